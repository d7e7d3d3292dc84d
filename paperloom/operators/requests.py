"""One request per document, the coder that answers it, and the envelopes of answers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.values import normalize_finish_reason


def build_requests(valid: DataFrame, texts: DataFrame, rules: str, codebooks: DataFrame, confidence_rule: str = "") -> DataFrame:
    """(source_pdf, row_ids, prompt): rules, with the rule on confidence if the codebook asks for it; what an effect is; the
    codebook; the rows asked for with their locators, and the text.

    ``valid`` rows name their ``codebook_id``; ``codebooks`` (codebook_id, text, effect_definition, confidence) may be many.
    A document whose rows have several codebooks gets a request for each; one whose codebook, or text, is not there gets
    none."""
    rows = F.sort_array(F.collect_list(F.struct("ordinal", "row_id", F.when(F.trim("locator") == "", "(none)").otherwise(F.col("locator")).alias("locator"))))
    asked = valid.groupBy("source_pdf", "codebook_id").agg(rows.alias("r"))
    books = codebooks.select("codebook_id", F.col("text").alias("_book"), "effect_definition", "confidence")
    lines = F.array_join(F.transform("r", lambda x: F.concat(F.lit("- "), x["row_id"], F.lit(": "), F.coalesce(x["locator"], F.lit("(none)")))), "\n")
    all_rules = F.when(F.col("confidence"), F.concat_ws("\n", F.lit(rules), F.nullif(F.lit(confidence_rule), F.lit("")))).otherwise(rules)
    effect = F.concat(F.lit("An effect:\n"), "effect_definition")
    prompt = F.concat_ws("\n\n", all_rules, effect, "_book", F.concat(F.lit("Rows: "), F.size("r").cast("string")), lines, "text")
    out = asked.join(books, "codebook_id").join(texts.select(F.col("name").alias("source_pdf"), "text"), "source_pdf")
    return out.select("source_pdf", "codebook_id", F.transform("r", lambda x: x["row_id"]).alias("row_ids"), prompt.alias("prompt"))


def annotate_documents(requests: DataFrame, coder: Callable[[str, list[str]], str], max_attempts: int = 3, delay: float = 2.0) -> DataFrame:
    """Applies ``coder(prompt, row_ids) -> raw response`` to each request on the executors: (source_pdf, status, raw,
    error, attempts). A coder that fails is asked again after ``delay`` seconds, twice as long each time, and then gives
    an error row; the job goes on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for pdf, ids, prompt in zip(batch["source_pdf"], batch["row_ids"], batch["prompt"]):
                for n in range(1, max_attempts + 1):
                    try:
                        out.append((pdf, "received", coder(prompt, list(ids)), None, n))
                        break
                    except Exception as e:  # whatever a coder raises becomes a row
                        if n < max_attempts:
                            time.sleep(delay * 2 ** (n - 1))
                        else:
                            out.append((pdf, "error", None, f"{type(e).__name__}: {e}", n))
            yield pd.DataFrame(out, columns=["source_pdf", "status", "raw", "error", "attempts"])

    return requests.select("source_pdf", "row_ids", "prompt").mapInPandas(run, "source_pdf string, status string, raw string, error string, attempts int")


def _kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, BOOLEAN, VOID, ... of a variant; null where there is none."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _within(value: Column, path: str, type_: str = "variant") -> Column:
    return F.try_variant_get(value, path, type_)


def _given(value: Column) -> Column:
    """A variant, or null where it is null or empty in the sense of JSON's readers: "", 0, false, [] and {}."""
    return F.when(~F.to_json(value).isin("null", '""', "0", "0.0", "false", "[]", "{}"), value)


def _wrong(value: Column, kind: str) -> Column:
    """Whether a variant is given and is of another kind."""
    return F.coalesce(_kind(_given(value)) != kind, F.lit(False))


def _count(usage: Column, name: str) -> Column:
    value = _within(usage, f"$.{name}")
    return F.when(_kind(value) == "BIGINT", _within(usage, f"$.{name}", "bigint"))


def parse_envelope(exchanges: DataFrame) -> DataFrame:
    """(id, raw) to text, finish reason, tokens, model and error, from either provider's JSON.

    Candidates: the texts of all parts of all candidates, joined. Choices: the first one's message. An envelope that is no
    JSON object, or has a part of another kind than it must have, is an error and gives nothing else; so is one without
    text, as ``no text``. Counts that are no integers are an error among candidates, and null among choices."""
    e = exchanges.select("id", F.try_parse_json("raw").alias("v")).withColumns({"choices": _within(F.col("v"), "$.choices"), "candidates": _within(F.col("v"), "$.candidates")})
    none = F.array().cast("array<variant>")
    listed = lambda v, path="$": F.coalesce(_within(_given(v), path, "array<variant>"), none)
    candidates = F.when(_kind(F.col("candidates")) == "ARRAY", listed(F.col("candidates"))).otherwise(none)
    e = e.withColumn("c", candidates)
    content = lambda c: _given(_within(c, "$.content"))
    parts = lambda c: F.when(_kind(content(c)) == "OBJECT", F.when(_kind(_within(content(c), "$.parts")) == "ARRAY", listed(_within(content(c), "$.parts"))).otherwise(none)).otherwise(none)
    e = e.withColumn("parts", F.flatten(F.transform("c", lambda c: F.when(_kind(c) == "OBJECT", parts(c)).otherwise(none))))
    said = lambda x: _within(x, "$.text")
    usage, tokens = _within(F.col("v"), "$.usageMetadata"), ("promptTokenCount", "candidatesTokenCount", "thoughtsTokenCount")
    bad_counts = F.lit(False)
    for name in tokens:
        bad_counts |= F.coalesce(~_kind(_within(usage, f"$.{name}")).isin("BIGINT", "VOID"), F.lit(False))
    first = F.try_element_at(F.when(_kind(F.col("choices")) == "ARRAY", listed(F.col("choices"))).otherwise(none), F.lit(1))
    by_choice = F.col("choices").isNotNull()
    message = _given(_within(first, "$.message"))
    text = F.when(by_choice, F.when(_kind(_within(message, "$.content")) == "STRING", _within(message, "$.content", "string")))
    text = text.otherwise(F.array_join(F.transform(F.filter("parts", lambda x: _kind(said(x)) == "STRING"), lambda x: _within(x, "$.text", "string")), ""))
    error = (
        F.when(F.col("v").isNull() | (_kind(F.col("v")) != "OBJECT"), "no JSON object")
        .when(by_choice & _wrong(F.col("choices"), "ARRAY"), "choices are no list")
        .when(by_choice & F.coalesce(_kind(first) != "OBJECT", F.lit(True)), "choice is no object")
        .when(by_choice & _wrong(message, "OBJECT"), "message is no object")
        .when(_wrong(F.col("candidates"), "ARRAY"), "candidates are no list")
        .when(F.exists("c", lambda c: _kind(c) != "OBJECT"), "candidate is no object")
        .when(F.exists("c", lambda c: _wrong(_within(c, "$.content"), "OBJECT")), "content is no object")
        .when(F.exists("c", lambda c: _wrong(_within(content(c), "$.parts"), "ARRAY")), "parts are no list")
        .when(F.exists("parts", lambda x: _kind(x) != "OBJECT"), "part is no object")
        .when(F.exists("parts", lambda x: F.coalesce(_kind(said(x)) != "STRING", F.lit(False))), "text is no string")
        .when(~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)), "no text")
        .when(~by_choice & (_wrong(usage, "OBJECT") | bad_counts), "usage is malformed")
    )
    e = e.withColumn("text", text).withColumn("error", error)
    answer, thought = _count(usage, tokens[1]), _count(usage, tokens[2])
    both = F.when(answer.isNotNull() | thought.isNotNull(), F.coalesce(answer, F.lit(0)) + F.coalesce(thought, F.lit(0)))
    own = _within(F.col("v"), "$.usage")
    name = lambda path: F.when(_kind(_within(F.col("v"), path)) == "STRING", F.nullif(_within(F.col("v"), path, "string"), F.lit("")))
    ended = F.when(by_choice, _within(first, "$.finish_reason", "string")).otherwise(_within(F.try_element_at("c", F.lit(1)), "$.finishReason", "string"))
    fine = lambda c: F.when(F.col("error").isNull(), c)
    return e.select(
        "id",
        fine(F.col("text")).alias("text"),
        fine(normalize_finish_reason(ended)).alias("finish_reason"),
        fine(F.when(by_choice, _count(own, "prompt_tokens")).otherwise(_count(usage, tokens[0]))).alias("input_tokens"),
        fine(F.when(by_choice, _count(own, "completion_tokens")).otherwise(both)).alias("output_tokens"),
        fine(F.when(by_choice, name("$.model")).otherwise(name("$.modelVersion"))).alias("served_model"),
        "error",
    )


def attempt_provenance_link(results: DataFrame, operations: DataFrame) -> DataFrame:
    """Results whose served model differs from the one their operation asked for, or whose operation is unknown."""
    out = results.join(operations.select("operation_id", F.col("model").alias("asked_model")), "operation_id", "left")
    problem = F.when(F.col("asked_model").isNull(), "unknown operation").when(F.col("asked_model") != F.col("served_model"), "another model served")
    return out.withColumn("problem", problem).where("problem is not null").select("source_pdf", "operation_id", "asked_model", "served_model", "problem")


def incremental_signals(documents: DataFrame, stored: DataFrame, version: int) -> DataFrame:
    """Documents (name, size, mtime) to scan: those without a stored signal of this size, time and version."""
    return documents.join(stored.where(F.col("version") == version).select("name", "size", "mtime"), ["name", "size", "mtime"], "left_anti")
