"""Attempts and results: which result stands, what is stale, and what is to be done next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.plans.staging import stage

RETRY = ("error", "needs_review", "cancelled", "stale")


def latest_attempt(attempts: DataFrame) -> DataFrame:
    """The last attempt of each document (by attempt_ts, then attempt)."""
    rest = [c for c in attempts.columns if c != "source_pdf"]
    return attempts.groupBy("source_pdf").agg(F.max_by(F.struct(*rest), F.struct("attempt_ts", "attempt")).alias("r")).select("source_pdf", "r.*")


def selected_result(attempts: DataFrame) -> DataFrame:
    """The result that stands: the last success, or the last attempt where there is none."""
    rest = [c for c in attempts.columns if c != "source_pdf"]
    rank = F.struct((F.col("status") == "ok").alias("ok"), "attempt_ts", "attempt")
    return attempts.groupBy("source_pdf").agg(F.max_by(F.struct(*rest), rank).alias("r")).select("source_pdf", "r.*")


def kept_success(attempts: DataFrame) -> DataFrame:
    """Documents whose last attempt failed while an earlier success stands."""
    both = attempts.groupBy("source_pdf").agg(F.max_by("status", F.struct("attempt_ts", "attempt")).alias("last"), F.bool_or(F.col("status") == "ok").alias("ok"))
    return both.where("ok and last <> 'ok'").select("source_pdf")


def pending_documents(valid: DataFrame, results: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Documents with valid rows and no current success; ``only`` (source_pdf) asks for some whatever their state."""
    documents = valid.select("source_pdf").distinct()
    if only is not None:
        return documents.join(only, "source_pdf", "left_semi")
    return documents.join(results.where("status = 'ok'"), "source_pdf", "left_anti")


def retry_candidates(results: DataFrame, valid: DataFrame) -> DataFrame:
    return results.where(F.col("status").isin(*RETRY)).join(valid, "source_pdf", "left_semi").select("source_pdf", "status")


#: The settings that a provider's answers depend on, beside provider and model.
SETTINGS = {"gemini": (), "openrouter": ("reasoning_effort",), "openai_compatible": ("reasoning_effort", "base_url", "response_format")}


def input_fingerprint(valid: DataFrame, digests: DataFrame, codebook_hash: str | None, provider: str, model: str, version: str = "1", **settings: str) -> DataFrame:
    """(source_pdf, fingerprint): a hash of all that a result depends on: the codebook, the rows with their locators in any
    order, the document, provider, model and those ``settings`` that the provider heeds. Bibliography doesn't count. A
    document without rows, or that isn't there, has none; nor has any without a codebook."""
    rows = valid.groupBy("source_pdf").agg(F.sort_array(F.collect_list(F.struct("row_id", "locator"))).alias("rows"))
    heeded = [F.lit(settings.get(k, "") if k in SETTINGS.get(provider, tuple(settings)) else "").alias(k) for k in ("base_url", "reasoning_effort", "response_format")]
    inputs = F.struct(F.lit(version).alias("version"), F.lit(codebook_hash).alias("codebook"), F.lit(provider).alias("provider"), F.lit(model).alias("model"), *heeded, "digest", "rows")
    out = rows.join(digests, rows.source_pdf == digests.name).select("source_pdf", F.sha2(F.to_json(inputs, {"ignoreNullFields": "false"}), 256).alias("fingerprint"))
    return out.where(F.lit(codebook_hash is not None))


#: What a stale result loses.
BLANKED = ("coded_by_row_id", "missing_ids", "extra_ids")


def mark_stale(results: DataFrame, fingerprints: DataFrame, valid: DataFrame) -> DataFrame:
    """Results (source_pdf, status, input_fingerprint, error, ...) against today's fingerprints: one that doesn't
    match is stale, with the reason, and its values and ids (``BLANKED``, where there are such columns) are empty; one
    without a fingerprint is from before there were any and stays."""
    rows = valid.select("source_pdf").distinct().withColumn("_rows", F.lit(True))
    out = results.join(fingerprints, "source_pdf", "left").join(rows, "source_pdf", "left")
    current = F.col("input_fingerprint").isNull() | F.coalesce(F.col("input_fingerprint") == F.col("fingerprint"), F.lit(False))
    why = F.when(F.col("fingerprint").isNull() & F.col("_rows"), "document is missing").otherwise("inputs have changed")
    empty = lambda kind: F.from_json(F.lit("{}"), kind) if kind.startswith("map") else F.from_json(F.lit("[]"), kind)
    blank = {c: F.when(current, F.col(c)).otherwise(empty(kind)) for c, kind in results.dtypes if c in BLANKED}
    out = out.withColumns({"error": F.when(current, F.col("error")).otherwise(why), "status": F.when(current, F.col("status")).otherwise("stale"), **blank})
    return out.select(results.columns)


_COUNTED = {"input_tokens": "long", "output_tokens": "long", "repaired": "boolean", "low_confidence": "long"}


def run_progress(worklist: DataFrame, attempts: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """One row: documents in all, processed, by status, tokens, repaired answers and cells of low confidence. ``live``
    (source_pdf, status, and any of the counts) is what runs now, and stands before the last attempt of the past."""
    past = latest_attempt(attempts)
    have = lambda df: df.select("source_pdf", "status", *(F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in _COUNTED.items()))
    last = have(past) if live is None else have(past.join(live, "source_pdf", "left_anti")).unionByName(have(live))
    last = worklist.select("source_pdf").distinct().join(last, "source_pdf", "left")
    by = [F.count_if(F.col("status") == s).alias(s) for s in ("ok", "needs_review", "error", "cancelled")]
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "low_confidence")]
    done = F.count_if(F.col("status").isNotNull() & (F.col("status") != "running")).alias("processed")
    return last.agg(F.count("*").alias("total"), done, *by, F.count_if("repaired").alias("repaired"), *sums)


def article_table(results: DataFrame, valid: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row per document with rows: its first row's authors and year, its result, and flags: may it be tried again,
    does an earlier success stand for it (kept), and is it a success from before there were fingerprints (unverified)?"""
    first = valid.groupBy("source_pdf").agg(F.min_by("authors", "ordinal").alias("authors"), F.min_by("year", "ordinal").alias("year"), F.count("*").alias("n_rows"))
    kept = kept_success(attempts).withColumn("kept", F.lit(True))
    more = [F.col(c).cast(t).alias(c) if c in results.columns else F.lit(None).cast(t).alias(c) for c, t in (*_COUNTED.items(), ("input_fingerprint", "string"))]
    out = first.join(results.select("source_pdf", "status", *more), "source_pdf", "left").join(kept, "source_pdf", "left")
    status = F.coalesce("status", F.lit("not_run"))
    unverified = (status == "ok") & F.col("input_fingerprint").isNull() if "input_fingerprint" in results.columns else F.lit(False)
    return out.select("source_pdf", "authors", "year", "n_rows", status.alias("status"), *_COUNTED, status.isin(*RETRY).alias("retryable"), F.coalesce("kept", F.lit(False)).alias("kept"), unverified.alias("unverified"))


def sort_articles(articles: DataFrame, key: str = "source_pdf", descending: bool = False) -> DataFrame:
    """By a column; texts without regard to case, missing numbers as -1, names deciding ties."""
    text = dict(articles.dtypes)[key] == "string"
    by: Column = F.lower(key) if text else F.coalesce(F.col(key), F.lit(-1))
    return articles.orderBy(by.desc() if descending else by.asc(), "source_pdf")


#: Rows up to which a page is found as the top of all rows.
TOP_ROWS = 10_000


class Pages:
    """Ordered rows cut into ranges of about equal numbers, staged, with the number of rows of each: a page, however deep, is
    read from the range or the two that hold it, and sorted there. Rows that the order leaves equal are put in the order
    of their other columns, so pages never overlap."""

    def __init__(self, rows: DataFrame, order: list[str], page_size: int = 10, ranges: int | None = None):
        self.order = [*order, *(c for c, kind in rows.dtypes if c not in order and not kind.startswith(("map", "variant")))]
        self.page_size, self.columns = page_size, rows.columns
        dealt = rows.repartitionByRange(ranges, *self.order) if ranges else rows.repartitionByRange(*self.order)
        self.rows = stage(dealt.withColumn("_range", F.spark_partition_id()), "pages")
        self.counts = {r["_range"]: r["n"] for r in self.rows.groupBy("_range").agg(F.count("*").alias("n")).collect()}  # a number per range
        self.n = sum(self.counts.values())

    def page(self, page: int) -> DataFrame:
        """One page; beyond the last it is the last, before the first the first."""
        first = (min(max(page, 1), max(1, -(-self.n // self.page_size))) - 1) * self.page_size
        held, since, before = [], 0, 0
        for k in sorted(self.counts):
            if since < first + self.page_size and since + self.counts[k] > first:
                held, before = [*held, k], before if held else since
            since += self.counts[k]
        near = self.rows.where(F.col("_range").isin(held)) if held else self.rows.limit(0)
        return near.orderBy(*self.order).offset(max(0, first - before)).limit(self.page_size).select(self.columns)


def paginate(rows: DataFrame, order: list[str], page: int, page_size: int = 10) -> DataFrame:
    """One page of the ordered rows; a page beyond the last is the last, one before the first the first. The rows are
    counted when this is called. A page among the first ``TOP_ROWS`` is the end of a top-k, a deeper one is read from the
    range of rows that holds it; for many pages of the same rows keep a ``Pages``."""
    n = rows.count()
    at = min(max(page, 1), max(1, -(-n // page_size)))
    if at * page_size > TOP_ROWS:
        return Pages(rows, order, page_size).page(at)
    ordered = [*order, *(c for c, kind in rows.dtypes if c not in order and not kind.startswith(("map", "variant")))]
    return rows.orderBy(*ordered).offset((at - 1) * page_size).limit(page_size)


def attempt_status(call_error: Column, cancelled: Column, problem: Column, flags: Column) -> Column:
    """A struct of status and error: a failed call is an error, or cancelled; an invalid response or one with review
    flags (an array) needs review, its reasons joined; else ok. Null is no problem."""
    reasons = F.array_join(F.array_compact(F.concat(F.array(problem), F.coalesce(flags, F.array().cast("array<string>")))), "; ")
    state = lambda status, error: F.struct(F.lit(status).alias("status"), error.alias("error"))
    none = F.lit(None).cast("string")
    return F.when(F.coalesce(cancelled, F.lit(False)), state("cancelled", call_error)).when(call_error.isNotNull(), state("error", call_error)).when(reasons != "", state("needs_review", reasons)).otherwise(state("ok", none))


def search_sort(named: DataFrame, text: str = "", order: str = "newest") -> DataFrame:
    """Of (id, name, created_at) those whose name holds ``text``, whatever the case, with the number of all (total) and of
    those that match (matching). In the order newest, oldest or name, ids deciding ties; any other order is newest."""
    rows = named.select("id", "name", "created_at")
    found = rows.where(F.contains(F.lower("name"), F.lower(F.lit(text.strip()))))
    # one row each
    found = found.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total")))).crossJoin(F.broadcast(found.agg(F.count("*").alias("matching"))))
    by = {"oldest": [F.col("created_at").asc(), F.col("id").asc()], "name": [F.lower("name").asc(), F.col("id").asc()]}
    return found.orderBy(*by.get(order, [F.col("created_at").desc(), F.col("id").desc()]))
