"""Coders' answers: the schema that asks for them, their cells, and whether they are what was asked for."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructType

from paperloom.functions.values import cell_type_check
from paperloom.operators.json_repair import tolerant_json

#: The degrees of confidence, and the field that needs none.
CONFIDENCE = ("high", "medium", "low")
NOTES = "notes"

_TEXT, _FLAG = StringType(), BooleanType()
_CELL = StructType().add("field", _TEXT).add("is_object", _FLAG).add("has_value", _FLAG).add("value_type", _TEXT).add("value_text", _TEXT).add("confidence", _TEXT).add("evidence", _TEXT)
_ITEM = StructType().add("row_id", _TEXT).add("cells", ArrayType(_CELL))
PARSED = StructType().add("repaired", _TEXT).add("is_json", _FLAG).add("is_object", _FLAG).add("has_effects", _FLAG).add("items", ArrayType(_ITEM))


@dataclass(frozen=True)
class Field:
    """One field of a codebook."""

    name: str
    type: str = "string"
    levels: tuple[str, ...] = ()
    evidence_required: bool = True


def _said(value: object) -> str | None:
    """A string as Arrow takes it (halves of surrogate pairs are replaced); anything else is null."""
    return value.encode("utf-8", "replace").decode() if isinstance(value, str) else None


def _cell(field: str, value: object) -> dict:
    inner = value.get("value") if isinstance(value, dict) else None
    kind = next(name for types, name in ((type(None), "null"), (bool, "boolean"), (int, "integer"), (float, "number"), (str, "string"), (list, "array"), (dict, "object")) if isinstance(inner, types))
    shown = None if inner is None else _said(inner) if kind == "string" else json.dumps(inner)
    more = value if isinstance(value, dict) else {}
    return {"field": _said(field), "is_object": isinstance(value, dict), "has_value": "value" in more, "value_type": kind, "value_text": shown, "confidence": _said(more.get("confidence")), "evidence": _said(more.get("evidence"))}


def repaired_json(raw: str) -> str | None:
    """A broken answer as JSON: as it stands, where no more is wrong with it than text around it, commas before a closing
    bracket, or an end that is missing; else as a recovering reader understands it; null where that can't tell."""
    closed = _closed_json(raw)
    return tolerant_json(raw) if closed is None else closed


def _closed_json(raw: str) -> str | None:
    starts = [i for i in (raw.find("{"), raw.find("[")) if i >= 0]
    out, open_, quoted, escaped = [], [], False, False
    for c in raw[min(starts) :] if starts else "":
        if quoted:
            quoted, escaped = c != '"' or escaped, c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
        elif c in "}]":
            while out and (out[-1].isspace() or out[-1] == ","):
                out.pop()
            if not open_ or open_.pop() != c:
                return None
        out.append(c)
        if starts and not open_ and not quoted:
            break
    text = "".join(out[:-1] if quoted and escaped else out) + ('"' if quoted else "")
    # what was cut off within a field goes up to the last whole value
    for _ in range(4):
        text = text.rstrip().rstrip(",")
        whole = text + "".join(reversed(open_))
        try:
            json.loads(whole)
            return whole if text else None
        except (ValueError, RecursionError):
            cut = max(text.rfind(","), text.rfind("{"), text.rfind("["))
            if cut < 0 or not open_ or any(x in text[cut + 1 :] for x in "}]"):
                return None
            text = text[: cut + (text[cut] != ",")]
    return None


@F.udf(returnType=PARSED, useArrow=True)
def parsed_response(raw: str | None) -> dict:
    """The boundary to untyped JSON: everything after it is columns. A broken text is repaired where it can be, and the
    repaired form told."""
    repaired = None
    try:
        parsed = json.loads(raw or "")
    except (ValueError, RecursionError):
        repaired = repaired_json(raw or "")
        if repaired is None:
            return {"repaired": None, "is_json": False, "is_object": False, "has_effects": False, "items": []}
        parsed = json.loads(repaired)
    effects = parsed.get("effects") if isinstance(parsed, dict) else None
    items = [x if isinstance(x, dict) else {} for x in effects] if isinstance(effects, list) else []
    rows = [{"row_id": _said(x.get("row_id")), "cells": [_cell(k, v) for k, v in x.items() if k != "row_id"]} for x in items]
    return {"repaired": _said(repaired), "is_json": True, "is_object": isinstance(parsed, dict), "has_effects": isinstance(effects, list), "items": rows}


def parse_response_cells(attempts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attempts (source_pdf, raw) as documents (source_pdf, repaired, is_json, is_object, has_effects, items) and as cells, one row
    per field of each item, numbered from 1 by ``position``. A null or broken text has no items."""
    documents = attempts.withColumn("_p", parsed_response("raw")).select("source_pdf", "_p.*")
    items = documents.select("source_pdf", F.posexplode("items").alias("position", "item"))
    cells = items.select("source_pdf", (F.col("position") + 1).alias("position"), "item.row_id", F.explode("item.cells").alias("cell"))
    return documents, cells.select("source_pdf", "position", "row_id", "cell.*")


def _listed(wrong: Callable[[Column], Column]) -> Column:
    """"`row`: a, b; `row`: c" of the items for which ``wrong`` gives fields; null if there are none."""
    rows = F.transform("items", lambda x: F.struct(x["row_id"].alias("row_id"), F.sort_array(wrong(x)).alias("names")))
    lines = F.transform(F.filter(rows, lambda r: F.size(r["names"]) > 0), lambda r: F.concat(F.lit("`"), r["row_id"], F.lit("`: "), F.array_join(r["names"], ", ")))
    return F.when(F.size(lines) > 0, F.array_join(lines, "; "))


def _verdict(fields: Sequence[Field], confidence: bool) -> Column:
    """(stage, error) of the first rule that a parsed response breaks, over ``items`` and the sorted ids ``asked``."""
    names = [f.name for f in fields]
    ids = F.transform("items", lambda x: x["row_id"])

    def offence(x: Column, i: Column) -> Column:
        blank = F.concat(F.lit("effects["), (i + 1).cast("string"), F.lit("] is missing a non-empty string `row_id`."))
        again = F.struct(F.lit("duplicate").alias("stage"), F.concat(F.lit("Duplicate row_id in response: `"), x["row_id"], F.lit("`.")).alias("error"))
        return F.when(x["row_id"].isNull() | (F.trim(x["row_id"]) == ""), F.struct(F.lit("row_id").alias("stage"), blank.alias("error"))).when(F.array_position(ids, x["row_id"]) <= i, again)

    def bad(c: Column) -> Column:
        wrong = F.lit(False)
        for f in fields:
            levels = F.array(*map(F.lit, f.levels)) if f.levels else F.lit(None).cast("array<string>")
            broken = ~c["has_value"] | ~cell_type_check(F.lit(f.type), levels, c["value_type"], c["value_text"])
            if confidence and f.name != NOTES:
                broken |= ~F.coalesce(c["confidence"].isin(*CONFIDENCE), F.lit(False))
            if f.evidence_required:
                broken |= F.trim(F.coalesce(c["evidence"], F.lit(""))) == ""
            wrong |= (c["field"] == f.name) & broken
        return wrong

    of = lambda x, test: F.transform(F.filter(x["cells"], test), lambda c: c["field"])
    expected = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    first = F.get(F.array_compact(F.transform("items", offence)), F.lit(0))
    omitted = _listed(lambda x: F.array_except(expected, F.transform(x["cells"], lambda c: c["field"])))
    malformed = _listed(lambda x: of(x, lambda c: c["field"].isin(*names) & ~c["is_object"]))
    invalid = _listed(lambda x: of(x, bad))
    say = lambda stage, error: F.struct(F.lit(stage).alias("stage"), error.alias("error"))
    told = lambda text, which: F.concat(F.lit(f"Response {text} field"), F.lit("(s): " if text.startswith("omitted") else " value(s): "), which, F.lit("."))
    return (
        F.when(~F.col("is_json"), say("json", F.lit("Response is not valid JSON.")))
        .when(~F.col("is_object"), say("object", F.lit("Response is not a JSON object.")))
        .when(~F.col("has_effects"), say("effects", F.lit("Response is missing an `effects` array.")))
        .when(first.isNotNull(), first)
        .when(omitted.isNotNull(), say("omitted", told("omitted required", omitted)))
        .when(malformed.isNotNull(), say("malformed", told("returned malformed", malformed)))
        .when(invalid.isNotNull(), say("invalid", told("returned invalid", invalid)))
        .when(F.sort_array(ids) != F.col("asked"), say("ids", F.lit("Returned row_id set does not match the requested set.")))
    )


def validate_response(documents: DataFrame, requested: DataFrame, fields: Sequence[Field], confidence: bool = False) -> DataFrame:
    """Parsed documents against the requested rows (source_pdf, row_id): (source_pdf, ok, stage, error, missing, extra).

    The first broken rule decides; a response is never accepted in part, and the items' order means nothing. Missing
    and extra ids are told only where the ids are what is wrong. A document of which nothing was requested has no
    ids to return. An answer is one row, so nothing but the requested ids is shuffled."""
    asked = requested.groupBy("source_pdf").agg(F.sort_array(F.collect_set("row_id")).alias("asked"))
    none = F.array().cast("array<string>")
    judged = documents.join(asked, "source_pdf", "left").withColumn("asked", F.coalesce("asked", none)).withColumn("v", _verdict(fields, confidence))
    ids = F.transform("items", lambda x: x["row_id"])
    apart = F.coalesce(F.col("v.stage") == "ids", F.lit(False))
    missing, extra = F.array_except("asked", ids), F.sort_array(F.array_except(ids, "asked"))
    return judged.select("source_pdf", F.col("v").isNull().alias("ok"), "v.stage", "v.error", F.when(apart, missing).otherwise(none).alias("missing"), F.when(apart, extra).otherwise(none).alias("extra"))


def replay(attempts: DataFrame, requested: DataFrame, fields: Sequence[Field], confidence: bool = False) -> DataFrame:
    """Attempts, one per document (source_pdf, status, error, raw), with status and error as today's rules decide.
    One without a raw response stays as it is; what is no JSON, and can't be repaired, is an error; a repaired one needs
    review, whatever else is right with it."""
    has_raw = F.coalesce(F.col("raw") != "", F.lit(False))
    documents = parse_response_cells(attempts.where(has_raw))[0]
    verdict = validate_response(documents, requested, fields, confidence).join(documents.select("source_pdf", "repaired"), "source_pdf")
    fine = F.when(F.col("repaired").isNull(), "ok").otherwise("needs_review")
    again = verdict.select("source_pdf", F.when(F.col("ok"), fine).when(F.col("stage") == "json", "error").otherwise("needs_review").alias("now"), F.col("error").alias("why"))
    out = attempts.join(again, "source_pdf", "left")
    seen = F.col("now").isNotNull()
    return out.select("source_pdf", F.when(seen, F.col("now")).otherwise(F.col("status")).alias("status"), F.when(seen, F.col("why")).otherwise(F.col("error")).alias("error"), "raw")


def _quoted(text: Column) -> Column:
    """A JSON string."""
    inside = F.to_json(F.array(text))
    return F.substring(inside, F.lit(2), F.length(inside) - 2)


def response_schema(codebooks: DataFrame, fields: DataFrame, dialect: str = "json_schema") -> DataFrame:
    """(codebook_id, schema_json): codebooks (codebook_id, confidence) and fields (codebook_id, ordinal, field, type,
    levels, description, evidence_required) as the JSON schema of an answer. ``gemini`` writes types in capitals and
    ``nullable``; ``json_schema`` has null among the types and closed objects. A codebook without fields has none."""
    if dialect not in ("gemini", "json_schema"):
        raise ValueError(f"no such dialect: {dialect}")
    closed = dialect == "json_schema"
    kind = lambda name: json.dumps(name if closed else name.upper())
    end = F.lit(',"additionalProperties":false}' if closed else "}")
    type_ = F.concat(F.lit('["'), F.col("type"), F.lit('","null"]')) if closed else F.concat(F.lit('"'), F.upper("type"), F.lit('","nullable":true'))
    levels = F.array_join(F.transform("levels", _quoted), ",")
    enum = F.when(F.coalesce(F.size("levels"), F.lit(0)) > 0, F.concat(F.lit(',"enum":['), levels, F.lit(",null]" if closed else "]"))).otherwise("")
    value = F.concat(F.lit('"value":{"type":'), type_, enum, F.lit("}"))
    sure = F.col("confidence") & (F.col("field") != NOTES)
    degree = f',"confidence":{{"type":{kind("string")},"description":"How confident you are in this value.","enum":{json.dumps(CONFIDENCE, separators=(",", ":"))}}}'
    proof = f',"evidence":{{"type":{kind("string")},"description":"Page number or a short quotation that supports this value."}}'
    required = F.concat(F.lit('["value"'), F.when(sure, ',"confidence"').otherwise(""), F.when(F.col("evidence_required"), ',"evidence"').otherwise(""), F.lit("]"))
    about = F.coalesce(F.nullif("description", F.lit("")), F.concat(F.lit("Coded value for `"), F.col("field"), F.lit("`.")))
    one = F.concat(
        _quoted(F.col("field")), F.lit(f':{{"type":{kind("object")},"description":'), _quoted(about), F.lit(',"properties":{'), value,
        F.when(sure, degree).otherwise(""), F.when(F.col("evidence_required"), proof).otherwise(""), F.lit('},"required":'), required, end,
    )
    rows = fields.join(codebooks.select("codebook_id", "confidence"), "codebook_id").select("codebook_id", F.struct("ordinal", one.alias("json"), _quoted(F.col("field")).alias("name")).alias("f"))
    grouped = rows.groupBy("codebook_id").agg(F.sort_array(F.collect_list("f")).alias("f"))
    head = F.lit(f'{{"type":{kind("object")},"properties":{{"effects":{{"type":{kind("array")},"description":"One entry per requested row.","items":{{"type":{kind("object")},"properties":{{"row_id":{{"type":{kind("string")},"description":"One of the requested row ids, unchanged."}},')
    tail = F.array_join(F.transform("f", lambda x: x["name"]), ",")
    schema = F.concat(head, F.array_join(F.transform("f", lambda x: x["json"]), ","), F.lit('},"required":["row_id",'), tail, F.lit("]"), end, F.lit('}},"required":["effects"]'), end)
    return grouped.select("codebook_id", schema.alias("schema_json"))


def exchange_facts(exchanges: DataFrame) -> DataFrame:
    """Exchanges (id, http_status, error, raw) to status, reported model, response id, system fingerprint and usage (as
    JSON). A body that is no JSON object has no facts; without status, error and body the exchange is in progress."""
    at = lambda *paths: F.coalesce(*(F.nullif(F.get_json_object("raw", p), F.lit("")) for p in paths))
    status = F.when(F.col("http_status") >= 400, "http_error").when(F.col("error").isNotNull(), "transport_error").when(F.col("raw").isNotNull(), "received").otherwise("in_progress")
    fact = lambda *paths: F.when(F.col("status") == "received", at(*paths))
    return exchanges.withColumn("status", status).select(
        "id", "status", fact("$.modelVersion", "$.model").alias("reported_model"), fact("$.responseId", "$.id").alias("response_id"),
        fact("$.system_fingerprint").alias("system_fingerprint"), fact("$.usageMetadata", "$.usage").alias("usage"),
    )
