"""Reading document files, result records and sheets of any layout."""

from __future__ import annotations

import csv
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions.text import collision_free_key

#: The size of an upload, and of a sheet that may be converted.
MAX_BYTES = 128 * 1024 * 1024
MAX_ROWS, MAX_CHARS, SNIFFED = 2_000, 500_000, 8_192

_TEXTS = ("error", "raw_response", "repaired_response", "audit_operation_id", "input_fingerprint", "provider", "model", "served_model")


def scan_documents(spark: SparkSession, path: str, suffix: str = ".pdf", magic: bytes = b"%PDF", max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """Files of a suffix (in any case) below ``path``: accepted (name, path, bytes) and rejected (name, path, bytes,
    error). Contents stay where they are; a file that is too large is not opened."""
    pattern = "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    named = lambda df: df.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.col("length").alias("bytes"), "ok")
    small = named(files.where(F.col("length") <= max_bytes).withColumn("ok", F.col("content").substr(1, len(magic)) == F.lit(bytearray(magic))))
    large = named(files.where(F.col("length") > max_bytes).withColumn("ok", F.lit(False)))
    wrong = small.where(~F.col("ok")).withColumn("error", F.lit(f"not a {suffix[1:].upper()}")).unionByName(large.withColumn("error", F.lit("too large")))
    return small.where("ok").drop("ok"), wrong.drop("ok")


def scan_results(spark: SparkSession, path: str) -> DataFrame:
    """Attempts from JSON records, one per file, with the file's name and whether it is the one that the document's own
    name gives (``is_canonical``). A record that can't be read, is no object, or has no source_pdf is skipped, and so is a
    copy of a latest attempt (``*.attempt.json``); without status it is an error; absent collections are empty.

    ``coded_by_row_id`` stays VARIANT, so coded values keep their JSON types: ``result_cells`` lists them."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(F.col("_metadata.file_name").alias("file_name"), F.try_parse_json("value").alias("v"))
    files = files.where(~F.col("file_name").endswith(".attempt.json"))
    get = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    none = F.array().cast("array<string>")
    ids = lambda name: F.sort_array(F.array_distinct(F.coalesce(get(name, "array<string>"), none)))
    coded = get("coded_by_row_id", "variant")
    is_object = F.schema_of_variant(coded).startswith("OBJECT")
    read = files.select(
        "file_name",
        get("source_pdf", "string").alias("source_pdf"),
        F.coalesce(F.nullif(get("status", "string"), F.lit("")), F.lit("error")).alias("status"),
        F.when(is_object, coded).otherwise(F.parse_json(F.lit("{}"))).alias("coded_by_row_id"),
        ids("missing_ids").alias("missing_ids"),
        ids("extra_ids").alias("extra_ids"),
        *(get(c, "string").alias(c) for c in _TEXTS),
        F.coalesce(get("duration_sec", "double"), F.lit(0.0)).alias("duration_sec"),
        *(get(c, "long").alias(c) for c in ("input_tokens", "output_tokens")),
    )
    return read.where("source_pdf <> ''").withColumn("is_canonical", F.col("file_name") == F.concat(collision_free_key(F.col("source_pdf")), F.lit(".json")))


#: JSON types by the first word of a variant's type.
_KINDS = {"STRING": "string", "BIGINT": "integer", "BOOLEAN": "boolean", "VOID": "null", "DOUBLE": "number", "DECIMAL": "number", "FLOAT": "number", "ARRAY": "array", "OBJECT": "object"}


def result_cells(records: DataFrame) -> DataFrame:
    """Coded values of records (source_pdf, coded_by_row_id) as cells: (source_pdf, row_id, field, is_object, present, value,
    value_type, value_text, confidence, evidence, evidence_is_string). ``true`` and ``"true"`` differ in value_type; a null
    value is present and of type null, one that is not there is not present."""
    view = f"_records_{uuid.uuid4().hex}"
    records.select("source_pdf", "coded_by_row_id").createOrReplaceTempView(view)
    spark = records.sparkSession
    # fields of a row that is no object: none
    cells = spark.sql(f"SELECT r.source_pdf, a.key AS row_id, c.key AS field, c.value AS cell FROM {view} r, LATERAL variant_explode(r.coded_by_row_id) a, LATERAL variant_explode(a.value) c WHERE c.key IS NOT NULL")
    kind = lambda v: F.create_map(*(F.lit(x) for k in _KINDS.items() for x in k))[F.regexp_extract(F.schema_of_variant(v), "^([A-Z]+)", 1)]
    value, evidence = F.try_variant_get("cell", "$.value", "variant"), F.try_variant_get("cell", "$.evidence", "variant")
    told = kind(value)
    return cells.select(
        "source_pdf",
        "row_id",
        "field",
        (kind(F.col("cell")) == "object").alias("is_object"),
        value.isNotNull().alias("present"),
        value.alias("value"),
        told.alias("value_type"),
        F.when(told.isin("array", "object"), F.to_json(value)).otherwise(F.try_variant_get(value, "$", "string")).alias("value_text"),
        F.try_variant_get("cell", "$.confidence", "string").alias("confidence"),
        F.try_variant_get("cell", "$.evidence", "string").alias("evidence"),
        F.coalesce(kind(evidence) == "string", F.lit(False)).alias("evidence_is_string"),
    )


def scan_delimited_any(spark: SparkSession, path: str, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> tuple[list[str], DataFrame]:
    """The header and the rows (source_row from 1, cells) of one short CSV of unknown delimiter; blank rows go. The
    delimiter is told from the first lines; a file beyond the limits, or without rows, is refused."""
    lines = spark.read.text(path)
    chars = lines.agg(F.sum(F.length("value") + 1)).first()[0] or 0
    if chars > max_chars + 1:
        raise ValueError("The CSV is too large.")
    sample = "\n".join(r.value for r in lines.head(SNIFFED))[:SNIFFED].lstrip("﻿")
    try:
        sep = csv.Sniffer().sniff(sample, delimiters=",;\t|").delimiter
    except csv.Error:
        sep = ","
    read = spark.read.csv(path, sep=sep, header=False, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, mode="PERMISSIVE")
    cells = F.transform(F.array(*(F.col(c) for c in read.columns)), lambda c: F.coalesce(c, F.lit("")))
    full = read.select(F.monotonically_increasing_id().alias("at"), cells.alias("cells")).where(F.exists("cells", lambda c: F.trim(c) != ""))
    # a file within the limits: one task numbers its rows
    rows = full.select((F.row_number().over(Window.orderBy("at")) - 1).alias("source_row"), "cells")
    n = rows.count()
    if n < 2:
        raise ValueError("The CSV needs a header and at least one data row.")
    if n - 1 > max_rows:
        raise ValueError(f"Convert at most {max_rows} source rows at a time.")
    return [c.lstrip("﻿") for c in rows.where("source_row = 0").first().cells], rows.where("source_row > 0")
