"""From coded cells to the wide tables that people read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("row_id", "source_pdf", "locator", "authors", "year", "status")


def _wide(valid: DataFrame, results: DataFrame, cells: DataFrame, fields: list[str], shown: Column) -> DataFrame:
    """The sheet, each row with its document's status and one column per field; a missing cell is blank, and of cells that
    are given twice the greatest text is shown."""
    long = cells.select("row_id", "field", shown.alias("_shown")).where(F.col("field").isin(*fields))
    wide = long.groupBy("row_id").pivot("field", fields).agg(F.max("_shown"))
    status = results.select("source_pdf", "status")
    out = valid.join(status, "source_pdf", "left").join(wide, "row_id", "left")
    return out.select(*(F.coalesce("status", F.lit("not_run")).alias(c) if c == "status" else c for c in BASE), *(F.coalesce(f, F.lit("")).alias(f) for f in fields))


def collate_coded(valid: DataFrame, results: DataFrame, cells: DataFrame, fields: list[str]) -> DataFrame:
    """Coded values; null is shown as `Not Reported`, an absent cell as blank."""
    return _wide(valid, results, cells, fields, F.when(F.col("value_type") == "null", "Not Reported").otherwise(F.col("value_text")))


def collate_evidence(valid: DataFrame, results: DataFrame, cells: DataFrame, fields: list[str]) -> DataFrame:
    return _wide(valid, results, cells, fields, F.col("evidence"))


def collate_key(key: str, valid: DataFrame, results: DataFrame, cells: DataFrame, fields: list[str]) -> DataFrame:
    """Any other key of the cells (such as confidence); never for notes."""
    return _wide(valid, results, cells, fields, F.when(F.col("field") != "notes", F.col(key).cast("string")))


def collate_provenance(valid: DataFrame, results: DataFrame) -> DataFrame:
    """Who coded each row: blank where unknown."""
    out = valid.join(results.select("source_pdf", "provider", "model", "operation_id"), "source_pdf", "left")
    return out.select("row_id", "source_pdf", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("provider", "model", "operation_id")))


def low_confidence_cells(cells: DataFrame, valid: DataFrame, rated: DataFrame) -> DataFrame:
    """Per document, how many of its rows' rated cells were coded with low confidence."""
    low = cells.where("confidence = 'low'").join(rated.select("field").distinct(), "field", "left_semi")
    return valid.select("row_id", "source_pdf").join(low.select("row_id", "field"), "row_id", "left").groupBy("source_pdf").agg(F.count("field").alias("n"))


def rated_fields(codebooks: DataFrame, fields: DataFrame) -> DataFrame:
    """Fields that carry a confidence: all but notes, in codebooks that ask for it."""
    return fields.join(codebooks.where("confidence"), "codebook_id", "left_semi").where("field <> 'notes'").select("codebook_id", "ordinal", "field")


def missing_extra_ids(requested: DataFrame, returned: DataFrame) -> DataFrame:
    """Per document, the requested ids that did not come back, and those that came unasked, sorted."""
    r = requested.select("source_pdf", "row_id", F.lit(True).alias("asked")).distinct()
    g = returned.select("source_pdf", "row_id", F.lit(True).alias("given")).distinct()
    both = r.join(g, ["source_pdf", "row_id"], "full")
    ids = lambda c: F.sort_array(F.collect_list(F.when(F.col(c).isNull(), F.col("row_id"))))
    return both.groupBy("source_pdf").agg(ids("given").alias("missing"), ids("asked").alias("extra"))
