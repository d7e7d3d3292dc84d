"""Reading sheets and page texts; writing tables, records and manifests."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions.text import collision_free_key, spreadsheet_safe
from paperloom.plans.staging import discard, stage
from paperloom.operators.sheet import FIELDS, shape_problem, sheet_row_issues, sheet_valid_rows

PAGE_CHARS = 500_000
#: Fixed value: what is said of a file in another encoding.
NOT_UTF8 = "Save the CSV as UTF-8 and try again."


_SHEET = "path string, ordinal long, " + ", ".join(f"{c} string" for c in FIELDS) + ", message string"


def parsed_sheet(content: bytes) -> tuple[list[dict], str | None]:
    """The records of one sheet file, or why the file as a whole is none. Quoting is strict, headers are trimmed, blank
    lines are no records; a blank file is a sheet without records."""
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return [], NOT_UTF8
    if not text.strip():
        return [], None
    try:
        lines = [x for x in csv.reader(io.StringIO(text, newline=""), strict=True)]
    except csv.Error as broken:
        return [], str(broken)
    header, records = [c.strip() for c in lines[0]], [x for x in lines[1:] if x]
    message = shape_problem(header, any(len(x) != len(header) for x in records))
    return ([], message) if message else ([dict(zip(header, x)) for x in records], None)


def scan_sheet(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Sheet files at ``path`` (a file, a folder, or a pattern) as rows (path, ordinal from 0, the sheet's columns) and as
    file-level issues (path, row_number, message, kind); a file with an issue has no rows, and a path that isn't there
    neither. Absent optional columns are blank.

    A sheet is one short file with quotes that may span lines, so a file is read whole, by Spark, wherever it lies, and many are
    read side by side. It is parsed when rows or issues are read."""
    try:
        files = spark.read.format("binaryFile").load(path).select("path", "content")
    except AnalysisException as absent:
        if absent.getCondition() != "PATH_NOT_FOUND":
            raise
        files = spark.createDataFrame([], "path string, content binary")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                records, message = parsed_sheet(content.as_py())
                found = [{"path": name, "ordinal": i, **{c: r.get(c, "") for c in FIELDS}} for i, r in enumerate(records)]
                yield pa.RecordBatch.from_pylist(found + [{"path": name, "message": message}] * bool(message), schema)

    schema = pa.schema([("path", pa.string()), ("ordinal", pa.int64()), *((c, pa.string()) for c in FIELDS), ("message", pa.string())])
    parsed = files.mapInArrow(rows, _SHEET)
    issues = parsed.where("message is not null").select("path", F.lit(None).cast("long").alias("row_number"), "message", F.lit("sheet").alias("kind"))
    return parsed.where("message is null").drop("message"), issues


def validated_sheet(spark: SparkSession, path: str, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The valid rows of one sheet file, and all that is wrong with it: of the file as a whole, or row by row."""
    rows, issues = scan_sheet(spark, path)
    own = sheet_row_issues(rows, documents).select(F.lit(None).cast("string").alias("path"), "row_number", "message", "kind")
    return sheet_valid_rows(rows, documents), issues.unionByName(own)


def assemble_page_text(pages: DataFrame, max_chars: int = PAGE_CHARS) -> DataFrame:
    """Pages (doc_id, page_no, text) to (doc_id, text, error): trimmed, numbered, joined by blank lines; blank pages
    are left out, and an empty or overlong document is an error without text."""
    body = F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\f\r"))
    page = F.when(body != "", F.struct("page_no", F.concat(F.lit("[Page "), F.col("page_no").cast("string"), F.lit("]\n"), body).alias("t")))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(page)), lambda p: p["t"]), "\n\n")
    out = pages.groupBy("doc_id").agg(joined.alias("text"))
    error = F.when(F.col("text") == "", "no text").when(F.length("text") > max_chars, "too long")
    return out.withColumn("error", error).withColumn("text", F.when(F.col("error").isNull(), F.col("text")))


def dedupe_result_records(records: DataFrame) -> DataFrame:
    """One record per document: that of the canonical file name before others, the last by name deciding ties."""
    place = F.row_number().over(Window.partitionBy("source_pdf").orderBy(F.col("is_canonical").desc(), F.col("file_name").desc()))
    return records.withColumn("_r", place).where("_r = 1").drop("_r")


def scan_eval_set(articles: DataFrame, sheet: DataFrame, set_name: str) -> DataFrame:
    """(source_pdf, row_ids) of the articles in a set; an article without rows has an empty list. A set without articles is
    an error, raised when this is called."""
    chosen = articles.where(F.array_contains(F.split("sets", r"\s+"), set_name)).select("source_pdf").distinct()
    if chosen.isEmpty():
        raise ValueError(f"No articles in set {set_name!r}.")
    rows = sheet.groupBy("source_pdf").agg(F.sort_array(F.collect_list("row_id")).alias("row_ids"))
    return chosen.join(rows, "source_pdf", "left").select("source_pdf", F.coalesce("row_ids", F.array().cast("array<string>")).alias("row_ids"))


def export_manifest(files: DataFrame) -> DataFrame:
    """(path, sha256, bytes) of files (path, content), without temporary and hidden ones."""
    name = F.element_at(F.split("path", "/"), -1)
    shown = files.where(~name.startswith(".") & ~name.endswith(".tmp"))
    content = F.col("content").cast("binary")
    return shown.select("path", F.sha2(content, 256).alias("sha256"), F.octet_length(content).cast("long").alias("bytes"))


def sink_wide_csv(wide: DataFrame, fields: list[str], path: str) -> None:
    """Base columns and fields, in order, as CSV with a header."""
    wide.select("row_id", "source_pdf", "locator", "authors", "year", "status", *fields).write.csv(path, header=True, quote='"', escape='"')


def sink_spreadsheet_csv(wide: DataFrame, path: str) -> None:
    """For spreadsheets: every cell and header made safe, lines ended by CRLF, a byte-order mark before the header of each
    file; rows without any cell are left out."""
    quoted = lambda c: F.when(c.rlike(r"[\",\r\n]"), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    names = [F.lit(c) for c in wide.columns]
    header = wide.sparkSession.range(1).select(F.concat_ws(",", *(quoted(spreadsheet_safe(c)) for c in names))).first()[0]
    cells = [spreadsheet_safe(F.col(f"`{c}`").cast("string")) for c in wide.columns]
    some = F.concat(*(F.coalesce(c, F.lit("")) for c in cells)) != ""
    lines = wide.where(some).select(F.concat_ws(",", *map(quoted, cells)).alias("line"))

    def with_header(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        schema = first.schema if first is not None else pa.schema([("line", pa.string())])
        yield pa.RecordBatch.from_pydict({"line": ["\ufeff" + header]}, schema)
        if first is not None:
            yield first
            yield from batches

    lines.mapInArrow(with_header, "line string").write.text(path, lineSep="\r\n")


def _json(text: Column) -> Column:
    """A JSON string."""
    inside = F.to_json(F.array(text))
    return F.substring(inside, F.lit(2), F.char_length(inside) - 2)


def document_records(rows: DataFrame, cells: DataFrame, results: DataFrame, fields: list[str], rated: tuple[str, ...] = ()) -> DataFrame:
    """(source_pdf, record): for each result with sheet rows, one JSON text of its status, where it comes from, what went wrong,
    and each row's locator and fields in order. A key without anything to say is left out; a field has always a value and
    evidence, null where there are none, and a confidence only if it is rated and has one; a row that the answer left
    out says so.

    ``rows`` (source_pdf, ordinal, row_id, locator), ``cells`` (source_pdf, row_id, field, value variant, confidence,
    evidence), ``results`` (source_pdf, status and any of audit_operation_id, provider, model, served_model,
    repaired_response, error, missing_ids, extra_ids)."""
    null = F.parse_json(F.lit("null"))
    rate = F.when(F.col("field").isin(*rated), F.col("confidence"))
    cell = F.to_json(F.struct(F.coalesce("value", null).alias("value"), rate.alias("confidence"), F.coalesce(F.col("evidence").cast("variant"), null).alias("evidence")))
    own = cells.groupBy("source_pdf", "row_id").agg(*(F.max(F.when(F.col("field") == f, cell)).alias(f"_{i}") for i, f in enumerate(fields)), F.lit(True).alias("_returned"))
    # a field that the answer left out is there, without anything
    told = [F.concat(_json(F.lit(f)), F.lit(":"), F.coalesce(f"_{i}", F.lit('{"value":null,"evidence":null}'))) for i, f in enumerate(fields)]
    body = F.when(F.col("_returned"), F.concat(F.lit('"fields":{'), F.concat_ws(",", *told), F.lit("}"))).otherwise('"status":"not returned by the model"')
    row = F.concat(_json(F.col("row_id")), F.lit(':{"locator":'), _json(F.coalesce("locator", F.lit(""))), F.lit(","), body, F.lit("}"))
    both = rows.join(own, ["source_pdf", "row_id"], "left").select("source_pdf", "ordinal", row.alias("row"))
    effects = both.groupBy("source_pdf").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "row"))), lambda r: r["row"]), ",").alias("effects"))
    have = lambda c: F.nullif(F.col(c), F.lit("")) if c in results.columns else F.lit(None).cast("string")
    ids = lambda c: F.when(F.size(c) > 0, F.sort_array(c)) if c in results.columns else F.lit(None).cast("array<string>")
    repaired = F.when(F.col("repaired_response").isNotNull(), True) if "repaired_response" in results.columns else F.lit(None).cast("boolean")
    head = F.struct("source_pdf", "status", *(have(c).alias(c) for c in ("audit_operation_id", "provider", "model", "served_model")), repaired.alias("json_repaired"), have("error").alias("error"), ids("missing_ids").alias("missing_row_ids"), ids("extra_ids").alias("unexpected_row_ids"))
    out = results.withColumn("_head", F.to_json(head)).join(effects, "source_pdf")
    return out.select("source_pdf", F.concat(F.substring("_head", F.lit(1), F.char_length("_head") - 1), F.lit(',"effects":{'), "effects", F.lit("}}")).alias("record"))


#: Files that one task writes; and the setting by which tasks, not the driver one after the other, move what they wrote.
FILES_A_TASK = 256
MOVED_BY_TASKS = ("mapreduce.fileoutputcommitter.algorithm.version", "2")


def file_tasks(n: int) -> int:
    """Tasks for so many files; their bytes say little of the time that it takes to open them."""
    return max(1, -(-n // FILES_A_TASK))


def sink_document_record(records: DataFrame, path: str) -> None:
    """Records (source_pdf, record), one file per document in a folder of its own, ``document=<key>``. Files are written
    aside, gathered by the tasks, and moved when the job commits, so a killed task leaves none half written; only the folders of the
    documents that are written are replaced. Tasks are as many as the documents need, however small these are."""
    keyed = stage(records.withColumn("document", collision_free_key(F.col("source_pdf"))).select("document", "record"), "records")
    dealt = keyed.repartition(file_tasks(keyed.count()), "document")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option(*MOVED_BY_TASKS).partitionBy("document").text(path)
    discard(keyed)
