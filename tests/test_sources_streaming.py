import csv
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from paperloom.operators import results
from paperloom.operators.linkage import document_signal
from paperloom.sources import files, sheets
from paperloom.streaming import jobs

HEAD = "row_id,source_pdf,locator,authors,year"


def scanned(spark, path):
    rows, issues = sheets.scan_sheet(spark, str(path))
    return [(r.ordinal, r.row_id, r.authors, r.title) for r in rows.orderBy("path", "ordinal").collect()], [(i.row_number, i.message, i.kind) for i in issues.collect()]


@pytest.mark.parametrize(
    ("content", "rows", "issue"),
    [
        (('﻿ row_id ,source_pdf,locator,authors ,year,title\r\nr1,a.pdf,,"A, ""B""\nC",2020,T\r\n\r\nr2,,,,,\r\n').encode(), [(0, "r1", 'A, "B"\nC', "T"), (1, "r2", "", "")], None),
        (b" \n\t", [], None),
        (b"", [], None),
        (f"{HEAD}\nr1,a.pdf,,M\xfcller,2020\n".encode("latin-1"), [], "Save the CSV as UTF-8 and try again."),
        (f"{HEAD}\nr1,a.pdf,,A\n".encode(), [], "A coding-sheet row has the wrong number of cells."),
        (f"{HEAD}\nr1,a.pdf,,A,2020,more\n".encode(), [], "A coding-sheet row has the wrong number of cells."),
        (f'{HEAD}\nr1,a.pdf,"never closed,A,2020\n'.encode(), [], "unexpected end of data"),
        (f'{HEAD}\nr1,a.pdf,"x"y,A,2020\n'.encode(), [], "',' expected after '\"'"),
        (b"row_id,row_id ,source_pdf,locator,authors,year\n", [], "Duplicate coding-sheet column headers."),
        (b"row_id,source_pdf,locator\n", [], "Missing required column(s): authors, year."),
        (f"{HEAD},notes\n".encode(), [], "Unexpected column(s): notes. The coding sheet only accepts row_id, source_pdf, locator, authors, year, title, doi."),
    ],
)
def test_a_sheet_is_read_strictly(spark, tmp_path, content, rows, issue):
    path = tmp_path / "sheet.csv"
    path.write_bytes(content)
    assert scanned(spark, path) == (rows, [(None, issue, "sheet")] if issue else [])


def test_missing_sheets_and_folders_of_sheets(spark, tmp_path):
    assert scanned(spark, tmp_path / "none.csv") == ([], [])
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text(f"{HEAD}\nr{i},a.pdf,,A,2020\n" if i else "x\n")
    rows, issues = scanned(spark, tmp_path)
    assert [r[1] for r in rows] == ["r1", "r2"] and len(issues) == 1
    documents = spark.createDataFrame([("a.pdf",)], "name string")
    valid, found = sheets.validated_sheet(spark, str(tmp_path / "1.csv"), documents)
    assert valid.count() == 1 and found.count() == 0
    (tmp_path / "4.csv").write_text(f"{HEAD}\nr,b.pdf,,A,2020\n,a.pdf,,A,2020\n")
    valid, found = sheets.validated_sheet(spark, str(tmp_path / "4.csv"), documents)
    assert valid.count() == 0
    assert sorted((i.row_number, i.message, i.kind) for i in found.collect()) == [(2, "row_id `r` references `b.pdf`, which has not been uploaded.", "pdf"), (3, "row_id is required.", "sheet")]


def test_spreadsheet_sink(spark, tmp_path):
    wide = spark.createDataFrame([("r1", "a.pdf", "", "A", "1", "ok", "=1"), ("r2", "a.pdf", "", "A", "1", "ok", 'q"x')], "row_id string, source_pdf string, locator string, authors string, year string, status string, f string")
    sheets.sink_spreadsheet_csv(wide.coalesce(1), str(tmp_path / "x"))
    rows = [r for f in glob.glob(str(tmp_path / "x/part*")) for r in csv.DictReader(open(f, newline=""))]
    assert [r["f"] for r in rows] == ["'=1", 'q"x']


RECORDS = {
    "a-1.json": {"source_pdf": "a.pdf", "status": "ok", "coded_by_row_id": {"r1": {"x": {"value": True, "confidence": "low", "evidence": "p. 1"}, "y": {"value": "true"}, "z": {"value": None}, "u": {"evidence": 5}, "v": "scalar"}, "r2": {"x": {"value": 1.5}, "y": {"value": 3}, "z": {"value": [1]}}, "r3": None}, "missing_ids": ["b", "a", "a"], "duration_sec": 2, "input_tokens": 7},
    "b.json": {"source_pdf": "b.pdf", "coded_by_row_id": None, "error": "no answer"},
    "c.json": {"status": "ok"},
    "d.json": [1],
    "a-1.attempt.json": {"source_pdf": "a.pdf", "status": "error"},
}


@pytest.fixture
def record_files(tmp_path):
    for name, record in RECORDS.items():
        (tmp_path / name).write_text(json.dumps(record, indent=2))
    (tmp_path / "broken.json").write_text('{"source_pdf": ')
    return str(tmp_path)


def test_records_keep_the_types_of_their_values(spark, record_files):
    read = files.scan_results(spark, record_files)
    got = {r.source_pdf: r for r in read.drop("coded_by_row_id").collect()}
    assert set(got) == {"a.pdf", "b.pdf"}
    assert (got["a.pdf"].missing_ids, got["a.pdf"].extra_ids, got["a.pdf"].duration_sec, got["a.pdf"].input_tokens, got["a.pdf"].file_name) == (["a", "b"], [], 2.0, 7, "a-1.json")
    assert (got["b.pdf"].status, got["b.pdf"].error, got["b.pdf"].duration_sec) == ("error", "no answer", 0.0)
    cells = {(c.row_id, c.field): c for c in files.result_cells(read).drop("value").collect()}
    kinds = {k: (c.present, c.value_type, c.value_text) for k, c in cells.items()}
    assert kinds == {
        ("r1", "x"): (True, "boolean", "true"),
        ("r1", "y"): (True, "string", "true"),
        ("r1", "z"): (True, "null", None),
        ("r1", "u"): (False, None, None),
        ("r1", "v"): (False, None, None),
        ("r2", "x"): (True, "number", "1.5"),
        ("r2", "y"): (True, "integer", "3"),
        ("r2", "z"): (True, "array", "[1]"),
    }
    assert not cells["r1", "v"].is_object and not cells["r1", "u"].evidence_is_string and cells["r1", "x"].evidence_is_string


def test_the_canonical_record_of_a_document_wins(spark, tmp_path):
    from paperloom.functions.text import collision_free_key

    own = spark.range(1).select(collision_free_key(F.lit("a.pdf"))).first()[0]
    for name, status in (("zz-legacy.json", "error"), (f"{own}.json", "ok")):
        (tmp_path / name).write_text(json.dumps({"source_pdf": "a.pdf", "status": status}))
    (row,) = sheets.dedupe_result_records(files.scan_results(spark, str(tmp_path))).collect()
    assert (row.status, row.is_canonical) == ("ok", True)


def test_document_records_are_whole_and_come_back(spark, record_files, tmp_path):
    read = files.scan_results(spark, record_files)
    rows = spark.createDataFrame([("a.pdf", 0, "r2", "Exp. 2"), ("a.pdf", 1, "r1", None), ("a.pdf", 2, 'r"4', "x"), ("b.pdf", 3, "r9", "y")], "source_pdf string, ordinal long, row_id string, locator string")
    results_ = read.withColumn("extra_ids", F.array(F.lit("q"), F.lit("p"))).withColumn("repaired_response", F.when(F.col("source_pdf") == "a.pdf", "{}"))
    out = str(tmp_path / "records")
    records = sheets.document_records(rows, files.result_cells(read), results_, ["y", "x", "z"], rated=("x",))
    sheets.sink_document_record(records, out)
    found = {json.loads(open(f).read())["source_pdf"]: json.loads(open(f).read()) for f in glob.glob(f"{out}/document=*/part-*")}
    assert len(glob.glob(f"{out}/document=*/part-*")) == 2
    a = found["a.pdf"]
    assert list(a) == ["source_pdf", "status", "json_repaired", "missing_row_ids", "unexpected_row_ids", "effects"]
    assert (a["json_repaired"], a["missing_row_ids"], a["unexpected_row_ids"]) == (True, ["a", "b"], ["p", "q"])
    assert list(a["effects"]) == ["r2", "r1", 'r"4']
    assert a["effects"]["r1"] == {"locator": "", "fields": {"y": {"value": "true", "evidence": None}, "x": {"value": True, "confidence": "low", "evidence": "p. 1"}, "z": {"value": None, "evidence": None}}}
    assert list(a["effects"]["r1"]["fields"]) == ["y", "x", "z"]
    assert a["effects"]['r"4'] == {"locator": "x", "status": "not returned by the model"}
    assert found["b.pdf"]["error"] == "no answer" and found["b.pdf"]["status"] == "error"
    # only the documents that are written again are replaced
    sheets.sink_document_record(records.where("source_pdf = 'b.pdf'"), out)
    assert len(glob.glob(f"{out}/document=*/part-*")) == 2


SIGNAL_ROWS = [("a2019.pdf", "Li 1999 of", 1), ("b.pdf", "year 2001", 2), ("a2019.pdf", "Wu again", 3)]


def test_signals_are_kept_once_per_name_across_restarts(spark, tmp_path):
    source, table, checkpoint = (str(tmp_path / x) for x in ("in", "table", "cp"))
    progress = jobs.ScanProgress("signals")
    spark.streams.addListener(progress)
    kind = "name string, text string, arrived long"
    late = [("a2019.pdf", "late and old", 0), ("c.pdf", None, 5)]
    try:
        for rows in (SIGNAL_ROWS, late):
            spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
            jobs.stream_signals(spark.readStream.schema(kind).parquet(source), table, checkpoint, "signals").awaitTermination(120)
    finally:
        spark.streams.removeListener(progress)
    got = {r.name: (r.tokens, r.year) for r in jobs.read_table(spark, table, jobs.last_signal).collect()}
    last = spark.createDataFrame([SIGNAL_ROWS[2], SIGNAL_ROWS[1], late[1]], kind)
    assert got == {r.name: (r.tokens, r.year) for r in document_signal(last).collect()}
    assert progress.snapshot()["processed"] >= 3
    before = sorted(map(str, jobs.read_table(spark, table, jobs.last_signal).collect()))
    jobs.compact(spark, table, jobs.last_signal)
    assert sorted(map(str, jobs.read_table(spark, table, jobs.last_signal).collect())) == before and os.listdir(table) == ["base=1"]


ATTEMPTS = "source_pdf string, attempt long, attempt_ts long, status string"


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    first = [("d", 1, 1, "ok"), ("d", 2, 2, "error"), ("e", 3, 1, "error"), ("f", 9, 9, "ok")]
    second = [("d", 4, 3, "cancelled"), ("e", 5, 2, "ok"), ("f", 1, 1, "ok"), ("e", 6, 3, "needs_review")]
    frames = [spark.createDataFrame(x, ATTEMPTS) for x in (first, second)]
    write, path = jobs.upsert(jobs.standing, str(tmp_path / "t")), str(tmp_path / "t")
    for number, frame in ((0, frames[0]), (1, frames[1]), (1, frames[1]), (0, frames[0])):
        write(frame, number)
    table, all_ = jobs.read_table(spark, path, jobs.standing), frames[0].unionByName(frames[1])
    for operator in (results.selected_result, results.latest_attempt, results.kept_success):
        assert sorted(operator(table).collect()) == sorted(operator(all_).collect())
    assert table.count() == 5
    assert jobs.read_table(spark, str(tmp_path / "none"), jobs.standing, ATTEMPTS).count() == 0


def test_streamed_results_equal_batch(spark, tmp_path):
    a = spark.createDataFrame([("d", 1, 1, "ok"), ("d", 2, 2, "error"), ("e", 3, 1, "error")], ATTEMPTS)
    a.write.parquet(str(tmp_path / "attempts"))
    stream = lambda: spark.readStream.schema(a.schema).parquet(str(tmp_path / "attempts"))
    for _ in range(2):
        jobs.stream_results(stream(), str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination(120)
    table = jobs.read_table(spark, str(tmp_path / "t"), jobs.standing)
    assert sorted(results.selected_result(table).collect()) == sorted(results.selected_result(a).collect())
    jobs.stream_selected_result(stream()).writeStream.format("memory").queryName("selected").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    got = {(r.source_pdf, r.attempt, r.status) for r in spark.table("selected").collect()}
    assert got == {(r.source_pdf, r.attempt, r.status) for r in results.selected_result(a).collect()}


def test_small_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    from paperloom.plans import queries

    monkeypatch.setattr(sheets, "FILES_A_TASK", 4)
    records = spark.createDataFrame([(f"d{i}.pdf", f'{{"n":{i}}}') for i in range(40)], "source_pdf string, record string").coalesce(1)
    tasks = lambda path: {p.name.split("-")[1] for p in path.rglob("part-*")}
    sheets.sink_document_record(records, str(tmp_path / "sunk"))
    assert len(list((tmp_path / "sunk").rglob("part-*"))) == 40 and len(tasks(tmp_path / "sunk")) > 4
    queries._write_records(records, str(tmp_path / "raw"))
    assert len(list((tmp_path / "raw").rglob("part-*"))) == 40 and len(tasks(tmp_path / "raw")) > 4
