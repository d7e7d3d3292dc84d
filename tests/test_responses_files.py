import json

import pytest

from paperloom.functions import text
from paperloom.operators import linkage, responses, sheet
from paperloom.sources import files
from pyspark.sql import functions as F


def test_schema_is_json_in_both_dialects(spark):
    books = spark.createDataFrame([(1, True)], "codebook_id int, confidence boolean")
    rows = [(1, 0, 'a"b', "string", ["x", 'y"'], None, True), (1, 1, "notes", "string", None, "why", False)]
    fields = spark.createDataFrame(rows, "codebook_id int, ordinal int, field string, type string, levels array<string>, description string, evidence_required boolean")
    for dialect in ("gemini", "json_schema"):
        schema = json.loads(responses.response_schema(books, fields, dialect).first().schema_json)
        item = schema["properties"]["effects"]["items"]
        assert item["required"] == ["row_id", 'a"b', "notes"] and list(item["properties"]) == item["required"]
        value = item["properties"]['a"b']["properties"]["value"]
        assert value == ({"type": "STRING", "nullable": True, "enum": ["x", 'y"']} if dialect == "gemini" else {"type": ["string", "null"], "enum": ["x", 'y"', None]})
        assert item["properties"]["notes"]["required"] == ["value"] and item["properties"]["notes"]["description"] == "why"
        assert ("additionalProperties" in item) == (dialect == "json_schema")


def test_validation_of_odd_answers(spark):
    item = '{"row_id":"%s","n":{"value":%s,"confidence":"%s","evidence":"p"}}'
    raws = {"ok": item % ("a", "1e3", "low"), "nan": item % ("a", "NaN", "low"), "sure": item % ("a", "1", "sure"), "half": item % ("\\ud800", "1", "low"), "text": "7"}
    df = spark.createDataFrame([(k, '{"effects":[' + v + "]}") for k, v in raws.items()] + [("null", None), ("deep", "[" * 100000)], "source_pdf string, raw string")
    asked = spark.createDataFrame([(k, "a") for k in raws], "source_pdf string, row_id string")
    documents, cells = responses.parse_response_cells(df)
    got = {r.source_pdf: r.stage for r in responses.validate_response(documents, asked, [responses.Field("n", "number")], True).collect()}
    assert got == {"ok": None, "nan": "invalid", "sure": "invalid", "half": "ids", "text": "row_id", "null": "json", "deep": "json"}
    assert cells.where("source_pdf = 'ok'").first().value_type == "number"


def test_shape_of_a_sheet(spark):
    rows = spark.createDataFrame([(["1"] * 5,), (["2"] * 5,)], "cells array<string>")
    say = lambda header: [r.message.split(" ")[0] for r in sheet.sheet_shape_check(header, rows).collect()]
    assert say(["a", "a"]) == ["Duplicate"] and say(list(sheet.REQUIRED)) == [] and say([*sheet.REQUIRED, "doi"]) == ["A"]
    assert say(["row_id", "b", "c", "d", "e"]) == ["Missing"]


def test_names(spark):
    given = {"é.pdf": "é.pdf", "é" * 100 + ".pdf": "é" * 80 + ".pdf", None: None, "a/b/": None, "nul.x.pdf": "_nul.x.pdf"}
    rows = spark.createDataFrame([(k,) for k in given], "n string").select("n", text.safe_document_name(F.col("n")).alias("r")).collect()
    assert {r.n: r.r.name for r in rows} == given and all((r.r.name is None) != (r.r.error is None) for r in rows)


def test_incremental_scores_only_new_pairs(spark):
    papers = spark.createDataFrame([("k1", "Miller", "2001"), ("k2", "Baker", "2002")], "key string, authors string, year string").selectExpr("*", "'' source_pdf", "'' title", "'' doi")
    signals = spark.createDataFrame([("x", ["miller", "2001"], "2001"), ("y", ["baker"], None)], "name string, tokens array<string>, year string")
    none = spark.createDataFrame([], "paper_hash string, signal_hash string, score double")
    every, fresh = linkage.incremental_pair_scores(papers, signals, none, none, none, score=linkage.containment_score)
    assert {(r.key, r.name) for r in every.collect()} == {("k1", "x"), ("k2", "y")}
    again, nothing = linkage.incremental_pair_scores(papers, signals, fresh, fresh, fresh, score=linkage.containment_score)
    assert nothing.isEmpty() and sorted(again.collect()) == sorted(every.collect())


def test_scans(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"%PDF-1"), (tmp_path / "b.pdf").write_bytes(b"no"), (tmp_path / "c.pdf").write_bytes(b"%PDF" + b"x" * 50), (tmp_path / "d.txt").write_bytes(b"%PDF")
    accepted, rejected = files.scan_documents(spark, str(tmp_path), max_bytes=20)
    assert [r.name for r in accepted.collect()] == ["a.PDF"] and {r.name: r.error for r in rejected.collect()} == {"b.pdf": "not a PDF", "c.pdf": "too large"}
    records = tmp_path / "raw"
    records.mkdir()
    for name, body in {"1": '{"source_pdf":"a.pdf"}', "2": "{broken", "3": '{"status":"ok"}', "4": '{"source_pdf":"b.pdf","status":"ok",\n"coded_by_row_id":{"r":{"f":{"value":3,"evidence":"p"}}},"missing_ids":["z","y"]}'}.items():
        (records / f"{name}.json").write_text(body)
    got = {r.source_pdf: r for r in files.scan_results(spark, str(records)).collect()}
    assert set(got) == {"a.pdf", "b.pdf"} and got["a.pdf"].status == "error" and got["a.pdf"].coded_by_row_id.toPython() == {} and got["a.pdf"].duration_sec == 0
    assert got["b.pdf"].coded_by_row_id.toPython() == {"r": {"f": {"value": 3, "evidence": "p"}}} and got["b.pdf"].missing_ids == ["y", "z"]
    (tmp_path / "s.csv").write_bytes("﻿x;y\n;\n1;\"a;\nb\"\n2;c\n".encode())
    header, rows = files.scan_delimited_any(spark, str(tmp_path / "s.csv"))
    assert header == ["x", "y"] and [(r.source_row, r.cells) for r in rows.orderBy("source_row").collect()] == [(1, ["1", "a;\nb"]), (2, ["2", "c"])]
    (tmp_path / "t.csv").write_text("x,y\n")
    with pytest.raises(ValueError):
        files.scan_delimited_any(spark, str(tmp_path / "t.csv"))
