"""Folding, deep pages, the blob store, repair of answers, drafts, requests: cases that the given tables don't hold."""

import json
import random

import pytest
from pyspark.sql import functions as F

from paperloom.functions import values
from paperloom.operators import audit, evaluate, requests, responses, results, sheet
from paperloom.operators.json_repair import tolerant_json
from paperloom.plans.staging import stage
from paperloom.sources import sheets


def test_folding_equals_full_case_folding(spark):
    texts = ["Straße", "STRASSE", "ΣΑΣ", "σας", "ﬁn", "FIN", "İstanbul", "ǰ", "ᾳ", "Ꭰꭰ", "ẞ", "ŉ", "", None, "plain", "ͅ", "ﬃﬃ"]
    everything = "".join(c for c in map(chr, range(1, 0x20000)) if not 0xD800 <= ord(c) < 0xE000)
    texts += [everything[i : i + 500] for i in range(0, len(everything), 500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("f", values.casefold(F.col("t"))).collect()
    assert [r.i for r in rows if (r.f is None) != (r.t is None) or (r.t and r.f.casefold() != r.t.casefold())] == []
    pairs = [(a, b) for a in texts[:17] for b in texts[:17] if a is not None and b is not None]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("m", values.values_match(F.lit("string"), F.col("a"), F.col("b"), F.lit("exact")))
    for r in df.collect():
        assert r.m == (" ".join(r.a.casefold().split()) == " ".join(r.b.casefold().split())), (r.a, r.b)


def test_blanks_of_any_kind_are_one(spark):
    df = spark.createDataFrame([("a  b\x1c", "A b")], "a string, b string").withColumn("m", values.values_match(F.lit("string"), F.col("a"), F.col("b"), F.lit("exact")))
    assert df.first().m


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_deep_pages_are_those_of_the_whole_order(spark, ranges):
    rng = random.Random(1)
    rows = [(rng.randrange(40), i, f"x{rng.randrange(9)}") for i in range(503)] + [(None, 600, None), (3, 601, None)]
    df = stage(spark.createDataFrame(rows, "k int, i int, t string"), "rows")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    pages = results.Pages(df, ["k"], ranges=ranges)
    for page in (-3, 1, 2, 25, 50, 51, 99):
        at = min(max(page, 1), 51) - 1
        assert [tuple(r) for r in pages.page(page).collect()] == order[at * 10 : at * 10 + 10], page
    assert results.Pages(df.limit(0), ["k"]).page(4).count() == 0


def test_deep_pages_read_one_range(spark, monkeypatch):
    df = stage(spark.range(3000).select((F.col("id") * 7 % 3000).alias("k")), "rows")
    monkeypatch.setattr(results, "TOP_ROWS", 100)
    assert [r.k for r in results.paginate(df, ["k"], 200).collect()] == list(range(1990, 2000))
    pages = results.Pages(df, ["k"], ranges=30)
    assert len(pages.counts) > 20 and max(pages.counts.values()) < 500
    held = pages.page(150)
    plan = held._jdf.queryExecution().optimizedPlan().toString()
    assert "_range" in plan and [r.k for r in held.collect()] == list(range(1490, 1500))


def test_overlapping_appends_keep_each_content_once(spark, tmp_path):
    kind, store = "operation_id long, sequence long, content string", str(tmp_path / "store")
    one, two = [(1, 0, "a"), (1, 1, "a"), (1, 2, None), (2, 0, "")], [(2, 1, "a"), (3, 0, "b" * 1000), (3, 1, "b" * 1000)]
    for rows in (one, two, two):
        refs = audit.append_blobs(spark.createDataFrame(rows, kind), store)
    found = spark.read.parquet(store).collect()
    assert sorted((bytes(r.content), r.bytes) for r in found) == [(b"", 0), (b"a", 1), (b"b" * 1000, 1000)]
    back = audit.read_blobs(spark, store, refs).collect()
    assert sorted((r.operation_id, r.sequence, bytes(r.content).decode()) for r in back) == sorted(two)


@pytest.mark.parametrize(
    ("raw", "meant"),
    [
        ("{'effects': [{'row_id': 'r1', 'x': {'value': None, 'ok': True,},},]}", {"effects": [{"row_id": "r1", "x": {"value": None, "ok": True}}]}),
        ("{effects: [{row_id: r1, n: 5 // five\n, m: 1.5e3 /* thousand */}]}", {"effects": [{"row_id": "r1", "n": 5, "m": 1500.0}]}),
        ('```json\n{"a": "x" "b": [1 2 3]}\n```', {"a": "x", "b": ["1 2 3"]}),
        ('{"a": 1\n"b": 2}', {"a": 1, "b": 2}),
        ('{"a": "he said "no" twice", "b": 1}', {"a": 'he said "no" twice', "b": 1}),
        ('{"a": [1, 2}, "b": 3', {"a": [1, 2]}),
        ("Sure: {“a”: “b”, # note\n 'c': False}", {"a": "b", "c": False}),
        ('{"a": "caf\\u00e9 \\ud83d\\ude00 \\q", "b": +3}', {"a": "café 😀 q", "b": 3}),
        ('{"a": {"b": "cut of', {"a": {"b": "cut of"}}),
        ('{"a": 1, "b', {"a": 1}),
        ('{"a": , "b": 2}', {"a": None, "b": 2}),
        ("[{'a': 1}, {'a': 2", [{"a": 1}, {"a": 2}]),
    ],
)
def test_a_broken_answer_is_read_as_meant(raw, meant):
    if raw == '{"a": 1, "b':
        assert json.loads(responses.repaired_json(raw)) == meant
    else:
        assert json.loads(tolerant_json(raw)) == meant


@pytest.mark.parametrize("raw", ["", "no answer", '{"a" 5}', "{5: 6}", "[" * 5000])
def test_what_cannot_be_told_is_refused(raw):
    assert tolerant_json(raw) is None


def test_a_repaired_answer_needs_review_and_a_hopeless_one_is_an_error(spark):
    raws = {"fine": '{"effects":[{"row_id":"a","n":{"value":1}}]}', "python": "{'effects':[{'row_id':'a','n':{'value':1}}]}", "bare": "{effects:[{row_id:'a', n:{value:1}}]}", "none": "I can't.", "typed": "{'effects':[{'row_id':'a','n':{'value':'one'}}]}"}
    attempts = spark.createDataFrame([(k, "ok", None, raw) for k, raw in raws.items()], "source_pdf string, status string, error string, raw string")
    asked = spark.createDataFrame([(k, "a") for k in raws], "source_pdf string, row_id string")
    got = {r.source_pdf: r.status for r in responses.replay(attempts, asked, [responses.Field("n", "integer", evidence_required=False)]).collect()}
    assert got == {"fine": "ok", "python": "needs_review", "bare": "needs_review", "none": "error", "typed": "needs_review"}


def test_the_shape_of_drafts(spark):
    cells = lambda *sizes: spark.createDataFrame([(i, ["x"] * n) for i, n in enumerate(sizes)], "ordinal long, cells array<string>")
    head = list(sheet.FIELDS)
    problem = lambda header, rows, most=2000: [(r.row_number, r.message) for r in sheet.draft_shape_check(header, rows, most).collect()]
    assert problem(head, cells(7, 7)) == []
    assert problem(head[::-1], cells(7)) == problem(head[:6], cells(6)) == [(None, "the headers or their order differ")]
    assert problem(head, cells()) == [(None, "the sheet must have 1 to 2000 rows")] and problem(head, cells(7, 7, 7), 2)[0][1] == "the sheet must have 1 to 2 rows"
    assert problem(head, cells(7, 8, 6)) == [(3, "a row has the wrong number of cells")]
    out = spark.createDataFrame([(0, [1]), (1, []), (2, None)], "ordinal long, source_rows array<long>")
    assert sorted(r.ordinal for r in sheet.untraced_rows(out).collect()) == [1, 2]


def test_unknown_sets_are_refused(spark):
    articles = spark.createDataFrame([("a.pdf", "small broad"), ("b.pdf", None)], "source_pdf string, sets string")
    rows = spark.createDataFrame([("c.pdf", "r")], "source_pdf string, row_id string")
    assert [tuple(r) for r in sheets.scan_eval_set(articles, rows, "broad").collect()] == [("a.pdf", [])]
    with pytest.raises(ValueError, match="No articles in set 'big'"):
        sheets.scan_eval_set(articles, rows, "big")


def test_a_request_says_what_an_effect_is_and_asks_how_sure(spark):
    valid = spark.createDataFrame([("a.pdf", 0, "r1", "", 1), ("a.pdf", 1, "r2", "T2", 1), ("b.pdf", 2, "r3", None, 2), ("c.pdf", 3, "r4", "", 9)], "source_pdf string, ordinal long, row_id string, locator string, codebook_id long")
    books = spark.createDataFrame([(1, "Book 1", "A contrast.", True), (2, "Book 2", "A slope.", False)], "codebook_id long, text string, effect_definition string, confidence boolean")
    texts = spark.createDataFrame([(f"{x}.pdf", f"text {x}") for x in "abc"], "name string, text string")
    got = {r.source_pdf: r.prompt for r in requests.build_requests(valid, texts, "Rules.", books, "How sure?").collect()}
    assert got == {
        "a.pdf": "Rules.\nHow sure?\n\nAn effect:\nA contrast.\n\nBook 1\n\nRows: 2\n\n- r1: (none)\n- r2: T2\n\ntext a",
        "b.pdf": "Rules.\n\nAn effect:\nA slope.\n\nBook 2\n\nRows: 1\n\n- r3: (none)\n\ntext b",
    }


def test_costs_of_input_and_output(spark):
    attempts = spark.createDataFrame([(7000, 3000), (7000, None), (None, 3000)], "input_tokens long, output_tokens long")
    row = evaluate.cost_estimate(attempts, 200, 0.375, 1.875, 0).first()
    assert row.cost_in == pytest.approx(0.525) and row.cost_out == pytest.approx(1.125) and row.cost == pytest.approx(1.65)
    assert evaluate.cost_estimate(attempts.withColumn("output_tokens", F.lit(None).cast("long")), 200, 0.375, 1.875).first().cost is None


def test_lineage_is_compared_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(sheet, "ROWS_A_TASK", 5)
    out = spark.createDataFrame([([1, 2, 2],), ([None, 9],), ([],), (None,), ([*range(20, 40)],)], "source_rows array<bigint>")
    source = spark.createDataFrame([(1,), (3,), (3,), (None,), *((i,) for i in range(20, 40))], "source_row bigint")
    found = sheet.lineage_coverage(out, source)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(2, "invalid"), (3, "omitted"), (9, "invalid"), (None, "invalid"), (None, "omitted")], key=str)
    assert found.rdd.getNumPartitions() == 10
