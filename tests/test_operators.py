import random

from pyspark.sql import functions as F

from paperloom.functions import text, values
from paperloom.operators import collate, linkage, results, sheet


def test_assignment_equals_greedy(spark):
    rng = random.Random(3)
    scores = [(f"k{i}", f"n{j}", rng.choice([0.3, 0.5, 0.7, 0.9])) for i in range(12) for j in range(10) if rng.random() < 0.6]
    ours = {(r.key, r.name) for r in linkage.assign_one_to_one(spark.createDataFrame(scores, "key string, name string, score double")).collect()}
    keys, names, greedy = set(), set(), set()
    for key, name, _ in sorted(scores, key=lambda x: (-x[2], x[0], x[1])):
        if key not in keys and name not in names:
            keys.add(key), names.add(name), greedy.add((key, name))
    assert ours == greedy


def test_contested_assignment_is_low(spark):
    papers = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    scores = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.85), ("b", "z", 0.9)], "key string, name string, score double")
    got = {r.key: (r.name, r.confidence) for r in linkage.match_suggestions(papers, scores).collect()}
    assert got == {"a": ("x", "low"), "b": ("z", "high"), "c": (None, "none")}


def test_text_expressions(spark):
    cases = spark.createDataFrame([("Smith2020 Müller_王 et al",), (None,), ("",)], "t string")
    row = cases.select(text.normalize_text(F.col("t")), text.find_year(F.col("t")), text.short_name_tokens(F.col("t"))).collect()
    assert tuple(row[0]) == ("smith 2020 müller 王 et al", "2020", ["王"])
    assert tuple(row[1]) == tuple(row[2]) == ("", None, [])
    unsafe = {"=1+1": "'=1+1", "-1.25e-3": "-1.25e-3", " @x": "' @x", "\tx": "'\tx", "plain": "plain", "-x": "'-x"}
    got = spark.createDataFrame([(k,) for k in unsafe], "t string").select("t", text.spreadsheet_safe(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in got} == unsafe


def test_values_match(spark):
    cases = [
        ("string", "Between  Subjects", "between subjects", "exact", True), ("boolean", "true", "true", "bool", True), ("string", "true", "true", "bool", False),
        ("string", "1990 – 1992", "1990-1992", "years", True), ("integer", "10", "10.5", "number:0.5", True), ("boolean", "1", "1", "number:0.5", False),
        ("number", "0.3", "0.311", "number:0.011", False), ("number", "-2", "2", "number_abs:0.011", True), ("string", "x", "2", "number:1", False), ("null", None, "2", "exact", False),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a string, b string, c string, d string, want boolean")
    for r in df.select("i", "want", values.values_match(*map(F.col, "abcd")).alias("got")).collect():
        assert r.got == r.want, cases[r.i]


def test_first_failing_rule_and_first_use(spark):
    rows = [(0, "r1", "a.pdf", "", "A", ""), (1, "r1", "a.pdf", "", "A", "1"), (2, " ", "a.pdf", "", "A", "1"), (3, "r2", "b.pdf", None, "A", "1"), (4, "r3", "a.pdf", None, "A", "1")]
    rows = spark.createDataFrame(rows, "ordinal long, row_id string, source_pdf string, locator string, authors string, year string")
    docs = spark.createDataFrame([("a.pdf",)], "name string")
    assert {(r.row_number, r.kind) for r in sheet.sheet_row_issues(rows, docs).collect()} == {(2, "sheet"), (3, "sheet"), (4, "sheet"), (5, "pdf")}
    assert [r.row_id for r in sheet.sheet_valid_rows(rows, docs).collect()] == ["r3"]


def test_failed_retry_keeps_success(spark):
    a = spark.createDataFrame([("d", 1, 1, "ok"), ("d", 2, 2, "error"), ("e", 3, 1, "error"), ("e", 4, 2, "cancelled")], "source_pdf string, attempt long, attempt_ts long, status string")
    assert {r.source_pdf: r.attempt for r in results.selected_result(a).collect()} == {"d": 1, "e": 4}
    assert {r.source_pdf: r.attempt for r in results.latest_attempt(a).collect()} == {"d": 2, "e": 4}
    assert [r.source_pdf for r in results.kept_success(a).collect()] == ["d"]


def test_low_confidence_counts_every_rated_field(spark):
    n = 10_050
    rated = spark.range(n).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("field"))
    cells = rated.select(F.lit("r1").alias("row_id"), "field", F.lit("low").alias("confidence"))
    valid = spark.createDataFrame([("r1", "a.pdf")], "row_id string, source_pdf string")
    assert [(r.source_pdf, r.n) for r in collate.low_confidence_cells(cells, valid, rated).collect()] == [("a.pdf", n)]
