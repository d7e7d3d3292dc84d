import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import audit, codebook, evaluate, requests, results, uploads
from paperloom.plans.staging import discard, stage
from paperloom.sources import sheets


def numbered(wanted, existing):
    """Names one after the other, as a file system would give them."""
    taken, out = set(existing), []
    for name in wanted:
        stem, dot, suffix = name.rpartition(".")
        k, now = 1, name
        while now in taken:
            k += 1
            now = f"{stem} ({k}).{suffix}"
        taken.add(now)
        out.append(now)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_unique_names_equal_one_after_the_other(spark, seed):
    rng = random.Random(seed)
    names = ["a.pdf", "a (2).pdf", "a (2) (2).pdf", "a (3).pdf", "b.pdf", "b (12).pdf", "a (02).pdf"]
    wanted, existing = [rng.choice(names) for _ in range(25)], rng.sample(names, 3)
    got = uploads.unique_document_name(spark.createDataFrame(list(enumerate(wanted)), "arrival long, wanted string"), spark.createDataFrame([(x,) for x in [*existing, None]], "name string")).collect()
    assert [r.name for r in sorted(got, key=lambda r: r.arrival)] == numbered(wanted, existing)


def test_waits_until_a_date(spark):
    cases = {"12": 12.0, "Wed, 21 Oct 2026 07:28:00 GMT": 11.0, "Wed, 21 Oct 2026 09:28:00 +0200": 11.0, "21 Oct 2026 07:28:00 -0000": 11.0, "Wed, 21 Oct 2026 07:22:00 GMT": 0.0, "soon": None, "": None, None: None, "-5": None, "31 Feb 2026 99:00:00 GMT": None}
    df = spark.createDataFrame([(k,) for k in cases], "h string")
    got = df.select("h", audit.asked_to_wait(F.col("h"), F.timestamp_seconds(F.lit(1792567669))).alias("s")).collect()
    assert {r.h: r.s for r in got} == cases


def test_stale_results_lose_values(spark):
    stored = spark.createDataFrame([("a", "ok", "old", None, {"r": "x"}, ["m"]), ("b", "ok", None, None, {"r": "x"}, ["m"])], "source_pdf string, status string, input_fingerprint string, error string, coded_by_row_id map<string,string>, missing_ids array<string>")
    prints, valid = spark.createDataFrame([("a", "new"), ("b", "new")], "source_pdf string, fingerprint string"), spark.createDataFrame([("a",), ("b",)], "source_pdf string")
    got = {r.source_pdf: (r.status, r.coded_by_row_id, r.missing_ids) for r in results.mark_stale(stored, prints, valid).collect()}
    assert got == {"a": ("stale", {}, []), "b": ("ok", {"r": "x"}, ["m"])}


def test_every_part_of_a_codebook_changes_its_hash(spark):
    book = {"codebook_id": 1, "name": "n", "description": "d", "effect_definition": "e", "confidence": True}
    field = {"codebook_id": 1, "ordinal": 1, "field": "f", "type": "string", "levels": ["a", "b"], "description": "x", "evidence_required": True, "level_descriptions": ["p", None]}
    book_t = "codebook_id int, name string, description string, effect_definition string, confidence boolean"
    field_t = "codebook_id int, ordinal int, field string, type string, levels array<string>, description string, evidence_required boolean, level_descriptions array<string>"

    def hash_of(b, f):
        return codebook.codebook_canonical_hash(spark.createDataFrame([tuple(b.values())], book_t), spark.createDataFrame([tuple(f.values())], field_t)).first().hash

    changes = [(book | {k: v}, field) for k, v in (("name", "m"), ("description", None), ("effect_definition", "g"), ("confidence", False))]
    changes += [(book, field | {k: v}) for k, v in (("field", "g"), ("type", "number"), ("levels", ["a,b"]), ("description", "y"), ("evidence_required", False), ("level_descriptions", ["q", None]))]
    hashes = [hash_of(book, field), *(hash_of(*c) for c in changes)]
    assert len(set(hashes)) == len(hashes)
    assert hashes[0] == hash_of(book | {"name": " n "}, field | {"type": " String"})


def test_fingerprint_heeds_the_providers_settings(spark):
    valid, digests = spark.createDataFrame([("a", "r", "")], "source_pdf string, row_id string, locator string"), spark.createDataFrame([("a", "d")], "name string, digest string")
    of = lambda book, *by, **how: [r.fingerprint for r in results.input_fingerprint(valid, digests, book, *by, **how).collect()]
    assert of("b", "gemini", "m", reasoning_effort="high") == of("b", "gemini", "m")
    assert of("b", "openrouter", "m", reasoning_effort="high") != of("b", "openrouter", "m")
    assert of("b", "openai_compatible", "m", base_url="u") != of("b", "openai_compatible", "m") != of("b", "openrouter", "m")
    assert of(None, "gemini", "m") == []


def test_alpha_of_the_textbook(spark):
    # four coders, twelve units, missing codes
    table = {"A": "1233214123..", "B": "123322412.51", "C": ".33322441251", "D": "12332441253."[:12]}
    rows = [(u, "f", c, x) for c, row in table.items() for u, x in enumerate(row) if x != "."]
    got = evaluate.krippendorff_alpha(spark.createDataFrame(rows, "unit int, field string, coder string, code string")).first()
    units = {}
    for u, _, _, x in rows:
        units.setdefault(u, []).append(int(x))
    units = {u: xs for u, xs in units.items() if len(xs) > 1}
    every = [x for xs in units.values() for x in xs]

    def alpha(apart):
        seen = sum(apart(x, y) / (len(xs) - 1) for xs in units.values() for i, x in enumerate(xs) for j, y in enumerate(xs) if i != j)
        return 1 - (len(every) - 1) * seen / sum(apart(x, y) for x in every for y in every)

    between = lambda x, y: (sum(min(x, y) <= g <= max(x, y) for g in every) - (every.count(x) + every.count(y)) / 2) ** 2 if x != y else 0
    assert got.units == len(units) and got.codes == len(every)
    assert got.alpha_nominal == pytest.approx(alpha(lambda x, y: x != y)) and got.alpha_ordinal == pytest.approx(alpha(between))


def test_a_baseline_is_one_row(spark):
    one = spark.createDataFrame([(1, 1.0, 0)], "cells long, accuracy double, not_ok long")
    assert evaluate.regression_check(one, one).count() == 0
    with pytest.raises(Exception, match="one row"):
        evaluate.regression_check(one, one.unionByName(one)).collect()


def test_sample_equals_a_sort(spark):
    rows = spark.range(3000).select(F.concat(F.lit("d"), (F.col("id") % 900).cast("string")).alias("source_pdf"), "id")
    import hashlib

    want = sorted({f"d{i}" for i in range(900)}, key=lambda x: hashlib.md5(f"s/{x}".encode()).hexdigest())[:7]
    assert {r.source_pdf for r in evaluate.validation_sample(rows, 7, "s").collect()} == set(want)


def test_spreadsheet_file(spark, tmp_path):
    wide = spark.createDataFrame([("r1", "=1+1", 'a "b", c\nd'), ("", None, None)], "row_id string, `@f` string, g string").coalesce(1)
    sheets.sink_spreadsheet_csv(wide, str(tmp_path / "x"))
    files = [p.read_bytes() for p in (tmp_path / "x").glob("part-*")]
    assert [f for f in files if b"r1" in f] == ['﻿row_id,\'@f,g\r\nr1,\'=1+1,"a ""b"", c\nd"\r\n'.encode()]


def test_a_failing_coder_is_asked_again(spark):
    def coder(prompt, row_ids):
        raise ValueError("no")

    asked = spark.createDataFrame([("a", ["r"], "p")], "source_pdf string, row_ids array<string>, prompt string")
    got = requests.annotate_documents(asked, coder, max_attempts=3, delay=0.01).first()
    assert (got.status, got.error, got.attempts) == ("error", "ValueError: no", 3)


def test_staged_tables_go(spark):
    df = stage(spark.range(3), "x")
    assert df.count() == 3
    discard(df, None, spark.range(1))
    with pytest.raises(Exception):
        spark.read.parquet(df._staged).count()


def test_broken_answers_are_repaired_where_they_can_be(spark):
    cases = {
        '```json\n{"effects": [1, 2,],}\n```': '{"effects": [1, 2]}', 'Here: [1] and more': "[1]", '{"a": "cut o': '{"a": "cut o"}', '{"a": 1, "b": ': '{"a": 1}', '{"a": [1, {"b": tr': '{"a": [1, {}]}',
        '{"a": "x\\': '{"a": "x"}', "no record": None, "": None, '{"a": 1]': '{"a": 1}', "{a: 1}": '{"a": 1}', '{"a" 1}': None,
    }
    from paperloom.operators import responses

    for raw, want in cases.items():
        assert responses.repaired_json(raw) == want, raw
    attempts = spark.createDataFrame([("a", "error", None, '{"effects":[{"row_id":"r","n":{"value":1}},]'), ("b", "ok", None, '{"effects":[{"row_id":"r","n":{"value":1}}]}'), ("c", "ok", None, "x")], "source_pdf string, status string, error string, raw string")
    asked = spark.createDataFrame([(x, "r") for x in "abc"], "source_pdf string, row_id string")
    got = {r.source_pdf: r.status for r in responses.replay(attempts, asked, [responses.Field("n", "integer", evidence_required=False)]).collect()}
    assert got == {"a": "needs_review", "b": "ok", "c": "error"}
