import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paperloom.llm import decontaminate, mixing, near_dedup
from sqlcheck import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed):
    rng = random.Random(seed)
    return [rng.choice(["the", "of", "and", "in"]) + str(rng.randrange(400)) for _ in range(n)]


def english(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choices("the house of the old man and the sea is near a quiet river with green fields where people walk every day in spring".split(), k=n))


def docs_of(spark, rows):
    """Rows (doc_id, text, source), with columns whose names the stages use inside."""
    docs = spark.createDataFrame([(i, t, "ru" if t and "все" in t else "en", s, None) for i, t, s in rows], DOCS)
    return docs.withColumns({c: F.lit(1) for c in ("component_id", "key", "size", "start", "_slot", "kept", "n")})


def of(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_takes_an_empty_table(spark, name):
    docs = docs_of(spark, [])
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    assert out.count() == 0 and set(docs.columns) <= set(out.columns)


def test_language_judges_rows_not_ids(spark):
    good = [(i, english(30, i), "a") for i in range(40)]
    foreign = "все люди рождаются свободными и равными " * 4
    rows = [*good, (3, foreign, "a"), (None, foreign, "a"), (None, english(20, 91), None), (7, None, "a"), (8, "", "a"), (9, " 12 ", "a"), (50, english(20, 92), "a"), (50, english(20, 92), "a")]
    docs = docs_of(spark, rows)
    out = corpus_pipeline.identify_language(spark, docs, SF)
    assert out.columns == docs.columns
    gone = {(3, foreign), (None, foreign), (7, None), (8, ""), (9, " 12 ")}
    assert of(out) == Counter((i, t) for i, t, _ in rows if (i, t) not in gone)


def test_near_duplicates_by_rows(spark):
    a, b, c = (words(80, k) for k in (1, 2, 3))
    text = lambda w, *edit: " ".join([*edit, *w[len(edit) :]])
    rows = [
        (5, text(a), "s"), (5, text(b), "s"), (7, text(a, "x"), "s"), (8, text(b, "x"), "s"),  # one id, two texts
        (None, text(a, "y"), "s"), (None, text(c), "s"), (None, text(c, "z"), "s"),  # no id
        (9, None, "s"), (9, None, "s"), (10, " ", "s"),  # no words
        (11, "one two", "s"), (11, "one two", "t"), (12, "one two three", "s"), (3, text(c, "q", "r"), "s"),
    ]
    docs = docs_of(spark, rows)
    out = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    assert of(out) == Counter([(5, text(a)), (5, text(b)), (9, None), (9, None), (10, " "), (11, "one two"), (12, "one two three"), (3, text(c, "q", "r"))])


def test_benchmark_goes_whatever_the_id(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    leak = english(50, 1) + " " + item + " " + english(50, 2)
    rows = [(None, leak, "s"), (1, leak, "s"), (1, english(60, 3), "s"), (2, None, "s"), (None, None, "s"), (3, "", "s"), (3, "", "s")]
    docs = docs_of(spark, rows)
    out = corpus_pipeline.drop_benchmark(spark, docs, SF)
    assert out.columns == docs.columns
    assert of(out) == Counter((i, t) for i, t, _ in rows if t != leak)


def test_mix_repeats_each_row_by_its_own_epochs(spark):
    rows = [(None, f"nul{i} " * (5 + i % 9), "a") for i in range(60)] + [(7, "same text here " * 4, "b")] * 20 + [(100 + i, f"one{i} " * 20, "c") for i in range(60)] + [(None, None, "a"), (8, " ", None)]
    docs = docs_of(spark, rows)
    out = corpus_pipeline.mix_sources(spark, docs, SF)
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.text, r.source) for r in out.collect())
    size = lambda t: len((t or "").split())
    sizes = docs.select("doc_id", "source", mixing.count_words(F.col("text")).alias("size"))
    target = {r.source: r.target for r in mixing.taken_words(sizes).select("source", "target").distinct().collect()}
    have, own = Counter(), Counter(rows)
    for (i, t, s), n in got.items():
        assert size(t) and n <= 3 * own[i, t, s]
        have[s] += n * size(t)
    # whole documents meet the target to within one per epoch
    assert all(abs(have[s] - target[s]) <= 60 for s in "abc")


def test_mix_stands_in_the_order_of_the_schedule(spark):
    rows = [(i, f"w{i} " * 400, "ab"[i % 2]) for i in range(400)]
    out = corpus_pipeline.mix_sources(spark, docs_of(spark, rows), SF)
    order = [r.source for r in out.withColumn("p", F.spark_partition_id()).collect()]
    share = order.count("a") / len(order)
    assert 0.2 < share < 0.5
    # sources alternate by their weights from the beginning
    for n in range(60, len(order), 60):
        assert abs(order[:n].count("a") - share * n) < 12


def test_shards_hold_every_row(spark):
    rows = [(i % 500, f"t{i}", "s") for i in range(1000)] + [(None, f"n{i}", "s") for i in range(500)] + [(1, "same", "s")] * 50 + [(None, None, None)] * 3
    docs = docs_of(spark, rows).withColumn("shard", F.lit("old"))
    got = corpus_pipeline.shard(spark, docs, SF)
    assert set(got.columns) == {*docs.columns, "slot"}
    assert of(got) == Counter((i, t) for i, t, _ in rows)
    by = Counter(r.shard for r in got.collect())
    assert set(by) == set(range(24)) and max(by.values()) - min(by.values()) <= 1


def test_pipeline_over_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    unique = corpus_pipeline.drop_near_duplicates(spark, docs.unionByName(docs), SF)
    assert unique.columns == docs.columns and unique.count() == near_dedup.near_duplicates(docs).where("kept").count()
    leaks = {r.doc_id for r in decontaminate.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    kept = {r.doc_id for r in corpus_pipeline.drop_benchmark(spark, docs, SF).select("doc_id").collect()}
    assert leaks and kept == {r.doc_id for r in docs.select("doc_id").collect()} - leaks
    assert corpus_pipeline.run(spark, SF).count() > 0
