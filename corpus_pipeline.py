"""A corpus from documents: language ID, near-duplicates, benchmark items, mixing to weights, shards.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import decontaminate, language_id, mixing, near_dedup, sharding
from paperloom.llm.selection import BROADCAST_IDS, one_row_each, row_key, without_keys
from paperloom.plans.staging import discard, stage

SHARDS = 24

#: Language ID learns from the data and its likelihoods are no SQL.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language, or too doubtful in it.

    Every row is judged by its own text, lang and source: rows without doc_id, or that share one, like any other. Rows
    without letters go; equal rows stay or go together; an empty table gives no rows.
    """
    key = row_key("doc_id", "text", "lang", "source")
    seen = docs.select(key.alias("doc_id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"), F.lit(None).cast("string").alias("suffix"))
    return without_keys(docs, key, language_id.identified(seen).where("not kept").select("doc_id"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: that of the smallest doc_id, one without doc_id last.

    Rows that share a doc_id and have different texts are different documents; rows without doc_id are grouped by their
    texts like any other. Rows equal in doc_id and text are copies, and the smallest stays. Rows without words are no
    copies of anything and all stay; an empty table gives no rows.
    """
    key = row_key("doc_id", "text")
    found = stage(near_dedup.near_duplicates(docs.select(key.alias("doc_id"), "text")).where("n_shingles > 0"), "groups")
    rows = found.groupBy("doc_id", "component_id").agg(F.count("*").alias("n"))
    groups = stage(rows.groupBy("component_id").agg(F.count("*").alias("m")).where("m > 1").select("component_id"), "several")
    # staged and counted: a group may hold a large part of the rows, and is either sent few names or split when joined
    few = F.broadcast if groups.count() <= BROADCAST_IDS else lambda df: df
    members = rows.join(few(groups), "component_id").select(F.col("doc_id").alias("_key"), "component_id")
    members = stage(members.join(docs.select(key.alias("_key"), "doc_id").distinct(), "_key"), "members")
    first = stage(members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key")).alias("first")), "first")
    others = members.join(few(first), "component_id").where(F.col("_key") != F.col("first._key")).select("_key")
    out = without_keys(docs, key, others)
    return one_row_each(out, key, rows.where("n > 1").select("doc_id"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test item, whatever their doc_id. Rows without text hold none and stay; equal texts stay
    or go together; an empty table, or a benchmark without items, drops nothing."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    key = row_key("text")
    return without_keys(docs, key, decontaminate.contaminated(docs.select(key.alias("doc_id"), "text"), items).select("doc_id"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in whole documents, in its order: a row stands once for each of the mix's epochs that takes more than half
    of its words, at the first slot in which that epoch takes it.

    Every row has epochs of its own, also without doc_id or with one that others have; a null source is a source. A row
    without words is in no mix and goes; an empty table gives no rows.
    """
    # staged: the rows' keys must be the same in every reading
    docs = stage(docs.select(F.struct(*docs.columns).alias("_doc"), F.monotonically_increasing_id().alias("_row")), "rows")
    sizes = stage(docs.select("_row", "_doc.doc_id", "_doc.source", mixing.count_words(F.col("_doc.text")).alias("size"), F.md5(F.col("_doc.text").cast("binary")).alias("salt")), "sizes")
    places, _, pieces = mixing.mix(sizes)
    rounds = pieces.groupBy("source", "start", "size", "epoch").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("words"), F.min("slot").alias("_slot"))
    copies = rounds.where("2 * words > size").select(F.col("source").alias("_source"), F.col("start").alias("_start"), "_slot")
    # in a source, a row with words is known by its start
    copies = places.where("size > 0").join(copies, F.col("source").eqNullSafe(F.col("_source")) & (F.col("start") == F.col("_start")))
    copies = stage(copies.select("_row", "_slot"), "copies")
    discard(sizes)
    side = F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies
    return docs.join(side, "_row").repartitionByRange("_slot", "_row").sortWithinPartitions("_slot", "_row").select("_doc.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and their slot in it, which replace columns of these names. A row stands on the ring where
    its doc_id does; one without doc_id where its text does. The texts travel once, to their places.

    Repeated rows get slots of their own; an empty table gives no rows.
    """
    place = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text/"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    # a hash tells rows of one doc_id apart, so that no text is sent twice
    docs = docs.withColumn("_ring_key", place).withColumn("_text_hash", F.xxhash64("text"))
    return sharding.assign_shards(docs, "_ring_key", SHARDS, order_by=("_text_hash",)).drop("_ring_key", "_text_hash")


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_benchmark),
    ("mix_sources", mix_sources),
    ("shard", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each staged as Parquet in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
