"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Targets: each source's share of all words by weight, limited to ``max_epochs`` times its own words, the excess shared
again by weight among the others (water filling, in closed form over the sources ordered by words per weight).

Schedule: slot k of 2^m slots stands at the van der Corput point reverse_bits(k) / 2^m. The sources, one after the
other, own shares of the unit interval in proportion to the slots they need, so the point of a slot names its source;
points beyond the last share are idle. Reversing bits is its own inverse, so the slots of a source are listed from
its share, without a search. A source's slots are ranked in schedule order; rank r takes block r of the source's
shuffled words (epochs follow each other), and a block's documents are found by joining on (source, block).

All ranks and running sums are in two levels (chunk totals, then within chunks) of about the square root of a source
each, so no task sees a whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.plans.staging import stage

BLOCK_WORDS = 2048
MAX_EPOCHS = 3


def count_words(text: Column) -> Column:
    """Number of runs of characters other than space and \\t\\n\\v\\f\\r; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def reverse_bits(k: Column, bits: int) -> Column:
    """The low ``bits`` bits of ``k`` in reverse order."""
    for shift, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        k = F.shiftrightunsigned(k, shift).bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftleft(k.bitwiseAND(F.lit(mask)), shift))
    k = F.shiftrightunsigned(k, 32).bitwiseOR(F.shiftleft(k, 32))
    return F.shiftrightunsigned(k, 64 - bits)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, size) rows to (source, source_size, weight, target). One row per source; weights repeat over the
    sources by code point, null last. The windows here run over the sources alone, one short row each."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(1))
    place = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * max_epochs)
    # from the source that is full first; a source is full if the level at its turn is above its cap
    by_level = everything.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("rest", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    s = s.withColumn("rest_weight", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("full", F.col("rest") * F.col("weight") > F.col("cap") * F.col("rest_weight"))
    level = F.min(F.when(~F.col("full"), F.struct(-F.col("rest_weight"), F.col("rest"), F.col("rest_weight").alias("w")))).over(everything)
    s = s.withColumn("level", level)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("level.rest").cast("double") * F.col("weight") / F.col("level.w"))
    return s.select("source", "source_size", "weight", target.alias("target"))


def placed(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Each document's place in its source's shuffled row of words: ``start`` (words before it). The order is that of
    md5 over doc_id and, where there is one, the column ``salt`` (a digest of the text, which tells apart rows without
    doc_id): the same in every run. Rows equal in all of these are interchangeable."""
    salt = F.coalesce(F.col("salt"), F.lit("")) if "salt" in docs.columns else F.lit("")
    docs = docs.withColumn("turn", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), salt).cast("binary"))).drop("salt")
    docs = docs.withColumn("chunk", F.conv(F.substring("turn", 1, 8), 16, 10).cast("long"))
    # as many chunks as a chunk of the largest source has documents
    parts = docs.groupBy("source").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    step = -(-(1 << 32) // max(1, math.isqrt(parts)))
    docs = docs.withColumn("chunk", F.floor(F.col("chunk") / step))
    totals = docs.groupBy("source", "chunk").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(F.col("source").alias("s"), F.col("chunk").alias("c"), before.alias("before"))
    inside = Window.partitionBy("source", "chunk").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    docs = docs.join(totals, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c")))
    return docs.withColumn("start", F.col("inside") + F.col("before")).drop("turn", "chunk", "inside", "before", "s", "c")


def schedule(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix's slots: (slot, source, rank, epoch, block, words), slot giving their order.

    A source needs the blocks of its full epochs and of the rest of its target; its last slot may be shorter, so that
    a source's slots sum up to its rounded target.
    """
    s = sources.where("source_size > 0").withColumn("want", F.round("target").cast("long"))
    per_epoch = F.ceil(F.col("source_size") / block_words)
    s = s.withColumn("per_epoch", per_epoch).withColumn("epochs", F.floor(F.col("want") / F.col("source_size")))
    s = s.withColumn("rest", F.col("want") - F.col("epochs") * F.col("source_size"))
    s = s.withColumn("slots", F.col("epochs") * F.col("per_epoch") + F.ceil(F.col("rest") / block_words))
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = stage(s.withColumn("low", F.coalesce(F.sum("slots").over(order), F.lit(0))), "shares")
    bits = max(1, int((s.agg(F.sum("slots")).first()[0] or 1) - 1).bit_length())
    chunk = 1 << (bits + 1) // 2
    chunks = s.where("slots > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / chunk))).alias("part"))
    chunks = chunks.repartition(F.col("source"), F.col("part"))
    points = chunks.select("*", F.explode(F.sequence(F.col("part") * chunk, F.least(F.col("part") * chunk + chunk, F.col("slots")) - 1)).alias("p"))
    slots = points.withColumn("slot", reverse_bits(F.col("low") + F.col("p"), bits)).withColumn("chunk", F.floor(F.col("slot") / chunk))
    # rank of a slot among its source's: slots in earlier chunks, then those before it in its own
    totals = slots.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(F.col("source").alias("ts"), F.col("chunk").alias("tc"), before.alias("before"))
    slots = slots.withColumn("inside", F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1)
    slots = slots.join(totals, F.col("source").eqNullSafe(F.col("ts")) & (F.col("chunk") == F.col("tc")))
    slots = slots.withColumn("rank", F.col("inside") + F.col("before"))
    slots = slots.withColumn("epoch", F.floor(F.col("rank") / F.col("per_epoch"))).withColumn("block", F.col("rank") % F.col("per_epoch"))
    length = F.least(F.lit(block_words), F.when(F.col("epoch") < F.col("epochs"), F.col("source_size")).otherwise(F.col("rest")) - F.col("block") * block_words)
    return slots.select("slot", "source", "rank", "epoch", "block", length.cast("long").alias("words"))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix of ``docs`` (doc_id, source, size, perhaps salt): the documents with their places, the sources with their targets, and
    the pieces (slot, epoch, doc_id, source, start, size, from_word, to_word) of which the mix consists, slot by slot.

    Defined cases: a null source is a source of its own, last in order; a document without words is in no piece; rows
    that repeat are mixed one by one; an empty table gives no rows.
    """
    sources = stage(source_targets(docs, weights, max_epochs), "targets")
    docs = stage(placed(docs, sources), "placed")
    slots = schedule(sources, block_words).select("slot", "epoch", F.col("source").alias("slot_source"), F.col("block").alias("slot_block"), F.col("words").alias("slot_words"))
    last = F.floor((F.col("start") + F.col("size") - 1) / block_words)
    parts = docs.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words), last)))
    pieces = parts.join(slots, F.col("source").eqNullSafe(F.col("slot_source")) & (F.col("block") == F.col("slot_block")))
    low = F.greatest(F.col("start"), F.col("block") * block_words)
    high = F.least(F.col("start") + F.col("size"), F.col("block") * block_words + F.col("slot_words"))
    pieces = pieces.where(high > low).select("slot", "epoch", "doc_id", "source", "start", "size", (low - F.col("start")).alias("from_word"), (high - F.col("start")).alias("to_word"))
    return docs, sources, pieces


def taken_words(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, source, size, perhaps salt) to one row per document: with source_size, target, the words that the mix takes
    and the first slot in which it does (null if none)."""
    docs, sources, pieces = mix(docs.select("doc_id", "source", "size", *(c for c in docs.columns if c == "salt")), **how)
    # in a source, a document with words is known by its start
    taken = pieces.groupBy("source", "start", "doc_id", "size").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"), F.min("slot").alias("first_slot"))
    taken = taken.select(F.col("source").alias("t_source"), F.col("start").alias("t_start"), F.col("size").alias("t_size"), "taken", "first_slot")
    out = docs.join(taken, F.col("source").eqNullSafe(F.col("t_source")) & (F.col("start") == F.col("t_start")) & (F.col("size") == F.col("t_size")), "left")
    sources = sources.select(F.col("source").alias("s_source"), "source_size", "target")
    out = out.join(sources, F.col("source").eqNullSafe(F.col("s_source")))
    return out.select("doc_id", "source", "size", "start", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")
