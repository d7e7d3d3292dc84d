"""MinHash near-duplicate detection: one-permutation hashing, banded buckets, star-shaped candidate edges.

Every text becomes the set of its distinct five-word shingles. One hash of each shingle is dealt to one of ``BINS``
bins and the smallest of a bin is kept (one permutation); an empty bin borrows from bins drawn by a fixed random probe
sequence (optimal densification). ``ROWS`` bins make a band; texts with an equal band share a bucket. In each bucket
the set that meets most others is the star's centre; only centre and member are compared, on full sets.

What the stars leave open (sets that share a bucket, are not its centre and are not yet connected) is closed by an
exact index, which also takes all sets of up to ``SHORT`` shingles, whatever their buckets, with all that may be similar
to them: see ``rare_pairs``. So no link of a set of up to ``SHORT`` shingles is lost; two longer sets are compared if
they share a bucket, or a third text ties them together.

Equal sets are one node from the start, so a group of exact copies costs one row per copy and no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.blocks import blocks_of, constants, mixed, text_blocks
from paperloom.plans.staging import discard, stage

WORDS, THRESHOLD = 5, 75
ROWS, BANDS = 6, 80
#: Sets of up to this many shingles are compared by the exact index, whatever their buckets.
SHORT = 64
BINS = ROWS * BANDS
PROBES = 64
#: Members that one star task compares with its centre.
STAR_ROWS = 400
#: Shingles are dealt to 2^BITS_LOG2 bits by hash; a set keeps each bit's parity.
BITS_LOG2 = 9
#: Sizes of sets are in one class of the exact index up to this factor.
CLASS = 1.1
#: Ids that may be broadcast to pick texts; beyond it the join shuffles.
BROADCAST_IDS = 2_000_000

_PROBE = (constants(BINS * PROBES, 11) % np.uint64(BINS)).astype(np.int64).reshape(BINS, PROBES)
_BAND = constants(BANDS, 12)
_ROW = constants(ROWS, 13)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The one-permutation signature of a sorted set of 64-bit hashes, densified."""
    bins = ((hashes >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(np.diff(bins)) + 1))
    out, full = np.zeros(BINS, dtype=np.uint64), np.zeros(BINS, dtype=bool)
    out[bins[first]], full[bins[first]] = hashes[first], True
    empty = np.flatnonzero(~full)
    if len(empty):
        hit = full[_PROBE[empty]]
        source = _PROBE[empty, hit.argmax(axis=1)]
        lost = ~hit.any(axis=1)  # no probe met a full bin: the next full one, going round
        if lost.any():
            there = bins[first]
            source[lost] = there[np.searchsorted(there, empty[lost]) % len(there)]
        out[empty] = out[source]
    return out


def bucket_keys(hashes: np.ndarray) -> np.ndarray:
    """The buckets of a sorted set, one per band."""
    bands = (mixed(signature(hashes).reshape(BANDS, ROWS)) * _ROW).sum(axis=1, dtype=np.uint64)
    return np.unique(mixed(bands + _BAND))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, block in text_blocks(batches):
        hashes, at = block.shingles(WORDS)
        n, f, keys = [], [], []
        for i in range(len(block)):
            own = np.unique(hashes[at[i] : at[i + 1]])
            n.append(len(own))
            f.append((int(own.sum(dtype=np.uint64).view(np.int64)), int(mixed(own + np.uint64(7)).sum(dtype=np.uint64).view(np.int64))) if len(own) else (None, None))
            # a set of one shingle is similar to its equals only
            keys.append(bucket_keys(own).view(np.int64) if len(own) > 1 else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array([x[0] for x in f], pa.int64()), pa.array([x[1] for x in f], pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "f1", "f2", "keys"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's set, sorted, under the name that ``_digest`` gives it."""
    for batch, block in text_blocks(batches):
        hashes, at = block.shingles(WORDS)
        own = [np.unique(hashes[at[i] : at[i + 1]]) for i in range(len(block))]
        names = np.array([x.sum(dtype=np.uint64) for x in own], dtype=np.uint64).view(np.int64)
        ends = np.concatenate(([0], np.cumsum([len(x) for x in own])))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(own).view(np.int64)))
        bits = np.stack([np.bincount((x >> np.uint64(64 - BITS_LOG2)).astype(np.int64), minlength=1 << BITS_LOG2) & 1 for x in own])
        parity = np.packbits(bits.astype(np.uint8), axis=1).view(np.int64)
        parities = pa.ListArray.from_arrays(pa.array(np.arange(len(block) + 1) * parity.shape[1], pa.int32()), pa.array(parity.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names), lists, parities], ["rep", "set", "own", "parity"])


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are linked."""
    if not len(a) or not len(b):
        return False
    both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return 100 * both >= THRESHOLD * (len(a) + len(b) - both)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by star, its centre first: the pairs whose sets are similar enough."""
    star, centre_own = None, None
    for batch in batches:
        ids = list(zip(*(batch.column(c).to_pylist() for c in ("centre", "centre_set", "star"))))
        member, is_centre = batch.column("member").to_pylist(), batch.column("is_centre").to_pylist()
        lists = batch.column("own")
        values, ends = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
        found: list[tuple[int, int]] = []
        for row, id_ in enumerate(ids):
            own = values[ends[row] : ends[row + 1]]
            if is_centre[row]:
                star, centre_own = id_, own.copy()
            elif star == id_ and _similar(centre_own, own):
                found.append((id_[0], member[row]))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["u", "v"])


def _held(docs: DataFrame, needed: DataFrame, repeated: bool) -> DataFrame:
    """The staged sets (rep, set, own, parity) of ``needed`` (rep, set): their texts are read again where they lie. Few ids are
    sent there; many are joined by a shuffle of both sides."""
    ids = stage(needed.select("rep", "set").distinct(), "needed")
    few = ids.count() <= BROADCAST_IDS
    texts = docs.join((F.broadcast if few else lambda x: x)(ids.select(F.col("rep").alias("doc_id")).distinct()), "doc_id", "left_semi")
    held = texts.mapInArrow(_sets, "rep long, set long, own array<long>, parity array<long>")
    if repeated:  # rows that repeat a doc_id: one row of each set, and no other sets
        held = held.groupBy("rep", "set").agg(F.any_value("own").alias("own"), F.any_value("parity").alias("parity")).join(ids, ["rep", "set"], "left_semi")
    held = stage(held, "held")
    discard(ids)
    return held


def _verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Of the staged pairs (centre, centre_set, member, member_set) those linked on their full sets, as (u, v) of ids. A
    centre with many members is dealt by hash to as many tasks as they fill; no set travels more than once to a star."""
    sizes = pairs.groupBy("centre", "centre_set").agg(F.count("*").alias("m")).where(F.col("m") > STAR_ROWS)
    # bounded: a row for every STAR_ROWS pairs at most
    large = stage(sizes.select("centre", "centre_set", F.ceil(F.col("m") / STAR_ROWS).alias("stars")), "stars")
    side = F.broadcast(large) if large.count() <= BROADCAST_IDS else large
    pairs = pairs.join(side, ["centre", "centre_set"], "left")
    pairs = pairs.withColumn("star", F.coalesce(F.pmod(F.xxhash64("member", "member_set"), F.col("stars")), F.lit(0))).drop("stars")
    centres = pairs.select("centre", "centre_set", "star").distinct()
    rows = pairs.withColumn("is_centre", F.lit(False)).unionByName(centres.select("*", F.col("centre").alias("member"), F.col("centre_set").alias("member_set"), F.lit(True).alias("is_centre")))
    rows = rows.join(held.select(F.col("rep").alias("member"), F.col("set").alias("member_set"), "own"), ["member", "member_set"])
    rows = rows.repartition("centre", "centre_set", "star").sortWithinPartitions("centre", "centre_set", "star", F.col("is_centre").desc())
    links = stage(rows.select("centre", "centre_set", "star", "member", "is_centre", "own").mapInArrow(_compare, "u long, v long"), "links")
    discard(large)
    return links


def rare_pairs(nodes: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs (a, a_set, b, b_set) of ``nodes`` (rep, set, label) with different labels: all that can be similar enough.

    In an order of shingles common to all sets, rarest first, take the first shingle that two linked sets share. From
    it on, each must still hold as many shingles as they share at least: t / (1 + t) of the two sizes' sum. The smaller
    set is indexed by the front that this leaves it beside its equals in size; the larger one asks, for each class of
    smaller sizes, with the front that is left to it there. So texts that differ from each other by more than the
    threshold allows, and share a template, meet in no key. In a key, members of its most frequent label never meet each
    other, so the pairs that are looked at are at most twice those with different labels. Of these only pairs are made
    whose parities differ in no more bits than linked sets have shingles apart."""
    at = held.join(nodes.select("rep", "set").distinct(), ["rep", "set"], "left_semi").select("rep", "set", F.size("own").alias("n"), F.explode("own").alias("shingle"))
    often = at.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    # a shingle of one set only meets nobody: its place in the order is all that counts
    common = stage(at.join(often, "shingle"), "common")
    place = F.row_number().over(Window.partitionBy("rep", "set").orderBy(F.col("df").desc(), F.col("shingle").desc()))
    # of the n - i shingles from a place on, counted from the most frequent
    front = common.withColumn("left", place).where((100 + THRESHOLD) * F.col("left") >= THRESHOLD * (F.col("n") + F.ceil(F.col("n") * (THRESHOLD / 100))))
    front = stage(front.select("rep", "set", "n", "shingle", "left").join(nodes.select("rep", "set", "label").distinct(), ["rep", "set"]), "front")
    class_ = lambda n: F.floor(F.log(n) / math.log(CLASS) + 1e-9)
    index = front.where((100 + THRESHOLD) * F.col("left") >= 2 * THRESHOLD * F.col("n")).withColumn("class", class_(F.col("n")))
    asks = front.withColumn("class", F.explode(F.sequence(class_(F.ceil(F.col("n") * (THRESHOLD / 100))), class_(F.col("n")))))
    least = F.greatest(F.ceil(F.pow(F.lit(CLASS), F.col("class")) - 1e-6), F.ceil(F.col("n") * (THRESHOLD / 100)))
    asks = asks.where((100 + THRESHOLD) * F.col("left") >= THRESHOLD * (F.col("n") + least))
    counts = index.groupBy("shingle", "class", "label").agg(F.count("*").alias("m")).unionByName(asks.groupBy("shingle", "class", "label").agg(F.count("*").alias("m")))
    keys = counts.groupBy("shingle", "class", "label").agg(F.sum("m").alias("m")).groupBy("shingle", "class")
    # a key whose sets are all connected has no pair to find
    keys = stage(keys.agg(F.max_by("label", "m").alias("most"), F.count("*").alias("labels")).where("labels > 1").drop("labels"), "keys")
    index, asks = (stage(x.join(keys, ["shingle", "class"]), "index") for x in (index, asks))
    staged = (common, front, keys, index, asks)
    index, asks = (x.join(held.select("rep", "set", "parity"), ["rep", "set"]) for x in (index, asks))
    other = asks.select("shingle", "class", F.col("rep").alias("a"), F.col("set").alias("a_set"), F.col("n").alias("a_n"), F.col("label").alias("a_label"), F.col("left").alias("a_left"), F.col("parity").alias("a_parity"), "most")
    index = index.select("shingle", "class", F.col("rep").alias("b"), F.col("set").alias("b_set"), F.col("n").alias("b_n"), F.col("label").alias("b_label"), F.col("left").alias("b_left"), F.col("parity").alias("b_parity"), F.col("most").alias("b_most"))
    can = (F.col("a_label") != F.col("b_label")) & (F.col("b_n") <= F.col("a_n")) & (100 * F.col("b_n") >= THRESHOLD * F.col("a_n"))
    both = F.col("a_n") + F.col("b_n")
    can &= (100 + THRESHOLD) * F.least("a_left", "b_left") >= THRESHOLD * both
    apart = sum((F.bit_count(F.col("a_parity")[i].bitwiseXOR(F.col("b_parity")[i])) for i in range(1, 1 << BITS_LOG2 - 6)), F.bit_count(F.col("a_parity")[0].bitwiseXOR(F.col("b_parity")[0])))
    can &= (100 + THRESHOLD) * (both - apart) >= 2 * THRESHOLD * both
    met = index.where("b_label <> b_most").join(other, ["shingle", "class"]).where(can)
    met = met.unionByName(index.where("b_label = b_most").join(other.where("a_label <> most"), ["shingle", "class"]).where(can))
    turned = (F.col("a") > F.col("b")) | ((F.col("a") == F.col("b")) & (F.col("a_set") > F.col("b_set")))
    one = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    found = stage(met.select(one("a", "b").alias("a"), one("a_set", "b_set").alias("a_set"), one("b", "a").alias("b"), one("b_set", "a_set").alias("b_set")).distinct(), "rare")
    discard(*staged)
    return found


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` with each u's ``least``: a staged table of few rows is sent to the edges; else adaptive execution may
    split the hot ones."""
    return edges.join(F.broadcast(least) if least.count() <= BROADCAST_IDS else least, "u")


def connected(edges: DataFrame) -> DataFrame:
    """The smallest node that each node of ``edges`` (u, v) reaches: (node, label). Alternates stars towards larger
    and smaller neighbours; each round is staged, so that lineage stays short and lost executors cost one round."""
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges, before = stage(edges, "edges"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = stage(_with_least(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        smallest = stage(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = _with_least(large, smallest).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        last, edges = edges, stage(small, "edges")
        discard(last, least, large, smallest)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        before = now


def _ties(own: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (u, v) from each doc_id with several sets to the ids that stand for those sets."""
    several = own.groupBy("doc_id").agg(F.min("f1").alias("low"), F.max("f1").alias("high")).where("low <> high").select("doc_id")
    theirs = own.select("doc_id", "f1", "f2", "n_shingles").distinct().join(several, "doc_id", "left_semi")
    return theirs.join(sets.drop("keys"), ["f1", "f2", "n_shingles"]).where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Defined cases: a null or blank text has no shingles, is its own component and kept; a null doc_id is never linked:
    its component_id is null and it is kept; rows that repeat a doc_id are one document with several texts, each of which
    may link it; a text of fewer than five words is linked with equal word sequences only; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    digest = stage(docs.mapInArrow(_digest, "doc_id long, n_shingles long, f1 long, f2 long, keys array<long>"), "digest")
    own = digest.where("doc_id is not null and n_shingles > 0")
    sets = stage(own.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.any_value("keys").alias("keys")), "sets")
    repeated = not own.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").isEmpty()
    entries = sets.where("keys is not null").select("rep", F.col("f1").alias("set"), F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
    # A set's fame is how often it meets others in buckets. The famous one of a bucket is its centre: the original of
    # many edited copies is closer to each of them than they are to each other.
    shared = entries.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    met = stage(entries.join(shared, "key"), "met")
    fame = met.groupBy("rep", "set").agg(F.sum("m").alias("fame"))
    members = stage(met.drop("m").join(fame, ["rep", "set"]), "members")
    best = F.min(F.struct((-F.col("fame")).alias("f"), "rep", "set", "n"))
    centres = members.groupBy("key").agg(best.alias("c")).select("key", F.col("c.rep").alias("centre"), F.col("c.set").alias("centre_set"), F.col("c.n").alias("centre_n"))
    centres = stage(centres, "centres")
    same_set = (F.col("centre") == F.col("rep")) & (F.col("centre_set") == F.col("set"))
    similar = (100 * F.least("n", "centre_n") >= THRESHOLD * F.greatest("n", "centre_n")) & ~same_set
    met_centre = members.join(centres, "key").where(similar)
    # two sets meet in many buckets, and may be each other's centre: they are compared once
    turned = (F.col("centre") > F.col("rep")) | ((F.col("centre") == F.col("rep")) & (F.col("centre_set") > F.col("set")))
    one = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    done = met_centre.select(one("centre", "rep").alias("a"), one("centre_set", "set").alias("a_set"), one("rep", "centre").alias("b"), one("set", "centre_set").alias("b_set"), (~turned).alias("a_is_centre"))
    done = stage(done.groupBy("a", "a_set", "b", "b_set").agg(F.bool_or("a_is_centre").alias("a_is_centre")), "candidates")
    pick = lambda x, y: F.when(F.col("a_is_centre"), F.col(x)).otherwise(F.col(y))
    pairs = done.select(pick("a", "b").alias("centre"), pick("a_set", "b_set").alias("centre_set"), pick("b", "a").alias("member"), pick("b_set", "a_set").alias("member_set"))
    held = _held(docs, pairs.select(F.col("member").alias("rep"), F.col("member_set").alias("set")).unionByName(pairs.select(F.col("centre").alias("rep"), F.col("centre_set").alias("set"))), repeated)
    links = _verified(pairs, held)
    discard(held, met)
    edges = links
    if repeated:  # the texts of one doc_id tie their groups together
        edges = links.unionByName(_ties(own, sets))
    same = connected(edges)
    discard(links)
    # The rest: without their centres, buckets whose members are still in more than one component.
    labels = same.select(F.col("node").alias("rep"), "label")
    rest = members.select("key", "rep", "set").join(centres.select("key", F.col("centre").alias("rep"), F.col("centre_set").alias("set")), ["key", "rep", "set"], "left_anti")
    rest = stage(rest.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep")), "rest")
    open_ = rest.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    nodes = rest.join(open_, "key", "left_semi").select("rep", "set", "label")
    # All short sets, and the longest that may be similar to one; a set of one shingle is similar to its equals only.
    short = sets.where((F.col("n_shingles") > 1) & (THRESHOLD * F.col("n_shingles") <= 100 * SHORT)).select("rep", F.col("f1").alias("set"))
    short = short.join(labels, "rep", "left").select("rep", "set", F.coalesce("label", "rep").alias("label"))
    nodes = stage(nodes.unionByName(short).distinct(), "nodes")
    discard(members, centres, rest)
    held = _held(docs, nodes, repeated)
    found = rare_pairs(nodes, held)
    pairs = stage(found.join(done.drop("a_is_centre"), ["a", "a_set", "b", "b_set"], "left_anti").select(F.col("a").alias("centre"), F.col("a_set").alias("centre_set"), F.col("b").alias("member"), F.col("b_set").alias("member_set")), "candidates")
    fresh = _verified(pairs, held)
    discard(held, nodes, found, pairs, done)
    label = F.coalesce("label", "rep")
    if not fresh.isEmpty():
        # the components found so far are the nodes of a smaller graph
        of = lambda c: F.coalesce(F.col(f"{c}_label"), F.col(c)).alias(c)
        ends = fresh.join(same.select(F.col("node").alias("u"), F.col("label").alias("u_label")), "u", "left").join(same.select(F.col("node").alias("v"), F.col("label").alias("v_label")), "v", "left")
        joined = connected(ends.select(of("u"), of("v"))).select(F.col("node").alias("first"), F.col("label").alias("last"))
        same = same.select("node", F.col("label").alias("first"))
        named = sets.select("f1", "f2", "n_shingles", "rep").join(same, F.col("rep") == F.col("node"), "left").withColumn("first", F.coalesce("first", "rep"))
        named = named.join(joined, "first", "left").select("f1", "f2", "n_shingles", F.coalesce("last", "first").alias("rep"))
    else:
        named = sets.select("f1", "f2", "n_shingles", "rep").join(same, F.col("rep") == F.col("node"), "left").select("f1", "f2", "n_shingles", label.alias("rep"))
    out = digest.drop("keys").join(named, ["f1", "f2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
