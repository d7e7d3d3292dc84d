"""Hard negatives: for an anchor and each of its positives, rows of other labels that score nearly as high.

Vectors of integers are indexed by an inverted multi-index: each half of the dimensions has a codebook, and a pair of
codewords is a cell. No row of a cell scores above the sum, over both halves, of anchor times codeword plus the anchor's
length times the cell's radius (the greatest distance of a row from its codeword). A query walks through the cells
from a heap, by falling sums of half bounds, and stops where no further cell can reach what it has: that certifies its windows,
so results are exact, whatever the codebooks are like. The walk has two legs, each a join of queries with cells: the first
takes the best cells until ``FIRST`` rows are seen, the second goes on from there with the scores that the first has found.
Positives are searched first, then the windows below them.

Rows of one label and vector are one point with its six smallest ids: of equal scores no more can come first (five, and the
anchor itself). Anchors of one label and vector are one query. Cells are cut into blocks of about ``BLOCK`` points by a hash,
queries travel in blocks of up to ``QUERIES``, and a task scores a block of one with a block of the other by one product
of matrices. Codebooks are fitted on a hashed sample of about ``SAMPLE`` points; all rows are indexed. They have as many
codewords as make cells of about ``CELL`` points, ``CODEWORDS`` at most, so that a product of matrices is worth its
call. The cells' directory (``CODEWORDS`` squared rows at most) is the only thing that goes to the driver, beside the sample.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component, take no part; shorter vectors
count as filled up with zeros; rows equal in id, label and vector are one; of rows that share an id none is a positive of
another; an anchor without rows of its label has no result; empty tables give none; further columns are not looked at.
Scores must fit into a long, else an error says so.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.plans.staging import discard, stage

CODEWORDS, CELL, SAMPLE, ROUNDS = 256, 512, 20_000, 8
BLOCK, QUERIES, FIRST = 1_024, 256, 2_048
POSITIVES, NEGATIVES = 5, 5
#: A negative scores between 80 and 100 per cent of the positive.
LOW, HIGH = 80, 100
#: Ids kept of a point: a row more than the positives, as the anchor may be among them.
_IDS = POSITIVES + 1
_NONE = np.iinfo(np.int64).min
_KINDS = ((1 << 15, np.int16), (1 << 31, np.int32), (1 << 62, np.int64))


class Index(NamedTuple):
    """Codebooks of both halves, the directory of cells and how numbers are kept."""

    halves: tuple[int, int]
    codes: tuple[np.ndarray, np.ndarray]
    counts: np.ndarray
    radii: tuple[np.ndarray, np.ndarray]
    kept: type
    exact: type


def points(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, q): the rows that take part, once each, components as integers."""
    x = F.transform("embedding", lambda x: x.cast("double"))
    rows = rows.select("vec_id", "label", x.alias("x"))
    sound = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where("vec_id is not null and label is not null and x is not null").where(sound)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform("x", lambda x: F.floor(x * scale)).alias("q")).distinct()


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix, shorter rows filled up with zeros."""
    flat, at = column.flatten().to_numpy(), column.offsets.to_numpy()
    sizes = np.diff(at)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(at[:-1] - at[0], sizes)] = flat
    return out


def codebook(sample: np.ndarray, size: int, rounds: int = ROUNDS) -> np.ndarray:
    """Codewords of half vectors by k-means, from evenly spaced distinct rows of the sample."""
    distinct = np.unique(sample, axis=0).astype(np.float64) if sample.size else np.zeros((1, sample.shape[1]))
    codes = distinct[np.linspace(0, len(distinct) - 1, min(size, len(distinct))).astype(np.int64)]
    for _ in range(rounds):
        own, _ = _nearest(sample.astype(np.float64), codes)
        n = np.bincount(own, minlength=len(codes))
        for i in np.flatnonzero(n):
            codes[i] = sample[own == i].mean(axis=0)
    return codes


def _nearest(half: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest codeword of each row, and the distance from it."""
    own = np.argmin((codes**2).sum(axis=1) - 2 * half @ codes.T, axis=1)
    return own, np.sqrt(((half - codes[own]) ** 2).sum(axis=1))


def _indexed(found: DataFrame, halves: tuple[int, int], codes: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Points with their cell and their distance from its codewords."""
    schema = "label: {}, q array<long>, ids array<long>, cell int, r1 double, r2 double".replace(": {}", " " + found.schema["label"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column("q"), sum(halves)).astype(np.float64)
            (i, r1), (j, r2) = _nearest(q[:, : halves[0]], codes[0]), _nearest(q[:, halves[0] :], codes[1])
            columns = [pa.array((i * len(codes[1]) + j).astype(np.int32)), pa.array(r1), pa.array(r2)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("label", "q", "ids")), *columns], names=["label", "q", "ids", "cell", "r1", "r2"])

    return found.select("label", "q", "ids").mapInArrow(run, schema)


def build(found: DataFrame) -> tuple[Index, DataFrame] | None:
    """The index of points (label, q, ids) and its blocks, staged; nothing where there are no points."""
    about = found.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("width"), F.max(F.array_max(F.transform("q", F.abs))).alias("most")).first()
    if not about.n:
        return None
    width, most = about.width, (about.most or 0) + 1
    if most * most * max(width, 1) >= 1 << 63:
        raise ValueError("components are too large: scores don't fit into a long")
    halves = (width + 1) // 2, width // 2
    share = F.pmod(F.xxhash64("label", "q"), F.lit(1_000_003)) < F.lit(int(1_000_003 * min(1, SAMPLE / about.n)) + 1)
    sample = _matrix(found.where(share).select("q").limit(2 * SAMPLE).toArrow().column("q").combine_chunks(), width)
    size = min(CODEWORDS, math.ceil(math.sqrt(about.n / CELL)))
    codes = codebook(sample[:, : halves[0]], size), codebook(sample[:, halves[0] :], size)
    rows = stage(_indexed(found, halves, codes), "indexed")
    cells = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2")).toArrow()
    shape = len(codes[0]), len(codes[1])
    counts, radii = np.zeros(shape, np.int64), (np.zeros(shape), np.zeros(shape))
    for into, name in zip((counts, *radii), ("n", "r1", "r2")):
        into.reshape(-1)[cells.column("cell").to_numpy()] = cells.column(name).to_numpy()
    kept = next(k for limit, k in _KINDS if most < limit)
    exact = next((k for limit, k in ((1 << 24, np.float32), (1 << 53, np.float64)) if most * most * max(width, 1) < limit), object)
    index = Index(halves, codes, counts, radii, kept, exact)
    parts = F.ceil(F.element_at(F.lit(_parts(index).tolist()), F.col("cell") + 1))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("label", "q"), parts).cast("int"))
    label = found.schema["label"].dataType.simpleString()

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        ids = table.column("ids").combine_chunks()
        q = _matrix(table.column("q").combine_chunks(), sum(halves)).astype(kept)
        row = {"cell": key[0], "part": key[1], "vectors": q.tobytes(), "labels": table.column("label").to_pylist(), "ids": ids.flatten().to_pylist(), "n_ids": np.diff(ids.offsets.to_numpy()).tolist()}
        return pa.Table.from_pylist([row], pa.schema([("cell", pa.int32()), ("part", pa.int32()), ("vectors", pa.binary()), ("labels", pa.list_(table.schema.field("label").type)), ("ids", pa.list_(pa.int64())), ("n_ids", pa.list_(pa.int32()))]))

    blocks = stage(dealt.groupBy("cell", "part").applyInArrow(packed, f"cell int, part int, vectors binary, labels array<{label}>, ids array<long>, n_ids array<int>"), "blocks")
    discard(rows)
    return index, blocks


def _parts(index: Index) -> np.ndarray:
    """Into how many blocks each cell is cut."""
    return np.maximum(1, -(-index.counts.reshape(-1) // BLOCK))


def walk(index: Index, q: np.ndarray) -> Iterator[tuple[float, int, float]]:
    """Cells that hold rows, by falling sums of half bounds: (that sum, cell, the bound of the cell itself). Sums are
    rounded up, so that no row is above them."""
    one, two = q[: index.halves[0]].astype(np.float64), q[index.halves[0] :].astype(np.float64)
    dots, norms = (index.codes[0] @ one, index.codes[1] @ two), (np.linalg.norm(one), np.linalg.norm(two))
    up = dots[0] + norms[0] * index.radii[0].max(axis=1), dots[1] + norms[1] * index.radii[1].max(axis=0)
    slack = 1e-3 + 1e-9 * (np.abs(up[0]).max() + np.abs(up[1]).max())
    own = dots[0][:, None] + dots[1] + norms[0] * index.radii[0] + norms[1] * index.radii[1] + slack
    first, second = np.argsort(-up[0], kind="stable").tolist(), np.argsort(-up[1], kind="stable").tolist()
    up = up[0].tolist(), up[1].tolist()
    heap = [(-up[0][first[0]] - up[1][second[0]], 0, 0)]
    while heap:
        total, a, b = heapq.heappop(heap)
        i, j = first[a], second[b]
        if b + 1 < len(second):
            heapq.heappush(heap, (-up[0][i] - up[1][second[b + 1]], a, b + 1))
        if b == 0 and a + 1 < len(first):
            heapq.heappush(heap, (-up[0][first[a + 1]] - up[1][j], a + 1, 0))
        if index.counts[i, j]:
            yield -total + slack, i * len(second) + j, float(own[i, j])


def leg(index: Index, q: np.ndarray, least: int, second: bool) -> list[int]:
    """The cells of a query's first or second leg that can hold a score of ``least``. The first leg ends where ``FIRST`` rows
    are seen, whatever their scores, so both legs agree on where it ended."""
    out, seen = [], 0
    for total, cell, own in walk(index, q):
        if total < least:
            break
        if own >= least and (seen >= FIRST) == second:
            out.append(cell)
        seen += int(index.counts.flat[cell])
        if seen >= FIRST and not second:
            break
    return out


def _visits(queries: DataFrame, index: Index, second: bool) -> DataFrame:
    """Queries (qid, label, q, wanted array<struct<p, least>>) to blocks of them, a row for each cell that some of a block
    visit and each part of it."""
    parts = _parts(index)
    label = queries.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), QUERIES):
                part = batch.slice(low, QUERIES)
                q = _matrix(part.column("q"), sum(index.halves))
                wanted, cells = part.column("wanted").to_pylist(), {}
                for i, windows in enumerate(wanted):
                    if windows:
                        for cell in leg(index, q[i], min(w["least"] for w in windows), second):
                            cells.setdefault(cell, []).append(i)
                q = q.astype(index.kept)
                for cell, who in cells.items():
                    own = part.take(pa.array(who))
                    n = int(parts[cell])
                    row = [pa.array([cell] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([q[who].tobytes()] * n, pa.binary())]
                    row += [pa.array([own.column(c).to_pylist()] * n, pa.list_(own.column(c).type)) for c in ("qid", "label", "wanted")]
                    yield pa.RecordBatch.from_arrays(row, names=["cell", "part", "asked", "qid", "q_label", "wanted"])

    schema = f"cell int, part int, asked binary, qid array<long>, q_label array<{label}>, wanted array<array<struct<p: long, least: long>>>"
    return queries.select("qid", "label", "q", "wanted").mapInArrow(run, schema)


def _best(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """The places of the first ``n``: highest scores, then smallest ids."""
    if len(scores) > 8 * n:
        near = np.flatnonzero(scores >= np.partition(scores, -n)[-n])
        return near[np.lexsort((ids[near], -scores[near]))[:n]]
    return np.lexsort((ids, -scores))[:n]


def _scored(queries: DataFrame, index: Index, blocks: DataFrame, second: bool, same: bool, n: int) -> DataFrame:
    """(qid, p, score, id): of each visited block and window the first ``n`` rows of the query's label (``same``), or of other
    labels, that score at most p, and at least what is asked."""
    width = sum(index.halves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], []]
            for row in range(len(batch)):
                get = lambda c: batch.column(c)[row]  # noqa: E731, B023
                x, q = (np.frombuffer(get(c).as_py(), index.kept).reshape(len(get(of)), width).astype(index.exact) for c, of in (("vectors", "labels"), ("asked", "qid")))
                labels, ids, times = get("labels").values.to_numpy(), get("ids").values.to_numpy(), get("n_ids").values.to_numpy()
                place, total = np.repeat(np.arange(len(labels)), times), (q @ x.T).astype(np.int64)
                of = {}
                for k, (qid, label, wanted) in enumerate(zip(get("qid").as_py(), get("q_label").as_py(), get("wanted").as_py())):
                    if label not in of:
                        own = np.flatnonzero((labels[place] == label) == same)
                        of[label] = place[own], ids[own]
                    scores, own = total[k][of[label][0]], of[label][1]
                    for w in wanted:
                        inside = np.flatnonzero((scores <= w["p"]) & (scores >= w["least"]))
                        inside = inside[_best(scores[inside], own[inside], n)]
                        for column, values in zip(out, ([qid] * len(inside), [w["p"]] * len(inside), scores[inside].tolist(), own[inside].tolist())):
                            column += values
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["qid", "p", "score", "id"])

    visits = _visits(queries, index, second)
    return visits.join(blocks, ["cell", "part"]).select("vectors", "labels", "ids", "n_ids", "asked", "qid", "q_label", "wanted").mapInArrow(run, "qid long, p long, score long, id long")


def _first(found: DataFrame, n: int) -> DataFrame:
    """The first ``n`` of each window; tasks cut their own before they are shuffled."""
    order = Window.partitionBy("qid", "p").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _search(queries: DataFrame, index: Index, blocks: DataFrame, same: bool, n: int) -> DataFrame:
    """(qid, p, score, id, rank) of every window of queries (qid, label, q, wanted), by both legs, staged."""
    near = stage(_first(_scored(queries, index, blocks, False, same, n), n), "near")
    # where the first leg has found n rows, none below the last of them is wanted any more
    full = near.where(F.col("rank") == n).select("qid", "p", F.col("score").alias("found"))
    open_ = queries.select("qid", F.explode("wanted").alias("w")).select("qid", "w.p", "w.least").join(full, ["qid", "p"], "left")
    open_ = open_.groupBy("qid").agg(F.collect_list(F.struct("p", F.coalesce(F.greatest("least", "found"), "least").alias("least"))).alias("wanted"))
    far = _scored(queries.drop("wanted").join(open_, "qid"), index, blocks, True, same, n)
    out = stage(_first(near.drop("rank").unionByName(far), n), "found")
    discard(near)
    return out


def hard_negatives(rows: DataFrame, is_anchor: Callable | str = "vec_id % 100 = 0") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from rows (vec_id, label, embedding):
    for each anchor its first five other rows of its label, and for each of these the first five rows of other labels in
    the window below it."""
    all_ = stage(points(rows), "rows")
    # the group limit is applied by each task before rows are shuffled, so a large group of copies is no more than others
    order = Window.partitionBy("label", "q").orderBy("vec_id")
    few = all_.withColumn("r", F.row_number().over(order)).where(F.col("r") <= _IDS)
    found = stage(few.groupBy("label", "q").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "points")
    anchors = all_.where(is_anchor)
    queries = stage(anchors.select("label", "q").distinct().withColumn("qid", F.monotonically_increasing_id()), "queries")
    built = build(found)
    columns = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if built is None:
        return rows.sparkSession.createDataFrame([], columns)
    index, blocks = built
    whole = F.array(F.struct(F.lit((1 << 63) - 1).alias("p"), F.lit(_NONE + 1).alias("least")))
    # neighbours in the first component's order share cells more often
    asked = queries.repartitionByRange("q").sortWithinPartitions("q")
    positives = _search(asked.withColumn("wanted", whole), index, blocks, True, _IDS).select("qid", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    least = F.ceil(F.col("p") * F.lit(LOW).cast("decimal(3)") / HIGH).cast("long")
    windows = positives.where("positive_score >= 0").select("qid", F.col("positive_score").alias("p")).distinct()
    windows = windows.groupBy("qid").agg(F.collect_list(F.struct("p", least.alias("least"))).alias("wanted"))
    negatives = _search(queries.join(windows, "qid"), index, blocks, False, NEGATIVES)
    of = anchors.select(F.col("vec_id").alias("anchor_id"), "label", "q").join(queries, ["label", "q"]).select("anchor_id", "qid")
    mine = of.join(positives, "qid").where("positive_id <> anchor_id")
    place = Window.partitionBy("qid", "anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    mine = mine.withColumn("place", F.row_number().over(place)).where(F.col("place") <= POSITIVES)
    out = mine.join(negatives.select("qid", F.col("p").alias("positive_score"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), "rank"), ["qid", "positive_score"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
