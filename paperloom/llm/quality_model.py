"""A supervised classifier of averaged subword embeddings.

A text is the average of learned vectors: one per word and one per run of ``GRAM`` bytes, each found by hash in a
table of ``BUCKETS`` rows; a softmax over the average gives the classes. Features are counted on the executors over
whole texts. The model is fitted by plain stochastic gradient descent in numpy on a bounded sample of labelled rows
(``SAMPLE``, those whose hash is smallest); every text is then scored where it lies, with the table's product with
the output layer, one number per feature.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.blocks import Block, constants, mixed, spans, text_blocks
from paperloom.plans.staging import discard, stage

BUCKETS_LOG2 = 16
DIM = 12
GRAM = 3
#: Distances at which a word is compared with an earlier one.
PAIRS = 3
EPOCHS = 12
RATE = 0.5
#: Labelled rows that the model is fitted on, at most, and the bytes of their counted features.
SAMPLE, SAMPLE_BYTES = 3000, 192 << 20

_CODE = constants(1, 21)[0]
_PAIR = (constants(PAIRS + 1, 22) >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64)


def features(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words, of their repeats and of the byte runs of a block, and where each text's begin."""
    hashes, first = block.word_hashes(), block.first
    words = (hashes >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64)
    # pairs of equal words share a vector for each distance, whichever the word is; other pairs share one too
    row = np.repeat(np.arange(len(block)), block.n_words)
    pairs = []
    for apart in range(1, PAIRS + 1):
        equal = np.zeros(len(words), dtype=bool)
        equal[apart:] = (hashes[apart:] == hashes[:-apart]) & (row[apart:] == row[:-apart])
        pairs.append(np.where(equal, _PAIR[apart - 1], _PAIR[PAIRS]))
    words = np.stack([words, *pairs], axis=1).ravel()
    data = block.data.astype(np.uint64)
    code = np.zeros(len(data), dtype=np.uint64)
    for j in range(GRAM):
        code[: len(data) - j] = code[: len(data) - j] * np.uint64(257) + data[j:] + np.uint64(1)
    grams = (mixed(code ^ _CODE) >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64)
    # a run that would reach into the next text belongs to none
    size = np.diff(block.offsets)
    inside = np.repeat(block.offsets[1:], size) - np.arange(len(data)) >= GRAM
    return words, first * (PAIRS + 1), grams[inside], np.concatenate(([0], np.cumsum(np.maximum(size - GRAM + 1, 0))))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct features of each text, and how often each stands there."""
    for batch, block in text_blocks(batches, lower=False):
        words, w, grams, g = features(block)
        ids, counts = [], []
        for i in range(len(block)):
            a, b = np.unique(np.concatenate((words[w[i] : w[i + 1]], grams[g[i] : g[i + 1]])), return_counts=True)
            ids.append(a.astype(np.int32).tobytes())
            counts.append(b.astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("label", "h", "t")), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], ["label", "h", "t", "ids", "counts"])


class Model:
    """Embeddings (buckets x dim) and an output layer (dim x 2)."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.table = rng.uniform(-1 / DIM, 1 / DIM, (1 << BUCKETS_LOG2, DIM)).astype(np.float32)
        self.out = np.zeros((DIM, 2), dtype=np.float32)
        self.bias = np.zeros(2, dtype=np.float32)

    def fit(self, rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 0) -> Model:
        rng = np.random.default_rng(seed)
        n = np.bincount([r[0] for r in rows], minlength=2).astype(np.float32)
        self.bias += np.log((n + 1) / (n.sum() + 2))  # an empty text gets the classes' shares
        steps = epochs * len(rows)
        for step in range(steps):
            if step % len(rows) == 0:
                order = rng.permutation(len(rows))
            label, ids, counts = rows[order[step % len(rows)]]
            share = counts / max(1.0, counts.sum())
            mean = share @ self.table[ids]
            p = mean @ self.out + self.bias
            p = np.exp(p - p.max())
            p /= p.sum()
            p[label] -= 1
            p *= rate * (1 - step / steps)
            back = self.out @ p
            self.out -= np.outer(mean, p)
            self.bias -= 0.01 * p
            self.table[ids] -= share[:, None] * (back * 20)  # an average of many features moves each a little only
        return self

    def weights(self) -> tuple[np.ndarray, float]:
        """For the odds of class 1: a number for each feature, and the constant."""
        return (self.table @ (self.out[:, 1] - self.out[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from ``labels`` (doc_id, label 0 or 1) and the texts of ``docs``; without any labels, one that says 0.5.

    It is fitted on the ``sample`` labelled ids of the smallest hashes (of equal ones the smaller ids), and of their texts
    on the first in the order of these hashes, up to ``sample`` texts and ``sample_bytes`` of features. An id with
    several labels has the smallest; equal texts of an id count once."""
    chosen = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # bounded by the sample
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "text", F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t"))
    counted = stage(texts.mapInArrow(_counts, "label int, h long, t long, ids binary, counts binary"), "sample")
    sizes = counted.groupBy("h", "t").agg(F.max(F.octet_length("ids") + F.octet_length("counts")).alias("bytes")).orderBy("h", "t").limit(sample).collect()
    n = int(np.searchsorted(np.cumsum([r.bytes for r in sizes]), sample_bytes, side="right"))
    if not n:
        return Model()
    rows = counted.where((F.col("h") < sizes[n - 1].h) | ((F.col("h") == sizes[n - 1].h) & (F.col("t") <= sizes[n - 1].t))).dropDuplicates(["h", "t"]).collect()
    discard(counted)
    rows = sorted((r.label, bytes(r.ids), bytes(r.counts)) for r in rows)
    return Model().fit([(a, np.frombuffer(b, np.int32), np.frombuffer(c, np.float32)) for a, b, c in rows])


def _scorer(model: Model) -> Callable:
    weight, bias = model.weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in text_blocks(batches, lower=False):
            words, w, grams, g = features(block)
            total = spans(weight[words].astype(np.float64), w) + spans(weight[grams].astype(np.float64), g)
            odds = total / np.maximum(1, np.diff(w) + np.diff(g)) + bias
            score = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    return run


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) to (doc_id, score): the probability of class 1.

    Defined cases: a null or empty text has no features and gets the model's constant; repeated rows are scored one by
    one; a null doc_id stays null; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_scorer(model), "doc_id long, score double")
