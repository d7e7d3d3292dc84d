"""Language identification by fusing evidence with Bayes' rule.

* The text: smoothed log-likelihoods of its byte trigrams under one model per language, tempered so that a long text
  counts as ``MAX_GRAMS`` trigrams at most (neighbouring trigrams are not independent). The models are fitted on a
  bounded sample of rows with a declared language.
* None of the languages: beside them stands ``OTHER``, which scores each trigram alike, at the floor of the language that
  is nearest to the text. A language's floor is what all but ``FLOOR_SHARE`` of its own sample reach; there each text is
  scored by the model without that text.
* The declared (markup) language: names the true language with probability ``DECLARED_RIGHT``; a language that
  is not among them speaks for ``OTHER``.
* The place: how often each language occurs at the host, smoothed towards its address suffix and that towards all
  documents. These are sums of the texts' own posteriors, gathered by grouped aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.blocks import BLANK, Block, constants, mixed, spans, text_blocks
from paperloom.plans.staging import stage

LANGUAGES = ("de", "en", "es", "fr")
#: Rows per language, at most, that its trigram model is fitted on.
SAMPLE = 1000
BUCKETS_LOG2 = 16
MAX_GRAMS = 60
DECLARED_RIGHT = 0.9
#: Documents that a host's, and a suffix's, own counts must reach to weigh as much as what stands above them.
HOST_STRENGTH, SUFFIX_STRENGTH = 10.0, 50.0
MIN_CONFIDENCE = 0.5
OTHER = "other"
FLOOR_SHARE = 0.005
#: Room below the sample's floor, in nats per trigram.
FLOOR_ROOM = 1.0
#: Longer codes of the languages that have shorter ones, and codes that name none.
SAME = {"deu": "de", "ger": "de", "eng": "en", "spa": "es", "fra": "fr", "fre": "fr"}
NO_LANGUAGE = ("und", "mul", "mis", "zxx")

SMOOTH = 0.05
_CODE = constants(1, 31)[0]


def weighed(n: np.ndarray) -> np.ndarray:
    """How many trigrams a text of ``n`` counts as."""
    return n / (1 + n / MAX_GRAMS)


def trigrams(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of each text that hold a letter and no digit or mark, and where each text's begin."""
    data = block.data
    odd, blank = _ODD[data], BLANK[data]
    code = np.zeros(len(data), dtype=np.uint64)
    fine = ~odd
    for j in range(3):
        code[: len(data) - j] = code[: len(data) - j] * np.uint64(257) + data[j:] + np.uint64(1)
        fine[: max(0, len(data) - j)] &= ~odd[j:]
    size = np.diff(block.offsets)
    if len(data) > 2:
        fine[:-2] &= ~(blank[:-2] & blank[1:-1] & blank[2:])
    fine &= np.repeat(block.offsets[1:], size) - np.arange(len(data)) >= 3
    at = np.concatenate(([0], np.cumsum(fine)))[block.offsets]
    return (mixed(code[fine] ^ _CODE) >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64), at


#: Bytes of ASCII that are neither letters nor blanks.
_ODD = np.array([b < 128 and not chr(b).isalpha() and chr(b) not in " \t\n\x0b\f\r" for b in range(256)])


def _gram_counts(languages: tuple[str, ...]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), 1 << BUCKETS_LOG2), dtype=np.int64)
        for batch, block in text_blocks(batches):
            code, at = trigrams(block)
            row = np.repeat([languages.index(x) for x in batch.column("declared").to_pylist()], np.diff(at))
            total += np.bincount((row << BUCKETS_LOG2) + code, minlength=total.size).reshape(total.shape)
        k, code = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(code.astype(np.int32)), pa.array(total[k, code])], ["k", "code", "n"])

    return run


def _own_means(total: np.ndarray, languages: tuple[str, ...]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = total.sum(axis=1)
        for batch, block in text_blocks(batches):
            code, at = trigrams(block)
            which, n, mean = [languages.index(x) for x in batch.column("declared").to_pylist()], np.diff(at), np.zeros(len(block))
            for i in np.flatnonzero(n):
                own, count = np.unique(code[at[i] : at[i + 1]], return_counts=True)
                # the model without this text
                left = total[which[i], own] - count + SMOOTH
                mean[i] = (np.log(left / (size[which[i]] - n[i] + SMOOTH * total.shape[1])) * count).sum() / n[i]
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(n, pa.int64()), pa.array(mean)], ["k", "n", "mean"])

    return run


def fitted(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities (bucket x language) of trigrams, and each language's floor, from at most ``sample`` rows of ``docs`` (doc_id, text,
    declared) per language: those whose hash is smallest."""
    ids = None
    for name in languages:
        some = docs.where((F.col("declared") == name) & F.col("doc_id").isNotNull()).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        ids = some if ids is None else ids.unionByName(some)
    # bounded: sample ids per language; the sums have a row per language and bucket at most
    chosen = docs.where(F.col("declared").isin(*languages)).join(F.broadcast(ids.distinct()), "doc_id", "left_semi")
    rows = chosen.select("text", "declared").mapInArrow(_gram_counts(languages), "k int, code int, n long").groupBy("k", "code").agg(F.sum("n").alias("n")).collect()
    total = np.zeros((len(languages), 1 << BUCKETS_LOG2))
    for r in rows:
        total[r.k, r.code] = r.n
    smooth = total + SMOOTH
    table = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32).copy()
    own = chosen.select("text", "declared").mapInArrow(_own_means(total, languages), "k int, n long, mean double").where("n > 0")
    credit = math.log(DECLARED_RIGHT * len(languages) / (1 - DECLARED_RIGHT))
    lowest = own.groupBy("k").agg(F.percentile(F.col("mean") + credit * (1 + F.col("n") / MAX_GRAMS) / F.col("n"), F.lit(FLOOR_SHARE)).alias("floor"))
    # without a sample a model knows nothing: no text is nearer to it than to OTHER
    floor = np.full(len(languages), -math.log(1 << BUCKETS_LOG2) + 1)
    for r in lowest.collect():  # a row per language
        floor[r.k] = r.floor - FLOOR_ROOM
    return table, floor


def _likelihoods(table: np.ndarray, floor: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in text_blocks(batches):
            code, at = trigrams(block)
            n = np.diff(at)
            mean = np.stack([spans(table[code, k].astype(np.float64), at) for k in range(table.shape[1])], axis=1) / np.maximum(n, 1)[:, None]
            mean = np.column_stack((mean, floor[mean.argmax(axis=1)]))
            log = mean * weighed(n)[:, None]
            log -= log.max(axis=1, keepdims=True)
            flat = pa.array(log.ravel(), pa.float64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * mean.shape[1], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "declared", "host", "suffix")), pa.array(n, pa.int64()), lists], ["doc_id", "declared", "host", "suffix", "n_grams", "log"])

    return run


def identified(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES, keep: tuple[str, ...] | None = None, sample: int = SAMPLE) -> DataFrame:
    """``docs`` (doc_id, text, declared, host, suffix) to doc_id, n_grams, language (or ``OTHER``), confidence, kept.

    A document is kept if its text has letters, its language is one of ``keep`` (default: all but ``OTHER``) and its
    posterior is at least ``MIN_CONFIDENCE``. Defined cases: a null or empty text, or one without letters, has language
    null and confidence 0 and is rejected; a null declared language, or one that is no code of two or three letters
    (before a region), and a null host or suffix are no evidence (a null host is smoothed like any other host: it is one
    group); repeated rows are judged one by one; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.lower(F.col(c).cast("string")).alias(c) for c in ("declared", "host", "suffix")))
    code = F.regexp_extract(F.trim("declared"), r"^([a-z]{2,3})(?:$|[-_])", 1)
    code = F.coalesce(F.create_map(*(F.lit(x) for pair in SAME.items() for x in pair))[code], code)
    docs = docs.withColumn("declared", F.when((code != "") & ~code.isin(*NO_LANGUAGE), code)).withColumn("text", F.when(F.col("text").rlike(r"\p{L}"), F.col("text")))
    table, floor = fitted(docs, languages, sample)
    scored = stage(docs.mapInArrow(_likelihoods(table, floor), "doc_id long, declared string, host string, suffix string, n_grams long, log array<double>"), "likelihoods")
    names = (*languages, OTHER)
    k = range(len(names))
    weight = [F.exp(F.col("log")[i]) for i in k]
    whole = sum(weight[1:], weight[0])
    soft = [F.sum(F.when(F.col("n_grams") > 0, weight[i] / whole).otherwise(0.0)).alias(f"h{i}") for i in k]
    hosts = scored.groupBy("host", "suffix").agg(*soft)
    suffixes = hosts.groupBy("suffix").agg(*(F.sum(f"h{i}").alias(f"s{i}") for i in k)).withColumnRenamed("suffix", "s_suffix")
    # one row
    overall = suffixes.agg(*(F.sum(f"s{i}").alias(f"a{i}") for i in k))
    hosts = hosts.join(suffixes, F.col("suffix").eqNullSafe(F.col("s_suffix"))).join(F.broadcast(overall), F.lit(True))

    def over(*names: str) -> object:
        return sum((F.col(n) for n in names[1:]), F.col(names[0]))

    top = [(F.col(f"a{i}") + 1) / (over(*(f"a{j}" for j in k)) + len(names)) for i in k]
    mid = [(F.col(f"s{i}") + SUFFIX_STRENGTH * top[i]) / (over(*(f"s{j}" for j in k)) + SUFFIX_STRENGTH) for i in k]
    low = [(F.col(f"h{i}") + HOST_STRENGTH * mid[i]) / (over(*(f"h{j}" for j in k)) + HOST_STRENGTH) for i in k]
    hosts = hosts.select(F.col("host").alias("p_host"), F.col("suffix").alias("p_suffix"), F.array(*(F.log(x) for x in low)).alias("prior"))
    # small, or a shuffled side whose hot keys adaptive execution splits
    out = scored.join(hosts, F.col("host").eqNullSafe(F.col("p_host")) & F.col("suffix").eqNullSafe(F.col("p_suffix")))
    said = F.when(F.col("declared").isin(*languages), F.col("declared")).when(F.col("declared").isNotNull(), OTHER)
    right, wrong = math.log(DECLARED_RIGHT), math.log((1 - DECLARED_RIGHT) / len(languages))
    log = [F.col("log")[i] + F.col("prior")[i] + F.when(said == names[i], right).when(said.isNotNull(), wrong).otherwise(0.0) for i in k]
    best = F.array_max(F.array(*(F.struct(log[i].alias("log"), F.lit(names[i]).alias("name")) for i in k)))
    out = out.withColumn("best", best).withColumn("all", sum((F.exp(x - F.col("best.log")) for x in log[1:]), F.exp(log[0] - F.col("best.log"))))
    has = F.col("n_grams") > 0
    out = out.select("doc_id", "n_grams", F.when(has, F.col("best.name")).alias("language"), F.when(has, 1 / F.col("all")).otherwise(0.0).alias("confidence"))
    return out.withColumn("kept", F.coalesce((F.col("confidence") >= MIN_CONFIDENCE) & F.col("language").isin(*(keep or languages)), F.lit(False)))
