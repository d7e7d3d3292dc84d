"""Benchmark decontamination: a BM25 inverted index of the test items, queried by every training passage.

The items are the indexed documents and the passages are the queries. Each term has a list of postings (item, score as a
share of the item's score against itself), in blocks of ``BLOCK_ITEMS`` items with the largest score of each. A text is
read in cells; a passage is two neighbouring cells, each at least as long as the longest item, so an item that occurs lies
within a passage. Items are indexed by classes of length, each twice as long as the one before, with passages of their
own: an item's passages are less than four times as long as it, whatever other items there are.

As in block-max WAND, the largest scores of a passage's terms are added up, the longest lists first: the terms before the
pivot, at which the sum reaches the threshold, can't retrieve an item alone, so their lists are never entered. The lists
from the pivot on name the blocks that are looked at; of these the ones are skipped whose bound, by the block maxima of all
terms, stays below the threshold. In the others all postings are added up. These steps are taken for arrays of passages at
once, so a task's work is numpy's; what is retrieved is what an exhaustive search finds.

All items at or above the threshold are verified: words of the question and of the answer must stand in the passage in runs
of ``RUN`` words. Words are letters and digits, so marks and blanks may differ.

The index holds a posting for each word of the items (some 3 KB for an item of 40 words), and is sent to the executors in
segments of about ``SEGMENT_ITEMS`` items: one pass over the texts serves that many. Numbers of items, their mean length
and the words' document frequencies are those of all items, so an item has the same score in whatever segment it is.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.blocks import MARKS, Block, blocks_of, constants, mixed, text_blocks

K1, B = 1.2, 0.75
BLOCK_ITEMS = 8
SEGMENT_ITEMS = 100_000
#: Words of the shortest class of items.
SHORTEST = 32
#: A passage retrieves items of which it reaches this share of the score of the item itself.
MIN_SCORE = 0.6
#: Runs of words for verification, and the shares of the question's and the answer's words that must stand in such runs: an
#: edited word takes up to three words of them.
RUN = 3
MIN_OVERLAP, MIN_ANSWER = 0.75, 0.6
#: Entries that are expanded at once.
STEP = 1 << 18
_TABLE_LOG2 = 20
#: Largest scores that are kept as a table of the most frequent terms by block.
_DENSE = 1 << 21
_EPS = 1e-6


def question_and_answer(text: str) -> tuple[str, str]:
    """An item without parts of its own: its last sentence is the answer, what stands before is the question; a single
    sentence is halved at a word."""
    parts = re.split(r"(?<=[.!?])\s+", text.strip())
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    return " ".join(words[: (len(words) + 1) // 2]), " ".join(words[(len(words) + 1) // 2 :])


def ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of some ranges, one range after the other, and the range of each."""
    size = ends - starts
    owner = np.repeat(np.arange(len(size)), size)
    return np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + starts[owner], owner


def steps(cost: np.ndarray, most: int = STEP) -> Iterator[slice]:
    """Cuts a row of costs into slices of about ``most``, each of one at least."""
    total, low = np.cumsum(cost), 0
    while low < len(cost):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + most, side="right")))
        yield slice(low, high)
        low = high


def runs_of(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    factor = constants(size, 2)
    n = max(0, len(hashes) - size + 1)
    return mixed(sum((hashes[j : j + n] * factor[j] for j in range(1, size)), hashes[:n] * factor[0]))


class Part:
    """A question or an answer: its words' hashes, and those of its runs."""

    def __init__(self, hashes: np.ndarray):
        self.n, self.size = len(hashes), max(1, min(RUN, len(hashes)))
        self.runs = runs_of(hashes, self.size)

    def overlap(self, runs: np.ndarray) -> float:
        """The share of its words in runs that are in ``runs`` (sorted); without words 1."""
        if not self.n:
            return 1.0
        if not len(runs):
            return 0.0
        there = np.flatnonzero(runs[np.minimum(np.searchsorted(runs, self.runs), len(runs) - 1)] == self.runs)
        covered = np.zeros(self.n + 1, dtype=np.int64)
        np.add.at(covered, there, 1)
        np.add.at(covered, there + self.size, -1)
        return float((np.cumsum(covered)[: self.n] > 0).mean())


Item = tuple[int, str, str]


class Statistics:
    """Of all items: how many, their words, and how many hold each word (by its hash, sorted). 16 bytes a distinct word."""

    def __init__(self) -> None:
        self.n, self.words = 0, 0
        self.terms, self.df = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, items: list[Item]) -> Statistics:
        items = [x for x in items if (x[1] + x[2]).strip()]
        whole = _block([f"{q} {a}" for _, q, a in items])
        hashes, lengths = whole.word_hashes(), whole.n_words
        self.n, self.words = self.n + len(items), self.words + int(lengths.sum())
        terms, term = np.unique(hashes, return_inverse=True)
        each = np.unique(term * max(1, len(items)) + np.repeat(np.arange(len(items)), lengths)) // max(1, len(items))
        df = np.bincount(each, minlength=len(terms)).astype(np.int64)
        self.terms, place = np.unique(np.concatenate((self.terms, terms)), return_inverse=True)
        self.df = np.bincount(place, np.concatenate((self.df, df)), len(self.terms)).astype(np.int64)
        return self


def by_length(items: list[Item]) -> list[list[Item]]:
    """Items in classes of length, each up to twice as long as the one before."""
    lengths = _block([f"{q} {a}" for _, q, a in items]).n_words
    classes: dict[int, list[Item]] = {}
    for item, n in zip(items, lengths.tolist()):
        classes.setdefault(max(0, (n - 1) // SHORTEST).bit_length(), []).append(item)
    return [classes[k] for k in sorted(classes)]


class Index:
    """Postings and block maxima of some of the items [(item_id, question, answer), ...]; ``of`` are the statistics of all of
    them, ``share`` is the part of the tables' memory that this index may take."""

    def __init__(self, items: list[Item], min_score: float = MIN_SCORE, of: Statistics | None = None, share: int = 1):
        items = [x for x in sorted(items) if (x[1] + x[2]).strip()]
        of = of or Statistics().add(items)
        self.ids = np.array([x[0] for x in items], dtype=np.int64)
        self.min_score = min_score
        whole = _block([f"{q} {a}" for _, q, a in items])
        hashes, lengths = whole.word_hashes(), whole.n_words
        self.longest = int(lengths.max(initial=1))
        self.terms, term = np.unique(hashes, return_inverse=True)
        row = np.repeat(np.arange(len(items)), lengths)
        key, tf = np.unique(term * max(1, len(items)) + row, return_counts=True)
        term, item = key // max(1, len(items)), key % max(1, len(items))
        df = np.bincount(term, minlength=len(self.terms))
        everywhere = of.df[np.searchsorted(of.terms, self.terms)]
        idf = np.log(1 + (of.n - everywhere + 0.5) / (everywhere + 0.5))
        norm = K1 * (1 - B + B * lengths / max(1e-9, of.words / max(1, of.n)))
        score = idf[term] * tf * (K1 + 1) / (tf + norm[item])
        score /= np.maximum(np.bincount(item, score, minlength=len(items)), 1e-9)[item]
        # terms are numbered from the longest list to the shortest
        number = np.empty(len(df), dtype=np.int64)
        number[np.argsort(-df, kind="stable")] = np.arange(len(df))
        self.number = number.astype(np.int32)
        order = np.argsort(number[term] * max(1, len(items)) + item, kind="stable")
        self.posting_term, self.posting_item, self.posting_score = number[term][order], item[order], score[order]
        self.posting_key = self.posting_term * max(1, len(items)) + self.posting_item
        self.blocks = -(-len(items) // BLOCK_ITEMS) or 1
        at = self.posting_term * self.blocks + self.posting_item // BLOCK_ITEMS
        self.block_key, first = np.unique(at, return_index=True)
        self.block_max = np.maximum.reduceat(self.posting_score, first) if len(first) else np.zeros(0)
        self.block_of = self.block_key % self.blocks
        self.lists = np.searchsorted(self.block_key, np.arange(len(df) + 1) * self.blocks)
        self.max = np.zeros(len(df))
        np.maximum.at(self.max, self.posting_term, self.posting_score)
        self.dense = min(len(df), _DENSE // share // self.blocks)
        self.table = np.zeros((self.dense, self.blocks), dtype=np.float32)
        top = self.block_key < self.dense * self.blocks
        self.table.ravel()[self.block_key[top]] = self.block_max[top]
        # place of a term by the high bits of its hash; terms that share a place follow each other
        self.table_log2 = min(_TABLE_LOG2, len(self.terms).bit_length() + 3)
        self.slot = np.searchsorted(self.terms >> np.uint64(64 - self.table_log2), np.arange((1 << self.table_log2) + 1, dtype=np.uint64)).astype(np.int32)
        self.deepest = int(np.diff(self.slot).max(initial=0))
        sides = [_block([x[k] for x in items]) for k in (1, 2)]
        words = [x.word_hashes() for x in sides]
        self.parts = [[Part(w[x.first[i] : x.first[i + 1]]) for x, w in zip(sides, words)] for i in range(len(items))]

    def term_of(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word's term, or -1."""
        place = (hashes >> np.uint64(64 - self.table_log2)).astype(np.int64)
        low, high = self.slot[place], self.slot[place + 1]
        out = np.full(len(hashes), -1, dtype=np.int32)
        for step in range(self.deepest):
            at = np.flatnonzero(low + step < high)
            there = low[at] + step
            same = self.terms[there] == hashes[at]
            out[at[same]] = self.number[there[same]]
        return out

    def bounds(self, term: np.ndarray, block: np.ndarray) -> np.ndarray:
        """The largest score of each term in each block."""
        out, sparse = np.zeros(len(term)), term >= self.dense
        out[~sparse] = self.table[term[~sparse], block[~sparse]]
        key = term[sparse] * self.blocks + block[sparse]
        at = np.minimum(np.searchsorted(self.block_key, key), len(self.block_key) - 1)
        out[sparse] = np.where(self.block_key[at] == key, self.block_max[at], 0)
        return out

    def retrieve(self, first: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) at or above the threshold, for passages whose distinct terms, in the order of their
        numbers, stand in ``term`` from ``first[p]`` to before ``first[p + 1]``."""
        least = self.min_score - _EPS
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        top = np.concatenate(([0.0], np.cumsum(self.max[term])))
        sums = top[1:] - top[first[:-1]][owner]
        entered = sums >= least  # from the pivot on
        pivot = first[:-1] + np.bincount(owner[~entered], minlength=len(first) - 1)
        before = top[pivot] - top[first[:-1]]
        found = []
        at = np.flatnonzero(entered)
        low, high = self.lists[term[at]], self.lists[term[at] + 1]
        # passages are cut where the lists to enter are many
        cost = np.bincount(owner[at], high - low, minlength=len(first) - 1)
        edge = np.searchsorted(owner[at], np.arange(len(first)))
        for some in steps(cost):
            mine = slice(edge[some.start], edge[some.stop])
            posting, which = ranges(low[mine], high[mine])
            key, back = np.unique(owner[at[mine]][which] * self.blocks + self.block_of[posting], return_inverse=True)
            bound = np.bincount(back, self.block_max[posting], minlength=len(key)) if len(key) else np.zeros(0)
            passage, block = key // self.blocks, key % self.blocks
            fine = np.flatnonzero(bound + before[passage] >= least)
            passage, block, bound = passage[fine], block[fine], bound[fine]
            for part in steps(pivot[passage] - first[passage] + 1):
                p, b = passage[part], block[part]
                entry, which = ranges(first[p], pivot[p])
                full = bound[part] + np.bincount(which, self.bounds(term[entry].astype(np.int64), b[which]), minlength=len(p))
                fine = np.flatnonzero(full >= least)
                p, b = p[fine], b[fine]
                entry, which = ranges(first[p], first[p + 1])
                key = term[entry].astype(np.int64) * len(self.ids) + b[which] * BLOCK_ITEMS
                posting, cell = ranges(np.searchsorted(self.posting_key, key), np.searchsorted(self.posting_key, np.minimum(key + BLOCK_ITEMS, (term[entry].astype(np.int64) + 1) * len(self.ids))))
                place = which[cell] * BLOCK_ITEMS + self.posting_item[posting] % BLOCK_ITEMS
                score = np.bincount(place, self.posting_score[posting], minlength=len(p) * BLOCK_ITEMS)
                fine = np.flatnonzero(score >= least)
                found.append((p[fine // BLOCK_ITEMS], b[fine // BLOCK_ITEMS] * BLOCK_ITEMS + fine % BLOCK_ITEMS, score[fine]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def hits(self, block: Block, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, word behind the last, item, score) of all passages of a block of texts, for items at or
        above the threshold."""
        term = self.term_of(block.word_hashes() if hashes is None else hashes)
        first = block.first
        doc = np.repeat(np.arange(len(block)), block.n_words)
        cells = np.maximum(1, -(-block.n_words // self.longest))
        base = np.concatenate(([0], np.cumsum(cells)))
        known = np.flatnonzero(term >= 0)
        cell = base[doc[known]] + (known - first[doc[known]]) // self.longest
        # a term counts once in a cell
        key = np.unique(cell << 32 | term[known])
        cell, term = key >> 32, (key & 0xFFFFFFFF).astype(np.int64)
        edge = np.searchsorted(cell, np.arange(base[-1] + 1))
        owner = np.repeat(np.arange(len(block)), cells)
        # a passage: a cell and the next one of the same text, or the last cell of a text alone, if it has no other
        second = np.zeros(len(owner), dtype=bool)
        second[:-1] = owner[1:] == owner[:-1]
        alone = cells[owner] == 1
        total = np.concatenate(([0.0], np.cumsum(self.max[term])))
        end = edge[np.arange(len(owner)) + 1 + second]
        able = np.flatnonzero((second | alone) & (total[end] - total[edge[:-1]] >= self.min_score - _EPS))
        out = []
        for some in steps(end[able] - edge[able]):
            p = able[some]
            entry, which = ranges(edge[p], end[p])
            key = np.unique(which << 32 | term[entry])
            found, item, score = self.retrieve(np.searchsorted(key >> 32, np.arange(len(p) + 1)), (key & 0xFFFFFFFF).astype(np.int64))
            q = p[found]
            d = owner[q]
            low = first[d] + (q - base[d]) * self.longest
            out.append((d, low, np.minimum(low + 2 * self.longest, first[d + 1]), item, score))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0),)


def _block(texts: list[str]) -> Block:
    return next((b for _, _, b in blocks_of(pa.array(texts, pa.string()), limit=1 << 40, blanks=MARKS)), Block(np.zeros(0, np.uint8), np.zeros(1, np.int64), True))


def _search(indexes: list[Index]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in text_blocks(batches, blanks=MARKS):
            hashes = block.word_hashes()
            best: dict[tuple[int, int], tuple[float, float, float]] = {}
            for index in indexes:
                last, runs = None, {}
                for doc, low, high, item, score in zip(*(x.tolist() for x in index.hits(block, hashes))):
                    if last != low:
                        last, runs = low, {}
                    told = []
                    for part in index.parts[item]:
                        if part.size not in runs:
                            runs[part.size] = np.unique(runs_of(hashes[low:high], part.size))
                        told.append(part.overlap(runs[part.size]))
                    # of a text's passages the one that holds most of the item, then the one that scores best
                    here, key = (min(told), score, *told), (doc, int(index.ids[item]))
                    best[key] = max(here, best.get(key, here))
            ids = batch.column("doc_id")
            out = [(ids[doc].as_py(), item, score, q, a) for (doc, item), (_, score, q, a) in sorted(best.items())]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return run


def retrieved(docs: DataFrame, items: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """All (document, item) at or above the threshold, with the overlaps of question and answer.

    ``items`` has item_id and either question and answer, or text. Defined cases: null or blank texts and items match
    nothing; repeated documents and items match one by one (an item that occurs twice is reported once per id and
    document, for the passage that holds most of it); items of equal score are all reported; a text of any length is read
    whole, passage by passage; other columns are passed over; an empty table of either kind gives no rows.
    """
    if not {"question", "answer"} <= set(items.columns):
        items = items.select("item_id", F.col("text").alias("question"), F.lit(None).cast("string").alias("answer"))
    items = items.where("item_id is not null").groupBy("item_id").agg(F.lower(F.min("question")).alias("question"), F.lower(F.min("answer")).alias("answer"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"))
    out = docs.limit(0).select("doc_id", F.lit(0).cast("long").alias("item_id"), *(F.lit(0.0).alias(c) for c in ("score", "question_overlap", "answer_overlap")))
    segments = -(-items.count() // SEGMENT_ITEMS)

    def segment(k: int) -> list[Item]:
        # bounded: a segment has about SEGMENT_ITEMS items
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(segments)) == k) if segments > 1 else items
        return [(r.item_id, *(question_and_answer(r.question or "") if r.answer is None else (r.question or "", r.answer))) for r in part.collect()]

    of, first = Statistics(), segment(0) if segments else []
    for k in range(segments):
        of.add(segment(k) if k else first)
    for k in range(segments):
        classes = by_length(segment(k) if k else first)
        indexes = [x for x in (Index(c, min_score, of, len(classes)) for c in classes) if len(x.ids)]
        if indexes:
            out = out.unionByName(docs.mapInArrow(_search(indexes), "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"))
    return out


def contaminated(docs: DataFrame, items: DataFrame, min_score: float = MIN_SCORE, min_overlap: float = MIN_OVERLAP, min_answer: float = MIN_ANSWER) -> DataFrame:
    """The verified matches of ``retrieved``."""
    return retrieved(docs, items, min_score).where((F.col("question_overlap") >= min_overlap) & (F.col("answer_overlap") >= min_answer))
