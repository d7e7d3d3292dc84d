"""Token counts under a unigram vocabulary, by dynamic programming over a trie of the distinct words.

A pre-token is a word (a run of non-blanks) behind the vocabulary's word mark. The distinct pre-tokens of a block of
texts are put into a trie, level by level; the forward score of a node (the best sum of piece scores over ways to
spell its prefix) is computed once, from its ancestors, for all nodes of a level together. The number of pieces on the
best way is stored at each word's last node, and a document's count is the sum over its words.

The public vocabulary file lists pieces by rank and has no probabilities, so a piece's score is Zipf's estimate,
-log(rank + 2), in fixed point; equal scores are decided by fewer pieces. A byte that no piece covers costs one token.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.blocks import Block, constants, mixed, spans, text_blocks

MARK = "▁".encode()
SCALE = 1_000_000
#: Longer words are spelled one by one: a trie level for each of their bytes would hold little else.
LONG = 96
TRIE_BYTES = 4 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BYTE = constants(256, 41)
_NONE = np.int64(-(1 << 60))
_TABLE_LOG2 = 18
#: Below the score come the pieces: among equal scores the fewest win.
_TIES = 1 << 20


def pieces_of(path: str) -> dict[bytes, int]:
    """Pieces of a sentencepiece file with their fixed-point scores; bytes without a piece of their own get the score
    of a rank ten vocabularies further down."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {bytes([b]): round(-math.log(10 * model.vocab_size()) * SCALE) for b in range(256)}
    for i in range(model.vocab_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)):
            piece, score = model.id_to_piece(i).encode(), round(-math.log(i + 2) * SCALE)
            out[piece] = max(score, out.get(piece, score))
    return out


class Vocabulary:
    """Pieces by hash, in numpy arrays of a few hundred kilobytes."""

    def __init__(self, pieces: dict[bytes, int]):
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        self.lengths = sorted({len(p) for p in pieces})
        hashes = np.zeros(len(pieces), dtype=np.uint64)
        for i, p in enumerate(pieces):
            h = 0
            for b in p:
                h = (h * int(_BASE) + int(_BYTE[b])) & (1 << 64) - 1
            hashes[i] = h
        hashes = mixed(hashes)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.values = np.array(list(pieces.values()), dtype=np.int64)[order] * _TIES - 1
        self.slot = np.searchsorted(self.hashes >> np.uint64(64 - _TABLE_LOG2), np.arange((1 << _TABLE_LOG2) + 1, dtype=np.uint64)).astype(np.int32)
        self.deepest = int(np.diff(self.slot).max())

    def lookup(self, raw: np.ndarray) -> np.ndarray:
        """Each string's value, or none."""
        hashes = mixed(raw)
        place = (hashes >> np.uint64(64 - _TABLE_LOG2)).astype(np.int64)
        low, high = self.slot[place], self.slot[place + 1]
        out = np.full(len(hashes), _NONE, dtype=np.int64)
        for step in range(self.deepest):
            at = np.flatnonzero(low + step < high)
            there = low[at] + step
            same = self.hashes[there] == hashes[at]
            out[at[same]] = self.values[there[same]]
        return out


def spelled(word: bytes, pieces: dict[bytes, int], longest: int) -> int:
    """Pieces on the best way to spell one pre-token."""
    best: list[tuple[int, int]] = [(0, 0)]
    for end in range(1, len(word) + 1):
        ways = []
        for begin in range(max(0, end - longest), end):
            score = pieces.get(word[begin:end])
            if score is not None:
                ways.append((best[begin][0] + score, best[begin][1] - 1))
        best.append(max(ways))
    return -best[-1][1]


def trie_counts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Token counts of distinct words, given as spans of ``data``; the word mark stands before each."""
    length = ends - starts
    out = np.zeros(len(starts), dtype=np.int64)
    for w in np.flatnonzero(length > LONG):
        out[w] = spelled(MARK + data[starts[w] : ends[w]].tobytes(), vocabulary.pieces, vocabulary.longest)
    words = np.flatnonzero(length <= LONG)
    node = np.zeros(len(words), dtype=np.int64)  # of each word, in the level
    # a level: prefix hash, forward score, pieces, parent in the level above
    levels = [(np.zeros(1, np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64))]
    power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(vocabulary.longest, _BASE))))
    depth = 0
    while len(words):
        if depth < len(MARK):
            byte = np.full(len(words), MARK[depth], dtype=np.int64)
        else:
            byte = data[starts[words] + depth - len(MARK)].astype(np.int64)
        key, node = np.unique(node << 8 | byte, return_inverse=True)
        parent = key >> 8
        hashes = levels[-1][0][parent] * _BASE + _BYTE[key & 255]
        best, count, above = np.full(len(key), _NONE), np.zeros(len(key), np.int64), parent
        for size in range(1, min(depth + 1, vocabulary.longest) + 1):
            level = levels[-size]
            value = vocabulary.lookup(hashes - level[0][above] * power[size])
            value = np.where(value > _NONE, value + level[1][above], _NONE)
            better = value > best
            best[better], count[better] = value[better], level[2][above[better]] + 1
            above = level[3][above]
        levels.append((hashes, best, count, parent))
        if len(levels) > vocabulary.longest + 1:
            levels.pop(0)
        depth += 1
        done = length[words] + len(MARK) == depth
        out[words[done]] = count[node[done]]
        words, node = words[~done], node[~done]
    return out


def block_counts(block: Block, vocabulary: Vocabulary) -> np.ndarray:
    """Tokens of each text of a block."""
    _, first, each = np.unique(block.word_hashes(), return_index=True, return_inverse=True)
    counts = trie_counts(block.data, block.starts[first], block.ends[first], vocabulary)
    return spans(counts[each], block.first) if len(each) else np.zeros(len(block), np.int64)


def _counter(vocabulary: Vocabulary) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in text_blocks(batches, lower=False, limit=TRIE_BYTES):
            tokens = block_counts(block, vocabulary)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(block.n_words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return run


def counted(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) to doc_id, n_words, n_tokens under the vocabulary file ``path``, read by the driver.

    Defined cases: a null or blank text has no words and no tokens; repeated rows are counted one by one; a null
    doc_id stays null; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_counter(Vocabulary(pieces_of(path))), "doc_id long, n_words long, n_tokens long")
