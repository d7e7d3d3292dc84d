"""Whole texts as numpy arrays, a block of documents at a time.

A task walks through its Arrow batches in blocks of about ``BLOCK_BYTES`` of UTF-8, so memory is bounded by the block
size or by one text, whichever is larger. Words are runs of bytes outside space and \\t\\n\\v\\f\\r, or
outside another given set of bytes. Hashes are 64-bit
polynomials over random byte values, so that all words of a block are hashed by a few array operations.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
#: Rows of a batch that are converted together.
SLICE_ROWS = 1_024
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Blanks, and everything else in ASCII that is no letter or digit.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit over the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    step = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE)
    return mixed(step + np.uint64(seed * 0x632BE59BD9B4E019 & (1 << 64) - 1))


_BYTE = constants(256, 1)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2^64."""
    if len(_powers.get("up", ())) <= n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(n + 1, base, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p)
    return _powers["up"], _powers["down"]


class Block:
    """Some documents: ``data`` their bytes, ``offsets`` where each starts, ``starts``/``ends`` of each word,
    ``first`` the index of each document's first word (and the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, blanks: np.ndarray = BLANK):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        blank = blanks[data]
        begin, last = ~blank, ~blank
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        edge = np.zeros(len(data), dtype=bool)
        edge[inner] = True
        if len(data):
            begin[1:] &= blank[:-1] | edge[1:]
            last[:-1] &= blank[1:] | edge[1:]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def word_hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same wherever the word stands."""
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        up, down = _power(len(self.data))
        total = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[self.data] * up[: len(self.data)], out=total[1:])
        return mixed((total[self.ends] - total[self.starts]) * down[self.starts])

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``size`` words that stay within a document, and where each document's begin. A
        shorter document with words has one: its whole sequence."""
        words, n, factor = self.word_hashes(), self.n_words, constants(size, 2)
        count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
        at = np.concatenate(([0], np.cumsum(count)))
        out = np.zeros(at[-1], dtype=np.uint64)
        if len(out):
            row = np.repeat(np.arange(len(n)), count)
            begin = self.first[row] + np.arange(len(out)) - at[row]
            length = np.minimum(n[row], size)
            padded = np.concatenate((words, np.zeros(size, dtype=np.uint64)))
            for j in range(size):
                out += np.where(j < length, padded[begin + j] * factor[j], np.uint64(0))
            out = mixed(out + length.astype(np.uint64))
        return out, at


def blocks_of(texts: pa.Array, lower: bool = True, limit: int = BLOCK_BYTES, blanks: np.ndarray = BLANK) -> Iterator[tuple[int, int, Block]]:
    """Cuts a string column into blocks: (first row, end row, block). A null text is an empty one."""
    # a batch may be much larger than a block: it is converted a part at a time
    rows = SLICE_ROWS if limit <= BLOCK_BYTES else max(1, len(texts))
    for begin in range(0, len(texts), rows):
        large = pc.fill_null(texts.slice(begin, rows).cast(pa.large_string()), "")
        _, where, bytes_ = large.buffers()
        offsets = np.frombuffer(where, dtype=np.int64)[large.offset : large.offset + len(large) + 1]
        data = np.frombuffer(bytes_, dtype=np.uint8) if bytes_ is not None else np.zeros(0, dtype=np.uint8)
        low = 0
        while low < len(large):
            high = int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1
            high = min(max(high, low + 1), len(large))
            yield begin + low, begin + high, Block(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], lower, blanks)
            low = high


def text_blocks(batches: Iterable[pa.RecordBatch], lower: bool = True, blanks: np.ndarray = BLANK, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, Block]]:
    """The blocks of the column ``text``, each with the slice of the batch that it covers."""
    for batch in batches:
        for low, high, block in blocks_of(batch.column("text"), lower, limit, blanks):
            yield batch.slice(low, high - low), block
        # what the batch took goes back to the system: the worker lives on, and so does the executor's limit
        pa.default_memory_pool().release_unused()


def spans(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive positions of ``at``; empty spans are 0."""
    total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[at])
