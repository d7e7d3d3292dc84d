"""Alignment of two tokenizers' tokens over the same bytes.

Tokenizer A (byte-level BPE, a tokenizers file) spells a blank and the text, tokenizer B (a sentencepiece file) the text, before which
it puts a blank itself; special tokens' strings are plain text. The cumulative byte ends of each become a dictionary
from end to index, as an array in which an end is its own hash; the ends that both dictionaries have, sorted, slice both
lists of ids into groups, and the last tokens of a group's slices, whose ranges end together, are linked. All texts of a
block are laid end to end, so that few array operations do it.

Tokens that end together are one the end of the other, so the two vocabularies bound the number of different linked pairs
(``Tokenizers.bound``, 324,297 for the public files): tables of pair counts are small at any size of the corpus, and are
sent to all tasks. Texts are spelled once; a document's distinct pairs are staged with it until the counts are known.

Defined cases: texts that are null, empty, or whose tokens' bytes are not the blank and the text (as where B rewrites
characters) have no tokens; rows are aligned one by one, so repeated rows and ids count as often as they are there; an
empty table gives no rows; further columns are not looked at. A very long text is handled whole, at some 400 bytes of
memory per byte of text.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.blocks import BLOCK_BYTES
from paperloom.plans.staging import stage

#: Fixed value: how byte-level BPE of this kind cuts texts before it merges bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_GROUPS = ""


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write visible Latin-1 characters as they are, and the other bytes, in order, from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pieces:
    """A vocabulary's bytes, one piece after the other."""

    def __init__(self, pieces: list[bytes]):
        self.size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.begin, self.data = self.size.cumsum() - self.size, np.frombuffer(b"".join(pieces), np.uint8)


class Tokens(NamedTuple):
    """Tokens of a block of texts: ``ids``, ``first`` token of each text (and the end)."""

    pieces: Pieces
    ids: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, pieces: Pieces, texts: list[list[int]]) -> Tokens:
        first = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
        return cls(pieces, np.fromiter(chain.from_iterable(texts), np.int64, int(first[-1])), first)

    @property
    def ends(self) -> np.ndarray:
        return self.pieces.size[self.ids].cumsum()

    def bytes_each(self) -> np.ndarray:
        return np.diff(np.concatenate(([0], self.ends))[self.first])

    def spelled(self) -> np.ndarray:
        """The bytes of all tokens."""
        size = self.pieces.size[self.ids]
        at = np.repeat(self.pieces.begin[self.ids] - (size.cumsum() - size), size)
        return self.pieces.data[at + np.arange(len(at))]

    def only(self, kept: np.ndarray) -> Tokens:
        """The tokens of some of the texts."""
        n = np.diff(self.first)
        return Tokens(self.pieces, self.ids[np.repeat(kept, n)], np.concatenate(([0], n[kept].cumsum())))

    def spread(self, places: np.ndarray, n: int) -> Tokens:
        """The same texts at their places among ``n``; the others have no tokens."""
        each = np.zeros(n, np.int64)
        each[places] = np.diff(self.first)
        return Tokens(self.pieces, self.ids, np.concatenate(([0], each.cumsum())))


class Tokenizers:
    """Both tokenizers, and the bytes of their tokens by id."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        self._paths = a_path, b_path
        byte, special = _byte_of(), {t["content"] for t in spec["added_tokens"]}
        vocabulary = {bytes(byte[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
        # ids are in the order of merges, so they serve as ranks; this encoder needs a quarter of the time for the same ids
        self._a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=vocabulary, special_tokens={})
        self._b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.a_bytes[i] = piece
        self.b_bytes = [self._piece(i) for i in range(self._b.vocab_size())]
        self.a, self.b = Pieces(self.a_bytes), Pieces(self.b_bytes)
        names = [str(i)[::-1] for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        #: decimal digits of each id, the last first, and how many there are
        self._digits = np.array([list(n.ljust(len(names[-1])).encode()) for n in names], np.uint8), np.array(list(map(len, names)))

    def __reduce__(self) -> tuple:
        return Tokenizers, self._paths

    def _piece(self, i: int) -> bytes:
        piece = self._b.id_to_piece(i)
        if self._b.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return b"" if self._b.is_control(i) or self._b.is_unknown(i) else piece.replace("▁", " ").encode()

    @property
    def bound(self) -> int:
        """How many pairs of ids can end together at most: one's bytes are the end of the other's."""
        a, b = Counter(filter(None, self.a_bytes)), Counter(filter(None, self.b_bytes))
        within = lambda one, other, first: sum(n * other[x[i:]] for x, n in one.items() for i in range(first, len(x)))
        return within(a, b, 0) + within(b, a, 1)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and of B for each text."""
        return [self._a.encode_ordinary(f" {t}") for t in texts], self._b.encode(texts, num_threads=1) if texts else []

    def aligned(self, texts: list[str | None]) -> tuple[Tokens, Tokens, np.ndarray, np.ndarray]:
        """Tokens of A and of B of a block of texts, and the indices behind each group's last token in both. Texts that
        either spells with other bytes have none."""
        spoken = [t or "" for t in texts]
        some = [i for i, t in enumerate(spoken) if t]
        ids = self.encode([spoken[i] for i in some])
        data = [f" {spoken[i]}".encode() for i in some]
        both = [Tokens.of(p, x) for p, x in zip((self.a, self.b), ids)]
        want = np.fromiter(map(len, data), np.int64, len(data))
        right = (both[0].bytes_each() == want) & (both[1].bytes_each() == want)
        if not right.all():
            both, data, want = [t.only(right) for t in both], [d for d, r in zip(data, right) if r], want[right]
        some, whole = np.array(some, np.int64)[right], np.frombuffer(b"".join(data), np.uint8)
        wrong = np.flatnonzero((both[0].spelled() != whole) | (both[1].spelled() != whole))
        if len(wrong):
            right = np.ones(len(data), bool)
            right[np.searchsorted(want.cumsum(), wrong, side="right")] = False
            both, some = [t.only(right) for t in both], some[right]
        both = [t.spread(some, len(texts)) for t in both]
        # dictionaries from end to index; an end is its own place in them
        ends = [np.zeros(int(t.ends[-1]) + 1 if len(t.ids) else 1, np.int64) for t in both]
        for index, t in zip(ends, both):
            index[t.ends] = np.arange(1, len(t.ids) + 1)
        common = np.flatnonzero((ends[0] > 0) & (ends[1] > 0))
        return *both, ends[0][common], ends[1][common]

    def spelled(self, a: Tokens, b: Tokens, to_a: np.ndarray, to_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The groups of all texts as ASCII, ``a1,a2|b1;a3|b2,b3;``, and where each text's begin (and the end)."""
        n_a, n_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        place_a = np.arange(len(a.ids)) + np.repeat(to_b - n_b, n_a)
        place_b = np.arange(len(b.ids)) + np.repeat(to_a, n_b)
        ids, mark = np.zeros(len(a.ids) + len(b.ids), np.int64), np.full(len(a.ids) + len(b.ids), ord(","), np.uint8)
        ids[place_a], ids[place_b] = a.ids, b.ids
        mark[place_a[to_a - 1]], mark[place_b[to_b - 1]] = ord("|"), ord(";")
        size = self._digits[1][ids]
        ends = np.cumsum(size + 1)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
        out[ends - 1] = mark
        for k in range(1, int(size.max(initial=0)) + 1):
            has = np.flatnonzero(size >= k)
            out[ends[has] - 1 - k] = self._digits[0][ids[has], k - 1]
        return out, np.concatenate(([0], ends))[a.first + b.first]

    def rows(self, texts: list[str | None]) -> list[pa.Array]:
        """What is kept of each text: numbers of tokens, groups and links, the groups' digest, distinct linked pairs and how
        often they are linked. No token of the public vocabularies is empty, so each group has one link: that of its last tokens."""
        a, b, to_a, to_b = self.aligned(texts)
        text = np.searchsorted(a.first, to_a, side="left") - 1
        n_groups = np.bincount(text, minlength=len(texts))
        width, pairs = len(self.b_bytes), len(self.a_bytes) * len(self.b_bytes)
        keys, times = np.unique(text * pairs + a.ids[to_a - 1] * width + b.ids[to_b - 1], return_counts=True)
        at = np.searchsorted(keys, np.arange(len(texts) + 1) * pairs)
        marks, begin = self.spelled(a, b, to_a, to_b)
        said = marks.tobytes()
        digests = [hashlib.sha256(said[i : j - 1]).hexdigest() if j > i else NO_GROUPS for i, j in zip(begin.tolist(), begin[1:].tolist())]
        lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v, pa.int32())) for v in (keys % pairs // width, keys % width, times)]
        return [*(pa.array(v, pa.int64()) for v in (np.diff(a.first), np.diff(b.first), n_groups, n_groups)), pa.array(digests, pa.string()), *lists]


_loaded: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    """One pair per Python worker."""
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Tokenizers(a_path, b_path)
    return _loaded[a_path, b_path]


_COLUMNS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a_ids array<int>, b_ids array<int>, times array<int>"


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the distinct linked pairs with their numbers: a_ids, b_ids,
    times), staged."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, schema = tokenizers(a_path, b_path), None
        for batch in batches:
            schema = schema or pa.schema([batch.schema.field("doc_id"), *_fields()])
            for part in _blocks(batch):
                # copies in a block are aligned once
                texts = pc.dictionary_encode(part.column("text"), null_encoding="encode")
                found = both.rows(texts.dictionary.to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(c.take(texts.indices) for c in found)], schema=schema)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return stage(docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, {_COLUMNS}"), "aligned")


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about a block's bytes, or of one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < len(batch):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + BLOCK_BYTES, side="right")))
        yield batch.slice(low, high - low)
        low = high


def _fields() -> list[pa.Field]:
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    return [pa.field(*(name, kinds[kind])) for name, kind in (c.split(" ") for c in _COLUMNS.split(", "))]


def pair_counts(found: DataFrame) -> DataFrame:
    """(a_id, b_id, n, best): how many links of the corpus hold a pair, and whether no other A id is linked with its B id
    more often. Each task adds up its own first; there are at most ``bound`` rows."""
    pairs = found.select(F.explode(F.arrays_zip("a_ids", "b_ids", "times")).alias("p")).select("p.*")
    counts = pairs.groupBy(F.col("a_ids").alias("a_id"), F.col("b_ids").alias("b_id")).agg(F.sum("times").alias("n"))
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b_id")))


def with_counts(found: DataFrame, counts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256). The counts go to all tasks: no more rows
    than the vocabularies' bound, at 17 bytes each."""
    table = counts.select("a_id", "b_id", "n", "best").toArrow()
    both = tokenizers(a_path, b_path)
    if table.num_rows > both.bound:
        raise ValueError("more pairs than the vocabularies allow")
    width = len(both.b_bytes)
    a, b, n, best = (table.column(c).to_numpy() for c in ("a_id", "b_id", "n", "best"))
    keys = a.astype(np.int64) * width + b
    order = np.argsort(keys)
    sent = found.sparkSession.sparkContext.broadcast((keys[order], n[order], best[order]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = sent.value
        for batch in batches:
            at, lists = batch.column("a_ids").offsets.to_numpy(), [batch.column(c).flatten().to_numpy() for c in ("a_ids", "b_ids", "times")]
            place = np.searchsorted(keys, lists[0].astype(np.int64) * width + lists[1])
            total = lambda v: pa.array(np.diff(np.concatenate(([0], np.cumsum(v)))[at - at[0]]).astype(np.int64))  # noqa: E731, B023
            columns = [batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
            times = lists[2].astype(np.int64)
            columns += [total(times * best[place]), total(times * n[place]), batch.column("groups_sha256")]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(rows, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def alignment(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per row of docs (doc_id, text): numbers of tokens, groups and links, how its links fare in the corpus, and a
    digest of its groups."""
    found = aligned(docs, a_path, b_path)
    return with_counts(found, pair_counts(found), a_path, b_path)


def vocabulary_map(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(b_id, a_id, n): for each B id the A ids most often linked with it, ties included."""
    return pair_counts(aligned(docs, a_path, b_path)).where("best").select("b_id", "a_id", "n")
