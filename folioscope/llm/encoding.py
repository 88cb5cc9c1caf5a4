"""Problem 6: byte-level BPE over padded numpy matrices."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

TOKENIZERS = os.environ.get("FOLIOSCOPE_TOKENIZERS", "/opt/tokenizers")
#: The public pattern that splits a text before the merges, and the same for ASCII texts.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\r\f\vA-Za-z0-9]+|[ \t\n\r\f\v]+(?![^ \t\n\r\f\v])|[ \t\n\r\f\v]+"""
_NONE = np.iinfo(np.int32).max
_EMPTY = np.int64(-1)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Pieces longer than this merge all places of their pair in a round, which gives the same ids in fewer rounds (see ByteBpe.ordered).
_LONG = 64
#: Pieces kept by a worker; beyond, it starts anew.
_KEPT = 400_000


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself where printable, else the next from code point 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    hidden = [b for b in range(256) if b not in letters]
    letters.update((b, chr(256 + k)) for k, b in enumerate(hidden))
    return [letters[b] for b in range(256)]


class PairTable:
    """Open-addressing hash table from a pair of ids to its merge rank, looked up for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray) -> None:
        self.shift = np.uint64(64 - max(4, int(np.ceil(np.log2(max(1, len(left))))) + 2))
        self.mask = (1 << int(64 - self.shift)) - 1
        self.keys = np.full(self.mask + 1, _EMPTY, np.int64)
        self.ranks = np.full(self.mask + 1, _NONE, np.int32)
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slots, rest, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(rest):
            at = slots[rest]
            free = self.keys[at] == _EMPTY
            _, first = np.unique(at, return_index=True)
            placed = np.zeros(len(rest), bool)
            placed[first] = free[first]
            self.keys[at[placed]] = keys[rest[placed]]
            self.ranks[at[placed]] = rest[placed]
            rest = rest[~placed]
            slots[rest] = (slots[rest] + 1) & self.mask
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _FACTOR) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF).ravel()
        slots = self._slot(keys)
        found = np.where(self.keys[slots] == keys, self.ranks[slots], _NONE)
        open_ = np.flatnonzero((found == _NONE) & (self.keys[slots] != _EMPTY))
        for _ in range(self.probes):
            if not len(open_):
                break
            slots[open_] = (slots[open_] + 1) & self.mask
            there = self.keys[slots[open_]]
            hit = there == keys[open_]
            found[open_[hit]] = self.ranks[slots[open_[hit]]]
            open_ = open_[~hit & (there != _EMPTY)]
        return found.reshape(left.shape)


class ByteBpe:
    """A byte-level BPE vocabulary: ids of bytes, and merges in order of rank."""

    def __init__(self, file: str) -> None:
        with open(file, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.byte_ids = np.array([vocab[c] for c in _byte_letters()], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int32) for k in (0, 1))
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.table = PairTable(left, right)
        # Merging all places of a pair at once equals merging them from the left if no merge comes before those that made its parts.
        made = np.full(max(vocab.values()) + 1, -1, np.int64)
        made[self.merged[::-1]] = np.arange(len(pairs))[::-1]
        self.ordered = bool((np.maximum(made[left], made[right]) < np.arange(len(pairs))).all())

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece. Pieces of like length share a padded matrix."""
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        widths = np.where(sizes > 0, 2 ** np.ceil(np.log2(np.maximum(sizes, 2))).astype(np.int64), 0)
        for width in np.unique(widths[widths > 0]):
            rows = np.flatnonzero(widths == width)
            step = max(1, (1 << 22) // int(width))
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                matrix = np.full((len(part), width), -1, np.int32)
                inside = np.arange(width) < sizes[part][:, None]
                matrix[inside] = self.byte_ids[np.frombuffer(b"".join(pieces[r] for r in part), np.uint8)]
                for r, ids in zip(part, self._merge(matrix, self.ordered and width > _LONG), strict=True):
                    out[r] = ids
        return out

    def _merge(self, matrix: np.ndarray, everywhere: bool) -> list[np.ndarray]:
        """Each round, every row merges its leftmost pair of least rank and closes the gap; finished rows leave the matrix."""
        done: list[np.ndarray] = [matrix[:0, 0]] * len(matrix)
        rows = np.arange(len(matrix))
        while len(rows):
            width = matrix.shape[1]
            if width > 1:
                ranks = self.table.find(matrix[:, :-1], matrix[:, 1:])
                ranks[matrix[:, 1:] < 0] = _NONE
                at = ranks.argmin(1)
                least = ranks[np.arange(len(rows)), at]
            else:
                least = np.full(len(rows), _NONE, np.int32)
            over = least == _NONE
            for r in np.flatnonzero(over):
                done[rows[r]] = matrix[r][matrix[r] >= 0]
            rows, matrix = rows[~over], matrix[~over]
            if not len(rows):
                break
            least, at, ranks = least[~over], at[~over], ranks[~over]
            if everywhere:
                matrix = self._merge_all(matrix, ranks == least[:, None], self.merged[least])
            else:
                matrix[np.arange(len(rows)), at] = self.merged[least]
                columns = np.arange(width - 1)
                matrix = np.take_along_axis(matrix, columns + (columns > at[:, None]), 1)
            used = int((matrix >= 0).sum(1).max())
            matrix = matrix[:, :used]
        return done

    @staticmethod
    def _merge_all(matrix: np.ndarray, here: np.ndarray, merged: np.ndarray) -> np.ndarray:
        """Merge every place of the row's pair, from the left, no two overlapping."""
        columns = np.arange(here.shape[1])
        start = np.maximum.accumulate(np.where(here, -1, columns), 1)  # the last place before the run
        here &= (columns - start) % 2 == 1
        matrix = matrix.copy()
        r, c = np.nonzero(here)
        matrix[r, c] = merged[r]
        gone = np.zeros(matrix.shape, bool)
        gone[r, c + 1] = True
        matrix[gone] = -2
        order = np.argsort(matrix == -2, 1, kind="stable")
        matrix = np.take_along_axis(matrix, order, 1)
        matrix[matrix == -2] = -1
        return matrix


@lru_cache(4)
def vocabulary(file: str) -> ByteBpe:
    return ByteBpe(file)


class _Pieces:
    """The pieces a worker has met, their ids in one flat array."""

    def __init__(self, bpe: ByteBpe) -> None:
        self.bpe, self.any, self.ascii = bpe, regex.compile(PATTERN).findall, re.compile(ASCII_PATTERN).findall
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.starts = self.sizes = np.empty(0, np.int64)
        self.flat = np.empty(0, np.int32)

    def index(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all pieces of the texts, and how many each text has."""
        if len(self.known) > _KEPT:
            self._clear()
        pieces: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if text:
                before = len(pieces)
                pieces += self.ascii(text) if text.isascii() else self.any(text)
                counts[k] = len(pieces) - before
        if new := [p for p in dict.fromkeys(pieces) if p not in self.known]:
            ids = self.bpe.encode_pieces([p.encode() for p in new])
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, *ids])
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces)), counts


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of the first counts[0] values, the next counts[1], and so on."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def _encode(batches: Iterator[pa.RecordBatch], file: str, name: str, count: bool) -> Iterator[pa.RecordBatch]:
    pieces = _Pieces(vocabulary(file))
    for batch in batches:
        index, counts = pieces.index(batch.column(1).to_pylist())
        sizes = pieces.sizes[index]
        per_text = _sums(sizes, counts)
        if count:
            result: pa.Array = pa.array(per_text)
        else:
            places = np.arange(sizes.sum()) + np.repeat(pieces.starts[index] - np.cumsum(sizes) + sizes, sizes)
            offsets = np.concatenate([[0], np.cumsum(per_text)])
            if offsets[-1] > _NONE:
                raise ValueError("a batch has more than 2^31 tokens; lower spark.sql.execution.arrow.maxRecordsPerBatch")
            result = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(pieces.flat[places]))
        yield pa.RecordBatch.from_arrays([batch.column(0), *([batch.column(2)] if count else []), result], ["doc_id", *(["source"] if count else []), name])


def encode(documents: DataFrame, file: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """doc_id and ``ids``, the tokens of the whole text, without special tokens.

    An empty and a null text have an empty list; strings of special tokens are
    plain text. ``file`` must be readable on every executor. Rows are encoded
    where they lie, without a shuffle; only (doc_id, text) is read.
    """
    return documents.select("doc_id", "text").mapInArrow(lambda it: _encode(it, file, "ids", False), "doc_id bigint, ids array<int>")


def count_tokens(documents: DataFrame, file: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """doc_id, source and ``n_tokens`` of each text; 0 for an empty and a null text."""
    return documents.select("doc_id", "text", "source").mapInArrow(lambda it: _encode(it, file, "n_tokens", True), "doc_id bigint, source string, n_tokens bigint")
