"""Problem 1: cutting oversized texts at natural boundaries, with overlap."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE_COLUMNS = "chunk_id string, piece_no int, n_pieces int, start int, end int, content string, content_hash string, location string"

#: Kinds of boundary, strongest first. Each pattern ends where a cut may fall.
_BOUNDARIES = [
    re.compile(r"\n[^\S\n]*\n\s*"),  # paragraphs
    re.compile(r"\n\s*"),  # lines, list items, table rows
    re.compile(r"[.!?…][\"'”’)\]]*\s+|[。！？]"),  # sentences
    re.compile(r"[,;:、，；：]\s+|[、，；：]|\s[-–—]\s+"),  # clauses
    re.compile(r"\s+"),  # words
]
_ABBREVIATION = re.compile(r"(?:\b(?:e\.g|i\.e|cf|vs|al|etc|approx|no|pp?|vol|eds?|dr|prof|st|sec|eq|fig|tab|ch)|\b[A-Z])\.$", re.IGNORECASE)


def _nearest(text: str, low: int, high: int, target: int) -> int:
    """The cut in [low, high] at the strongest kind of boundary, of these the nearest to target; target where there is none."""
    low, high = max(low, 1), min(high, len(text) - 1)
    back = max(0, low - 80)
    area = text[back : high + 80]
    for kind, pattern in enumerate(_BOUNDARIES):
        cuts = [m.end() + back for m in pattern.finditer(area) if low <= m.end() + back <= high and not (kind == 2 and m.group()[0] == "." and _ABBREVIATION.search(text[max(0, m.start() + back - 8) : m.start() + back + 1]))]
        if cuts:
            return min(cuts, key=lambda c: (abs(c - target), c))
    return min(max(target, low), high)


def split_spans(text: str, limit: int = 2400, overlap: int = 200) -> list[tuple[int, int]]:
    """Spans of at most ``limit`` characters that cover ``text``.

    The fewest pieces that can hold the text get ends at equal distances; each
    end moves to the strongest boundary near it, and each start to one at most
    ``overlap`` before its predecessor's end. Where a piece would pass the
    limit, one piece more is tried: with shorter strides the slack grows, so
    this ends, even in a text without any boundary.
    """
    n = len(text)
    if not 0 <= overlap < limit / 2:
        raise ValueError("overlap must be less than half of the limit")
    if n <= limit:
        return [(0, n)]
    pieces = max(2, -(-(n - overlap) // (limit - overlap)))
    while True:
        stride = (n - overlap) / pieces
        reach = max(1, min(int(stride / 4), (limit - overlap) // 8))
        spans, start, end = [], 0, 0
        for k in range(1, pieces + 1):
            target = round(overlap + k * stride)
            last = end
            end = n if k == pieces else _nearest(text, max(target - reach, last + 1), min(target + reach, start + limit), target)
            if not start < end or end <= last or end - start > limit:
                break
            spans.append((start, end))
            start = max(last + 1, _nearest(text, end - overlap, end - overlap // 2, end - overlap)) if overlap else end
            start = max(start, end - overlap)
        else:
            return spans
        pieces += 1


def _split(batches: Iterator[pa.RecordBatch], limit: int, overlap: int) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in PIECE_COLUMNS.split(", ")]
    for batch in batches:
        out: list[tuple] = []
        for key, text, location in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            spans = split_spans(text, limit, overlap)
            for no, (start, end) in enumerate(spans, 1):
                piece = text[start:end]
                place = f"part {no} of {len(spans)}, characters {start + 1}-{end}"
                out.append((key, no, len(spans), start, end, piece, hashlib.sha256(piece.encode()).hexdigest(), f"{location} ({place})" if location else place))
        columns = list(zip(*out, strict=True)) or [[]] * len(names)
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


def split_oversized(chunks: DataFrame, limit: int = 2400, overlap: int = 200) -> DataFrame:
    """Pieces of at most ``limit`` characters (Unicode code points) for every chunk.

    Method: balanced targets (see split_spans). Only oversized contents reach
    Python; all others pass inside the JVM as one piece with their own location.
    A null, empty or blank content is one piece as it is (``n_pieces`` 1). Rows
    delivered twice give their pieces twice: call with distinct rows, or make
    the result distinct. ``start`` and ``end`` count characters from 0, end
    excluded. Null locations become the piece's place alone. Other columns of
    the input are not carried.
    """
    rows = chunks.select(F.col("id").alias("chunk_id"), "content", "location")
    size = F.coalesce(F.char_length("content"), F.lit(0))
    small = rows.where(size <= limit).select(
        "chunk_id",
        F.lit(1).alias("piece_no"),
        F.lit(1).alias("n_pieces"),
        F.lit(0).alias("start"),
        size.alias("end"),
        "content",
        F.sha2("content", 256).alias("content_hash"),
        "location",
    )
    large = rows.where(size > limit).mapInArrow(lambda it: _split(it, limit, overlap), PIECE_COLUMNS)
    return small.unionByName(large)


def delivered_once(chunks: DataFrame) -> DataFrame:
    """Each chunk once: of rows of one id the first that comes. Only rows of repeated ids are shuffled; rows without an id all stay."""
    repeated = chunks.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    once, twice = chunks.join(repeated, "id", "left_anti"), chunks.join(repeated, "id", "left_semi")
    return once.unionByName(twice.dropDuplicates(["id"]))
