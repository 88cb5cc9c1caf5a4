"""Passages of documents: paragraphs, sentences, packing into chunks, headings and filters."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words whose full stop ends no sentence.
NO_END = frozenset("Mr Mrs Ms Dr Prof Jr Sr vs etc al e.g i.e eg ie Fig Eq Ch Vol No Ref cf".split())
#: Patterns of the chunk filter; (?d) lets only \n end a line.
REFERENCE = r"(?dm)^[ \t\n\f\r]*\[?[0-9]+\]?[ \t\n\f\r]*[A-Z][a-z]+.*[0-9]{4}"
TABLE_ROW = r"(?dm)^[ \t\n\f\r0-9.,\-|]+$"
EQUATION = "[∑∏∫∂∇√∞≈≠≤≥∈∉⊂⊃∪∩]"
GARBAGE = r"[^\x00-\x7F]{5,}|[!@#$%^&*]{3,}"


def paragraphs(text: str) -> list[str]:
    """Parts between blank lines, trimmed, empty ones dropped."""
    return [p for p in (x.strip() for x in re.split(r"\n\s*\n", text)) if p]


def sentences(text: str) -> list[str]:
    """Parts that end in . ! or ? before white space; not after abbreviations, initials and bare numbers."""
    out, start = [], 0
    for m in re.finditer(r"[.!?]+(?=\s)", text):
        last = text[start : m.start()].split()[-1:] or [""]
        word = last[0].lstrip("([\"'")
        if m.group() == "." and (word in NO_END or len(word) == 1 and word.isupper() or word.isdigit()):
            continue
        if part := text[start : m.end()].strip():
            out.append(part)
        start = m.end()
    return [*out, rest] if (rest := text[start:].strip()) else out


def count_words(text: str) -> int:
    return len(text.split())


def pack(text: str, target: int = 300, variance: int = 50, overlap: int = 50, count: Callable[[str], int] = count_words) -> list[str]:
    """Chunks of about ``target`` tokens made of whole paragraphs.

    A paragraph above target + variance goes in groups of whole sentences; a
    chunk is closed when the next part would pass target + variance, and the
    next begins with the last parts of it that make up about ``overlap`` tokens.
    A sentence is never cut. Blank texts give no chunk.
    """
    most, parts = target + variance, []
    for p in paragraphs(text):
        if count(p) <= most:
            parts.append(p)
            continue
        group: list[str] = []
        for s in sentences(p):
            if group and count(" ".join([*group, s])) > most:
                parts.append(" ".join(group))
                group = []
            group.append(s)
        parts.append(" ".join(group))
    chunks, current, fresh = [], [], False
    for p in parts:
        if fresh and sum(map(count, current)) + count(p) > most:
            chunks.append("\n\n".join(current))
            current, fresh = _tail(current, overlap, count), False
        current.append(p)
        fresh = True
    return [*chunks, "\n\n".join(current)] if fresh else chunks


def _tail(parts: list[str], tokens: int, count: Callable[[str], int]) -> list[str]:
    """The last parts that reach ``tokens``, without one that would pass one and a half times as many."""
    out: list[str] = []
    size = 0
    for p in reversed(parts):
        n = count(p)
        if size >= tokens or out and size + n > 1.5 * tokens or n > 3 * tokens:
            break
        out.insert(0, p)
        size += n
    return out


def chunked(documents: DataFrame, target: int = 300, variance: int = 50, overlap: int = 50) -> DataFrame:
    """doc_id, chunk_index, content, token_count and char_count of each document's chunks; none for null and blank texts."""

    def of_batch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(key, k, c, count_words(c), len(c)) for key, text in zip(frame["doc_id"], frame["text"], strict=True) if text for k, c in enumerate(pack(text, target, variance, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "content", "token_count", "char_count"])

    return documents.select("doc_id", "text").mapInPandas(of_batch, "doc_id bigint, chunk_index int, content string, token_count int, char_count int")


def sentence_rows(documents: DataFrame) -> DataFrame:
    """doc_id, n and sentence of each document."""

    def of_batch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(k, n, s) for k, t in zip(frame["doc_id"], frame["text"], strict=True) if t for n, s in enumerate(sentences(t))], columns=["doc_id", "n", "sentence"])

    return documents.select("doc_id", "text").mapInPandas(of_batch, "doc_id bigint, n int, sentence string")


def chunk_metrics(content: Column) -> dict[str, Column]:
    """What the filter looks at: length, lines, words, share of letters, and counts of patterns."""
    length = F.length(content)
    return {
        "length": length,
        "lines": F.regexp_count(content, F.lit("\n")) + 1,
        "words": F.size(F.filter(F.split(content, r"[ \t\n\f\r]+"), lambda w: w != "")),
        "letter_share": F.coalesce(F.try_divide(F.length(F.regexp_replace(content, "[^A-Za-z]", "")), length), F.lit(0.0)),
        "references": F.regexp_count(content, F.lit(REFERENCE)),
        "table_rows": F.regexp_count(content, F.lit(TABLE_ROW)),
        "equations": F.regexp_count(content, F.lit(EQUATION)),
        "garbage": F.regexp_count(content, F.lit(GARBAGE)),
    }


def filtered(chunks: DataFrame) -> DataFrame:
    """Chunks with decision (process, skip, flag) and reason; the first rule that fits counts. A null content is too short."""
    m = chunk_metrics(F.coalesce("content", F.lit("")))
    rules = [
        (m["length"] < 100, "skip", "too_short"),
        (m["length"] > 15000, "flag", "too_long"),
        (m["letter_share"] < 0.4, "skip", "few_letters"),
        (m["references"] > 5, "skip", "references"),
        (m["table_rows"] > m["lines"] * 0.5, "flag", "table"),
        (m["garbage"] > 3, "skip", "garbage"),
        (m["equations"] > 10, "flag", "equations"),
    ]
    pair = F.struct(F.lit("process").alias("decision"), F.lit("good").alias("reason"))
    for fits, decision, reason in reversed(rules):
        pair = F.when(fits, F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason"))).otherwise(pair)
    return chunks.withColumn("__r", pair).withColumn("decision", F.col("__r.decision")).withColumn("reason", F.col("__r.reason")).drop("__r")


def heading_levels(blocks: DataFrame) -> DataFrame:
    """doc_id, at, text and level 1-3 of blocks (doc_id, at, text, size) whose type is larger than the document's median by 2, 1 or half a standard deviation; texts of 3-100 characters and at most 15 words; none where all sizes are equal."""
    about = blocks.groupBy("doc_id").agg(F.expr("percentile(size, 0.5)").alias("m"), F.stddev_samp("size").alias("s"), F.count_distinct("size").alias("k")).where("k > 1")
    level = F.when(F.col("size") >= F.col("m") + 2 * F.col("s"), 1).when(F.col("size") >= F.col("m") + F.col("s"), 2).when(F.col("size") >= F.col("m") + 0.5 * F.col("s"), 3)
    fits = F.length(F.trim("text")).between(3, 100) & (F.size(F.split(F.trim("text"), r"\s+")) <= 15)
    return blocks.where(fits).join(about, "doc_id").withColumn("level", level).where("level IS NOT NULL").select("doc_id", "at", "text", "level")


def last_heading(chunks: DataFrame, headings: DataFrame) -> DataFrame:
    """Chunks (doc_id, at, ...) with the last heading at or before them, by a union and one window instead of a range join."""
    both = chunks.select("doc_id", "at", F.lit(1).alias("kind"), F.struct(*chunks.columns).alias("row"), F.lit(None).cast("string").alias("text")).unionByName(headings.select("doc_id", "at", F.lit(0).alias("kind"), "text"), allowMissingColumns=True)
    by = Window.partitionBy("doc_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("heading", F.last("text", True).over(by)).where("kind = 1").select("row.*", "heading")


def page_range(chunks: DataFrame, pages: DataFrame, snippet: int = 100) -> DataFrame:
    """chunk_id with first_page and last_page, the least page that holds its first and its last ``snippet`` characters; 1 if none does. Pages are (doc_id, page, text), chunks (chunk_id, doc_id, content)."""
    ends = chunks.select("chunk_id", "doc_id", F.substring("content", 1, snippet).alias("head"), F.expr(f"right(content, {snippet})").alias("tail"))
    met = ends.join(pages, "doc_id", "left").groupBy("chunk_id").agg(F.min(F.when(F.contains("text", "head"), F.col("page"))).alias("a"), F.min(F.when(F.contains("text", "tail"), F.col("page"))).alias("b"))
    return met.select("chunk_id", F.coalesce("a", F.lit(1)).alias("first_page"), F.greatest(F.coalesce("b", "a", F.lit(1)), F.coalesce("a", F.lit(1))).alias("last_page"))
