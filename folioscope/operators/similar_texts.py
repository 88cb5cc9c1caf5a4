"""Pairs of texts whose sets of letter triples are alike, compared in blocks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.lineage import materialize

_LETTERS = {c: i for i, c in enumerate(" abcdefghijklmnopqrstuvwxyz0123456789")}
_TRIPLES = len(_LETTERS) ** 3
#: Triples that are compared for all pairs, those that tell most texts apart; more for pairs that these leave; all for what is left then.
_FIRST, _BITS = 126, 512
#: Texts of a side in a cell of the grid, and the least groups of a side.
_CELL, _GROUPS = 200_000, 6
_SLACK = 1e-3


def plain(text: Column | str) -> Column:
    """Lower case, with one blank for all that is no ASCII letter or digit."""
    return F.trim(F.regexp_replace(F.lower(F.col(text) if isinstance(text, str) else text), r"[^a-z0-9]+", " "))


@lru_cache(100_000)
def _triples(word: str) -> frozenset[int]:
    """Codes of the triples of a word, padded by two blanks before and one after."""
    at = [0, 0, *(_LETTERS[c] for c in word), 0]
    return frozenset((x * 37 + y) * 37 + z for x, y, z in zip(at, at[1:], at[2:], strict=False))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("plain").to_pylist()
        grams = [sorted(frozenset().union(*map(_triples, t.split(" ")))) for t in texts]
        own = [int.from_bytes(blake2b(t.encode(), digest_size=8).digest(), "little", signed=True) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("plain"), pa.array(own, pa.int64()), pa.array(grams, pa.list_(pa.int32()))], ["plain", "c", "grams"])


def _packed(batches: Iterator[pa.RecordBatch], place: np.ndarray) -> Iterator[pa.RecordBatch]:
    """c, n and bits, one for each triple that is compared in cells."""
    for batch in batches:
        grams = batch.column("grams")
        n = grams.value_lengths().to_numpy(zero_copy_only=False)
        at = place[grams.flatten().to_numpy()]
        bits = np.zeros((batch.num_rows, _BITS), bool)
        bits[np.repeat(np.arange(batch.num_rows), n)[at >= 0], at[at >= 0]] = True
        rows = np.packbits(bits, axis=1)
        yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array(n, pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], ["c", "n", "bits"])


def _compared(cell: pa.Table, threshold: float, mirrored: bool) -> pa.Table:
    """x and y of the two sides of one cell that the compared triples don't prove to be too different.

    Sets of n and m elements are alike if no more than (1 - t) / (1 + t) of n + m are in
    one alone, and what is in one alone among some triples is no more than among all.
    """
    share = (1 - threshold) / (1 + threshold)
    sides = []
    for own in (1, 0):
        table = cell.filter(pc.equal(cell.column("side"), own))
        n = table.column("n").to_numpy()
        order = np.argsort(n, kind="stable")
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint8).reshape(-1, _BITS // 8)[order]
        sides.append((table.column("c").to_numpy()[order], n[order], bits, own))

    def factors(of: tuple, start: int, end: int) -> np.ndarray:
        """Of which the products are what both have, less what they need."""
        _, n, bits, own = of
        out = np.ones((end - start, _FIRST + 2), np.float32)
        out[:, :_FIRST] = np.unpackbits(bits[start:end], axis=1, count=_FIRST)
        out[:, _FIRST + 1 - own] = (share * n[start:end] - out[:, :_FIRST].sum(1)) / 2
        return out

    first, second = sides
    words = [side[2].view(np.uint64) for side in sides]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for start in range(0, len(first[0]), 512):
        end = min(start + 512, len(first[0]))
        left = factors(first, start, end)
        low = np.searchsorted(second[1], threshold * first[1][start] - _SLACK)
        high = np.searchsorted(second[1], first[1][end - 1] / threshold + _SLACK, "right")
        for at in range(low, high, 2048):
            right = factors(second, at, min(at + 2048, high))
            i, j = np.divmod(np.flatnonzero(left @ right.T >= -_SLACK), len(right))
            i, j = i + start, j + at
            apart = np.bitwise_count(words[0][i] ^ words[1][j]).sum(1, dtype=np.int32)
            kept = apart <= share * (first[1][i] + second[1][j]) + _SLACK
            found.append((first[0][i[kept]], second[0][j[kept]]))
    a, b = (np.concatenate([f[k] for f in found] or [np.empty(0, np.int64)]) for k in (0, 1))
    if mirrored and cell.column("i")[0] == cell.column("j")[0]:
        a, b = a[a <= b], b[a <= b]
    return pa.table({"x": pa.array(a, pa.int64()), "y": pa.array(b, pa.int64())})


def _near(left: DataFrame, right: DataFrame, threshold: float, mirrored: bool, least: int = _GROUPS) -> DataFrame:
    """x and y of rows (key, c, n, bits) with equal keys that may be alike: all are compared, in cells of a grid."""
    p, q = (max(least, -(-rows.count() // _CELL)) for rows in (left, right))

    def dealt(rows: DataFrame, own: str, of: int, other: str, others: Column) -> DataFrame:
        return rows.withColumn(own, F.pmod("c", F.lit(of)).cast("int")).withColumn(other, F.explode(others)).select("key", "i", "j", F.lit(int(own == "i")).alias("side"), "c", "n", "bits")

    if mirrored:
        x, y = dealt(left, "i", p, "j", F.sequence("i", F.lit(p - 1))), dealt(right, "j", p, "i", F.sequence(F.lit(0), "j"))
    else:
        x, y = dealt(left, "i", p, "j", F.sequence(F.lit(0), F.lit(q - 1))), dealt(right, "j", q, "i", F.sequence(F.lit(0), F.lit(p - 1)))
    # By number, as few bytes are much work here and would be put into one task.
    tasks = max(p * q, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    return x.unionByName(y).repartition(tasks, "key", "i", "j").groupBy("key", "i", "j").applyInArrow(lambda cell: _compared(cell, threshold, mirrored), "x bigint, y bigint")


def similar_texts(left: DataFrame, right: DataFrame | None, threshold: float) -> DataFrame:
    """x, y and similarity of plain texts (column ``plain``) whose sets of letter triples have a Jaccard coefficient of at least ``threshold``; without ``right``, each pair of ``left`` once in either order, and each text with itself.

    Where both sides have a ``year``, texts meet only where years agree or one is
    unknown. Exact: each text is taken once and all are compared, by matrix products over
    the triples that tell most texts apart; what these don't rule out is
    compared whole. No pair is written before it has passed. The work grows as the
    square of the different texts (within a year where years count).
    """
    mirrored = right is None
    every = left.select("plain") if mirrored else left.select("plain").unionByName(right.select("plain"))
    sets = materialize(every.distinct().mapInArrow(_sets, "plain string, c bigint, grams array<int>"), "sets")
    total = sets.count()
    place = np.full(_TRIPLES, -1, np.int64)
    counts = sets.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("n")).collect()
    for k, r in enumerate(sorted(counts, key=lambda r: (-r.n * (total - r.n), r.g))[:_BITS]):
        place[r.g] = k
    packed = materialize(sets.mapInArrow(lambda it: _packed(it, place), "c bigint, n int, bits binary"), "packed")
    names = sets.select("plain", "c")

    def rows(texts: DataFrame, key: str | int) -> DataFrame:
        """Of each text once a key."""
        return texts.select("plain", (F.col(key) if isinstance(key, str) else F.lit(key)).alias("key")).distinct().join(names, "plain").select("key", "c").join(packed, "c")

    if mirrored:
        own = rows(left, 0)
        near = _near(own, own, threshold, True)
    elif "year" not in left.columns or "year" not in right.columns:
        near = _near(rows(left, 0), rows(right, 0), threshold, False)
    else:
        known = [side.where("year IS NOT NULL") for side in (left, right)]
        near = _near(rows(known[0], "year"), rows(known[1], "year"), threshold, False, 1)
        near = near.unionByName(_near(rows(left.where("year IS NULL"), 0), rows(right, 0), threshold, False))
        near = near.unionByName(_near(rows(known[0], 0), rows(right.where("year IS NULL"), 0), threshold, False)).distinct()
    near = materialize(near, "near", packed)
    x, y = (sets.select(F.col("c").alias(c), F.col("plain").alias(f"{c}_plain"), F.col("grams").alias(f"{c}_grams")) for c in ("x", "y"))
    both = near.join(x, "x").join(y, "y").select("x_plain", "y_plain", F.size("x_grams").alias("n"), F.size("y_grams").alias("m"), F.size(F.array_intersect("x_grams", "y_grams")).alias("k"))
    similar = both.select(F.col("x_plain").alias("x"), F.col("y_plain").alias("y"), (F.col("k") / (F.col("n") + F.col("m") - F.col("k"))).alias("similarity"))
    return similar.where(F.col("similarity") >= threshold - 1e-9)
