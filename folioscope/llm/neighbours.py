"""Problem 3: nearest vectors through shifted Hilbert curves, or of all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.operators.lineage import materialize

_KEYED = "curve int, place bigint, h bigint, vector array<float>"
_FOUND = "h bigint, other bigint, cosine double"
_ROWS_A_TASK = 60_000


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of whole coordinates in [0, 2^bits), one row a point.

    Works from the highest bit down: an axis whose bit is set inverts the lower
    bits of the first axis, else exchanges them with it; the Gray code of what
    remains is the place. rows x axes x bits must fit into 63 bits a row.
    """
    axes = [c.astype(np.int64) for c in cells.T]
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for k, axis in enumerate(axes):
            set_ = axis >> bit & 1 == 1
            swap = np.where(set_, 0, (axes[0] ^ axis) & low)
            axes[0] = np.where(set_, axes[0] ^ low, axes[0] ^ swap)
            if k:
                axes[k] = axis ^ swap
    for k in range(1, len(axes)):
        axes[k] ^= axes[k - 1]
    flip = np.zeros_like(axes[0])
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where(axes[-1] >> bit & 1 == 1, (1 << bit) - 1, 0)
    place = np.zeros_like(flip)
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            place = place << 1 | (axis ^ flip) >> bit & 1
    return place


def _sound(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose vector has ``size`` finite numbers, not all zero; and those vectors."""
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    rows = np.flatnonzero(lengths == size)
    part = column.take(pa.array(rows)).flatten()
    vectors = np.asarray(part.cast(pa.float32()).fill_null(float("nan")), np.float32).reshape(-1, size)
    good = np.isfinite(vectors).all(1) & (vectors != 0).any(1)
    return rows[good], vectors[good]


def _keys(batches: Iterator[pa.RecordBatch], size: int, curves: int, axes: int, bits: int, seed: int) -> Iterator[pa.RecordBatch]:
    rng = np.random.default_rng(seed)
    projections = [np.linalg.qr(rng.standard_normal((size, size)))[0][:, :axes].astype(np.float32) * np.sqrt(size) for _ in range(curves)]
    shifts = rng.uniform(-0.5, 0.5, (curves, axes)).astype(np.float32)
    for batch in batches:
        rows, vectors = _sound(batch.column(1), size)
        if not len(rows):
            continue
        ids = batch.column(0).take(pa.array(rows))
        flat = pa.array(vectors.ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, vectors.size + 1, size, dtype=np.int32)), flat)
        unit = vectors / np.linalg.norm(vectors.astype(np.float64), axis=1).astype(np.float32)[:, None]
        for curve in range(curves):
            # Coordinates have mean 0 and variance about 1: cells cover -2 to 2, the shift moves their borders.
            at = (unit @ projections[curve] + shifts[curve] + 2) * (2**bits / 4)
            place = hilbert_keys(np.clip(at, 0, 2**bits - 1).astype(np.int64), bits)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), curve, np.int32)), pa.array(place), ids, lists], ["curve", "place", "h", "vector"])


def _top(values: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest values of each row, in any order.

    The k largest lie in the k strides with the largest maxima, so only those are searched.
    """
    rows, width = values.shape
    if width <= k:
        return np.tile(np.arange(width), (rows, 1))
    strides = 32
    each = width // strides
    if each <= 4 * k:
        return np.argpartition(-values, k - 1, 1)[:, :k]
    most = values[:, : each * strides].reshape(rows, strides, each).max(1)
    near = np.argpartition(-most, k - 1, 1)[:, :k]
    places = (near[:, :, None] + np.arange(strides) * each).reshape(rows, -1)
    rest = np.broadcast_to(np.arange(each * strides, width), (rows, width - each * strides))
    places = np.concatenate([places, rest], 1)
    best = np.argpartition(-np.take_along_axis(values, places, 1), k - 1, 1)[:, :k]
    return np.take_along_axis(places, best, 1)


def _window(batches: Iterator[pa.RecordBatch], size: int, k: int, reach: int, least: float, block: int) -> Iterator[pa.RecordBatch]:
    """The best k of each row among the ``reach`` rows before and after it on its curve.

    A block of rows waits until ``reach`` rows have come after it, then meets
    those, itself and the ``reach`` rows before it, so a row's best of both
    sides come out at once. Memory holds about two reaches.
    """

    def best(cos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells with the best k of each row of cos, at least ``least``."""
        if least > -1:
            r, c = np.nonzero(cos >= least)
            if not len(r):
                return r, c
            counts = np.bincount(r, minlength=len(cos))
            crowded = counts > k
            if not crowded.any():
                return r, c
            rows = np.flatnonzero(crowded)
            keep = ~crowded[r]
            r, c = r[keep], c[keep]
        else:
            rows, r, c = np.arange(len(cos)), np.empty(0, np.int64), np.empty(0, np.int64)
        part = cos if len(rows) == len(cos) else cos[rows]
        top = _top(part, k)
        r2, c2 = np.repeat(rows, top.shape[1]), top.ravel()
        good = cos[r2, c2] >= max(least, -1.5)
        return np.concatenate([r, r2[good]]), np.concatenate([c, c2[good]])

    def meet(held: tuple, start: int, end: int) -> Iterator[pa.RecordBatch]:
        """The best of the held rows from start to end among those within reach."""
        low = max(0, start - reach)
        ids, light, exact = (x[low : end + reach] for x in held)
        cos = light[start - low : end - low] @ light.T
        at = np.arange(end - start)
        cos[at, at + start - low] = -2
        r, c = best(cos)
        if len(r):
            mine = r + start - low
            yield pa.RecordBatch.from_arrays([pa.array(ids[mine]), pa.array(ids[c]), pa.array(np.einsum("ij,ij->i", exact[mine], exact[c]))], ["h", "other", "cosine"])

    def rows_of(ids: list, vectors: list) -> tuple:
        plain = np.concatenate(vectors).astype(np.float64)
        exact = plain / np.sqrt(np.einsum("ij,ij->i", plain, plain))[:, None]
        return np.concatenate(ids), exact.astype(np.float32), exact

    none = (np.empty(0, np.int64), np.empty((0, size), np.float32), np.empty((0, size)))
    held, done, ids, vectors, count, curve, last = none, 0, [], [], 0, None, None

    def flush(end: bool = False) -> Iterator[pa.RecordBatch]:
        """Hold the rows that have come together and settle those that have all their neighbours; at the end of a curve all have."""
        nonlocal held, done, ids, vectors, count
        if count:
            held = tuple(np.concatenate([h, n]) for h, n in zip(held, rows_of(ids, vectors), strict=True))
            ids, vectors, count = [], [], 0
        ready = len(held[0]) if end else len(held[0]) - reach
        while done < ready and (end or ready - done >= block):
            step = min(block, ready - done)
            yield from meet(held, done, done + step)
            done += step
        if end:
            held, done = none, 0
        elif done > reach:
            held, done = tuple(h[done - reach :] for h in held), reach

    for batch in batches:
        curves = np.asarray(batch.column(0))
        names = np.asarray(batch.column(1))
        if not len(names):
            continue
        flat = np.asarray(batch.column(2).flatten(), np.float32).reshape(-1, size)
        fresh = np.ones(len(names), bool)
        fresh[1:] = (names[1:] != names[:-1]) | (curves[1:] != curves[:-1])
        fresh[0] = (curves[0], names[0]) != last
        bounds = [0, *(np.flatnonzero(np.diff(curves)) + 1), len(names)]
        for start, end in zip(bounds[:-1], bounds[1:], strict=True):
            if curves[start] != curve:
                yield from flush(True)
                curve = curves[start]
            for i in range(start, end, block):
                take = np.arange(i, min(i + block, end))
                take = take[fresh[take]]
                if len(take):
                    ids.append(names[take])
                    vectors.append(flat[take])
                    count += len(take)
                if count >= max(block, reach // 2):
                    yield from flush()
        last = (curves[-1], names[-1])
    yield from flush(True)


def _blocks(batches: Iterator[pa.RecordBatch], size: int, most: int) -> Iterator[pa.RecordBatch]:
    """Sound rows in blocks of up to ``most``: hashes of ids and vectors, each as bytes."""
    ids, vectors = np.empty(0, np.int64), np.empty((0, size), np.float32)
    names = ["ids", "vectors"]
    for batch in batches:
        rows, found = _sound(batch.column(1), size)
        ids, vectors = np.concatenate([ids, np.asarray(batch.column(0))[rows]]), np.concatenate([vectors, found])
        while len(ids) >= most:
            yield pa.RecordBatch.from_arrays([pa.array([ids[:most].tobytes()]), pa.array([vectors[:most].tobytes()])], names)
            ids, vectors = ids[most:], vectors[most:]
    if len(ids):
        yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()]), pa.array([vectors.tobytes()])], names)


def _compared(batches: Iterator[pa.RecordBatch], size: int, k: int, least: float, tile: int = 512) -> Iterator[pa.RecordBatch]:
    """The best k of each row of the asking blocks among the blocks that they meet in this task.

    Single precision tells which cells may be among a row's best so far, double precision decides.
    """
    held: dict[bytes, tuple] = {}

    def unit(flat: bytes) -> tuple[np.ndarray, np.ndarray]:
        plain = np.frombuffer(flat, np.float32).reshape(-1, size).astype(np.float64)
        exact = plain / np.sqrt(np.einsum("ij,ij->i", plain, plain))[:, None]
        return exact.astype(np.float32), exact

    for batch in batches:
        for q_ids, q_vectors, x_ids, x_vectors in zip(*(batch.column(i) for i in range(4)), strict=True):
            key = q_ids.as_py()
            if key not in held:
                n = len(key) // 8
                held[key] = (np.frombuffer(key, np.int64), *unit(q_vectors.as_py()), np.full((n, k), -2.0), np.zeros((n, k), np.int64))
            ids, light, exact, best, other = held[key]
            names, (x_light, x_exact) = np.frombuffer(x_ids.as_py(), np.int64), unit(x_vectors.as_py())
            for at in range(0, len(ids), tile):
                cos = light[at : at + tile] @ x_light.T
                floor = np.maximum(best[at : at + tile, -1], least) - 1e-5
                hit = cos >= floor.astype(np.float32)[:, None]
                crowded = np.flatnonzero(hit.sum(1) > 4 * (k + 9))
                hit[crowded] = False
                r, c = np.nonzero(hit)
                if len(crowded):
                    top = _top(cos[crowded], k + 9)
                    r, c = np.concatenate([r, np.repeat(crowded, top.shape[1])]), np.concatenate([c, top.ravel()])
                r = r + at
                apart = ids[r] != names[c]
                r, c = r[apart], c[apart]
                if not len(r):
                    continue
                rows = np.unique(r)
                value = np.concatenate([np.einsum("ij,ij->i", exact[r], x_exact[c]), best[rows].ravel()])
                name, r = np.concatenate([names[c], other[rows].ravel()]), np.concatenate([r, np.repeat(rows, k)])
                order = np.lexsort((name, -value, r))
                value, name, r = value[order], name[order], r[order]
                place = np.arange(len(r)) - np.searchsorted(r, r)
                keep = place < k
                best[r[keep], place[keep]], other[r[keep], place[keep]] = value[keep], name[keep]
    for ids, _, _, best, other in held.values():
        r, c = np.nonzero(best >= max(least, -1.5))
        yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(other[r, c]), pa.array(best[r, c])], ["h", "other", "cosine"])


_SOUND_SQL = "size(embedding) = {0} AND forall(embedding, x -> x IS NOT NULL AND abs(x) < double('inf')) AND exists(embedding, x -> x <> 0)"


def _in_blocks(asking: DataFrame, asked: DataFrame, size: int, k: int, least: float, step: int = 4096, width: int = 160_000) -> DataFrame:
    """h, other and cosine of the best k of each row of ``asking`` (h, embedding) among all rows of ``asked``, for each ``width`` of these once.

    Each task holds about ``step`` rows with their best so far while blocks of ``width`` rows pass. Both are written tables.
    """
    kind = "ids binary, vectors binary"
    left = asking.repartition(max(1, -(-asking.count() // step))).mapInArrow(lambda it: _blocks(it, size, 2 * step), kind)
    right = asked.repartition(max(1, -(-asked.count() // width))).mapInArrow(lambda it: _blocks(it, size, 8192), kind)
    right = materialize(right, "blocks").toDF("x_ids", "x_vectors")
    return left.crossJoin(right.hint("shuffle_replicate_nl")).mapInArrow(lambda it: _compared(it, size, k, least), _FOUND)


def _exhaustive(vectors: DataFrame, size: int, k: int, least: float) -> DataFrame:
    """h, other and cosine of the best k of each row among all rows."""
    table = materialize(vectors.where(_SOUND_SQL.format(size)).groupBy("h").agg(F.min("embedding").alias("embedding")), "vectors")
    return _in_blocks(table, table, size, k, least)


def _with_crowds(met: DataFrame, vectors: DataFrame, size: int, k: int, least: float) -> DataFrame:
    """``met`` (h, other, cosine), whose crowded rows are compared anew with all rows that met any other.

    A row with fewer than ``k`` finds has room for all; one that has k may
    have missed nearer ones where more rows are alike than a window holds. Of equal vectors only k + 1 are
    compared, which are enough to fill the places of all: the others' nearest are the first k of them.
    """
    met = materialize(met, "met")
    found = met.groupBy("h").agg(F.count("*").alias("n"))
    crowded = materialize(found.where(F.col("n") >= k).select("h"), "crowded")
    if not crowded.limit(1).count():
        return met
    alike = met.select("h").unionByName(met.select(F.col("other").alias("h"))).distinct()
    known = vectors.where(_SOUND_SQL.format(size)).join(alike, "h", "left_semi").groupBy("h").agg(F.min("embedding").alias("embedding"))
    known = materialize(known, "alike")
    by = Window.partitionBy("embedding").orderBy("h")
    first = materialize(known.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k + 1), "first")
    table = first.select("h", "embedding")
    again = _in_blocks(materialize(table.join(crowded, "h", "left_semi"), "asking"), table, size, k, least)
    copies = first.groupBy("embedding").agg(F.sort_array(F.collect_list("h")).alias("hs")).where(F.size("hs") > k)
    more = known.join(first.select("h"), "h", "left_anti").join(copies, "embedding").select("h", F.explode(F.slice("hs", 1, k)).alias("other"), F.lit(1.0).alias("cosine"))
    kept = met.join(crowded, "h", "left_anti").join(more.select("h").distinct(), "h", "left_anti")
    return kept.unionByName(again).unionByName(more)


def nearest(rows: DataFrame, k: int = 5, min_cosine: float = -1.0, size: int = 64, curves: int = 6, axes: int = 12, bits: int = 5, reach: int | None = None, seed: int = 7) -> DataFrame:
    """id, other, cosine and rank of the k rows most similar to each row: of all rows, or with a ``reach`` as far as the curves show them.

    With a reach the method is shifted space-filling curves. Each of ``curves`` random projections
    to ``axes`` coordinates, with its own shift, puts all rows on one Hilbert
    curve; the curves are range-partitioned in one exchange and sorted, and
    each row is compared with the ``reach`` rows before and after it. The k
    best of all windows remain, with exact cosines. ``min_cosine`` is pushed
    into the windows: pairs below it are never emitted. It also tells crowds: a
    row that met k rows of at least that cosine is compared with all
    rows that met any (see _with_crowds), however many are alike.

    Recall of the curves falls with the angle: near copies are next to each other on nearly
    every curve, the nearest of unrelated vectors often are not. Rows at the border of two range partitions meet on other
    curves, whose borders lie elsewhere; partitions follow the number of rows.

    Without a reach every row is compared with every other, in blocks, so the
    result is exact and the work grows as the square of the rows. Unrelated
    vectors have their nearest almost at random, and no window of a fixed size
    finds them; figures are in the README.

    Rows with a null, wrongly sized, all-zero or non-finite vector, or a null
    id, are left out. A row delivered twice counts once. On the way rows go by a
    64-bit hash of their id, which also breaks ties.
    Needs ``id`` (string) and ``embedding``; other columns are not carried.
    """
    if axes * bits > 63:
        raise ValueError("axes * bits must be at most 63")
    known = rows.where("id IS NOT NULL AND embedding IS NOT NULL").select("id", "embedding", F.xxhash64("id").alias("h"))
    vectors = known.select("h", "embedding")
    least = min_cosine - 1e-6 if min_cosine > -1 else -1.5
    if reach is None:
        met = _exhaustive(vectors, size, k, least)
    else:
        keyed = vectors.mapInArrow(lambda it: _keys(it, size, curves, axes, bits, seed), _KEYED)
        parts = curves * max(1, -(-rows.count() // _ROWS_A_TASK))
        placed = keyed.repartitionByRange(parts, "curve", "place", "h").sortWithinPartitions("curve", "place", "h").select("curve", "h", "vector")
        met = placed.mapInArrow(lambda it: _window(it, size, k, reach, least, 512), _FOUND)
    met = met.where((F.col("cosine") >= min_cosine) & (F.col("h") != F.col("other"))).groupBy("h", "other").agg(F.max("cosine").alias("cosine"))
    if reach is not None and min_cosine > -1:
        met = _with_crowds(met, vectors, size, k, least).where(F.col("cosine") >= min_cosine)
    by = Window.partitionBy("h").orderBy(F.desc("cosine"), "other")
    best = met.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    names = known.select("h", "id").distinct()
    return best.join(names, "h").join(names.select(F.col("h").alias("other"), F.col("id").alias("name")), "other").select("id", F.col("name").alias("other"), "cosine", "rank")


def similar_pairs(rows: DataFrame, min_cosine: float = 0.9, k: int = 5, reach: int | None = 512, **options: int) -> DataFrame:
    """Pairs id_a < id_b with a cosine of at least ``min_cosine``, where one is among the k nearest of the other; cases and method as in nearest."""
    found = nearest(rows, k, min_cosine, reach=reach, **options)
    return found.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
