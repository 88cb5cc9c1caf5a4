"""Problem 4: near-duplicates through prefixes under several token orders."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.operators.lineage import materialize

_WORDS = re.compile(r"[^\W_]+").findall
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_KEPT = 1_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _ODD[0]
    x = x ^ (x >> np.uint64(29))
    return x * _ODD[1]


class _Words:
    """64-bit hashes of the words a worker has met."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def of(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > _KEPT:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_sets(texts: list[str], width: int, least_words: int, words: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts of at least ``least_words`` words; the sorted sets of hashed word sequences of those, flat; and their sizes."""
    found: list[str] = []
    counts = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        own = _WORDS(text.lower())
        if len(own) >= max(least_words, width):
            found += own
            counts[k] = len(own)
    rows = np.flatnonzero(counts)
    counts = counts[rows]
    hashes = words.of(found)
    n = len(hashes) - width + 1
    if n <= 0:
        return rows, np.empty(0, np.uint64), np.zeros(len(rows), np.int64)
    shingles = np.zeros(n, np.uint64)
    for k in range(width):
        shingles = _mix(shingles ^ hashes[k : k + n] * _ODD[2]) + np.uint64(k)
    owner = np.repeat(np.arange(len(rows)), counts)
    inside = owner[:n] == owner[width - 1 :]
    owner, shingles = owner[:n][inside], shingles[inside]
    order = np.lexsort((shingles, owner))
    owner, shingles = owner[order], shingles[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (shingles[1:] != shingles[:-1])
    return rows, shingles[new], np.bincount(owner[new], minlength=len(rows))


def _prefix_keys(sets: np.ndarray, sizes: np.ndarray, groups: int, orders: int) -> np.ndarray:
    """One key a group: the first tokens of each set under the group's token orders, joined.

    An order ranks all tokens by a hash of its own, so it is global. Two sets
    have equal keys if they share the prefix token under every order of the
    group: the intersection of the filters. No order serves two groups, so
    the groups meet a pair independently of each other.
    """
    starts = np.cumsum(sizes) - sizes
    keys = np.zeros((len(sizes), groups), np.uint64)
    # Tokens are hashes already: half of one, times an odd number of the order's own, ranks them.
    tokens = (sets >> np.uint64(32)).astype(np.uint32)
    odd = np.random.default_rng(5).integers(0, 1 << 32, groups * orders, np.uint32) | np.uint32(1)
    ranks = np.empty_like(tokens)
    for g in range(groups):
        key = np.full(len(sizes), g, np.uint64)
        for o in range(g * orders, (g + 1) * orders):
            np.multiply(tokens, odd[o], out=ranks)
            key = _mix(key ^ np.minimum.reduceat(ranks, starts).astype(np.uint64))
        keys[:, g] = key
    return keys


def _classes(batches: Iterator[pa.RecordBatch], width: int, least_words: int, groups: int = 0, orders: int = 0) -> Iterator[pa.RecordBatch]:
    """id, class and 128-bit digest of each row's set; with groups, instead class and keys, once for each class of a task."""
    words, met = _Words(), set()
    for batch in batches:
        rows, sets, sizes = shingle_sets(batch.column(1).to_pylist(), width, least_words, words)
        if not len(rows):
            continue
        ends = np.cumsum(sizes)
        class_ = np.fromiter((xxhash.xxh3_64_intdigest(sets[e - s : e].tobytes()) for s, e in zip(sizes, ends, strict=True)), np.uint64, len(sizes)).view(np.int64)
        if not groups:
            digests = [xxhash.xxh3_128_digest(sets[e - s : e].tobytes()) for s, e in zip(sizes, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(class_), pa.array(digests, pa.binary())], ["id", "class", "digest"])
            continue
        if len(met) > _KEPT:
            met.clear()
        fresh = np.array([c not in met and not met.add(c) for c in class_.tolist()], bool)
        sets, sizes, class_ = sets[np.repeat(fresh, sizes)], sizes[fresh], class_[fresh]
        if len(sizes):
            keys = _prefix_keys(sets, sizes, groups, orders)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(class_, groups)), pa.array(keys.ravel().view(np.int64))], ["class", "key"])


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    words = _Words()
    for batch in batches:
        rows, sets, sizes = shingle_sets(batch.column(1).to_pylist(), width, width, words)
        ends = np.cumsum(sizes)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([sets[e - s : e].tobytes() for s, e in zip(sizes, ends, strict=True)], pa.binary())], ["id", "tokens"])


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = np.zeros(batch.num_rows)
        for k, (a, b) in enumerate(zip(batch.column("tokens_a"), batch.column("tokens_b"), strict=True)):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (a, b))
            shared = len(np.intersect1d(x, y, True))
            scores[k] = shared / (len(x) + len(y) - shared)
        good = pa.array(np.flatnonzero(scores >= threshold - 1e-12))
        yield pa.RecordBatch.from_arrays([batch.column("a").take(good), batch.column("b").take(good), pa.array(scores).take(good)], ["a", "b", "jaccard"])


def _texts(rows: DataFrame) -> DataFrame:
    return rows.select("id", "content").where("id IS NOT NULL AND content IS NOT NULL")


def _classed(texts: DataFrame, width: int, least_words: int) -> tuple[DataFrame, DataFrame]:
    """Members (id, head) of the classes of equal sets, and heads (class, head). Sets are equal by 128-bit digest; ``class`` is a shorter hash that only brings candidates together."""
    classed = materialize(texts.mapInArrow(lambda it: _classes(it, width, least_words), "id string, class bigint, digest binary"), "classed")
    heads = materialize(classed.groupBy("digest").agg(F.min("id").alias("head"), F.min("class").alias("class")), "heads")
    return classed.join(heads.select("digest", "head"), "digest").select("id", "head").distinct(), heads.select("class", "head")


def _posted(texts: DataFrame, width: int, least_words: int, groups: int, orders: int) -> DataFrame:
    """key and class of the classes that share a key with another."""
    by = Window.partitionBy("key")
    posted = texts.mapInArrow(lambda it: _classes(it, width, least_words, groups, orders), "class bigint, key bigint")
    posted = posted.withColumn("least", F.min("class").over(by)).withColumn("most", F.max("class").over(by)).where("least < most").select("key", "class").distinct()
    return materialize(posted, "posted")


def _token_sets(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    sets = texts.join(wanted, "id", "left_semi").dropDuplicates(["id"]).mapInArrow(lambda it: _sets(it, width), "id string, tokens binary")
    return materialize(sets, "sets")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """a, b and jaccard of those pairs (a, b) whose whole sets reach the threshold."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("tokens_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("tokens_b")), "b")
    return both.mapInArrow(lambda it: _verify(it, threshold), "a string, b string, jaccard double")


def _tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat = [np.frombuffer(v.as_buffer(), np.int64) for v in batch.column(1)]
        ends = np.cumsum([0, *map(len, flat)], dtype=np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat) if flat else np.empty(0, np.int64)))], ["head", "tokens"])


def _prefix_pairs(texts: DataFrame, heads: DataFrame, threshold: float, width: int, orders: int) -> DataFrame:
    """Candidates (a, b) of heads by full-length prefixes, exactly: two sets that reach the threshold share a token of both prefixes under every order.

    The first order is by rarity; its matches must be able to reach the
    threshold by their sizes and places. What is left must share a token in
    the prefixes under ``orders`` - 1 hashed orders as well.
    """
    tokens = _token_sets(texts, heads.select(F.col("head").alias("id")), width).mapInArrow(_tokens_of, "head string, tokens array<bigint>")
    tokens = materialize(tokens, "tokens")
    length = F.size("tokens") - F.ceil(F.size("tokens") * threshold - 1e-9) + 1
    each = tokens.select("head", F.size("tokens").alias("n"), length.alias("p"), F.explode("tokens").alias("token"))
    df = each.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    by = Window.partitionBy("head").orderBy("df", "token")
    # Tokens of one set only come first in the order and match nothing: they are counted, not joined.
    shared = each.join(df, "token")
    alone = shared.groupBy("head").agg(F.count("*").alias("met"))
    ranked = shared.withColumn("at", F.row_number().over(by)).join(alone, "head").withColumn("at", F.col("at") + F.col("n") - F.col("met")).where(F.col("at") <= F.col("p"))
    prefix = materialize(ranked.select("token", "head", "n", "at"), "prefixes")
    x, y = (prefix.select("token", *[F.col(c).alias(f"{c}_{e}") for c in ("head", "n", "at")]) for e in "ab")
    met = x.join(y, "token").where("head_a < head_b").where((F.col("n_a") >= threshold * F.col("n_b") - 1e-9) & (F.col("n_b") >= threshold * F.col("n_a") - 1e-9))
    pairs = met.groupBy("head_a", "head_b", "n_a", "n_b").agg(F.count("*").alias("k"), F.max("at_a").alias("i"), F.max("at_b").alias("j"))
    most = F.col("k") + F.least(F.col("n_a") - F.col("i"), F.col("n_b") - F.col("j"))
    pairs = pairs.where(most >= F.lit(threshold / (1 + threshold)) * (F.col("n_a") + F.col("n_b")) - 1e-9).select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    for o in range(1, orders):
        under = tokens.select("head", F.slice(F.array_sort(F.transform("tokens", lambda t: F.xxhash64(t, F.lit(o)))), 1, length).alias("prefix"))  # noqa: B023
        pairs = pairs.join(under.toDF("a", "prefix_a"), "a").join(under.toDF("b", "prefix_b"), "b").where(F.arrays_overlap("prefix_a", "prefix_b")).select("a", "b")
    return pairs


def near_duplicate_classes(rows: DataFrame, threshold: float = 0.6, width: int = 3, least_words: int = 40, groups: int = 150, orders: int = 5, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Members (id, head) of the classes of equal shingle sets, and links (a, b, jaccard) between heads a < b of at least ``threshold``.

    Method: multiple global orders. Every set is filtered by its prefix under
    ``groups`` x ``orders`` global token orders, each of one group only;
    candidates share the prefix token under all orders of at least one group,
    and are then verified on the whole sets. A pair of similarity s is missed
    with (1 - s^orders)^groups, for 150 groups of 5 orders 0.000005 at 0.6
    and less than 0.0000001 from 0.65 on. ``exact`` takes full-length
    prefixes under three orders instead, which miss nothing (see _prefix_pairs), but make posting lists that grow as the
    square of a corpus whose vocabulary is exhausted; figures in the README.

    Equal sets are one class before the filter, however many copies there are:
    a task emits a class's keys once, so copies never meet in a group. Each
    key's rows are spread by the join, a key is never collected. Null ids and contents and those of fewer than
    ``least_words`` words belong to no class. A row delivered twice counts once.
    """
    texts = _texts(rows)
    members, heads = _classed(texts, width, least_words)
    if exact:
        pairs = materialize(_prefix_pairs(texts, heads, threshold, width, 3), "candidates")
    else:
        posted = _posted(texts, width, least_words, groups, orders)
        pairs = posted.withColumnRenamed("class", "a").join(posted.withColumnRenamed("class", "b"), "key").where("a < b").select("a", "b").distinct()
        named = heads.join(posted.select("class").distinct(), "class")
        pairs = pairs.join(named.toDF("a", "x"), "a").join(named.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        pairs = materialize(pairs, "candidates")
    sets = _token_sets(texts, pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), width)
    return members, materialize(_verified(pairs, sets, threshold), "links")


def near_duplicate_pairs(rows: DataFrame, **options: float) -> DataFrame:
    """All pairs id_a < id_b of near-duplicate rows, copies included; see near_duplicate_classes for cases."""
    members, links = near_duplicate_classes(rows, **options)
    one = members.select(F.col("id").alias("x"), F.col("head").alias("a"))
    two = members.select(F.col("id").alias("y"), F.col("head").alias("b"))
    across = links.select("a", "b").join(one, "a").join(two, "b").select("x", "y")
    crowded = members.groupBy("head").agg(F.count("*").alias("n")).where("n > 1").select("head")
    copies = members.join(crowded, "head", "left_semi")
    within = copies.select("head", F.col("id").alias("x")).join(copies.select("head", F.col("id").alias("y")), "head").where("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def _components(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels (head, label) after links (a, b): of all that are linked over any number of steps the least label.

    The least label of the neighbours spreads with pointer jumping over tables in the
    shared folder, so rounds grow with the logarithm of a chain, and no links reach the driver.
    """
    ends = links.join(labels.toDF("a", "x"), "a").join(labels.toDF("b", "y"), "b").where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    edges = materialize(ends.union(ends.select("y", "x")).toDF("a", "b"), "edges")
    roots = written = materialize(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")), "roots")
    while True:
        best = edges.join(roots.toDF("b", "near"), "b").groupBy("a").agg(F.min("near").alias("near"))
        jump = roots.toDF("root", "far")
        step = roots.join(best, "a").join(jump, "root", "left").select("a", F.least("root", "near", "far").alias("new"), "root")
        step = written = materialize(step, "roots", written)
        roots = step.select("a", F.col("new").alias("root"))
        if not step.where("new <> root").limit(1).count():
            break
    return labels.join(roots.toDF("label", "root"), "label", "left").select("head", F.coalesce("root", "label").alias("label"))


def near_duplicate_groups(rows: DataFrame, threshold: float = 0.6, width: int = 3, least_words: int = 40, groups: int = 150, orders: int = 5) -> DataFrame:
    """id and ``group``, the least id linked with it over any number of steps; rows in no class have no row here. Cases and candidates as in near_duplicate_classes.

    Not all pairs of a crowded key are verified, as a group needs only links
    that hold it together. In each round every key's members meet one of them,
    another one each round, unless they are of one group already; when what is
    left to compare is little, or a round spares less than a third of it, all pairs of different groups
    that share a key are verified. So every candidate pair is either verified
    or within a group, and rounds grow with the logarithm of the pairs.
    """
    texts = _texts(rows)
    members, heads = _classed(texts, width, least_words)
    posted = _posted(texts, width, least_words, groups, orders)
    posted = materialize(posted.join(heads, "class").select("key", "head"), "posted", posted)
    sets = _token_sets(texts, posted.select(F.col("head").alias("id")).distinct(), width)
    labels = written = materialize(posted.select("head").distinct().withColumn("label", F.col("head")), "labels")
    few, turn, before = 4 * posted.count(), 0, float("inf")
    while True:
        at = posted.join(labels, "head")
        kept = at.groupBy("key", "label").agg(F.count("*").alias("n"))
        left = kept.groupBy("key").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("same")).where("all * all > same")
        cross = left.agg(F.coalesce(F.sum(F.col("all") * F.col("all") - F.col("same")), F.lit(0)) / 2).first()[0]
        if not cross:
            break
        apart = at.join(left.select("key"), "key", "left_semi")
        last = cross <= few or cross > 0.7 * before
        if last:
            one, two = kept.join(left.select("key"), "key").select("key", F.col("label").alias("x")), kept.select("key", F.col("label").alias("y"))
            both = one.join(two, "key").where("x < y")
            pairs = both.join(apart.select("key", F.col("label").alias("x"), F.col("head").alias("a")), ["key", "x"]).join(apart.select("key", F.col("label").alias("y"), F.col("head").alias("b")), ["key", "y"])
        else:
            center = apart.groupBy("key").agg(F.min_by(F.struct("head", "label"), F.xxhash64("head", F.lit(turn))).alias("c"))
            pairs = apart.join(center, "key").where("label <> c.label").select(F.col("head").alias("a"), F.col("c.head").alias("b"))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        links = materialize(_verified(pairs, sets, threshold), "links")
        if links.limit(1).count():
            labels = written = materialize(_components(links, labels), "labels", written)
        if last:
            break
        turn, before = turn + 1, cross
    return members.join(labels, "head", "left").select("id", F.coalesce("label", "head").alias("group"))
