"""Measures of retrieval, linking and extraction against expected results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_hits(results: DataFrame, targets: DataFrame) -> DataFrame:
    """query and the least rank of any of its targets; null where none was returned. Results are (query, id, rank), targets (query, id)."""
    met = results.join(targets.distinct(), ["query", "id"]).groupBy("query").agg(F.min("rank").alias("hit_rank"))
    return targets.select("query").distinct().join(met, "query", "left")


def pattern_hits(results: DataFrame, cases: DataFrame) -> DataFrame:
    """query, hit_rank and passed: the first result whose title matches the case's pattern within its top k. Results are (query, title, rank), cases (query, pattern, top_k)."""
    met = results.join(cases, "query").where(F.expr("title RLIKE concat('(?i)', pattern)")).groupBy("query").agg(F.min("rank").alias("hit_rank"))
    return cases.join(met, "query", "left").select("query", "hit_rank", F.coalesce(F.col("hit_rank") <= F.col("top_k"), F.lit(False)).alias("passed"))


def gain_at(rank: Column, k: int) -> Column:
    """Normalised discounted gain of one relevant result: 1 / log2(rank + 1) within k, else 0."""
    return F.when(rank <= k, 1 / F.log2(rank + 1.0)).otherwise(0.0)


def retrieval_metrics(hits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Hit rates at 5 and 10, both mean reciprocal ranks (over hits only, over all queries) and gains at 5 and 10."""
    r = F.col("hit_rank")
    return hits.groupBy(*(by or [])).agg(
        F.count("*").alias("queries"),
        F.avg(F.coalesce((r <= 5).cast("double"), F.lit(0.0))).alias("hit_5"),
        F.avg(F.coalesce((r <= 10).cast("double"), F.lit(0.0))).alias("hit_10"),
        F.avg(1.0 / r).alias("mrr_hits_only"),
        F.avg(F.coalesce(1.0 / r, F.lit(0.0))).alias("mrr_all"),
        F.avg(gain_at(r, 5)).alias("ndcg_5"),
        F.avg(gain_at(r, 10)).alias("ndcg_10"),
    )


def set_metrics(expected: DataFrame, found: DataFrame, keys: list[str], by: list[str], weight: Column | None = None) -> DataFrame:
    """Precision, recall, F1 and weighted recall of found against expected keys, for each value of ``by``."""
    e = expected.select(*keys, *[c for c in by if c not in keys], (F.lit(1.0) if weight is None else weight).alias("__w")).dropDuplicates(keys)
    f = found.select(*keys).distinct().withColumn("__f", F.lit(1))
    rows = e.join(f, keys, "full_outer")
    out = rows.groupBy(*by).agg(F.count_if(F.col("__w").isNotNull() & F.col("__f").isNotNull()).alias("hits"), F.count("__w").alias("expected"), F.count("__f").alias("found"), F.sum(F.when(F.col("__f").isNotNull(), F.col("__w"))).alias("__hit"), F.sum("__w").alias("__all"))
    p, r = F.coalesce(F.try_divide("hits", "found"), F.lit(0.0)), F.coalesce(F.try_divide("hits", "expected"), F.lit(0.0))
    return out.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))).withColumn("weighted_recall", F.coalesce(F.try_divide("__hit", "__all"), F.lit(0.0))).drop("__hit", "__all")


def precision_at_confidence(found: DataFrame, cuts: list[float]) -> DataFrame:
    """Precision of found rows (correct boolean, confidence) at or above each cut."""
    rows = found.withColumn("cut", F.explode(F.array(*map(F.lit, cuts)))).where(F.col("confidence") >= F.col("cut"))
    return rows.groupBy("cut").agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("precision"))


def expected_edges(expected: DataFrame, edges: DataFrame) -> DataFrame:
    """Expected edges (src, dst, type) with status found, other_type or missing."""
    same = edges.select("src", "dst", "type").distinct().withColumn("__same", F.lit(True))
    any_ = edges.select("src", "dst").distinct().withColumn("__any", F.lit(True))
    rows = expected.join(same, ["src", "dst", "type"], "left").join(any_, ["src", "dst"], "left")
    return rows.select("src", "dst", "type", F.when(F.col("__same"), "found").when(F.col("__any"), "other_type").otherwise("missing").alias("status"))
