"""Counts and summaries of a corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name and n of each table, one aggregate each."""
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()]
    return reduce(DataFrame.unionAll, parts)


def grouped_counts(rows: DataFrame, by: str | Column, name: str = "kind") -> DataFrame:
    """A column's values, null included, and how often each occurs."""
    return rows.groupBy((F.col(by) if isinstance(by, str) else by).alias(name)).agg(F.count("*").alias("n"))


def confidence_bands(rows: DataFrame, column: str = "confidence_score") -> DataFrame:
    """Rows in the bands from 0.9, 0.7, 0.5 and below, with their means; unknown confidences aside."""
    c = F.col(column).cast("double")
    band = F.when(c >= 0.9, "0.9-1.0").when(c >= 0.7, "0.7-0.9").when(c >= 0.5, "0.5-0.7").otherwise("0.0-0.5")
    return rows.where(c.isNotNull()).groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.avg(c).alias("mean"))


def coverage(rows: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """One row: rows, rows whose key occurs in ``parts``, and their share."""
    done = parts.select(key).distinct().withColumn("__in", F.lit(1))
    out = rows.join(done, key, "left").agg(F.count("*").alias("rows"), F.count("__in").alias("covered"))
    return out.withColumn("share", F.coalesce(F.try_divide("covered", "rows"), F.lit(0.0)))


def domain_statistics(domains: DataFrame, sources: DataFrame, chunks: DataFrame, citations: DataFrame) -> DataFrame:
    """For each domain, its sources, chunks and citations; each table is counted before it is joined."""
    s = sources.groupBy(F.col("domain_id").alias("id")).agg(F.count("*").alias("sources"))
    c = chunks.groupBy(F.col("domain_id").alias("id")).agg(F.count_distinct("id").alias("chunks")) if "id" not in chunks.columns else chunks.select(F.col("id").alias("cid"), "domain_id").groupBy(F.col("domain_id").alias("id")).agg(F.count_distinct("cid").alias("chunks"))
    q = citations.select(F.col("id").alias("qid"), "source_id").join(sources.select(F.col("id").alias("source_id"), "domain_id"), "source_id").groupBy(F.col("domain_id").alias("id")).agg(F.count_distinct("qid").alias("citations"))
    return domains.select("id", "name").join(s, "id", "left").join(c, "id", "left").join(q, "id", "left").fillna(0, ["sources", "chunks", "citations"])


def trailing_statistics(log: DataFrame, now: str, days: int = 30) -> DataFrame:
    """For each method of a log (method, created_at, duration) in the ``days`` before ``now``: events, total, mean and longest duration, first and last time."""
    end = F.lit(now).cast("timestamp_ntz")
    rows = log.where((F.col("created_at") > end - F.make_interval(days=F.lit(days))) & (F.col("created_at") <= end))
    return rows.groupBy("method").agg(F.count("*").alias("events"), F.sum("duration").alias("total"), F.avg("duration").alias("mean"), F.max("duration").alias("longest"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


def queue_statistics(queue: DataFrame) -> DataFrame:
    """For each status of a queue (status, priority, retry_count): items, urgent ones, mean priority of pending ones and retries."""
    return queue.groupBy("status").agg(F.count("*").alias("items"), F.count_if(F.col("priority") <= 2).alias("urgent"), F.avg(F.when(F.col("status") == "pending", F.col("priority"))).alias("pending_priority"), F.sum("retry_count").alias("retries"))


def index_percentiles(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    """p50 and p95 as elements of the sorted values, not between them: places n // 2 and least(0.95 n, n - 1) from 0.

    Two windows over a group's rows; no group is collected.
    """
    order = Window.partitionBy(*by).orderBy(column)
    placed = rows.where(F.col(column).isNotNull()).select(*by, column, (F.row_number().over(order) - 1).alias("at"), F.count("*").over(Window.partitionBy(*by)).alias("n"))
    pick = lambda place: F.max(F.when(F.col("at") == place, F.col(column)))
    return placed.groupBy(*by).agg(F.max("n").alias("n"), pick(F.floor(F.col("n") / 2)).alias("p50"), pick(F.least(F.floor(F.col("n") * F.lit(0.95)), F.col("n") - 1)).alias("p95"))


def extraction_metrics(runs: DataFrame) -> DataFrame:
    """One row over extraction runs (failed boolean, n_concepts, seconds): rates of failures and empty results, concepts a run, runs a second and the alerts due (failures above 0.05, empty ones above 0.15)."""
    out = runs.agg(F.count("*").alias("runs"), F.avg(F.col("failed").cast("double")).alias("failure_rate"), F.avg(F.when(~F.col("failed"), (F.col("n_concepts") == 0).cast("double"))).alias("empty_rate"), F.avg("n_concepts").alias("concepts_per_run"), F.try_divide(F.count("*"), F.sum("seconds")).alias("runs_per_second"))
    return out.withColumn("failure_alert", F.col("failure_rate") > 0.05).withColumn("empty_alert", F.col("empty_rate") > 0.15)


def frequent_concepts(links: DataFrame, concepts: DataFrame, least: int = 3, limit: int = 50) -> DataFrame:
    """id, name and chunks of the concepts in at least ``least`` chunks, the most frequent first."""
    counts = links.groupBy(F.col("concept_id").alias("id")).agg(F.count_distinct("chunk_id").alias("chunks")).where(F.col("chunks") >= least)
    return counts.join(concepts.select("id", "name"), "id").orderBy(F.desc("chunks"), "id").limit(limit).select("id", "name", "chunks")


def known_identifiers(sources: DataFrame) -> DataFrame:
    """One row: distinct identifiers of each kind, read from JSON metadata."""
    key = lambda k: F.get_json_object("metadata", f"$.{k}")
    return sources.agg(*[F.sort_array(F.collect_set(key(k))).alias(k) for k in ("s2_paper_id", "doi", "arxiv_id")])
