"""Finding papers to acquire: filters, topics, walks along citations, and the queue of what to fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.lineage import materialize
from folioscope.operators.tables import latest


def current_papers(papers: DataFrame) -> DataFrame:
    """The latest acquisition of each paper."""
    return latest(papers, ["s2_paper_id"], [F.desc_nulls_last("acquired_at"), F.desc_nulls_last("citation_count"), F.desc_nulls_last("influential_citation_count")])


def paper_filter(papers: DataFrame, min_citations: int = 0, min_influential: int = 0, open_access: bool = False, fields: list[str] | None = None, years: tuple[int, int] | None = None, known: DataFrame | None = None) -> DataFrame:
    """Papers that meet all of the given conditions; ``known`` (s2_paper_id) are left out."""
    rows = papers.where((F.coalesce("citation_count", F.lit(0)) >= min_citations) & (F.coalesce("influential_citation_count", F.lit(0)) >= min_influential))
    if open_access:
        rows = rows.where("is_open_access")
    if fields:
        rows = rows.where(F.arrays_overlap("fields_of_study", F.array(*map(F.lit, fields))))
    if years:
        rows = rows.where(F.col("year").between(*years))
    return rows if known is None else rows.join(known.select("s2_paper_id"), "s2_paper_id", "left_anti")


def topic_papers(papers: DataFrame, topics: list[str], per_topic: int = 50) -> DataFrame:
    """s2_paper_id and topic: the most cited papers whose title or abstract has all words of a topic; a paper counts for its first topic."""
    text = F.lower(F.concat_ws(" ", "title", "abstract"))
    every = None
    for k, topic in enumerate(topics):
        fits = [F.contains(text, F.lit(w)) for w in topic.lower().split()]
        rows = papers
        for f in fits:
            rows = rows.where(f)
        rows = rows.orderBy(F.desc_nulls_last("citation_count"), "s2_paper_id").limit(per_topic).select("s2_paper_id", F.lit(k).alias("k"), F.lit(topic).alias("topic"))
        every = rows if every is None else every.unionByName(rows)
    return every.groupBy("s2_paper_id").agg(F.min_by("topic", "k").alias("topic"))


def not_acquired(papers: DataFrame, known: DataFrame) -> DataFrame:
    """Papers of which neither id, DOI nor arXiv id is known; one anti-join for each."""
    rows = papers
    for c in ("s2_paper_id", "doi", "arxiv_id"):
        ids = known.where(F.col(c).isNotNull()).select(F.lower(c).alias("__k")).distinct()
        rows = rows.join(ids, F.lower(c) == F.col("__k"), "left_anti")
    return rows


def cited_walk(seeds: DataFrame, edges: DataFrame, depth: int = 1, direction: str = "both", keep: DataFrame | None = None) -> DataFrame:
    """id and depth of what is reached from seeds (id) along citations (citing, cited), each at its least depth. Nodes that are not in ``keep`` (id) are neither returned nor walked on from, but count as seen."""
    out = edges.where("citing IS NOT NULL AND cited IS NOT NULL").select(F.col("citing").alias("a"), F.col("cited").alias("b"))
    step = {"references": out, "citations": out.select(F.col("b").alias("a"), F.col("a").alias("b")), "both": out.unionByName(out.select(F.col("b").alias("a"), F.col("a").alias("b")))}[direction]
    step = materialize(step.distinct(), "steps")
    seen, frontier, every = seeds.select("id").distinct(), seeds.select("id").distinct(), None
    for d in range(1, depth + 1):
        grown = materialize(frontier.withColumnRenamed("id", "a").join(step, "a").select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti"), "walk")
        seen = seen.unionByName(grown)
        frontier = grown if keep is None else grown.join(keep.select("id"), "id", "left_semi")
        level = frontier.withColumn("depth", F.lit(d))
        every = level if every is None else every.unionByName(level)
    return every


def pending(queue: DataFrame, limit: int = 50) -> DataFrame:
    """The next items: pending, most urgent first, then oldest, then by id."""
    return queue.where(F.col("status") == "pending").orderBy(F.desc("priority"), "created_at", "id").limit(limit)


def with_status(queue: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """The queue after changes (id, new_status, error): failures add to retry_count, changed rows are stamped."""
    rows = queue.join(changes.select("id", "new_status", F.col("error").alias("__e")), "id", "left")
    hit = F.col("new_status").isNotNull()
    return (
        rows.withColumn("status", F.coalesce("new_status", "status"))
        .withColumn("retry_count", F.col("retry_count") + F.coalesce((F.col("new_status") == "failed").cast("int"), F.lit(0)))
        .withColumn("error_message", F.when(hit, F.col("__e")).otherwise(F.col("error_message")))
        .withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at")))
        .select(*queue.columns)
    )


def retried(queue: DataFrame, most: int = 3) -> DataFrame:
    """Failed items with fewer than ``most`` retries are pending again."""
    again = (F.col("status") == "failed") & (F.col("retry_count") < most)
    return queue.withColumn("error_message", F.when(~again, F.col("error_message"))).withColumn("status", F.when(again, "pending").otherwise(F.col("status")))


def without_old(queue: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """The queue without items completed more than ``days`` ago."""
    return queue.where(~((F.col("status") == "completed") & (F.col("updated_at") < now - F.make_interval(days=F.lit(days)))))


def fresh_entries(cache: DataFrame, now: Column) -> DataFrame:
    """Entries of a cache (key, response, created_at, expires_at) that have not expired, the newest of each key."""
    return latest(cache.where(F.col("expires_at") > now), ["key"], [F.desc("created_at")])


def cache_key(endpoint: Column, parameters: Column) -> Column:
    """SHA-256 of an endpoint and its parameters (a map) in the order of their names."""
    pairs = F.array_sort(F.map_entries(parameters))
    return F.sha2(F.concat(endpoint, F.lit(":"), F.to_json(F.map_from_entries(pairs))), 256)
