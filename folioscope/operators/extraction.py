"""Steps of extracting concepts: what is still to be done, what is kept, and how it enters the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import canonical_name, clean, jaccard
from folioscope.functions.vectors import cosine
from folioscope.operators.quality import nearest_between, orphans
from folioscope.operators.tables import insert_new, latest


def to_process(chunks: DataFrame, links: DataFrame, domain: str | None = None, least: int = 100) -> DataFrame:
    """Chunks without links yet, of a domain if given, with at least ``least`` characters."""
    rows = chunks.where(F.length("content") >= least)
    if domain is not None:
        rows = rows.where(F.col("domain_id") == domain)
    return rows.join(links.select(F.col("chunk_id").alias("id")), "id", "left_anti")


def kept_concepts(extracted: DataFrame, least: float = 0.7) -> DataFrame:
    """Extracted concepts (chunk_id, name, aliases, confidence) of enough confidence and a name, cleaned."""
    return extracted.where(F.col("confidence") >= least).withColumn("name", clean("name")).where("name <> ''")


def kept_relations(relations: DataFrame, concepts: DataFrame) -> DataFrame:
    """Relations (chunk_id, source, target) whose ends are both names or aliases extracted from their chunk, no loops."""
    names = concepts.select("chunk_id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n")).select("chunk_id", F.lower("n").alias("n")).distinct()
    rows = relations
    for end in ("source", "target"):
        rows = rows.withColumn("n", F.lower(clean(end))).join(names, ["chunk_id", "n"], "left_semi").drop("n")
    return rows.where(F.lower("source") != F.lower("target"))


def stored(concepts: DataFrame, extracted: DataFrame) -> DataFrame:
    """Concepts (canonical_name, name) with the new ones of an extraction; a canonical name enters once, under its least name."""
    fresh = extracted.withColumn("canonical_name", canonical_name("name")).where("canonical_name <> ''")
    return insert_new(concepts.select("canonical_name", "name"), latest(fresh, ["canonical_name"], [F.col("name")]).select("canonical_name", "name"), ["canonical_name"])


def concept_similarity(a: DataFrame, b: DataFrame, on: Column) -> DataFrame:
    """a_id, b_id and similarity: equal canonical names 1, a shared alias 0.95, the cosine of their vectors, else the Jaccard of their words. ``on`` joins the sides, whose columns begin with a_ and b_."""
    pairs = a.select(*[F.col(c).alias(f"a_{c}") for c in ("id", "name", "aliases", "embedding")]).join(b.select(*[F.col(c).alias(f"b_{c}") for c in ("id", "name", "aliases", "embedding")]), on)
    forms = lambda s: F.concat(F.array(canonical_name(f"{s}_name")), F.transform(F.coalesce(f"{s}_aliases", F.array().cast("array<string>")), lambda x: F.lower(x)))
    words = lambda s: F.array_distinct(F.split(canonical_name(f"{s}_name"), " "))
    value = F.when(canonical_name("a_name") == canonical_name("b_name"), 1.0).when(F.arrays_overlap(forms("a"), forms("b")), 0.95).otherwise(F.coalesce(cosine("a_embedding", "b_embedding"), jaccard(words("a"), words("b"))))
    return pairs.select("a_id", "b_id", value.alias("similarity"))


def relinked(concepts: DataFrame, edges: DataFrame, threshold: float = 0.8, most: int = 3) -> DataFrame:
    """src, dst, type RELATED_TO and strength: orphans and up to ``most`` of the connected concepts nearest to them, by the cosine."""
    lost = orphans(concepts, edges)
    linked = concepts.join(lost.select("id"), "id", "left_anti")
    near = nearest_between(lost.select("id", "embedding"), linked.select("id", "embedding"), threshold, most)
    return near.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("RELATED_TO").alias("type"), F.col("cosine").alias("strength"))


def matched_seeds(seeds: DataFrame, concepts: DataFrame) -> DataFrame:
    """seed, id and confidence: by canonical name (1.0), else by any alias (0.9), the least id of several."""
    s = seeds.select("seed", canonical_name("seed").alias("key"), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(a)).alias("forms"))
    exact = s.join(concepts.select("id", F.col("canonical_name").alias("key")), "key").select("seed", "id", F.lit(1.0).alias("confidence"))
    named = concepts.select("id", F.explode(F.concat(F.array("canonical_name"), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(a)))).alias("form"))
    alias = s.select("seed", F.explode("forms").alias("form")).join(named, "form").select("seed", "id", F.lit(0.9).alias("confidence"))
    best = exact.unionByName(alias).groupBy("seed").agg(F.min(F.struct(-F.col("confidence"), "id")).alias("b"))
    return seeds.select("seed").join(best.select("seed", F.col("b.id").alias("id"), (-F.col("b.col1")).alias("confidence")), "seed", "left")


def domains_by_keywords(chunks: DataFrame, rules: list[tuple[str, list[str]]], other: str = "general") -> DataFrame:
    """source_id and domain: the first rule of which the source's first chunk has a keyword."""
    first = chunks.groupBy("source_id").agg(F.min_by("content", F.struct(F.coalesce("page_start", F.lit(1 << 30)), "created_at", "id")).alias("text"))
    text = F.lower(F.coalesce("text", F.lit("")))
    domain = F.lit(other)
    for name, keywords in reversed(rules):
        domain = F.when(reduce(Column.__or__, [F.contains(text, F.lit(k.lower())) for k in keywords]), name).otherwise(domain)
    return first.select("source_id", domain.alias("domain"))


def keywords_in(text: Column, keywords: list[str]) -> Column:
    """The keywords that a text contains, in any case."""
    return F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.lower(text), F.lower(k)))


def centroid_neighbours(rows: DataFrame, wanted: DataFrame, unwanted: DataFrame, limit: int = 10, size: int = 64) -> DataFrame:
    """id and score of rows (id, embedding) near the mean of the wanted and away from that of the unwanted (id); given rows are left out."""
    mean = lambda ids, name: rows.join(ids.select("id"), "id", "left_semi").agg(F.array(*[F.avg(F.col("embedding")[i]) for i in range(size)]).alias(name))
    free = rows.join(wanted.select("id").unionByName(unwanted.select("id")), "id", "left_anti")
    means = mean(wanted, "plus").crossJoin(mean(unwanted, "minus"))
    score = F.coalesce(cosine("embedding", "plus"), F.lit(0.0)) - 0.5 * F.coalesce(cosine("embedding", "minus"), F.lit(0.0))
    return free.crossJoin(F.broadcast(means)).select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(limit)
