"""Assumptions of methods: looking them up in the graph and in a cache, joining both, and storing new ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.tables import merge_rows

#: Importance and its order.
IMPORTANCE = ["critical", "standard", "technical"]


def find_method(concepts: DataFrame, aliases: DataFrame, name: str) -> DataFrame:
    """The method of a name: by canonical name, name or alias in any case, then by the table of aliases (alias, concept_id)."""
    t = F.lower(F.lit(name))
    held = F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(a) == t)
    kind = F.when(F.lower("canonical_name") == t, 0).when(F.lower("name") == t, 1).when(held, 2)
    direct = concepts.where(F.col("concept_type") == "METHOD").select("id", kind.alias("kind")).where("kind IS NOT NULL")
    other = aliases.where(F.lower("alias") == t).select(F.col("concept_id").alias("id"), F.lit(3).alias("kind"))
    return direct.unionByName(other).orderBy("kind", "id").limit(1)


def assumptions_in_graph(edges: DataFrame, concepts: DataFrame, domain: str | None = None, keep_unknown: bool = True) -> DataFrame:
    """method, assumption, name, importance and strength: REQUIRES edges to assumptions are critical, USES edges standard. With a domain only its assumptions, and those of none if ``keep_unknown``."""
    rows = concepts.where(F.col("concept_type") == "ASSUMPTION")
    if domain is not None:
        fits = F.col("domain_id") == domain
        rows = rows.where(fits | F.col("domain_id").isNull() if keep_unknown else fits)
    ends = rows.select(F.col("id").alias("assumption"), "name")
    kept = edges.where(F.col("type").isin("REQUIRES", "USES")).select(F.col("src").alias("method"), F.col("dst").alias("assumption"), "type", "strength")
    met = kept.join(ends, "assumption").groupBy("method", "assumption", "name").agg(F.min(F.when(F.col("type") == "REQUIRES", 0).otherwise(1)).alias("k"), F.max("strength").alias("strength"))
    return met.select("method", "assumption", "name", F.when(F.col("k") == 0, "critical").otherwise("standard").alias("importance"), "strength")


def audited(graph: DataFrame, cached: DataFrame, few: int = 3) -> DataFrame:
    """Assumptions of both origins by method and name in any case; cached texts enrich those of the graph, importance comes from the cache where it has one.

    ``origin`` is graph, cache or both; ``needs_more`` marks methods with fewer
    than ``few`` assumptions, for which a model would be asked.
    """
    g = graph.groupBy("method", F.lower("name").alias("key")).agg(F.min_by("importance", F.array_position(F.array(*map(F.lit, IMPORTANCE)), F.col("importance"))).alias("g_importance"), F.min("name").alias("g_name"))
    c = cached.groupBy("method", F.lower("name").alias("key")).agg(F.max("importance").alias("c_importance"), F.max("statement").alias("statement"), F.min("name").alias("c_name"))
    rows = g.join(c, ["method", "key"], "full_outer")
    origin = F.when(F.col("g_name").isNull(), "cache").when(F.col("c_name").isNull(), "graph").otherwise("both")
    rows = rows.select("method", F.coalesce("g_name", "c_name").alias("name"), F.coalesce("c_importance", "g_importance").alias("importance"), "statement", origin.alias("origin"))
    counts = rows.groupBy("method").agg(F.count("*").alias("n"))
    return rows.join(counts, "method").withColumn("needs_more", F.col("n") < few).drop("n")


def cache_assumptions(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache with fresh rows merged in by (method, name): texts stay where the new ones are null, importance and confidence are replaced."""
    new = {c: F.coalesce(f"new_{c}", f"old_{c}") for c in cache.columns if c not in ("method", "name")}
    return merge_rows(cache, fresh, ["method", "name"], new)


def by_importance(rows: DataFrame) -> DataFrame:
    """Rows in the order critical, standard, technical, then by name."""
    place = F.array_position(F.array(*map(F.lit, IMPORTANCE)), F.col("importance"))
    return rows.orderBy("method", F.when(place == 0, 9).otherwise(place), "name")
