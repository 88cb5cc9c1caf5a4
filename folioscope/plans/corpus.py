"""Corpus views over the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import canonical_name
from folioscope.sources.tables import table


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks, each delivered once."""
    return table(spark, folder, "chunks").dropDuplicates(["id"])


def citations(spark: SparkSession, folder: str) -> DataFrame:
    """Citations, each delivered once."""
    return table(spark, folder, "citations").dropDuplicates(["id"])


def concepts(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as concepts: type by brand, domain by size."""
    p = table(spark, folder, "part")
    kinds = F.array(*map(F.lit, ("METHOD", "ASSUMPTION", "PROBLEM", "DEFINITION", "THEOREM")))
    return p.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        canonical_name("p_name").alias("canonical_name"),
        F.array("p_brand", "p_type").alias("aliases"),
        F.get(kinds, (F.col("p_partkey") % 5).cast("int")).alias("concept_type"),
        F.concat(F.lit("d"), F.col("p_size") % 4).alias("domain_id"),
        (F.col("p_retailprice") / 2500).alias("confidence_score"),
    )


TYPES = ("REQUIRES", "USES", "ADDRESSES", "EXTENDS", "SPECIALIZES", "ALTERNATIVE_TO", "RELATED_TO")


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """Concept edges: from a line's part to one named by its order, its type by the supplier, the strongest of parallel ones."""
    line = table(spark, folder, "lineitem")
    parts = table(spark, folder, "part").agg(F.max("p_partkey").alias("n"))
    kind = F.get(F.array(*map(F.lit, TYPES)), (F.col("l_suppkey") % 7).cast("int"))
    rows = line.crossJoin(F.broadcast(parts)).select(F.col("l_partkey").alias("src"), (F.col("l_orderkey") % F.col("n") + 1).alias("dst"), kind.alias("type"), (1 - F.col("l_discount")).alias("strength"))
    return rows.where("src <> dst").groupBy("src", "dst", "type").agg(F.max("strength").alias("strength"))


EDGES_SQL = """e AS (
    SELECT src, dst, type, max(strength) AS strength FROM (
        SELECT l_partkey AS src, l_orderkey % (SELECT max(p_partkey) FROM part) + 1 AS dst,
            ['REQUIRES', 'USES', 'ADDRESSES', 'EXTENDS', 'SPECIALIZES', 'ALTERNATIVE_TO', 'RELATED_TO'][CAST(l_suppkey % 7 AS INT) + 1] AS type, 1 - l_discount AS strength
        FROM lineitem) WHERE src <> dst GROUP BY ALL)"""

WEIGHT_SQL = "CASE type WHEN 'REQUIRES' THEN 1.0 WHEN 'EXTENDS' THEN 0.9 WHEN 'USES' THEN 0.8 WHEN 'ADDRESSES' THEN 0.7 WHEN 'SPECIALIZES' THEN 0.6 WHEN 'GENERALIZES' THEN 0.6 WHEN 'ALTERNATIVE_TO' THEN 0.5 WHEN 'RELATED_TO' THEN 0.4 ELSE 0.5 END"


def links(spark: SparkSession, folder: str) -> DataFrame:
    """Concepts in chunks: orders as chunks, their parts as concepts."""
    line = table(spark, folder, "lineitem")
    mention = F.get(F.array(F.lit("defines"), F.lit("reference"), F.lit("example")), (F.col("l_linenumber") % 3).cast("int"))
    return line.select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("concept_id"), mention.alias("mention_type"), F.when(F.col("l_tax") > 0.01, F.col("l_tax") * 10).alias("relevance_score")).distinct()


LINKS_SQL = "l AS (SELECT DISTINCT l_orderkey AS chunk_id, l_partkey AS concept_id, ['defines', 'reference', 'example'][CAST(l_linenumber % 3 AS INT) + 1] AS mention_type, CASE WHEN l_tax > 0.01 THEN l_tax * 10 END AS relevance_score FROM lineitem)"


def queue(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as a queue."""
    o = table(spark, folder, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "completed").otherwise("failed")
    return o.select(F.col("o_orderkey").alias("id"), status.alias("status"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), (F.col("o_custkey") % 5).cast("int").alias("retry_count"), F.lit(None).cast("string").alias("error_message"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"))


QUEUE_SQL = "q AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'completed' ELSE 'failed' END AS status, CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority, CAST(o_custkey % 5 AS INT) AS retry_count, o_orderdate AS created_at, o_orderdate AS updated_at FROM orders)"


def log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a log of discoveries."""
    return table(spark, folder, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("method"), F.col("ts").alias("created_at"), F.col("value").alias("duration"), F.col("props").alias("metadata"), "user_id")


def references(spark: SparkSession, folder: str) -> DataFrame:
    """citing source and cited paper, by normal DOI, or title in lower case and year; null for works outside."""
    from folioscope.operators.citations import citation_edges, match_exactly

    c = citations(spark, folder)
    return citation_edges(c, match_exactly(normal_ids(c), papers(spark, folder)))


def normal_ids(rows: DataFrame) -> DataFrame:
    """DOIs without prefixes and spaces, in lower case."""
    doi = F.regexp_replace(F.regexp_replace(F.lower("doi"), r"[\s]+", ""), r"^(https?://(dx\.)?doi\.org/|doi:?)", "")
    return rows.withColumn("doi", F.regexp_replace(doi, r"\.$", ""))


def papers(spark: SparkSession, folder: str) -> DataFrame:
    """Papers at their latest acquisition, with id for s2_paper_id."""
    from folioscope.operators.discovery import current_papers

    return normal_ids(current_papers(table(spark, folder, "papers"))).withColumn("id", F.col("s2_paper_id"))


CHUNKS_SQL = "c AS (SELECT DISTINCT ON (id) * FROM chunks)"
_DOI = r"regexp_replace(regexp_replace(regexp_replace(lower(doi), '\s+', '', 'g'), '^(https?://(dx\.)?doi\.org/|doi:?)', ''), '\.$', '')"
PAPERS_SQL = f"p AS (SELECT * EXCLUDE (doi, n), {_DOI} AS doi FROM (SELECT *, row_number() OVER (PARTITION BY s2_paper_id ORDER BY acquired_at DESC NULLS LAST, citation_count DESC NULLS LAST, influential_citation_count DESC NULLS LAST) AS n FROM papers) WHERE n = 1)"
REFERENCES_SQL = f"""{PAPERS_SQL},
    c AS (SELECT DISTINCT ON (id) id, source_id, title, year, lower(arxiv_id) AS arxiv_id, {_DOI} AS doi FROM citations),
    k AS (
        SELECT c.id, s2_paper_id, 0 AS r FROM c JOIN p ON c.doi = p.doi
        UNION ALL SELECT c.id, s2_paper_id, 1 FROM c JOIN p ON c.arxiv_id = lower(p.arxiv_id)
        UNION ALL SELECT c.id, s2_paper_id, 2 FROM c JOIN p ON lower(trim(c.title)) = lower(trim(p.title)) AND c.year IS NOT DISTINCT FROM p.year),
    b AS (SELECT id, first(s2_paper_id ORDER BY r, s2_paper_id) AS cited FROM k GROUP BY id),
    f AS (SELECT source_id AS citing, cited, c.id AS citation_id FROM c LEFT JOIN b USING (id))"""
