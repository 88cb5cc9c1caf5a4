"""Queries of the problems, over whole tables; their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import encoding, linkage, lookalike, mixing, near_duplicates, neighbours, scans, splitting
from folioscope.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_oversized(table(spark, folder, "chunks")).where("n_pieces > 1").select("chunk_id").distinct()


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "chunks").select("id", "content", "location")
    return splitting.split_oversized(splitting.delivered_once(rows))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    links = linkage.link(table(spark, folder, "citations"), table(spark, folder, "papers"))
    return links.where("p_id IS NOT NULL").select(F.col("c_id").alias("citation_id"), F.col("p_id").alias("s2_paper_id"))


def p2_links(spark: SparkSession, folder: str) -> DataFrame:
    links = linkage.link(table(spark, folder, "citations"), table(spark, folder, "papers"))
    return links.select(F.col("c_id").alias("citation_id"), F.col("p_id").alias("s2_paper_id"), "confidence")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = neighbours.similar_pairs(table(spark, folder, "chunks"), 0.9)
    return pairs.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p3_nearest(spark: SparkSession, folder: str) -> DataFrame:
    found = neighbours.nearest(table(spark, folder, "chunks"))
    return found.select(F.col("id").alias("chunk_id"), F.col("other").alias("neighbour_id"), "rank", "cosine")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = near_duplicates.near_duplicate_pairs(table(spark, folder, "chunks"))
    return pairs.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    groups = near_duplicates.near_duplicate_groups(table(spark, folder, "chunks"))
    return groups.select(F.col("id").alias("chunk_id"), F.col("group").alias("group_id"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return scans.find_noise(table(spark, folder, "chunks"), table(spark, folder, "sources"))[0]


def p5_clean(spark: SparkSession, folder: str) -> DataFrame:
    return scans.repair(table(spark, folder, "chunks"), table(spark, folder, "sources"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.encode(table(spark, folder, "documents"))


def p7_draw(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.lookalike_pairs(table(spark, folder, "documents"))


def p8_classes(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.lookalike_classes(table(spark, folder, "documents")).withColumnRenamed("group", "group_id")


def p8_forms(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.consistent_form(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_links, p3_found, p3_nearest, p4_found, p4_groups, p5_found, p5_clean, p6_ids, p7_draw, p7_shares, p8_found, p8_classes, p8_forms)}

_WORDS = "regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+')"

ORACLE: dict[str, str] = {
    "p1_found": "SELECT DISTINCT id AS chunk_id FROM chunks WHERE length(content) > 2400",
    "p3_found": """
        WITH v AS (
            SELECT DISTINCT id, CAST(embedding AS DOUBLE[]) AS e FROM chunks
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        s AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.id <> b.id),
        r AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS n FROM s)
        SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM r WHERE n <= 5 AND c >= 0.9""",
    "p4_found": f"""
        WITH t AS (SELECT DISTINCT id, {_WORDS} AS w FROM chunks),
        g AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2]))) AS s FROM t WHERE len(w) >= 40),
        n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
        o AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.id < b.id GROUP BY a.id, b.id)
        SELECT a AS chunk_id_a, b AS chunk_id_b FROM o JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE k >= 0.6 * (x.n + y.n - k) - 1e-9""",
}
