"""Queries of intake: rules of tables, new chunks, missing embeddings, rows of links in both directions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import ingest as I
from folioscope.operators.lineage import shared_folder
from folioscope.plans import corpus
from folioscope.plans.corpus import CHUNKS_SQL, EDGES_SQL
from folioscope.sources import schema as R
from folioscope.sources.tables import table
from folioscope.streaming import queues as Q


def chunk_rules(spark: SparkSession, folder: str) -> DataFrame:
    return R.broken_counts(corpus.chunks(spark, folder), R.rules("chunks"))


def broken_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return R.split_rows(corpus.chunks(spark, folder), R.rules("chunks"))[1].select("id", F.array_join("broken", ",").alias("broken"))


def citation_rules(spark: SparkSession, folder: str) -> DataFrame:
    return R.broken_counts(corpus.citations(spark, folder), R.rules("citations"))


def chunks_to_embed(spark: SparkSession, folder: str) -> DataFrame:
    return I.without_embedding(corpus.chunks(spark, folder)).select("id", F.length("content").alias("size"))


def embeddings_filled(spark: SparkSession, folder: str) -> DataFrame:
    c = corpus.chunks(spark, folder).select("id", "embedding")
    given = c.where("embedding IS NULL").select("id", F.array(F.lit(1.0).cast("float")).alias("embedding"))
    return I.with_embeddings(c, given).groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n"))


def new_chunks(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    known = I.new_chunks(docs.where("doc_id % 2 = 0"), docs.limit(0).select(F.col("doc_id").alias("source_id"), F.col("text").alias("content_hash")))
    return I.new_chunks(docs, known).select("source_id", "chunk_index", "content_hash", "token_count")


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    kind = table(spark, folder, "events").schema
    rows = spark.readStream.schema(kind).option("pathGlobFilter", "events*.parquet").parquet(folder)
    return rows.select(F.col("event_type").alias("method"), "user_id", F.col("ts").cast("timestamp").alias("created_at"), F.col("value").alias("duration"))


def streamed_rollup(spark: SparkSession, folder: str) -> DataFrame:
    rows = Q.settled(Q.daily_rollup(_event_stream(spark, folder)), f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}")
    return rows.select(F.col("day").cast("timestamp_ntz").alias("day"), "method", "events", F.round("total", 4).alias("total"))


def streamed_sessions(spark: SparkSession, folder: str) -> DataFrame:
    events = _event_stream(spark, folder).withColumnRenamed("created_at", "ts")
    rows = Q.settled(Q.sessions(events, "12 hours"), f"{shared_folder(spark)}/sessions-{uuid.uuid4().hex}")
    return rows.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(f"{c}_at") for c in ("start", "end")], "events")


def clean_contents(spark: SparkSession, folder: str) -> DataFrame:
    return I.cleaned(corpus.chunks(spark, folder)).select("id", "content_hash")


def hash_mismatches(spark: SparkSession, folder: str) -> DataFrame:
    c = corpus.chunks(spark, folder).where("content IS NOT NULL AND content_hash IS NOT NULL")
    return c.where(F.lower("content_hash") != F.sha2("content", 256)).select("id")


def cross_domain_concepts(spark: SparkSession, folder: str) -> DataFrame:
    """Edges between concepts of different domains, from either end of the concepts asked for."""
    e, k = corpus.edges(spark, folder), corpus.concepts(spark, folder).select("id", "domain_id", "name")
    both = e.select("src", "dst", "strength", F.lit("out").alias("direction")).unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "strength", F.lit("in").alias("direction")))
    mine = both.where("src IN (3, 4, 5)").join(k.select(F.col("id").alias("src"), F.col("domain_id").alias("mine")), "src")
    return mine.join(k.select(F.col("id").alias("dst"), F.col("domain_id").alias("other"), "name"), "dst").where("mine <> other").groupBy("src", "dst", "direction", "name").agg(F.round(F.max("strength"), 6).alias("strength"))


QUERIES = {f.__name__: f for f in (chunk_rules, broken_chunks, citation_rules, chunks_to_embed, embeddings_filled, new_chunks, streamed_rollup, streamed_sessions, clean_contents, hash_mismatches, cross_domain_concepts)}

_RULES = [
    ("content", "content IS NOT NULL AND trim(content, ' ') <> ''"),
    ("source_id", "source_id IS NOT NULL AND trim(source_id, ' ') <> ''"),
    ("embedding", "embedding IS NULL OR len(embedding) = 64"),
    ("pages", "page_start IS NULL OR page_end IS NULL OR page_end >= page_start"),
]

ORACLE = {
    "streamed_rollup": "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type AS method, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "streamed_sessions": """WITH g AS (SELECT user_id, ts, sum(CASE WHEN ts > l + INTERVAL 12 HOUR OR l IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS l FROM events))
        SELECT user_id, min(ts) AS start_at, max(ts) + INTERVAL 12 HOUR AS end_at, count(*) AS events FROM g GROUP BY user_id, s""",
    "chunk_rules": f"WITH {CHUNKS_SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS condition, count(*) FILTER (NOT coalesce({r}, false)) AS n FROM c" for n, r in _RULES),
    "broken_chunks": f"WITH {CHUNKS_SQL}, b AS (SELECT id, concat_ws(',', " + ", ".join(f"CASE WHEN NOT coalesce({r}, false) THEN '{n}' END" for n, r in _RULES) + ") AS broken FROM c) SELECT * FROM b WHERE broken <> ''",
    "citation_rules": "WITH q AS (SELECT DISTINCT ON (id) * FROM citations) SELECT 'source_id' AS condition, count(*) FILTER (coalesce(trim(source_id, ' '), '') = '') AS n FROM q UNION ALL SELECT 'raw_string', count(*) FILTER (coalesce(trim(raw_string, ' '), '') = '') FROM q UNION ALL SELECT 'confidence_score', count(*) FILTER (confidence_score NOT BETWEEN 0 AND 1) FROM q",
    "chunks_to_embed": f"WITH {CHUNKS_SQL} SELECT id, length(content) AS size FROM c WHERE embedding IS NULL AND trim(content, ' ') <> ''",
    "embeddings_filled": f"WITH {CHUNKS_SQL} SELECT CASE WHEN embedding IS NULL THEN 1 ELSE len(embedding) END AS size, count(*) AS n FROM c GROUP BY 1",
    "clean_contents": f"WITH {CHUNKS_SQL} SELECT id, sha256(replace(replace(content, chr(0), ''), chr(65533), '')) AS content_hash FROM c WHERE trim(replace(replace(content, chr(0), ''), chr(65533), ''), ' ') <> ''",
    "hash_mismatches": f"WITH {CHUNKS_SQL} SELECT id FROM c WHERE content IS NOT NULL AND lower(content_hash) <> sha256(content)",
    "cross_domain_concepts": f"""WITH {EDGES_SQL}, k AS (SELECT p_partkey AS id, 'd' || (p_size % 4) AS d, p_name AS name FROM part),
        b AS (SELECT src, dst, strength, 'out' AS direction FROM e UNION ALL SELECT dst, src, strength, 'in' FROM e)
        SELECT src, dst, direction, y.name, round(max(strength), 6) AS strength FROM b JOIN k x ON x.id = src JOIN k y ON y.id = dst WHERE src IN (3, 4, 5) AND x.d <> y.d GROUP BY ALL""",
}
