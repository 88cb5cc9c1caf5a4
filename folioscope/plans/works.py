"""Queries on citations, papers and the queue of what to acquire."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import citations as C
from folioscope.operators import discovery as D
from folioscope.plans import corpus
from folioscope.plans.corpus import EDGES_SQL, PAPERS_SQL, QUEUE_SQL, REFERENCES_SQL
from folioscope.sources.tables import table

NOW = "1998-08-02 00:00:00"


def citation_matches(spark: SparkSession, folder: str) -> DataFrame:
    return C.match_to_targets(corpus.normal_ids(corpus.citations(spark, folder)), corpus.papers(spark, folder)).select("id", "target_id", "method")


def citation_edges(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.references(spark, folder)


def simple_matches(spark: SparkSession, folder: str) -> DataFrame:
    return C.match_simply(corpus.normal_ids(corpus.citations(spark, folder)), corpus.papers(spark, folder))


def pagerank(spark: SparkSession, folder: str) -> DataFrame:
    rows = C.pagerank(corpus.concepts(spark, folder), corpus.edges(spark, folder))
    return rows.select("id", F.round("authority", 6).alias("authority"))


def source_coupling(spark: SparkSession, folder: str) -> DataFrame:
    return C.coupling(corpus.references(spark, folder), 0.1).select("a", "b", "shared", F.round("strength", 6).alias("strength"))


def similar_sources(spark: SparkSession, folder: str) -> DataFrame:
    refs = corpus.references(spark, folder)
    first = table(spark, folder, "sources").agg(F.min("id").alias("s"))
    pairs = C.coupling(refs, 0.02)
    both = pairs.select(F.col("a").alias("s"), F.col("b").alias("other"), "strength").unionByName(pairs.select(F.col("b").alias("s"), F.col("a").alias("other"), "strength"))
    return both.join(F.broadcast(first), "s", "left_semi").orderBy(F.desc("strength"), "other").limit(10).select("other", F.round("strength", 6).alias("strength"))


def coupling_statistics(spark: SparkSession, folder: str) -> DataFrame:
    rows = C.coupling_statistics(C.coupling(corpus.references(spark, folder), 0.1))
    return rows.select("pairs", "sources", F.round("mean_strength", 6).alias("mean_strength"), F.round("max_strength", 6).alias("max_strength"))


def source_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return C.source_statistics(table(spark, folder, "sources"), corpus.references(spark, folder)).select("id", "references_made", "sources_cited")


def citation_kinds(spark: SparkSession, folder: str) -> DataFrame:
    kinds = table(spark, folder, "sources").select(F.col("id").alias("citing"), "source_type")
    rows = corpus.references(spark, folder).join(kinds, "citing", "left")
    return rows.groupBy("source_type", F.col("cited").isNotNull().alias("inside")).agg(F.count("*").alias("n"))


def corpus_summary(spark: SparkSession, folder: str) -> DataFrame:
    return C.corpus_summary(table(spark, folder, "sources"), corpus.references(spark, folder))


def most_cited(spark: SparkSession, folder: str) -> DataFrame:
    works = corpus.papers(spark, folder).select("id", F.col("citation_count").alias("authority"))
    return C.most_cited(corpus.references(spark, folder), works, 15)


def citing_sources(spark: SparkSession, folder: str) -> DataFrame:
    refs = corpus.references(spark, folder)
    top = refs.where("cited IS NOT NULL").groupBy("cited").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cited").limit(1)
    return refs.join(F.broadcast(top.select("cited")), "cited", "left_semi").groupBy("citing").agg(F.count("*").alias("n"))


def near_titles(spark: SparkSession, folder: str) -> DataFrame:
    p = corpus.papers(spark, folder).select("id", F.col("title").alias("text"))
    return C.trigram_pairs(p, p, 0.7, ordered=True).select("a", "b", F.round("similarity", 6).alias("similarity"))


def current_papers(spark: SparkSession, folder: str) -> DataFrame:
    return D.current_papers(table(spark, folder, "papers")).select("s2_paper_id", "citation_count", "acquired_at")


def filtered_papers(spark: SparkSession, folder: str) -> DataFrame:
    return D.paper_filter(D.current_papers(table(spark, folder, "papers")), 5, 1, True, ["Statistics", "Economics"], (1990, 2020)).select("s2_paper_id", "year", "citation_count")


def topic_papers(spark: SparkSession, folder: str) -> DataFrame:
    return D.topic_papers(D.current_papers(table(spark, folder, "papers")), ["regression case files", "wavelet", "graph-based panels"], 20)


def papers_not_cited(spark: SparkSession, folder: str) -> DataFrame:
    known = corpus.normal_ids(corpus.citations(spark, folder)).withColumn("s2_paper_id", F.lit(None).cast("string"))
    return D.not_acquired(corpus.papers(spark, folder), known).select("s2_paper_id")


def normalised_rank(spark: SparkSession, folder: str) -> DataFrame:
    p = D.current_papers(table(spark, folder, "papers"))
    most = p.groupBy("year").agg(F.max("citation_count").alias("most"))
    rows = p.where("year IS NOT NULL").join(most, "year")
    return rows.select("s2_paper_id", F.round(F.when(F.col("most") > 0, F.col("citation_count") / F.col("most")).otherwise(0.5), 6).alias("rank_score"))


def cited_walk(spark: SparkSession, folder: str) -> DataFrame:
    e = corpus.edges(spark, folder).select(F.col("src").alias("citing"), F.col("dst").alias("cited"))
    seeds = spark.createDataFrame([(1,), (5,)], "id bigint")
    return D.cited_walk(seeds, e, 2, "references", corpus.concepts(spark, folder).where("id % 3 <> 0"))


def queue_next(spark: SparkSession, folder: str) -> DataFrame:
    return D.pending(corpus.queue(spark, folder), 50).select("id", "priority", "created_at")


def queue_after_failures(spark: SparkSession, folder: str) -> DataFrame:
    q = corpus.queue(spark, folder)
    changes = q.where("id % 10 = 0").select("id", F.lit("failed").alias("new_status"), F.lit("timeout").alias("error"))
    return D.with_status(q, changes, F.lit(NOW).cast("timestamp_ntz")).groupBy("status", "error_message").agg(F.count("*").alias("n"), F.sum("retry_count").alias("retries"), F.max("updated_at").alias("updated_at"))


def queue_retried(spark: SparkSession, folder: str) -> DataFrame:
    return D.retried(corpus.queue(spark, folder)).groupBy("status").agg(F.count("*").alias("n"))


def queue_without_old(spark: SparkSession, folder: str) -> DataFrame:
    return D.without_old(corpus.queue(spark, folder), F.lit(NOW).cast("timestamp_ntz"), 700).groupBy("status").agg(F.count("*").alias("n"))


def cache_entries(spark: SparkSession, folder: str) -> DataFrame:
    log = corpus.log(spark, folder)
    rows = log.select(F.sha2(F.concat("method", F.lit(":"), "metadata"), 256).alias("key"), F.col("id").alias("response"), "created_at", (F.col("created_at") + F.make_interval(days=F.lit(7))).alias("expires_at"))
    return D.fresh_entries(rows, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).select("key", "response")


_TRIGRAMS = "list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
_JACCARD = "len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))"

_SIMPLE_SQL = f"""WITH {REFERENCES_SQL},
    h AS (SELECT c.id, min(s2_paper_id) AS held FROM c JOIN p ON contains(lower(trim(p.title)), lower(trim(c.title))) OR contains(lower(trim(c.title)), lower(trim(p.title)))
        WHERE c.id NOT IN (SELECT id FROM b) AND length(trim(c.title)) >= 5 AND length(trim(p.title)) >= 5 GROUP BY c.id)
    SELECT c.id, coalesce(cited, held) AS target_id FROM c LEFT JOIN b ON b.id = c.id LEFT JOIN h ON h.id = c.id"""

QUERIES = {
    f.__name__: f
    for f in (citation_matches, citation_edges, simple_matches, pagerank, source_coupling, similar_sources, coupling_statistics, source_statistics, citation_kinds, corpus_summary, most_cited, citing_sources, near_titles, current_papers, filtered_papers, topic_papers, papers_not_cited, normalised_rank, cited_walk, queue_next, queue_after_failures, queue_retried, queue_without_old, cache_entries)
}

_PAIRS = f"""WITH {REFERENCES_SQL},
    r AS (SELECT DISTINCT citing, cited FROM f WHERE cited IS NOT NULL),
    n AS (SELECT citing, count(*) AS n FROM r GROUP BY citing),
    o AS (SELECT x.citing AS a, y.citing AS b, count(*) AS shared FROM r x JOIN r y ON x.cited = y.cited AND x.citing < y.citing GROUP BY ALL),
    s AS (SELECT a, b, shared, shared / (u.n + v.n - shared) AS strength FROM o JOIN n u ON u.citing = a JOIN n v ON v.citing = b)"""

ORACLE = {
    "simple_matches": _SIMPLE_SQL,
    "citation_matches": f"""WITH {REFERENCES_SQL},
        x AS (SELECT id, year, {_TRIGRAMS.format("title")} AS x FROM c WHERE title IS NOT NULL), y AS (SELECT s2_paper_id, year, {_TRIGRAMS.format("title")} AS y FROM p),
        t AS (SELECT id, s2_paper_id, {_JACCARD} AS j FROM x JOIN y ON x.year IS NULL OR y.year IS NULL OR x.year = y.year WHERE {_JACCARD} >= 0.85 - 1e-9),
        m AS (SELECT id, s2_paper_id, r, 1.0 AS j FROM k WHERE r < 2 UNION ALL SELECT id, s2_paper_id, 2, j FROM t),
        g AS (SELECT id, first(s2_paper_id ORDER BY r, j DESC, s2_paper_id) AS target_id, min(r) AS r FROM m GROUP BY id)
        SELECT c.id, target_id, ['doi', 'arxiv', 'title'][CAST(r AS INT) + 1] AS method FROM c LEFT JOIN g USING (id)""",
    "citation_edges": f"WITH {REFERENCES_SQL} SELECT * FROM f",
    "pagerank": f"""WITH RECURSIVE {EDGES_SQL}, n AS (SELECT count(*)::DOUBLE AS n FROM part),
        o AS (SELECT src, count(*) AS k FROM e GROUP BY src),
        s(it, id, score) AS (
            SELECT 0, p_partkey, 1.0 / n FROM part, n
            UNION ALL
            SELECT i.it + 1, p_partkey, 0.15 / max(n.n) + 0.85 * coalesce(sum(s2.score / o.k), 0)
            FROM (SELECT DISTINCT it FROM s) i CROSS JOIN part CROSS JOIN n LEFT JOIN e ON e.dst = p_partkey LEFT JOIN o ON o.src = e.src LEFT JOIN s s2 ON s2.id = e.src
            WHERE i.it < 20 GROUP BY i.it, p_partkey)
        SELECT id, round(score / max(score) OVER (), 6) AS authority FROM s WHERE it = 20""",
    "source_coupling": _PAIRS + " SELECT a, b, shared, round(strength, 6) AS strength FROM s WHERE strength >= 0.1 - 1e-12",
    "similar_sources": _PAIRS + " SELECT CASE WHEN a = m THEN b ELSE a END AS other, round(strength, 6) AS strength FROM s, (SELECT min(id) AS m FROM sources) WHERE m IN (a, b) AND strength >= 0.02 - 1e-12 ORDER BY s.strength DESC, other LIMIT 10",
    "coupling_statistics": _PAIRS + ", z AS (SELECT * FROM s WHERE strength >= 0.1 - 1e-12) SELECT count(*) AS pairs, (SELECT count(DISTINCT x) FROM (SELECT a AS x FROM z UNION ALL SELECT b FROM z)) AS sources, round(avg(strength), 6) AS mean_strength, round(max(strength), 6) AS max_strength FROM z",
    "source_statistics": f"WITH {REFERENCES_SQL} SELECT s.id, count(citation_id) AS references_made, count(DISTINCT cited) AS sources_cited FROM sources s LEFT JOIN f ON citing = s.id GROUP BY s.id",
    "citation_kinds": f"WITH {REFERENCES_SQL} SELECT source_type, cited IS NOT NULL AS inside, count(*) AS n FROM f LEFT JOIN sources s ON s.id = citing GROUP BY ALL",
    "corpus_summary": f"WITH {REFERENCES_SQL} SELECT (SELECT count(*) FROM sources) AS sources, count(*) AS citations, count(cited) AS inside, count(*) - count(cited) AS outside, count(DISTINCT citing) AS citing_sources, count(DISTINCT cited) AS cited_works FROM f",
    "most_cited": f"WITH {REFERENCES_SQL} SELECT cited AS id, count(*) AS citations, any_value(citation_count) AS authority FROM f JOIN p ON s2_paper_id = cited GROUP BY cited ORDER BY citations DESC, authority DESC, id LIMIT 15",
    "citing_sources": f"WITH {REFERENCES_SQL}, t AS (SELECT cited FROM f WHERE cited IS NOT NULL GROUP BY cited ORDER BY count(*) DESC, cited LIMIT 1) SELECT citing, count(*) AS n FROM f JOIN t USING (cited) GROUP BY citing",
    "near_titles": f"""WITH {PAPERS_SQL}, x AS (SELECT s2_paper_id AS a, {_TRIGRAMS.format("title")} AS x FROM p), y AS (SELECT a AS b, x AS y FROM x)
        SELECT a, b, round({_JACCARD}, 6) AS similarity FROM x JOIN y ON a < b WHERE {_JACCARD} >= 0.7 - 1e-9""",
    "current_papers": f"WITH {PAPERS_SQL} SELECT s2_paper_id, citation_count, acquired_at FROM p",
    "filtered_papers": f"WITH {PAPERS_SQL} SELECT s2_paper_id, year, citation_count FROM p WHERE citation_count >= 5 AND influential_citation_count >= 1 AND is_open_access AND list_has_any(fields_of_study, ['Statistics', 'Economics']) AND year BETWEEN 1990 AND 2020",
    "topic_papers": f"WITH {PAPERS_SQL}, x AS (SELECT s2_paper_id, citation_count, lower(concat_ws(' ', title, abstract)) AS t FROM p), "
    + ", ".join(f"t{k} AS (SELECT s2_paper_id, {k} AS k, '{topic}' AS topic FROM x WHERE {' AND '.join(f'contains(t, {chr(39)}{w}{chr(39)})' for w in topic.split())} ORDER BY citation_count DESC NULLS LAST, s2_paper_id LIMIT 20)" for k, topic in enumerate(["regression case files", "wavelet", "graph-based panels"]))
    + " SELECT s2_paper_id, first(topic ORDER BY k) AS topic FROM (FROM t0 UNION ALL FROM t1 UNION ALL FROM t2) GROUP BY s2_paper_id",
    "papers_not_cited": f"WITH {REFERENCES_SQL} SELECT s2_paper_id FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doi = lower(p.doi)) AND NOT EXISTS (SELECT 1 FROM c WHERE c.arxiv_id = lower(p.arxiv_id))",
    "normalised_rank": f"WITH {PAPERS_SQL} SELECT s2_paper_id, round(CASE WHEN m > 0 THEN citation_count / m ELSE 0.5 END, 6) AS rank_score FROM p JOIN (SELECT year AS y, max(citation_count) AS m FROM p GROUP BY year) ON y = year",
    "cited_walk": f"""WITH {EDGES_SQL}, a AS (SELECT DISTINCT src, dst FROM e),
        h1 AS (SELECT DISTINCT dst AS id FROM a WHERE src IN (1, 5) AND dst NOT IN (1, 5)),
        h2 AS (SELECT DISTINCT dst AS id FROM a WHERE src IN (SELECT id FROM h1 WHERE id % 3 <> 0) AND dst NOT IN (1, 5) AND dst NOT IN (SELECT id FROM h1))
        SELECT id, d AS depth FROM (SELECT id, 1 AS d FROM h1 UNION ALL SELECT id, 2 FROM h2) WHERE id % 3 <> 0 AND id IN (SELECT p_partkey FROM part)""",
    "queue_next": f"WITH {QUEUE_SQL} SELECT id, priority, created_at FROM q WHERE status = 'pending' ORDER BY priority DESC, created_at, id LIMIT 50",
    "queue_after_failures": f"WITH {QUEUE_SQL}, r AS (SELECT CASE WHEN id % 10 = 0 THEN 'failed' ELSE status END AS status, CASE WHEN id % 10 = 0 THEN 'timeout' END AS error_message, retry_count + CASE WHEN id % 10 = 0 THEN 1 ELSE 0 END AS r, CASE WHEN id % 10 = 0 THEN TIMESTAMP '{NOW}' ELSE updated_at END AS u FROM q) SELECT status, error_message, count(*) AS n, CAST(sum(r) AS BIGINT) AS retries, max(u) AS updated_at FROM r GROUP BY ALL",
    "queue_retried": f"WITH {QUEUE_SQL} SELECT CASE WHEN status = 'failed' AND retry_count < 3 THEN 'pending' ELSE status END AS status, count(*) AS n FROM q GROUP BY 1",
    "queue_without_old": f"WITH {QUEUE_SQL} SELECT status, count(*) AS n FROM q WHERE NOT (status = 'completed' AND updated_at < TIMESTAMP '{NOW}' - INTERVAL 700 DAY) GROUP BY 1",
    "cache_entries": "SELECT sha256(event_type || ':' || props) AS key, event_id AS response FROM events WHERE ts + INTERVAL 7 DAY > TIMESTAMP '2024-01-20' QUALIFY row_number() OVER (PARTITION BY event_type, props ORDER BY ts DESC) = 1",
}
