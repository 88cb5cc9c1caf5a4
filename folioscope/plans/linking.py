"""Queries of fuzzy matching, extraction steps and the application's calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import enrichment as N
from folioscope.operators import extraction as X
from folioscope.operators.services import Corpus
from folioscope.plans import corpus
from folioscope.plans.corpus import CHUNKS_SQL, EDGES_SQL, LINKS_SQL, REFERENCES_SQL
from folioscope.plans.retrieval import _HYBRID, VECTOR
from folioscope.sources.tables import table

RULES = [("econometrics", ["panel", "wages"]), ("retrieval", ["retrieval", "ranking"]), ("causal", ["treatment", "instrument"])]


def chosen_papers(spark: SparkSession, folder: str) -> DataFrame:
    rows = N.chosen_papers(corpus.normal_ids(corpus.citations(spark, folder)), corpus.papers(spark, folder))
    return rows.select("id", "paper_id", "method", F.round("confidence", 6).alias("confidence"))


def best_names(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    expected = p.select(F.col("p_brand").alias("group"), F.upper("p_name").alias("expected"), F.array("p_type").alias("aliases"))
    return N.best_names(expected.distinct(), p.select(F.col("p_brand").alias("group"), F.col("p_name").alias("name")).distinct()).withColumn("score", F.round("score", 6))


def chunks_to_process(spark: SparkSession, folder: str) -> DataFrame:
    c = corpus.chunks(spark, folder)
    done = c.where("page_start % 2 = 0").select(F.col("id").alias("chunk_id"))
    return X.to_process(c, done, "time_series").select("id")


def stored_concepts(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    known = p.where("p_partkey < 20").select(F.col("p_name").alias("canonical_name"), F.col("p_name").alias("name")).distinct()
    return X.stored(known, p.select(F.concat(F.lit("The "), F.upper("p_name")).alias("name")))


def relinked_orphans(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    edges = e.where("id >= 30").select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    return X.relinked(e, edges, 0.3).select("src", "dst", "type", F.round("strength", 6).alias("strength"))


def matched_seeds(spark: SparkSession, folder: str) -> DataFrame:
    seeds = table(spark, folder, "region").select(F.col("r_name").alias("seed"), F.array(F.col("r_name")).alias("aliases"))
    concepts = table(spark, folder, "nation").select(F.col("n_nationkey").alias("id"), F.lower("n_name").alias("canonical_name"), F.array(F.lit("Asia"), "n_name").alias("aliases"))
    return X.matched_seeds(seeds, concepts)


def domains_by_keywords(spark: SparkSession, folder: str) -> DataFrame:
    return X.domains_by_keywords(corpus.chunks(spark, folder), RULES)


def keywords_found(spark: SparkSession, folder: str) -> DataFrame:
    words = ["regression", "wavelet", "panel", "auction"]
    return corpus.chunks(spark, folder).where("content IS NOT NULL").select("id", F.array_join(X.keywords_in(F.col("content"), words), ",").alias("keywords"))


def recommendations(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    rows = X.centroid_neighbours(e, e.where("id < 5").select("id"), e.where("id BETWEEN 10 AND 12").select("id"), 15)
    return rows.select("id", F.round("score", 6).alias("score"))


def _corpus(spark: SparkSession, folder: str) -> Corpus:
    return Corpus(table(spark, folder, "sources"), corpus.chunks(spark, folder), corpus.references(spark, folder), corpus.concepts(spark, folder), corpus.edges(spark, folder), corpus.links(spark, folder), table(spark, folder, "domains"))


def service_search(spark: SparkSession, folder: str) -> DataFrame:
    found = _corpus(spark, folder).search("importance weighted regression", VECTOR, 12, "auditing", use_citations=True)
    return found.select("id", "rank", F.round("combined_score", 6).alias("combined_score"), "title")


def service_sources(spark: SparkSession, folder: str) -> DataFrame:
    return _corpus(spark, folder).list_sources(10, 5, "paper").select("id", "title")


def service_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _corpus(spark, folder).stats()


def service_chunk_concepts(spark: SparkSession, folder: str) -> DataFrame:
    ids = spark.range(0, 40).select((F.col("id") * 7).alias("id"))
    return _corpus(spark, folder).chunk_concepts(ids).select("id", F.array_join("concepts", ",").alias("concepts"))


def service_neighbourhood(spark: SparkSession, folder: str) -> DataFrame:
    return _corpus(spark, folder).graph_neighbourhood("12", 1, 100)


def service_concepts(spark: SparkSession, folder: str) -> DataFrame:
    return _corpus(spark, folder).list_concepts("METHOD", 30, 5).select("id", "name")


def service_concept(spark: SparkSession, folder: str) -> DataFrame:
    rows = _corpus(spark, folder).concept("12", 40)
    return rows.select("id", "name", "other", "type", "outgoing", F.round("strength", 6).alias("strength"))


def service_concept_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return _corpus(spark, folder).chunks_of_concept("12").select("chunk_id", "mention_type", F.round("relevance", 6).alias("relevance"))


def service_domains(spark: SparkSession, folder: str) -> DataFrame:
    return _corpus(spark, folder).list_domains()


def service_unlinked(spark: SparkSession, folder: str) -> DataFrame:
    c = _corpus(spark, folder)
    rows = Corpus(c.sources, c.chunks, c.references, c.concepts, c.edges.where("strength > 0.98"), c.links).unlinked(3)
    return rows.select("concept_type", "n", F.array_join("names", "|").alias("names"))


def service_network(spark: SparkSession, folder: str) -> DataFrame:
    c = _corpus(spark, folder)
    return c.citation_network(c.sources.agg(F.min("id")).first()[0])


def service_coupled(spark: SparkSession, folder: str) -> DataFrame:
    c = _corpus(spark, folder)
    return c.coupled_sources(c.sources.agg(F.min("id")).first()[0], 10, 0.02).select("other", "shared", F.round("strength", 6).alias("strength"))


def service_assumptions(spark: SparkSession, folder: str) -> DataFrame:
    return _corpus(spark, folder).assumptions("12").select("assumption", "name", "importance", F.round("strength", 6).alias("strength"))


def service_explanation(spark: SparkSession, folder: str) -> DataFrame:
    return _corpus(spark, folder).explain_connection("1", "100").select("step", "name", "type", "rank", "chunk_id")


def sources_without_chunks(spark: SparkSession, folder: str) -> DataFrame:
    c = _corpus(spark, folder)
    return Corpus(c.sources, c.chunks.where("page_start > 60"), c.references).sources_without_chunks().select("id")


QUERIES = {
    f.__name__: f
    for f in (chosen_papers, best_names, chunks_to_process, stored_concepts, relinked_orphans, matched_seeds, domains_by_keywords, keywords_found, recommendations, service_search, service_sources, service_counts, service_chunk_concepts, service_neighbourhood, service_concepts, service_concept, service_concept_chunks, service_domains, service_unlinked, service_network, service_coupled, service_assumptions, service_explanation, sources_without_chunks)
}

_MEAN = "(SELECT list(a ORDER BY i) FROM (SELECT i, avg(v[i]) AS a FROM v, range(1, 65) t(i) WHERE {0} GROUP BY i))"

ORACLE = {
    "chunks_to_process": f"WITH {CHUNKS_SQL} SELECT id FROM c WHERE length(content) >= 100 AND domain_id = 'time_series' AND (page_start IS NULL OR page_start % 2 <> 0)",
    "stored_concepts": "WITH k AS (SELECT DISTINCT p_name AS n FROM part WHERE p_partkey < 20) SELECT n AS canonical_name, n AS name FROM k UNION ALL SELECT DISTINCT p_name, 'The ' || upper(p_name) FROM part WHERE p_name NOT IN (SELECT n FROM k)",
    "relinked_orphans": """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT a.id AS src, b.id AS dst, list_cosine_similarity(a.v, b.v) AS c FROM v a JOIN v b ON a.id < 30 AND b.id >= 30)
        SELECT src, dst, 'RELATED_TO' AS type, round(c, 6) AS strength FROM s WHERE c >= 0.3 QUALIFY row_number() OVER (PARTITION BY src ORDER BY c DESC, dst) <= 3""",
    "matched_seeds": "SELECT r_name AS seed, CASE WHEN r_name = 'ASIA' THEN (SELECT min(n_nationkey) FROM nation) END AS id, CASE WHEN r_name = 'ASIA' THEN 0.9::DOUBLE END AS confidence FROM region",
    "domains_by_keywords": f"WITH {CHUNKS_SQL}, f AS (SELECT source_id, lower(coalesce(content, '')) AS t FROM c QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY coalesce(page_start, 1 << 30), created_at, id) = 1) SELECT source_id, CASE "
    + " ".join(f"WHEN {' OR '.join(f'contains(t, {chr(39)}{k}{chr(39)})' for k in keys)} THEN '{name}'" for name, keys in RULES)
    + " ELSE 'general' END AS domain FROM f",
    "keywords_found": f"WITH {CHUNKS_SQL} SELECT id, array_to_string(list_filter(['regression', 'wavelet', 'panel', 'auction'], lambda k: contains(lower(content), k)), ',') AS keywords FROM c WHERE content IS NOT NULL",
    "recommendations": f"""WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        m AS (SELECT {_MEAN.format("id < 5")} AS p, {_MEAN.format("id BETWEEN 10 AND 12")} AS q),
        s AS (SELECT id, list_cosine_similarity(v, p) - 0.5 * list_cosine_similarity(v, q) AS s FROM v, m WHERE id >= 5 AND id NOT BETWEEN 10 AND 12)
        SELECT id, round(s, 6) AS score FROM s ORDER BY s DESC, id LIMIT 15""",
    "service_search": f"""WITH {_HYBRID},
        b AS (SELECT id, source_id, text_score, vector_score FROM (SELECT *, 0.5 * ts + 0.5 * vs AS s FROM h) ORDER BY s DESC, id LIMIT 24),
        j AS (SELECT b.id, title, text_score, vector_score, coalesce(CAST(citation_authority AS DOUBLE), 0) AS cs FROM b LEFT JOIN sources s ON s.id = b.source_id),
        m AS (SELECT max(cs) > 0 AS has FROM j)
        SELECT id, title, round(s, 6) AS combined_score, row_number() OVER (ORDER BY s DESC, id) AS rank
        FROM (SELECT id, title, (0.5 * text_score + 0.5 * vector_score + CASE WHEN has THEN 0.15 * cs ELSE 0 END) / (1.0 + CASE WHEN has THEN 0.15 ELSE 0 END) AS s FROM j, m ORDER BY s DESC, id LIMIT 12)""",
    "service_concepts": "SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey % 5 = 0 ORDER BY trim(p_name), p_partkey LIMIT 30 OFFSET 5",
    "service_concept": f"WITH {EDGES_SQL} SELECT 12 AS id, p_name AS name, other, type, outgoing, round(strength, 6) AS strength FROM (SELECT dst AS other, type, strength, true AS outgoing FROM e WHERE src = 12 UNION ALL SELECT src, type, strength, false FROM e WHERE dst = 12), part WHERE p_partkey = 12 ORDER BY x.strength DESC, other, type LIMIT 40".replace("), part", ") x, part"),
    "service_concept_chunks": f"WITH {LINKS_SQL} SELECT chunk_id, mention_type, round(coalesce(relevance_score, 0), 6) AS relevance FROM l WHERE concept_id = 12 ORDER BY mention_type <> 'defines', coalesce(relevance_score, 0) DESC, chunk_id, mention_type LIMIT 20",
    "service_domains": "SELECT d.id, d.name, (SELECT count(*) FROM sources s WHERE s.domain_id = d.id) AS sources, (SELECT count(DISTINCT c.id) FROM chunks c WHERE c.domain_id = d.id) AS chunks FROM domains d",
    "service_unlinked": f"WITH {EDGES_SQL}, s AS (SELECT * FROM e WHERE strength > 0.98), o AS (SELECT p_name, ['METHOD', 'ASSUMPTION', 'PROBLEM', 'DEFINITION', 'THEOREM'][CAST(p_partkey % 5 AS INT) + 1] AS concept_type FROM part WHERE p_partkey NOT IN (SELECT src FROM s) AND p_partkey NOT IN (SELECT dst FROM s)) SELECT concept_type, count(*) AS n, array_to_string(list_sort(list(p_name))[1:3], '|') AS names FROM o GROUP BY 1",
    "service_network": f"WITH {REFERENCES_SQL} SELECT 'cites' AS direction, cited AS other, count(*) AS n FROM f WHERE citing = (SELECT min(id) FROM sources) AND cited IS NOT NULL GROUP BY cited ORDER BY n DESC, other LIMIT 100",
    "service_coupled": f"""WITH {REFERENCES_SQL}, r AS (SELECT DISTINCT citing, cited FROM f WHERE citing IS NOT NULL AND cited IS NOT NULL), n AS (SELECT citing, count(*) AS n FROM r GROUP BY 1),
        kk AS (SELECT y.citing AS other, count(*) AS shared FROM r x JOIN r y ON x.cited = y.cited AND x.citing <> y.citing WHERE x.citing = (SELECT min(id) FROM sources) GROUP BY 1)
        SELECT other, shared, round(shared / (a.n + b.n - shared), 6) AS strength FROM kk JOIN n b ON b.citing = other JOIN n a ON a.citing = (SELECT min(id) FROM sources) WHERE shared / (a.n + b.n - shared) >= 0.02 ORDER BY shared / (a.n + b.n - shared) DESC, other LIMIT 10""",
    "service_assumptions": f"WITH {EDGES_SQL} SELECT dst AS assumption, any_value(p_name) AS name, CASE WHEN min(CASE type WHEN 'REQUIRES' THEN 0 ELSE 1 END) = 0 THEN 'critical' ELSE 'standard' END AS importance, round(max(strength), 6) AS strength FROM e JOIN part ON p_partkey = dst WHERE src = 12 AND type IN ('REQUIRES', 'USES') AND dst % 5 = 1 GROUP BY dst",
    "service_sources": "SELECT id, title FROM sources WHERE source_type = 'paper' ORDER BY created_at DESC, id LIMIT 10 OFFSET 5",
    "service_counts": f"""WITH {EDGES_SQL}, {LINKS_SQL} SELECT 'sources' AS name, count(*) AS n FROM sources UNION ALL SELECT 'chunks', count(DISTINCT id) FROM chunks UNION ALL SELECT 'references', count(DISTINCT id) FROM citations
        UNION ALL SELECT 'concepts', count(*) FROM part UNION ALL SELECT 'edges', count(*) FROM e UNION ALL SELECT 'links', count(*) FROM l""",
    "service_chunk_concepts": f"WITH {LINKS_SQL} SELECT i AS id, coalesce(array_to_string(list_sort(list(DISTINCT concept_id) FILTER (concept_id IS NOT NULL)), ','), '') AS concepts FROM (SELECT 7 * unnest(range(40)) AS i) LEFT JOIN (SELECT DISTINCT chunk_id, concept_id FROM l) ON chunk_id = i GROUP BY i",
    "service_neighbourhood": f"WITH {EDGES_SQL} SELECT DISTINCT CASE WHEN src = 12 THEN dst ELSE src END AS node, 1 AS hops FROM e WHERE 12 IN (src, dst)",
    "sources_without_chunks": "SELECT id FROM sources WHERE id NOT IN (SELECT source_id FROM chunks WHERE page_start > 60)",
}
