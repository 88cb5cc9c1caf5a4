"""Queries on the concept graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import graph as G
from folioscope.plans import corpus
from folioscope.plans.corpus import EDGES_SQL, LINKS_SQL, WEIGHT_SQL

STARTS = (1, 2, 3)


def _starts(spark: SparkSession, ids: tuple[int, ...] = STARTS) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id bigint")


def graph_distances(spark: SparkSession, folder: str) -> DataFrame:
    return G.distances(corpus.edges(spark, folder), _starts(spark), 2).select("start", "node", "hops", F.round("weight", 6).alias("weight"))


def graph_neighbourhood(spark: SparkSession, folder: str) -> DataFrame:
    return G.neighbourhood(corpus.edges(spark, folder), "1", 2)


def graph_neighbourhood_of_types(spark: SparkSession, folder: str) -> DataFrame:
    return G.neighbourhood(corpus.edges(spark, folder), "1", 2, ["REQUIRES", "USES"], directed=True)


def graph_neighbourhood_edges(spark: SparkSession, folder: str) -> DataFrame:
    e = corpus.edges(spark, folder)
    near = G.neighbourhood(e, "1", 1).select("node").unionByName(_starts(spark, (1,)).select(F.col("id").alias("node")))
    return G.induced_edges(e, near).select("src", "dst", "type", F.round("strength", 6).alias("strength"))


def graph_path(spark: SparkSession, folder: str) -> DataFrame:
    return G.shortest_path(corpus.edges(spark, folder), "1", "100", 5)


def graph_path_text(spark: SparkSession, folder: str) -> DataFrame:
    names = corpus.concepts(spark, folder).select(F.col("id").cast("string").alias("id"), "name")
    return G.path_text(graph_path(spark, folder), names)


def graph_path_length(spark: SparkSession, folder: str) -> DataFrame:
    near = G.distances(corpus.edges(spark, folder), _starts(spark, (1,)), 3)
    return near.groupBy("hops").agg(F.count("*").alias("nodes"))


def related_concepts(spark: SparkSession, folder: str) -> DataFrame:
    return G.related_concepts(corpus.edges(spark, folder), "1", 2, 0.95)


def graph_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = G.graph_scores(corpus.edges(spark, folder), _starts(spark), corpus.links(spark, folder), 2)
    return rows.select("id", F.round("graph_score", 6).alias("graph_score"))


def graph_scores_unweighted(spark: SparkSession, folder: str) -> DataFrame:
    rows = G.graph_scores(corpus.edges(spark, folder), _starts(spark), corpus.links(spark, folder), 1, weighted=False, self_match=False, directed=True)
    return rows.select("id", F.round("graph_score", 6).alias("graph_score"))


def graph_scores_mentions(spark: SparkSession, folder: str) -> DataFrame:
    rows = G.graph_scores(corpus.edges(spark, folder), _starts(spark), corpus.links(spark, folder), 1, mentions=True)
    return rows.select("id", F.round("graph_score", 9).alias("graph_score"))


def graph_explanations(spark: SparkSession, folder: str) -> DataFrame:
    near = G.distances(corpus.edges(spark, folder), _starts(spark), 1)
    return G.best_explanations(near, corpus.links(spark, folder), corpus.concepts(spark, folder))


def graph_degrees(spark: SparkSession, folder: str) -> DataFrame:
    return G.degrees(corpus.edges(spark, folder))


def edge_types(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.edges(spark, folder).groupBy("type").agg(F.count("*").alias("n"))


def edges_of_concept(spark: SparkSession, folder: str) -> DataFrame:
    return G.edge_lists(corpus.edges(spark, folder), "7", "both", 40).select("src", "dst", "type", F.round("strength", 6).alias("strength"))


def resolve_concept(spark: SparkSession, folder: str) -> DataFrame:
    return G.resolve(corpus.concepts(spark, folder), "12").select("id", "name")


def path_evidence(spark: SparkSession, folder: str) -> DataFrame:
    e = corpus.edges(spark, folder).withColumn("evidence_chunk_ids", F.array(F.col("src") * 4))
    return G.path_evidence(graph_path(spark, folder), e, corpus.links(spark, folder), 2)


_ARCS = f"a AS (SELECT src, dst, max({WEIGHT_SQL}) AS w FROM (SELECT src, dst, type FROM e UNION ALL SELECT dst, src, type FROM e) GROUP BY src, dst)"
_DIRECTED = f"a AS (SELECT src, dst, max({WEIGHT_SQL}) AS w FROM e GROUP BY src, dst)"


def _reach(starts: str, hops: int, arcs: str = _ARCS) -> str:
    """d0 .. dn: what each number of steps reaches first; d: all of it."""
    out = f"{EDGES_SQL}, {arcs}, d0 AS (SELECT id AS start, id AS node, 1.0::DOUBLE AS weight FROM (VALUES {starts}) t(id))"
    for h in range(1, hops + 1):
        seen = " UNION ALL ".join(f"SELECT start, node FROM d{i}" for i in range(h))
        out += f", d{h} AS (SELECT start, dst AS node, max(weight * w) AS weight FROM d{h - 1} JOIN a ON src = node WHERE (start, dst) NOT IN ({seen}) GROUP BY start, dst)"
    return out + ", d AS (" + " UNION ALL ".join(f"SELECT start, node, {h} AS hops, weight FROM d{h}" for h in range(hops + 1)) + ")"


_PATH_SQL = f"""{EDGES_SQL}, u AS (SELECT src, dst, type, {WEIGHT_SQL} AS w FROM (SELECT src, dst, type FROM e UNION ALL SELECT dst, src, type FROM e)),
    a AS (SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, last(type ORDER BY w, type) AS type, max(w) AS w FROM u GROUP BY ALL),
    d0 AS (SELECT '1' AS node, 1.0::DOUBLE AS weight, ['1'] AS path)""" + "".join(
    f""", d{h} AS (SELECT node, max(weight) AS weight, first(path ORDER BY weight DESC, path) AS path FROM (SELECT dst AS node, weight * w AS weight, list_append(path, dst) AS path FROM d{h - 1} JOIN a ON src = node)
        WHERE node NOT IN ({" UNION ALL ".join(f"SELECT node FROM d{i}" for i in range(h))}) GROUP BY node)"""
    for h in range(1, 4)
) + """, f AS (SELECT path FROM (SELECT 1 AS h, path FROM d1 WHERE node = '100' UNION ALL SELECT 2, path FROM d2 WHERE node = '100' UNION ALL SELECT 3, path FROM d3 WHERE node = '100') ORDER BY h LIMIT 1),
    s AS (SELECT unnest(range(len(path))) AS step, path FROM f),
    x AS (SELECT step, path[step + 1] AS node, type FROM s LEFT JOIN a ON a.src = path[step] AND a.dst = path[step + 1])"""
_S3 = "(1), (2), (3)"


def _scores(hops: int, value: str, keep: str = "true", factor: str = "1.0", arcs: str = _ARCS, digits: int = 6) -> str:
    return f"""WITH {_reach(_S3, hops, arcs)}, {LINKS_SQL},
        k AS (SELECT chunk_id, concept_id, max(CASE mention_type WHEN 'defines' THEN 1.0 WHEN 'reference' THEN 0.6 WHEN 'example' THEN 0.4 ELSE 0.5 END * coalesce(relevance_score, 1.0)) AS m FROM l GROUP BY ALL),
        n AS (SELECT node, sum({value}) AS v FROM d WHERE {keep} GROUP BY node)
        SELECT chunk_id AS id, round(least(sum(coalesce(v, 0)) / (3 * count(*)), 1.0) * {factor}, {digits}) AS graph_score FROM k LEFT JOIN n ON node = concept_id GROUP BY chunk_id"""


QUERIES = {f.__name__: f for f in (graph_distances, graph_neighbourhood, graph_neighbourhood_of_types, graph_neighbourhood_edges, graph_path, graph_path_text, graph_path_length, related_concepts, graph_scores, graph_scores_unweighted, graph_scores_mentions, graph_explanations, graph_degrees, edge_types, edges_of_concept, resolve_concept, path_evidence)}

ORACLE = {
    "graph_distances": f"WITH {_reach(_S3, 2)} SELECT start, node, hops, round(weight, 6) AS weight FROM d",
    "graph_neighbourhood": f"WITH {_reach('(1)', 2)} SELECT node, hops FROM d WHERE hops > 0",
    "graph_neighbourhood_of_types": "WITH " + _reach("(1)", 2, "t AS (SELECT * FROM e WHERE type IN ('REQUIRES', 'USES')), " + _DIRECTED.replace("FROM e", "FROM t")) + " SELECT node, hops FROM d WHERE hops > 0",
    "graph_neighbourhood_edges": f"WITH {_reach('(1)', 1)} SELECT src, dst, type, round(strength, 6) AS strength FROM e WHERE src IN (SELECT node FROM d) AND dst IN (SELECT node FROM d)",
    "graph_path": f"WITH {_PATH_SQL} SELECT step, node, type FROM x",
    "graph_path_text": f"WITH {_PATH_SQL} SELECT string_agg(CASE WHEN type IS NULL THEN p_name ELSE '-> (' || lower(replace(type, '_', ' ')) || ') -> ' || p_name END, ' ' ORDER BY step) AS explanation FROM x JOIN part ON CAST(p_partkey AS VARCHAR) = node",
    "graph_path_length": f"WITH {_reach('(1)', 3)} SELECT hops, count(*) AS nodes FROM d GROUP BY hops",
    "related_concepts": f"""WITH {EDGES_SQL}, s AS (SELECT DISTINCT src, dst, type FROM e WHERE strength >= 0.95),
        h1 AS (SELECT dst AS node, 1 AS distance, min(type) AS path FROM s WHERE src = 1 AND dst <> 1 GROUP BY dst),
        h2 AS (SELECT s.dst AS node, 2 AS distance, min(path || '>' || type) AS path FROM h1 JOIN s ON s.src = node WHERE s.dst <> 1 GROUP BY s.dst)
        SELECT * FROM h1 UNION ALL SELECT * FROM h2 WHERE node NOT IN (SELECT node FROM h1)""",
    "graph_scores": _scores(2, "weight / (hops + 1)"),
    "graph_scores_unweighted": _scores(1, "1.0 / (hops + 1)", "hops > 0", arcs=_DIRECTED),
    "graph_scores_mentions": _scores(1, "weight / (hops + 1)", factor="avg(m)", digits=9),
    "graph_explanations": f"""WITH {_reach(_S3, 1)}, {LINKS_SQL},
        m AS (SELECT chunk_id, start, node, weight, row_number() OVER (PARTITION BY chunk_id ORDER BY weight DESC, start, node) AS rank FROM (SELECT DISTINCT chunk_id, concept_id FROM l) JOIN d ON node = concept_id WHERE hops > 0)
        SELECT chunk_id, rank, x.p_name || ' -> ' || y.p_name AS explanation FROM m JOIN part x ON x.p_partkey = start JOIN part y ON y.p_partkey = node WHERE rank <= 3""",
    "graph_degrees": f"WITH {EDGES_SQL} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node",
    "edge_types": f"WITH {EDGES_SQL} SELECT type, count(*) AS n FROM e GROUP BY type",
    "edges_of_concept": f"WITH {EDGES_SQL} SELECT src, dst, type, round(strength, 6) AS strength FROM e WHERE src = 7 OR dst = 7 ORDER BY e.strength DESC, src, dst, type LIMIT 40",
    "resolve_concept": "SELECT p_partkey AS id, p_name AS name FROM part WHERE CAST(p_partkey AS VARCHAR) = '12'",
}
