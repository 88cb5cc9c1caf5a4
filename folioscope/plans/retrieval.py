"""Queries of retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.stems import stem_of, stem_sql
from folioscope.functions.text import STOP_WORDS
from folioscope.functions.vectors import cosine, is_sound
from folioscope.operators import search as S
from folioscope.plans import corpus
from folioscope.plans.corpus import CHUNKS_SQL
from folioscope.sources.tables import table

TEXT = "importance weighted regression"
TERMS = [stem_of(w) for w in TEXT.split()]
EXPANSIONS = ["estimation", "kernel smoothing"]
WEIGHTS = dict.fromkeys([stem_of(w) for e in EXPANSIONS for w in e.split()], S.EXPANSION_WEIGHT) | dict.fromkeys(TERMS, 1.0)
#: The embedding of the query: a fixed direction.
VECTOR = [((7 * i + 3) % 11 - 5) / 10 for i in range(64)]
_VECTOR_SQL = "CAST([" + ", ".join(map(str, VECTOR)) + "] AS DOUBLE[])"


def _query(**more: object) -> S.SearchQuery:
    return S.SearchQuery(**({"text": TEXT, "embedding": VECTOR, "limit": 20} | more))


def _parts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return corpus.chunks(spark, folder), table(spark, folder, "sources")


def _rounded(rows: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    return rows.select(*keep, *[F.round(c, 6).alias(c) for c in columns])


def search_text(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(S.search_text(corpus.chunks(spark, folder), _query()), ["combined_score"], ["id", "rank"])


def search_text_inflected(spark: SparkSession, folder: str) -> DataFrame:
    found = S.search_text(corpus.chunks(spark, folder), _query(text="important weights of regressions"))
    return _rounded(found, ["combined_score"], ["id", "rank"])


def search_indexed(spark: SparkSession, folder: str) -> DataFrame:
    found = S.search_index(S.build_text_index(corpus.chunks(spark, folder)), TEXT, 20)
    return _rounded(found, ["combined_score"], ["id", "rank"])


def _synonyms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("regression", EXPANSIONS[:1]), ("weighted regression", EXPANSIONS[1:]), ("auction", ["bidding"])], "term string, synonyms array<string>")


def search_expanded(spark: SparkSession, folder: str) -> DataFrame:
    found = S.search_expanded(corpus.chunks(spark, folder), _query(embedding=None), S.expansions_of(TEXT, _synonyms(spark)))
    return _rounded(found, ["combined_score"], ["id", "rank"])


def search_expanded_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    found = S.search_expanded(corpus.chunks(spark, folder), _query(), S.expansions_of(TEXT, _synonyms(spark)))
    return _rounded(found, ["text_score", "vector_score", "combined_score"], ["id", "rank"])


def search_vector(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(S.search_vector(table(spark, folder, "chunks"), _query()), ["combined_score"], ["id", "rank"])


def search_vector_in_domain(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(S.search_vector(table(spark, folder, "chunks"), _query(domain_id="time_series")), ["combined_score"], ["id", "rank"])


def search_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(S.search_hybrid(*_parts(spark, folder), _query()), ["text_score", "vector_score", "combined_score"], ["id", "rank"])


def search_hybrid_of_type(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(S.search_hybrid(*_parts(spark, folder), _query(source_type="paper", weights={"text": 0.5, "vector": 0.5})), ["combined_score"], ["id", "rank"])


def search_hybrid_rrf(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(S.search_hybrid(*_parts(spark, folder), _query(scoring="rrf")), ["combined_score"], ["id", "rank"])


def search_fused(spark: SparkSession, folder: str) -> DataFrame:
    query = _query(weights={"text": 0.3, "vector": 0.7, "graph": 0.2, "citation": 0.15})
    return _rounded(S.search_fused(*_parts(spark, folder), query), ["citation_score", "combined_score"], ["id", "rank"])


def search_fused_normalized(spark: SparkSession, folder: str) -> DataFrame:
    query = _query(weights={"text": 0.3, "vector": 0.7, "graph": 0.2, "citation": 0.15})
    return _rounded(S.search_fused(*_parts(spark, folder), query, normalize=True), ["combined_score"], ["id", "rank"])


def search_reranked(spark: SparkSession, folder: str) -> DataFrame:
    scorer = lambda rows: rows.where("content IS NOT NULL").select("id", (F.length("content") / 100).alias("rerank_score"))
    return S.search_reranked(*_parts(spark, folder), _query(limit=10), scorer).select("id", "rank", "original_rank", F.round("rerank_score", 6).alias("rerank_score"))


def batch_vector_search(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    found = S.batch_vector_search(rows, rows.where("id % 100 = 0"), 10)
    return _rounded(found, ["cosine"], ["query_id", "id", "rank"])


def synonym_expansion(spark: SparkSession, folder: str) -> DataFrame:
    queries = table(spark, folder, "part").select(F.concat("p_name", F.lit(" "), "p_brand").alias("query")).distinct()
    synonyms = spark.createDataFrame([("promo", ["advertised", "offer"]), ("economy", ["cheap", "low cost"]), ("brand#13", ["thirteen"])], "term string, synonyms array<string>")
    return S.with_synonyms(queries, synonyms).select("query", F.array_join("expansions", ",").alias("expansions"))


def concept_search(spark: SparkSession, folder: str) -> DataFrame:
    found = S.concept_search(corpus.concepts(spark, folder), "red", 50, "METHOD")
    return found.select("id", "name", F.round("relevance", 2).alias("relevance"))


def query_concepts(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "region").select(F.col("r_regionkey").alias("id"), F.lower("r_name").alias("canonical_name"))
    queries = table(spark, folder, "nation").select(F.concat(F.lit("trade of asia and "), "n_name", F.lit(" middle east")).alias("query"))
    return S.query_concepts(names, queries)


def unified_concepts(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.concat(F.lit("item "), F.col("vec_id").cast("string")).alias("canonical_name"))
    own = v.where("id = 7").select("embedding").first()[0]
    return S.unified_concepts(v, "items like item 12 and item 7", list(own), 6, 0.3)


def similar_vectors(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return _rounded(S.similar_concepts(rows, VECTOR, 0.5, 25), ["similarity"], ["id"])


def sound_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    unit = F.array(*[F.lit(1.0)] * 64)
    return corpus.chunks(spark, folder).select("id", is_sound("embedding", 64).alias("sound"), F.round(F.when(is_sound("embedding", 64), cosine("embedding", unit)).otherwise(0.0), 6).alias("cosine"))


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_TOKENS = "list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+'), lambda w: NOT list_contains([" + _STOP + "], w))"
_SOUND = "coalesce(len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false)"


def _text_sql(where: str = "true", weights: dict[str, float] | None = None) -> str:
    """Scores by BM25 of stems over location and content; with weights any of their terms counts, without them all of TERMS must occur."""
    terms = sorted(weights or TERMS)
    k = range(len(terms))
    tf = ", ".join(f"CAST(len(list_filter({f}, lambda w: list_contains(s{i}, w))) AS DOUBLE) AS {f}{i}" for f in "lc" for i in k)
    part = lambda i, f, boost: f"{boost} * coalesce({f}{i} * 2.2 / nullif({f}{i} + 1.2 * (0.25 + 0.75 * coalesce({f}n / nullif({f}a, 0), 0)), 0), 0)"
    score = " + ".join(f"{(weights or {}).get(t, 1.0)} * ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * ({part(i, 'l', 1.0)} + {part(i, 'c', 0.4)})" for i, t in enumerate(terms))
    every = "true" if weights else " AND ".join(f"l{i} + c{i} > 0" for i in k)
    return f"""{CHUNKS_SQL},
    w AS (SELECT id, source_id, embedding, {_TOKENS.format("location")} AS l, {_TOKENS.format("content")} AS c FROM c WHERE {where}),
    vw AS (SELECT w, {stem_sql("w")} AS s FROM (SELECT DISTINCT unnest(l || c) AS w FROM w)),
    sv AS (SELECT {", ".join(f"coalesce(list(w) FILTER (s = '{t}'), []) AS s{i}" for i, t in enumerate(terms))} FROM vw),
    tf AS (SELECT *, CAST(len(l) AS DOUBLE) AS ln, CAST(len(c) AS DOUBLE) AS cn, {tf} FROM w, sv),
    st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(ln) AS la, avg(cn) AS ca, {", ".join(f"CAST(count(*) FILTER (l{i} + c{i} > 0) AS DOUBLE) AS d{i}" for i in k)} FROM tf),
    t AS (SELECT id, source_id, embedding, CASE WHEN {every} THEN {score} ELSE 0.0 END AS text_score FROM tf, st)"""


_VECTOR_SCORE = f"(1 + list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_VECTOR_SQL})) / 2"
_HYBRID = f"""{_text_sql()},
    v AS (SELECT id, source_id, text_score, {_VECTOR_SCORE} AS vector_score FROM t WHERE {_SOUND}),
    mm AS (SELECT min(text_score) AS t0, max(text_score) AS t1, min(vector_score) AS v0, max(vector_score) AS v1 FROM v),
    h AS (SELECT v.*, CASE WHEN t1 > t0 THEN (text_score - t0) / (t1 - t0) WHEN t1 > 0 THEN 1.0 ELSE 0.0 END AS ts, CASE WHEN v1 > v0 THEN (vector_score - v0) / (v1 - v0) WHEN v1 > 0 THEN 1.0 ELSE 0.0 END AS vs FROM v, mm)"""


def _top(rows: str, columns: str, limit: int = 20) -> str:
    return f"SELECT id, {columns}, row_number() OVER (ORDER BY s DESC, id) AS rank FROM ({rows} ORDER BY s DESC, id LIMIT {limit})"


_FUSED = f"""WITH {_HYBRID},
    b AS (SELECT id, source_id, text_score, vector_score FROM (SELECT *, 0.3 * ts + 0.7 * vs AS s FROM h) ORDER BY s DESC, id LIMIT 40),
    j AS (SELECT b.id, text_score, vector_score, coalesce(CAST(citation_authority AS DOUBLE), 0) AS citation_score FROM b LEFT JOIN sources s ON s.id = b.source_id),
    """

QUERIES = {f.__name__: f for f in (search_text, search_text_inflected, search_indexed, search_expanded, search_expanded_hybrid, search_vector, search_vector_in_domain, search_hybrid, search_hybrid_of_type, search_hybrid_rrf, search_fused, search_fused_normalized, search_reranked, batch_vector_search, synonym_expansion, concept_search, query_concepts, unified_concepts, similar_vectors, sound_embeddings)}

ORACLE = {
    "search_text": f"WITH {_text_sql()} " + _top("SELECT id, text_score AS s FROM t WHERE text_score > 0", "round(s, 6) AS combined_score"),
    "search_text_inflected": f"WITH {_text_sql()} " + _top("SELECT id, text_score AS s FROM t WHERE text_score > 0", "round(s, 6) AS combined_score"),
    "search_indexed": f"WITH {_text_sql()} " + _top("SELECT id, text_score AS s FROM t WHERE text_score > 0", "round(s, 6) AS combined_score"),
    "search_expanded": f"WITH {_text_sql(weights=WEIGHTS)} " + _top("SELECT id, text_score AS s FROM t WHERE text_score > 0", "round(s, 6) AS combined_score"),
    "search_expanded_hybrid": f"""WITH {_text_sql(weights=WEIGHTS)}, v AS (SELECT id, text_score, {_VECTOR_SCORE} AS vector_score FROM t WHERE text_score > 0 AND {_SOUND}),
        mm AS (SELECT min(text_score) AS t0, max(text_score) AS t1, min(vector_score) AS v0, max(vector_score) AS v1 FROM v)"""
    + _top("SELECT id, text_score, vector_score, 0.3 * (text_score - t0) / (t1 - t0) + 0.7 * (vector_score - v0) / (v1 - v0) AS s FROM v, mm", "round(text_score, 6) AS text_score, round(vector_score, 6) AS vector_score, round(s, 6) AS combined_score"),
    "search_vector": f"WITH {CHUNKS_SQL} " + _top(f"SELECT id, {_VECTOR_SCORE} AS s FROM c WHERE {_SOUND}", "round(s, 6) AS combined_score"),
    "search_vector_in_domain": f"WITH {CHUNKS_SQL} " + _top(f"SELECT id, {_VECTOR_SCORE} AS s FROM c WHERE domain_id = 'time_series' AND {_SOUND}", "round(s, 6) AS combined_score"),
    "search_hybrid": f"WITH {_HYBRID} " + _top("SELECT id, text_score, vector_score, 0.3 * ts + 0.7 * vs AS s FROM h", "round(text_score, 6) AS text_score, round(vector_score, 6) AS vector_score, round(s, 6) AS combined_score"),
    "search_hybrid_of_type": f"WITH {_HYBRID} " + _top("SELECT id, 0.5 * ts + 0.5 * vs AS s FROM h WHERE source_id IN (SELECT id FROM sources WHERE source_type = 'paper')", "round(s, 6) AS combined_score"),
    "search_hybrid_rrf": f"""WITH {_HYBRID},
        b AS (SELECT id, text_score, vector_score FROM (SELECT *, 0.3 * ts + 0.7 * vs AS s FROM h) ORDER BY s DESC, id LIMIT 20),
        r AS (SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY text_score DESC, id)) + 1.0 / (60 + row_number() OVER (ORDER BY vector_score DESC, id)) AS s FROM b) """
    + _top("SELECT id, s FROM r", "round(s, 6) AS combined_score"),
    "search_fused": _FUSED
    + "m AS (SELECT max(citation_score) > 0 AS has FROM j) "
    + _top("SELECT id, citation_score, (0.3 * text_score + 0.7 * vector_score + CASE WHEN has THEN 0.15 * citation_score ELSE 0 END) / (1.0 + CASE WHEN has THEN 0.15 ELSE 0 END) AS s FROM j, m", "round(citation_score, 6) AS citation_score, round(s, 6) AS combined_score"),
    "search_fused_normalized": _FUSED
    + "x AS (SELECT id, "
    + ", ".join(f"CASE WHEN max({c}) OVER () > min({c}) OVER () THEN ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) WHEN max({c}) OVER () > 0 THEN 1.0 ELSE 0.0 END AS {c}" for c in ("text_score", "vector_score", "citation_score"))
    + " FROM j), m AS (SELECT max(citation_score) > 0 AS has FROM x) "
    + _top("SELECT id, (0.3 * text_score + 0.7 * vector_score + CASE WHEN has THEN 0.15 * citation_score ELSE 0 END) / (1.0 + CASE WHEN has THEN 0.15 ELSE 0 END) AS s FROM x, m", "round(s, 6) AS combined_score"),
    "search_reranked": f"""WITH {_HYBRID},
        b AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS original_rank FROM (SELECT id, 0.3 * ts + 0.7 * vs AS s FROM h ORDER BY s DESC, id LIMIT 50)),
        r AS (SELECT b.id, original_rank, length(content) / 100.0 AS s FROM b LEFT JOIN c ON c.id = b.id)
        SELECT id, original_rank, round(s, 6) AS rerank_score, row_number() OVER (ORDER BY s DESC NULLS LAST, original_rank) AS rank FROM r QUALIFY rank <= 10""",
    "batch_vector_search": """WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        s AS (SELECT q.id AS query_id, e.id, list_cosine_similarity(q.v, e.v) AS c FROM e JOIN e q ON q.id % 100 = 0 AND q.id <> e.id)
        SELECT query_id, id, round(c, 6) AS cosine, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) AS rank FROM s QUALIFY rank <= 10""",
    "synonym_expansion": r"""WITH q AS (SELECT DISTINCT p_name || ' ' || p_brand AS query FROM part),
        n AS (SELECT query, trim(regexp_replace(regexp_replace(replace(lower(query), '_', ' '), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) AS m FROM q),
        s AS (SELECT * FROM (VALUES ('promo', 'advertised'), ('promo', 'offer'), ('economy', 'cheap'), ('economy', 'low cost'), ('brand13', 'thirteen')) t(term, syn)),
        j AS (SELECT query, syn FROM n LEFT JOIN s ON contains(m, term))
        SELECT query, coalesce(string_agg(DISTINCT syn, ',' ORDER BY syn) FILTER (NOT contains(lower(query), syn)), '') AS expansions FROM j GROUP BY query""",
    "concept_search": """WITH r AS (SELECT p_partkey AS id, p_name AS name, CASE WHEN lower(p_name) = 'red' THEN 1.0 WHEN starts_with(lower(p_name), 'red') THEN 0.9 WHEN contains(lower(p_name), 'red') THEN 0.8
            WHEN contains(lower(p_brand), 'red') OR contains(lower(p_type), 'red') THEN 0.5 END AS relevance FROM part WHERE p_partkey % 5 = 0)
        SELECT id, name, CAST(relevance AS DOUBLE) AS relevance FROM r WHERE relevance IS NOT NULL ORDER BY relevance DESC, name, id LIMIT 50""",
    "query_concepts": r"""WITH q AS (SELECT 'trade of asia and ' || n_name || ' middle east' AS query FROM nation),
        w AS (SELECT query, lower(trim(query)) AS t, list_filter(string_split_regex(lower(trim(query)), '\s+'), lambda x: length(x) >= 2) AS w FROM q),
        n AS (SELECT r_regionkey AS id, lower(r_name) AS name FROM region),
        k AS (SELECT query, id, 0 AS kind, name FROM w JOIN n ON t = name
            UNION ALL SELECT query, id, 1, name FROM w JOIN n ON list_contains(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), name)
            UNION ALL SELECT query, id, 2, name FROM w JOIN n ON list_contains(w, name)
            UNION ALL SELECT query, id, 3, name FROM w JOIN n ON length(name) > 3 AND contains(t, name)),
        b AS (SELECT query, id, min(kind * 1000 - length(name)) AS o FROM k GROUP BY query, id)
        SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY o, id) AS rank FROM b QUALIFY rank <= 5""",
    "unified_concepts": """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT e AS q FROM v WHERE id = 7),
        n AS (SELECT id, 0 AS kind, CAST(row_number() OVER (ORDER BY o, id) AS DOUBLE) AS at_ FROM (SELECT id, CASE WHEN id = 12 THEN 1000 ELSE 3000 END - length('item ' || id) AS o FROM v WHERE contains('items like item 12 and item 7', 'item ' || id)) QUALIFY row_number() OVER (ORDER BY o, id) <= 6),
        s AS (SELECT id, 1 AS kind, -(1 + list_cosine_similarity(e, q)) / 2 AS at_ FROM v, q WHERE (1 + list_cosine_similarity(e, q)) / 2 >= 0.65 ORDER BY at_, id LIMIT 6),
        b AS (SELECT id, min(kind) AS kind, arg_min(at_, kind) AS at_ FROM (FROM n UNION ALL FROM s) GROUP BY id)
        SELECT id, row_number() OVER (ORDER BY kind, at_, id) AS rank FROM b QUALIFY rank <= 6""",
    "similar_vectors": f"SELECT vec_id AS id, round({_VECTOR_SCORE}, 6) AS similarity FROM embeddings WHERE {_VECTOR_SCORE} >= 0.5 ORDER BY {_VECTOR_SCORE} DESC, vec_id LIMIT 25",
    "sound_embeddings": f"WITH {CHUNKS_SQL} SELECT id, {_SOUND} AS sound, CASE WHEN {_SOUND} THEN round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), list_transform(range(64), lambda i: 1.0::DOUBLE)), 6) ELSE 0.0 END AS cosine FROM c",
}
