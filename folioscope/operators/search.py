"""Retrieval: full text, vectors, and their fusion with graph and citation signals.

Similarities of search results are (1 + cosine) / 2. Ties always break by id.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions.stems import stem, stem_of
from folioscope.functions.text import match_normal, tokens, words_of
from folioscope.functions.vectors import cosine_with, half_similarity, has_direction
from folioscope.operators.lineage import materialize

#: Weights of text and vector for each use of a search.
CONTEXT_WEIGHTS = {"building": (0.2, 0.8), "auditing": (0.5, 0.5), "balanced": (0.3, 0.7)}
K1, B = 1.2, 0.75
LOCATION_BOOST, CONTENT_BOOST = 1.0, 0.4
EXPANSION_WEIGHT = 0.4


@dataclass(frozen=True)
class SearchQuery:
    """What to search for. Needs a text or an embedding; weights are of text, vector, graph and citations."""

    text: str | None = None
    embedding: list[float] | None = None
    limit: int = 10
    weights: dict[str, float] = field(default_factory=lambda: {"text": 0.3, "vector": 0.7, "graph": 0.0, "citation": 0.0})
    domain_id: str | None = None
    source_type: str | None = None
    scoring: str = "weighted"

    def __post_init__(self) -> None:
        if not self.text and not self.embedding:
            raise ValueError("a query needs a text or an embedding")
        if self.scoring not in ("weighted", "rrf"):
            raise ValueError("scoring is weighted or rrf")
        if sum(self.active().values()) <= 0:
            raise ValueError("the weights of the active signals must have a positive sum")

    def active(self) -> dict[str, float]:
        """Weights of the signals that the query has."""
        has = {"text": bool(self.text), "vector": bool(self.embedding), "graph": True, "citation": True}
        return {k: v for k, v in self.weights.items() if has[k] and v > 0}


def _stems_of(text: str) -> list[str]:
    return sorted({stem_of(w) for w in words_of(text)})


def _bm25(tf: Column, size: Column, mean: Column, boost: float) -> Column:
    return F.lit(boost) * F.coalesce(F.try_divide(tf * (K1 + 1), tf + K1 * (1 - B + B * F.coalesce(F.try_divide(size, mean), F.lit(0.0)))), F.lit(0.0))


def _idf(n: Column, df: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


def text_scores(chunks: DataFrame, text: str, expansions: list[str] | None = None) -> DataFrame:
    """``chunks`` with ``text_score``: BM25 of stems over location and content, 0 unless all stems of the text occur.

    With ``expansions`` any stem counts, those of the expansions by EXPANSION_WEIGHT.
    Only words that begin like a stem are stemmed. Counts come from an expression on each row and the corpus statistics
    from one aggregate of one row, so nothing is exploded or shuffled.
    """
    weights = dict.fromkeys(_stems_of(text), 1.0)
    for e in expansions or []:
        weights |= {t: EXPANSION_WEIGHT for t in _stems_of(e) if t not in weights}
    terms = sorted(weights)
    if not terms:
        return chunks.withColumn("text_score", F.lit(0.0))
    begins = "^(" + "|".join(re.escape(t[: max(1, len(t) - 1)]) for t in terms) + ")"
    rows = chunks.withColumn("__wc", tokens("content")).withColumn("__wl", tokens("location"))
    for f in "cl":
        rows = rows.withColumn(f"__{f}", F.transform(F.filter(f"__w{f}", lambda w: w.rlike(begins)), stem)).withColumn(f"__{f}n", F.size(f"__w{f}").cast("double"))
    count = lambda words, t: F.size(F.filter(words, lambda w: w == t)).cast("double")
    rows = rows.withColumn("__tf", F.array(*[F.struct(count(F.col("__l"), t).alias("l"), count(F.col("__c"), t).alias("c")) for t in terms]))
    has = [(F.col("__tf")[i]["l"] + F.col("__tf")[i]["c"]) > 0 for i in range(len(terms))]
    stats = rows.agg(F.count("*").cast("double").alias("__n"), F.avg("__cn").alias("__ca"), F.avg("__ln").alias("__la"), F.array(*[F.count_if(h).cast("double") for h in has]).alias("__df"))
    total, every = F.lit(0.0), F.lit(True)
    for i, t in enumerate(terms):
        parts = [_bm25(F.col("__tf")[i][f], F.col(f"__{f}n"), F.col(f"__{f}a"), boost) for f, boost in (("l", LOCATION_BOOST), ("c", CONTENT_BOOST))]
        total = total + F.lit(weights[t]) * _idf(F.col("__n"), F.col("__df")[i]) * (parts[0] + parts[1])
        every = every & has[i]
    scored = rows.crossJoin(F.broadcast(stats)).withColumn("text_score", total if expansions else F.when(every, total).otherwise(0.0))
    return scored.select(*chunks.columns, "text_score")


@dataclass(frozen=True)
class TextIndex:
    """A stored index of stems: postings (bucket, term, id, l, c, ln, cn) in folders by bucket, and one row of statistics (n, la, ca)."""

    postings: DataFrame
    statistics: DataFrame
    buckets: int


def build_text_index(chunks: DataFrame, buckets: int = 64) -> TextIndex:
    """The index of chunks (id, content, location), each once. A task counts its chunks' stems before anything is shuffled; words are stemmed once for each that occurs."""
    size = lambda f: F.size(tokens(f))
    of_field = lambda f: F.transform(tokens(f), lambda w: F.struct(w.alias("word"), F.lit(f).alias("field")))
    about = chunks.select("id", size("location").alias("ln"), size("content").alias("cn"), F.concat(of_field("location"), of_field("content")).alias("t"))
    about = about.select("id", "ln", "cn", F.explode_outer("t").alias("t"))  # sizes come before, else each exploded row would count them anew
    counted = materialize(about.groupBy("id", "ln", "cn", "t.word").agg(F.count_if(F.col("t.field") == "location").alias("l"), F.count_if(F.col("t.field") == "content").alias("c")), "words")
    stems = materialize(counted.select("word").where("word IS NOT NULL").distinct().withColumn("term", F.get(F.transform(F.array("word"), stem), F.lit(0))), "stems")
    postings = counted.join(stems, "word").groupBy("term", "id", "ln", "cn").agg(F.sum("l").alias("l"), F.sum("c").alias("c"))
    postings = postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    stored = materialize(postings.repartition(buckets, "bucket").sortWithinPartitions("bucket", "term", "id"), "postings", by="bucket")
    each = counted.select("id", "ln", "cn").distinct()
    statistics = materialize(each.agg(F.count("*").cast("double").alias("n"), F.avg("ln").alias("la"), F.avg("cn").alias("ca")), "statistics")
    return TextIndex(stored, statistics, buckets)


def search_index(index: TextIndex, text: str, limit: int = 10) -> DataFrame:
    """As search_text, from the index: only the folders of the text's stems are read."""
    terms = _stems_of(text)
    spark = index.postings.sparkSession
    at = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(F.pmod(F.xxhash64("t"), F.lit(index.buckets)).cast("int")).collect()]
    held = index.postings.where(F.col("bucket").isin(at) & F.col("term").isin(terms))
    df = held.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    rows = held.join(df, "term").crossJoin(F.broadcast(index.statistics))
    part = _idf(F.col("n"), F.col("df")) * (_bm25(F.col("l").cast("double"), F.col("ln").cast("double"), F.col("la"), LOCATION_BOOST) + _bm25(F.col("c").cast("double"), F.col("cn").cast("double"), F.col("ca"), CONTENT_BOOST))
    found = rows.groupBy("id").agg(F.sum(part).alias("combined_score"), F.count("*").alias("met")).where(F.col("met") == len(terms))
    return _ranked(found, limit, ["id", "combined_score"])


def search_text(chunks: DataFrame, query: SearchQuery) -> DataFrame:
    """The best chunks by text; those without an embedding count too."""
    rows = _of_domain(text_scores(chunks, query.text or ""), query).where("text_score > 0")
    return _ranked(rows.withColumn("combined_score", F.col("text_score")), query.limit, ["id", "combined_score"])


def vector_scores(chunks: DataFrame, embedding: list[float]) -> DataFrame:
    """``chunks`` with a sound embedding, and ``vector_score``."""
    return chunks.where(has_direction("embedding", len(embedding))).withColumn("vector_score", half_similarity(cosine_with("embedding", embedding)))


def search_vector(chunks: DataFrame, query: SearchQuery) -> DataFrame:
    """The chunks nearest to the embedding; a chunk delivered twice counts once, and only ids and scores are shuffled."""
    rows = vector_scores(_of_domain(chunks, query), query.embedding or []).select("id", "vector_score")
    return _ranked(rows.groupBy("id").agg(F.max("vector_score").alias("combined_score")), query.limit, ["id", "combined_score"])


def min_max(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """New columns with the range of each old one as [0, 1]; a constant positive column becomes 1, a constant 0 stays 0. The range is one broadcast row, not a window over one partition."""
    spans = rows.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])
    rows = rows.crossJoin(F.broadcast(spans))
    for old, new in columns.items():
        low, high = F.col(f"__min_{old}"), F.col(f"__max_{old}")
        rows = rows.withColumn(new, F.when(high > low, (F.col(old) - low) / (high - low)).when(high > 0, 1.0).otherwise(0.0))
    return rows.drop(*spans.columns)


def search_hybrid(chunks: DataFrame, sources: DataFrame, query: SearchQuery) -> DataFrame:
    """Text and vector fused: scores as ranges over all chunks with a sound embedding, weighted, the best ``limit``.

    The source's type is applied after the ranges are known, the domain before.
    With rrf the rows found are ranked anew by reciprocal ranks.
    """
    rows = _hybrid_rows(chunks, sources, query)
    found = _ranked(rows, query.limit, ["id", "text_score", "vector_score", "combined_score"])
    return fuse_ranks(found, ["text_score", "vector_score"], query.limit) if query.scoring == "rrf" else found


def _hybrid_rows(chunks: DataFrame, sources: DataFrame, query: SearchQuery) -> DataFrame:
    rows = vector_scores(text_scores(_of_domain(chunks, query), query.text or ""), query.embedding or [])
    # Both ranges and the fusion need the scores of all rows: they are computed once, the texts are not read again.
    rows = materialize(rows.select("id", "source_id", "text_score", "vector_score"), "scores")
    rows = min_max(rows, {"text_score": "__t", "vector_score": "__v"})
    weights = {k: v for k, v in query.active().items() if k in ("text", "vector")}
    total = sum(weights.values())
    rows = rows.withColumn("combined_score", (weights.get("text", 0.0) * F.col("__t") + weights.get("vector", 0.0) * F.col("__v")) / total).drop("__t", "__v")
    if query.source_type is not None:
        rows = rows.join(sources.where(F.col("source_type") == query.source_type).select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return rows


def search_fused(chunks: DataFrame, sources: DataFrame, query: SearchQuery, graph_scores: DataFrame | None = None, normalize: bool = False) -> DataFrame:
    """Four signals: twice ``limit`` rows of the hybrid search, with graph scores (id, graph_score) and the sources' citation authority.

    Signals that are zero throughout lose their weight, and the others are
    weighed by what remains. Raw scores are fused; ``normalize`` makes ranges first.
    """
    base = _ranked(_hybrid_rows(chunks, sources, query), 2 * query.limit, ["id", "source_id", "text_score", "vector_score"]).drop("rank")
    rows = base.join(graph_scores, "id", "left") if graph_scores is not None else base.withColumn("graph_score", F.lit(0.0))
    rows = rows.join(sources.select(F.col("id").alias("source_id"), F.col("citation_authority").cast("double").alias("citation_score")), "source_id", "left")
    signals = {"text": "text_score", "vector": "vector_score", "graph": "graph_score", "citation": "citation_score"}
    rows = rows.fillna(0.0, list(signals.values()))
    if normalize:
        rows = min_max(rows, {c: f"__n_{c}" for c in signals.values()}).select("id", *[F.col(f"__n_{c}").alias(c) for c in signals.values()])
    if query.scoring == "rrf":
        return fuse_ranks(rows.select("id", *[F.when(F.col(c) > 0, F.col(c)).alias(c) for c in signals.values()]), list(signals.values()), query.limit)
    most = rows.agg(*[F.max(c).alias(f"__{k}") for k, c in signals.items()])
    weight = {k: F.when(F.col(f"__{k}") > 0, query.weights.get(k, 0.0)).otherwise(0.0) if k in ("graph", "citation") else F.lit(query.weights.get(k, 0.0)) for k in signals}
    total = sum(weight.values(), F.lit(0.0))
    fused = sum((weight[k] * F.col(c) for k, c in signals.items()), F.lit(0.0))
    rows = rows.crossJoin(F.broadcast(most)).withColumn("combined_score", F.try_divide(fused, total))
    return _ranked(rows, query.limit, ["id", *signals.values(), "combined_score"])


def fuse_ranks(rows: DataFrame, signals: list[str], limit: int, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion over the rows given: the sum of 1 / (k + rank) over signals, null signals left out."""
    score = F.lit(0.0)
    for s in signals:
        order = Window.partitionBy(F.col(s).isNull()).orderBy(F.desc(s), "id")
        rows = rows.withColumn(f"__r_{s}", F.when(F.col(s).isNotNull(), F.row_number().over(order)))
        score = score + F.coalesce(F.try_divide(F.lit(1.0), F.col(f"__r_{s}") + k), F.lit(0.0))
    return _ranked(rows.withColumn("combined_score", score), limit, ["id", *signals, "combined_score"])


def reranked(results: DataFrame, scores: DataFrame, limit: int) -> DataFrame:
    """Results in the order of a table of outside scores (id, rerank_score); results without a score come last, in their old order."""
    rows = results.withColumnRenamed("rank", "original_rank").join(scores, "id", "left")
    by = Window.orderBy(F.desc_nulls_last("rerank_score"), "original_rank")
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)


def batch_vector_search(rows: DataFrame, queries: DataFrame, k: int = 10, block: int = 2048, least: float = -1.0) -> DataFrame:
    """query_id, id, cosine and rank of the k rows nearest to each query, exactly, of a cosine of at least ``least``.

    Both sides need id and embedding, all of one length. Queries and rows are
    packed into blocks, each pair of blocks is one matrix product, and only the
    k best of each query and block go on. A row is no neighbour of the query
    with its own id. Rows without a sound embedding are left out.
    """
    import numpy as np
    import pyarrow as pa

    kind = dict(rows.dtypes)["id"]

    def packed(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            sizes = np.asarray(batch.column(1).value_lengths().fill_null(-1))
            size = int(sizes.max(initial=0))
            at = np.flatnonzero(sizes == size) if size else np.empty(0, np.int64)
            flat = batch.column(1).take(pa.array(at)).flatten().cast(pa.float32()).fill_null(float("nan"))
            vectors = np.asarray(flat, np.float32).reshape(len(at), max(size, 1))
            good = np.isfinite(vectors).all(1) & (vectors != 0).any(1)
            at, vectors = at[good], vectors[good]
            for i in range(0, len(at), block):
                ids = batch.column(0).take(pa.array(at[i : i + block]))
                lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([lists, pa.array([vectors[i : i + block].tobytes()])], ["ids", "vectors"])

    def unit(raw, n):  # noqa: ANN001, ANN202
        x = np.frombuffer(raw, np.float32).reshape(n, -1).astype(np.float64)
        return x / np.linalg.norm(x, axis=1)[:, None]

    def products(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for r in range(batch.num_rows):
                ids, q_ids = batch.column("ids")[r].values, batch.column("q_ids")[r].values
                x, q = unit(batch.column("vectors")[r].as_py(), len(ids)), unit(batch.column("q_vectors")[r].as_py(), len(q_ids))
                if q.shape[1] != x.shape[1]:
                    continue
                names, q_names = (np.asarray(v.to_pylist()) for v in (ids, q_ids))
                cos = q @ x.T
                cos[q_names[:, None] == names[None, :]] = -2
                if len(names) > 8 * k:  # only what reaches a query's k-th value can be among its best, ties included
                    kth = -np.partition(-cos, k - 1, axis=1)[:, k - 1 : k]
                    a, b = np.nonzero(cos >= kth)
                else:
                    a, b = (v.ravel() for v in np.indices(cos.shape))
                order = np.lexsort((names[b], -cos[a, b], a))
                a, b = a[order], b[order]
                place = np.arange(len(a)) - np.searchsorted(a, a)
                good = (place < k) & (cos[a, b] > -2) & (cos[a, b] >= least)
                a, b = a[good], b[good]
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(cos[a, b])], ["query_id", "id", "cosine"])

    block_kind = f"ids array<{kind}>, vectors binary"
    left = queries.select(F.col("id").cast(kind), "embedding").mapInArrow(packed, block_kind).select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    right = rows.select("id", "embedding").mapInArrow(packed, block_kind)
    found = right.crossJoin(left).mapInArrow(products, f"query_id {kind}, id {kind}, cosine double")
    by = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def with_synonyms(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """``queries`` (query) with ``expansions``: synonyms of a term (term, synonyms) that is the query, one of its words, or part of it; none that the query already holds."""
    q = queries.withColumn("__n", match_normal("query"))
    s = synonyms.select(match_normal("term").alias("__t"), "synonyms")
    hit = (F.col("__n") == F.col("__t")) | F.array_contains(F.split("__n", " "), F.col("__t")) | F.contains(F.col("__n"), F.col("__t"))
    met = q.join(s, hit & (F.col("__t") != ""), "left").select("query", "__n", F.explode_outer("synonyms").alias("__s"))
    fresh = F.when(~F.contains(F.lower("query"), F.lower("__s")), F.lower("__s"))
    return met.groupBy("query").agg(F.sort_array(F.collect_set(fresh)).alias("expansions"))


def expansions_of(text: str, synonyms: DataFrame, concepts: DataFrame | None = None, edges: DataFrame | None = None, most: int = 10) -> list[str]:
    """What a search of ``text`` also looks for: synonyms of its terms, then names of concepts one edge from those it names, the strongest first; at most ``most``."""
    spark = synonyms.sparkSession
    query = spark.createDataFrame([(text,)], "query string")
    found = with_synonyms(query, synonyms).first()["expansions"]
    if concepts is not None and edges is not None:
        named = query_concepts(concepts, query).select(F.col("id").alias("src"))
        both = edges.select("src", "dst", "strength").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "strength"))
        near = both.join(named, "src").groupBy("dst").agg(F.max("strength").alias("strength")).join(concepts.select(F.col("id").alias("dst"), F.lower("name").alias("name")), "dst")
        found += [r["name"] for r in near.orderBy(F.desc("strength"), "name").limit(most).collect()]
    return list(dict.fromkeys(e for e in found if e not in text.lower()))[:most]


def search_expanded(chunks: DataFrame, query: SearchQuery, expansions: list[str]) -> DataFrame:
    """The best chunks by a text and its expansions (see text_scores), of which any may occur, fused with the vector if the query has one."""
    rows = text_scores(_of_domain(chunks, query), query.text or "", expansions).where("text_score > 0")
    if not query.embedding:
        return _ranked(rows.withColumn("combined_score", F.col("text_score")), query.limit, ["id", "combined_score"])
    rows = materialize(vector_scores(rows, query.embedding).select("id", "text_score", "vector_score"), "scores")
    rows = min_max(rows, {"text_score": "__t", "vector_score": "__v"})
    weights = query.active()
    fused = (weights.get("text", 0.0) * F.col("__t") + weights.get("vector", 0.0) * F.col("__v")) / (weights.get("text", 0.0) + weights.get("vector", 0.0))
    return _ranked(rows.withColumn("combined_score", fused), query.limit, ["id", "text_score", "vector_score", "combined_score"])


def weighted_terms(query: str, expansions: list[str]) -> Column:
    """The query for a weighted text index: own words :A, words of expansions :B, joined by |."""
    marked = lambda text, mark: F.transform(F.filter(F.split(F.regexp_replace(F.lit(text.lower()), r"[^\w\s\-]", ""), r"\s+"), lambda w: w != ""), lambda w: F.concat(w, F.lit(f":{mark}")))
    return F.array_join(F.array_distinct(F.flatten(F.array(marked(query, "A"), *[marked(e, "B") for e in expansions]))), " | ")


def query_concepts(concepts: DataFrame, queries: DataFrame, most: int = 5) -> DataFrame:
    """query, id and rank of the concepts that a query names: the whole query, two words, one word, then names longer than three letters inside it, longer ones first."""
    q = queries.select("query", F.lower(F.trim("query")).alias("__q")).withColumn("__w", F.filter(F.split("__q", r"\s+"), lambda w: F.length(w) >= 2))
    pairs = F.when(F.size("__w") > 1, F.transform(F.sequence(F.lit(0), F.size("__w") - 2), lambda i: F.concat_ws(" ", F.get(F.col("__w"), i), F.get(F.col("__w"), i + 1)))).otherwise(F.array().cast("array<string>"))
    patterns = F.concat(F.array(F.struct(F.lit(0).alias("kind"), F.col("__q").alias("name"))), F.transform(pairs, lambda p: F.struct(F.lit(1).alias("kind"), p.alias("name"))), F.transform("__w", lambda w: F.struct(F.lit(2).alias("kind"), w.alias("name"))))
    exact = q.select("query", F.inline(patterns)).join(concepts.select("id", F.col("canonical_name").alias("name")), "name").select("query", "id", "kind", F.length("name").alias("size"))
    inside = q.join(concepts.where("length(canonical_name) > 3"), F.contains(F.col("__q"), F.col("canonical_name"))).select("query", "id", F.lit(3).alias("kind"), F.length("canonical_name").alias("size"))
    best = exact.unionByName(inside).groupBy("query", "id").agg(F.min(F.struct("kind", -F.col("size"))).alias("best"))
    by = Window.partitionBy("query").orderBy("best", "id")
    return best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most).select("query", "id", "rank")


def similar_concepts(concepts: DataFrame, embedding: list[float], threshold: float = 0.8, limit: int = 10) -> DataFrame:
    """id and similarity (1 + cosine) / 2 of at least ``threshold``."""
    rows = vector_scores(concepts, embedding).withColumnRenamed("vector_score", "similarity").where(F.col("similarity") >= threshold)
    return rows.orderBy(F.desc("similarity"), "id").limit(limit).select("id", "similarity")


def unified_concepts(concepts: DataFrame, text: str, embedding: list[float] | None = None, most: int = 5, least: float = 0.85) -> DataFrame:
    """id and rank of the concepts that a query means: those it names (see query_concepts) first, then those whose vector has a cosine of at least ``least`` with its own, without repeats."""
    named = query_concepts(concepts, concepts.sparkSession.createDataFrame([(text,)], "query string"), most).select("id", F.lit(0).alias("kind"), F.col("rank").cast("double").alias("at"))
    if embedding is not None:
        near = similar_concepts(concepts.select("id", "embedding"), embedding, (1 + least) / 2, most)
        named = named.unionByName(near.select("id", F.lit(1).alias("kind"), (-F.col("similarity")).alias("at")))
    best = named.groupBy("id").agg(F.min(F.struct("kind", "at")).alias("b")).orderBy("b", "id").limit(most)
    return best.select("id", F.row_number().over(Window.orderBy("b", "id")).alias("rank"))


def search_reranked(chunks: DataFrame, sources: DataFrame, query: SearchQuery, scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The best of five times as many hybrid results, at least 50, by the scores that ``scorer`` gives to their rows (id, content): a table (id, rerank_score)."""
    wide = replace(query, limit=max(50, 5 * query.limit))
    found = materialize(search_hybrid(chunks, sources, wide), "found")
    texts = chunks.select("id", "content").join(found.select("id"), "id", "left_semi").dropDuplicates(["id"])
    return reranked(found, scorer(texts), query.limit)


def concept_search(concepts: DataFrame, text: str, limit: int = 50, concept_type: str | None = None) -> DataFrame:
    """Concepts by name: equal names 1, names that begin with the text 0.9, names that hold it 0.8, aliases that hold it 0.5."""
    t = text.lower()
    rows = concepts if concept_type is None else concepts.where(F.col("concept_type") == concept_type)
    name, plain = F.lower("canonical_name"), F.lower("name")
    alias = F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.contains(F.lower(a), F.lit(t)))
    relevance = F.when((name == t) | (plain == t), 1.0).when(name.startswith(t) | plain.startswith(t), 0.9).when(F.contains(name, F.lit(t)) | F.contains(plain, F.lit(t)), 0.8).when(alias, 0.5)
    return rows.withColumn("relevance", relevance).where("relevance IS NOT NULL").orderBy(F.desc("relevance"), "name", "id").limit(limit).select("id", "name", "relevance")


def _of_domain(rows: DataFrame, query: SearchQuery) -> DataFrame:
    return rows if query.domain_id is None else rows.where(F.col("domain_id") == query.domain_id)


def _ranked(rows: DataFrame, limit: int, columns: list[str]) -> DataFrame:
    """The best rows by combined_score; the rank is given after the limit, so its window holds few rows."""
    top = rows.orderBy(F.desc("combined_score"), "id").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("combined_score"), "id"))).select(*columns, "rank")
