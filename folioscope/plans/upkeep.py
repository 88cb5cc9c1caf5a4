"""Queries of upkeep: tables, duplicates, merges, statistics, passages, exports and measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import bibtex_escaped, bibtex_key, canonical_name, file_name, jaccard, match_normal, shortened, tokens, trigrams
from folioscope.operators import audit as A
from folioscope.operators import evaluation as E
from folioscope.operators import passages as P
from folioscope.operators import quality as Q
from folioscope.operators import statistics as S
from folioscope.operators import tables as T
from folioscope.plans import corpus
from folioscope.plans.corpus import CHUNKS_SQL, EDGES_SQL, LINKS_SQL, PAPERS_SQL, QUEUE_SQL
from folioscope.sources import exports as X
from folioscope.sources.tables import table

CONCEPTS_SQL = "k AS (SELECT p_partkey AS id, p_name AS name, trim(p_name) AS canonical_name, ['METHOD', 'ASSUMPTION', 'PROBLEM', 'DEFINITION', 'THEOREM'][CAST(p_partkey % 5 AS INT) + 1] AS concept_type, 'd' || (p_size % 4) AS domain_id FROM part)"


# Tables


def insert_new_customers(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer").select("c_custkey", "c_name")
    base, more = c.where("c_custkey % 3 <> 0"), c.where("c_custkey % 2 = 0").withColumn("c_name", F.upper("c_name"))
    return T.insert_new(base, more, ["c_custkey"])


def insert_counts(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer").select("c_custkey", "c_name")
    return T.insert_counts(c.where("c_custkey % 3 <> 0"), c.where("c_custkey % 2 = 0"), ["c_custkey"])


def replace_customers(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer").select("c_custkey", "c_name")
    return T.replace_rows(c.where("c_custkey % 3 <> 0"), c.where("c_custkey % 2 = 0").withColumn("c_name", F.upper("c_name")), ["c_custkey"])


def merge_customers(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    more = c.where("c_custkey % 2 = 0").select("c_custkey", F.lit(None).cast("string").alias("c_name"), (F.col("c_acctbal") * 2).alias("c_acctbal"))
    return T.merge_rows(c.where("c_custkey % 3 <> 0"), more, ["c_custkey"])


def delete_cascade(spark: SparkSession, folder: str) -> DataFrame:
    gone = table(spark, folder, "customer").where("c_acctbal < 0")
    return T.delete_rows(table(spark, folder, "orders"), gone, {"o_custkey": "c_custkey"}).select("o_orderkey", "o_custkey")


def chunks_of_sources(spark: SparkSession, folder: str) -> DataFrame:
    first = [r[0] for r in table(spark, folder, "sources").select("id").orderBy("id").limit(3).collect()]
    return T.by_values(corpus.chunks(spark, folder), "source_id", first).select("id", "source_id")


def sources_by_method(spark: SparkSession, folder: str) -> DataFrame:
    return T.by_metadata(table(spark, folder, "sources"), "extraction_method", ["grobid", "pymupdf"]).select("id")


def chunks_by_source(spark: SparkSession, folder: str) -> DataFrame:
    return T.count_by(table(spark, folder, "chunks"), "source_id")


def reconciled_sources(spark: SparkSession, folder: str) -> DataFrame:
    return T.reconciled(table(spark, folder, "sources"), table(spark, folder, "citations").withColumnRenamed("id", "citation").withColumnRenamed("source_id", "id"), "id")


def parsed_papers(spark: SparkSession, folder: str) -> DataFrame:
    """Papers as scholarly XML, which refers to its venue, parsed again."""
    xml = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.concat(F.lit('<div><head>Abstract</head><p>'), xml("abstract"), F.lit(' <ref target="#b0">1</ref></p></div>'))
    tei = F.concat(F.lit("<TEI><teiHeader><titleStmt><title>"), xml("title"), F.lit("</title></titleStmt></teiHeader><text><body>"), body, F.lit('</body><back><listBibl><biblStruct xml:id="b0"><monogr><title>'), xml("venue"), F.lit("</title></monogr></biblStruct></listBibl></back></text></TEI>"))
    return X.parse_tei(corpus.papers(spark, folder).select(F.col("s2_corpus_id").alias("doc_id"), tei.alias("tei"))).fillna("", ["details"])


def page_of_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return T.page(corpus.chunks(spark, folder), [F.desc("created_at"), F.col("id")], 25, 50).select("id", "created_at")


def merged_metadata(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "sources").select("id", T.merged_json(F.col("metadata"), F.lit('{"total_pages": "0", "checked": "yes"}')).alias("m"))
    return rows.select("id", *[F.get_json_object("m", f"$.{k}").alias(k) for k in ("extraction_method", "total_pages", "checked")])


# Duplicates, merges, orphans


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as chunks of a language, some of them equal copies."""
    d = table(spark, folder, "documents")
    page = F.when(F.col("doc_id") % 3 > 0, (F.col("n_chars") % 5).cast("int"))
    return d.select(F.col("doc_id").alias("id"), F.col("lang").alias("source_id"), F.sha2("text", 256).alias("content_hash"), page.alias("page_start"), "created_at", "domain_id")


def duplicate_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return Q.duplicate_chunks(_documents(spark, folder))


def duplicate_groups(spark: SparkSession, folder: str) -> DataFrame:
    return Q.duplicate_groups(_documents(spark, folder))


def duplicate_evidence(spark: SparkSession, folder: str) -> DataFrame:
    c = _documents(spark, folder)
    edges = c.groupBy("source_id").agg(F.sort_array(F.collect_set("id")).alias("evidence_chunk_ids"))
    return Q.repointed_evidence(edges, Q.duplicate_chunks(c), "evidence_chunk_ids").select("source_id", F.array_join("evidence_chunk_ids", ",").alias("evidence"))


def duplicates_removed(spark: SparkSession, folder: str) -> DataFrame:
    c = _documents(spark, folder)
    links = c.select(F.col("id").alias("chunk_id"), F.col("domain_id").alias("concept_id"))
    kept, moved = Q.without_duplicates(c, links, Q.duplicate_chunks(c))
    return kept.agg(F.count("*").alias("chunks")).crossJoin(moved.agg(F.count("*").alias("links")))


def new_or_known(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    known = p.where("p_partkey < 5").select(canonical_name("p_name").alias("canonical_name")).distinct()
    return Q.new_or_known(p.select(F.col("p_partkey").alias("position"), F.concat(F.lit("The "), F.upper("p_name")).alias("name")), known).fillna(-1, ["match"])


def _named(spark: SparkSession, folder: str) -> DataFrame:
    """Types, events and words of regions as names with plurals, hyphens and articles."""
    n = table(spark, folder, "nation").select(F.col("n_nationkey").alias("id"), F.lower("n_name").alias("w"))
    forms = F.array(F.col("w"), F.concat("w", F.lit("s")), F.concat(F.lit("the "), "w"), F.concat("w", F.lit("-trade")), F.concat("w", F.lit(" trade")), F.concat("w", F.lit("es")))
    rows = n.select("id", F.posexplode(forms).alias("k", "canonical_name"))
    return rows.select((F.col("id") * 10 + F.col("k")).alias("id"), "canonical_name", F.col("canonical_name").alias("name"), F.array("canonical_name").alias("aliases"))


_NAMED_SQL = "nm AS (SELECT n_nationkey * 10 + k AS id, CASE k WHEN 0 THEN w WHEN 1 THEN w || 's' WHEN 2 THEN 'the ' || w WHEN 3 THEN w || '-trade' WHEN 4 THEN w || ' trade' ELSE w || 'es' END AS canonical_name FROM (SELECT n_nationkey, lower(n_name) AS w FROM nation), range(6) t(k))"


def plural_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return Q.plural_pairs(_named(spark, folder))


def hyphen_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return Q.form_pairs(_named(spark, folder), F.replace("canonical_name", F.lit("-"), F.lit(" ")))


def article_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return Q.form_pairs(_named(spark, folder), F.regexp_replace("canonical_name", "^(the|an|a) ", ""))


def merge_chains(spark: SparkSession, folder: str) -> DataFrame:
    chain = table(spark, folder, "part").where("p_partkey % 50 <> 0").select(F.col("p_partkey").alias("gone"), (F.col("p_partkey") - 1).alias("keep"))
    return Q.resolved_chains(chain)


def merged_edges(spark: SparkSession, folder: str) -> DataFrame:
    mapping = corpus.concepts(spark, folder).where("id % 10 <> 0").select(F.col("id").alias("old"), (F.col("id") - F.col("id") % 10).alias("new"))
    return Q.merged_edges(corpus.edges(spark, folder), mapping).select("src", "dst", "type", F.round("strength", 6).alias("strength"))


def orphan_concepts(spark: SparkSession, folder: str) -> DataFrame:
    strong = corpus.edges(spark, folder).where("strength > 0.98")
    return Q.orphans(corpus.concepts(spark, folder), strong).groupBy("concept_type").agg(F.count("*").alias("n"))


def prunable_concepts(spark: SparkSession, folder: str) -> DataFrame:
    protected = corpus.edges(spark, folder).where("strength > 0.95").select(F.col("src").alias("concept_id"))
    return Q.prunable(corpus.concepts(spark, folder), corpus.links(spark, folder), [protected], r"^(red|blue) ", 9, 30)


def domain_links(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    found = Q.nearest_between(e.where("label = 1"), e.where("label <> 1"), 0.2, 5)
    return Q.domain_links(found, 0.25, 0.3).select("a", "b", "link_type", F.round("confidence", 6).alias("confidence"))


def chunk_domains(spark: SparkSession, folder: str) -> DataFrame:
    return Q.inherited_domain(corpus.chunks(spark, folder), table(spark, folder, "sources"))[1]


# Statistics


def table_counts(spark: SparkSession, folder: str) -> DataFrame:
    return S.table_counts({n: table(spark, folder, n) for n in ("sources", "chunks", "citations", "papers", "domains", "documents")})


def sources_by_type(spark: SparkSession, folder: str) -> DataFrame:
    return S.grouped_counts(table(spark, folder, "sources"), "source_type")


def confidence_bands(spark: SparkSession, folder: str) -> DataFrame:
    return S.confidence_bands(corpus.citations(spark, folder)).select("band", "n", F.round("mean", 6).alias("mean"))


def citation_coverage(spark: SparkSession, folder: str) -> DataFrame:
    parts = corpus.citations(spark, folder).select(F.col("source_id").alias("id"))
    return S.coverage(table(spark, folder, "sources"), parts, "id").select("rows", "covered", F.round("share", 6).alias("share"))


def domain_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return S.domain_statistics(table(spark, folder, "domains"), table(spark, folder, "sources"), table(spark, folder, "chunks"), table(spark, folder, "citations"))


def log_statistics(spark: SparkSession, folder: str) -> DataFrame:
    rows = S.trailing_statistics(corpus.log(spark, folder), "2024-01-25 00:00:00", 10)
    return rows.select("method", "events", *[F.round(c, 4).alias(c) for c in ("total", "mean", "longest")], "first_at", "last_at")


def queue_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return S.queue_statistics(corpus.queue(spark, folder)).withColumn("pending_priority", F.round("pending_priority", 6))


def duration_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return S.index_percentiles(corpus.log(spark, folder), "duration", ["method"])


def extraction_metrics(spark: SparkSession, folder: str) -> DataFrame:
    log = corpus.log(spark, folder)
    runs = log.select((F.col("method") == "error").alias("failed"), F.get_json_object("metadata", "$.k").cast("int").alias("n_concepts"), F.col("duration").alias("seconds"))
    rows = S.extraction_metrics(runs)
    return rows.select("runs", "failure_alert", "empty_alert", *[F.round(c, 6).alias(c) for c in ("failure_rate", "empty_rate", "concepts_per_run", "runs_per_second")])


def frequent_concepts(spark: SparkSession, folder: str) -> DataFrame:
    return S.frequent_concepts(corpus.links(spark, folder), corpus.concepts(spark, folder))


# Passages and text


def chunk_filter(spark: SparkSession, folder: str) -> DataFrame:
    return P.filtered(corpus.chunks(spark, folder)).select("id", "decision", "reason")


def filter_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return P.filtered(corpus.chunks(spark, folder)).groupBy("decision", "reason").agg(F.count("*").alias("n"))


def chunk_metrics(spark: SparkSession, folder: str) -> DataFrame:
    m = P.chunk_metrics(F.col("content"))
    return corpus.chunks(spark, folder).where("content IS NOT NULL").select("id", *[v.cast("double").alias(k) if k != "letter_share" else F.round(v, 6).alias(k) for k, v in m.items()])


def packed_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return P.chunked(table(spark, folder, "documents"), 120, 30, 30)


def sentences(spark: SparkSession, folder: str) -> DataFrame:
    return P.sentence_rows(table(spark, folder, "documents"))


def headings(spark: SparkSession, folder: str) -> DataFrame:
    c = corpus.chunks(spark, folder)
    blocks = c.where("content IS NOT NULL").select(F.col("source_id").alias("doc_id"), F.col("page_start").alias("at"), F.col("location").alias("text"), F.length("content").cast("double").alias("size"))
    return P.heading_levels(blocks.where("text IS NOT NULL AND at IS NOT NULL"))


def last_headings(spark: SparkSession, folder: str) -> DataFrame:
    c = corpus.chunks(spark, folder).where("page_start IS NOT NULL").select(F.col("source_id").alias("doc_id"), F.col("page_start").alias("at"), "id", "location")
    heads = c.where("location LIKE 'Section%'").groupBy("doc_id", "at").agg(F.max("location").alias("text"))
    return P.last_heading(c.select("doc_id", "at", "id"), heads).select("id", "heading")


def canonical_names(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.citations(spark, folder).select("id", canonical_name(F.regexp_replace("title", r"[^\x20-\x7e]", "")).alias("canonical"))


def title_tokens(spark: SparkSession, folder: str) -> DataFrame:
    c = corpus.papers(spark, folder)
    return c.select("id", F.array_join(tokens("title"), " ").alias("tokens"), F.size(trigrams("title")).alias("n_trigrams"), match_normal("title").alias("plain"), file_name("title").alias("file"), bibtex_escaped("title").alias("escaped"), shortened("title", 40).alias("short"))


def title_overlap(spark: SparkSession, folder: str) -> DataFrame:
    p = corpus.papers(spark, folder).where("abstract IS NOT NULL")
    return p.select("id", F.round(jaccard(F.array_distinct(tokens("title")), F.array_distinct(tokens("abstract"))), 6).alias("jaccard"))


def bibtex_keys(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "sources").where("authors IS NOT NULL").select("id", bibtex_key(F.get("authors", F.lit(0)), "year", "title").alias("key"))


def source_bibliography(spark: SparkSession, folder: str) -> DataFrame:
    return X.sources_as_bibtex(table(spark, folder, "sources"))


def citation_bibliography(spark: SparkSession, folder: str) -> DataFrame:
    return X.citations_as_bibtex(corpus.citations(spark, folder))


def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    return X.page_texts(table(spark, folder, "documents")).select("doc_id", "page", "char_count")


def recognition_needed(spark: SparkSession, folder: str) -> DataFrame:
    c = corpus.chunks(spark, folder).select(F.col("source_id").alias("doc_id"), F.col("content").alias("text"))
    return X.needs_recognition(c, 950).select("doc_id", F.round("mean_chars", 4).alias("mean_chars"), "needs_ocr")


# Audit and measures


def graph_assumptions(spark: SparkSession, folder: str) -> DataFrame:
    rows = A.assumptions_in_graph(corpus.edges(spark, folder), corpus.concepts(spark, folder), "d1")
    return rows.select("method", "assumption", "name", "importance", F.round("strength", 6).alias("strength"))


def audited_assumptions(spark: SparkSession, folder: str) -> DataFrame:
    g = A.assumptions_in_graph(corpus.edges(spark, folder), corpus.concepts(spark, folder))
    cached = corpus.concepts(spark, folder).where("id % 4 = 0").select(F.col("id").alias("method"), F.upper("name").alias("name"), F.lit("technical").alias("importance"), F.lit("stated").alias("statement"))
    return A.audited(g, cached).select("method", F.lower("name").alias("name"), "importance", "statement", "origin", "needs_more")


def _hits(spark: SparkSession, folder: str) -> DataFrame:
    from folioscope.operators.search import batch_vector_search

    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    found = batch_vector_search(e, e.where("id % 100 = 0"), 10)
    targets = e.where("id % 100 = 0").select(F.col("id").alias("query"), "label").join(e.select("id", "label"), "label").select("query", "id").where("query <> id")
    return E.first_hits(found.withColumnRenamed("query_id", "query"), targets)


def retrieval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows = E.retrieval_metrics(_hits(spark, folder))
    return rows.select("queries", *[F.round(c, 6).alias(c) for c in rows.columns if c != "queries"])


def edge_metrics(spark: SparkSession, folder: str) -> DataFrame:
    e = corpus.edges(spark, folder)
    rows = E.set_metrics(e.where("strength > 0.93"), e.where("src % 3 <> 0"), ["src", "dst", "type"], ["type"])
    return rows.select("type", "hits", "expected", "found", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def confidence_precision(spark: SparkSession, folder: str) -> DataFrame:
    c = corpus.citations(spark, folder).select((F.col("doi").isNotNull()).alias("correct"), F.col("confidence_score").cast("double").alias("confidence"))
    return E.precision_at_confidence(c, [0.5, 0.6, 0.7, 0.8, 0.9]).select("cut", "n", F.round("precision", 6).alias("precision"))


def expected_edges(spark: SparkSession, folder: str) -> DataFrame:
    e = corpus.edges(spark, folder)
    wanted = e.where("src < 50").select("src", "dst", F.lit("USES").alias("type")).distinct().unionByName(e.where("src < 20").select("dst", "src", F.lit("REQUIRES").alias("type")).toDF("src", "dst", "type").distinct())
    return E.expected_edges(wanted, e)


QUERIES = {
    f.__name__: f
    for f in (
        insert_new_customers, insert_counts, replace_customers, merge_customers, delete_cascade, chunks_of_sources, sources_by_method, chunks_by_source, reconciled_sources, parsed_papers, page_of_chunks, merged_metadata,
        duplicate_chunks, duplicate_groups, duplicate_evidence, duplicates_removed, new_or_known, plural_pairs, hyphen_pairs, article_pairs, merge_chains, merged_edges, orphan_concepts, prunable_concepts, domain_links, chunk_domains,
        table_counts, sources_by_type, confidence_bands, citation_coverage, domain_statistics, log_statistics, queue_statistics, duration_percentiles, extraction_metrics, frequent_concepts,
        chunk_filter, filter_statistics, chunk_metrics, packed_chunks, sentences, headings, last_headings, canonical_names, title_tokens, title_overlap, bibtex_keys, source_bibliography, citation_bibliography, page_texts, recognition_needed,
        graph_assumptions, audited_assumptions, retrieval_metrics, edge_metrics, confidence_precision, expected_edges,
    )
}

_FILTER = rf"""{CHUNKS_SQL}, m AS (SELECT id, coalesce(content, '') AS t FROM c),
    v AS (SELECT id, length(t) AS n, length(t) - length(replace(t, chr(10), '')) + 1 AS lines,
        coalesce(length(regexp_replace(t, '[^A-Za-z]', '', 'g')) / nullif(length(t), 0), 0) AS letters,
        len(regexp_extract_all(t, '(?m)^[ \t\n\f\r]*\[?[0-9]+\]?[ \t\n\f\r]*[A-Z][a-z]+.*[0-9]{{4}}')) AS refs,
        len(regexp_extract_all(t, '(?m)^[ \t\n\f\r0-9.,\-|]+$')) AS rows,
        len(regexp_extract_all(t, '[∑∏∫∂∇√∞≈≠≤≥∈∉⊂⊃∪∩]')) AS eq,
        len(regexp_extract_all(t, '[^\x00-\x7F]{{5,}}|[!@#$%^&*]{{3,}}')) AS bad,
        len(regexp_extract_all(t, '[^ \t\n\f\r]+')) AS words FROM m),
    r AS (SELECT id, CASE WHEN n < 100 THEN 'skip too_short' WHEN n > 15000 THEN 'flag too_long' WHEN letters < 0.4 THEN 'skip few_letters' WHEN refs > 5 THEN 'skip references' WHEN rows > lines * 0.5 THEN 'flag table' WHEN bad > 3 THEN 'skip garbage' WHEN eq > 10 THEN 'flag equations' ELSE 'process good' END AS d FROM v),
    f AS (SELECT id, split_part(d, ' ', 1) AS decision, split_part(d, ' ', 2) AS reason FROM r)"""

_ASSUMPTIONS = f"""{EDGES_SQL}, {CONCEPTS_SQL},
    g AS (SELECT src AS method, dst AS assumption, any_value(name) AS name, CASE WHEN min(CASE type WHEN 'REQUIRES' THEN 0 ELSE 1 END) = 0 THEN 'critical' ELSE 'standard' END AS importance, max(strength) AS strength
        FROM e JOIN k ON k.id = dst WHERE type IN ('REQUIRES', 'USES') AND concept_type = 'ASSUMPTION' AND {{0}} GROUP BY src, dst)"""

_CANON = r"trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower({0})), '\s+', ' ', 'g'), '\s*\([^)]*\)\s*', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s\-]', '', 'g'), '-', ' ', 'g')), '^(the|a|an)\s+', ''), '\s+', ' ', 'g'))"

_TOKENS_SQL = "list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: NOT list_contains(string_split('a an and are as at be by for from has have in is it its of on or that the then this to was were which with', ' '), w))"
_ESCAPED_SQL = "replace(replace(replace(replace(replace(replace(replace(replace(replace({0}, '\\', '\\\\'), '&', '\\&'), '%', '\\%'), '#', '\\#'), '_', '\\_'), '{{', '\\{{'), '}}', '\\}}'), '~', '\\textasciitilde{{}}'), '^', '\\textasciicircum{{}}')"
_AUTHORS_SQL = "array_to_string(list_transform(authors, lambda a: CASE WHEN contains(a, ',') THEN a ELSE regexp_replace(trim(a), '^(.*)[ ]+([^ ]+)$', '\\2, \\1') END), ' and ')"
_KEY_SQL = "coalesce(regexp_replace(lower(CASE WHEN contains(authors[1], ',') THEN split_part(authors[1], ',', 1) ELSE split_part(trim(authors[1]), ' ', -1) END), '[^a-z]', '', 'g'), 'unknown') || coalesce(CAST(year AS VARCHAR), '0000') || coalesce(" + _TOKENS_SQL.format("coalesce(title, '')") + "[1], 'untitled')"
_TRIGRAMS_SQL = "list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def _bibtex_sql(kind: str, more: dict[str, str]) -> str:
    fields = {"author": _ESCAPED_SQL.format(_AUTHORS_SQL), "title": _ESCAPED_SQL.format("coalesce(title, '')"), "year": "CAST(year AS VARCHAR)"} | more
    lines = ", ".join(f"CASE WHEN {v} <> '' THEN '  {n} = {{' || {v} || '}}' END" for n, v in fields.items())
    return f"'@' || {kind} || '{{' || {_KEY_SQL} || ',' || chr(10) || concat_ws(',' || chr(10), {lines}) || chr(10) || '}}'"


_COPIES_SQL = """c AS (SELECT doc_id AS id, lang AS source_id, sha256(text) AS content_hash, CASE WHEN doc_id % 3 > 0 THEN n_chars % 5 END AS page_start, created_at, domain_id FROM documents),
    m AS (SELECT id, first(id) OVER (PARTITION BY source_id, lower(content_hash) ORDER BY page_start NULLS LAST, created_at NULLS FIRST, id) AS n FROM c WHERE content_hash IS NOT NULL)"""

ORACLE = {
    "insert_new_customers": "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, upper(c_name) FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 = 0",
    "insert_counts": "SELECT count(*) FILTER (c_custkey % 3 = 0) AS added, count(*) FILTER (c_custkey % 3 <> 0) AS skipped FROM customer WHERE c_custkey % 2 = 0",
    "replace_customers": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS c_name FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0",
    "merge_customers": "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS c_name, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0",
    "delete_cascade": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "chunks_of_sources": f"WITH {CHUNKS_SQL} SELECT id, source_id FROM c WHERE source_id IN (SELECT id FROM sources ORDER BY id LIMIT 3)",
    "sources_by_method": "SELECT id FROM sources WHERE metadata ->> '$.extraction_method' IN ('grobid', 'pymupdf')",
    "chunks_by_source": "SELECT source_id, count(DISTINCT id) AS n FROM chunks GROUP BY 1",
    "reconciled_sources": "SELECT CASE WHEN s.id IS NULL THEN 'only_right' WHEN c.id IS NULL THEN 'only_left' ELSE 'both' END AS status, count(*) AS n FROM (SELECT DISTINCT id FROM sources) s FULL JOIN (SELECT DISTINCT source_id AS id FROM citations) c ON s.id = c.id GROUP BY 1",
    "parsed_papers": f"""WITH {PAPERS_SQL}, t AS (SELECT s2_corpus_id AS doc_id, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, trim(regexp_replace(abstract || ' 1', '\\s+', ' ', 'g')) AS abstract, trim(regexp_replace(venue, '\\s+', ' ', 'g')) AS venue FROM p WHERE abstract IS NOT NULL AND title IS NOT NULL AND venue IS NOT NULL)
        SELECT doc_id, 'title' AS kind, 0 AS n, title AS text, '' AS details FROM t UNION ALL SELECT doc_id, 'section', 0, abstract, 'Abstract' FROM t
        UNION ALL SELECT doc_id, 'context', 0, abstract, 'b0' FROM t UNION ALL SELECT doc_id, 'citation', 0, venue, '' FROM t""",
    "page_of_chunks": f"WITH {CHUNKS_SQL} SELECT id, created_at FROM c ORDER BY created_at DESC, id LIMIT 25 OFFSET 50",
    "merged_metadata": "SELECT id, metadata ->> '$.extraction_method' AS extraction_method, '0' AS total_pages, 'yes' AS checked FROM sources",
    "duplicate_chunks": f"WITH {_COPIES_SQL} SELECT id AS old, n AS new FROM m WHERE id <> n",
    "duplicate_groups": f"WITH {_COPIES_SQL} SELECT source_id, lower(content_hash) AS hash, count(*) AS n FROM c WHERE content_hash IS NOT NULL GROUP BY ALL HAVING n > 1 ORDER BY n DESC, source_id NULLS FIRST, hash LIMIT 15",
    "duplicate_evidence": f"WITH {_COPIES_SQL} SELECT c.source_id, array_to_string(list_sort(list(DISTINCT coalesce(n, c.id))), ',') AS evidence FROM c LEFT JOIN m ON m.id = c.id GROUP BY 1",
    "duplicates_removed": f"WITH {_COPIES_SQL}, d AS (SELECT coalesce(n, c.id) AS n, domain_id FROM c LEFT JOIN m ON m.id = c.id) SELECT count(DISTINCT n) AS chunks, (SELECT count(*) FROM (SELECT DISTINCT n, domain_id FROM d)) AS links FROM d",
    "new_or_known": "WITH k AS (SELECT DISTINCT p_name AS name FROM part WHERE p_partkey < 5), f AS (SELECT p_partkey AS position, p_name AS canonical, min(p_partkey) OVER (PARTITION BY p_name) AS first FROM part) SELECT position, canonical, name IS NULL AND position = first AS is_new, CASE WHEN name IS NULL THEN first ELSE -1 END AS match FROM f LEFT JOIN k ON name = canonical",
    "plural_pairs": f"WITH {_NAMED_SQL}, t AS (SELECT id AS gone, 0 AS r, regexp_replace(canonical_name, 's$', '') AS s FROM nm WHERE canonical_name LIKE '%s' UNION ALL SELECT id, 1, regexp_replace(canonical_name, 'es$', '') FROM nm WHERE canonical_name LIKE '%es' UNION ALL SELECT id, 2, regexp_replace(canonical_name, 'ses$', 'sis') FROM nm WHERE canonical_name LIKE '%ses' UNION ALL SELECT id, 3, regexp_replace(canonical_name, 'ices$', 'ix') FROM nm WHERE canonical_name LIKE '%ices') SELECT gone, first(id ORDER BY r, id) AS keep FROM t JOIN nm ON s = canonical_name WHERE id <> gone GROUP BY gone",
    "hyphen_pairs": f"WITH {_NAMED_SQL} SELECT a.id AS gone, min(b.id) AS keep FROM nm a JOIN nm b ON replace(a.canonical_name, '-', ' ') = b.canonical_name WHERE a.canonical_name LIKE '%-%' GROUP BY a.id",
    "article_pairs": f"WITH {_NAMED_SQL} SELECT a.id AS gone, min(b.id) AS keep FROM nm a JOIN nm b ON regexp_replace(a.canonical_name, '^(the|an|a) ', '') = b.canonical_name WHERE a.id <> b.id AND a.canonical_name SIMILAR TO '(the|an|a) .*' GROUP BY a.id",
    "merge_chains": "SELECT p_partkey AS old, p_partkey - p_partkey % 50 AS new FROM part WHERE p_partkey % 50 <> 0",
    "merged_edges": f"WITH {EDGES_SQL} SELECT src - src % 10 AS src, CASE WHEN dst IN (SELECT p_partkey FROM part) THEN dst - dst % 10 ELSE dst END AS dst, type, round(max(strength), 6) AS strength FROM e WHERE src - src % 10 <> CASE WHEN dst IN (SELECT p_partkey FROM part) THEN dst - dst % 10 ELSE dst END GROUP BY ALL",
    "orphan_concepts": f"WITH {EDGES_SQL}, {CONCEPTS_SQL}, s AS (SELECT * FROM e WHERE strength > 0.98) SELECT concept_type, count(*) AS n FROM k WHERE id NOT IN (SELECT src FROM s) AND id NOT IN (SELECT dst FROM s) GROUP BY concept_type",
    "prunable_concepts": f"WITH {EDGES_SQL}, {LINKS_SQL}, {CONCEPTS_SQL} SELECT id FROM k WHERE (regexp_matches(canonical_name, '^(red|blue) ') OR length(canonical_name) > 9) AND id NOT IN (SELECT concept_id FROM l GROUP BY concept_id HAVING count(*) > 30) AND id NOT IN (SELECT src FROM e WHERE strength > 0.95)",
    "domain_links": "WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), s AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS c FROM v a JOIN v b ON a.label = 1 AND b.label <> 1), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS n FROM s WHERE c >= 0.2) SELECT a, b, CASE WHEN c >= 0.3 THEN 'EQUIVALENT' ELSE 'ANALOGOUS' END AS link_type, round(c, 6) AS confidence FROM r WHERE n <= 5 AND c >= 0.25",
    "chunk_domains": f"WITH {CHUNKS_SQL} SELECT c.id FROM c JOIN sources s ON s.id = c.source_id WHERE s.domain_id IS NOT NULL AND c.domain_id IS DISTINCT FROM s.domain_id",
    "table_counts": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("sources", "chunks", "citations", "papers", "domains", "documents")),
    "sources_by_type": "SELECT source_type AS kind, count(*) AS n FROM sources GROUP BY 1",
    "confidence_bands": "WITH q AS (SELECT DISTINCT ON (id) CAST(confidence_score AS DOUBLE) AS c FROM citations) SELECT CASE WHEN c >= 0.9 THEN '0.9-1.0' WHEN c >= 0.7 THEN '0.7-0.9' WHEN c >= 0.5 THEN '0.5-0.7' ELSE '0.0-0.5' END AS band, count(*) AS n, round(avg(c), 6) AS mean FROM q WHERE c IS NOT NULL GROUP BY 1",
    "citation_coverage": "SELECT count(*) AS rows, count(*) FILTER (id IN (SELECT source_id FROM citations)) AS covered, round(count(*) FILTER (id IN (SELECT source_id FROM citations)) / count(*), 6) AS share FROM sources",
    "domain_statistics": "SELECT d.id, d.name, (SELECT count(*) FROM sources s WHERE s.domain_id = d.id) AS sources, (SELECT count(DISTINCT c.id) FROM chunks c WHERE c.domain_id = d.id) AS chunks, (SELECT count(DISTINCT q.id) FROM citations q JOIN sources s ON s.id = q.source_id WHERE s.domain_id = d.id) AS citations FROM domains d",
    "log_statistics": "SELECT event_type AS method, count(*) AS events, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, round(max(value), 4) AS longest, min(ts) AS first_at, max(ts) AS last_at FROM events WHERE ts > TIMESTAMP '2024-01-15' AND ts <= TIMESTAMP '2024-01-25' GROUP BY 1",
    "queue_statistics": f"WITH {QUEUE_SQL} SELECT status, count(*) AS items, count(*) FILTER (priority <= 2) AS urgent, round(avg(CASE WHEN status = 'pending' THEN priority END), 6) AS pending_priority, CAST(sum(retry_count) AS BIGINT) AS retries FROM q GROUP BY status",
    "duration_percentiles": "SELECT event_type AS method, count(*) AS n, list_sort(list(value))[CAST(floor(count(*) / 2) AS INT) + 1] AS p50, list_sort(list(value))[CAST(least(floor(count(*) * 0.95), count(*) - 1) AS INT) + 1] AS p95 FROM events GROUP BY 1",
    "extraction_metrics": "WITH r AS (SELECT event_type = 'error' AS f, CAST(props ->> '$.k' AS INT) AS n, value AS s FROM events), a AS (SELECT count(*) AS runs, avg(f::INT) AS failure_rate, avg(CASE WHEN NOT f THEN (n = 0)::INT END) AS empty_rate, avg(n) AS concepts_per_run, count(*) / sum(s) AS runs_per_second FROM r) SELECT runs, failure_rate > 0.05 AS failure_alert, empty_rate > 0.15 AS empty_alert, round(failure_rate, 6) AS failure_rate, round(empty_rate, 6) AS empty_rate, round(concepts_per_run, 6) AS concepts_per_run, round(runs_per_second, 6) AS runs_per_second FROM a",
    "frequent_concepts": f"WITH {LINKS_SQL} SELECT concept_id AS id, p_name AS name, count(DISTINCT chunk_id) AS chunks FROM l JOIN part ON p_partkey = concept_id GROUP BY ALL HAVING chunks >= 3 ORDER BY chunks DESC, id LIMIT 50",
    "chunk_filter": f"WITH {_FILTER} SELECT * FROM f",
    "filter_statistics": f"WITH {_FILTER} SELECT decision, reason, count(*) AS n FROM f GROUP BY ALL",
    "chunk_metrics": f"WITH {_FILTER} SELECT v.id, n::DOUBLE AS length, lines::DOUBLE AS lines, words::DOUBLE AS words, round(letters, 6) AS letter_share, refs::DOUBLE AS references, rows::DOUBLE AS table_rows, eq::DOUBLE AS equations, bad::DOUBLE AS garbage FROM v JOIN c ON c.id = v.id WHERE content IS NOT NULL",
    "last_headings": f"WITH {CHUNKS_SQL} SELECT id, (SELECT h.location FROM c h WHERE h.source_id = x.source_id AND h.location LIKE 'Section%' AND h.page_start <= x.page_start ORDER BY h.page_start DESC, h.location DESC LIMIT 1) AS heading FROM c x WHERE page_start IS NOT NULL",
    "canonical_names": "SELECT DISTINCT ON (id) id, " + _CANON.format(r"regexp_replace(title, '[^\x20-\x7e]', '', 'g')") + " AS canonical FROM citations",
    "bibtex_keys": "SELECT id, regexp_replace(lower(CASE WHEN contains(authors[1], ',') THEN split_part(authors[1], ',', 1) ELSE split_part(trim(authors[1]), ' ', -1) END), '[^a-z]', '', 'g') || coalesce(CAST(year AS VARCHAR), '0000') || coalesce(list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda w: NOT list_contains(string_split('a an and are as at be by for from has have in is it its of on or that the then this to was were which with', ' '), w))[1], 'untitled') AS key FROM sources WHERE authors IS NOT NULL",
    "title_tokens": f"WITH {PAPERS_SQL} SELECT s2_paper_id AS id, array_to_string({_TOKENS_SQL.format('title')}, ' ') AS tokens, len({_TRIGRAMS_SQL}) AS n_trigrams, trim(regexp_replace(regexp_replace(replace(lower(title), '_', ' '), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS plain, substr(regexp_replace(trim(regexp_replace(lower(title), '[^a-z0-9\\s\\-]', '', 'g')), '[\\s\\-]+', '_', 'g'), 1, 50) AS file, {_ESCAPED_SQL.format('title')} AS escaped, CASE WHEN length(title) > 40 THEN substr(title, 1, 37) || '...' ELSE title END AS short FROM p",
    "title_overlap": f"WITH {PAPERS_SQL}, t AS (SELECT s2_paper_id AS id, list_distinct({_TOKENS_SQL.format('title')}) AS x, list_distinct({_TOKENS_SQL.format('abstract')}) AS y FROM p WHERE abstract IS NOT NULL) SELECT id, round(coalesce(len(list_intersect(x, y)) / nullif(len(list_distinct(x || y)), 0), 0), 6) AS jaccard FROM t",
    "source_bibliography": "SELECT id, " + _bibtex_sql("CASE source_type WHEN 'textbook' THEN 'book' WHEN 'paper' THEN 'article' ELSE 'misc' END", {k: f"(metadata ->> '$.{k}')" for k in ("publisher", "doi", "arxiv_id")}) + " AS bibtex FROM sources",
    "citation_bibliography": "SELECT DISTINCT ON (id) id, " + _bibtex_sql("CASE WHEN venue IS NOT NULL THEN 'article' ELSE 'misc' END", {"journal": _ESCAPED_SQL.format("venue"), "doi": "doi", "eprint": "arxiv_id"}) + " AS bibtex FROM citations",
    "page_texts": "WITH p AS (SELECT doc_id, unnest(string_split(text, chr(12))) AS t, generate_subscripts(string_split(text, chr(12)), 1) AS page FROM documents WHERE text IS NOT NULL) SELECT doc_id, page, length(array_to_string(list_filter(list_transform(string_split(replace(t, chr(0), ''), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), chr(10))) AS char_count FROM p",
    "headings": f"WITH {CHUNKS_SQL}, b AS (SELECT source_id AS doc_id, page_start AS \"at\", location AS text, CAST(length(content) AS DOUBLE) AS size FROM c WHERE content IS NOT NULL AND location IS NOT NULL AND page_start IS NOT NULL), s AS (SELECT doc_id, quantile_cont(size, 0.5) AS m, stddev_samp(size) AS s FROM b GROUP BY 1 HAVING count(DISTINCT size) > 1) SELECT doc_id, \"at\", text, CASE WHEN size >= m + 2 * s THEN 1 WHEN size >= m + s THEN 2 ELSE 3 END AS level FROM b JOIN s USING (doc_id) WHERE size >= m + 0.5 * s AND length(trim(text)) BETWEEN 3 AND 100 AND len(string_split_regex(trim(text), '\\s+')) <= 15",
    "recognition_needed": f"WITH {CHUNKS_SQL} SELECT source_id AS doc_id, round(avg(length(trim(content, ' '))), 4) AS mean_chars, coalesce(avg(length(trim(content, ' '))) < 950, true) AS needs_ocr FROM c GROUP BY 1",
    "graph_assumptions": "WITH " + _ASSUMPTIONS.format("domain_id = 'd1'") + " SELECT method, assumption, name, importance, round(strength, 6) AS strength FROM g",
    "audited_assumptions": "WITH "
    + _ASSUMPTIONS.format("true")
    + """, a AS (SELECT method, lower(name) AS name, min(importance) AS i FROM g GROUP BY ALL), b AS (SELECT id AS method, lower(name) AS name FROM k WHERE id % 4 = 0),
        j AS (SELECT coalesce(a.method, b.method) AS method, coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN i ELSE 'technical' END AS importance, CASE WHEN b.name IS NOT NULL THEN 'stated' END AS statement, CASE WHEN a.name IS NULL THEN 'cache' WHEN b.name IS NULL THEN 'graph' ELSE 'both' END AS origin FROM a FULL JOIN b ON a.method = b.method AND a.name = b.name)
        SELECT *, count(*) OVER (PARTITION BY method) < 3 AS needs_more FROM j""",
    "retrieval_metrics": """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
        s AS (SELECT q.id AS query, e.label = q.label AS hit, row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(q.v, e.v) DESC, e.id) AS r FROM v e JOIN v q ON q.id % 100 = 0 AND q.id <> e.id),
        h AS (SELECT query, min(r) FILTER (hit AND r <= 10) AS r FROM s GROUP BY query)
        SELECT count(*) AS queries, round(avg(coalesce((r <= 5)::INT, 0)), 6) AS hit_5, round(avg(coalesce((r <= 10)::INT, 0)), 6) AS hit_10, round(avg(1 / r), 6) AS mrr_hits_only, round(avg(coalesce(1 / r, 0)), 6) AS mrr_all,
            round(avg(CASE WHEN r <= 5 THEN 1 / log2(r + 1) ELSE 0 END), 6) AS ndcg_5, round(avg(CASE WHEN r <= 10 THEN 1 / log2(r + 1) ELSE 0 END), 6) AS ndcg_10 FROM h""",
    "edge_metrics": f"""WITH {EDGES_SQL}, m AS (SELECT type, count(*) FILTER (strength > 0.93 AND src % 3 <> 0) AS hits, count(*) FILTER (strength > 0.93) AS expected, count(*) FILTER (src % 3 <> 0) AS found FROM e GROUP BY type)
        SELECT type, hits, expected, found, round(coalesce(hits / nullif(found, 0), 0), 6) AS precision, round(coalesce(hits / nullif(expected, 0), 0), 6) AS recall, round(coalesce(2.0 * hits / nullif(found + expected, 0), 0), 6) AS f1 FROM m""",
    "confidence_precision": "WITH q AS (SELECT DISTINCT ON (id) doi IS NOT NULL AS ok, CAST(confidence_score AS DOUBLE) AS c FROM citations) SELECT CAST(cut AS DOUBLE) AS cut, count(*) AS n, round(avg(ok::INT), 6) AS precision FROM q JOIN (VALUES (0.5::DOUBLE), (0.6::DOUBLE), (0.7::DOUBLE), (0.8::DOUBLE), (0.9::DOUBLE)) t(cut) ON c >= cut GROUP BY 1",
    "expected_edges": f"""WITH {EDGES_SQL}, w AS (SELECT DISTINCT src, dst, 'USES' AS type FROM e WHERE src < 50 UNION ALL SELECT DISTINCT dst, src, 'REQUIRES' FROM e WHERE src < 20)
        SELECT w.src, w.dst, w.type, CASE WHEN EXISTS (FROM e WHERE e.src = w.src AND e.dst = w.dst AND e.type = w.type) THEN 'found' WHEN EXISTS (FROM e WHERE e.src = w.src AND e.dst = w.dst) THEN 'other_type' ELSE 'missing' END AS status FROM w""",
}
