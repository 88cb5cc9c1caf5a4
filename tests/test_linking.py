"""Fuzzy matching, extraction steps, audits and the application's calls on small fixtures."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import audit, citations, enrichment, extraction, quality, search, statistics
from folioscope.operators.services import Corpus, clamped
from folioscope.plans import catalog
from folioscope.sources import exports
from folioscope.sources.tables import table
from tests.oracle import DATA

PAPER = "id string, title string, authors array<string>, year int, venue string, doi string, arxiv_id string, citation_count int"


@pytest.mark.parametrize(("a", "b", "want"), [("Panel", " panel ", 1.0), (None, "x", 0.0), ("", "", 0.0), ("abcd", "abce", 0.75)])
def test_ratio(a: str | None, b: str | None, want: float) -> None:
    assert enrichment.ratio(a, b) == pytest.approx(want)


def test_overlap() -> None:
    assert enrichment.overlap(["J. Smith", "A. Doe"], ["John Smith"]) == 0.5
    assert enrichment.overlap(None, ["a"]) == enrichment.overlap([], []) == 0.0


def test_venue_and_fuzzy_scores(spark: SparkSession) -> None:
    rows = spark.createDataFrame([("Journal of Applied Letters", "JAL"), ("Same", "same "), (None, "x"), ("robust panels", "panels")], "a string, b string")
    got = [(round(r[0], 2), round(r[1], 2) if r[1] is not None else None) for r in rows.select(enrichment.venue_score(F.col("a"), F.col("b")), enrichment.fuzzy_score(F.col("a"), F.col("b"))).collect()]
    assert [g[0] for g in got[:3]] == [0.9, 1.0, 0.0]
    assert got[3][1] == 0.9


def test_chosen_papers(spark: SparkSession) -> None:
    papers = [("p1", "Robust Panels", ["Doe, J."], 2000, "JAL", "10.1/A", None, 5), ("p2", "Robust panels", ["Roe, R."], 2010, "Other", None, "x1", 50), ("p3", "Alone", None, None, None, None, None, None)]
    cited = [
        ("c1", None, None, None, None, "10.1/a", None),
        ("c2", None, None, None, None, None, "X1"),
        ("c3", "alone!", None, None, None, None, None),
        ("c4", "robust panels", ["Doe, J."], 2000, "JAL", None, None),
        ("c5", "robust panels", ["Nobody"], 1990, None, None, None),
        ("c6", "unknown", None, None, None, None, None),
        ("c7", None, None, None, None, None, None),
    ]
    rows = enrichment.chosen_papers(spark.createDataFrame(cited, PAPER.rpartition(",")[0]), spark.createDataFrame(papers, PAPER))
    got = {r.id: (r.paper_id, r.method) for r in rows.collect()}
    assert got == {"c1": ("p1", "doi"), "c2": ("p2", "arxiv"), "c3": ("p3", "title"), "c4": ("p1", "signals"), "c5": (None, "ambiguous"), "c6": (None, "unmatched"), "c7": (None, "unmatched")}
    assert enrichment.chosen_papers(spark.createDataFrame([], PAPER), spark.createDataFrame([], PAPER)).count() == 0


def test_extraction_steps(spark: SparkSession) -> None:
    found = spark.createDataFrame([("1", ' "Panel  Data" ', ["PD"], 0.9), ("1", "Shock", None, 0.8), ("1", "weak", None, 0.5), ("2", "''", None, 0.9)], "chunk_id string, name string, aliases array<string>, confidence double")
    kept = extraction.kept_concepts(found)
    assert sorted(r.name for r in kept.collect()) == ["Panel  Data".replace("  ", " "), "Shock"]
    relations = spark.createDataFrame([("1", "pd", "shock"), ("1", "shock", "Shock"), ("1", "pd", "weak"), ("2", "pd", "shock")], "chunk_id string, source string, target string")
    assert [(r.source, r.target) for r in extraction.kept_relations(relations, kept).collect()] == [("pd", "shock")]


def test_concept_similarity(spark: SparkSession) -> None:
    kind = "id int, name string, aliases array<string>, embedding array<double>"
    a = spark.createDataFrame([(1, "IV", None, None), (2, "panel data", ["longitudinal data"], None), (3, "x y", None, [1.0, 0.0]), (4, "q b", None, None)], kind)
    b = spark.createDataFrame([(1, "instrumental variables", None, None), (2, "longitudinal data", None, None), (3, "z", None, [1.0, 1.0]), (4, "b c", None, None)], kind)
    got = {r.a_id: round(r.similarity, 6) for r in extraction.concept_similarity(a, b, F.col("a_id") == F.col("b_id")).collect()}
    assert got == {1: 1.0, 2: 0.95, 3: round(2**-0.5, 6), 4: round(1 / 3, 6)}


def test_audit(spark: SparkSession) -> None:
    graph = spark.createDataFrame([("m", "SUTVA", "critical"), ("m", "Overlap", "standard")], "method string, name string, importance string")
    cached = spark.createDataFrame([("m", "sutva", "technical", "no interference"), ("m", "Rank", None, "full")], "method string, name string, importance string, statement string")
    got = {r.name: (r.importance, r.statement, r.origin, r.needs_more) for r in audit.audited(graph, cached).collect()}
    assert got == {"SUTVA": ("technical", "no interference", "both", False), "Overlap": ("standard", None, "graph", False), "Rank": (None, "full", "cache", False)}
    concepts = spark.createDataFrame([("m", "did", "DiD", ["diff in diff"], "METHOD")], "id string, canonical_name string, name string, aliases array<string>, concept_type string")
    aliases = spark.createDataFrame([("two-way", "m")], "alias string, concept_id string")
    assert all(audit.find_method(concepts, aliases, n).first().id == "m" for n in ("DID", "Diff in Diff", "TWO-WAY"))
    assert audit.find_method(concepts, aliases, "none").count() == 0
    cache = audit.cache_assumptions(cached, cached.limit(1).withColumn("statement", F.lit(None).cast("string")).withColumn("importance", F.lit("critical")))
    assert {(r.name, r.importance, r.statement) for r in cache.collect()} == {("sutva", "critical", "no interference"), ("Rank", None, "full")}


def test_percentiles_are_elements(spark: SparkSession) -> None:
    rows = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4)] + [("a", None)], "k string, x double")
    row = statistics.index_percentiles(rows, "x", ["k"]).first()
    assert (row.n, row.p50, row.p95) == (4, 3.0, 4.0)


def test_synonyms_and_weighted_terms(spark: SparkSession) -> None:
    queries = spark.createDataFrame([("IV estimation",), ("other",)], "query string")
    synonyms = spark.createDataFrame([("iv", ["Instrumental Variables", "estimation"])], "term string, synonyms array<string>")
    got = {r.query: r.expansions for r in search.with_synonyms(queries, synonyms).collect()}
    assert got == {"IV estimation": ["instrumental variables"], "other": []}
    assert spark.range(1).select(search.weighted_terms("iv est.", ["two words"])).first()[0] == "iv:A | est:A | two:B | words:B"


def test_domain_links_and_relinked(spark: SparkSession) -> None:
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.05]), ("c", [0.0, 1.0]), ("z", None)], "id string, embedding array<double>")
    edges = spark.createDataFrame([("b", "c", "USES", 1.0)], "src string, dst string, type string, strength double")
    assert {(r.src, r.dst) for r in extraction.relinked(rows, edges).collect()} == {("a", "b")}
    found = quality.nearest_between(rows.where("id = 'a'"), rows, 0.5, 3)
    assert [(r.a, r.b, r.link_type) for r in quality.domain_links(found).collect()] == [("a", "b", "EQUIVALENT")]


@pytest.fixture
def little(spark: SparkSession) -> Corpus:
    sources = spark.createDataFrame([("s1", "paper", "T1", "d", 0.5, '{"doi": "10.1/x"}', 1), ("s2", "textbook", "T2", None, None, None, 2)], "id string, source_type string, title string, domain_id string, citation_authority double, metadata string, created_at int")
    chunks = spark.createDataFrame([("c1", "s1", "sparse panels", "p. 1", "d", [1.0, 0.0]), ("c2", "s1", "dense trees", None, "d", [0.0, 1.0]), ("c3", "gone", None, None, None, None)], "id string, source_id string, content string, location string, domain_id string, embedding array<double>")
    references = spark.createDataFrame([("s1", "w", "q1"), ("s2", "w", "q2"), ("s1", None, "q3")], "citing string, cited string, citation_id string")
    concepts = spark.createDataFrame([("k1", "panels", "Panels"), ("k2", "trees", "Trees")], "id string, canonical_name string, name string")
    edges = spark.createDataFrame([("k1", "k2", "USES", 1.0)], "src string, dst string, type string, strength double")
    links = spark.createDataFrame([("c1", "k1", "defines", 1.0)], "chunk_id string, concept_id string, mention_type string, relevance_score double")
    return Corpus(sources, chunks, references, concepts, edges, links)


def test_calls(spark: SparkSession, little: Corpus) -> None:
    assert [r.id for r in little.search("panels").collect()] == ["c1"]
    assert [r.id for r in little.search("panels", [0.0, 1.0], limit=99, use_graph=True, use_citations=True).collect()][0] in ("c1", "c2")
    assert [r.id for r in little.search("panels", [1.0, 0.0], scoring="rrf").collect()] == ["c1", "c2"]
    assert little.fast_search([0.0, 1.0], 1).first().id == "c2"
    assert [r.id for r in little.list_sources().collect()] == ["s2", "s1"]
    assert little.source_by_key("doi", "10.1/x").first().id == "s1" and little.source("none").count() == 0
    assert [r.id for r in little.sources_without_chunks().collect()] == ["s2"]
    got = {r.id: r.concepts for r in little.chunk_concepts(spark.createDataFrame([("c1",), ("c2",)], "id string")).collect()}
    assert got == {"c1": ["k1"], "c2": []}
    assert little.cited_by("w").count() == 2 and little.cites("s1").first().cited == "w"
    assert [r.node for r in little.graph_neighbourhood("panels").collect()] == ["k2"] and little.graph_neighbourhood("none").count() == 0
    assert little.graph_path("panels", "trees").count() == 2
    assert {r.name: r.n for r in little.stats().collect()}["chunks"] == 3 and little.health()
    assert clamped(99, 1, 50) == 50


def test_results_as_text(little: Corpus) -> None:
    found = little.search("panels")
    assert exports.results_as_markdown(found).first().line.startswith("1. **T1** (p. 1), score ")
    assert '"id":"c1"' in exports.results_as_json(found).first().json


def test_metrics_text(spark: SparkSession) -> None:
    rows = spark.createDataFrame([("b", "help b", "gauge", 2.0), ("a", "help a", "counter", 1.0)], "name string, help string, kind string, value double")
    assert exports.metrics_text(rows).first().text.split("\n") == ["# HELP a help a", "# TYPE a counter", "a 1.0", "# HELP b help b", "# TYPE b gauge", "b 2.0"]


def test_the_core_needs_no_training_operators(tmp_path: Path) -> None:
    root = Path(__file__).resolve().parents[1]
    code = "import sys; sys.modules['folioscope.llm'] = None; import __spark_entry__ as e; assert not any(n[:2] in ('p1', 'p8') for n in e.queries()); print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) == len(catalog.QUERIES)


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_best_names_of_all_parts(spark: SparkSession) -> None:
    parts = table(spark, str(DATA), "part").select("p_brand", F.upper("p_name").alias("n")).distinct()
    found = catalog.QUERIES["best_names"](spark, str(DATA))
    assert {(r.group, r.expected) for r in found.collect()} == {tuple(r) for r in parts.collect()}


def test_best_names_match_brute_force(spark: SparkSession) -> None:
    expected = spark.createDataFrame([("g", "Random Forest", ["RF", None]), ("g", "Lasso", None), ("g", "xabcd", None), ("g", "", []), ("h", " LASSO", None), ("h", "Instrumental", ["iv method"]), ("i", "a-b-c-d-e", None)], "group string, expected string, aliases array<string>")
    returned = spark.createDataFrame([("g", "random forests"), ("g", "rf"), ("g", " lasso "), ("g", "a random"), ("g", "abcdy"), ("g", None), ("h", "lass"), ("h", "the iv methods of all"), ("h", "instrument"), ("i", "a+b+c+d+e"), ("i", "a-b")], "group string, name string")
    forms = expected.select("group", "expected", F.explode(F.concat(F.array("expected"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("form"))
    scored = forms.join(returned, "group").select("group", "expected", "name", enrichment.fuzzy_score(F.col("form"), F.col("name")).alias("score"))
    best = scored.groupBy("group", "expected").agg(F.max(F.struct("score", "name")).alias("b")).where("b.score >= 0.5").select("group", "expected", "b.name", "b.score")
    assert {tuple(r) for r in enrichment.best_names(expected, returned, 0.5).collect()} == {tuple(r) for r in best.collect()}


def test_titles_within_one_another(spark: SparkSession) -> None:
    kind = "id string, doi string, arxiv_id string, title string, year int"
    papers = spark.createDataFrame([("p1", None, None, "Sparse panels: a study of effects", 2000), ("p2", None, None, "Trees", 2001), ("p3", None, None, None, None)], kind)
    cited = spark.createDataFrame([("c1", None, None, "SPARSE PANELS", 1990), ("c2", None, None, "All about trees and more", None), ("c3", None, None, "Trees", 2001), ("c4", None, None, "else", 1), ("c5", None, None, None, None)], kind)
    got = {r.id: r.target_id for r in citations.match_simply(cited, papers).collect()}
    assert got == {"c1": "p1", "c2": "p2", "c3": "p2", "c4": None, "c5": None}
    assert {r.target_id for r in citations.match_simply(cited, papers.limit(0)).collect()} == {None}


def test_more_calls(spark: SparkSession, little: Corpus) -> None:
    assert [r.id for r in little.list_concepts().collect()] == ["k1", "k2"]
    assert [(r.other, r.outgoing) for r in little.concept("panels").collect()] == [("k2", True)]
    assert [r.chunk_id for r in little.chunks_of_concept("panels").collect()] == ["c1"]
    assert {(r.direction, r.other) for r in little.citation_network("s1").collect()} == {("cites", "w")}
    found = little.explain_connection("panels", "trees").collect()
    assert [(r.name, r.type, r.chunk_id) for r in found] == [("Panels", None, "c1"), ("Trees", "USES", None)]
    links = spark.createDataFrame([("k2", "k1", "ANALOGOUS", 0.9)], "a string, b string, link_type string, confidence double")
    assert [r.other for r in little.cross_domain_concepts("panels", links, 0.5).collect()] == ["k2"]


def test_evidence_moves_with_duplicates(spark: SparkSession) -> None:
    edges = spark.createDataFrame([("e1", ["a", "b", "c"]), ("e2", None), ("e3", [])], "id string, evidence array<string>")
    mapping = spark.createDataFrame([("b", "a")], "old string, new string")
    got = {r.id: r.evidence for r in quality.repointed_evidence(edges, mapping, "evidence").collect()}
    assert got == {"e1": ["a", "c"], "e2": None, "e3": []}
