"""Exact values on small fixtures, with the odd cases: nulls, empty tables, ties, repeats, further columns."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import stems
from folioscope.functions.text import bibtex_escaped, canonical_name, jaccard, trigrams
from folioscope.functions.vectors import cosine, is_sound
from folioscope.operators import citations, discovery, evaluation, graph, passages, quality, search, similar_texts, tables
from folioscope.operators.lineage import materialize
from folioscope.sources import exports
from folioscope.streaming import queues


def values(df, *columns):  # noqa: ANN001, ANN002, ANN201
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: [(x is None, x) for x in r])


def test_cosine_of_odd_vectors(spark: SparkSession) -> None:
    rows = spark.createDataFrame([(1, [1.0, 0.0], [0.0, 2.0]), (2, [1.0, 1.0], [2.0, 2.0]), (3, [0.0, 0.0], [1.0, 1.0]), (4, [1.0], [1.0, 1.0]), (5, None, [1.0, 1.0])], "id int, a array<double>, b array<double>")
    got = {r.id: (None if r.c is None else round(r.c, 9), r.s) for r in rows.select("id", cosine("a", "b").alias("c"), is_sound("a", 2).alias("s")).collect()}
    assert got == {1: (0.0, True), 2: (1.0, True), 3: (None, False), 4: (None, False), 5: (None, False)}


def test_rank_fusion_of_ties_and_nulls(spark: SparkSession) -> None:
    rows = spark.createDataFrame([("a", 1.0, None), ("b", 1.0, 0.5), ("c", None, 0.9)], "id string, x double, y double")
    got = {r.id: r.combined_score for r in search.fuse_ranks(rows, ["x", "y"], 10).collect()}
    assert got == pytest.approx({"a": 1 / 61, "b": 1 / 62 + 1 / 62, "c": 1 / 61})


def test_min_max_of_constants(spark: SparkSession) -> None:
    rows = spark.createDataFrame([(1, 2.0, 0.0, 1.0), (2, 2.0, 0.0, 3.0)], "id int, a double, b double, c double")
    got = values(search.min_max(rows, {"a": "x", "b": "y", "c": "z"}), "x", "y", "z")
    assert got == [(1.0, 0.0, 0.0), (1.0, 0.0, 1.0)]


def test_query_needs_a_signal() -> None:
    with pytest.raises(ValueError):
        search.SearchQuery()
    with pytest.raises(ValueError):
        search.SearchQuery(text="a", weights={"text": 0.0, "vector": 1.0})


def test_text_search_needs_all_terms(spark: SparkSession) -> None:
    rows = spark.createDataFrame([("1", "sparse panels matter", None, "d"), ("2", "sparse", "panels", "d"), ("3", None, None, None), ("4", "panels", None, "d")], "id string, content string, location string, domain_id string")
    found = search.search_text(rows, search.SearchQuery(text="the sparse panels"))
    assert {r.id for r in found.collect()} == {"1", "2"}
    assert search.search_text(rows.limit(0), search.SearchQuery(text="sparse")).count() == 0


@pytest.mark.parametrize(
    ("name", "want"),
    [("IV", "instrumental variables"), ("2SLS", "two stage least squares"), ("The  Random-Forest (RF)", "random forest"), ("a.b, c!", "ab c"), ("an example", "example"), ("", "")],
)
def test_canonical_name(spark: SparkSession, name: str, want: str) -> None:
    assert spark.range(1).select(canonical_name(F.lit(name))).first()[0] == want


def test_trigrams_and_jaccard(spark: SparkSession) -> None:
    row = spark.range(1).select(trigrams(F.lit("Cat")), jaccard(trigrams(F.lit("cat")), trigrams(F.lit("cats"))), jaccard(trigrams(F.lit("")), trigrams(F.lit("a")))).first()
    assert sorted(row[0]) == ["  c", " ca", "at ", "cat"]
    assert row[1] == pytest.approx(3 / 6)
    assert row[2] == 0.0


def test_bibtex_escapes_once(spark: SparkSession) -> None:
    assert spark.range(1).select(bibtex_escaped(F.lit("a_b & 5% {x}"))).first()[0] == r"a\_b \& 5\% \{x\}"


EDGES = [("a", "b", "REQUIRES", 1.0), ("b", "c", "USES", 0.5), ("c", "d", "EXTENDS", 0.9), ("a", "a", "USES", 1.0), ("d", "e", "OTHER", 1.0)]


def test_distances_and_paths(spark: SparkSession) -> None:
    edges = spark.createDataFrame(EDGES, "src string, dst string, type string, strength double")
    near = graph.distances(edges, spark.createDataFrame([("a",), ("a",)], "id string"), 2)
    assert values(near, "node", "hops") == [("a", 0), ("b", 1), ("c", 2)]
    assert values(graph.distances(edges, spark.createDataFrame([("c",)], "id string"), 1, directed=True), "node", "hops") == [("c", 0), ("d", 1)]
    assert [tuple(r) for r in graph.shortest_path(edges, "a", "d", 5).orderBy("step").collect()] == [(0, "a", None), (1, "b", "REQUIRES"), (2, "c", "USES"), (3, "d", "EXTENDS")]
    assert graph.shortest_path(edges, "a", "e", 2).count() == 0
    assert [r.node for r in graph.shortest_path(edges, "a", "a").collect()] == ["a"]
    assert graph.distances(edges.limit(0), spark.createDataFrame([("a",)], "id string"), 2).count() == 1


def test_graph_score_counts_unlinked_pairs_as_zero(spark: SparkSession) -> None:
    edges = spark.createDataFrame(EDGES, "src string, dst string, type string, strength double")
    links = spark.createDataFrame([("x", "a", "defines", None), ("x", "a", "example", 0.5), ("x", "z", "other", 1.0), ("y", "b", "reference", 1.0)], "chunk_id string, concept_id string, mention_type string, relevance_score double")
    query = spark.createDataFrame([("a",)], "id string")
    got = {r.id: round(r.graph_score, 6) for r in graph.graph_scores(edges, query, links, 2).collect()}
    assert got == {"x": 0.5, "y": 0.5}
    got = {r.id: round(r.graph_score, 6) for r in graph.graph_scores(edges, query, links, 2, mentions=True).collect()}
    assert got == {"x": 0.375, "y": 0.3}


def test_pagerank_of_a_pair_and_of_nothing(spark: SparkSession) -> None:
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "q")], "src string, dst string")
    got = {r.id: round(r.authority, 6) for r in citations.pagerank(nodes, edges, 20).collect()}
    assert got["b"] == 1.0
    assert got["a"] == pytest.approx(0.075 / (0.075 + 0.85 * 0.075), abs=1e-6)
    assert citations.pagerank(nodes.limit(0), edges.limit(0), 2).count() == 0


def test_coupling_counts_each_work_once(spark: SparkSession) -> None:
    refs = [("a", f"w{i}") for i in range(10)] + [("b", f"w{i}") for i in range(5, 13)] + [("a", "w1"), ("c", None), (None, "w1")]
    rows = citations.coupling(spark.createDataFrame(refs, "citing string, cited string"))
    assert [(r.a, r.b, r.shared, round(r.strength, 6)) for r in rows.collect()] == [("a", "b", 5, round(5 / 13, 6))]


def test_trigram_pairs_match_brute_force(spark: SparkSession) -> None:
    words = ["robust panels", "robust panel", "robust pannels", "sparse trials", "sparse trial", "", None, "robust panels"]
    rows = spark.createDataFrame(list(enumerate(words)), "id int, text string")
    got = set(values(citations.trigram_pairs(rows, rows, 0.7, ordered=True), "a", "b"))

    def grams(t: str) -> set[str]:
        return {f"  {w} "[i : i + 3] for w in t.split() for i in range(len(w) + 1)}

    want = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if i < j and a and b and len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= 0.7}
    assert got == want


def test_tables_with_null_keys_and_repeats(spark: SparkSession) -> None:
    base = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    more = spark.createDataFrame([(1, "b"), (2, "c"), (2, "c"), (None, "m")], "k int, v string")
    assert set(values(tables.insert_new(base, more, ["k"]), "k", "v")) == set([(1, "a"), (None, "n"), (2, "c")])
    assert set(values(tables.replace_rows(base, more.where("k = 1 OR k IS NULL"), ["k"]), "k", "v")) == set([(1, "b"), (None, "m")])
    assert tables.insert_new(base.limit(0), more.limit(0), ["k"]).count() == 0
    merged = spark.range(1).select(tables.merged_json(F.lit('{"a": "1", "b": "2"}'), F.lit('{"b": "3"}'))).first()[0]
    assert merged == '{"a":"1","b":"3"}'


def test_chains_end_at_one_keeper(spark: SparkSession) -> None:
    pairs = spark.createDataFrame([("d", "c"), ("c", "b"), ("b", "a"), ("x", "y"), ("y", "x"), ("q", "q")], "gone string, keep string")
    got = dict(values(quality.resolved_chains(pairs), "old", "new"))
    assert {k: got[k] for k in "bcd"} == {"b": "a", "c": "a", "d": "a"}
    assert got.get("y", got.get("x")) in ("x", "y")


def test_duplicates_keep_the_earliest_page(spark: SparkSession) -> None:
    rows = spark.createDataFrame([("1", "s", "AB", None, 1), ("2", "s", "ab", 5, 2), ("3", "s", "ab", 3, 3), ("4", "t", "ab", 1, 1), ("5", "s", None, 1, 1)], "id string, source_id string, content_hash string, page_start int, created_at int")
    assert values(quality.duplicate_chunks(rows), "old", "new") == [("1", "3"), ("2", "3")]


def test_sentences_and_packing() -> None:
    assert passages.sentences("Dr. Smith said hello. She was right.") == ["Dr. Smith said hello.", "She was right."]
    assert passages.sentences("The value is 3.14. Next one! J. Doe agreed") == ["The value is 3.14.", "Next one!", "J. Doe agreed"]
    assert passages.sentences("  ") == []
    text = "\n\n".join(" ".join(f"w{i}_{j}" for j in range(40)) + "." for i in range(10))
    chunks = passages.pack(text, 100, 20, 40)
    assert all(len(c.split()) <= 120 for c in chunks)
    assert {w for c in chunks for w in c.split()} == set(text.split())
    assert all(chunks[k + 1].split("\n\n")[0] == chunks[k].split("\n\n")[-1] for k in range(len(chunks) - 1))
    assert passages.pack("") == []


@pytest.mark.parametrize(("size", "want"), [(99, "skip"), (100, "process"), (15000, "process"), (15001, "flag")])
def test_filter_bounds(spark: SparkSession, size: int, want: str) -> None:
    rows = spark.createDataFrame([("1", "a" * size, 7)], "id string, content string, other int")
    assert passages.filtered(rows).first().decision == want


def test_filter_of_null(spark: SparkSession) -> None:
    assert passages.filtered(spark.createDataFrame([("1", None)], "id string, content string")).first().reason == "too_short"


def test_measures(spark: SparkSession) -> None:
    hits = spark.createDataFrame([("a", 1), ("b", 4), ("c", None)], "query string, hit_rank int")
    row = evaluation.retrieval_metrics(hits).first()
    assert (row.hit_5, row.mrr_hits_only, row.mrr_all) == pytest.approx((2 / 3, 0.625, 1.25 / 3))
    assert evaluation.retrieval_metrics(hits.limit(0)).first().queries == 0


def test_papers_and_queue(spark: SparkSession) -> None:
    rows = spark.createDataFrame([(1, "failed", 1, "e"), (2, "failed", 3, "e"), (3, "pending", 0, None)], "id int, status string, retry_count int, error_message string")
    assert values(discovery.retried(rows), "id", "status") == [(1, "pending"), (2, "failed"), (3, "pending")]


def test_exports(spark: SparkSession, tmp_path: Path) -> None:
    rows = spark.createDataFrame([("1", "f", "ValueError", "bad", "t", None, 1, None)], exports.DEAD_LETTER)
    exports.append_dead_letters(rows, str(tmp_path / "dead"))
    exports.append_dead_letters(rows.withColumn("id", F.lit("2")), str(tmp_path / "dead"))
    assert exports.dead_letters(spark, str(tmp_path / "dead"), "ValueError", ["1"]).count() == 1
    exports.write_csv(rows.select("id"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1
    tei = '<TEI xmlns="http://x"><teiHeader><titleStmt><title>T</title></titleStmt></teiHeader><text><body><div><head>H</head><p>One.</p></div></body><back><listBibl><biblStruct><title>W</title><surname>Doe</surname><date when="1999-01"/></biblStruct><biblStruct/></listBibl></back></text></TEI>'
    got = exports.parse_tei(spark.createDataFrame([(1, tei), (2, "<broken"), (3, None)], "doc_id bigint, tei string"))
    assert [r.kind for r in got.orderBy("doc_id", "kind").collect()] == ["citation", "section", "title", "error"]
    assert got.where("kind = 'citation'").first().details == "Doe; 1999"


def test_materialized_tables_are_equal(spark: SparkSession) -> None:
    assert materialize(spark.range(10)).count() == 10


def test_status_stream(spark: SparkSession, tmp_path: Path) -> None:
    source = tmp_path / "in"
    for k, rows in enumerate(([("a", "pending", 1), ("b", "pending", 1)], [("a", "failed", 2), ("a", "completed", 3)])):
        spark.createDataFrame(rows, "id string, status string, at int").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("id string, status string, at int").parquet(str(source))
        queues.latest_status(spark, stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
        last = spark.read.parquet(str(tmp_path / "out" / str(k)))
    assert values(last, "id", "status") == [("a", "completed"), ("b", "pending")]


def test_rollup_and_dead_letter_streams(spark: SparkSession, tmp_path: Path) -> None:
    rows = spark.sql("SELECT TIMESTAMP'2024-01-01 10:00:00' AS created_at, 'm' AS method, 2.0D AS duration UNION ALL SELECT TIMESTAMP'2024-01-05 10:00:00', 'm', -1.0D")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = queues.daily_rollup(read()).writeStream.format("memory").queryName("rollup").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    query.awaitTermination(120)
    assert [(r.method, r.events) for r in spark.table("rollup").collect()] == [("m", 1)]
    write = lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / f"good{n}"))
    queues.with_dead_letters(read(), lambda df: df.withColumn("ok", F.col("duration") > 0), write, str(tmp_path / "dead"), str(tmp_path / "c2")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "good0")).count() == 1
    assert spark.read.json(str(tmp_path / "dead")).count() == 1


@pytest.mark.parametrize(("word", "want"), [("caresses", "caress"), ("ponies", "poni"), ("feed", "feed"), ("plastered", "plaster"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("vietnamization", "vietnam"), ("sensitivity", "sensit"), ("replacement", "replac"), ("adjustment", "adjust"), ("adoption", "adopt"), ("regressions", "regress"), ("as", "as"), ("x2s", "x2s")])
def test_stems(spark: SparkSession, word: str, want: str) -> None:
    assert stems.stem_of(word) == want
    assert spark.createDataFrame([(word,)], "w string").select(stems.stem(F.col("w"))).first()[0] == want


def test_text_index_and_expansion(spark: SparkSession) -> None:
    rows = spark.createDataFrame([("a", "Regressions of panels", "p. 1", [1.0, 0.0]), ("b", "a regression", None, [0.0, 1.0]), ("c", "kernel sums", "", None), ("d", None, None, None)], "id string, content string, location string, embedding array<double>")
    index = search.build_text_index(rows, 4)
    assert {r.id for r in search.search_index(index, "regressing").collect()} == {"a", "b"}
    assert [r.id for r in search.search_index(index, "panel regression").collect()] == ["a"]
    assert search.search_index(index, "nothing").count() == 0
    synonyms = spark.createDataFrame([("regression", ["kernel"])], "term string, synonyms array<string>")
    concepts = spark.createDataFrame([(1, "regression", "Regression"), (2, "panel", "Panel")], "id bigint, canonical_name string, name string")
    edges = spark.createDataFrame([(2, 1, 0.5)], "src bigint, dst bigint, strength double")
    more = search.expansions_of("a regression", synonyms, concepts, edges)
    assert more == ["kernel", "panel"]
    found = [r.id for r in search.search_expanded(rows, search.SearchQuery("a regression"), more).collect()]
    assert set(found) == {"a", "b", "c"} and found[-1] == "c"


def test_similar_texts_are_not_written_before_they_pass(spark: SparkSession) -> None:
    """Texts of one frame, no two of which are alike: what is written between must not grow as their pairs."""
    a, b, c = (["".join(chr(97 + (k * s + j * j) % 26) for j in range(9)) for k in range(12)] for s in (5, 7, 11))
    texts = [f"on {x} and {y} in {z}" for x in a for y in b for z in c]
    rows = spark.createDataFrame(list(enumerate(texts[::2] + texts[:3] + ["", None])), "id int, text string")
    written, write = [], similar_texts.materialize

    def counted(df: DataFrame, *rest: object) -> DataFrame:
        out = write(df, *rest)
        written.append(out.count())
        return out

    similar_texts.materialize = counted
    try:
        got = set(values(citations.trigram_pairs(rows, rows, 0.95, ordered=True), "a", "b"))
    finally:
        similar_texts.materialize = write

    def grams(t: str) -> set[str]:
        return {f"  {w} "[i : i + 3] for w in t.split() for i in range(len(w) + 1)}

    sets = [grams(t) for t in texts[::2] + texts[:3]]
    want = {(i, j) for i, s in enumerate(sets) for j, t in enumerate(sets[i + 1 :], i + 1) if len(s & t) / len(s | t) >= 0.95}
    assert got == want
    assert max(written) < 3 * len(sets)


def test_titles_meet_within_years(spark: SparkSession) -> None:
    """Only pairs of one year, or of an unknown one, are compared; of equal targets the least counts."""
    kind = "id string, doi string, arxiv_id string, title string, year int"
    name = "Robust panels with sparse local effects in lagged trials"
    cited = [("c1", None, None, name, 2000), ("c2", None, None, name + "s", None), ("c3", None, None, name, 1990), ("c4", None, None, "Other words", 2000)]
    targets = [(f"p{k}", None, None, name, y) for k, y in enumerate((2001, 2000, 2000, None))]
    seen, compared = [], similar_texts._near
    similar_texts._near = lambda x, y, *rest: seen.append({r.key for r in x.select("key").collect()}) or compared(x, y, *rest)
    try:
        got = {r.id: r.target_id for r in citations.match_to_targets(spark.createDataFrame(cited, kind), spark.createDataFrame(targets, kind)).collect()}
    finally:
        similar_texts._near = compared
    assert got == {"c1": "p1", "c2": "p0", "c3": "p3", "c4": None}
    assert seen[0] == {1990, 2000}
