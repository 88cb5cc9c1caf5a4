"""The operators for training text: exact results, brute force, round trips and odd cases."""

from __future__ import annotations

import random
import unicodedata
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import encoding, linkage, lookalike, mixing, near_duplicates, neighbours, queries, scans, splitting
from folioscope.operators.search import batch_vector_search
from tests.oracle import DATA, compare

FILE = Path(encoding.TOKENIZERS) / "byte_bpe_50k.json"
CHUNK = "id string, source_id string, content string, location string, page_start int, page_end int, embedding array<float>, chunk_id int, other string, class int, key int, doc_id string, form string, line string"


def chunks(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Chunks with columns whose names clash with those of the operators."""
    names = [c.split()[0] for c in CHUNK.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], CHUNK)


def words(n: int, seed: int = 0) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark: SparkSession, name: str) -> None:
    if name in queries.ORACLE:
        compare(spark, queries.QUERIES[name], queries.ORACLE[name])
    else:
        found = queries.QUERIES[name](spark, str(DATA))
        assert found.count() == found.distinct().count()


# Problem 1


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n-é漢", max_size=900), st.integers(20, 120))
def test_pieces_cover_the_text(text: str, limit: int) -> None:
    spans = splitting.split_spans(text, limit, limit // 5)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (a, b), (c, d) in zip(spans, spans[1:], strict=False):
        assert a < c <= b < d and b - c <= limit // 5
    assert all(b - a <= limit for a, b in spans)


def test_pieces_end_at_sentences() -> None:
    text = " ".join(f"This is sentence number {i} of a long text." for i in range(300))
    spans = splitting.split_spans(text)
    assert len(spans) == -(-(len(text) - 200) // 2200)
    assert all(text[:b].rstrip().endswith(".") for _, b in spans)
    assert all(100 <= b - c <= 200 for (_, b), (c, _) in zip(spans, spans[1:], strict=False))


def test_a_text_without_boundaries_is_cut() -> None:
    spans = splitting.split_spans("x" * 100_000)
    assert all(b - a <= 2400 for a, b in spans) and spans[-1][1] == 100_000


def test_split_of_odd_rows(spark: SparkSession) -> None:
    rows = chunks(spark, [{"id": "a", "content": None}, {"id": "b", "content": ""}, {"id": "c", "content": "é" * 2400, "location": "p. 1"}, {"id": "d", "content": "e " * 1201}, {"id": None, "content": "x" * 3000, "location": "p. 2"}])
    found = splitting.split_oversized(rows)
    assert {(r.chunk_id, r.n_pieces) for r in found.collect()} == {("a", 1), ("b", 1), ("c", 1), ("d", 2), (None, 2)}
    assert found.where("chunk_id IS NULL AND piece_no = 2").first().location.startswith("p. 2 (part 2 of 2")
    assert splitting.split_oversized(rows.limit(0)).count() == 0
    more = rows.unionByName(rows.where("id IN ('c', 'd')")).unionByName(rows.where("id IS NULL"))
    assert sorted(str(r.id) for r in splitting.delivered_once(more).collect()) == ["None", "None", "a", "b", "c", "d"]


# Problem 2

PAPERS = [
    ("p1", "A wavelet approach to average uptake in clustered panels, Part I", ["Vanel D. Zemanobrin", "Élowe Fennithzune"], 2016, "10.1/a"),
    ("p2", "A wavelet approach to average uptake in clustered panels, Part II", ["Vanel D. Zemanobrin", "Élowe Fennithzune"], 2017, None),
    ("p3", "Correction to: Sparse trials and robust boosting for rare events", ["Sivobexi, Zelmo"], 2003, None),
    ("p4", "Sparse trials and robust boosting for rare events", ["Sivobexi, Zelmo"], 2001, "10.1/d"),
    ("p5", None, None, None, None),
]
CITATIONS = [
    ("c1", "A WAVELET APPROACH TO AVERAGE UPTAKE IN CLUSTERED PANELS, PART II", ["ZEMANOBRIN VD", "FENNITHZUNE É"], 2017, None, "p2"),
    ("c2", "A wavlet aproach to average uptake in clustered panels, part i", ["Zemanobrin, V.", "et al."], None, "doi: 10.1/A.", "p1"),
    ("c3", "Sparse trials and {robust} boosting for rare events", ["Z. Sivobexi"], 2001, "10.1/a", "p4"),
    ("c4", "Correction to: Sparse trials and robust boosting for rare events", ["Sivobexi, Z."], 2003, None, "p3"),
    ("c5", "Sparse trials and robust boosting for rare events", ["Other, A.", "Another, B."], 2001, None, None),
    ("c6", None, None, None, "10.1/d", None),
    ("c7", "An unknown work on something else entirely", ["Nobody, N."], 1999, None, None),
    ("c8", None, None, None, None, None),
    ("c9", "", [], 2001, "", None),
]


def test_links(spark: SparkSession) -> None:
    kind = "id string, title string, authors array<string>, year int, doi string"
    cited = spark.createDataFrame([c[:5] for c in CITATIONS] * 2 + [(None, "x", None, 1, None)], kind).withColumn("p_id", F.lit("clash"))
    papers = spark.createDataFrame([*PAPERS, PAPERS[0]], kind.replace("id ", "s2_paper_id ", 1)).withColumn("c_id", F.lit(1))
    got = {r.c_id: r.p_id for r in linkage.link(cited, papers).collect()}
    assert len(got) == len(CITATIONS)
    assert {k: got[k] for k, *_, want in CITATIONS if k != "c6"} == {c[0]: c[5] for c in CITATIONS if c[0] != "c6"}
    assert set(r.p_id for r in linkage.link(cited, papers.limit(0)).collect()) == {None}
    assert linkage.link(cited.limit(0), papers).count() == 0


@pytest.mark.parametrize(("names", "want"), [(["Draédrith OR", "Ulmarimmel Y"], ["draedrith", "ulmarimmel"]), (["A. Doe; Roe, B."], ["doe", "roe"]), (["et al.", None, ""], []), (None, [])])
def test_surnames(names: list[str] | None, want: list[str]) -> None:
    assert linkage.surnames(names) == want


def test_crowded_attributes_are_refined(spark: SparkSession) -> None:
    kind = "id string, title string, authors array<string>, year int, doi string"
    papers = [(f"p{i:03}", "Robust panels with sparse local effects", [f"Author{chr(97 + i // 26)}{chr(97 + i % 26)}x, B."], 2000, None) for i in range(60)]
    cited = [(f"c{i:03}", "Robust panels with sparse local effects", [f"Author{chr(97 + i // 26)}{chr(97 + i % 26)}x, B."], 2000, None) for i in range(60)]
    got = linkage.link(spark.createDataFrame(cited, kind), spark.createDataFrame(papers, kind.replace("id ", "s2_paper_id ", 1)), crowded=5).collect()
    assert all(r.p_id == r.c_id.replace("c", "p") for r in got)


def test_titles_and_years_meet_where_surnames_fail(spark: SparkSession) -> None:
    kind = "id string, title string, authors array<string>, year int, doi string"
    long = "Regional auctions lagged tariffs mobile networks sparse kernels robust panels hidden markets"
    papers = [("p1", "Sparse trials and robust boosting for rare events", ["Sivobexi, Z.", "Fennithzune, E."], 2001, None), ("p2", long, ["Zemanobrin, V.", "Mirrzune, A."], 2010, None), ("p3", "Lagged tariffs", ["Ulmarimmel, Y.", "Draedrith, O."], 1999, None)]
    cited = [
        ("c1", papers[0][1], ["Sivobxei, Z.", "Fenithzune, E."], 2001, None),
        ("c2", "Regoinal auctoins laged tarifs moblie netwroks sparse kernels robust panels hidden markets", ["Zemnobrin, V.", "Mirzune, A."], 2010, None),
        ("c3", "Laged tarrifs", ["Ulmarimmel, Y.", "Dreadrith, O."], 1999, None),
    ]
    got = {r.c_id: r.p_id for r in linkage.link(spark.createDataFrame(cited, kind), spark.createDataFrame(papers, kind.replace("id ", "s2_paper_id ", 1))).collect()}
    assert got == {"c1": "p1", "c2": "p2", "c3": "p3"}


@pytest.mark.parametrize("n", [150, 250])
def test_no_link_hangs_on_the_number_of_like_titles(spark: SparkSession, n: int) -> None:
    """Papers share the start of their titles; citations have the title, a surname with a letter missing, and no year."""
    kind = "id string, title string, authors array<string>, year int, doi string"
    name = lambda i: "".join(chr(97 + (i * k + i // 26) % 26) for k in (1, 3, 7, 11, 5, 9, 2, 4))
    papers = [(f"p{i:03}", f"Robust estimation of lagged {words(2, i)}", [f"{name(i).title()}, B."], 2000, None) for i in range(n)]
    cited = [(p[0].replace("p", "c"), p[1], [p[2][0][:3] + p[2][0][4:]], None, None) for p in papers]
    got = linkage.link(spark.createDataFrame(cited, kind), spark.createDataFrame(papers, kind.replace("id ", "s2_paper_id ", 1))).collect()
    assert all(r.p_id == r.c_id.replace("c", "p") for r in got) and len(got) == n


def test_late_names_and_words_count(spark: SparkSession) -> None:
    """A paper of twenty authors, cited by the last two of them and the last words of its title, or by another decade."""
    kind = "id string, title string, authors array<string>, year int, doi string"
    names = [f"{words(1, i).title()}, A." for i in range(20)]
    papers = [("p1", words(14, 7), names, 2004, None), ("p2", words(14, 8), ["Иванова, О."], 2001, None)]
    cited = [("c1", " ".join(words(14, 7).split()[3:]), names[18:], 2004, None), ("c2", words(14, 8), ["Иванова, О."], 1991, None)]
    got = {r.c_id: r.p_id for r in linkage.link(spark.createDataFrame(cited, kind), spark.createDataFrame(papers, kind.replace("id ", "s2_paper_id ", 1))).collect()}
    assert got == {"c1": "p1", "c2": "p2"}


# Problem 3


def test_hilbert_neighbours_are_one_step_apart() -> None:
    grid = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    places = neighbours.hilbert_keys(grid, 3)
    assert sorted(places) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(places)], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("width", [3, 5, 6, 700, 1000, 4099])
def test_top_places(width: int) -> None:
    values = np.random.default_rng(width).standard_normal((40, width)).astype(np.float32)
    got = np.sort(np.take_along_axis(values, neighbours._top(values, 5), 1), 1)
    assert np.array_equal(got, np.sort(values, 1)[:, -5:])


def test_pairs_match_brute_force(spark: SparkSession) -> None:
    rng = np.random.default_rng(1)
    base = rng.standard_normal((300, 64))
    near = base[:80] + rng.standard_normal((80, 64)) * rng.uniform(0.02, 0.3, (80, 1))
    vectors = np.concatenate([base, near]).astype(np.float32)
    rows = [{"id": f"v{i:04}", "embedding": v.tolist()} for i, v in enumerate(vectors)]
    odd = [{"id": "n1"}, {"id": "n2", "embedding": [0.0] * 64}, {"id": "n3", "embedding": [float("nan")] * 64}, {"id": "n4", "embedding": [1.0]}, {"embedding": [1.0] * 64}, {"id": "n5", "embedding": [float("inf")] * 64}]
    table = chunks(spark, rows + rows[:50] + odd)
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1)[:, None]
    cos = unit @ unit.T
    np.fill_diagonal(cos, -2)
    want = set()
    for i in range(len(cos)):
        for j in np.argsort(-cos[i])[:5]:
            if cos[i, j] >= 0.9:
                want.add((f"v{min(i, j):04}", f"v{max(i, j):04}"))
    got = {tuple(r) for r in neighbours.similar_pairs(table).collect()}
    assert got <= want and len(got) >= 0.95 * len(want)
    top = neighbours.nearest(table)
    assert top.groupBy("id").count().agg(F.max("count")).first()[0] == 5
    assert {r.id for r in top.select("id").distinct().collect()} == {f"v{i:04}" for i in range(380)}
    assert neighbours.similar_pairs(table.limit(0)).count() == 0


def test_many_equal_vectors(spark: SparkSession) -> None:
    rows = chunks(spark, [{"id": f"{i:05}", "embedding": [1.0] * 64} for i in range(3000)])
    found = neighbours.nearest(rows, min_cosine=0.9)
    assert found.count() == 15_000
    assert found.where("abs(cosine - 1) > 1e-9 OR id = other").count() == 0


@pytest.mark.parametrize("n", [10_000, 40_000])
def test_nearest_of_unrelated_vectors_are_whole(spark: SparkSession, n: int) -> None:
    vectors = np.random.default_rng(n).standard_normal((n, 64)).astype(np.float32)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, vectors.size + 1, 64, dtype=np.int32)), pa.array(vectors.ravel()))
    rows = spark.createDataFrame(pa.table({"id": pa.array(np.arange(n)), "embedding": lists}))
    want = {(r.query_id, r.id, r["rank"]) for r in batch_vector_search(rows, rows.where("id % 100 = 0"), 5).collect()}
    found = neighbours.nearest(rows.withColumn("id", F.col("id").cast("string")))
    got = {(int(r.id), int(r.other), r["rank"]) for r in found.where("cast(id AS int) % 100 = 0").collect()}
    assert len(want) == n // 20 and got == want


def test_pairs_in_a_crowd_of_near_copies(spark: SparkSession) -> None:
    """6,000 slightly different copies of one vector, whose five nearest are all in the crowd."""
    rng = np.random.default_rng(9)
    vectors = (rng.standard_normal(64) + 0.02 * rng.standard_normal((6000, 64))).astype(np.float32)
    rows = spark.createDataFrame([(f"{i:05}", v.tolist()) for i, v in enumerate(vectors)], "id string, embedding array<float>")
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1)[:, None]
    want = set()
    for i in range(len(unit)):
        cos = unit @ unit[i]
        cos[i] = -2
        want |= {(f"{min(i, j):05}", f"{max(i, j):05}") for j in np.argpartition(-cos, 4)[:5]}
    assert {tuple(r) for r in neighbours.similar_pairs(rows).collect()} == want


@pytest.mark.parametrize("n", [400, 3000, 30_000])
def test_pairs_of_a_cluster_among_unrelated_vectors(spark: SparkSession, n: int) -> None:
    """A cluster of a mutual cosine of about 0.95, a run of equal vectors, and unrelated ones; a hundredth of the cluster against all rows."""
    rng = np.random.default_rng(n)
    center = rng.standard_normal(64)
    vectors = np.concatenate([center + 0.23 * rng.standard_normal((n, 64)), np.tile(rng.standard_normal(64), (700, 1)), rng.standard_normal((4000, 64))]).astype(np.float32)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, vectors.size + 1, 64, dtype=np.int32)), pa.array(vectors.ravel()))
    rows = spark.createDataFrame(pa.table({"id": pa.array([f"{i:06}" for i in range(len(vectors))]), "embedding": lists}))
    found = neighbours.nearest(rows, min_cosine=0.9, reach=512)
    got: dict[int, set[int]] = {}
    for r in found.where("cast(id AS int) % 100 = 0").collect():
        got.setdefault(int(r.id), set()).add(int(r.other))
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1)[:, None]
    wrong = 0
    for i in range(0, n, 100):
        cos = unit @ unit[i]
        cos[i] = -2
        best = {int(j) for j in np.argsort(-cos)[:5] if cos[j] >= 0.9}
        wrong += len(best ^ got.get(i, set()))
    assert wrong == 0
    for i in range(n, n + 700, 100):
        assert len(got[i]) == 5 and all(n <= j < n + 700 and j != i for j in got[i])


# Problem 4


def jaccard(a: str, b: str) -> float:
    x, y = ({tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_near_duplicates_match_brute_force(spark: SparkSession) -> None:
    rng = random.Random(3)
    texts = {f"t{i:02}": words(120, i) for i in range(20)}
    for i in range(20):
        own = texts[f"t{i:02}"].split()
        for _ in range(rng.randint(1, 9)):
            own[rng.randrange(len(own))] = "edited"
        texts[f"u{i:02}"] = " ".join(own)
    texts |= {"copy1": texts["t00"], "copy2": texts["t00"].upper(), "short": "too few words", "short2": "too few words"}
    rows = [{"id": k, "content": v} for k, v in texts.items()]
    table = chunks(spark, rows + rows[:5] + [{"id": "null"}, {"id": "blank", "content": " "}, {"content": texts["t00"]}])
    long = {k: v for k, v in texts.items() if len(v.split()) >= 40}
    want = {(a, b) for a in long for b in long if a < b and jaccard(long[a], long[b]) >= 0.6}
    assert {tuple(r) for r in near_duplicates.near_duplicate_pairs(table).collect()} == want
    assert {tuple(r) for r in near_duplicates.near_duplicate_pairs(table, exact=True).collect()} == want
    groups = {r.id: r.group for r in near_duplicates.near_duplicate_groups(table).collect()}
    assert set(groups) == set(long)
    assert groups["copy1"] == groups["copy2"] == groups["t00"] == "copy1"
    assert all(groups[a] == groups[b] for a, b in want)
    assert near_duplicates.near_duplicate_pairs(table.limit(0)).count() == 0


def test_pairs_near_the_threshold_are_met(spark: SparkSession) -> None:
    """1,500 pairs of similarity 69 / 113 = 0.61, of texts that share nothing else."""
    rng = random.Random(6)
    rows = []
    for i in range(1500):
        own = [f"w{rng.getrandbits(40):x}" for _ in range(93)]
        other = own[:71] + [f"w{rng.getrandbits(40):x}" for _ in range(22)]
        rows += [{"id": f"a{i:04}", "content": " ".join(own)}, {"id": f"b{i:04}", "content": " ".join(other)}]
    assert 0.6 < jaccard(rows[0]["content"], rows[1]["content"]) < 0.62
    got = {tuple(r) for r in near_duplicates.near_duplicate_pairs(chunks(spark, rows)).collect()}
    assert got == {(f"a{i:04}", f"b{i:04}") for i in range(1500)}
    assert {tuple(r) for r in near_duplicates.near_duplicate_pairs(chunks(spark, rows), exact=True).collect()} == got


def test_a_chain_is_one_group(spark: SparkSession) -> None:
    base = [f"w{i}" for i in range(300)]
    rows = [{"id": f"{k:02}", "content": " ".join(base[8 * k : 8 * k + 60])} for k in range(30)]
    groups = {r.group for r in near_duplicates.near_duplicate_groups(chunks(spark, rows)).collect()}
    assert groups == {"00"}


def test_a_crowd_of_near_copies_is_one_group(spark: SparkSession) -> None:
    """30,000 texts that differ in one word of 60, and two more crowds: all pairs of them would be 450 million."""
    base = [f"w{i}" for i in range(180)]
    rows = []
    for i in range(30_000):
        own = base[:60]
        own[i % 60] = f"x{i}"
        rows.append((f"{i:05}", " ".join(own)))
    rows += [(f"y{i:04}", " ".join([*base[60:120], f"y{i}"])) for i in range(500)] + [(f"z{i:04}", " ".join([*base[100:160], f"y{i}"])) for i in range(500)]
    found = near_duplicates.near_duplicate_groups(spark.createDataFrame(rows, "id string, content string"))
    assert {(r.group, r.n) for r in found.groupBy("group").agg(F.count("*").alias("n")).collect()} == {("00000", 30_000), ("y0000", 500), ("z0000", 500)}


# Problem 5

TITLE, AUTHORS = "The role of boosting in panels: a study of effects", ["Sivobexi, Zelmo", "Mirrzune, Ada"]
PLAIN = "The estimator explains the average outcome of the sample while the variance stays modest."


def noisy(spark: SparkSession, texts: dict[str, str | None], pages: tuple[int | None, int | None] = (12, 13)) -> tuple[DataFrame, DataFrame]:
    clean = [{"id": f"clean{i:02}", "source_id": "s", "content": PLAIN, "page_start": 1, "page_end": 1} for i in range(30)]
    rows = chunks(spark, clean + [{"id": k, "source_id": "s", "content": v, "page_start": pages[0], "page_end": pages[1]} for k, v in texts.items()])
    return rows, spark.createDataFrame([("s", TITLE, AUTHORS, "clash"), ("t", None, None, None)], "id string, title string, authors array<string>, content string")


CASES = {
    "hyphen": ("The esti-\nmator explains the outcome.", {"hyphenation"}),
    "compound": ("We use kernel-\nweighted sums.", {"hyphenation"}),
    "suspended": ("The pre-\nand post-treatment outcome.", set()),
    "formula": ("y = a + b x - \nc z", set()),
    "broken_misread": ("The esti-\nrnator explains the outcome.", {"hyphenation", "misread"}),
    "across": ("The esti-\n\nThe role of boosting in panels    12\n\nmator explains.", {"hyphenation", "header"}),
    "across_two": ("The esti-\nThe role of boosting in panels    12\n\n13  |  Sivobexi and Mirrzune\nmator explains.", {"hyphenation", "header"}),
    "across_many": ("The esti-\n\n\n\n\n\n\n- 12 -\n\n\n\nmator explains.", {"hyphenation", "page_number"}),
    "across_text": ("The esti-\nThe Sample Stays\nmator explains.", set()),
    "misread": ("The estirnator explains the 0utcome.", {"misread"}),
    "number": ("It appeared in 2O15 with R2 and L1 norms.", {"misread"}),
    "symbols": ("Let R2 and T1 denote x0.", set()),
    "title": ("THE ROLE OF BOOSTING IN PANELS: A STUDY OF EFFECTS\nThe sample stays.", {"header"}),
    "surnames": ("13  |  Sivobexi and Mirrzune\nThe sample stays.", {"header"}),
    "et_al": ("13    SIVOBEXI ET AL.\nThe sample stays.", {"header"}),
    "cited": ("The sample stays, after\nSivobexi et al. (1998).", set()),
    "misread_title": ("The role of boosfing in panels\nThe sample stays.", {"header", "misread"}),
    "page": ("The sample stays.\n- 13 -", {"page_number"}),
    "other_page": ("The sample stays.\n99", set()),
    "year": ("The sample stays, see Doe\n(1998).", set()),
    "null": (None, set()),
    "blank": ("  ", set()),
}


def test_noise(spark: SparkSession) -> None:
    rows, sources = noisy(spark, {k: v for k, (v, _) in CASES.items()})
    found = scans.find_noise(rows.union(rows), sources)[0].collect()
    got = {k: {r.noise for r in found if r.chunk_id == k} for k in CASES}
    assert got == {k: want for k, (_, want) in CASES.items()}
    assert len(found) == len(set(found)) and not any(r.chunk_id.startswith("clean") for r in found)
    assert scans.find_noise(rows.limit(0), sources)[0].count() == 0
    assert scans.find_noise(rows, sources.limit(0))[0].where("noise = 'header'").count() == 0


@pytest.mark.parametrize("title", ["Роль усиления в панелях: обзор", "パネルにおける推定の役割について", "what panels say about boosting.", "Panels " * 60])
def test_headers_of_any_title(spark: SparkSession, title: str) -> None:
    rows = chunks(spark, [{"id": "a", "source_id": "s", "content": f"{title}  12\nThe sample stays."}, {"id": "b", "source_id": "s", "content": "Something else 12\nThe sample stays."}])
    sources = spark.createDataFrame([("s", title, ["Doe, J."])], "id string, title string, authors array<string>")
    assert {tuple(r) for r in scans.find_noise(rows, sources)[0].collect()} == {("a", "header")}


def test_confused_words() -> None:
    assert all(scans.reads_as(a, b) for a, b in [("estirnator", "estimator"), ("0utc0me", "outcome"), ("m·odel", "model"), ("cliff", "diff"), ("same", "same")])
    assert not any(scans.reads_as(a, b) for a, b in [("abc", "abd"), ("0utc0rne", "outcome"), ("model", "models")])


def test_page_numbers_need_pages() -> None:
    assert not scans.is_page_number("12", None, None)
    assert scans.is_page_number("[l2]", 12, 12) and scans.is_page_number("Page 13", 12, None) and not scans.is_page_number("(12)", 12, 12)


def test_repair(spark: SparkSession) -> None:
    text = "The esti-\nmator explairis the average\noutcome of the\n\nThe role of boosting in panels    12\n\nsample while the variance stays\nmodest.\n\n- 12 -\nWe use kernel-\nweighted sums in 2O15."
    rows, sources = noisy(spark, {"n": text, "null": None, "blank": " "})
    got = {r.chunk_id: r.content for r in scans.repair(rows.union(rows), sources).collect()}
    assert got["n"] == "The estimator explains the average outcome of the sample while the variance stays modest.\n\nWe use kernel-weighted sums in 2015."
    assert got["clean00"] == PLAIN and got["null"] is None and got["blank"] == " "
    assert len(got) == 33


# Problem 6


@pytest.mark.skipif(not FILE.exists(), reason="no vocabulary")
def test_merges_build_on_earlier_ones() -> None:
    assert encoding.ByteBpe(str(FILE)).ordered


@pytest.mark.skipif(not FILE.exists(), reason="no vocabulary")
def test_ids_equal_the_library(spark: SparkSession) -> None:
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(str(FILE))
    library.encode_special_tokens = True
    rng = random.Random(5)
    texts = ["", None, " ", "a" * 3000, " " * 300 + "x", "it's I'LL <|endoftext|>\n\n\tx", "𝒳 é漢字🤦🏼‍♂️ ½²٣", "\x1c a\x1d\x85c\xa0d", "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4000))]
    texts += ["".join(chr(rng.choice((rng.randrange(32, 127), rng.randrange(160, 0x3000), 32, 10))) for _ in range(200)) for _ in range(40)]
    rows = spark.createDataFrame([(i, t, "clash", "s") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string, source string")
    got = {r.doc_id: r.ids for r in encoding.encode(rows).collect()}
    assert got == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    counts = {r.doc_id: r.n_tokens for r in encoding.count_tokens(rows).collect()}
    assert counts == {k: len(v) for k, v in got.items()}
    assert encoding.encode(rows.limit(0)).count() == 0


# Problem 7


def test_transfer_keeps_the_weighted_sum() -> None:
    rng = np.random.default_rng(0)
    weights = rng.integers(1, 500, 400).astype(float)
    total, means = [], np.zeros(400)
    for k in range(200):
        parts = np.full(400, 0.3)
        left = mixing.transfer(parts, weights, np.random.default_rng(k))
        assert sum(0 < p < 1 for p in parts) <= 1 and (left < 0 or 0 < parts[left] < 1)
        total.append((parts * weights).sum())
        means += parts / 200
    assert np.allclose(total, 0.3 * weights.sum())
    assert abs(means.mean() - 0.3) < 0.02 and np.abs(means - 0.3).max() < 0.2


def mixture(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    rng = random.Random(1)
    rows = [(i, "big" if i % 3 else "small", rng.randint(50, 900)) for i in range(3000)] + [(9001, None, 5), (9002, "unlisted", 5), (9003, "big", 0)]
    targets = [("big", 0.5, 1), ("small", 0.4, 3), ("absent", 0.1, 2), (None, 0.1, 1), ("zero", 0.0, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


@pytest.mark.parametrize(("block", "fan"), [(100_000, 64), (50, 4)])
def test_draw_meets_shares(spark: SparkSession, block: int, fan: int) -> None:
    tokens, targets = mixture(spark)
    plan = mixing.plan_shares(tokens, targets).cache()
    drawn = mixing.draw(tokens, plan, block_size=block, fan_in=fan).collect()
    sums: Counter = Counter()
    for r in drawn:
        sums[r.source] += r.n_tokens * r.copies
        assert 1 <= r.copies <= {"big": 1, "small": 3}[r.source]
    assert len({r.doc_id for r in drawn}) == len(drawn)
    goals = {r.source: r.goal_share * r.total for r in plan.collect()}
    assert all(abs(sums[s] - goals[s]) < 900 for s in ("big", "small"))
    assert drawn == mixing.draw(tokens.repartition(7), plan, block_size=block, fan_in=fan).collect() or Counter(drawn) == Counter(mixing.draw(tokens.repartition(7), plan, block_size=block, fan_in=fan).collect())


def test_draw_of_nothing(spark: SparkSession) -> None:
    tokens, targets = mixture(spark)
    assert mixing.draw(tokens.limit(0), mixing.plan_shares(tokens.limit(0), targets)).count() == 0
    assert mixing.draw(tokens, mixing.plan_shares(tokens, targets.limit(0))).count() == 0


# Problem 8


@pytest.mark.parametrize(
    ("a", "b"),
    [("ｆｕｌｌ width", "full width"), ("a​b­c", "abc"), ("a b c", "a b c"), ("é", "é"), ("раре", "pape"), ("ﬁt", "fit"), ("ÅK", "ÅK"), ("non‑stop", "non-stop"), ("x\r\ny", "x\ny"), ("µ", "μ"), ("νακρο", "vaĸpo"), ("օս", "ou"), ("ѵԍ", "vg"), ("ᎪᏢ", "AP"), ("ᴏᴠ", "ov"), ("ꓮꓐ", "AB"), ("кот", "κoт")],
)
def test_same_looks(a: str, b: str) -> None:
    assert lookalike.skeleton(a) == lookalike.skeleton(b)


@pytest.mark.parametrize(("a", "b"), [("A", "a"), ("é", "e"), ("0", "O"), ("1", "l"), ("a.", "a"), ("x²", "x2"), ("½", "1/2"), ("a b", "a  b"), ("👩‍🔬", "👩🔬"), ("й", "и"), ("a\nb", "a b"), ("-", "–")])
def test_other_looks(a: str, b: str) -> None:
    assert lookalike.skeleton(a) != lookalike.skeleton(b)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40))
def test_skeletons_are_stable(text: str) -> None:
    once = lookalike.skeleton(text)
    assert lookalike.skeleton(once) == once
    assert lookalike.skeleton(unicodedata.normalize("NFC", text)) == lookalike.skeleton(unicodedata.normalize("NFD", text))


def test_lookalike_pairs(spark: SparkSession) -> None:
    texts = ["abc", "abc", "ａbc", "a​bc", None, "", " ", " ", "Abc", "x" * 100_000, "x" * 99_999 + "ｘ", "​"]
    rows = spark.createDataFrame([(i, t, b"1") for i, t in enumerate(texts)], "doc_id bigint, text string, looks binary")
    got = {tuple(r) for r in lookalike.lookalike_pairs(rows.union(rows)).collect()}
    assert got == {(0, 2), (1, 2), (0, 3), (1, 3), (2, 3), (9, 10)}
    forms = {r.doc_id: r.form for r in lookalike.consistent_form(rows).collect()}
    assert forms[2] == "abc" and forms[4] is None and forms[5] == ""
    assert lookalike.lookalike_pairs(rows.limit(0)).count() == 0
    classes = {r.doc_id: (r.group, r.n_links) for r in lookalike.lookalike_classes(rows.union(rows)).collect()}
    assert classes == {0: (0, 2), 1: (0, 2), 2: (0, 3), 3: (0, 3), 8: (8, 0), 9: (9, 1), 10: (9, 1)}
    assert lookalike.lookalike_classes(rows.limit(0)).count() == 0


def test_one_variant_beside_many_copies(spark: SparkSession) -> None:
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 7, "ｓame").otherwise("same").alias("text"))
    found = lookalike.lookalike_pairs(rows)
    assert found.count() == found.distinct().count() == 39_999
    assert lookalike.lookalike_classes(rows).agg(F.sum("n_links"), F.count_distinct("group")).first()[:] == (2 * 39_999, 1)
