"""Operators on citations: matching, edges, authority, coupling and statistics."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.operators.lineage import materialize
from folioscope.operators.similar_texts import plain, similar_texts


def trigram_pairs(left: DataFrame, right: DataFrame, threshold: float, ordered: bool = False) -> DataFrame:
    """a, b and similarity of rows (id, text) whose trigram sets have a Jaccard coefficient of at least ``threshold``.

    Exact: see similar_texts. Rows of equal texts are one text until the last
    join. ``ordered`` keeps a < b of a self-join. Where both sides have a
    ``year``, pairs of two different years are left out.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")

    years = ["year"] if "year" in left.columns and "year" in right.columns else []

    def texts(rows: DataFrame) -> DataFrame:
        return rows.select("id", plain("text").alias("plain"), *years).where("plain <> ''")

    own = ordered and left is right and not years
    a = materialize(texts(left), "left")
    b = a if own else materialize(texts(right), "right")
    pairs = similar_texts(a, None if own else b, threshold)
    x, y = (rows.select(F.col("id").alias(n), F.col("plain").alias(t), *[F.col(c).alias(f"{c}_{t}") for c in years]) for rows, n, t in ((a, "a", "x"), (b, "b", "y")))
    found = pairs.join(x, "x").join(y, "y")
    if years:
        found = found.where("year_x IS NULL OR year_y IS NULL OR year_x = year_y")
    if own:
        found = found.where("a < b OR x <> y AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
    elif ordered:
        found = found.where("a < b")
    return found.select("a", "b", "similarity")


def _still_possible(met: DataFrame, threshold: float) -> DataFrame:
    """Distinct a, b, n_a and n_b of matches in prefixes (at_a, at_b are places in the global order), of which what matched and what follows the last match can reach the threshold."""
    pairs = met.groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("k"), F.max("at_a").alias("i"), F.max("at_b").alias("j"))
    most = F.col("k") + F.least(F.col("n_a") - F.col("i"), F.col("n_b") - F.col("j"))
    return pairs.where(most >= F.lit(threshold / (1 + threshold)) * (F.col("n_a") + F.col("n_b")) - 1e-9).select("a", "b", "n_a", "n_b")


def match_to_targets(citations: DataFrame, targets: DataFrame, threshold: float = 0.85) -> DataFrame:
    """id, target_id and method of each citation: by DOI, then by arXiv id, then by trigram similarity of titles where the years agree or one is unknown.

    Both sides need id, doi, arxiv_id, title and year. Several targets: the most
    similar, then the least id. Unmatched citations have a null target.
    """
    by_id = []
    for k, column in enumerate(("doi", "arxiv_id")):
        key = F.lower(F.trim(column))
        ids = targets.where(F.col(column).isNotNull()).groupBy(key.alias("key")).agg(F.min("id").alias("target_id"))
        by_id.append(citations.where(F.col(column).isNotNull()).select("id", key.alias("key")).join(ids, "key").select("id", "target_id", F.lit(k).alias("rank"), F.lit(1.0).alias("similarity")))
    # Of targets with one title and year the least id would be taken anyway.
    least = targets.groupBy(F.col("title").alias("text"), "year").agg(F.min("id").alias("id"))
    pairs = trigram_pairs(citations.select("id", F.col("title").alias("text"), "year"), least, threshold)
    by_title = pairs.select(F.col("a").alias("id"), F.col("b").alias("target_id"), F.lit(2).alias("rank"), "similarity")
    found = by_id[0].unionByName(by_id[1]).unionByName(by_title)
    best = found.groupBy("id").agg(F.min(F.struct("rank", -F.col("similarity"), "target_id")).alias("b"))
    method = F.when(F.col("b.target_id").isNotNull(), F.element_at(F.array(F.lit("doi"), F.lit("arxiv"), F.lit("title")), F.col("b.rank") + 1))
    return citations.select("id").join(best, "id", "left").select("id", F.col("b.target_id").alias("target_id"), method.alias("method"))


def contained_titles(citations: DataFrame, targets: DataFrame, size: int = 5) -> DataFrame:
    """id and target_id of citations (id, title) whose title holds a target's or is held by it, in lower case; the least target of several.

    A title within another has all its runs of ``size`` characters there, so
    each title's rarest run is looked up among the others' runs and what meets is
    compared. Titles of fewer characters hold and are held by none.
    """

    def runs(rows: DataFrame, name: str) -> DataFrame:
        t = F.lower(F.trim("title"))
        each = F.transform(F.sequence(F.lit(1), F.length("t") - (size - 1)), lambda i: F.substring("t", i, size))
        rows = rows.where("title IS NOT NULL").select(F.col("id").alias(name), t.alias("t")).where(F.length("t") >= size)
        return rows.select(name, F.col("t").alias(f"t_{name}"), F.explode(F.array_distinct(each)).alias("run"))

    sides = {"a": materialize(runs(citations, "a"), "runs"), "b": materialize(runs(targets, "b"), "runs")}
    counts = {k: v.groupBy("run").agg(F.count("*").alias("n")) for k, v in sides.items()}
    met = None
    for inner, outer in (("a", "b"), ("b", "a")):
        # A run that the other side lacks proves that nothing there holds the title.
        best = sides[inner].join(counts[outer], "run", "left").groupBy(inner, f"t_{inner}").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "run")).alias("r")).where("r.col1 > 0")
        near = best.select(inner, f"t_{inner}", F.col("r.run").alias("run")).join(sides[outer], "run").where(F.contains(F.col(f"t_{outer}"), F.col(f"t_{inner}"))).select("a", "b")
        met = near if met is None else met.unionByName(near)
    return met.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("target_id"))


def match_exactly(citations: DataFrame, targets: DataFrame) -> DataFrame:
    """id and target_id by DOI, arXiv id, or equal lower-case title and year."""
    title = F.concat_ws("|", F.lower(F.trim("title")), F.coalesce(F.col("year").cast("string"), F.lit("")))
    found = None
    for k, key in enumerate((F.lower("doi"), F.lower("arxiv_id"), F.when(F.col("title").isNotNull(), title))):
        ids = targets.select(key.alias("key"), "id").where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("target_id"))
        met = citations.select("id", key.alias("key")).where("key IS NOT NULL").join(ids, "key").select("id", "target_id", F.lit(k).alias("rank"))
        found = met if found is None else found.unionByName(met)
    best = found.groupBy("id").agg(F.min(F.struct("rank", "target_id")).alias("b"))
    return citations.select("id").join(best, "id", "left").select("id", F.col("b.target_id").alias("target_id"))


def match_simply(citations: DataFrame, targets: DataFrame) -> DataFrame:
    """As match_exactly; then, of what is left, by a title that holds the other (see contained_titles)."""
    best = materialize(match_exactly(citations, targets), "matched")
    left = citations.select("id", "title").join(best.where("target_id IS NULL").select("id"), "id", "left_semi")
    more = contained_titles(left, targets.select("id", "title")).withColumnRenamed("target_id", "held")
    return best.join(more, "id", "left").select("id", F.coalesce("target_id", "held").alias("target_id"))


def citation_edges(citations: DataFrame, matches: DataFrame) -> DataFrame:
    """citing, cited (null for a work outside) and citation_id, one edge for each citation."""
    return citations.select(F.col("id"), F.col("source_id").alias("citing")).join(matches, "id", "left").select("citing", F.col("target_id").alias("cited"), F.col("id").alias("citation_id"))


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 20, damping: float = 0.85, cut_every: int = 5) -> DataFrame:
    """id and authority: PageRank divided by its maximum.

    All scores move together; parallel edges count each, edges to or from
    unknown nodes don't, what reaches a node without out-edges is lost. Edges
    are combined by end and weighted once, and stay partitioned by their start, so a round moves only scores; its
    partial sums take the load of a much-cited node. Lineage is cut every few rounds.
    """
    ids = nodes.select("id").distinct()
    known = edges.select("src", "dst").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    out = known.groupBy("src").agg(F.count("*").alias("out"))
    share = known.groupBy("src", "dst").agg(F.count("*").alias("n")).join(out, "src").select("src", "dst", (F.col("n") / F.col("out")).alias("share"))
    spark = nodes.sparkSession
    share = materialize(share, "shares").repartition(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), "src").persist(StorageLevel.MEMORY_AND_DISK)
    ids = materialize(ids.crossJoin(F.broadcast(ids.agg(F.count("*").alias("n")))), "nodes")
    scores = ids.select("id", (F.lit(1.0) / F.col("n")).alias("score"))
    cut = None
    for k in range(1, iterations + 1):
        moved = share.join(scores.withColumnRenamed("id", "src"), "src").groupBy("dst").agg(F.sum(F.col("share") * F.col("score")).alias("moved"))
        scores = ids.join(moved.withColumnRenamed("dst", "id"), "id", "left").select("id", (F.lit(1 - damping) / F.col("n") + damping * F.coalesce("moved", F.lit(0.0))).alias("score"))
        if k % cut_every == 0 or k == iterations:
            scores = cut = materialize(scores, "scores", cut)
    share.unpersist()
    most = scores.agg(F.max("score").alias("most"))
    return scores.crossJoin(F.broadcast(most)).select("id", F.coalesce(F.try_divide("score", "most"), F.lit(0.0)).alias("authority"))


def coupling(references: DataFrame, least: float = 0.1) -> DataFrame:
    """a < b, shared and strength: Jaccard of the works that two sources cite, of at least ``least``.

    References are (citing, cited), null ends left out, repeats count once.
    Exact by prefix filtering on the rarest works, so a work that everyone
    cites brings no pairs together by itself; shared works are counted only
    for candidates.
    """
    refs = references.where("citing IS NOT NULL AND cited IS NOT NULL").select("citing", "cited").distinct()
    df = refs.groupBy("cited").agg(F.count("*").alias("df"))
    by = Window.partitionBy("citing").orderBy("df", "cited")
    ranked = refs.join(df, "cited").withColumn("at", F.row_number().over(by)).withColumn("n", F.count("*").over(Window.partitionBy("citing")))
    ranked = materialize(ranked, "references")
    prefix = ranked.where((F.col("at") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1) & (F.col("df") > 1))
    x, y = (prefix.select("cited", F.col("citing").alias(c), F.col("n").alias(f"n_{c}"), F.col("at").alias(f"at_{c}")) for c in ("a", "b"))
    pairs = _still_possible(x.join(y, "cited").where("a < b").where((F.col("n_a") >= least * F.col("n_b")) & (F.col("n_b") >= least * F.col("n_a"))), least)
    sets = ranked.groupBy("citing").agg(F.collect_set("cited").alias("works"))
    both = pairs.join(sets.select(F.col("citing").alias("a"), F.col("works").alias("x")), "a").join(sets.select(F.col("citing").alias("b"), F.col("works").alias("y")), "b")
    shared = both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("x", "y")).cast("bigint").alias("shared"))
    strength = F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))
    return shared.select("a", "b", "shared", strength.alias("strength")).where(F.col("strength") >= least - 1e-12)


def similar_sources(pairs: DataFrame, source: str, limit: int = 10) -> DataFrame:
    """other, shared and strength of the sources coupled with one, from either side."""
    both = pairs.where(F.col("a") == source).select(F.col("b").alias("other"), "shared", "strength").unionByName(pairs.where(F.col("b") == source).select(F.col("a").alias("other"), "shared", "strength"))
    return both.orderBy(F.desc("strength"), "other").limit(limit)


def coupling_statistics(pairs: DataFrame) -> DataFrame:
    """One row: pairs, mean and largest strength, and the sources in any pair, each once."""
    ends = pairs.select(F.col("a").alias("s")).unionByName(pairs.select(F.col("b").alias("s"))).agg(F.count_distinct("s").alias("sources"))
    return pairs.agg(F.count("*").alias("pairs"), F.avg("strength").alias("mean_strength"), F.max("strength").alias("max_strength")).crossJoin(ends)


def source_statistics(sources: DataFrame, edges: DataFrame) -> DataFrame:
    """For each source: works it cites, sources it cites, and those that cite it by type. Each end is joined by itself."""
    made = edges.groupBy(F.col("citing").alias("id")).agg(F.count("*").alias("references_made"), F.count_distinct("cited").alias("sources_cited"))
    kinds = sources.select(F.col("id").alias("citing"), "source_type")
    got = edges.where("cited IS NOT NULL").select("citing", "cited").join(kinds, "citing").groupBy(F.col("cited").alias("id")).agg(F.count("*").alias("citations_received"), F.count_if(F.col("source_type") == "paper").alias("from_papers"), F.count_if(F.col("source_type") == "textbook").alias("from_textbooks"))
    return sources.select("id").join(made, "id", "left").join(got, "id", "left").fillna(0)


def corpus_summary(sources: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: sources, citations, those inside and outside, sources that cite and are cited."""
    of_edges = edges.agg(F.count("*").alias("citations"), F.count("cited").alias("inside"), (F.count("*") - F.count("cited")).alias("outside"), F.count_distinct("citing").alias("citing_sources"), F.count_distinct("cited").alias("cited_works"))
    return sources.agg(F.count("*").alias("sources")).crossJoin(of_edges)


def most_cited(edges: DataFrame, works: DataFrame, limit: int = 10) -> DataFrame:
    """id, citations and authority of the works cited most."""
    counts = edges.where("cited IS NOT NULL").groupBy(F.col("cited").alias("id")).agg(F.count("*").alias("citations"))
    return counts.join(works.select("id", "authority"), "id").orderBy(F.desc("citations"), F.desc("authority"), "id").limit(limit)


def citing(edges: DataFrame, work: str, limit: int = 100) -> DataFrame:
    """citing and n, the sources that cite a work."""
    return edges.where(F.col("cited") == work).groupBy("citing").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "citing").limit(limit)


def bibtex_authors(authors: Column) -> Column:
    """Names as 'Last, First' joined by 'and'."""
    turned = F.transform(authors, lambda a: F.when(F.instr(a, ",") > 0, a).otherwise(F.regexp_replace(F.trim(a), r"^(.*)\s+(\S+)$", "$2, $1")))
    return F.array_join(turned, " and ")


def coupling_score(pairs: DataFrame, one: str, other: str) -> DataFrame:
    """shared and strength of two sources, in either order; no row where they aren't coupled."""
    ends = F.array_sort(F.array("a", "b")) == F.array_sort(F.array(F.lit(one), F.lit(other)))
    return pairs.where(ends).select("shared", "strength")
