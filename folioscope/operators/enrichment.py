"""Fuzzy comparison of names, venues and titles, and choosing the paper that a citation means among candidates."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window


def ratio(a: str | None, b: str | None) -> float:
    """Matching share of two strings in lower case without outer blanks; 0 if one is missing or empty."""
    a, b = (a or "").lower().strip(), (b or "").lower().strip()
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def overlap(cited: list[str] | None, known: list[str] | None, least: float = 0.7) -> float:
    """Share of cited names with a known name of a ratio of at least ``least``."""
    if cited is None or known is None or not len(cited) or not len(known):
        return 0.0
    return sum(any(ratio(c, k) >= least for k in known) for c in cited) / len(cited)


@pandas_udf(DoubleType())
def ratio_of(a: pd.Series, b: pd.Series) -> pd.Series:
    """The ratio of two columns."""
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


@pandas_udf(DoubleType())
def overlap_of(cited: pd.Series, known: pd.Series) -> pd.Series:
    """The overlap of two columns of names."""
    return pd.Series([overlap(x, y) for x, y in zip(cited, known, strict=True)], dtype=float)


def fuzzy_score(a: Column, b: Column) -> Column:
    """Equal names 1, one within the other 0.9, else their ratio."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return F.when(x == y, 1.0).when((x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x)), 0.9).otherwise(ratio_of(a, b))


def venue_score(a: Column, b: Column) -> Column:
    """Equal venues 1, one the other's abbreviation by first letters 0.9, else their ratio."""
    initials = lambda c: F.array_join(F.transform(F.filter(F.split(F.lower(c), r"[^a-z]+"), lambda w: (w != "") & ~w.isin("of", "the", "and", "in", "for", "on")), lambda w: F.substring(w, 1, 1)), "")
    short = (F.lower(F.trim(a)) == initials(b)) | (F.lower(F.trim(b)) == initials(a))
    return F.when(a.isNull() | b.isNull(), 0.0).when(F.lower(F.trim(a)) == F.lower(F.trim(b)), 1.0).when(short, 0.9).otherwise(ratio_of(a, b))


def year_score(a: Column, b: Column) -> Column:
    """Equal years 1, neighbours 0.5, else or unknown 0."""
    return F.coalesce(F.when(a == b, 1.0).when(F.abs(a - b) == 1, 0.5), F.lit(0.0))


def chosen_papers(citations: DataFrame, papers: DataFrame, least: float = 0.8) -> DataFrame:
    """id, paper_id, method and confidence: by DOI (1.0), arXiv id (0.95), a title that one paper alone has (0.8), or several signals among those of one title.

    Signals are weighted 0.4 authors, 0.3 venue, 0.2 year and 0.1 citations
    against the most cited candidate; below ``least`` a citation with candidates is
    ambiguous, without any unmatched. Both sides need id, title, authors, year,
    venue, doi and arxiv_id, papers citation_count too.
    """
    title = F.regexp_replace(F.lower("title"), "[^a-z0-9]+", " ")
    c, p = citations.withColumn("key", F.trim(title)), papers.withColumn("key", F.trim(title))
    exact = None
    for k, (column, method, score) in enumerate((("doi", "doi", 1.0), ("arxiv_id", "arxiv", 0.95))):
        ids = p.where(F.col(column).isNotNull()).groupBy(F.lower(column).alias("k")).agg(F.min("id").alias("paper_id"))
        met = c.where(F.col(column).isNotNull()).select("id", F.lower(column).alias("k")).join(ids, "k").select("id", "paper_id", F.lit(k).alias("rank"), F.lit(method).alias("method"), F.lit(score).alias("confidence"))
        exact = met if exact is None else exact.unionByName(met)
    right = p.where("key <> ''").select("key", F.col("id").alias("paper_id"), F.col("authors").alias("p_authors"), F.col("venue").alias("p_venue"), F.col("year").alias("p_year"), F.coalesce("citation_count", F.lit(0)).alias("cited"))
    pairs = c.join(right, "key").withColumn("n", F.count("*").over(Window.partitionBy("id"))).withColumn("most", F.max("cited").over(Window.partitionBy("id")))
    popular = F.when(F.col("most") > 0, F.col("cited") / F.col("most")).otherwise(0.5)
    several = 0.4 * overlap_of("authors", "p_authors") + 0.3 * venue_score(F.col("venue"), F.col("p_venue")) + 0.2 * year_score(F.col("year"), F.col("p_year")) + 0.1 * popular
    scored = pairs.select("id", "paper_id", "n", F.when(F.col("n") == 1, 0.8).otherwise(several).alias("confidence"))
    by = Window.partitionBy("id").orderBy(F.desc("confidence"), "paper_id")
    titled = scored.withColumn("at", F.row_number().over(by)).where("at = 1").select("id", F.when((F.col("n") == 1) | (F.col("confidence") >= least), F.col("paper_id")).alias("paper_id"), F.lit(2).alias("rank"), F.when(F.col("n") == 1, "title").when(F.col("confidence") >= least, "signals").otherwise("ambiguous").alias("method"), "confidence")
    best = exact.unionByName(titled).groupBy("id").agg(F.min_by(F.struct("paper_id", "method", "confidence"), F.struct("rank", "paper_id")).alias("b"))
    return citations.select("id").join(best, "id", "left").select("id", "b.paper_id", F.coalesce("b.method", F.lit("unmatched")).alias("method"), F.coalesce("b.confidence", F.lit(0.0)).alias("confidence"))


def best_names(expected: DataFrame, returned: DataFrame, least: float = 0.7) -> DataFrame:
    """expected, name and score of the returned name most like an expected one (group, expected, aliases; returned group, name), if at least ``least``.

    Equal names are joined as such and settle what they meet, as nothing scores
    higher. The rest meets all names of its group whose length allows ``least``
    or that may hold one another; a key of shared letter triples would lose
    pairs, as a ratio of 0.7 needs no triple in common.
    """
    folded = lambda c: F.regexp_replace(F.lower(c), r"(?U)^\s+|\s+$", "")
    forms = expected.select("group", "expected", F.explode(F.concat(F.array("expected"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("form")).distinct().withColumn("x", folded(F.col("form")))
    names = returned.select("group", "name").distinct().withColumn("y", folded(F.col("name")))
    equal = forms.join(names.withColumnRenamed("y", "x"), ["group", "x"]).where(F.lower(F.trim("form")) == F.lower(F.trim("name"))).select("group", "expected", "name", F.lit(1.0).alias("score"))
    n, m = F.length("x"), F.length("y")
    possible = (2 * F.least(n, m) >= least * (n + m) - 1e-9) | F.contains("x", "y") | F.contains("y", "x")
    rest = forms.join(equal.select("group", "expected").distinct(), ["group", "expected"], "left_anti").join(names, "group").where(possible)
    scored = equal.unionByName(rest.select("group", "expected", "name", fuzzy_score(F.col("form"), F.col("name")).alias("score")))
    best = scored.groupBy("group", "expected").agg(F.max(F.struct("score", "name")).alias("b")).where(F.col("b.score") >= least)
    return best.select("group", "expected", "b.name", "b.score")
