"""Column expressions over text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English words that a text query does not weigh.
STOP_WORDS = "a an and are as at be by for from has have in is it its of on or that the then this to was were which with".split()
#: Abbreviations of method names and what they stand for.
ABBREVIATIONS = {
    "iv": "instrumental variables",
    "ivs": "instrumental variables",
    "2sls": "two-stage least squares",
    "tsls": "two-stage least squares",
    "did": "difference-in-differences",
    "dd": "difference-in-differences",
    "diff-in-diff": "difference-in-differences",
    "rdd": "regression discontinuity design",
    "rd": "regression discontinuity",
    "psm": "propensity score matching",
    "ate": "average treatment effect",
    "att": "average treatment effect on the treated",
    "atc": "average treatment effect on the controls",
    "atu": "average treatment effect on the untreated",
    "late": "local average treatment effect",
    "cate": "conditional average treatment effect",
    "itt": "intention to treat",
    "toa": "treatment on the treated",
    "ols": "ordinary least squares",
    "gls": "generalized least squares",
    "gmm": "generalized method of moments",
    "ml": "machine learning",
    "dml": "double machine learning",
    "lasso": "least absolute shrinkage and selection operator",
    "rf": "random forest",
    "gbm": "gradient boosting machine",
    "xgboost": "extreme gradient boosting",
    "dag": "directed acyclic graph",
    "scm": "structural causal model",
    "sem": "structural equation model",
    "rct": "randomized controlled trial",
    "fe": "fixed effects",
    "re": "random effects",
    "cia": "conditional independence assumption",
    "sutva": "stable unit treatment value assumption",
    "nuc": "no unmeasured confounding",
}
#: Replacements of BibTeX's special characters, in order.
BIBTEX_ESCAPES = [("\\", r"\\"), ("&", r"\&"), ("%", r"\%"), ("#", r"\#"), ("_", r"\_"), ("{", r"\{"), ("}", r"\}"), ("~", r"\textasciitilde{}"), ("^", r"\textasciicircum{}")]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """Lower-cased runs of ASCII letters and digits, stop words left out; empty for null."""
    words = F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(STOP_WORDS))


def words_of(text: str) -> list[str]:
    """The tokens of one text, outside a table."""
    return [w for w in re.findall("[a-z0-9]+", text.lower()) if w not in STOP_WORDS]


def canonical_name(name: Column | str, abbreviations: dict[str, str] | None = None) -> Column:
    """The name by which concepts are one: case, spaces, abbreviations, parentheses, punctuation, hyphens and leading articles put in order.

    ``abbreviations`` are those of a domain (a map from the short to the long form), by default ABBREVIATIONS. Letters of any script stay.
    """
    plain = F.trim(F.lower(_col(name)))
    known = F.create_map(*[F.lit(x) for pair in (ABBREVIATIONS if abbreviations is None else abbreviations).items() for x in pair]) if abbreviations != {} else None
    plain = plain if known is None else F.coalesce(F.element_at(known, plain), plain)
    plain = F.trim(F.regexp_replace(plain, r"\s*\([^)]*\)\s*", " "))
    plain = F.regexp_replace(plain, r"[^\p{L}\p{N}_\s\-]", "")
    plain = F.regexp_replace(plain, "-", " ")
    plain = F.regexp_replace(F.trim(plain), r"^(the|a|an)\s+", "")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def trigrams(text: Column | str) -> Column:
    """Distinct letter triples of the words, each padded by two blanks before and one after."""
    words = F.filter(F.split(F.regexp_replace(F.lower(_col(text)), r"[^a-z0-9]+", " "), " "), lambda w: w != "")
    triples = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))))
    return F.array_distinct(triples)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where either is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def match_normal(text: Column | str) -> Column:
    """Form for comparing queries with synonyms: underscores become blanks, the rest keeps a-z, 0-9 and single blanks."""
    plain = F.regexp_replace(F.lower(_col(text)), "_", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9\s]", ""), r"\s+", " "))


def clean(text: Column | str) -> Column:
    """White space collapsed, quotes at the ends taken off."""
    return F.regexp_replace(F.trim(F.regexp_replace(_col(text), r"\s+", " ")), "^[\"']+|[\"']+$", "")


def bibtex_escaped(text: Column | str) -> Column:
    """Special characters of BibTeX escaped, one after the other."""
    out = _col(text)
    for plain, escaped in BIBTEX_ESCAPES:
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out


def file_name(text: Column | str, most: int = 50) -> Column:
    """A text as part of a file name."""
    plain = F.regexp_replace(F.lower(_col(text)), r"[^a-z0-9\s\-]", "")
    return F.substring(F.regexp_replace(F.trim(plain), r"[\s\-]+", "_"), 1, most)


def bibtex_key(first_author: Column | str, year: Column | str, title: Column | str) -> Column:
    """Surname, year (0000 if unknown) and the title's first word that is no stop word."""
    name = F.regexp_replace(F.lower(F.when(F.instr(_col(first_author), ",") > 0, F.substring_index(_col(first_author), ",", 1)).otherwise(F.element_at(F.split(F.trim(_col(first_author)), r"\s+"), -1))), "[^a-z]", "")
    word = F.coalesce(F.get(tokens(title), F.lit(0)), F.lit("untitled"))
    return F.concat(F.coalesce(name, F.lit("unknown")), F.coalesce(_col(year).cast("string"), F.lit("0000")), word)


def shortened(text: Column | str, most: int = 300) -> Column:
    """At most ``most`` characters; a longer text ends in three dots."""
    return F.when(F.length(_col(text)) > most, F.concat(F.substring(_col(text), 1, most - 3), F.lit("..."))).otherwise(_col(text))
