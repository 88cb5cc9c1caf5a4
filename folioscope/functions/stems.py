"""Stems of English words by the rules of Porter's algorithm (1980), each rule a replacement that Spark and SQL engines both know."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
#: Beginnings with a measure above 0, above 1, of 1, and with a vowel.
_M0 = f"(?:{_C})?{_V}{_C}.*"
_M1 = f"(?:{_C})?{_V}{_C}{_V}{_C}.*"
_VOWEL = f"(?:{_C})?[aeiouy].*"
#: Suffixes of the algorithm's second and third step and what takes their place.
_SECOND = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
_THIRD = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
#: Suffixes that the fourth step takes off; the longest that fits counts.
_FOURTH = "ement|ment|ance|ence|able|ible|ant|ent|ism|ate|iti|ous|ive|ize|al|er|ic|ou"


def _rules() -> list[tuple[str, str]]:
    """Pattern and replacement (with the begin as group 1), in order; \\x01 marks where an ending went."""
    plural = [("^(.*ss|.*i)es$", "\\1"), ("^(.*[^s])s$", "\\1")]
    past = [(f"^({_M0[:-2]}.*)eed$", "\\1ee"), (f"^({_VOWEL}[^e])ed$", "\\1\x01"), (f"^({_VOWEL})ing$", "\\1\x01"), ("^(.*(?:at|bl|iz))\x01$", "\\1e")]
    past += [(f"^(.*{c}){c}\x01$", "\\1") for c in "bcdfghjkmnpqrtvwx"] + [(f"^({_C}[aeiouy][^aeiouwxy])\x01$", "\\1e"), ("\x01$", ""), (f"^({_VOWEL})y$", "\\1i")]
    middle = [(f"^({_M0}){a}$", f"\\1{b}") for step in (_SECOND, _THIRD) for a, b in (x.split(":") for x in step.split())]
    short = f"(?:{_C})?{_V}{_C}{_V}[^aeiou][^aeiouy]*?.*?"
    last = [(f"^({short})(?:{_FOURTH})$", "\\1"), (f"^({_M1[:-2]}.*[st])ion$", "\\1"), (f"^({_M1})e$", "\\1"), (f"^({_M1[:-2]}.*l)l$", "\\1")]
    return [*plural, *past, *middle, *last]


RULES = _rules()


def stem_of(word: str) -> str:
    """The stem of one word, outside a table."""
    if len(word) > 2 and re.fullmatch("[a-z]+", word):
        for pattern, new in RULES:
            word = re.sub(pattern, new, word)
    return word


def stem(word: Column) -> Column:
    """The stem of a lower-case word; words of up to two letters, and such with digits, stay."""
    plain = reduce(lambda w, r: F.regexp_replace(w, r[0], r[1].replace("\\1", "$1")), RULES, word)
    return F.when((F.length(word) > 2) & word.rlike("^[a-z]+$"), plain).otherwise(word)


def stem_sql(word: str) -> str:
    """The same as SQL of engines whose groups are written \\1."""
    plain = reduce(lambda w, r: f"regexp_replace({w}, '{r[0]}', '{r[1]}')", RULES, word)
    return f"CASE WHEN length({word}) > 2 AND regexp_full_match({word}, '[a-z]+') THEN {plain} ELSE {word} END"
