"""Problem 8: one form for texts that look the same."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.lineage import materialize

#: Letters and marks that look like others, script by script, each with the character that it looks like.
LOOKALIKES = {
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγικνορυϒϱϲϳϹϺϷϸ", "ABEZHIKMNOPTYXayiĸvopuYpcjCMÞþ"),
    "Cyrillic": ("АВГЕЅІЈКМНОПРСТУФХЬѴӀҮԌԚԜаеѕіјкорсуфхѵһӏүԁԍԛԝ", "ABΓESIJKMHOΠPCTYΦXbVIYGQWaesijĸopcyφxvhlydgqw"),
    "Armenian": ("ՍՏՕհյոռսցօքզ։", "USOhjnnugofq:"),
    "Cherokee": ("ᎠᎡᎢᎥᎩᎪᎫᎬᎳᎷᎻᎽᏀᏃᏎᏚᏙᏒᏟᏢᏦᏧᏞᏴ", "DRTiyAJEWMHYGZ4SVRCPKdLB"),
    "Coptic": ("ⲂⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ", "BHIKMNOPCTYXopc"),
    "Lisu": ("ꓐꓑꓒꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPdDTGKJCZFMNLSRVHWXYAEIOU"),
    "Latin": ("ıɑɡɩȷᴄᴏᴠᴡᴢꜱᴋǃ", "iagijcovwzsĸ!"),
    "Marks": ("‐‑ʼ∶⁄∕‧∙⋅", "--’://···"),
}
_SPACE = re.compile(r"[^\S\n]")
_LINE = re.compile("\r\n?|[\u2028\u2029\x85]")
#: A joiner between pictographs makes them one, which shows.
_JOINED = re.compile("(?<=[\U0001F000-\U0001FAFF\u2600-\u27bf\ufe0f])\u200d(?=[\U0001F000-\U0001FAFF\u2600-\u27bf])")
_JOINER = "\ue000"


@lru_cache(1)
def _prototypes() -> dict[int, str | None]:
    """From code point to prototype: width, space and ligature forms by rule, look-alikes from the table, invisible characters to nothing."""
    table: dict[int, str | None] = {}
    for code in (*range(0x80, 0x30000), *range(0xE0000, 0xE0200)):
        char = chr(code)
        category = unicodedata.category(char)
        if category == "Cf" or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or code in (0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x17B4, 0x17B5):
            table[code] = None
        elif category == "Zs":
            table[code] = " "
        elif kind := re.match(r"<(\w+)>", unicodedata.decomposition(char)):
            if kind[1] in ("wide", "narrow", "noBreak", "font", "small") or kind[1] == "compat" and category in ("Ll", "Lu", "Lt", "Lo", "Nl", "Lm"):
                table[code] = unicodedata.normalize("NFKD", char)
    for odd, plain in LOOKALIKES.values():
        table.update((ord(a), b) for a, b in zip(odd, plain, strict=True))
    # A width form may lead to a look-alike letter.
    return {k: v if v is None else "".join(table.get(ord(c), c) or "" for c in v) for k, v in table.items()}


def skeleton(text: str) -> str:
    """The form that all texts of the same looks share.

    Decompose, replace each character by its prototype, decompose again. Width,
    kind of space, invisible characters, composition of accents and look-alike
    letters vanish; case, accents, digits, punctuation and the number of spaces
    stay. Superscripts, fractions and signs such as the numero sign look
    different from plain letters and are kept.
    """
    if text.isascii():
        return _SPACE.sub(" ", _LINE.sub("\n", text)) if "\r" in text or "\t" in text else text
    if "\u200d" in text:
        text = _JOINED.sub(_JOINER, text)
    plain = unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(_prototypes()))
    return _SPACE.sub(" ", _LINE.sub("\n", plain))


def _hash(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def _forms(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        forms = [None if t is None else skeleton(t) for t in texts]
        if keep:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forms, pa.string())], ["doc_id", "form"])
        else:
            seen = [f is not None and bool(f.strip()) for f in forms]
            own = [_hash(t) if s else None for s, t in zip(seen, texts, strict=True)]
            of = [h if s and f is t else _hash(f) if s else None for s, f, t, h in zip(seen, forms, texts, own, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(of, pa.binary()), pa.array(own, pa.binary())], ["doc_id", "looks", "exact"])


def consistent_form(documents: DataFrame) -> DataFrame:
    """doc_id and ``form``, the skeleton of each text.

    Null texts have a null form, empty and blank texts an empty or blank one.
    Other columns of the input are not carried.
    """
    return documents.select("doc_id", "text").mapInArrow(lambda it: _forms(it, True), "doc_id bigint, form string")


def _classes(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (doc_id, looks, exact), the classes of equal texts (looks, exact, least, n), and those of looks that have several."""
    rows = documents.select("doc_id", "text").mapInArrow(lambda it: _forms(it, False), "doc_id bigint, looks binary, exact binary").where("doc_id IS NOT NULL AND looks IS NOT NULL")
    rows = materialize(rows.distinct(), "looks")
    classes = materialize(rows.groupBy("looks", "exact").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    mixed = classes.groupBy("looks").agg(F.count("*").alias("spellings"), F.min("least").alias("group"), F.sum("n").alias("all")).where("spellings > 1")
    return rows, classes, mixed


def lookalike_pairs(documents: DataFrame) -> DataFrame:
    """Pairs doc_id_a < doc_id_b of texts that look the same but are not equal.

    Only 128-bit hashes of skeleton and text are shuffled. Texts become classes
    of equal texts, classes of one look are paired, and each pair of classes is
    expanded into its documents, so the work follows the pairs that come out:
    equal copies of a text never meet each other, however many there are. Null,
    empty and blank texts and null ids are left out.
    """
    rows, classes, mixed = _classes(documents)
    several = classes.join(mixed.select("looks"), "looks").select("looks", "exact")
    pairs = several.withColumnRenamed("exact", "a").join(several.withColumnRenamed("exact", "b"), "looks").where("a < b").select("a", "b")
    members = rows.join(mixed.select("looks"), "looks", "left_semi").select("exact", "doc_id")
    both = pairs.join(members.toDF("a", "x"), "a").join(members.toDF("b", "y"), "b")
    return both.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))


def lookalike_classes(documents: DataFrame) -> DataFrame:
    """doc_id, ``group`` (the least document of the same looks) and ``n_links`` (documents of the same looks and another spelling); rows as in lookalike_pairs.

    Documents that look like no other spelling are groups by the least of their
    copies, with no links. No pairs are formed.
    """
    rows, classes, mixed = _classes(documents)
    known = classes.join(mixed, "looks", "left").select("looks", "exact", F.coalesce("group", "least").alias("group"), F.coalesce(F.col("all") - F.col("n"), F.lit(0)).alias("n_links"))
    return rows.join(known, ["looks", "exact"]).select("doc_id", "group", "n_links")
