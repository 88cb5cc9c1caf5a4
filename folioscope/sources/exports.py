"""Readers and writers beside Parquet: dead letters, CSV, metrics text, BibTeX, results as text, scholarly XML."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import bibtex_escaped, bibtex_key
from folioscope.operators.citations import bibtex_authors

DEAD_LETTER = "id string, file_path string, error_type string, error_message string, traceback string, timestamp timestamp, retry_count int, metadata string"


def append_dead_letters(rows: DataFrame, folder: str) -> None:
    """Failures as JSON lines, appended."""
    rows.write.mode("append").json(folder)


def dead_letters(spark: SparkSession, folder: str, error_type: str | None = None, without: list[str] | None = None) -> DataFrame:
    """Failures of a folder, of one type if given, without some ids."""
    rows = spark.read.schema(DEAD_LETTER).json(folder)
    if error_type is not None:
        rows = rows.where(F.col("error_type") == error_type)
    return rows if not without else rows.where(~F.col("id").isin(without))


def write_csv(rows: DataFrame, folder: str) -> None:
    """Rows as CSV with a header."""
    rows.write.mode("overwrite").option("header", True).csv(folder)


def metrics_text(rows: DataFrame) -> DataFrame:
    """One row: metrics (name, help, kind, value) as exposition text."""
    entry = F.concat(F.lit("# HELP "), F.col("name"), F.lit(" "), F.col("help"), F.lit("\n# TYPE "), F.col("name"), F.lit(" "), F.col("kind"), F.lit("\n"), F.col("name"), F.lit(" "), F.col("value").cast("string"))
    return rows.agg(F.array_join(F.sort_array(F.collect_list(entry)), "\n").alias("text"))


def bibtex_entry(kind: Column, authors: Column, title: Column, year: Column, more: dict[str, Column]) -> Column:
    """A BibTeX entry; fields without a value are left out."""
    key = bibtex_key(F.get(authors, F.lit(0)), year, title)
    fields = {"author": bibtex_escaped(bibtex_authors(authors)), "title": bibtex_escaped(title), "year": year.cast("string")} | more
    lines = [F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"  {n} = {{"), v, F.lit("}"))) for n, v in fields.items()]
    return F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",\n"), F.concat_ws(",\n", *lines), F.lit("\n}"))


def citations_as_bibtex(citations: DataFrame) -> DataFrame:
    """id and bibtex: an article where the venue is known, else misc."""
    kind = F.when(F.col("venue").isNotNull(), "article").otherwise("misc")
    more = {"journal": bibtex_escaped("venue"), "doi": F.col("doi"), "eprint": F.col("arxiv_id")}
    return citations.select("id", bibtex_entry(kind, F.col("authors"), F.coalesce("title", F.lit("")), F.col("year"), more).alias("bibtex"))


def sources_as_bibtex(sources: DataFrame) -> DataFrame:
    """id and bibtex: textbooks are books, papers articles, others misc; publisher and identifiers from metadata."""
    kind = F.when(F.col("source_type") == "textbook", "book").when(F.col("source_type") == "paper", "article").otherwise("misc")
    more = {k: F.get_json_object("metadata", f"$.{k}") for k in ("publisher", "doi", "arxiv_id")}
    return sources.select("id", bibtex_entry(kind, F.col("authors"), F.coalesce("title", F.lit("")), F.col("year"), more).alias("bibtex"))


def results_as_markdown(results: DataFrame) -> DataFrame:
    """rank and line of search results (rank, title, location, combined_score, content)."""
    line = F.format_string("%d. **%s** (%s), score %.3f\n   %s", "rank", F.coalesce("title", F.lit("untitled")), F.coalesce("location", F.lit("no place")), "combined_score", F.substring(F.regexp_replace("content", r"\s+", " "), 1, 200))
    return results.select("rank", line.alias("line"))


def results_as_json(results: DataFrame) -> DataFrame:
    """rank and json of search results, with all their columns."""
    return results.select("rank", F.to_json(F.struct(*results.columns)).alias("json"))


def parse_tei(documents: DataFrame) -> DataFrame:
    """doc_id, kind (title, section, citation, context), n, text and details of scholarly XML (doc_id, tei); a document that is no XML gives one row of kind error.

    A context is a paragraph that refers to a citation: n is that of the citation, details its xml:id; repeats count once.
    """

    def name(e: ET.Element) -> str:
        return e.tag.rpartition("}")[2]

    def text(e: ET.Element | None) -> str:
        return " ".join("".join(e.itertext()).split()) if e is not None else ""

    def found(e: ET.Element, tag: str) -> list[ET.Element]:
        return [x for x in e.iter() if name(x) == tag]

    def rows(key: int, tei: str) -> Iterator[tuple]:
        try:
            root = ET.fromstring(tei)
        except ET.ParseError as e:
            yield key, "error", 0, str(e), None
            return
        header = found(root, "titleStmt")
        yield key, "title", 0, text(next(iter(found(header[0], "title")), None)) if header else "", None
        for body in found(root, "body"):
            for n, div in enumerate(found(body, "div")):
                head = next((x for x in div if name(x) == "head"), None)
                yield key, "section", n, " ".join(text(p) for p in div if name(p) == "p"), text(head) or None
        listed = [x for b in found(root, "listBibl") for x in found(b, "biblStruct")]
        at = {v: n for n, x in enumerate(listed) for k, v in x.attrib.items() if k.rpartition("}")[2] == "id"}
        contexts = {(at[r.get("target")[1:]], text(p), r.get("target")[1:]): None for body in found(root, "body") for p in found(body, "p") for r in found(p, "ref") if r.get("target", "")[1:] in at}
        for n, words, target in contexts:
            yield key, "context", n, words, target
        for n, bibl in enumerate(listed):
            titles = found(bibl, "title")
            if titles and text(titles[0]):
                when = next((d.get("when") for d in found(bibl, "date") if d.get("when")), None)
                yield key, "citation", n, text(titles[0]), "; ".join([*(text(s) for s in found(bibl, "surname")), *([when[:4]] if when else [])])

    def of_batch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([r for k, t in zip(frame["doc_id"], frame["tei"], strict=True) if t for r in rows(k, t)], columns=["doc_id", "kind", "n", "text", "details"])

    return documents.select("doc_id", "tei").mapInPandas(of_batch, "doc_id bigint, kind string, n int, text string, details string")


def page_texts(documents: DataFrame) -> DataFrame:
    """doc_id, page, text and char_count of texts whose pages are parted by form feeds; zero bytes and blank lines go, lines are trimmed."""
    pages = documents.where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\f")).alias("page", "text"))
    lines = F.filter(F.transform(F.split(F.replace("text", F.lit("\x00"), F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return pages.select("doc_id", (F.col("page") + 1).alias("page"), F.array_join(lines, "\n").alias("text")).withColumn("char_count", F.length("text"))


def needs_recognition(pages: DataFrame, least: int = 100) -> DataFrame:
    """doc_id, mean_chars and needs_ocr: fewer than ``least`` characters a page."""
    mean = F.avg(F.length(F.trim("text")))
    return pages.groupBy("doc_id").agg(mean.alias("mean_chars"), F.coalesce(mean < least, F.lit(True)).alias("needs_ocr"))
