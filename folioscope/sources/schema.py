"""Tables of a corpus: their columns, their values, and the rows that break the rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Columns of each table.
TABLES = {
    "domains": "id string, name string, description string, concept_types array<string>, relationship_types array<string>",
    "sources": "id string, source_type string, title string, authors array<string>, year int, file_path string, file_hash string, metadata string, created_at timestamp_ntz, updated_at timestamp_ntz, citation_authority float, domain_id string",
    "chunks": "id string, source_id string, domain_id string, content string, content_hash string, location string, page_start int, page_end int, embedding array<float>, metadata string, created_at timestamp_ntz",
    "citations": "id string, source_id string, authors array<string>, title string, year int, venue string, doi string, arxiv_id string, raw_string string, bibtex string, extraction_method string, confidence_score float, metadata string, created_at timestamp_ntz, s2_paper_id string, context string",
    "concepts": "id string, name string, canonical_name string, aliases array<string>, concept_type string, category string, definition string, embedding array<float>, extraction_method string, confidence_score float, validated boolean, metadata string, created_at timestamp_ntz, domain_id string",
    "concept_relationships": "id string, src string, dst string, type string, is_directed boolean, strength float, evidence_chunk_ids array<string>, confidence_score float, created_at timestamp_ntz",
    "chunk_concepts": "chunk_id string, concept_id string, mention_type string, relevance_score float, created_at timestamp_ntz",
    "source_citations": "citing string, cited string, citation_id string, context string, created_at timestamp_ntz",
    "cross_domain_links": "src string, dst string, link_type string, confidence_score float, evidence string, metadata string, created_at timestamp_ntz",
    "discovery_log": "id string, discovery_method string, query string, domain_id string, papers_found int, papers_acquired int, papers_ingested int, papers_skipped int, papers_failed int, duration_seconds float, metadata string, created_at timestamp_ntz",
    "ingestion_queue": "id string, s2_paper_id string, doi string, arxiv_id string, pdf_url string, title string, authors array<string>, year int, venue string, domain_id string, status string, priority int, error_message string, retry_count int, metadata string, created_at timestamp_ntz, updated_at timestamp_ntz",
}
#: What enumerated columns may hold.
VALUES = {
    "source_type": ["textbook", "paper", "code_repo"],
    "mention_type": ["defines", "reference", "example"],
    "type": ["REQUIRES", "USES", "ADDRESSES", "GENERALIZES", "SPECIALIZES", "ALTERNATIVE_TO", "EXTENDS", "RELATED_TO"],
}


def struct(table: str) -> StructType:
    """The schema of a table."""
    return StructType.fromDDL(TABLES[table])


def rules(table: str, dimension: int = 64) -> dict[str, Column]:
    """Conditions by name that each row of a table must meet; a null condition counts as met where the value may be unknown."""
    share = lambda c: F.col(c).isNull() | F.col(c).between(0, 1)
    known = lambda c: F.col(c).isin(VALUES[c])
    filled = lambda c: F.col(c).isNotNull() & (F.trim(c) != "")
    sized = F.col("embedding").isNull() | (F.size("embedding") == dimension)
    return {
        "sources": {"file_hash": filled("file_hash"), "title": filled("title"), "source_type": known("source_type")},
        "chunks": {"content": filled("content"), "source_id": filled("source_id"), "embedding": sized, "pages": F.col("page_start").isNull() | F.col("page_end").isNull() | (F.col("page_end") >= F.col("page_start"))},
        "citations": {"source_id": filled("source_id"), "raw_string": filled("raw_string"), "confidence_score": share("confidence_score")},
        "concepts": {"canonical_name": filled("canonical_name"), "embedding": sized, "confidence_score": share("confidence_score")},
        "concept_relationships": {"ends": F.col("src").isNotNull() & F.col("dst").isNotNull(), "type": known("type"), "strength": share("strength")},
        "chunk_concepts": {"mention_type": known("mention_type"), "relevance_score": share("relevance_score")},
    }.get(table, {})


def validated(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Rows with ``broken``, the names of the conditions that they don't meet; an empty list for sound rows."""
    names = [F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in conditions.items()]
    found = F.filter(F.array(*names), lambda x: x.isNotNull()) if names else F.array().cast("array<string>")
    return rows.withColumn("broken", found)


def split_rows(rows: DataFrame, conditions: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Sound rows, and the others with the names of the broken conditions."""
    marked = validated(rows, conditions)
    return marked.where(F.size("broken") == 0).drop("broken"), marked.where(F.size("broken") > 0)


def broken_counts(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """condition and n, also for those that no row breaks."""
    counts = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in conditions.items()])
    parts = [counts.select(F.lit(name).alias("condition"), F.col(name).alias("n")) for name in conditions]
    return reduce(DataFrame.unionAll, parts)
