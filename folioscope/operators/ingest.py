"""Taking texts into a corpus once: hashes, clean content, chunks without repeats, failures aside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.passages import chunked
from folioscope.operators.tables import insert_new, latest


def hashed(files: DataFrame) -> DataFrame:
    """Files (path, content binary) with their SHA-256."""
    return files.withColumn("file_hash", F.sha2("content", 256))


def unknown(files: DataFrame, sources: DataFrame) -> DataFrame:
    """Files whose hash no source has, one for each hash, the least path of several."""
    return latest(files, ["file_hash"], [F.col("path")]).join(sources.select("file_hash"), "file_hash", "left_anti")


def cleaned(rows: DataFrame) -> DataFrame:
    """Content without zero bytes and replacement characters, and its hash; contents that end up blank are left out."""
    text = F.translate("content", "\x00�", "")
    return rows.withColumn("content", text).where(F.trim("content") != "").withColumn("content_hash", F.sha2("content", 256))


def new_chunks(documents: DataFrame, known: DataFrame, target: int = 300, variance: int = 50, overlap: int = 50) -> DataFrame:
    """source_id, chunk_index, content, content_hash and token_count of chunks of documents (doc_id, text) that ``known`` (source_id, content_hash) lacks; a content counts once for each source."""
    rows = chunked(documents, target, variance, overlap).select(F.col("doc_id").alias("source_id"), "chunk_index", "content", "token_count")
    rows = latest(cleaned(rows), ["source_id", "content_hash"], [F.col("chunk_index")])
    return rows.join(known.select(F.col("source_id").alias("__s"), F.col("content_hash").alias("__h")), (F.col("source_id") == F.col("__s")) & (F.col("content_hash") == F.col("__h")), "left_anti")


def with_embeddings(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Chunks whose missing embedding comes from a table (id, embedding), such as a model's output."""
    given = embeddings.select("id", F.col("embedding").alias("__e"))
    return chunks.join(given, "id", "left").withColumn("embedding", F.coalesce("embedding", "__e")).drop("__e").select(*chunks.columns)


def without_embedding(chunks: DataFrame) -> DataFrame:
    """id and content of chunks that a model has still to embed."""
    return chunks.where(F.col("embedding").isNull() & (F.trim("content") != "")).select("id", "content")


def with_sources(sources: DataFrame, fresh: DataFrame) -> DataFrame:
    """Sources with the fresh ones whose file hash is new."""
    return insert_new(sources, fresh, ["file_hash"])
