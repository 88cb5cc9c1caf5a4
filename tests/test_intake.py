"""Rules of tables and intake of texts on small fixtures."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from folioscope.operators import ingest
from folioscope.sources import schema


def test_rules(spark: SparkSession) -> None:
    rows = spark.createDataFrame([("1", "s", None, "text", None, None, None, None, None, None, None), ("2", None, None, " ", None, None, 3, 2, [1.0], None, None)], schema.struct("chunks"))
    good, bad = schema.split_rows(rows, schema.rules("chunks"))
    assert [r.id for r in good.collect()] == ["1"]
    assert bad.first().broken == ["content", "source_id", "embedding", "pages"]
    assert {r.condition: r.n for r in schema.broken_counts(rows, schema.rules("chunks")).collect()} == {"content": 1, "source_id": 1, "embedding": 1, "pages": 1}
    assert schema.validated(rows, {}).first().broken == []


def test_files_enter_once(spark: SparkSession) -> None:
    files = ingest.hashed(spark.createDataFrame([("b", b"x"), ("a", b"x"), ("c", b"y")], "path string, content binary"))
    known = files.where("path = 'c'").select("file_hash")
    assert [r.path for r in ingest.unknown(files, known).collect()] == ["a"]
    fresh = files.select("path", "file_hash")
    assert ingest.with_sources(fresh.where("path = 'a'"), fresh).count() == 2


def test_chunks_enter_once(spark: SparkSession) -> None:
    docs = spark.createDataFrame([(1, "one two\x00 three"), (1, "one two three"), (2, "one two three"), (3, None), (4, " \x00 ")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "source_id bigint, content_hash string")
    rows = ingest.new_chunks(docs, none)
    assert sorted((r.source_id, r.content) for r in rows.collect()) == [(1, "one two three"), (2, "one two three")]
    assert ingest.new_chunks(docs, rows).count() == 0


def test_missing_embeddings(spark: SparkSession) -> None:
    rows = spark.createDataFrame([("1", "a", None), ("2", "b", [1.0]), ("3", " ", None)], "id string, content string, embedding array<float>")
    assert [r.id for r in ingest.without_embedding(rows).collect()] == ["1"]
    got = ingest.with_embeddings(rows, rows.select("id", F.array(F.lit(9.0).cast("float")).alias("embedding"))).orderBy("id").collect()
    assert [r.embedding for r in got] == [[9.0], [1.0], [9.0]]
