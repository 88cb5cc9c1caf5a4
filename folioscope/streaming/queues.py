"""Streams: status events of a queue, rollups of a log, idempotent ingest, and dead letters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscope.operators.tables import latest, replace_rows


def daily_rollup(events: DataFrame, late: str = "1 day", size: str = "1 day") -> DataFrame:
    """day, method, events and total of a stream (method, created_at, duration); rows later than ``late`` are left out."""
    rows = events.withWatermark("created_at", late).groupBy(F.window("created_at", size).alias("w"), "method")
    return rows.agg(F.count("*").alias("events"), F.sum("duration").alias("total")).select(F.col("w.start").alias("day"), "method", "events", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, end and events of sessions that a gap ends."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events"))
    return rows.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def first_seen(events: DataFrame, key: str, time: str, late: str = "7 days") -> DataFrame:
    """A stream without the repeats of a key that arrive within ``late``, for idempotent ingest."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def settled(stream: DataFrame, folder: str) -> DataFrame:
    """The result over all rows that a stream's source has now, as a table in ``folder``; a later call goes on from there with what is new."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result")

    query = stream.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/result")


def latest_status(spark: SparkSession, changes: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keeps in ``folder`` a table of the latest status (id, status, at) of each item, one version for each batch; a replayed batch writes its version anew."""

    def upsert(batch: DataFrame, number: int) -> None:
        rows = latest(batch, ["id"], [F.desc("at"), F.desc("status")])
        if number > 0:
            old = spark.read.parquet(f"{folder}/{number - 1}")
            rows = latest(replace_rows(old, rows.limit(0), ["id"]).unionByName(rows), ["id"], [F.desc("at"), F.desc("status")])
        rows.write.mode("overwrite").parquet(f"{folder}/{number}")

    return changes.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_dead_letters(rows: DataFrame, sound: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame, int], None], dead: str, checkpoint: str) -> StreamingQuery:
    """Writes the sound rows of each batch by ``write`` and appends the rest to the folder ``dead``; ``sound`` adds the column ``ok``."""

    def each(batch: DataFrame, number: int) -> None:
        marked = sound(batch)
        write(marked.where("ok").drop("ok"), number)
        marked.where("NOT ok OR ok IS NULL").drop("ok").write.mode("overwrite").json(f"{dead}/batch={number}")

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
