"""Cutting lineage with tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only a local session may lack it.

    A machine's own temporary folder is used in local mode alone, where driver
    and executors are one process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="folioscope-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame, name: str = "step", replaces: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    What follows neither recomputes ``df`` nor depends on the executor that
    computed it, and the planner knows the table's true size. ``replaces`` is a
    table of this kind that nothing needs any more, such as an earlier round of
    a loop: it is removed. The rest is removed when the driver's Python ends.
    ``by`` is a column whose values get folders of their own, which a filter prunes.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    if not _written:
        atexit.register(_remove_all)
    _written.append((spark, path))
    table = spark.read.schema(df.schema).parquet(path)
    table._folioscope_path = path
    if old := getattr(replaces, "_folioscope_path", None):
        _remove(spark, old)
    return table


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _written[:] = [x for x in _written if x[1] != path]


def _remove_all() -> None:
    for spark, path in list(_written):
        try:
            _remove(spark, path)
        except Exception:  # the session has ended; its folder's owner cleans up
            return
