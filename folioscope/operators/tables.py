"""Writing to tables that can only be rewritten: inserts, upserts, merges, deletes and look-ups.

Every function returns the new content of the table; nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def insert_new(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` and the rows of ``delta`` whose keys are new; of several rows with one key any one enters. Null keys count as equal."""
    fresh = delta.dropDuplicates(keys).alias("d").join(base.select(*keys).distinct().alias("b"), _same(keys), "left_anti")
    return base.unionByName(fresh, allowMissingColumns=True)


def insert_counts(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """One row: ``added`` and ``skipped`` of an insert_new."""
    known = base.select(*keys).distinct().withColumn("known", F.lit(1))
    marked = delta.dropDuplicates(keys).join(known, keys, "left")
    return marked.agg(F.count_if(F.col("known").isNull()).alias("added")).crossJoin(delta.agg(F.count("*").alias("all"))).select("added", (F.col("all") - F.col("added")).alias("skipped"))


def replace_rows(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """``delta`` in place of the rows of ``base`` with its keys."""
    return base.alias("d").join(delta.select(*keys).distinct().alias("b"), _same(keys), "left_anti").unionByName(delta, allowMissingColumns=True)


def merge_rows(base: DataFrame, delta: DataFrame, keys: list[str], values: dict[str, Column] | None = None) -> DataFrame:
    """A full outer join on ``keys``: each other column takes delta's value where it has one, or the expression given over ``old`` and ``new`` columns (old_x, new_x)."""
    others = [c for c in base.columns if c not in keys]
    old = base.select(*keys, *[F.col(c).alias(f"old_{c}") for c in others])
    new = delta.select(*keys, *[(F.col(c) if c in delta.columns else F.lit(None)).alias(f"new_{c}") for c in others])
    given = values or {}
    return old.join(new, keys, "full_outer").select(*keys, *[given.get(c, F.coalesce(f"new_{c}", f"old_{c}")).alias(c) for c in others])


def delete_rows(base: DataFrame, gone: DataFrame, on: dict[str, str]) -> DataFrame:
    """``base`` without the rows that match a row of ``gone``; ``on`` maps base's columns to gone's. Apply it to children for a cascade."""
    names = {b: f"__{i}" for i, b in enumerate(on)}
    other = gone.select(*[F.col(g).alias(names[b]) for b, g in on.items()]).distinct()
    return base.join(other, [F.col(b) == F.col(names[b]) for b in on], "left_anti")


def repointed(base: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """``column`` with the ids of ``mapping`` (old, new) replaced."""
    return base.join(mapping.select(F.col("old").alias(column), "new"), column, "left").withColumn(column, F.coalesce("new", column)).drop("new").select(*base.columns)


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """``limit`` rows after ``offset`` in a total order; the order must end in a key."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def merged_json(old: Column, new: Column) -> Column:
    """Shallow union of two JSON objects of plain values; the right one wins, null counts as empty."""
    kind = "map<string,string>"
    left, right = (F.coalesce(F.from_json(c, kind), F.create_map().cast(kind)) for c in (old, new))
    keep = F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k))
    return F.to_json(F.map_concat(keep, right))


def _same(keys: list[str]) -> list[Column]:
    return [F.col(f"d.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]


def by_values(rows: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose ``column`` is one of a short list of values, which reaches the scan; none for an empty list."""
    return rows.where(F.col(column).isin(list(values)))


def by_metadata(rows: DataFrame, key: str, values: list[str], column: str = "metadata") -> DataFrame:
    """Rows whose JSON ``column`` has one of the values under ``key``."""
    return rows.where(F.get_json_object(column, f"$.{key}").isin(list(values)))


def count_by(rows: DataFrame, key: str, column: str = "id") -> DataFrame:
    """key and n, the distinct ``column`` values of each."""
    return rows.groupBy(key).agg(F.count_distinct(column).alias("n"))


def reconciled(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """status (both, only_left, only_right) and n of the keys of two tables that should agree."""
    one, two = left.select(key).distinct().withColumn("l", F.lit(True)), right.select(key).distinct().withColumn("r", F.lit(True))
    status = F.when(F.col("l").isNull(), "only_right").when(F.col("r").isNull(), "only_left").otherwise("both")
    return one.join(two, key, "full").groupBy(status.alias("status")).agg(F.count("*").alias("n"))
