"""Column expressions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    v = _doubles(a)
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def is_sound(a: Column | str, size: int) -> Column:
    """Whether a vector has ``size`` finite numbers that are not all zero."""
    v = _doubles(a)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) == size) & ~odd & F.exists(v, lambda x: x != 0), F.lit(False))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors; null where one is null, all zero, or of another length."""
    return F.when(F.size(_doubles(a)) == F.size(_doubles(b)), F.try_divide(dot(a, b), norm(a) * norm(b)))


def has_direction(a: Column | str, size: int) -> Column:
    """Whether a vector has ``size`` finite numbers that are not all zero, told by its square sum: it is null, undefined, infinite or 0 otherwise."""
    squares = dot(a, a)
    return (F.size(F.col(a) if isinstance(a, str) else a) == size) & (squares > 0) & (squares < float("inf"))


def cosine_with(a: Column | str, vector: list[float]) -> Column:
    """Cosine of a vector that has_direction with a fixed one."""
    length = sum(float(x) * float(x) for x in vector) ** 0.5
    return F.try_divide(dot(a, F.array(*[F.lit(float(x)) for x in vector])), norm(a) * length)


def half_similarity(cos: Column) -> Column:
    """The scale of search results: cosine distance d in [0, 2] becomes 1 - d / 2."""
    return (F.lit(1.0) + cos) / 2
