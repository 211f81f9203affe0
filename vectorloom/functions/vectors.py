"""Column functions over ARRAY<DOUBLE> vectors; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def l2(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def scale(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def unit(v: Column) -> Column:
    """Row scaled to length one; a zero row stays as it is."""
    n = l2(v)
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x))


def vector_norm(v: Column, order: str = "2") -> Column:
    """Norm of order 1, 2, inf or -inf."""
    if order == "1":
        return F.aggregate(v, F.lit(0.0), lambda a, x: a + F.abs(x))
    if order == "2":
        return l2(v)
    if order == "inf":
        return F.array_max(F.transform(v, F.abs))
    if order == "-inf":
        return F.array_min(F.transform(v, F.abs))
    raise ValueError(f"unknown order {order}")


def normalize_rows(v: Column, order: str = "2") -> Column:
    n = vector_norm(v, order)
    return F.transform(v, lambda x: x / n)


def nudge_zero(v: Column, by: float = 1e-4) -> Column:
    """An all-zero vector gets a small first component so that it can be normalised."""
    zero = ~F.exists(v, lambda x: x != 0)
    return F.when(zero, F.transform(v, lambda x, i: F.when(i == 0, F.lit(by)).otherwise(x))).otherwise(v)
