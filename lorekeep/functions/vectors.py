"""Column functions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalise(v: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    return F.transform(F.array(F.struct(v.cast("array<double>").alias("v"), norm(v).alias("n"))), lambda p: F.transform(p["v"], lambda x: x / F.when(p["n"] == 0, 1.0).otherwise(p["n"])))[0]


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def literal(values) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))
