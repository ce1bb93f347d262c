"""Dense-vector Column expressions (arrays of numbers, summed left to right in double)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import col


def as_doubles(v: str | Column) -> Column:
    return col(v).cast("array<double>")


def dot(a: str | Column, b: str | Column) -> Column:
    prods = F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y)
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column) -> Column:
    """dot / (|a| |b|); 0 when either vector has zero length."""
    den = norm(a) * norm(b)
    return F.when(den > 0, dot(a, b) / den).otherwise(F.lit(0.0))


def normalize(a: str | Column) -> Column:
    """Unit vector; the zero vector stays zero."""
    n = norm(a)
    return F.transform(as_doubles(a), lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))
