"""Dense vectors (array columns) in plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyweft.functions.text import bound

#: Distances are rounded before they are compared, so that equal vectors tie.
DIGITS = 12


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    """a at length 1; a zero vector stays zero."""
    return bound(norm(a), lambda n: F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a))


def is_zero(a: Column) -> Column:
    return ~F.exists(a, lambda x: x != 0)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, held in [0, 2]; 1 if either is zero."""
    length = norm(a) * norm(b)
    similar = F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - similar)), DIGITS)


def similarity_to_distance(i: Column, j: Column, similarity: Column) -> Column:
    """1 / (1 + s), with the diagonal's s taken as 0."""
    return 1 / (1 + F.when(i == j, 0.0).otherwise(similarity))
