"""Similarity and distance of vectors (arrays of numbers) and sets (arrays of anything), as expressions that stay in the JVM.

Null arguments and vectors of different sizes give null; a zero norm or an empty set gives null instead of a division by zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)


def _same(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value)


def dot(a: Column, b: Column) -> Column:
    return _same(a, b, _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def squared_l2(a: Column, b: Column) -> Column:
    return _same(a, b, _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def centred(a: Column) -> Column:
    mean = F.try_divide(_sum(F.transform(a, lambda x: x.cast("double"))), F.size(a))
    return F.transform(a, lambda x: x.cast("double") - mean)


def pearson(a: Column, b: Column) -> Column:
    """Cosine of the mean-centred vectors."""
    return cosine(centred(a), centred(b))


def _shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def _distinct(a: Column) -> Column:
    return F.size(F.array_distinct(a))


def cosine_set(a: Column, b: Column) -> Column:
    return F.try_divide(_shared(a, b).cast("double"), F.sqrt((_distinct(a) * _distinct(b)).cast("double")))


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(_shared(a, b).cast("double"), F.size(F.array_union(a, b)))


def overlap_coefficient(a: Column, b: Column) -> Column:
    return F.try_divide(_shared(a, b).cast("double"), F.least(_distinct(a), _distinct(b)))
