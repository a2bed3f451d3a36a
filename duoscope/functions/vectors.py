"""Vector arithmetic on ``array<double>`` columns with higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added to denominators so that zero vectors give large finite ratios (fixed value).
EPS = 1e-20


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def plus(u: Column, v: Column) -> Column:
    return F.zip_with(u, v, lambda a, b: a + b)


def minus(u: Column, v: Column) -> Column:
    return F.zip_with(u, v, lambda a, b: a - b)


def dot(u: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(u, v, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine_of(uv: Column, uu: Column, vv: Column) -> Column:
    """Cosine from three dot products, 0 where either vector vanishes."""
    scale = F.sqrt(uu) * F.sqrt(vv)
    return F.when(scale > EPS, uv / scale).otherwise(F.lit(0.0))


def cosine_distance(u: Column, v: Column) -> Column:
    c = dot(u, v) / (norm(u) * norm(v) + EPS)
    return 1 - F.greatest(F.least(c, F.lit(1.0)), F.lit(-1.0))


def l2_distance(u: Column, v: Column) -> Column:
    return norm(minus(u, v)) + EPS
