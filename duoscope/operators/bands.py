"""Joins on ranges of positions, by equality of position bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import fixed


def band_join(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, width: int, least: int = 1) -> DataFrame:
    """Rows of ``left`` and ``right`` equal in ``keys`` with ``least <= right.b - left.a <= width``.

    Positions are cut into bins of ``width``: a partner stands in the left row's bin or the next, so
    the left row is doubled and the rest is an equi-join with a residual filter.
    """
    here = F.floor(F.col(a) / width)
    cut = left.withColumn("_bin", F.explode(F.array(here, here + 1)))
    return cut.join(right.withColumn("_bin", F.floor(F.col(b) / width)), [*keys, "_bin"]).where((F.col(b) - F.col(a) >= least) & (F.col(b) - F.col(a) <= width)).drop("_bin")


def near_join(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, width: int) -> DataFrame:
    """As ``band_join`` on either side: ``0 < abs(b - a) <= width``."""
    here = F.floor(F.col(a) / width)
    cut = left.withColumn("_bin", F.explode(F.array(here - 1, here, here + 1)))
    return cut.join(right.withColumn("_bin", F.floor(F.col(b) / width)), [*keys, "_bin"]).where((F.col(a) != F.col(b)) & (F.abs(F.col(b) - F.col(a)) <= width)).drop("_bin")


def interval_join(points: DataFrame, blocks: DataFrame, keys: list[str], pos: str, begin: str, end: str, width: int) -> DataFrame:
    """Points within half-open intervals; blocks are spread over the bins they cover."""
    spread = blocks.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(begin) / width), F.floor((F.col(end) - 1) / width))))
    return points.withColumn("_bin", F.floor(F.col(pos) / width)).join(spread, [*keys, "_bin"]).where((F.col(pos) >= F.col(begin)) & (F.col(pos) < F.col(end))).drop("_bin")


def combinations(rows: DataFrame, keys: list[str], member: str, most: int | None = None, block: int = 2048, task: int = 1 << 22) -> DataFrame:
    """``keys, member1, member2, unambiguous``: every two members of a group, each pair once; members are distinct.

    Pairs are what is asked for, so their number grows with the squares of the groups; ``most``, if given, leaves out
    groups with more members. ``unambiguous`` marks groups of two. Null keys take no part. Members are written once, and
    only they move: a group's are cut into blocks of about ``block``, each of which meets itself and all later ones
    in a task of some ``task`` pairs, so neither a task's rows nor the disk grow with the pairs.
    """
    rows = fixed(rows.select(*keys, member).dropna(subset=keys))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    sizes = sizes.where(F.col("_n") <= most) if most is not None else sizes
    sizes = fixed(sizes.where("_n > 1"))
    pairs = sizes.agg(F.sum(F.col("_n") * F.col("_n")).alias("n")).first()["n"] or 0
    last = F.floor((F.col("_n") - 1) / block)
    held = rows.join(sizes, keys).withColumn("_own", F.pmod(F.xxhash64(member), last + 1)).withColumn("_last", last)
    met = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_last")), lambda x: F.struct(F.least(x, F.col("_own")).alias("_i"), F.greatest(x, F.col("_own")).alias("_j")))
    dealt = held.withColumn("_m", F.explode(met)).select(*keys, F.col("_m._i").alias("_i"), F.col("_m._j").alias("_j"), "_own", member, (F.col("_n") == 2).alias("unambiguous"))
    dealt = dealt.repartition(int(pairs // task) + 1, *keys, "_i", "_j")
    a = dealt.select(*keys, "_i", "_j", F.col("_own").alias("_a"), F.col(member).alias("_x"), "unambiguous").where("_a = _i")
    b = dealt.select(*keys, "_i", "_j", F.col("_own").alias("_b"), F.col(member).alias("_y")).where("_b = _j")
    both = a.join(b, [*keys, "_i", "_j"]).where("_x <> _y and (_i < _j or _x < _y)")
    return both.select(*keys, F.least("_x", "_y").alias(f"{member}1"), F.greatest("_x", "_y").alias(f"{member}2"), "unambiguous")
