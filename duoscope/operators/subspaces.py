"""Leading subspaces of covariances, their overlap, and how much of a vector lies inside one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import fixed
from .spectra import eigenpairs
from .statistics import mann_whitney


def components(cells: DataFrame, keys: list[str], k: int) -> DataFrame:
    """``keys, rank, share, axis``: the ``k`` leading unit vectors of each key's covariance cells ``i, j, value``.

    ``share`` is a vector's part of the whole variance. A key's cells, dimension squared of them, meet in one task.
    """
    types = dict(cells.dtypes)

    def leading(part: pd.DataFrame) -> pd.DataFrame:
        d = int(part["i"].max()) + 1
        m = np.zeros((d, d))
        m[part["i"], part["j"]] = part["value"]
        values, axes = np.linalg.eigh(m)
        top = np.argsort(-values, kind="stable")[:k]
        out = pd.DataFrame({"rank": np.arange(1, len(top) + 1), "share": values[top] / max(values.sum(), 1e-300), "axis": list(axes[:, top].T)})
        for name in keys:
            out[name] = part[name].iloc[0]
        return out[[*keys, "rank", "share", "axis"]]

    schema = "".join(f"{c} {types[c]}, " for c in keys) + "rank int, share double, axis array<double>"
    return cells.select(*keys, "i", "j", "value").groupBy(*keys).applyInPandas(leading, schema)


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """``overlap, projected``: mean over the axes of ``a`` of the largest absolute cosine with one of ``b``, and the
    share of the axes of ``a`` that lies inside the space of ``b``."""
    long = lambda t, n: t.select(F.col("rank").alias(f"{n}_rank"), F.posexplode("axis").alias("i", n))
    dots = long(a, "a").join(long(b, "b"), "i").groupBy("a_rank", "b_rank").agg(F.sum(F.col("a") * F.col("b")).alias("c"))
    axes = dots.groupBy("a_rank").agg(F.max(F.abs("c")).alias("best"), F.sum(F.col("c") * F.col("c")).alias("inside"))
    return axes.agg(F.avg("best").alias("overlap"), F.avg("inside").alias("projected"))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x.cast("array<double>"), y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def fraction_inside(df: DataFrame, axes: DataFrame, vector: str) -> DataFrame:
    """Adds ``inside_fraction, inside_norm, orthogonal_norm`` of ``vector`` under ``axes`` (k rows, sent to every task).

    Vectors are not centred; one shorter than 1e-15 has fraction 0, a null one nulls.
    """
    held = axes.agg(F.collect_list("axis").alias("_axes"))
    v = F.col(vector).cast("array<double>")
    df = df.join(F.broadcast(held)).withColumn("_norm", dot(v, v)).withColumn("_in", F.aggregate("_axes", F.lit(0.0), lambda s, e: s + F.pow(dot(v, e), 2)))
    out = df.withColumn("inside_fraction", F.when(F.col("_norm") < 1e-30, 0.0).otherwise(F.least(F.col("_in") / F.col("_norm"), F.lit(1.0))))
    out = out.withColumn("inside_norm", F.sqrt("_in")).withColumn("orthogonal_norm", F.sqrt(F.greatest(F.col("_norm") - F.col("_in"), F.lit(0.0))))
    return out.drop("_axes", "_norm", "_in")


def template_axes(df: DataFrame, vector: str, score: str, k: int, top: float = 0.9) -> DataFrame:
    """The ``k`` leading axes of the vectors whose absolute ``score`` reaches its ``top`` quantile."""
    bound = df.agg(F.percentile(F.abs(score), top).alias("_bound"))
    best = df.join(F.broadcast(bound)).where(F.abs(score) >= F.col("_bound")).select(vector, F.lit(0).alias("_key"))
    return eigenpairs(best, ["_key"], vector, k)


def template_contrast(df: DataFrame, axes: DataFrame, vector: str, score: str, top: float = 0.9, bottom: float = 0.5) -> DataFrame:
    """Are vectors of high absolute ``score`` more inside ``axes`` than those of low? One row:
    ``n1, n2, u, z, top_median, bottom_median`` of their fractions inside."""
    bound = df.agg(F.percentile(F.abs(score), top).alias("_high"), F.percentile(F.abs(score), bottom).alias("_low"))
    part = df.join(F.broadcast(bound)).withColumn("_top", F.when(F.abs(score) >= F.col("_high"), True).when(F.abs(score) <= F.col("_low"), False)).where("_top is not null")
    inside = fixed(fraction_inside(part.select(vector, "_top"), axes, vector).select("_top", "inside_fraction", F.lit(0).alias("_key")))
    medians = inside.groupBy("_key").agg(*[F.percentile(F.when(F.col("_top") == g, F.col("inside_fraction")), 0.5).alias(n) for g, n in ((True, "top_median"), (False, "bottom_median"))])
    return mann_whitney(inside, "inside_fraction", "_top", ["_key"]).join(medians, "_key").drop("_key")
