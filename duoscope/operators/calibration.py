"""Null covariances: Gram sums over all rows, shrinkage, and distances under them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import fixed


def gram(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """``keys, i, j, n, s, q``: sums of x_i, and of x_i x_j, over the vectors of each key.

    Each task sums its rows as matrix products and sends one matrix per key; the sums meet by cell.
    """
    schema = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in keys) + ", i int, j int, n long, s double, q double"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for b in batches:
            for key, part in b.groupby(keys, dropna=False):
                x = np.stack(part[vector].to_numpy()).astype(np.float64)
                now = held.setdefault(key, [0, np.zeros(x.shape[1]), np.zeros((x.shape[1], x.shape[1]))])
                now[0] += len(x)
                now[1] += x.sum(axis=0)
                now[2] += x.T @ x
        for key, (n, s, q) in held.items():
            d = len(s)
            i, j = np.divmod(np.arange(d * d), d)
            yield pd.DataFrame({**dict(zip(keys, key, strict=True)), "i": i, "j": j, "n": n, "s": s[i], "q": q.ravel()})[[*keys, "i", "j", "n", "s", "q"]]

    cells = df.where(F.col(vector).isNotNull()).select(*keys, vector).mapInPandas(partial, schema)
    return cells.groupBy(*keys, "i", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))


def covariance(sums: DataFrame, keys: list[str], ridge: float = 0.0, divisor: int = 1) -> DataFrame:
    """``keys, i, j, n, value``: covariance cells (divided by n - divisor), ridge on the diagonal."""
    other = sums.select(*keys, F.col("j").alias("_j"), F.col("i").alias("_i"), F.col("s").alias("_s")).where("_i = _j").drop("_i")
    both = sums.join(other.withColumnRenamed("_j", "j"), [*keys, "j"])
    cell = F.try_divide(F.col("q") - F.col("s") * F.col("_s") / F.col("n"), F.col("n") - divisor)
    return both.select(*keys, "i", "j", "n", (cell + F.when(F.col("i") == F.col("j"), ridge).otherwise(0.0)).alias("value"))


def shrinkage(df: DataFrame, sums: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """``keys, n, dim, mu, alpha``: Ledoit-Wolf intensity towards mu times the identity."""
    cells = covariance(sums, keys, divisor=0)
    whole = cells.groupBy(*keys).agg(F.max("n").alias("n"), (F.max("i") + 1).alias("dim"), F.sum(F.when(F.col("i") == F.col("j"), F.col("value"))).alias("trace"), F.sum(F.col("value") ** 2).alias("frob"))
    mean = sums.where("i = j").groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", (F.col("s") / F.col("n")).alias("m")))), lambda x: x["m"]).alias("_mean"))
    centred = F.zip_with(F.col(vector).cast("array<double>"), F.col("_mean"), lambda a, b: (a - b) * (a - b))
    fourth = df.join(F.broadcast(mean), keys).groupBy(*keys).agg(F.sum(F.pow(F.aggregate(centred, F.lit(0.0), lambda s, x: s + x), 2)).alias("fourth"))
    s = whole.join(fourth, keys)
    mu = F.col("trace") / F.col("dim")
    delta = (F.col("frob") - F.col("dim") * mu * mu) / F.col("dim")
    beta = F.least((F.col("fourth") / F.col("n") - F.col("frob")) / (F.col("dim") * F.col("n")), delta)
    return s.select(*keys, "n", "dim", mu.alias("mu"), F.when(beta == 0, 0.0).otherwise(F.coalesce(F.try_divide(beta, delta), F.lit(0.0))).alias("alpha"))


def shrunk(cells: DataFrame, intensity: DataFrame, keys: list[str], ridge: float = 0.0) -> DataFrame:
    """Covariance cells moved towards the scaled identity; ``cells`` are divided by n."""
    s = cells.join(F.broadcast(intensity.select(*keys, "mu", "alpha")), keys)
    value = (1 - F.col("alpha")) * F.col("value") + F.when(F.col("i") == F.col("j"), F.col("alpha") * F.col("mu") + ridge).otherwise(0.0)
    return s.select(*keys, "i", "j", "n", value.alias("value"))


def binned_fits(nulls: DataFrame, vector: str, bin_col: str, least: int, ridge: float, whole: int = -1) -> DataFrame:
    """``use, i, j, n, value``: shrunk covariances of the bins with at least ``least`` vectors, and of all as bin ``whole``.

    The sums of all vectors are those of the bins, so vectors are multiplied once.
    """
    by_bin = fixed(gram(nulls, [bin_col], vector))
    every = by_bin.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")]).withColumn("use", F.lit(whole))
    own = by_bin.where(F.col("n") >= least).withColumnRenamed(bin_col, "use")
    sums = fixed(own.select("use", "i", "j", "n", "s", "q").unionByName(every))
    named = nulls.select(vector, F.explode(F.array(F.col(bin_col), F.lit(whole))).alias("use"))
    return fixed(shrunk(covariance(sums, ["use"], divisor=0), shrinkage(named, sums, ["use"], vector), ["use"], ridge))


def square(part: pd.DataFrame) -> np.ndarray:
    """The matrix of one key's cells ``i, j, value``."""
    d = int(part["i"].max()) + 1
    m = np.zeros((d, d))
    m[part["i"], part["j"]] = part["value"]
    return m


def stability(df: DataFrame, vector: str, id_col: str, fractions: list[float], repeats: int, tests: int = 100, ridge: float = 1e-6) -> DataFrame:
    """``fraction, n, mean, std, cv`` of mean distances under shrunk covariances fitted to parts of the rows, ``repeats`` times each.

    A row is in a part by a hash of its id and the repeat, so parts of larger fractions hold those of smaller ones.
    Distances are those of the ``tests`` vectors with the smallest ids, the only ones that pass through the driver;
    each fit is inverted in a task of its own.
    """
    held = np.array([r[0] for r in df.where(F.col(vector).isNotNull()).orderBy(id_col).limit(tests).select(vector).collect()], dtype=float)
    share = F.pmod(F.xxhash64(F.col(id_col), F.col("repeat")), F.lit(1_000_000)) / 1e6
    many = df.select(id_col, vector, F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"))
    many = many.withColumn("fraction", F.explode(F.array(*map(F.lit, fractions)))).where(share < F.col("fraction"))
    keys = ["fraction", "repeat"]
    sums = gram(many, keys, vector)
    cells = shrunk(covariance(sums, keys, divisor=0), shrinkage(many, sums, keys, vector), keys, ridge)

    def distances(part: pd.DataFrame) -> pd.DataFrame:
        d = np.sqrt(np.maximum(0.0, ((held @ np.linalg.inv(square(part))) * held).sum(axis=1)))
        return pd.DataFrame({"fraction": part["fraction"].iloc[:1], "n": part["n"].iloc[:1], "mean": d.mean()})

    runs = cells.groupBy(*keys).applyInPandas(distances, "fraction double, n long, mean double")
    whole = runs.groupBy("fraction").agg(F.avg("n").alias("n"), F.avg("mean").alias("mean"), F.stddev_pop("mean").alias("std"))
    return whole.withColumn("cv", F.col("std") / (F.col("mean") + 1e-30))


def ridge_sensitivity(cells: DataFrame, keys: list[str], ridges: list[float], usual: float = 1e-6) -> DataFrame:
    """``keys, ridge, change``: relative change, against ``usual``, of the distance of a unit vector along the leading axis.

    Along that axis the distance is 1 / sqrt(largest eigenvalue + ridge).
    """
    types = dict(cells.dtypes)

    def changes(part: pd.DataFrame) -> pd.DataFrame:
        top = max(float(np.linalg.eigvalsh(square(part))[-1]), 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            out = pd.DataFrame({"ridge": ridges, "change": np.sqrt((top + usual) / (top + np.array(ridges))) - 1})
        for name in keys:
            out[name] = part[name].iloc[0]
        return out[[*keys, "ridge", "change"]]

    return cells.select(*keys, "i", "j", "value").groupBy(*keys).applyInPandas(changes, "".join(f"{c} {types[c]}, " for c in keys) + "ridge double, change double")
