"""Ranks, bins, residuals and corrections.

Windows are partitioned by the strata given, or, where one stratum may hold most rows, by blocks of equal counts
within them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import fixed

#: Blocks of about equal counts that a stratum's values are cut into.
BLOCKS = 256


def cumulated(df: DataFrame, value: str, strata: list[str], sums: dict[str, Column]) -> DataFrame:
    """One row per stratum and value: each sum over the rows of lower values, ``{name}_before``, and of this value.

    Values are counted first, then cut into blocks at approximate quantiles; sums go over the few blocks, then
    within each, so neither a stratum nor a tied value is ever sorted in one task. ``strata`` and ``value`` are
    not null; rows with a null value are left out.
    """
    t = fixed(df.where(F.col(value).isNotNull()).groupBy(*strata, value).agg(*[F.sum(c).alias(n) for n, c in sums.items()]))
    cuts = t.groupBy(*strata).agg(F.array_sort(F.percentile_approx(value, F.array(*[F.lit(k / BLOCKS) for k in range(1, BLOCKS)]), 10_000)).alias("_cuts"))
    t = t.join(cuts, strata) if strata else t.join(F.broadcast(cuts))
    t = t.withColumn("_block", F.size(F.filter("_cuts", lambda e: e < F.col(value)))).drop("_cuts")
    over = Window.partitionBy(*strata).orderBy("_block")
    blocks = t.groupBy(*strata, "_block").agg(*[F.sum(n).alias(n) for n in sums])
    blocks = blocks.select(*strata, "_block", *[(F.sum(n).over(over) - F.col(n)).alias(f"_{n}") for n in sums])
    inside = Window.partitionBy(*strata, "_block").orderBy(value)
    t = t.withColumns({f"{n}_before": F.sum(n).over(inside) - F.col(n) for n in sums}).join(blocks, [*strata, "_block"])
    return t.select(*strata, value, *sums, *[(F.col(f"{n}_before") + F.col(f"_{n}")).alias(f"{n}_before") for n in sums])


def ordinal(df: DataFrame, value: str, key: str, strata: list[str], name: str = "rank") -> DataFrame:
    """Adds each row's place in its stratum, from 1, by ``value`` and then by ``key``, which tells equal values apart.

    Places of values come from counts; only keys of values that more than one row has are counted in turn. Rows
    with a null value are left out. Rows of equal value and key share the first of their places.
    """
    df = fixed(df)
    t = cumulated(df, value, strata, {"_n": F.lit(1)})
    tied = df.join(t.where("_n > 1").select(*strata, value), [*strata, value]).select(*strata, value, key)
    within = cumulated(tied, key, [*strata, value], {"_k": F.lit(1)}).select(*strata, value, key, "_k_before")
    rows = df.join(t.select(*strata, value, "_n_before"), [*strata, value]).join(within, [*strata, value, key], "left")
    return rows.withColumn(name, F.col("_n_before") + F.coalesce("_k_before", F.lit(0)) + 1).select(*df.columns, name)


def rank_bins(df: DataFrame, value: str, key: str, flag: str, strata: list[str], bins: int = 20) -> DataFrame:
    """``strata, bin, n, marked``: bins of equal counts by ``value`` and then ``key``, the remainder in the last, and the rows with ``flag``.

    A value that lies in one bin adds its counts to it; rows are looked at only where a value lies in several.
    ``key`` differs among rows of a value. Rows with a null value are left out.
    """
    df = fixed(df.where(F.col(value).isNotNull()).select(*strata, value, key, F.coalesce(F.col(flag).cast("boolean"), F.lit(False)).cast("long").alias("_f")))
    t = cumulated(df, value, strata, {"_n": F.lit(1), "_m": F.col("_f")})
    whole = df.groupBy(*strata).agg(F.greatest(F.floor(F.count("*") / bins), F.lit(1)).alias("_width"))
    t = t.join(whole, strata) if strata else t.join(F.broadcast(whole))
    at = lambda r: F.least(F.floor(r / F.col("_width")), F.lit(bins - 1))
    t = fixed(t.withColumn("bin", at(F.col("_n_before"))).withColumn("_last", at(F.col("_n_before") + F.col("_n") - 1)))
    inner = t.where("bin = _last").select(*strata, "bin", "_n", "_m")
    edge = t.where("bin < _last").select(*strata, value, F.col("_n_before").alias("_base"), "_width")
    rows = cumulated(df.join(edge.select(*strata, value), [*strata, value]), key, [*strata, value], {"_n": F.lit(1), "_m": F.col("_f")})
    rows = rows.join(edge, [*strata, value]).select(*strata, at(F.col("_base") + F.col("_n_before")).alias("bin"), "_n", "_m")
    return inner.unionByName(rows).groupBy(*strata, "bin").agg(F.sum("_n").alias("n"), F.sum("_m").alias("marked"))


def minmax(df: DataFrame, value: str, strata: list[str], name: str = "scaled") -> DataFrame:
    """Adds ``value`` scaled to 0..1 within its stratum, 0 where all its values are equal; rows need a stratum.

    Only a row per stratum is shuffled, not the rows.
    """
    ends = df.groupBy(*strata).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    df = df.join(ends, strata) if strata else df.join(F.broadcast(ends))
    return df.withColumn(name, F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)).drop("_lo", "_hi")


def half_open_bin(c: Column, edges: list[float]) -> Column:
    """Index of the bin ``[lo, hi)``; the last is open-ended, values below the first are null."""
    out = F.when(c >= edges[-1], len(edges) - 1)
    for k in range(len(edges) - 2, -1, -1):
        out = out.when((c >= edges[k]) & (c < edges[k + 1]), k)
    return out


def quantile_bins(df: DataFrame, value: str, q: int, name: str = "bin") -> DataFrame:
    """Right-closed bins at linearly interpolated quantiles, lowest value included, equal edges merged."""
    edges = df.agg(F.array_distinct(F.percentile(value, F.array(*[F.lit(k / q) for k in range(q + 1)]))).alias("_edges"))
    above = F.size(F.filter("_edges", lambda e: e < F.col(value)))
    return df.join(F.broadcast(edges)).withColumn(name, F.greatest(above - 1, F.lit(0))).drop("_edges")


def residualise(df: DataFrame, value: str, strata: list[str], name: str) -> DataFrame:
    """Value less the mean of its stratum; rows without a stratum stay as they are."""
    mean = F.avg(value).over(Window.partitionBy(*strata))
    known = F.lit(True)
    for s in strata:
        known = known & F.col(s).isNotNull()
    return df.withColumn(name, F.when(known, F.col(value) - mean).otherwise(F.col(value)))


def bh_fdr(df: DataFrame, p: str, strata: list[str], tie: list[str] | None = None, name: str = "q") -> DataFrame:
    """Benjamini-Hochberg q-values within strata; rows without a p-value have none.

    Of equal p-values the last one's rank gives the least ratio, so one row per value is enough and the order
    ``tie`` of equal ones, which callers may name, has no say. The least ratio at or above a value is the least
    of its block's later rows and of all later blocks.
    """
    df = fixed(df)
    t = cumulated(df, p, strata, {"_n": F.lit(1)})
    whole = df.groupBy(*strata).agg(F.count(p).alias("_all"))
    t = t.join(whole, strata) if strata else t.join(F.broadcast(whole))
    t = fixed(t.withColumn("_ratio", F.col(p) * F.col("_all") / (F.col("_n_before") + F.col("_n"))).withColumn("_block", F.floor(F.col("_n_before") * BLOCKS / F.col("_all"))))
    later = Window.partitionBy(*strata).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = t.groupBy(*strata, "_block").agg(F.min("_ratio").alias("_least"))
    blocks = blocks.select(*strata, "_block", F.min("_least").over(later).alias("_least"))
    inside = Window.partitionBy(*strata, "_block").orderBy(F.desc(p))
    t = t.withColumn("_own", F.min("_ratio").over(inside)).join(blocks, [*strata, "_block"])
    q = t.select(*strata, p, F.least("_own", "_least", F.lit(1.0)).alias(name))
    return df.join(q, [*strata, p], "left")


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a stated order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def priority_scores(df: DataFrame, value: str, bin_col: str, strata: list[str]) -> DataFrame:
    """Residual after distance bins, direction, rank and percentile by its size, and rank within direction.

    A row without a bin keeps its value; one without a value has no rank.
    """
    keys = [*strata, bin_col]
    means = df.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    df = df.join(means, keys, "left").withColumn("residual", F.col(value) - F.coalesce("_mean", F.lit(0.0))).drop("_mean")
    df = df.withColumn("abs_residual", F.abs("residual")).withColumn("direction", F.when(F.col("residual") < 0, "corrective").otherwise("cumulative"))
    df = fixed(df.withColumn("_down", -F.col("abs_residual")))
    one = {"_n": F.lit(1)}
    every = cumulated(df, "_down", strata, one).select(*strata, "_down", (F.col("_n_before") + 1).alias("rank"))
    within = cumulated(df, "_down", [*strata, "direction"], one).select(*strata, "direction", "_down", (F.col("_n_before") + 1).alias("dir_rank"))
    size = df.groupBy(*strata).agg(F.count("*").alias("_all"))
    df = df.join(every, [*strata, "_down"], "left").join(within, [*strata, "direction", "_down"], "left")
    df = df.join(size, strata) if strata else df.join(F.broadcast(size))
    return df.withColumn("percentile", 100.0 * F.col("rank") / F.col("_all")).drop("_down", "_all")


def product_correction(cells: DataFrame, i: str, j: str, score: str, keys: list[str]) -> DataFrame:
    """Average-product correction of full symmetric maps in long form, their diagonal 0."""
    row = F.avg(score).over(Window.partitionBy(*keys, i))
    col = F.avg(score).over(Window.partitionBy(*keys, j))
    whole = F.avg(score).over(Window.partitionBy(*keys))
    return cells.withColumn("apc", F.when(F.col(i) == F.col(j), 0.0).otherwise(F.col(score) - row * col / F.when(whole != 0, whole)))


def distance_normalise(cells: DataFrame, i: str, j: str, score: str, keys: list[str]) -> DataFrame:
    """Score less the mean of its diagonal; the main diagonal 0."""
    mean = F.avg(score).over(Window.partitionBy(*keys, F.abs(F.col(i) - F.col(j))))
    return cells.withColumn("normalised", F.when(F.col(i) == F.col(j), 0.0).otherwise(F.col(score) - mean))


def selected(df: DataFrame, count: str, share: str, least: int, most: int, bound: float) -> DataFrame:
    """Rows whose ``count`` lies from ``least`` to ``most`` and whose ``share`` is ``bound`` or more, highest shares first."""
    return df.where(F.col(count).between(least, most) & (F.col(share) >= bound)).orderBy(F.desc(share), F.desc(count))


def annotation(calls: DataFrame, keys: list[str], cls: str, protein: str, order: list[str], width: int = 20) -> DataFrame:
    """``keys, class, protein, ref, alt, chrom``: commonest class and protein change, the rest from the first row by ``order``.

    The lowest of equally common ones counts; a protein change is cut to ``width``; ``?`` where there is none.
    """
    first = F.min(F.struct(*order, "ref", "alt", "chrom")).alias("_f")
    g = calls.groupBy(*keys).agg(F.mode(cls, True).alias("_c"), F.mode(protein, True).alias("_p"), first)
    return g.select(*keys, F.coalesce("_c", F.lit("?")).alias("class"), F.coalesce(F.substring("_p", 1, width), F.lit("?")).alias("protein"), "_f.ref", "_f.alt", F.regexp_replace("_f.chrom", "^chr", "").alias("chrom"))


def best_of_two(df: DataFrame, keys: list[str], a: tuple[str, str, str], b: tuple[str, str, str]) -> DataFrame:
    """``keys, best_r, best_p, metric`` of the larger of two statistics ``(name, r, p)``; the first wins ties, a null or NaN never."""
    r = [F.nanvl(F.col(x[1]), F.lit(None).cast("double")) for x in (a, b)]
    one = r[1].isNull() | (r[0].isNotNull() & (r[0] >= r[1]))
    pick = lambda x, y: F.when(one, x).otherwise(y)
    return df.select(*keys, pick(r[0], r[1]).alias("best_r"), pick(F.col(a[2]), F.col(b[2])).alias("best_p"), pick(F.lit(a[0]), F.lit(b[0])).alias("metric"))
