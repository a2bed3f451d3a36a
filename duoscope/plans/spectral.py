"""Queries on spectra of covariances and on their inverses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibration, spectra
from ..operators.lineage import fixed
from .geometry import COVS, residuals
from .standins import PAIRS

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {COVS}, n AS (SELECT is_null, count(*) AS n FROM q GROUP BY is_null) SELECT is_null, any_value(n) AS n, (max(i) + 1)::INT AS dim, round(sum(v) FILTER (i = j), 4) AS trace, round(sum(v*v), 4) AS squares, round(power(sum(v) FILTER (i = j), 2)/sum(v*v), 4) AS participation_ratio FROM c JOIN n USING (is_null) GROUP BY is_null")
def spectrum_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eigenvalues of null and signal covariances: their sum, their squares' sum and the participation ratio.

    They are found from products of the rows with blocks of vectors; their sums are those of the cells.
    """
    e = spectra.eigenpairs(residuals(spark, sf_dir), ["is_null"], "residual", 64)
    s = e.groupBy("is_null").agg(F.max("n").alias("n"), F.max("dim").alias("dim"), F.sum("value").alias("t"), F.sum(F.col("value") * F.col("value")).alias("s"))
    return s.select("is_null", "n", "dim", F.round("t", 4).alias("trace"), F.round("s", 4).alias("squares"), F.round(F.col("t") * F.col("t") / F.col("s"), 4).alias("participation_ratio"))


@query()
def covariance_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective dimensions of null and signal residuals, and the partial correlations of their coordinates."""
    r = residuals(spark, sf_dir)
    e = spectra.effective_dimensions(spectra.eigenpairs(r, ["is_null"], "residual", 64), ["is_null"])
    cells = calibration.covariance(calibration.gram(r, ["is_null"], "residual"), ["is_null"], ridge=1e-3)
    precision = spectra.cells_of(spectra.inverse(spectra.in_blocks(cells, ["is_null"]), ["is_null"]), ["is_null"])
    return e.join(spectra.partial_correlations(precision, ["is_null"]), "is_null")


@query(f"""WITH {PAIRS}, r AS (SELECT pair, bin, i - 1 AS i, vo - v1 - v2 AS x FROM v JOIN q USING (pair) WHERE is_null), a AS (SELECT a.i, b.i AS j, covar_samp(a.x, b.x) AS v FROM r a JOIN r b USING (pair) GROUP BY a.i, b.i),
b AS (SELECT a.bin, a.i, b.i AS j, covar_samp(a.x, b.x) AS v, count(*) AS n FROM r a JOIN r b USING (pair) GROUP BY a.bin, a.i, b.i HAVING count(*) >= 10) SELECT bin, any_value(b.n) AS n, round(sqrt(sum(power(b.v - a.v, 2)))/sqrt(sum(a.v*a.v)), 6) AS difference FROM b JOIN a USING (i, j) GROUP BY bin""")
def binned_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative Frobenius distance of each distance bin's null covariance from that of all bins, one Gram sum by bin for both."""
    by_bin = fixed(calibration.gram(residuals(spark, sf_dir).where("is_null"), ["bin"], "residual"))
    every = by_bin.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")]).withColumn("bin", F.lit(-1))
    whole = calibration.covariance(every, ["bin"]).select("i", "j", "value")
    own = calibration.covariance(by_bin.where("n >= 10"), ["bin"])
    d = spectra.relative_difference(whole, own.select("bin", "i", "j", "value"), ["bin"])
    return d.join(own.groupBy("bin").agg(F.max("n").alias("n")), "bin").select("bin", "n", F.round("difference", 6).alias("difference"))


@query()
def spectrum_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By distance bin against all: change of the largest eigenvalue, difference and largest eigenvalue of the precision matrix.

    The precision's largest eigenvalue is one over the covariance's least.
    """
    cells = calibration.binned_fits(residuals(spark, sf_dir).where("is_null"), "residual", "bin", 10, 1e-3)
    precision = fixed(spectra.cells_of(spectra.inverse(spectra.in_blocks(cells, ["use"]), ["use"]), ["use"]))
    diff = spectra.relative_difference(precision.where("use = -1").drop("use"), precision.where("use >= 0"), ["use"])
    r = residuals(spark, sf_dir).where("is_null").select("residual", F.explode(F.array("bin", F.lit(-1))).alias("use"))
    top = spectra.eigenpairs(r, ["use"], "residual", 1).select("use", F.col("value").alias("top"))
    whole = top.where("use = -1").select(F.col("top").alias("all"))
    return top.where("use >= 0").join(F.broadcast(whole)).select("use", "top", ((F.col("top") - F.col("all")) / F.col("all")).alias("top_change")).join(diff, "use").withColumnRenamed("use", "bin")


@query()
def spectrum_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of the distance bins' curves of cumulated variance, two by two."""
    return spectra.curve_correlations(spectra.eigenpairs(residuals(spark, sf_dir), ["bin"], "residual", 64), "bin")
