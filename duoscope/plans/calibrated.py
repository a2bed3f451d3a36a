"""Queries on calibration by distance bin, matched sizes, precision matrices, and single variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import calibration, geometry, spectra, subspaces
from .geometry import METRICS, residuals, rounded
from .standins import PAIRS, pairs, r6, store

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


EFFECTS = f"{PAIRS}, r AS (SELECT v.pair, v.i, bin, is_null, vo - v1 - v2 AS res, vo AS obs, v1 + v2 AS ad FROM v JOIN q USING (pair))"
DISTANCES = ", ".join(f"round(sqrt(sum(r.{c}*r.{c}/({v} + 1e-3))), 6) AS {k}_{n}" for k, v in (("global", "gv.v"), ("binned", "coalesce(bv.v, gv.v)")) for n, c in (("epi_mahal", "res"), ("mahal_obs", "obs"), ("mahal_add", "ad")))


@query(f"""WITH {EFFECTS}, gv AS (SELECT i, var_samp(res) AS v FROM r WHERE is_null GROUP BY i), bv AS (SELECT bin, i, var_samp(res) AS v FROM r WHERE is_null GROUP BY bin, i HAVING count(*) >= 20)
SELECT r.pair, r.bin, {DISTANCES} FROM r JOIN gv USING (i) LEFT JOIN bv ON r.bin = bv.bin AND r.i = bv.i GROUP BY r.pair, r.bin""")
def calibrated_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances under the diagonal null covariance, of all pairs and of the pair's distance bin, in one row.

    A bin with fewer than 20 null pairs takes the global variances. One Gram sum by bin serves both.
    """
    r = residuals(spark, sf_dir)
    by_bin = calibration.gram(r.where("is_null"), ["bin"], "residual").where("i = j")
    spread = lambda n, s, q: F.try_divide(q - s * s / n, n - 1)
    own = by_bin.where("n >= 20").select("bin", "i", spread(F.col("n"), F.col("s"), F.col("q")).alias("own"))
    whole = by_bin.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).select("i", spread(F.col("n"), F.col("s"), F.col("q")).alias("whole"))
    long = r.select("pair", "bin", F.posexplode(F.arrays_zip("residual", "obs", "add")).alias("i", "x")).select("pair", "bin", "i", "x.*")
    long = long.join(F.broadcast(whole), "i").join(F.broadcast(own), ["bin", "i"], "left").withColumn("own", F.coalesce("own", "whole"))
    at = lambda c, v: r6(F.sqrt(F.sum(F.col(c) * F.col(c) / (F.col(v) + 1e-3))))
    names = (("epi_mahal", "residual"), ("mahal_obs", "obs"), ("mahal_add", "add"))
    return long.groupBy("pair", "bin").agg(*[at(c, v).alias(f"{k}_{n}") for k, v in (("global", "whole"), ("binned", "own")) for n, c in names])


@query(f"""WITH {EFFECTS}, k AS (SELECT pair, is_null, row_number() OVER (PARTITION BY is_null ORDER BY md5(pair::VARCHAR)) AS r FROM q), m AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM q GROUP BY is_null)),
s AS (SELECT r.* FROM r JOIN k USING (pair) WHERE k.r <= (SELECT n FROM m)) SELECT is_null, max(i) - min(i) + 1 AS dim, count(DISTINCT pair) AS n, round(sum(v), 6) AS trace FROM (SELECT is_null, i, pair, var_samp(res) OVER (PARTITION BY is_null, i) / count(*) OVER (PARTITION BY is_null, i) AS v FROM s) GROUP BY is_null""")
def matched_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariance of two groups cut to one size by a seeded order: size, dimension and trace."""
    r = residuals(spark, sf_dir)
    k = r.select("pair", "is_null", F.row_number().over(Window.partitionBy("is_null").orderBy(F.md5(F.col("pair").cast("string")))).alias("r"))
    least = r.groupBy("is_null").agg(F.count("*").alias("n")).agg(F.min("n").alias("least"))
    s = r.join(k.join(F.broadcast(least)).where("r <= least").select("pair"), "pair")
    c = calibration.covariance(calibration.gram(s, ["is_null"], "residual"), ["is_null"]).where("i = j")
    return c.groupBy("is_null").agg((F.max("i") + 1).cast("long").alias("dim"), F.max("n").alias("n"), F.round(F.sum("value"), 6).alias("trace"))


@query(f"WITH {PAIRS}, w AS (SELECT pair, sqrt(sum(power(CASE WHEN a IS NULL OR w IS NULL THEN NULL ELSE a - w END, 2))) AS l FROM z GROUP BY pair) SELECT pair, round(l, 6) AS v_l2 FROM w")
def single_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of each first single's effect; null where wild type or mutant is missing."""
    wide = geometry.quadruples(store(spark, sf_dir), ["pair"])
    return geometry.single_coords(wide, ["pair"]).select("pair", F.round("v_l2", 6).alias("v_l2"))


@query(f"""WITH {PAIRS}, h AS (SELECT vec_id // 4 AS pair, sha256(string_agg(k, '|' ORDER BY role)) AS hash FROM (SELECT vec_id, vec_id % 4 AS role, array_to_string(list_transform(embedding, lambda x: round(x::DOUBLE * 1e4)::BIGINT), ',') AS k FROM embeddings) GROUP BY 1 HAVING count(*) = 4)
SELECT pair, hash, gene AS meta_gene, bin AS meta_bin, {METRICS} FROM q JOIN h USING (pair)""")
def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics, fingerprint and descriptive columns of each pair in one table."""
    p = pairs(spark, sf_dir)
    text = lambda r: F.array_join(F.transform(F.col(r), lambda x: F.round(x.cast("double") * 1e4).cast("long").cast("string")), ",")
    p = p.withColumn("hash", F.sha2(F.concat_ws("|", *[text(r) for r in geometry.ROLES]), 256)).withColumnsRenamed({"gene": "meta_gene", "bin": "meta_bin"})
    return rounded(geometry.pair_metrics(p, ["pair", "hash", "meta_gene", "meta_bin"]), ["pair", "hash", "meta_gene", "meta_bin"])


def null_axes(r: DataFrame, k: int) -> DataFrame:
    return spectra.eigenpairs(r, ["is_null"], "residual", k)


@query()
def subspace_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of the ten leading axes of null and signal residuals."""
    axes = null_axes(residuals(spark, sf_dir), 10)
    return subspaces.overlap(axes.where("is_null"), axes.where("not is_null"))


@query()
def subspace_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each signal residual lies in the ten leading axes of the null ones."""
    r = residuals(spark, sf_dir)
    inside = subspaces.fraction_inside(r.where("not is_null"), null_axes(r.where("is_null"), 10), "residual")
    return inside.select("pair", "inside_fraction", "inside_norm", "orthogonal_norm")
