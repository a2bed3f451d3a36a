"""Queries on exact tests and shuffled labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranking, resampling
from ..operators import statistics as st
from .geometry import residuals
from .standins import GRADED, PAIRS, graded, r6, scored

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {GRADED}, t AS (SELECT source, count(*) FILTER (good AND value >= 800) AS a, count(*) FILTER (good AND value < 800) AS b, count(*) FILTER (NOT good AND value >= 800) AS c, count(*) FILTER (NOT good AND value < 800) AS d FROM graded GROUP BY source),
x AS (SELECT *, a + b AS m, a + c AS k, a + b + c + d AS n, unnest(range(greatest(0, a + c - c - d), least(a + b, a + c) + 1)) AS j FROM t),
p AS (SELECT *, exp(lgamma(m+1.0)-lgamma(j+1.0)-lgamma(m-j+1.0)+lgamma(n-m+1.0)-lgamma(k-j+1.0)-lgamma(n-m-k+j+1.0)-lgamma(n+1.0)+lgamma(k+1.0)+lgamma(n-k+1.0)) AS q FROM x), s AS (SELECT *, max(CASE WHEN j = a THEN q END) OVER (PARTITION BY source) AS seen FROM p)
SELECT source, a, b, c, d, round(any_value(CASE WHEN b*c > 0 THEN a*d/(b*c)::DOUBLE END), 6) AS odds, round(least(sum(q) FILTER (q <= seen*(1 + 1e-7)), 1.0), 6) AS p FROM s GROUP BY source, a, b, c, d""")
def fisher_two_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long documents among good and other ones of each source: odds ratio and two-sided exact p."""
    g = graded(spark, sf_dir).withColumn("long", F.col("value") >= 800)
    t = g.groupBy("source").agg(*[F.count_if((F.col("good") == x) & (F.col("long") == y)).alias(n) for n, x, y in (("a", True, True), ("b", True, False), ("c", False, True), ("d", False, False))])
    t = st.fisher_two_sided(t, "a", "b", "c", "d")
    return t.select("source", "a", "b", "c", "d", F.round(F.when(F.col("odds") < float("inf"), F.col("odds")), 6).alias("odds"), F.round("p", 6).alias("p"))


RANKED = "rank() OVER (PARTITION BY {0} ORDER BY {1}) + (count(*) OVER (PARTITION BY {0}, {1}) - 1)/2.0"


@query(f"""WITH {PAIRS}, s AS (SELECT pair, label % 3 AS set3, epi_r_raw - avg(epi_r_raw) OVER (PARTITION BY bin) AS v FROM q), dg AS (SELECT *, CASE WHEN v < 0 THEN 'corrective' ELSE 'cumulative' END AS direction, set3 = 0 AS first FROM s WHERE set3 < 2), r AS (SELECT *, {RANKED.format('direction', 'v')} AS r FROM dg)
SELECT direction, count(*) FILTER (first) AS n1, count(*) FILTER (NOT first) AS n2, sum(r) FILTER (first) - count(*) FILTER (first)*(count(*) FILTER (first) + 1)/2.0 AS u FROM r GROUP BY direction""")
def asymmetry_u(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank sums of two sets' residuals, each direction on its own."""
    return asymmetry_p(spark, sf_dir).select("direction", "n1", "n2", "u")


@query()
def asymmetry_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with p-values of all three alternatives."""
    s = ranking.residualise(scored(spark, sf_dir), "epi_R_raw", ["bin"], "v").withColumn("set3", F.col("label") % 3).where("set3 < 2")
    s = s.withColumn("direction", F.when(F.col("v") < 0, "corrective").otherwise("cumulative")).withColumn("first", F.col("set3") == 0)
    return st.mann_whitney(s, "v", "first", ["direction"])


@query()
def effect_sizes_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good against other documents by source, where each has five rows or more: medians and a two-sided rank test."""
    g = graded(spark, sf_dir)
    of = lambda c: F.percentile(F.when(c, F.col("value")), 0.5)
    medians = g.groupBy("source").agg(of(F.col("good")).alias("median_good"), of(~F.col("good")).alias("median_other"))
    return st.mann_whitney(g, "value", "good", ["source"]).where("n1 >= 5 and n2 >= 5").join(medians, "source").select("source", "n1", "n2", "median_good", "median_other", "u", "p_two")


@query()
def quintile_contrast_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest quintile of distances against the lowest, by a rank test of the scores."""
    q = ranking.quantile_bins(scored(spark, sf_dir), "distance", 5, "quintile").where("quintile in (0, 4)").withColumn("top", F.col("quintile") == 4).withColumn("set", F.lit("all"))
    return st.mann_whitney(q, "epi_R_raw", "top", ["set"])


@query(f"""WITH {PAIRS}, k AS (SELECT label = 1 AS mine, row_number() OVER (ORDER BY epi_r_raw DESC, pair) AS r, count(*) OVER () AS n FROM q), sh AS (SELECT unnest([1, 2, 5, 10]) AS pct),
t AS (SELECT pct, any_value(greatest(1, n*pct//100)) AS n_top, count(*) FILTER (mine AND r <= greatest(1, n*pct//100)) AS a, count(*) FILTER (NOT mine AND r <= greatest(1, n*pct//100)) AS b, count(*) FILTER (mine AND r > greatest(1, n*pct//100)) AS c, count(*) FILTER (NOT mine AND r > greatest(1, n*pct//100)) AS d FROM k, sh GROUP BY pct),
x AS (SELECT *, a + b AS m, a + c AS h, a + b + c + d AS n, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS j FROM t),
pf AS (SELECT *, exp(lgamma(m+1.0)-lgamma(j+1.0)-lgamma(m-j+1.0)+lgamma(n-m+1.0)-lgamma(h-j+1.0)-lgamma(n-m-h+j+1.0)-lgamma(n+1.0)+lgamma(h+1.0)+lgamma(n-h+1.0)) AS f FROM x), s AS (SELECT *, max(CASE WHEN j = a THEN f END) OVER (PARTITION BY pct) AS seen FROM pf)
SELECT pct, n_top::BIGINT AS n_top, a, b, c, d, round(least(sum(f) FILTER (f <= seen*(1 + 1e-7)), 1.0), 6) AS p FROM s GROUP BY pct, n_top, a, b, c, d""")
def tail_enrichment_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source among the highest 1, 2, 5 and 10 percent against the rest, by Fisher's exact test.

    A share is cut at the value where its number of rows is reached; of the rows of that value the first by id fall in.
    Only rows of the cut values are numbered, a value at a time.
    """
    s = scored(spark, sf_dir).select("pair", (-F.col("epi_R_raw")).alias("down"), (F.col("label") == 1).alias("mine"))
    return st.tails(s, "down", "mine", "pair", [1, 2, 5, 10]).select("pct", "n_top", "a", "b", "c", "d", F.round("p", 6).alias("p"))


@query()
def label_shuffles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of null and signal pairs by distance bin: their mean difference against 5,000 shuffles of the labels."""
    t = resampling.mean_shuffles(scored(spark, sf_dir), "epi_R_raw", "is_null", "pair", ["bin"], 5000)
    return t.select("bin", "n1", "n2", r6(F.col("observed")).alias("observed"), (F.col("larger") / 5000).alias("p"), "larger_abs", "mean", "std")


@query()
def coherence_shuffles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute cosine inside null and signal residuals by bin, and whether the labels matter."""
    return resampling.coherence_shuffles(residuals(spark, sf_dir), "residual", "is_null", "pair", ["bin"])
