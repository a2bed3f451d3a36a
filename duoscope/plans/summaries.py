"""Queries on linkage tables, replicates and summary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .standins import CALLS, GRADED, PAIRS, calls, graded, r6, scored, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


LD = "ld AS (SELECT least(l_partkey, l_suppkey) AS pos1, greatest(l_partkey, l_suppkey) AS pos2, max(l_discount) AS r2 FROM lineitem WHERE l_linenumber = 1 AND l_partkey <> l_suppkey GROUP BY 1, 2)"


def linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of positions, the lower first, with the largest R2 seen."""
    li = table(spark, sf_dir, "lineitem").where("l_linenumber = 1 and l_partkey <> l_suppkey")
    return li.groupBy(F.least("l_partkey", "l_suppkey").alias("pos1"), F.greatest("l_partkey", "l_suppkey").alias("pos2")).agg(F.max("l_discount").alias("r2"))


@query(f"WITH {LD}, g AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem) SELECT a, b, ld.r2 IS NOT NULL AS found, round(ld.r2, 6) AS r2, x.p_brand AS gene1, y.p_brand AS gene2 FROM g LEFT JOIN ld ON pos1 = least(a, b) AND pos2 = greatest(a, b) LEFT JOIN part x ON x.p_partkey = a LEFT JOIN part y ON y.p_partkey = b")
def linkage_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linkage of given pairs in either order, whether it is known, and both ends' annotations."""
    g = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    g = g.withColumn("pos1", F.least("a", "b")).withColumn("pos2", F.greatest("a", "b"))
    part = table(spark, sf_dir, "part")
    x, y = (part.select(F.col("p_partkey").alias(k), F.col("p_brand").alias(n)) for k, n in (("a", "gene1"), ("b", "gene2")))
    j = g.join(linkage(spark, sf_dir), ["pos1", "pos2"], "left").join(x, "a", "left").join(y, "b", "left")
    return j.select("a", "b", F.col("r2").isNotNull().alias("found"), F.round("r2", 6).alias("r2"), "gene1", "gene2")


@query(f"WITH {LD} SELECT pos1, pos2, round(r2, 6) AS r2 FROM ld WHERE pos1 BETWEEN 5 AND 150 AND pos2 BETWEEN 5 AND 150 AND r2 >= 0.05 AND pos2 - pos1 <= 60")
def linkage_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with both ends in a region, by least R2 and greatest distance."""
    inside = F.col("pos1").between(5, 150) & F.col("pos2").between(5, 150)
    return linkage(spark, sf_dir).where(inside & (F.col("r2") >= 0.05) & (F.col("pos2") - F.col("pos1") <= 60)).select("pos1", "pos2", F.round("r2", 6).alias("r2"))


@query(f"WITH {LD}, a AS (SELECT p_partkey AS pos FROM part WHERE p_size <= 5) SELECT pos1, pos2, round(r2, 6) AS r2 FROM ld WHERE pos2 - pos1 < 600 AND (pos1 IN (SELECT pos FROM a) OR pos2 IN (SELECT pos FROM a))")
def linkage_by_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with an anchor at either end: two semi joins, so that no join has an OR."""
    near = linkage(spark, sf_dir).where("pos2 - pos1 < 600")
    a = table(spark, sf_dir, "part").where("p_size <= 5")
    ends = [near.join(a.select(F.col("p_partkey").alias(c)), c, "left_semi").select("pos1", "pos2", F.round("r2", 6).alias("r2")) for c in ("pos1", "pos2")]
    return ends[0].unionByName(ends[1]).distinct()


@query("SELECT l_orderkey AS barcode, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem WHERE l_linenumber <= 3 AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1) GROUP BY l_orderkey")
def replicate_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readouts averaged over replicates by barcode, for the barcodes of the first one; absent ones are skipped."""
    li = table(spark, sf_dir, "lineitem").where("l_linenumber <= 3").select(F.col("l_orderkey").alias("barcode"), "l_linenumber", "l_quantity")
    first = li.where("l_linenumber = 1").select("barcode")
    return li.join(first, "barcode", "left_semi").groupBy("barcode").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"))


@query("SELECT l_partkey AS pos, count(*) FILTER (l_returnflag = 'A') AS n_a, count(*) FILTER (l_returnflag <> 'A') AS n_other, round(avg(l_quantity) FILTER (l_returnflag = 'A') - avg(l_quantity) FILTER (l_returnflag <> 'A'), 6) + 0.0 AS difference FROM lineitem GROUP BY l_partkey")
def structural_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean in one background less the mean in all others; null if either is missing."""
    own = F.col("l_returnflag") == "A"
    mean = lambda c: F.avg(F.when(c, F.col("l_quantity")))
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("pos"))
    return t.agg(F.count_if(own).alias("n_a"), F.count_if(~own).alias("n_other"), r6(mean(own) - mean(~own)).alias("difference"))


@query("SELECT l_partkey AS pos, l_returnflag AS background, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY ALL")
def background_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("pos"), F.col("l_returnflag").alias("background")).agg(F.round(F.avg("l_quantity"), 6).alias("mean"))


@query(f"""WITH {GRADED}, t AS (SELECT lang, quantile_cont(value, 0.75) FILTER (good) - quantile_cont(value, 0.25) FILTER (good) AS a, quantile_cont(value, 0.75) FILTER (NOT good) - quantile_cont(value, 0.25) FILTER (NOT good) AS b,
quantile_cont(value, 0.5) FILTER (good) AS x, quantile_cont(value, 0.5) FILTER (NOT good) AS y FROM graded GROUP BY lang) SELECT lang, round(CASE WHEN b <> 0 THEN a/b END, 6) AS spread_ratio, round(CASE WHEN y <> 0 THEN x/y END, 6) AS median_ratio FROM t""")
def spread_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interquartile ranges and medians of two groups as ratios."""
    at = [F.lit(0.25), F.lit(0.5), F.lit(0.75)]
    quartiles = lambda c: F.percentile(F.when(c, F.col("value")), F.array(*at))
    t = graded(spark, sf_dir).groupBy("lang").agg(quartiles(F.col("good")).alias("a"), quartiles(~F.col("good")).alias("b"))
    wide = lambda q: F.get(q, 2) - F.get(q, 0)
    a, b = F.col("a"), F.col("b")
    return t.select("lang", F.round(F.try_divide(wide(a), wide(b)), 6).alias("spread_ratio"), F.round(F.try_divide(F.get(a, 1), F.get(b, 1)), 6).alias("median_ratio"))


@query(f"WITH {PAIRS}, k AS (SELECT avg(epi_r_raw) AS m, stddev_samp(epi_r_raw) AS s FROM q WHERE is_null) SELECT pair, round((epi_r_raw - m)/s, 6) + 0.0 AS z, round(abs(epi_r_raw - abs(lmr))/(epi_r_raw + abs(lmr) + 1e-30), 6) AS asymmetry FROM q, k")
def background_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores in standard deviations of the background, and the asymmetry of two scores."""
    s = scored(spark, sf_dir)
    k = s.where("is_null").agg(F.avg("epi_R_raw").alias("m"), F.stddev("epi_R_raw").alias("s"))  # one row
    a, b = F.col("epi_R_raw"), F.abs("log_magnitude_ratio")
    return s.join(F.broadcast(k)).select("pair", r6((a - F.col("m")) / F.col("s")).alias("z"), F.round(F.abs(a - b) / (a + b + 1e-30), 6).alias("asymmetry"))


@query(f"WITH {PAIRS}, t AS (SELECT bin, quantile_cont(epi_r_raw, 0.5) FILTER (is_null) AS m0, quantile_cont(epi_r_raw, 0.5) FILTER (NOT is_null) AS m1, count(*) FILTER (is_null) AS n0, count(*) FILTER (NOT is_null) AS n1 FROM q GROUP BY bin) SELECT bin, n0, n1, round(m0, 6) AS median_null, round(m1, 6) AS median_signal FROM t WHERE n0 >= 3 AND n1 >= 3")
def group_medians_by_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of two groups per distance bin, where both are large enough."""
    own = F.col("is_null")
    median = lambda c: F.round(F.percentile(F.when(c, F.col("epi_R_raw")), 0.5), 6)
    t = scored(spark, sf_dir).groupBy("bin").agg(F.count_if(own).alias("n0"), F.count_if(~own).alias("n1"), median(own).alias("median_null"), median(~own).alias("median_signal"))
    return t.where("n0 >= 3 and n1 >= 3")


@query("WITH s AS (SELECT unnest([l_partkey, l_suppkey]) AS variant, l_quantity AS v FROM lineitem) SELECT variant, count(*) AS n, round(quantile_cont(v, 0.5), 6) AS median FROM s GROUP BY variant")
def singles_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both members of each pair stacked with its effect, and the median of each."""
    s = table(spark, sf_dir, "lineitem").select(F.explode(F.array("l_partkey", "l_suppkey")).alias("variant"), "l_quantity")
    return s.groupBy("variant").agg(F.count("*").alias("n"), F.round(F.percentile("l_quantity", 0.5), 6).alias("median"))


@query(f"WITH {CALLS} SELECT gene, round(avg(depth) FILTER (cls = 'A'), 6) AS a, round(avg(depth) FILTER (cls = 'R'), 6) AS r, round(avg(depth) FILTER (cls = 'A') - avg(depth) FILTER (cls = 'R'), 6) + 0.0 AS delta FROM calls GROUP BY gene")
def method_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column per method, and the difference of two of them."""
    t = calls(spark, sf_dir).groupBy("gene").pivot("cls", ["A", "R"]).agg(F.avg("depth"))
    return t.select("gene", F.round("A", 6).alias("a"), F.round("R", 6).alias("r"), r6(F.col("A") - F.col("R")).alias("delta"))


@query(f"""WITH {GRADED}, m AS (SELECT lang, source, avg(value) FILTER (good) AS a, avg(value) FILTER (NOT good) AS b FROM graded GROUP BY lang, source), k AS (SELECT lang, max(a) AS best_a, max(b) AS best_b FROM m GROUP BY lang)
SELECT lang, round(best_a, 6) AS best_a, round(best_b, 6) AS best_b, (SELECT min(source) FROM m WHERE m.lang = k.lang AND m.a = best_a) AS source_a, (SELECT min(source) FROM m WHERE m.lang = k.lang AND m.b = best_b) AS source_b, coalesce(best_a > best_b, false) AS win FROM k WHERE lang IS NOT NULL""")
def head_to_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best source by either measure for each language, and which measure wins; ties go to the first name."""
    m = graded(spark, sf_dir).where("lang is not null").groupBy("lang", "source").agg(F.avg(F.when(F.col("good"), F.col("value"))).alias("a"), F.avg(F.when(~F.col("good"), F.col("value"))).alias("b"))

    def best(c: str) -> Column:
        return F.min(F.when(F.col(c).isNotNull(), F.struct((-F.col(c)).alias("v"), F.col("source").alias("s")))).alias(f"_{c}")

    t = m.groupBy("lang").agg(best("a"), best("b"))
    a, b = -F.col("_a.v"), -F.col("_b.v")
    return t.select("lang", F.round(a, 6).alias("best_a"), F.round(b, 6).alias("best_b"), F.col("_a.s").alias("source_a"), F.col("_b.s").alias("source_b"), F.coalesce(a > b, F.lit(False)).alias("win"))


@query(f"WITH {GRADED} SELECT source, round(avg(value), 6) AS mean, count(*) FILTER (lines < 3) AS few_lines, count(DISTINCT lang) AS languages, count(*) AS n FROM graded GROUP BY source")
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graded(spark, sf_dir).groupBy("source").agg(F.round(F.avg("value"), 6).alias("mean"), F.count_if(F.col("lines") < 3).alias("few_lines"), F.countDistinct("lang").alias("languages"), F.count("*").alias("n"))
