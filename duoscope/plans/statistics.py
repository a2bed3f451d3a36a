"""Queries on statistical tests and survival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import bands, ranking
from ..operators import statistics as st
from .standins import CALLS, CLINICAL, GRADED, PAIRS, calls, clinical, graded, r6, scored

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


RANKS = "rank() OVER (PARTITION BY lang ORDER BY {0}) + (count(*) OVER (PARTITION BY lang, {0}) - 1)/2.0"


@query(f"""WITH {GRADED}, r AS (SELECT *, {RANKS.format('value')} AS r FROM graded), t AS (SELECT lang, sum(power(c, 3) - c) AS ties FROM (SELECT lang, count(*) AS c FROM graded GROUP BY lang, value) GROUP BY lang),
s AS (SELECT lang, count(*) FILTER (good) AS n1, count(*) FILTER (NOT good) AS n2, sum(r) FILTER (good) AS w FROM r GROUP BY lang), u AS (SELECT lang, n1, n2, w - n1*(n1+1)/2.0 AS u, sqrt(n1*n2/12.0*(n1+n2+1 - ties/((n1+n2)*(n1+n2-1)))) AS sd FROM s JOIN t USING (lang))
SELECT lang, n1, n2, u, round((u - n1*n2/2.0 - 0.5)/sd, 6) + 0.0 AS z FROM u""")
def mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of good against other documents, by language."""
    return st.mann_whitney(graded(spark, sf_dir), "value", "good", ["lang"]).select("lang", "n1", "n2", "u", r6(F.col("z")).alias("z"))


@query()
def mann_whitney_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with one-sided p-values, and their q-values."""
    t = st.mann_whitney(graded(spark, sf_dir), "value", "good", ["source"]).withColumn("p", st.normal_tail(F.col("z"))).withColumn("track", F.lit("length"))
    return ranking.bh_fdr(t, "p", ["track"]).select("source", "u", "z", "p", "q")


@query(f"""WITH {GRADED}, r AS (SELECT lang, {RANKS.format('value')} AS x, {RANKS.format('lines')} AS y, {RANKS.format('other')} AS c FROM graded), k AS (SELECT lang, corr(x, y) AS xy, corr(x, c) AS xc, corr(y, c) AS yc FROM r GROUP BY lang)
SELECT lang, round(xy, 6) + 0.0 AS rho, round((xy - xc*yc)/sqrt((1 - xc*xc)*(1 - yc*yc)), 6) + 0.0 AS partial_rho FROM k""")
def spearman_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = st.spearman(graded(spark, sf_dir), "value", "lines", ["lang"], "other")
    return s.select("lang", r6(F.col("rho")).alias("rho"), r6(F.col("partial_rho")).alias("partial_rho"))


@query(f"""WITH {GRADED}, k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY value DESC, doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM graded), g AS (SELECT unnest([5, 10, 25]) AS pct),
t AS (SELECT lang, pct, any_value(n) AS n, count(*) FILTER (NOT good) AS m, any_value(greatest(1, floor(n*pct/100.0)))::BIGINT AS d, count(*) FILTER (NOT good AND r <= greatest(1, floor(n*pct/100.0))) AS k FROM k, g GROUP BY lang, pct),
x AS (SELECT *, unnest(range(greatest(k, d + m - n, 0)::BIGINT, (least(m, d) + 1)::BIGINT)) AS j FROM t)
SELECT lang, pct, n, m, d, k, round(k/(d*m/n::DOUBLE), 6) AS fold, round(least(sum(exp(lgamma(m+1.0)-lgamma(j+1.0)-lgamma(m-j+1.0)+lgamma(n-m+1.0)-lgamma(d-j+1.0)-lgamma(n-m-d+j+1.0)-lgamma(n+1.0)+lgamma(d+1.0)+lgamma(n-d+1.0))), 1.0), 6) + 0.0 AS p FROM x GROUP BY lang, pct, n, m, d, k""")
def hypergeometric_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enrichment of poor documents among the longest few percent, for all languages and cuts at once."""
    w = Window.partitionBy("lang")
    d = graded(spark, sf_dir).withColumn("r", F.row_number().over(w.orderBy(F.desc("value"), "doc_id"))).withColumn("size", F.count("*").over(w))
    d = d.withColumn("pct", F.explode(F.array(F.lit(5), F.lit(10), F.lit(25))))
    top = F.greatest(F.lit(1), F.floor(F.col("size") * F.col("pct") / 100.0)).cast("long")
    t = d.groupBy("lang", "pct").agg(F.max("size").alias("n"), F.count_if(~F.col("good")).alias("m"), F.max(top).alias("d"), F.count_if(~F.col("good") & (F.col("r") <= top)).alias("k"))
    t = st.hypergeometric_tail(t, "n", "m", "d", "k")
    return t.select("lang", "pct", "n", "m", "d", "k", F.round(F.try_divide(F.col("k"), F.col("d") * F.col("m") / F.col("n")), 6).alias("fold"), r6(F.col("p")).alias("p"))


@query(f"""WITH {PAIRS}, r AS (SELECT bin, is_null, epi_r_raw AS s FROM q), t AS (SELECT q.pair, q.bin, q.epi_r_raw AS s, (SELECT count(*) FROM r WHERE is_null) AS n, (SELECT count(*) FROM r WHERE is_null AND r.s >= q.epi_r_raw) AS k FROM q WHERE NOT is_null)
SELECT pair, round((1 + k)/(1 + n)::DOUBLE, 6) AS p FROM t""")
def empirical_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal pairs against the null scores."""
    return st.empirical_p(scored(spark, sf_dir).withColumn("model", F.lit("m")), "epi_R_raw", "is_null", ["model"]).select("pair", F.round("p", 6).alias("p"))


@query(f"""WITH {PAIRS}, r AS (SELECT pair, bin, epi_r_raw AS s, count(*) FILTER (is_null) OVER () AS n, is_null FROM q), t AS (SELECT x.pair, (1 + count(*) FILTER (y.is_null AND y.s >= x.s))/(1 + any_value(x.n))::DOUBLE AS p FROM r x, r y WHERE NOT x.is_null GROUP BY x.pair),
o AS (SELECT pair, p, row_number() OVER (ORDER BY p, pair) AS k, count(*) OVER () AS n FROM t) SELECT a.pair, round(least(min(b.p*b.n/b.k), 1.0), 6) AS q FROM o a JOIN o b ON b.k >= a.k GROUP BY a.pair""")
def fdr_q_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benjamini-Hochberg over the empirical p-values."""
    p = st.empirical_p(scored(spark, sf_dir).withColumn("model", F.lit("m")), "epi_R_raw", "is_null", ["model"])
    return ranking.bh_fdr(p, "p", ["model"]).select("pair", F.round("q", 6).alias("q"))


@query(f"""WITH {GRADED}, v AS (SELECT DISTINCT lang, value FROM graded), c AS (SELECT v.lang, v.value, count(*) FILTER (good AND g.value <= v.value)/(count(*) FILTER (good))::DOUBLE AS a, count(*) FILTER (NOT good AND g.value <= v.value)/(count(*) FILTER (NOT good))::DOUBLE AS b FROM v JOIN graded g USING (lang) GROUP BY v.lang, v.value)
SELECT lang, round(max(abs(a - b)), 6) AS d FROM c GROUP BY lang""")
def kolmogorov_smirnov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.kolmogorov_smirnov(graded(spark, sf_dir), "value", "good", ["lang"]).select("lang", F.round("d", 6).alias("d"))


@query(f"""WITH {GRADED}, m AS (SELECT lang, source, avg(value) FILTER (good) AS a, avg(value) FILTER (NOT good) AS b FROM graded GROUP BY lang, source), d AS (SELECT lang, round(a - b, 12) AS d FROM m WHERE a IS NOT NULL AND b IS NOT NULL),
r AS (SELECT lang, d, rank() OVER (PARTITION BY lang ORDER BY abs(d)) + (count(*) OVER (PARTITION BY lang, abs(d)) - 1)/2.0 AS r FROM d WHERE d <> 0), s AS (SELECT lang, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0.0) AS w FROM r GROUP BY lang)
SELECT lang, n, w::DOUBLE AS w, round((w - n*(n+1)/4.0)/sqrt(n*(n+1)*(2*n+1)/24.0), 6) + 0.0 AS z FROM s""")
def wilcoxon_signed_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired by source: mean length of good and other documents."""
    m = graded(spark, sf_dir).groupBy("lang", "source").agg(F.avg(F.when(F.col("good"), F.col("value"))).alias("a"), F.avg(F.when(~F.col("good"), F.col("value"))).alias("b")).where("a is not null and b is not null")
    return st.signed_rank(m, "a", "b", ["lang"]).select("lang", "n", "w", r6(F.col("z")).alias("z"))


@query(f"""WITH {PAIRS}, b AS (SELECT pair, bin, is_null, epi_r_raw - avg(epi_r_raw) OVER (PARTITION BY bin) AS v, count(*) FILTER (is_null) OVER (PARTITION BY bin) AS n FROM q),
o AS (SELECT avg(v) FILTER (is_null) - avg(v) FILTER (NOT is_null) AS d FROM b), s AS (SELECT perm, v, row_number() OVER (PARTITION BY perm, bin ORDER BY md5(perm || ':' || pair)) <= n AS g FROM b, (SELECT unnest(range(1, 501)) AS perm)),
r AS (SELECT perm, avg(v) FILTER (g) - avg(v) FILTER (NOT g) AS d FROM s GROUP BY perm) SELECT round(any_value(o.d), 6) + 0.0 AS observed, round((any_value(o.d) - avg(r.d))/stddev_samp(r.d), 6) + 0.0 AS z, round((count(*) FILTER (r.d >= o.d) + 1)/501.0, 6) AS p FROM r, o""")
def permutation_within_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null against signal pairs, labels shuffled within distance bins 500 times."""
    t = st.permutation_test(scored(spark, sf_dir).withColumn("model", F.lit("m")), "epi_R_raw", "is_null", "bin", "pair", 500, ["model"])
    return t.select(r6(F.col("observed")).alias("observed"), r6(F.col("z")).alias("z"), F.round("p", 6).alias("p"))


def by_carriers(spark: SparkSession, sf_dir: str, strata: list[str]) -> DataFrame:
    """A test per gene: its carriers against all other cases of the follow-up table."""
    carriers = calls(spark, sf_dir).where("depth >= 15 and alt_count >= 15").select("gene", "case_id").distinct()
    return st.log_rank_of_carriers(clinical(spark, sf_dir), carriers, "gene", "case_id", strata)


COHORTS = f"{CALLS}, {CLINICAL}, ca AS (SELECT DISTINCT gene, case_id FROM calls WHERE depth >= 15 AND alt_count >= 15), co AS (SELECT g.gene, c.*, CASE WHEN ca.case_id IS NULL THEN 0 ELSE 1 END AS grp FROM clinical c CROSS JOIN (SELECT DISTINCT gene FROM ca) g LEFT JOIN ca ON ca.gene = g.gene AND ca.case_id = c.case_id)"
LOGRANK = """, ti AS (SELECT {k}, duration, sum(CASE WHEN grp = 1 THEN event ELSE 0 END) AS d1, sum(event) AS d, sum(grp) AS c1, count(*) AS c FROM co GROUP BY {k}, duration),
ri AS (SELECT *, sum(c1) OVER w AS n1, sum(c) OVER w AS n FROM ti WINDOW w AS (PARTITION BY {k} ORDER BY duration DESC)),
lr AS (SELECT {k}, sum(d1) AS o, sum(d*n1/n::DOUBLE) AS e, sum(CASE WHEN n > 1 THEN d*n1/n::DOUBLE*(1 - n1/n::DOUBLE)*(n - d)/(n - 1)::DOUBLE ELSE 0 END) AS v FROM ri GROUP BY {k})"""


@query(f"WITH {COHORTS}{LOGRANK.format(k='gene')} SELECT gene, o::BIGINT AS observed, round(e, 6) AS expected, round(v, 6) AS variance, round(CASE WHEN v > 0 THEN power(o - e, 2)/v END, 6) AS chi2 FROM lr")
def log_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carriers of each gene against all others, every gene in one job."""
    t = by_carriers(spark, sf_dir, [])
    return t.select("gene", F.col("observed").cast("long").alias("observed"), *[F.round(c, 6).alias(c) for c in ("expected", "variance", "chi2")])


@query()
def log_rank_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = by_carriers(spark, sf_dir, []).withColumn("p", st.chi2_tail(F.col("chi2"))).withColumn("track", F.lit("gene"))
    return ranking.bh_fdr(t, "p", ["track"]).select("gene", "chi2", "p", "q")


@query(f"WITH {COHORTS}{LOGRANK.format(k='gene, project')} SELECT gene, round(sum(power(o - e, 2)/v), 6) AS chi2, count(*) AS df FROM lr WHERE v > 0 GROUP BY gene")
def stratified_log_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum over projects of their chi-squares."""
    return st.stratified_log_rank(by_carriers(spark, sf_dir, ["project"]), ["gene"]).select("gene", F.round("chi2", 6).alias("chi2"), "df")


@query(f"""WITH {CLINICAL}, t AS (SELECT project, duration, sum(event) AS d, count(*) AS c FROM clinical GROUP BY project, duration), r AS (SELECT *, sum(c) OVER (PARTITION BY project ORDER BY duration DESC) AS n FROM t),
k AS (SELECT *, max(CASE WHEN d = n THEN 1 ELSE 0 END) OVER w AS gone, sum(CASE WHEN d < n THEN ln(1 - d/n::DOUBLE) ELSE 0 END) OVER w AS s FROM r WINDOW w AS (PARTITION BY project ORDER BY duration))
SELECT project, round(duration, 6) AS duration, d::BIGINT AS d, n::BIGINT AS n, round(CASE WHEN gone = 1 THEN 0 ELSE exp(s) END, 6) AS survival FROM k WHERE d > 0""")
def kaplan_meier(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clinical(spark, sf_dir).withColumn("grp", F.lit(0))
    return st.kaplan_meier(c, ["project"]).select("project", F.round("duration", 6).alias("duration"), F.col("d").cast("long").alias("d"), F.col("n").cast("long").alias("n"), F.round("survival", 6).alias("survival"))


@query(f"WITH {CLINICAL} SELECT project, count(*) AS n, sum(event)::BIGINT AS events, round(quantile_cont(duration, 0.5), 6) AS median_followup FROM clinical GROUP BY project")
def survival_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clinical(spark, sf_dir).groupBy("project").agg(F.count("*").alias("n"), F.sum("event").alias("events"), F.round(F.percentile("duration", 0.5), 6).alias("median_followup"))


@query(f"""WITH {CALLS}, {CLINICAL}, b AS (SELECT case_id, count(*) AS tmb FROM calls GROUP BY case_id), ca AS (SELECT DISTINCT gene, case_id FROM calls WHERE depth >= 15 AND alt_count >= 15),
t AS (SELECT ca.gene, c.case_id, c.duration, c.event, tmb FROM ca JOIN clinical c USING (case_id) JOIN b USING (case_id)), m AS (SELECT gene, quantile_cont(tmb, 0.5) AS med FROM t GROUP BY gene),
x AS (SELECT m.gene, c.duration, c.event FROM m JOIN b ON tmb BETWEEN med*0.5 AND med*1.5 JOIN clinical c USING (case_id) WHERE NOT EXISTS (SELECT 1 FROM ca WHERE ca.gene = m.gene AND ca.case_id = c.case_id)),
co AS (SELECT gene, duration, event, 1 AS grp FROM t UNION ALL SELECT gene, duration, event, 0 FROM x){LOGRANK.format(k='gene')}
SELECT gene, round(CASE WHEN v > 0 THEN power(o - e, 2)/v END, 6) AS chi2 FROM lr""")
def burden_matched_log_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carriers against non-carriers whose number of mutations lies within half of the carriers' median."""
    c, cl = calls(spark, sf_dir), clinical(spark, sf_dir)
    burden = c.groupBy("case_id").agg(F.count("*").alias("tmb"))
    carriers = c.where("depth >= 15 and alt_count >= 15").select("gene", "case_id").distinct()
    people = cl.join(burden, "case_id").select("case_id", "duration", "event", "tmb")
    target = carriers.join(people, "case_id")
    median = target.groupBy("gene").agg(F.percentile("tmb", 0.5).alias("med"))
    ranges = median.select("gene", F.ceil(F.col("med") * 0.5).alias("least"), (F.floor(F.col("med") * 1.5) + 1).alias("past"))
    near = bands.interval_join(people, ranges, [], "tmb", "least", "past", 16).join(carriers, ["gene", "case_id"], "left_anti")
    both = target.select("gene", "duration", "event", F.lit(1).alias("grp")).unionByName(near.select("gene", "duration", "event", F.lit(0).alias("grp")))
    return st.log_rank(both, ["gene"]).select("gene", F.round("chi2", 6).alias("chi2"))


@query()
def cox_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hazard by the logarithm of a case's number of mutations and the share of them read at 25 or deeper."""
    burden = calls(spark, sf_dir).groupBy("case_id").agg(F.log1p(F.count("*")).alias("burden"), F.avg((F.col("depth") >= 25).cast("double")).alias("deep"))
    return st.cox(clinical(spark, sf_dir).join(burden, "case_id"), ["burden", "deep"])
