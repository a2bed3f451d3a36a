"""Queries that annotate pairs and single variants with all their columns, and selections among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import embedding, geometry, maps, ranking
from ..operators import statistics as st
from ..operators.lineage import fixed
from .geometry import METRICS, rounded
from .standins import CALLS, GRADED, PAIRS, calls, graded, pairs, r6, scored, store, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {PAIRS}, u AS (SELECT pair, bool_and(w IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL) AS whole, sqrt(sum(power(a - w, 2))) AS l, sum((a - w)*(b - w)) AS ab, sqrt(sum(power(b - w, 2))) AS r, sum(a*w) AS aw, sqrt(sum(a*a)) AS na, sqrt(sum(w*w)) AS nw FROM z GROUP BY pair), p1 AS (SELECT *, CASE WHEN r > 1e-20 THEN ab/r ELSE 0 END AS par FROM u),
p2 AS (SELECT *, sqrt(greatest(l*l - par*par, 0)) AS perp, greatest(l, 1e-20) AS d FROM p1)
SELECT pair, round(CASE WHEN whole THEN l END, 6) AS m1_v_l2, round(CASE WHEN whole THEN 1 - greatest(least(aw/(na*nw + 1e-20), 1.0), -1.0) END, 6) AS m1_v_diff, round(CASE WHEN whole THEN par END, 6) + 0.0 AS m1_v_par, round(CASE WHEN whole THEN perp END, 5) + 0.0 AS m1_v_perp, round(CASE WHEN whole THEN par/d END, 6) + 0.0 AS m1_x, round(CASE WHEN whole THEN perp/d END, 5) + 0.0 AS m1_y,
round(CASE WHEN whole THEN sqrt(power(par/d, 2) + power(perp/d, 2)) END, 6) AS m1_radius, round(CASE WHEN whole THEN atan2(perp/d, par/d) END, 5) + 0.0 AS m1_angle, round(CASE WHEN whole THEN atan2(perp/d, par/d)/pi() END, 5) + 0.0 AS m1_angle_over_pi FROM p2""")
def single_variant_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All coordinates of each pair's first single, along the second one's effect; null where a vector is missing."""
    wide = geometry.quadruples(store(spark, sf_dir), ["pair"]).withColumn("axis", geometry.minus(F.col("M2").cast("array<double>"), F.col("WT").cast("array<double>")))
    t = geometry.annotate_singles(wide, ["pair"], "M1", "m1_", "axis")
    fine = {"m1_v_perp", "m1_y", "m1_angle", "m1_angle_over_pi"}
    return t.select("pair", *[(F.round(c, 5 if c in fine else 6) + 0.0).alias(c) for c in t.columns if c != "pair"])


@query(f"""WITH {PAIRS}, n AS (SELECT epi_r_raw AS s FROM q WHERE is_null), k AS (SELECT pair, (1 + (SELECT count(*) FROM n WHERE n.s >= q.epi_r_raw))/(1 + (SELECT count(*) FROM n))::DOUBLE AS p FROM q WHERE NOT is_null), o AS (SELECT *, row_number() OVER (ORDER BY p, pair) AS r, count(*) OVER () AS m FROM k),
f AS (SELECT a.pair, least(min(b.p*b.m/b.r), 1.0) AS q FROM o a JOIN o b ON b.r >= a.r GROUP BY a.pair)
SELECT q.pair, gene AS meta_gene, bin AS meta_bin, {METRICS}, round(sqrt(d11), 6) AS norm_delta_a, round(sqrt(d22), 6) AS norm_delta_b, round(sqrt(dee), 6) AS norm_delta_add, round(sqrt(doo), 6) AS norm_delta_obs, round(sqrt(drr), 6) AS norm_residual, round(k.p, 6) AS p_epi_r_raw, round(f.q, 6) AS q_epi_r_raw FROM q LEFT JOIN k USING (pair) LEFT JOIN f USING (pair)""")
def feature_table_tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics, norms and descriptive columns of each pair, with p- and q-values against the null pairs where it is none."""
    p = pairs(spark, sf_dir).withColumnsRenamed({"gene": "meta_gene", "bin": "meta_bin"})
    keys = ["pair", "meta_gene", "meta_bin", "is_null"]
    m = fixed(geometry.feature_columns(p, keys).withColumn("track", F.lit("all")))
    tested = ranking.bh_fdr(st.empirical_p(m.select("pair", "track", "is_null", "epi_R_raw"), "epi_R_raw", "is_null", ["track"]), "p", ["track"])
    out = m.join(tested.select("pair", F.col("p").alias("p_epi_r_raw"), F.col("q").alias("q_epi_r_raw")), "pair", "left").drop("track", "is_null")
    return rounded(out, ["pair", "meta_gene", "meta_bin"])


@query(f"WITH {CALLS}, g AS (SELECT gene, count(DISTINCT case_id) AS n_gene FROM calls GROUP BY gene), b AS (SELECT gene, pos, count(DISTINCT case_id) AS n_both FROM calls GROUP BY 1, 2) SELECT gene, pos, n_both, round(n_both/n_gene::DOUBLE, 6) AS cond FROM b JOIN g USING (gene) WHERE n_both BETWEEN 3 AND 50 AND n_both/n_gene::DOUBLE >= 0.01")
def selected_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions shared by 3 to 50 cases with a share of the gene's cases of at least the bound."""
    c = calls(spark, sf_dir).select("gene", "pos", "case_id").distinct()
    g = c.groupBy("gene").agg(F.countDistinct("case_id").alias("n_gene"))
    b = c.groupBy("gene", "pos").agg(F.count("*").alias("n_both")).join(g, "gene").withColumn("cond", F.col("n_both") / F.col("n_gene"))
    return ranking.selected(b, "n_both", "cond", 3, 50, 0.01).select("gene", "pos", "n_both", F.round("cond", 6).alias("cond"))


@query(f"""WITH {CALLS}, h AS (SELECT *, CASE WHEN case_id % 3 > 0 THEN 'p.' || repeat(ref, 1 + (case_id % 2)::INT * 20) || pos || alt END AS protein FROM calls), k AS (SELECT gene, pos, cls, count(*) AS n FROM h WHERE cls IS NOT NULL GROUP BY ALL), m AS (SELECT gene, pos, cls FROM k QUALIFY row_number() OVER (PARTITION BY gene, pos ORDER BY n DESC, cls) = 1),
kp AS (SELECT gene, pos, protein, count(*) AS n FROM h WHERE protein IS NOT NULL GROUP BY ALL), mp AS (SELECT gene, pos, protein FROM kp QUALIFY row_number() OVER (PARTITION BY gene, pos ORDER BY n DESC, protein) = 1), f AS (SELECT gene, pos, min((case_id, depth, ref, alt, chrom)) AS f FROM h GROUP BY gene, pos)
SELECT gene, pos, coalesce(m.cls, '?') AS class, coalesce(substr(mp.protein, 1, 20), '?') AS protein, f[3] AS ref, f[4] AS alt, regexp_replace(f[5], '^chr', '') AS chrom FROM f LEFT JOIN m USING (gene, pos) LEFT JOIN mp USING (gene, pos)""")
def position_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each position the commonest class and protein change (cut to 20), and alleles and chromosome of its first case."""
    c = calls(spark, sf_dir)
    protein = F.concat(F.lit("p."), F.repeat(F.col("ref"), (1 + F.col("case_id") % 2 * 20).cast("int")), F.col("pos").cast("string"), "alt")
    return ranking.annotation(c.withColumn("protein", F.when(F.col("case_id") % 3 > 0, protein)), ["gene", "pos"], "cls", "protein", ["case_id", "depth"])


EFFECTS = "s AS (SELECT *, greatest(sqrt(d11), sqrt(d22)) AS e FROM q), b AS (SELECT avg(e) AS m, stddev_samp(e) AS sd FROM s WHERE is_null)"


@query(f"WITH {PAIRS}, {EFFECTS}, w AS (SELECT *, (e - m)/sd AS ez, ceil(19*ln(distance)/ln(max(distance) OVER () + 1)) - 1 AS k FROM s, b) SELECT k::BIGINT AS log_bin, count(*) AS n, round(avg(ez), 6) + 0.0 AS mean_z FROM w WHERE k >= 0 GROUP BY 1 HAVING count(*) >= 10")
def single_effects_by_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The larger single's effect, as a z-score of the null pairs', by nineteen log-spaced bins of distance."""
    m = geometry.pair_metrics(pairs(spark, sf_dir), ["distance", "is_null"])
    b = m.where("is_null").agg(F.avg("max_single").alias("m"), F.stddev("max_single").alias("s"))
    top = m.agg(F.log(F.max("distance") + 1).alias("top"))
    k = F.ceil(19 * F.log("distance") / F.col("top")) - 1
    g = m.join(F.broadcast(b)).join(F.broadcast(top)).withColumn("log_bin", k).where("log_bin >= 0").groupBy("log_bin")
    return g.agg(F.count("*").alias("n"), r6(F.avg((F.col("max_single") - F.col("m")) / F.col("s"))).alias("mean_z")).where("n >= 10")


@query(f"WITH {PAIRS}, a AS (SELECT label % 2 AS model, is_null, abs(sqrt(d11) - sqrt(d22))/(sqrt(d11) + sqrt(d22) + 1e-30) AS x FROM q) SELECT model, round(median(x) FILTER (is_null), 6) AS null_median, round(median(x) FILTER (NOT is_null), 6) AS signal_median FROM a GROUP BY model HAVING count(*) FILTER (is_null) >= 20 AND count(*) FILTER (NOT is_null) >= 20")
def asymmetry_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of the singles' asymmetry in null and signal pairs, by model with twenty of each."""
    return asymmetry_tested(spark, sf_dir).select("model", r6(F.col("null_median")).alias("null_median"), r6(F.col("signal_median")).alias("signal_median"))


@query()
def asymmetry_tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a two-sided rank test."""
    m = geometry.pair_metrics(pairs(spark, sf_dir).withColumn("model", F.col("label") % 2), ["model", "is_null"])
    a = m.withColumn("x", F.abs(F.col("len_WT_M1") - F.col("len_WT_M2")) / (F.col("len_WT_M1") + F.col("len_WT_M2") + 1e-30))
    of = lambda null: F.percentile(F.when(F.col("is_null") == null, F.col("x")), 0.5)
    t = st.mann_whitney(a, "x", "is_null", ["model"]).where("n1 >= 20 and n2 >= 20").select("model", "p_two")
    return a.groupBy("model").agg(of(True).alias("null_median"), of(False).alias("signal_median")).join(t, "model")


@query()
def best_of_two_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source the larger of two statistics with its own p-value, and which one that is; an absent one never wins."""
    g = graded(spark, sf_dir)
    a, b = (st.mann_whitney(g, v, "good", ["source"]).select("source", F.col("z").alias(f"r_{v}"), F.col("p_greater").alias(f"p_{v}")) for v in ("lines", "value"))
    return ranking.best_of_two(a.join(b, "source", "full"), ["source"], ("lines", "r_lines", "p_lines"), ("value", "r_value", "p_value"))


@query("WITH d AS (SELECT o_custkey AS case_id, greatest(max(date_diff('day', DATE '1992-01-01', o_orderdate::DATE)), max(CASE WHEN o_orderstatus = 'F' THEN date_diff('day', DATE '1991-01-01', o_orderdate::DATE) END))/365.0 AS duration, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS event FROM orders GROUP BY 1) SELECT case_id, round(duration, 6)::DOUBLE AS duration, event FROM d WHERE duration >= 6.5")
def follow_up_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Follow-up as elsewhere, cases under six and a half years left out."""
    o = table(spark, sf_dir, "orders")
    days = lambda start: F.datediff("o_orderdate", F.lit(start).cast("date"))
    g = o.groupBy(F.col("o_custkey").alias("case_id")).agg(F.max(days("1992-01-01")).alias("days_seen"), F.max(F.when(F.col("o_orderstatus") == "F", days("1991-01-01"))).alias("days_to_death"))
    t = st.follow_up(g, ["days_seen", "days_to_death"], "days_to_death", least=6.5)
    return t.select("case_id", F.round("duration", 6).alias("duration"), "event")


ROLE = "list_extract(['WT', 'M1', 'M2', 'M12'], (vec_id % 4 + 1)::INT)"


@query(f"WITH k AS (SELECT vec_id // 4 AS pair, {ROLE} AS role, embedding FROM embeddings), f AS (SELECT pair FROM k GROUP BY pair HAVING count(DISTINCT role) = 4) SELECT 'G' || pair || ':1:' || pair || ':A:C:P|G' || pair || ':1:' || (pair + 7) || ':G:T:P' AS id, role, round(CASE WHEN pair % 3 = 1 THEN 3*embedding[1]::DOUBLE ELSE embedding[1]::DOUBLE END, 5) AS first FROM k JOIN f USING (pair) WHERE pair % 3 < 2")
def reused_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors found in two other stores: by their own id in the first, by the id without gene and strand in the second.

    The second store has all pairs of remainder 1 and 0, so the first wins for 0, and lacks a role of remainder 2.
    """
    s = store(spark, sf_dir)
    name = lambda gene, strand: F.concat(gene, F.lit(":1:"), F.col("pair").cast("string"), F.lit(":A:C"), F.lit(strand), F.lit("|"), gene, F.lit(":1:"), (F.col("pair") + 7).cast("string"), F.lit(":G:T"), F.lit(strand))
    gene = F.concat(F.lit("G"), F.col("pair").cast("string"))
    wanted = s.select(name(gene, ":P").alias("id")).distinct()
    first = s.where("pair % 3 = 0").select(name(gene, ":P").alias("id"), "role", "embedding")
    second = s.where("pair % 3 < 2 or role <> 'M12'").select(name(F.lit("OTHER"), ":N").alias("id"), "role", F.transform("embedding", lambda x: x * 3).alias("embedding"))
    return embedding.reusable(wanted, [first, second]).select("id", "role", F.round(F.get("embedding", 0).cast("double"), 5).alias("first"))


@query(f"""WITH {PAIRS}, s AS (SELECT pair, (pair*37) % 101 AS cond, epi_r_raw - avg(epi_r_raw) OVER (PARTITION BY bin) AS v FROM q), d AS (SELECT *, CASE WHEN v < 0 THEN 'corrective' ELSE 'cumulative' END AS direction FROM s),
r AS (SELECT direction, rank() OVER (PARTITION BY direction ORDER BY abs(v)) + (count(*) OVER (PARTITION BY direction, abs(v)) - 1)/2.0 AS x, rank() OVER (PARTITION BY direction ORDER BY cond) + (count(*) OVER (PARTITION BY direction, cond) - 1)/2.0 AS y FROM d) SELECT direction, count(*) AS n, round(corr(x, y), 6) + 0.0 AS rho FROM r GROUP BY direction HAVING count(*) >= 50""")
def directional_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of a residual's size with a share, each direction of fifty pairs or more on its own."""
    s = ranking.residualise(scored(spark, sf_dir), "epi_R_raw", ["bin"], "v").withColumn("cond", (F.col("pair") * 37) % 101)
    s = fixed(s.select(F.when(F.col("v") < 0, "corrective").otherwise("cumulative").alias("direction"), F.abs("v").alias("size"), F.col("cond").cast("double").alias("cond")))
    n = s.groupBy("direction").agg(F.count("*").alias("n")).where("n >= 50")
    return st.spearman(s, "size", "cond", ["direction"]).join(n, "direction").select("direction", "n", r6(F.col("rho")).alias("rho"))


@query(f"""WITH {GRADED}, h AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY value DESC) AS r, count(*) OVER (PARTITION BY lang) AS n FROM graded WHERE other >= 40), sh AS (SELECT unnest([5, 10]) AS pct),
t AS (SELECT lang, pct, any_value(n) AS n, count(*) FILTER (good) AS m, any_value(greatest(1, n*pct//100)) AS d, count(*) FILTER (good AND r <= greatest(1, n*pct//100)) AS k FROM h, sh GROUP BY lang, pct), x AS (SELECT *, unnest(range(greatest(k, d + m - n, 0)::BIGINT, (least(m, d) + 1)::BIGINT)) AS j FROM t)
SELECT lang, pct, n, m, d, k, round(k/(d*m/n::DOUBLE), 6) AS fold, round(least(sum(exp(lgamma(m+1.0)-lgamma(j+1.0)-lgamma(m-j+1.0)+lgamma(n-m+1.0)-lgamma(d-j+1.0)-lgamma(n-m-d+j+1.0)-lgamma(n+1.0)+lgamma(d+1.0)+lgamma(n-d+1.0))), 1.0), 6) + 0.0 AS p FROM x GROUP BY lang, pct, n, m, d, k""")
def enrichment_in_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a high share ranked anew among themselves, and how a set is enriched at their top."""
    h = fixed(graded(spark, sf_dir).where("other >= 40").select("lang", "good", (-F.col("value")).alias("down")))
    t = ranking.cumulated(h, "down", ["lang"], {"n": F.lit(1), "good": F.col("good").cast("long")})
    whole = h.groupBy("lang").agg(F.count("*").alias("size"), F.count_if("good").alias("m"))
    t = t.join(whole, "lang").withColumn("pct", F.explode(F.array(F.lit(5), F.lit(10))))
    top = F.greatest(F.lit(1), F.floor(F.col("size") * F.col("pct") / 100)).cast("long")
    c = t.groupBy("lang", "pct").agg(F.max("size").alias("n"), F.max("m").alias("m"), F.max(top).alias("d"), F.sum(F.when(F.col("n_before") + 1 <= top, F.col("good")).otherwise(0)).alias("k"))
    c = st.hypergeometric_tail(c, "n", "m", "d", "k")
    return c.select("lang", "pct", "n", "m", "d", "k", F.round(F.try_divide(F.col("k"), F.col("d") * F.col("m") / F.col("n")), 6).alias("fold"), r6(F.col("p")).alias("p"))


@query("""WITH d AS (SELECT doc_id, len(coalesce(text, '')) AS n FROM documents WHERE len(coalesce(text, '')) > 0), p AS (SELECT doc_id, n, n//3 AS p1, least(n - 1, n//3 + 40 + doc_id % 400) AS p2 FROM d), w AS (SELECT *, greatest(0, p1 - 200) AS lo, least(n, p2 + 201) AS hi FROM p),
v AS (SELECT doc_id, 'pair' AS part, lo, hi, [p1, p2] AS sites FROM w WHERE hi - lo <= 600 UNION ALL SELECT doc_id, 'first', greatest(0, p1 - 300), least(n, p1 + 300), [p1] FROM w WHERE hi - lo > 600 UNION ALL SELECT doc_id, 'second', greatest(0, p2 - 300), least(n, p2 + 300), [p2] FROM w WHERE hi - lo > 600),
s AS (SELECT *, greatest(1, (hi - lo)//250) AS step FROM v), g AS (SELECT doc_id, part, lo, hi, unnest(list_distinct(range(0, hi - lo, step) || list_transform(sites, lambda x: x - lo))) AS pos FROM s)
SELECT doc_id, part, any_value(lo)::INT AS lo, any_value(hi)::INT AS hi, count(*) AS n, sum(pos)::BIGINT AS total FROM g GROUP BY doc_id, part""")
def pair_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows around two places of each text and the places looked at: one for both, or one each where they lie too far apart."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("length")).where("length > 0")
    d = d.withColumn("pos1", F.floor(F.col("length") / 3).cast("int")).withColumn("pos2", F.least(F.col("length") - 1, (F.col("pos1") + 40 + F.col("doc_id") % 400).cast("int")))
    w = maps.pair_windows(d, ["doc_id"], 200, 250, 600)
    return w.groupBy("doc_id", "part").agg(F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n"), F.sum("pos").alias("total"))
