"""Queries on pair geometry, calibration and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import calibration, geometry, ranking, spectra
from .standins import PAIRS, pairs, r6, scored, store, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, *[r6(F.col(c)).alias(c) for c in df.columns if c not in keys])


R = lambda x, name: f"round({x}, 6) + 0.0 AS {name}"
COS = lambda d, u, v: f"CASE WHEN sqrt({u})*sqrt({v}) > 1e-20 THEN {d}/(sqrt({u})*sqrt({v})) ELSE 0.0 END"
ALONG = "CASE WHEN sqrt(dee) < 1e-20 THEN 0.0 ELSE der/sqrt(dee) END"
METRICS = ", ".join(
    R(x, n)
    for n, x in {
        "len_WT_M1": "sqrt(d11)", "len_WT_M2": "sqrt(d22)", "len_WT_M12": "sqrt(doo)", "len_WT_M12_exp": "sqrt(dee)", "epi_R_raw": "sqrt(drr)",
        "epi_R_singles": "sqrt(drr)/(sqrt(d11+d22)+1e-20)", "cos_v1_v2": COS("d12", "d11", "d22"), "cos_exp_to_obs": COS("der", "dee", "drr"),
        "magnitude_ratio": "sqrt(doo)/(sqrt(dee)+1e-20)", "log_magnitude_ratio": "lmr", "cos_obs_exp": COS("doe", "doo", "dee"),
        "cos_dist_obs_exp": f"1 - ({COS('doe', 'doo', 'dee')})", "r_parallel": ALONG, "r_perp": f"sqrt(greatest(drr - power({ALONG}, 2), 0))",
        "theta": "acos(greatest(least(doe/(sqrt(doo)*sqrt(dee)+1e-20), 1.0), -1.0))", "max_single": "greatest(sqrt(d11), sqrt(d22))", "sum_singles": "sqrt(d11)+sqrt(d22)",
    }.items()
)


@query(f"WITH {PAIRS} SELECT pair, {METRICS} FROM q")
def epistasis_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pair metrics from four embeddings."""
    return rounded(geometry.pair_metrics(pairs(spark, sf_dir), ["pair"]), ["pair"])


@query(f"""WITH {PAIRS}, c AS (SELECT pair, sqrt(dee) AS e, sqrt(greatest(ddd - ded*ded/dee, 0)) AS ac, dee, doe, dod, ded FROM q),
t AS (SELECT pair, doe/e/(e+1e-20) AS x, (CASE WHEN ac > 0 THEN (dod - ded*doe/dee)/ac ELSE 0.0 END)/(e+1e-20) AS y FROM c)
SELECT pair, {R('x', 'x_obs')}, {R('y', 'y_obs')}, {R('sqrt(x*x+y*y)', 'rho')}, {R('atan2(y, x)', 'theta')}, {R('atan2(y, x)/pi()', 'theta_over_pi')} FROM t""")
def complex_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(geometry.complex_coords(pairs(spark, sf_dir), ["pair"]), ["pair"])


@query(f"""WITH {PAIRS}, c AS (SELECT pair, doo, sqrt(dee) AS e, (doo + dee - drr)/(2*sqrt(dee)) AS xr FROM q),
t AS (SELECT pair, CASE WHEN e < 1e-20 THEN sqrt(doo)/(e+1e-20) ELSE xr/(e+1e-20) END AS x, CASE WHEN e < 1e-20 THEN 0.0 ELSE sqrt(greatest(doo - xr*xr, 0))/(e+1e-20) END AS y FROM c)
SELECT pair, {R('x', 'x_obs')}, {R('y', 'y_obs')}, {R('sqrt(x*x+y*y)', 'rho')}, {R('atan2(y, x)', 'theta')}, {R('atan2(y, x)/pi()', 'theta_over_pi')} FROM t""")
def triangle_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(geometry.triangle_coords(pairs(spark, sf_dir), ["pair"]), ["pair"])


@query(f"""WITH {PAIRS}, c AS (SELECT pair, d11, (d11 + d12)/sqrt(d11 + 2*d12 + d22) AS along FROM q), t AS (SELECT pair, sqrt(d11) AS l, along, sqrt(greatest(d11 - along*along, 0)) AS ac FROM c)
SELECT pair, {R('l', 'v_l2')}, {R('along', 'v_par')}, {R('ac', 'v_perp')}, {R('sqrt(along*along + ac*ac)/l', 'radius')}, {R('atan2(ac, along)', 'angle')} FROM t""")
def single_variant_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each first single against the axis of its pair's additive effect."""
    from ..functions.vectors import as_double, minus, plus

    v = lambda m: minus(as_double(F.col(m)), as_double(F.col("WT")))
    df = pairs(spark, sf_dir).withColumn("axis", plus(v("M1"), v("M2")))
    return rounded(geometry.single_coords(df, ["pair"], axis="axis"), ["pair"])


@query(f"""WITH {PAIRS}, s AS (SELECT pair, sqrt(sum(power(vo - v2 - v1, 2))) AS raw, sqrt(sum(power(vo - v2 - v1, 2)))/(sqrt(sum(v2*v2) + sum(v1*v1)) + 1e-20) AS singles, sqrt(sum(vo*vo))/(sqrt(sum(power(v2 + v1, 2))) + 1e-20) AS ratio, sqrt(sum(power((v1 + v2) - v1 - v2, 2))) AS zero FROM v GROUP BY pair)
SELECT pair, abs(epi_r_raw - raw) < 1e-6 AND abs(epi_r_raw/(sqrt(d11 + d22) + 1e-20) - singles) < 1e-6 AND abs(sqrt(doo)/(sqrt(dee) + 1e-20) - ratio) < 1e-6 AS swap_symmetric, zero < 1e-6 AS zero_residual FROM q JOIN s USING (pair)""")
def sanity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.sanity(pairs(spark, sf_dir), ["pair"])


@query("""SELECT label, i::INT AS i, round(avg(x), 6) + 0.0 AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY label, i""")
def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token vectors pooled by group, in long form."""
    long = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return long.groupBy("label", "i").agg(r6(F.avg(F.col("x").cast("double"))).alias("mean"))


@query("SELECT vec_id // 4 AS pair, sha256(string_agg(k, '|' ORDER BY role)) AS hash FROM (SELECT vec_id, vec_id % 4 AS role, array_to_string(list_transform(embedding, lambda x: round(x::DOUBLE * 1e4)::BIGINT), ',') AS k FROM embeddings) GROUP BY vec_id // 4 HAVING count(*) = 4")
def case_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of a pair's four vectors, each number in ten-thousandths."""
    text = lambda r: F.array_join(F.transform(F.col(r), lambda x: F.round(x.cast("double") * 1e4).cast("long").cast("string")), ",")
    return pairs(spark, sf_dir).select("pair", F.sha2(F.concat_ws("|", *[text(r) for r in geometry.ROLES]), 256).alias("hash"))


@query("SELECT label % 2 AS source, count(*) AS n, arg_max(len(embedding), 1) AS dim FROM embeddings GROUP BY label % 2")
def majority_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("source", F.col("label") % 2)
    return geometry.majority_dimension(e, ["source"]).join(e.groupBy("source").agg(F.count("*").alias("n")), "source").select("source", "n", F.col("dim").cast("long").alias("dim"))


RESIDUALS = f"{PAIRS}, r AS (SELECT v.pair, i - 1 AS i, vo - v1 - v2 AS x FROM v JOIN q USING (pair) WHERE is_null)"


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.with_dots(pairs(spark, sf_dir)).select("pair", "is_null", "bin", "_rr", F.col("_r").alias("residual"), F.col("_o").alias("obs"), F.col("_e").alias("add"), F.lit("m").alias("model"))


@query(f"WITH {RESIDUALS} SELECT a.i::INT AS i, b.i::INT AS j, count(*) AS n, round(covar_samp(a.x, b.x), 6) + 0.0 AS value FROM r a JOIN r b USING (pair) GROUP BY a.i, b.i")
def null_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample covariance of the null residuals, by cell."""
    r = residuals(spark, sf_dir).where("is_null")
    return calibration.covariance(calibration.gram(r, ["model"], "residual"), ["model"]).select("i", "j", "n", r6(F.col("value")).alias("value"))


@query(f"WITH {RESIDUALS}, va AS (SELECT i, var_samp(x) AS s FROM r GROUP BY i) SELECT pair, round(sqrt(sum(power(vo - v1 - v2, 2)/(s + 1e-3))), 6) + 0.0 AS epi_mahal FROM v JOIN va ON v.i - 1 = va.i GROUP BY pair")
def diagonal_mahalanobis(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = residuals(spark, sf_dir)
    cells = calibration.covariance(calibration.gram(r.where("is_null"), ["model"], "residual"), ["model"], ridge=1e-3).where("i = j")
    # As many numbers as the vectors have.
    held = cells.groupBy("model").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda x: x["value"]).alias("_var"))
    d = r.join(F.broadcast(held), "model").withColumn("epi_mahal", F.sqrt(F.aggregate(F.zip_with("residual", "_var", lambda x, v: x * x / v), F.lit(0.0), lambda s, x: s + x)))
    return rounded(d.select("pair", "epi_mahal"), ["pair"])


@query(f"""WITH {RESIDUALS}, k AS (SELECT i, avg(x) AS m FROM r GROUP BY i), c AS (SELECT pair, r.i, x - m AS x FROM r JOIN k USING (i)), n AS (SELECT count(DISTINCT pair) AS n, max(i) + 1 AS dim FROM c),
s AS (SELECT a.i, b.i AS j, avg(a.x*b.x) AS v FROM c a JOIN c b USING (pair) GROUP BY a.i, b.i), f AS (SELECT sum(v*v) AS frob, sum(v) FILTER (i = j) AS tr FROM s),
h AS (SELECT sum(t*t) AS fourth FROM (SELECT sum(x*x) AS t FROM c GROUP BY pair)), d AS (SELECT n, dim, tr/dim AS mu, (frob - dim*power(tr/dim, 2))/dim AS delta, (fourth/n - frob)/(dim*n) AS beta FROM n, f, h)
SELECT n, dim::BIGINT AS dim, round(mu, 6) AS mu, round(least(beta, delta)/delta, 6) AS alpha FROM d""")
def ledoit_wolf_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = residuals(spark, sf_dir).where("is_null")
    return calibration.shrinkage(r, calibration.gram(r, ["model"], "residual"), ["model"], "residual").select("n", F.col("dim").cast("long").alias("dim"), F.round("mu", 6).alias("mu"), F.round("alpha", 6).alias("alpha"))


@query()
def mahalanobis_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of residual, observed and additive effect under the shrunk null covariance, by distance bin.

    Bins with fewer null pairs than needed use the global matrix; both versions stand in one row.
    """
    r = residuals(spark, sf_dir)
    vectors = {"epi_mahal": "residual", "mahal_obs": "obs", "mahal_add": "add"}
    cells = calibration.binned_fits(r.where("is_null"), "residual", "bin", 20, 1e-6)
    own = F.broadcast(cells.select(F.col("use").alias("bin")).distinct().withColumn("own", F.col("bin")))
    # A row a pair and kind of calibration; both go through the same inverses.
    both = r.join(own, "bin", "left").select("pair", "bin", *vectors.values(), F.explode(F.create_map(F.lit("global"), F.lit(-1), F.lit("binned"), F.coalesce("own", F.lit(-1)))).alias("kind", "use"))
    blocks = spectra.inverse(spectra.in_blocks(cells, ["use"]), ["use"])
    long = spectra.distances(both, ["use"], blocks, vectors, ["pair", "bin", "kind"])
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c))).alias(f"{kind}_{c}")
    out = long.groupBy("pair", "bin").agg(*[of(k, c) for k in ("global", "binned") for c in vectors])
    eps = 1e-20
    for kind in ("global", "binned"):
        obs, add = F.col(f"{kind}_mahal_obs"), F.col(f"{kind}_mahal_add")
        out = out.withColumn(f"{kind}_mahal_ratio", obs / (add + eps)).withColumn(f"{kind}_log_mahal_ratio", F.log((obs + eps) / (add + eps)))
    return out


COVS = f"{PAIRS}, r AS (SELECT pair, i - 1 AS i, vo - v1 - v2 AS x, is_null FROM v JOIN q USING (pair)), c AS (SELECT a.is_null, a.i, b.i AS j, covar_samp(a.x, b.x) AS v FROM r a JOIN r b USING (pair, is_null) GROUP BY a.is_null, a.i, b.i)"


@query(f"WITH {COVS} SELECT is_null, round(power(sum(v) FILTER (i = j), 2)/sum(v*v), 6) AS participation_ratio FROM c GROUP BY is_null")
def participation_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = calibration.covariance(calibration.gram(residuals(spark, sf_dir), ["is_null"], "residual"), ["is_null"])
    return c.groupBy("is_null").agg(F.round(F.pow(F.sum(F.when(F.col("i") == F.col("j"), F.col("value"))), 2) / F.sum(F.col("value") ** 2), 6).alias("participation_ratio"))


@query(f"WITH {COVS}, t AS (SELECT x.v AS a, y.v AS b FROM c x JOIN c y USING (i, j) WHERE x.is_null AND NOT y.is_null) SELECT round(sqrt(sum(power(b - a, 2)))/sqrt(sum(a*a)), 6) AS shift, round(sum(a*b)/sqrt(sum(a*a)*sum(b*b)), 6) AS rv FROM t")
def covariance_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative Frobenius distance and RV coefficient of the signal's covariance against the null's."""
    c = calibration.covariance(calibration.gram(residuals(spark, sf_dir), ["is_null"], "residual"), ["is_null"])
    a = c.where("is_null").select("i", "j", F.col("value").alias("a"))
    t = a.join(c.where("not is_null").select("i", "j", F.col("value").alias("b")), ["i", "j"])
    s = lambda x: F.sum(x)
    return t.agg(F.round(F.sqrt(s((F.col("b") - F.col("a")) ** 2)) / F.sqrt(s(F.col("a") ** 2)), 6).alias("shift"), F.round(s(F.col("a") * F.col("b")) / F.sqrt(s(F.col("a") ** 2) * s(F.col("b") ** 2)), 6).alias("rv"))


RES = f"{PAIRS}, s AS (SELECT *, epi_r_raw - avg(epi_r_raw) OVER (PARTITION BY bin) AS res FROM q)"


@query(f"""WITH {RES}, a AS (SELECT pair, round(res, 6) + 0.0 AS residual, CASE WHEN res < 0 THEN 'corrective' ELSE 'cumulative' END AS direction, abs(res) AS ar FROM s)
SELECT pair, residual, direction, rank() OVER (ORDER BY ar DESC) AS rank, round(100.0*rank() OVER (ORDER BY ar DESC)/count(*) OVER (), 6) AS percentile, rank() OVER (PARTITION BY direction ORDER BY ar DESC) AS dir_rank FROM a""")
def priority_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ranking.priority_scores(scored(spark, sf_dir).withColumn("model", F.lit("m")), "epi_R_raw", "bin", ["model"])
    return df.select("pair", r6(F.col("residual")).alias("residual"), "direction", F.col("rank").cast("long").alias("rank"), F.round("percentile", 6).alias("percentile"), F.col("dir_rank").cast("long").alias("dir_rank"))


@query(f"WITH {PAIRS}, k AS (SELECT quantile_cont(distance, [0, 0.25, 0.5, 0.75, 1]) AS e FROM q), b AS (SELECT greatest(len(list_filter(list_distinct(e), lambda x: x < distance)) - 1, 0)::INT AS bin4, epi_r_raw AS v FROM q, k) SELECT bin4, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v)/sqrt(count(*)), 6) AS sem FROM b GROUP BY bin4")
def quantile_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and standard error by quartile of distance."""
    df = ranking.quantile_bins(scored(spark, sf_dir), "distance", 4, "bin4")
    return df.groupBy("bin4").agg(F.count("*").alias("n"), F.round(F.avg("epi_R_raw"), 6).alias("mean"), F.round(F.stddev("epi_R_raw") / F.sqrt(F.count("*")), 6).alias("sem"))


@query(f"WITH {PAIRS} SELECT floor(log10(distance)*2)::BIGINT AS log_bin, count(*) AS n, round(avg(epi_r_raw), 6) AS mean FROM q GROUP BY 1 HAVING count(*) >= 3")
def distance_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean by log-spaced distance."""
    return scored(spark, sf_dir).groupBy(F.floor(F.log10("distance") * 2).alias("log_bin")).agg(F.count("*").alias("n"), F.round(F.avg("epi_R_raw"), 6).alias("mean")).where("n >= 3")


@query(f"WITH {PAIRS}, t AS (SELECT bin, min(epi_r_raw) AS lo, max(epi_r_raw) AS hi FROM q GROUP BY bin) SELECT pair, bin, round(CASE WHEN hi > lo THEN (epi_r_raw - lo)/(hi - lo) ELSE 0 END, 6) AS scaled FROM q JOIN t USING (bin)")
def minmax_by_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ranking.minmax(scored(spark, sf_dir), "epi_R_raw", ["bin"])
    return df.select("pair", "bin", F.round("scaled", 6).alias("scaled"))


@query(f"WITH {PAIRS}, m AS (SELECT pair, 100.0*(row_number() OVER (ORDER BY epi_r_raw, pair) - 1)/count(*) OVER () AS a, 100.0*(row_number() OVER (ORDER BY lmr, pair) - 1)/count(*) OVER () AS b FROM q) SELECT pair, round((a + b)/2, 6) AS mean_percentile FROM m")
def ensemble_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile ranks under two scores, averaged over pairs that both have."""
    s = scored(spark, sf_dir)
    long = s.select("pair", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("v")) for m in ("epi_R_raw", "log_magnitude_ratio")])).alias("x")).select("pair", "x.*")
    long = ranking.ordinal(long, "v", "pair", ["model"], "r")
    size = long.groupBy("model").agg(F.count("*").alias("n"))
    p = long.join(size, "model").withColumn("p", 100.0 * (F.col("r") - 1) / F.col("n"))
    return p.groupBy("pair").agg(F.countDistinct("model").alias("k"), F.avg("p").alias("m")).where("k = 2").select("pair", F.round("m", 6).alias("mean_percentile"))


@query(f"WITH {PAIRS}, t AS (SELECT epi_r_raw AS t FROM q WHERE pair = 7), b AS (SELECT avg(CASE WHEN epi_r_raw <= t THEN 1.0 ELSE 0 END) AS share, count(*) AS n FROM q, t) SELECT round(share, 6) AS share, round(-log10(greatest(1 - share, 0.5/n)), 6) AS score FROM b")
def target_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the background at or under one pair's score, and its log score with a floor."""
    s = scored(spark, sf_dir).select("pair", "epi_R_raw")
    t = s.where("pair = 7").select(F.col("epi_R_raw").alias("t"))
    b = s.join(F.broadcast(t)).agg(F.avg(F.when(F.col("epi_R_raw") <= F.col("t"), 1.0).otherwise(0.0)).alias("share"), F.count("*").alias("n"))
    return b.select(F.round("share", 6).alias("share"), F.round(-F.log10(F.greatest(1 - F.col("share"), 0.5 / F.col("n"))), 6).alias("score"))


@query(f"WITH {PAIRS}, k AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY epi_r_raw DESC, pair) AS r, count(*) OVER (PARTITION BY bin) AS n FROM q) SELECT pair, bin, r AS rank FROM k WHERE r <= greatest(1, floor(n*0.1))")
def top_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top tenth of each distance bin, at least one."""
    s = ranking.ordinal(scored(spark, sf_dir).select("pair", "bin", (-F.col("epi_R_raw")).alias("down")), "down", "pair", ["bin"])
    size = s.groupBy("bin").agg(F.count("*").alias("n"))
    return s.join(size, "bin").where(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("n") * 0.1))).select("pair", "bin", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {PAIRS}, t AS (SELECT v.i, vo - v1 - v2 AS x FROM v WHERE pair = 3), s AS (SELECT v.pair, abs(sum((vo - v1 - v2)*x)/(sqrt(sum(power(vo - v1 - v2, 2)))*sqrt(sum(x*x)))) AS c FROM v JOIN t USING (i) GROUP BY v.pair) SELECT pair, round(c, 6) AS similarity FROM s WHERE pair <> 3 ORDER BY c DESC LIMIT 10")
def nearest_to_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten residuals nearest to a template's by absolute cosine."""
    from ..functions.vectors import cosine_of, dot

    r = residuals(spark, sf_dir)
    t = r.where("pair = 3").select(F.col("residual").alias("t"), F.col("_rr").alias("tt"))
    s = r.where("pair <> 3").join(F.broadcast(t)).select("pair", F.abs(cosine_of(dot(F.col("residual"), F.col("t")), F.col("_rr"), F.col("tt"))).alias("c"))
    return s.orderBy(F.desc("c")).limit(10).select("pair", F.round("c", 6).alias("similarity"))


@query(f"""WITH {PAIRS}, k AS (SELECT v.pair, v.i, vo - v1 - v2 AS x, bin, row_number() OVER (PARTITION BY v.i, bin ORDER BY md5(v.pair::VARCHAR)) AS r FROM v JOIN q USING (pair)),
c AS (SELECT a.bin, a.pair AS p, b.pair AS q2, abs(sum(a.x*b.x)/(sqrt(sum(a.x*a.x))*sqrt(sum(b.x*b.x)))) AS c FROM k a JOIN k b ON a.bin = b.bin AND a.i = b.i AND a.r < b.r WHERE a.r <= 500 AND b.r <= 500 GROUP BY a.bin, a.pair, b.pair)
SELECT bin, count(*) AS n, round(avg(c), 6) AS coherence, round(avg(CASE WHEN c > 0.3 THEN 1.0 ELSE 0 END), 6) AS above_03 FROM c GROUP BY bin""")
def directional_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute cosine among a seeded sample of residuals per distance bin."""
    from ..functions.vectors import cosine_of, dot

    # 500 a bin is the sample that the measure is defined on.
    w = Window.partitionBy("bin").orderBy(F.md5(F.col("pair").cast("string")))
    s = residuals(spark, sf_dir).select("pair", "bin", "residual", "_rr", F.row_number().over(w).alias("r")).where("r <= 500")
    o = s.select("bin", F.col("residual").alias("x"), F.col("_rr").alias("xx"), F.col("r").alias("r2"))
    c = s.join(o, "bin").where("r < r2").select("bin", F.abs(cosine_of(dot(F.col("residual"), F.col("x")), F.col("_rr"), F.col("xx"))).alias("c"))
    return c.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("c"), 6).alias("coherence"), F.round(F.avg(F.when(F.col("c") > 0.3, 1.0).otherwise(0.0)), 6).alias("above_03"))


@query("SELECT vec_id // 4 AS pair, max(CASE WHEN vec_id % 4 = 0 THEN 1 ELSE 0 END) = 1 AS has_wt, count(DISTINCT vec_id % 4) = 4 AS complete FROM embeddings GROUP BY 1")
def store_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pairs of a store have all four roles."""
    return store(spark, sf_dir).groupBy("pair").agg((F.max(F.when(F.col("role") == "WT", 1).otherwise(0)) == 1).alias("has_wt"), (F.countDistinct("role") == 4).alias("complete"))


@query("SELECT a.vec_id // 4 AS pair FROM embeddings a WHERE vec_id % 4 = 0 AND vec_id // 4 NOT IN (SELECT vec_id // 4 FROM embeddings WHERE label >= 5 AND vec_id % 4 = 3)")
def pairs_to_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs not yet in a store of done ones."""
    s = store(spark, sf_dir)
    return s.where("role = 'WT'").select("pair").distinct().join(s.where("role = 'M12' and label >= 5").select("pair"), "pair", "left_anti")
