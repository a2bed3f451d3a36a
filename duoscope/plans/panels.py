"""Queries on labels, summaries, ranks and tests of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import identifiers as ids
from ..operators import ranking
from ..operators import statistics as st
from .standins import CALLS, CLINICAL, GRADED, PAIRS, calls, clinical, graded, r6, scored, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {CALLS} SELECT CASE WHEN cls = 'R' THEN 'significant' WHEN depth >= 25 THEN 'tcga_null' ELSE 'germline_null' END AS label, count(*) AS n FROM calls GROUP BY 1")
def split_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set labels by a ladder of rules."""
    label = F.when(F.col("cls") == "R", "significant").when(F.col("depth") >= 25, "tcga_null").otherwise("germline_null")
    return calls(spark, sf_dir).groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS track, p_name AS name FROM part WHERE contains(lower(p_name), 'a') OR p_name IN ('part 7')")
def selected_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks by a part of their name in any case, or by exact name."""
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("track"), F.col("p_name").alias("name"))
    return t.where(F.lower("name").contains("a") | F.col("name").isin("part 7"))


@query(f"WITH {CALLS} SELECT gene, count(*) AS n FROM calls WHERE NOT (gene = 'Brand#11' OR gene LIKE 'Brand#2%' OR gene LIKE 'Brand#5%') GROUP BY gene")
def genes_not_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of genes outside an exclusion list of names and prefixes."""
    return calls(spark, sf_dir).where(~ids.excluded_gene(F.col("gene"), ["Brand#11"], ["Brand#2", "Brand#5"])).groupBy("gene").agg(F.count("*").alias("n"))


@query(f"WITH {CALLS}, v AS (SELECT gene, CASE WHEN cls = 'R' THEN ref || alt ELSE ref END AS ref, CASE WHEN cls = 'A' THEN ref ELSE alt END AS alt FROM calls) SELECT gene, count(*) AS n FROM v WHERE length(ref) = 1 AND length(alt) = 1 AND ref <> alt GROUP BY gene")
def snv_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that change one base into another, among longer ones and ones that change nothing."""
    c = calls(spark, sf_dir).select("gene", F.when(F.col("cls") == "R", F.concat("ref", "alt")).otherwise(F.col("ref")).alias("r"), F.when(F.col("cls") == "A", F.col("ref")).otherwise(F.col("alt")).alias("a"))
    return c.where(ids.is_snv(F.col("r"), F.col("a"))).groupBy("gene").agg(F.count("*").alias("n"))


@query(f"WITH {CALLS}, g AS (SELECT gene, count(DISTINCT case_id) AS n_gene FROM calls GROUP BY gene), b AS (SELECT gene, project, count(DISTINCT case_id) AS n_both FROM calls GROUP BY 1, 2) SELECT gene, project, n_both, round(n_both/n_gene::DOUBLE, 6) AS cond FROM b JOIN g USING (gene) WHERE n_both >= 3 AND n_both/n_gene::DOUBLE >= 0.2 ORDER BY cond DESC, n_both DESC")
def selected_by_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with enough shared cases and a high conditional share, highest first."""
    c = calls(spark, sf_dir).select("gene", "project", "case_id").distinct()
    g = c.groupBy("gene").agg(F.countDistinct("case_id").alias("n_gene"))
    b = c.groupBy("gene", "project").agg(F.count("*").alias("n_both")).join(g, "gene").withColumn("cond", F.col("n_both") / F.col("n_gene"))
    return b.where("n_both >= 3 and cond >= 0.2").select("gene", "project", "n_both", F.round("cond", 6).alias("cond")).orderBy(F.desc("cond"), F.desc("n_both"))


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every source and label."""
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


@query(f"WITH {PAIRS}, b AS (SELECT avg(epi_r_raw) AS m, stddev_samp(epi_r_raw) AS s FROM q WHERE is_null) SELECT floor(log10(distance)*2)::BIGINT AS log_bin, count(*) AS n, round(avg((epi_r_raw - m)/s), 6) + 0.0 AS mean_z, round(median(abs(sqrt(d11) - sqrt(d22))), 6) AS asymmetry FROM q, b GROUP BY 1 HAVING count(*) >= 10")
def effect_by_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean effect against the null, and median asymmetry of the singles, by log-spaced distance."""
    from ..operators.geometry import pair_metrics
    from .standins import pairs

    m = pair_metrics(pairs(spark, sf_dir), ["distance", "is_null"])
    b = m.where("is_null").agg(F.avg("epi_R_raw").alias("m"), F.stddev("epi_R_raw").alias("s"))
    g = m.join(F.broadcast(b)).groupBy(F.floor(F.log10("distance") * 2).alias("log_bin"))
    gap = F.abs(F.col("len_WT_M1") - F.col("len_WT_M2"))
    return g.agg(F.count("*").alias("n"), r6(F.avg((F.col("epi_R_raw") - F.col("m")) / F.col("s"))).alias("mean_z"), F.round(F.percentile(gap, 0.5), 6).alias("asymmetry")).where("n >= 10")


@query(f"WITH {GRADED}, c AS (SELECT source, corr(value, lines) AS a, corr(value, other) AS b FROM graded GROUP BY source) SELECT source, round(CASE WHEN abs(coalesce(a, 0)) >= abs(coalesce(b, 0)) THEN a ELSE b END, 6) + 0.0 AS r, CASE WHEN abs(coalesce(a, 0)) >= abs(coalesce(b, 0)) THEN 'lines' ELSE 'other' END AS metric FROM c")
def best_of_two_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source the stronger of two correlations, and which one that is; an absent one never wins."""
    c = graded(spark, sf_dir).groupBy("source").agg(F.corr("value", "lines").alias("a"), F.corr("value", "other").alias("b"))
    size = lambda x: F.abs(F.coalesce(F.nanvl(F.col(x), F.lit(None)), F.lit(0.0)))
    first = size("a") >= size("b")
    return c.select("source", r6(F.when(first, F.col("a")).otherwise(F.col("b"))).alias("r"), F.when(first, "lines").otherwise("other").alias("metric"))


@query(f"""WITH {GRADED}, m AS (SELECT source, avg(value) AS a, avg(lines) AS b, avg(other) AS c FROM graded GROUP BY source), k AS (SELECT source, rank() OVER (ORDER BY a DESC) AS ra, rank() OVER (ORDER BY b DESC) AS rb, rank() OVER (ORDER BY c DESC) AS rc, (a > 2000)::INT + (b > 10)::INT + (c > 48)::INT AS passed FROM m)
SELECT source, ra AS rank_value, rb AS rank_lines, rc AS rank_other, round((ra + rb + rc)/3.0, 6) AS mean_rank, passed FROM k""")
def model_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of each source under three tests, their mean, and how many it passes. One row a source."""
    m = graded(spark, sf_dir).groupBy("source").agg(*[F.avg(c).alias(c) for c in ("value", "lines", "other")])
    ranks = [F.rank().over(Window.orderBy(F.desc(c))).cast("long").alias(f"rank_{c}") for c in ("value", "lines", "other")]
    passed = sum(((F.col(c) > x).cast("int") for c, x in (("value", 2000), ("lines", 10), ("other", 48))), F.lit(0))
    k = m.select("source", *ranks, passed.alias("passed"))
    return k.withColumn("mean_rank", F.round((F.col("rank_value") + F.col("rank_lines") + F.col("rank_other")) / 3.0, 6))


@query(f"WITH {GRADED}, k AS (SELECT lang, good, row_number() OVER (PARTITION BY lang ORDER BY value, doc_id) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM graded) SELECT lang, least(r // greatest(n // 20, 1), 19) AS bin, count(*) AS n, round(avg(good::INT), 6) AS share FROM k GROUP BY 1, 2")
def rank_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty bins of equal count by rank, the remainder in the last, and the share of a flag in each."""
    t = ranking.rank_bins(graded(spark, sf_dir), "value", "doc_id", "good", ["lang"])
    return t.select("lang", "bin", "n", F.round(F.col("marked") / F.col("n"), 6).alias("share"))


CELLS = "c AS (SELECT l_linenumber AS i, l_quantity::INT % 9 + 1 AS j, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2)"


@query(f"WITH {CELLS}, t AS (SELECT v AS t FROM c WHERE i = 2 AND j = 5) SELECT count(*) AS cells, round(avg(CASE WHEN v < t THEN 1.0 ELSE 0 END)*100, 6) AS percentile FROM c, t WHERE i < j")
def cell_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the upper triangle of a map under one of its cells."""
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("i"), (F.col("l_quantity").cast("int") % 9 + 1).alias("j")).agg(F.avg("l_extendedprice").alias("v"))
    t = c.where("i = 2 and j = 5").select(F.col("v").alias("t"))
    return c.where("i < j").join(F.broadcast(t)).agg(F.count("*").alias("cells"), F.round(F.avg(F.when(F.col("v") < F.col("t"), 1.0).otherwise(0.0)) * 100, 6).alias("percentile"))


@query(f"WITH {CALLS}, k AS (SELECT gene, pos, ((pos*7919 + case_id*31) % 1000)/1000.0 AS p, case_id FROM calls), r AS (SELECT *, row_number() OVER (PARTITION BY gene, pos ORDER BY p, case_id) AS r FROM k WHERE p < 0.05) SELECT gene, pos, round(p, 6)::DOUBLE AS p, case_id FROM r WHERE r = 1")
def nominal_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nominally significant rows, the best one of each pair."""
    k = calls(spark, sf_dir).select("gene", "pos", (((F.col("pos") * 7919 + F.col("case_id") * 31) % 1000) / 1000.0).alias("p"), "case_id").where("p < 0.05")
    return ranking.first_per_key(k, ["gene", "pos"], ["p", "case_id"]).select("gene", "pos", F.round("p", 6).alias("p"), "case_id")


@query("WITH a AS (SELECT DISTINCT p_brand AS gene FROM part WHERE p_size > 45), b AS (SELECT DISTINCT p_brand AS gene FROM part WHERE p_size < 3) SELECT gene, gene IN (SELECT gene FROM a) AS in_first, gene IN (SELECT gene FROM b) AS in_second FROM (SELECT gene FROM a UNION SELECT gene FROM b)")
def gene_set_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of two gene sets, and which of them holds each gene."""
    p = table(spark, sf_dir, "part").where("p_size > 45 or p_size < 3")
    return p.groupBy(F.col("p_brand").alias("gene")).agg((F.count_if(F.col("p_size") > 45) > 0).alias("in_first"), (F.count_if(F.col("p_size") < 3) > 0).alias("in_second"))


@query("SELECT doc_id, translate(translate(upper(substr(md5(text), 1, 12)), '0123456789', 'ACGUACGUAC'), 'Uu', 'Tt') AS dna FROM documents WHERE text IS NOT NULL")
def rna_to_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    rna = F.translate(F.upper(F.substring(F.md5("text"), 1, 12)), "0123456789", "ACGUACGUAC")
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", ids.to_dna(rna).alias("dna"))


@query(f"WITH {PAIRS}, b AS (SELECT CASE WHEN distance >= 100000 THEN 3 WHEN distance >= 10000 THEN 2 WHEN distance >= 1000 THEN 1 ELSE 0 END AS bin4 FROM q) SELECT bin4, count(*) AS n FROM b GROUP BY 1")
def half_open_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by fixed bins of distance, the last one open."""
    return scored(spark, sf_dir).groupBy(ranking.half_open_bin(F.col("distance"), [0, 1000, 10_000, 100_000]).alias("bin4")).agg(F.count("*").alias("n"))


@query(f"WITH {CALLS}, v AS (SELECT DISTINCT gene, chrom, pos, ref, alt, case_id % 40 - 20 AS step, CASE WHEN cls = 'N' THEN 'N' WHEN cls = 'A' THEN 'P' END AS strand FROM calls), t AS (SELECT *, coalesce(strand, 'P') AS s, pos + step AS other FROM v), u AS (SELECT *, gene || ':' || chrom || ':' || pos || ':' || ref || ':' || alt || ':' || s AS one, gene || ':' || chrom || ':' || other || ':' || alt || ':' || ref || ':' || s AS two FROM t) SELECT CASE WHEN pos <= other THEN one || '|' || two ELSE two || '|' || one END AS key, count(*) AS n FROM u GROUP BY 1")
def pair_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair identifiers, lower position first, forward where no strand is given."""
    c = calls(spark, sf_dir).select("gene", "chrom", "pos", "ref", "alt", (F.col("case_id") % 40 - 20).alias("step"), F.when(F.col("cls") == "N", "N").when(F.col("cls") == "A", "P").alias("strand")).distinct()
    key = ids.pair_key(*[F.col(x) for x in ("gene", "chrom", "pos", "ref", "alt")], F.col("pos") + F.col("step"), F.col("alt"), F.col("ref"), F.col("strand"))
    return c.groupBy(key.alias("key")).agg(F.count("*").alias("n"))


@query("SELECT o_custkey AS case_id, round(greatest(max(date_diff('day', DATE '1992-01-01', o_orderdate::DATE)), max(CASE WHEN o_orderstatus = 'F' THEN date_diff('day', DATE '1991-01-01', o_orderdate::DATE) END))/365.0, 6)::DOUBLE AS duration, (max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)) AS event FROM orders GROUP BY 1")
def follow_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years to the last of several dates, and whether the deciding one was seen; absent dates are passed over."""
    o = table(spark, sf_dir, "orders")
    days = lambda start: F.datediff("o_orderdate", F.lit(start).cast("date"))
    dead = F.col("o_orderstatus") == "F"
    g = o.groupBy(F.col("o_custkey").alias("case_id")).agg(F.max(days("1992-01-01")).alias("seen"), F.max(F.when(dead, days("1991-01-01"))).alias("died"))
    return g.select("case_id", F.round(F.greatest("seen", "died") / 365.0, 6).alias("duration"), F.col("died").isNotNull().cast("int").alias("event"))


@query(f"WITH {CALLS}, s AS (SELECT case_id, gene, list_sort(list(DISTINCT pos)) AS p FROM calls GROUP BY 1, 2) SELECT case_id, gene, len(p)::INT AS n, array_to_string(p, ',') AS positions FROM s WHERE len(p) >= 2")
def position_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of each case and gene with two or more of them."""
    s = calls(spark, sf_dir).groupBy("case_id", "gene").agg(F.sort_array(F.collect_set("pos")).alias("p")).where(F.size("p") >= 2)
    return s.select("case_id", "gene", F.size("p").alias("n"), F.array_join("p", ",").alias("positions"))


@query(f"WITH {CALLS}, m AS (SELECT case_id, max((pos % 50 = 1)::INT) AS a, max((pos % 50 = 2)::INT) AS b FROM calls GROUP BY 1) SELECT CASE WHEN a + b = 2 THEN 'both' WHEN a = 1 THEN 'only1' WHEN b = 1 THEN 'only2' ELSE 'neither' END AS part, count(*) AS n FROM m GROUP BY 1")
def two_mutation_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases by which of two mutations they carry."""
    m = calls(spark, sf_dir).groupBy("case_id").agg(F.max(F.col("pos") % 50 == 1).alias("a"), F.max(F.col("pos") % 50 == 2).alias("b"))
    part = F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "only1").when(F.col("b"), "only2").otherwise("neither")
    return m.groupBy(part.alias("part")).agg(F.count("*").alias("n"))


@query(f"WITH {CALLS}, n AS (SELECT chrom, ref, alt, count(*) AS n FROM calls GROUP BY 1, 2, 3) SELECT chrom, ref, round(sum(n) FILTER (alt = 'A')/sum(n), 6) AS \"A\", round(sum(n) FILTER (alt = 'C')/sum(n), 6) AS \"C\", round(sum(n) FILTER (alt = 'G')/sum(n), 6) AS \"G\", round(sum(n) FILTER (alt = 'T')/sum(n), 6) AS \"T\" FROM n GROUP BY 1, 2")
def conditional_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each base given the reference base, as columns."""
    n = calls(spark, sf_dir).groupBy("chrom", "ref").pivot("alt", ["A", "C", "G", "T"]).agg(F.count("pos"))
    total = sum((F.coalesce(F.col(b), F.lit(0)) for b in "ACGT"), F.lit(0))
    return n.select("chrom", "ref", *[F.round(F.col(b) / total, 6).alias(b) for b in "ACGT"])


@query(f"WITH {CALLS} SELECT project, count(*) FILTER (cls = 'A') AS \"A\", count(*) FILTER (cls = 'N') AS \"N\", count(*) FILTER (cls = 'R') AS \"R\" FROM calls GROUP BY 1")
def labelled_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map in long form as a matrix with labels."""
    return calls(spark, sf_dir).groupBy("project").pivot("cls", ["A", "N", "R"]).agg(F.count("pos")).na.fill(0)


RANKED = "rank() OVER (PARTITION BY {0} ORDER BY {1}) + (count(*) OVER (PARTITION BY {0}, {1}) - 1)/2.0"


@query(f"""WITH {GRADED}, t AS (SELECT lang, good, lines + 0.0 AS v, row_number() OVER (PARTITION BY lang ORDER BY value DESC, doc_id) <= greatest(1, floor(count(*) OVER (PARTITION BY lang)*0.1)) AS top FROM graded), r AS (SELECT *, {RANKED.format('lang', 'v')} AS r FROM t)
SELECT lang, count(*) FILTER (top) AS n_top, round(avg(v) FILTER (top)/avg(v) FILTER (NOT top), 6) AS ratio, round(avg(good::INT) FILTER (top), 6) AS share_top, round(avg(good::INT) FILTER (NOT top), 6) AS share_rest, sum(r) FILTER (top) - count(*) FILTER (top)*(count(*) FILTER (top) + 1)/2.0 AS u FROM r GROUP BY lang""")
def depletion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top tenth by score against the rest: ratio of means, shares of a flag, rank sum."""
    w = Window.partitionBy("lang")
    g = graded(spark, sf_dir).withColumn("top", F.row_number().over(w.orderBy(F.desc("value"), "doc_id")) <= F.greatest(F.lit(1), F.floor(F.count("*").over(w) * 0.1)))
    u = st.mann_whitney(g, "lines", "top", ["lang"]).select("lang", "u")
    of = lambda c, top: F.avg(F.when(F.col("top") == top, F.col(c).cast("double")))
    g = g.withColumn("flag", F.col("good").cast("int"))
    s = g.groupBy("lang").agg(F.count_if("top").alias("n_top"), F.round(of("lines", True) / of("lines", False), 6).alias("ratio"), F.round(of("flag", True), 6).alias("share_top"), F.round(of("flag", False), 6).alias("share_rest"))
    return s.join(u, "lang")


@query(f"""WITH {PAIRS}, s AS (SELECT pair, label % 3 AS set3, epi_r_raw - avg(epi_r_raw) OVER (PARTITION BY bin) AS v FROM q), dg AS (SELECT *, CASE WHEN v < 0 THEN 'corrective' ELSE 'cumulative' END AS direction, set3 = 0 AS first FROM s WHERE set3 < 2), r AS (SELECT *, {RANKED.format('direction', 'v')} AS r FROM dg)
SELECT direction, count(*) FILTER (first) AS n1, count(*) FILTER (NOT first) AS n2, round(avg(v) FILTER (first), 6) + 0.0 AS mean1, round(avg(v) FILTER (NOT first), 6) + 0.0 AS mean2, round(corr(v, pair), 6) + 0.0 AS r_pair FROM r GROUP BY direction""")
def directional_asymmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals of two sets and a correlation, each direction on its own."""
    s = ranking.residualise(scored(spark, sf_dir), "epi_R_raw", ["bin"], "v").withColumn("set3", F.col("label") % 3).where("set3 < 2")
    s = s.withColumn("direction", F.when(F.col("v") < 0, "corrective").otherwise("cumulative")).withColumn("first", F.col("set3") == 0)
    of = lambda first: r6(F.avg(F.when(F.col("first") == first, F.col("v"))))
    return s.groupBy("direction").agg(F.count_if("first").alias("n1"), F.count_if(~F.col("first")).alias("n2"), of(True).alias("mean1"), of(False).alias("mean2"), r6(F.corr("v", "pair")).alias("r_pair"))


@query(f"WITH {PAIRS}, k AS (SELECT pair, label = 1 AS mine, row_number() OVER (ORDER BY epi_r_raw DESC, pair) <= floor(count(*) OVER ()*0.1) AS top FROM q), c AS (SELECT count(*) FILTER (mine AND top) AS a, count(*) FILTER (NOT mine AND top) AS b, count(*) FILTER (mine AND NOT top) AS c, count(*) FILTER (NOT mine AND NOT top) AS d FROM k) SELECT a, b, c, d, round((a + 0.5)*(d + 0.5)/((b + 0.5)*(c + 0.5)), 6) AS odds FROM c")
def tail_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source among the highest tenth against the rest, as a table of four and its odds ratio.

    Values are counted, the tenth ends at a value, and of the rows of that value the first by id fall in.
    """
    s = scored(spark, sf_dir).select("pair", (-F.col("epi_R_raw")).alias("down"), (F.col("label") == 1).alias("mine"))
    c = st.tails(s, "down", "mine", "pair", [10]).select("a", "b", "c", "d")
    odds = (F.col("a") + 0.5) * (F.col("d") + 0.5) / ((F.col("b") + 0.5) * (F.col("c") + 0.5))
    return c.select("*", F.round(odds, 6).alias("odds"))


@query(f"WITH {CALLS}, {CLINICAL}, m AS (SELECT case_id, max((gene = 'Brand#11')::INT) AS a, max((gene = 'Brand#22')::INT) AS b FROM calls GROUP BY 1) SELECT CASE WHEN a = 1 AND b = 1 THEN 3 WHEN a = 1 THEN 1 WHEN b = 1 THEN 2 ELSE 0 END AS grp, count(*) AS n, sum(event)::BIGINT AS events, round(median(duration), 6)::DOUBLE AS median FROM clinical LEFT JOIN m USING (case_id) GROUP BY 1")
def two_gene_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases by which of two genes is hit: neither, one, the other, both."""
    m = calls(spark, sf_dir).where(F.col("gene").isin("Brand#11", "Brand#22")).groupBy("case_id").agg(F.max((F.col("gene") == "Brand#11").cast("int")).alias("a"), F.max(2 * (F.col("gene") == "Brand#22").cast("int")).alias("b"))
    g = clinical(spark, sf_dir).join(m, "case_id", "left").withColumn("grp", F.coalesce(F.col("a") + F.col("b"), F.lit(0)))
    return g.groupBy("grp").agg(F.count("*").alias("n"), F.sum("event").alias("events"), F.round(F.percentile("duration", 0.5), 6).alias("median"))


@query(f"WITH {GRADED} SELECT source, round(median(value) FILTER (good), 6) AS median_good, round(median(value) FILTER (NOT good), 6) AS median_other, count(*) FILTER (good) AS n_good, count(*) FILTER (NOT good) AS n_other FROM graded GROUP BY source HAVING count(*) FILTER (good) >= 5 AND count(*) FILTER (NOT good) >= 5")
def effect_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of two groups by model, where each has five rows or more."""
    of = lambda c: F.round(F.percentile(F.when(c, F.col("value")), 0.5), 6)
    g = graded(spark, sf_dir).groupBy("source").agg(of(F.col("good")).alias("median_good"), of(~F.col("good")).alias("median_other"), F.count_if("good").alias("n_good"), F.count_if(~F.col("good")).alias("n_other"))
    return g.where("n_good >= 5 and n_other >= 5")


@query(f"WITH {PAIRS}, k AS (SELECT quantile_cont(distance, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS e FROM q), b AS (SELECT greatest(len(list_filter(list_distinct(e), lambda x: x < distance)) - 1, 0)::INT AS quintile, epi_r_raw AS v, is_null FROM q, k) SELECT quintile, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v)/sqrt(count(*)), 6) AS sem, round(avg(is_null::INT), 6) AS share FROM b GROUP BY 1")
def quintile_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, standard error and share of a set by quintile."""
    q = ranking.quantile_bins(scored(spark, sf_dir), "distance", 5, "quintile")
    return q.groupBy("quintile").agg(F.count("*").alias("n"), F.round(F.avg("epi_R_raw"), 6).alias("mean"), F.round(F.stddev("epi_R_raw") / F.sqrt(F.count("*")), 6).alias("sem"), F.round(F.avg(F.col("is_null").cast("int")), 6).alias("share"))
