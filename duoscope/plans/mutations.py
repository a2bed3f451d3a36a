"""Queries on mutation calls: filters, counts, co-occurrence and position pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.bands import band_join, combinations, interval_join, near_join
from ..operators.ranking import first_per_key
from ..operators.statistics import hypergeometric_tail
from .standins import CALLS, calls, r6, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


SOUND = "depth >= 15 AND coalesce(alt_count, 0) >= 15"


@query(f"WITH {CALLS} SELECT case_id, gene, pos, round(alt_count/greatest(depth, 1), 6) AS vaf FROM calls WHERE {SOUND} AND alt_count/greatest(depth, 1) >= 0.10 AND project IN ('BUILDING', 'MACHINERY') AND cls <> 'N'")
def filtered_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth, allele fraction, project and class filters."""
    c = calls(spark, sf_dir).where(SOUND).where(F.col("project").isin("BUILDING", "MACHINERY") & (F.col("cls") != "N"))
    vaf = F.col("alt_count") / F.greatest(F.col("depth"), F.lit(1))
    return c.where(vaf >= 0.10).select("case_id", "gene", "pos", F.round(vaf, 6).alias("vaf"))


@query(f"WITH {CALLS}, t AS (SELECT gene FROM calls GROUP BY gene ORDER BY count(*) DESC, gene LIMIT 5) SELECT gene, count(*) AS n FROM calls WHERE gene NOT IN (SELECT gene FROM t) GROUP BY gene")
def without_top_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls outside the five most mutated genes."""
    c = calls(spark, sf_dir)
    n = c.groupBy("gene").agg(F.count("*").alias("n"))
    top = n.orderBy(F.desc("n"), "gene").limit(5)
    return n.join(F.broadcast(top.select("gene")), "gene", "left_anti")


@query(f"WITH {CALLS} SELECT gene, pos, count(DISTINCT case_id) AS n_cases FROM calls WHERE pos BETWEEN 100 AND 400 AND NOT regexp_matches(gene, '^Brand#1') GROUP BY gene, pos")
def position_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = calls(spark, sf_dir).where(F.col("pos").between(100, 400) & ~F.col("gene").rlike("^Brand#1"))
    return c.groupBy("gene", "pos").agg(F.countDistinct("case_id").alias("n_cases"))


@query(f"WITH {CALLS} SELECT project, count(DISTINCT case_id) AS patients, count(*) AS events, count(DISTINCT gene) AS genes FROM calls GROUP BY project")
def project_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).groupBy("project").agg(F.countDistinct("case_id").alias("patients"), F.count("*").alias("events"), F.countDistinct("gene").alias("genes"))


@query(f"WITH {CALLS} SELECT gene, project, count(DISTINCT case_id) AS patients, count(*) AS events FROM calls GROUP BY gene, project")
def gene_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).groupBy("gene", "project").agg(F.countDistinct("case_id").alias("patients"), F.count("*").alias("events"))


@query(f"WITH {CALLS} SELECT case_id, count(*) AS burden FROM calls GROUP BY case_id")
def mutation_burden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).groupBy("case_id").agg(F.count("*").alias("burden"))


@query(f"WITH {CALLS}, f AS (SELECT case_id, max((gene = 'Brand#11')::INT) AS a, max((gene = 'Brand#22')::INT) AS b FROM calls GROUP BY case_id) SELECT case_id, a, b, CASE WHEN a = 1 AND b = 1 THEN 'both' WHEN a = 1 THEN 'only_a' WHEN b = 1 THEN 'only_b' ELSE 'neither' END AS part FROM f")
def gene_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patients by gene presence, and their part of the two-gene partition."""
    names = ["Brand#11", "Brand#22"]
    m = calls(spark, sf_dir).groupBy("case_id").pivot("gene", names).agg(F.lit(1)).fillna(0, names)
    a, b = (F.coalesce(F.col(f"`{n}`"), F.lit(0)) for n in names)
    part = F.when((a == 1) & (b == 1), "both").when(a == 1, "only_a").when(b == 1, "only_b").otherwise("neither")
    return m.select("case_id", a.alias("a"), b.alias("b"), part.alias("part"))


@query(f"WITH {CALLS} SELECT case_id, count(DISTINCT pos) AS n, sha256(string_agg(DISTINCT gene || ':' || chrom || ':' || pos || ':' || ref || ':' || alt, '|' ORDER BY gene || ':' || chrom || ':' || pos || ':' || ref || ':' || alt)) AS ids FROM calls GROUP BY case_id")
def patient_mutation_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each patient's sorted distinct mutation identifiers, joined and digested."""
    m = F.concat_ws(":", "gene", "chrom", F.col("pos").cast("string"), "ref", "alt")
    return calls(spark, sf_dir).groupBy("case_id").agg(F.countDistinct("pos").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_set(m)), "|"), 256).alias("ids"))


@query(f"""WITH {CALLS}, f AS (SELECT gene, pos, alt_count/greatest(depth, 1) AS vaf, depth, cls FROM calls)
SELECT gene, pos, count(*) AS n, round(quantile_cont(vaf, 0.5), 4) AS median_vaf, round(coalesce(stddev_samp(vaf), 0), 4) AS std_vaf, round(avg((cls = 'R')::INT), 3) AS flagged, round(quantile_cont(depth, 0.5), 1) AS median_depth,
mode(cls ORDER BY cls) AS modal_class FROM f GROUP BY gene, pos""")
def position_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality statistics and modal class of every position."""
    c = calls(spark, sf_dir).withColumn("vaf", F.col("alt_count") / F.greatest(F.col("depth"), F.lit(1)))
    return c.groupBy("gene", "pos").agg(
        F.count("*").alias("n"), F.round(F.percentile("vaf", 0.5), 4).alias("median_vaf"), F.round(F.coalesce(F.stddev("vaf"), F.lit(0.0)), 4).alias("std_vaf"),
        F.round(F.avg((F.col("cls") == "R").cast("int")), 3).alias("flagged"), F.round(F.percentile("depth", 0.5), 1).alias("median_depth"), F.mode("cls", True).alias("modal_class"),
    )


SQL["position_quality"] = SQL["position_quality"].replace("mode(cls ORDER BY cls) AS modal_class FROM f GROUP BY gene, pos", "(SELECT cls FROM f g WHERE g.gene = f.gene AND g.pos = f.pos GROUP BY cls ORDER BY count(*) DESC, cls LIMIT 1) AS modal_class FROM f GROUP BY gene, pos")

GROUPS = f"{CALLS}, s AS (SELECT DISTINCT case_id, gene, pos FROM calls), k AS (SELECT case_id, gene FROM s GROUP BY case_id, gene HAVING count(*) BETWEEN 2 AND 20), w AS (SELECT s.* FROM s JOIN k USING (case_id, gene)), pp AS (SELECT a.gene, a.pos AS pos1, b.pos AS pos2, count(*) AS n_both FROM w a JOIN w b ON a.case_id = b.case_id AND a.gene = b.gene AND b.pos - a.pos BETWEEN 1 AND 500 GROUP BY 1, 2, 3)"


def position_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = calls(spark, sf_dir).select("case_id", "gene", "pos").distinct()
    n = F.count("*").over(Window.partitionBy("case_id", "gene"))
    w = s.withColumn("n", n).where(F.col("n").between(2, 20)).drop("n")
    p = band_join(w.withColumnRenamed("pos", "pos1"), w.withColumnRenamed("pos", "pos2"), ["case_id", "gene"], "pos1", "pos2", 500)
    return p.groupBy("gene", "pos1", "pos2").agg(F.count("*").alias("n_both"))


@query(f"WITH {GROUPS} SELECT * FROM pp WHERE n_both BETWEEN 2 AND 500")
def within_gene_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position pairs that two or more patients share, from patient-gene groups of 2 to 20 positions."""
    return position_pairs(spark, sf_dir).where("n_both between 2 and 500")


@query(f"""WITH {GROUPS}, gn AS (SELECT gene, count(DISTINCT case_id) AS n FROM s GROUP BY gene), pn AS (SELECT gene, pos, count(*) AS c FROM s GROUP BY gene, pos),
t AS (SELECT pp.gene, pos1, pos2, n_both, x.c AS n1, y.c AS n2, n, greatest(x.c*y.c/n::DOUBLE, 0.001) AS e FROM pp JOIN gn USING (gene) JOIN pn x ON x.gene = pp.gene AND x.pos = pos1 JOIN pn y ON y.gene = pp.gene AND y.pos = pos2 WHERE n_both >= 2 AND n >= 5),
h AS (SELECT *, unnest(range(greatest(n_both, n1 + n2 - n, 0)::BIGINT, (least(n1, n2) + 1)::BIGINT)) AS j FROM t WHERE n_both/e >= 1)
SELECT gene, pos1, pos2, n_both, n1, n2, n, round(n_both/e, 6) AS oe, round(least(sum(exp(lgamma(n1+1.0)-lgamma(j+1.0)-lgamma(n1-j+1.0)+lgamma(n-n1+1.0)-lgamma(n2-j+1.0)-lgamma(n-n1-n2+j+1.0)-lgamma(n+1.0)+lgamma(n2+1.0)+lgamma(n-n2+1.0))), 1.0), 6) + 0.0 AS p FROM h GROUP BY gene, pos1, pos2, n_both, n1, n2, n, e""")
def observed_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed over expected sharing of two positions and Fisher's one-sided p."""
    s = calls(spark, sf_dir).select("case_id", "gene", "pos").distinct()
    gn = s.groupBy("gene").agg(F.countDistinct("case_id").alias("n")).where("n >= 5")
    pn = s.groupBy("gene", "pos").agg(F.count("*").alias("c"))
    t = position_pairs(spark, sf_dir).where("n_both >= 2").join(gn, "gene").join(pn.select("gene", F.col("pos").alias("pos1"), F.col("c").alias("n1")), ["gene", "pos1"]).join(pn.select("gene", F.col("pos").alias("pos2"), F.col("c").alias("n2")), ["gene", "pos2"])
    t = t.withColumn("oe", F.col("n_both") / F.greatest(F.col("n1") * F.col("n2") / F.col("n"), F.lit(0.001))).where("oe >= 1")
    t = hypergeometric_tail(t, "n", "n1", "n2", "n_both")
    return t.select("gene", "pos1", "pos2", "n_both", "n1", "n2", "n", F.round("oe", 6).alias("oe"), r6(F.col("p")).alias("p"))


@query(f"WITH {CALLS}, s AS (SELECT DISTINCT case_id, chrom, gene, pos FROM calls WHERE {SOUND}) SELECT a.case_id, a.chrom, a.gene AS gene1, b.gene AS gene2, a.pos AS pos1, b.pos AS pos2 FROM s a JOIN s b ON a.case_id = b.case_id AND a.chrom = b.chrom AND b.pos - a.pos BETWEEN 1 AND 100")
def case_doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutations of one case and chromosome within 100 positions."""
    s = calls(spark, sf_dir).where(SOUND).select("case_id", "chrom", "gene", "pos").distinct()
    a, b = s.withColumnsRenamed({"gene": "gene1", "pos": "pos1"}), s.withColumnsRenamed({"gene": "gene2", "pos": "pos2"})
    return band_join(a, b, ["case_id", "chrom"], "pos1", "pos2", 100).select("case_id", "chrom", "gene1", "gene2", "pos1", "pos2")


CO = f"""{CALLS}, s AS (SELECT DISTINCT case_id, chrom, gene, pos FROM calls WHERE {SOUND}), u AS (SELECT DISTINCT case_id, gene, pos FROM calls), un AS (SELECT gene, pos, count(*) AS c FROM u GROUP BY gene, pos),
pr AS (SELECT DISTINCT a.gene AS gene1, b.gene AS gene2, a.pos AS pos1, b.pos AS pos2 FROM s a JOIN s b ON a.case_id = b.case_id AND a.chrom = b.chrom AND b.pos - a.pos BETWEEN 1 AND 100),
bo AS (SELECT gene1, gene2, pos1, pos2, count(*) AS n_both FROM pr JOIN u x ON x.gene = gene1 AND x.pos = pos1 JOIN u y ON y.gene = gene2 AND y.pos = pos2 AND y.case_id = x.case_id GROUP BY 1, 2, 3, 4),
co AS (SELECT bo.*, a.c - n_both AS only1, b.c - n_both AS only2, n_both/a.c::DOUBLE AS p21, n_both/b.c::DOUBLE AS p12 FROM bo JOIN un a ON a.gene = gene1 AND a.pos = pos1 JOIN un b ON b.gene = gene2 AND b.pos = pos2)"""


@query(f"WITH {CO} SELECT gene1, gene2, pos1, pos2, n_both, only1, only2, round(p21, 6) AS p21, round(p12, 6) AS p12, round(greatest(p21, p12), 6) AS cond, CASE WHEN p21 >= p12 THEN gene1 ELSE gene2 END AS dependent FROM co")
def co_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For all pairs found in filtered calls, carriers counted in all calls, with conditional probabilities."""
    u = calls(spark, sf_dir).select("case_id", "gene", "pos").distinct()
    n = u.groupBy("gene", "pos").agg(F.count("*").alias("c"))
    p = case_doubles(spark, sf_dir).select("gene1", "gene2", "pos1", "pos2").distinct()
    one, two = (u.withColumnsRenamed({"gene": f"gene{k}", "pos": f"pos{k}"}) for k in (1, 2))
    both = p.join(one, ["gene1", "pos1"]).join(two, ["gene2", "pos2", "case_id"]).groupBy("gene1", "gene2", "pos1", "pos2").agg(F.count("*").alias("n_both"))
    c1, c2 = (n.select(F.col("gene").alias(f"gene{k}"), F.col("pos").alias(f"pos{k}"), F.col("c").alias(f"c{k}")) for k in (1, 2))
    t = both.join(c1, ["gene1", "pos1"]).join(c2, ["gene2", "pos2"]).withColumn("p21", F.col("n_both") / F.col("c1")).withColumn("p12", F.col("n_both") / F.col("c2"))
    return t.select("gene1", "gene2", "pos1", "pos2", "n_both", (F.col("c1") - F.col("n_both")).alias("only1"), (F.col("c2") - F.col("n_both")).alias("only2"), F.round("p21", 6).alias("p21"), F.round("p12", 6).alias("p12"), F.round(F.greatest("p21", "p12"), 6).alias("cond"), F.when(F.col("p21") >= F.col("p12"), F.col("gene1")).otherwise(F.col("gene2")).alias("dependent"))


@query("WITH c AS (SELECT DISTINCT l_partkey AS m, l_suppkey AS s FROM lineitem), n AS (SELECT m, count(*) AS n FROM c GROUP BY m) SELECT a.m AS m1, b.m AS m2, any_value(x.n) AS n1, any_value(y.n) AS n2, count(*) AS n_both FROM c a JOIN c b ON a.s = b.s AND b.m - a.m BETWEEN 1 AND 3 JOIN n x ON x.m = a.m JOIN n y ON y.m = b.m GROUP BY a.m, b.m")
def carrier_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the carrier sets of neighbouring mutations and of their intersection."""
    c = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("m"), F.col("l_suppkey").alias("s")).distinct()
    n = c.groupBy("m").agg(F.count("*").alias("n"))
    both = band_join(c.withColumnRenamed("m", "m1"), c.withColumnRenamed("m", "m2"), ["s"], "m1", "m2", 3).groupBy("m1", "m2").agg(F.count("*").alias("n_both"))
    return both.join(n.select(F.col("m").alias("m1"), F.col("n").alias("n1")), "m1").join(n.select(F.col("m").alias("m2"), F.col("n").alias("n2")), "m2").select("m1", "m2", "n1", "n2", "n_both")


@query(f"WITH {CALLS}, g AS (SELECT gene, pos, count(*) AS n FROM calls GROUP BY gene, pos), a AS (SELECT gene, pos FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY n DESC, pos) AS r FROM g) WHERE r = 1) SELECT a.gene, a.pos AS anchor, g.pos AS partner, g.n FROM a JOIN g ON g.gene = a.gene AND g.pos <> a.pos AND abs(g.pos - a.pos) <= 60")
def anchor_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partners within 60 positions of each gene's commonest one."""
    g = calls(spark, sf_dir).groupBy("gene", "pos").agg(F.count("*").alias("n"))
    a = first_per_key(g, ["gene"], [F.desc("n"), "pos"]).select("gene", F.col("pos").alias("anchor"))
    return near_join(a, g.withColumnRenamed("pos", "partner"), ["gene"], "anchor", "partner", 60).select("gene", "anchor", "partner", "n")


@query(f"WITH {CALLS}, p AS (SELECT DISTINCT chrom, pos FROM calls), b AS (SELECT c.chrom, i*100 AS s, i*100 + 90 AS e, 5000 + i*7 AS shift, i % 2 = 1 AS rev FROM (SELECT DISTINCT chrom FROM calls) c, (SELECT unnest(range(0, (SELECT max(pos) // 100 + 1 FROM calls))) AS i)) SELECT p.chrom, pos, CASE WHEN rev THEN shift + e - 1 - (pos - s) ELSE pos + shift END AS lifted FROM p JOIN b ON p.chrom = b.chrom AND pos >= s AND pos < e")
def lift_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions through a table of blocks with offsets and strands; what falls between blocks is lost."""
    p = calls(spark, sf_dir).select("chrom", "pos").distinct()
    last = p.agg(F.floor(F.max("pos") / 100).alias("last"))
    b = p.select("chrom").distinct().join(F.broadcast(last)).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    b = b.select("chrom", (F.col("i") * 100).alias("s"), (F.col("i") * 100 + 90).alias("e"), (5000 + F.col("i") * 7).alias("shift"), (F.col("i") % 2 == 1).alias("rev"))
    j = interval_join(p, b, ["chrom"], "pos", "s", "e", 250)
    return j.select("chrom", "pos", F.when(F.col("rev"), F.col("shift") + F.col("e") - 1 - (F.col("pos") - F.col("s"))).otherwise(F.col("pos") + F.col("shift")).alias("lifted"))


@query(f"WITH {CALLS}, v AS (SELECT DISTINCT gene, chrom, pos FROM calls), n AS (SELECT gene, chrom, count(*) AS k FROM v GROUP BY ALL) SELECT a.gene, a.chrom, a.pos AS pos1, b.pos AS pos2, b.pos - a.pos AS distance, k = 2 AS unambiguous FROM v a JOIN v b ON a.gene = b.gene AND a.chrom = b.chrom AND a.pos < b.pos JOIN n ON n.gene = a.gene AND n.chrom = a.chrom")
def group_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs within a group, here a gene on a chromosome, marked where the group has but two members."""
    v = calls(spark, sf_dir).select("gene", "chrom", "pos").distinct()
    return combinations(v, ["gene", "chrom"], "pos").select("gene", "chrom", "pos1", "pos2", (F.col("pos2") - F.col("pos1")).alias("distance"), "unambiguous")


@query(f"WITH {CALLS}, v AS (SELECT DISTINCT chrom, gene, pos FROM calls) SELECT a.chrom, a.gene AS gene1, b.gene AS gene2, count(*) AS n FROM v a JOIN v b ON a.chrom = b.chrom AND a.gene < b.gene AND b.pos - a.pos BETWEEN 0 AND 20 GROUP BY 1, 2, 3")
def cross_group_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different genes of one chromosome at most 20 positions apart."""
    v = calls(spark, sf_dir).select("chrom", "gene", "pos").distinct()
    a, b = v.withColumnsRenamed({"gene": "gene1", "pos": "pos1"}), v.withColumnsRenamed({"gene": "gene2", "pos": "pos2"})
    return band_join(a, b, ["chrom"], "pos1", "pos2", 20, 0).where("gene1 < gene2").groupBy("chrom", "gene1", "gene2").agg(F.count("*").alias("n"))
