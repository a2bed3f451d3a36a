"""Queries on structures and contacts, and on cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cascade, cohorts, structures
from ..operators.maps import bracket_pairs
from .curation import MAPS, dependency
from .standins import CALLS, CLINICAL, calls, clinical, r6, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors' first three coordinates as atom records of fixed columns, beside records of other atoms."""
    e = table(spark, sf_dir, "embeddings").where("embedding is not null and label is not null")
    e = e.select(F.concat(F.col("label").cast("string"), F.lit("_"), F.floor(F.col("vec_id") / 5000).cast("string")).alias("id"), F.when(F.col("vec_id") % 2 == 0, "A").otherwise("B").alias("chain"), (F.floor(F.col("vec_id") % 5000 / 2) + 3).alias("residue"), *[(F.get("embedding", k).cast("double") * 10).alias(c) for k, c in enumerate("xyz")])
    line = lambda kind, atom: F.concat(F.lit(f"{kind:<6}"), F.lit("    1 "), F.lit(atom), F.lit("   G "), "chain", F.lpad(F.col("residue").cast("string"), 4, " "), F.lit("    "), *[F.format_string("%8.3f", c) for c in "xyz"])
    kinds = F.array(line("ATOM", " C1'"), line("ATOM", " P  "), line("HETATM", " C1'"))
    return e.select("id", F.explode(kinds).alias("value"))


@query("""WITH e AS (SELECT label || '_' || (vec_id // 5000) AS id, CASE WHEN vec_id % 2 = 0 THEN 'A' ELSE 'B' END AS chain, (vec_id % 5000) // 2 + 3 AS residue, round(embedding[1]::DOUBLE*10, 3) AS x, round(embedding[2]::DOUBLE*10, 3) AS y, round(embedding[3]::DOUBLE*10, 3) AS z FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
c AS (SELECT id, chain, min(residue) AS a, max(residue) AS b FROM e GROUP BY ALL), o AS (SELECT *, coalesce(sum(b - a + 1) OVER (PARTITION BY id ORDER BY chain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM c), r AS (SELECT id, (f + residue - a)::INT AS i, x, y, z FROM e JOIN o USING (id, chain)),
d AS (SELECT a.id, a.i, b.i AS j, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) AS d FROM r a JOIN r b ON a.id = b.id AND a.i < b.i)
SELECT id, i, j, round(d, 4) AS distance, round(CASE WHEN d > 0 THEN 1/d END, 4) AS proximity FROM d WHERE d <= 1.5""")
def structure_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residues at most 1.5 apart in structures of two chains, read from records of fixed columns."""
    at = structures.indexed(structures.atoms(records(spark, sf_dir), ["id"]), ["id"])
    return structures.neighbours(at, ["id"], 1.5).select("id", "i", "j", F.round("distance", 4).alias("distance"), F.round("proximity", 4).alias("proximity"))


@query("WITH d AS (SELECT doc_id, n_chars % 7 + 1 AS p, n_chars % 3 AS q FROM documents), k AS (SELECT *, unnest(range(0, 2*p + 2*q + 2))::INT AS i FROM d), t AS (SELECT *, unnest(range(i + 1, 2*p + 2*q + 2))::INT AS j FROM k) SELECT doc_id, i AS pos1, j AS pos2, (i < p AND j = 2*p + q + 1 - i) OR (i >= p AND i < p + q AND j = 3*p + 2*q + 1 - i) AS is_paired FROM t")
def paired_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two places of a structure, and whether they pair."""
    n = F.col("n_chars")
    p, q = (n % 7 + 1).cast("int"), (n % 3).cast("int")
    s = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.repeat(F.lit("("), p), F.repeat(F.lit("["), q), F.lit(".."), F.repeat(F.lit(")"), p), F.repeat(F.lit("]"), q)).alias("s"))
    pairs = s.withColumn("pos1", F.explode(F.sequence(F.lit(0), F.length("s") - 2))).withColumn("pos2", F.explode(F.sequence(F.col("pos1") + 1, F.length("s") - 1)))
    return structures.paired_label(pairs.select("doc_id", "pos1", "pos2"), bracket_pairs(s, ["doc_id"], "s"), ["doc_id"])


REGIONS = [(4, "a"), (8, "b"), (12, "c")]


@query(f"""WITH {MAPS}, up AS (SELECT *, quantile_cont(score, 0.9) FILTER (score > 0) OVER (PARTITION BY id) AS bound FROM mp WHERE pos_i < pos_j), rg AS (SELECT *, CASE WHEN pos_i < 4 THEN 'a' WHEN pos_i < 8 THEN 'b' ELSE 'c' END AS region_i, CASE WHEN pos_j < 4 THEN 'a' WHEN pos_j < 8 THEN 'b' ELSE 'c' END AS region_j FROM up)
SELECT id, pos_i, pos_j, round(score, 6) AS score, pos_j - pos_i AS distance, region_i, region_j, region_i <> region_j AS crosses FROM rg WHERE score > bound AND pos_j - pos_i >= 4 AND pos_i + pos_j <> 11""")
def novel_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High scores of dependency maps outside the known contacts, here a stem's."""
    d = dependency(spark, sf_dir)
    known = d.where("pos_i + pos_j = 11").select("id", F.col("pos_i").alias("i"), F.col("pos_j").alias("j"))
    return structures.novel_pairs(d, known, ["id"], REGIONS).withColumn("score", F.round("score", 6))


@query(f"""WITH {CALLS}, {CLINICAL}, pl AS (SELECT DISTINCT gene, case_id, pos FROM calls), pr AS (SELECT a.gene, a.pos AS pos1, b.pos AS pos2 FROM pl a JOIN pl b ON a.gene = b.gene AND a.case_id = b.case_id AND a.pos < b.pos GROUP BY ALL HAVING count(*) >= 3),
k AS (SELECT pr.gene, pos1, pos2, pl.case_id, count(*) FILTER (pos IN (pos1, pos2)) AS hit, count(*) AS n FROM pr JOIN pl ON pl.gene = pr.gene GROUP BY ALL), g AS (SELECT *, CASE WHEN hit = 2 THEN 1 ELSE 0 END AS grp FROM k WHERE hit = 2 OR (hit = 1 AND n >= 2))
SELECT gene, pos1, pos2, count(*) FILTER (grp = 1) AS n_target, count(*) FILTER (grp = 0) AS n_control, coalesce(sum(event) FILTER (grp = 1), 0)::BIGINT AS events_target, coalesce(sum(event) FILTER (grp = 0), 0)::BIGINT AS events_control FROM g JOIN clinical USING (case_id) GROUP BY ALL""")
def position_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with both positions of a pair against those with one of them and another hit, for all pairs at once."""
    positions = calls(spark, sf_dir).select("gene", "case_id", "pos").distinct()
    pairs = cascade.carried_pairs(positions, 3).select("gene", "pos1", "pos2").distinct()
    c = cohorts.position_cohorts(positions, pairs).join(clinical(spark, sf_dir), "case_id")
    of = lambda g, c: F.coalesce(F.sum(F.when(F.col("grp") == g, c)), F.lit(0)).cast("long")
    return c.groupBy("gene", "pos1", "pos2").agg(of(1, F.lit(1)).alias("n_target"), of(0, F.lit(1)).alias("n_control"), of(1, F.col("event")).alias("events_target"), of(0, F.col("event")).alias("events_control"))


@query(f"""WITH {CALLS}, {CLINICAL}, h AS (SELECT case_id, bool_or(gene = 'Brand#11') AS a, bool_or(gene = 'Brand#22') AS b, bool_or(gene = 'Brand#33') AS c FROM calls GROUP BY case_id),
s AS (SELECT cl.*, coalesce(a AND NOT b, false) AS only_a, coalesce(b AND NOT a, false) AS only_b, coalesce(a AND b, false) AS both_, coalesce(a OR b, false) AS either_, coalesce(a AND b AND c, false) AS all3 FROM clinical cl LEFT JOIN h USING (case_id)),
u AS (SELECT 'both' AS cohort, CASE WHEN only_a THEN 0 WHEN both_ THEN 1 END AS grp, * FROM s UNION ALL SELECT 'either', CASE WHEN either_ THEN 1 ELSE 0 END, * FROM s UNION ALL SELECT 'all', CASE WHEN all3 THEN 1 ELSE 0 END, * FROM s UNION ALL SELECT 'only_b', CASE WHEN only_b THEN 1 END, * FROM s)
SELECT cohort, grp, count(*) AS n, sum(event)::BIGINT AS events, round(avg(duration), 6) AS mean FROM u WHERE grp IS NOT NULL GROUP BY cohort, grp""")
def gene_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carriers of both genes against those of one, of either and of all of three against the rest, and of one alone."""
    c, people = calls(spark, sf_dir), clinical(spark, sf_dir)
    a, b = "Brand#11", "Brand#22"
    made = {
        "both": cohorts.cohort(people, cohorts.two_gene_carriers(c, a, b, "both"), cohorts.two_gene_carriers(c, a, b, "only_a")),
        "either": cohorts.cohort(people, cohorts.carriers_of(c, [a, b])), "all": cohorts.cohort(people, cohorts.carriers_of(c, [a, b, "Brand#33"], False)),
        "only_b": cohorts.cohort(people, cohorts.two_gene_carriers(c, a, b, "only_b"), rest=False),
    }
    out = None
    for name, df in made.items():
        part = df.groupBy("grp").agg(F.count("*").alias("n"), F.sum("event").alias("events"), r6(F.avg("duration")).alias("mean")).withColumn("cohort", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
