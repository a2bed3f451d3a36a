"""Queries on the embedding store, lookups by key, and sets of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import identifiers as ids
from ..operators.bands import band_join, near_join
from ..operators.embedding import latest, missing
from ..operators.lineage import fixed
from .standins import CALLS, calls, r6, store, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


ROLE = "list_extract(['WT', 'M1', 'M2', 'M12'], (vec_id % 4 + 1)::INT)"
KEYED = f"k AS (SELECT vec_id // 4 AS pair, {ROLE} AS role, label, embedding, 'G' || label || ':' || (vec_id // 4) || '|' || {ROLE} AS key FROM embeddings)"


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir).withColumn("key", F.concat(F.lit("G"), F.col("label").cast("string"), F.lit(":"), F.col("pair").cast("string"), F.lit("|"), F.col("role")))


@query(f"WITH {KEYED} SELECT key, CASE WHEN label >= 5 THEN 2 ELSE 1 END AS version, round(CASE WHEN label >= 5 THEN 2*embedding[1]::DOUBLE ELSE embedding[1]::DOUBLE END, 6) + 0.0 AS first FROM k")
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of writes, some keys written twice: the last one counts."""
    k = keyed(spark, sf_dir)
    again = k.where("label >= 5").withColumn("embedding", F.transform("embedding", lambda x: x * 2)).withColumn("version", F.lit(2))
    now = latest(k.withColumn("version", F.lit(1)).unionByName(again), ["key"], "version")
    return now.select("key", "version", r6(F.get("embedding", 0).cast("double")).alias("first"))


@query(f"WITH {KEYED}, w AS (SELECT DISTINCT l_partkey AS pair FROM lineitem) SELECT pair, role, len(embedding)::INT AS dim FROM k JOIN w USING (pair)")
def store_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of many wanted pairs; those not there are left out."""
    wanted = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("pair")).distinct()
    return store(spark, sf_dir).join(wanted, "pair").select("pair", "role", F.size("embedding").alias("dim"))


@query(f"WITH {KEYED}, w AS (SELECT DISTINCT o_custkey AS pair FROM orders) SELECT pair, pair IN (SELECT pair FROM k) AS held FROM w")
def store_has(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of many wanted pairs a store holds."""
    wanted = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pair")).distinct()
    lost = missing(wanted, store(spark, sf_dir), "pair").withColumn("lost", F.lit(True))
    return wanted.join(lost, "pair", "left").select("pair", F.col("lost").isNull().alias("held"))


@query(f"WITH {KEYED} SELECT key, len(embedding)::INT AS dim FROM k WHERE key LIKE 'G1:%|WT'")
def store_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a pattern."""
    return keyed(spark, sf_dir).where(F.col("key").like("G1:%|WT")).select("key", F.size("embedding").alias("dim"))


@query(f"WITH {KEYED}, d AS (SELECT DISTINCT pair FROM k WHERE label = 3) SELECT role, count(*) AS n FROM k WHERE pair NOT IN (SELECT pair FROM d) GROUP BY role")
def store_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys left of each role once some pairs are deleted."""
    s = store(spark, sf_dir)
    return s.join(s.where("label = 3").select("pair").distinct(), "pair", "left_anti").groupBy("role").agg(F.count("*").alias("n"))


@query("SELECT 'model' || (label % 2) AS model, count(*) AS n, max(len(embedding))::INT AS dim, min(vec_id) AS first_key, 'mean pooled' AS description FROM embeddings GROUP BY label % 2")
def store_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each model's store holds."""
    e = table(spark, sf_dir, "embeddings")
    g = e.groupBy(F.concat(F.lit("model"), (F.col("label") % 2).cast("string")).alias("model"))
    return g.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim"), F.min("vec_id").alias("first_key")).withColumn("description", F.lit("mean pooled"))


@query(f"WITH {CALLS}, v AS (SELECT DISTINCT chrom, pos, ref, alt FROM calls) SELECT 'chr' || chrom || '_' || pos || '_' || ref || '_' || alt || '_b38' AS variant_id, chrom, pos, ref, alt, 'b38' AS build FROM v")
def parsed_variant_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Underscored variant ids taken apart."""
    v = calls(spark, sf_dir).select("chrom", "pos", "ref", "alt").distinct()
    v = v.select(F.concat(F.lit("chr"), F.concat_ws("_", "chrom", F.col("pos").cast("string"), "ref", "alt", F.lit("b38"))).alias("variant_id"))
    return v.select("variant_id", ids.parse_underscored(F.col("variant_id")).alias("x")).select("variant_id", "x.*")


CHANGES = "c AS (SELECT DISTINCT ref, pos, alt, pos % 5 AS k FROM calls)"


@query(f"""WITH {CALLS}, {CHANGES} SELECT CASE k WHEN 0 THEN ref || '->' || alt WHEN 1 THEN ref || '/' || alt WHEN 2 THEN ref || pos || alt WHEN 3 THEN pos || ':' || ref || ':' || alt ELSE pos || '-' || alt END AS change,
CASE WHEN k < 4 THEN ref END AS ref, CASE WHEN k > 1 THEN pos END AS pos, alt, count(*) AS n FROM c GROUP BY 1, 2, 3, 4""")
def parsed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five notations of a base change taken apart."""
    c = calls(spark, sf_dir).select("ref", "pos", "alt").distinct().withColumn("k", F.col("pos") % 5)
    at = F.col("pos").cast("string")
    forms = [F.concat("ref", F.lit("->"), "alt"), F.concat_ws("/", "ref", "alt"), F.concat("ref", at, "alt"), F.concat_ws(":", at, "ref", "alt"), F.concat(at, F.lit("-"), "alt")]
    change = forms[4]
    for k in range(4):
        change = F.when(F.col("k") == k, forms[k]).otherwise(change)
    return c.select(change.alias("change")).select("change", ids.parse_change(F.col("change")).alias("x")).groupBy("change", "x.ref", "x.pos", "x.alt").agg(F.count("*").alias("n"))


@query(f"WITH {CALLS}, g AS (SELECT p_brand AS gene, CASE WHEN max(p_size) % 2 = 1 THEN 'N' END AS strand, min(p_partkey) AS gene_id FROM part WHERE p_size > 10 GROUP BY p_brand) SELECT gene, gene_id, coalesce(strand, 'P') AS strand, count(*) AS n FROM calls LEFT JOIN g USING (gene) GROUP BY 1, 2, 3")
def gene_strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gene ids and strands by symbol; an unknown strand is forward."""
    p = table(spark, sf_dir, "part").where("p_size > 10").groupBy(F.col("p_brand").alias("gene")).agg(F.when(F.max("p_size") % 2 == 1, "N").alias("strand"), F.min("p_partkey").alias("gene_id"))
    return calls(spark, sf_dir).groupBy("gene").agg(F.count("*").alias("n")).join(p, "gene", "left").select("gene", "gene_id", F.coalesce("strand", F.lit("P")).alias("strand"), "n")


@query("""WITH s AS (SELECT p_partkey AS k, substr('ACGT', (p_partkey % 4 + 1)::INT, 1) AS ref, substr('CGTA', (p_partkey % 4 + 1)::INT, 1) || ',' || substr('GTAC', (p_partkey % 4 + 1)::INT, 1) AS alts FROM part WHERE p_partkey % 7 <> 0), q AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem)
SELECT 'rs' || a AS snp1, 'rs' || b AS snp2, x.ref AS ref1, string_split(x.alts, ',')[1] AS alt1, y.ref AS ref2, string_split(y.alts, ',')[1] AS alt2 FROM q LEFT JOIN s x ON a = x.k LEFT JOIN s y ON b = y.k""")
def snp_alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference and first alternate allele of both SNPs of a pair, null where a SNP is not known."""
    base = lambda letters: F.substring(F.lit(letters), (F.col("p_partkey") % 4 + 1).cast("int"), F.lit(1))
    s = table(spark, sf_dir, "part").where("p_partkey % 7 <> 0").select(F.concat(F.lit("rs"), F.col("p_partkey").cast("string")).alias("rs"), base("ACGT").alias("ref"), F.concat_ws(",", base("CGTA"), base("GTAC")).alias("alts"))
    pairs = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("rs"), F.col("l_partkey").cast("string")).alias("snp1"), F.concat(F.lit("rs"), F.col("l_suppkey").cast("string")).alias("snp2")).distinct()
    for k in (1, 2):
        of = s.select(F.col("rs").alias(f"snp{k}"), F.col("ref").alias(f"ref{k}"), F.get(F.split("alts", ","), 0).alias(f"alt{k}"))
        pairs = pairs.join(of, f"snp{k}", "left")
    return pairs


@query(f"WITH {CALLS}, p AS (SELECT DISTINCT gene, pos AS anchor FROM calls WHERE cls = 'R' AND depth >= 49), v AS (SELECT DISTINCT gene, pos FROM calls) SELECT p.gene, anchor, pos, abs(pos - anchor) AS distance FROM p JOIN v ON p.gene = v.gene AND abs(pos - anchor) BETWEEN 1 AND 50")
def matched_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All variants of a positive pair's gene close to its anchor."""
    c = calls(spark, sf_dir)
    anchors = c.where("cls = 'R' and depth >= 49").select("gene", F.col("pos").alias("anchor")).distinct()
    return near_join(anchors, c.select("gene", "pos").distinct(), ["gene"], "anchor", "pos", 50).select("gene", "anchor", "pos", F.abs(F.col("pos") - F.col("anchor")).alias("distance"))


@query(f"WITH {CALLS}, s AS (SELECT gene, chrom, pos, min(case_id) AS row_id FROM calls WHERE cls = 'R' GROUP BY 1, 2, 3) SELECT a.gene, a.chrom, a.pos AS pos1, b.pos AS pos2 FROM s a JOIN s b ON a.gene = b.gene AND a.chrom = b.chrom AND b.pos - a.pos BETWEEN 1 AND 400")
def independent_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of signals of one gene and chromosome at a bounded distance."""
    s = calls(spark, sf_dir).where("cls = 'R'").select("gene", "chrom", "pos").distinct()
    return band_join(s.withColumnRenamed("pos", "pos1"), s.withColumnRenamed("pos", "pos2"), ["gene", "chrom"], "pos1", "pos2", 400).select("gene", "chrom", "pos1", "pos2")


@query(f"WITH {CALLS} SELECT gene, pos, count(*) AS n FROM calls WHERE pos IN (SELECT pos FROM calls WHERE cls = 'A' AND depth >= 48) GROUP BY 1, 2")
def groups_seen_elsewhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls at positions that another set holds too."""
    c = calls(spark, sf_dir)
    return c.join(c.where("cls = 'A' and depth >= 48").select("pos").distinct(), "pos", "left_semi").groupBy("gene", "pos").agg(F.count("*").alias("n"))


@query(f"WITH {CALLS} SELECT pos, count(*) AS n FROM calls GROUP BY pos HAVING count(DISTINCT project) = (SELECT count(DISTINCT project) FROM calls)")
def ids_of_all_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions that every project has."""
    c = fixed(calls(spark, sf_dir, 1 << 18).groupBy("pos", "project").agg(F.count("*").alias("n")))
    total = c.agg(F.countDistinct("project").alias("total"))
    return c.groupBy("pos").agg(F.sum("n").alias("n"), F.count("project").alias("k")).join(F.broadcast(total)).where("k = total").select("pos", "n")


@query("SELECT l_orderkey AS id, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%') GROUP BY 1")
def new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id a combined table lacks."""
    done = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").like("1%")).select(F.col("o_orderkey").alias("id"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")).join(done, "id", "left_anti").groupBy("id").agg(F.count("*").alias("n"))


@query("WITH p AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem) SELECT x.p_type AS chrom, count(*) AS n FROM p JOIN part x ON a = x.p_partkey JOIN part y ON b = y.p_partkey WHERE a <> b AND x.p_type = y.p_type GROUP BY 1")
def cis_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different variants on one chromosome."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct().where("a <> b")
    of = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    p = p.join(of.select(F.col("p_partkey").alias("a"), F.col("p_type").alias("chrom")), "a").join(of.select(F.col("p_partkey").alias("b"), F.col("p_type").alias("other")), "b")
    return p.where("chrom = other").groupBy("chrom").agg(F.count("*").alias("n"))


@query(f"WITH {CALLS} SELECT DISTINCT gene, pos AS pos1, pos + (case_id % 40) - 20 AS pos2, least(pos, pos + (case_id % 40) - 20) - 100 AS start, greatest(pos, pos + (case_id % 40) - 20) + 99 AS \"end\", CASE WHEN cls = 'N' THEN greatest(pos, pos + (case_id % 40) - 20) + 99 - pos ELSE pos - least(pos, pos + (case_id % 40) - 20) + 100 END AS off1, CASE WHEN cls = 'N' THEN greatest(pos, pos + (case_id % 40) - 20) + 99 - (pos + (case_id % 40) - 20) ELSE pos + (case_id % 40) - 20 - least(pos, pos + (case_id % 40) - 20) + 100 END AS off2, cls = 'N' AS rev FROM calls")
def window_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows around pairs, and the places of both variants in them."""
    c = calls(spark, sf_dir).select("gene", F.col("pos").alias("pos1"), (F.col("pos") + F.col("case_id") % 40 - 20).alias("pos2"), (F.col("cls") == "N").alias("rev")).distinct()
    return c.withColumn("w", ids.window_offsets(F.col("pos1"), F.col("pos2"), 100, F.col("rev"))).select("gene", "pos1", "pos2", "w.*", "rev")


@query(f"WITH {CALLS}, v AS (SELECT DISTINCT gene, pos FROM calls), p AS (SELECT gene, min(pos) AS a, max(pos) AS b FROM v GROUP BY gene), w AS (SELECT gene, a, b, greatest(1, ceil((b - a + 401)/500.0)::BIGINT) AS step FROM p) SELECT DISTINCT gene, pos FROM (SELECT gene, unnest(range(a - 200, b + 201, step)) AS pos FROM w UNION ALL SELECT gene, a FROM w UNION ALL SELECT gene, b FROM w)")
def window_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most some 500 positions around a pair at a fixed step, both variants among them."""
    w = calls(spark, sf_dir).groupBy("gene").agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    step = F.greatest(F.lit(1), F.ceil((F.col("b") - F.col("a") + 401) / 500.0)).cast("long")
    sites = F.concat(F.sequence(F.col("a") - 200, F.col("b") + 200, step), F.array("a", "b"))
    return w.select("gene", F.explode(F.array_distinct(sites)).alias("pos"))


@query("SELECT DISTINCT b.p_brand AS gene, least(a.p_partkey, b.p_partkey) AS pos1, greatest(a.p_partkey, b.p_partkey) AS pos2 FROM (SELECT unnest([11, 57, 103]) AS p_partkey) a, part b WHERE b.p_size = 50 AND a.p_partkey <> b.p_partkey")
def fixed_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three anchors with a list of partners, lower position first."""
    p = table(spark, sf_dir, "part").where("p_size = 50").select(F.col("p_brand").alias("gene"), "p_partkey", F.explode(F.array(F.lit(11), F.lit(57), F.lit(103))).alias("anchor")).where("anchor <> p_partkey")
    return p.select("gene", F.least("anchor", "p_partkey").alias("pos1"), F.greatest("anchor", "p_partkey").alias("pos2")).distinct()


@query(f"WITH {CALLS}, v AS (SELECT DISTINCT gene, pos, cls FROM calls), k AS (SELECT *, pos // 500 AS bin, row_number() OVER (PARTITION BY cls, pos // 500 ORDER BY md5(gene || ':' || pos), gene, pos) AS r FROM v), n AS (SELECT bin, min(c) AS n, count(*) AS sets FROM (SELECT cls, bin, count(*) AS c FROM k GROUP BY 1, 2) GROUP BY bin) SELECT cls, gene, pos, bin FROM k JOIN n USING (bin) WHERE n >= 10 AND sets = 3 AND r <= n")
def matched_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many rows of every set in a distance bin as the smallest set has there; thin bins are left out."""
    v = calls(spark, sf_dir).select("gene", "pos", "cls").distinct().withColumn("bin", F.floor(F.col("pos") / 500))
    w = Window.partitionBy("cls", "bin").orderBy(F.md5(F.concat_ws(":", "gene", F.col("pos").cast("string"))), "gene", "pos")
    n = v.groupBy("cls", "bin").agg(F.count("*").alias("c")).groupBy("bin").agg(F.min("c").alias("n"), F.count("*").alias("sets")).where("n >= 10 and sets = 3")
    return v.withColumn("r", F.row_number().over(w)).join(n, "bin").where("r <= n").select("cls", "gene", "pos", "bin")


@query("WITH p AS (SELECT p_partkey, unnest([100, 1000, 10000]) AS distance FROM part), h AS (SELECT *, ('0x' || substr(md5(p_partkey || ':' || distance), 1, 7))::BIGINT AS h FROM p) SELECT p_partkey AS id, distance, h % 1000000 AS pos1, h % 1000000 + distance AS pos2, substr('ACGT', (h % 4 + 1)::INT, 1) AS ref, substr('CGTA', (h % 4 + 1)::INT, 1) AS alt FROM h")
def random_null_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded pairs at fixed distances, a few for every id of a table."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.explode(F.array(F.lit(100), F.lit(1000), F.lit(10000))).alias("distance"))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.col("distance").cast("string"))), 1, 7), 16, 10).cast("long")
    p = p.withColumn("h", h)
    base = lambda s: F.substring(F.lit(s), (F.col("h") % 4 + 1).cast("int"), F.lit(1))
    return p.select("id", "distance", (F.col("h") % 1000000).alias("pos1"), (F.col("h") % 1000000 + F.col("distance")).alias("pos2"), base("ACGT").alias("ref"), base("CGTA").alias("alt"))


@query("WITH c AS (SELECT label AS chain, vec_id AS residue, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings) SELECT a.chain, a.residue AS i, b.residue AS j, round(1/sqrt(power(a.x-b.x,2)+power(a.y-b.y,2)+power(a.z-b.z,2)), 6) AS proximity FROM c a JOIN c b ON a.chain = b.chain AND b.residue - a.residue BETWEEN 1 AND 200")
def structure_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One over the distance of two residues' coordinates, within a chain and a span of residues."""
    at = lambda k: F.get("embedding", k).cast("double")
    c = table(spark, sf_dir, "embeddings").select(F.col("label").alias("chain"), F.col("vec_id").alias("residue"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))
    b = c.select("chain", *[F.col(k).alias(f"{k}2") for k in ("residue", "x", "y", "z")])
    j = band_join(c, b, ["chain"], "residue", "residue2", 200)
    d = sum(((F.col(k) - F.col(f"{k}2")) ** 2 for k in ("x", "y", "z")), F.lit(0.0))
    return j.select("chain", F.col("residue").alias("i"), F.col("residue2").alias("j"), F.round(F.try_divide(F.lit(1.0), F.sqrt(d)), 6).alias("proximity"))
