"""Domain tables derived from the given ones: Spark frames, and the same as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper ends of the distance bins, by their lower edges.
EDGES = [0, 1000, 10_000, 100_000]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column) -> Column:
    """Rounded as compared: sums in another order differ in the last digits. Minus zero becomes zero."""
    return F.round(c, 6) + 0.0


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a store: pair, role, label of the pair, vector."""
    e = table(spark, sf_dir, "embeddings")
    pair = F.floor(F.col("vec_id") / 4)
    role = F.element_at(F.array(*[F.lit(x) for x in ("WT", "M1", "M2", "M12")]), (F.col("vec_id") % 4 + 1).cast("int"))
    return e.select(pair.alias("pair"), role.alias("role"), "label", "embedding")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per pair: four vectors, gene, positions, distance and its bin, whether it is null."""
    s = store(spark, sf_dir)
    wide = s.groupBy("pair").pivot("role", ["WT", "M1", "M2", "M12"]).agg(F.first("embedding"))
    label = s.where("role = 'WT'").select("pair", "label")
    df = wide.join(label, "pair").where("WT is not null and M1 is not null and M2 is not null and M12 is not null")
    df = df.withColumn("gene", F.concat(F.lit("G"), F.col("label").cast("string"))).withColumn("pos1", 1000 + 37 * F.col("pair")).withColumn("distance", 1 + (F.col("pair") * 7919) % 150_000)
    df = df.withColumn("pos2", F.col("pos1") + F.col("distance")).withColumn("is_null", F.col("label") < 5)
    b = F.when(F.col("distance") < 1000, 0).when(F.col("distance") < 10_000, 1).when(F.col("distance") < 100_000, 2).otherwise(3)
    return df.withColumn("bin", b)


PAIRS = """
e AS (SELECT vec_id // 4 AS pair, vec_id % 4 AS role, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
z AS (SELECT pair, i, max(CASE WHEN role = 0 THEN x END) AS w, max(CASE WHEN role = 1 THEN x END) AS a, max(CASE WHEN role = 2 THEN x END) AS b, max(CASE WHEN role = 3 THEN x END) AS o, max(CASE WHEN role = 0 THEN label END) AS label FROM e GROUP BY pair, i),
v AS (SELECT pair, i, label, a - w AS v1, b - w AS v2, o - w AS vo FROM z WHERE w IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AND o IS NOT NULL),
g AS (SELECT pair, any_value(label) AS label, sum(v1*v1) AS d11, sum(v2*v2) AS d22, sum(vo*vo) AS doo, sum((v1+v2)*(v1+v2)) AS dee, sum((vo-v1-v2)*(vo-v1-v2)) AS drr,
  sum(v1*v2) AS d12, sum((v1+v2)*(vo-v1-v2)) AS der, sum(vo*(v1+v2)) AS doe, sum(vo*(v1-v2)) AS dod, sum((v1+v2)*(v1-v2)) AS ded, sum((v1-v2)*(v1-v2)) AS ddd FROM v GROUP BY pair),
p AS (SELECT *, 'G' || label AS gene, 1000 + 37*pair AS pos1, 1 + (pair*7919) % 150000 AS distance, label < 5 AS is_null FROM g),
q AS (SELECT *, pos1 + distance AS pos2, CASE WHEN distance < 1000 THEN 0 WHEN distance < 10000 THEN 1 WHEN distance < 100000 THEN 2 ELSE 3 END AS bin,
  sqrt(drr) AS epi_r_raw, ln((sqrt(doo)+1e-20)/(sqrt(dee)+1e-20)) AS lmr FROM p)
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with two of their metrics, without the vectors."""
    from ..operators.geometry import pair_metrics

    keys = ["pair", "label", "gene", "pos1", "pos2", "distance", "bin", "is_null"]
    return pair_metrics(pairs(spark, sf_dir), keys).select(*keys, "epi_R_raw", "log_magnitude_ratio")


def calls(spark: SparkSession, sf_dir: str, most: int | None = None) -> DataFrame:
    """Mutation calls: case, gene, position, project, chromosome, class, depth and alternate count.

    The small tables meet first, so lines move once by order and once by part. With ``most`` a task joins about so many
    lines, whatever the tables' size.
    """
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    part, c = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    spread = lambda df, key: df.repartition(li.count() // most + 1, key) if most else df
    of = o.join(c, o.o_custkey == c.c_custkey)
    df = spread(spread(li, "l_orderkey").join(of, li.l_orderkey == o.o_orderkey), "l_partkey").join(part, F.col("l_partkey") == part.p_partkey)
    bases = F.lit("ACGT")
    return df.select(
        F.col("o_custkey").alias("case_id"), F.col("p_brand").alias("gene"), F.col("l_partkey").alias("pos"), F.col("c_mktsegment").alias("project"),
        F.col("p_type").alias("chrom"), F.col("l_returnflag").alias("cls"), F.col("l_quantity").alias("depth"), F.floor(F.round(F.col("l_quantity") * F.col("l_discount") * 10, 6)).cast("long").alias("alt_count"),
        F.substring(bases, (F.col("l_partkey") % 4 + 1).cast("int"), F.lit(1)).alias("ref"), F.substring(bases, ((F.col("l_partkey") + 1) % 4 + 1).cast("int"), F.lit(1)).alias("alt"),
    )


CALLS = """
calls AS (SELECT o_custkey AS case_id, p_brand AS gene, l_partkey AS pos, c_mktsegment AS project, p_type AS chrom, l_returnflag AS cls, l_quantity AS depth,
  floor(round(l_quantity*l_discount*10, 6))::BIGINT AS alt_count, substr('ACGT', (l_partkey % 4 + 1)::INT, 1) AS ref, substr('ACGT', ((l_partkey+1) % 4 + 1)::INT, 1) AS alt
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey)
"""


def clinical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with years from first to last order and an event flag."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    span = o.groupBy("o_custkey").agg(F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).alias("days"))
    return span.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_custkey").alias("case_id"), (F.col("days") / 365.0).alias("duration"), (F.col("c_acctbal") < 0).cast("int").alias("event"), F.col("c_mktsegment").alias("project"))


CLINICAL = """
clinical AS (SELECT o_custkey AS case_id, date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE)/365.0 AS duration, (any_value(c_acctbal) < 0)::INT AS event, any_value(c_mktsegment) AS project
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey)
"""


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two groups of documents with a value, a covariate and strata."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select("doc_id", "lang", "source", F.col("n_chars").cast("double").alias("value"), (F.col("quality") == 1).alias("good"), F.size(F.split("text", "\n")).cast("double").alias("lines"), (F.col("doc_id") % 97).cast("double").alias("other"))


GRADED = """
graded AS (SELECT d.doc_id, lang, source, n_chars::DOUBLE AS value, quality = 1 AS good, len(string_split(text, chr(10)))::DOUBLE AS lines, (d.doc_id % 97)::DOUBLE AS other FROM documents d JOIN labels l USING (doc_id))
"""
