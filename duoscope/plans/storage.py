"""Queries on tables written and read again: the embedding store, delimited files, tables by source and chromosome."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranking, substitution
from ..operators.lineage import folder
from ..sources import tables
from ..sources.store import Store, fill
from .genome import SPELLED, spelled
from .standins import CALLS, PAIRS, calls, r6, scored, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelled(spark, sf_dir).select(F.col("chrom").alias("key"), "doc_id", "seq")


COUNTED = f"{SPELLED}, cn AS (SELECT doc_id, chrom AS key, {', '.join(f'(len(seq) - len(replace(seq, {b!r}, {chr(39) * 2})))::DOUBLE AS {b.lower()}' for b in 'ACGT')} FROM sq), ve AS (SELECT doc_id, key, a, c, (g*g/greatest(a + c + g + t, 1))::FLOAT::DOUBLE AS x, (a*t/greatest(a + c + g + t, 1))::FLOAT::DOUBLE AS y FROM cn)"


@query(f"WITH {COUNTED} SELECT key, 4 AS dim, 7::BIGINT AS version, CASE WHEN doc_id % 5 = 0 THEN 2*a ELSE a END AS a, round(CASE WHEN doc_id % 5 = 0 THEN 2*x ELSE x END, 4) AS x, round(CASE WHEN doc_id % 5 = 0 THEN 2*y ELSE y END, 4) AS y FROM ve WHERE doc_id % 7 <> 0")
def store_on_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of whole texts' vectors: filled in rounds, a fifth written anew, a seventh deleted, then compacted."""
    s = Store(spark, folder(spark))
    w = wanted(spark, sf_dir)
    fill(s, w, "seq", substitution.composition_model, 4)
    s.upsert(s.rows().join(w.where("doc_id % 5 = 0").select("key"), "key").select("key", F.transform("embedding", lambda x: x * 2).alias("embedding")))
    s.delete(w.where("doc_id % 7 = 0").select("key"))
    s.compact()
    s.vacuum()
    at = lambda k: F.get("embedding", k).cast("double")
    return s.rows().select("key", "dim", "version", at(0).alias("a"), F.round(at(2), 4).alias("x"), F.round(at(3), 4).alias("y"))


@query("SELECT 'composition' AS model, count(*) AS wanted, count(*) FILTER (doc_id % 2 = 0) AS loaded, count(*) FILTER (doc_id % 2 <> 0) AS computed, 0::BIGINT AS skipped FROM documents")
def store_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job over a store that holds half of the keys: what it loaded, computed and skipped, beside the store's model."""
    s = Store(spark, folder(spark))
    s.describe(model="other", description="mean pooled")
    s.describe(model="composition")
    w = wanted(spark, sf_dir)
    fill(s, w.where("doc_id % 2 = 0"), "seq", substitution.composition_model, 2)
    counts = fill(s, w, "seq", substitution.composition_model, 2)
    facts = s.facts().where("name = 'model'").select(F.col("value").alias("model"))
    return facts.select("model", *[F.lit(counts[c]).cast("long").alias(c) for c in ("wanted", "loaded", "computed", "skipped")])


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 < 2 THEN o_custkey END AS customer, round(o_totalprice, 2) AS price, o_orderstatus AS status FROM orders")
def sniffed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table in three parts, cut by commas, by tabs and gzipped, and by bars without a column; read by its headers."""
    at = folder(spark)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    w = lambda df, sep: df.write.mode("append").option("header", True).option("sep", sep)
    w(o.where("id % 3 = 0"), ",").csv(at)
    w(o.where("id % 3 = 1").select("status", "price", "customer", "id"), "\t").option("compression", "gzip").csv(at)
    w(o.where("id % 3 = 2").select("id", "status", "price"), "|").csv(at)
    return tables.read_sniffed(spark, at, "id", "id long, customer long, price double, status string").withColumn("price", F.round("price", 2))


@query(f"WITH {CALLS}, v AS (SELECT DISTINCT pos, ref, alt FROM calls) SELECT (pos % 22 + 1)::VARCHAR AS chrom, count(*) AS n, sum(pos)::BIGINT AS total, min(ref) AS first FROM v GROUP BY 1")
def chromosome_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation in a folder per chromosome, which is told by the folder's name alone."""
    at = folder(spark)
    v = calls(spark, sf_dir).select("pos", "ref", "alt").distinct().withColumn("part", F.concat(F.lit("chr"), (F.col("pos") % 22 + 1).cast("string")))
    v.write.partitionBy("part").option("header", True).csv(at)
    t = tables.read_by_chromosome(spark, at, "pos long, ref string, alt string")
    return t.groupBy("chrom").agg(F.count("*").alias("n"), F.sum("pos").alias("total"), F.min("ref").alias("first"))


@query(f"WITH {PAIRS} SELECT pair, 's' || label AS source, round(lmr, 6) + 0.0 AS lmr FROM q WHERE label IN (1, 4)")
def combined_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics written by source, some rows twice, and read again: two sources, three columns, the first row of each id."""
    at = folder(spark)
    m = scored(spark, sf_dir).withColumn("source", F.concat(F.lit("s"), F.col("label").cast("string")))
    tables.write_by_source(m.unionByName(m.where("pair % 3 = 0")), at)
    r = tables.read_metrics(spark, at, ["s1", "s4"], ["pair", "source", "log_magnitude_ratio"])
    return ranking.first_per_key(r, ["pair", "source"], ["log_magnitude_ratio"]).select("pair", "source", r6(F.col("log_magnitude_ratio")).alias("lmr"))


@query(f"WITH {PAIRS}, t AS (SELECT 's' || label AS source, pair FROM q) SELECT source, count(*) AS n_by_source, count(*) AS n_combined, sum(pair)::BIGINT AS ids FROM t GROUP BY source")
def combined_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of TSV per source, all rows in one table, and the light table of ids: rows of each source in all three."""
    at = folder(spark)
    m = scored(spark, sf_dir).withColumn("source", F.concat(F.lit("s"), F.col("label").cast("string")))
    tables.write_combined(m.select("source", "pair", "gene", "distance"), at, "pair", ["gene"])
    own = spark.read.option("header", True).option("sep", "\t").schema("pair long, gene string, distance long, source string").csv(f"{at}/by_source").groupBy("source").agg(F.count("pair").alias("n_by_source"))
    whole = tables.read_sniffed(spark, f"{at}/combined", "pair", "source string, pair long").groupBy("source").agg(F.count("pair").alias("n_combined"))
    ids = spark.read.parquet(f"{at}/ids").groupBy("source").agg(F.sum("pair").alias("ids"))
    return own.join(whole, "source").join(ids, "source")
