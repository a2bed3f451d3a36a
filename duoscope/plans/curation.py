"""Queries on identifiers, curation, sequences, maps and the embedding store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import identifiers as ids
from ..operators import embedding, maps, ranking
from ..sources import tables
from .standins import CALLS, calls, r6, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


VARIANTS = f"{CALLS}, va AS (SELECT DISTINCT gene, chrom, pos, ref, alt FROM calls), mi AS (SELECT *, gene || ':' || chrom || ':' || pos || ':' || ref || ':' || alt || CASE WHEN pos % 3 = 0 THEN ':N' WHEN pos % 3 = 1 THEN ':P' ELSE '' END AS m FROM va)"


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = calls(spark, sf_dir).select("gene", "chrom", "pos", "ref", "alt").distinct()
    strand = F.when(F.col("pos") % 3 == 0, ":N").when(F.col("pos") % 3 == 1, ":P").otherwise("")
    return v.withColumn("m", F.concat(F.concat_ws(":", "gene", "chrom", F.col("pos").cast("string"), "ref", "alt"), strand))


@query(f"WITH {VARIANTS} SELECT m, gene, chrom, pos, ref, alt, pos % 3 = 0 AS rev FROM mi")
def parsed_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers taken apart again."""
    return variants(spark, sf_dir).select("m", ids.parse_mutation(F.col("m")).alias("x")).select("m", "x.gene", "x.chrom", "x.pos", "x.ref", "x.alt", "x.rev")


@query(f"WITH {VARIANTS} SELECT m, gene || ':' || chrom || ':' || pos || ':' || ref || ':' || alt AS canonical, translate(ref || alt, 'ACGT', 'TGCA') AS complement, reverse(translate(ref || alt, 'ACGT', 'TGCA')) AS revcomp, 'NN' || substr(m, 1, 3) || 'NN' AS padded, substr(m, (floor((length(m) - 7)/2) + 1)::INT, 7) AS cropped FROM mi")
def normalised_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, both = variants(spark, sf_dir), F.concat("ref", "alt")
    return v.select("m", ids.canonical_mutation(F.col("m")).alias("canonical"), ids.complement(both).alias("complement"), ids.reverse_complement(both).alias("revcomp"), ids.fit_length(F.substring("m", 1, 3), 7).alias("padded"), ids.fit_length(F.col("m"), 7).alias("cropped"))


PAIRED = f"{VARIANTS}, a AS (SELECT * FROM mi), pk AS (SELECT a.gene, a.chrom, a.pos AS p1, b.pos AS p2, a.m AS m1, b.m AS m2, (a.pos % 3 = 0) = (b.pos % 3 = 0) AS same FROM a JOIN mi b ON b.gene = a.gene AND b.chrom = a.chrom AND b.pos - a.pos BETWEEN -9 AND 9 AND b.pos <> a.pos)"


@query(f"WITH {PAIRED} SELECT m1 || '|' || m2 AS key, same AS valid, CASE WHEN same THEN abs(p2 - p1) ELSE -1 END AS distance, same AND p1 > p2 AS reversed, '_:' || array_to_string(string_split(m1, ':')[2:5], ':') || '|_:' || array_to_string(string_split(m2, ':')[2:5], ':') AS free FROM pk")
def parsed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair identifiers: validity, distance, order, and the form without genes."""
    from ..operators.bands import near_join

    v = variants(spark, sf_dir)
    a = v.select("gene", "chrom", F.col("pos").alias("p1"), F.col("m").alias("m1"))
    p = near_join(a, v.select("gene", "chrom", F.col("pos").alias("p2"), F.col("m").alias("m2")), ["gene", "chrom"], "p1", "p2", 9)
    p = p.withColumn("key", F.concat_ws("|", "m1", "m2")).withColumn("x", ids.parse_pair(F.col("key")))
    return p.select("key", F.col("x").isNotNull().alias("valid"), F.coalesce(F.abs(F.col("x.b.pos") - F.col("x.a.pos")), F.lit(-1)).alias("distance"), F.coalesce(F.col("x.a.pos") > F.col("x.b.pos"), F.lit(False)).alias("reversed"), ids.gene_free(F.col("key")).alias("free"))


@query(f"WITH {CALLS}, v AS (SELECT DISTINCT gene, chrom, pos, ref, alt FROM calls), r AS (SELECT *, CASE pos % 4 WHEN 0 THEN ref WHEN 1 THEN alt WHEN 2 THEN translate(ref, 'ACGT', 'TGCA') END AS base FROM v WHERE pos % 7 <> 0), j AS (SELECT v.*, base FROM v LEFT JOIN r USING (gene, chrom, pos, ref, alt)), s AS (SELECT *, CASE WHEN base IS NULL THEN 'unknown' WHEN ref = base THEN 'match' WHEN alt = base THEN 'swapped' WHEN translate(ref, 'ACGT', 'TGCA') = base THEN 'complement' ELSE 'unresolved' END AS status FROM j) SELECT status, CASE status WHEN 'swapped' THEN alt WHEN 'complement' THEN translate(ref, 'ACGT', 'TGCA') ELSE ref END AS ref, CASE status WHEN 'swapped' THEN ref WHEN 'complement' THEN translate(alt, 'ACGT', 'TGCA') ELSE alt END AS alt, count(*) AS n FROM s GROUP BY ALL")
def repaired_alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alleles checked against reference bases: match, swap, complement or neither."""
    v = calls(spark, sf_dir).select("gene", "chrom", "pos", "ref", "alt").distinct()
    k = F.col("pos") % 4
    base = F.when(k == 0, F.col("ref")).when(k == 1, F.col("alt")).when(k == 2, ids.complement(F.col("ref")))
    known = v.where("pos % 7 <> 0").select("chrom", "pos", base.alias("base")).distinct()
    return tables.repaired_alleles(v, known).groupBy("status", "ref", "alt").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS id, least(l_partkey, l_suppkey*20) AS pos1, greatest(l_partkey, l_suppkey*20) AS pos2, CASE WHEN l_partkey > l_suppkey*20 THEN 'b' ELSE 'a' END AS name1, CASE WHEN l_partkey > l_suppkey*20 THEN 'a' ELSE 'b' END AS name2, greatest(l_partkey, l_suppkey*20) - least(l_partkey, l_suppkey*20) <= 600 AS near FROM lineitem")
def ordered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column pair swapped where positions are out of order, and a distance filter as a flag."""
    d = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("pos1"), (F.col("l_suppkey") * 20).alias("pos2"), F.lit("a").alias("name1"), F.lit("b").alias("name2"))
    return tables.ordered_pairs(d).withColumn("near", F.col("pos2") - F.col("pos1") <= 600)


@query("SELECT source, count(*) AS n, count(value)::BIGINT AS n_value, count(tag)::BIGINT AS n_tag FROM (SELECT 'events' AS source, value, NULL AS tag FROM events UNION ALL SELECT 'orders', NULL, o_orderpriority FROM orders UNION ALL SELECT 'lineitem', l_tax, l_returnflag FROM lineitem) GROUP BY source")
def united_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of different columns aligned to one schema and united."""
    e = table(spark, sf_dir, "events").select(F.lit("events").alias("source"), "value")
    o = table(spark, sf_dir, "orders").select(F.lit("orders").alias("source"), F.col("o_orderpriority").alias("tag"))
    li = table(spark, sf_dir, "lineitem").select(F.lit("lineitem").alias("source"), F.col("l_tax").alias("value"), F.col("l_returnflag").alias("tag"))
    schema = StructType.fromDDL("source string, value double, tag string")
    return tables.union_by_name([tables.aligned(x, schema) for x in (e, o, li)]).groupBy("source").agg(F.count("*").alias("n"), F.count("value").alias("n_value"), F.count("tag").alias("n_tag"))


@query("SELECT o_custkey, o_orderkey, 'p_' || lpad((row_number() OVER (ORDER BY o_custkey))::VARCHAR, 5, '0') AS pair_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first order of each customer in a stated order, numbered by customer.

    Numbers come from counts per hash range of the key, so no window holds all rows.
    """
    f = ranking.first_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")
    f = f.withColumn("part", F.floor(F.col("o_custkey") / 1000))
    base = f.groupBy("part").agg(F.count("*").alias("n"))
    base = base.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    number = F.col("base") + F.row_number().over(Window.partitionBy("part").orderBy("o_custkey"))
    return f.join(base, "part").select("o_custkey", "o_orderkey", F.concat(F.lit("p_"), F.lpad(number.cast("string"), 5, "0")).alias("pair_id"))


@query("SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 10 OR source = 'src0'")
def truncated_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rows per source, one source whole: a report of the first few."""
    w = Window.partitionBy("source").orderBy("doc_id")
    return table(spark, sf_dir, "documents").withColumn("r", F.row_number().over(w)).where("r <= 10 or source = 'src0'").select("source", "doc_id")


@query("WITH a AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 > 0 THEN p_retailprice END AS af FROM part) SELECT l_orderkey, l_linenumber, round(coalesce(x.af, y.af), 6) AS maf1, round(y.af, 6) AS maf2 FROM lineitem LEFT JOIN a x ON x.k = l_partkey LEFT JOIN a y ON y.k = l_suppkey")
def allele_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies of both members of a pair by two left joins, the first falling back on the second."""
    a = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 > 0, F.col("p_retailprice")).alias("af"))
    x, y = (a.select(F.col("p_partkey").alias(f"k{k}"), F.col("af").alias(f"af{k}")) for k in (1, 2))
    li = table(spark, sf_dir, "lineitem")
    j = li.join(x, li.l_partkey == x.k1, "left").join(y, li.l_suppkey == y.k2, "left")
    return j.select("l_orderkey", "l_linenumber", F.round(F.coalesce("af1", "af2"), 6).alias("maf1"), F.round("af2", 6).alias("maf2"))


@query("SELECT DISTINCT unnest([l_partkey, l_suppkey]) AS variant FROM lineitem")
def unique_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.explode(F.array("l_partkey", "l_suppkey")).alias("variant")).distinct()


SEQS = "sq AS (SELECT doc_id AS id, translate(md5(doc_id::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM documents), ps AS (SELECT id, seq, unnest(range(0, 32))::INT AS pos FROM sq), rb AS (SELECT *, substr(seq, pos + 1, 1) AS ref FROM ps), sb AS (SELECT *, unnest(['A', 'C', 'G', 'T']) AS alt FROM rb)"


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.translate(F.md5(F.col("doc_id").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT").alias("seq"))


@query(f"WITH {SEQS} SELECT id, pos, ref, alt, substr(seq, 1, pos) || alt || substr(seq, pos + 2) AS mutant FROM sb WHERE alt <> ref")
def single_substitutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = maps.single_substitutions(sequences(spark, sf_dir), ["id", "seq"], "seq")
    return s.select("id", "pos", "ref", "alt", maps.substituted(F.col("seq"), F.col("pos"), F.col("alt")).alias("mutant"))


@query(f"WITH {SEQS} SELECT a.id, count(*) AS n, sum(a.pos*b.pos)::BIGINT AS mark FROM sb a JOIN sb b ON a.id = b.id AND b.pos - a.pos BETWEEN 1 AND 5 WHERE a.alt <> a.ref AND b.alt <> b.ref GROUP BY a.id")
def double_substitutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = maps.double_substitutions(sequences(spark, sf_dir), ["id"], "seq", 5)
    return d.groupBy("id").agg(F.count("*").alias("n"), F.sum((F.col("pos1") * F.col("pos2")).cast("long")).alias("mark"))


MAPS = """nu AS (SELECT unnest(['A', 'C', 'G', 'T']) AS nuc), po AS (SELECT unnest(range(0, 12))::INT AS pos), bk AS (SELECT item_id AS id FROM benchmark),
ba AS (SELECT id, pos AS pos_j, nuc, (1 + ascii(md5(id || ':' || pos || ':' || nuc)))::DOUBLE AS p FROM bk, po, nu),
mu AS (SELECT id, a.pos AS pos_i, b.pos AS pos_j, nuc, (1 + ascii(md5(id || ':' || a.pos || ':' || b.pos || ':' || nuc)))::DOUBLE AS p FROM bk, po a, po b, nu WHERE a.pos <> b.pos),
m1 AS (SELECT id, pos_i, pos_j, max(abs(ln((mu.p + 1e-10)/(ba.p + 1e-10)))) AS s FROM mu JOIN ba USING (id, pos_j, nuc) GROUP BY id, pos_i, pos_j), mp AS (SELECT a.id, a.pos_i, a.pos_j, greatest(a.s, b.s) AS score FROM m1 a JOIN m1 b ON a.id = b.id AND a.pos_i = b.pos_j AND a.pos_j = b.pos_i)"""


def dependency(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))
    place = F.sequence(F.lit(0), F.lit(11))
    base = b.withColumn("pos_j", F.explode(place)).withColumn("nuc", F.explode(maps.bases()))
    text = lambda *c: (1 + F.ascii(F.md5(F.concat_ws(":", *[F.col(x).cast("string") for x in c])))).cast("double")
    mutant = base.withColumn("pos_i", F.explode(place)).where("pos_i <> pos_j")
    return maps.dependency_map(mutant.withColumn("p", text("id", "pos_i", "pos_j", "nuc")), base.withColumn("p", text("id", "pos_j", "nuc")), ["id"])


@query(f"WITH {MAPS} SELECT id, pos_i, pos_j, round(score, 6) AS score FROM mp")
def dependency_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-odds map from nucleotide probabilities with and without a mutation."""
    return dependency(spark, sf_dir).select("id", "pos_i", "pos_j", F.round("score", 6).alias("score"))


@query(f"""WITH {MAPS}, fu AS (SELECT * FROM mp UNION ALL SELECT id, pos, pos, 0.0 FROM bk, po), ap AS (SELECT *, avg(score) OVER (PARTITION BY id, pos_i) AS r, avg(score) OVER (PARTITION BY id, pos_j) AS c, avg(score) OVER (PARTITION BY id) AS w, avg(score) OVER (PARTITION BY id, abs(pos_i - pos_j)) AS g FROM fu)
SELECT id, pos_i, pos_j, round(CASE WHEN pos_i = pos_j THEN 0.0 ELSE score - r*c/w END, 6) + 0.0 AS apc, round(CASE WHEN pos_i = pos_j THEN 0.0 ELSE score - g END, 6) + 0.0 AS normalised FROM ap""")
def corrected_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average-product correction and distance normalisation of full maps."""
    d = dependency(spark, sf_dir)
    own = d.select("id", "pos_i").distinct().select("id", "pos_i", F.col("pos_i").alias("pos_j"), F.lit(0.0).alias("score"))
    full = ranking.product_correction(d.unionByName(own), "pos_i", "pos_j", "score", ["id"])
    full = ranking.distance_normalise(full, "pos_i", "pos_j", "score", ["id"])
    return full.select("id", "pos_i", "pos_j", r6(F.col("apc")).alias("apc"), r6(F.col("normalised")).alias("normalised"))


@query(f"WITH {MAPS}, k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, pos_i, pos_j) AS r, quantile_cont(score, 0.9) OVER (PARTITION BY id) AS q FROM mp WHERE pos_i < pos_j) SELECT id, pos_i, pos_j, r AS rank FROM k WHERE r <= 5 AND score >= q AND pos_j - pos_i >= 2")
def top_map_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each map the five best pairs, if past its 90th percentile and two apart."""
    d = dependency(spark, sf_dir).where("pos_i < pos_j")
    q = d.groupBy("id").agg(F.percentile("score", 0.9).alias("q"))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "pos_i", "pos_j")
    return d.withColumn("rank", F.row_number().over(w).cast("long")).join(q, "id").where("rank <= 5 and score >= q and pos_j - pos_i >= 2").select("id", "pos_i", "pos_j", "rank")


@query(f"WITH {MAPS}, tr AS (SELECT *, 1.0/(pos_j - pos_i) AS t FROM mp WHERE pos_i < pos_j), g AS (SELECT unnest([1, 3, 5]) AS apart) SELECT id, apart, count(*) AS n, round(corr(score, t), 6) + 0.0 AS r FROM tr, g WHERE pos_j - pos_i >= apart GROUP BY id, apart")
def map_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of predicted and true maps over their upper triangles at several least separations."""
    d = dependency(spark, sf_dir).where("pos_i < pos_j").withColumn("t", 1.0 / (F.col("pos_j") - F.col("pos_i")))
    d = d.withColumn("apart", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5)))).where("pos_j - pos_i >= apart")
    return d.groupBy("id", "apart").agg(F.count("*").alias("n"), r6(F.corr("score", "t")).alias("r"))


@query()
def bracket_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base pairs of structures made from documents' line lengths, nested and crossing."""
    s = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.repeat(F.lit("("), (F.col("n_chars") % 7 + 1).cast("int")), F.repeat(F.lit("["), (F.col("n_chars") % 3).cast("int")), F.lit(".."), F.repeat(F.lit(")"), (F.col("n_chars") % 7 + 1).cast("int")), F.repeat(F.lit("]"), (F.col("n_chars") % 3).cast("int"))).alias("s"))
    return maps.bracket_pairs(s, ["doc_id"], "s")


@query()
def model_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user model over sequences, loaded once per task, failures kept as rows."""
    out = embedding.embed(sequences(spark, sf_dir), "seq", embedding.kmer_model, ["id"])
    return out.select("id", F.size("embedding").alias("dim"), F.round(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x), 3).alias("total"), "error")
