"""Queries on a reference in chunks: genotype sequences, random windows, conditional tables and epistasis maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..operators import genome, substitution
from .standins import r6, table

QUERIES, SQL = {}, {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bases that stand for the letters of a text, the last one unknown.
LETTERS = "ACGT" * 6 + "AN"
#: Bases of a chunk, so small that windows of documents cross several.
WIDTH = 256


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: A table of bytes, and the bytes that fall out.
TO = bytes.maketrans((UPPER + LOWER).encode(), (LETTERS * 2).encode())
DROP = bytes(k for k in range(256) if not chr(k).isascii() or not chr(k).isalpha())


@F.udf(StringType(), useArrow=False)
def spelling(text: str | None) -> str:
    """Bases of the ASCII letters of a text, by one table of bytes; null is empty.

    Rows come a hundred at a time, as they do without Arrow, so a task holds few texts, however many it reads.
    """
    return "" if text is None else text.encode().translate(TO, DROP).decode()


def spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as sequences: ASCII letters become bases, everything else falls out. Each is a chromosome.

    Filters on the sequence stay above the function, so a text is spelled once wherever it is read.
    """
    seq = spelling.asNondeterministic()("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("chrom"), seq.alias("seq"))


SPELLED = f"sq AS (SELECT doc_id, doc_id::VARCHAR AS chrom, translate(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^a-z]', '', 'g'), '{LOWER}', '{LETTERS}') AS seq FROM documents)"


def pairs(s: DataFrame, apart: Column) -> DataFrame:
    """Two variants per chromosome, the first after a third of it; some name a wrong reference allele, half are reverse."""
    d = s.where(F.length("seq") > 0).withColumn("pos1", (1 + F.floor(F.length("seq") / 3)).cast("int")).withColumn("pos2", (F.col("pos1") + apart).cast("int"))
    base = lambda p: F.substring("seq", F.col(p), F.lit(1))
    d = d.withColumn("ref1", F.when(F.col("doc_id") % 10 == 0, "A").otherwise(base("pos1"))).withColumn("ref2", F.when(F.col("pos2") > F.length("seq"), "A").otherwise(base("pos2")))
    alt = lambda c: F.translate(c, "ACGTN", "CGTAA").alias(c.replace("ref", "alt"))
    return d.select("doc_id", "chrom", "pos1", "pos2", "ref1", "ref2", alt("ref1"), alt("ref2"), (F.col("doc_id") % 2 == 1).alias("rev"))


def genotyped(apart: str, context: int) -> str:
    return f"""{SPELLED}, pa AS (SELECT doc_id, seq, len(seq) AS n, 1 + len(seq)//3 AS pos1, 1 + len(seq)//3 + {apart} AS pos2, doc_id % 2 = 1 AS rev FROM sq WHERE len(seq) > 0),
pb AS (SELECT *, greatest(pos1 - 1 - {context}, 0) AS lo, least(pos2 + {context} - 1, n) AS hi, pos2 > n AS far, CASE WHEN doc_id % 10 = 0 THEN 'A' ELSE substr(seq, pos1, 1) END AS ref1, substr(seq, pos2, 1) AS ref2 FROM pa),
pc AS (SELECT *, substr(seq, lo + 1, hi - lo) AS w, pos1 - 1 - lo AS i1, pos2 - 1 - lo AS i2, translate(ref1, 'ACGTN', 'CGTAA') AS alt1, translate(ref2, 'ACGTN', 'CGTAA') AS alt2 FROM pb),
pd AS (SELECT *, substr(w, 1, i1) || alt1 || substr(w, i1 + 2) AS a, substr(w, 1, i2) || alt2 || substr(w, i2 + 2) AS b, substr(w, 1, i1) || alt1 || substr(w, i1 + 2, i2 - i1 - 1) || alt2 || substr(w, i2 + 2) AS c FROM pc),
ge AS (SELECT doc_id, CASE WHEN far THEN 'outside' WHEN substr(w, i1 + 1, 1) <> ref1 THEN 'mismatch' ELSE 'ok' END AS status, CASE WHEN NOT far THEN CASE WHEN rev THEN len(w) - 1 - i1 ELSE i1 END END AS idx1, CASE WHEN NOT far THEN CASE WHEN rev THEN len(w) - 1 - i2 ELSE i2 END END AS idx2,
  {', '.join(f"CASE WHEN NOT far THEN CASE WHEN rev THEN translate(reverse({x}), 'ACGT', 'TGCA') ELSE {x} END END AS {n}" for x, n in zip("wabc", ("wt", "m1", "m2", "m12"), strict=True))} FROM pd)"""


@query(f"WITH {genotyped('1 + len(seq) % 400', 300)} SELECT doc_id, status, idx1::INT AS idx1, idx2::INT AS idx2, len(wt)::INT AS n_bases, md5(wt) AS wt, md5(m1) AS m1, md5(m2) AS m2, md5(m12) AS m12 FROM ge")
def genotype_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four sequences of a pair per document, windows of three chunks and more, half of them reverse complements."""
    s = spelled(spark, sf_dir)
    g = genome.genotypes(pairs(s, 1 + F.length("seq") % 400), genome.chunks(s, width=WIDTH), "doc_id", 300, WIDTH)
    return g.select("doc_id", "status", "idx1", "idx2", F.length("wt").alias("n_bases"), *[F.md5(c).alias(c) for c in ("wt", "m1", "m2", "m12")])


def hashed(*parts: str) -> str:
    return f"(('0x' || substr(md5({' || chr(58) || '.join(parts)}), 1, 13))::BIGINT / 4503599627370496.0)"


@query(f"""WITH {SPELLED}, le AS (SELECT chrom, seq, len(seq) AS length FROM sq WHERE len(seq) > 2*200), li AS (SELECT *, sum(length) OVER (ORDER BY chrom)::BIGINT AS hi_, sum(length) OVER ()::BIGINT AS total FROM le),
dr AS (SELECT range AS draw, floor({hashed("'11'", "'place'", "range")}*(SELECT any_value(total) FROM li))::BIGINT AS x FROM range((SELECT 3*count(*) FROM documents))),
fo AS (SELECT draw, chrom, seq, floor({hashed("'11'", "'start'", "draw")}*(length - 200))::BIGINT AS lo FROM dr JOIN li ON x >= hi_ - length AND x < hi_)
SELECT draw, chrom, lo, lo + 200 AS hi, md5(substr(seq, lo + 1, 200)) AS bases FROM fo WHERE 200 - len(replace(substr(seq, lo + 1, 200), 'N', '')) <= 0.01*200""")
def random_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 200 bases drawn by chromosome length, three for each document, those with over 1% of N dropped."""
    n = 3 * table(spark, sf_dir, "documents").count()
    w = genome.random_windows(spark, genome.chunks(spelled(spark, sf_dir), width=WIDTH), n, 200, 11, 0.01, WIDTH)
    return w.select("draw", "chrom", "lo", "hi", F.md5("seq").alias("bases"))


BASES = ("A", "C", "G", "T")


@query(f"""WITH {genotyped('1 + doc_id % 4', 50)}, n1 AS (SELECT doc_id, wt, idx1, idx2, unnest(['A', 'C', 'G', 'T']) AS a FROM ge WHERE wt IS NOT NULL),
ms AS (SELECT *, substr(wt, 1, idx1) || a || substr(wt, idx1 + 2) AS s FROM n1), nb AS (SELECT *, substr(s, greatest(idx2 - 2, 0) + 1, idx2 - greatest(idx2 - 2, 0)) || substr(s, idx2 + 2, 2) AS k FROM ms),
pr AS (SELECT doc_id, a, b, round((1 + len(k) - len(replace(k, b, '')))/(4.0 + len(replace(k, 'N', ''))), 6) AS p FROM nb, (SELECT unnest(['A', 'C', 'G', 'T']) AS b))
SELECT ge.doc_id, any_value(CASE WHEN wt IS NOT NULL THEN substr(wt, idx1 + 1, 1) END) AS ref1_nuc, any_value(CASE WHEN wt IS NOT NULL THEN substr(wt, idx2 + 1, 1) END) AS ref2_nuc,
{', '.join(f"max(CASE WHEN a = '{a}' AND b = '{b}' THEN p END)::DOUBLE AS {a}_{b}" for a in BASES for b in BASES)} FROM ge LEFT JOIN pr USING (doc_id) GROUP BY ge.doc_id""")
def conditional_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A masked model's probabilities at the second place of a pair for each base at the first."""
    s = spelled(spark, sf_dir)
    g = genome.genotypes(pairs(s, 1 + F.col("doc_id") % 4), genome.chunks(s, width=WIDTH), "doc_id", 50, WIDTH)
    t = genome.conditional_table(g.withColumnRenamed("wt", "seq"), genome.masked_neighbours, "doc_id")
    return t.select("doc_id", "ref1_nuc", "ref2_nuc", *[F.round(f"{a}_{b}", 6).alias(f"{a}_{b}") for a in BASES for b in BASES])


#: Places of the map, in every text that has them.
PLACES = [0, 5, 11, 30]
VEC = "{a} AS x1, {c} AS x2, ({g}*{g}/w)::FLOAT::DOUBLE AS x3, ({a}*{t}/w)::FLOAT::DOUBLE AS x4"


def counted(ref: str, alt: str) -> dict[str, str]:
    return {b.lower(): f"({b.lower()} - ({ref} = '{b}')::INT + ({alt} = '{b}')::INT)" for b in BASES}


@query(f"""WITH {SPELLED}, ct AS (SELECT doc_id, seq, {', '.join(f"(len(seq) - len(replace(seq, '{b}', '')))::DOUBLE AS {b.lower()}" for b in BASES)} FROM sq),
st AS (SELECT doc_id, p::INT AS pos, substr(seq, p + 1, 1) AS ref FROM ct, (SELECT unnest({PLACES}) AS p) WHERE p < len(seq)), al AS (SELECT *, unnest(['A', 'C', 'G', 'T']) AS alt FROM st),
ba AS (SELECT doc_id, a, c, g, t, greatest(a + c + g + t, 1) AS w FROM ct), wi AS (SELECT doc_id, {VEC.format(a='a', c='c', g='g', t='t')} FROM ba),
s0 AS (SELECT doc_id, pos, ref, alt, {', '.join(f'{v} AS {k}' for k, v in counted('ref', 'alt').items())} FROM al JOIN ba USING (doc_id) WHERE alt <> ref), s1 AS (SELECT *, greatest(a + c + g + t, 1) AS w FROM s0),
si AS (SELECT doc_id, pos, ref, alt, a, c, g, t, {VEC.format(a='a', c='c', g='g', t='t')} FROM s1),
d0 AS (SELECT i.doc_id, i.pos AS pos_i, j.pos AS pos_j, i.alt AS alt_i, j.alt AS alt_j, {', '.join(f"(i.{b.lower()} - (j.ref = '{b}')::INT + (j.alt = '{b}')::INT) AS {b.lower()}" for b in BASES)} FROM si i JOIN si j ON i.doc_id = j.doc_id AND i.pos < j.pos), d1 AS (SELECT *, greatest(a + c + g + t, 1) AS w FROM d0),
db AS (SELECT doc_id, pos_i, pos_j, alt_i, alt_j, {VEC.format(a='a', c='c', g='g', t='t')} FROM d1),
sc AS (SELECT o.doc_id, o.pos_i, o.pos_j, sqrt({' + '.join(f'power(o.x{k} - m.x{k} - n.x{k} + w.x{k}, 2)' for k in range(1, 5))})/(sqrt({' + '.join(f'power(m.x{k} - w.x{k}, 2) + power(n.x{k} - w.x{k}, 2)' for k in range(1, 5))}) + 1e-20) AS s
  FROM db o JOIN si m ON m.doc_id = o.doc_id AND m.pos = o.pos_i AND m.alt = o.alt_i JOIN si n ON n.doc_id = o.doc_id AND n.pos = o.pos_j AND n.alt = o.alt_j JOIN wi w ON w.doc_id = o.doc_id),
mx AS (SELECT doc_id, pos_i, pos_j, round(max(s), 6) + 0.0 AS score, count(*) AS n FROM sc GROUP BY ALL)
SELECT doc_id, pos_i, pos_j, score, n FROM mx UNION ALL SELECT doc_id, pos_j, pos_i, score, n FROM mx""")
def epistasis_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest epistasis of all substitutions at four places of every text, each genotype of the whole text embedded once."""
    m = substitution.epistasis_maps(spelled(spark, sf_dir).select("doc_id", "seq"), ["doc_id"], "seq", substitution.composition_model, positions=PLACES)
    return m.select("doc_id", "pos_i", "pos_j", r6(F.col("score")).alias("score"), "n")
