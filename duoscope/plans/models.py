"""Queries on user models and their maps, template subspaces, calibration stability and matched survival of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibration, cascade, embedding, maps, subspaces
from ..operators import statistics as st
from ..operators.lineage import fixed
from .curation import sequences
from .genome import LETTERS, LOWER, UPPER
from .geometry import residuals
from .standins import CALLS, CLINICAL, calls, clinical, scored, table
from .statistics import LOGRANK

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


SEQS = "sq AS (SELECT doc_id AS id, translate(md5(doc_id::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM documents)"


@query(f"""WITH {SEQS}, ps AS (SELECT id, seq, unnest(range(0, 32))::INT AS pos FROM sq), w AS (SELECT id, pos, substr(seq, greatest(pos - 1, 1), pos + 4 - greatest(pos - 1, 1)) AS s FROM ps), n AS (SELECT *, unnest(['A', 'C', 'G', 'T']) AS nuc FROM w)
SELECT id, pos, nuc, round((1 + len(s) - len(replace(s, nuc, '')))/(4 + len(s))::DOUBLE, 6) AS p FROM n""")
def predicted_nucleotides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's nucleotide predictor over sequences, its rows checked to sum to one."""
    p = embedding.nucleotides(sequences(spark, sf_dir), "seq", embedding.window_predictor, ["id"])
    return p.select("id", "pos", "nuc", F.round("p", 6).alias("p"))


@query(f"""WITH {SEQS}, ps AS (SELECT id, substr(seq, b*8 + 1, 8) AS s, (b*8)::INT AS pos FROM sq, (SELECT unnest(range(0, 4)) AS b)), t AS (SELECT id, 0 AS track, pos, len(replace(replace(s, 'A', ''), 'T', ''))/8.0 AS value FROM ps UNION ALL SELECT id, 1, pos, (8 - len(replace(s, 'A', '')))/8.0 FROM ps)
SELECT id, track, pos, round(value::DOUBLE, 6) AS value FROM t""")
def predicted_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's track model over sequences."""
    return embedding.tracks(sequences(spark, sf_dir), "seq", embedding.content_tracks, ["id"]).select("id", "track", "pos", F.round("value", 6).alias("value"))


@query("WITH b AS (SELECT vec_id // 4 AS pair, vec_id % 4 AS role, embedding FROM embeddings) SELECT x.pair, round(list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))), 4) AS distance FROM b x JOIN b y ON x.pair = y.pair AND x.role = 0 AND y.role = 3")
def custom_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's own distance (here the sum of absolute differences) of the first and the last vector of each pair."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("pair"), (F.col("vec_id") % 4).alias("role"), F.col("embedding").cast("array<double>").alias("x"))
    two = e.where("role = 0").select("pair", "x").join(e.where("role = 3").select("pair", F.col("x").alias("y")), "pair")
    return two.select("pair", F.round(embedding.custom_distance(lambda a, b: abs(a - b).sum())(F.col("x"), F.col("y")), 4).alias("distance"))


LOGITS = """nu AS (SELECT unnest(['A', 'C', 'G', 'T']) AS nuc), po AS (SELECT unnest(range(0, 12))::INT AS pos), bk AS (SELECT item_id AS id FROM benchmark),
ba AS (SELECT id, pos AS pos_j, nuc, (1 + ascii(md5(id || ':' || pos || ':' || nuc)))::DOUBLE + 1e-10 AS p FROM bk, po, nu), bn AS (SELECT *, p/sum(p) OVER (PARTITION BY id, pos_j) AS q FROM ba),
mu AS (SELECT id, a.pos AS pos_i, b.pos AS pos_j, al.nuc AS alt, nu.nuc, (1 + ascii(md5(id || ':' || a.pos || ':' || al.nuc || ':' || b.pos || ':' || nu.nuc)))::DOUBLE + 1e-10 AS p FROM bk, po a, po b, nu al, nu), mn AS (SELECT *, p/sum(p) OVER (PARTITION BY id, pos_i, alt, pos_j) AS q FROM mu),
lm AS (SELECT id, pos_i, pos_j, max(CASE WHEN pos_i = pos_j THEN 0.0 ELSE abs(log2(mn.q) - log2(1 - mn.q) - log2(bn.q) + log2(1 - bn.q)) END) AS s FROM mn JOIN bn USING (id, pos_j, nuc) GROUP BY id, pos_i, pos_j)"""


@query(f"WITH {LOGITS} SELECT a.id, a.pos_i, a.pos_j, round(greatest(a.s, b.s), 6) AS score FROM lm a JOIN lm b ON a.id = b.id AND a.pos_i = b.pos_j AND a.pos_j = b.pos_i")
def logit_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map of base-2 logit differences from nucleotide probabilities with and without each mutation."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"))
    place = F.sequence(F.lit(0), F.lit(11))
    base = b.withColumn("pos_j", F.explode(place)).withColumn("nuc", F.explode(maps.bases()))
    text = lambda *c: (1 + F.ascii(F.md5(F.concat_ws(":", *[F.col(x).cast("string") for x in c])))).cast("double")
    mutant = base.withColumn("pos_i", F.explode(place)).withColumn("alt", F.explode(maps.bases()))
    out = maps.logit_map(mutant.withColumn("p", text("id", "pos_i", "alt", "pos_j", "nuc")), base.withColumn("p", text("id", "pos_j", "nuc")), ["id"])
    return out.select("id", "pos_i", "pos_j", F.round("score", 6).alias("score"))


def tokens(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """A stand-in for a model's tokens: one before and one after the bases, each with code, neighbours and the whole's mean."""
    at = lambda c, i: F.coalesce(F.get(c, i), F.lit(0)).cast("double")
    t = df.select(*keys, coded(F.col(seq)).alias("_c")).withColumn("_m", F.aggregate("_c", F.lit(0.0), lambda s, x: s + x) / F.size("_c"))
    vec = lambda i: F.array(at(F.col("_c"), i), (at(F.col("_c"), i - 1) + at(F.col("_c"), i + 1)) / 2, F.col("_m"))
    return t.select(*keys, F.posexplode(F.transform(F.sequence(F.lit(0), F.size("_c") - 1), vec)).alias("token", "vec"))


def coded(seq: Column) -> Column:
    """Codes 1 to 4 of the bases of a sequence, 0 before and after."""
    code = lambda c: F.when(c == "A", 1).when(c == "C", 2).when(c == "G", 3).when(c == "T", 4).otherwise(0)
    return F.transform(F.split(F.concat(F.lit("N"), seq, F.lit("N")), ""), code)


def spelled_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the items' texts as a sequence of bases: ASCII letters become bases, everything else parts words."""
    letters = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    words = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split(letters, "[^a-z]+")).alias("k", "w")).where("w <> ''")
    return words.select(F.concat_ws(":", F.col("item_id").cast("string"), F.col("k").cast("string")).alias("id"), (F.col("k") % 3).alias("lead"), F.translate("w", LOWER, LETTERS).alias("seq"))


WORDS = f"ws AS (SELECT item_id, string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^a-z]+') AS w FROM benchmark), wk AS (SELECT item_id, unnest(w) AS w, unnest(range(0, len(w))) AS k FROM ws), wo AS (SELECT item_id || ':' || k AS id, k % 3 AS lead, translate(w, '{LOWER}', '{LETTERS}') AS seq FROM wk WHERE w <> '')"


def moved(s: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tokens of sequences ``id, seq``, of all their single substitutions, and the offset of the first base's token."""
    changed = maps.single_substitutions(s.select("id", "seq"), ["id", "seq"], "seq").withColumn("seq", maps.substituted(F.col("seq"), F.col("pos"), F.col("alt")))
    mutant = tokens(changed.withColumnRenamed("pos", "pos_i"), ["id", "pos_i", "alt"], "seq")
    return tokens(s, ["id"], "seq"), mutant, first_base(s.withColumn("lead", F.lit(0)))


def first_base(s: DataFrame) -> DataFrame:
    """``id, offset``: the token that a change of the first base moves most, behind ``lead`` unknown bases and a first token."""
    led = lambda seq: F.concat(F.repeat(F.lit("N"), F.col("lead").cast("int")), seq)
    probe = F.concat(F.when(F.col("seq").startswith("C"), "A").otherwise("C"), F.substring("seq", F.lit(2), F.length("seq")))
    whole = tokens(s.withColumn("seq", led(F.col("seq"))), ["id"], "seq")
    # As many tokens must follow as the shortest sequence has bases.
    return maps.token_offset(whole, tokens(s.withColumn("seq", led(probe)), ["id"], "seq"), ["id"], F.lit(1))


@query(f"WITH {WORDS} SELECT id, (1 + lead)::INT AS \"offset\" FROM wo")
def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token of the first base of each word, behind one that starts each sequence and up to two unknown bases."""
    return first_base(spelled_words(spark, sf_dir)).select("id", F.col("offset").cast("int").alias("offset"))


@query(f"""WITH {WORDS}, ps AS (SELECT id, len(seq) AS n, substr(seq, p, 1) AS ref, (p - 1)::INT AS pos FROM (SELECT id, seq, unnest(range(1, len(seq) + 1)) AS p FROM wo)),
mv AS (SELECT id, n, pos, max(abs(strpos('ACGT', alt) - strpos('ACGT', ref))) AS d FROM ps, (SELECT unnest(['A', 'C', 'G', 'T']) AS alt) WHERE ref <> 'N' AND alt <> ref GROUP BY ALL),
di AS (SELECT mv.id, mv.pos AS pos_i, ps.pos AS pos_j, sqrt(power(CASE WHEN abs(mv.pos - ps.pos) = 1 THEN d/2.0 ELSE 0 END, 2) + power(d/(mv.n + 2.0), 2)) AS s FROM mv JOIN ps ON ps.id = mv.id AND ps.pos <> mv.pos)
SELECT a.id, a.pos_i, a.pos_j, round(greatest(a.s, coalesce(b.s, a.s)), 6) AS score FROM di a LEFT JOIN di b ON a.id = b.id AND a.pos_i = b.pos_j AND a.pos_j = b.pos_i""")
def perturbation_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far tokens of a word move under each mutation of its bases, the larger of both ways.

    The SQL knows that a mutation moves a token by half its code next door and by its share of the mean elsewhere.
    """
    s = spelled_words(spark, sf_dir)
    whole, mutant, offsets = moved(s)
    out = maps.perturbation_map(whole, mutant, offsets.join(s.select("id", F.length("seq").alias("length")), "id"), ["id"])
    return out.select("id", "pos_i", "pos_j", F.round("score", 6).alias("score"))


@query()
def template_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axes of the residuals with the strongest log magnitude ratios, and whether those lie in them more than weak ones."""
    r = residuals(spark, sf_dir).join(scored(spark, sf_dir).select("pair", "log_magnitude_ratio"), "pair")
    axes = subspaces.template_axes(r, "residual", "log_magnitude_ratio", 10)
    out = subspaces.template_contrast(r, axes, "residual", "log_magnitude_ratio")
    return out.withColumn("p", st.normal_tail(F.col("z")))


@query()
def calibration_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of mean distances under covariances of parts of the null residuals."""
    return calibration.stability(residuals(spark, sf_dir).where("is_null"), "residual", "pair", [0.25, 0.5, 0.75, 1.0], 10)


@query()
def ridge_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of a distance along the null's leading axis with the ridge."""
    c = calibration.covariance(calibration.gram(residuals(spark, sf_dir).where("is_null"), ["model"], "residual"), ["model"])
    return calibration.ridge_sensitivity(c, ["model"], [0.0, 1e-8, 1e-6, 1e-4, 1e-2])


MATCHED = f"""{CALLS}, {CLINICAL}, pl AS (SELECT DISTINCT gene, case_id, pos FROM calls), nm AS (SELECT gene, case_id, count(*) AS n FROM pl GROUP BY ALL), tm AS (SELECT case_id, count(*) AS tmb FROM calls GROUP BY case_id),
pe AS (SELECT gene, case_id, n, tmb, duration, event, project FROM nm JOIN tm USING (case_id) JOIN clinical USING (case_id)),
pr AS (SELECT a.gene, a.pos AS pos1, b.pos AS pos2 FROM pl a JOIN pl b ON a.gene = b.gene AND a.case_id = b.case_id AND a.pos < b.pos GROUP BY ALL HAVING count(*) >= 3), tg AS (SELECT pr.*, a.case_id FROM pr JOIN pl a ON a.gene = pr.gene AND a.pos = pos1 JOIN pl b ON b.gene = pr.gene AND b.pos = pos2 AND b.case_id = a.case_id),
tn AS (SELECT gene, pos1, pos2, n, count(*) AS k FROM tg JOIN pe USING (gene, case_id) GROUP BY ALL), sz AS (SELECT gene, n, count(*) AS m FROM pe GROUP BY ALL), le AS (SELECT DISTINCT gene, pos1, pos2, unnest(CASE WHEN m - k < 3 THEN [n - 1, n, n + 1] ELSE [n] END) AS n FROM tn JOIN sz USING (gene, n)),
c0 AS (SELECT DISTINCT pr.gene, pos1, pos2, pl.case_id FROM pr JOIN pl ON pl.gene = pr.gene AND (pl.pos = pos1 OR pl.pos = pos2) WHERE NOT EXISTS (SELECT 1 FROM tg WHERE tg.gene = pr.gene AND tg.pos1 = pr.pos1 AND tg.pos2 = pr.pos2 AND tg.case_id = pl.case_id)),
c1 AS (SELECT le.gene, pos1, pos2, case_id FROM le JOIN pe USING (gene, n) WHERE NOT EXISTS (SELECT 1 FROM tg WHERE tg.gene = le.gene AND tg.pos1 = le.pos1 AND tg.pos2 = le.pos2 AND tg.case_id = pe.case_id)),
md AS (SELECT gene, pos1, pos2, quantile_cont(tmb, 0.5) AS med FROM tg JOIN pe USING (gene, case_id) GROUP BY ALL),
al AS (SELECT gene, pos1, pos2, case_id, 1 AS grp, unnest([0, 1, 2]) AS level FROM tg UNION ALL SELECT gene, pos1, pos2, case_id, 0, 0 FROM c0 UNION ALL SELECT gene, pos1, pos2, case_id, 0, 1 FROM c1
  UNION ALL SELECT gene, pos1, pos2, case_id, 0, 2 FROM c1 JOIN pe USING (gene, case_id) JOIN md USING (gene, pos1, pos2) WHERE tmb BETWEEN med*0.5 AND med*1.5),
ev AS (SELECT gene, pos1, pos2, level, grp, duration, event, project, tmb FROM al JOIN pe USING (gene, case_id))"""


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Both are read many times; lines meet orders and parts once.
    counted = fixed(calls(spark, sf_dir).groupBy("gene", "case_id", "pos").agg(F.count("*").alias("k")))
    positions = counted.select("gene", "case_id", "pos")
    people = positions.groupBy("gene", "case_id").agg(F.count("*").alias("n")).join(counted.groupBy("case_id").agg(F.sum("k").alias("tmb")), "case_id").join(clinical(spark, sf_dir), "case_id")
    return cascade.cohorts(fixed(cascade.carried_pairs(positions, 3)), positions, fixed(people))


@query(f"""WITH {MATCHED}, co AS (SELECT * FROM ev){LOGRANK.format(k='gene, pos1, pos2, level')}, s AS (SELECT gene, pos1, pos2, level, sum(grp) AS t, count(*) - sum(grp) AS c FROM co GROUP BY ALL),
x AS (SELECT gene, pos1, pos2, level, t, c, CASE WHEN v > 0 THEN power(o - e, 2)/v END AS chi2 FROM s JOIN lr USING (gene, pos1, pos2, level) WHERE t >= 2 AND c >= 3)
SELECT z.gene, z.pos1, z.pos2, z.t::BIGINT AS n_target, z.c::BIGINT AS n_control_0, round(z.chi2, 6) AS chi2_0, a.c::BIGINT AS n_control_1, round(a.chi2, 6) AS chi2_1, b.c::BIGINT AS n_control_2, round(b.chi2, 6) AS chi2_2
FROM x z LEFT JOIN x a ON (a.gene, a.pos1, a.pos2, a.level) = (z.gene, z.pos1, z.pos2, 1) LEFT JOIN x b ON (b.gene, b.pos1, b.pos2, b.level) = (z.gene, z.pos1, z.pos2, 2) WHERE z.level = 0 AND z.chi2 IS NOT NULL""")
def survival_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carriers of two positions of a gene against controls of levels 0 to 2."""
    t = cascade.cascade(matched(spark, sf_dir))
    return t.select("gene", "pos1", "pos2", "n_target", *[c for k in range(3) for c in (f"n_control_{k}", F.round(f"chi2_{k}", 6).alias(f"chi2_{k}"))])


@query(f"""WITH {MATCHED}, co AS (SELECT * FROM ev WHERE level = 2){LOGRANK.format(k='gene, pos1, pos2, project')}, s AS (SELECT gene, pos1, pos2, sum(power(o - e, 2)/v) AS chi2, count(*) AS df FROM lr WHERE v > 0 GROUP BY ALL)
SELECT gene, pos1, pos2, round(chi2, 6) AS chi2, df FROM s""")
def survival_cascade_by_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level 3: the chi-squares of level 2 by project, summed."""
    two = matched(spark, sf_dir).where("level = 2")
    s = st.stratified_log_rank(st.log_rank_counted(two, ["gene", "pos1", "pos2", "project"]), ["gene", "pos1", "pos2"])
    return s.select("gene", "pos1", "pos2", F.round("chi2", 6).alias("chi2"), "df")


@query()
def survival_cascade_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All levels with p-values, the balance of burdens, and whether a pair is kept."""
    return cascade.cascade(matched(spark, sf_dir))


@query()
def survival_by_pair_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next query's tests with p-values, and q-values within each project and over all."""
    return cascade.pair_tests(matched(spark, sf_dir), True).select("gene", "pos1", "pos2", "project", "n_target", "n_control", "direction", "chi2", "p", "q")


@query(f"""WITH {MATCHED}, co AS (SELECT gene, pos1, pos2, grp, duration, event, unnest(['ALL', project]) AS project FROM ev WHERE level = 1){LOGRANK.format(k='gene, pos1, pos2, project')},
s AS (SELECT gene, pos1, pos2, project, sum(grp)::BIGINT AS n_target, (count(*) - sum(grp))::BIGINT AS n_control, quantile_cont(duration, 0.5) FILTER (grp = 1) AS a, quantile_cont(duration, 0.5) FILTER (grp = 0) AS b FROM co GROUP BY ALL HAVING sum(grp) >= 2 AND count(*) - sum(grp) >= 3),
k AS (SELECT gene, pos1, pos2, project, count(*) AS k, row_number() OVER (PARTITION BY gene, pos1, pos2 ORDER BY count(*) DESC, project) AS r FROM ev WHERE level = 1 AND grp = 1 GROUP BY gene, pos1, pos2, project), tp AS (SELECT gene, pos1, pos2, string_agg(project || '(' || k || ')', '; ' ORDER BY r) AS top FROM k WHERE r <= 3 GROUP BY ALL)
SELECT gene, pos1, pos2, project, n_target, n_control, round(a, 3) AS target_median, round(b, 3) AS control_median, CASE WHEN a < b THEN 'worse' ELSE 'better' END AS direction, CASE WHEN project = 'ALL' THEN top ELSE project END AS top, round(CASE WHEN v > 0 THEN power(o - e, 2)/v END, 6) AS chi2
FROM s JOIN lr USING (gene, pos1, pos2, project) JOIN tp USING (gene, pos1, pos2)""")
def survival_by_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carriers against controls of the same number of mutations, over all projects and within each."""
    t = cascade.pair_tests(matched(spark, sf_dir))
    return t.select("gene", "pos1", "pos2", "project", "n_target", "n_control", F.round("target_median", 3).alias("target_median"), F.round("control_median", 3).alias("control_median"), "direction", "top", F.round("chi2", 6).alias("chi2"))
