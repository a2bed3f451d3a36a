"""Robust multivariate outliers among documents: minimum covariance determinant per language and source.

DataFrame functions only. Estimates come from every row: each concentration step is one pass that sums
moments by group and distance bin, so a group of any size costs a bounded number of partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, attach, settle, text_of, words_of

X = ("x1", "x2", "x3", "x4")
P = len(X)
#: Chi-square quantiles for four degrees of freedom (fixed values): the median, and 1 - 1e-4.
MEDIAN, CUTOFF = 3.3567, 23.5127
#: Least standard deviations of the four statistics: below these a spread is that of short texts.
FLOORS = (0.06, 0.05, 0.15, 0.15)
CELLS = [(i, j) for i in range(P) for j in range(i + 1)]


def statistics(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words`` to ``docs``."""
    lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(WORD))
    df = docs.withColumn("_t", text_of(text_col)).withColumn("_w", words_of(F.col("_t"))).withColumn("_l", lines)
    df = df.withColumn("n_words", F.size("_w").cast("long"))
    # A 64-bit hash stands for each 3-word window; the words themselves are hashed in order.
    window = F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))
    df = df.withColumn("_h", F.when(F.col("n_words") >= 3, window).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))

    def twice(x: Column, k: Column) -> Column:
        near = lambda j: F.get("_s", j)["h"].eqNullSafe(x["h"])
        return ((k > 0) & near(k - 1)) | near(k + 1)

    df = df.withColumn("_p", F.transform(F.filter("_s", twice), lambda x: x["i"]))
    covered = F.size(F.array_distinct(F.flatten(F.transform("_p", lambda i: F.array(i, i + 1, i + 2)))))
    return df.select(
        *docs.columns,
        "n_words",
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.size(F.split("_t", "[#*$%&|<>]", -1)) - 1).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        F.when(F.col("_s").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"),
        F.char_length("_t").cast("long").alias("_chars"),
    )


def summed(terms: list[str]) -> str:
    return " + ".join(terms) or "0D"


def factored(df: DataFrame) -> DataFrame:
    """Adds ``v{i}{j}``, the inverse of the Cholesky factor of the covariance in ``c{i}{j}``, and ``logdet``.

    Column by column, each a projection over the last, so no term is written out twice. Written as SQL,
    since a step builds hundreds of terms and each operator on a ``Column`` is a call to the JVM.
    """
    for j in range(P):
        left = {i: f"c{i}{j} - ({summed([f'l{i}{k} * l{j}{k}' for k in range(j)])})" for i in range(j, P)}
        df = df.selectExpr("*", f"sqrt(greatest({left[j]}, 1e-12D)) AS l{j}{j}")
        df = df.selectExpr("*", f"1 / l{j}{j} AS v{j}{j}", *[f"({left[i]}) / l{j}{j} AS l{i}{j}" for i in range(j + 1, P)])
    for gap in range(1, P):
        df = df.selectExpr("*", *[f"-({summed([f'l{i}{k} * v{k}{i - gap}' for k in range(i - gap, i)])}) / l{i}{i} AS v{i}{i - gap}" for i in range(gap, P)])
    return df.selectExpr("*", f"{summed([f'ln(l{i}{i})' for i in range(P)])} AS logdet").drop(*[f"l{i}{j}" for i, j in CELLS])


def distance() -> Column:
    """Squared Mahalanobis distance from the centre ``m*`` under the inverse factor ``v**``."""
    z = [summed([f"v{i}{j} * ({X[j]} - m{j})" for j in range(i + 1)]) for i in range(P)]
    return F.expr(summed([f"power({t}, 2)" for t in z]))


def estimate(moments: DataFrame, keys: list[str]) -> DataFrame:
    """Rows ``n``, centre, covariance and inverse factor for each key from sums ``n, s*, q**``, variances held above the floors."""
    mean = [f"s{i} / n AS m{i}" for i in range(P)]
    held = [f"q{i}{j} / n - (s{i} / n) * (s{j} / n) + {FLOORS[i] ** 2 if i == j else 0.0!r}D AS c{i}{j}" for i, j in CELLS]
    return factored(moments.selectExpr(*keys, "group_size", "n", *mean, *held))


def sums() -> list[Column]:
    return [F.expr("count(*) AS n"), *[F.expr(f"sum({X[i]}) AS s{i}") for i in range(P)], *[F.expr(f"sum({X[i]} * {X[j]}) AS q{i}{j}") for i, j in CELLS]]


def distance_bin() -> Column:
    """Distances are told apart to 1/64 of their logarithm, in about 900 bins."""
    return F.least(F.floor(F.log1p(F.col("d2")) * 64), F.lit(1200)).cast("int")


def centres(rows: DataFrame, n_rows: int, steps: int, share: float, settled: float = 1e-3) -> DataFrame:
    """One row per ``key``: the MCD centre ``m*``, covariance ``c**`` of ``n`` rows, inverse factor ``v**`` and ``scale``.

    Two starts, coordinate medians with absolute deviations, and plain moments, take concentration
    steps on the ``share`` of rows nearest to them until no determinant's logarithm moves by
    ``settled``, ``steps`` at most; the smaller determinant wins.
    """
    keys = ["key", "begun"]
    sizes = settle(rows.groupBy("key").agg(F.count("*").alias("group_size"), *[F.percentile_approx(c, 0.5, 1000).alias(f"m{i}") for i, c in enumerate(X)]))
    n_keys = sizes.count()
    off = attach(rows, sizes, "key", n_rows, n_groups=n_keys).groupBy("key", "group_size", "m0", "m1", "m2", "m3")
    off = off.agg(*[F.percentile_approx(F.abs(F.col(c) - F.col(f"m{i}")), 0.5, 1000).alias(f"a{i}") for i, c in enumerate(X)])
    spread = [(F.pow(F.lit(1.4826) * F.col(f"a{i}"), 2) + FLOORS[i] ** 2 if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in CELLS]
    robust = factored(off.select("key", F.lit(0).alias("begun"), "group_size", F.col("group_size").alias("n"), *[f"m{i}" for i in range(P)], *spread))
    plain = estimate(rows.groupBy("key").agg(F.count("*").alias("group_size"), *sums()).withColumn("begun", F.lit(1)), keys)
    now = settle(robust.unionByName(plain))
    # The last determinant goes with its key, so that a step needs no join to tell how far it moved.
    held = [*keys, "group_size", "last"]
    upto = Window.partitionBy(*keys).orderBy("bin")
    for _ in range(steps):
        binned = attach(rows, now.withColumnRenamed("logdet", "last"), "key", n_rows, n_groups=n_keys).withColumn("d2", distance()).groupBy(*held, distance_bin().alias("bin")).agg(*sums())
        near = binned.withColumn("before", F.sum("n").over(upto) - F.col("n")).where(F.col("before") < F.col("group_size") * share)
        added = [F.expr(f"sum({c}) AS {c}") for c in ["n", *[f"s{i}" for i in range(P)], *[f"q{i}{j}" for i, j in CELLS]]]
        now = settle(estimate(near.groupBy(*held).agg(*added), [*keys, "last"]))
        moved = now.agg(F.max(F.abs(F.col("logdet") - F.col("last")))).first()[0]
        now = now.drop("last")
        if moved is None or moved < settled:
            break
    best = now.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("logdet", "begun"))).where("r = 1").drop("r")
    best = settle(best)
    # The median distance under the winner puts it on the scale of a chi-square variable.
    middle = attach(rows, best, "key", n_rows, n_groups=n_keys).withColumn("d2", distance()).groupBy("key", "group_size", distance_bin().alias("bin")).agg(F.count("*").alias("n"))
    middle = middle.withColumn("upto", F.sum("n").over(Window.partitionBy("key").orderBy("bin"))).where(F.col("upto") * 2 >= F.col("group_size"))
    scale = middle.groupBy("key").agg(F.greatest(F.lit(1.0), F.expm1((F.min("bin") + 1) / 64) / MEDIAN).alias("scale"))
    return best.join(scale, "key")


def shrunk(own: DataFrame, prior: DataFrame, prior_key: str, weight: float) -> DataFrame:
    """``own`` estimates (``n, m*, c**`` and keys) drawn towards those of ``prior`` under ``prior_key``, as ``weight`` rows of it would."""
    parts = [*[f"m{i}" for i in range(P)], *[f"c{i}{j}" for i, j in CELLS]]
    p = prior.selectExpr(f"key AS {prior_key}", *[f"{q} AS p_{q}" for q in parts])
    mix = [f"({q} * n + p_{q} * {weight!r}D) / (n + {weight!r}D) AS {q}" for q in parts]
    names = [c for c in own.columns if c[0] not in "mcv" and c != "logdet"]
    return own.join(p, prior_key).selectExpr(*names, *mix)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", weight: float = 400.0, steps: int = 8, share: float = 0.55) -> DataFrame:
    """One row per input row: the statistics, ``base_failed, outlier_distance, kept``.

    ``base_failed``: fewer than 50 words, or over half of them in repeated 3-word windows. Other rows are
    described by log mean word length and the shares of symbols (root), repeated lines and repeated
    words, and rejected where their squared Mahalanobis distance from the estimate of their language and
    source passes ``CUTOFF``. Every pair of language and source has an MCD estimate of its own; centre and
    covariance are the means of the pair's, weighing its ``n`` rows, and its language's, weighing ``weight``,
    and a language's those of its own and the whole table's likewise, so small groups lean on larger ones
    without a step. Null text has no words; null language or source is a value like any other. Equal texts of
    one group get equal verdicts, repeated rows their own rows, an empty table none. Other columns are not
    looked at.
    """
    lang, source = F.col(lang_col).cast("string"), F.col(source_col).cast("string")
    given = docs.select(F.col(id_col).alias("doc_id"), F.concat(F.lit("lang "), F.to_json(F.struct(lang.alias("l")))).alias("lang_key"), F.concat(F.lit("pair "), F.to_json(F.struct(lang.alias("l"), source.alias("s")))).alias("pair_key"), text_of(text_col).alias("text"))
    base = settle(statistics(given, "text").drop("text"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("_chars"), F.lit(1))
    shares = {"x1": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words), "x2": F.sqrt(F.col("n_symbols") / chars), "x3": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), "x4": F.col("n_repeat_words") / words}
    rows = base.withColumn("base_failed", failed).withColumns(shares)
    sound = settle(rows.where("not base_failed").select("lang_key", "pair_key", *X))
    fitted = sound.select(F.explode(F.array("pair_key", "lang_key", F.lit("all"))).alias("key"), *X)
    found = centres(fitted, 3 * sound.count(), steps, share)
    # Covariances on the scale of a chi-square distance.
    found = settle(found.select("key", "group_size", "n", *[f"m{i}" for i in range(P)], *[(F.col("scale") * F.col(f"c{i}{j}")).alias(f"c{i}{j}") for i, j in CELLS]))
    langs = found.where(F.col("key").startswith("lang ")).withColumn("whole", F.lit("all"))
    langs = settle(shrunk(langs, found.where("key = 'all'"), "whole", weight))
    pairs = found.join(sound.groupBy(F.col("pair_key").alias("key"), "lang_key").agg(F.count("*").alias("_n")), "key")
    pairs = factored(shrunk(pairs, langs, "lang_key", weight).withColumnRenamed("key", "pair_key")).select("pair_key", "group_size", *[f"m{i}" for i in range(P)], *[f"v{i}{j}" for i, j in CELLS])
    pairs = settle(pairs)
    judged = attach(rows, pairs, "pair_key", base.count(), n_groups=pairs.count()).withColumn("d", F.when(~F.col("base_failed"), distance()))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("d").alias("outlier_distance"), (~F.col("base_failed") & (F.col("d") <= CUTOFF)).alias("kept"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
