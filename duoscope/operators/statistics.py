"""Statistical tests, each one job over all strata."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .lineage import fixed
from .ranking import cumulated

#: Shuffled rows that a task makes, and bins times shuffles up to which facts of bins are broadcast.
SHUFFLED, BROADCAST = 1 << 22, 1 << 18


@F.pandas_udf(DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    """Upper tail of the normal distribution; one value per test."""
    return z.map(lambda x: None if x is None or x != x else 0.5 * math.erfc(x / math.sqrt(2)))


@F.pandas_udf(DoubleType())
def chi2_tail(x: pd.Series) -> pd.Series:
    """Upper tail of chi-square with one degree of freedom."""
    return x.map(lambda v: None if v is None or v != v else math.erfc(math.sqrt(max(v, 0.0) / 2)))


def mann_whitney(df: DataFrame, value: str, group: str, strata: list[str], weight: str | None = None) -> DataFrame:
    """U of the rows where ``group`` is true, with mid-ranks, tie-corrected z and a 0.5 continuity step.

    ``z`` is that of the alternative "greater"; ``p_greater, p_less, p_two`` are the normal tails of all three. A row
    counts ``weight`` times. Values are counted before anything is ranked, so a row per stratum and value is all that
    is joined and no window holds a stratum.
    """
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    known = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(*strata, value, group, w.alias("_w"))
    t = cumulated(known, value, strata, {"_a": F.when(F.col(group), F.col("_w")).otherwise(0), "_b": F.when(F.col(group), 0).otherwise(F.col("_w"))})
    n = (F.col("_a") + F.col("_b")).cast("double")
    s = t.groupBy(*strata).agg(F.sum("_a").alias("n1"), F.sum("_b").alias("n2"), F.sum(F.col("_a") * (F.col("_b_before") + F.col("_b") / 2.0)).alias("u"), F.sum(n * n * n - n).alias("ties"))
    n1, n2, u = F.col("n1"), F.col("n2"), F.col("u")
    whole = n1 + n2
    mean = n1 * n2 / 2
    sd = F.sqrt(n1 * n2 / 12 * (whole + 1 - F.coalesce(F.try_divide(F.col("ties"), whole * (whole - 1)), F.lit(0.0))))
    out = s.select(*strata, "n1", "n2", "u", F.when(sd > 0, (u - mean - 0.5) / sd).alias("z"), F.when(sd > 0, (mean - u - 0.5) / sd).alias("_less"))
    return out.select(*strata, "n1", "n2", "u", "z", normal_tail(F.col("z")).alias("p_greater"), normal_tail(F.col("_less")).alias("p_less"), F.least(2 * normal_tail(F.greatest("z", "_less")), F.lit(1.0)).alias("p_two"))


def mid_ranked(df: DataFrame, value: str, strata: list[str], name: str) -> DataFrame:
    """Adds the average rank among equals, from 1, from counted values; null where ``value`` is. ``df`` is settled."""
    t = cumulated(df, value, strata, {"_n": F.lit(1)})
    return df.join(t.select(*strata, value, (F.col("_n_before") + (F.col("_n") + 1) / 2).alias(name)), [*strata, value], "left")


def spearman(df: DataFrame, x: str, y: str, strata: list[str], given: str | None = None) -> DataFrame:
    """Rank correlation, partial for a covariate if one is given. Rows that lack a value take no part."""
    names = [x, y] + ([given] if given else [])
    df = fixed(df.select(*strata, *names).dropna(subset=names))
    for c in names:
        df = mid_ranked(df, c, strata, f"_{c}")
    r = lambda a, b: F.corr(f"_{a}", f"_{b}")
    aggs = [r(x, y).alias("rho")]
    if given:
        aggs.append(F.try_divide(r(x, y) - r(x, given) * r(y, given), F.sqrt((1 - r(x, given) ** 2) * (1 - r(y, given) ** 2))).alias("partial_rho"))
    return df.groupBy(*strata).agg(*aggs)


def log_factorial(k: Column) -> Column:
    """ln k! by Stirling's series at k + 9, stepped back by the eight factors between; good to 1e-12."""
    x = k.cast("double") + 1
    product = x
    for j in range(1, 8):
        product = product * (x + j)
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def hypergeometric_tail(df: DataFrame, total: str, marked: str, drawn: str, seen: str, name: str = "p") -> DataFrame:
    """P(at least ``seen`` of ``marked`` among ``drawn`` of ``total``): the first term from log factorials, the rest by ratios."""
    n, m, d = (F.col(c).cast("double") for c in (total, marked, drawn))
    low, high = F.greatest(F.col(seen).cast("double"), d + m - n, F.lit(0.0)), F.least(m, d)
    lf = log_factorial
    first = F.exp(lf(m) - lf(low) - lf(m - low) + lf(n - m) - lf(d - low) - lf(n - m - d + low) - lf(n) + lf(d) + lf(n - d))
    steps = F.when(low < high, F.sequence(low.cast("int"), high.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    state = F.struct(F.col("_first").alias("term"), F.col("_first").alias("total"))

    def more(s: Column, k: Column) -> Column:
        term = s["term"] * (m - k) * (d - k) / ((k + 1) * (n - m - d + k + 1))
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    df = df.withColumn("_first", F.when(low <= high, first).otherwise(0.0)).withColumn("_steps", steps)
    return df.withColumn(name, F.least(F.aggregate("_steps", state, more)["total"], F.lit(1.0))).drop("_first", "_steps")


def fisher_two_sided(df: DataFrame, a: str, b: str, c: str, d: str, name: str = "p", slack: float = 1e-7) -> DataFrame:
    """Adds the odds ratio ``odds`` and the two-sided exact p-value of tables ``[[a, b], [c, d]]``.

    All tables with the same margins that are no likelier than the seen one count (up to ``slack``, relatively).
    Their probabilities come from the seen one's, whose logarithm is exact, by ratios up and down from it, so no term
    overflows and tables far less likely add nothing. ``odds`` is infinite where b or c is 0, null for 0 / 0.
    """
    x = F.col(a).cast("double")
    m, k = x + F.col(b), x + F.col(c)
    n = m + F.col(c) + F.col(d)
    low, high = F.greatest(k + m - n, F.lit(0.0)), F.least(m, k)
    lf = log_factorial
    seen = lf(m) - lf(x) - lf(m - x) + lf(n - m) - lf(k - x) - lf(n - m - k + x) - lf(n) + lf(k) + lf(n - k)
    none = F.array().cast("array<int>")
    up = F.when(x < high, F.sequence(x.cast("int"), high.cast("int") - 1)).otherwise(none)
    down = F.when(x > low, F.sequence(x.cast("int"), low.cast("int") + 1, F.lit(-1))).otherwise(none)
    zero = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("total"))

    def step(s: Column, ratio: Column) -> Column:
        at = s["log"] + F.log(ratio)
        return F.struct(at.alias("log"), (s["total"] + F.when(at <= slack, F.exp(at)).otherwise(0.0)).alias("total"))

    rising = F.aggregate("_up", zero, lambda s, j: step(s, (m - j) * (k - j) / ((j + 1) * (n - m - k + j + 1))))
    falling = F.aggregate("_down", zero, lambda s, j: step(s, j * (n - m - k + j) / ((m - j + 1) * (k - j + 1))))
    df = df.withColumn("_up", up).withColumn("_down", down)
    p = F.least(F.exp(seen) * (1 + rising["total"] + falling["total"]), F.lit(1.0))
    cross = F.col(b).cast("double") * F.col(c)
    odds = F.when(cross > 0, x * F.col(d) / cross).when(x * F.col(d) > 0, F.lit(float("inf")))
    return df.withColumn("odds", odds).withColumn(name, p).drop("_up", "_down")


def tails(s: DataFrame, down: str, mine: str, key: str, shares: list[int]) -> DataFrame:
    """``pct, n_top, a, b, c, d, odds, p``: rows of ``mine`` and others within and past the least values of ``down``."""
    s = fixed(s)
    t = cumulated(s, down, [], {"_m": F.col(mine).cast("long"), "_n": F.lit(1)})
    whole = s.agg(F.count("*").alias("n"), F.count_if(mine).alias("m"))
    cut = whole.withColumn("pct", F.explode(F.array(*[F.lit(x) for x in shares]))).withColumn("n_top", F.greatest(F.lit(1), F.floor(F.col("n") * F.col("pct") / 100)).cast("long"))
    # A row per share; all values meet these few.
    at = t.join(F.broadcast(cut), (F.col("_n_before") < F.col("n_top")) & (F.col("_n_before") + F.col("_n") >= F.col("n_top")))
    edge = s.join(F.broadcast(at.select("pct", F.col(down).alias("_v"), (F.col("n_top") - F.col("_n_before")).alias("_room"))), F.col(down) == F.col("_v"))
    edge = edge.withColumn("_r", F.row_number().over(Window.partitionBy("pct").orderBy(key))).groupBy("pct").agg(F.count_if((F.col("_r") <= F.col("_room")) & F.col(mine)).alias("_part"))
    four = at.join(F.broadcast(edge), "pct").withColumn("a", F.col("_m_before") + F.col("_part"))
    four = four.select("pct", "n_top", "a", (F.col("n_top") - F.col("a")).alias("b"), (F.col("m") - F.col("a")).alias("c"), (F.col("n") - F.col("n_top") - F.col("m") + F.col("a")).alias("d"))
    return fisher_two_sided(four, "a", "b", "c", "d")


def empirical_p(df: DataFrame, score: str, is_null: str, strata: list[str]) -> DataFrame:
    """``(1 + null scores >= s) / (1 + null scores)`` for rows outside the null, null where there is none."""
    df = fixed(df)
    t = cumulated(df, score, strata, {"_null": F.col(is_null).cast("long")}).select(*strata, score, "_null_before")
    whole = df.groupBy(*strata).agg(F.count_if(F.col(is_null)).alias("_nulls"), F.count_if(F.col(is_null) & F.col(score).isNotNull()).alias("_told"))
    rest = df.where(~F.col(is_null)).join(t, [*strata, score], "left")
    rest = rest.join(whole, strata) if strata else rest.join(F.broadcast(whole))
    scored = (1 + F.col("_told") - F.col("_null_before")) / (1 + F.col("_nulls"))
    return rest.withColumn("p", F.when((F.col("_nulls") > 0) & F.col(score).isNotNull(), scored)).drop("_nulls", "_told", "_null_before")


def kolmogorov_smirnov(df: DataFrame, value: str, group: str, strata: list[str]) -> DataFrame:
    """Largest gap between the two groups' cumulative shares, from counted values."""
    t = cumulated(df.where(F.col(group).isNotNull()), value, strata, {"_a": F.when(F.col(group), 1).otherwise(0), "_b": F.when(F.col(group), 0).otherwise(1)})
    whole = t.groupBy(*strata).agg(F.sum("_a").alias("_m"), F.sum("_b").alias("_k"))
    t = t.join(whole, strata) if strata else t.join(F.broadcast(whole))
    share = lambda c, n: F.try_divide(F.col(f"{c}_before") + F.col(c), F.col(n))
    return t.groupBy(*strata).agg(F.max(F.abs(share("_a", "_m") - share("_b", "_k"))).alias("d"))


def signed_rank(df: DataFrame, a: str, b: str, strata: list[str]) -> DataFrame:
    """Wilcoxon's W+ on paired differences, zeros and nulls left out, from counted sizes of differences."""
    d = df.withColumn("_d", F.round(F.col(a) - F.col(b), 12)).where("_d <> 0").withColumn("_size", F.abs("_d"))
    t = cumulated(d, "_size", strata, {"_n": F.lit(1), "_up": (F.col("_d") > 0).cast("long")})
    n = F.sum("_n")
    w = F.sum(F.col("_up") * (F.col("_n_before") + (F.col("_n") + 1) / 2))
    return t.groupBy(*strata).agg(n.alias("n"), w.alias("w"), ((w - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)).alias("z"))


def permutation_test(df: DataFrame, value: str, group: str, bin_col: str, key: str, times: int, strata: list[str]) -> DataFrame:
    """Difference of the groups' means of bin residuals against labels shuffled within bins.

    Shuffles rank rows by md5 of permutation and key, so any engine repeats them. ``z`` and
    ``p = (k + 1) / (times + 1)`` for k permuted differences as large as the observed one.

    Rows of a shuffle are counted and added up by the first digits of their md5, about as many cells to a bin as rows
    to a cell. A cell lies within the labels or past them, but for the one where they end: only its rows are ranked.
    """
    by = [*strata, bin_col]
    rows = fixed(df.select(*by, key, F.col(value).cast("double").alias("_x"), F.col(group).alias("_g")))
    # The logarithm of the root of a bin's rows, in hexadecimal digits.
    digits = F.round(F.log2(F.count("*").cast("double")) / 8).cast("int")
    bins = rows.groupBy(*by).agg(F.avg("_x").alias("_mean"), F.count_if("_g").alias("_n"), digits.alias("_digits"), F.count("*").alias("_rows"))
    size = bins.agg(F.count("*").alias("bins"), F.sum("_rows").alias("rows")).first()
    small = F.broadcast if size.bins * times <= BROADCAST else lambda t: t

    def of_bin(t: DataFrame, facts: DataFrame) -> DataFrame:
        facts = small(facts.select(*[F.col(c).alias(f"_of_{k}") for k, c in enumerate(by)], *[c for c in facts.columns if c not in by]))
        same = [F.col(c).eqNullSafe(F.col(f"_of_{k}")) for k, c in enumerate(by)]
        return t.join(facts, same).drop(*[f"_of_{k}" for k in range(len(by))])

    held = of_bin(rows, bins.drop("_rows")).withColumn("_v", F.col("_x") - F.col("_mean")).drop("_x", "_mean")
    seen = held.groupBy(*strata).agg((F.avg(F.when(F.col("_g"), F.col("_v"))) - F.avg(F.when(~F.col("_g"), F.col("_v")))).alias("observed"))
    # A count that Spark does not merge: a task makes so many shuffled rows, whatever the bins' sizes.
    held = held.drop("_g").repartition((size.rows or 0) * times // SHUFFLED + 1, key)
    digest = F.md5(F.concat_ws(":", "perm", F.col(key).cast("string")))

    many = held.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(times)))).withColumn("_cell", F.substring(digest, F.lit(1), F.col("_digits")))
    cells = many.groupBy(*by, "perm", "_cell").agg(F.max("_n").alias("_n"), F.count("*").alias("_c"), F.count("_v").alias("_k"), F.sum("_v").alias("_s"))
    upto = F.sum("_c").over(Window.partitionBy(*by, "perm").orderBy("_cell"))
    cells = cells.withColumn("_left", F.col("_n") - upto + F.col("_c"))
    inside, past = F.col("_left") >= F.col("_c"), F.col("_left") <= 0
    ends = ~inside & ~past

    def halves(one: Column, other: Column, k: Column, s: Column) -> list[Column]:
        return [F.sum(F.when(c, x)).alias(n) for n, c, x in (("_k1", one, k), ("_s1", one, s), ("_k2", other, k), ("_s2", other, s))]

    whole = fixed(cells.groupBy(*by, "perm").agg(*halves(inside, past, F.col("_k"), F.col("_s")), F.max(F.when(ends, F.col("_cell"))).alias("_cell"), F.max(F.when(ends, F.col("_left"))).alias("_left")))
    cuts = whole.where("_cell is not null").groupBy(*by).agg(F.collect_list(F.struct("perm", "_cell", "_left")).alias("_cuts"))
    near = of_bin(held.select(*by, key, "_v"), cuts).select(*by, key, "_v", F.inline("_cuts")).withColumn("_md5", digest).where(F.col("_md5").startswith(F.col("_cell")))
    ranked = near.withColumn("_in", F.row_number().over(Window.partitionBy(*by, "perm").orderBy("_md5", "_v")) <= F.col("_left"))
    rest = ranked.groupBy(*by, "perm").agg(*halves(F.col("_in"), ~F.col("_in"), F.when(F.col("_v").isNotNull(), 1).otherwise(0), F.col("_v")))
    parts = ["_k1", "_s1", "_k2", "_s2"]
    runs = whole.select(*strata, "perm", *parts).unionByName(rest.select(*strata, "perm", *parts)).groupBy(*strata, "perm").agg(*[F.sum(c).alias(c) for c in parts])
    runs = runs.select(*strata, (F.try_divide("_s1", "_k1") - F.try_divide("_s2", "_k2")).alias("d"))
    both = runs.join(seen, strata) if strata else runs.join(F.broadcast(seen))
    return both.groupBy(*strata, "observed").agg(F.try_divide(F.col("observed") - F.avg("d"), F.stddev("d")).alias("z"), ((F.count_if(F.col("d") >= F.col("observed")) + 1) / (times + 1)).alias("p"))


def at_risk(cohort: DataFrame, keys: list[str]) -> DataFrame:
    """Per test, group and time: deaths ``d`` and numbers at risk ``n``, aggregated before any window."""
    times = cohort.where(F.col("duration").isNotNull()).groupBy(*keys, "grp", "duration").agg(F.sum("event").alias("d"), F.count("*").alias("left"))
    later = Window.partitionBy(*keys, "grp").orderBy(F.desc("duration"))
    return times.withColumn("n", F.sum("left").over(later))


def kaplan_meier(cohort: DataFrame, keys: list[str]) -> DataFrame:
    """Survival after each time at which someone died."""
    t = at_risk(cohort, keys)
    upto = Window.partitionBy(*keys, "grp").orderBy("duration")
    gone = F.max(F.when(F.col("d") == F.col("n"), 1).otherwise(0)).over(upto)
    log = F.sum(F.when(F.col("d") < F.col("n"), F.log(1 - F.col("d") / F.col("n"))).otherwise(0.0)).over(upto)
    return t.withColumn("survival", F.when(gone == 1, 0.0).otherwise(F.exp(log))).where("d > 0").select(*keys, "grp", "duration", "d", "n", "survival")


def log_rank(cohort: DataFrame, keys: list[str]) -> DataFrame:
    """Chi-square of group 1 against 0 for every test at once: ``observed, expected, variance, chi2``."""
    times = cohort.where(F.col("duration").isNotNull()).groupBy(*keys, "grp", "duration").agg(F.sum("event").alias("d"), F.count("*").alias("c"))
    return log_rank_counted(times, keys)


def log_rank_counted(counted: DataFrame, keys: list[str]) -> DataFrame:
    """The same from counts: ``keys, grp, duration``, deaths ``d`` and cases ``c``; rows of one group and time are added up."""
    times = counted.groupBy(*keys, "duration").agg(*[F.sum(F.when(F.col("grp") == g, F.col(n)).otherwise(0)).alias(f"{n}{g}") for g in (0, 1) for n in ("d", "c")])
    later = Window.partitionBy(*keys).orderBy(F.desc("duration"))
    t = times.withColumn("n1", F.sum("c1").over(later)).withColumn("n", F.sum(F.col("c0") + F.col("c1")).over(later)).withColumn("d", F.col("d0") + F.col("d1"))
    e = F.col("d") * F.col("n1") / F.col("n")
    v = F.when(F.col("n") > 1, e * (1 - F.col("n1") / F.col("n")) * (F.col("n") - F.col("d")) / (F.col("n") - 1)).otherwise(0.0)
    s = t.groupBy(*keys).agg(F.sum("d1").alias("observed"), F.sum(e).alias("expected"), F.sum(v).alias("variance"))
    return s.withColumn("chi2", F.when(F.col("variance") > 0, (F.col("observed") - F.col("expected")) ** 2 / F.col("variance")))


def log_rank_of_carriers(cohort: DataFrame, carriers: DataFrame, test: str, case: str, strata: list[str]) -> DataFrame:
    """Log-rank of the carriers of each ``test`` against all other cases, by stratum, from the carriers' rows alone.

    ``cohort`` has ``case, duration, event`` once per case, ``carriers`` ``test, case`` once each. Let d of n at
    risk die at a time. Expected deaths are the cumulated d/n at each carrier's end, summed. With
    w = d(n - d) / (n^2 (n - 1)) the variance is the sum over times of w n1 n less that of w n1^2, and
    n1^2 counts pairs of carriers, each until the earlier end: c carriers who end together, with m later ones,
    stand for c^2 + 2cm pairs. So no row is made for a case that does not carry.
    """
    times = cohort.where(F.col("duration").isNotNull()).groupBy(*strata, "duration").agg(F.sum("event").alias("d"), F.count("*").alias("c"))
    n, d = F.col("n").cast("double"), F.col("d")
    w = F.when(n > 1, d * (n - d) / (n * n * (n - 1))).otherwise(0.0)
    upto = Window.partitionBy(*strata).orderBy("duration")
    times = times.withColumn("n", F.sum("c").over(Window.partitionBy(*strata).orderBy(F.desc("duration"))))
    steps = times.select(*strata, "duration", F.sum(d / n).over(upto).alias("hazard"), F.sum(w * n).over(upto).alias("linear"), F.sum(w).over(upto).alias("square"))
    ends = carriers.join(cohort.where(F.col("duration").isNotNull()), case).groupBy(test, *strata, "duration").agg(F.sum("event").alias("e"), F.count("*").cast("double").alias("c"))
    ends = ends.withColumn("m", F.sum("c").over(Window.partitionBy(test, *strata).orderBy(F.desc("duration"))) - F.col("c"))
    at = ends.join(steps, [*strata, "duration"])
    s = at.groupBy(test, *strata).agg(F.sum("e").alias("observed"), F.sum(F.col("c") * F.col("hazard")).alias("expected"), F.sum(F.col("c") * F.col("linear")).alias("_a"), F.sum(F.col("square") * (F.col("c") * F.col("c") + 2 * F.col("c") * F.col("m"))).alias("_b"))
    left = F.col("_a") - F.col("_b")
    # A difference of equal sums is zero but for its last digits.
    s = s.withColumn("variance", F.when(left > 1e-12 * F.col("_a"), left).otherwise(0.0)).drop("_a", "_b")
    return s.withColumn("chi2", F.when(F.col("variance") > 0, (F.col("observed") - F.col("expected")) ** 2 / F.col("variance")))


def stratified_log_rank(tests: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of the strata's chi-squares with as many degrees of freedom (approximate, not the pooled test).

    ``tests``: log-rank results by stratum.
    """
    return tests.where("chi2 is not null").groupBy(*keys).agg(F.sum("chi2").alias("chi2"), F.count("*").alias("df"))


def cox(cohort: DataFrame, features: list[str], steps: int = 25, enough: float = 1e-8) -> DataFrame:
    """``feature, coefficient, error, z, p`` of a proportional-hazards fit of ``duration, event`` by Newton steps.

    Ties by Breslow's rule. Each step is one job: sums over everyone still at risk, by counted times in blocks, then
    one row of gradient and information, as long as the features squared; the driver solves that.
    """
    rows = fixed(cohort.select("duration", F.col("event").cast("double").alias("event"), *[F.col(c).cast("double").alias(c) for c in features]).dropna().withColumn("_back", -F.col("duration")))
    k, cells = len(features), [(i, j) for i in range(len(features)) for j in range(i + 1)]
    beta = np.zeros(k)
    for step in range(steps + 1):
        w = F.exp(F.expr(" + ".join(f"{b!r}D * `{c}`" for b, c in zip(beta.tolist(), features, strict=True))))
        x = [F.col(c) for c in features]
        sums = {"d": F.col("event"), "r": w, **{f"e{i}": F.col("event") * x[i] for i in range(k)}, **{f"r{i}": w * x[i] for i in range(k)}, **{f"r{i}_{j}": w * x[i] * x[j] for i, j in cells}}
        at = cumulated(rows, "_back", [], sums).where("d > 0")
        left = lambda n: F.col(n) + F.col(f"{n}_before")
        mean = [left(f"r{i}") / left("r") for i in range(k)]
        one = at.agg(*[F.sum(F.col(f"e{i}") - F.col("d") * mean[i]).alias(f"g{i}") for i in range(k)], *[F.sum(F.col("d") * (left(f"r{i}_{j}") / left("r") - mean[i] * mean[j])).alias(f"h{i}_{j}") for i, j in cells]).first()
        if one["g0"] is None:
            return rows.sparkSession.createDataFrame([], "feature string, coefficient double, error double, z double, p double")
        information = np.array([[one[f"h{max(i, j)}_{min(i, j)}"] for j in range(k)] for i in range(k)])
        move = np.linalg.pinv(information) @ np.array([one[f"g{i}"] for i in range(k)])
        if step == steps or np.abs(move).max() < enough:
            break
        beta = beta + move
    error = np.sqrt(np.maximum(np.diag(np.linalg.pinv(information)), 0))
    found = [(c, float(b), float(e), float(b / e) if e > 0 else None) for c, b, e in zip(features, beta, error, strict=True)]
    t = rows.sparkSession.createDataFrame(found, "feature string, coefficient double, error double, z double")
    return t.withColumn("p", 2 * normal_tail(F.abs("z")))


def follow_up(cases: DataFrame, times: list[str], death: str, least: float = 0.0, years: bool = True) -> DataFrame:
    """Adds ``duration``, the last of ``times`` (days, absent ones passed over), and ``event``, whether ``death`` is 0 or more.

    In years of 365 days unless told otherwise; cases under ``least``, or without any time, are left out.
    """
    last = F.greatest(*times) if len(times) > 1 else F.col(times[0])
    out = cases.withColumn("duration", last / 365.0 if years else last.cast("double"))
    return out.withColumn("event", F.coalesce(F.col(death) >= 0, F.lit(False)).cast("int")).where(F.col("duration") >= least)
