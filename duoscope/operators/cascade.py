"""Survival of the carriers of two positions of a gene against controls that are matched step by step."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .bands import combinations
from .lineage import fixed
from .ranking import bh_fdr
from .statistics import chi2_tail, log_rank_counted, mann_whitney, stratified_log_rank

PAIR = ["gene", "pos1", "pos2"]
CELL = ["tmb", "project", "duration"]


@F.pandas_udf(DoubleType())
def chi2_upper(x: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail of chi-square with a whole number of degrees of freedom; one value per test."""

    def tail(v: float, n: float) -> float | None:
        if v is None or n is None or v != v or n != n or n < 1:
            return None
        h, n = max(float(v), 0.0) / 2, int(n)
        at, total = (1.0, math.erfc(math.sqrt(h))) if n % 2 else (2.0, math.exp(-h))
        while at < n:
            total += math.exp(at / 2 * math.log(h) - h - math.lgamma(at / 2 + 1)) if h > 0 else 0.0
            at += 2
        return min(total, 1.0)

    return pd.Series([tail(v, n) for v, n in zip(x, df, strict=True)], dtype="float64")


def carried_pairs(positions: DataFrame, least: int, block: int = 2048) -> DataFrame:
    """``gene, pos1, pos2`` with ``pos1 < pos2`` that ``least`` cases or more carry; ``positions`` has distinct ``gene, case_id, pos``.

    Every case names all pairs of its positions in a gene. Those of a case with over ``block`` are made in blocks over
    tasks, without positions that fewer than ``least`` cases carry, as these are in no such pair.
    """
    of = ["gene", "case_id"]
    crowded = fixed(positions.groupBy(*of).agg(F.count("*").alias("_k")).where(F.col("_k") > block).select(*of))
    some = not crowded.isEmpty()
    held = positions.join(crowded, of, "left_anti") if some else positions
    other = held.select(*of, F.col("pos").alias("pos2"))
    both = held.select(*of, F.col("pos").alias("pos1")).join(other, of).where("pos1 < pos2").select(*PAIR)
    if some:
        often = positions.groupBy("gene", "pos").agg(F.count("*").alias("_c")).where(F.col("_c") >= least)
        many = positions.join(crowded, of, "left_semi").join(often, ["gene", "pos"], "left_semi")
        both = both.unionByName(combinations(many, of, "pos", block=block).select(*PAIR))
    return both.groupBy(*PAIR).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(*PAIR)


def cohorts(pairs: DataFrame, positions: DataFrame, people: DataFrame, few: int = 3) -> DataFrame:
    """``gene, pos1, pos2, level, grp, tmb, project, duration, d, c``: counted cases ``c`` and deaths ``d``.

    Group 1 carries both positions. Controls of level 0 carry one of them; of level 1 they have as many positions in
    the gene as some carrier, or one more or fewer where under ``few`` such cases are left; level 2 are those of level 1
    with a burden within half of the carriers' median. ``people``: ``gene, case_id, n, tmb, duration, event, project``
    once per gene and case. Controls are counts per gene, so none of levels 1 and 2 is a row of its own per pair and
    case: carriers are counted out of them.
    """
    first = positions.withColumnRenamed("pos", "pos1")
    second = positions.withColumnRenamed("pos", "pos2")
    both = fixed(pairs.join(first, ["gene", "pos1"]).join(second, ["gene", "pos2", "case_id"]).join(people, ["gene", "case_id"]))
    count = lambda t, keys: t.groupBy(*keys, *CELL).agg(F.sum("event").alias("d"), F.count("*").alias("c"))
    target = count(both, PAIR)
    less = lambda times: target.select(*PAIR, *CELL, (F.col("d") * -times).alias("d"), (F.col("c") * -times).alias("c"))

    by_place = count(positions.join(people, ["gene", "case_id"]), ["gene", "pos"])
    one = [pairs.join(by_place.withColumnRenamed("pos", side), ["gene", side]).select(*PAIR, *CELL, "d", "c") for side in ("pos1", "pos2")]
    zero = one[0].unionByName(one[1]).unionByName(less(2))

    held = both.groupBy(*PAIR, "n").agg(F.count("*").alias("k")).join(people.groupBy("gene", "n").agg(F.count("*").alias("m")), ["gene", "n"])
    near = F.when(F.col("m") - F.col("k") < few, F.array(F.col("n") - 1, F.col("n"), F.col("n") + 1)).otherwise(F.array("n"))
    wanted = held.select(*PAIR, F.explode(near).alias("n")).distinct()
    matched = wanted.join(count(people, ["gene", "n"]), ["gene", "n"]).select(*PAIR, *CELL, "d", "c").unionByName(less(1))
    median = both.groupBy(*PAIR).agg(F.percentile("tmb", 0.5).alias("_m"))
    close = matched.join(median, PAIR).where("tmb between _m * 0.5 and _m * 1.5").drop("_m")

    tag = lambda t, level: t.groupBy(*PAIR, *CELL).agg(F.sum("d").alias("d"), F.sum("c").alias("c")).where("c > 0").withColumn("level", F.lit(level))
    controls = tag(zero, 0).unionByName(tag(matched, 1)).unionByName(tag(close, 2)).withColumn("grp", F.lit(0))
    carriers = target.withColumn("level", F.explode(F.array(*map(F.lit, (0, 1, 2))))).withColumn("grp", F.lit(1))
    return fixed(controls.unionByName(carriers).select(*PAIR, "level", "grp", *CELL, "d", "c"))


def compared(rows: DataFrame, keys: list[str], least: int = 2, controls: int = 3) -> DataFrame:
    """``n_target, n_control``, median follow-ups and the log-rank ``chi2`` of counted rows, by ``keys``.

    Tests with fewer than ``least`` carriers or fewer ``controls`` are left out.
    """
    of = lambda g, c: F.when(F.col("grp") == g, F.col(c))
    middle = lambda g: F.percentile(of(g, "duration"), 0.5, F.col("c"))
    sizes = rows.groupBy(*keys).agg(F.sum(of(1, "c")).alias("n_target"), F.sum(of(0, "c")).alias("n_control"), middle(1).alias("target_median"), middle(0).alias("control_median"))
    sizes = sizes.where((F.col("n_target") >= least) & (F.col("n_control") >= controls))
    return sizes.join(log_rank_counted(rows, keys), keys)


def pair_tests(rows: DataFrame, values: bool = False) -> DataFrame:
    """Over all projects and within each: carriers against controls of level 1, with direction and most frequent projects.

    ``rows``: what ``cohorts`` gives. ``top`` has a pair's three projects with the most carriers, ties by name. With
    ``values`` each test has its ``p``, and ``q`` among the tests of its project (or of all projects together).
    """
    one = rows.where("level = 1")
    every = compared(one, PAIR).withColumn("project", F.lit("ALL"))
    own = compared(one, [*PAIR, "project"])
    both = every.select(*own.columns).unionByName(own)
    often = one.where("grp = 1").groupBy(*PAIR, "project").agg(F.sum("c").alias("k")).groupBy(*PAIR)
    # A pair's projects are few: one struct for each.
    often = often.agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("k")).alias("k"), "project"))), 1, 3).alias("t"))
    named = often.select(*PAIR, F.array_join(F.transform("t", lambda x: F.concat(x["project"], F.lit("("), (-x["k"]).cast("string"), F.lit(")"))), "; ").alias("top"))
    out = both.join(named, PAIR).withColumn("top", F.when(F.col("project") == "ALL", F.col("top")).otherwise(F.col("project")))
    out = out.withColumn("direction", F.when(F.col("target_median") < F.col("control_median"), "worse").otherwise("better"))
    return bh_fdr(out.withColumn("p", chi2_tail(F.col("chi2"))), "p", ["project"], PAIR) if values else out


def cascade(rows: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row per pair that level 0 can test: ``n_target``, and by level ``n_control_k, chi2_k, p_k``; ``df_3``, ``tmb_u``, ``kept``.

    Level 3 sums the chi-squares of level 2 by project. ``tmb_u`` is Mann-Whitney's U of the burdens at level 2. A pair
    is kept if levels 0 to 2 are below ``alpha`` and level 3 is too, or has no test.
    """
    tests = compared(rows, [*PAIR, "level"])
    level = lambda k: tests.where(F.col("level") == k).select(*PAIR, *(["n_target"] if k == 0 else []), F.col("n_control").alias(f"n_control_{k}"), F.col("chi2").alias(f"chi2_{k}"))
    out = level(0).where("chi2_0 is not null").join(level(1), PAIR, "left").join(level(2), PAIR, "left")
    two = rows.where("level = 2")
    strata = stratified_log_rank(log_rank_counted(two, [*PAIR, "project"]), PAIR).withColumnsRenamed({"chi2": "chi2_3", "df": "df_3"})
    cases = two.select(*PAIR, (F.col("grp") == 1).alias("carries"), "tmb", "c")
    balance = mann_whitney(cases, "tmb", "carries", PAIR, "c").where("n1 >= 2 and n2 >= 2").select(*PAIR, F.col("u").alias("tmb_u"))
    out = out.join(strata, PAIR, "left").join(balance, PAIR, "left")
    tested = F.col("chi2_2").isNotNull()
    out = out.withColumn("chi2_3", F.when(tested, F.col("chi2_3"))).withColumn("df_3", F.when(tested, F.col("df_3")))
    for k in range(3):
        out = out.withColumn(f"p_{k}", chi2_upper(F.col(f"chi2_{k}"), F.lit(1)))
    out = out.withColumn("p_3", chi2_upper("chi2_3", "df_3"))
    low = [F.coalesce(F.col(f"p_{k}") < alpha, F.lit(False)) for k in range(3)]
    return out.withColumn("kept", low[0] & low[1] & low[2] & F.coalesce(F.col("p_3") < alpha, F.lit(True)))
