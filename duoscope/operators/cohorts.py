"""Cohorts for survival tests: carriers against others, against given controls, and pairs of positions against single hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def carriers_of(calls: DataFrame, genes: list[str], any_of: bool = True) -> DataFrame:
    """``case_id`` of the cases hit in any, or in all, of ``genes``."""
    hit = calls.where(F.col("gene").isin(*genes)).groupBy("case_id").agg(F.countDistinct("gene").alias("n"))
    return hit.where(F.col("n") >= (1 if any_of else len(set(genes)))).select("case_id")


def two_gene_carriers(calls: DataFrame, a: str, b: str, cohort: str = "either") -> DataFrame:
    """``case_id`` of the cases hit in ``only_a``, ``only_b``, ``both`` or ``either`` of two genes."""
    hit = calls.where(F.col("gene").isin(a, b)).groupBy("case_id").agg(F.max(F.col("gene") == a).alias("a"), F.max(F.col("gene") == b).alias("b"))
    keep = {"only_a": F.col("a") & ~F.col("b"), "only_b": F.col("b") & ~F.col("a"), "both": F.col("a") & F.col("b"), "either": F.lit(True)}
    return hit.where(keep[cohort]).select("case_id")


def cohort(people: DataFrame, targets: DataFrame, controls: DataFrame | None = None, rest: bool = True) -> DataFrame:
    """``people`` with ``grp``: 1 for ``targets``, 0 for ``controls``; a case that is in both is a control.

    Without ``controls`` all other people are, if ``rest``, else none. Cases without follow-up drop out.
    """
    t = targets.select("case_id").distinct().withColumn("_t", F.lit(1))
    out = people.join(t, "case_id", "left")
    if controls is not None:
        c = controls.select("case_id").distinct().withColumn("_c", F.lit(0))
        return out.join(c, "case_id", "left").withColumn("grp", F.coalesce("_c", "_t")).where("grp is not null").drop("_t", "_c")
    out = out.withColumn("grp", F.coalesce("_t", F.lit(0))).drop("_t")
    return out if rest else out.where("grp = 1")


def varying(df: DataFrame, flags: list[str]) -> DataFrame:
    """``flags`` as 0 and 1 (above 0, null as 0), those that all rows agree in left out."""
    df = df.withColumns({f: F.when(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) > 0, 1).otherwise(0) for f in flags})
    seen = df.agg(*[F.max(f).alias(f"max_{f}") for f in flags], *[F.min(f).alias(f"min_{f}") for f in flags]).first() if flags else None
    return df.drop(*[f for f in flags if seen[f"max_{f}"] == seen[f"min_{f}"]])


def position_cohorts(positions: DataFrame, pairs: DataFrame) -> DataFrame:
    """``gene, pos1, pos2, case_id, grp`` of all pairs at once: cases with both positions, and controls.

    A control carries one of the two and at least one other position of the gene. ``positions``: distinct gene, case_id,
    pos; ``pairs``: distinct gene, pos1, pos2. Rows are made for carriers of a pair's positions only, summed to one per
    pair and case.
    """
    sizes = positions.groupBy("gene", "case_id").agg(F.count("*").alias("n")).where("n >= 2")
    multi = positions.join(sizes, ["gene", "case_id"])
    ends = pairs.select("gene", "pos1", "pos2", F.explode(F.array("pos1", "pos2")).alias("pos"))
    hit = ends.join(multi, ["gene", "pos"]).groupBy("gene", "pos1", "pos2", "case_id").agg(F.count("*").alias("k"))
    return hit.select("gene", "pos1", "pos2", "case_id", F.when(F.col("k") == 2, 1).otherwise(0).alias("grp"))
