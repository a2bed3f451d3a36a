"""Plans that the driver works through again and again stay small; their results stay the same."""

import pytest
from pyspark.sql import functions as F

from duoscope.llm import mixing, quality_rules
from duoscope.llm.common import attach, settle


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_few_groups_take_one_join(spark):
    """As many rows as the way for any number of groups gives, unmatched and null keys and two rows a key included."""
    rows = settle(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4), (None, 5)], "key string, x int"))
    groups = settle(spark.createDataFrame([("a", 0, 2), ("a", 1, 2), ("b", 0, 1)], "key string, begun int, group_size long"))
    few, any_number = attach(rows, groups, "key", 5, n_groups=2), attach(rows, groups, "key", 5, share=2)
    seen = lambda df: sorted(df.collect(), key=str)
    assert few.columns == any_number.columns and seen(few) == seen(any_number) == seen(attach(rows, groups, "key", 5, share=2, n_groups=3))
    assert len(seen(few)) == 7
    assert optimized(few).count("Join ") == 1


def test_a_concentration_step_has_one_join(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(quality_rules, "settle", lambda df: plans.append(optimized(df)) or settle(df))
    df = spark.range(60).select(F.when(F.col("id") < 40, "a").otherwise("b").alias("key"), *[F.rand(i).alias(f"x{i}") for i in (1, 2, 3, 4)])
    assert quality_rules.centres(settle(df), 60, 3, 0.55).count() == 2
    assert len(plans) >= 4 and max(p.count("Join ") for p in plans) == 1


def test_the_mix_is_planned_in_parts(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * (i + 3), "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    plan = mixing.mix_plan(docs)
    assert optimized(plan).count("Window [") <= 3
    assert {r.source: r.t == pytest.approx(r.target, abs=2) for r in plan.groupBy("source", "target").agg(F.sum(F.coalesce(F.col("hi") - F.col("lo"), F.lit(0))).alias("t")).collect()} == {"a": True, "b": True}
