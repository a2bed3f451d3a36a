"""Tests by shuffled labels. Rows stay where they are: each task adds up what a shuffle would give for its own rows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block, and shuffles that are drawn at a time.
BLOCK, TURN = 4096, 128


def seed_of(*parts: object) -> np.random.SeedSequence:
    return np.random.SeedSequence(zlib.crc32(repr(parts).encode()))


def labels_in(sizes: np.ndarray, block: int, marked: int, times: int, seed: tuple) -> np.ndarray:
    """How many of the ``marked`` labels fall into ``block`` in each of ``times`` shuffles of rows in blocks of ``sizes``.

    Blocks are halved again and again; at each halving a hypergeometric draw, seeded by the halves, tells how many
    labels go left. So every task that asks gets the same counts, and they add up to ``marked``.
    """
    lo, hi = 0, len(sizes)
    k = np.full(times, marked, dtype=np.int64)
    total = np.concatenate([[0], np.cumsum(sizes)])
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left, right = int(total[mid] - total[lo]), int(total[hi] - total[mid])
        rng = np.random.default_rng(seed_of(*seed, lo, hi))
        # Drawn from the urn of rows: labels are the good ones.
        go = np.array([rng.hypergeometric(left, right, x) if x and left + right else 0 for x in k]) if left + right >= 10**9 else rng.hypergeometric(left, right, k)
        if block < mid:
            k, hi = go, mid
        else:
            k, lo = k - go, mid
    return k


def mean_shuffles(df: DataFrame, value: str, group: str, key: str, strata: list[str], times: int, seed: int = 42) -> DataFrame:
    """``strata, n1, n2, observed, larger, larger_abs, mean, std``: difference of the groups' means against shuffled labels.

    In each of ``times`` shuffles exactly as many rows of a stratum have the label as are seen with it, all choices
    being equally likely. ``larger`` counts shuffles whose difference is the seen one or more, ``larger_abs`` those whose
    size is; ``mean`` and ``std`` are over shuffles. Rows with a null value or label take no part; a stratum without both
    groups has no row. Rows fall into blocks of about 4096 by hash of ``key``; a block's shuffles are summed in its
    task, and only a sum per block and shuffle moves on. The sizes of a stratum's blocks go with each of its blocks.
    """
    known = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(*strata, F.col(value).cast("double").alias("_v"), F.col(group).alias("_g"), F.xxhash64(key, F.lit(seed)).alias("_k"))
    whole = known.groupBy(*strata).agg(F.count("*").alias("_n"), F.count_if("_g").alias("_m"), F.sum("_v").alias("_s"), F.sum(F.when(F.col("_g"), F.col("_v"))).alias("_t"))
    whole = whole.where("_m > 0 and _m < _n").withColumn("_blocks", F.ceil(F.col("_n") / BLOCK))
    held = known.join(whole.select(*strata, "_blocks"), strata) if strata else known.join(F.broadcast(whole.select("_blocks")))
    held = held.withColumn("_block", F.pmod("_k", "_blocks").cast("int"))
    sizes = held.groupBy(*strata, "_block").agg(F.count("*").alias("_c"))
    sizes = sizes.groupBy(*strata).agg(F.array_sort(F.collect_list(F.struct("_block", "_c"))).alias("_sizes"))
    info = (sizes.join(whole, strata) if strata else sizes.join(F.broadcast(whole))).select(*strata, "_m", "_blocks", "_sizes")
    blocks = held.groupBy(*strata, "_block").agg(F.array_sort(F.collect_list(F.struct("_k", "_v"))).alias("_rows"))
    blocks = blocks.join(info, strata) if strata else blocks.join(F.broadcast(info))
    types = dict(df.dtypes)
    schema = "".join(f"`{c}` {types[c]}, " for c in strata) + "shuffle int, s double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                row = dict(zip(b.columns, r, strict=True))
                count = np.zeros(int(row["_blocks"]), dtype=np.int64)
                for x in row["_sizes"]:
                    count[x["_block"]] = x["_c"]
                values = np.array([x["_v"] for x in row["_rows"]])
                name = (seed, *[str(row[c]) for c in strata])
                k = labels_in(count, int(row["_block"]), int(row["_m"]), times, name)
                rng = np.random.default_rng(seed_of(*name, "rows", int(row["_block"])))
                sums = np.empty(times)
                for lo in range(0, times, TURN):
                    part = k[lo : lo + TURN]
                    order = rng.random((len(part), len(values))).argsort(axis=1)
                    run_of = np.cumsum(values[order], axis=1)
                    sums[lo : lo + TURN] = np.where(part > 0, run_of[np.arange(len(part)), np.maximum(part, 1) - 1], 0.0)
                yield pd.DataFrame({**{c: [row[c]] * times for c in strata}, "shuffle": np.arange(times, dtype=np.int32), "s": sums})

    sums = blocks.mapInPandas(run, schema).groupBy(*strata, "shuffle").agg(F.sum("s").alias("s"))
    both = sums.join(whole, strata) if strata else sums.join(F.broadcast(whole))
    n1, n2 = F.col("_m"), F.col("_n") - F.col("_m")
    gap = lambda s: s / n1 - (F.col("_s") - s) / n2
    # Sums of other orders differ in their last digits: ties count as ties.
    both = both.withColumn("observed", gap(F.col("_t"))).withColumn("_d", gap(F.col("s"))).withColumn("_e", 1e-9 * (F.abs("observed") + 1e-300))
    out = both.groupBy(*strata, n1.alias("n1"), n2.alias("n2"), "observed").agg(F.count_if(F.col("_d") >= F.col("observed") - F.col("_e")).alias("larger"), F.count_if(F.abs("_d") >= F.abs("observed") - F.col("_e")).alias("larger_abs"), F.avg("_d").alias("mean"), F.stddev("_d").alias("std"))
    return out


def coherence_shuffles(df: DataFrame, vector: str, group: str, key: str, strata: list[str], pairs: int = 500, times: int = 200, seed: int = 42) -> DataFrame:
    """``strata, coherence1, coherence2, observed, p``: mean absolute cosine inside each group, and of their difference.

    Rows are drawn by hash of ``key``, as many as about ``pairs`` pairs or more inside the smaller group need, and fall into
    cells of some 16; all pairs within a cell are compared, which is a random sample of pairs, since cells know nothing
    of vectors. A stratum of fewer rows is used whole. In a shuffle every row draws its
    label anew with the groups' shares; a pair counts for the group that both its rows fall into. ``p`` is the share of
    shuffles whose difference is at least as large as the seen one's, not under ``1 / (times + 1)``. Null vectors and
    labels take no part; zero vectors have cosine 0; a group without a pair has null.
    """
    known = df.where(F.col(vector).isNotNull() & F.col(group).isNotNull()).select(*strata, F.col(vector).cast("array<double>").alias("_x"), F.col(group).alias("_g"), F.xxhash64(key, F.lit(seed)).alias("_k"))
    whole = known.groupBy(*strata).agg(F.count("*").alias("_n"), (F.count_if("_g") / F.count("*")).alias("_share"))
    info = known.join(whole, strata) if strata else known.join(F.broadcast(whole))
    # A cell of 16 has 120 pairs, of which the square of the smaller share lies inside that group.
    least = F.least(F.col("_share"), 1 - F.col("_share"))
    rows = F.greatest(F.lit(16.0), F.ceil(4 * pairs / F.greatest(least * least, F.lit(1e-3))) / 8)
    info = info.where(F.pmod(F.shiftright("_k", 20), F.lit(1 << 20)) < (rows / F.col("_n")) * (1 << 20))
    taken = info.withColumn("_cell", F.pmod("_k", F.greatest(F.lit(1), F.floor(F.least(rows, F.col("_n")) / 16))))
    cells = taken.groupBy(*strata, "_cell", "_share").agg(F.array_sort(F.collect_list(F.struct("_k", "_g", "_x"))).alias("_rows"))
    types = dict(df.dtypes)
    schema = "".join(f"`{c}` {types[c]}, " for c in strata) + "shuffle int, s1 double, c1 long, s2 double, c2 long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                row = dict(zip(b.columns, r, strict=True))
                rows_ = row["_rows"]
                if len(rows_) < 2:
                    continue
                x = np.array([np.asarray(q["_x"], float) for q in rows_])
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-20)
                i, j = np.triu_indices(len(x), 1)
                c = np.abs((x[i] * x[j]).sum(axis=1))
                bits = np.array([np.random.default_rng(seed_of(seed, int(q["_k"]))).random(times) < row["_share"] for q in rows_])
                bits = np.column_stack([[bool(q["_g"]) for q in rows_], bits])
                one, two = bits[i] & bits[j], ~bits[i] & ~bits[j]
                yield pd.DataFrame({**{k: [row[k]] * (times + 1) for k in strata}, "shuffle": np.arange(times + 1, dtype=np.int32), "s1": c @ one, "c1": one.sum(axis=0), "s2": c @ two, "c2": two.sum(axis=0)})

    sums = cells.mapInPandas(run, schema).groupBy(*strata, "shuffle").agg(*[F.sum(c).alias(c) for c in ("s1", "c1", "s2", "c2")])
    d = sums.withColumn("_1", F.try_divide("s1", "c1")).withColumn("_2", F.try_divide("s2", "c2")).withColumn("_d", F.col("_1") - F.col("_2"))
    seen = d.where("shuffle = 0").select(*strata, F.col("_1").alias("coherence1"), F.col("_2").alias("coherence2"), F.col("_d").alias("observed"))
    runs = d.where("shuffle > 0").select(*strata, "_d")
    both = runs.join(seen, strata) if strata else runs.join(F.broadcast(seen))
    p = F.greatest(F.count_if(F.abs("_d") >= F.abs("observed")) / F.count("_d"), F.lit(1.0 / (times + 1)))
    return both.groupBy(*strata, "coherence1", "coherence2", "observed").agg(F.when(F.count("_d") > 0, p).alias("p"))
