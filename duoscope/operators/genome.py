"""A reference in chunks: windows stitched from them, genotype sequences of pairs, random windows, conditional tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.identifiers import reverse_complement
from .lineage import fixed
from .maps import BASES

#: Bases of a chunk. Small enough that a row is cheap to move, large enough that a usual window touches a few.
WIDTH = 1 << 14


def chunks(df: DataFrame, chrom: str = "chrom", seq: str = "seq", width: int = WIDTH) -> DataFrame:
    """``chrom, chunk, bases, n_before``: sequences cut at multiples of ``width``, with the count of N in earlier chunks.

    Null and empty sequences have no chunks. A sequence's chunks are summed in one window, a row per ``width`` bases.
    """
    cut = df.where(F.length(seq) > 0).select(F.col(chrom).alias("chrom"), F.col(seq).alias("_s"), F.explode(F.sequence(F.lit(0), F.floor((F.length(seq) - 1) / width).cast("int"))).alias("chunk"))
    cut = cut.select("chrom", "chunk", F.upper(F.substring("_s", F.col("chunk") * width + 1, F.lit(width))).alias("bases"))
    before = Window.partitionBy("chrom").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return cut.withColumn("n_before", F.coalesce(F.sum(F.length(F.regexp_replace("bases", "[^N]", ""))).over(before), F.lit(0)))


def lengths(chunked: DataFrame) -> DataFrame:
    """``chrom, length`` of a chunked reference."""
    return chunked.groupBy("chrom").agg(F.sum(F.length("bases")).alias("length"))


def windows(asked: DataFrame, chunked: DataFrame, keys: list[str], width: int = WIDTH) -> DataFrame:
    """``keys, chrom, lo, hi, seq``: the bases from ``lo`` to ``hi`` (0-based, ``hi`` outside) of each row of ``asked``.

    A window is clipped at the ends of its chromosome, and ``lo, hi`` tell what was had; one wholly outside, or of an
    unknown chromosome, has no row. ``keys`` are unique. Every chunk that a window touches meets it by an equi-join on
    chromosome and chunk; pieces of a window are put together by its keys, so a much-asked chunk is split by AQE and
    no window is larger than what it asks for.
    """
    a = asked.select(*keys, "chrom", F.greatest("lo", F.lit(0)).cast("long").alias("_lo"), F.col("hi").cast("long").alias("_hi")).where("_hi > _lo")
    a = a.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("_lo") / width).cast("int"), F.floor((F.col("_hi") - 1) / width).cast("int"))))
    met = a.join(chunked.select("chrom", "chunk", "bases"), ["chrom", "chunk"])
    # Only the part inside the window moves on.
    first = F.greatest(F.col("_lo") - F.col("chunk").cast("long") * width, F.lit(0))
    last = F.least(F.col("_hi") - F.col("chunk").cast("long") * width, F.length("bases").cast("long"))
    part = met.where(last > first).select(*keys, "chrom", "_lo", "chunk", F.substring("bases", (first + 1).cast("int"), (last - first).cast("int")).alias("part"))
    whole = part.groupBy(*keys, "chrom", "_lo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "part"))), lambda x: x["part"]), "").alias("seq"))
    return whole.select(*keys, "chrom", F.col("_lo").alias("lo"), (F.col("_lo") + F.length("seq")).alias("hi"), "seq")


def edited(seq: Column, at: Column, ref: Column, alt: Column) -> Column:
    """``seq`` with the bases of ``ref`` at ``at`` (from 0) replaced by ``alt``; ``-`` and the empty allele have none."""
    bases = lambda a: F.when(a == "-", "").otherwise(a)
    return F.concat(F.substring(seq, F.lit(1), at), bases(alt), F.substring(seq, at + F.length(bases(ref)) + 1, F.length(seq)))


def genotypes(pairs: DataFrame, chunked: DataFrame, key: str, context: int = 3000, width: int = WIDTH, first: int = 1) -> DataFrame:
    """``key, wt, m1, m2, m12, idx1, idx2, status``: the four sequences of each pair of variants.

    ``pairs``: a unique ``key``, chrom, pos1, ref1, alt1, pos2, ref2, alt2, rev. The window goes from ``context``
    before the lower position to ``context`` - 1 behind the higher one; ``first`` is the number of a chromosome's
    first base. Positions and alleles are those of the forward strand; where ``rev``, all four sequences are reverse
    complements and ``idx1, idx2``, the variants' places in them, count from the other end. Bases are in upper case.

    ``status``: ``ok``; ``outside`` where a position is not in the reference or a value is null (no sequences);
    ``overlap`` where one variant's bases reach the other's (no double mutant); ``mismatch`` where a reference allele is
    not what the reference has there (the sequences are given all the same).
    """
    p = pairs.select(key, "chrom", *[F.col(f"pos{k}").cast("long").alias(f"pos{k}") for k in (1, 2)], *[F.upper(f"{a}{k}").alias(f"{a}{k}") for a in ("ref", "alt") for k in (1, 2)], F.coalesce("rev", F.lit(False)).alias("rev"))
    asked = p.select(key, "chrom", (F.least("pos1", "pos2") - context - first).alias("lo"), (F.greatest("pos1", "pos2") + context - first).alias("hi"))
    j = p.join(windows(asked, chunked, [key], width).drop("chrom"), key, "left")
    bases = lambda a: F.when(F.col(a) == "-", "").otherwise(F.col(a))
    for k in (1, 2):
        j = j.withColumn(f"_r{k}", bases(f"ref{k}")).withColumn(f"_i{k}", (F.col(f"pos{k}") - first - F.col("lo")).cast("int"))
    inside = lambda k: (F.col(f"_i{k}") >= 0) & (F.col(f"_i{k}") + F.length(f"_r{k}") <= F.length("seq")) & (F.col(f"_i{k}") < F.length("seq"))
    have = F.coalesce(inside(1) & inside(2), F.lit(False))
    for k in ("1", "2"):
        have = have & F.col(f"alt{k}").isNotNull()
    low, high = F.col("pos1") <= F.col("pos2"), F.col("pos1") > F.col("pos2")
    apart = F.when(low, F.col("_i1") + F.greatest(F.length("_r1"), F.lit(1)) <= F.col("_i2")).otherwise(F.col("_i2") + F.greatest(F.length("_r2"), F.lit(1)) <= F.col("_i1"))
    same = lambda k: F.substring(F.col("seq"), F.col(f"_i{k}") + 1, F.length(f"_r{k}")) == F.col(f"_r{k}")
    status = F.when(~have, "outside").when(~apart, "overlap").when(~(same(1) & same(2)), "mismatch").otherwise("ok")
    j = j.withColumn("status", status)
    one = lambda s, k: edited(s, F.col(f"_i{k}"), F.col(f"ref{k}"), F.col(f"alt{k}"))
    seq = F.when(F.col("status") != "outside", F.col("seq"))
    # The later of the two places goes first, so the other one's place still holds.
    both = F.when(high, one(one(seq, 1), 2)).otherwise(one(one(seq, 2), 1))
    turned = lambda s: F.when(F.col("rev"), reverse_complement(s)).otherwise(s)
    place = lambda k: F.when(F.col("status") != "outside", F.when(F.col("rev"), F.length("seq") - 1 - F.col(f"_i{k}")).otherwise(F.col(f"_i{k}")))
    return j.select(key, turned(seq).alias("wt"), turned(one(seq, 1)).alias("m1"), turned(one(seq, 2)).alias("m2"), turned(F.when(F.col("status") != "overlap", both)).alias("m12"), place(1).alias("idx1"), place(2).alias("idx2"), "status")


def unit(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("double") / float(1 << 52)


def random_windows(spark: SparkSession, chunked: DataFrame, n: int, length: int, seed: int, most_n: float = 0.1, width: int = WIDTH) -> DataFrame:
    """``draw, chrom, lo, hi, seq`` of up to ``n`` windows, chromosomes drawn by length, those with over ``most_n`` N dropped.

    Chromosomes longer than twice the window take part. A draw's place on the line of all of them, in order of their
    names, tells the chromosome: both sides are cut into steps of the mean length, so a draw meets the few that share
    its step, however many chromosomes there are. Null names take no part.
    """
    named = lengths(chunked).where((F.col("length") > 2 * length) & F.col("chrom").isNotNull())
    # A row per chromosome: its place on the line comes from sums over hash ranges would not be ordered by name.
    line = fixed(named.withColumn("_to", F.sum("length").over(Window.orderBy("chrom"))))
    whole = line.agg(F.max("_to").alias("total"), F.count("*").alias("k")).first()
    if not whole["k"]:
        return windows(spark.createDataFrame([], "draw long, chrom string, lo long, hi long"), chunked, ["draw"], width)
    step = max(1, whole["total"] // whole["k"])
    line = line.withColumn("_from", F.col("_to") - F.col("length")).withColumn("_step", F.explode(F.sequence(F.floor(F.col("_from") / step), F.floor((F.col("_to") - 1) / step))))
    draws = spark.range(n).select(F.col("id").alias("draw"), F.floor(unit(F.lit(seed), F.lit("place"), F.col("id")) * whole["total"]).alias("_x")).withColumn("_step", F.floor(F.col("_x") / step))
    asked = draws.join(line, "_step").where("_x >= _from and _x < _to")
    asked = asked.withColumn("lo", F.floor(unit(F.lit(seed), F.lit("start"), F.col("draw")) * (F.col("length") - length))).withColumn("hi", F.col("lo") + length)
    found = windows(asked.select("draw", "chrom", "lo", "hi"), chunked, ["draw"], width)
    return found.where(F.length(F.regexp_replace("seq", "[^N]", "")) <= most_n * length)


def conditional_table(df: DataFrame, load: Callable[[], Callable[[list[str], list[int]], np.ndarray]], key: str, prefix: str = "", batch: int = 64) -> DataFrame:
    """``key, ref1_nuc, ref2_nuc, A_A .. T_T, error``: a masked model's view of place 2 for every base at place 1.

    ``df``: key, seq, idx1, idx2 (from 0). For each of four bases at ``idx1`` the model gives the probabilities of A,
    C, G, T at the masked ``idx2``; column ``A_C`` is that of C after A was set. ``load`` makes the model once per
    task; it takes sequences and places and returns a row of four per sequence. A batch that fails is done pair by
    pair; a pair that fails, or has a null or a place outside its sequence, has nulls and the reason in ``error``.
    """
    names = [f"{prefix}{a}_{b}" for a in BASES for b in BASES]
    kind = dict(df.dtypes)[key]
    schema = f"`{key}` {kind}, `{prefix}ref1_nuc` string, `{prefix}ref2_nuc` string, " + ", ".join(f"`{n}` double" for n in names) + ", error string"

    def asked(s: str, i: int) -> list[str]:
        return [s[:i] + b + s[i + 1 :] for b in BASES]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()

        def tables(rows: list[tuple[str, int, int]]) -> np.ndarray:
            p = np.asarray(model([t for s, i, _ in rows for t in asked(s, i)], [j for _, _, j in rows for _ in BASES]), dtype=float)
            if p.shape != (4 * len(rows), 4):
                raise ValueError("a model must give four probabilities for each sequence")
            return p.reshape(len(rows), 16)

        for b in batches:
            for lo in range(0, len(b), batch):
                part = b.iloc[lo : lo + batch]
                sound, errors = [], []
                for s, i, j in zip(part["seq"], part["idx1"], part["idx2"], strict=True):
                    ok = isinstance(s, str) and i == i and j == j and i is not None and j is not None and 0 <= i < len(s) and 0 <= j < len(s)
                    sound.append((s, int(i), int(j)) if ok else None)
                    errors.append(None if ok else "place outside the sequence")
                got = np.full((len(part), 16), np.nan)
                at = [k for k, r in enumerate(sound) if r]
                try:
                    if at:
                        got[at] = tables([sound[k] for k in at])
                except Exception:  # one bad pair must not lose the others
                    for k in at:
                        try:
                            got[k] = tables([sound[k]])[0]
                        except Exception as e:
                            errors[k] = str(e)
                out = {key: part[key], f"{prefix}ref1_nuc": [r[0][r[1]] if r else None for r in sound], f"{prefix}ref2_nuc": [r[0][r[2]] if r else None for r in sound]}
                out |= {n: pd.array(np.where(np.isnan(got[:, c]), np.nan, got[:, c]), dtype="Float64") for c, n in enumerate(names)}
                yield pd.DataFrame({**out, "error": errors})

    return df.select(key, "seq", "idx1", "idx2").mapInPandas(run, schema)


def masked_neighbours(width: int = 2) -> Callable[[list[str], list[int]], np.ndarray]:
    """A stand-in for a masked model: shares of the bases within ``width`` places of the masked one, one added to each."""

    def model(texts: list[str], at: list[int]) -> np.ndarray:
        near = [s[max(0, k - width) : k] + s[k + 1 : k + width + 1] for s, k in zip(texts, at, strict=True)]
        n = np.array([[1 + t.count(b) for b in BASES] for t in near], dtype=float).reshape(-1, 4)
        return n / n.sum(axis=1, keepdims=True)

    return model
