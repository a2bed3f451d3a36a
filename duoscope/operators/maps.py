"""Sequences, their substitutions, and position-by-position maps in long form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BASES = ("A", "C", "G", "T")
#: Kinds of brackets that pair positions of a structure (fixed values); letters pair upper with lower case.
BRACKETS = (("(", ")"), ("[", "]"), ("{", "}"), ("<", ">"))
LETTERS = tuple((chr(k), chr(k + 32)) for k in range(ord("A"), ord("Z") + 1))


def bases() -> Column:
    return F.array(*[F.lit(b) for b in BASES])


def positions(df: DataFrame, seq: str) -> DataFrame:
    """Adds ``pos`` (from 0) and ``ref`` for every place of a sequence."""
    return df.select("*", F.posexplode(F.split(seq, "")).alias("pos", "ref"))


def single_substitutions(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """All ``pos, ref, alt`` of sequences; places other than A, C, G, T have none."""
    p = positions(df, seq).where(F.col("ref").isin(*BASES))
    return p.select(*keys, "pos", "ref", F.explode(bases()).alias("alt")).where("alt <> ref")


def double_substitutions(df: DataFrame, keys: list[str], seq: str, width: int) -> DataFrame:
    """All pairs of substitutions at most ``width`` apart: each first one meets the next places of its own sequence."""
    s = single_substitutions(df.select(*keys, F.col(seq).alias("_seq")), [*keys, "_seq"], "_seq").withColumnsRenamed({"pos": "pos1", "ref": "ref1", "alt": "alt1"})
    last = F.least(F.col("pos1") + width, F.length("_seq") - 1)
    s = s.where(F.col("pos1") + 1 <= last).withColumn("pos2", F.explode(F.sequence(F.col("pos1") + 1, last)))
    s = s.withColumn("ref2", F.substring("_seq", F.col("pos2") + 1, F.lit(1))).where(F.col("ref2").isin(*BASES))
    return s.withColumn("alt2", F.explode(bases())).where("alt2 <> ref2").drop("_seq")


def substituted(seq: Column, pos: Column, alt: Column) -> Column:
    """``seq`` with one base changed at ``pos`` (from 0)."""
    return F.overlay(seq, alt, pos + 1, F.lit(1))


def bracket_pairs(df: DataFrame, keys: list[str], structure: str) -> DataFrame:
    """Paired positions ``i < j`` of dot-bracket strings, each kind of bracket on its own, so pairs may cross.

    At equal depth of one kind the k-th opening meets the k-th closing.
    """
    p = df.select(*keys, F.posexplode(F.split(structure, "")).alias("pos", "ch"))
    kind, step = F.lit(None).cast("int"), F.lit(0)
    for k, (a, b) in enumerate(BRACKETS + LETTERS):
        kind = F.when(F.col("ch").isin(a, b), k).otherwise(kind)
        step = F.when(F.col("ch") == a, 1).when(F.col("ch") == b, -1).otherwise(step)
    p = p.withColumn("kind", kind).withColumn("step", step).where("kind is not null")
    w = Window.partitionBy(*keys, "kind").orderBy("pos")
    p = p.withColumn("depth", F.sum("step").over(w) + F.when(F.col("step") < 0, 1).otherwise(0))
    p = p.withColumn("k", F.row_number().over(Window.partitionBy(*keys, "kind", "depth", "step").orderBy("pos")))
    a = p.where("step = 1").select(*keys, "kind", "depth", "k", F.col("pos").alias("i"))
    b = p.where("step = -1").select(*keys, "kind", "depth", "k", F.col("pos").alias("j"))
    return a.join(b, [*keys, "kind", "depth", "k"]).select(*keys, "i", "j")


def dependency_map(mutant: DataFrame, base: DataFrame, keys: list[str], eps: float = 1e-10) -> DataFrame:
    """Largest absolute log ratio of a nucleotide's probability at j when i is mutated, both ways; i <> j.

    ``mutant``: keys, pos_i, alt, pos_j, nuc, p; ``base``: keys, pos_j, nuc, p.
    """
    j = mutant.join(base.select(*keys, "pos_j", "nuc", F.col("p").alias("p0")), [*keys, "pos_j", "nuc"]).where("pos_i <> pos_j")
    m = j.groupBy(*keys, "pos_i", "pos_j").agg(F.max(F.abs(F.log((F.col("p") + eps) / (F.col("p0") + eps)))).alias("score"))
    return mirrored(m, keys)


def mirrored(m: DataFrame, keys: list[str]) -> DataFrame:
    """The larger of a map's scores both ways."""
    other = m.select(*keys, F.col("pos_j").alias("pos_i"), F.col("pos_i").alias("pos_j"), F.col("score").alias("_s"))
    return m.join(other, [*keys, "pos_i", "pos_j"], "left").select(*keys, "pos_i", "pos_j", F.greatest("score", "_s").alias("score"))


def logit_map(mutant: DataFrame, base: DataFrame, keys: list[str], eps: float = 1e-10) -> DataFrame:
    """Largest absolute difference of base-2 logits at j when i is mutated, both ways, and 0 where i = j.

    ``mutant``: keys, pos_i, alt, pos_j, nuc, p; ``base``: keys, pos_j, nuc, p. ``eps`` is added to every p before a
    place's four are brought to sum 1.
    """

    def logits(t: DataFrame, place: list[str], name: str) -> DataFrame:
        four = t.groupBy(*place).agg(F.collect_list(F.struct("nuc", (F.col("p") + eps).alias("p"))).alias("_x"), F.sum(F.col("p") + eps).alias("_t"))
        one = four.select(*place, F.explode(F.transform("_x", lambda x: F.struct(x["nuc"].alias("nuc"), (x["p"] / F.col("_t")).alias("p")))).alias("_x"))
        return one.select(*place, F.col("_x.nuc").alias("nuc"), (F.log2("_x.p") - F.log2(1 - F.col("_x.p"))).alias(name))

    j = logits(mutant, [*keys, "pos_i", "alt", "pos_j"], "a").join(logits(base, [*keys, "pos_j"], "b"), [*keys, "pos_j", "nuc"])
    change = F.when(F.col("pos_i") == F.col("pos_j"), 0.0).otherwise(F.abs(F.col("a") - F.col("b")))
    return mirrored(j.groupBy(*keys, "pos_i", "pos_j").agg(F.max(change).alias("score")), keys)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def token_offset(whole: DataFrame, probe: DataFrame, keys: list[str], needed: Column) -> DataFrame:
    """``keys, offset``: the token that a change of the first base moves most, the first of equals.

    ``whole, probe``: keys, token (from 0), vec, before and after that change. If fewer than ``needed`` tokens follow,
    only those that leave room are looked at.
    """
    d = whole.join(probe.select(*keys, "token", F.col("vec").alias("_p")), [*keys, "token"]).select(*keys, "token", needed.alias("_n"), l2(F.col("vec"), F.col("_p")).alias("_d"))
    d = d.join(d.groupBy(*keys).agg((F.max("token") + 1).alias("_t")), keys)
    moved = F.struct("_d", -F.col("token"))
    last = F.greatest(F.col("_t") - F.col("_n"), F.lit(0))
    best = d.groupBy(*keys).agg(F.max_by("token", moved).alias("_all"), F.max_by("token", F.when(F.col("token") <= last, moved)).alias("_fit"), F.max("_t").alias("_t"), F.max("_n").alias("_n"))
    return best.select(*keys, F.when(F.col("_all") + F.col("_n") > F.col("_t"), F.col("_fit")).otherwise(F.col("_all")).alias("offset"))


def perturbation_map(whole: DataFrame, mutant: DataFrame, offsets: DataFrame, keys: list[str], k: int = 1, distance: Callable[[Column, Column], Column] = l2, mean: bool = False) -> DataFrame:
    """``keys, pos_i, pos_j, score``: how far the token of j moves when i is mutated, both ways; i <> j.

    ``whole``: keys, token, vec; ``mutant``: keys, pos_i, alt, token, vec; ``offsets``: keys, offset, and ``length``
    of the sequence; tokens of ``k`` bases. Over the alleles of i the largest distance counts, or their ``mean``.
    ``distance`` makes a column of two array columns: a built-in expression or a pandas UDF.
    """
    both = mutant.join(whole.select(*keys, "token", F.col("vec").alias("_w")), [*keys, "token"]).join(offsets, keys).where("token >= offset")
    begin = (F.col("token") - F.col("offset")) * k
    both = both.where(begin < F.col("length")).withColumn("_d", distance(F.col("_w"), F.col("vec")))
    j = both.select(*keys, "pos_i", "length", "_d", F.explode(F.sequence(begin, begin + (k - 1))).alias("pos_j")).where("pos_j < length and pos_i <> pos_j")
    return mirrored(j.groupBy(*keys, "pos_i", "pos_j").agg((F.avg if mean else F.max)("_d").alias("score")), keys)


def best_of_alleles(scores: DataFrame, keys: list[str], i: str, j: str, value: str) -> DataFrame:
    """Position map of the largest value over allele combinations, mirrored."""
    m = scores.groupBy(*keys, F.col(i).alias("pos_i"), F.col(j).alias("pos_j")).agg(F.max(value).alias("score"))
    return m.unionByName(m.select(*keys, F.col("pos_j").alias("pos_i"), F.col("pos_i").alias("pos_j"), "score"))


def pair_windows(df: DataFrame, keys: list[str], pad: int, most: int, context: int) -> DataFrame:
    """``keys, part, lo, hi, pos, is_site``: windows around places ``pos1, pos2`` of sequences of ``length``, and their places.

    A window goes ``pad`` beyond both places and is cut at the sequence's ends. If it has more than ``context`` bases, each
    place has a window of its own instead, half of ``context`` to either side. Within a window (``lo`` to ``hi``, outside)
    every ``step``-th place is looked at, ``step`` being its length by ``most``, rounded down, 1 at least, and the places
    themselves always; ``pos`` counts from the window's first base. ``part`` is ``pair``, ``first`` or ``second``.
    """
    a, b, n = F.least("pos1", "pos2"), F.greatest("pos1", "pos2"), F.col("length")
    lo, hi = F.greatest(F.lit(0), a - pad), F.least(n, b + pad + 1)
    of = lambda part, lo, hi, sites: F.struct(F.lit(part).alias("part"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), F.transform(sites, lambda x: x.cast("int")).alias("sites"))
    half = context // 2
    alone = lambda part, p: of(part, F.greatest(F.lit(0), F.col(p) - half), F.least(n, F.col(p) + half), F.array(p))
    parts = F.when(hi - lo <= context, F.array(of("pair", lo, hi, F.array("pos1", "pos2")))).otherwise(F.array(alone("first", "pos1"), alone("second", "pos2")))
    w = df.select(*keys, F.explode(parts).alias("_w")).select(*keys, "_w.*")
    step = F.greatest(F.lit(1), F.floor((F.col("hi") - F.col("lo")) / most).cast("int"))
    w = w.withColumn("_s", F.transform("sites", lambda x: x - F.col("lo")))
    grid = F.array_distinct(F.concat(F.sequence(F.lit(0), F.col("hi") - F.col("lo") - 1, step), F.col("_s")))
    return w.select(*keys, "part", "lo", "hi", "_s", F.explode(grid).alias("pos")).withColumn("is_site", F.array_contains("_s", F.col("pos"))).drop("_s")
