"""Structure records in fixed columns, residues near each other, and high scores outside known contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import fixed


def atoms(lines: DataFrame, keys: list[str], line: str = "value", atom: str = "C1'") -> DataFrame:
    """``keys, chain, residue, x, y, z`` of one atom per residue from ``ATOM`` records of fixed columns.

    Columns, from 1: name 13-16, chain 22, residue number 23-26, coordinates 31-38, 39-46, 47-54. Other records and
    atoms, and lines whose numbers cannot be read, are left out. A blank chain is the empty name. Of records of one
    residue (alternate places) the least coordinates count.
    """
    cut = lambda a, n: F.trim(F.substring(F.col(line), a, n))
    number = lambda c: c.try_cast("double")
    a = lines.where(F.col(line).startswith("ATOM") & (cut(13, 4) == atom)).select(*keys, cut(22, 1).alias("chain"), cut(23, 4).try_cast("int").alias("residue"), *[number(cut(p, 8)).alias(n) for n, p in (("x", 31), ("y", 39), ("z", 47))])
    a = a.dropna(subset=["residue", "x", "y", "z"])
    return a.groupBy(*keys, "chain", "residue").agg(F.min(F.struct("x", "y", "z")).alias("_p")).select(*keys, "chain", "residue", "_p.x", "_p.y", "_p.z")


def indexed(residues: DataFrame, keys: list[str], chains: list[str] | None = None) -> DataFrame:
    """Adds ``i``, from 0 along all chains of a structure: a chain begins where the one before ends, gaps counted.

    Chains come in the order given, or by name; those not given are left out.
    """
    order = F.array_position(F.array(*[F.lit(c) for c in chains]), F.col("chain")) if chains else F.col("chain")
    r = residues.where(F.col("chain").isin(*chains)) if chains else residues
    ends = r.groupBy(*keys, "chain").agg(F.min("residue").alias("_first"), F.max("residue").alias("_last"))
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_offset", F.coalesce(F.sum(F.col("_last") - F.col("_first") + 1).over(before), F.lit(0)))
    return r.join(ends, [*keys, "chain"]).withColumn("i", (F.col("_offset") + F.col("residue") - F.col("_first")).cast("int")).drop("_first", "_last", "_offset")


def neighbours(points: DataFrame, keys: list[str], radius: float, key: str = "i") -> DataFrame:
    """``keys, i, j, distance, proximity`` of points at most ``radius`` apart, i < j; equal places have proximity null.

    Space is cut into cubes of ``radius``: a point meets those of its own cube and of the 26 around it by an equi-join, so
    a structure's far residues never meet.
    """
    cube = [F.floor(F.col(c) / radius) for c in ("x", "y", "z")]
    near = F.explode(F.array(*[F.struct(*[(c + d).alias(f"_{k}") for k, c, d in zip("xyz", cube, step, strict=True)]) for step in [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]]))
    a = points.select(*keys, F.col(key).alias("i"), "x", "y", "z", near.alias("_at")).select(*keys, "i", "x", "y", "z", "_at.*")
    b = points.select(*keys, F.col(key).alias("j"), *[F.col(c).alias(f"{c}2") for c in "xyz"], *[v.alias(f"_{k}") for k, v in zip("xyz", cube, strict=True)])
    d = F.sqrt(sum((F.pow(F.col(c) - F.col(f"{c}2"), 2) for c in "xyz"), F.lit(0.0)))
    j = a.join(b, [*keys, "_x", "_y", "_z"]).where("i < j").withColumn("distance", d).where(F.col("distance") <= radius)
    return j.select(*keys, "i", "j", "distance", F.when(F.col("distance") > 0, 1 / F.col("distance")).alias("proximity"))


def proximity_map(points: DataFrame, sizes: DataFrame, keys: list[str], key: str = "i") -> DataFrame:
    """``keys, i, j, distance, proximity`` of all pairs of places of a structure of ``sizes`` (keys, length), i < j.

    Null where a place is not resolved. A small structure's whole map: its square is what is asked for.
    """
    place = sizes.select(*keys, F.explode(F.sequence(F.lit(0), F.col("length").cast("int") - 1)).alias("i")).join(points.select(*keys, F.col(key).alias("i"), F.struct("x", "y", "z").alias("_p")), [*keys, "i"], "left")
    other = place.select(*keys, F.col("i").alias("j"), F.col("_p").alias("_q"))
    d = F.sqrt(sum((F.pow(F.col(f"_p.{c}") - F.col(f"_q.{c}"), 2) for c in "xyz"), F.lit(0.0)))
    j = place.join(other, keys).where("i < j").withColumn("distance", d)
    return j.select(*keys, "i", "j", "distance", F.when(F.col("distance") > 0, 1 / F.col("distance")).alias("proximity"))


def paired_label(pairs: DataFrame, contacts: DataFrame, keys: list[str], i: str = "pos1", j: str = "pos2") -> DataFrame:
    """Adds ``is_paired``: whether two places, in either order, are paired in ``contacts`` (keys, i, j)."""
    known = contacts.select(*keys, F.least("i", "j").alias("_i"), F.greatest("i", "j").alias("_j"), F.lit(True).alias("_yes")).distinct()
    on = pairs.withColumn("_i", F.least(i, j)).withColumn("_j", F.greatest(i, j))
    return on.join(known, [*keys, "_i", "_j"], "left").withColumn("is_paired", F.coalesce("_yes", F.lit(False))).drop("_i", "_j", "_yes")


def region_of(place: Column, regions: list[tuple[int, str]]) -> Column:
    """The name of the region that a place lies in: ``(end, name)`` in order, the last one open."""
    out = F.lit(regions[-1][1])
    for end, name in reversed(regions[:-1]):
        out = F.when(place < end, name).otherwise(out)
    return out


def novel_pairs(scores: DataFrame, contacts: DataFrame, keys: list[str], regions: list[tuple[int, str]], share: float = 0.9, apart: int = 4) -> DataFrame:
    """``keys, pos_i, pos_j, score, distance, region_i, region_j, crosses`` of high scores that are no known contacts.

    ``scores``: keys, pos_i, pos_j, score. High is above the ``share`` quantile of a map's positive scores; places are at
    least ``apart`` from each other. ``crosses`` marks pairs of two regions. Null scores take no part.
    """
    up = fixed(scores.where("pos_i < pos_j and score is not null"))
    bound = up.where("score > 0").groupBy(*keys).agg(F.percentile("score", share).alias("_bound"))
    high = up.join(bound, keys).where((F.col("score") > F.col("_bound")) & (F.col("pos_j") - F.col("pos_i") >= apart)).drop("_bound")
    known = contacts.select(*keys, F.least("i", "j").alias("pos_i"), F.greatest("i", "j").alias("pos_j"))
    out = high.join(known, [*keys, "pos_i", "pos_j"], "left_anti")
    out = out.withColumn("region_i", region_of(F.col("pos_i"), regions)).withColumn("region_j", region_of(F.col("pos_j"), regions))
    return out.select(*keys, "pos_i", "pos_j", "score", (F.col("pos_j") - F.col("pos_i")).alias("distance"), "region_i", "region_j", (F.col("region_i") != F.col("region_j")).alias("crosses"))
