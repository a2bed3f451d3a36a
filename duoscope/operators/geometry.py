"""Geometry of variant pairs from their four embeddings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import EPS, as_double, cosine_distance, cosine_of, dot, minus, norm, plus

ROLES = ("WT", "M1", "M2", "M12")


def quadruples(store: DataFrame, keys: list[str], role: str = "role", vector: str = "embedding") -> DataFrame:
    """One row per pair with columns of the four roles; null where a role is missing."""
    return store.groupBy(*keys).pivot(role, list(ROLES)).agg(F.first(vector))


def majority_dimension(store: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """The commonest vector length of each store, the larger of equals."""
    sizes = store.groupBy(*keys, F.size(vector).alias("dim")).agg(F.count("*").alias("n"))
    return sizes.groupBy(*keys).agg(F.max_by("dim", F.struct("n", "dim")).alias("dim"))


def with_dots(pairs: DataFrame) -> DataFrame:
    """Adds the effect vectors' dot products, from which every metric follows; null unless all four are of one length."""
    sizes = [F.size(r) for r in ROLES]
    whole = (sizes[0] > 0) & (sizes[0] == sizes[1]) & (sizes[0] == sizes[2]) & (sizes[0] == sizes[3])
    z = {r: F.when(whole, as_double(F.col(r))) for r in ROLES}
    df = pairs.withColumn("_1", minus(z["M1"], z["WT"])).withColumn("_2", minus(z["M2"], z["WT"])).withColumn("_o", minus(z["M12"], z["WT"]))
    df = df.withColumn("_e", plus(F.col("_1"), F.col("_2"))).withColumn("_r", minus(F.col("_o"), F.col("_e"))).withColumn("_d", minus(F.col("_1"), F.col("_2")))
    for a, b in ("11", "22", "oo", "ee", "rr", "12", "er", "oe", "od", "ed", "dd"):
        df = df.withColumn(f"_{a}{b}", dot(F.col(f"_{a}"), F.col(f"_{b}")))
    return df


def metric_columns() -> dict[str, Column]:
    """The pair metrics and the residual's parts along and across the additive effect."""
    c = F.col
    a1, a2, a12, exp, raw = (F.sqrt(c(x)) for x in ("_11", "_22", "_oo", "_ee", "_rr"))
    cos_oe = cosine_of(c("_oe"), c("_oo"), c("_ee"))
    along = F.when(exp < EPS, F.lit(0.0)).otherwise(c("_er") / exp)
    clamped = F.greatest(F.least(c("_oe") / (a12 * exp + EPS), F.lit(1.0)), F.lit(-1.0))
    return {
        "len_WT_M1": a1, "len_WT_M2": a2, "len_WT_M12": a12, "len_WT_M12_exp": exp, "epi_R_raw": raw,
        "epi_R_singles": raw / (F.sqrt(c("_11") + c("_22")) + EPS), "cos_v1_v2": cosine_of(c("_12"), c("_11"), c("_22")),
        "cos_exp_to_obs": cosine_of(c("_er"), c("_ee"), c("_rr")), "magnitude_ratio": a12 / (exp + EPS),
        "log_magnitude_ratio": F.log((a12 + EPS) / (exp + EPS)), "cos_obs_exp": cos_oe, "cos_dist_obs_exp": 1 - cos_oe,
        "r_parallel": along, "r_perp": F.sqrt(F.greatest(c("_rr") - along * along, F.lit(0.0))), "theta": F.acos(clamped),
        "max_single": F.greatest(a1, a2), "sum_singles": a1 + a2,
    }


def pair_metrics(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return with_dots(pairs).select(*keys, *[v.alias(k) for k, v in metric_columns().items()])


def polar(x: Column, y: Column) -> dict[str, Column]:
    angle = F.atan2(y, x)
    return {"x_obs": x, "y_obs": y, "rho": F.sqrt(x * x + y * y), "theta": angle, "theta_over_pi": angle / math.pi}


def complex_coords(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The observed effect in the plane of the additive effect (1, 0) and of what sets the singles apart."""
    df = with_dots(pairs)
    c = F.col
    exp = F.sqrt(c("_ee"))
    across = F.sqrt(F.greatest(c("_dd") - F.try_divide(c("_ed") * c("_ed"), c("_ee")), F.lit(0.0)))
    x = F.try_divide(c("_oe"), exp)
    y = F.when(across > 0, (c("_od") - c("_ed") * c("_oe") / c("_ee")) / across).otherwise(0.0)
    return df.select(*keys, *[v.alias(k) for k, v in polar(x / (exp + EPS), y / (exp + EPS)).items()])


def triangle_coords(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The triangle of wild type, expected and observed by its three sides."""
    df = with_dots(pairs)
    o2, e2, r2 = F.col("_oo"), F.col("_ee"), F.col("_rr")
    e = F.sqrt(e2)
    x = F.try_divide(o2 + e2 - r2, 2 * e)
    y = F.sqrt(F.greatest(o2 - x * x, F.lit(0.0)))
    x = F.when(e < EPS, F.sqrt(o2) / (e + EPS)).otherwise(x / (e + EPS))
    y = F.when(e < EPS, F.lit(0.0)).otherwise(y / (e + EPS))
    return df.select(*keys, *[v.alias(k) for k, v in polar(x, y).items()])


def single_coords(df: DataFrame, keys: list[str], wt: str = "WT", mut: str = "M1", axis: str | None = None) -> DataFrame:
    """A single variant's effect along and across its own or a given axis."""
    df = df.withColumn("_v", minus(as_double(F.col(mut)), as_double(F.col(wt))))
    axis_of = as_double(F.col(axis)) if axis else F.col("_v")
    df = df.withColumn("_vv", dot(F.col("_v"), F.col("_v"))).withColumn("_va", dot(F.col("_v"), axis_of)).withColumn("_n", norm(axis_of))
    along = F.when(F.col("_n") > EPS, F.col("_va") / F.col("_n")).otherwise(0.0)
    length = F.sqrt(F.col("_vv"))
    across = F.sqrt(F.greatest(F.col("_vv") - along * along, F.lit(0.0)))
    scale = F.greatest(length, F.lit(EPS))
    at = polar(along / scale, across / scale)
    return df.select(*keys, length.alias("v_l2"), along.alias("v_par"), across.alias("v_perp"), at["rho"].alias("radius"), at["theta"].alias("angle"))


def annotate_singles(df: DataFrame, keys: list[str], mut: str = "M1", prefix: str = "", axis: str | None = None, wt: str = "WT") -> DataFrame:
    """``keys`` and all coordinates of single variants, their names led by ``prefix``; null unless both vectors (and the axis) are there.

    ``v_l2, v_diff`` (cosine distance of mutant and wild type), ``v_par, v_perp`` along and across the effect's own or a
    given ``axis``, the point ``x, y`` of that in units of the length, ``radius, angle, angle_over_pi``.
    """
    whole = F.col(wt).isNotNull() & F.col(mut).isNotNull() & (F.size(wt) == F.size(mut))
    whole = whole & F.col(axis).isNotNull() & (F.size(axis) == F.size(mut)) if axis else whole
    part = df.withColumn("_whole", F.coalesce(whole, F.lit(False)))
    part = part.withColumn("_wt", F.when(F.col("_whole"), as_double(F.col(wt)))).withColumn("_mut", F.when(F.col("_whole"), as_double(F.col(mut))))
    part = part.withColumn("_axis", F.when(F.col("_whole"), as_double(F.col(axis))) if axis else minus(F.col("_mut"), F.col("_wt")))
    v = minus(F.col("_mut"), F.col("_wt"))
    part = part.withColumn("_v", v).withColumn("_l", norm(F.col("_v"))).withColumn("_n", norm(F.col("_axis")))
    along = F.when(F.col("_n") > EPS, dot(F.col("_v"), F.col("_axis")) / F.col("_n")).otherwise(F.when(F.col("_whole"), 0.0))
    part = part.withColumn("_par", along).withColumn("_perp", F.when(F.col("_whole"), F.sqrt(F.greatest(F.col("_l") * F.col("_l") - F.col("_par") * F.col("_par"), F.lit(0.0)))))
    scale = F.when(F.col("_whole"), F.greatest(F.col("_l"), F.lit(EPS)))
    at = polar(F.col("_par") / scale, F.col("_perp") / scale)
    names = {"v_l2": F.col("_l"), "v_diff": cosine_distance(F.col("_mut"), F.col("_wt")), "v_par": F.col("_par"), "v_perp": F.col("_perp"), "x": at["x_obs"], "y": at["y_obs"], "radius": at["rho"], "angle": at["theta"], "angle_over_pi": at["theta_over_pi"]}
    return part.select(*keys, *[F.when(F.col("_whole"), c).alias(prefix + n) for n, c in names.items()])


def feature_columns(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, all pair metrics, and the norms of the effect vectors."""
    m = pair_metrics(pairs, keys)
    names = {"norm_delta_a": "len_WT_M1", "norm_delta_b": "len_WT_M2", "norm_delta_add": "len_WT_M12_exp", "norm_delta_obs": "len_WT_M12", "norm_residual": "epi_R_raw"}
    return m.withColumns({n: F.col(c) for n, c in names.items()})


def sanity(pairs: DataFrame, keys: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Per pair: whether metrics ignore the order of the singles, and an additive double leaves no residual."""
    m = pair_metrics(pairs, keys)
    swapped = pair_metrics(pairs.select(*keys, "WT", F.col("M2").alias("M1"), F.col("M1").alias("M2"), "M12"), keys).select(*keys, *[F.col(x).alias(f"s_{x}") for x in ("epi_R_raw", "epi_R_singles", "magnitude_ratio")])
    additive = pairs.withColumn("M12", minus(plus(as_double(F.col("M1")), as_double(F.col("M2"))), as_double(F.col("WT"))))
    zero = pair_metrics(additive, keys).select(*keys, (F.col("epi_R_raw") < tolerance).alias("zero_residual"))
    same = [F.abs(F.col(x) - F.col(f"s_{x}")) < tolerance for x in ("epi_R_raw", "epi_R_singles", "magnitude_ratio")]
    return m.join(swapped, keys).join(zero, keys).select(*keys, (same[0] & same[1] & same[2]).alias("swap_symmetric"), "zero_residual")
