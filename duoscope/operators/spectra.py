"""Spectra and inverses of large covariances: no matrix of d x d cells meets in one task or on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import fixed

#: Bytes of axes that the driver holds, and of a broadcast of panels.
HELD, PANEL = 256 << 20, 64 << 20


def stacked(part: pd.Series) -> np.ndarray:
    return np.stack(part.to_numpy()).astype(np.float64)


def moments(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """``keys, i, n, mean, square``: count, mean and mean square about it of every coordinate, a row each."""
    types = dict(df.dtypes)
    schema = "".join(f"`{c}` {types[c]}, " for c in keys) + "i int, n long, s double, q double"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for b in batches:
            for key, part in b.groupby(keys, dropna=False):
                x = stacked(part[vector])
                now = held.setdefault(key, [0, np.zeros(x.shape[1]), np.zeros(x.shape[1])])
                now[0] += len(x)
                now[1] += x.sum(axis=0)
                now[2] += (x * x).sum(axis=0)
        for key, (n, s, q) in held.items():
            yield pd.DataFrame({**dict(zip(keys, key, strict=True)), "i": np.arange(len(s)), "n": n, "s": s, "q": q})[[*keys, "i", "n", "s", "q"]]

    sums = df.where(F.col(vector).isNotNull()).select(*keys, vector).mapInPandas(partial, schema).groupBy(*keys, "i").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])
    mean = F.col("s") / F.col("n")
    return sums.select(*keys, "i", "n", mean.alias("mean"), (F.col("q") / F.col("n") - mean * mean).alias("square"))


def products(df: DataFrame, keys: list[str], vector: str, held: dict[tuple, tuple[np.ndarray, np.ndarray]]) -> dict[tuple, np.ndarray]:
    """For each key ``(mean, V)`` the product ``(X - mean)' (X - mean) V``, d rows of as many numbers as V has columns.

    A task sums its rows' part, d x b numbers a key; parts meet by coordinate.
    """
    sent = df.sparkSession.sparkContext.broadcast(held)
    types = dict(df.dtypes)
    width = max(v.shape[1] for _, v in held.values())
    schema = "".join(f"`{c}` {types[c]}, " for c in keys) + "i int, v array<double>"

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            for key, part in b.groupby(keys, dropna=False):
                if key in sent.value:
                    mean, v = sent.value[key]
                    x = stacked(part[vector]) - mean
                    sums[key] = sums.get(key, 0.0) + x.T @ (x @ v)
        for key, s in sums.items():
            wide = np.pad(s, ((0, 0), (0, width - s.shape[1])))
            yield pd.DataFrame({**{c: [k] * len(s) for c, k in zip(keys, key, strict=True)}, "i": np.arange(len(s)), "v": list(wide)})[[*keys, "i", "v"]]

    cells = df.where(F.col(vector).isNotNull()).select(*keys, vector).mapInPandas(partial, schema)
    out = cells.groupBy(*keys, "i").agg(F.array(*[F.sum(F.get("v", c)) for c in range(width)]).alias("v")).toPandas()
    return {key: stacked(part.sort_values("i")["v"])[:, : held[key][1].shape[1]] for key, part in out.groupby(keys, dropna=False)}


def eigenpairs(df: DataFrame, keys: list[str], vector: str, k: int, block: int = 16, tolerance: float = 1e-9, passes: int = 60, divisor: int = 1, seed: int = 7) -> DataFrame:
    """``keys, n, dim, rank, value, share, axis``: the ``k`` leading eigenpairs of each key's covariance, largest first.

    Each pass multiplies the covariance, as the rows that make it, by a block of vectors; all blocks so far span the
    space in which eigenpairs are sought (Rayleigh and Ritz), until the residuals of the first ``k`` are below
    ``tolerance`` times the largest value, or the space is the whole one, when they are exact. ``share`` is a value's
    part of the trace. Covariances divide by n - ``divisor``; a key of fewer rows has none. The driver holds the
    blocks, d numbers a vector, of as many keys at a time as 256 MB allow; of ``keys`` there are few (models, bins).
    Vectors of a key have one length.
    """
    spark = df.sparkSession
    first = moments(df, keys, vector).toPandas()
    info = {}
    for key, part in first.groupby(keys, dropna=False):
        part = part.sort_values("i")
        n = int(part["n"].iloc[0])
        if n > divisor:
            info[key] = (n, part["mean"].to_numpy(), float(part["square"].sum()) * n / (n - divisor))
    found = []
    waiting = list(info)
    while waiting:
        room, now = HELD, []
        while waiting and (not now or room > 0):
            now.append(waiting.pop())
            d = len(info[now[-1]][1])
            room -= 16 * d * min(d, block * passes)
        for key, (values, axes) in ritz(df, keys, vector, {x: info[x] for x in now}, k, block, tolerance, passes, divisor, seed).items():
            n, mean, trace = info[key]
            found += [(*key, n, len(mean), r + 1, float(v), float(v / trace) if trace > 0 else 0.0, axes[:, r].tolist()) for r, v in enumerate(values)]
    types = dict(df.dtypes)
    schema = "".join(f"`{c}` {types[c]}, " for c in keys) + "n long, dim int, rank int, value double, share double, axis array<double>"
    return spark.createDataFrame([tuple(x.item() if isinstance(x, np.generic) else x for x in r) for r in found], schema)


def ritz(df: DataFrame, keys: list[str], vector: str, info: dict[tuple, tuple], k: int, block: int, tolerance: float, passes: int, divisor: int, seed: int) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
    """Values and axes of each key from the growing space of its blocks."""
    rng = np.random.default_rng(seed)
    space, image, following, done = {}, {}, {}, {}
    for key, (_, mean, _) in info.items():
        d = len(mean)
        space[key], image[key] = np.empty((d, 0)), np.empty((d, 0))
        following[key] = np.linalg.qr(rng.normal(size=(d, min(block, d))))[0]
    for turn in range(passes):
        if not following:
            break
        got = products(df, keys, vector, {key: (info[key][1], v) for key, v in following.items()})
        for key, v in list(following.items()):
            n, mean, _ = info[key]
            d = len(mean)
            space[key] = np.column_stack([space[key], v])
            image[key] = np.column_stack([image[key], got[key] / (n - divisor)])
            q, a = space[key], image[key]
            small = q.T @ a
            values, turned = np.linalg.eigh((small + small.T) / 2)
            top = np.argsort(-values, kind="stable")[:k]
            values, turned = values[top], turned[:, top]
            axes = q @ turned
            gap = np.linalg.norm(a @ turned - axes * values, axis=0)
            least = tolerance * max(abs(values[0]), 1e-300)
            if q.shape[1] == d or (len(values) == min(k, d) and (gap <= least).all()) or turn == passes - 1:
                done[key] = (np.maximum(values, 0.0), axes)
                del following[key]
                continue
            fresh = a[:, -v.shape[1] :]
            for _ in range(2):
                fresh = fresh - q @ (q.T @ fresh)
            u, s, _ = np.linalg.svd(fresh, full_matrices=False)
            u = u[:, s > 1e-10 * max(abs(values[0]), 1e-300)]
            if not u.shape[1]:
                # What is left is orthogonal to all the rows seen through the space: look in a direction of chance.
                u = rng.normal(size=(d, min(block, d - q.shape[1])))
            for _ in range(2):
                u = u - q @ (q.T @ u)
                u = np.linalg.qr(u)[0]
            following[key] = u[:, : d - q.shape[1]]
    return done


def effective_dimensions(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, dim, n_values, participation_ratio, usage, dims_95, dims_99, condition, entropy`` of eigenpairs.

    Values below 1e-12 of the trace are zero but for rounding and take no part. ``dims_95, dims_99`` are null where the pairs at hand do not reach that
    share; the other measures are of all values only where ``n_values`` is the dimension.
    """
    v = pairs.where("value > 0 and share > 1e-12")
    whole = Window.partitionBy(*keys)
    v = v.withColumn("_upto", F.sum("share").over(whole.orderBy("rank"))).withColumn("_p", F.col("value") / F.sum("value").over(whole))
    reach = lambda s: F.min(F.when(F.col("_upto") >= s - 1e-12, F.col("rank")))
    return v.groupBy(*keys).agg(
        F.max("dim").alias("dim"), F.count("*").alias("n_values"), (F.pow(F.sum("value"), 2) / F.sum(F.col("value") * F.col("value"))).alias("participation_ratio"),
        (F.pow(F.sum("value"), 2) / F.sum(F.col("value") * F.col("value")) / F.max("dim")).alias("usage"), reach(0.95).alias("dims_95"), reach(0.99).alias("dims_99"),
        (F.max("value") / F.min("value")).alias("condition"), (-F.sum(F.col("_p") * F.log(F.col("_p") + 1e-30))).alias("entropy"),
    )


def curve_correlations(pairs: DataFrame, key: str, points: int = 200) -> DataFrame:
    """``key_a, key_b, r``: correlation of two keys' cumulated shares of variance over the share of their dimensions.

    Curves of positive values are read at ``points`` even places by straight lines, so dimensions may differ. Keys have
    all their pairs; a curve is ``points`` rows, and every two keys are compared, of which there are few.
    """
    kind = dict(pairs.dtypes)[key]

    def curve(part: pd.DataFrame) -> pd.DataFrame:
        e = np.sort(part["value"].to_numpy())[::-1]
        e = e[e > 1e-12 * max(e.sum(), 0.0)]
        if not len(e):
            return pd.DataFrame({key: [], "at": [], "y": []})
        y = np.interp(np.linspace(0, 1, points), np.linspace(0, 1, len(e)), np.cumsum(e) / e.sum())
        return pd.DataFrame({key: [part[key].iloc[0]] * points, "at": np.arange(points), "y": y})

    c = fixed(pairs.select(key, "value").groupBy(key).applyInPandas(curve, f"`{key}` {kind}, at int, y double"))
    other = c.select(F.col(key).alias("key_b"), "at", F.col("y").alias("_y"))
    return c.withColumnRenamed(key, "key_a").join(other, "at").where("key_a < key_b").groupBy("key_a", "key_b").agg(F.corr("y", "_y").alias("r"))


def in_blocks(cells: DataFrame, keys: list[str], size: int = 256) -> DataFrame:
    """``keys, bi, bj, h, w, m``: cells ``i, j, value`` as dense blocks of up to ``size`` rows and columns, doubles by rows."""
    types = dict(cells.dtypes)
    schema = "".join(f"`{c}` {types[c]}, " for c in keys) + "bi int, bj int, h int, w int, m binary"

    def dense(part: pd.DataFrame) -> pd.DataFrame:
        i, j = part["i"].to_numpy() % size, part["j"].to_numpy() % size
        m = np.zeros((i.max() + 1, j.max() + 1))
        m[i, j] = part["value"]
        return pd.DataFrame({**{c: [part[c].iloc[0]] for c in keys}, "bi": [part["bi"].iloc[0]], "bj": [part["bj"].iloc[0]], "h": [m.shape[0]], "w": [m.shape[1]], "m": [m.tobytes()]})

    laid = cells.select(*keys, "i", "j", "value", F.floor(F.col("i") / size).cast("int").alias("bi"), F.floor(F.col("j") / size).cast("int").alias("bj"))
    return laid.groupBy(*keys, "bi", "bj").applyInPandas(dense, schema)


def inverse(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks of the inverses of symmetric positive definite matrices given in blocks, all keys at once.

    Block by block the matrix is swept: the pivot is inverted, its row and column are multiplied by that, and every
    other block loses their product. A step joins each block with three more, so a task holds a few blocks at a time;
    steps are checkpointed, since each depends on the last. Symmetry is kept, so a column is its row turned.
    """
    types = dict(blocks.dtypes)
    names = [*keys, "bi", "bj", "h", "w", "m"]
    schema = ", ".join(f"`{c}` {types[c]}" for c in names)
    now = fixed(blocks.select(*names))
    top = now.agg(F.max("bi")).first()[0]

    for p in range(0 if top is None else top + 1):
        pivot = now.where((F.col("bi") == p) & (F.col("bj") == p)).select(*keys, F.col("m").alias("_p"), F.col("h").alias("_s"))
        line = now.where(F.col("bi") == p)
        left = line.select(*keys, F.col("bj").alias("bi"), F.col("m").alias("_l"))
        right = line.select(*keys, "bj", F.col("m").alias("_r"))

        def swept(batches: Iterator[pd.DataFrame], p: int = p) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for r in b.itertuples(index=False):
                    h, w, s = r.h, r.w, getattr(r, "s_")
                    get = lambda x, shape: np.frombuffer(x).reshape(shape)
                    inv = np.linalg.inv(get(r.p_, (s, s)))
                    if r.bi == p and r.bj == p:
                        m = -inv
                    elif r.bi == p:
                        m = inv @ get(r.m, (h, w))
                    elif r.bj == p:
                        m = get(r.m, (h, w)) @ inv
                    else:
                        m = get(r.m, (h, w)) - get(r.l_, (s, h)).T @ inv @ get(r.r_, (s, w))
                    out.append(np.ascontiguousarray(m).tobytes())
                yield b[names].assign(m=out)

        met = now.join(pivot, keys).join(left, [*keys, "bi"]).join(right, [*keys, "bj"])
        met = met.withColumnsRenamed({"_p": "p_", "_s": "s_", "_l": "l_", "_r": "r_"})
        now = fixed(met.mapInPandas(swept, schema))

    @F.pandas_udf("binary")
    def turned(m: pd.Series) -> pd.Series:
        return m.map(lambda x: (-np.frombuffer(x)).tobytes())

    return now.withColumn("m", turned("m"))


def cells_of(blocks: DataFrame, keys: list[str], size: int = 256) -> DataFrame:
    """``keys, i, j, value`` of matrices in blocks."""
    types = dict(blocks.dtypes)
    schema = "".join(f"`{c}` {types[c]}, " for c in keys) + "i int, j int, value double"

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.to_dict("records"):
                at = np.arange(r["h"] * r["w"])
                yield pd.DataFrame({**{c: [r[c]] * len(at) for c in keys}, "i": r["bi"] * size + at // r["w"], "j": r["bj"] * size + at % r["w"], "value": np.frombuffer(r["m"])})

    return blocks.mapInPandas(spread, schema)


def partial_correlations(precision: DataFrame, keys: list[str], thresholds: tuple[float, ...] = (0.01, 0.05, 0.1)) -> DataFrame:
    """``keys, mean_abs, max_abs, sparse_..`` of the partial correlations in the cells of inverse covariances.

    ``sparse_t`` is the share of pairs below ``t`` in size. Cells meet the diagonal's, a row per coordinate.
    """
    scale = precision.where("i = j").select(*keys, F.col("i").alias("_i"), F.sqrt(F.abs("value")).alias("_s"))
    scale = scale.withColumn("_s", F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s")))
    c = precision.where("i < j").join(scale.withColumnsRenamed({"_i": "i", "_s": "_a"}), [*keys, "i"]).join(scale.withColumnsRenamed({"_i": "j", "_s": "_b"}), [*keys, "j"])
    r = F.abs(F.col("value") / (F.col("_a") * F.col("_b")))
    return c.groupBy(*keys).agg(F.avg(r).alias("mean_abs"), F.max(r).alias("max_abs"), *[F.avg(F.when(r < t, 1.0).otherwise(0.0)).alias(f"sparse_{t:g}".replace(".", "_")) for t in thresholds])


def relative_difference(a: DataFrame, b: DataFrame, keys: list[str], eps: float = 1e-30) -> DataFrame:
    """``keys, difference``: Frobenius norm of ``b - a`` over that of ``a``, by cells; ``a`` may lack some of the keys."""
    on = [c for c in keys if c in a.columns]
    j = b.withColumnRenamed("value", "_b").join(a.select(*on, "i", "j", F.col("value").alias("_a")), [*on, "i", "j"])
    return j.groupBy(*keys).agg((F.sqrt(F.sum(F.pow(F.col("_b") - F.col("_a"), 2))) / (F.sqrt(F.sum(F.pow("_a", 2))) + eps)).alias("difference"))


def distances(df: DataFrame, keys: list[str], blocks: DataFrame, vectors: dict[str, str], id_cols: list[str], size: int = 256, panel: int = PANEL) -> DataFrame:
    """``id_cols`` and the distance of each vector under its key's inverse in ``blocks``; null without one or of another length.

    Quadratic forms are summed over groups of block rows of at most ``panel`` bytes (one row of blocks at least), which
    is what a broadcast holds; ``id_cols`` are unique. Negative forms count as 0.
    """
    spark = df.sparkSession
    blocks = fixed(blocks)
    sizes = blocks.groupBy(*keys, "bi").agg(F.sum(F.length("m")).alias("b")).orderBy(*keys, "bi").collect()
    dims = {tuple(r[c] for c in keys): r["d"] for r in blocks.where("bi = bj").groupBy(*keys).agg(F.sum("h").alias("d")).collect()}
    groups: list[list] = []
    room = 0
    for r in sizes:
        if not groups or r["b"] > room:
            groups.append([])
            room = panel
        groups[-1].append(r)
        room -= r["b"]
    asked = df.select(*dict.fromkeys([*id_cols, *keys, *vectors.values()]))
    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in id_cols) + "".join(f", `{n}` double" for n in vectors)
    parts = None
    for g in groups or [[]]:
        panels: dict[tuple, list[tuple[int, np.ndarray]]] = {}
        for r in g:
            key = tuple(r[c] for c in keys)
            same = [F.col(c).eqNullSafe(F.lit(r[c])) for c in keys]
            row = blocks.where(F.col("bi") == r["bi"])
            for s in same:
                row = row.where(s)
            got = sorted(row.select("bj", "h", "w", "m").collect())
            panels.setdefault(key, []).append((r["bi"] * size, np.column_stack([np.frombuffer(x["m"]).reshape(x["h"], x["w"]) for x in got])))
        sent = spark.sparkContext.broadcast(panels)

        def forms(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for b in batches:
                for key, part in b.groupby(keys, dropna=False):
                    d = dims.get(key)
                    out = part[id_cols].copy()
                    for name, v in vectors.items():
                        fits = np.array([d is not None and x is not None and len(x) == d for x in part[v]], dtype=bool)
                        f = np.full(len(part), np.nan)
                        if fits.any():
                            x = stacked(part[v][fits])
                            f[fits] = sum((((x @ m.T) * x[:, at : at + len(m)]).sum(axis=1) for at, m in sent.value.get(key, [])), np.zeros(len(x)))
                        out[name] = pd.array(f, dtype="Float64")
                    yield out

        one = asked.mapInPandas(forms, schema)
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy(*id_cols).agg(*[F.when(F.sum(n).isNotNull(), F.sqrt(F.greatest(F.sum(n), F.lit(0.0)))).alias(n) for n in vectors])
