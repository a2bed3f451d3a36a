"""Hard negatives for anchors: cover trees over shards of the candidates, windows of scores, leaves verified exactly."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ROW, numbered, settle

#: Points of a node that is not split further, and the factor by which covering radii shrink a level.
LEAF, SHRINK = 16, 0.6


class CoverTree:
    """A cover tree over integer vectors, extended by one coordinate that makes all norms equal.

    In that space the inner product with a query (its extra coordinate 0) changes between a node's centre and any
    point below by the query's norm times their distance at most. Each level covers a node's points by centres
    that are more than the level's radius apart and have all points within it; a node keeps the radius measured.

    Node j has points ``lo[j]:hi[j]`` in the tree's order, one of them its ``centre[j]``, and the nodes
    ``first[j]:last[j]`` below it. ``pure`` nodes have points of one label only, ``of``.
    """

    def __init__(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> None:
        norms = np.einsum("ij,ij->i", x, x)
        most = norms.max() if len(x) else 0.0
        wide = np.column_stack([x, np.sqrt(np.maximum(most - norms, 0.0))])
        order = np.arange(len(x))
        nodes = [(0, 0, len(x), np.inf)] if len(x) else []
        radius, pure, of, first, last = [], [], [], [], []
        # Nodes are split in the order in which they are made, so the nodes below one stand side by side.
        for centre, lo, hi, scale in nodes:
            at = order[lo:hi]
            gap = wide[at] - wide[centre]
            radius.append(float(np.sqrt(np.einsum("ij,ij->i", gap, gap).max())))
            of.append(labels[at[0]])
            pure.append(bool((labels[at] == of[-1]).all()))
            first.append(len(nodes))
            if hi - lo > LEAF and radius[-1] > 1e-9:
                scale = min(radius[-1], scale) * SHRINK
                while len(centres := cover(wide, at, centre, scale)) == 1:
                    scale *= SHRINK
                mine = nearest(wide, at, centres)
                order[lo:hi] = at[np.argsort(mine, kind="stable")]
                ends = lo + np.cumsum(np.bincount(mine, minlength=len(centres)))
                nodes += [(int(c), int(b), int(e), scale) for c, b, e in zip(centres, [lo, *ends[:-1]], ends, strict=True)]
            last.append(len(nodes))
        self.x, self.ids, self.rows, self.labels = x[order], ids[order], rows[order], labels[order]
        place = np.empty(len(x), dtype=np.int64)
        place[order] = np.arange(len(x))
        self.centre = place[np.array([n[0] for n in nodes], dtype=np.int64)]
        self.lo, self.hi = (np.array([n[k] for n in nodes], dtype=np.int64) for k in (1, 2))
        self.first, self.last = np.array(first, dtype=np.int64), np.array(last, dtype=np.int64)
        self.radius, self.pure, self.of = np.array(radius), np.array(pure, dtype=bool), np.array(of, dtype=np.int64)

    def search(self, q: np.ndarray, row: int, label: int, same: bool, low: np.ndarray, high: np.ndarray, k: int) -> list[np.ndarray]:
        """For each window ``[low, high]`` the places of its first ``k`` points: highest score first, then least id and row.

        Points have the query's label (``same``) or another, and are not the query's own row. Nodes outside all
        windows, or below all windows' k-th scores so far, are skipped, level by level; centres, which are points too,
        raise those scores. Leaves are then verified exactly, highest bound first, until no bound reaches a k-th score.
        """
        length = float(np.sqrt(q @ q))
        floor = low.astype(float)
        best: list[np.ndarray] = [np.empty(0, dtype=np.int64)] * len(low)
        scores = [np.empty(0)] * len(low)
        leaves, bounds = [], []

        def open_to(places: np.ndarray) -> np.ndarray:
            return ((self.labels[places] == label) == same) & (self.rows[places] != row)

        level = np.arange(min(1, len(self.centre)))
        while len(level) and len(low):
            s = self.x[self.centre[level]] @ q
            slack = length * self.radius[level] * (1 + 1e-9) + 1e-6
            upper, lower = s + slack, s - slack
            mine = s[open_to(self.centre[level])]
            for w in range(len(low)):
                inside = mine[(mine >= floor[w]) & (mine <= high[w])]
                if len(inside) >= k:
                    floor[w] = np.partition(inside, len(inside) - k)[len(inside) - k]
            keep = ((upper[:, None] >= floor) & (lower[:, None] <= high)).any(axis=1) & ~(self.pure[level] & ((self.of[level] == label) != same))
            level, upper = level[keep], upper[keep]
            ends = self.first[level] == self.last[level]
            leaves.append(level[ends])
            bounds.append(upper[ends])
            level = ranges(self.first[level[~ends]], self.last[level[~ends]])

        if leaves:
            leaf, bound = np.concatenate(leaves), np.concatenate(bounds)
            turn = np.argsort(-bound, kind="stable")
            leaf, bound = leaf[turn], bound[turn]
            size = np.cumsum(self.hi[leaf] - self.lo[leaf])
            done, batch = 0, 16 * k
            while done < len(leaf) and bound[done] >= floor.min():
                upto = int(np.searchsorted(size, (size[done - 1] if done else 0) + batch)) + 1
                part = leaf[done:upto][bound[done:upto] >= floor.min()]
                places = ranges(self.lo[part], self.hi[part])
                s = self.x[places] @ q
                ok = open_to(places) & (s >= floor.min())
                places, s = places[ok], s[ok]
                for w in range(len(low)):
                    inside = (s >= floor[w]) & (s <= high[w])
                    p, v = np.concatenate([best[w], places[inside]]), np.concatenate([scores[w], s[inside]])
                    if len(p) > k:
                        least = np.partition(v, len(v) - k)[len(v) - k]
                        p, v = p[v >= least], v[v >= least]
                    now = np.lexsort((self.rows[p], self.ids[p], -v))[:k]
                    best[w], scores[w] = p[now], v[now]
                    if len(now) == k:
                        floor[w] = max(floor[w], v[now[-1]])
                done, batch = upto, batch * 4
        return best


def ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of the ranges ``lo[j]:hi[j]``, one after another."""
    n = hi - lo
    return np.arange(n.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(lo) else np.empty(0, dtype=np.int64)


def cover(wide: np.ndarray, at: np.ndarray, centre: int, scale: float) -> np.ndarray:
    """Greedy centres from ``at``, the node's own first: apart by more than ``scale``, all points within it of one."""
    square = np.einsum("ij,ij->i", wide[at], wide[at])
    centres = [centre]
    limit = scale * scale
    for k in range(0, len(at), 256):
        part = at[k : k + 256]
        known = wide[centres]
        d = square[k : k + 256, None] + np.einsum("ij,ij->i", known, known)[None] - 2 * wide[part] @ known.T
        left = np.flatnonzero(d.min(axis=1) > limit)
        while len(left):
            new = part[left[0]]
            centres.append(int(new))
            gap = wide[part[left]] - wide[new]
            left = left[np.einsum("ij,ij->i", gap, gap) > limit]
    return np.array(centres)


def nearest(wide: np.ndarray, at: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of each point's nearest centre; a centre is its own, so every level splits and centres nest."""
    known = wide[centres]
    square = np.einsum("ij,ij->i", known, known)
    mine = np.empty(len(at), dtype=np.int64)
    for k in range(0, len(at), 1024):
        mine[k : k + 1024] = (square[None] - 2 * wide[at[k : k + 1024]] @ known.T).argmin(axis=1)
    where = {int(c): j for j, c in enumerate(centres)}
    own = np.array([where.get(int(p), -1) for p in at])
    return np.where(own >= 0, own, mine)


def exact_limit(x: np.ndarray) -> None:
    """Scores are at most the largest squared norm; doubles hold whole numbers up to 2^53."""
    if len(x) and np.einsum("ij,ij->i", x, x).max() >= 2.0**53:
        raise ValueError("vectors too long: scaled squared norms must be below 2^53")


def trees(rows: DataFrame, per_shard: int) -> DataFrame:
    """``dim, shard, tree``: candidates of each vector length dealt by hash over shards, one tree each.

    A shard has about ``per_shard`` rows, or as many as 32 MB hold where vectors are long.
    """
    room = F.greatest(F.lit(1), F.least(F.lit(per_shard), F.floor(F.lit(32 << 20) / (8 * F.col("dim") + 64))))
    # A row per vector length.
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n")).select("dim", F.ceil(F.col("n") / room).alias("shards"))
    laid = rows.join(F.broadcast(sizes), "dim").withColumn("shard", F.pmod(F.xxhash64(ROW, "id"), F.col("shards")).cast("int"))

    def build(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(g["v"].to_list()).astype(np.float64).reshape(len(g), -1)
        exact_limit(x)
        tree = CoverTree(x, g["id"].to_numpy(), g[ROW].to_numpy(), g["label"].to_numpy())
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "tree": [pickle.dumps(tree, protocol=5)]})

    return settle(laid.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, tree binary"))


def searched(spark: SparkSession, grown: DataFrame, wave: pd.DataFrame, same: bool, k: int, tasks: int) -> DataFrame:
    """``anchor, window, id, row, score`` from every tree, its own first ``k`` of each window.

    ``wave``: ``row, dim, label, v`` of some anchors, and arrays ``low, high`` of their windows. It is broadcast.
    """
    held = spark.sparkContext.broadcast(wave.to_dict("list"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = held.value
        for b in batches:
            for dim, blob in zip(b["dim"], b["tree"], strict=True):
                tree: CoverTree = pickle.loads(blob)
                out = []
                for j in range(len(a["row"])):
                    if a["dim"][j] != dim:
                        continue
                    q = np.asarray(a["v"][j], dtype=np.float64)
                    low, high = np.asarray(a["low"][j], dtype=float), np.asarray(a["high"][j], dtype=float)
                    for w, p in enumerate(tree.search(q, a["row"][j], a["label"][j], same, low, high, k)):
                        if len(p):
                            out.append(pd.DataFrame({"anchor": a["row"][j], "window": w, "id": tree.ids[p], "row": tree.rows[p], "score": (tree.x[p] @ q).astype(np.int64)}))
                if out:
                    yield pd.concat(out, ignore_index=True)

    return grown.repartitionByRange(tasks, "dim", "shard").mapInPandas(run, "anchor long, window int, id long, row long, score long")


def first_of(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each key with ``rank`` from 1; Spark cuts groups before it shuffles them."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: str, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: float = 256.0, n_pos: int = 5, n_neg: int = 10, low: int = 30, high: int = 90, per_shard: int = 8192, wave_bytes: int = 16 << 20) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score, anchor_row, positive_row``.

    ``anchors`` is a condition on ``id`` in SQL. Scores are inner products of components ``floor(scale * x)``. An
    anchor's positives are its first ``n_pos`` other rows of its label, a positive's negatives the first ``n_neg``
    rows of other labels with ``low * positive_score <= 100 * score <= high * positive_score``; higher scores go
    first, ties by smaller id, then by the row's number. An anchor without positives, and a positive without
    negatives, have no rows.

    Rows with a null id, label or vector, or a component that is null, NaN or infinite, take no part. A vector meets
    only those of its own length. Rows that repeat an id are rows of their own, anchors too. An empty table gives an
    empty result. Other columns are not looked at. Scaled squared norms must be below 2^53, otherwise it is an error,
    since scores would not be exact.

    Every shard of about ``per_shard`` candidates has one tree, whatever their labels. Anchors go to all trees in waves
    of about ``wave_bytes`` bytes, which is what a broadcast holds; a tree gives its own first rows of a window.
    """
    spark = rows.sparkSession
    v = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(scale) * x.cast("double")))
    raw = F.col(vector_col)
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.col("fine")
    fine = F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    given = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.when(fine, v).alias("v"), fine.alias("fine"))
    given = numbered(given.where(sound).select("id", "label", F.size("v").alias("dim"), F.transform("v", lambda x: x.cast("double")).alias("v")))
    grown = trees(given, per_shard)
    tasks = max(1, grown.count())
    marked = given.where(anchors)
    held = marked.agg(F.coalesce(F.sum(8 * F.col("dim") + 256), F.lit(0))).first()[0]
    waves = max(1, -(-held // wave_bytes))
    marked = marked.withColumn("wave", F.pmod(F.xxhash64(ROW, F.lit("wave")), F.lit(waves)))

    def over(keys: DataFrame, same: bool, k: int) -> DataFrame | None:
        out = None
        for w in range(waves):
            part = keys.where(F.col("wave") == w).drop("wave").toPandas().rename(columns={ROW: "row"})
            if len(part):
                found = settle(first_of(searched(spark, grown, part, same, k, tasks), ["anchor", "window"], k))
                out = found if out is None else out.unionByName(found)
        return out

    whole = marked.withColumn("low", F.array(F.lit(float("-inf")))).withColumn("high", F.array(F.lit(float("inf"))))
    schema = "anchor long, window int, id long, row long, score long, rank int"
    positives = over(whole.select(ROW, "dim", "label", "v", "low", "high", "wave"), True, n_pos)
    if positives is None:
        positives = spark.createDataFrame([], schema)
    positives = positives.select(F.col("anchor"), F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("row").alias("positive_row"), F.col("score").alias("positive_score"))
    # Windows in whole scores, in the order of the positives.
    whole_part = lambda x: ((x - F.pmod(x, F.lit(100))) / 100).cast("long")
    window = F.struct("place", (-whole_part(-F.col("positive_score") * low)).alias("low"), whole_part(F.col("positive_score") * high).alias("high"))
    bounds = positives.groupBy("anchor").agg(F.array_sort(F.collect_list(window)).alias("b"))
    bounds = bounds.select(F.col("anchor").alias(ROW), F.transform("b.low", lambda x: x.cast("double")).alias("low"), F.transform("b.high", lambda x: x.cast("double")).alias("high"))
    negatives = over(marked.select(ROW, "dim", "label", "v", "wave").join(bounds, ROW).select(ROW, "dim", "label", "v", "low", "high", "wave"), False, n_neg)
    if negatives is None:
        negatives = spark.createDataFrame([], schema)
    out = negatives.withColumn("place", F.col("window") + 1).join(positives, ["anchor", "place"]).join(marked.select(F.col(ROW).alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"), F.col("anchor").alias("anchor_row"), "positive_row")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = hard_negatives(e.select("vec_id", label.alias("label"), "embedding"), "id % 100 = 0")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256*x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 100*score BETWEEN 30*positive_score AND 90*positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 10
"""
