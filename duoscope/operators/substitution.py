"""Epistasis maps of sequences: every distinct genotype is embedded once, vectors meet again at the pairs of places."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .embedding import attempted
from .geometry import ROLES, complex_coords, pair_metrics
from .lineage import fixed
from .maps import BASES

#: First places of a row of work, so that a sequence's doubles are spread over tasks.
FIRST = 4
#: Places up to which a row of work is a whole sequence, so that none of its vectors moves.
WHOLE = 8
#: Sequences whose texts are made at a time, and doubles that are sent on at a time.
TEXTS, SENT = 64, 1 << 10


def places(df: DataFrame, seq: str, positions: list[int] | None, start: int, end: int | None, step: int) -> DataFrame:
    """Adds ``places``: the chosen positions that lie in the sequence, ascending, from 0."""
    n = F.length(seq)
    if positions is not None:
        chosen = F.array(*[F.lit(p) for p in sorted(set(positions))]).cast("array<int>")
    else:
        last = F.least(n, F.lit(end)) if end is not None else n
        chosen = F.when(last > start, F.sequence(F.lit(start), last - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return df.withColumn("places", F.filter(chosen, lambda p: (p >= 0) & (p < n)))


def genotype_vectors(bases: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], double: bool, batch: int = 64) -> DataFrame:
    """``sid, pos1, alt1, pos2, alt2, embedding, error`` of a sequence's genotypes.

    ``bases``: sid, seq, places. Singles and the sequence itself (all nulls), or, if ``double``, the doubles. Genotypes
    are made where they are embedded: a row of work is a sequence and a few of its places, ``batch`` mutants are held
    at a time.
    """
    work = bases.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.size("places") - 1) / FIRST).cast("int")))) if double else bases.withColumn("block", F.lit(0))

    def spelled(seq: str, at: list[int], block: int) -> Iterator[tuple]:
        other = lambda p: [b for b in BASES if b != seq[p]]
        if not double:
            yield None, None, None, None, seq
            for p in at:
                for a in other(p):
                    yield p, a, None, None, seq[:p] + a + seq[p + 1 :]
            return
        for k in range(block * FIRST, min((block + 1) * FIRST, len(at))):
            for a in other(at[k]):
                one = seq[: at[k]] + a + seq[at[k] + 1 :]
                for q in at[k + 1 :]:
                    for b in other(q):
                        yield at[k], a, q, b, one[:q] + b + one[q + 1 :]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()

        def done(sid: bytes, held: list[tuple]) -> pd.DataFrame:
            vectors, errors = attempted(model, [h[4] for h in held])
            out = pd.DataFrame([h[:4] for h in held], columns=["pos1", "alt1", "pos2", "alt2"]).astype({"pos1": "Int32", "pos2": "Int32"})
            return out.assign(sid=sid, embedding=vectors, error=errors)[["sid", "pos1", "alt1", "pos2", "alt2", "embedding", "error"]]

        for b in batches:
            for sid, seq, at, block in zip(b["sid"], b["seq"], b["places"], b["block"], strict=True):
                held: list[tuple] = []
                for g in spelled(seq, [int(p) for p in at], block):
                    held.append(g)
                    if len(held) == batch:
                        yield done(sid, held)
                        held = []
                if held:
                    yield done(sid, held)

    spread = work.select("sid", "seq", "places", "block").repartition("sid", "block")
    return spread.mapInPandas(run, "sid binary, pos1 int, alt1 string, pos2 int, alt2 string, embedding array<float>, error string")


def quadruples(bases: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 64) -> DataFrame:
    """``sid, pos1, alt1, pos2, alt2, WT, M1, M2, M12`` of all doubles of sequences of few places.

    A sequence's genotypes are embedded where its doubles are sent on, each once, ``batch`` at a time; a batch goes on
    from one sequence to the next. A genotype that the model fails on is null.
    """
    kinds = {"sid": pa.binary(), "pos1": pa.int32(), "alt1": pa.string(), "pos2": pa.int32(), "alt2": pa.string()}

    def texts(seq: str, alts: list[tuple], two: list[tuple]) -> Iterator[str]:
        yield seq
        for p, a in alts:
            yield seq[:p] + a + seq[p + 1 :]
        for i, j in two:
            (p, a), (q, b) = alts[i], alts[j]
            yield seq[:p] + a + seq[p + 1 : q] + b + seq[q + 1 :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()

        def embedded(every: Iterator[str]) -> Iterator[np.ndarray | None]:
            for part in iter(lambda: list(islice(every, batch)), []):
                yield from attempted(model, part)[0]

        def sent(rows: list[tuple], found: list) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            vectors = pa.array(found, pa.list_(pa.float32()))
            made = [pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=False)]
            return pa.RecordBatch.from_arrays([*made, *[vectors.take(pa.array(c, pa.int32())) for c in cols[len(kinds) :]]], [*kinds, *ROLES])

        for b in batches:
            for k in range(0, len(b), TEXTS):
                work = []
                for r in b.slice(k, TEXTS).to_pylist():
                    alts = [(p, a) for p in r["places"] for a in BASES if a != r["seq"][p]]
                    work.append((r["sid"], r["seq"], alts, [(i, j) for i, j in combinations(range(len(alts)), 2) if alts[i][0] < alts[j][0]]))
                vectors = embedded(t for _, *w in work for t in texts(*w))
                rows, found = [], []
                for sid, _, alts, two in work:
                    at = len(found)
                    found.extend(islice(vectors, 1 + len(alts) + len(two)))
                    rows.extend((sid, *alts[i], *alts[j], at, at + 1 + i, at + 1 + j, at + 1 + len(alts) + n) for n, (i, j) in enumerate(two))
                    if len(rows) >= SENT:
                        yield sent(rows, found)
                        rows, found = [], []
                if rows:
                    yield sent(rows, found)

    # A count that Spark does not merge, as texts are small beside the work on them.
    spread = bases.select("sid", "seq", "places").repartition(int(bases.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sid")
    return spread.mapInArrow(run, "sid binary, pos1 int, alt1 string, pos2 int, alt2 string, " + ", ".join(f"{r} array<float>" for r in ROLES))


def joined_quadruples(bases: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 64) -> DataFrame:
    """The same of sequences of many places, whose doubles are spread over tasks: single vectors meet them by joins."""
    bases = fixed(bases)
    small = fixed(genotype_vectors(bases, load, False, batch).select("sid", "pos1", "alt1", "embedding"))
    wild = small.where("pos1 is null").select("sid", F.col("embedding").alias("WT"))
    one = small.where("pos1 is not null").join(wild, "sid")
    first = one.select("sid", "pos1", "alt1", "WT", F.col("embedding").alias("M1"))
    second = one.select("sid", F.col("pos1").alias("pos2"), F.col("alt1").alias("alt2"), F.col("embedding").alias("M2"))
    both = genotype_vectors(bases, load, True, batch).select("sid", "pos1", "alt1", "pos2", "alt2", F.col("embedding").alias("M12"))
    return both.join(first, ["sid", "pos1", "alt1"]).join(second, ["sid", "pos2", "alt2"]).select("sid", "pos1", "alt1", "pos2", "alt2", *ROLES)


def sequence_scores(df: DataFrame, keys: list[str], seq: str, load: Callable[[], Callable[[list[str]], np.ndarray]], metric: str, positions: list[int] | None, start: int, end: int | None, step: int, batch: int, whole: int) -> tuple[DataFrame, DataFrame]:
    """``keys, sid`` and ``sid, pos_i, pos_j, alt_i, alt_j, score``: ``sid`` is the SHA-256 of a sequence, so texts move once."""
    rows = places(df.where(F.length(seq) > 0), seq, positions, start, end, step).where(F.size("places") >= 2)
    rows = rows.withColumn("sid", F.unhex(F.sha2(F.col(seq), 256)))
    distinct = rows.groupBy("sid").agg(F.first(F.struct(F.col(seq).alias("seq"), "places")).alias("_s")).select("sid", "_s.seq", "_s.places")
    few = positions is not None and len(set(positions)) <= whole
    pairs = quadruples(distinct if few else distinct.where(F.size("places") <= whole), load, batch)
    pairs = pairs if few else pairs.unionByName(joined_quadruples(distinct.where(F.size("places") > whole), load, batch))
    at = ["sid", "pos1", "pos2", "alt1", "alt2"]
    scored = complex_coords(pairs, at) if metric == "rho" else pair_metrics(pairs, at)
    if metric not in scored.columns:
        raise ValueError(f"unknown metric {metric!r}")
    scored = scored.select("sid", F.col("pos1").alias("pos_i"), F.col("pos2").alias("pos_j"), F.col("alt1").alias("alt_i"), F.col("alt2").alias("alt_j"), F.col(metric).alias("score"))
    return rows.select(*keys, "sid"), scored


def epistasis_scores(df: DataFrame, keys: list[str], seq: str, load: Callable[[], Callable[[list[str]], np.ndarray]], metric: str = "epi_R_singles", positions: list[int] | None = None, start: int = 0, end: int | None = None, step: int = 1, batch: int = 64, whole: int = WHOLE) -> DataFrame:
    """``keys, pos_i, pos_j, alt_i, alt_j, score``: a pair metric of every two substitutions at the chosen places, i < j.

    Equal sequences are embedded once, whatever keys they have, and a single mutant once for all its doubles. ``metric``
    is one of the pair metrics or ``rho``, the length in the complex plane. At a place that is none of A, C, G, T all
    four are substitutions. Places outside a sequence are left out; a sequence of fewer than two, a null or an empty
    one has no rows. A genotype that the model fails on leaves its scores null. Sequences of up to ``whole`` places are
    a row of work each; doubles of others are spread over tasks.
    """
    owners, scored = sequence_scores(df, keys, seq, load, metric, positions, start, end, step, batch, whole)
    return owners.join(scored, "sid").select(*keys, "pos_i", "pos_j", "alt_i", "alt_j", "score")


def epistasis_maps(df: DataFrame, keys: list[str], seq: str, load: Callable[[], Callable[[list[str]], np.ndarray]], metric: str = "epi_R_singles", positions: list[int] | None = None, start: int = 0, end: int | None = None, step: int = 1, batch: int = 64, whole: int = WHOLE, mean: bool = False) -> DataFrame:
    """``epistasis_map`` of ``epistasis_scores``, made once a distinct sequence before its keys meet it."""
    owners, scored = sequence_scores(df, keys, seq, load, metric, positions, start, end, step, batch, whole)
    return owners.join(epistasis_map(scored, ["sid"], mean), "sid").select(*keys, "pos_i", "pos_j", "score", "n")


def epistasis_map(scores: DataFrame, keys: list[str], mean: bool = False) -> DataFrame:
    """``keys, pos_i, pos_j, score, n``: the largest (or mean) score of a pair of places, both ways, and how many were had."""
    m = scores.groupBy(*keys, "pos_i", "pos_j").agg((F.avg if mean else F.max)("score").alias("score"), F.count("score").alias("n"))
    # A row that is doubled, not a second reading of the scores.
    ways = m.withColumn("_w", F.explode(F.array(F.struct("pos_i", "pos_j"), F.struct(F.col("pos_j").alias("pos_i"), F.col("pos_i").alias("pos_j")))))
    return ways.select(*keys, "_w.pos_i", "_w.pos_j", "score", "n")


def composition_model() -> Callable[[list[str]], np.ndarray]:
    """A stand-in for a sequence model whose vectors are not additive in substitutions: products of base counts."""

    def model(texts: list[str]) -> np.ndarray:
        # A line each, so that none is empty.
        parts = [t.encode() + b"\n" for t in texts]
        letters = np.frombuffer(b"".join(parts), np.uint8)
        starts = np.cumsum([0, *[len(p) for p in parts]])[:-1]
        n = np.array([np.add.reduceat(letters == ord(b), starts, dtype=np.int64) for b in BASES], dtype=float).T
        whole = np.maximum(n.sum(axis=1), 1)
        a, c, g, t = n.T
        return np.column_stack([a, c, g * g / whole, a * t / whole])

    return model
