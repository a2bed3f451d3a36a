"""User models over tables, and the embedding store they fill."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a model's answer that are sent on at a time.
SLICE = 1 << 16
#: Rows of short answers that are gathered before they are sent on.
HELD = 1 << 13
STORE = "id string, role string, dim int, embedding array<float>"


def attempted(model: Callable[[list[str]], np.ndarray], texts: list[str]) -> tuple[list, list]:
    """Vectors and errors of a batch; one that fails is done text by text, so a bad one does not lose the others."""
    try:
        return [np.asarray(v, np.float32) for v in model(texts)], [None] * len(texts)
    except Exception:
        vectors, errors = [], []
        for t in texts:
            try:
                vectors.append(np.asarray(model([t])[0], np.float32))
                errors.append(None)
            except Exception as e:
                vectors.append(None)
                errors.append(str(e))
        return vectors, errors


def embed(df: DataFrame, seq: str, load: Callable[[], Callable[[list[str]], np.ndarray]], columns: list[str], batch: int = 256) -> DataFrame:
    """``columns`` and ``embedding, error``. ``load`` makes the model once per task.

    A batch that fails is done row by row; a row that fails has a null embedding and the error's text.
    """
    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in columns) + ", embedding array<float>, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for b in batches:
            for k in range(0, len(b), batch):
                # Texts are made of a few rows at a time: what Spark sends at once is held as bytes alone.
                part = b.slice(k, batch)
                vectors, errors = attempted(model, part[seq].to_pylist())
                made = [pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())]
                yield pa.RecordBatch.from_arrays([*[part[c] for c in columns], *made], [*columns, "embedding", "error"])

    return df.select(*dict.fromkeys([*columns, seq])).mapInArrow(run, schema)


def kmer_model(k: int = 3, dim: int = 16) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for a sequence model: signed k-mer counts."""
    weights = np.random.default_rng(k).normal(size=(4**k, dim))
    code = {b: i for i, b in enumerate("ACGT")}

    def model(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for r, t in enumerate(texts):
            x = [code[c] for c in t]
            for i in range(len(x) - k + 1):
                out[r] += weights[sum(c * 4**p for p, c in enumerate(x[i : i + k]))]
        return out

    return model


def long_results(df: DataFrame, load: Callable[[], Callable[[pd.Series], pd.DataFrame]], columns: list[str], made: str) -> DataFrame:
    """``columns`` and the rows ``made`` (names and types) that a user model gives for each row of ``df``.

    ``load`` makes the model once per task; the model takes a row and returns a frame of any number of rows.
    """
    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in columns) + ", " + made

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            # A row's answer goes on as it is, cut where it is long: no batch's answers are held together.
            for _, row in b.iterrows():
                out = model(row).assign(**{c: row[c] for c in columns})
                out = out[[*columns, *[c for c in out.columns if c not in columns]]]
                for lo in range(0, len(out), SLICE):
                    yield out.iloc[lo : lo + SLICE]

    return df.mapInPandas(run, schema)


def long_arrays(df: DataFrame, load: Callable[[], Callable[[dict], dict[str, np.ndarray]]], columns: list[str], made: str) -> DataFrame:
    """As ``long_results``, of a model that takes a row as a dict and returns arrays of one length by name.

    Answers of several rows go on as one frame of some ``HELD`` rows, so a short one costs no frame of its own.
    """
    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in columns) + ", " + made

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()

        def joined(b: pd.DataFrame, at: list[int], parts: list[dict[str, np.ndarray]]) -> Iterator[pd.DataFrame]:
            n = [len(next(iter(p.values()))) for p in parts]
            own = {c: b[c].iloc[np.repeat(at, n)].reset_index(drop=True) for c in columns}
            out = pd.DataFrame(own | {c: np.concatenate([p[c] for p in parts]) for c in parts[0]})
            for lo in range(0, len(out), SLICE):
                yield out.iloc[lo : lo + SLICE]

        for b in batches:
            at, parts, held = [], [], 0
            for k, row in enumerate(b.to_dict("records")):
                answer = model(row)
                n = len(next(iter(answer.values())))
                if not n:
                    continue
                at.append(k)
                parts.append(answer)
                held += n
                if held >= HELD:
                    yield from joined(b, at, parts)
                    at, parts, held = [], [], 0
            if parts:
                yield from joined(b, at, parts)

    return df.mapInPandas(run, schema)


def nucleotides(df: DataFrame, seq: str, load: Callable[[], Callable[[str], np.ndarray]], columns: list[str], slack: float = 1e-6) -> DataFrame:
    """``columns, pos, nuc, p``: a user model's probabilities of A, C, G, T at every place of a sequence.

    A model's answer is a matrix of a row per place and four columns; rows that do not sum to 1 within ``slack`` are
    an error.
    """

    def rows() -> Callable[[dict], dict[str, np.ndarray]]:
        model = load()
        bases = np.array(list("ACGT"), dtype=object)

        def one(row: dict) -> dict[str, np.ndarray]:
            p = np.asarray(model(row[seq]), dtype=float).reshape(-1, 4)
            if len(p) and np.abs(p.sum(axis=1) - 1).max() > slack:
                raise ValueError("probabilities of a place must sum to one")
            return {"pos": np.repeat(np.arange(len(p)), 4), "nuc": np.tile(bases, len(p)), "p": p.ravel()}

        return one

    return long_arrays(df, rows, columns, "pos int, nuc string, p double")


def tracks(df: DataFrame, seq: str, load: Callable[[], Callable[[str], tuple[np.ndarray, np.ndarray]]], columns: list[str]) -> DataFrame:
    """``columns, track, pos, value`` of a user model that returns ``(tracks, positions)``: a row per track, a column per position."""

    def rows() -> Callable[[dict], dict[str, np.ndarray]]:
        model = load()

        def one(row: dict) -> dict[str, np.ndarray]:
            values, at = model(row[seq])
            values = np.asarray(values, dtype=float).reshape(-1, len(at))
            return {"track": np.repeat(np.arange(len(values)), len(at)), "pos": np.tile(at, len(values)), "value": values.ravel()}

        return one

    return long_arrays(df, rows, columns, "track int, pos int, value double")


def window_predictor(width: int = 2) -> Callable[[str], np.ndarray]:
    """A stand-in predictor: shares of the bases within ``width`` places, one added to each count."""

    def model(s: str) -> np.ndarray:
        hot = np.array([[c == b for b in "ACGT"] for c in s], dtype=float).reshape(-1, 4)
        near = np.array([hot[max(0, k - width) : k + width + 1].sum(axis=0) for k in range(len(s))]).reshape(-1, 4) + 1
        return near / near.sum(axis=1, keepdims=True)

    return model


def content_tracks(bin_size: int = 8) -> Callable[[str], tuple[np.ndarray, np.ndarray]]:
    """A stand-in for a track model: shares of G or C, and of A, by bins of a sequence."""

    def model(s: str) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(0, len(s), bin_size)
        cut = [s[k : k + bin_size] for k in at]
        return np.array([[(c.count("G") + c.count("C")) / len(c) for c in cut], [c.count("A") / len(c) for c in cut]]), at

    return model


def custom_distance(measure: Callable[[np.ndarray, np.ndarray], float]) -> Callable[[Column, Column], Column]:
    """A user's distance of two vectors as a function of two columns, by Arrow batches; null where a vector is."""

    @F.pandas_udf("double")
    def apart(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else float(measure(np.asarray(x), np.asarray(y))) for x, y in zip(a, b, strict=True)], dtype="float64")

    return apart


def latest(store: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The last write of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col(version).desc())
    return store.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def missing(wanted: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Distinct wanted keys that the store lacks."""
    return wanted.select(key).distinct().join(store.select(key).distinct(), key, "left_anti")


def reusable(wanted: DataFrame, stores: list[DataFrame], roles: int = 4) -> DataFrame:
    """Vectors of wanted ``id``s found in other stores (``id, role, embedding``), the first store with all roles wins.

    An exact id goes before one that is equal but for genes and strands.
    """
    from ..functions.identifiers import gene_free

    ids = wanted.select("id").distinct().withColumn("free", gene_free(F.col("id")))
    found = None
    for k, s in enumerate(stores):
        exact = ids.select("id").join(s, "id").select("id", "role", "embedding", F.lit(2 * k).alias("priority"))
        free = ids.join(s.withColumn("free", gene_free(F.col("id"))).drop("id"), "free").select("id", "role", "embedding", F.lit(2 * k + 1).alias("priority"))
        both = exact.unionByName(free)
        found = both if found is None else found.unionByName(both)
    whole = found.groupBy("id", "priority").agg(F.countDistinct("role").alias("n")).where(F.col("n") == roles).groupBy("id").agg(F.min("priority").alias("priority"))
    # Several rows of one priority and role: the least vector, so that reruns agree.
    return found.join(whole, ["id", "priority"]).groupBy("id", "role").agg(F.min("embedding").alias("embedding"))


def embed_into(spark: SparkSession, path: str, wanted: DataFrame, seq: str, load: Callable) -> None:
    """Embed the ids that the store at ``path`` lacks and append them; safe to run again after a failure."""
    spark.createDataFrame([], STORE).coalesce(1).write.mode("append").parquet(path)
    todo = wanted.join(missing(wanted, spark.read.schema(STORE).parquet(path), "id"), "id", "left_semi")
    out = embed(todo, seq, load, ["id", "role"]).where("error is null")
    out.select("id", "role", F.size("embedding").alias("dim"), "embedding").write.mode("append").parquet(path)
