"""Removal of long repeated byte strings by suffix arrays of shards that hold all places of a string."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, filter_keys, settle, text_of
from .suffixes import repeated_starts

#: Bytes of the strings that anchor a window, and of a stretch of text that is anchored at a time.
GRAM = 48
STRETCH = 1 << 20
#: Starts of a finer chunk, for anchors that very many texts share.
FINE = 64


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, and a number for each byte."""
    base = 0x9E3779B97F4A7C15
    up = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(STRETCH, base, np.uint64)]))
    down = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(STRETCH, pow(base, -1, 1 << 64), np.uint64)]))
    return up, down, np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64)


def anchors(data: np.ndarray, window: int) -> np.ndarray:
    """Runs of window starts with one anchor, a column each: hash of the anchor, its place, first start, number of starts.

    The anchor of a window is its gram with the least hash, the leftmost of several: windows with equal
    bytes have equal anchors at equal places. Every window start is in one run.
    """
    up, down, number = powers()
    span, found = window - GRAM + 1, []
    for a in range(0, max(len(data) - window + 1, 0), STRETCH - window + 1):
        s = data[a : a + STRETCH]
        n = len(s)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(number[s] * up[:n])])
        g = (sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1]
        g ^= g >> np.uint64(29)
        g *= np.uint64(0xBF58476D1CE4E5B9)
        g ^= g >> np.uint64(32)
        key = g & ~np.uint64(STRETCH - 1) | np.arange(len(g), dtype=np.uint64)
        padded = np.concatenate([key, np.full(-len(key) % span, np.iinfo(np.uint64).max)]).reshape(-1, span)
        left = np.minimum.accumulate(padded, axis=1).ravel()
        right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        best = np.minimum(right[: n - window + 1], left[span - 1 : n - window + span]) & np.uint64(STRETCH - 1)
        best = best.astype(np.int64)
        begin = np.concatenate([[0], np.flatnonzero(np.diff(best)) + 1])
        size = np.diff(np.concatenate([begin, [len(best)]]))
        found.append(np.stack([g[best[begin]].view(np.int64), best[begin] + a, begin + a, size]))
    return np.concatenate(found, axis=1) if found else np.empty((4, 0), np.int64)


def digest(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=16).digest()


def merged(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Unions of intervals, those that touch made one."""
    order = np.argsort(begin, kind="stable")
    begin, upto = begin[order], np.maximum.accumulate(end[order])
    cut = np.flatnonzero(begin[1:] > upto[:-1]) + 1
    return list(zip(begin[np.concatenate([[0], cut])].tolist(), upto[np.concatenate([cut - 1, [len(upto) - 1]])].tolist(), strict=True)) if len(begin) else []


def chunk_rows(h: bytes, data: bytes, runs: list, window: int) -> Iterator[tuple]:
    """``(v, h, first, n, chunk)``: the text of each run of starts; of common anchors in finer runs.

    A finer run also goes by the bytes that all its windows share, at its place beside the anchor.
    """
    for v, pos, first, n, fine in runs:
        if not fine:
            yield v, h, first, n, data[first : first + n + window - 1]
            continue
        a, end = first, first + n
        while a < end:
            block = (pos - a) // FINE  # starts at pos - a in [64 b, 64 b + 63]
            z = min(end, pos - block * FINE + 1)
            core = data[pos - block * FINE : pos - block * FINE - FINE + 1 + window]
            yield int.from_bytes(digest(v.to_bytes(8, "little", signed=True), block.to_bytes(4, "little"), core)[:8], "little", signed=True), h, a, z - a, data[a : z + window - 1]
            a = z


def edges(hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of true values, as first and one past the last."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def counted(kinds: DataFrame, window: int) -> DataFrame:
    """``cd, a, z``: runs of starts in the chunks ``cd, chunk`` at which a window begins that begins twice in all of them.

    Digests of windows are counted by Spark, so any number of chunks may share an anchor.
    """

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 256):
                part = b.iloc[k : k + 256]
                out = [(cd, at, digest(c[at : at + window])) for cd, c in zip(part["cd"], part["chunk"], strict=True) for at in range(len(c) - window + 1)]
                yield pd.DataFrame(out, columns=["cd", "at", "w"])

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for cd, at in zip(b["cd"], b["at"], strict=True):
                hit = np.zeros(int(max(at)) + 1, dtype=bool)
                hit[np.asarray(at)] = True
                out += [(cd, a, z) for a, z in edges(hit)]
            yield pd.DataFrame(out, columns=["cd", "a", "z"])

    # Tasks that hold equal chunks have each sent one on.
    begun = settle(kinds.select("cd", "chunk").dropDuplicates(["cd"]).mapInPandas(windows, "cd binary, at long, w binary"))
    twice = settle(begun.groupBy("w").agg(F.count("*").alias("group_size")).where("group_size > 1"))
    hits = attach(begun, twice, "w", begun.count()).where("group_size is not null")
    return hits.groupBy("cd").agg(F.collect_list("at").alias("at")).mapInPandas(runs, "cd binary, a long, z long")


def repeated_spans(texts: DataFrame, window: int, common: int, batch: int) -> DataFrame:
    """``h, begin, end``: stretches of the distinct texts ``h, text`` covered by windows that begin twice.

    All windows with equal bytes have one anchor, so the places of every repeated string meet in the
    shard of its anchor's hash. Equal chunks are counted, one of them goes on; chunks that share an anchor
    but are not equal go into suffix arrays of about ``batch`` bytes. An anchor with more than that in
    distinct chunks goes into none: digests of its windows are counted, a row for each start.
    """

    def anchored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [anchors(np.frombuffer(t.encode(), np.uint8), window) for t in b["text"]]
            rows = np.concatenate(found, axis=1) if found else np.empty((4, 0), np.int64)
            h = np.repeat(b["h"].to_numpy(), [x.shape[1] for x in found])
            yield pd.DataFrame(dict(zip(("v", "pos", "first", "n"), rows, strict=True)) | {"h": h})

    places = settle(texts.mapInPandas(anchored, "v long, pos long, first long, n long, h binary"))
    shared = settle(places.groupBy("v").agg(F.count("*").alias("places")).where("places > 1"))
    runs = attach(places, shared, "v", places.count(), weight="places").where("places > 1")
    runs = runs.groupBy("h").agg(F.collect_list(F.struct("v", "pos", "first", "n", (F.col("places") > common).alias("fine"))).alias("runs"))
    runs = settle(runs)
    near = filter_keys(texts, runs.select("h"), ["h"], "left_semi").join(runs, "h")

    def chunked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: set[bytes] = set()
            for h, text, runs in zip(b["h"], b["text"], b["runs"], strict=True):
                rows = []
                plain = [(int(r["v"]), int(r["pos"]), int(r["first"]), int(r["n"]), bool(r["fine"])) for r in runs]
                for v, key, first, n, chunk in chunk_rows(bytes(h), text.encode(), plain, window):
                    cd = digest(v.to_bytes(8, "little", signed=True), chunk)
                    rows.append((v, cd, key, first, n, None if cd in seen else chunk))
                    seen.add(cd)
                yield pd.DataFrame(rows, columns=["v", "cd", "h", "first", "n", "chunk"])

    chunks = settle(near.mapInPandas(chunked, "v long, cd binary, h binary, first long, n long, chunk binary"))
    counts = settle(chunks.groupBy("cd").agg(F.count("*").alias("group_size"), F.first("n").alias("n"), F.first("v").alias("v")))
    # Chunks move once, by anchor; the lengths that set the number of shards come from the counts.
    shards = counts.agg(F.coalesce(F.sum(F.col("n") + window - 1), F.lit(0))).first()[0] // batch + 1
    large = settle(counts.groupBy("v").agg(F.sum(F.col("n") + window - 1).alias("size")).where(F.col("size") > batch).select("v"))
    kinds = chunks.where("chunk is not null").select("v", "cd", "chunk")
    hot, kinds = filter_keys(kinds, large, ["v"], "left_semi"), filter_keys(kinds, large, ["v"], "left_anti")
    kinds = kinds.repartition(shards, "v").sortWithinPartitions("v", "cd")

    def sorted_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, bytes, bytes]] = []  # of whole anchors with several kinds of chunks
        anchor: list[tuple[int, bytes, bytes]] = []
        size = 0

        def flush(group: list) -> pd.DataFrame:
            hits = repeated_starts([np.frombuffer(c, np.uint8) for _, _, c in group], window)
            out = []
            for (_, cd, _), hit in zip(group, hits, strict=True):
                out += [(cd, a, z) for a, z in edges(hit)]
            return pd.DataFrame(out, columns=["cd", "a", "z"]).astype({"a": "int64", "z": "int64"})

        def rows() -> Iterator[tuple[int | None, bytes, bytes]]:
            for b in batches:
                yield from zip(b["v"].tolist(), b["cd"], b["chunk"], strict=True)
            yield None, b"", b""

        for row in rows():
            if anchor and row[0] == anchor[-1][0]:
                if row[1] != anchor[-1][1]:
                    anchor.append(row)
                continue
            if len(anchor) > 1:  # equal chunks alone are settled by their count
                held += anchor
                size += sum(len(c) for _, _, c in anchor)
            if size >= batch:
                yield flush(held)
                held, size = [], 0
            anchor = [row]
        if held:
            yield flush(held)

    found = kinds.mapInPandas(sorted_shards, "cd binary, a long, z long")
    if not large.isEmpty():
        found = found.unionByName(counted(hot, window))
    apart = settle(found.groupBy("cd").agg(F.collect_list(F.struct("a", "z")).alias("spans")))
    state = settle(counts.join(apart, "cd", "left").where("group_size > 1 or spans is not null").select("cd", "group_size", "spans"))
    hits = attach(chunks.select("cd", "h", "first", "n"), state, "cd", chunks.count()).where("group_size is not null")
    every = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n").alias("z")))
    spans = hits.select("h", "first", F.explode(F.when(F.col("group_size") > 1, every).otherwise(F.col("spans"))).alias("x"))
    return spans.select("h", (F.col("first") + F.col("x.a")).alias("begin"), (F.col("first") + F.col("x.z") + window - 1).alias("end"))


def substring_dedup(docs: DataFrame, window: int = 400, id_col: str = "doc_id", text_col: str = "text", common: int = 512, batch: int = 1 << 21) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    A byte of a text (UTF-8; null is empty) is removed if any ``window``-byte string over it also starts
    elsewhere in any text, its own included. Texts shorter than ``window`` lose nothing. Texts that occur
    twice lose every byte and stand in the search once. Repeated rows and ids get rows of their own; an
    empty table gives none. Other columns are not looked at.
    """
    given = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("h", F.unhex(F.md5("text")))
    rows = settle(given.select("doc_id", "h", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("sha")))
    groups = settle(rows.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("group_size")))
    copies = settle(groups.where("group_size > 1"))
    n = rows.count()
    spared = settle(attach(rows.select("doc_id", "h"), copies, "h", n).where("first_id <> doc_id").select("h", "doc_id").distinct())
    texts = filter_keys(given, spared, ["h", "doc_id"], "left_anti").where(F.octet_length("text") >= window).select("h", "text")
    spans = settle(repeated_spans(texts, window, common, batch).groupBy("h").agg(F.collect_list(F.struct("begin", "end")).alias("spans")))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for h, text, spans in zip(b["h"], b["text"], b["spans"], strict=True):
                data = text.encode()
                gone = merged(np.array([x["begin"] for x in spans]), np.array([x["end"] for x in spans]))
                kept = hashlib.sha256()
                at = 0
                for a, z in gone:
                    kept.update(data[at:a])
                    at = z
                kept.update(data[at:])
                out.append((h, sum(z - a for a, z in gone), len(gone), kept.digest()))
            yield pd.DataFrame(out, columns=["h", "n_removed", "n_spans", "kept"])

    hit = filter_keys(texts, spans.select("h"), ["h"], "left_semi").join(spans, "h")
    hit = settle(hit.mapInPandas(cut, "h binary, n_removed long, n_spans long, kept binary").dropDuplicates(["h"]))
    state = settle(groups.join(hit, "h", "left").select("h", "group_size", "n_removed", "n_spans", "kept"))
    out = attach(rows, state, "h", n)
    whole = (F.col("group_size") > 1) & (F.col("n_bytes") >= window)
    kept = F.when(whole, F.unhex(F.sha2(F.lit(""), 256))).otherwise(F.coalesce("kept", "sha"))
    return out.select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"), F.lower(F.hex(kept)).alias("kept_sha256"),
    )


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
