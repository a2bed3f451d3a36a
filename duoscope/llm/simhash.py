"""SimHash near-duplicates found through Golay-code keys of fingerprint segments."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, settle, text_of
from .components import connected_components

#: Generator polynomial of the binary Golay code of length 23 (fixed value).
POLYNOMIAL = 0b101011100011
#: Lowest bit and width of the three segments of a fingerprint.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Fingerprints differ in at most this many bits; two of three segments then differ in two at most.
ERRORS = 4


def remainder(w: np.ndarray) -> np.ndarray:
    w = w.astype(np.uint32)
    for k in range(22, 10, -1):
        w = np.where(w >> k & 1, w ^ np.uint32(POLYNOMIAL << (k - 11)), w)
    return w


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Parity of each message, and the message of the error of up to 3 bits that leaves each syndrome."""
    parity = remainder(np.arange(4096, dtype=np.uint32) << np.uint32(11))
    bits = [0, *(1 << k for k in range(23))]
    errors = np.array(sorted({a | b | c for a in bits for b in bits for c in bits}), dtype=np.uint32)
    fix = np.zeros(2048, dtype=np.uint32)
    fix[remainder(errors)] = errors >> np.uint32(11)
    return parity, fix


def decode(w: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword nearest to each 23-bit word; the code is perfect, so it is one."""
    parity, fix = tables()
    message = w >> np.uint32(11)
    return message ^ fix[(w & np.uint32(2047)) ^ parity[message]]


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)``: for two segments at a time, the codeword indices of both after at most one flip in either.

    If two fingerprints differ in at most 2 bits of the two segments, one flip from each leads to a word
    between them, whose indices are then a key of both.
    """
    rows, keys = [], []
    parts = [(prints >> np.uint64(lo) & np.uint64((1 << n) - 1)).astype(np.uint32) for lo, n in SEGMENTS]
    near = [np.stack([decode(w), *(decode(w ^ np.uint32(1 << k)) for k in range(n))], axis=1) for w, (_, n) in zip(parts, SEGMENTS, strict=True)]
    for which, (i, j) in enumerate(PAIRS):
        codes = np.concatenate([near[i] << np.uint32(12) | near[j][:, :1], near[i][:, :1] << np.uint32(12) | near[j][:, 1:]], axis=1)
        codes.sort(axis=1)
        new = np.ones(codes.shape, dtype=bool)
        new[:, 1:] = codes[:, 1:] != codes[:, :-1]
        rows.append(np.nonzero(new)[0])
        keys.append(codes[new].astype(np.int32) | np.int32(which << 24))
    return np.concatenate(rows), np.concatenate(keys)


def fingerprint(text: str, k: int) -> int:
    """64 bits, each the majority over the hashes of the text's k-word shingles."""
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= k:
        return xxhash.xxh64_intdigest(line, 42)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-k] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], 42) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def links(keys: np.ndarray, prints: np.ndarray, lag: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what lies within ``ERRORS`` bits under a key; rows are sorted by key.

    Small groups are compared at every lag at once. In a larger one each fingerprint, from the first,
    takes the ones near it that nothing has taken yet: a spanning forest, so copies cost one pass.
    """
    edge = np.flatnonzero(np.diff(keys)) + 1
    begin, end = np.concatenate([[0], edge]), np.concatenate([edge, [len(keys)]])
    size = end - begin
    out_a, out_b = [], []
    small = np.repeat(size <= lag + 1, size)
    for step in range(1, lag + 1):
        if len(keys) > step:
            at = np.flatnonzero((keys[step:] == keys[:-step]) & small[step:])
            at = at[np.bitwise_count(prints[at] ^ prints[at + step]) <= ERRORS]
            out_a.append(prints[at])
            out_b.append(prints[at + step])
    for g in np.flatnonzero(size > lag + 1):
        rest = np.unique(prints[begin[g] : end[g]])
        waiting: list[np.uint64] = []
        while len(rest) or waiting:
            if not waiting:
                waiting, rest = [rest[0]], rest[1:]
            at = waiting.pop()
            near = np.bitwise_count(rest ^ at) <= ERRORS
            if near.any():
                out_a.append(np.full(int(near.sum()), at, dtype=np.uint64))
                out_b.append(rest[near])
                waiting.extend(rest[near])
                rest = rest[~near]
    empty = np.empty(0, dtype=np.uint64)
    return np.concatenate([empty, *out_a]), np.concatenate([empty, *out_b])


def linked(prints: DataFrame, most: int = 20_000) -> DataFrame:
    """``a, b``: links between the distinct fingerprints ``f`` that hold together all that lie within ``ERRORS`` bits.

    A key with over ``most`` fingerprints is split: its blocks meet in pairs, in tasks of their own.
    """

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 4096):
                f = b["f"].to_numpy()[k : k + 4096]
                row, key = golay_keys(f.view(np.uint64))
                yield pd.DataFrame({"key": key, "f": f[row]})

    def forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_k, held_f = np.empty(0, np.int64), np.empty(0, np.uint64)

        def found(k: np.ndarray, f: np.ndarray) -> pd.DataFrame:
            a, b = links(k, f)
            return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)}).drop_duplicates()

        for b in batches:
            k, f = np.concatenate([held_k, b["key"].to_numpy()]), np.concatenate([held_f, b["f"].to_numpy().view(np.uint64)])
            whole = int(np.searchsorted(k, k[-1])) if len(k) else 0  # the last key may go on
            held_k, held_f = k[whole:], f[whole:]
            if whole:
                yield found(k[:whole], f[:whole])
        if len(held_k):
            yield found(held_k, held_f)

    keys = settle(prints.select("f").mapInPandas(keyed, "key int, f long"))
    large = settle(keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most))
    keys = keys.select(F.col("key").cast("long").alias("key"), "f")
    if not large.isEmpty():
        # Fewer keys than all keys / most, each over `most` rows.
        sized = keys.join(F.broadcast(large), "key").withColumn("blocks", F.ceil(F.col("n") / most))
        own = F.pmod(F.xxhash64("f"), F.col("blocks"))
        pairs = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.least(x, own) * F.lit(1 << 16) + F.greatest(x, own)))
        split = sized.withColumn("pair", pairs).select((F.xxhash64("key", "pair") % (1 << 40) + (1 << 41)).alias("key"), "f")
        keys = keys.join(F.broadcast(large), "key", "left_anti").unionByName(split)
    return keys.repartition("key").sortWithinPartitions("key").mapInPandas(forest, "a long, b long").distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id``.

    Words are runs of other than white space in the text with A-Z lowered. Null, empty and blank texts
    have fingerprint zero and are linked like any other; texts of fewer words than a shingle are one
    shingle. Fingerprints within 4 bits are linked; ``component_id`` is the smallest id reachable. Only
    distinct fingerprints are linked, so copies make no pairs. Repeated rows get rows of their own; null
    ids take part and never name a component that has another id. An empty table gives none. Other
    columns are not looked at.
    """

    def prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            f = np.array([fingerprint(t, shingle) for t in b["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "f": f.view(np.int64)})

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    rows = settle(given.mapInPandas(prints, "doc_id long, f long"))
    groups = settle(rows.groupBy("f").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("group_size")))
    roots = settle(connected_components(linked(groups)).withColumnRenamed("node", "f"))
    named = groups.join(roots, "f", "left").withColumn("root", F.coalesce("root", "f"))
    named = settle(named)
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("of_root"))
    sized = attach(named, settle(smallest), "root", groups.count(), weight="of_root").select("f", "group_size", "component_id")
    out = attach(rows, settle(sized), "f", rows.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
