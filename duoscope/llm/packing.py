"""Best-fit packing of documents into fixed-length sequences by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, text_of
from .tokens import encoder, public

PIECE = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECE + ", sequence_id long, offset long"


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def cut(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str, row_col: str | None) -> DataFrame:
    """Pieces of at most ``capacity`` ids; a longer document's first piece takes the remainder."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        for b in batches:
            for k in range(0, len(b), 256):
                out = []
                part = b.iloc[k : k + 256]
                for doc, row, ids in zip(part["doc_id"], part["row"], encode(part["text"].tolist()), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    at, step = 0, len(ids) % capacity or capacity
                    for piece in range(-(-len(ids) // capacity)):
                        out.append((doc, row, piece, at, step, zlib.crc32(ids[at : at + step])))
                        at, step = at + step, capacity
                yield pd.DataFrame(out, columns=names(PIECE)).astype({"doc_id": "Int64", "row": "Int64"})

    row = F.col(row_col) if row_col else F.lit(None)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), row.cast("long").alias("row"), text_of(text_col).alias("text")).mapInPandas(pieces, PIECE)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, placed in the order given.

    ``open_[g]`` counts the open bins with gap g. A length goes where the sum of ``open_**2`` over gaps
    1..capacity-1 ends smallest: into a bin of some gap, or a new bin. Ties go to the smallest gap, and an
    exact fit also goes before a place where the sum would end smaller by one, since it closes a bin for good.
    """
    open_ = np.zeros(capacity + 1, dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, at, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    shut = np.iinfo(np.int64).max
    for k, size in enumerate(lengths.tolist()):
        if size >= capacity:
            bins[k], at[k], n = n, 0, n + 1
            continue
        gaps = open_[size:capacity]  # of bins that have room
        change = open_[0 : capacity - size] - gaps + 1  # half the change of the sum, for gap size + j
        change[gaps == 0] = shut
        best, j = shut, -1
        if len(change):
            change[0] = -gaps[0] if gaps[0] else shut  # an exact fit leaves no gap
            j = int(change.argmin())
            best = int(change[j])
        if open_[capacity - size] < best:
            b, gap, n = n, capacity, n + 1
        else:
            gap = size + j
            b = stacks[gap].pop()
            open_[gap] -= 1
        bins[k], at[k] = b, capacity - gap
        if rest := gap - size:
            stacks[rest].append(b)
            open_[rest] += 1
    return bins, at


def tightest_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, longest first into the open bin with the least gap that holds it."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps: list[int] = []  # those that some open bin has
    bins, at, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[k])
        j = bisect_left(gaps, size)
        if j == len(gaps):
            b, gap, n = n, capacity, n + 1
        else:
            gap = gaps[j]
            b = stacks[gap].pop()
            if not stacks[gap]:
                gaps.pop(j)
        bins[k], at[k] = b, capacity - gap
        if rest := gap - size:
            if not stacks[rest]:
                insort(gaps, rest)
            stacks[rest].append(b)
    return bins, at


def sequences(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of squares; what the bins it leaves part-filled hold is then packed anew, if that takes fewer."""
    bins, at = sum_of_squares(lengths, capacity)
    if not len(lengths):
        return bins, at
    fill = np.bincount(bins, weights=lengths)
    loose = fill[bins] < capacity
    again, offset = tightest_fit(lengths[loose], capacity)
    if loose.any() and again.max() + 1 < int((fill < capacity).sum()):
        bins[loose], at[loose] = again + len(fill), offset
        bins = np.unique(bins, return_inverse=True)[1].astype(np.int64)
    return bins, at


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, per_shard: int = 100_000, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, and ``row`` where ``row_col`` is given.

    Every document is its ids and ``end_id``; null and empty texts are the end id alone. Documents over
    ``capacity`` are cut, others stay whole. Pieces are dealt by hash to shards of about ``per_shard``,
    each packed longest first by the sum-of-squares rule; the pieces of bins left part-filled are packed
    once more, tightest gap first. A shard leaves a few bins part-filled, whatever the input's size. Repeated
    rows are packed as rows of their own; an empty table gives no rows. Other columns are not looked at. The
    same input gives the same sequences.
    """
    pieces = settle(cut(docs, tokenizer, capacity, end_id, id_col, text_col, row_col))
    shards = max(1, round(pieces.where(F.col("length") < capacity).count() / per_shard))

    def place(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["length", "doc_id", "piece", "ids_crc32", "row"], ascending=[False, True, True, True, True], ignore_index=True)
        bins, at = sequences(p["length"].to_numpy(), capacity)
        return p.assign(sequence_id=bins * shards + p["shard"], offset=at)[names(PACKED)]

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "length"), F.lit(shards)))
    packed = dealt.groupBy("shard").applyInPandas(place, PACKED)
    return packed if row_col else packed.drop("row")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public("byte_bpe_50k.json"))
