"""Token ids as one long array in segment files, with Elias-Fano coded document boundaries.

A segment holds the ids of consecutive documents (little-endian, 16 bits where the vocabulary allows,
else 32) and two Elias-Fano sequences: where each document ends, and the documents' ids. Segments are
rows of a Parquet table, so that Spark's committer leaves no half-written files when tasks are lost,
and any store that Spark writes to will do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, text_of
from .tokens import encoder, public, vocabulary

SEGMENT = "part int, segment long, n_docs long, n_null long, n_ids long, width int, ids binary, ends binary, first_id long, doc_ids binary"


class EliasFano:
    """A non-decreasing sequence of n values up to u in about n * (2 + log2(u / n)) bits.

    The low bits of each value stand side by side; the high parts are in unary, value k at bit
    ``high + k`` of a bit array. ``select`` finds the k-th one from counts of 64-bit words, between the
    words that hold the 512th ones before and after it.
    """

    EVERY = 512

    def __init__(self, n: int, low: int, lows: np.ndarray, bits: np.ndarray):
        self.n, self.low, self.lows = n, low, lows
        self.words = np.concatenate([bits, np.zeros(-len(bits) % 8, np.uint8)]).view("<u8")
        self.bits = bits
        self.counts = np.cumsum(np.bitwise_count(self.words), dtype=np.uint32)  # ones up to the end of each word
        held = np.searchsorted(self.counts, np.arange(0, n, self.EVERY, dtype=np.uint32), side="right")
        self.samples = np.append(held, max(len(self.words) - 1, 0)).astype(np.uint32)

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        low = max(0, int(values[-1] // np.uint64(n)).bit_length() - 1) if n else 0
        high = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(high[-1]) + 1 if n else 0, dtype=np.uint8)
        flags[high] = 1
        width = (values[:, None] >> np.arange(low, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
        return cls(n, low, np.packbits(width.ravel(), bitorder="little"), np.packbits(flags, bitorder="little"))

    def tobytes(self) -> bytes:
        return np.array([self.n, self.low, len(self.lows), len(self.bits)], dtype="<u4").tobytes() + self.lows.tobytes() + self.bits.tobytes()

    @classmethod
    def frombytes(cls, data: bytes) -> EliasFano:
        n, low, a, b = np.frombuffer(data, dtype="<u4", count=4).tolist()
        return cls(n, low, np.frombuffer(data, np.uint8, a, 16), np.frombuffer(data, np.uint8, b, 16 + a))

    def select(self, which: np.ndarray) -> np.ndarray:
        """The values at the places ``which``."""
        k = np.asarray(which, dtype=np.int64)
        if len(k) and not (0 <= k.min() and k.max() < self.n):
            raise IndexError(which)
        at, last = self.samples[k // self.EVERY].astype(np.int64), self.samples[k // self.EVERY + 1].astype(np.int64)
        while (at < last).any():  # the first word that ends past k ones
            middle = (at + last) // 2
            past = self.counts[middle] > k
            at, last = np.where(past | (at == last), at, middle + 1), np.where(past, middle, last)
        before = np.where(at > 0, self.counts[at - 1], 0) if len(k) else k
        ones = np.unpackbits(self.words[at].view(np.uint8).reshape(len(k), 8), axis=1, bitorder="little")
        place = (np.cumsum(ones, axis=1, dtype=np.int64) <= (k - before)[:, None]).sum(axis=1)
        value = at * 64 + place - k
        low = np.zeros(len(k), dtype=np.int64)
        for j in range(self.low):
            bit = k * self.low + j
            low |= (self.lows[bit >> 3].astype(np.int64) >> (bit & 7) & 1) << j
        return value << self.low | low


def segment_row(part: int, segment: int, docs: list[int | None], ids: list[np.ndarray], width: int) -> dict:
    known = [d for d in docs if d is not None]
    first = known[0] if known else 0
    array = np.concatenate(ids)
    if int(array.max()) >= 256**width:
        raise ValueError(f"id {array.max()} does not fit {width} bytes")
    return {
        "part": part, "segment": segment, "n_docs": len(docs), "n_null": len(docs) - len(known), "n_ids": len(array), "width": width,
        "ids": array.astype(f"<u{width}").tobytes(), "ends": EliasFano.build(np.cumsum([len(x) for x in ids])).tobytes(),
        "first_id": first, "doc_ids": EliasFano.build(np.array(known, dtype=np.int64) - first).tobytes(),
    }


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, width: int | None = None, per_segment: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write all documents' ids in ascending order of id, each followed by ``end_id``.

    Documents are range-partitioned by id before they are encoded, so each task writes the segments of
    one range. A segment is closed at ``per_segment`` ids; a longer document is a segment of its own.
    ``width`` is the bytes of an id, 2 for vocabularies up to 65,536 and else 4 unless given; an id that
    does not fit is an error.
    """
    from pyspark import TaskContext

    width = width or (2 if max(vocabulary(tokenizer), end_id + 1) <= 1 << 16 else 4)

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, part, number = encoder(tokenizer), TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        held: list[np.ndarray] = []
        n = 0
        for b in batches:
            for k in range(0, len(b), 256):
                cut = b.iloc[k : k + 256]
                for doc, ids in zip(cut["doc_id"], encode(cut["text"].tolist()), strict=True):
                    names.append(None if pd.isna(doc) else int(doc))
                    held.append(np.append(ids, np.uint32(end_id)))
                    n += len(ids) + 1
                    if n >= per_segment:
                        yield pd.DataFrame([segment_row(part, number, names, held, width)])
                        names, held, n, number = [], [], 0, number + 1
        if names:
            yield pd.DataFrame([segment_row(part, number, names, held, width)])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    # Equal ids are told apart by their text, so that reruns write the same bytes.
    given = given.repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    given.mapInPandas(segments, SEGMENT).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: ``doc_id, start`` (ids before it in the whole array), ``n_tokens, ids_crc32``."""
    found = spark.read.schema(SEGMENT).parquet(path)
    sizes = found.select("part", "segment", "n_ids")
    # One row per task that wrote: as many as there are partitions, not documents.
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    order = Window.partitionBy("part").orderBy("segment")
    starts = sizes.withColumn("within", F.sum("n_ids").over(order) - F.col("n_ids")).join(parts, "part").select("part", "segment", (F.col("base") + F.col("within")).alias("base"))

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                ends, known = EliasFano.frombytes(row.ends), EliasFano.frombytes(row.doc_ids)
                ids = np.frombuffer(row.ids, dtype=f"<u{row.width}")
                for k in range(0, row.n_docs, 4096):
                    which = np.arange(k, min(k + 4096, row.n_docs))
                    upto = ends.select(which)
                    begins = np.concatenate([ends.select(which[:1] - 1) if k else [0], upto[:-1]]).astype(np.int64)
                    names = [*[None] * int((which < row.n_null).sum()), *(known.select(which[which >= row.n_null] - row.n_null) + row.first_id).tolist()]
                    crc = [zlib.crc32(ids[a:z].astype("<u4")) for a, z in zip(begins.tolist(), upto.tolist(), strict=True)]
                    yield pd.DataFrame({"part": row.part, "segment": row.segment, "doc_id": pd.array(names, dtype="Int64"), "begin": begins, "n_tokens": upto - begins, "ids_crc32": crc})

    rows = found.select("part", "segment", "n_docs", "n_null", "width", "ids", "ends", "first_id", "doc_ids").mapInPandas(documents, "part int, segment long, doc_id long, begin long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "segment"]).select("doc_id", (F.col("base") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, path: str, tokenizer: str, **how) -> DataFrame:
    """Write the ids of ``docs`` to ``path`` and read them back, one row per input row.

    Null and empty texts are the end id alone. Null ids come first; repeated ids follow each other.
    An empty table writes no segment and gives no rows. Other columns are not looked at.
    """
    write_tokens(docs, path, tokenizer, **how)
    return read_tokens(docs.sparkSession, path)


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch(spark), public("word_bpe_49k.json"))
