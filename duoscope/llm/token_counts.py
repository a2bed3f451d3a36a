"""Token counts through a digest cache: only texts whose digest has no stored count are encoded."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, filter_keys, scratch, settle, text_of
from .tokens import encoder, public, version

CACHE = "digest binary, tokenizer string, n_tokens long"


def count_tokens(docs: DataFrame, cache_path: str, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_tokens, over_limit``.

    The cache at ``cache_path`` (Parquet: content digest, tokenizer digest, count) is made if absent.
    A text is normalised only by reading null as empty, since any other change could change its count.
    Each distinct text without a stored count is encoded once and its count appended; an append that is
    repeated after a failure adds equal rows, which reading folds. Empty texts have 0 tokens. Repeated
    rows and ids each get their row; an empty table gives none. Other columns are not looked at.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    rows = settle(given.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")))
    groups = settle(rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("group_size")))
    n, mark = rows.count(), version(tokenizer)

    def stored() -> DataFrame:
        return spark.read.schema(CACHE).parquet(cache_path).where(F.col("tokenizer") == mark).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    spark.createDataFrame([], CACHE).coalesce(1).write.mode("append").parquet(cache_path)
    known = stored().select("digest", F.lit(True).alias("known"))
    state = groups.join(known, "digest", "left").where("known or group_size > 1")
    # Rows that need no encoding: a count is stored, or another row of the same text is encoded.
    spared = settle(attach(rows, settle(state), "digest", n).where("known or first_id <> doc_id").select("digest", "doc_id").distinct())
    misses = filter_keys(given, spared, ["digest", "doc_id"], "left_anti")

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        for b in batches:
            yield pd.DataFrame({"digest": b["digest"], "tokenizer": mark, "n_tokens": [len(x) for x in encode(b["text"].tolist())]})

    misses.select("digest", "text").mapInPandas(counts, CACHE).write.mode("append").parquet(cache_path)
    found = attach(rows, groups.join(stored(), "digest"), "digest", n)
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache of its own, so every distinct text is encoded."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch(spark), public("byte_bpe_50k.json"))
