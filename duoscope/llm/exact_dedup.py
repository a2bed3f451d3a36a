"""Exact deduplication by 128-bit content hash, with a byte comparison inside every group. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, attach, filter_keys, settle, text_of


def content_hash(norm: Column) -> Column:
    return F.unhex(F.md5(norm))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", hashed=content_hash) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their bytes are after lowering A-Z. ``keep`` says whether the smallest or the
    largest id of a group stays. Null text counts as empty; empty texts form one group. Rows that repeat
    an id count separately in ``group_size`` and share the id's verdict; a null id stays only where the
    whole group has none. An empty table gives an empty result. Other columns are not looked at.

    Only digests are grouped; only texts whose digest occurs twice are moved, salted by group size, to be
    compared with the text that stays. Groups in which bytes differ are grouped again by the text itself.
    """
    norm = ascii_lower(text_of(text_col))
    best = {"smallest": F.min, "largest": F.max}[keep]
    given = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm"))
    rows = settle(given.select("doc_id", hashed(F.col("norm")).alias("h"), F.unhex(F.sha2("norm", 256)).alias("sha")))
    groups = settle(rows.groupBy("h").agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"))
    n = rows.count()

    members = settle(filter_keys(given.withColumn("h", hashed(F.col("norm"))), groups.select("h"), ["h"], "left_semi"))
    sized = attach(members, groups, "h", n)
    salted = sized.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("group_size") / 2048)))
    stays = sized.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).dropDuplicates(["h", "doc_id"])
    stays = stays.select("h", F.col("norm").alias("of_keeper"), F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("group_size") / 2048) - 1)).alias("salt"))
    differ = settle(salted.join(stays, ["h", "salt"]).where("norm <> of_keeper").select("h").distinct())

    out = attach(rows, groups, "h", n)
    if not differ.isEmpty():
        split = members.join(differ, "h", "left_semi")
        classes = split.groupBy("h", "norm").agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        apart = split.join(classes, ["h", "norm"]).select("h", "doc_id", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")
        out = out.join(differ, "h", "left_anti").unionByName(apart)
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="largest")


SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""
