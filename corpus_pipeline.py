"""A corpus from raw documents to packed sequences: quality rules, exact and near dedup, mixing, packing."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duoscope.llm.common import ROW, SETTLED, discard, filter_keys, numbered, release, settle
from duoscope.llm.exact_dedup import exact_dedup
from duoscope.llm.mixing import mixed_documents
from duoscope.llm.near_sets import near_groups
from duoscope.llm.packing import pack
from duoscope.llm.quality_rules import quality_rules
from duoscope.llm.tokens import public


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables that stages called so far still stand on.
LEFT: list[str] = []


def stage(made: Stage) -> Stage:
    """Before a stage, what earlier ones stood on is deleted: their results are written by then.

    Tables that ``docs`` itself reads stay, for callers that pass on a result unwritten.
    """

    @wraps(made)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles() if LEFT else []
        gone = [p for p in LEFT if not any(p.rsplit("/", 1)[-1] in f for f in read)]
        discard(spark, gone)
        LEFT[:] = [p for p in LEFT if p not in gone]
        mark = len(SETTLED)
        out = made(spark, docs, sf_dir)
        LEFT.extend(SETTLED[mark:])
        return out

    return run_stage


def without(rows: DataFrame, dropped: DataFrame, mark: int) -> DataFrame:
    """Numbered ``rows`` less those whose number is in ``dropped``, without the number.

    ``rows`` was the first table settled after the first ``mark``; those since are done with once the numbers are written.
    """
    numbers = settle(dropped.select(ROW))
    discard(rows.sparkSession, SETTLED[mark + 1 : -1])
    return filter_keys(rows, numbers, [ROW], "left_anti").drop(ROW)


def rank_of() -> Column:
    """Ids in ascending order, null ids after all others, rows of one id by their number."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(ROW).alias("row"))


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are outliers of their language and source go.

    Every row has its own verdict, so rows of equal or null id go or stay by their own text. Null and empty
    texts fail. An empty table stays empty.
    """
    mark = len(SETTLED)
    rows = numbered(docs)
    return without(rows, quality_rules(rows, id_col=ROW).where("not kept").select(F.col("doc_id").alias(ROW)), mark)


@stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row of the smallest id stays, one row only; a null id only where the group has no other.

    Null and empty texts are equal to each other. An empty table stays empty.
    """
    mark = len(SETTLED)
    rows = numbered(docs)
    ids = exact_dedup(rows.select(rank_of().alias("_id"), "text"), id_col="_id")
    return without(rows, ids.where("not kept").select(F.col("doc_id.row").alias(ROW)), mark)


@stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by five-word shingles at similarity 0.8 or more the row of the smallest id stays.

    SimHash fingerprints within 4 bits name candidates, and so do min-hash bands, for pairs that differ in more bits. Null, empty and blank texts form one group; a null id stays only where its group has no other. An
    empty table stays empty.
    """
    mark = len(SETTLED)
    rows = numbered(docs)
    groups = near_groups(rows.select(ROW, "text"), id_col=ROW).withColumnRenamed("doc_id", ROW)
    ids = settle(groups.join(rows.select(ROW, "doc_id"), ROW).select(ROW, "component_id", rank_of().alias("rank")))
    stay = ids.groupBy("component_id").agg(F.min("rank").alias("rank")).select(F.col("rank.row").alias(ROW))
    return without(rows, ids.join(stay, ROW, "left_anti"), mark)


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What each source gives to the mix; a document taken in several rounds comes several times, under its one id.

    A null source is one of its own. Null, empty and blank texts have no words and give no row; rows of null or equal
    ids are taken each by its own words. An empty table stays empty.
    """
    return mixed_documents(docs)


@stage
def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 1024 tokens.

    ``row`` tells rows of one id apart, so ``row, piece`` is unique in the result. A null or empty text is one piece, its
    end token alone; a null id stays null. An empty table gives no pieces.
    """
    return pack(numbered(docs), public("byte_bpe_50k.json"), row_col=ROW)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("simhash_near_dedup", near), ("mix_sources", mix), ("best_fit_packing", sequences)]

#: Similarity, token ids and packing are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; a stage's own tables are deleted once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        mark = len(SETTLED)
        out = settle(step(spark, docs, sf_dir))
        kept = SETTLED.pop()
        release(spark, mark)
        SETTLED.append(kept)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
