"""Helpers the corpus operators share: scratch tables, key filters and skew-proof lookups."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A run of white space, and a word, as the operators' contracts define them.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: The column of a row's own number.
ROW = "__row__"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Folders of settled tables that no one has released yet, oldest first.
SETTLED: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new path under the shared folder of ``spark.checkpoint.dir``.

    Where that is unset a session on one machine takes a temporary folder; on a cluster it is an error,
    since executors would not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there and a lost executor costs nothing."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    SETTLED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete settled tables by their paths. What was read from them must be written or done with."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    SETTLED[:] = [p for p in SETTLED if p not in set(paths)]


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables settled after the first ``since``."""
    discard(spark, SETTLED[since:])


def numbered(docs: DataFrame, name: str = ROW) -> DataFrame:
    """``docs`` with a number of its own for each row, settled, so that equal and null ids are told apart for good.

    A column of that name in ``docs`` is overwritten.
    """
    return settle(docs.withColumn(name, F.monotonically_increasing_id()))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z lowered and nothing else; all-ASCII strings take the faster built-in, which agrees there."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words_of(c: Column) -> Column:
    return F.array_remove(F.split(c, SPACE), "")


def filter_keys(rows: DataFrame, keys: DataFrame, on: list[str], how: str, limit: int = 32 << 20) -> DataFrame:
    """Join of ``rows`` with a settled key table: broadcast while that has at most ``limit`` bytes, else shuffled.

    The bytes are those of its values and 32 more a row; the rows of the result are the same either way.
    """
    size = F.lit(32)
    for name, kind in keys.dtypes:
        size = size + (F.coalesce(F.octet_length(name), F.lit(0)) if kind in ("string", "binary") else F.lit(8))
    held = keys.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return rows.join(F.broadcast(keys) if held <= limit else keys, on, how)


def running(df: DataFrame, keys: list[str], order: str, value: str, name: str, width: int = 4096) -> DataFrame:
    """Adds the sum of ``value`` over the rows of ``keys`` whose whole number ``order`` is less. Rows have an order each.

    Sums go over blocks of ``width`` numbers first, then within a block, so no task sorts all rows of a key.
    """
    df = df.withColumn("_block", F.floor(F.col(order) / width))
    blocks = df.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum"))
    blocks = blocks.select(*keys, "_block", (F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_block")) - F.col("_sum")).alias("_base"))
    within = F.sum(value).over(Window.partitionBy(*keys, "_block").orderBy(order)) - F.col(value)
    return df.withColumn("_within", within).join(blocks, [*keys, "_block"]).withColumn(name, F.col("_base") + F.col("_within")).drop("_block", "_base", "_within")


def attach(rows: DataFrame, groups: DataFrame, key: str, n_rows: int, weight: str = "group_size", share: int = 1000, n_groups: int | None = None) -> DataFrame:
    """Left join of settled ``rows`` to the rows of their key, whatever share of the rows a key holds.

    A key with more than ``n_rows / share`` rows is one of fewer than ``share`` such keys, so those are
    broadcast; all others are joined by shuffle, where none can weigh much. Where ``groups`` is known to have
    ``n_groups`` keys and no more than ``share``, all are broadcast at once: one join in place of three.
    """
    if n_groups is not None and n_groups <= share:
        return rows.join(F.broadcast(groups), key, "left")
    hot = groups.where(F.col(weight) * share > n_rows)
    cold = groups.where(F.col(weight) * share <= n_rows)
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left")
    return near.unionByName(far)
