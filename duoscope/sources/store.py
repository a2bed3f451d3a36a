"""An embedding store on shared storage: Parquet folders by version, the last write of a key counts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.embedding import embed, latest

SCHEMA = "key string, dim int, embedding array<float>, deleted boolean, version long"
FACTS = "name string, value string, version long"


class Store:
    """Folders ``<version>-<delta|base|facts>-<id>`` under ``path``; one counts once Spark has marked it complete.

    A write makes a new folder and changes none, so a job that dies leaves nothing half done, and readers keep what they
    began with. A base holds all keys of its version; readers take the newest complete one and the deltas after it.
    Equal versions of two writers at once are ordered by the folders' ids.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _folders(self) -> list[tuple[int, str, str]]:
        """Complete folders as ``(version, kind, name)``, oldest first."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        done = [n for n in names if n.count("-") == 2 and fs.exists(hadoop.Path(f"{self.path}/{n}/_SUCCESS"))]
        return [(int(n.split("-")[0]), n.split("-")[1], n) for n in sorted(done)]

    def _read(self, kinds: tuple[str, ...], schema: str) -> DataFrame:
        """All rows of the folders that count, with ``_turn``, the order of the folders."""
        all_ = [f for f in self._folders() if f[1] in kinds]
        base = max((k for k, f in enumerate(all_) if f[1] == "base"), default=0)
        live = all_[base:]
        if not live:
            return self.spark.createDataFrame([], schema).withColumn("_turn", F.lit(0))
        turn = F.create_map(*[x for k, f in enumerate(live) for x in (F.lit(f[2]), F.lit(k))])
        read = self.spark.read.schema(schema).parquet(*[f"{self.path}/{f[2]}" for f in live])
        return read.withColumn("_turn", turn[F.element_at(F.split(F.input_file_name(), "/"), -2)])

    def _write(self, df: DataFrame, kind: str) -> int:
        version = max((f[0] for f in self._folders()), default=0) + 1
        df.withColumn("version", F.lit(version).cast("long")).write.parquet(f"{self.path}/{version:08d}-{kind}-{uuid.uuid4().hex}")
        return version

    def rows(self) -> DataFrame:
        """``key, dim, embedding, version``: the last write of each key, deleted ones left out."""
        now = latest(self._read(("delta", "base"), SCHEMA), ["key"], "_turn")
        return now.where("not deleted").select("key", "dim", "embedding", "version")

    def upsert(self, df: DataFrame, order: str | None = None) -> int:
        """Writes ``key, embedding`` and tells the version. Of rows of one key the last by ``order`` counts, or the
        largest vector. Null keys and vectors are left out."""
        by = F.struct(*([order] if order else []), "embedding")
        df = df.where("key is not null and embedding is not null").groupBy("key").agg(F.max_by("embedding", by).cast("array<float>").alias("embedding"))
        return self._write(df.select("key", F.size("embedding").alias("dim"), "embedding", F.lit(False).alias("deleted")), "delta")

    def delete(self, keys: DataFrame) -> int:
        """Keys of ``keys`` (column ``key``) are gone from the next version on."""
        none = F.lit(None).cast("array<float>").alias("embedding")
        return self._write(keys.where("key is not null").select("key").distinct().select("key", F.lit(None).cast("int").alias("dim"), none, F.lit(True).alias("deleted")), "delta")

    def compact(self) -> int:
        """All keys in one new base. Older folders stay for readers that began with them, until ``vacuum``."""
        return self._write(self.rows().drop("version").withColumn("deleted", F.lit(False)), "base")

    def vacuum(self) -> int:
        """Deletes folders that no reader that begins now would read, and tells how many."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        fs = hadoop.Path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        rows = [f for f in self._folders() if f[1] != "facts"]
        base = max((k for k, f in enumerate(rows) if f[1] == "base"), default=0)
        for f in rows[:base]:
            fs.delete(hadoop.Path(f"{self.path}/{f[2]}"), True)
        return base

    def describe(self, **facts: str) -> int:
        """Notes facts such as model or description; a later note of one name replaces it."""
        return self._write(self.spark.createDataFrame([(k, str(v)) for k, v in facts.items()], "name string, value string"), "facts")

    def facts(self) -> DataFrame:
        """``name, value, version``: what was noted last under each name."""
        return latest(self._read(("facts",), FACTS), ["name"], "_turn").select("name", "value", "version")


def fill(store: Store, wanted: DataFrame, seq: str, load: Callable, rounds: int = 8) -> dict[str, int]:
    """Embeds the distinct keys of ``wanted`` (``key`` and a sequence) that the store lacks; safe to kill and run again.

    Work goes in ``rounds`` by hash of the key, each one a write, so a run that dies has lost one round at most and the next
    finds the others done. Counts: ``wanted`` keys, ``loaded`` from the store, ``computed`` now, ``skipped`` for want of a
    sequence or because the model failed. Rows of one key give the least sequence; null keys take no part.
    """
    asked = wanted.where("key is not null").groupBy("key").agg(F.min(seq).alias(seq))
    held = store.rows().select("key")
    todo = asked.join(held, "key", "left_anti")
    counts = {"wanted": asked.count(), "computed": 0}
    counts["loaded"] = asked.join(held, "key", "left_semi").count()
    for r in range(rounds):
        part = todo.where(F.pmod(F.xxhash64("key"), F.lit(rounds)) == r).where(F.col(seq).isNotNull())
        seen = Observation()
        done = embed(part, seq, load, ["key"]).where("error is null").select("key", "embedding").observe(seen, F.count("*").alias("n"))
        store.upsert(done)
        counts["computed"] += seen.get["n"]
    counts["skipped"] = counts["wanted"] - counts["loaded"] - counts["computed"]
    return counts
