"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import SETTLED, filter_keys, scratch, settle, text_of

#: Symbols are bytes, with one more for the begin of a text.
SYMBOLS = 257
POOLED = "*"


def gram_keys(data: bytes, order: int) -> np.ndarray:
    """The ``order`` bytes up to each byte of ``data`` as one number, zeros before its begin."""
    x = np.concatenate([np.zeros(order - 1, np.int64), np.frombuffer(data, np.uint8).astype(np.int64)])
    n, key = len(data), np.zeros(len(data), np.int64)
    for k in range(order):
        key = key << 8 | x[k : k + n]
    return key


def key_runs(data: bytes, order: int, run: int = 1 << 20) -> Iterator[np.ndarray]:
    """``gram_keys`` of a text of any length, in runs of bounded size."""
    for k in range(0, len(data), run):
        yield gram_keys(data[max(0, k - order + 1) : k + run], order)[min(k, order - 1) :]


def tally(texts: Iterable[str], order: int, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of some texts and their counts; about ``most`` occurrences are held at a time."""
    grams, counts, held, n = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0

    def close() -> None:
        g, c = np.unique(np.concatenate(held), return_counts=True)
        grams.append(g)
        counts.append(c)

    for text in texts:
        for run in key_runs(text.encode(), order):
            held.append(run)
            n += len(run)
            if n >= most:
                close()
                held, n = held[:1], 0
    close()
    g, at = np.unique(np.concatenate(grams), return_inverse=True)
    return g, np.bincount(at, np.concatenate(counts), len(g)).astype(np.int64)


def summed(a: tuple[np.ndarray, np.ndarray] | None, b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of two tallies with their counts added."""
    if a is None:
        return b
    g, at = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    return g, np.bincount(at, np.concatenate([a[1], b[1]]), len(g)).astype(np.int64)


def blocks_of(texts: DataFrame, bytes_of_block: int = 64 << 20) -> DataFrame:
    """``texts`` with the number of their ``block``, written once to the shared folder, bucketed by block.

    A task numbers its rows' blocks by the bytes it has seen, so a block holds ``bytes_of_block`` and one text
    at most, whatever ids and texts are equal. Small partitions are coalesced up to that size first, since
    larger blocks repeat fewer grams. The table is written where its rows are, without a shuffle, and later
    meets other rows by block without one.
    """
    from pyspark import TaskContext

    spark, schema = texts.sparkSession, StructType([*texts.schema, StructField("block", LongType())])

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, seen = TaskContext.get().partitionId() << 24, 0
        for b in batches:
            upto = seen + np.cumsum(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first + upto // bytes_of_block)], [*b.schema.names, "block"])
            seen = int(upto[-1]) if len(upto) else seen

    whole = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    texts = texts.coalesce(max(spark.sparkContext.defaultParallelism, -(-whole // bytes_of_block)))
    path, name = scratch(spark), f"blocks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts.mapInArrow(laid, schema).write.bucketBy(buckets, "block").option("path", path).option("compression", "zstd").saveAsTable(name)
    SETTLED.append(path)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name alone: the files are not the catalog's
    return table


def count_grams(texts: DataFrame, order: int) -> DataFrame:
    """``block, model, g, c``: the distinct grams of ``order`` bytes of a block's texts of a model, with their counts in the ``trained`` ones.

    A task keeps the grams of one block at a time, at most as many as the block has bytes. Where a block's rows are read
    by several tasks a gram comes once in each.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, at = {}, None

        def close() -> Iterator[pd.DataFrame]:
            for model, (g, c) in held.items():
                yield pd.DataFrame({"block": at, "model": model, "g": g, "c": c})
            held.clear()

        for b in batches:
            for block, rows in b.groupby("block"):
                if block != at:
                    yield from close()
                    at = block
                for (model, trained), part in rows.groupby(["model", "trained"]):
                    g, n = tally(part["text"], order)
                    held[model] = summed(held.get(model), (g, n if trained else np.zeros_like(n)))
        yield from close()

    return texts.select("block", "model", "trained", "text").mapInPandas(counted, "block long, model string, g long, c long")


def discount(c: Column) -> Column:
    return F.when(c == 0, 0.0).when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))


def gram_scores(grams: DataFrame, order: int) -> DataFrame:
    """``model, g, logp``: the interpolated modified Kneser-Ney log probability of each row of ``model, g, c``.

    ``c`` counts occurrences in trusted text; grams that only other text holds have 0 and are scored by the
    same joins. Lower orders count the different trained bytes before a gram. Each order's counts are
    joined by context for totals and by suffix to the order below, all by shuffled keys.
    """
    counts = {order: grams}
    for k in range(order - 1, 0, -1):
        cut = F.col("g").bitwiseAND((1 << 8 * k) - 1)
        counts[k] = settle(counts[k + 1].groupBy("model", cut.alias("g")).agg(F.count_if(F.col("c") > 0).alias("c")))
    below = None
    for k in range(1, order + 1):
        df = counts[k]
        of = [F.count_if(F.col("c") == j).alias(f"n{j}") for j in (1, 2, 3, 4)]
        y = F.try_divide("n1", F.col("n1") + 2 * F.col("n2"))

        def step(j: int, y: Column = y) -> Column:
            d = j - F.try_divide((j + 1) * y * F.col(f"n{j + 1}"), f"n{j}")
            return F.when((d > 0) & (d < j), d).otherwise(0.5 * min(j, 2)).alias(f"d{j}")

        d = df.groupBy("model").agg(*of).select("model", step(1), step(2), step(3))  # a row per language
        df = df.join(F.broadcast(d), "model").withColumn("h", F.shiftright("g", 8))
        left = df.groupBy("model", "h").agg(F.sum("c").alias("total"), F.sum(discount(F.col("c"))).alias("saved"))
        df = df.join(left, ["model", "h"])
        gamma = F.coalesce(F.try_divide("saved", "total"), F.lit(1.0))  # an unseen context leaves all to the order below
        own = F.coalesce(F.try_divide(F.col("c") - discount(F.col("c")), "total"), F.lit(0.0))
        if below is None:
            p = own + gamma / SYMBOLS
        else:
            df = df.withColumn("suffix", F.col("g").bitwiseAND((1 << 8 * (k - 1)) - 1)).join(below, ["model", "suffix"])
            p = own + gamma * F.exp("below")
        df = settle(df.select("model", "g", F.log(p).alias("logp")))
        below = df.select("model", F.col("g").alias("suffix"), F.col("logp").alias("below"))
    return df


def text_scores(texts: DataFrame, asked: DataFrame, scores: DataFrame, order: int) -> DataFrame:
    """``doc_id, lang, n_bytes, logp`` for rows of ``block, doc_id, lang, model, text``: the sum of the scores of a text's grams.

    ``asked`` has the ``block, model, g`` that the blocks hold. They are joined with the scores by gram, which
    a gram enters about once a block, so no key is hot, and meet their block's texts in one task, which holds
    a block and its scores at most.
    """
    given = asked.join(scores, ["model", "g"]).select("block", "model", "g", "logp")

    def scored(part: pa.Table, known: pa.Table) -> pa.Table:
        held, sizes, totals = {}, [], []
        rows = known.select(["model", "g", "logp"]).to_pandas()
        for model, of in rows.drop_duplicates(["model", "g"]).sort_values("g").groupby("model"):
            held[model] = of["g"].to_numpy(), of["logp"].to_numpy()
        for model, text in zip(part["model"].to_pylist(), part["text"], strict=True):
            data, total = text.as_py().encode(), 0.0
            for keys in key_runs(data, order):
                g, logp = held[model]
                at = np.searchsorted(g, keys)
                if at.max() == len(g) or (g[at] != keys).any():
                    raise ValueError("a text holds a gram without a score")
                total += float(logp[at].sum())
            sizes.append(len(data))
            totals.append(total)
        return pa.table([part["doc_id"], part["lang"], pa.array(sizes, pa.int64()), pa.array(totals, pa.float64())], ["doc_id", "lang", "n_bytes", "logp"])

    near = texts.select("block", "doc_id", "lang", "model", "text").groupBy("block").cogroup(given.groupBy("block"))
    return near.applyInArrow(scored, "doc_id long, lang string, n_bytes long, logp double")


def perplexity_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality", order: int = 5, held_out: int = 8, quantile: float = 0.999, margin: float = 1.05, bytes_of_block: int = 64 << 20) -> DataFrame:
    """One row per input row: ``doc_id, lang, n_bytes, perplexity, threshold, kept``.

    Models are trained on the whole texts of all trusted documents (label 1) but one in ``held_out`` by
    hash of the id. Every whole document is scored, by its language's model, or by one of all languages
    where a language has none or is null. The threshold of a language is ``margin`` times the larger of
    two ``quantile``s of perplexity: that of its held-out trusted documents and that of all its trusted
    ones; a language without trusted documents takes that of all languages. Documents at or under it
    stay. ``bytes_of_block`` is how much text is scored at a time; it sets what is shuffled, not what is computed. Null and empty texts have no perplexity and do not stay; where no
    document is trusted nothing is known, and all others stay. Equal rows get equal results; an empty
    table gives none. Other columns are not looked at.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), text_of(text_col).alias("text"))
    trusted = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("doc_id")).distinct()
    trusted = settle(trusted.withColumn("trained", F.pmod(F.xxhash64("doc_id"), F.lit(held_out)) != 0))
    known = filter_keys(given, trusted.where("trained"), ["doc_id"], "left_semi").where("text <> ''")
    langs = settle(known.where("lang is not null").select("lang").distinct().withColumn("model", F.concat(F.lit("="), "lang")))
    given = filter_keys(given, langs, ["lang"], "left").withColumn("model", F.coalesce("model", F.lit(POOLED)))
    marked = filter_keys(given, trusted, ["doc_id"], "left").withColumn("trained", F.coalesce("trained", F.lit(False)))
    marked = blocks_of(marked.select("doc_id", "lang", "model", "trained", "text"), bytes_of_block)
    found = settle(count_grams(marked, order))
    grams = settle(found.groupBy("model", "g").agg(F.sum("c").alias("c")))
    if not grams.where(F.col("model") == POOLED).isEmpty():
        shared = grams.where("c > 0").where(F.col("model") != POOLED).withColumn("model", F.lit(POOLED))
        grams = settle(grams.unionByName(shared).groupBy("model", "g").agg(F.sum("c").alias("c")))
    scored = settle(text_scores(marked, found.select("block", "model", "g"), gram_scores(grams, order), order))
    rows = scored.select("doc_id", "lang", "n_bytes", F.exp(-F.try_divide("logp", "n_bytes")).alias("perplexity"))
    judged = settle(filter_keys(rows.select("doc_id", "lang", "perplexity"), trusted, ["doc_id"], "inner"))
    level = lambda w: F.percentile_approx(F.when(w, F.col("perplexity")), quantile, 100_000)
    limit = (F.greatest(level(~F.col("trained")), level(F.lit(True))) * margin).alias("own")
    limits = settle(judged.groupBy(F.col("lang").alias("of")).agg(limit))
    rest = judged.agg(limit).first()[0]
    out = rows.join(F.broadcast(limits), F.col("lang").eqNullSafe(F.col("of")), "left")  # a row per language
    bound = F.coalesce("own", F.lit(rest).cast("double"))
    kept = F.when(F.col("n_bytes") == 0, False).otherwise(F.coalesce(F.col("perplexity") <= bound, F.lit(True)))
    return out.select("doc_id", "lang", "n_bytes", "perplexity", bound.alias("threshold"), kept.alias("kept"))


def op7_perplexity_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity_filter(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
