"""Mixing sources to target weights, by blocks of words drawn for output shards. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ROW, filter_keys, numbered, running, settle, text_of, words_of

SPANS = "__spans__"
#: Rounds of the index permutations.
ROUNDS = 48


def targets(sizes: DataFrame, weights: tuple[int, ...], most: float) -> DataFrame:
    """``source, source_size, s, target``: water-filling of all sizes by weight, no source above ``most`` times its own.

    ``sizes`` has one row per source. Sources are numbered by code point, null last, and take the
    weights in turn. In order of what they hold per weight, sources fill up until the level that the
    rest would share is below what the next one holds.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    df = sizes.withColumn("s", F.row_number().over(order).cast("int")).withColumn("w", w).withColumn("cap", F.col("source_size") * most)
    fill = Window.orderBy(F.col("cap") / F.col("w"), "s")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    df = df.withColumn("total", F.sum("source_size").over(whole)).withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    level = F.min(F.when(F.col("cap") / F.col("w") >= F.col("level"), F.struct(F.col("cap") / F.col("w"), F.col("s"), F.col("level").alias("at")))).over(whole)["at"]
    return df.withColumn("target", F.least(F.col("cap"), F.col("w") * level)).select("source", "source_size", "s", "target")


def blocks_of(sources: DataFrame, block: int) -> DataFrame:
    """Adds the words of a block, how many blocks a source has, and how many slots its target fills."""
    length = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("source_size") / 256))).cast("long")
    df = sources.withColumn("len", length).withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("len")))
    rounds = F.floor(F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)) + 1e-9)
    rest = F.round((F.col("target") - rounds * F.col("source_size")) / F.col("len")).cast("long")
    quota = rounds * F.col("n_blocks") + F.least(F.greatest(rest, F.lit(0)), F.col("n_blocks"))
    return df.withColumn("quota", F.when(F.col("source_size") > 0, quota).otherwise(0).cast("long"))


def unit(*c: Column) -> Column:
    """A reproducible number in [0, 1) from the values."""
    return F.shiftrightunsigned(F.xxhash64(*c), 11) / float(1 << 53)


def slots(spark: SparkSession, sources: DataFrame, seed: int, per_shard: int) -> DataFrame:
    """``shard, s, k``: slot k of source s stands in an output shard.

    Every shard of ``per_shard`` slots draws its sources independently by quota, so its counts are
    multinomial. Draws beyond a source's quota fall out; slots that no draw reached fill last shards.
    """
    held = settle(sources.where("quota > 0").select("s", "quota", "n_blocks", "len"))
    total, n = held.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count("*")).first()
    cells = max(64, n)
    # A source's part of [0, 1), once for each cell of a grid that it reaches: at most a row a source and one a cell.
    upto = F.sum("quota").over(Window.orderBy("s"))
    parts = held.withColumn("upto", upto).select("s", ((F.col("upto") - F.col("quota")) / total).alias("lo"), (F.col("upto") / total).alias("hi"))
    parts = settle(parts.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.floor(F.col("hi") * cells)))))
    drawn = spark.range(total).select("id", F.floor(F.col("id") / per_shard).alias("shard"), unit(F.lit(seed), F.col("id")).alias("u"))
    drawn = filter_keys(drawn.withColumn("cell", F.floor(F.col("u") * cells)), parts, ["cell"], "inner").where("u >= lo and u < hi")
    drawn = settle(drawn.select("id", "shard", "s"))
    counts = drawn.groupBy("s", "shard").agg(F.count("*").alias("n"))
    base = running(counts, ["s"], "shard", "n", "base").select("s", "shard", "base")
    # Within a shard the slots of a source go by their id: a shard is small, so its window is too.
    ranked = drawn.withColumn("r", F.row_number().over(Window.partitionBy("s", "shard").orderBy("id")) - 1)
    ranked = ranked.join(base, ["s", "shard"]).select("shard", "s", (F.col("base") + F.col("r")).alias("k"))
    ranked = filter_keys(ranked, held, ["s"], "inner").where("k < quota")
    short = held.join(counts.groupBy("s").agg(F.sum("n").alias("n")), "s", "left").where("coalesce(n, 0) < quota")
    short = short.select(F.explode(F.sequence(F.coalesce("n", F.lit(0)).cast("long"), F.col("quota") - 1)).alias("k"), "s", "quota", "n_blocks", "len")
    last = short.withColumn("shard", F.ceil(F.lit(total) / per_shard) + F.floor(F.col("k") / per_shard))
    return ranked.unionByName(last.select(*ranked.columns))


def permuted(k: Column, s: Column, n: Column, seed: int, rounds: int = ROUNDS) -> Column:
    """Block of slot ``k``: a pseudorandom permutation of 0..n-1 for each source and round of its blocks, for any n.

    Swap-or-not (Hoang, Morris and Rogaway 2012): each step pairs x with key - x modulo n and swaps the
    two or not by a bit hashed from the larger, so every step is a bijection. Nothing is multiplied, so
    nothing overflows up to n = 2^62.
    """
    turn = F.floor(k / n)

    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(seed), s, turn, r), n) - x, n)
        bit = F.xxhash64(F.lit(seed), F.lit("swap"), s, turn, r, F.greatest(x, other)).bitwiseAND(F.lit(1))
        return F.when(bit == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.pmod(k, n).cast("long"), swap)


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, block: int = 128, per_shard: int = 4096, per_chunk: int = 1000, seed: int = 7) -> DataFrame:
    """One row per input row and block of it that the mix takes: the row's ``doc_id, row, source, size,
    off`` (its first word's place in its source), its source's ``source_size, target``, and ``shard,
    turn`` (the round of the source's blocks, from 0), ``lo, hi`` (words of the row taken). Rows of
    which nothing is taken have null in the last four. ``row`` is ``row_col``, or a number of the row's own.
    """
    spark = docs.sparkSession
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    rows = docs.select(F.col(id_col).alias("doc_id"), row.cast("long").alias("row"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text_col).alias("tie"), F.size(words_of(text_of(text_col))).cast("long").alias("size"))
    rows = settle(rows)
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.ceil(F.count("*") / per_chunk).alias("chunks"))
    sources = settle(sources)
    named = targets(sources.drop("chunks"), weights, most).withColumnRenamed("source", "named")
    sources = settle(blocks_of(sources.select("source", "chunks").join(named, F.col("source").eqNullSafe(F.col("named"))).drop("named"), block))
    # Chunks hold some per_chunk rows of one source each. Null is told from text by a column of its own.
    named = [F.col("source").isNull().alias("unnamed"), F.coalesce("source", F.lit("")).alias("name")]
    info = settle(sources.select(*named, "s", "chunks"))
    laid = filter_keys(rows.select("*", *named), info, ["unnamed", "name"], "inner").withColumn("chunk", F.pmod(F.xxhash64("doc_id", "tie"), F.col("chunks")))
    part = settle(laid.groupBy("s", "chunk").agg(F.sum("size").alias("part")))
    begins = running(part, ["s"], "chunk", "part", "begin").select("s", "chunk", "begin")
    within = F.sum("size").over(Window.partitionBy("s", "chunk").orderBy("doc_id", "tie", "size", "row").rowsBetween(Window.unboundedPreceding, -1))
    laid = laid.withColumn("within", F.coalesce(within, F.lit(0))).join(begins, ["s", "chunk"])
    laid = filter_keys(laid, sources.select("s", "source_size", "target", "len"), ["s"], "inner")
    laid = laid.select("doc_id", "row", "source", "size", "source_size", "target", "s", "len", (F.col("begin") + F.col("within")).alias("off"))
    block_of = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("off") / F.col("len")), F.floor((F.col("off") + F.col("size") - 1) / F.col("len"))))
    cut = laid.withColumn("block", F.explode_outer(block_of))
    taken = slots(spark, sources, seed, per_shard).select("shard", "s", permuted(F.col("k"), F.col("s"), F.col("n_blocks"), seed).alias("block"), F.floor(F.col("k") / F.col("n_blocks")).alias("turn"))
    # Written, so that neither plan holds the other's windows and joins: the driver plans them anew after every stage.
    taken = settle(taken)
    lo = F.greatest(F.col("block") * F.col("len") - F.col("off"), F.lit(0))
    hi = F.least((F.col("block") + 1) * F.col("len") - F.col("off"), F.col("size"))
    out = cut.join(taken, ["s", "block"], "left")
    return out.select("doc_id", "row", "source", "size", "off", "source_size", "target", "shard", "turn", F.when(F.col("turn").isNotNull(), lo).alias("lo"), F.when(F.col("turn").isNotNull(), hi).alias("hi"))


def mix_counts(docs: DataFrame, **how) -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, taken`` (words taken, repeats counted).

    A row's size is its words; null and empty texts have none and give none. Null is a source of its
    own, numbered last. Sources' words form a stream in an order by hash of the id, cut into blocks; a
    source's full rounds take every block once, its last round a pseudorandom part, so no row gives
    more than ``most`` times its size. Repeated rows stand in the stream once each. An empty table, or
    one without words, takes nothing. Other columns are not looked at. Reruns give the same counts.
    """
    plan = mix_plan(docs, **how)
    return plan.groupBy("doc_id", "row", "source", "off", "size", "source_size", "target").agg(F.coalesce(F.sum(F.col("hi") - F.col("lo")), F.lit(0)).cast("long").alias("taken")).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str = "n_chars", **how) -> DataFrame:
    """The mix as documents with the columns of ``docs``: one row per input row and round that takes words of it.

    A round that takes all words of a row gives its text unchanged; one that takes part gives the
    words taken, each with the white space before it. ``length_col``, if there, is set anew. Rows are numbered
    first, so rows of equal or null id are told apart: each comes as often as rounds take words of it, so ids
    repeat. Texts without words give no row; an empty table gives none.
    """
    rows = numbered(docs, ROW)
    plan = mix_plan(rows, id_col, text_col, source_col, ROW, **how).where("hi > lo")
    rounds = plan.groupBy("row", "turn", "size").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"), F.sum(F.col("hi") - F.col("lo")).alias("n"))
    rounds = rounds.select(F.col("row").alias(ROW), F.when(F.col("n") < F.col("size"), F.col("spans")).alias(SPANS))
    df = rows.join(rounds, ROW)
    pieces = F.regexp_extract_all(text_col, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    part = F.array_join(F.flatten(F.transform(SPANS, lambda x: F.slice(pieces, (x["lo"] + 1).cast("int"), (x["hi"] - x["lo"]).cast("int")))), "")
    text = F.when(F.col(SPANS).isNull(), F.col(text_col)).otherwise(part)
    df = df.withColumn(text_col, text)
    if length_col in docs.columns:
        df = df.withColumn(length_col, F.char_length(text_col).cast(dict(docs.dtypes)[length_col]))
    return df.select(*docs.columns)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
