"""Readers and writers of the domain's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Separators that are told apart, the commonest first.
SEPARATORS = ("\t", ",", ";", "|", " ")


def separators(spark: SparkSession, path: str) -> DataFrame:
    """``file, header, sep``: the first line of each file under ``path``, and what it is cut by.

    The separator that the header holds most often counts, the earlier of equals; a header without any is one column.
    Only first lines are gathered, one a file, from the files' first splits; gzipped files are read as they are.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), "value").where("_at = 0 and value <> ''")
    heads = lines.withColumn("_id", F.monotonically_increasing_id()).groupBy("file").agg(F.min_by("value", "_id").alias("header"))
    often = F.array(*[F.struct((F.length("header") - F.length(F.replace("header", F.lit(x)))).alias("n"), F.lit(-k).alias("first"), F.lit(x).alias("sep")) for k, x in enumerate(SEPARATORS)])
    return heads.select("file", "header", F.array_max(often)["sep"].alias("sep"))


def read_sniffed(spark: SparkSession, path: str, id_col: str, schema: StructType | str) -> DataFrame:
    """Delimited files under ``path``, each with a header and a separator of its own, as the columns of ``schema`` in order.

    Files are read once per separator found, of which there are five at most. Columns are found by name, so files may
    have them in any order, lack some (null) or have more; a file without ``id_col`` is an error.
    """
    want = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    found = separators(spark, path)
    kinds = found.groupBy("header", "sep").agg(F.collect_list("file").alias("files")).collect()
    parts = []
    for sep in {r["sep"] for r in kinds}:
        # Files of one header are read together: a reader takes one header for all its files.
        for r in [r for r in kinds if r["sep"] == sep]:
            names = [c.strip().strip('"') for c in r["header"].split(sep)]
            if id_col not in names:
                raise ValueError(f"no column {id_col!r} in {r['files'][0]}")
            raw = spark.read.option("header", True).option("sep", sep).schema(", ".join(f"`{c}` string" for c in names)).csv(r["files"])
            parts.append(raw.select(*[(F.col(f"`{f.name}`") if f.name in names else F.lit(None)).try_cast(f.dataType).alias(f.name) for f in want.fields]))
    return union_by_name(parts) if parts else spark.createDataFrame([], want)


def read_pairs(spark: SparkSession, path: str, id_col: str, schema: StructType | str | None = None, sep: str = "\t") -> DataFrame:
    """A delimited pair table; gzipped files are read as they are. The id column must be there."""
    reader = spark.read.option("header", True).option("sep", sep)
    df = (reader.schema(schema) if schema else reader).csv(path)
    if id_col not in df.columns:
        raise ValueError(f"no column {id_col!r}")
    return df


def read_metrics(spark: SparkSession, path: str, sources: list[str], columns: list[str]) -> DataFrame:
    """A combined Parquet table, pruned to columns and sources before it is read."""
    return spark.read.parquet(path).where(F.col("source").isin(*sources)).select(*columns)


def read_by_chromosome(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A folder of files or folders per chromosome; the chromosome comes from the name of the file, or of its folder."""
    return spark.read.schema(schema).option("header", True).csv(path).withColumn("chrom", F.regexp_extract(F.input_file_name(), r"chr([0-9XYM]+)[^/]*(?:/[^/]*)?$", 1))


def write_by_source(df: DataFrame, path: str) -> None:
    df.write.partitionBy("source").mode("overwrite").parquet(path)


def write_combined(df: DataFrame, path: str, id_col: str, light: list[str]) -> None:
    """Three tables under ``path``: a folder of TSV per source, all rows as one TSV table, and a light one of ids.

    The light table has ``source``, ``id_col`` and the columns of ``light``.
    """
    df.write.partitionBy("source").mode("overwrite").option("header", True).option("sep", "\t").csv(f"{path}/by_source")
    df.write.mode("overwrite").option("header", True).option("sep", "\t").option("compression", "gzip").csv(f"{path}/combined")
    df.select("source", id_col, *light).write.mode("overwrite").parquet(f"{path}/ids")


def aligned(df: DataFrame, schema: StructType) -> DataFrame:
    """The columns of ``schema`` in order, nulls for what ``df`` lacks."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def ordered_pairs(df: DataFrame, pos1: str = "pos1", pos2: str = "pos2") -> DataFrame:
    """Swaps every pair of columns that differ by 1 and 2 in their name where the positions are out of order."""
    names = set(df.columns)
    partner: dict[str, str] = {}
    for c in df.columns:
        for k, ch in enumerate(c):
            if ch == "1" and (other := c[:k] + "2" + c[k + 1 :]) in names:
                partner |= {c: other, other: c}
    swap = F.col(pos1) > F.col(pos2)
    return df.select(*[F.when(swap, F.col(partner[c])).otherwise(F.col(c)).alias(c) if c in partner else F.col(c) for c in df.columns])


def repaired_alleles(df: DataFrame, bases: DataFrame) -> DataFrame:
    """``df`` (chrom, pos, ref, alt) against reference bases (chrom, pos, base): adds ``status``, alleles repaired.

    As many reference bases from ``pos`` on as the ``ref`` allele has are held against it. A mismatch is tried
    as swapped alleles first, then, for a single base, as the other strand. An insertion, whose ``ref`` is
    ``-`` or empty, has nothing to hold against and passes; where a base is not known nothing is said.
    """
    from ..functions.identifiers import complement

    asked = df.select("chrom", "pos", F.greatest(F.length("ref"), F.lit(1)).alias("_n")).groupBy("chrom", "pos").agg(F.max("_n").alias("_n"))
    asked = asked.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).select("chrom", F.col("pos").alias("_at"), "_k", (F.col("pos") + F.col("_k")).alias("pos"))
    seen = asked.join(bases.where("base is not null"), ["chrom", "pos"]).groupBy("chrom", "_at").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_k", "base"))), lambda x: x["base"]), "").alias("_ref"), F.min("_k").alias("_first"))
    seen = seen.where("_first = 0").select("chrom", F.col("_at").alias("pos"), "_ref")
    j = df.join(seen, ["chrom", "pos"], "left")
    actual = F.substring(F.col("_ref"), F.lit(1), F.length("ref"))
    other = (F.length("ref") == 1) & (complement(F.col("ref")) == actual)
    short = F.col("_ref").isNull() | (F.length("_ref") < F.length("ref"))
    status = F.when(F.col("ref").isin("-", ""), "match").when(short, "unknown").when(F.col("ref") == actual, "match").when(F.col("alt") == actual, "swapped").when(other, "complement").otherwise("unresolved")
    j = j.withColumn("status", status)

    def by(same: Column, swapped: Column, other: Column) -> Column:
        return F.when(F.col("status") == "swapped", swapped).when(F.col("status") == "complement", other).otherwise(same)

    return j.select(*[c for c in df.columns if c not in ("ref", "alt")], by(F.col("ref"), F.col("alt"), complement(F.col("ref"))).alias("ref"), by(F.col("alt"), F.col("ref"), F.when(F.length("alt") == 1, complement(F.col("alt"))).otherwise(F.col("alt"))).alias("alt"), "status")


def write_sheets(df: DataFrame, path: str) -> None:
    """One folder of metrics per model."""
    df.write.partitionBy("model").mode("overwrite").parquet(path)
