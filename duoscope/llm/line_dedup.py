"""Lines that many documents repeat: counted by digest, dropped from all but one, texts put together by position. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, ROW, UPPER, ascii_lower, attach, numbered, settle, text_of
from .exact_dedup import content_hash

BLANKS = " \t\n\x0b\x0c\r"
#: Bytes up to which a table of keys or of positions is broadcast.
HELD = 32 << 20


def keys_of(text: Column) -> Column:
    """The keys of a text's lines in order: blanks stripped at both ends, A-Z lowered."""
    return F.transform(F.split(ascii_lower(text), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)))


def repeated_keys(rows: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """``h, group_size, keep_id``: digests of long keys that at least ``min_docs`` rows hold, and the largest id of those.

    A row counts once however often it holds a key, since its keys are made distinct before they are hashed; counts
    are summed before the shuffle, so a line of a third of all documents is a row per task.
    """
    long = F.array_distinct(F.filter(keys_of(F.col("text")), lambda k: F.char_length(k) >= min_chars))
    held = rows.select("doc_id", F.explode(long).alias("key")).select("doc_id", content_hash(F.col("key")).alias("h"))
    return held.groupBy("h").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id")).where(F.col("group_size") >= min_docs)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """One row per input row: ``row, doc_id, n_lines, n_dropped, kept_text``.

    Lines end at ``\\n`` alone. A key of at least ``min_chars`` code points that at least ``min_docs`` rows hold loses
    all its lines, except in the rows of the largest id that holds it. Null text counts as empty, and an empty text is
    one empty line, which stays. Every row is a document of its own: rows that repeat an id count one by one, and all
    rows of the largest id keep a line. A null id is below all others; where only null ids hold a key its lines stay.
    A text that loses all lines becomes empty. An empty table gives an empty result. Other columns are not looked at;
    one named ``__row__`` does not clash.

    A first pass counts digests; a second finds the places of lines that go. Repeated keys are broadcast while they
    have at most 32 MB. Past that, the places of a key in one row are brought together, so that a row weighs one, and
    keys that hold a thousandth of the rows or more, of which there are few, are joined apart from all others.
    Texts move only where the places that go exceed 32 MB too.
    """
    rows = numbered(docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")))
    repeated = settle(repeated_keys(rows, min_chars, min_docs))
    lines = rows.select("doc_id", ROW, F.posexplode(keys_of(F.col("text"))).alias("pos", "key")).where(F.char_length("key") >= min_chars)
    lines = lines.select("doc_id", ROW, "pos", content_hash(F.col("key")).alias("h"))
    goes = ~F.col("doc_id").eqNullSafe(F.col("keep_id"))
    if repeated.count() * 64 <= HELD:
        places = lines.join(F.broadcast(repeated), "h").where(goes).groupBy(ROW).agg(F.collect_list("pos").alias("places"))
    else:
        held = settle(lines.groupBy(ROW, "doc_id", "h").agg(F.collect_list("pos").alias("places")))
        met = attach(held, repeated, "h", held.count()).where(F.col("group_size").isNotNull() & goes)
        places = met.groupBy(ROW).agg(F.flatten(F.collect_list("places")).alias("places"))
    places = settle(places)
    size = places.agg(F.coalesce(F.sum(64 + 4 * F.size("places")), F.lit(0))).first()[0]
    found = rows.join(F.broadcast(places) if size <= HELD else places, ROW, "left")
    found = found.select(F.col(ROW).alias("row"), "doc_id", "text", F.split("text", "\n").alias("lines"), "places")
    at = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("places"))
    kept = F.when(F.col("places").isNull(), F.col("text")).otherwise(F.array_join(F.transform(at, lambda i: F.get("lines", i)), "\n"))
    return found.select("row", "doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
li AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
ke AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k FROM li),
co AS (SELECT k, max(doc_id) AS keep_id FROM ke WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
fl AS (SELECT ke.*, coalesce(ke.doc_id <> co.keep_id, false) AS goes FROM ke LEFT JOIN co USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT goes), '')) AS kept_sha256
FROM fl GROUP BY doc_id
"""
