"""Ranked lexical search of many items at once: shared term sets are mined, their accumulators made once and combined."""

from __future__ import annotations

import hashlib
import math
import pickle
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, ROW, UPPER, numbered, settle

#: ASCII letters lowered, digits and all bytes of other characters kept, everything else a blank.
TERM_BYTES = bytes(ord(chr(b).lower()) if chr(b).isalnum() and b < 128 else b if b >= 128 else 32 for b in range(256))
#: Bounds of a block of items: items, and the sum of their squared numbers of terms (what mining pairs costs).
BLOCK_ITEMS, BLOCK_PAIRS = 256, 2_000_000
#: Items that must share a pair of sets before it is one node: with two, as many additions are made as saved.
SHARED = 3
#: Documents that are scored at once.
DOCS = 1024


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all non-ASCII characters, only A-Z lowered; null has none."""
    return text.encode().translate(TERM_BYTES).split() if text else []


@dataclass
class Plan:
    """How a block of items is evaluated.

    ``sets`` maps a term to its set, a set being all terms that occur in the same items equally often; sets are nodes
    ``0 .. n_sets - 1``. ``joins`` are further nodes, each the sum of two earlier ``(node, times)``. An item is the sum
    of the ``(node, times)`` in ``items``.
    """

    sets: dict[bytes, int]
    n_sets: int
    joins: list[tuple[tuple[int, int], tuple[int, int]]]
    items: list[list[tuple[int, int]]]


def mine(queries: list[dict[bytes, int]]) -> Plan:
    """A query-sharing graph of a block's items, given as terms and how often each occurs.

    Terms of equal use become one set. Then, round by round, the pairs of nodes that most items share are joined to
    one node wherever both stand, until no pair is shared by ``SHARED`` items.
    """
    uses: dict[bytes, list[tuple[int, int]]] = {}
    for q, terms in enumerate(queries):
        for t, n in terms.items():
            uses.setdefault(t, []).append((q, n))
    number: dict[tuple, int] = {}
    sets = {t: number.setdefault(tuple(u), len(number)) for t, u in sorted(uses.items())}
    items: list[set[tuple[int, int]]] = [set() for _ in queries]
    for use, s in number.items():
        for q, n in use:
            items[q].add((s, n))
    joins: list[tuple[tuple[int, int], tuple[int, int]]] = []
    while True:
        seen = Counter(p for i in items for p in combinations(sorted(i), 2))
        often = sorted((p for p, n in seen.items() if n >= SHARED), key=lambda p: (-seen[p], p))
        if not often:
            break
        taken: set[tuple[int, int]] = set()
        for a, b in often:
            if a in taken or b in taken:
                continue
            taken |= {a, b}
            node = (len(number) + len(joins), 1)
            joins.append((a, b))
            for i in items:
                if a in i and b in i:
                    i -= {a, b}
                    i.add(node)
    return Plan(sets, len(number), joins, [sorted(i) for i in items])


def blocks(rows: Iterable[tuple[bytes, dict[bytes, int]]]) -> Iterator[tuple[list[bytes], Plan]]:
    """Plans of consecutive items, cut where a block is full."""
    names: list[bytes] = []
    queries: list[dict[bytes, int]] = []
    cost = 0
    for name, terms in rows:
        more = len(terms) ** 2
        if queries and (len(queries) == BLOCK_ITEMS or cost + more > BLOCK_PAIRS):
            yield names, mine(queries)
            names, queries, cost = [], [], 0
        names.append(name)
        queries.append(terms)
        cost += more
    if queries:
        yield names, mine(queries)


def evaluate(plan: Plan, at: np.ndarray, doc: np.ndarray, gain: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Scores of ``n`` documents for each item in turn, from occurrences: set ``at``, document, gain.

    A set's accumulator is filled once, a join's is made once from its two nodes, and items only add nodes up.
    """
    acc = np.zeros((plan.n_sets + len(plan.joins), n), dtype=np.int64)
    np.add.at(acc, (at, doc), gain)
    for k, ((a, x), (b, y)) in enumerate(plan.joins):
        acc[plan.n_sets + k] = acc[a] * x + acc[b] * y
    for item in plan.items:
        score = np.zeros(n, dtype=np.int64)
        for node, times in item:
            score += acc[node] if times == 1 else acc[node] * times
        yield score


class Best:
    """The first ``k`` documents so far of every item: highest score, then least id (null last), then row."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.rows: dict[tuple[int, int], np.ndarray] = {}

    def add(self, key: tuple[int, int], score: np.ndarray, none: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        old = self.rows.get(key)
        least = 1 if old is None or len(old) < self.k else old[-1, 0]
        hit = np.flatnonzero(score >= least)
        if len(hit) > self.k:
            cut = np.partition(score[hit], len(hit) - self.k)[len(hit) - self.k]
            hit = hit[score[hit] >= cut]
        if len(hit):
            new = np.column_stack([score[hit], none[hit], ids[hit], rows[hit]])
            both = new if old is None else np.concatenate([old, new])
            self.rows[key] = both[np.lexsort((both[:, 3], both[:, 2], both[:, 1], -both[:, 0]))[: self.k]]


def planned(items: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``item_row, item_id, sig`` of items with terms, and ``block, names, plan`` of their distinct term multisets.

    Items of equal terms are one query. Queries lie in order of the least hash of their terms, so those that share
    many are likely neighbours, and are cut into blocks where they lie.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [sorted(Counter(terms_of(t)).items()) for t in b["text"]]
            sig = [hashlib.blake2b(repr(f).encode(), digest_size=16).digest() for f in found]
            near = [min((int.from_bytes(hashlib.blake2b(t, digest_size=7).digest()) for t, _ in f), default=0) for f in found]
            out = pd.DataFrame({"item_row": b[ROW], "item_id": b["id"], "sig": sig, "near": near, "terms": [[t for t, _ in f] for f in found], "times": [[n for _, n in f] for f in found]})
            yield out[[bool(f) for f in found]]

    given = numbered(items.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")))
    kind = dict(given.dtypes)["id"]
    parsed = settle(given.mapInPandas(read, f"item_row long, item_id {kind}, sig binary, near long, terms array<binary>, times array<int>"))
    distinct = parsed.groupBy("sig").agg(F.first("near").alias("near"), F.first("terms").alias("terms"), F.first("times").alias("times"))

    def plans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = ((s, dict(zip(map(bytes, t), map(int, n), strict=True))) for b in batches for s, t, n in zip(b["sig"], b["terms"], b["times"], strict=True))
        for names, plan in blocks(rows):
            yield pd.DataFrame({"names": [[bytes(x) for x in names]], "plan": [pickle.dumps(plan, protocol=5)]})

    laid = distinct.repartitionByRange("near", "sig").sortWithinPartitions("near", "sig")
    made = settle(laid.mapInPandas(plans, "names array<binary>, plan binary"))
    return parsed.select("item_row", "item_id", "sig"), numbered(made, "block")


def postings(rows: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``row, id, n, terms, times``: each document's number of terms, and those of the vocabulary by number with their counts."""
    held = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = held.value
        for b in batches:
            sizes, terms, times = [], [], []
            for text in b["text"]:
                found = terms_of(text)
                sizes.append(len(found))
                few = [(known[t], n) for t, n in Counter(found).items() if t in known]
                terms.append([t for t, _ in few])
                times.append([n for _, n in few])
            yield pd.DataFrame({"row": b[ROW], "id": b["id"], "n": sizes, "terms": terms, "times": times})

    return settle(rows.mapInPandas(read, "row long, id long, n long, terms array<int>, times array<int>"))


def scores(posts: DataFrame, plans: list[tuple[int, Plan]], vocabulary: dict[bytes, int], df: dict[int, int], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``block, item, score, id, row``: every task's first ``k`` documents of each item of the plans."""
    weights = np.zeros(len(vocabulary), dtype=np.int64)
    for t, d in df.items():
        weights[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1)))
    by_plan = []
    for block, plan in plans:
        of = np.full(len(vocabulary), -1, dtype=np.int64)
        for t, s in plan.sets.items():
            of[vocabulary[t]] = s
        by_plan.append((block, of, Plan({}, plan.n_sets, plan.joins, plan.items)))
    held = posts.sparkSession.sparkContext.broadcast((weights, by_plan))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, block_plans = held.value
        best = Best(k)
        for b in batches:
            for lo in range(0, len(b), DOCS):
                part = b.iloc[lo : lo + DOCS]
                sizes = np.array([len(t) for t in part["terms"]])
                doc = np.repeat(np.arange(len(part)), sizes)
                term = np.concatenate([np.asarray(t, dtype=np.int64) for t in part["terms"]])
                tf = np.concatenate([np.asarray(t, dtype=np.int64) for t in part["times"]])
                m = np.array([25 + 75 * int(n) * n_docs // n_terms for n in part["n"]], dtype=np.int64)
                gain = w[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
                none = part["id"].isna().to_numpy().astype(np.int64)
                ids, rows = part["id"].fillna(0).to_numpy().astype(np.int64), part["row"].to_numpy()
                for block, of, plan in block_plans:
                    at = of[term]
                    on = at >= 0
                    for item, score in enumerate(evaluate(plan, at[on], doc[on], gain[on], len(part))):
                        best.add((block, item), score, none, ids, rows)
        for (block, item), rows in best.rows.items():
            ids = pd.array(rows[:, 2], dtype="Int64")
            ids[rows[:, 1] == 1] = pd.NA
            yield pd.DataFrame({"block": block, "item": item, "score": rows[:, 0], "id": ids, "row": rows[:, 3]})

    return posts.where(F.size("terms") > 0).mapInPandas(run, "block long, item int, score long, id long, row long")


def lexical_search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 10, plan_bytes: int = 16 << 20) -> DataFrame:
    """``item_row, item_id, rank, doc_id, score, doc_row``: every item's ``k`` highest-scoring documents with a score above 0.

    Terms are maximal runs of ASCII letters and digits and non-ASCII characters, A-Z lowered. A document's score is
    the sum over the item's terms, repeats included, of ``w * ((10^9 tf) div (1000 tf + 8 m))`` with ``w = floor(1000
    ln((2N + 2) / (2 df + 1)))`` and ``m = 25 + (75 n N) div L``: N documents with terms, L their terms, n this one's.

    Null and empty texts have no terms: such documents count nowhere, such items have no rows. Documents of equal
    score go by id, null last, then by the row's number; rows that repeat an id are documents of their own, and items
    that repeat an id or a text each have rows (``item_row`` tells them apart). Document ids are whole numbers. Empty
    tables give an empty result. Other columns are not looked at.

    Whole texts are read once for every ``plan_bytes`` of plans, which is what the driver and a broadcast hold of the
    items at a time; of documents only their terms in the plans' vocabulary are kept. A task keeps ``k`` rows an item.
    """
    spark = docs.sparkSession
    members, plans = planned(items, item_id, item_text)
    rows = numbered(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(doc_text).cast("string").alias("text")))
    sizes = plans.select("block", F.length("plan").alias("bytes")).orderBy("block").toLocalIterator()
    groups: list[list[int]] = []
    room = 0
    for r in sizes:
        if not groups or r["bytes"] > room:
            groups.append([])
            room = plan_bytes
        groups[-1].append(r["block"])
        room -= r["bytes"]
    found = None
    for g in groups:
        taken = [(r["block"], pickle.loads(r["plan"])) for r in plans.where(F.col("block").isin(g)).collect()]
        vocabulary = {t: j for j, t in enumerate(sorted({t for _, p in taken for t in p.sets}))}
        posts = postings(rows, vocabulary)
        whole = posts.agg(F.count(F.when(F.col("n") > 0, 1)).alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_terms")).first()
        if not whole["n_docs"]:
            break
        df = {r["t"]: r["count"] for r in posts.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}
        out = settle(scores(posts, taken, vocabulary, df, whole["n_docs"], whole["n_terms"], k))
        found = out if found is None else found.unionByName(out)
    if found is None:
        found = spark.createDataFrame([], "block long, item int, score long, id long, row long")
    w = Window.partitionBy("block", "item").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    first = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    names = plans.select("block", F.posexplode("names").alias("item", "sig"))
    out = first.join(names, ["block", "item"]).join(members, "sig")
    return out.select("item_row", "item_id", "rank", F.col("id").alias("doc_id"), "score", F.col("row").alias("doc_row"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return lexical_search(docs, items).select("item_id", "rank", "doc_id", "score")


TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH q AS (SELECT item_id, unnest({TERMS}) AS t FROM benchmark), qt AS (SELECT item_id, t, count(*) AS r FROM q GROUP BY ALL), vo AS (SELECT DISTINCT t FROM q),
d AS (SELECT doc_id, {TERMS} AS ts FROM documents), z AS (SELECT doc_id, len(ts) AS n, ts FROM d WHERE len(ts) > 0), a AS (SELECT count(*) AS nd, sum(n)::BIGINT AS nt FROM z),
o AS (SELECT doc_id, n, unnest(ts) AS t FROM z), tf AS (SELECT doc_id, n, t, count(*) AS tf FROM o SEMI JOIN vo USING (t) GROUP BY ALL), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
g AS (SELECT doc_id, t, floor(1000*ln((2*nd + 2)/(2*df + 1)::DOUBLE))::BIGINT * ((1000000000*tf) // (1000*tf + 8*(25 + (75*n*nd) // nt))) AS gain FROM tf JOIN df USING (t), a),
s AS (SELECT item_id, doc_id, sum(r*gain)::BIGINT AS score FROM qt JOIN g USING (t) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
