"""Near-duplicates by the Jaccard similarity of shingle sets: SimHash and min-hash bands name candidates, every link is verified."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, filter_keys, settle, text_of
from .components import connected_components
from .simhash import fingerprint, linked

#: Bands of min-hashes and hashes in a band: of pairs at similarity 0.8, 1 - (1 - 0.8^5)^30 meet, all but 7 in a million.
BANDS, DEEP = 30, 5


def shingles(text: str, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; a shorter text is one shingle, one of no words has none."""
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(line, 42)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-k] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], 42) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], dtype=np.uint64))


def name_of(hashes: np.ndarray) -> int:
    """64-bit name of a shingle set."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


@lru_cache(maxsize=1)
def factors() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(7)
    return tuple(r.integers(0, 1 << 63, BANDS * DEEP, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of a set's min-hashes."""
    a, b = factors()
    least = np.full(len(a), np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[at : at + 2048] * a[:, None]).min(axis=1), out=least)
    mixed = (least ^ least >> np.uint64(31)) * b
    mixed ^= mixed >> np.uint64(29)
    keys = (mixed.reshape(BANDS, DEEP) * b[:DEEP]).sum(axis=1, dtype=np.uint64) + b[:BANDS] * np.arange(BANDS, dtype=np.uint64)
    return (keys ^ keys >> np.uint64(32)).view(np.int64)


def links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph that joins all pairs at ``similarity`` or more.

    Each set, from the first, takes the ones similar to it that nothing has taken yet, so near copies
    of one text cost one pass.
    """
    size = np.array([len(x) for x in sets], dtype=np.int64)
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    begin = np.cumsum(size) - size
    out: list[tuple[int, int]] = []
    rest, waiting = np.arange(len(sets)), []
    held = np.zeros(int(token.max()) + 1 if len(token) else 1, dtype=bool)
    flat, edge = token, begin  # tokens of the sets in `rest`
    while len(rest) or waiting:
        if not waiting:
            waiting, keep = [int(rest[0])], np.arange(len(rest)) > 0
        else:
            if not len(rest):
                break
            at = waiting.pop()
            own = token[begin[at] : begin[at] + size[at]]
            held[own] = True
            common = np.add.reduceat(held[flat], edge, dtype=np.int64)
            held[own] = False
            near = common >= similarity * (size[at] + size[rest] - common) - 1e-9
            keep = ~near
            out += [(at, int(x)) for x in rest[near]]
            waiting += rest[near].tolist()
        if not keep.all():
            flat = flat[np.repeat(keep, size[rest])]
            rest = rest[keep]
            edge = np.cumsum(size[rest]) - size[rest]
    return out


def by_fingerprint(prints: DataFrame) -> DataFrame:
    """``a, b``: sets ``f`` whose SimHash fingerprints ``p`` lie within 4 bits, held together by one set a fingerprint."""
    first = settle(prints.groupBy("p").agg(F.min("f").alias("m"), F.count("*").alias("group_size")))
    same = attach(prints, first, "p", prints.count()).where("m <> f").select(F.col("f").alias("a"), F.col("m").alias("b"))
    one, two = (first.select(F.col("p").alias(c), F.col("m").alias(f"_{c}")) for c in ("a", "b"))
    apart = linked(first.select(F.col("p").alias("f"))).join(one, "a").join(two, "b")
    return same.unionByName(apart.select(F.col("_a").alias("a"), F.col("_b").alias("b")))


def candidates(keys: DataFrame, prints: DataFrame | None = None) -> DataFrame:
    """``f, root``: components of the sets ``f`` that share a ``key`` or have near fingerprints; all others are left out."""
    shared = settle(keys.groupBy("key").agg(F.count("*").alias("group_size"), F.min("f").alias("m")).where("group_size > 1"))
    met = attach(keys, shared, "key", keys.count()).where("m <> f").select(F.col("f").alias("a"), F.col("m").alias("b"))
    met = (met if prints is None else met.unionByName(by_fingerprint(prints))).distinct()
    return settle(connected_components(settle(met)).withColumnRenamed("node", "f"))


def verified(sets: DataFrame, similarity: float, most: int) -> DataFrame:
    """``a, b``: links that hold together all sets ``f, root, s`` of one ``root`` at ``similarity`` or more.

    A component with over ``most`` shingles is split: its blocks meet in pairs, in tasks of their own.
    """

    def forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found(f: list[int], s: list[np.ndarray]) -> pd.DataFrame:
            pairs = np.array(links(s, similarity), dtype=np.int64).reshape(-1, 2)
            names = np.array(f, dtype=np.int64)
            return pd.DataFrame({"a": names[pairs[:, 0]], "b": names[pairs[:, 1]]})

        key, f, s = None, [], []
        for b in batches:
            for k, one, shingle in zip(b["key"], b["f"], b["s"], strict=True):
                if k != key:
                    if len(f) > 1:
                        yield found(f, s)
                    key, f, s = k, [], []
                f.append(one)
                s.append(np.asarray(shingle, dtype=np.int64))
        if len(f) > 1:
            yield found(f, s)

    sized = settle(sets.groupBy("root").agg(F.count("*").alias("group_size"), F.ceil(F.sum(F.size("s")) / most).alias("blocks")))
    last = F.greatest(F.col("blocks"), F.lit(1)) - 1
    own = F.pmod(F.xxhash64("f"), last + 1)
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), last), lambda x: F.concat_ws(":", F.col("root"), F.least(x, own), F.greatest(x, own))))
    dealt = attach(sets, sized, "root", sets.count()).select(F.explode(pairs).alias("key"), "f", "s")
    return dealt.repartition("key").sortWithinPartitions("key").mapInPandas(forest, "a long, b long").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, most: int = 1 << 21) -> DataFrame:
    """One row per input row: ``doc_id, component_id``, the smallest id reachable by similar texts.

    Texts are similar if their sets of ``shingle``-word shingles (A-Z lowered) have Jaccard similarity
    ``similarity`` or more. Sets whose SimHash fingerprints (of four-word shingles, as in ``op3``) lie within 4 bits
    are gathered with those that share a band of min-hashes, since fingerprints near similarity 0.8 mostly differ in
    more bits. All pairs among those gathered are held against the similarity itself, so no link is false; a pair is
    missed only if it shares neither, by itself or through others. Null, empty and blank texts are similar to each other.
    Repeated rows get rows of their own; null ids take part and never name a component that has another
    id. An empty table gives none. Other columns are not looked at.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).withColumn("h", F.xxhash64("text"))

    def banded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingles(t, shingle) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "h": b["h"], "f": [name_of(x) for x in sets], "p": np.array([fingerprint(t, 4) for t in b["text"]], dtype=np.uint64).view(np.int64), "keys": [band_keys(x) if len(x) else np.empty(0, np.int64) for x in sets]})

    rows = settle(given.mapInPandas(banded, "doc_id long, h long, f long, p long, keys array<long>"))
    groups = settle(rows.groupBy("f").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("group_size"), F.min("h").alias("h"), F.first("keys").alias("keys")))
    near = candidates(settle(groups.select(F.explode("keys").alias("key"), "f")), settle(rows.select("f", "p").distinct()))
    asked = settle(groups.select("f", "h").join(near, "f"))

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingles(t, shingle) for t in b["text"]]
            yield pd.DataFrame({"f": [name_of(x) for x in sets], "s": [x.view(np.int64) for x in sets]})

    # Texts of one hash are equal but for collisions, and the name made anew tells those apart.
    texts = filter_keys(given, asked.select("h").distinct(), ["h"], "left_semi").select("text")
    sets = settle(texts.mapInPandas(again, "f long, s array<long>").dropDuplicates(["f"]))
    sets = settle(sets.join(asked.select("f", "root"), "f"))
    roots = settle(connected_components(verified(sets, similarity, most)).withColumnRenamed("node", "f"))
    named = settle(groups.drop("keys").join(roots, "f", "left").withColumn("root", F.coalesce("root", "f")))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("of_root"))
    sized = attach(named, settle(smallest), "root", named.count(), weight="of_root").select("f", "group_size", "component_id")
    return attach(rows.select("doc_id", "f"), settle(sized), "f", rows.count()).select("doc_id", "component_id")
