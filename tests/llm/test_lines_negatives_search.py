"""Line dedup, hard negatives and lexical search against brute force and awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from duoscope.llm import hard_negatives as hn
from duoscope.llm import lexical_search as ls
from duoscope.llm import line_dedup as ld

LINES = "row long, doc_id long, text string, h string, key string, keep_id long"


def lines_by_hand(docs, min_chars=20, min_docs=3):
    strip = " \t\n\x0b\x0c\r"
    lower = str.maketrans(ld.UPPER, ld.LOWER)
    keys = [[x.strip(strip).translate(lower) for x in (t or "").split("\n")] for _, t in docs]
    held = Counter(k for ks in keys for k in set(ks) if len(k) >= min_chars)
    rank = lambda i: (i is not None, i or 0)
    keep = {k: max((d[0] for d, ks in zip(docs, keys) if k in ks), key=rank) for k, n in held.items() if n >= min_docs}
    out = []
    for (i, t), ks in zip(docs, keys):
        lines = (t or "").split("\n")
        stay = [x for x, k in zip(lines, ks) if k not in keep or keep[k] == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(map(repr, out))


def long(k):
    return f"A shared LINE of text number {k}"


AWKWARD = [
    (1, None), (2, ""), (3, "\n\n"), (4, f"x\n{long(1)}\ny"), (5, f"  {long(1).upper()}\t\r\n{long(1)}"), (6, f"\x0b{long(1).lower()}\n"), (7, long(2)), (7, long(2)), (8, long(2)),
    (None, long(1)), (None, None), (9, "short\nshort"), (10, "short"), (11, "short"), (12, "é" * 20), (13, "é" * 20 + "\n"), (14, "É" * 20 + "\n" + "é" * 20), (15, "\n".join(long(k % 50) for k in range(3000))), (16, long(3) + " " + long(3)),
]


@pytest.mark.parametrize("held", [ld.HELD, 0])
def test_lines_as_by_hand(spark, monkeypatch, held):
    monkeypatch.setattr(ld, "HELD", held)
    rng = random.Random(5)
    docs = AWKWARD + [(100 + k, "\n".join(long(rng.randrange(40)) if rng.random() < 0.7 else f"own line {k} {j} of this text" for j in range(rng.randrange(12)))) for k in range(60)]
    df = spark.createDataFrame([(7, i, t, "h", "key", 1) for i, t in docs], LINES).repartition(5)
    got = ld.line_dedup(df).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert sorted(repr(tuple(r)) for r in got) == lines_by_hand(docs)


def test_no_lines(spark):
    assert ld.line_dedup(spark.createDataFrame([], LINES)).collect() == []


def negatives_by_hand(rows, anchors, n_pos=5, n_neg=10):
    rows = [(i, lab, np.floor(256 * np.asarray(v, float))) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, lab, q) in enumerate(rows):
        if not anchors(i):
            continue
        seen = [(-int(q @ v), j, b, m == lab) for b, (j, m, v) in enumerate(rows) if b != a and len(v) == len(q)]
        for s, j, _, _ in sorted(x for x in seen if x[3])[:n_pos]:
            far = sorted((x, k) for x, k, _, same in seen if not same and 30 * -s <= 100 * -x <= 90 * -s)[:n_neg]
            out += [(i, j, r + 1, k, -s, -x) for r, (x, k) in enumerate(far)]
    return sorted(out)


VECTORS = "vec_id long, label int, embedding array<float>, id string, v int, dim string"


def vectors(seed, n, d=6, copies=0):
    rng = np.random.default_rng(seed)
    made = [(k, int(rng.integers(0, 4)), [float(x) for x in rng.normal(size=d).astype(np.float32)]) for k in range(n)]
    return made + [(n + k, int(rng.integers(0, 4)), made[0][2]) for k in range(copies)]


@pytest.mark.parametrize("per_shard, wave_bytes", [(8192, 16 << 20), (60, 5000)])
def test_negatives_as_by_hand(spark, per_shard, wave_bytes):
    rows = vectors(1, 300, copies=150)
    rows += [(900, None, [0.0] * 6), (901, 1, None), (902, 1, [0.0, None, 0.0, 0.0, 0.0, 0.0]), (903, 1, [math.nan] * 6), (904, 2, [math.inf] + [0.0] * 5), (None, 1, [1.0] * 6)]
    rows += [(910, 1, [0.5] * 3), (920, 2, [0.4] * 3), (930, 1, [0.6] * 3), (940, 1, []), (950, 2, []), (960, 1, [0.0] * 6)]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], VECTORS).repartition(3)
    got = hn.hard_negatives(df, "id % 10 = 0", per_shard=per_shard, wave_bytes=wave_bytes)
    assert sorted(tuple(r)[:6] for r in got.collect()) == negatives_by_hand(rows, lambda i: i % 10 == 0)


def test_negatives_of_repeated_ids(spark):
    """Each row of a repeated id is an anchor and a candidate of its own."""
    rows = [(10, 1, [1.0, 0.0])] * 2 + [(11, 2, [0.5, 0.5]), (12, 1, [0.9, 0.1])]
    got = hn.hard_negatives(spark.createDataFrame([(*r, "x", 1, "y") for r in rows], VECTORS), "id % 10 = 0")
    assert Counter(tuple(r)[:6] for r in got.collect()) == Counter({(10, 10, 1, 11, 65536, 32768): 2, (10, 12, 1, 11, 58880, 32768): 2})


def test_no_vectors_and_no_anchors(spark):
    df = spark.createDataFrame([], VECTORS)
    assert hn.hard_negatives(df, "id % 10 = 0").collect() == []
    one = spark.createDataFrame([(1, 1, [1.0], "x", 1, "y")], VECTORS)
    assert hn.hard_negatives(one, "id % 10 = 0").collect() == []


def test_too_long_vectors_are_an_error(spark):
    df = spark.createDataFrame([(10, 1, [1e30], "x", 1, "y"), (11, 1, [1.0], "x", 1, "y")], VECTORS)
    with pytest.raises(Exception, match="too long|overflow|OVERFLOW"):
        hn.hard_negatives(df, "id % 10 = 0").collect()


def test_a_tree_covers_and_skips():
    """Radii cover all points below, centres of a level lie apart, and clustered data are skipped for the most part."""
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(20, 8)) * 400
    x = np.floor(np.concatenate([m + rng.normal(size=(100, 8)) * 10 for m in middles]))
    rows = np.arange(len(x))
    tree = hn.CoverTree(x, rows, rows, rows % 3)
    norms = (x**2).sum(axis=1)
    wide = np.column_stack([tree.x, np.sqrt(np.maximum(norms.max() - (tree.x**2).sum(axis=1), 0))])
    for n in range(len(tree.lo)):
        lo, hi, below = tree.lo[n], tree.hi[n], slice(tree.first[n], tree.last[n])
        assert lo <= tree.centre[n] < hi
        assert np.sqrt(((wide[lo:hi] - wide[tree.centre[n]]) ** 2).sum(axis=1)).max() <= tree.radius[n] * (1 + 1e-9) + 1e-6
        if len(tree.lo[below]):
            assert (tree.lo[below].min(), tree.hi[below].max(), (tree.hi[below] - tree.lo[below]).sum()) == (lo, hi, hi - lo)
            gap = np.sqrt(((wide[tree.centre[below]][:, None] - wide[tree.centre[below]][None]) ** 2).sum(axis=2))
            assert tree.centre[n] in tree.centre[below] and gap[~np.eye(len(gap), dtype=bool)].min() > 0
    looked = []
    inside = tree.x

    class Counted:
        def __getitem__(self, k):
            got = inside[k]
            looked.append(len(got))
            return got

    q = tree.x[0]
    want = sorted(((-int(v @ q), int(i)) for v, i, lab in zip(tree.x, tree.ids, tree.labels) if lab != 1))[:5]
    tree.x = Counted()
    (found,) = tree.search(q, -1, 1, False, np.array([-np.inf]), np.array([np.inf]), 5)
    assert [int(tree.ids[p]) for p in found] == [i for _, i in want]
    assert sum(looked) < len(x) / 4


def search_by_hand(docs, items, k=10):
    lower = str.maketrans(ls.UPPER, ls.LOWER)
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower))
    of = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in of), sum(sum(c.values()) for _, c in of)
    df = Counter(t for _, c in of for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in of:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms if n_terms else 0
            s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, r in Counter(terms(text)).items() if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return Counter(out)


DOCS = "doc_id long, text string, row string, n string, terms int"
ITEMS = "item_id long, text string, sig string, block int"


def test_search_as_by_hand(spark, monkeypatch):
    monkeypatch.setattr(ls, "BLOCK_ITEMS", 7)
    monkeypatch.setattr(ls, "DOCS", 16)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)] + ["Éa", "日本", "x1", "THE", "a"]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", ",", "-", "_", " "]) for _ in range(n))
    docs = [(k, text(rng.randrange(1, 60))) for k in range(120)] + [(None, text(20)), (None, None), (500, ""), (501, "?!"), (7, text(9)), (7, text(9)), (502, "w1 " * 3000)]
    docs += [(600 + k, "w1 w2 the") for k in range(20)]
    base = text(8)
    items = [(k, text(rng.randrange(1, 12)) + " " + base) for k in range(25)] + [(30, None), (31, ""), (32, "w1 W1 w1"), (33, "w1 W1 w1"), (33, "unknown"), (None, "w2 the")]
    d = spark.createDataFrame([(*x, "r", "n", 1) for x in docs], DOCS).repartition(4)
    i = spark.createDataFrame([(*x, "s", 1) for x in items], ITEMS).repartition(3)
    for plan_bytes in (16 << 20, 1):
        got = ls.lexical_search(d, i, plan_bytes=plan_bytes)
        assert Counter(tuple(r)[1:5] for r in got.collect()) == search_by_hand(docs, items)


def test_search_of_nothing(spark):
    none, one = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b", "r", "n", 1)], DOCS)
    no_items, item = spark.createDataFrame([], ITEMS), spark.createDataFrame([(1, "a b", "s", 1)], ITEMS)
    for d, i in ((none, item), (one, no_items), (none, no_items), (spark.createDataFrame([(1, "..", "r", "n", 1)], DOCS), item)):
        assert ls.lexical_search(d, i).collect() == []


def test_shared_sets_are_made_once():
    """Items evaluate to the sums of their terms, by fewer additions than terms where they share many."""
    rng = random.Random(1)
    shared = [b"s%d" % k for k in range(30)]
    queries = [Counter(shared[: 10 + q % 20] + [b"own%d" % q] + [rng.choice(shared)]) for q in range(40)]
    plan = ls.mine(queries)
    terms = sorted(plan.sets)
    gain = np.array([int(hashlib.md5(t).hexdigest()[:6], 16) for t in terms])
    at = np.array([plan.sets[t] for t in terms])
    got = [int(s[0]) for s in ls.evaluate(plan, at, np.zeros(len(terms), dtype=int), gain, 1)]
    value = dict(zip(terms, gain.tolist()))
    assert got == [sum(value[t] * n for t, n in q.items()) for q in queries]
    assert plan.joins and len(terms) + 2 * len(plan.joins) + sum(map(len, plan.items)) < sum(map(len, queries)) / 2
