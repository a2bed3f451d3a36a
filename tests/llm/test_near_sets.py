"""Near-duplicates by similarity against brute force."""

import random
import re
from collections import Counter

import pytest

from duoscope.llm.near_sets import near_groups

AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "ONE"), (6, "one two"), (6, "one two"), (None, "one two"), (None, "alone here"), (7, "a b c d e f"), (8, "word " * 3000)]


def edited(n, seed):
    """Texts of 60 to 300 words, each with copies of which a few words are replaced."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        words = [f"w{r.randrange(5000)}" for _ in range(r.randrange(60, 300))]
        out.append(" ".join(words))
        for share in (0.004, 0.01, 0.02, 0.03):
            out.append(" ".join(f"x{r.randrange(5000)}" if r.random() < share else w for w in words))
    return list(enumerate(out))


def similar(rows, least=0.8):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return [(a, b) for a in range(len(rows)) for b in range(a) if not sets[a] | sets[b] or len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]


def components(rows):
    root = list(range(len(rows)))
    for a, b in similar(rows):
        if root[a] != root[b]:
            root = [root[b] if r == root[a] else r for r in root]
    least = {r: min((rows[k][0] for k in range(len(rows)) if root[k] == r and rows[k][0] is not None), default=None) for r in set(root)}
    return Counter((d, least[root[k]]) for k, (d, _) in enumerate(rows))


@pytest.mark.parametrize(("rows", "most"), [(AWKWARD, 1 << 21), ([], 1 << 21), (edited(60, 1), 1 << 21), (edited(10, 2), 300)])
def test_near_groups(spark, rows, most):
    got = near_groups(spark.createDataFrame(rows, "doc_id long, text string"), most=most)
    assert Counter(map(tuple, got.collect())) == components(rows)


def test_the_near_stage_drops_every_similar_copy(spark):
    import corpus_pipeline as cp

    rows = edited(40, 3)
    assert len(similar(rows)) > 100
    kept = {r.doc_id for r in cp.near(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert kept == {root for _, root in components(rows)}


def test_near_fingerprints_name_candidates_that_no_band_names(spark):
    from duoscope.llm.near_sets import candidates

    keys = spark.createDataFrame([(k, k) for k in range(1, 7)], "key long, f long")
    # 1 and 2 differ in 4 bits, 2 and 3 in none, 4 and 5 in 5, 6 in half of all.
    prints = spark.createDataFrame([(1, 0), (2, 15), (3, 15), (4, 31 << 20), (5, 1023 << 20), (6, 0x0F0F0F0F0F0F0F0F)], "f long, p long")
    assert sorted(map(tuple, candidates(keys, prints).select("f", "root").collect())) == [(1, 1), (2, 1), (3, 1)]
