"""Places, bins and scaled values against plain loops, with ties, nulls and tables of a few rows."""

import math
import random

import pytest

from duoscope.operators import ranking
from duoscope.operators import statistics as st

ROWS = [(s, k, v, f) for r in [random.Random(5)] for s, n in (("a", 103), ("b", 7), ("c", 1)) for k in range(n) for v, f in [(r.choice([None, 0.5, 0.5, 0.5, 1.5, -2.0, r.random()]), r.choice([True, False, None]))]]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "s string, k int, v double, f boolean")


def ordered():
    for s in "abc":
        yield s, sorted((v, k, f) for x, k, v, f in ROWS if x == s and v is not None)


def test_ordinal(rows):
    got = {(r.s, r.k): r.rank for r in ranking.ordinal(rows, "v", "k", ["s"]).collect()}
    assert got == {(s, k): i + 1 for s, part in ordered() for i, (_, k, _) in enumerate(part)}


@pytest.mark.parametrize("bins", [1, 4, 20])
def test_rank_bins(rows, bins):
    got = {(r.s, r.bin): (r.n, r.marked) for r in ranking.rank_bins(rows, "v", "k", "f", ["s"], bins).collect()}
    want = {}
    for s, part in ordered():
        for i, (_, _, f) in enumerate(part):
            at = s, min(i // max(len(part) // bins, 1), bins - 1)
            n, m = want.get(at, (0, 0))
            want[at] = n + 1, m + bool(f)
    assert got == want


def test_ranks_of_no_rows(rows):
    none = rows.where("false")
    assert ranking.ordinal(none, "v", "k", ["s"]).count() == ranking.rank_bins(none, "v", "k", "f", ["s"]).count() == ranking.minmax(none, "v", ["s"]).count() == 0


def test_minmax(rows):
    got = {(r.s, r.k): r.scaled for r in ranking.minmax(rows.where("v is not null"), "v", ["s"]).collect()}
    for s, part in ordered():
        lo, hi = (part[0][0], part[-1][0]) if part else (0, 0)
        for v, k, _ in part:
            assert got.pop((s, k)) == pytest.approx((v - lo) / (hi - lo) if hi > lo else 0)
    assert not got


def test_signed_rank(spark):
    r = random.Random(2)
    given = [("a", r.randrange(6) / 2 if i % 9 else None, r.randrange(6) / 2) for i in range(60)]
    t = st.signed_rank(spark.createDataFrame(given, "s string, x double, y double"), "x", "y", ["s"]).first()
    d = [x - y for _, x, y in given if x is not None and x != y]
    place = lambda z: sum(abs(e) < abs(z) for e in d) + (sum(abs(e) == abs(z) for e in d) + 1) / 2
    w, n = sum(place(z) for z in d if z > 0), len(d)
    assert (t.n, t.w) == (n, w)
    assert t.z == pytest.approx((w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24))
