"""Windows, genotypes, maps, exact tests, shuffles, structures, cohorts and the store against brute force on small tables."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from duoscope.operators import bands, cohorts, genome, resampling, statistics, structures, substitution
from duoscope.operators.geometry import pair_metrics
from duoscope.sources import tables
from duoscope.sources.store import Store, fill

COMPLEMENT = str.maketrans("ACGT", "TGCA")


@pytest.fixture(scope="module")
def reference(spark):
    rng = random.Random(4)
    seqs = {"1": "".join(rng.choice("ACGT") for _ in range(95)), "2": "".join(rng.choice("ACGN") for _ in range(40)), "3": "ACG", "4": "", "5": None}
    df = spark.createDataFrame(list(seqs.items()), "chrom string, seq string")
    return seqs, genome.chunks(df, width=10)


def test_windows_over_chunks(spark, reference):
    seqs, chunks = reference
    asked = [(k, c, lo, lo + n) for k, (c, lo, n) in enumerate(itertools.product(["1", "2", "3", "4", "9"], [-7, 0, 9, 10, 33, 200], [0, 1, 10, 37]))]
    df = spark.createDataFrame(asked, "id long, chrom string, lo long, hi long")
    want = {}
    for k, c, lo, hi in asked:
        part = (seqs.get(c) or "")[max(lo, 0) : max(hi, 0)]
        if part:
            want[k] = (max(lo, 0), part)
    assert {r.id: (r.lo, r.seq) for r in genome.windows(df, chunks, ["id"], 10).collect()} == want
    for r in chunks.collect():
        assert r.n_before == seqs[r.chrom][: r.chunk * 10].count("N")


def apply_by_hand(seq, lo, edits):
    out = seq
    for pos, ref, alt in sorted(edits, key=lambda e: -e[0]):
        i = pos - 1 - lo
        ref, alt = ref.replace("-", ""), alt.replace("-", "")
        out = out[:i] + alt + out[i + len(ref) :]
    return out


def test_genotypes(spark, reference):
    seqs, chunks = reference
    s = seqs["1"]
    rows = []
    for p, q, rev in itertools.product([1, 30, 31, 60, 95], [2, 31, 58, 94], [False, True, None]):
        rows.append((len(rows), "1", p, s[p - 1], "A", q, s[q - 1].lower(), "T", rev))
    rows += [(100, "1", 40, s[39:42], "G", 41, s[40], "A", False), (101, "1", 40, s[39:42], "-", 50, "-", "GG", True), (102, "1", 40, "N", "A", 50, s[49], "C", False), (103, "1", 96, "A", "C", 50, s[49], "C", False), (104, "7", 1, "A", "C", 2, "A", "C", False), (105, "1", 40, None, "C", 50, s[49], "C", False)]
    df = spark.createDataFrame(rows, "id long, chrom string, pos1 long, ref1 string, alt1 string, pos2 long, ref2 string, alt2 string, rev boolean")
    got = {r.id: r for r in genome.genotypes(df, chunks, "id", 12, 10).collect()}
    assert len(got) == len(rows)
    for k, _, p, r1, a1, q, r2, a2, rev in rows:
        g = got[k]
        if k in (103, 104, 105):
            assert g.status == "outside" and g.wt is None and g.m12 is None
            continue
        lo, hi = max(min(p, q) - 12 - 1, 0), min(max(p, q) + 12 - 1, len(s))
        r2 = r2.upper()
        turn = lambda x: x[::-1].translate(COMPLEMENT) if rev else x
        one, two = (p, r1, a1), (q, r2, a2)
        assert (g.wt, g.m1, g.m2) == (turn(s[lo:hi]), turn(apply_by_hand(s[lo:hi], lo, [one])), turn(apply_by_hand(s[lo:hi], lo, [two])))
        at = [x - 1 - lo for x in (p, q)]
        assert [g.idx1, g.idx2] == ([hi - lo - 1 - x for x in at] if rev else at)
        overlap = k == 100 or p == q
        assert g.status == ("overlap" if overlap else "mismatch" if k == 102 else "ok")
        assert g.m12 == (None if overlap else turn(apply_by_hand(s[lo:hi], lo, [one, two])))


def test_random_windows(spark):
    seqs = {f"c{k}": ("ACGT" * 50)[: 30 + 20 * k] for k in range(6)} | {"n": "N" * 500, "half": "N" * 10 + "A" * 90}
    df = spark.createDataFrame(list(seqs.items()), "chrom string, seq string")
    got = genome.random_windows(spark, genome.chunks(df, width=16), 4000, 20, 3, 0.1, 16).collect()
    assert all(r.hi - r.lo == 20 and r.seq == seqs[r.chrom][r.lo : r.hi] and r.seq.count("N") <= 2 for r in got)
    share = {c: sum(r.chrom == c for r in got) for c in seqs}
    total = sum(len(x) for x in seqs.values() if len(x) > 40)
    assert share["c0"] == 0 and share["n"] == 0
    for c in ("c2", "c5"):
        assert share[c] == pytest.approx(4000 * len(seqs[c]) / total, rel=0.2)
    none = spark.createDataFrame([], "chrom string, seq string")
    assert genome.random_windows(spark, genome.chunks(none, width=16), 10, 20, 3, 0.1, 16).collect() == []


def test_conditional_tables_keep_shapes_and_sums(spark):
    rows = [(1, "ACGTACG", 2, 3), (2, "AC", 0, 5), (3, None, 0, 1), (4, "ACX", 1, 0), (5, "AAAA", 1, 1), (6, "AC", None, 1)]
    df = spark.createDataFrame(rows, "id long, seq string, idx1 int, idx2 int")

    def load():
        inner = genome.masked_neighbours()

        def model(texts, at):
            if any("X" in t for t in texts):
                raise ValueError("no X")
            return inner(texts, at)

        return model

    got = {r.id: r for r in genome.conditional_table(df, load, "id", "p_").collect()}
    assert (got[2].error, got[3].error, got[4].error, got[6].error) == ("place outside the sequence",) * 2 + ("no X", "place outside the sequence")
    assert got[4].p_A_A is None and got[1].error is None and (got[1].p_ref1_nuc, got[1].p_ref2_nuc) == ("G", "T")
    for a in "ACGT":
        near = "C" + a + "AC"
        want = [(1 + near.count(b)) / 8 for b in "ACGT"]
        assert [got[1][f"p_{a}_{b}"] for b in "ACGT"] == pytest.approx(want)
        assert sum(got[5][f"p_{a}_{b}"] for b in "ACGT") == pytest.approx(1)


@pytest.mark.parametrize("metric", ["epi_R_raw", "rho"])
def test_epistasis_map_embeds_each_genotype_once(spark, tmp_path, metric):
    seqs = [("a", "ACGTN"), ("b", "ACGTN"), ("c", "GG"), ("d", "G"), ("e", None), ("f", "")]
    df = spark.createDataFrame(seqs, "id string, seq string")
    count = spark.sparkContext.accumulator(0)

    def load():
        inner = substitution.composition_model()

        def model(texts):
            count.add(len(texts))
            return inner(texts)

        return model

    s = substitution.epistasis_scores(df, ["id"], "seq", load, metric, batch=7)
    got = {(r.id, r.pos_i, r.pos_j, r.alt_i, r.alt_j): r.score for r in s.collect()}
    n = {p: 3 for p in range(4)} | {4: 4}
    doubles = sum(n[i] * n[j] for i, j in itertools.combinations(range(5), 2))
    # One sequence for two keys: 1 + 16 + doubles, and 1 + 6 + 9 of the short one.
    assert count.value == 1 + 16 + doubles + 1 + 6 + 9 and len(got) == 2 * doubles + 9
    if metric == "rho":
        return
    model = substitution.composition_model()
    for (key, i, j, a, b), score in got.items():
        seq = dict(seqs)[key]
        put = lambda *e: "".join(dict(e).get(k, c) for k, c in enumerate(seq))
        w, x, y, z = (v.astype(np.float32).astype(float) for v in model([seq, put((i, a)), put((j, b)), put((i, a), (j, b))]))
        assert score == pytest.approx(np.linalg.norm(z - x - y + w), abs=1e-9)
    m = {(r.id, r.pos_i, r.pos_j): (r.score, r.n) for r in substitution.epistasis_map(s, ["id"]).collect()}
    best = max(v for k, v in got.items() if k[:3] == ("a", 1, 4))
    assert m["a", 1, 4] == m["a", 4, 1] == (pytest.approx(best), 12) and "epi_R_raw" in pair_metrics.__globals__["metric_columns"]()


def fisher_by_hand(a, b, c, d):
    m, k, n = a + b, a + c, a + b + c + d
    p = [math.comb(m, j) * math.comb(n - m, k - j) for j in range(max(0, m + k - n), min(m, k) + 1)]
    seen = math.comb(m, a) * math.comb(n - m, c)
    return sum(x for x in p if x <= seen) / sum(p)


def test_fisher(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(30), rng.randrange(30), rng.randrange(30), rng.randrange(30)) for _ in range(150)]
    rows += [(0, 0, 0, 0), (0, 5, 5, 0), (5, 0, 0, 5), (3, 0, 0, 0), (2000, 50, 40, 3000), (700, 300, 250, 900), (10, 10, 10, 10)]
    got = statistics.fisher_two_sided(spark.createDataFrame(rows, "a long, b long, c long, d long"), "a", "b", "c", "d").collect()
    for r in got:
        assert r.p == pytest.approx(fisher_by_hand(r.a, r.b, r.c, r.d), rel=1e-8, abs=1e-290)
        assert r.odds == (pytest.approx(r.a * r.d / (r.b * r.c)) if r.b * r.c else math.inf if r.a * r.d else None)


def test_rank_tests(spark):
    rng = random.Random(2)
    rows = [(g, float(rng.randrange(12)), rng.random() < 0.4, rng.randrange(1, 4)) for g in "st" for _ in range(80)] + [("s", None, True, 1), ("t", 3.0, None, 1), ("u", 1.0, True, 2)]
    df = spark.createDataFrame(rows, "g string, v double, m boolean, w int")
    for weighted in (False, True):
        got = {r.g: r for r in statistics.mann_whitney(df, "v", "m", ["g"], "w" if weighted else None).collect()}
        for g in "st":
            part = [(v, m, w if weighted else 1) for h, v, m, w in rows if h == g and v is not None and m is not None]
            a = [v for v, m, w in part for _ in range(w) if m]
            b = [v for v, m, w in part for _ in range(w) if not m]
            u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
            n = len(a) + len(b)
            ties = sum(k**3 - k for k in ((a + b).count(x) for x in set(a + b)))
            sd = math.sqrt(len(a) * len(b) / 12 * (n + 1 - ties / (n * (n - 1))))
            tail = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
            mean = len(a) * len(b) / 2
            r = got[g]
            assert (r.n1, r.n2, r.u) == (len(a), len(b), u)
            assert (r.p_greater, r.p_less, r.p_two) == pytest.approx((tail((u - mean - 0.5) / sd), tail((mean - u - 0.5) / sd), min(1, 2 * tail((abs(u - mean) - 0.5) / sd))), abs=1e-9)
            if not weighted:
                d = {r.g: r.d for r in statistics.kolmogorov_smirnov(df, "v", "m", ["g"]).collect()}
                assert d[g] == pytest.approx(max(abs(sum(x <= t for x in a) / len(a) - sum(x <= t for x in b) / len(b)) for t in set(a + b)))
        assert got["u"].z is None


def test_shuffled_means(spark, monkeypatch):
    """Every shuffle has as many labels as are seen, whatever the blocks; p-values agree with all choices there are."""
    values = [0.3, 1.7, 2.2, 0.1, 3.9, 1.1, 0.4, 2.8, 5.0, 0.9]
    rows = [("x", k, v, k in (2, 4, 8)) for k, v in enumerate(values)] + [("one", k, 1.0, k % 3 == 0) for k in range(700)] + [("all", 1, 1.0, True), ("x", 99, None, True)]
    df = spark.createDataFrame(rows, "g string, k long, v double, m boolean").repartition(4)
    monkeypatch.setattr(resampling, "BLOCK", 64)
    got = {r.g: r for r in resampling.mean_shuffles(df, "v", "m", "k", ["g"], 4000).collect()}
    assert set(got) == {"x", "one"}
    # All values are 1, so every choice of exactly n1 rows has difference 0.
    assert (got["one"].n1, got["one"].observed, got["one"].larger, got["one"].std) == (234, pytest.approx(0, abs=1e-9), 4000, pytest.approx(0, abs=1e-9))
    every = [np.mean([values[i] for i in c]) - np.mean([v for i, v in enumerate(values) if i not in c]) for c in itertools.combinations(range(10), 3)]
    seen = got["x"].observed
    assert seen == pytest.approx(np.mean([values[i] for i in (2, 4, 8)]) - np.mean([v for i, v in enumerate(values) if i not in (2, 4, 8)]))
    assert got["x"].larger / 4000 == pytest.approx(np.mean([d >= seen - 1e-9 for d in every]), abs=0.015)
    assert got["x"].std == pytest.approx(np.std(every), rel=0.05)
    sizes = np.array([5, 0, 7, 64, 1])
    drawn = sum(resampling.labels_in(sizes, b, 30, 50, ("s",)) for b in range(5))
    assert (drawn == 30).all()


def test_coherence(spark):
    rng = np.random.default_rng(8)
    rows = [("t", k, (rng.normal(size=6) * 0.2 + [1, 0, 0, 0, 0, 0] if k % 2 else rng.normal(size=6)).tolist(), bool(k % 2)) for k in range(120)]
    rows += [("n", k, rng.normal(size=6).tolist(), bool(k % 2)) for k in range(120)] + [("n", 900, None, True)]
    got = {r.g: r for r in resampling.coherence_shuffles(spark.createDataFrame(rows, "g string, k long, x array<double>, m boolean"), "x", "m", "k", ["g"]).collect()}
    assert got["t"].coherence1 > 0.8 > got["t"].coherence2 and got["t"].p == pytest.approx(1 / 201)
    assert got["n"].p > 0.05


def atom(chain, residue, x, y, z, name=" C1'", kind="ATOM  "):
    return f"{kind}    1 {name}   G {chain}{residue:>4}    {x:8.3f}{y:8.3f}{z:8.3f}  1.00 20.00"


def test_structure_records(spark):
    rng = random.Random(6)
    points = {("B", r): tuple(round(rng.uniform(-9, 9), 3) for _ in range(3)) for r in (5, 6, 9)} | {("A", r): tuple(round(rng.uniform(-9, 9), 3) for _ in range(3)) for r in range(-1, 8) if r != 3}
    lines = [atom(c, r, *p) for (c, r), p in points.items()] + [atom("A", 1, 0, 0, 0, " P  "), atom("A", 1, 0, 0, 0, kind="HETATM"), "TER", "", None, "ATOM  broken"]
    a = structures.atoms(spark.createDataFrame([("s", x) for x in lines], "id string, value string"), ["id"])
    assert {(r.chain, r.residue): (r.x, r.y, r.z) for r in a.collect()} == points
    at = structures.indexed(a, ["id"])
    index = {(c, r): r + 1 if c == "A" else 9 + r - 5 for c, r in points}
    assert {(r.chain, r.residue): r.i for r in at.collect()} == index
    swapped = {(r.chain, r.residue): r.i for r in structures.indexed(a, ["id"], ["B", "A"]).collect()}
    assert swapped["B", 5] == 0 and swapped["A", -1] == 5
    by = {index[k]: p for k, p in points.items()}
    want = {(i, j): math.dist(by[i], by[j]) for i, j in itertools.combinations(sorted(by), 2)}
    near = {(r.i, r.j): r.distance for r in structures.neighbours(at, ["id"], 6.0).collect()}
    assert near == pytest.approx({k: d for k, d in want.items() if d <= 6.0})
    whole = {(r.i, r.j): r.proximity for r in structures.proximity_map(at, spark.createDataFrame([("s", 14)], "id string, length int"), ["id"]).collect()}
    assert len(whole) == 14 * 13 // 2 and {k for k, v in whole.items() if v is not None} == set(want)
    assert whole[0, 1] == pytest.approx(1 / want[0, 1])


def test_contacts(spark):
    scores = spark.createDataFrame([("m", i, j, float((i * 7 + j * 3) % 11)) for i in range(12) for j in range(12) if i != j] + [("m", 0, 11, None)], "id string, pos_i int, pos_j int, score double")
    known = spark.createDataFrame([("m", 9, 1)], "id string, i int, j int")
    got = {(r.pos_i, r.pos_j): (r.region_i, r.region_j, r.crosses) for r in structures.novel_pairs(scores, known, ["id"], [(6, "a"), (12, "b")], 0.5).collect()}
    up = {(i, j): float((i * 7 + j * 3) % 11) for i in range(12) for j in range(i + 1, 12)}
    bound = np.percentile([v for v in up.values() if v > 0], 50)
    assert set(got) == {k for k, v in up.items() if v > bound and k[1] - k[0] >= 4 and k != (1, 9)}
    assert all(v == ("a" if i < 6 else "b", "a" if j < 6 else "b", (i < 6) != (j < 6)) for (i, j), v in got.items())
    pairs = spark.createDataFrame([("m", 1, 9), ("m", 9, 1), ("m", 1, 8)], "id string, pos1 int, pos2 int")
    assert sorted(r.is_paired for r in structures.paired_label(pairs, known, ["id"]).collect()) == [False, True, True]


def test_cohorts(spark):
    calls = spark.createDataFrame([("g", 1, 5), ("g", 1, 6), ("g", 2, 5), ("g", 2, 9), ("g", 3, 5), ("g", 4, 6), ("g", 4, 9), ("g", 5, 9), ("g", 5, 8), ("h", 1, 1), ("h", 6, 1)], "gene string, case_id long, pos long")
    people = spark.createDataFrame([(k, 1.0, 1, k % 2, 1) for k in range(1, 8)], "case_id long, duration double, event int, drug int, other int")
    of = lambda df: {r.case_id: r.grp for r in df.collect()}
    assert of(cohorts.cohort(people, cohorts.carriers_of(calls, ["g", "h"], False))) == {k: int(k == 1) for k in range(1, 8)}
    both, only = cohorts.two_gene_carriers(calls, "g", "h", "both"), cohorts.two_gene_carriers(calls, "g", "h", "only_b")
    assert of(cohorts.cohort(people, both, only)) == {1: 1, 6: 0} and of(cohorts.cohort(people, both, rest=False)) == {1: 1}
    assert of(cohorts.cohort(people, both, both)) == {1: 0}
    kept = cohorts.varying(people, ["drug", "other"])
    assert "drug" in kept.columns and "other" not in kept.columns
    pairs = spark.createDataFrame([("g", 5, 6)], "gene string, pos1 long, pos2 long")
    assert of(cohorts.position_cohorts(calls.select("gene", "case_id", "pos"), pairs)) == {1: 1, 2: 0, 4: 0}


def test_combinations(spark):
    df = spark.createDataFrame([("a", 1), ("a", 900), ("b", 1), ("b", 2), ("b", 300), ("c", 5)], "g string, m int")
    got = {tuple(r) for r in bands.combinations(df, ["g"], "m").select("g", "m1", "m2", "unambiguous").collect()}
    assert got == {("a", 1, 900, True), ("b", 1, 2, False), ("b", 1, 300, False), ("b", 2, 300, False)}
    assert bands.combinations(df, ["g"], "m", 2).count() == 1


def test_a_job_killed_halfway_and_run_again(spark, tmp_path):
    """What a killed job wrote stays, the next run does the rest, and the content is that of one run."""
    rows = [(f"k{k}", "ACGT" * (k % 5) + "A" * k) for k in range(60)] + [("bad", "X"), ("none", None), (None, "A"), ("k1", "ZZZ")]
    df = spark.createDataFrame(rows, "key string, seq string")
    flag = tmp_path / "die"
    flag.write_text("")

    def load():
        inner = substitution.composition_model()

        def model(texts):
            if any("X" in t for t in texts):
                raise ValueError("no X")
            return inner(texts)

        return model

    def dying():
        inner = load()

        def model(texts):
            if flag.exists() and any(len(t) > 60 for t in texts):
                import os

                os._exit(1)
            return inner(texts)

        return model

    straight, again = Store(spark, str(tmp_path / "a")), Store(spark, str(tmp_path / "b"))
    assert fill(straight, df, "seq", load, 4) == {"wanted": 62, "computed": 60, "loaded": 0, "skipped": 2}
    with pytest.raises(Exception):  # noqa: B017
        fill(again, df, "seq", dying, 4)
    flag.unlink()
    had = again.rows().count()
    counts = fill(again, df, "seq", dying, 4)
    assert counts == {"wanted": 62, "computed": 60 - had, "loaded": had, "skipped": 2}
    content = lambda s: {r.key: tuple(r.embedding) for r in s.rows().collect()}
    assert content(again) == content(straight)
    before = content(again)
    again.upsert(spark.createDataFrame([("k3", [9.0], 1), ("k3", [1.0], 2), ("new", [2.0], 1), (None, [1.0], 1)], "key string, embedding array<float>, at int"), "at")
    again.delete(spark.createDataFrame([("k4",), ("unknown",)], "key string"))
    want = {k: v for k, v in before.items() if k != "k4"} | {"k3": (1.0,), "new": (2.0,)}
    assert content(again) == want
    again.compact()
    assert again.vacuum() > 0 and content(again) == want and again.compact() and content(again) == want
    again.describe(model="a", dim="4")
    again.describe(model="b")
    assert {r.name: r.value for r in again.facts().collect()} == {"model": "b", "dim": "4"} and content(again) == want


def test_files_of_several_separators(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name,n\n1,\"x, y\",2\n2,z,no\n")
    (tmp_path / "b.tsv").write_text("n\tid\textra\n5\t3\tq\n")
    (tmp_path / "c.txt").write_text("id\n7\n")
    got = {r.id: (r.name, r.n) for r in tables.read_sniffed(spark, str(tmp_path), "id", "id long, name string, n int").collect()}
    assert got == {1: ("x, y", 2), 2: ("z", None), 3: (None, 5), 7: (None, None)}
    with pytest.raises(ValueError, match="no column"):
        tables.read_sniffed(spark, str(tmp_path), "key", "key long")


def test_model_embeddings(spark):
    from duoscope.operators.embedding import embed, kmer_model

    weights = np.random.default_rng(3).normal(size=(64, 16))
    code = {b: i for i, b in enumerate("ACGT")}
    seqs = ["ACGTAC", "AAA", "AC", "TTGCA"]
    got = {r.s: r.embedding for r in embed(spark.createDataFrame([(s,) for s in seqs], "s string"), "s", kmer_model, ["s"]).collect()}
    for s in seqs:
        want = sum((weights[code[s[i]] + 4 * code[s[i + 1]] + 16 * code[s[i + 2]]] for i in range(len(s) - 2)), np.zeros(16))
        assert got[s] == pytest.approx(want.tolist(), abs=1e-5)
    assert embed(spark.createDataFrame([], "s string"), "s", kmer_model, ["s"]).select(F.col("s")).count() == 0


def test_annotated_singles(spark):
    from duoscope.operators.geometry import annotate_singles

    rows = [(1, [1.0, 0.0], [1.0, 2.0], [3.0, 0.0]), (2, None, [1.0, 2.0], [1.0, 0.0]), (3, [1.0, 0.0], None, [1.0, 0.0]), (4, [1.0, 0.0], [1.0], [1.0, 0.0]), (5, [1.0, 0.0], [1.0, 0.0], [0.0, 0.0]), (6, [1.0, 0.0], [2.0, 1.0], None)]
    df = spark.createDataFrame(rows, "id int, WT array<float>, M1 array<float>, axis array<float>")
    got = {r.id: r for r in annotate_singles(df, ["id"], prefix="x_", axis="axis").collect()}
    assert [got[k].x_v_l2 for k in (2, 3, 4, 6)] == [None] * 4 and got[3].x_angle is None
    assert (got[1].x_v_l2, got[1].x_v_par, got[1].x_v_perp, got[1].x_x, got[1].x_y, got[1].x_angle_over_pi) == pytest.approx((2, 0, 2, 0, 1, 0.5))
    assert got[1].x_v_diff == pytest.approx(1 - 1 / math.sqrt(5)) and (got[5].x_v_l2, got[5].x_v_par, got[5].x_radius) == (0, 0, 0)
    own = {r.id: r for r in annotate_singles(df, ["id"]).collect()}
    assert (own[6].v_par, own[6].v_perp, own[6].angle) == pytest.approx((math.sqrt(2), 0, 0), abs=1e-6)


def test_choices_and_follow_up(spark):
    from duoscope.operators import ranking

    nan = math.nan
    df = spark.createDataFrame([(1, 0.2, 0.1, 0.3, 0.2), (2, 0.3, 0.1, 0.3, 0.2), (3, nan, 0.1, -0.3, 0.2), (4, 0.1, 0.1, nan, 0.2), (5, None, 0.1, None, 0.2)], "id int, a double, pa double, b double, pb double")
    got = {r.id: (r.best_r, r.best_p, r.metric) for r in ranking.best_of_two(df, ["id"], ("x", "a", "pa"), ("y", "b", "pb")).collect()}
    assert got == {1: (0.3, 0.2, "y"), 2: (0.3, 0.1, "x"), 3: (-0.3, 0.2, "y"), 4: (0.1, 0.1, "x"), 5: (None, 0.1, "x")}
    cases = spark.createDataFrame([(1, 730, None, 365), (2, 10, 400, None), (3, None, None, None), (4, 100, -1, None), (5, 365, None, None)], "case_id int, seen int, died int, other int")
    got = {r.case_id: (r.duration, r.event) for r in statistics.follow_up(cases, ["seen", "died", "other"], "died", 0.5).collect()}
    assert got == {1: (2.0, 0), 2: (pytest.approx(400 / 365), 1), 5: (1.0, 0)}
    days = {r.case_id: r.duration for r in statistics.follow_up(cases, ["seen"], "died", years=False).collect()}
    assert days == {1: 730, 2: 10, 4: 100, 5: 365}
    some = spark.createDataFrame([("a", n, s) for n, s in [(2, 0.9), (3, 0.8), (50, 0.8), (51, 0.9), (10, 0.79), (4, 0.95)]], "id string, n int, s double")
    assert [(r.n, r.s) for r in ranking.selected(some, "n", "s", 3, 50, 0.8).collect()] == [(4, 0.95), (50, 0.8), (3, 0.8)]
    calls = spark.createDataFrame([("g", 5, "B", None, 2, "A", "C", "chr1"), ("g", 5, "A", "p." + "x" * 40, 1, "A", "G", "chr1"), ("g", 6, None, None, 1, "T", "G", "X")], "gene string, pos int, cls string, protein string, case_id int, ref string, alt string, chrom string")
    got = {r.pos: tuple(r)[2:] for r in ranking.annotation(calls, ["gene", "pos"], "cls", "protein", ["case_id"]).collect()}
    assert got == {5: ("A", "p." + "x" * 18, "A", "G", "1"), 6: ("?", "?", "T", "G", "X")}


def test_pair_windows(spark):
    from duoscope.operators.maps import pair_windows

    rows = [(1, 1000, 500, 520), (2, 30, 29, 0), (3, 5000, 4900, 100), (4, 1, 0, 0)]
    got = {}
    for r in pair_windows(spark.createDataFrame(rows, "id int, length int, pos1 int, pos2 int"), ["id"], 50, 40, 200).collect():
        got.setdefault((r.id, r.part), []).append(r)
    assert set(got) == {(1, "pair"), (2, "pair"), (3, "first"), (3, "second"), (4, "pair")}
    for (k, part), rs in got.items():
        _, n, p, q = rows[k - 1]
        lo, hi = (max(0, min(p, q) - 50), min(n, max(p, q) + 51)) if part == "pair" else (max(0, {"first": p, "second": q}[part] - 100), min(n, {"first": p, "second": q}[part] + 100))
        sites = {p - lo, q - lo} if part == "pair" else {{"first": p, "second": q}[part] - lo}
        step = max(1, (hi - lo) // 40)
        assert {(r.lo, r.hi) for r in rs} == {(lo, hi)} and sorted(r.pos for r in rs) == sorted(set(range(0, hi - lo, step)) | sites)
        assert {r.pos for r in rs if r.is_site} == sites
