"""Fits that SQL does not state, against numpy on small tables."""

import itertools
from collections import Counter

import numpy as np
import pytest

from duoscope.operators import calibration, cascade, embedding, maps, ranking, statistics, subspaces


def test_cox(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 2))
    t = np.ceil(10 * rng.exponential(size=80) * np.exp(-x[:, 0]))
    e = rng.random(80) < 0.7
    df = spark.createDataFrame([(float(a), int(b), float(c), float(d)) for a, b, (c, d) in zip(t, e, x, strict=True)], "duration double, event int, u double, v double")
    beta = np.zeros(2)
    for _ in range(30):
        g, h = np.zeros(2), np.zeros((2, 2))
        for k in np.flatnonzero(e):
            at = t >= t[k]
            w = np.exp(x[at] @ beta)
            m = w @ x[at] / w.sum()
            g += x[k] - m
            h += (x[at].T * w) @ x[at] / w.sum() - np.outer(m, m)
        beta = beta + np.linalg.solve(h, g)
    got = {r.feature: r for r in statistics.cox(df, ["u", "v"]).collect()}
    assert [got["u"].coefficient, got["v"].coefficient] == pytest.approx(beta.tolist(), abs=1e-6)
    assert [got["u"].error, got["v"].error] == pytest.approx(np.sqrt(np.diag(np.linalg.inv(h))).tolist(), abs=1e-6)
    assert got["u"].p < 1e-4 and statistics.cox(df.limit(0), ["u", "v"]).count() == 0


def test_subspaces(spark):
    rng = np.random.default_rng(6)
    sets = {"a": rng.normal(size=(40, 5)) * [5, 3, 1, 0.5, 0.1], "b": rng.normal(size=(40, 5)) * [0.1, 3, 5, 0.5, 1]}
    df = spark.createDataFrame([(k, n, r.tolist()) for k, m in sets.items() for n, r in enumerate(m)], "k string, n int, x array<double>")
    axes = subspaces.components(calibration.covariance(calibration.gram(df, ["k"], "x"), ["k"]), ["k"], 2)
    top = {k: np.linalg.eigh(np.cov(m.T))[1][:, ::-1][:, :2] for k, m in sets.items()}
    c = np.abs(top["a"].T @ top["b"])
    got = subspaces.overlap(axes.where("k = 'a'"), axes.where("k = 'b'")).first()
    assert (got.overlap, got.projected) == pytest.approx((c.max(axis=1).mean(), (c**2).sum() / 2), abs=1e-9)
    zero = df.union(spark.createDataFrame([("b", 99, [0.0] * 5)], df.schema)).where("k = 'b'")
    for r in subspaces.fraction_inside(zero, axes.where("k = 'a'"), "x").collect():
        x = np.array(r.x)
        inside = ((x @ top["a"]) ** 2).sum()
        assert r.inside_fraction == pytest.approx(inside / (x @ x) if r.n < 99 else 0.0, abs=1e-9)
        assert r.orthogonal_norm == pytest.approx(np.sqrt(max(x @ x - inside, 0)), abs=1e-6)


def test_cumulated_sums_over_ties(spark):
    values = [k % 7 if k % 3 else 4 for k in range(900)]
    df = spark.createDataFrame([("s" if k % 5 else "t", float(v)) for k, v in enumerate(values)], "g string, v double")
    from pyspark.sql import functions as F

    rows = [("s" if k % 5 else "t", v) for k, v in enumerate(values)]
    for r in ranking.cumulated(df, "v", ["g"], {"n": F.lit(1)}).collect():
        assert r.n == rows.count((r.g, r.v)) and r.n_before == sum(g == r.g and v < r.v for g, v in rows)


def test_log_rank_from_carriers_alone(spark):
    rng = np.random.default_rng(7)
    cases = [(k, float(rng.integers(1, 15)), int(rng.random() < 0.6), "pq"[k % 2]) for k in range(60)]
    carried = [(g, k) for g in "xyz" for k in range(60) if rng.random() < 0.3] + [("all", k) for k in range(60)]
    cohort = spark.createDataFrame(cases, "case_id int, duration double, event int, project string")
    carriers = spark.createDataFrame(carried, "gene string, case_id int")
    long = spark.createDataFrame([(g, *c, int((g, c[0]) in set(carried))) for g in ("x", "y", "z", "all") for c in cases], "gene string, case_id int, duration double, event int, project string, grp int")
    for by in ([], ["project"]):
        want = {(r.gene, *[r[c] for c in by]): (r.expected, r.variance, r.chi2) for r in statistics.log_rank(long, ["gene", *by]).collect()}
        got = {(r.gene, *[r[c] for c in by]): (r.expected, r.variance, r.chi2) for r in statistics.log_rank_of_carriers(cohort, carriers, "gene", "case_id", by).collect()}
        assert got.keys() == want.keys()
        for k, v in want.items():
            assert got[k] == pytest.approx(v, abs=1e-9)


def test_upper_tails_of_chi_square(spark):
    # Known values: the 5 per cent points of 1 to 6 degrees of freedom.
    points = [3.841459, 5.991465, 7.814728, 9.487729, 11.070498, 12.591587]
    df = spark.createDataFrame([(x, n + 1) for n, x in enumerate(points)] + [(0.0, 3), (None, 1), (1.0, None)], "x double, n int")
    got = [r[0] for r in df.coalesce(1).select(cascade.chi2_upper("x", "n")).collect()]
    assert got[:6] == pytest.approx([0.05] * 6, abs=1e-6) and got[6:] == [1.0, None, None]


def brute_controls(pairs, carried, people, few=3):
    """Cases by pair and level, as sets."""
    out = {}
    for g, a, b in pairs:
        own = {c: p for (h, c), p in carried.items() if h == g}
        target = {c for c, p in own.items() if a in p and b in p}
        one = {c for c, p in own.items() if (a in p) != (b in p)}
        same = set()
        for n in {len(own[c]) for c in target}:
            found = {c for c in own if c not in target and len(own[c]) == n}
            same |= found if len(found) >= few else {c for c in own if c not in target and abs(len(own[c]) - n) <= 1}
        middle = np.median([people[c][2] for c in target])
        out[g, a, b] = target, [one, same, {c for c in same if middle * 0.5 <= people[c][2] <= middle * 1.5}]
    return out


def test_matched_controls_and_verdicts(spark):
    rng = np.random.default_rng(8)
    people = {c: (float(rng.integers(1, 12)), int(rng.random() < 0.7), int(rng.integers(4, 30)), "pq"[c % 2]) for c in range(90)}
    carried = {(g, c): {int(x) for x in rng.choice(7, int(rng.integers(1, 5)), replace=False)} for g in "xy" for c in range(90) if rng.random() < 0.8}
    positions = spark.createDataFrame([(g, c, p) for (g, c), s in carried.items() for p in s], "gene string, case_id int, pos int")
    table = spark.createDataFrame([(g, c, len(s), people[c][2], people[c][0], people[c][1], people[c][3]) for (g, c), s in carried.items()], "gene string, case_id int, n int, tmb int, duration double, event int, project string")
    pairs = cascade.carried_pairs(positions, 3)
    want = brute_controls([tuple(r) for r in pairs.collect()], carried, people)
    rows = cascade.cohorts(pairs, positions, table)
    got = {}
    for r in rows.collect():
        got.setdefault((r.gene, r.pos1, r.pos2, r.level, r.grp), []).extend([(r.tmb, r.project, r.duration)] * r.c)
    for (g, a, b), (target, levels) in want.items():
        for level, controls in enumerate(levels):
            for grp, who in ((1, target), (0, controls)):
                assert sorted(got.get((g, a, b, level, grp), [])) == sorted((people[c][2], people[c][3], people[c][0]) for c in who)
    verdicts = {(r.gene, r.pos1, r.pos2): r for r in cascade.cascade(rows, alpha=0.5).collect()}
    assert len(verdicts) > 10 and {r.kept for r in verdicts.values()} == {True, False}
    for key, r in verdicts.items():
        target, levels = want[key]
        if len(target) > 1 and len(levels[2]) > 1:
            t, c = [people[x][2] for x in target], [people[x][2] for x in levels[2]]
            assert r.tmb_u == sum((x > y) + 0.5 * (x == y) for x in t for y in c)
        low = [p is not None and p < 0.5 for p in (r.p_0, r.p_1, r.p_2)]
        assert r.kept == (all(low) and (r.p_3 is None or r.p_3 < 0.5))
    assert cascade.cascade(cascade.cohorts(pairs.limit(0), positions, table)).count() == 0


def test_cases_with_many_positions_name_all_their_pairs(spark, tmp_path):
    import duckdb

    from duoscope.plans import models

    # Cases 1 to 3 have 30 positions, 25 of them in common; the others have 3 or one, some in common with them.
    own = {c: set(range(25)) | {100 * c + k for k in range(5)} for c in (1, 2, 3)} | {4: {0, 1, 2}, 5: {0, 101, 102}, 6: {101, 102, 7}, 7: {5}}
    positions = spark.createDataFrame([("g", c, p) for c, s in own.items() for p in s], "gene string, case_id long, pos long")
    seen = Counter(pair for s in own.values() for pair in itertools.combinations(sorted(s), 2))
    want = {("g", *pair) for pair, n in seen.items() if n >= 3}
    assert len(want) == 25 * 24 // 2 + 1
    for block in (2048, 7):
        got = [tuple(r) for r in cascade.carried_pairs(positions, 3, block).collect()]
        assert set(got) == want and len(got) == len(want)

    # The same cases as tables, each with two orders, and controls: two cases for each position, four with 30 of their own.
    own |= {8 + c: {c % 25} for c in range(50)} | {60 + c: {1000 * (c + 1) + k for k in range(30)} for c in range(4)}
    lines = [(c, p) for c, s in own.items() for p in s]
    db = duckdb.connect()
    db.execute("CREATE TABLE own (c BIGINT, p BIGINT)")
    db.executemany("INSERT INTO own VALUES (?, ?)", lines)
    tables = {
        "lineitem": "SELECT c AS l_orderkey, p AS l_partkey, 'N' AS l_returnflag, 1.0::DOUBLE AS l_quantity, 0.1::DOUBLE AS l_discount FROM own",
        "orders": "SELECT c + 1000 * k AS o_orderkey, c AS o_custkey, DATE '2020-01-01' + (k * (c * 37 % 50))::INT AS o_orderdate FROM (SELECT DISTINCT c FROM own), range(2) AS r(k)",
        "part": "SELECT DISTINCT p AS p_partkey, 'g' AS p_brand, 't' AS p_type FROM own",
        "customer": "SELECT DISTINCT c AS c_custkey, CASE WHEN c % 2 = 0 THEN 'a' ELSE 'b' END AS c_mktsegment, (CASE WHEN c % 3 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS c_acctbal FROM own",
    }
    for name, sql in tables.items():
        db.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    for name in ("survival_cascade", "survival_cascade_by_project", "survival_by_pair"):
        got = models.QUERIES[name](spark, str(tmp_path))
        sql = db.execute(f"SELECT {', '.join(got.columns)} FROM ({models.SQL[name]})").fetchall()
        rows = lambda t: sorted((tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in t), key=str)
        assert rows(map(tuple, got.collect())) == rows(sql) and len({r[1:3] for r in sql}) >= 300
    for name in ("survival_cascade_verdicts", "survival_by_pair_p"):
        assert models.QUERIES[name](spark, str(tmp_path)).select("pos1", "pos2").distinct().count() >= 300


def test_template_axes_and_stability(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 4)) * [1, 1, 1, 0.5]
    score = rng.normal(size=200)
    x[np.abs(score) > 1.2] *= [6, 1, 1, 1]
    df = spark.createDataFrame([(k, v.tolist(), float(s)) for k, (v, s) in enumerate(zip(x, score, strict=True))], "k int, x array<double>, s double")
    strong = np.abs(score) >= np.quantile(np.abs(score), 0.9)
    axis = np.linalg.eigh(np.cov(x[strong].T))[1][:, -1]
    axes = subspaces.template_axes(df, "x", "s", 1)
    assert abs(np.dot(axes.first().axis, axis)) == pytest.approx(1, abs=1e-9)
    inside = (x @ axis) ** 2 / (x * x).sum(axis=1)
    a, b = inside[strong], inside[np.abs(score) <= np.quantile(np.abs(score), 0.5)]
    got = subspaces.template_contrast(df, axes, "x", "s").first()
    assert (got.n1, got.n2, got.u) == (len(a), len(b), sum((p > q) + 0.5 * (p == q) for p in a for q in b)) and got.z > 3
    assert (got.top_median, got.bottom_median) == pytest.approx((np.median(a), np.median(b)), abs=1e-9)
    runs = {r.fraction: r for r in calibration.stability(df, "x", "k", [0.3, 1.0], 4, tests=20).collect()}
    assert runs[1.0].n == 200 and runs[1.0].cv == pytest.approx(0, abs=1e-9) and 30 < runs[0.3].n < 90 and runs[0.3].cv > 0
    cells = calibration.covariance(calibration.gram(df.withColumn("g", df.k * 0), ["g"], "x"), ["g"])
    top = np.linalg.eigvalsh(np.cov(x.T))[-1]
    assert {r.ridge: r.change for r in calibration.ridge_sensitivity(cells, ["g"], [1e-6, 1.0]).collect()} == pytest.approx({1e-6: 0, 1.0: np.sqrt((top + 1e-6) / (top + 1)) - 1}, abs=1e-9)


def test_token_offsets_and_maps_of_longer_tokens(spark):
    # Two bases a token; the last token moves most, but leaves no room for the sequence.
    whole = [(0, [0.0]), (1, [0.0]), (2, [0.0]), (3, [0.0])]
    probe = [(0, [0.1]), (1, [2.0]), (2, [0.0]), (3, [9.0])]
    frame = lambda rows: spark.createDataFrame([("s", t, v) for t, v in rows], "id string, token int, vec array<double>")
    from pyspark.sql import functions as F

    offsets = maps.token_offset(frame(whole), frame(probe), ["id"], F.lit(2))
    assert offsets.first().offset == 1
    mutant = spark.createDataFrame([("s", i, alt, t, [float(i + t + (alt == "C"))]) for i in range(4) for alt in "AC" for t in range(4)], "id string, pos_i int, alt string, token int, vec array<double>")
    for distance in (maps.l2, embedding.custom_distance(lambda a, b: abs(a - b).max())):
        for mean in (False, True):
            got = maps.perturbation_map(frame(whole), mutant, offsets.withColumn("length", F.lit(4)), ["id"], 2, distance, mean)
            moved = lambda i, j: i + 1 + j // 2 + (0.5 if mean else 1)
            assert {(r.pos_i, r.pos_j): r.score for r in got.collect()} == {(i, j): max(moved(i, j), moved(j, i)) for i in range(4) for j in range(4) if i != j}


def test_predictions_must_sum_to_one(spark):
    df = spark.createDataFrame([(1, "ACGT"), (2, "")], "id int, seq string")
    assert embedding.nucleotides(df, "seq", embedding.window_predictor, ["id"]).count() == 16
    with pytest.raises(Exception, match="sum to one"):
        embedding.nucleotides(df, "seq", lambda: lambda s: np.ones((len(s), 4)), ["id"]).collect()
