"""Spectra, inverses and distances in blocks against numpy, at d = 64."""

import numpy as np
import pytest

from duoscope.operators import calibration, spectra

D = 64


@pytest.fixture(scope="module")
def sets():
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(D, D))
    return {"a": rng.normal(size=(400, D)) * np.linspace(5, 0.2, D) @ mix / 8, "b": rng.normal(size=(300, D)) + 2.0, "few": rng.normal(size=(20, D))}


@pytest.fixture(scope="module")
def df(spark, sets):
    return spark.createDataFrame([(k, n, r.tolist()) for k, m in sets.items() for n, r in enumerate(m)], "k string, n long, x array<double>").repartition(6)


@pytest.mark.parametrize("k, block", [(5, 6), (D, 16)])
def test_eigenpairs(df, sets, k, block):
    got = {}
    for r in spectra.eigenpairs(df, ["k"], "x", k, block).collect():
        got.setdefault(r.k, {})[r["rank"]] = r
    for key, x in sets.items():
        c = np.cov(x.T)
        values, axes = np.linalg.eigh(c)
        values = np.maximum(values[::-1], 0)
        assert [got[key][j + 1].value for j in range(k)] == pytest.approx(values[:k].tolist(), rel=1e-7, abs=1e-9)
        assert got[key][1].share == pytest.approx(values[0] / np.trace(c), rel=1e-8)
        for j in range(3):
            assert abs(np.dot(got[key][j + 1].axis, axes[:, ::-1][:, j])) == pytest.approx(1, abs=1e-6)


def test_dimensions_and_curves(df, sets):
    pairs = spectra.eigenpairs(df, ["k"], "x", D)
    curves = {}
    for r in spectra.effective_dimensions(pairs, ["k"]).collect():
        e = np.linalg.eigvalsh(np.cov(sets[r.k].T))[::-1]
        e = e[e > 1e-9]
        if r.k == "few":
            continue
        share = np.cumsum(e) / e.sum()
        p = e / e.sum()
        assert (r.dims_95, r.dims_99, r.n_values) == (np.searchsorted(share, 0.95) + 1, np.searchsorted(share, 0.99) + 1, D)
        assert (r.participation_ratio, r.condition, r.entropy) == pytest.approx((e.sum() ** 2 / (e**2).sum(), e[0] / e[-1], -(p * np.log(p)).sum()), rel=1e-6)
        curves[r.k] = np.interp(np.linspace(0, 1, 200), np.linspace(0, 1, D), share)
    got = {(r.key_a, r.key_b): r.r for r in spectra.curve_correlations(pairs, "k").collect()}
    assert got["a", "b"] == pytest.approx(np.corrcoef(curves["a"], curves["b"])[0, 1], abs=1e-7) and len(got) == 3


@pytest.mark.parametrize("size", [24, 256])
def test_inverse_distances_and_partial_correlations(df, sets, size):
    ridge = 1e-2
    cells = calibration.covariance(calibration.gram(df, ["k"], "x"), ["k"], ridge)
    blocks = spectra.inverse(spectra.in_blocks(cells, ["k"], size), ["k"])
    precision = spectra.cells_of(blocks, ["k"], size)
    want = {k: np.linalg.inv(np.cov(x.T) + ridge * np.eye(D)) for k, x in sets.items()}
    got = {k: np.zeros((D, D)) for k in sets}
    for r in precision.collect():
        got[r.k][r.i, r.j] = r.value
    for k in sets:
        assert np.abs(got[k] - want[k]).max() <= 1e-8 * np.abs(want[k]).max()
    for r in spectra.partial_correlations(precision, ["k"]).collect():
        s = np.sqrt(np.diag(want[r.k]))
        p = np.abs(want[r.k] / np.outer(s, s))[np.triu_indices(D, 1)]
        assert (r.mean_abs, r.max_abs, r.sparse_0_05) == pytest.approx((p.mean(), p.max(), (p < 0.05).mean()), abs=1e-9)
    a = precision.where("k = 'a'").drop("k")
    diff = {r.k: r.difference for r in spectra.relative_difference(a, precision, ["k"]).collect()}
    assert diff["b"] == pytest.approx(np.linalg.norm(want["b"] - want["a"]) / np.linalg.norm(want["a"]), rel=1e-8) and diff["a"] == 0
    odd = df.union(df.sparkSession.createDataFrame([("a", 900, [1.0]), ("none", 901, [0.0] * D), ("a", 902, None)], df.schema))
    for r in spectra.distances(odd, ["k"], blocks, {"m": "x"}, ["k", "n"], size, 40_000).collect():
        if r.n >= 900:
            assert r.m is None
        else:
            x = sets[r.k][r.n]
            assert r.m == pytest.approx(np.sqrt(x @ want[r.k] @ x), rel=1e-7)
