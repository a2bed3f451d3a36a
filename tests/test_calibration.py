"""Distances of the recalibration query against numpy, with global and binned matrices."""

import numpy as np
import pytest

from duoscope.plans import geometry


def shrunk(x, ridge=1e-6):
    """Ledoit and Wolf's estimate, as they state it."""
    n, d = x.shape
    x = x - x.mean(axis=0)
    s = x.T @ x / n
    mu = np.trace(s) / d
    delta = ((s - mu * np.eye(d)) ** 2).sum() / d
    beta = sum(((np.outer(r, r) - s) ** 2).sum() for r in x) / n**2 / d
    a = min(beta, delta) / delta
    return (1 - a) * s + (a * mu + ridge) * np.eye(d)


def test_mahalanobis_columns(spark, sf):
    rows = {r.pair: r for r in geometry.residuals(spark, sf).collect()}
    nulls = [r for r in rows.values() if r.is_null]
    bins = {b for b in {r.bin for r in nulls} if sum(r.bin == b for r in nulls) >= 20}
    of = lambda rs: np.linalg.inv(shrunk(np.array([r.residual for r in rs])))
    inv = {-1: of(nulls), **{b: of([r for r in nulls if r.bin == b]) for b in bins}}
    got = geometry.mahalanobis_columns(spark, sf).collect()
    assert len(got) == len(rows) and bins
    for g in got:
        r = rows[g.pair]
        for kind, m in (("global", inv[-1]), ("binned", inv[r.bin if r.bin in bins else -1])):
            d = {n: np.sqrt(np.array(v) @ m @ np.array(v)) for n, v in (("epi_mahal", r.residual), ("mahal_obs", r.obs), ("mahal_add", r.add))}
            assert [g[f"{kind}_{n}"] for n in d] == pytest.approx(list(d.values()), rel=1e-6)
            assert g[f"{kind}_log_mahal_ratio"] == pytest.approx(np.log(d["mahal_obs"] / d["mahal_add"]), abs=1e-6)
