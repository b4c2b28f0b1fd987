"""The minimum covariance determinant against numpy."""

import numpy as np
import pytest

from tern.llm import outliers
from tern.session import materialize

D = outliers.D


def plain_step(x, m, cov):
    """Location, scatter and log determinant of the next half."""
    d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(cov), x - m)
    b = np.floor(np.log2(np.maximum(d, 1e-12)) * outliers.FINE)
    half, w, left = np.ceil(len(x) * outliers.SHARE), np.zeros(len(x)), 0.0
    for k in np.unique(b):
        n = (b == k).sum()
        w[b == k] = min(1.0, max(0.0, (half - left) / n))
        left += n
    assert np.isclose(w.sum(), half)
    return plain_moments(x, w)


def plain_moments(x, w):
    m = (w[:, None] * x).sum(axis=0) / w.sum()
    cov = outliers.CONSISTENCY * ((w[:, None] * (x - m)).T @ (x - m) / w.sum()) + outliers.TINY**2 * np.eye(D)
    return m, cov, np.linalg.slogdet(cov)[1]


def plain_mcd(x):
    """The lowest end of both starts, and all log determinants on the way."""
    low = lambda v: np.quantile(v, 0.5, axis=0, method="inverted_cdf")
    mid = low(x)
    starts = [(mid, np.diag((low(np.abs(x - mid)) * 1.4826) ** 2 + outliers.TINY**2)), plain_moments(x, np.ones(len(x)))[:2]]
    ends, falls = [], []
    for m, cov in starts:
        before = None
        for _ in range(outliers.STEPS):
            m, cov, log = plain_step(x, m, cov)
            falls.append(0 if before is None else log - before)
            if before is not None and not log < before - outliers.SETTLED:
                break
            before = log
        ends.append((log, m, cov))
    return min(ends, key=lambda e: e[0]), falls


def groups(seed=3):
    """Clean rows with junk, a group with ties and one third of equal rows, and
    one whose dimensions are mostly zero."""
    r = np.random.default_rng(seed)
    a = r.normal(size=(D, D))
    clean = r.normal(size=(900, D)) @ a.T
    junk = r.normal(size=(400, D)) * 0.3 + 25
    ties = np.round(r.normal(size=(600, D)), 1)
    ties[:200] = ties[0]
    flat = r.normal(size=(500, D)) * np.array([1, 1, 0, 0, 0.01, 1e-6])
    flat[::5, 2] = 1.0
    return {"junk": np.concatenate([clean, junk]), "ties": ties, "flat": flat}


@pytest.mark.parametrize("few", [20_000, 1])
def test_estimates_equal_numpy(spark, monkeypatch, few):
    """Also where groups are joined by salt."""
    monkeypatch.setattr(outliers, "FEW", few)
    of = groups()
    rows = [(g, k % outliers.SALTS, *map(float, v)) for g, x in of.items() for k, v in enumerate(x)]
    ddl = "_t_group string, _t_salt int, " + ", ".join(f"{c} double" for c in outliers.X)
    got = {r["_t_group"]: r for r in outliers.estimates(materialize(spark.createDataFrame(rows, ddl), "test-mcd")).collect()}
    for g, x in of.items():
        (log, m, cov), falls = plain_mcd(x)
        assert max(falls) <= 1e-9  # steps never raise the determinant
        assert np.isclose(got[g]["_t_log"], log, atol=1e-6), g
        assert np.allclose([got[g][f"_t_m{i}"] for i in range(D)], m, atol=1e-6)
        v = np.zeros((D, D))
        for i, j in outliers.PAIRS:
            v[i, j] = got[g][f"_t_v{i}_{j}"]
        assert np.allclose(v.T @ v @ cov, np.eye(D), atol=1e-5)
    # the junk is no part of the estimate
    centre = np.array([got["junk"][f"_t_m{i}"] for i in range(D)])
    assert np.abs(centre).max() < 1


def test_no_start_of_many_ends_much_lower():
    """Random starts as a measure of the two that are used."""
    r = np.random.default_rng(9)
    x = groups()["junk"]
    used = plain_mcd(x)[0][0]
    for _ in range(20):
        pick = x[r.choice(len(x), D + 1, replace=False)]
        m, cov = pick.mean(axis=0), np.cov(pick.T) + 1e-3 * np.eye(D)
        for _ in range(40):
            m, cov, log = plain_step(x, m, cov)
        assert log > used - 0.05
