"""Ridges on resampled rows by passes, against the same draws fitted in one place."""

import numpy as np
import pytest

from terncube.functions import fitters
from terncube.operators import models as L
from terncube.operators import resampled as R
from terncube.operators import spread as S

PREDICTORS = ["a", "b"]


def made(spark, rows):
    rng = np.random.default_rng(7)
    a, b, u = rng.integers(0, 30, rows) / 3, rng.integers(-9, 9, rows), rng.random(rows)
    data = [(i // 2, 1995 + i % 2, int(v < 1 / (1 + np.exp(2 - x + 0.1 * y))), float(x), float(y)) for i, (x, y, v) in enumerate(zip(a, b, u, strict=True))]
    data[5], data[6], data[7] = (1, None, *data[5][2:]), (1, 1995, 1, None, 2.0), (1, 1996, None, 3.0, 2.0)
    return spark.createDataFrame(data, "row_id long, year int, occurrence int, a double, b double").cache()


def drawn(found, r):
    """Predictors, response and fold of the rows of draw r."""
    parts, (sizes, names) = [], found.drawn.value
    for block in found.blocks.collect():
        x, y, n = R.train(np.frombuffer(block["data"]).reshape(-1, 5), 2)
        for k, w in enumerate(R.weights(sizes[r, :, names[block["block"]]], n, [found.seed, r, 1, block["block"]]).astype(int)):
            parts.append(np.column_stack([np.repeat(x, w, 0), np.repeat(y, w), np.full(w.sum(), k)]))
    rows = np.concatenate(parts)
    return rows[:, :2], rows[:, 2], rows[:, 3]


def ridge(x, y, fold):
    """fitters.fit_ridge with given folds: (coefficients, penalty)."""
    z = np.column_stack([np.ones(len(x)), (x - x.mean(0)) / x.std(0)])
    floor = np.array([-np.inf, 0, 0])
    errors = []
    for v in S.PATH:
        errors.append([])
        for k in range(5):
            t = fold != k
            b, _ = fitters.newton(z[t], y[t], np.array([0, v, v]) * t.sum(), floor=floor)
            errors[-1].append(fitters.deviance(y[~t], fitters.logistic(z[~t] @ b)) / (~t).sum())
    m, se = np.mean(errors, 1), np.std(errors, axis=1, ddof=1) / np.sqrt(5)
    lam = S.PATH[np.flatnonzero(m <= m.min() + se[m.argmin()])[0]]
    return fitters.fit_ridge(x, y, lam=lam)["b"], lam


@pytest.mark.parametrize("rows, far", [(900, R.FAR), (900, 0.0), (20_000, 9.0)])
def test_draws_by_passes_are_those_in_one_place(monkeypatch, spark, rows, far):
    monkeypatch.setattr(R, "KINDS", 300)
    monkeypatch.setattr(R, "FAR", far)
    found = R.Resampled(R._blocks(made(spark, rows), PREDICTORS, "occurrence"), 2, 3, 42)
    which, b, lam = found.ridges()
    assert list(which) == [0, 1, 2] and found.n == rows - 2
    for r in range(3):
        x, y, fold = drawn(found, r)
        assert len(y) == rows - 2 and np.ptp(np.bincount(fold.astype(int))) <= 1
        want, penalty = ridge(x, y, fold)
        assert np.isclose(lam[r], penalty)
        w = b[r][1:] / found.sd
        assert np.allclose([b[r][0] - (w * found.mean).sum(), *w], want, atol=1e-6)


def test_bootstrap_of_many_rows_takes_no_task_of_all_rows(monkeypatch, spark):
    df = made(spark, 900)
    plain = {r["year"]: r for r in L.trend_bootstrap(df, PREDICTORS, n=12).collect()}
    monkeypatch.setattr(S, "LARGE", 100)
    monkeypatch.setattr(L, "fit_ridge", None)  # no task may fit one
    got = {r["year"]: r for r in L.trend_bootstrap(df, PREDICTORS, n=12).collect()}
    assert set(got) == {1995, 1996}
    for year, r in got.items():
        assert r["nBootOK"] == 12 and r["lwr95"] < r["bootMean"] < r["upr95"]
        assert abs(r["bootMean"] - plain[year]["bootMean"]) < 4 * plain[year]["bootSE"] / 12**0.5


def test_bootstrap_of_one_class_has_no_rows(monkeypatch, spark):
    monkeypatch.setattr(S, "LARGE", 100)
    assert L.trend_bootstrap(made(spark, 900).where("occurrence = 1"), PREDICTORS, n=3).count() == 0


def test_draws_are_multinomial():
    n = np.array([1.0, 6.0, 3.0])
    got = np.array([R.weights(np.array([40, 60]), n, [s]) for s in range(400)])
    assert (got.sum(2) == [40, 60]).all() and np.allclose(got.mean(0), np.outer([40, 60], n / 10), atol=1)
    assert np.allclose(got[:, 1].var(0), 60 * n / 10 * (1 - n / 10), rtol=0.3)
