"""Models of keys with many rows, fitted by passes, against the same models fitted in one task."""

import numpy as np
import pytest

from terncube.functions.fitters import fit_logistic, fit_ridge
from terncube.operators import jobs as J
from terncube.operators import models as L
from terncube.operators import spread as S

PREDICTORS = ["a", "b"]


@pytest.fixture
def rows(spark):
    rng = np.random.default_rng(7)
    a, b, u = rng.normal(3, 2, 900), rng.normal(0, 5, 900), rng.random(900)
    data = [(i // 2, i % 2, f"b{i % 7}", i % 3, int(v < 1 / (1 + np.exp(2 - x + 0.1 * y))), float(x), float(y)) for i, (x, y, v) in enumerate(zip(a, b, u, strict=True))]
    data[5] = (*data[5][:5], None, 1.0)
    return spark.createDataFrame(data, "row_id long, year int, block_id string, fold_id int, occurrence int, a double, b double").cache()


def arrays(rows):
    return L._arrays(rows.toPandas(), PREDICTORS, "occurrence")


@pytest.mark.parametrize("family", ["ridge", "logistic"])
def test_a_key_with_many_rows_is_fitted_by_passes(monkeypatch, rows, family):
    monkeypatch.setattr(S, "LARGE", 100)
    monkeypatch.setattr(L, "FITTERS", {})  # no task may fit one
    got = J.coefficients(L.fit(rows, ["year"], family, PREDICTORS), ["year"], PREDICTORS).toPandas().set_index("year")
    for year in (0, 1):
        x, y = arrays(rows.where(f"year = {year}"))
        lam = L.pickle.loads(L.fit(rows, ["year"], family, PREDICTORS).where(f"year = {year}").first()["model"])["lambda"]
        b = fit_logistic(x, y)["b"] if family == "logistic" else fit_ridge(x, y, lam=lam)["b"]
        assert np.allclose(got.loc[year].to_numpy(), b, atol=1e-6)
        assert family == "logistic" or 1e-4 <= lam <= 1


def test_importance_by_passes(monkeypatch, rows):
    monkeypatch.setattr(S, "LARGE", 100)
    got = {r["predictor"]: r["importance"] for r in L.importance(rows, PREDICTORS).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9 and got["a"] > got["b"] >= 0


def test_copies_of_drawn_blocks_are_fitted_by_passes(monkeypatch, spark, rows):
    seeds = spark.createDataFrame([(0, 0), (1, 7919)], "replicate int, seed long")
    plain = J.coefficients(J.replicate_fits(rows, seeds, "logistic", PREDICTORS), ["replicate"], PREDICTORS).toPandas().sort_values("replicate").to_numpy()
    monkeypatch.setattr(S, "LARGE", 100)
    monkeypatch.setattr(L, "FITTERS", {})
    spread = J.coefficients(J.replicate_fits(rows, seeds, "logistic", PREDICTORS), ["replicate"], PREDICTORS).toPandas().sort_values("replicate").to_numpy()
    assert np.allclose(plain, spread, atol=1e-6)


def test_held_out_folds_and_drawn_replicates_by_passes(monkeypatch, spark, rows):
    seeds = spark.createDataFrame([(0, 0), (1, 7919)], "replicate int, seed long")
    order = ["replicate", "row_id", "fold_id"]
    plain = J.out_of_fold(rows, seeds, "logistic", PREDICTORS).toPandas().sort_values(order)["p"].to_numpy()
    cv = L.block_cv(rows, ["year"], "logistic", PREDICTORS).toPandas().sort_values(["row_id", "year"])["p"].to_numpy()
    monkeypatch.setattr(S, "LARGE", 100)
    monkeypatch.setattr(L, "FITTERS", {})
    monkeypatch.setattr(J, "FITTERS", {})
    spread = J.out_of_fold(rows, seeds, "logistic", PREDICTORS).toPandas().sort_values(order)["p"].to_numpy()
    assert np.allclose(plain, spread, atol=1e-6, equal_nan=True) and np.isnan(spread).sum() == 2
    assert np.allclose(cv, L.block_cv(rows, ["year"], "logistic", PREDICTORS).toPandas().sort_values(["row_id", "year"])["p"].to_numpy(), atol=1e-6, equal_nan=True)


def test_weights_of_replicates_by_passes(monkeypatch, spark, rows):
    """Row ids repeat here: no record may meet the predictions of another."""
    seeds = spark.createDataFrame([(0, 0)], "replicate int, seed long")
    rows = rows.withColumn("row_id", rows["row_id"] % 3)
    monkeypatch.setattr(S, "LARGE", 100)
    both = J.out_of_folds(rows, seeds, "logistic", {"first": ["a"], "second": ["b"]}, keep=["block_id"])
    assert both.count() == 900
    fit = J.replicate_ridge(both, rows, seeds, ["first", "second"]).first()
    assert fit["presences"] + fit["absences"] == 899
    x, y = L._arrays(both.toPandas(), ["first", "second"], "occurrence")
    model = L.pickle.loads(fit["model"])
    assert np.allclose(model["b"], fit_ridge(x, y, lam=model["lambda"])["b"], atol=1e-6)


def test_comparison_counts_every_row_once(monkeypatch, rows):
    """Row ids repeat: joined by them the combined model would be judged on more rows."""
    rows = rows.withColumn("row_id", rows["row_id"] % 3).dropna()
    monkeypatch.setattr(S, "LARGE", 100)
    one = J.oof_comparison(rows, {"first": ["a"], "second": ["b"]}).toPandas().set_index("variant")
    x, y = L._arrays(rows.toPandas(), ["a"], "occurrence")
    assert len(one) == 6
    assert abs(one.loc["first alone, in-sample", "AUC"] - _auc(y, x[:, 0])) < 1e-6
    judged = L.block_cv(rows.selectExpr("*", "0 AS __key"), ["__key"], "ridge", ["a", "b"])
    assert judged.count() == 899 and judged.where("p is null").count() == 0


def _auc(y, x):
    wins = (x[y == 1][:, None] > x[y == 0]) + 0.5 * (x[y == 1][:, None] == x[y == 0])
    return max(wins.mean(), 1 - wins.mean())


def test_members_predict_each_row_once(rows):
    """Row ids repeat: a join of the members by them would multiply rows."""
    repeated = rows.withColumn("row_id", rows["row_id"] % 3)
    got = L.member_cv(repeated, ["year"], ["glm", "logistic"], PREDICTORS)
    assert got.count() == 900
    order = ["row_id", "year"]
    plain = L.block_cv(rows, ["year"], "glm", PREDICTORS).toPandas().sort_values(order)["p"].to_numpy()
    ours = L.member_cv(rows, ["year"], ["glm"], PREDICTORS).toPandas().sort_values(order)["glm"].to_numpy()
    assert np.allclose(plain, ours, atol=1e-9, equal_nan=True)


def test_held_out_folds_of_a_penalty_take_one_pass(monkeypatch, spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(20_000, 2))
    y = (rng.random(20_000) < 1 / (1 + np.exp(1 - 0.8 * x[:, 0] + 0.3 * x[:, 1]))).astype(int)
    df = spark.createDataFrame([(0, i, int(c), float(a), float(b)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "__g int, row_id long, occurrence int, a double, b double").cache()
    seen, plain = [], S._pass
    monkeypatch.setattr(S, "_pass", lambda rows, state, *more: (seen.append((len(state[0].b), len(np.unique(state[0].b, axis=0)))), plain(rows, state, *more))[1])
    near = S.ridges(df, PREDICTORS, "occurrence")
    assert sum(models > 25 for models, _ in seen) == 1 and seen[-1][1] <= 25  # ten folds share the models of all rows
    errors, own = [], S._near_errors
    monkeypatch.setattr(S, "_near_errors", lambda *a: errors.append(own(*a)) or {})
    ends, newton = [], S.newton
    monkeypatch.setattr(S, "newton", lambda rows, state, *more: (newton(rows, state, *more), ends.append(state[0]))[0])
    exact = S.ridges(df, PREDICTORS, "occurrence")
    assert near[1] == exact[1] and np.allclose(near[0][0].linear(0), exact[0][0].linear(0))
    n = exact[2][0].n
    assert np.allclose(errors[0][0], ends[-1].deviance.reshape(10, 25).T / n, atol=1e-7)
