"""Fits that take equal rows once."""

import pickle

import numpy as np
import pytest

from terncube.functions import fitters
from terncube.operators import models


def made(rows=400, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 9, rows), rng.integers(0, 5, rows)]).astype(float)
    return x, (x[:, 0] + 2 * rng.normal(size=rows) > 4).astype(float), rng.integers(1, 5, rows)


@pytest.mark.parametrize("family, settings", [("rf", {"trees": 15}), ("nn", {"rounds": 20})])
def test_equal_rows_count(family, settings):
    x, y, n = made()
    at = np.random.default_rng(1).permutation(np.repeat(np.arange(len(y)), n))
    once, each = fitters.FITTERS[family](x, y, n=n, **settings), fitters.FITTERS[family](x[at], y[at], **settings)
    assert np.allclose(fitters.predict(once, x), fitters.predict(each, x), atol=1e-12)


def test_network_is_that_of_each_start_alone():
    x, y, _ = made()
    mean, sd = x.mean(0), x.std(0)
    z, got = np.column_stack([(x - mean) / sd, np.ones(len(x))]), fitters.fit_nn(x, y, seed=4, rounds=30, block=64)["nets"]
    for i, net in enumerate(got):
        rng = np.random.default_rng(4 + i)
        w = [rng.normal(0, 0.5, (3, 3)), rng.normal(0, 0.5, 4)]
        m, v = [0 * a for a in w], [0 * a for a in w]
        for t in range(1, 31):
            h = fitters.logistic(z @ w[0])
            h1 = np.column_stack([h, np.ones(len(z))])
            e = fitters.logistic(h1 @ w[1]) - y
            for k, g in enumerate([(z.T @ (e[:, None] * w[1][:-1] * h * (1 - h)) + 0.1 * w[0]) / len(y), (h1.T @ e + 0.1 * w[1]) / len(y)]):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - 0.05 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        assert np.allclose(net[0], w[0]) and np.allclose(net[1], w[1])


def test_forest_as_table_and_as_trees(monkeypatch):
    x, y, _ = made()
    table = fitters.fit_rf(x, y, trees=30)
    assert len(pickle.dumps(table)) < 20_000  # the means by bins, whatever the number of trees
    monkeypatch.setattr(fitters, "GRID", 0)
    trees = fitters.fit_rf(x, y, trees=30)
    assert trees["table"] is None and len(trees["trees"]) == 30
    assert np.allclose(fitters.predict(table, x), fitters.predict(trees, x))
    column, cut, mean = trees["trees"][0]
    leaves = {}
    for row in fitters._coded(x, trees["edges"]):
        node = 0
        while column[node] >= 0:
            node = 2 * node + 1 + (row[column[node]] > cut[node])
        leaves[node] = mean[node]
    assert len(leaves) > 3 and all(0 <= v <= 1 for v in leaves.values())


def test_registry_counts_rows_not_their_kinds(spark):
    rows = [(i, 1.0 * (i % 3), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, a double, occurrence int").selectExpr("'k' as k", "*")
    got = models.fit(df, ["k"], "nn", ["a"], rounds=5).first()
    assert (got["presences"], got["absences"], got["note"]) == (30, 30, "")


def test_boosted_trees_count_equal_rows():
    x, y, n = made()
    n[:3] = 70, 64, 129
    at = np.random.default_rng(1).permutation(np.repeat(np.arange(len(y)), n))
    limits = {"least_trees": 20, "most_trees": 300, "step": 10}
    once, each = fitters.search_brt(x, y, n=n, **limits), fitters.search_brt(x[at], y[at], **limits)
    assert once["rate"] == each["rate"] and once["best_trees"] == each["best_trees"]
    assert np.allclose(fitters.predict(once, x), fitters.predict(each, x), atol=1e-12)
    assert ((fitters.predict(once, x) > 0.5) == (y > 0.5)).mean() > 0.7


def test_boosted_trees_as_table_and_as_trees(monkeypatch):
    x, y, _ = made()
    table = fitters.fit_brt(x, y, trees=30)
    monkeypatch.setattr(fitters, "GRID", 0)
    trees = fitters.fit_brt(x, y, trees=30)
    assert trees["table"] is None and np.allclose(fitters.predict(table, x), fitters.predict(trees, x))


def test_bags_hold_their_rows():
    n = np.array([1, 64, 0, 200, 3])
    for bag in (0.75, 0.5):
        draws = fitters._bags(np.random.default_rng(2), np.stack([n, n // 2]), bag)
        both = np.array([next(draws) for _ in range(400)])
        for got, of in zip(both.swapaxes(0, 1), (n, n // 2), strict=True):
            assert (got.sum(1) == int(bag * of.sum())).all() and (got <= of).all() and (got >= 0).all()
            assert np.allclose(got.mean(0), of * int(bag * of.sum()) / of.sum(), atol=0.8)


def test_a_tree_on_kinds_is_that_on_rows():
    x, y, n = made(60)
    kinds = fitters.Kinds.of(x, y, n, np.zeros(n.sum(), int), 1)
    rows, p = kinds.rows[0].astype(float), 0.3
    both = np.stack([rows * (kinds.codes[0] > 1), rows])  # trees that grow together know nothing of each other
    column, cut, _, value = (part[1] for part in fitters._level_trees(kinds, kinds.keys(2), both, both * (kinds.y - p), both * p * (1 - p), 2, 5))
    best = {}
    for j in range(2):
        for c in range(kinds.widths[j]):
            low = kinds.codes[j] <= c
            if rows[low].sum() >= 5 and rows[~low].sum() >= 5:
                best[j, c] = sum((rows[m] * (kinds.y[m] - p)).sum() ** 2 / rows[m].sum() for m in (low, ~low))
    assert (column[0], cut[0]) == max(best, key=best.get)
    for v in np.unique(value):
        m = value == v
        assert np.isclose(v, (rows[m] * (kinds.y[m] - p)).sum() / (rows[m] * p * (1 - p)).sum())


def test_search_reaches_rows_by_their_fold(spark):
    """Row ids repeat, a row has no value, and one has no fold."""
    x, y, _ = made()
    rows = [("k", i % 9, None if i == 3 else i % 2, None if i == 5 else float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "k string, row_id int, fold_id int, a double, b double, occurrence int")
    got = models.block_cv(df, ["k"], "brt_search", ["a", "b"], least_trees=10, most_trees=400, step=10)
    assert got.count() == 399 and got.where("p is null").count() == 0
    for fold in (0, 1):
        t = df.where(f"fold_id <> {fold}").dropna().toPandas()
        model = fitters.search_brt(t[["a", "b"]].to_numpy(), t["occurrence"].to_numpy(float), least_trees=10, most_trees=400, step=10)
        test = df.where(f"fold_id = {fold}").toPandas()
        p = got.where(f"fold_id = {fold}").toPandas()["p"].to_numpy()
        assert np.allclose(np.sort(p), np.sort(fitters.predict(model, test[["a", "b"]].to_numpy(float))))


def test_a_search_runs_once_however_often_it_is_read(monkeypatch, spark, tmp_path):
    x, y, _ = made(80)
    log = tmp_path / "fits"

    def noted(x, y, n=None):
        with open(log, "a") as file:
            file.write("1")
        return fitters.fit_brt(x, y, trees=3, n=n)

    monkeypatch.setitem(models.FITTERS, "brt_search", noted)
    df = spark.createDataFrame([("k", i, i % 2, *map(float, a), int(c)) for i, (a, c) in enumerate(zip(x, y, strict=True))], "k string, row_id int, fold_id int, a double, b double, occurrence int")
    got = models.block_cv(df, ["k"], "brt_search", ["a", "b"])
    assert got.count() == 80 and got.where("p is null").count() == 0 and log.read_text() == "11"


@pytest.mark.parametrize("most", [1, 5, 200])
def test_kept_bags_are_those_drawn_anew(most):
    x, y, _ = made(60)
    n = np.random.default_rng(1).integers(1, most + 1, 60)
    kinds = fitters.Kinds.of(x, y, n, np.zeros(n.sum(), int), 1)
    both = np.concatenate([kinds.rows, kinds.rows // 2])
    kept, anew = fitters.Bags(kinds, both, 3, 0.75, 2000), fitters.Bags(kinds, both, 3, 0.75)
    for _ in range(2):
        for _, (a, ha), (b, hb) in zip(range(40), kept, anew):
            assert (a == b).all() and (ha == hb).all() and (a <= both).all()
    assert 0 < len(kept.kept) < 40 and not anew.kept


@pytest.mark.parametrize("family", ["glm", "gam"])
def test_smooth_fits_count_equal_rows(monkeypatch, family):
    x, y, n = made()
    monkeypatch.setattr(fitters, "BLOCK", 150)
    once, each = fitters.FITTERS[family](x, y, n=n), fitters.FITTERS[family](np.repeat(x, n, axis=0), np.repeat(y, n))
    assert np.allclose(fitters.predict(once, x), fitters.predict(each, x), atol=1e-9)


def test_members_meet_equal_rows_once(monkeypatch, spark, tmp_path):
    """A row has no value, one no class, one no fold, and one key has no number."""
    x, y, n = made(150)
    rows = [(None if i % 2 else 1, i, None if i == 3 else j % 3, None if i == 5 else float(a), float(b), None if i == 7 else int(c)) for i, ((a, b), c, k) in enumerate(zip(x, y, n, strict=True)) for j in range(3 * k)]
    df = spark.createDataFrame(rows, "k int, row_id int, fold_id int, a double, b double, occurrence int")
    log, plain = tmp_path / "sizes", dict(fitters.FITTERS)

    def noted(family):
        def fitted(x, y, **more):
            with open(log, "a") as file:
                file.write(f"{len(y)}\n")
            return plain[family](x, y, **more)

        return fitted

    for family in ("glm", "gam"):
        monkeypatch.setitem(models.FITTERS, family, noted(family))
    got = models.member_cv(df, ["k"], ["glm", "gam"], ["a", "b"]).toPandas()
    assert len(got) == sum(r[2] is not None for r in rows) and max(map(int, log.read_text().split())) <= 75
    t = df.where("fold_id is not null").toPandas()
    for null in (True, False):
        own, mine = t[t["k"].isna() == null], got[got["k"].isna() == null]
        for fold in range(3):
            train, test = own[own["fold_id"] != fold].dropna(subset=["a", "occurrence"]), own[own["fold_id"] == fold].sort_values("row_id")
            for family in ("glm", "gam"):
                model = plain[family](train[["a", "b"]].to_numpy(float), train["occurrence"].to_numpy(float))
                p = mine[mine["fold_id"] == fold].sort_values("row_id")[family].to_numpy(float)
                assert np.allclose(p, fitters.predict(model, test[["a", "b"]].to_numpy(float)), atol=1e-8, equal_nan=True)
