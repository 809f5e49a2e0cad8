"""Invariants of the operators on small hand-made inputs."""

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from terncube.functions import fitters
from terncube.operators import grid, metrics, models, replicates, sampling, storage, temporal


def test_bray_curtis(spark):
    df = spark.createDataFrame([("same", 0.4, 0.4), ("same", 0.2, 0.2), ("apart", 1.0, 0.0), ("apart", 0.0, 1.0), ("none", 0.0, 0.0)], "k string, p1 double, p0 double")
    got = {r["k"]: r["b"] for r in df.groupBy("k").agg(replicates.bray_curtis().alias("b")).collect()}
    assert got == {"same": 0.0, "apart": 1.0, "none": 0.0}


def test_trend_of_a_line(spark):
    rows = [("s", y, r, 1, 0.2 + 0.003 * (y - 2005)) for y in range(2005, 2026) for r in range(3)]
    got = replicates.trend_map(spark.createDataFrame(rows, "species string, year int, replicate int, cell_id long, prob double")).first()
    assert abs(got["slopeMean"] - 0.03) < 1e-9 and got["shareIncrease"] == 1.0


def test_trend_needs_every_year(spark):
    rows = [("s", y, r, c, 0.1) for y in range(2005, 2011) for r in range(3) for c in (1, 2) if not (c == 2 and y == 2007)]
    got = replicates.trend_map(spark.createDataFrame(rows, "species string, year int, replicate int, cell_id long, prob double"))
    assert [r["cell_id"] for r in got.collect()] == [1]


def test_summary_is_null_strict(spark):
    df = spark.createDataFrame([(1, 0.1), (1, None), (2, 0.1), (2, 0.3)], "k int, p double")
    got = {r["k"]: r["mean"] for r in df.groupBy("k").agg(*replicates.summary("p")).collect()}
    assert got[1] is None and abs(got[2] - 0.2) < 1e-12


def test_index_baseline_is_100(spark):
    means = spark.createDataFrame([("a", r, y, 0.1 * (r + 1) * (1 + y - 2005), 5) for r in range(4) for y in (2005, 2006)], "species string, replicate int, year int, areaMean double, nCells long")
    got = {r["year"]: r for r in replicates.index_summary(replicates.species_index(means, 2005)).collect()}
    assert got[2005]["lwr"] == got[2005]["upr"] == 100.0 and abs(got[2006]["mean"] - 200) < 1e-9


def test_neighbourhoods(spark):
    inner = grid.neighbours(spark.createDataFrame([(210,)], "cell_id long"), 20, 20)
    corner = grid.neighbours(spark.createDataFrame([(0,)], "cell_id long"), 20, 20)
    assert (inner.count(), corner.count()) == (25, 9)


def test_projection(spark):
    x, y = grid.laea(F.lit(11.5), F.lit(48.1))
    got = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert abs(got["x"] - 4432769) < 1 and abs(got["y"] - 2777406) < 1


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(3)
    q, r = rng.random((60, 2)), rng.random((90, 2))
    q[0], q[1] = (9.0, 9.0), r[5]
    r[7] = r[5]
    make = lambda a: spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(a)], "id long, x double, y double")
    got = {r_["id"]: r_["ref_id"] for r_ in grid.nearest_record(make(q), make(r), 0.05).collect()}
    assert got == {i: int(((p - r) ** 2).sum(1).argmin()) for i, p in enumerate(q)}


def test_packing_of_probabilities(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.123456,), (None,)], "p double").select("p", storage.unpack(storage.pack(F.col("p"))).alias("q"))
    for r in df.collect():
        assert (r["p"] is None) == (r["q"] is None) and (r["p"] is None or abs(r["p"] - r["q"]) <= 0.5 / 30000)


def test_cube_write_replaces_partitions_only(spark, tmp_path):
    path = f"file://{tmp_path}/cube"
    make = lambda y, p: spark.createDataFrame([("a", y, 1, p)], "species string, year int, cell_id long, prob double")
    storage.write_cube(make(2005, 0.1), path)
    storage.write_cube(make(2006, 0.2), path)
    storage.write_cube(make(2006, 0.3), path)
    assert sorted((r["year"], round(r["prob"], 4)) for r in storage.read_cube(spark, path).collect()) == [(2005, 0.1), (2006, 0.3)]


def test_runs_with_a_shared_replicate_are_refused(spark):
    a, b = (spark.createDataFrame([(0, x), (i, x)], "replicate int, prob double") for i, x in ((1, 0.1), (2, 0.2)))
    assert storage.union_runs([a, b]).count() == 2
    with pytest.raises(Exception, match="replicates in two runs"):
        storage.union_runs([a, a]).collect()


def test_empty_member_set_is_refused(spark):
    with pytest.raises(Exception, match="no members"):
        spark.range(1).select(storage.member_tag(F.array().cast("array<string>"))).collect()


def test_seed_of_non_ascii(spark):
    key = "Größe|1"
    want = sum(ord(c) * (i % 97 + 1) for i, c in enumerate(key, 1)) % 2147483629 + 1
    assert spark.range(1).select(sampling.stable_seed(F.lit(key)).alias("s")).first()["s"] == want


def test_snapshots(spark):
    got = spark.createDataFrame([(y,) for y in (2004, 2005, 2011, 2012, 2018, 2030)], "y int").select(temporal.snapshot_of(F.col("y")).alias("s")).collect()
    assert [r["s"] for r in got] == [2018, 2006, 2006, 2012, 2018, 2018]


def test_auc_with_ties(spark):
    rng = np.random.default_rng(1)
    y, p = rng.integers(0, 2, 200), rng.integers(0, 8, 200) / 8
    want = np.mean([(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]])
    assert abs(metrics.auc(spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p, strict=True)], "y int, p double")).first()["AUC"] - want) < 1e-12


@pytest.mark.parametrize("family", sorted(fitters.FITTERS))
def test_families_learn_and_refit_alike(family):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    y = (rng.random(400) < fitters.logistic(-0.5 + 2 * x[:, 0] + x[:, 1])).astype(float)
    p, again = (fitters.predict(fitters.FITTERS[family](x, y, seed=3), x) for _ in range(2))
    assert np.array_equal(p, again) and ((p >= 0) & (p <= 1)).all()
    assert p[y == 1].mean() - p[y == 0].mean() > 0.2


def test_ridge_weights_are_never_negative():
    rng = np.random.default_rng(6)
    x = rng.random((300, 3))
    y = (rng.random(300) < fitters.logistic(-1 + 2 * x[:, 0] - x[:, 2])).astype(float)
    assert (fitters.fit_ridge(x, y)["b"][1:] >= 0).all()


def test_models_per_key(spark):
    rng = np.random.default_rng(7)
    rows = [(k, int(i), int(i % 3), float(a), float(b), int(rng.random() < fitters.logistic(3 * a))) for k in ("u", "v") for i, (a, b) in enumerate(rng.normal(size=(150, 2)))]
    t = spark.createDataFrame([*rows, ("w", 0, 0, 1.0, 1.0, 1), ("u", 999, 0, None, 1.0, 1)], "k string, row_id long, fold_id int, a double, b double, occurrence int")
    fitted = models.fit(t, ["k"], "glm", ["a", "b"])
    assert {r["k"]: r["model"] is not None for r in fitted.collect()} == {"u": True, "v": True, "w": False}
    got = models.predict_with(t, fitted, ["k"], ["a", "b"])
    assert got.where("prob is null").count() == 2 and got.count() == 302
    assert models.block_cv(t.where("k <> 'w' and a is not null"), ["k"], "glm", ["a", "b"]).count() == 300


def test_trend_bootstrap_by_its_definition(spark):
    assert inspect.signature(models.trend_bootstrap).parameters["n"].default == 200
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 2)) * 3
    y = (x[:, 0] + rng.normal(size=120) > 1).astype(int)
    df = spark.createDataFrame([(i, 1995 + i % 2, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "row_id long, year int, a double, b double, occurrence int")
    got = {r["year"]: r for r in models.trend_bootstrap(df, ["a", "b"], n=6).collect()}
    means = []
    for draw in range(6):
        at = np.random.default_rng([42, draw]).integers(0, 120, 120)
        model = fitters.fit_ridge(x[at], y[at].astype(float), seed=[42, draw, 1], folds=5)
        means.append([fitters.predict(model, x[k::2]).mean() for k in (0, 1)])
    for k, year in enumerate((1995, 1996)):
        p = [m[k] for m in means]
        assert got[year]["nBootOK"] == 6
        assert np.allclose([got[year][c] for c in ("bootMean", "bootSE", "lwr95", "upr95")], [np.mean(p), np.std(p, ddof=1), *np.quantile(p, [0.025, 0.975])])


def test_tree_search_and_forest_as_the_reference_has_them(spark):
    limits = {k: v.default for k, v in inspect.signature(fitters.FITTERS["brt_search"]).parameters.items()}
    assert (limits["least_trees"], limits["most_trees"], limits["low"], limits["high"], limits["rounds"], limits["rate"]) == (1000, 5000, 1e-6, 1.0, 50, 0.08)
    assert inspect.signature(fitters.FITTERS["rf"]).parameters["trees"].default == 1000
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 2))
    y = (x[:, 0] + rng.normal(size=200) > 0).astype(float)
    model = fitters.search_brt(x, y, rng.integers(0, 3, 200), least_trees=100, most_trees=300, step=10)
    assert model["rate"] < 0.08 and 100 <= model["best_trees"] == len(model["trees"]) <= 300
    assert fitters.search_brt(x, np.ones(200)) is None
    df = spark.createDataFrame([("k", i, i % 2, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "k string, row_id int, fold_id int, a double, b double, occurrence int")
    none = {"least_trees": 100, "most_trees": 300, "low": 0.07, "high": 0.075}
    assert models.block_cv(df, ["k"], "brt_search", ["a", "b"], **none).where("p is null").count() == 200
    fitted = models.fit(df, ["k"], "brt_search", ["a", "b"], **none)
    assert fitted.first()["note"] == "no learning rate found"
    assert models.predict_with(df, fitted, ["k"], ["a", "b"]).where("prob is null").count() == 200


def test_registered_tree_queries_run_whole():
    from pathlib import Path

    text = Path(models.__file__).parents[1].joinpath("plans", "queries.py").read_text()
    cv = text.split('@query("gbt_cv")')[1].split("\n\n")[0]
    assert "brt_search" in cv and "where(\"year" not in cv and "trees" not in cv
