"""Rules of the cube operators on small fixtures, and models against plain numpy."""

import numpy as np
import pytest
from pyspark.errors import PySparkException

from terncube.functions.fitters import fit_logistic
from terncube.operators import area as A
from terncube.operators import grid as G
from terncube.operators import jobs as J
from terncube.operators import lineage as N
from terncube.operators import models as L
from terncube.operators import replicates as R
from terncube.operators import sampling as S
from terncube.operators import storage as D
from terncube.sources import fixtures as X
from terncube.sources import layers as Y


def test_nearest_record_of_missing_coordinates(spark):
    queries = spark.createDataFrame([(1, 9.0, 9.0), (2, None, 1.0), (3, 500.0, 0.0)], "id long, x double, y double")
    records = spark.createDataFrame([(7, 9.0, 8.0), (8, None, 1.0), (9, 9.0, 10.0)], "id long, x double, y double")
    got = {r["id"]: (r["ref_id"], r["d2"]) for r in G.nearest_record(queries, records, 0.5).collect()}
    assert got == {1: (7, 1.0), 2: (None, None), 3: (7, 491.0**2 + 64)}
    assert {r["ref_id"] for r in G.nearest_record(queries, records.limit(0), 0.5, rings=2).collect()} == {None}


def test_draws_are_repeated_until_both_classes_are_there(spark):
    rows = spark.createDataFrame([(i, int(i >= 38), f"b{i // 2}") for i in range(40)], "row_id long, occurrence int, block_id string")
    seeds = spark.createDataFrame([(i, 101 * i) for i in range(1, 30)], "replicate int, seed long")
    drawn = S.draw_blocks(rows, seeds, least=2)
    tries = {r["replicate"]: r["attempts"] for r in drawn.select("replicate", "attempts").distinct().collect()}
    assert set(tries) == set(range(1, 30)) and max(tries.values()) > 1
    assert all(r["usable"] for r in S.class_guard(S.block_draw(rows, seeds, least=2), 2).collect())
    assert S.draw_blocks(rows, seeds, least=1000, attempts=3).count() == 0


def test_communities_hold_the_same_species_in_every_replicate(spark):
    rows = [(s, y, r, 1, p) for s, p0 in (("a", 0.2), ("b", 0.6)) for y, p in ((2000, p0), (2010, p0 + 0.1)) for r in (1, 2, 3) if not (s == "b" and r == 3)]
    cube = spark.createDataFrame(rows, "species string, year int, replicate int, cell_id long, prob double")
    assert {r["replicate"] for r in R.common_replicates(R.paired(cube, 2010, 2000)).collect()} == {1, 2}
    bc = R.turnover(cube, 2010, 2000).first()
    assert abs(bc["mean"] - 0.2 / 1.8) < 1e-12 and bc["width"] == 0


def test_runs_without_a_band_are_skipped(spark):
    rows = [("a", "x", b, 2000, r, c, 0.5) for r in (1, 2) for b, c in ((1, 0), (2, 11))] + [("a", "y", 1, 2000, 3, 0, 0.9)]
    cube = spark.createDataFrame(rows, "species string, run string, band int, year int, replicate int, cell_id long, prob double")
    area = spark.createDataFrame([(0,), (1,), (55,)], "cell_id long")
    got = R.regional_final(cube, area, 2, 2).collect()
    assert {(r["replicate"], r["row"], r["col"], r["nGerman"], r["mean"]) for r in got} == {(1, 0, 0, 2, 0.5), (2, 0, 0, 2, 0.5)}


def test_outlines(spark):
    table = X.boundaries(spark)
    with pytest.raises(PySparkException, match="no outline"):
        A.outline(table, ["XXX"]).collect()
    far = table.withColumn("lon", table["lon"] - 60)
    with pytest.raises(PySparkException, match="outside"):
        A.outline(far).collect()
    grid = A.Grid(0.0, 10.0, 1.0, 10, 10)
    square = spark.createDataFrame([("p", 1, i, x, y) for i, (x, y) in enumerate([(2.2, 2.2), (7.8, 2.2), (7.8, 7.8), (2.2, 7.8)])], "part string, ring int, seq int, x double, y double")
    assert {r["cell_id"] for r in A.rasterise(square, grid).collect()} == {r * 10 + c for r in range(2, 8) for c in range(2, 8)}
    assert A.overlap((0, 5, 0, 5), (4, 9, -1, 3)) == (4, 5, 0, 3) and A.overlap((0, 1, 0, 1), (2, 3, 0, 1)) is None
    assert A.Grid(0.0, 10.0, 200.0, 100, 50).coarser(10_000) == A.Grid(0.0, 10.0, 10_000.0, 2, 1)


def test_layers_by_name():
    assert Y.resolve_names(["arable", "forest", "elevation"], ["arable_2019", "forest_2018", "forest_2012", "elevation"]) == ["arable_2019", "forest_2018", "elevation"]
    with pytest.raises(ValueError, match="b, c"):
        Y.resolve_names(["a", "b", "c"], ["a_2019"])


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0.5), ("b", 2, None)], "species string, replicate int, areaMean double")
    for _ in range(2):
        Y.append_csv(df, f"file://{tmp_path}/t")
    back = Y.read_csv(spark, f"file://{tmp_path}/t", "species string, replicate int, areaMean double")
    assert sorted(map(tuple, back.collect()), key=repr) == sorted([*map(tuple, df.collect())] * 2, key=repr)


def test_two_runs_with_one_id_raise(spark):
    one = spark.createDataFrame([(1, 0.5), (2, 0.5)], "replicate int, prob double")
    with pytest.raises(PySparkException, match="two runs"):
        D.union_runs([one, one]).collect()
    with pytest.raises(PySparkException, match="keys differ"):
        D.assert_same(one, one.where("replicate = 1"), ["replicate"]).collect()
    assert D.assert_same(one, one, ["replicate"]).count() == 2


def test_content_keys():
    key = N.content_key("f", {"a": 1, "cores": 2}, ["x", "y"], ignore=["cores"])
    assert key == N.content_key("f", {"cores": 8, "a": 1}, ["y", "x"], ignore=["cores"])
    assert key != N.content_key("f", {"a": 2}, ["x", "y"]) and key != N.content_key("f", {"a": 1}, ["x"])


def test_logistic_against_plain_newton(spark, sf):
    rows = X.training(spark, sf).limit(800).toPandas()
    x, y = rows[["p1", "p3"]].to_numpy(), rows["occurrence"].to_numpy(float)
    design, b = np.column_stack([np.ones(len(x)), x]), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.einsum("ij,j->i", design, b)))
        h = np.einsum("ij,i,ik->jk", design, p * (1 - p), design)
        g = np.einsum("ij,i->j", design, y - p)
        for j in range(3):  # Gauss-Jordan
            g[j], h[j] = g[j] / h[j, j], h[j] / h[j, j]
            for k in range(3):
                if k != j:
                    g[k], h[k] = g[k] - h[k, j] * g[j], h[k] - h[k, j] * h[j]
        b = b + g
    assert np.abs(fit_logistic(x, y)["b"] - b).max() < 1e-6


def test_failed_refits_fall_back_on_the_main_model(spark):
    fits = spark.createDataFrame([("a", 1, bytearray(b"x")), ("a", 2, None)], "species string, replicate int, model binary")
    main = spark.createDataFrame([("a", bytearray(b"m"))], "species string, model binary")
    got = {r["replicate"]: (bytes(r["model"]), r["fallback"]) for r in J.with_fallback(fits, main, ["species"]).collect()}
    assert got == {1: (b"x", False), 2: (b"m", True)}


def test_replicates_out_of_fold(spark, sf):
    rows = X.training(spark, sf).dropDuplicates(["row_id"]).orderBy("row_id").limit(600).withColumn("block_id", G.block_id(X.F.col("x"), X.F.col("y"), 100_000)).cache()
    seeds = spark.createDataFrame([(0, 0), (1, 7919)], "replicate int, seed long")
    got = J.out_of_fold(rows, seeds, "logistic", ["p1", "p3"]).toPandas()
    assert sorted(got.groupby("replicate").size()) == [600, 600] and not got["p"].isna().any()
    whole, zero = rows.toPandas(), got[got["replicate"] == 0].set_index("row_id")["p"]
    train = whole[whole["fold_id"] != 3]
    b = fit_logistic(train[["p1", "p3"]].to_numpy(), train["occurrence"].to_numpy(float))["b"]
    test = whole[whole["fold_id"] == 3]
    want = 1 / (1 + np.exp(-(b[0] + np.einsum("ij,j->i", test[["p1", "p3"]].to_numpy(), b[1:]))))
    assert np.abs(zero.loc[test["row_id"]].to_numpy() - want).max() < 1e-9
    fits = J.replicate_fits(rows, seeds, "logistic", ["p1", "p3"])
    assert J.coefficients(fits, ["replicate"], ["p1", "p3"]).where("intercept is not null").count() == 2
    assert L.fit(rows.limit(5), ["year"], "logistic", ["p1"]).where("model is not null").count() == 0
