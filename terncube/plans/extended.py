"""Queries of study areas, covariate layers, lineage, regions and replicate jobs, registered beside the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from terncube.operators import area as A
from terncube.operators import grid as G
from terncube.operators import jobs as J
from terncube.operators import lineage as N
from terncube.operators import metrics as M
from terncube.operators import replicates as R
from terncube.operators import sampling as S
from terncube.operators import storage as D
from terncube.plans.queries import AREA, BASE, BLOCKS, CURRENT, INDEX, P4, REG, _by_year, query, r, summary_sql
from terncube.sources import fixtures as X
from terncube.sources import layers as L

GRID = A.Grid(4_000_000.0, 3_600_000.0, 20_000.0, 40, 60)
_lon, _lat = G.laea_sql("lon", "lat")


# ---- study areas


def _outline_sql(where: str) -> str:
    verts = f"verts AS (SELECT country || '/' || name || '/' || part AS part, ring, seq, {_lon} AS x, {_lat} AS y FROM ({X.boundaries_sql()}) WHERE {where})"
    sides = "sides AS (SELECT x AS x1, y AS y1, coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(y) OVER w, first(y) OVER w) AS y2 FROM verts WINDOW w AS (PARTITION BY part, ring ORDER BY seq))"
    cells = f"cells AS (SELECT i AS cell_id, {GRID.xmin} + (i % {GRID.ncol}) * {GRID.res} AS xl, {GRID.ymax} - (i // {GRID.ncol} + 1) * {GRID.res} AS yl FROM (SELECT unnest(range({GRID.ncol * GRID.nrow})) AS i))"
    span = lambda a, d, lo: f"CASE WHEN {d} = 0 THEN CASE WHEN {a} BETWEEN {lo} AND {lo} + {GRID.res} THEN 0 ELSE 2 END ELSE least(({lo} - {a}) / {d}, ({lo} + {GRID.res} - {a}) / {d}) END"
    stop = lambda a, d, lo: f"CASE WHEN {d} = 0 THEN CASE WHEN {a} BETWEEN {lo} AND {lo} + {GRID.res} THEN 1 ELSE -1 END ELSE greatest(({lo} - {a}) / {d}, ({lo} + {GRID.res} - {a}) / {d}) END"
    touch = f"greatest(0, {span('x1', '(x2 - x1)', 'xl')}, {span('y1', '(y2 - y1)', 'yl')}) <= least(1, {stop('x1', '(x2 - x1)', 'xl')}, {stop('y1', '(y2 - y1)', 'yl')})"
    yc, xc = f"(yl + {GRID.res / 2})", f"(xl + {GRID.res / 2})"
    crossed = f"(y1 <= {yc}) <> (y2 <= {yc}) AND {xc} < x1 + ({yc} - y1) * (x2 - x1) / (y2 - y1)"
    inside = f"inside AS (SELECT cell_id FROM cells, sides GROUP BY cell_id HAVING bool_or({touch}) OR sum(CAST({crossed} AS INT)) % 2 = 1)"
    return f"{verts}, {sides}, {cells}, {inside}"


GERMANY = _outline_sql("country = 'DEU' AND level = 0")


def _germany(s):
    return A.rasterise(A.outline(X.boundaries(s)), GRID)


@query("study_area_cells", f"WITH {GERMANY} SELECT CAST(cell_id AS BIGINT) AS cell_id FROM inside")
def _(s, d):
    return _germany(s)


@query("region_cells", f"WITH {_outline_sql('level = 1 AND lower(name) IN (' + repr('sachsen') + ', ' + repr('bayern') + ')')} SELECT CAST(cell_id AS BIGINT) AS cell_id FROM inside")
def _(s, d):
    regions = [A.rasterise(A.outline(X.boundaries(s), ["DEU"], [name]), GRID) for name in ("SACHSEN", "Bayern")]
    return A.dissolve(*regions)


@query("widened_area", f"WITH {GERMANY} SELECT DISTINCT CAST(c.cell_id AS BIGINT) AS cell_id FROM cells c, cells i WHERE i.cell_id IN (SELECT cell_id FROM inside) AND sqrt((c.xl - i.xl) ** 2 + (c.yl - i.yl) ** 2) <= 45000")
def _(s, d):
    return A.widen(_germany(s), GRID, 45_000)


@query("points_in_area", X.with_views(f", {GERMANY} SELECT row_id FROM training WHERE floor((3600000 - y) / 20000) * 40 + floor((x - 4000000) / 20000) IN (SELECT cell_id FROM inside) AND x < 4800000 AND y > 2400000", "training").replace(") , verts", "), verts"))
def _(s, d):
    return A.points_inside(X.training(s, d).select("row_id", "x", "y"), _germany(s), GRID).select("row_id")


@query("area_fingerprint", f"WITH {GERMANY} SELECT 'Germany|' || CAST(CAST(round(min(x)) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(round(max(x)) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(round(min(y)) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(round(max(y)) AS BIGINT) AS VARCHAR) || '|' || count(*) || '|' || CAST(CAST(round(sum(x + y)) AS BIGINT) AS VARCHAR) || '|buffer1000' AS stamp FROM verts")
def _(s, d):
    return A.fingerprint(A.outline(X.boundaries(s)), "Germany", 1000)


STAMPS = [("a", "Germany|4000000,4600000,2700000,3500000|15|9|buffer1000"), ("b", "Saxony|4400000,4600000,3000000,3200000|9|9|buffer0"), ("c", "broken|x,2,3,4|9|9|buffer0"), ("d", "short|1,2")]


@query("stamp_covers", "SELECT * FROM (VALUES ('a', true), ('b', false), ('c', false), ('d', false)) t(id, covers)")
def _(s, d):
    return A.with_cover(s.createDataFrame(STAMPS, "id string, stamp string"), (3_999_100.0, 4_600_900.0, 2_699_100.0, 3_500_900.0)).select("id", "covers")


@query("crop_report", "SELECT * FROM (VALUES ('scale_1', 'elevation', 'current'), ('scale_1', 'slope', 'cropped and masked'), ('scale_1', 'old', 'cropped and masked'), ('scale_50', 'bioclim_2012-2017_scale_50', 'training window, left as it is')) t(scale, name, action)")
def _(s, d):
    stamp = STAMPS[0][1]
    files = [("scale_1", "elevation", 5, stamp, 7), ("scale_1", "slope", 5, None, None), ("scale_1", "old", 9, stamp, 7), ("scale_50", "bioclim_2012-2017_scale_50", 5, None, None)]
    table = s.createDataFrame(files, "scale string, name string, version int, stamp string, stamp_version int")
    return A.crop_report(table, stamp, (4_000_000.0, 4_600_000.0, 2_700_000.0, 3_500_000.0))


# ---- covariate layers

YEARS = "yrs AS (SELECT unnest(range(2014, 2023)) AS year)"
USE = "use AS (SELECT cell_id, y AS year, 'arable' AS name, q AS value FROM lbase UNION ALL SELECT b.cell_id, b.y, 'hedges', CASE WHEN b.y > 2016 THEN b.d ELSE f.d END FROM lbase b LEFT JOIN lbase f ON f.cell_id = b.cell_id AND f.y = 2017)"
HETERO = "SELECT cell_id, y AS year, 'landscape_heterogeneity' AS name, q * d AS value FROM lbase WHERE y % 2 = 0"
COVER = "SELECT cell_id, y AS year, CASE WHEN y < 2018 THEN 2012 ELSE 2018 END AS snap, CASE WHEN y < 2018 THEN f12 ELSE f18 END AS value FROM lcell, (SELECT DISTINCT y FROM lbase)"
RELIEF = "SELECT cell_id, y AS year, unnest(['elevation', 'slope']) AS name, unnest([high, low]) AS value FROM lcell, (SELECT DISTINCT y FROM lbase)"


def _years(s):
    return s.range(2014, 2023).select(F.col("id").cast("int").alias("year"))


@query("landscape_covariates", X.with_views(f", {USE} SELECT CAST(year AS INT) AS year, name || '_' || year AS name, cell_id, {r('value', 'value')} FROM use UNION ALL SELECT year, name, cell_id, round(value, 6) + 0.0 FROM ({HETERO}) UNION ALL SELECT year, 'forest_' || snap, cell_id, round(value, 6) + 0.0 FROM ({COVER}) UNION ALL SELECT year, name, cell_id, round(value, 6) + 0.0 FROM ({RELIEF})", "lbase", "lcell").replace(") , use", "), use"))
def _(s, d):
    return L.landscape(X.layers(s, d), _years(s))


HABITAT = ["arable", "hedges", "forest", "elevation", "slope"]


@query("habitat_covariates", X.with_views(f", {USE} SELECT CAST(u.year AS INT) AS year, u.cell_id, {', '.join(r(x, n) for n, x in zip(HABITAT, ('u.value', 'h.value', 'c.value', 'high', 'low')))} FROM lcell l JOIN ({COVER}) c USING (cell_id) LEFT JOIN use u ON u.cell_id = l.cell_id AND u.year = c.year AND u.name = 'arable' LEFT JOIN use h ON h.cell_id = l.cell_id AND h.year = c.year AND h.name = 'hedges' WHERE u.year IS NOT NULL UNION ALL SELECT c.year, l.cell_id, NULL, NULL, round(c.value, 6) + 0.0, round(high, 6) + 0.0, round(low, 6) + 0.0 FROM lcell l JOIN ({COVER}) c USING (cell_id) WHERE (l.cell_id, c.year) NOT IN (SELECT (cell_id, y) FROM lbase)", "lbase", "lcell").replace(") , use", "), use"))
def _(s, d):
    return L.wide(L.covariate_stack(X.layers(s, d), "habitat", _years(s)), HABITAT)


@query("climate_covariates", X.with_views(f"SELECT y AS year, unnest(['bio1', 'bio2']) AS name, cell_id, unnest([round(t, 6) + 0.0, round(d, 6) + 0.0]) AS value FROM lbase", "lbase"))
def _(s, d):
    return L.covariate_stack(X.layers(s, d), "climate", _years(s))


@query("missing_predictors", f"WITH {YEARS} SELECT CAST(year AS INT) AS year, CASE WHEN year BETWEEN 2015 AND 2021 THEN 'landscape_heterogeneity' ELSE 'arable,landscape_heterogeneity' END AS missing FROM yrs WHERE year % 2 = 1 OR year NOT BETWEEN 2015 AND 2021")
def _(s, d):
    return L.missing_predictors(L.landscape(X.layers(s, d), _years(s)), ["arable", "landscape_heterogeneity", "x"], _years(s))


@query("complete_cells", X.with_views(f"SELECT CAST(y AS INT) AS year, cell_id, {r('d', 'hedges')}, {r('4000000.0::DOUBLE + (cell_id % 40 + 0.5) * 20000', 'x')} FROM lbase WHERE y >= 2017 AND cell_id % 3 = 0 UNION ALL SELECT b.y, b.cell_id, round(f.d, 6) + 0.0, 4000000.0::DOUBLE + (b.cell_id % 40 + 0.5) * 20000 FROM lbase b JOIN lbase f ON f.cell_id = b.cell_id AND f.y = 2017 WHERE b.y < 2017 AND b.cell_id % 3 = 0", "lbase"))
def _(s, d):
    cells = L.wide(L.covariate_stack(X.layers(s, d), "habitat", _years(s)), HABITAT)
    return L.complete_cells(cells, ["hedges", "x"], GRID, cells.where("cell_id % 3 = 0").select("cell_id"))


@query("valid_layers", X.with_views(f"SELECT name, year, {r('min(value)', 'least')}, {r('max(value)', 'most')}, coalesce(max(value) > 0, false) AS valid FROM (SELECT 'arable' AS name, y AS year, q AS value FROM lbase UNION ALL SELECT 'hedges', y, CASE WHEN y > 2016 THEN d END FROM lbase) GROUP BY 1, 2", "lbase"))
def _(s, d):
    use = X.layers(s, d).where("scale = 'habitat' and kind = 'landuse'")
    return L.valid_layers(use, ["name", "year"])


@query("suitability", X.with_views(f"SELECT year, CAST(fr * 40 + fc AS BIGINT) AS cell_id, CASE WHEN sum(CASE WHEN v IS NOT NULL THEN w END) > 1 - 1e-9 THEN round(sum(w * v), 6) + 0.0 END AS value FROM (SELECT t.year, fr, fc, t.clim AS v, greatest(0, 1 - abs((fr + 0.5) / 4 - 0.5 - floor(t.cell_id / 10))) * greatest(0, 1 - abs((fc + 0.5) / 4 - 0.5 - t.cell_id % 10)) AS w FROM triples t JOIN (SELECT unnest(range(44)) AS fr) ON abs((fr + 0.5) / 4 - 0.5 - floor(t.cell_id / 10)) < 1 JOIN (SELECT unnest(range(40)) AS fc) ON abs((fc + 0.5) / 4 - 0.5 - t.cell_id % 10) < 1 WHERE fr < 44) WHERE w > 0 GROUP BY year, fr, fc", "triples"))
def _(s, d):
    maps = X.triples(s, d).select(F.lit("brt").alias("algo"), "year", "cell_id", F.col("clim").alias("prob"))
    return L.suitability(maps, "brt", 4, 40, 44)


@query("covariate_cache", X.with_views("SELECT CAST(y AS INT) AS year, 'arable' AS name, cell_id, round(q, 6) + 0.0 AS value FROM lbase", "lbase"))
def _(s, d):
    path = D.shared_folder(s, "covariates")
    L.write_cache(X.layers(s, d).where("scale = 'habitat' and name = 'arable'").select("year", "name", "cell_id", "value"), path, "scale_02")
    return L.read_cache(s, path, "scale_02")


@query("cube_round_trip", X.with_views("SELECT species, year, replicate, cell_id, round(round_even(prob * 30000, 0) / 30000.0::DOUBLE, 6) + 0.0 AS prob FROM cube", "cube"))
def _(s, d):
    path = D.shared_folder(s, "cube")
    D.write_cube(X.cube(s, d), path)
    return D.read_cube(s, path).select("species", "year", "replicate", "cell_id", "prob")


@query("union_runs", X.with_views("SELECT species, year, replicate, cell_id, round(prob, 6) + 0.0 AS prob FROM cube WHERE replicate <> 0", "cube"))
def _(s, d):
    cube = X.cube(s, d)
    return D.union_runs([cube.where("replicate < 3"), cube.where("replicate >= 3 or replicate = 0")])


@query("layer_digest", X.with_views("SELECT count(*) AS n FROM cube", "cube"))
def _(s, d):
    one, two = (D.digest(X.cube(s, d).repartition(k), ["species", "year", "replicate", "cell_id", "prob"]) for k in (3, 7))
    return one.join(two, ["n", "sum", "xor"]).select("n")


@query("two_layers", X.with_views(f"SELECT cell_id, {r('brt', 'mean_prob')}, brt >= 0.5 AS is_present FROM by_cell", "by_cell"))
def _(s, d):
    return D.two_layers(X.members(s, d).where("member = 'brt'").select("cell_id", "prob"), 0.5)


@query("combined_layers", X.with_views(f"SELECT cell_id, {r('brt', 'brt')}, {r('glm', 'glm')}, {r('gam', 'gam')} FROM by_cell", "by_cell"))
def _(s, d):
    members = X.members(s, d)
    same = D.assert_same(members.where("member = 'brt'"), members.where("member = 'glm'"), ["cell_id"])
    of = lambda df, m: df.where(F.col("member") == m).select("cell_id", F.col("prob").alias(m))
    return D.combine([of(same, "brt"), of(members, "glm"), of(members, "gam")])


# ---- regions and indices

IN_AREA = "cell_id % 10 BETWEEN 1 AND 6"
FINAL = f"rf AS (SELECT species, CAST(floor(floor(cell_id / 10) / 2) AS INT) AS row, CAST(floor((cell_id % 10) / 2) AS INT) AS col, year, replicate, sum(prob) AS s, count(prob) AS n FROM cube WHERE {IN_AREA} AND replicate < 4 GROUP BY ALL), cnt AS (SELECT CAST(floor(floor(cell_id / 10) / 2) AS INT) AS row, CAST(floor((cell_id % 10) / 2) AS INT) AS col, count(DISTINCT cell_id) AS nGerman FROM cube WHERE {IN_AREA} GROUP BY 1, 2)"


def _area(cube):
    return cube.where(IN_AREA).select("cell_id").distinct()


@query("regional_final", f"WITH cube AS ({X.SQL['cube']}), {FINAL} SELECT species, row, col, year, replicate, {r('s / n', 'mean')}, n AS N, nGerman FROM rf JOIN cnt USING (row, col)")
def _(s, d):
    cube = X.cube(s, d)
    band = (F.col("cell_id") % 2 + 1).cast("int")
    runs = cube.withColumn("run", F.when(F.col("replicate") < 4, "a").otherwise("b")).withColumn("band", band)
    return R.regional_final(runs.where("run = 'a' or band = 1"), _area(cube), 2, 2)  # run b lacks a band


RIX = f"{REG}, rix AS (SELECT a.row, a.col, a.year, a.replicate, 100 * exp(avg(ln((a.s / a.n) / (b.s / b.n)))) AS ix FROM reg a JOIN reg b USING (species, row, col, replicate) WHERE b.year = {BASE} AND b.s / b.n >= 1e-6 AND a.s / a.n > 0 GROUP BY ALL)"


def _rix(s, d):
    return R.regional_index(R.regional_means(X.cube(s, d)), BASE)


@query("regional_summary", f"WITH cube AS ({X.SQL['cube']}), {RIX} SELECT row, col, year, {summary_sql('ix')} FROM rix WHERE replicate <> 0 GROUP BY row, col, year HAVING count(*) >= 2")
def _(s, d):
    return R.regional_summary(_rix(s, d))


@query("regional_change", f"WITH cube AS ({X.SQL['cube']}), {RIX} SELECT row, col, {summary_sql('x', 'delta', True)} FROM (SELECT c.row, c.col, c.ix - b.ix AS x FROM rix c JOIN rix b USING (row, col, replicate) WHERE c.year = {CURRENT} AND b.year = {BASE} AND replicate <> 0) GROUP BY row, col HAVING count(*) >= 2")
def _(s, d):
    return R.regional_change(_rix(s, d), CURRENT, BASE)


@query("regional_trend", f"WITH cube AS ({X.SQL['cube']}), {RIX} SELECT row, col, {summary_sql('slope', 'slope', True)} FROM (SELECT row, col, replicate, round(regr_slope(ix, year) * 10, 9) AS slope, count(*) AS n FROM rix WHERE replicate <> 0 GROUP BY ALL) WHERE n = (SELECT count(DISTINCT year) FROM rix WHERE replicate <> 0) AND n >= 5 GROUP BY row, col HAVING count(*) >= 2")
def _(s, d):
    return R.regional_trend(_rix(s, d))


@query("regional_coverage", f"WITH cube AS ({X.SQL['cube']}), {FINAL} SELECT row, col, {r('nGerman / 4.0::DOUBLE', 'coverage')} FROM cnt")
def _(s, d):
    return R.regional_coverage(_area(X.cube(s, d)), 2)


@query("regional_parity", f"WITH cube AS ({X.SQL['cube']}), {RIX} SELECT count(*) AS n, CAST(0 AS BIGINT) AS nullMismatch, 0.0::DOUBLE AS maxDiff, 0.0::DOUBLE AS relMean, 'OK' AS verdict FROM rix WHERE replicate = 0")
def _(s, d):
    """Replicate 0 through the whole cube and alone: the same index."""
    cube = X.cube(s, d)
    alone = R.regional_index(R.regional_means(cube.where("replicate = 0")), BASE)
    return R.parity(_rix(s, d).where("replicate = 0"), alone, ["row", "col", "year"], "index")


@query("analytical", f"WITH cube AS ({X.SQL['cube']}), {AREA}, {INDEX}, sp AS (SELECT species, year, avg(ix) AS m, stddev_samp(ix) AS sd FROM ind WHERE replicate <> 0 GROUP BY ALL), y AS (SELECT year, exp(avg(ln(m))) AS est, sqrt(sum((sd / m) * (sd / m))) / count(*) AS se FROM sp GROUP BY year) SELECT year, {r('est', 'est')}, {r('est * exp(-1.6448536269514722 * se)', 'lwr')}, {r('est * exp(1.6448536269514722 * se)', 'upr')} FROM y")
def _(s, d):
    return R.analytical_index(R.species_index(R.area_means(X.cube(s, d)), BASE))


# ---- lineage and configuration

MADE = "made AS (SELECT o_custkey AS a, max(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE))) AS v FROM orders GROUP BY 1), used AS (SELECT o_custkey + 1 AS a, max(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE))) AS v FROM orders GROUP BY 1)"


@query("freshness", f"WITH {MADE} SELECT CAST(a AS BIGINT) AS artefact, coalesce(made.v >= coalesce(used.v, made.v), false) AS fresh FROM made FULL JOIN used USING (a)")
def _(s, d):
    day = F.datediff("o_orderdate", F.lit("1990-01-01").cast("date"))
    orders = X.table(s, d, "orders")
    outputs = orders.select(F.col("o_custkey").cast("long").alias("artefact"), day.alias("version"))
    return N.freshness(outputs, orders.select((F.col("o_custkey") + 1).cast("long").alias("artefact"), F.lit("x").alias("source"), day.alias("version")))


@query("stale_years", "SELECT * FROM (VALUES ('A', 2001), ('A', 2002)) t(species, year)")
def _(s, d):
    fits = s.createDataFrame([("A", "oof", "ens", -1.25, 2.0), ("B", "oof", "ens", 0.5, 0.0)], "species string, source string, basis string, b0 double, b1 double")
    now = fits.select("species", N.ridge_id(F.col("source"), F.col("basis"), [F.col("b0"), F.col("b1")]).alias("ridge"))
    maps = now.withColumn("year", F.explode(F.array(F.lit(2001), F.lit(2002)))).withColumn("ridge", F.when(F.col("species") == "A", "old").otherwise(F.col("ridge")))
    return N.stale_years(maps, now)


@query("climate_stamp", "SELECT l_returnflag AS species, md5(string_agg(DISTINCT 'bioclim_' || (year(l_shipdate) - 5) || '-' || year(l_shipdate) || '=' || md5(CAST(year(l_shipdate) AS VARCHAR)), ';' ORDER BY 'bioclim_' || (year(l_shipdate) - 5) || '-' || year(l_shipdate) || '=' || md5(CAST(year(l_shipdate) AS VARCHAR)))) AS stamp FROM lineitem GROUP BY 1")
def _(s, d):
    y = F.year("l_shipdate")
    name = F.concat(F.lit("bioclim_"), (y - 5).cast("string"), F.lit("-"), y.cast("string"))
    files = X.table(s, d, "lineitem").select(F.col("l_returnflag").alias("species"), name.alias("name"), F.md5(y.cast("string")).alias("md5"))
    return N.file_stamp(files)


@query("learning_rates", "SELECT * FROM (VALUES ('A', 'habitat', 0.02::DOUBLE, 0.02::DOUBLE), ('A', 'climate', 0.08, 0.01), ('R', 'habitat', 0.04, 0.04)) t(species, scale, rate, after)")
def _(s, d):
    rate = "species string, scale string, rate double"
    wanted = s.createDataFrame([("A", "habitat"), ("A", "climate"), ("R", "habitat")], "species string, scale string")
    state = s.createDataFrame([("R", "habitat", 0.04), ("A", "habitat", 0.02)], rate)
    start = N.starting_rate(wanted, s.createDataFrame([("A", "habitat", 0.02)], rate), state)
    fits = s.createDataFrame([("A", "climate", 2, 0.01), ("R", "habitat", 1, 0.5), ("A", "habitat", 2, None)], "species string, scale string, chunk int, rate double")
    return start.join(N.settled(state, fits, 2).withColumnRenamed("rate", "after"), ["species", "scale"])


@query("jobs_to_start", "SELECT * FROM (VALUES ('A', true), ('R', false)) t(species, start)")
def _(s, d):
    done = [("A", "climate", 1, 1), ("A", "landscape", 1, 1), ("A", "habitat", 6, 6), ("R", "climate", 1, 1), ("R", "landscape", 1, 1), ("R", "habitat", 5, 6)]
    return N.to_start(s.createDataFrame(done, "species string, scale string, chunk int, chunks int"), ["climate", "landscape", "habitat"])


@query("resume", X.with_views("SELECT DISTINCT species, year FROM cube WHERE year > 1997", "cube"))
def _(s, d):
    pieces = X.cube(s, d).select("species", "year").distinct()
    return N.resume(pieces.where("year <= 1997"), pieces, ["species", "year"])


@query("labels", "SELECT * FROM (VALUES ('A', 'scale_02_scale_1_scale_50', 'reps_000-050')) t(species, label, run)")
def _(s, d):
    scales = s.createDataFrame([("A", 50000), ("A", 200), ("A", 1000)], "species string, resolution int")
    named = N.model_label(scales.withColumn("label", D.scale_label(F.col("resolution"))))
    return named.withColumn("run", N.run_label(F.lit(0), F.lit(50)))


@query("memo", X.with_views("SELECT year, count(*) AS n FROM cube GROUP BY year", "cube"))
def _(s, d):
    root, key = D.shared_folder(s, "memo"), N.content_key("years", {"least": 1, "cores": 8}, ["a"], ignore=["cores"])
    make = lambda: X.cube(s, d).groupBy("year").agg(F.count("*").alias("n"))
    N.memo(s, root, key, make)
    return N.memo(s, root, key, lambda: make().where("false"))  # the second is read, not made


@query("replicate_batches", X.with_views("SELECT replicate, CAST(ceil(row_number() OVER (ORDER BY replicate) / 3.0) AS INT) AS batch FROM (SELECT DISTINCT replicate FROM cube)", "cube"))
def _(s, d):
    return S.batches(X.cube(s, d), 3)


# ---- draws and models

DRAWS = f"WITH training AS ({X.SQL['training']}), {BLOCKS}"


@query("block_folds", f"{DRAWS} SELECT CAST(least(10, count(DISTINCT block_id)) AS BIGINT) AS folds, count(DISTINCT block_id) AS blocks FROM rws")
def _(s, d):
    rows = X.training(s, d).select(G.block_id(F.col("x"), F.col("y"), 100_000).alias("block_id"))
    return S.block_folds(rows).agg(F.count_distinct("fold").alias("folds"), F.count("*").alias("blocks"))


@query("replicate_log", f"{DRAWS} SELECT replicate, CAST(sum(multiplicity) AS BIGINT) AS rowsDrawn, CAST(sum(multiplicity * occurrence) AS BIGINT) AS presDrawn, CAST(sum(multiplicity * (1 - occurrence)) AS BIGINT) AS absDrawn, 1 AS attempts FROM rws JOIN times USING (block_id) GROUP BY replicate UNION ALL SELECT 0, count(*), sum(occurrence), sum(1 - occurrence), 0 FROM rws")
def _(s, d):
    return J.replicate_log(*_drawn(s, d))


def _drawn(s, d):
    rows = X.training(s, d).withColumn("block_id", G.block_id(F.col("x"), F.col("y"), 100_000))
    return rows, s.createDataFrame([(0, 0), *[(i, 7919 * i) for i in (1, 2, 3)]], "replicate int, seed long")


@query("replicate_glm")
def _(s, d):
    """Coefficients of every replicate's logistic model."""
    rows, replicates = _drawn(s, d)
    return J.coefficients(J.replicate_fits(rows, replicates, "logistic", P4), ["replicate"], P4)


@query("replicate_oof")
def _(s, d):
    rows, replicates = _drawn(s, d)
    return J.out_of_fold(rows, replicates, "logistic", P4)


@query("replicate_ridge")
def _(s, d):
    """Ridge weights of every replicate, from its own out-of-fold predictions of two models."""
    rows, replicates = _drawn(s, d)
    both = J.out_of_folds(rows, replicates, "logistic", {"first": P4[:2], "second": P4[2:]}, keep=["block_id"])
    return J.coefficients(J.replicate_ridge(both, rows, replicates, ["first", "second"]), ["replicate"], ["first", "second"])


@query("replicate_bands", X.with_views("SELECT cell_id, year, replicate, CAST(round_even(30000 / (1 + exp(-(b0 + b1 * clim + b2 * land + b3 * hab))), 0) AS INT) AS packed FROM triples, (VALUES (1, -1.0::DOUBLE, 2.0::DOUBLE, 0.0::DOUBLE, 0.5::DOUBLE), (2, -0.5, 1.0, 0.25, 0.0)) t(replicate, b0, b1, b2, b3)", "triples"))
def _(s, d):
    weights = s.createDataFrame([(1, -1.0, 2.0, 0.0, 0.5), (2, -0.5, 1.0, 0.25, 0.0), (3, None, None, None, None)], "replicate int, intercept double, clim double, land double, hab double")
    return J.predict_replicates(X.triples(s, d), weights, ["clim", "land", "hab"]).withColumn("packed", F.col("packed").cast("int"))


@query("member_performance")
def _(s, d):
    seen = X.triples(s, d).groupBy("cell_id").agg((F.avg("clim") > 0.5).cast("int").alias("y"))
    return M.member_performance(X.members(s, d), seen)


@query("oof_comparison")
def _(s, d):
    return J.oof_comparison(_by_year(s, d).where("fold_id is not null"), {"first": P4[:2], "second": P4[2:]})
