"""Registered queries of the cube operators, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terncube.operators import grid as G
from terncube.operators import jobs as J
from terncube.operators import metrics as M
from terncube.operators import models as L
from terncube.operators import replicates as R
from terncube.operators import sampling as S
from terncube.operators import storage as D
from terncube.operators import temporal as T
from terncube.sources import fixtures as X

BASE, CURRENT, FIVE, LAST = 1995, 2001, 1996, 2000
QUERIES: dict[str, Callable] = {}  # extended.py adds to both
SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; negative zero becomes zero."""
    return df.select([(F.round(F.col(f"`{c}`"), digits) + 0.0).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return add


def r(x: str, name: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name}"


def summary_sql(x: str, prefix: str = "", shares: bool = False) -> str:
    name = (lambda s: prefix + s.capitalize()) if prefix else (lambda s: s)
    lo, hi = f"quantile_cont({x}, 0.05)", f"quantile_cont({x}, 0.95)"
    out = [r(f"avg({x})", name("mean")), r(f"stddev_samp({x})", name("sd")), r(lo, name("lwr")), r(hi, name("upr")), r(f"{hi} - {lo}", name("width"))]
    if shares:
        out += [r(f"avg(CASE WHEN {x} < 0 THEN 1.0::DOUBLE ELSE 0 END)", "shareDecrease"), r(f"avg(CASE WHEN {x} > 0 THEN 1.0::DOUBLE ELSE 0 END)", "shareIncrease")]
    return ", ".join(out)


@query("unc_year_map", X.with_views(f"SELECT species, year, cell_id, {summary_sql('prob')} FROM cube WHERE replicate <> 0 GROUP BY species, year, cell_id HAVING count(*) >= 2", "cube"))
def _(s, d):
    return R.year_map(X.cube(s, d))


def _change_sql(cur: int, ref: int) -> str:
    return X.with_views(f"SELECT c.species, c.cell_id, {summary_sql('(c.prob - b.prob)', 'delta', True)} FROM cube c JOIN cube b USING (species, cell_id, replicate) WHERE c.year = {cur} AND b.year = {ref} AND replicate <> 0 GROUP BY c.species, c.cell_id HAVING count(*) >= 2", "cube")


for _name, _ref in (("baseline", BASE), ("5y", FIVE), ("last", LAST)):
    query(f"unc_change_{_name}", _change_sql(CURRENT, _ref))(lambda s, d, ref=_ref: R.change_map(X.cube(s, d), CURRENT, ref))


@query("unc_trend_decade", X.with_views(f"SELECT species, cell_id, {summary_sql('slope', 'slope', True)} FROM (SELECT species, cell_id, replicate, round(regr_slope(prob, year) * 10, 12) AS slope, count(*) AS n FROM cube WHERE replicate <> 0 GROUP BY ALL) JOIN (SELECT species, count(DISTINCT year) AS years FROM cube WHERE replicate <> 0 GROUP BY species) USING (species) WHERE n = years AND years >= 5 GROUP BY species, cell_id HAVING count(*) >= 2", "cube"))
def _(s, d):
    return R.trend_map(X.cube(s, d))


AREA = "area AS (SELECT species, year, replicate, sum(prob) AS s, count(prob) AS n FROM cube GROUP BY ALL), means AS (SELECT species, replicate, year, s / first_n AS areaMean, first_n AS nCells FROM area JOIN (SELECT species, year, arg_min(n, replicate) AS first_n FROM area GROUP BY ALL) USING (species, year))"
INDEX = f"ind AS (SELECT m.species, m.replicate, m.year, 100 * m.areaMean / b.areaMean AS ix FROM means m JOIN means b USING (species, replicate) WHERE b.year = {BASE})"


@query("area_mean", f"WITH cube AS ({X.SQL['cube']}), {AREA} SELECT species, replicate, year, {r('areaMean', 'areaMean')}, nCells FROM means")
def _(s, d):
    return R.area_means(X.cube(s, d))


REG = "reg AS (SELECT species, CAST(floor(floor(cell_id / 10) / 2) AS INT) AS row, CAST(floor((cell_id % 10) / 2) AS INT) AS col, year, replicate, sum(prob) AS s, count(prob) AS n FROM cube GROUP BY ALL)"


@query("regional_means", f"WITH cube AS ({X.SQL['cube']}), {REG} SELECT species, row, col, year, replicate, {r('s / n', 'mean')}, n AS N FROM reg")
def _(s, d):
    return R.regional_means(X.cube(s, d))


@query("national_means", f"WITH cube AS ({X.SQL['cube']}), {REG} SELECT species, year, replicate, {r('sum(s) / sum(n)', 'areaMean')}, CAST(sum(n) AS BIGINT) AS nCells FROM reg GROUP BY species, year, replicate")
def _(s, d):
    return R.national_means(R.regional_means(X.cube(s, d)))


SHARED = "shared AS (SELECT c.* FROM cube c SEMI JOIN (SELECT year, replicate FROM (SELECT year, replicate, count(DISTINCT species) AS k FROM cube WHERE replicate <> 0 GROUP BY ALL) JOIN (SELECT year, count(DISTINCT species) AS k FROM cube WHERE replicate <> 0 GROUP BY ALL) USING (year, k)) q ON c.year = q.year AND c.replicate = q.replicate)"


@query("richness", f"WITH cube AS ({X.SQL['cube']}), {SHARED} SELECT year, cell_id, {summary_sql('s')} FROM (SELECT year, cell_id, replicate, sum(prob) AS s FROM shared GROUP BY ALL) GROUP BY year, cell_id HAVING count(*) >= 2")
def _(s, d):
    return R.richness(X.cube(s, d))


PAIRED = f"pr AS (SELECT c.species, c.cell_id, c.replicate, c.prob AS p1, b.prob AS p0 FROM cube c JOIN cube b USING (species, cell_id, replicate) WHERE c.year = {CURRENT} AND b.year = {BASE}), pc AS (SELECT * FROM pr WHERE replicate IN (SELECT replicate FROM pr WHERE replicate <> 0 GROUP BY replicate HAVING count(DISTINCT species) = (SELECT count(DISTINCT species) FROM pr WHERE replicate <> 0)))"


@query("mean_delta_p", f"WITH cube AS ({X.SQL['cube']}), {PAIRED} SELECT cell_id, {summary_sql('x', 'delta', True)} FROM (SELECT cell_id, replicate, avg(p1 - p0) AS x FROM pc WHERE replicate <> 0 GROUP BY ALL) GROUP BY cell_id HAVING count(*) >= 2")
def _(s, d):
    return R.mean_delta(X.cube(s, d), CURRENT, BASE)


@query("bray_curtis", f"WITH cube AS ({X.SQL['cube']}), {PAIRED} SELECT cell_id, {summary_sql('x')} FROM (SELECT cell_id, replicate, sum(abs(p1 - p0)) / greatest(sum(p0 + p1), 1e-12) AS x FROM pc WHERE replicate <> 0 GROUP BY ALL) GROUP BY cell_id HAVING count(*) >= 2")
def _(s, d):
    return R.turnover(X.cube(s, d), CURRENT, BASE)


@query("community_change", f"WITH cube AS ({X.SQL['cube']}), {PAIRED} SELECT cell_id, {r('avg(p1 - p0)', 'meanDeltaP')}, CAST(sum(CAST(p1 >= 0.5 AND NOT p0 >= 0.5 AS INT)) - sum(CAST(p0 >= 0.5 AND NOT p1 >= 0.5 AS INT)) AS BIGINT) AS netGainLoss, CAST(sum(CAST(p1 >= 0.5 AND NOT p0 >= 0.5 AS INT)) AS BIGINT) AS gainCount, CAST(sum(CAST(p0 >= 0.5 AND NOT p1 >= 0.5 AS INT)) AS BIGINT) AS lossCount, {r('sum(abs(p1 - p0)) / greatest(sum(p0 + p1), 1e-12)', 'turnoverBC')} FROM pr WHERE replicate = 0 GROUP BY cell_id")
def _(s, d):
    return R.community_change(X.cube(s, d), CURRENT, BASE)


@query("species_index", f"WITH cube AS ({X.SQL['cube']}), {AREA}, {INDEX} SELECT species, year, {r('avg(ix)', 'mean')}, {r('quantile_cont(ix, 0.5)', 'median')}, {r('quantile_cont(ix, 0.05)', 'lwr')}, {r('quantile_cont(ix, 0.95)', 'upr')} FROM ind WHERE replicate <> 0 GROUP BY species, year")
def _(s, d):
    return R.index_summary(R.species_index(R.area_means(X.cube(s, d)), BASE))


@query("sbi", f"WITH cube AS ({X.SQL['cube']}), {AREA}, {INDEX} SELECT replicate, year, {r('exp(avg(ln(ix)))', 'index')} FROM ind GROUP BY replicate, year")
def _(s, d):
    return R.combined_index(R.species_index(R.area_means(X.cube(s, d)), BASE))


@query("chain", f"WITH cube AS ({X.SQL['cube']}), {AREA}, {INDEX}, steps AS (SELECT replicate, year, avg(coalesce(r, 0)) AS r FROM (SELECT *, ln(ix / lag(ix) OVER (PARTITION BY species, replicate ORDER BY year)) AS r FROM ind) GROUP BY ALL) SELECT replicate, year, {r('100 * exp(sum(r) OVER (PARTITION BY replicate ORDER BY year))', 'index')} FROM steps")
def _(s, d):
    return R.chain_index(R.species_index(R.area_means(X.cube(s, d)), BASE))


@query("msi", f"WITH cube AS ({X.SQL['cube']}), {AREA}, {INDEX}, sp AS (SELECT species, year, avg(ln(ix)) AS m, var_samp(ln(ix)) AS v FROM ind WHERE replicate <> 0 GROUP BY ALL), y AS (SELECT year, avg(m) AS m, sqrt(sum(v)) / count(*) AS se FROM sp GROUP BY year) SELECT year, {r('exp(m)', 'est')}, {r('exp(m - 1.6448536269514722 * se)', 'lwr')}, {r('exp(m + 1.6448536269514722 * se)', 'upr')} FROM y")
def _(s, d):
    return R.msi_index(R.species_index(R.area_means(X.cube(s, d)), BASE))


@query("regional_index", f"WITH cube AS ({X.SQL['cube']}), {REG} SELECT a.row, a.col, a.year, a.replicate, {r('100 * exp(avg(ln((a.s / a.n) / (b.s / b.n))))', 'index')}, count(*) AS n_species FROM reg a JOIN reg b USING (species, row, col, replicate) WHERE b.year = {BASE} AND b.s / b.n >= 1e-6 AND a.s / a.n > 0 GROUP BY a.row, a.col, a.year, a.replicate")
def _(s, d):
    return R.regional_index(R.regional_means(X.cube(s, d)), BASE)


@query("parity", X.with_views(f"SELECT count(*) AS n, CAST(sum(CAST((a.prob IS NULL) <> (b.prob IS NULL) AS INT)) AS BIGINT) AS nullMismatch, {r('max(abs(a.prob - b.prob))', 'maxDiff')}, {r('abs(avg(a.prob) - avg(b.prob)) / avg(a.prob)', 'relMean')}, CASE WHEN sum(CAST((a.prob IS NULL) <> (b.prob IS NULL) AS INT)) > 0.001 * count(*) OR max(abs(a.prob - b.prob)) > 1e-3 OR abs(avg(a.prob) - avg(b.prob)) / avg(a.prob) > 1e-3 THEN 'MISMATCH' ELSE 'OK' END AS verdict FROM (SELECT * FROM cube WHERE replicate = 0) a FULL JOIN (SELECT * FROM cube WHERE replicate = 1) b USING (species, year, cell_id)", "cube"))
def _(s, d):
    c = X.cube(s, d)
    return R.parity(c.where("replicate = 0"), c.where("replicate = 1"), ["species", "year", "cell_id"])


@query("ensemble_mean", X.with_views(f"SELECT cell_id, CASE WHEN count(prob) = count(*) THEN round(avg(prob), 6) + 0.0 END AS mean_prob, CASE WHEN count(prob) = count(*) THEN round(stddev_samp(prob), 6) + 0.0 END AS sd_members, CASE WHEN count(prob) = count(*) THEN avg(prob) >= 0.5 END AS is_present FROM members GROUP BY cell_id", "by_cell", "members"))
def _(s, d):
    return M.ensemble(X.members(s, d)).withColumn("is_present", F.col("mean_prob") >= 0.5)


@query("auc", X.with_views(f"SELECT {r('(sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0))::DOUBLE', 'AUC')} FROM (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS rk FROM scores)", "scores"))
def _(s, d):
    return M.auc(X.scores(s, d))


SCAN = "scan AS (SELECT t / 100.0::DOUBLE AS thresh, tp, fp, P - tp AS fn, N - fp AS tn, tp / P AS Sens, (N - fp) / N AS Spec, tp / P + (N - fp) / N - 1 AS TSS, (tp + N - fp) / (P + N) AS PCC, ((tp + N - fp) / (P + N) - pe) / (1 - pe) AS Kappa FROM (SELECT *, ((tp + fp) * P + (P - tp + N - fp) * N) / ((P + N) * (P + N)) AS pe FROM (SELECT t, count(*) FILTER (y = 1 AND k >= t)::DOUBLE AS tp, count(*) FILTER (y = 0 AND k >= t)::DOUBLE AS fp, count(*) FILTER (y = 1)::DOUBLE AS P, count(*) FILTER (y = 0)::DOUBLE AS N FROM (SELECT unnest(range(0, 101)) AS t), (SELECT y, floor(p * 100 + 1e-9) AS k FROM scores) GROUP BY t)))"
_scan = ", ".join(["thresh", *[f"CAST({c} AS BIGINT) AS {c}" for c in ("tp", "fp", "fn", "tn")], *[r(c, c) for c in ("Sens", "Spec", "TSS", "PCC", "Kappa")]])


@query("threshold_scan", f"WITH scores AS ({X.SQL['scores']}), {SCAN} SELECT {_scan} FROM scan")
def _(s, d):
    return M.threshold_scan(X.scores(s, d))


@query("confusion_metrics", f"WITH scores AS ({X.SQL['scores']}), {SCAN} SELECT {_scan} FROM scan ORDER BY round(TSS, 12) DESC, thresh LIMIT 1")
def _(s, d):
    return M.best_threshold(M.threshold_scan(X.scores(s, d)))


@query("explained_deviance", X.with_views(f"SELECT {r('1 - avg(y * ln(q) + (1 - y) * ln(1 - q)) / (avg(y) * ln(avg(y)) + (1 - avg(y)) * ln(1 - avg(y)))', 'D2')} FROM (SELECT y, greatest(1e-5::DOUBLE, least(0.9999::DOUBLE, p)) AS q FROM scores)", "scores"))
def _(s, d):
    return M.explained_deviance(X.scores(s, d))


@query("cell_lookup", X.with_views(f"SELECT row_id, loc.cell_id, {r('brt', 'value')} FROM (SELECT row_id, CASE WHEN y > 3000000 THEN CAST(floor((3600000 - y) / 60000) * 10 + floor((x - 4000000) / 60000) AS BIGINT) END AS cell_id FROM training) loc LEFT JOIN by_cell ON by_cell.cell_id = loc.cell_id", "training", "by_cell"))
def _(s, d):
    at = X.training(s, d).select("row_id", G.cell_of(F.col("x"), F.col("y"), 4_000_000.0, 3_600_000.0, 60_000.0, 10, 10).alias("cell_id"))
    values = X.members(s, d).where("member = 'brt'").select("cell_id", F.col("prob").alias("value"))
    return at.join(values, "cell_id", "left").select("row_id", "cell_id", "value")


@query("bilinear", X.with_views(f"SELECT id, CASE WHEN count(v) = 4 THEN round(sum(w * v), 6) + 0.0 END AS value FROM (SELECT t.cell_id AS id, (1 - abs(floor(t.cell_id / 10) + 0.25 - (floor(t.cell_id / 10) + a))) * (1 - abs(t.cell_id % 10 + 0.75 - (t.cell_id % 10 + b))) AS w, CASE WHEN t.cell_id % 10 + b < 10 THEN s.brt END AS v FROM by_cell t CROSS JOIN (SELECT unnest([0, 0, 1, 1]) AS a, unnest([0, 1, 0, 1]) AS b) LEFT JOIN by_cell s ON s.cell_id = (floor(t.cell_id / 10) + a) * 10 + t.cell_id % 10 + b) GROUP BY id", "by_cell"))
def _(s, d):
    values = X.members(s, d).where("member = 'brt'").select("cell_id", F.col("prob").alias("value"))
    targets = values.select(F.col("cell_id").alias("id"), (F.floor(F.col("cell_id") / 10) + 0.25).alias("row"), (F.col("cell_id") % 10 + 0.75).alias("col"))
    return G.bilinear(values, targets, 10)


@query("neighbours", X.with_views("SELECT DISTINCT CAST(rr * 10 + cc AS BIGINT) AS cell_id FROM (SELECT floor(cell_id / 10) + dr AS rr, cell_id % 10 + dc AS cc FROM by_cell, (SELECT unnest(range(-2, 3)) AS dr), (SELECT unnest(range(-2, 3)) AS dc)) WHERE rr BETWEEN 0 AND 99 AND cc BETWEEN 0 AND 9", "by_cell"))
def _(s, d):
    return G.neighbours(X.members(s, d).where("member = 'brt'").select("cell_id"), 10, 100)


@query("nearest_record", X.with_views("SELECT id, ref_id, round(d2, 6) + 0.0 AS d2 FROM (SELECT q.id, f.id AS ref_id, (q.x - f.x) * (q.x - f.x) + (q.y - f.y) * (q.y - f.y) AS d2, row_number() OVER (PARTITION BY q.id ORDER BY (q.x - f.x) * (q.x - f.x) + (q.y - f.y) * (q.y - f.y), f.id) AS k FROM pts q, pts f WHERE q.id % 5 = 0 AND f.id % 5 <> 0) WHERE k = 1", "pts"))
def _(s, d):
    return G.nearest_record(*X.points(s, d), size=0.02)


@query("mask_area", X.with_views(f"SELECT cell_id, {r('brt', 'value')} FROM by_cell WHERE cell_id % 10 BETWEEN 2 AND 7", "by_cell"))
def _(s, d):
    cells = X.members(s, d).where("member = 'brt'").select("cell_id", F.col("prob").alias("value"))
    return G.inside(cells, cells.where(F.col("cell_id") % 10 >= 2).where(F.col("cell_id") % 10 <= 7))


@query("coarse_counts", X.with_views("SELECT CAST(floor(floor(cell_id / 10) / 5) AS INT) AS row, CAST(floor((cell_id % 10) / 5) AS INT) AS col, count(*) AS n FROM by_cell GROUP BY 1, 2", "by_cell"))
def _(s, d):
    row, col = R.coarse(F.col("cell_id"), 5)
    return X.members(s, d).where("member = 'brt'").groupBy(row.alias("row"), col.alias("col")).agg(F.count("*").alias("n"))


_x, _y = G.laea_sql("(6 + c_custkey % 900 / 100.0::DOUBLE)", "(47 + c_custkey % 800 / 100.0::DOUBLE)")


@query("laea", f"SELECT CAST(c_custkey AS BIGINT) AS id, {r(_x, 'x', 3)}, {r(_y, 'y', 3)} FROM customer")
def _(s, d):
    x, y = G.laea(6 + F.col("c_custkey") % 900 / 100.0, 47 + F.col("c_custkey") % 800 / 100.0)
    return X.table(s, d, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("block_ids", X.with_views("SELECT block_id, count(*) AS n FROM (SELECT CAST(floor(x / 20000) AS BIGINT) || '_' || CAST(floor(y / 20000) AS BIGINT) AS block_id FROM training) GROUP BY block_id", "training"))
def _(s, d):
    return X.training(s, d).groupBy(G.block_id(F.col("x"), F.col("y"), 20_000).alias("block_id")).agg(F.count("*").alias("n"))


_edges = G.band_edges(10, 4)


@query("bands", X.with_views("SELECT band, count(*) AS n FROM (SELECT " + " + ".join(f"CAST(floor(cell_id / 10) >= {e} AS INT)" for e in _edges[:-1]) + " AS band FROM by_cell) GROUP BY band", "by_cell"))
def _(s, d):
    cells = X.members(s, d).where("member = 'brt'")
    return cells.groupBy(G.band_of(F.floor(F.col("cell_id") / 10), _edges).alias("band")).agg(F.count("*").alias("n"))


@query("corine_asof", "SELECT DISTINCT year(l_shipdate) + 10 AS year, CASE WHEN year(l_shipdate) + 10 BETWEEN 2005 AND 2011 THEN 2006 WHEN year(l_shipdate) + 10 BETWEEN 2012 AND 2017 THEN 2012 ELSE 2018 END AS snapshot FROM lineitem")
def _(s, d):
    years = X.table(s, d, "lineitem").select((F.year("l_shipdate") + 10).alias("year")).distinct()
    return years.withColumn("snapshot", T.snapshot_of(F.col("year")))


@query("backfill", X.with_views(f"SELECT a.cell_id, a.year, {r('CASE WHEN a.year IN (1999, 2000) THEN b.clim ELSE a.clim END', 'value')} FROM triples a LEFT JOIN triples b ON b.cell_id = a.cell_id AND b.year = 1998", "triples"))
def _(s, d):
    layers = X.triples(s, d).select("cell_id", "year", F.when(~F.col("year").isin(1999, 2000), F.col("clim")).alias("value"))
    return T.backfill(layers, F.when(F.col("year").isin(1999, 2000), 1998))


@query("years_union", "SELECT DISTINCT year(l_shipdate) AS year FROM lineitem UNION SELECT DISTINCT year(o_orderdate) FROM orders")
def _(s, d):
    return T.years_union(X.table(s, d, "lineitem").select(F.year("l_shipdate").alias("year")), X.table(s, d, "orders").select(F.year("o_orderdate").alias("year")))


@query("year_chunks", "SELECT year, CAST(ceil(k / ceil(n / 3.0)) AS INT) AS chunk FROM (SELECT year, row_number() OVER (ORDER BY year) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT year(l_shipdate) AS year FROM lineitem))")
def _(s, d):
    return T.year_chunks(X.table(s, d, "lineitem").select(F.year("l_shipdate").alias("year")).distinct(), 3)


@query("climatology", X.with_views(f"SELECT cell_id, year, {r('avg(clim) OVER (PARTITION BY cell_id ORDER BY year RANGE BETWEEN 5 PRECEDING AND CURRENT ROW)', 'value')} FROM triples", "triples"))
def _(s, d):
    return T.climatology(X.triples(s, d).select("cell_id", "year", F.col("clim").alias("value")))


@query("missing_layers", "SELECT DISTINCT species, year FROM (SELECT DISTINCT l_returnflag AS species FROM lineitem), (SELECT unnest(range(1995, 2004)) AS year) WHERE (species, year) NOT IN (SELECT (l_returnflag, year(l_shipdate)) FROM lineitem)")
def _(s, d):
    have = X.table(s, d, "lineitem").select(F.col("l_returnflag").alias("species"), F.year("l_shipdate").cast("long").alias("year")).distinct()
    need = have.select("species").distinct().withColumn("year", F.explode(F.sequence(F.lit(1995).cast("long"), F.lit(2003).cast("long"))))
    return D.missing(need, have, ["species", "year"])


@query("readiness", "SELECT l_returnflag AS species, count(DISTINCT year(l_shipdate)) FILTER (year(l_shipdate) BETWEEN 1995 AND 2001) = 7 AS ready FROM lineitem GROUP BY 1")
def _(s, d):
    have = X.table(s, d, "lineitem").select(F.col("l_returnflag").alias("species"), F.year("l_shipdate").alias("year")).distinct()
    need = have.select("species").distinct().withColumn("year", F.explode(F.sequence(F.lit(1995), F.lit(2001))))
    return D.readiness(need, have, "species", ["species", "year"])


@query("config_fallback", "SELECT DISTINCT l_returnflag AS species, CASE l_returnflag WHEN 'A' THEN 100 ELSE 200 END AS resolution FROM lineitem")
def _(s, d):
    wanted = X.table(s, d, "lineitem").select(F.col("l_returnflag").alias("species")).distinct()
    return D.resolve(wanted, s.createDataFrame([("A", 100), ("N", None)], "species string, resolution int"), ["species"], "resolution", F.lit(200))


@query("member_order", "SELECT * FROM (VALUES ('nn,brt', 'ens_brt-nn'), ('rf,gam,glm,brt', 'ens'), ('gam', 'ens_gam')) t(members, tag)")
def _(s, d):
    return s.createDataFrame([("nn,brt",), ("rf,gam,glm,brt",), ("gam",)], "members string").withColumn("tag", D.member_tag(F.split("members", ",")))


@query("scale_labels", "SELECT * FROM (VALUES (200, 'scale_02'), (1000, 'scale_1'), (50000, 'scale_50'), (2500, 'scale_25')) t(resolution, label)")
def _(s, d):
    return s.createDataFrame([(200,), (1000,), (50000,), (2500,)], "resolution int").withColumn("label", D.scale_label(F.col("resolution")))


@query("stable_seed", "SELECT c_name AS key, CAST((list_sum(list_transform(range(1, length(c_name) + 1), lambda i: unicode(substr(c_name, i, 1)) * (i % 97 + 1))) % 2147483629) + 1 AS BIGINT) AS seed, CAST((list_sum(list_transform(range(1, length(c_name) + 1), lambda i: unicode(substr(c_name, i, 1)) * (i % 97 + 1))) % 2147483629 + 1 + 2 * 1000003) % 2147483629 + 1 AS BIGINT) AS second FROM customer")
def _(s, d):
    seeds = X.table(s, d, "customer").select(F.col("c_name").alias("key"), S.stable_seed(F.col("c_name")).alias("seed"))
    return seeds.withColumn("second", S.attempt_seed(F.col("seed"), F.lit(2)))


BLOCKS = "rws AS (SELECT row_id, occurrence, CAST(floor(x / 100000) AS BIGINT) || '_' || CAST(floor(y / 100000) AS BIGINT) AS block_id FROM training), blocks AS (SELECT block_id, row_number() OVER (ORDER BY block_id) AS ordinal, count(*) OVER () AS n FROM (SELECT DISTINCT block_id FROM rws)), slots AS (SELECT replicate, slot, ((((7919 * replicate * 48271 + slot * 69621) % 2147483647) * 16807 + slot) % 2147483647) % n + 1 AS ordinal FROM (SELECT unnest([1, 2, 3]) AS replicate), (SELECT DISTINCT n, unnest(range(1, n + 1)) AS slot FROM blocks)), times AS (SELECT replicate, block_id, count(*) AS multiplicity FROM slots JOIN blocks USING (ordinal) GROUP BY ALL)"


def _draws(s, d):
    rows = X.training(s, d).select("row_id", "occurrence", G.block_id(F.col("x"), F.col("y"), 100_000).alias("block_id"))
    return S.block_draw(rows, s.createDataFrame([(i, 7919 * i) for i in (1, 2, 3)], "replicate int, seed long"))


@query("block_draw", f"WITH training AS ({X.SQL['training']}), {BLOCKS} SELECT replicate, row_id, multiplicity, occurrence FROM rws JOIN times USING (block_id)")
def _(s, d):
    return _draws(s, d)


@query("class_guard", f"WITH training AS ({X.SQL['training']}), {BLOCKS} SELECT replicate, CAST(sum(multiplicity * occurrence) AS BIGINT) AS presences, CAST(sum(multiplicity * (1 - occurrence)) AS BIGINT) AS absences, sum(multiplicity * occurrence) >= 10 AND sum(multiplicity * (1 - occurrence)) >= 10 AS usable FROM rws JOIN times USING (block_id) GROUP BY replicate")
def _(s, d):
    return S.class_guard(_draws(s, d))


@query("fold_split", X.with_views("SELECT fold_id, (SELECT count(*) FROM training) - count(*) AS train, count(*) AS test FROM training GROUP BY fold_id", "training"))
def _(s, d):
    return S.folds(X.training(s, d))


@query("int16_roundtrip", X.with_views(f"SELECT cell_id, member, v AS packed, {r('CASE WHEN v >= 0 THEN v / 30000.0::DOUBLE END', 'prob')} FROM (SELECT cell_id, member, coalesce(CAST(round_even(prob * 30000, 0) AS INT), -1) AS v FROM members)", "by_cell", "members"))
def _(s, d):
    return X.members(s, d).select("cell_id", "member", D.pack(F.col("prob")).cast("int").alias("packed"), D.unpack(D.pack(F.col("prob"))).alias("prob"))


@query("digest_stamp", X.with_views("SELECT species, year, string_agg(CAST(replicate AS VARCHAR), ',' ORDER BY replicate) AS stamp FROM (SELECT DISTINCT species, year, replicate FROM cube WHERE replicate <> 0) GROUP BY species, year", "cube"))
def _(s, d):
    return D.replicate_stamp(X.cube(s, d))


RIDGE = (-1.0, 2.0, 0.0, 0.5)


@query("ridge_apply", X.with_views(f"SELECT cell_id, year, {r('1 / (1 + exp(-(-1.0 + 2.0 * clim + 0.5 * hab)))', 'prob')}, 1 / (1 + exp(-(-1.0 + 2.0 * clim + 0.5 * hab))) >= 0.5 AS is_present FROM triples", "triples"))
def _(s, d):
    p = L.ridge_probability(RIDGE, ["clim", "land", "hab"])
    return X.triples(s, d).select("cell_id", "year", p.alias("prob"), (p >= 0.5).alias("is_present"))


P4 = ["p1", "p2", "p3", "p4"]


def _by_year(s, d):
    return X.training(s, d).withColumn("species", F.lit("R"))


@query("ridge_fit")
def _(s, d):
    """Ridge weights by year."""
    return J.coefficients(L.fit(_by_year(s, d), ["year"], "ridge", P4), ["year"], P4)


@query("glm_aic")
def _(s, d):
    t = _by_year(s, d)
    return L.predict_with(t, L.fit(t, ["year"], "glm", P4), ["year"], P4).select("row_id", "year", "prob")


@query("gbt_cv")
def _(s, d):
    return M.auc(L.block_cv(_by_year(s, d), ["year"], "brt_search", P4).where("p is not null").select("y", "p"))


for _family in ("rf", "nn", "gam"):
    query(f"{_family}_predict")(lambda s, d, f=_family: L.predict_with(_by_year(s, d).select("row_id", "year", *P4), L.fit(_by_year(s, d), ["year"], f, P4), ["year"], P4).select("row_id", "year", "prob"))


@query("stacked_meta")
def _(s, d):
    cv = L.member_cv(_by_year(s, d), ["year"], ["glm", "gam"], P4).select(F.lit("R").alias("species"), "row_id", F.col("y").alias("occurrence"), "fold_id", "glm", "gam")
    path = D.shared_folder(s, "members")
    cv.write.parquet(path)  # the ridge reads it several times
    both = s.read.parquet(path)
    return J.coefficients(L.fit(both, ["species"], "ridge", ["glm", "gam"]), ["species"], ["glm", "gam"])


@query("importance")
def _(s, d):
    return L.importance(X.training(s, d), P4)


@query("trend_bootstrap")
def _(s, d):
    return L.trend_bootstrap(X.training(s, d), P4, n=200)
