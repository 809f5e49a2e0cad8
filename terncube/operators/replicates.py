"""Replicate summaries, changes, trends, area and regional means, community statistics and indices.

Replicate 0 is the main model and enters no interval. Summaries over replicates are null if any replicate's value is
(strict), sums for means skip nulls.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROBS = (0.05, 0.95)


def strict(agg: Column, x: str) -> Column:
    """An aggregate of x, null unless every row has a value."""
    return F.when(F.count(x) == F.count("*"), agg)


def summary(x: str, probs: Sequence[float] = PROBS, prefix: str = "") -> list[Column]:
    """mean, sd, lwr, upr, width; quantiles interpolate between order statistics."""
    name = (lambda s: prefix + s.capitalize()) if prefix else (lambda s: s)
    lwr, upr = F.percentile(x, F.lit(probs[0])), F.percentile(x, F.lit(probs[1]))
    return [strict(F.avg(x), x).alias(name("mean")), strict(F.stddev_samp(x), x).alias(name("sd")), strict(lwr, x).alias(name("lwr")), strict(upr, x).alias(name("upr")), strict(upr - lwr, x).alias(name("width"))]


def change(x: str, probs: Sequence[float] = PROBS, prefix: str = "delta") -> list[Column]:
    """summary and the shares of negative and positive values; zeros are in neither."""
    share = lambda c: strict(F.avg(c.cast("double")), x)
    return [*summary(x, probs, prefix), share(F.col(x) < 0).alias("shareDecrease"), share(F.col(x) > 0).alias("shareIncrease")]


def boot(cube: DataFrame) -> DataFrame:
    return cube.where("replicate <> 0")


def enough(df: DataFrame, keys: Sequence[str], columns: Sequence[Column]) -> DataFrame:
    """Aggregates by keys over replicates, where there are at least two."""
    return df.groupBy(*keys).agg(*columns, F.count("*").alias("__n")).where("__n >= 2").drop("__n")


def year_map(cube: DataFrame) -> DataFrame:
    return enough(boot(cube), ["species", "year", "cell_id"], summary("prob"))


def change_map(cube: DataFrame, current: int, reference: int, keys: Sequence[str] = ("species", "cell_id"), value: str = "prob") -> DataFrame:
    """current - reference on the cells and replicates that both years have. One pass: no self-join."""
    two = boot(cube).where(F.col("year").isin(current, reference))
    of = lambda y: F.max(F.when(F.col("year") == y, F.struct(F.col(value).alias("v"))))
    pairs = two.groupBy(*keys, "replicate").agg(of(current).alias("c"), of(reference).alias("r")).where("c is not null and r is not null")
    return enough(pairs.withColumn("d", F.col("c.v") - F.col("r.v")), keys, change("d"))


def trend_map(cube: DataFrame, keys: Sequence[str] = ("species", "cell_id"), least_years: int = 5) -> DataFrame:
    """Ordinary least squares slope per decade of each replicate, to 12 decimals so that a flat line has slope 0, summarised; a missing year drops cell and replicate."""
    b = boot(cube)
    years = b.groupBy("species").agg(F.count_distinct("year").alias("years"))
    slopes = b.groupBy(*keys, "replicate").agg(F.round(strict(F.regr_slope("prob", "year"), "prob") * 10, 12).alias("slope"), F.count("*").alias("n"))
    whole = slopes.join(years, "species").where(f"n = years and years >= {least_years}")
    return enough(whole, keys, change("slope", prefix="slope"))


def area_means(cube: DataFrame) -> DataFrame:
    """(species, replicate, year, areaMean, nCells): sums skip nulls; cells are counted in the first replicate."""
    sums = cube.groupBy("species", "year", "replicate").agg(F.sum("prob").alias("s"), F.count("prob").alias("n"))
    first = sums.groupBy("species", "year").agg(F.min_by("n", "replicate").alias("nCells"))
    return sums.join(first, ["species", "year"]).select("species", "replicate", "year", (F.col("s") / F.col("nCells")).alias("areaMean"), "nCells")


def coarse(cell: Column, factor: int, ncol: int = 10) -> tuple[Column, Column]:
    """Row and column of the coarse cell of a cell id on a grid of ncol columns."""
    return F.floor(F.floor(cell / ncol) / factor).cast("int"), F.floor(F.pmod(cell, F.lit(ncol)) / factor).cast("int")


def regional_means(cube: DataFrame, factor: int = 2) -> DataFrame:
    row, col = coarse(F.col("cell_id"), factor)
    sums = cube.groupBy("species", row.alias("row"), col.alias("col"), "year", "replicate").agg(F.sum("prob").alias("S"), F.count("prob").alias("N"))
    return sums.select("species", "row", "col", "year", "replicate", F.when(F.col("N") > 0, F.col("S") / F.col("N")).alias("mean"), "N")


def national_means(regional: DataFrame) -> DataFrame:
    """Sums of the regional sums over all coarse cells."""
    sums = regional.groupBy("species", "year", "replicate").agg(F.sum(F.col("mean") * F.col("N")).alias("S"), F.sum("N").alias("nCells"))
    return sums.where("nCells > 0").select("species", "year", "replicate", (F.col("S") / F.col("nCells")).alias("areaMean"), "nCells")


def shared_replicates(cube: DataFrame) -> DataFrame:
    """Rows of replicates that every species has in the year."""
    n = cube.select("year", "species").distinct().groupBy("year").agg(F.count("*").alias("k"))
    common = cube.select("year", "species", "replicate").distinct().groupBy("year", "replicate").agg(F.count("*").alias("k")).join(n, ["year", "k"]).select("year", "replicate")
    return cube.join(common, ["year", "replicate"], "left_semi")


def richness(cube: DataFrame) -> DataFrame:
    """Expected number of species by cell; a species that lacks a cell adds nothing there."""
    sums = shared_replicates(boot(cube)).groupBy("year", "cell_id", "replicate").agg(F.sum("prob").alias("s"))
    return enough(sums, ["year", "cell_id"], summary("s"))


def paired(cube: DataFrame, current: int, reference: int) -> DataFrame:
    """(species, cell_id, replicate, p1, p0) of cells and replicates that both years have."""
    two = cube.where(F.col("year").isin(current, reference))
    value = lambda y: F.max(F.when(F.col("year") == y, F.col("prob")))
    return two.groupBy("species", "cell_id", "replicate").agg(value(current).alias("p1"), value(reference).alias("p0")).where("p1 is not null and p0 is not null")


def common_replicates(pairs: DataFrame) -> DataFrame:
    """Pairs of replicates that every species has: a sum over species always holds the same community."""
    n = pairs.agg(F.count_distinct("species").alias("k"))
    ids = pairs.select("species", "replicate").distinct().groupBy("replicate").agg(F.count("*").alias("k")).join(n, "k").select("replicate")
    return pairs.join(ids, "replicate", "left_semi")


def mean_delta(cube: DataFrame, current: int, reference: int) -> DataFrame:
    by = common_replicates(paired(boot(cube), current, reference)).groupBy("cell_id", "replicate").agg(F.avg(F.col("p1") - F.col("p0")).alias("d"))
    return enough(by, ["cell_id"], change("d"))


def bray_curtis(p1: str = "p1", p0: str = "p0") -> Column:
    return F.sum(F.abs(F.col(p1) - F.col(p0))) / F.greatest(F.sum(F.col(p0) + F.col(p1)), F.lit(1e-12))


def turnover(cube: DataFrame, current: int, reference: int) -> DataFrame:
    by = common_replicates(paired(boot(cube), current, reference)).groupBy("cell_id", "replicate").agg(bray_curtis().alias("bc"))
    return enough(by, ["cell_id"], summary("bc"))


def community_change(cube: DataFrame, current: int, reference: int, threshold: float = 0.5) -> DataFrame:
    """Main model: (cell_id, meanDeltaP, netGainLoss, gainCount, lossCount, turnoverBC)."""
    p = paired(cube.where("replicate = 0"), current, reference)
    on = lambda c: F.col(c) >= threshold
    gain, loss = F.sum((on("p1") & ~on("p0")).cast("int")), F.sum((on("p0") & ~on("p1")).cast("int"))
    return p.groupBy("cell_id").agg(F.avg(F.col("p1") - F.col("p0")).alias("meanDeltaP"), (gain - loss).alias("netGainLoss"), gain.alias("gainCount"), loss.alias("lossCount"), bray_curtis().alias("turnoverBC"))


def species_index(means: DataFrame, baseline: int) -> DataFrame:
    """(species, replicate, year, index): 100 * mean / the baseline year's mean in the same replicate."""
    base = means.where(F.col("year") == baseline).select("species", "replicate", F.col("areaMean").alias("base"))
    return means.join(base, ["species", "replicate"]).select("species", "replicate", "year", (100 * F.col("areaMean") / F.col("base")).alias("index"))


def index_summary(index: DataFrame, keys: Sequence[str] = ("species", "year")) -> DataFrame:
    rows = boot(index)
    return rows.groupBy(*keys).agg(F.avg("index").alias("mean"), F.percentile("index", F.lit(0.5)).alias("median"), F.percentile("index", F.lit(0.05)).alias("lwr"), F.percentile("index", F.lit(0.95)).alias("upr"))


def combined_index(index: DataFrame) -> DataFrame:
    """Geometric mean of the species' indices inside each replicate."""
    return index.where("index > 0").groupBy("replicate", "year").agg(F.exp(F.avg(F.ln("index"))).alias("index"))


def chain_index(index: DataFrame) -> DataFrame:
    """Chained: each year's mean log ratio to the year before, summed up; 100 in the first year. The window runs over the
    years of one species or replicate only."""
    from pyspark.sql import Window

    steps = Window.partitionBy("species", "replicate").orderBy("year")
    ratio = index.where("index > 0").withColumn("r", F.coalesce(F.ln(F.col("index") / F.lag("index").over(steps)), F.lit(0.0)))
    yearly = ratio.groupBy("replicate", "year").agg(F.avg("r").alias("r"))
    return yearly.select("replicate", "year", (100 * F.exp(F.sum("r").over(Window.partitionBy("replicate").orderBy("year")))).alias("index"))


def msi_index(index: DataFrame) -> DataFrame:
    """Delta method on the log scale: the standard error of the mean log index from the species' spread over replicates."""
    by = boot(index).where("index > 0").groupBy("species", "year").agg(F.avg(F.ln("index")).alias("m"), F.var_samp(F.ln("index")).alias("v"))
    mean = by.groupBy("year").agg(F.avg("m").alias("m"), (F.sqrt(F.sum("v")) / F.count("*")).alias("se"))
    at = lambda k: F.exp(F.col("m") + k * F.col("se"))
    return mean.select("year", at(0).alias("est"), at(-1.6448536269514722).alias("lwr"), at(1.6448536269514722).alias("upr"))


def analytical_index(index: DataFrame) -> DataFrame:
    """Geometric mean of the species' mean indices; its standard error by the delta method from the species' spread over
    replicates."""
    by = boot(index).groupBy("species", "year").agg(F.avg("index").alias("m"), F.stddev_samp("index").alias("sd")).where("m > 0")
    mean = by.groupBy("year").agg(F.exp(F.avg(F.ln("m"))).alias("est"), (F.sqrt(F.sum((F.col("sd") / F.col("m")) ** 2)) / F.count("*")).alias("se"))
    at = lambda k: F.col("est") * F.exp(k * F.col("se"))
    return mean.select("year", at(0.0).alias("est"), at(-1.6448536269514722).alias("lwr"), at(1.6448536269514722).alias("upr"))


def regional_index(regional: DataFrame, baseline: int, least: float = 1e-6) -> DataFrame:
    """Geometric mean over species in each coarse cell; a species is left out where its baseline mean is under least."""
    base = regional.where((F.col("year") == baseline) & (F.col("mean") >= least)).select("species", "row", "col", "replicate", F.col("mean").alias("base"))
    both = regional.join(base, ["species", "row", "col", "replicate"]).where("mean > 0")
    return both.groupBy("row", "col", "year", "replicate").agg((100 * F.exp(F.avg(F.ln(F.col("mean") / F.col("base"))))).alias("index"), F.count("*").alias("n_species"))


def complete_runs(cube: DataFrame, bands: int) -> DataFrame:
    """Rows of runs (species, run) that have all bands: one that lacks a band is skipped whole."""
    whole = cube.groupBy("species", "run").agg(F.count_distinct("band").alias("n")).where(F.col("n") == bands).select("species", "run")
    return cube.join(whole, ["species", "run"], "left_semi")


def area_counts(area: DataFrame, factor: int, ncol: int = 10) -> DataFrame:
    """(row, col, nGerman): cells of the study area in each coarse cell that has any."""
    row, col = coarse(F.col("cell_id"), factor, ncol)
    return area.select("cell_id").distinct().groupBy(row.alias("row"), col.alias("col")).agg(F.count("*").alias("nGerman"))


def regional_final(cube: DataFrame, area: DataFrame, factor: int, bands: int, ncol: int = 10) -> DataFrame:
    """(species, row, col, year, replicate, mean, N, nGerman): means over the study area's cells of complete runs, of coarse
    cells that have any; the mean is null where no cell has a value."""
    inside = complete_runs(cube, bands).join(area.select("cell_id").distinct(), "cell_id", "left_semi")
    row, col = coarse(F.col("cell_id"), factor, ncol)
    sums = inside.groupBy("species", row.alias("row"), col.alias("col"), "year", "replicate").agg(F.sum("prob").alias("S"), F.count("prob").alias("N"))
    got = sums.join(area_counts(area, factor, ncol), ["row", "col"])
    return got.select("species", "row", "col", "year", "replicate", F.when(F.col("N") > 0, F.col("S") / F.col("N")).alias("mean"), "N", "nGerman")


def regional_summary(index: DataFrame) -> DataFrame:
    return enough(boot(index), ["row", "col", "year"], summary("index"))


def regional_change(index: DataFrame, current: int, reference: int) -> DataFrame:
    return change_map(index, current, reference, ["row", "col"], "index")


def regional_trend(index: DataFrame, least_years: int = 5) -> DataFrame:
    """Index points per decade of cells and replicates that have every year."""
    b = boot(index)
    years = b.agg(F.count_distinct("year").alias("years"))
    slopes = b.groupBy("row", "col", "replicate").agg(F.round(strict(F.regr_slope("index", "year"), "index") * 10, 9).alias("slope"), F.count("*").alias("n"))
    return enough(slopes.join(years, (F.col("n") == F.col("years")) & (F.col("years") >= least_years)), ["row", "col"], change("slope", prefix="slope"))


def regional_coverage(area: DataFrame, factor: int, ncol: int = 10) -> DataFrame:
    """Share of each coarse cell's cells that lie in the study area."""
    return area_counts(area, factor, ncol).select("row", "col", (F.col("nGerman") / (factor * factor)).alias("coverage"))


def parity(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str = "prob", tolerance: float = 1e-3, share: float = 1e-3) -> DataFrame:
    """One row that compares two cubes: rows with a value on one side only, the largest difference, OK or MISMATCH."""
    left = a.select(*keys, F.col(value).alias("__a"))
    right = b.select(*keys, F.col(value).alias("__b"))
    both = left.join(right, list(keys), "full_outer")
    one = (F.col("__a").isNull() != F.col("__b").isNull()).cast("int")
    got = both.agg(F.count("*").alias("n"), F.sum(one).alias("nullMismatch"), F.max(F.abs(F.col("__a") - F.col("__b"))).alias("maxDiff"), (F.abs(F.avg("__a") - F.avg("__b")) / F.avg("__a")).alias("relMean"))
    bad = (F.col("nullMismatch") > share * F.col("n")) | (F.col("maxDiff") > tolerance) | (F.col("relMean") > tolerance)
    return got.withColumn("verdict", F.when(bad, "MISMATCH").otherwise("OK"))
