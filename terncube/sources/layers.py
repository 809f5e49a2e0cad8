"""Covariate layers: readers by scale and year, name resolution, complete cells, predictions of a scale, caches.

Layers are one long table (scale, kind, name, year, cell_id, value), year null for static ones: a reader is a filter that
reaches the scan and needs no list of files. All years are read at once; the wide form has the columns asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terncube.operators.temporal import snapshot_of

#: Fixed names of layer kinds: by year, by land-cover snapshot, static; the optional ones may be absent.
YEARLY, SNAPSHOT, STATIC = "landuse", "landcover", ("elevation", "slope")
OPTIONAL_YEARLY, OPTIONAL_SNAPSHOT = ("landscape_heterogeneity", "unmapped_other"), ("dist_to_woodland",)
HEDGES = "hedges"
WINDOW = 6


def hedge_reference(year: Column) -> Column:
    """The year whose hedges stand in for a year that has none at all; null where no rule says."""
    return F.when(year <= 2016, 2017).when(year.isin(2022, 2023), 2021)


def _years(layers: DataFrame, years: DataFrame) -> DataFrame:
    """(year, snapshot) of the years that have land use and whose snapshot has land cover: others are skipped."""
    wanted = years.select(F.col("year").cast("int").alias("year")).distinct().withColumn("snapshot", snapshot_of(F.col("year")))
    have = layers.where(F.col("kind").isin(YEARLY, SNAPSHOT)).select("kind", F.col("year").cast("int").alias("y")).distinct()
    use = have.where(F.col("kind") == YEARLY).select(F.col("y").alias("year"))
    cover = have.where(F.col("kind") == SNAPSHOT).select(F.col("y").alias("snapshot"))
    return wanted.join(use, "year", "left_semi").join(cover, "snapshot", "left_semi").select("year", "snapshot")


def _filled(use: DataFrame) -> DataFrame:
    """Land use with the hedges of years that have none taken from their reference year."""
    hedges = F.col("name") == HEDGES
    empty = use.where(hedges).groupBy("year").agg(F.count("value").alias("n")).where("n = 0").select("year", hedge_reference(F.col("year")).alias("ref"))
    marked = use.join(empty.select("year", F.col("ref").alias("__ref")), "year", "left")
    source = use.where(hedges).select("name", "cell_id", F.col("year").alias("__ref"), F.col("value").alias("__v"))
    return marked.join(source, ["name", "cell_id", "__ref"], "left").select("year", "name", "cell_id", F.coalesce("value", "__v").alias("value"))


def covariates(layers: DataFrame, years: DataFrame, all_static: bool = False) -> DataFrame:
    """(year, name, cell_id, value) of land use, its snapshot of land cover, relief and whatever optional layers there are,
    for every year that has land use and land cover. all_static: a table that lacks a relief layer has no year at all."""
    known = _years(layers, years)
    if all_static:
        relief = layers.where(F.col("kind").isin(*STATIC)).agg(F.count_distinct("kind").alias("n")).where(F.col("n") == len(STATIC))
        known = known.join(relief.select("n"), F.lit(True), "left_semi")
    rows = lambda *kinds: layers.where(F.col("kind").isin(*kinds)).select(F.col("year").cast("int").alias("y"), "name", "cell_id", "value")
    by_year = known.select("year", F.col("year").alias("y"))
    by_snapshot = known.select("year", F.col("snapshot").alias("y"))
    first = rows(YEARLY)
    use = _filled(first.withColumnRenamed("y", "year")).join(known.select("year"), "year", "left_semi")
    more = rows(*OPTIONAL_YEARLY).join(by_year, "y").select("year", "name", "cell_id", "value")
    cover = rows(SNAPSHOT, *OPTIONAL_SNAPSHOT).join(by_snapshot, "y").select("year", "name", "cell_id", "value")
    relief = rows(*STATIC).drop("y").join(known.select("year"), F.lit(True)).select("year", "name", "cell_id", "value")
    return use.unionByName(more).unionByName(cover).unionByName(relief)


def landscape(layers: DataFrame, years: DataFrame) -> DataFrame:
    """Covariates at landscape scale, names of yearly layers and snapshots with their year."""
    got = covariates(layers.where("scale = 'landscape'"), years)
    dated = layers.where("scale = 'landscape' and year is not null").select("name", "kind").distinct()
    stamp = F.when(F.col("kind") == YEARLY, F.col("year")).when(F.col("kind") == SNAPSHOT, snapshot_of(F.col("year")))
    named = got.join(dated, "name", "left").withColumn("name", F.concat_ws("_", "name", stamp.cast("string")))
    return named.select("year", "name", "cell_id", "value")


def habitat(layers: DataFrame, years: DataFrame) -> DataFrame:
    """Covariates at habitat scale under plain names; all of land use, land cover and relief must be there."""
    return covariates(layers.where("scale = 'habitat'"), years, all_static=True).withColumn("name", plain_name(F.col("name")))


def climate(layers: DataFrame, years: DataFrame, window: int = WINDOW) -> DataFrame:
    """The climatology whose window ends in each year, found by its name; years without one are absent."""
    want = years.select(F.col("year").cast("int").alias("year")).distinct()
    kind = F.concat(F.lit("bioclim_"), (F.col("year") - (window - 1)).cast("string"), F.lit("-"), F.col("year").cast("string"))
    rows = layers.where("scale = 'climate'").select("kind", "name", "cell_id", "value")
    return want.withColumn("kind", kind).join(rows, "kind").select("year", "name", "cell_id", "value")


READERS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {"climate": climate, "landscape": landscape, "habitat": habitat}


def covariate_stack(layers: DataFrame, scale: str, years: DataFrame) -> DataFrame:
    """The reader of a scale."""
    return READERS[scale](layers, years)


def plain_name(name: Column) -> Column:
    """A layer's name without its year."""
    return F.regexp_replace(name, r"_\d{4}$", "")


def resolve_names(wanted: Sequence[str], have: Sequence[str]) -> list[str]:
    """For each wanted layer its name in the table: itself, else the first that equals it but for a year. Raises with all
    that are missing."""
    import re

    bare: dict[str, str] = {}
    for h in have:
        bare.setdefault(re.sub(r"_\d{4}$", "", h), h)
    missing = [w for w in wanted if w not in have and w not in bare]
    if missing:
        raise ValueError("layers not found: " + ", ".join(missing))
    return [w if w in have else bare[w] for w in wanted]


def wide(stack: DataFrame, names: Sequence[str]) -> DataFrame:
    """(year, cell_id, one column a name): one shuffle, columns known beforehand."""
    return stack.groupBy("year", "cell_id").pivot("name", list(names)).agg(F.first("value", ignorenulls=True))


def species_layers(cells: DataFrame, layers: Sequence[str] | None, keys: Sequence[str] = ("year", "cell_id")) -> DataFrame:
    """The layers of a species (none named: all), never the coordinates."""
    every = [c for c in cells.columns if c not in keys and c not in ("x", "y")]
    return cells.select(*keys, *(every if layers is None else resolve_names([n for n in layers if n not in ("x", "y")], every)))


def missing_predictors(stack: DataFrame, predictors: Sequence[str], years: DataFrame) -> DataFrame:
    """(year, missing): the predictors that a year lacks, in order; x and y come from the cell and are never missing."""
    need = [p for p in predictors if p not in ("x", "y")]
    have = stack.groupBy("year").agg(F.collect_set(plain_name(F.col("name"))).alias("have"))
    all_of = F.array(*map(F.lit, sorted(need))) if need else F.array().cast("array<string>")
    lacks = years.select(F.col("year").cast("int").alias("year")).distinct().join(have, "year", "left")
    gap = F.array_except(all_of, F.coalesce("have", F.array().cast("array<string>")))
    return lacks.select("year", F.array_join(gap, ",").alias("missing")).where("missing <> ''")


def complete_cells(cells: DataFrame, predictors: Sequence[str], grid, keep: DataFrame | None = None) -> DataFrame:
    """Cells with a value of every predictor, x and y being those of the centre; keep: only these cells."""
    x, y = grid.centre(F.col("cell_id"))
    own = cells.withColumns({"x": x, "y": y}).dropna(subset=list(predictors))
    rows = own if keep is None else own.join(keep.select("cell_id").distinct(), "cell_id", "left_semi")
    return rows.select(*[c for c in ("year",) if c in rows.columns], "cell_id", *predictors)


def valid_layers(cells: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """(keys, least, most, valid): smallest and largest value; a layer without a value above 0 is not valid."""
    got = cells.groupBy(*keys).agg(F.min(value).alias("least"), F.max(value).alias("most"))
    return got.withColumn("valid", F.coalesce(F.col("most") > 0, F.lit(False)))


def suitability(predictions: DataFrame, algo: str, factor: int, ncol: int, nrow: int) -> DataFrame:
    """(year, cell_id, value) on a reference grid of ncol columns and nrow rows, from predictions (algo, year, cell_id, prob)
    on a grid factor times as coarse: bilinear between the centres of the four coarse cells around, null unless all have a
    value. A year that the source lacks is absent."""
    wide_cols = -(-ncol // factor)
    src = predictions.where(F.col("algo") == algo).select("year", F.col("cell_id").alias("__c"), "prob")
    fine = F.sequence(F.lit(-factor), F.lit(2 * factor - 1))
    spread = src.withColumns({"R": F.floor(F.col("__c") / wide_cols), "C": F.pmod("__c", F.lit(wide_cols))})
    spread = spread.withColumn("dr", F.explode(fine)).withColumn("dc", F.explode(fine))
    spread = spread.withColumns({"r": F.col("R") * factor + F.col("dr"), "c": F.col("C") * factor + F.col("dc")})
    weight = lambda d: F.greatest(F.lit(0.0), 1 - F.abs((F.col(d) + 0.5) / factor - 0.5))
    spread = spread.withColumn("w", weight("dr") * weight("dc")).where(f"w > 0 and r between 0 and {nrow - 1} and c between 0 and {ncol - 1}")
    got = spread.groupBy("year", (F.col("r") * ncol + F.col("c")).cast("long").alias("cell_id"))
    got = got.agg(F.sum(F.when(F.col("prob").isNotNull(), F.col("w"))).alias("have"), F.sum(F.col("w") * F.col("prob")).alias("v"))
    return got.select("year", "cell_id", F.when(F.col("have") > 1 - 1e-9, F.col("v")).alias("value"))


def write_cache(stack: DataFrame, path: str, label: str) -> None:
    """Covariates of a resolution label, partitioned by label and year; only the years given are replaced."""
    out = stack.withColumn("label", F.lit(label)).repartition("year", "name")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("label", "year").parquet(path)


def read_cache(spark: SparkSession, path: str, label: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("label") == label).select("year", "name", "cell_id", "value")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of comma-separated values with a header; the schema is given, so the file is read once."""
    return spark.read.csv(path, schema=schema, header=True)


def append_csv(df: DataFrame, path: str) -> None:
    """Rows added to a table of comma-separated values: a file with a header for each part."""
    df.write.mode("append").csv(path, header=True)
