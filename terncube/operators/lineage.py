"""Lineage: content keys, freshness, penalties' ids, state that the next run starts from, and what may start next.

All of it is tables of (artefact, ...) rows, so that a thousand artefacts are judged by one join and not by one look each.
"""

from __future__ import annotations

import hashlib
import json
import os
import platform
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the learning-rate state: the rate without one, and of the labels of folds.
DEFAULT_RATE = 0.08


def content_key(name: str, settings: dict, digests: Sequence[str], ignore: Sequence[str] = ()) -> str:
    """A key that changes with a function's name, its settings (but those ignored) and the digests of what it reads."""
    kept = {k: v for k, v in sorted(settings.items()) if k not in ignore}
    return hashlib.md5(json.dumps([name, kept, sorted(digests)], default=str).encode()).hexdigest()


def memo(spark: SparkSession, root: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table kept under a key below a shared folder, made and written only where it is not there yet. A table counts as
    there once Spark has marked it as committed, so that a run cut short leaves nothing that looks whole."""
    path = f"{root.rstrip('/')}/{key}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def newest(versions: DataFrame, keys: Sequence[str] = ("artefact",)) -> DataFrame:
    """(keys, version): the latest version of each artefact."""
    return versions.groupBy(*keys).agg(F.max("version").alias("version"))


def freshness(outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    """(artefact, fresh) for outputs (artefact, version) made from inputs (artefact, source, version): fresh if the output
    exists and no input is newer; one without inputs only has to exist."""
    latest = inputs.groupBy("artefact").agg(F.max("version").alias("__in"))
    both = newest(outputs).withColumnRenamed("version", "__out").join(latest, "artefact", "full_outer")
    return both.select("artefact", F.coalesce(F.col("__out") >= F.coalesce("__in", "__out"), F.lit(False)).alias("fresh"))


def ridge_id(source: Column, basis: Column, coefficients: Sequence[Column], digits: int = 8) -> Column:
    """A text that changes with the source, the basis and the coefficients to so many significant digits."""
    size = lambda c: F.when(c == 0, F.lit(0)).otherwise(F.floor(F.log10(F.abs(c)))).cast("int")
    short = lambda c: F.format_string(f"%.{digits - 1}e", F.when(size(c).isNotNull(), c.cast("double")))
    return F.concat_ws("|", source, basis, *[short(c) for c in coefficients])


def stale_years(maps: DataFrame, current: DataFrame) -> DataFrame:
    """Maps (species, year, ridge) made under another ridge than the current one (species, ridge): all to be made again."""
    now = current.select("species", F.col("ridge").alias("__now"))
    return maps.join(now, "species").where(~F.col("ridge").eqNullSafe(F.col("__now"))).select("species", "year")


def file_stamp(files: DataFrame, keys: Sequence[str] = ("species",)) -> DataFrame:
    """(keys, stamp): the MD5 of the files' names and digests, which come as (name, md5), in order of name."""
    parts = F.array_sort(F.collect_set(F.concat_ws("=", "name", "md5")))
    return files.groupBy(*keys).agg(F.md5(F.array_join(parts, ";")).alias("stamp"))


def starting_rate(wanted: DataFrame, overrides: DataFrame, state: DataFrame, keys: Sequence[str] = ("species", "scale")) -> DataFrame:
    """(keys, rate): the override, else the rate that the last run settled on, else DEFAULT_RATE."""
    named = lambda df, c: df.select(*keys, F.col("rate").alias(c))
    both = wanted.select(*keys).join(named(overrides, "__o"), list(keys), "left").join(named(state, "__s"), list(keys), "left")
    return both.select(*keys, F.coalesce("__o", "__s", F.lit(DEFAULT_RATE)).alias("rate"))


def settled(state: DataFrame, fits: DataFrame, last_chunk: int, keys: Sequence[str] = ("species", "scale")) -> DataFrame:
    """The state for the next run: rates of this run's fits (keys, chunk, rate) where the last chunk made them, else those
    known. A fit that gave up (no rate) changes nothing."""
    new = fits.where((F.col("chunk") == last_chunk) & F.col("rate").isNotNull()).select(*keys, F.col("rate").alias("__n")).dropDuplicates(list(keys))
    both = state.select(*keys, "rate").join(new, list(keys), "full_outer")
    return both.select(*keys, F.coalesce("__n", "rate").alias("rate"))


def to_start(scales: DataFrame, needed: Sequence[str]) -> DataFrame:
    """(species, start) from finished scales (species, scale, chunk, chunks): the combining model starts once the last chunk
    of every needed scale is there."""
    done = scales.where(F.col("chunk") == F.col("chunks")).groupBy("species").agg(F.collect_set("scale").alias("have"))
    every = scales.select("species").distinct().join(done, "species", "left")
    need = F.array(*map(F.lit, needed))
    return every.select("species", F.coalesce(F.size(F.array_except(need, "have")) == 0, F.lit(False)).alias("start"))


def resume(parts: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pieces of work that no checkpoint has: wanted without parts."""
    return wanted.join(parts.select(*keys).distinct(), list(keys), "left_anti")


def run_info(spark: SparkSession, label: str, revision: str = "") -> DataFrame:
    """One row that says what a run was made with."""
    row = (label, revision or os.environ.get("GIT_REVISION", ""), spark.version, platform.python_version())
    return spark.createDataFrame([row], "run string, revision string, spark string, python string")


def run_label(lowest: Column, highest: Column) -> Column:
    """reps_<first>-<last>, each of three digits at least."""
    return F.format_string("reps_%03d-%03d", lowest.cast("int"), highest.cast("int"))


def model_label(resolutions: DataFrame, keys: Sequence[str] = ("species",)) -> DataFrame:
    """(keys, label): the labels of (keys, resolution, label), finest first, joined."""
    pairs = F.array_sort(F.collect_set(F.struct("resolution", "label")))
    return resolutions.groupBy(*keys).agg(F.array_join(F.transform(pairs, lambda p: p["label"]), "_").alias("label"))
