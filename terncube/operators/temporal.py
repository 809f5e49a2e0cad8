"""Years: snapshots, backfill, unions, chunks and rolling windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Years that a land-cover snapshot stands for, and the snapshot of any other year.
SNAPSHOTS = [(2006, 2005, 2011), (2012, 2012, 2017), (2018, 2018, 2025)]
DEFAULT_SNAPSHOT = 2018


def snapshot_of(year: Column, snapshots: Sequence[tuple[int, int, int]] = SNAPSHOTS, default: int = DEFAULT_SNAPSHOT) -> Column:
    out = F.lit(default)
    for snap, lo, hi in snapshots:
        out = F.when(year.between(lo, hi), snap).otherwise(out)
    return out


def backfill(layers: DataFrame, reference_of: Column) -> DataFrame:
    """(cell_id, year, value): a year whose layer has no value at all takes that of its reference year."""
    empty = layers.groupBy("year").agg(F.count("value").alias("n")).where("n = 0").select(F.col("year").alias("y0"), reference_of.alias("ref"))
    plain = layers.join(empty.select(F.col("y0").alias("year"), "ref"), "year", "left")
    source = layers.select(F.col("cell_id"), F.col("year").alias("ref"), F.col("value").alias("filled"))
    return plain.join(source, ["cell_id", "ref"], "left").select("cell_id", "year", F.coalesce("value", "filled").alias("value"))


def years_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("year").unionByName(b.select("year")).distinct().orderBy("year")


def year_chunks(years: DataFrame, n: int) -> DataFrame:
    """(year, chunk): n chunks of ceil(N / n) years; late chunks may be empty. The table has one row a year."""
    order = Window.orderBy("year")
    return years.withColumn("k", F.row_number().over(order)).withColumn("size", F.ceil(F.count("*").over(Window.partitionBy()) / n)).select("year", F.ceil(F.col("k") / F.col("size")).cast("int").alias("chunk"))


def climatology(layers: DataFrame, window: int = 6) -> DataFrame:
    """Mean of each cell over the last window years."""
    span = Window.partitionBy("cell_id").orderBy("year").rangeBetween(-(window - 1), 0)
    return layers.select("cell_id", "year", F.avg("value").over(span).alias("value"))
