"""Cube, grid and training views over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cube(spark: SparkSession, sf_dir: str, species: bool = True) -> DataFrame:
    """(species, year, replicate, cell_id, prob), one probability a row; replicate 0 is the main model."""
    keys = [F.year("l_shipdate").alias("year"), (F.col("l_linenumber") - 1).cast("int").alias("replicate"), F.col("l_suppkey").cast("long").alias("cell_id")]
    keys = ([F.col("l_returnflag").alias("species")] if species else []) + keys
    return table(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.round(F.avg(F.col("l_discount") * 10), 9).alias("prob"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, member, prob): three models' probabilities; glm has none on every seventh cell."""
    by_cell = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("long").alias("cell_id")).agg(F.avg(F.col("l_discount") * 10).alias("brt"), F.avg(F.col("l_tax") * 12.5).alias("glm"), F.avg(F.col("l_quantity") / 50).alias("gam"))
    by_cell = by_cell.withColumn("glm", F.when(F.col("cell_id") % 7 != 0, F.col("glm")))
    return by_cell.unpivot(["cell_id"], ["brt", "glm", "gam"], "member", "prob")


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, year, clim, land, hab)."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("long").alias("cell_id"), F.year("l_shipdate").alias("year")).agg(F.avg(F.col("l_discount") * 10).alias("clim"), F.avg(F.col("l_tax") * 12.5).alias("land"), F.avg(F.col("l_quantity") / 50).alias("hab"))


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, x, y, year, occurrence, fold_id, p1..p4)."""
    row = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        row.cast("long").alias("row_id"),
        (F.lit(4_000_000.0) + F.col("l_orderkey") * 7919 % 600_000).alias("x"),
        (F.lit(3_000_000.0) + F.col("l_orderkey") * 104_729 % 600_000).alias("y"),
        F.year("l_shipdate").alias("year"),
        (F.col("l_returnflag") == "R").cast("int").alias("occurrence"),
        (F.col("l_suppkey") % 5).cast("int").alias("fold_id"),
        *[F.col(c).cast("double").alias(f"p{i}") for i, c in enumerate(("l_quantity", "l_extendedprice", "l_discount", "l_tax"), 1)],
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(y, p): observed class and a score with many ties."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_discount") * 10).cast("double").alias("p"))


def points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Query and reference points (id, x, y)."""
    all_points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return all_points.where("id % 5 = 0"), all_points.where("id % 5 <> 0")


#: Outlines in degrees (country, level, name, part, ring, points): a country with a hole and an island, and two regions.
OUTLINES = [
    ("DEU", 0, "Germany", 1, 1, [(6.1, 50.3), (7.2, 53.4), (9.9, 54.7), (13.9, 53.9), (14.9, 51.0), (12.3, 50.2), (13.4, 48.4), (10.2, 47.5), (7.7, 47.9)]),
    ("DEU", 0, "Germany", 1, 2, [(10.0, 50.6), (10.4, 51.7), (11.6, 51.2)]),
    ("DEU", 0, "Germany", 2, 1, [(13.2, 54.3), (13.5, 54.6), (13.7, 54.35)]),
    ("DEU", 1, "Sachsen", 1, 1, [(11.9, 50.4), (12.6, 51.6), (14.9, 51.4), (14.3, 50.9)]),
    ("DEU", 1, "Bayern", 1, 1, [(9.1, 50.1), (12.2, 50.3), (13.8, 48.6), (10.2, 47.4)]),
    ("CZE", 0, "Czechia", 1, 1, [(12.2, 50.2), (15.0, 51.0), (18.8, 49.5), (14.0, 48.6)]),
]


def boundaries(spark: SparkSession) -> DataFrame:
    """(country, level, name, part, ring, seq, lon, lat)."""
    rows = [(c, level, name, part, ring, i, *point) for c, level, name, part, ring, points in OUTLINES for i, point in enumerate(points)]
    return spark.createDataFrame(rows, "country string, level int, name string, part int, ring int, seq int, lon double, lat double")


def boundaries_sql() -> str:
    rows = [(c, level, name, part, ring, i, *point) for c, level, name, part, ring, points in OUTLINES for i, point in enumerate(points)]
    return f"SELECT * FROM (VALUES {', '.join(map(str, rows))}) t(country, level, name, part, ring, seq, lon, lat)"


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scale, kind, name, year, cell_id, value): land use of 2015 to 2021 without hedges before 2017, two snapshots of land
    cover, relief, heterogeneity in even years, and climatologies by their window."""
    item, cell = table(spark, sf_dir, "lineitem"), F.col("l_suppkey").cast("long").alias("cell_id")
    means = [F.avg(F.col("l_quantity") / 50).alias("q"), F.avg(F.col("l_discount") * 10).alias("d"), F.avg(F.col("l_tax") * 12.5).alias("t")]
    base = item.groupBy(cell, (F.year("l_shipdate") + 20).alias("y")).agg(*means)
    row = lambda kind, name, year, value: F.struct(F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), F.lit(name).alias("name"), year.cast("int").alias("year"), value.alias("value"))
    y, none = F.col("y"), F.lit(None)
    hetero = "landscape_heterogeneity"
    yearly = [row("landuse", "arable", y, F.col("q")), row("landuse", "hedges", y, F.when(y > 2016, F.col("d"))), F.when(y % 2 == 0, row(hetero, hetero, y, F.col("q") * F.col("d")))]
    out = lambda df, rows, scales: df.select("cell_id", F.explode(F.array(*rows)).alias("r")).where("r is not null").withColumn("scale", F.explode(F.array(*map(F.lit, scales)))).select("scale", "r.kind", "r.name", "r.year", "cell_id", "r.value")
    by_cell = base.groupBy("cell_id").agg(F.avg(F.when(y < 2018, F.col("t"))).alias("f12"), F.avg(F.when(y >= 2018, F.col("t"))).alias("f18"), F.max("q").alias("high"), F.min("q").alias("low"))
    fixed = [row("landcover", "forest", F.lit(2012), F.col("f12")), row("landcover", "forest", F.lit(2018), F.col("f18")), row("elevation", "elevation", none, F.col("high")), row("slope", "slope", none, F.col("low"))]
    window = F.concat(F.lit("bioclim_"), (y - 5).cast("string"), F.lit("-"), y.cast("string"))
    climate = [row(window, "bio1", none, F.col("t")), row(window, "bio2", none, F.col("d"))]
    both = ["landscape", "habitat"]
    return out(base, yearly, both).unionByName(out(by_cell, fixed, both)).unionByName(out(base, climate, ["climate"]))


#: The same views for DuckDB.
SQL = {
    "cube": "SELECT l_returnflag AS species, year(l_shipdate) AS year, CAST(l_linenumber - 1 AS INT) AS replicate, CAST(l_suppkey AS BIGINT) AS cell_id, round(avg(l_discount * 10), 9) AS prob FROM lineitem GROUP BY 1, 2, 3, 4",
    "cube1": "SELECT year(l_shipdate) AS year, CAST(l_linenumber - 1 AS INT) AS replicate, CAST(l_suppkey AS BIGINT) AS cell_id, round(avg(l_discount * 10), 9) AS prob FROM lineitem GROUP BY 1, 2, 3",
    "by_cell": "SELECT CAST(l_suppkey AS BIGINT) AS cell_id, avg(l_discount * 10) AS brt, CASE WHEN l_suppkey % 7 <> 0 THEN avg(l_tax * 12.5) END AS glm, avg(l_quantity / 50) AS gam FROM lineitem GROUP BY l_suppkey",
    "members": "SELECT cell_id, 'brt' AS member, brt AS prob FROM by_cell UNION ALL SELECT cell_id, 'glm', glm FROM by_cell UNION ALL SELECT cell_id, 'gam', gam FROM by_cell",
    "triples": "SELECT CAST(l_suppkey AS BIGINT) AS cell_id, year(l_shipdate) AS year, avg(l_discount * 10) AS clim, avg(l_tax * 12.5) AS land, avg(l_quantity / 50) AS hab FROM lineitem GROUP BY 1, 2",
    "training": "SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS row_id, 4000000.0::DOUBLE + l_orderkey * 7919 % 600000 AS x, 3000000.0::DOUBLE + l_orderkey * 104729 % 600000 AS y, year(l_shipdate) AS year, CAST(l_returnflag = 'R' AS INT) AS occurrence, CAST(l_suppkey % 5 AS INT) AS fold_id, CAST(l_quantity AS DOUBLE) AS p1, CAST(l_extendedprice AS DOUBLE) AS p2, CAST(l_discount AS DOUBLE) AS p3, CAST(l_tax AS DOUBLE) AS p4 FROM lineitem",
    "scores": "SELECT CAST(l_returnflag = 'R' AS INT) AS y, CAST(l_discount * 10 AS DOUBLE) AS p FROM lineitem",
    "lbase": "SELECT CAST(l_suppkey AS BIGINT) AS cell_id, CAST(year(l_shipdate) + 20 AS INT) AS y, avg(l_quantity / 50) AS q, avg(l_discount * 10) AS d, avg(l_tax * 12.5) AS t FROM lineitem GROUP BY 1, 2",
    "lcell": "SELECT cell_id, avg(t) FILTER (y < 2018) AS f12, avg(t) FILTER (y >= 2018) AS f18, max(q) AS high, min(q) AS low FROM lbase GROUP BY 1",
    "pts": "SELECT CAST(vec_id AS BIGINT) AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings",
}


def with_views(body: str, *views: str) -> str:
    """A query with the views that it names in front."""
    return "WITH " + ", ".join(f"{v} AS ({SQL[v]})" for v in views) + " " + body
