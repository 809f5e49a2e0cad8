"""Cells, neighbourhoods, resampling, masks, coordinates and nearest records, as expressions and equi-joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the projection EPSG:3035 on the GRS80 ellipsoid.
SEMI_MAJOR, FLATTENING, LAT0, LON0, FALSE_EAST, FALSE_NORTH = 6378137.0, 1 / 298.257222101, 52.0, 10.0, 4321000.0, 3210000.0


def cell_of(x: Column, y: Column, xmin: float, ymax: float, res: float, ncol: int, nrow: int) -> Column:
    """0-based row-major cell id, from the top left; null outside."""
    row, col = F.floor((F.lit(ymax) - y) / res), F.floor((x - xmin) / res)
    return F.when((row >= 0) & (row < nrow) & (col >= 0) & (col < ncol), row * ncol + col).cast("long")


def neighbours(cells: DataFrame, ncol: int, nrow: int, reach: int = 2) -> DataFrame:
    """Distinct cells within reach rows and columns of the given ones, clipped at the edges."""
    step = F.sequence(F.lit(-reach), F.lit(reach))
    wide = cells.select(F.floor(F.col("cell_id") / ncol).alias("r"), F.pmod("cell_id", F.lit(ncol)).alias("c")).withColumn("dr", F.explode(step)).withColumn("dc", F.explode(step))
    at = wide.select((F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c")).where(f"r between 0 and {nrow - 1} and c between 0 and {ncol - 1}")
    return at.select((F.col("r") * ncol + F.col("c")).cast("long").alias("cell_id")).distinct()


def bilinear(values: DataFrame, targets: DataFrame, ncol: int) -> DataFrame:
    """(id, value): targets (id, row, col as doubles, in cell units) from the four cells around each; null unless all four
    have a value."""
    four = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    t = targets.select("id", "row", "col", F.explode(four).alias("k")).select("id", (F.floor("row") + F.col("k.a")).alias("r"), (F.floor("col") + F.col("k.b")).alias("c"), "row", "col")
    w = (1 - F.abs(F.col("row") - F.col("r"))) * (1 - F.abs(F.col("col") - F.col("c")))
    at = t.select("id", w.alias("w"), F.when(F.col("c") < ncol, F.col("r") * ncol + F.col("c")).cast("long").alias("cell_id"))
    got = at.join(values.select("cell_id", "value"), "cell_id", "left").groupBy("id").agg(F.count("value").alias("n"), F.sum(F.col("w") * F.col("value")).alias("v"))
    return got.select("id", F.when(F.col("n") == 4, F.col("v")).alias("value"))


def laea(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Lambert azimuthal equal-area coordinates of longitudes and latitudes in degrees."""
    e2 = FLATTENING * (2 - FLATTENING)
    e = math.sqrt(e2)

    def q_of(s: float) -> float:
        return (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    s0, qp = math.sin(math.radians(LAT0)), q_of(1.0)
    rq, b0 = SEMI_MAJOR * math.sqrt(qp / 2), math.asin(q_of(s0) / qp)
    d = SEMI_MAJOR * math.cos(math.radians(LAT0)) / (math.sqrt(1 - e2 * s0 * s0) * rq * math.cos(b0))
    s, turn = F.sin(F.radians(lat)), F.radians(lon - LON0)
    beta = F.asin((1 - e2) * (s / (1 - e2 * s * s) - F.ln((1 - e * s) / (1 + e * s)) / (2 * e)) / qp)
    b = rq * F.sqrt(2 / (1 + math.sin(b0) * F.sin(beta) + math.cos(b0) * F.cos(beta) * F.cos(turn)))
    x = FALSE_EAST + b * d * F.cos(beta) * F.sin(turn)
    y = FALSE_NORTH + b / d * (math.cos(b0) * F.sin(beta) - math.sin(b0) * F.cos(beta) * F.cos(turn))
    return x, y


def laea_sql(lon: str, lat: str) -> tuple[str, str]:
    """The same as SQL text."""
    e2 = FLATTENING * (2 - FLATTENING)
    e = math.sqrt(e2)
    q = lambda s: (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))
    s0, qp = math.sin(math.radians(LAT0)), q(1.0)
    rq, b0 = SEMI_MAJOR * math.sqrt(qp / 2), math.asin(q(s0) / qp)
    d = SEMI_MAJOR * math.cos(math.radians(LAT0)) / (math.sqrt(1 - e2 * s0 * s0) * rq * math.cos(b0))
    s, t = f"sin(radians({lat}))", f"radians({lon} - {LON0})"
    beta = f"asin({1 - e2!r}::DOUBLE * ({s} / (1 - {e2!r}::DOUBLE * {s} * {s}) - ln((1 - {e!r}::DOUBLE * {s}) / (1 + {e!r}::DOUBLE * {s})) / {2 * e!r}::DOUBLE) / {qp!r}::DOUBLE)"
    b = f"({rq!r}::DOUBLE * sqrt(2 / (1 + {math.sin(b0)!r}::DOUBLE * sin({beta}) + {math.cos(b0)!r}::DOUBLE * cos({beta}) * cos({t}))))"
    return f"{FALSE_EAST} + {b} * {d!r}::DOUBLE * cos({beta}) * sin({t})", f"{FALSE_NORTH} + {b} / {d!r}::DOUBLE * ({math.cos(b0)!r}::DOUBLE * sin({beta}) - {math.sin(b0)!r}::DOUBLE * cos({beta}) * cos({t}))"


def block_id(x: Column, y: Column, size: float) -> Column:
    return F.concat_ws("_", F.floor(x / size), F.floor(y / size))


def band_edges(nrow: int, n: int) -> list[int]:
    """Distinct half-even rounded edges of n bands of rows."""
    return sorted({round(i * nrow / n) for i in range(n + 1)})


def band_of(row: Column, edges: list[int]) -> Column:
    """1-based band of a 0-based row: every row is in exactly one."""
    return F.aggregate(F.array(*map(F.lit, edges[:-1])), F.lit(0), lambda a, e: a + (row >= e).cast("int"))


def inside(cells: DataFrame, area: DataFrame) -> DataFrame:
    """Cells of a rasterised study area."""
    return cells.join(area.select("cell_id"), "cell_id", "left_semi")


def nearest_record(queries: DataFrame, records: DataFrame, size: float, rings: int = 12) -> DataFrame:
    """(id, ref_id, d2): each query's nearest record by squared planar distance, ties to the smaller id, exactly. Records
    without a coordinate are none; a query without one has a null record, as has every query where there are no records.

    Records are bucketed in squares of the given size, and of twice, four times, ... that size: at each step the squares
    around a query's own are searched, and what is found no farther than a square's side is nearest. Work follows the
    records near a query; each step takes what the one before left open. Past the last the squares hold everything."""
    whole = lambda df: df.where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    refs = whole(records).select(F.col("id").alias("ref_id"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    every = queries.select("id", "x", "y")
    left, done = whole(every), None
    d2 = (F.col("x") - F.col("rx")) * (F.col("x") - F.col("rx")) + (F.col("y") - F.col("ry")) * (F.col("y") - F.col("ry"))
    step = F.sequence(F.lit(-1), F.lit(1))
    for k in range(rings):
        side = size * 4**k
        square = lambda a, b, side=side: (F.floor(F.col(a) / side).cast("long"), F.floor(F.col(b) / side).cast("long"))
        bx, by = square("x", "y")
        ring = left.withColumn("dx", F.explode(step)).withColumn("dy", F.explode(step)).withColumns({"bx": bx + F.col("dx"), "by": by + F.col("dy")})
        rx, ry = square("rx", "ry")
        best = ring.join(refs.withColumns({"bx": rx, "by": ry}), ["bx", "by"]).groupBy("id").agg(F.min(F.struct(d2.alias("d2"), "ref_id")).alias("b"))
        known = best.where(F.col("b.d2") <= side**2).select("id", "b.ref_id", "b.d2")
        done = known if done is None else done.unionByName(known)
        left = left.join(known.select("id"), "id", "left_anti")
        if left.isEmpty():
            break
    else:
        far = left.join(refs, F.lit(True)).groupBy("id").agg(F.min(F.struct(d2.alias("d2"), "ref_id")).alias("b"))
        done = done.unionByName(far.select("id", "b.ref_id", "b.d2"))
    return every.select("id").join(done, "id", "left")
