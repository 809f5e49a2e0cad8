"""Study areas: outlines as vertex tables, rasterised once to cell sets; masks, buffers, stamps and reports.

An outline is a table (part, ring, seq, x, y): rings of a part in order, the first point not repeated; holes are further
rings, as a point is inside where rings are crossed an odd number of times. All work is on edges and cells: nothing is
collected, and rows follow the cells that an outline touches.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terncube.operators.grid import cell_of, laea

#: The box that an outline in EPSG:3035 must lie in, and the outline used where none is named.
EUROPE = (0.9e6, 7.5e6, 0.9e6, 6.1e6)
DEFAULT_AREA = ("Germany", ("DEU",))


@dataclass(frozen=True)
class Grid:
    """Geometry of a raster: cells are numbered from 0, row by row from the top left."""

    xmin: float
    ymax: float
    res: float
    ncol: int
    nrow: int

    @property
    def extent(self) -> tuple[float, float, float, float]:
        return self.xmin, self.xmin + self.ncol * self.res, self.ymax - self.nrow * self.res, self.ymax

    def coarser(self, cell_size: float) -> Grid:
        """The grid of whole multiples of this one's cells that is nearest to the cell size."""
        k = max(1, round(cell_size / self.res))
        return Grid(self.xmin, self.ymax, self.res * k, -(-self.ncol // k), -(-self.nrow // k))

    def cell(self, x: Column, y: Column) -> Column:
        return cell_of(x, y, self.xmin, self.ymax, self.res, self.ncol, self.nrow)

    def centre(self, cell: Column) -> tuple[Column, Column]:
        """Coordinates of a cell's centre: predictors x and y, which are never layers."""
        return self.xmin + (F.pmod(cell, F.lit(self.ncol)) + 0.5) * self.res, self.ymax - (F.floor(cell / self.ncol) + 0.5) * self.res


def overlap(a: Sequence[float], b: Sequence[float]) -> tuple[float, float, float, float] | None:
    """The common extent (xmin, xmax, ymin, ymax), None where there is none."""
    got = max(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), min(a[3], b[3])
    return got if got[0] < got[1] and got[2] < got[3] else None


def outline(boundaries: DataFrame, countries: Sequence[str] = DEFAULT_AREA[1], regions: Sequence[str] | None = None) -> DataFrame:
    """Outline in EPSG:3035 from boundaries (country, level, name, part, ring, seq, lon, lat): level 0 of the countries, or
    those level-1 regions whose names match in any case. Raises when read if nothing matches or if it leaves Europe's box."""
    rows = boundaries.where(F.col("country").isin(list(countries)) & (F.col("level") == (1 if regions else 0)))
    if regions:
        rows = rows.where(F.lower("name").isin([r.lower() for r in regions]))
    x, y = laea(F.col("lon"), F.col("lat"))
    part = F.concat_ws("/", "country", "name", F.col("part").cast("string"))
    out = rows.select(part.alias("part"), F.col("ring").cast("int").alias("ring"), F.col("seq").cast("long").alias("seq"), x.alias("x"), y.alias("y"))
    lo, hi, south, north = EUROPE
    box = out.agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    bad = (F.col("x0") <= lo) | (F.col("x1") >= hi) | (F.col("y0") <= south) | (F.col("y1") >= north)
    fault = F.when(F.col("n") == 0, F.raise_error(F.lit("no outline of that name"))).when(bad, F.raise_error(F.lit("the outline is outside Europe's box")))
    checked = box.select(fault.cast("string").alias("fault"), F.col("n").alias("__n"))
    return checked.join(out, F.lit(True), "left").where("fault is null").select("part", "ring", "seq", "x", "y")


def edges(vertices: DataFrame) -> DataFrame:
    """(x1, y1, x2, y2): the sides of all rings, the last point joined with the first. One ring must fit a task."""
    ring = Window.partitionBy("part", "ring").orderBy("seq")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(ring), F.first(c).over(whole))
    return vertices.select(F.col("x").alias("x1"), F.col("y").alias("y1"), after("x").alias("x2"), after("y").alias("y2"))


def rasterise(vertices: DataFrame, grid: Grid) -> DataFrame:
    """(cell_id): cells whose centre is inside, and cells that a side touches."""
    e = edges(vertices)
    row_of = lambda y: F.floor((grid.ymax - y) / grid.res)
    col_of = lambda x: F.floor((x - grid.xmin) / grid.res)
    kept = lambda v, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), v)).cast("long")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    first, last = row_of(high), row_of(low)
    e = e.withColumns({"first": first, "last": last}).where(F.col("last") >= 0).where(F.col("first") < grid.nrow)
    rows = e.withColumn("row", F.explode(F.sequence(kept(F.col("first"), grid.nrow), kept(F.col("last"), grid.nrow))))
    top = grid.ymax - F.col("row") * grid.res
    slope = (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    at = lambda y: F.when(F.col("y1") == F.col("y2"), F.lit(None)).otherwise(F.col("x1") + (y - F.col("y1")) * slope)
    upper, lower = F.least(high, top), F.greatest(low, top - grid.res)
    ends = [F.coalesce(at(upper), F.col("x1")), F.coalesce(at(lower), F.col("x2"))]
    spans = rows.withColumns({"c0": col_of(F.least(*ends)), "c1": col_of(F.greatest(*ends))}).where("c1 >= 0").where(F.col("c0") < grid.ncol)
    touched = spans.select("row", F.explode(F.sequence(kept(F.col("c0"), grid.ncol), kept(F.col("c1"), grid.ncol))).alias("col"))
    centre = top - grid.res / 2
    crossed = rows.where((centre >= low) & (centre < high)).select("row", at(centre).alias("x"))
    paired = crossed.withColumn("k", F.row_number().over(Window.partitionBy("row").orderBy("x")))
    runs = paired.groupBy("row", F.floor((F.col("k") + 1) / 2).alias("pair")).agg(F.min("x").alias("a"), F.max("x").alias("b"))
    runs = runs.withColumns({"c0": F.ceil((F.col("a") - grid.xmin) / grid.res - 0.5), "c1": F.ceil((F.col("b") - grid.xmin) / grid.res - 0.5) - 1})
    runs = runs.where("c1 >= c0 and c1 >= 0").where(F.col("c0") < grid.ncol)
    inner = runs.select("row", F.explode(F.sequence(kept(F.col("c0"), grid.ncol), kept(F.col("c1"), grid.ncol))).alias("col"))
    return touched.unionByName(inner).select((F.col("row") * grid.ncol + F.col("col")).alias("cell_id")).distinct()


def dissolve(*areas: DataFrame) -> DataFrame:
    """One cell set of several."""
    out = areas[0].select("cell_id")
    for a in areas[1:]:
        out = out.unionByName(a.select("cell_id"))
    return out.distinct()


def widen(area: DataFrame, grid: Grid, metres: float) -> DataFrame:
    """The area and all cells whose centre lies within metres of the centre of one of its cells; itself where metres is not
    positive. Only cells at the area's border are expanded."""
    if not metres > 0:
        return area.select("cell_id").distinct()
    reach = int(metres / grid.res)
    own = area.select("cell_id").distinct()
    here = own.select(F.floor(F.col("cell_id") / grid.ncol).alias("r"), F.pmod("cell_id", F.lit(grid.ncol)).alias("c"))
    side = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))]))
    near = here.withColumn("k", side).groupBy((F.col("r") + F.col("k.a")).alias("r"), (F.col("c") + F.col("k.b")).alias("c")).agg(F.count("*").alias("n"))
    border = here.join(near.where("n = 4").select("r", "c"), ["r", "c"], "left_anti")
    step = F.sequence(F.lit(-reach), F.lit(reach))
    wide = border.withColumn("dr", F.explode(step)).withColumn("dc", F.explode(step)).where(F.sqrt(F.col("dr") ** 2 + F.col("dc") ** 2) * grid.res <= metres)
    at = wide.select((F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c")).where(f"r between 0 and {grid.nrow - 1} and c between 0 and {grid.ncol - 1}")
    return own.unionByName(at.select((F.col("r") * grid.ncol + F.col("c")).alias("cell_id"))).distinct()


def points_inside(points: DataFrame, area: DataFrame, grid: Grid) -> DataFrame:
    """Points (x, y and more) in cells of the area; those off the grid or without a coordinate are not."""
    at = points.withColumn("__cell", grid.cell(F.col("x"), F.col("y")))
    return at.join(area.select(F.col("cell_id").alias("__cell")).distinct(), "__cell", "left_semi").drop("__cell")


def crop_and_mask(cells: DataFrame, area: DataFrame) -> DataFrame:
    """A layer's cells inside the area; other columns are passed along."""
    return cells.join(area.select("cell_id").distinct(), "cell_id", "left_semi")


def fingerprint(vertices: DataFrame, label: str, metres: float = 0) -> DataFrame:
    """(stamp): label, rounded extent, vertices, their coordinate sum and the buffer, which change with the area."""
    whole = lambda c: F.rint(c).cast("long").cast("string")
    box = F.concat_ws(",", whole(F.min("x")), whole(F.max("x")), whole(F.min("y")), whole(F.max("y")))
    text = F.concat_ws("|", F.lit(label), box, F.count("*").cast("string"), whole(F.sum(F.col("x") + F.col("y"))), F.lit(f"buffer{metres:g}"))
    return vertices.agg(text.alias("stamp"))


def stamp_covers(stamp: Column, extent: Sequence[float], tolerance: float = 1) -> Column:
    """Whether what was cropped under a stamp holds the whole extent (xmin, xmax, ymin, ymax); a broken stamp does not."""
    parts = F.split(stamp, r"\|")
    at = lambda i: F.expr(f"try_cast(get(split(get(__p, 1), ','), {i}) as double)")
    buffer = F.expr("try_cast(regexp_replace(get(__p, 4), '^buffer', '') as double)")
    del parts
    signs = (-1, 1, -1, 1)
    old = [at(i) + s * buffer for i, s in enumerate(signs)]
    fine = [(F.lit(float(extent[i])) - old[i]) * s <= tolerance for i, s in enumerate(signs)]
    return F.coalesce(fine[0] & fine[1] & fine[2] & fine[3], F.lit(False))


def with_cover(stamps: DataFrame, extent: Sequence[float], tolerance: float = 1, stamp: str = "stamp", out: str = "covers") -> DataFrame:
    """stamps with a column that says whether each covers the extent."""
    split = stamps.withColumn("__p", F.split(F.col(stamp), r"\|"))
    return split.withColumn(out, stamp_covers(F.col(stamp), extent, tolerance)).drop("__p")


def crop_report(files: DataFrame, stamp: str, extent: Sequence[float], climate_scale: str = "scale_50", training_year: int = 2017, dry: bool = False) -> DataFrame:
    """(scale, name, action) for layer files (scale, name, version, stamp, stamp_version), stamp null where none was written:
    the climate training window is left, layers stamped alike since they were written are current, those stamped for an
    area that does not cover the extent raise, all others are cropped and masked (or would be)."""
    left = (F.col("scale") == climate_scale) & F.col("name").rlike(rf"bioclim_[0-9]{{4}}-{training_year}_")
    current = (F.col("stamp") == stamp) & (F.col("stamp_version") >= F.col("version"))
    rows = with_cover(files, extent)
    smaller = F.col("stamp").isNotNull() & ~F.col("covers")
    action = F.when(left, "training window, left as it is").when(F.coalesce(current, F.lit(False)), "current")
    action = action.when(smaller, F.raise_error(F.concat(F.col("name"), F.lit(" was cropped for a smaller area"))).cast("string"))
    return rows.select("scale", "name", action.otherwise("would crop and mask" if dry else "cropped and masked").alias("action"))
