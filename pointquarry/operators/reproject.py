"""Reprojection by a control grid, its error, and metric spans of a cloud."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointquarry.functions.geodesy import chord, geocentric

GRIDS = (8, 16, 32, 64)
#: Degrees by which a grid may be off: a millimetre on the ground.
TOLERANCE = 9e-9
SEGMENTS = 8


def control_grid(spark: SparkSession, projection, low: tuple[float, float], high: tuple[float, float], cells: int) -> DataFrame:
    """(gx, gy, lon, lat) at the corners of a grid over a rectangle of source coordinates."""
    n = cells + 1
    at = spark.range(n * n).select((F.col("id") % n).cast("int").alias("gx"), F.floor(F.col("id") / n).cast("int").alias("gy"))
    x = F.lit(low[0]) + F.col("gx") * ((high[0] - low[0]) / cells)
    y = F.lit(low[1]) + F.col("gy") * ((high[1] - low[1]) / cells)
    lon, lat = projection.inverse(x, y)
    return at.select("gx", "gy", lon.alias("lon"), lat.alias("lat"))


def packed(grid: DataFrame) -> DataFrame:
    """The grid as one row of two arrays, by gy and then gx: at most 65 * 65 corners."""
    return grid.agg(F.array_sort(F.collect_list(F.struct("gy", "gx", "lon", "lat"))).alias("g")).select(F.col("g.lon").alias("lons"), F.col("g.lat").alias("lats"))


def by_grid(points: DataFrame, grid: DataFrame, low: tuple[float, float], high: tuple[float, float], cells: int, x: str = "x", y: str = "y") -> DataFrame:
    """Adds ``lon`` and ``lat`` between the four corners of each point's cell (beyond the grid: of the nearest cell)."""

    def cell(c: str, i: int) -> tuple[Column, Column]:
        u = (F.col(c) - low[i]) / ((high[i] - low[i]) / cells)
        k = F.least(F.lit(cells - 1), F.greatest(F.lit(0), u.cast("int")))
        return k, u - k

    (i, fx), (j, fy) = cell(x, 0), cell(y, 1)
    p = points.crossJoin(F.broadcast(packed(grid))).withColumns({"__i": j * (cells + 1) + i, "__fx": fx, "__fy": fy})

    def between(values: str) -> Column:
        a, b, c, d = (F.get(values, F.col("__i") + o) for o in (0, 1, cells + 1, cells + 2))
        return (a * (1 - F.col("__fx")) + b * F.col("__fx")) * (1 - F.col("__fy")) + (c * (1 - F.col("__fx")) + d * F.col("__fx")) * F.col("__fy")

    return p.withColumns({"lon": between("lons"), "lat": between("lats")}).drop("__i", "__fx", "__fy", "lons", "lats")


def grid_error(samples: DataFrame, projection, x: str = "x", y: str = "y") -> DataFrame:
    """Largest and mean error in degrees of ``lon`` and ``lat`` against the exact projection."""
    lon, lat = projection.inverse(F.col(x), F.col(y))
    e = F.greatest(F.abs(F.col("lon") - lon), F.abs(F.col("lat") - lat))
    return samples.agg(F.max(e).alias("max_error"), F.avg(e).alias("mean_error"))


def cell_samples(spark: SparkSession, low: tuple[float, float], high: tuple[float, float], cells: int) -> DataFrame:
    """Five places in each cell: its middle and the middles between that and the corners."""
    at = spark.range(cells * cells).select((F.col("id") % cells).alias("i"), F.floor(F.col("id") / cells).alias("j"), F.explode(F.array(*[F.struct(F.lit(a).alias("u"), F.lit(b).alias("v")) for a, b in ((0.5, 0.5), (0.25, 0.25), (0.75, 0.25), (0.25, 0.75), (0.75, 0.75))])).alias("o"))
    return at.select((F.lit(low[0]) + (F.col("i") + F.col("o.u")) * ((high[0] - low[0]) / cells)).alias("x"), (F.lit(low[1]) + (F.col("j") + F.col("o.v")) * ((high[1] - low[1]) / cells)).alias("y"))


def chosen_grid(spark: SparkSession, projection, low: tuple[float, float], high: tuple[float, float], tolerance: float = TOLERANCE) -> tuple[int, DataFrame] | None:
    """The coarsest grid that is exact enough everywhere it was tried; none if none is, or without extent."""
    if high[0] <= low[0] or high[1] <= low[1]:
        return None
    for cells in GRIDS:
        grid = control_grid(spark, projection, low, high, cells)
        error = grid_error(by_grid(cell_samples(spark, low, high, cells), grid, low, high, cells), projection).first()["max_error"]
        if error is not None and error <= tolerance:
            return cells, grid
    return None


def reprojected(points: DataFrame, projection, low: tuple[float, float], high: tuple[float, float]) -> DataFrame:
    """Adds ``lon`` and ``lat``: by a grid where one is exact enough, or else by the projection."""
    found = chosen_grid(points.sparkSession, projection, low, high)
    if found:
        return by_grid(points, found[1], low, high, found[0])
    lon, lat = projection.inverse(F.col("x"), F.col("y"))
    return points.withColumns({"lon": lon, "lat": lat})


def horizontal_span(rects: DataFrame, lonlat, keys: list[str]) -> DataFrame:
    """``span``: the longest straight line in metres across each rectangle, bottom to top or left to right."""
    t = F.col("i") / float(SEGMENTS)
    x, y = F.col("min_x") + (F.col("max_x") - F.col("min_x")) * t, F.col("min_y") + (F.col("max_y") - F.col("min_y")) * t
    ground = lambda a, b: geocentric(*lonlat(a, b), F.lit(0.0))
    up = chord(ground(x, F.col("min_y")), ground(x, F.col("max_y")))
    over = chord(ground(F.col("min_x"), y), ground(F.col("max_x"), y))
    each = rects.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS)))).select(*keys, F.greatest(up, over).alias("m"))
    span = each.groupBy(*keys).agg(F.max("m").alias("span"), F.max(F.isnan("m").cast("int")).alias("bad"))
    return span.select(*keys, F.when(F.col("bad") == 1, F.raise_error(F.lit("a span is not finite")).cast("double")).otherwise(F.col("span")).alias("span"))


def root_span(horizontal: Column, side: Column, height: Column, unit: float, z_unit: float, angular: bool, has_span: Column) -> Column:
    """The metric span of the root node: the larger of width and height. Without a usable width
    a projected cloud takes the cube's side; one in degrees is an error."""
    flat = F.raise_error(F.lit("bounds in degrees are degenerate")).cast("double") if angular else side * max(unit, z_unit)
    return F.when(has_span, F.greatest(horizontal, height * z_unit)).otherwise(flat)
