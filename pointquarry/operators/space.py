"""Exact nearest points in space, by a search down a tree of cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointquarry.functions.geodesy import geocentric
from pointquarry.scratch import written

#: Points that a cell of the lowest level has on average, and cells up to which a level is sent to all tasks (100 bytes each).
POINTS, FEW = 64, 1 << 16
#: A bound on distances is widened by this part, for the rounding of sums.
SLACK = 1e-9


def embedded(projection, unit: float, z_unit: float, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """A position of a cloud in a space whose straight distances are metres: geocentric for
    a cloud in degrees (``projection`` is none), the scaled source axes for a projected one."""
    if projection is None:
        return geocentric(x, y, z * z_unit)
    return x * unit, y * unit, z * z_unit


def source_position(projection, z_unit: float, lon: Column, lat: Column, height: Column) -> tuple[Column, Column, Column]:
    """The source coordinates of degrees and a height in metres."""
    x, y = (lon, lat) if projection is None else projection.forward(lon, lat)
    return x, y, height / z_unit


def nearest_points(seeds: DataFrame, points: DataFrame, keep: list[str], order: list[str], id_col: str = "seed_id", axes: tuple[str, str, str] = ("ex", "ey", "ez"), cell_points: int = POINTS) -> DataFrame:
    """The nearest point to each seed among all points, by straight distance along ``axes`` (of both tables, in one unit).

    Space is cut into cubes, of about ``cell_points`` points each at the lowest level, and the tree above them goes down level by level.
    Each cell holds the box of its own points. A seed keeps a cell if the box is not farther than the far corner of the nearest
    kept box can be, so the cell of the nearest point always stays; at the lowest level the seed meets the points of the few cells left, by
    an equi-join on the cell and a partial minimum. No seed meets all points of a node. Levels of at most ``FEW`` cells are
    broadcast, larger ones joined by cell.

    Returns the id, the columns ``keep`` of the point and ``distance``. Ties go to the first in ``order``. Seeds and points with a null,
    infinite or NaN coordinate take no part; without points no seed has a row. Seeds of one id are one seed each only if they are equal.
    """
    finite = [F.col(a).isNotNull() & ~F.isnan(a) & (F.abs(F.col(a)) < float("inf")) for a in axes]
    usable = finite[0] & finite[1] & finite[2]
    p = points.where(usable)
    bounds = p.agg(F.count("*").alias("n"), *[f(a).alias(f"{f.__name__}_{a}") for a in axes for f in (F.min, F.max)]).first()
    kinds = {f.name: f.dataType for f in points.schema.fields}
    if not bounds["n"]:
        return seeds.sparkSession.createDataFrame([], seeds.select(id_col).schema).select(id_col, *[F.lit(None).cast(kinds[c]).alias(c) for c in keep], F.lit(0.0).alias("distance"))
    low = [bounds[f"min_{a}"] for a in axes]
    side = max(max(bounds[f"max_{a}"] - b for a, b in zip(axes, low, strict=True)), 1e-9) * (1 + 1e-12)
    # Points lie on surfaces, so a level has about four times as many cells as the one above.
    depth = min(30, max(0, math.ceil(math.log(max(1.0, bounds["n"] / cell_points), 4))))
    places = [F.least(F.lit((1 << depth) - 1), F.floor((F.col(a) - b) / (side / (1 << depth)))).cast("long").alias(f"c{i}") for i, (a, b) in enumerate(zip(axes, low, strict=True))]
    cells = ["c0", "c1", "c2"]
    dealt = p.select(*places, F.struct(*axes).alias("at"), F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)]).alias("first"), F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]).alias("kept"))
    boxes = dealt.groupBy(*cells).agg(*[f(F.col("at")[a]).alias(f"{n}{i}") for i, a in enumerate(axes) for f, n in ((F.min, "l"), (F.max, "h"))])
    levels = [written(boxes, "cells")]
    for _ in range(depth):
        up = levels[-1].groupBy(*[F.shiftright(c, 1).alias(c) for c in cells]).agg(*[f(f"{n}{i}").alias(f"{n}{i}") for i in range(3) for f, n in ((F.min, "l"), (F.max, "h"))])
        levels.append(written(up, "cells"))
    asked = seeds.where(usable).select(F.col(id_col).alias("id"), *[F.col(a).alias(f"s{i}") for i, a in enumerate(axes)]).distinct()
    found = asked.select("*", *[F.lit(0).cast("long").alias(c) for c in cells])
    one = W.partitionBy("id", "s0", "s1", "s2")
    for level in reversed(levels[:-1]):
        below = level.select("*", *[F.shiftright(c, 1).alias(f"p{c}") for c in cells])
        small = level.count() <= FEW
        met = found.withColumnsRenamed({c: f"p{c}" for c in cells}).join(F.broadcast(below) if small else below, [f"p{c}" for c in cells])
        near = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"l{i}") - F.col(f"s{i}"), F.col(f"s{i}") - F.col(f"h{i}")), 2) for i in range(3)), F.lit(0.0))
        far = sum((F.pow(F.greatest(F.abs(F.col(f"l{i}") - F.col(f"s{i}")), F.abs(F.col(f"h{i}") - F.col(f"s{i}"))), 2) for i in range(3)), F.lit(0.0))
        kept = met.select("id", "s0", "s1", "s2", *cells, near.alias("near"), far.alias("far")).withColumn("most", F.min("far").over(one))
        found = written(kept.where(F.col("near") <= F.col("most") * (1 + SLACK)).select("id", "s0", "s1", "s2", *cells), "candidates")
    d2 = sum((F.pow(F.col("at")[a] - F.col(f"s{i}"), 2) for i, a in enumerate(axes)), F.lit(0.0))
    best = found.join(dealt, cells).select("id", "s0", "s1", "s2", F.struct(d2.alias("d2"), "first", "kept").alias("b")).groupBy("id", "s0", "s1", "s2").agg(F.min("b").alias("b"))
    return best.select(F.col("id").alias(id_col), *[F.col("b.kept")[f"k{i}"].alias(c) for i, c in enumerate(keep)], F.sqrt("b.d2").alias("distance"))


def snap_geographic(seeds: DataFrame, points: DataFrame, keep: list[str], order: list[str], projection=None, unit: float = 1.0, z_unit: float = 1.0, id_col: str = "seed_id") -> DataFrame:
    """The nearest point of a cloud to each seed given as ``lon``, ``lat`` and ``height`` in metres.

    ``projection`` is that of the cloud's x and y, none if they are degrees; ``unit`` and ``z_unit`` are metres of its units. Distances are
    metres: between geocentric positions for a cloud in degrees, along the scaled source axes for a projected one. A position that the
    projection cannot place has no row.
    """
    at = seeds.select(id_col, *[c.alias(n) for c, n in zip(source_position(projection, z_unit, F.col("lon"), F.col("lat"), F.col("height")), "xyz", strict=True)])
    axes = ("ex", "ey", "ez")
    placed = [df.withColumns(dict(zip(axes, embedded(projection, unit, z_unit, F.col("x"), F.col("y"), F.col("z")), strict=True))) for df in (at, points)]
    return nearest_points(*placed, keep, order, id_col, axes)
