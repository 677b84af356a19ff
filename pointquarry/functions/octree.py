"""Keys, cubes and errors of octree nodes as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_of(d: Column, x: Column, y: Column, z: Column) -> Column:
    return F.concat_ws("-", *[c.cast("string") for c in (d, x, y, z)])


def key_parts(key: Column) -> tuple[Column, Column, Column, Column]:
    """Depth and the three places of a key D-X-Y-Z."""
    parts = F.split(key, "-")
    return tuple(F.get(parts, i).cast("int") for i in range(4))


def place_at(coordinate: Column, low: float, side: float, depth: Column) -> Column:
    """The place along an axis of the node of a depth that holds a coordinate; the upper
    face of the cube belongs to the last node."""
    cells = F.pow(F.lit(2.0), depth)
    return F.least(cells - 1, F.floor((coordinate - low) / (F.lit(side) / cells))).cast("int")


def node_side(side: float, depth: Column) -> Column:
    return F.lit(float(side)) / F.pow(F.lit(2.0), depth)


def within(coordinate: Column, low: float, side: float) -> Column:
    """Whether a coordinate is in the cube, both faces included."""
    return coordinate.between(low, low + side)


def child(place: Column, octant: Column, axis: int) -> Column:
    """The place of a child along an axis (0 x, 1 y, 2 z)."""
    return place * 2 + F.shiftright(octant, axis).bitwiseAND(F.lit(1))


def parent(place: Column) -> Column:
    return F.shiftright(place, 1)


def geometric_error(root_span: float, depth: Column) -> Column:
    """Error in metres of a node that is drawn in place of its children."""
    return F.lit(root_span / 16) / F.pow(F.lit(2.0), depth)


def screen_error(error: Column, distance: Column, height: float, field_of_view: float) -> Column:
    """That error in pixels at a distance (``field_of_view`` in radians)."""
    import math

    return error * F.lit(height / 2) / (distance * F.lit(math.tan(field_of_view / 2)))
