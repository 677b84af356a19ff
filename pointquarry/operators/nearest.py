"""Nearest points of seeds, picked attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointquarry.functions.geodesy import chord, geocentric, source_metric
from pointquarry.scratch import small, written


def nearest_in_node(seeds: DataFrame, points: DataFrame, keep: list[str], order: list[str], unit: float = 1.0, z_unit: float = 1.0, id_col: str = "seed_id") -> DataFrame:
    """The nearest point to each seed among the points of its node (``node_key``).

    Seeds meet places, not points: equal seeds and points at one place of a node count once. A node is cut into cells, about as many
    as a cell has places, each with the box of its places. A seed keeps the cells whose box is not farther than the far corner of
    the nearest, and meets the places of these, so of n places in a node some root of n. Least distances are partial aggregates of numbers,
    which hold no pairs. The points at the nearest places are looked up at last; the first in ``order`` wins ties.

    Seeds in a node without points have no row, nor take seeds and points with a null, infinite or NaN coordinate part.
    ``distance`` is in metres.
    """
    metric = lambda dx, dy, dz: source_metric(dx, dy, dz, unit, z_unit)
    seed, place, cell = ["node_key", "s_x", "s_y", "s_z"], ["node_key", *"xyz"], ["node_key", "c_x", "c_y", "c_z"]
    s = written(seeds.where(finite("xyz")).select(F.col(id_col).alias("id"), "node_key", *[F.col(a).alias(f"s_{a}") for a in "xyz"]), "seeds")
    asked = s.select(*seed).distinct()
    shown = points.where(finite("xyz"))
    sizes = shown.groupBy("node_key").agg(F.count("*").alias("n"), *[f(a).alias(f"{n}_{a}") for a in "xyz" for f, n in ((F.min, "l"), (F.max, "h"))])
    # Points lie on surfaces, so a cut of edges in 2^g parts makes about 4^g cells: the root of n.
    parts = F.pow(F.lit(2.0), F.ceil(F.log2("n") / 4))
    grids = small(written(sizes.join(asked.select("node_key").distinct(), "node_key", "left_semi").select("node_key", parts.alias("parts"), *[F.col(f"l_{a}").alias(f"l_{a}") for a in "xyz"], *[F.greatest((F.col(f"h_{a}") - F.col(f"l_{a}")) / parts, F.lit(1e-300)).alias(f"w_{a}") for a in "xyz"]), "grids"))
    cut = [F.least(F.col("parts") - 1, F.floor((F.col(a) - F.col(f"l_{a}")) / F.col(f"w_{a}"))).cast("int").alias(f"c_{a}") for a in "xyz"]
    places = written(shown.select(*place).join(grids, "node_key").select(*place, *cut).distinct(), "places")
    boxes = places.groupBy(*cell).agg(*[f(a).alias(f"{n}_{a}") for a in "xyz" for f, n in ((F.min, "l"), (F.max, "h"))])
    # Each step of the metric keeps the order of what it rounds, so no place is nearer than its box or farther than the corner.
    near = metric(*[F.greatest(F.lit(0.0), F.col(f"l_{a}") - F.col(f"s_{a}"), F.col(f"s_{a}") - F.col(f"h_{a}")) for a in "xyz"])
    far = metric(*[F.greatest(F.abs(F.col(f"l_{a}") - F.col(f"s_{a}")), F.abs(F.col(f"h_{a}") - F.col(f"s_{a}"))) for a in "xyz"])
    bounded = asked.join(boxes, "node_key").groupBy(*seed).agg(F.min(far).alias("most"))
    kept = written(bounded.join(boxes, "node_key").where(near <= F.col("most")).select(*seed, *cell[1:]), "cells")
    met = kept.join(places, cell).withColumn("d2", metric(*[F.col(a) - F.col(f"s_{a}") for a in "xyz"]))
    least = met.groupBy(*seed).agg(F.min("d2").alias("least"))
    hits = written(met.join(least, seed).where(F.col("d2") == F.col("least")).select(*seed, *"xyz", "d2"), "hits")
    fields = [F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)]).alias("first"), F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]).alias("kept")]
    there = shown.select(*place, *fields).join(small(hits.select(*place).distinct()), place).groupBy(*place).agg(F.min(F.struct("first", "kept")).alias("b"))
    best = hits.join(there, place).groupBy(*seed, "d2").agg(F.min("b").alias("b"))
    return s.join(best, seed).select(F.col("id").alias(id_col), "node_key", *[F.col("b.kept")[f"k{i}"].alias(c) for i, c in enumerate(keep)], (F.sqrt("d2") * unit).alias("distance"))


def finite(axes) -> Column:
    """Whether all of the columns are numbers, and not infinite."""
    usable = F.lit(True)
    for a in axes:
        usable = usable & F.col(a).isNotNull() & ~F.isnan(a) & (F.abs(F.col(a)) < float("inf"))
    return usable


def snap_distance(seed: tuple[Column, Column, Column], hit: tuple[Column, Column, Column]) -> Column:
    """Straight distance between two positions in degrees and metres."""
    return chord(geocentric(*seed), geocentric(*hit))


def feature_ids(points: DataFrame, order: list[str], by: str = "node_key") -> DataFrame:
    """Adds ``feature_id``: the place of a point within its tile, from 0."""
    return points.withColumn("feature_id", F.row_number().over(W.partitionBy(by).orderBy(*order)) - 1)


def picked(features: DataFrame, asked: DataFrame, attributes: list[str]) -> DataFrame:
    """The attributes of asked features (``node_key``, ``feature_id``), as a map."""
    values = F.map_from_arrays(F.array(*[F.lit(a) for a in attributes]), F.array(*[F.col(a).cast("double") for a in attributes]))
    return features.join(asked, ["node_key", "feature_id"]).select("node_key", "feature_id", values.alias("attributes"))


def owned(hits: DataFrame, owner: Column, primitive: str = "primitive") -> DataFrame:
    """Hits on what the owner drew: those of others and hits on nothing (null) go."""
    return hits.where(F.col(primitive) == owner)
