"""Profiles of a cloud: classes, bounds, ranges, floating classes, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Names of standard classification codes.
CLASS_NAMES = {
    0: "created/never",
    1: "unclassified",
    2: "ground",
    3: "low veg",
    4: "med veg",
    5: "high veg",
    6: "building",
    7: "LOW NOISE",
    8: "model key",
    9: "water",
    17: "bridge deck",
    18: "HIGH NOISE",
}


def class_name(code: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in CLASS_NAMES.items() for x in kv])[code], F.lit("?"))


def in_depth_order(nodes: DataFrame) -> DataFrame:
    """Adds ``before``: the points of all nodes that come before, by depth and then key.

    A running sum over levels and, within a level, over its nodes: so levels are summed apart
    and no window spans all nodes.
    """
    levels = nodes.groupBy("d").agg(F.sum("point_count").alias("level"))
    above = levels.withColumn("above", F.coalesce(F.sum("level").over(W.orderBy("d").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("d", "above")
    own = F.coalesce(F.sum("point_count").over(W.partitionBy("d").orderBy("node_key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return nodes.join(F.broadcast(above), "d").withColumn("before", own + F.col("above")).drop("above")


def point_budget(nodes: DataFrame, budget: int) -> DataFrame:
    """How many points of each node a load takes that stops at ``budget``; nodes without any are left out."""
    take = F.least(F.col("point_count"), F.lit(budget) - F.col("before"))
    return in_depth_order(nodes).withColumn("take", take.cast("long")).where("take > 0")


def shallow_nodes(nodes: DataFrame, most_points: int) -> DataFrame:
    """Nodes in depth order until their points reach a number; the last one is whole."""
    return in_depth_order(nodes).where(F.col("before") < most_points)


def class_profile(points: DataFrame) -> DataFrame:
    """Count, share, heights and name of each class."""
    stats = points.groupBy("classification").agg(F.count("*").alias("n"), F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.avg("z").alias("z_mean"))
    return stats.withColumns({"pct": F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()), "name": class_name(F.col("classification"))})


def floating_classes(profile: DataFrame, header_span: float | None = None, ground: int = 2, part: float = 0.3) -> DataFrame:
    """Adds ``floats``: whether a class is on average far above ground; false without ground.

    A profile has a row per class, so windows over all its rows are small.
    """
    all_rows = W.partitionBy()
    base = F.max(F.when(F.col("classification") == ground, F.col("z_mean"))).over(all_rows)
    span = F.lit(header_span) if header_span is not None else F.max("z_max").over(all_rows) - F.min("z_min").over(all_rows)
    return profile.withColumn("floats", F.coalesce((F.col("classification") != ground) & (F.col("z_mean") > base + F.lit(part) * span), F.lit(False)))


def attribute_range(points: DataFrame, names: list[str]) -> DataFrame:
    """(name, lo, hi) of several attributes in one pass; NaN is left out."""
    value = lambda n: F.nanvl(F.col(n).cast("double"), F.lit(None).cast("double"))
    both = points.agg(*[f(value(n)).alias(f"{f.__name__}_{n}") for n in names for f in (F.min, F.max)])
    return both.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"min_{n}").alias("lo"), F.col(f"max_{n}").alias("hi")) for n in names])).alias("r")).select("r.*")


def bounds(points: DataFrame, axes: list[str], by: list[str] | None = None) -> DataFrame:
    """Smallest, largest and middle value of each axis."""
    out = points.groupBy(*(by or [])).agg(*[f(a).alias(f"{f.__name__}_{a}") for a in axes for f in (F.min, F.max)])
    return out.withColumns({f"mid_{a}": (F.col(f"min_{a}") + F.col(f"max_{a}")) / 2 for a in axes})


def every_nth(points: DataFrame, order: list[str], n: int, by: str) -> DataFrame:
    """Every n-th point of each group, in a definite order."""
    place = F.row_number().over(W.partitionBy(by).orderBy(*order)) - 1
    return points.withColumn("place", place).where(F.col("place") % n == 0)


def checksum(points: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Count and sums of columns in whole thousandths, whatever the order of rows."""
    return points.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(F.floor(F.col(c) * 1000 + 0.5).cast("long")).alias(f"sum_{c}") for c in columns])


def memory_limits(budget: Column, bytes_each: int = 8) -> tuple[Column, Column]:
    """(cache, overflow) in bytes, the two halves of what a budget of points may take; null, which is no limit, where it is not positive."""
    half = F.when(budget > 0, budget * bytes_each)
    return half, half
