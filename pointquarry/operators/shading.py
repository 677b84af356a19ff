"""Colours of whole clouds: ramps over a range, per-node scales, the spread of hues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointquarry.functions.colors import CHANNELS, class_color, eight_bit, hue_bin, ramp, return_color
from pointquarry.operators.orderstats import robust_range
from pointquarry.scratch import small, written

MODES = ("height", "intensity", "classification", "return", "rgb")


def height_range(root: DataFrame, fallback: tuple[float, float], z: str = "z") -> DataFrame:
    """One row (lo, hi): the robust range of the root node's heights, or that of the header."""
    r = robust_range(root, z)
    return r.agg(F.coalesce(F.max("lo"), F.lit(fallback[0])).alias("lo"), F.coalesce(F.max("hi"), F.lit(fallback[1])).alias("hi"))


def height_colored(points: DataFrame, range_: DataFrame, z: str = "z") -> DataFrame:
    """Adds ``color`` by height; the range is one row for the whole cloud."""
    return points.crossJoin(F.broadcast(range_)).withColumn("color", ramp(F.col(z), F.col("lo"), F.col("hi"))).drop("lo", "hi")


def scaled_by_node(points: DataFrame, value: str, by: str = "node_key") -> DataFrame:
    """Adds ``color`` by a value's place in the range of its node."""
    w = W.partitionBy(by)
    return points.withColumns({"__lo": F.min(value).over(w), "__hi": F.max(value).over(w)}).withColumn("color", ramp(F.col(value), F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")


def true_colored(points: DataFrame, by: str = "node_key") -> DataFrame:
    """Adds ``color`` of the points' own channels, in 8 bits if their node needs it. A node's largest value comes to its points,
    which stay where they are."""
    most = written(points.groupBy(by).agg(F.max(F.greatest(*CHANNELS)).alias("__most")), "channels")
    p = points.join(small(most), by, "left")
    return p.withColumn("color", F.struct(*[eight_bit(F.col(c), F.col("__most")).cast("int").alias(c) for c in CHANNELS])).drop("__most")


def colored(points: DataFrame, mode: str, range_: DataFrame | None = None) -> DataFrame:
    """Adds ``color`` by a mode; height where the columns of another mode are missing."""
    needs = {"intensity": ["intensity"], "classification": ["classification"], "return": ["return_number"], "rgb": list(CHANNELS)}
    if mode not in MODES:
        raise ValueError(f"no colour mode {mode}")
    if mode == "height" or not set(needs[mode]) <= set(points.columns):
        return height_colored(points, range_ if range_ is not None else points.agg(F.min("z").alias("lo"), F.max("z").alias("hi")))
    if mode == "intensity":
        return scaled_by_node(points, "intensity")
    if mode == "rgb":
        return true_colored(points)
    return points.withColumn("color", class_color(F.col("classification")) if mode == "classification" else return_color(F.col("return_number")))


def hue_arc(pixels: DataFrame, bins: int = 36, part: float = 0.9) -> DataFrame:
    """The shortest arc of hues that holds ``part`` of all coloured pixels, in degrees.

    The histogram has a row per bin, so what follows it is small: it is laid out twice
    in a row, and prefix sums give the shortest stretch from each start.
    """
    hist = pixels.select(hue_bin(*map(F.col, CHANNELS), bins).alias("bin")).where("bin is not null").groupBy("bin").count()
    dense = pixels.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(hist, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("n"))
    twice = dense.select(F.explode(F.array(F.col("bin"), F.col("bin") + bins)).alias("at"), "n")
    sums = twice.withColumns({"until": F.sum("n").over(W.orderBy("at").rowsBetween(W.unboundedPreceding, 0)), "total": F.sum("n").over(W.partitionBy()) / 2})
    ends = sums.select(F.col("at").alias("end"), F.col("until").alias("to"))
    starts = sums.where(F.col("at") < bins).select(F.col("at").alias("start"), (F.col("until") - F.col("n")).alias("from"), "total")
    enough = (F.col("end") >= F.col("start")) & (F.col("end") < F.col("start") + bins) & (F.col("to") - F.col("from") >= F.col("total") * part)
    length = starts.join(ends, enough).agg(F.min(F.col("end") - F.col("start") + 1).alias("bins"), F.max("total").cast("long").alias("coloured"))
    top = dense.agg(F.max(F.struct("n", (-F.col("bin")).alias("neg"))).alias("t"))
    return length.crossJoin(top).select("coloured", (F.col("bins") * (360.0 / bins)).alias("span_deg"), (-F.col("t.neg") * (360 // bins)).cast("int").alias("dominant_deg"))
