"""Curves of measurements by load: bucket medians, comparison, matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointquarry.operators.orderstats import upper_median


def bucket_curve(df: DataFrame, load: str, value: str, bucket: float, least: int = 3, by: list[str] | None = None) -> DataFrame:
    """(pts, n, median): the upper median of the values in each bucket of load, of ``least`` values at least.

    A load belongs to the nearest multiple of ``bucket``, halves to the upper.
    """
    by = by or []
    at = df.select(*by, (F.floor(F.col(load) / bucket + 0.5) * bucket).cast("double").alias("pts"), value)
    return upper_median(at, value, [*by, "pts"]).where(F.col("n") >= least)


def noise_floor(a: DataFrame, b: DataFrame) -> DataFrame:
    """The largest relative difference between two curves of one thing; 0 without common buckets."""
    both = a.select("pts", F.col("median").alias("a")).join(b.select("pts", F.col("median").alias("b")), "pts")
    return both.agg(F.coalesce(F.max(F.abs(F.col("a") - F.col("b")) / ((F.col("a") + F.col("b")) / 2)), F.lit(0.0)).alias("floor"))


def compared(a: DataFrame, b: DataFrame, floor: DataFrame, tie: float = 0.10) -> DataFrame:
    """Common buckets of two curves: who wins by their ratio, and that to 3 places; within the noise
    or ``tie`` nobody does. ``floor`` is one row."""
    both = a.select("pts", F.col("median").alias("a")).join(b.select("pts", F.col("median").alias("b")), "pts").crossJoin(F.broadcast(floor))
    out = both.withColumn("ratio", F.col("a") / F.col("b"))
    judged = out.withColumn("verdict", F.when(F.abs(F.col("ratio") - 1) <= F.greatest(F.lit(tie), F.col("floor")), "tie").when(F.col("ratio") < 1, "win").otherwise("loss"))
    return judged.withColumn("ratio", F.floor(F.col("ratio") * 1000 + 0.5) / 1000)


def plateau(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The bucket with most values; the smallest load of equal ones."""
    return curve.groupBy(*(by or [])).agg(F.max(F.struct("n", (-F.col("pts")).alias("neg"), "median")).alias("b")).select(*(by or []), (-F.col("b.neg")).alias("pts"), F.col("b.n").alias("n"), F.col("b.median").alias("median"))


def flatness(curve: DataFrame) -> DataFrame:
    """Largest over smallest value of a curve, to 2 places."""
    return curve.agg((F.floor(F.max("median") / F.min("median") * 100 + 0.5) / 100).alias("flatness"))


def best_match(runs: DataFrame, target: float, load: str, order: str) -> DataFrame:
    """The run whose load is nearest to the target (the first of equal ones) and the part it misses by."""
    b = F.min(F.struct(F.abs(F.col(load) - target).alias("miss"), F.col(order).alias("ord"), F.col(load).alias("load"))).alias("b")
    return runs.agg(b).select(F.col("b.ord").alias(order), F.col("b.load").alias(load), (F.col("b.miss") / target).alias("mismatch"))


def pairs_within(a: DataFrame, b: DataFrame, load: str, part: float = 0.1) -> DataFrame:
    """Pairs of runs whose loads differ by at most ``part`` of the second's (which is above 0).

    Loads are dealt to buckets on a logarithmic scale, a pair can only be in neighbouring ones.
    """
    step = F.log(F.lit(1 / (1 - part)))
    cell = lambda c: F.floor(F.log(c) / step)
    left = a.where(F.col(load) > 0).select(F.col("run").alias("run_a"), F.col(load).alias("load_a")).withColumn("cell", F.explode(F.array(*[cell(F.col("load_a")) + i for i in (-1, 0, 1)])))
    right = b.where(F.col(load) > 0).select(F.col("run").alias("run_b"), F.col(load).alias("load_b")).withColumn("cell", cell(F.col("load_b")))
    return left.join(right, "cell").where(F.abs(F.col("load_a") - F.col("load_b")) / F.col("load_b") <= part).drop("cell")


def axis_report(samples: DataFrame, run: str, axes: list[str], points: str) -> DataFrame:
    """(axis, median, pct, per_million): each axis summed by run, then the upper median over runs."""
    each = samples.groupBy(run).agg(F.sum(points).alias("points"), *[F.sum(a).alias(a) for a in axes])
    long = each.select(run, "points", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("axis"), F.col(a).alias("ms")) for i, a in enumerate(axes)])).alias("s")).select(run, "points", "s.*")
    med = upper_median(long, "ms", ["i", "axis"])
    pts = upper_median(each.withColumn("points", F.col("points").cast("double")), "points", name="points").select("points")
    total = med.agg(F.sum("median").alias("total"))
    return med.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(pts)).select("axis", "median", (F.col("median") * 100 / F.col("total")).alias("pct"), (F.col("median") / F.col("points") * 1e6).alias("per_million"))


def top_axis(report: DataFrame, axes: list[str]) -> DataFrame:
    """The axis of the largest median in a report of axes; of equal ones the first in ``axes``."""
    place = F.array_position(F.array(*[F.lit(a) for a in axes]), F.col("axis"))
    best = F.max_by(F.struct("axis", "pct", "per_million"), F.struct("median", -place))
    return report.agg(best.alias("b")).select("b.*")
