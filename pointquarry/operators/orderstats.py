"""Order statistics at a floor index: exact, and no group need fit into one task."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bins between the smallest and the largest value of a group.
BINS = 512


def floor_index(n: Column, fraction: float) -> Column:
    """The place floor(fraction * n) from 0, within the group."""
    return F.least(n - 1, F.greatest(F.lit(0), F.floor(n * F.lit(fraction)))).cast("long")


def order_statistics(df: DataFrame, value: str, fractions: Mapping[str, float], by: list[str] | None = None) -> DataFrame:
    """For each group the values at the floor indices of ``fractions``, named as these, and ``n``.

    Values are counted by bins of their group's range; the bin of each index is found from
    the counts, and only the values in such bins are ranked, each bin by itself. So all
    counts are partial before the shuffle, and a hot group spreads over its bins. Null and
    NaN values are left out; a group without others has no row.
    """
    by = by or []
    clean = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*by, F.col(value).cast("double").alias("v"))
    key = by or ["one"]
    clean = clean if by else clean.withColumn("one", F.lit(0))
    span = clean.groupBy(*key).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    width = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(BINS - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS))).otherwise(0)
    binned = clean.join(F.broadcast(span) if not by else span, key).withColumn("bin", width.cast("int"))
    counts = binned.groupBy(*key, "bin", "n").agg(F.count("*").alias("held"))
    before = F.coalesce(F.sum("held").over(W.partitionBy(*key).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    places = counts.withColumn("before", before).select(*key, "bin", "n", "held", "before", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), floor_index(F.col("n"), f).alias("at")) for name, f in fractions.items()])).alias("s"))
    wanted = places.where((F.col("s.at") >= F.col("before")) & (F.col("s.at") < F.col("before") + F.col("held"))).select(*key, "bin", "n", F.col("s.name").alias("name"), (F.col("s.at") - F.col("before") + 1).alias("place"))
    bins = wanted.select(*key, "bin").distinct()
    ranked = binned.join(bins, [*key, "bin"], "left_semi").select(*key, "bin", "v").withColumn("place", F.row_number().over(W.partitionBy(*key, "bin").orderBy("v")))
    hits = ranked.join(wanted, [*key, "bin", "place"])
    out = hits.groupBy(*key).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in fractions])
    return out if by else out.drop("one")


def upper_median(df: DataFrame, value: str, by: list[str] | None = None, name: str = "median") -> DataFrame:
    """The value at floor(n / 2): the upper one of an even number."""
    return order_statistics(df, value, {name: 0.5}, by)


def robust_range(df: DataFrame, value: str, low: float = 0.01, high: float = 0.99, least: int = 32) -> DataFrame:
    """(lo, hi): the range without outliers; null with fewer values than ``least`` or without a span."""
    s = order_statistics(df, value, {"lo": low, "hi": high})
    good = (F.col("n") >= least) & (F.col("hi") > F.col("lo"))
    return s.select(F.when(good, F.col("lo")).alias("lo"), F.when(good, F.col("hi")).alias("hi"))
