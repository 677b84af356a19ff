"""Measurement series: settling, changes, drift, in-flight counts, lifecycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointquarry.operators.orderstats import upper_median


def deltas(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Adds ``delta``, the difference to the row before; the first row has none."""
    return df.withColumn("delta", F.col(value) - F.lag(value).over(W.partitionBy(*by).orderBy(*order)))


def changed_only(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the row before (the first row stays)."""
    before = F.lag(value).over(W.partitionBy(*by).orderBy(*order))
    first = F.row_number().over(W.partitionBy(*by).orderBy(*order)) == 1
    return df.withColumns({"__b": before, "__f": first}).where(F.col("__f") | ~F.col("__b").eqNullSafe(F.col(value))).drop("__b", "__f")


def settled(df: DataFrame, by: list[str], t: str, order: list[str], value: str, quiet: float) -> DataFrame:
    """When each series settles: the start of the first plateau of at least ``quiet``, and its value.

    Rows of a plateau have one value one after another; it lasts from its first to its last row.
    """
    w = W.partitionBy(*by).orderBy(t, *order)
    moved = df.withColumn("__c", (~F.lag(value).over(w).eqNullSafe(F.col(value))).cast("int"))
    runs = moved.withColumn("__run", F.sum("__c").over(w.rowsBetween(W.unboundedPreceding, 0)))
    each = runs.groupBy(*by, "__run").agg(F.min(t).alias("since"), F.max(t).alias("until"), F.max(value).alias("value"))
    return each.where(F.col("until") - F.col("since") >= quiet).groupBy(*by).agg(F.min(F.struct("since", "until", "value")).alias("b")).select(*by, "b.*")


def frame_summary(deltas_: DataFrame, delta: str, slow: float) -> DataFrame:
    """Number, sum, longest and count of slow frames."""
    return deltas_.agg(F.count(delta).alias("frames"), F.max(delta).alias("longest"), F.sum(F.when(F.col(delta) > slow, 1).otherwise(0)).cast("long").alias("slow"))


def drift(df: DataFrame, by: list[str], order: list[str], value: str, k: int = 3) -> DataFrame:
    """Means of the first and the last ``k`` rows of each series, and their ratio."""
    up = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    n = F.count("*").over(W.partitionBy(*by))
    ranked = df.withColumns({"__up": up, "__n": n})
    first = F.avg(F.when(F.col("__up") <= k, F.col(value)))
    last = F.avg(F.when(F.col("__up") > F.col("__n") - k, F.col(value)))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), first.alias("first_mean"), last.alias("last_mean")).withColumn("ratio", F.when(F.col("first_mean") != 0, F.col("last_mean") / F.col("first_mean")))


def quarter_drift(df: DataFrame, by: list[str], order: list[str], value: str, jump: float) -> DataFrame:
    """Means of the first and the last quarter (floor(n / 4) rows), and how often a value jumps."""
    w = W.partitionBy(*by).orderBy(*order)
    r = df.withColumns({"__up": F.row_number().over(w), "__n": F.count("*").over(W.partitionBy(*by)), "__before": F.lag(value).over(w)})
    q = F.floor(F.col("__n") / 4)
    return r.groupBy(*by).agg(
        F.avg(F.when(F.col("__up") <= q, F.col(value))).alias("first_quarter"),
        F.avg(F.when(F.col("__up") > F.col("__n") - q, F.col(value))).alias("last_quarter"),
        F.sum(F.when(F.col(value) - F.col("__before") > jump, 1).otherwise(0)).cast("long").alias("jumps"),
    )


def unbounded(drifts: DataFrame, peak: DataFrame, by: list[str], ratio: float = 1.8, least_peak: float = 12) -> DataFrame:
    """Whether what is in flight grows without bound: its end is much above its start, and its peak is high."""
    grows = (F.col("last_mean") > F.col("first_mean") * ratio) & (F.col("peak") > least_peak)
    return drifts.join(peak, by).withColumn("unbounded", grows)


def in_flight(df: DataFrame, by: list[str], started: Column, done: Column) -> DataFrame:
    """Started, done and open tiles of each session."""
    s, d = F.sum(started.cast("int")).cast("long"), F.sum(done.cast("int")).cast("long")
    return df.groupBy(*by).agg(s.alias("started"), d.alias("done")).withColumn("in_flight", F.col("started") - F.col("done"))


def host_limits(owners: DataFrame) -> DataFrame:
    """The limit of each host: the smallest positive one of its owners; hosts without any have no row."""
    return owners.where("request_limit > 0").groupBy("host").agg(F.min("request_limit").alias("request_limit"), F.count("*").alias("owners"))


def answered_once(answers: DataFrame, request: str, order: list[str]) -> DataFrame:
    """The first answer of each request."""
    cols = [c for c in answers.columns if c != request]
    first = F.min(F.struct(*order, *[F.col(c).alias(f"__{c}") for c in cols])).alias("b")
    return answers.groupBy(request).agg(first).select(request, *[F.col(f"b.__{c}").alias(c) for c in cols])


def lifecycles(starts: DataFrame, ends: DataFrame, key: list[str]) -> DataFrame:
    """Requests with their start, end and duration; those that did not end are left out."""
    s = starts.groupBy(*key).agg(F.min("t").alias("t_start"))
    e = ends.groupBy(*key).agg(F.max("t").alias("t_end"), F.sum("bytes").alias("bytes"))
    return s.join(e, key).where("t_end >= t_start").withColumn("ms", F.col("t_end") - F.col("t_start"))


def latest_only(df: DataFrame, by: list[str], token: str) -> DataFrame:
    """Rows of the largest token of their group: late answers to older clicks go."""
    top = df.groupBy(*by).agg(F.max(token).alias("__top"))
    return df.join(top, by).where(F.col(token) == F.col("__top")).drop("__top")


def mean_difference(a: DataFrame, b: DataFrame, place: str, value: str) -> DataFrame:
    """Mean absolute difference of two series over their common places; null without any."""
    both = a.select(place, F.col(value).alias("a")).join(b.select(place, F.col(value).alias("b")), place)
    return both.agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("difference"))


def lit_pixels(pixels: DataFrame, width: int, height: int, dark: float = 10) -> DataFrame:
    """Centre, bounds and share of the pixels that are brighter than ``dark``, in parts of the picture."""
    lit = pixels.where(F.greatest("red", "green", "blue") > dark)
    parts = [f(F.col(c)) / s for c, s in (("px", width), ("py", height)) for f in (F.avg, F.min, F.max)]
    names = [f"{f}_{c}" for c in ("x", "y") for f in ("mean", "min", "max")]
    return lit.agg(*[p.alias(n) for p, n in zip(parts, names, strict=True)], (F.count("*") / (width * height)).alias("coverage"))


def variant_costs(passes: DataFrame, points: float) -> DataFrame:
    """What reading costs by variant (none, xyz, all), in ms per million points, from medians per variant."""
    per = lambda c: c / points * 1e6
    wide = passes.groupBy().pivot("variant", ["none", "xyz", "all"]).agg(F.max("median"))
    return wide.select(per(F.col("none")).alias("decompress"), per(F.col("xyz") - F.col("none")).alias("positions"), per(F.col("all") - F.col("none")).alias("all_dimensions"), (F.col("none") / F.col("xyz")).alias("share"))


def bytes_by_pattern(sent: DataFrame, finished: DataFrame, key: list[str], pattern: str) -> DataFrame:
    """Requests whose URL matches, and the bytes of those of them that finished."""
    asked = sent.where(F.col("url").rlike(pattern)).select(*key).distinct()
    done = finished.groupBy(*key).agg(F.sum("bytes").alias("bytes"))
    return asked.join(done, key, "left").agg(F.count("*").alias("requests"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def staleness(logs: DataFrame, least: float) -> DataFrame:
    """Adds what a log line says is shown, its ratio to what is there, and whether that is enough without failures."""
    shown = F.regexp_extract("line", r"shown=(\d+)", 1).cast("double")
    ratio = F.when(F.col("actual") > 0, shown / F.col("actual"))
    return logs.withColumns({"shown": shown, "ratio": ratio}).withColumn("fresh", F.coalesce((F.col("ratio") >= least) & (F.col("failed") == 0), F.lit(False)))


def frame_rate(frames: DataFrame, t_ms: str, by: list[str]) -> DataFrame:
    """Whole frames per second of each series; null without a duration."""
    span = F.max(t_ms) - F.min(t_ms)
    return frames.groupBy(*by).agg(F.floor(F.when(span > 0, (F.count("*") - 1) * 1000 / span) + 0.5).alias("fps"))


def suite_summary(checks: DataFrame) -> DataFrame:
    """Checks, failures and passes of each suite."""
    failed = F.sum(F.when(F.col("failed"), 1).otherwise(0)).cast("long")
    return checks.groupBy("suite").agg(F.count("*").alias("total"), failed.alias("failures")).withColumn("passes", F.col("total") - F.col("failures"))


def settled_states(df: DataFrame, loaded: Column, fired: Column, processing: Column) -> DataFrame:
    """Rows at rest: everything is loaded, the event of that came, and nothing is being processed."""
    return df.where(loaded & fired & (processing == 0))


def first_byte_report(df: DataFrame, kind: str = "kind", first: str = "ttfb", body: str = "body", size: str = "bytes") -> DataFrame:
    """Per kind of range: how many, the median waits for the first byte and for the body, the bytes, and the share of waiting."""
    sums = df.groupBy(kind).agg(F.sum(first).alias("__f"), F.sum(body).alias("__b"), F.sum(size).alias("bytes"))
    waits, bodies = (upper_median(df, c, [kind]) for c in (first, body))
    both = waits.withColumnRenamed("median", "ttfb_median").join(bodies.select(kind, F.col("median").alias("body_median")), kind)
    return both.join(sums, kind).select(kind, "n", "ttfb_median", "body_median", "bytes", (F.col("__f") / F.nullif(F.col("__f") + F.col("__b"), F.lit(0.0))).alias("waiting"))


def soak(df: DataFrame, by: list[str], t: str, every: float, ready: Column, unloaded: Column) -> DataFrame:
    """Samples of a long run every ``every``: what is ready then, what was unloaded so far, and whether the run unloads at all.

    Rows are counted by period before anything is ordered; the running sums go over periods.
    """
    tick = F.floor(F.col(t) / every).alias("tick")
    n = df.groupBy(*by, tick).agg(F.count_if(ready).alias("ready"), F.count_if(unloaded).alias("__u"))
    so_far = W.partitionBy(*by).orderBy("tick").rowsBetween(W.unboundedPreceding, W.currentRow)
    return n.withColumns({"unloads": F.sum("__u").over(so_far), "evicts": F.sum("__u").over(W.partitionBy(*by)) > 0}).drop("__u")
