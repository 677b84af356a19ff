"""Queries on measurements: percentiles, curves, plateaus, concurrency, drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointquarry.functions import numbers as N
from pointquarry.functions.transfer import clear_message
from pointquarry.operators import curves as CV
from pointquarry.operators import intervals as I
from pointquarry.operators import orderstats as O
from pointquarry.operators import series as SE
from pointquarry.plans.registry import query
from pointquarry.sources import clouds as C

ORDER = ["t_ms", "event_id"]
FLOOR = "{v}[least(len({v}) - 1, greatest(0, floor(len({v}) * {p})))::BIGINT + 1]"


def at(values: str, p: str) -> str:
    return FLOOR.format(v=values, p=f"{p}::DOUBLE")


@query("requests", f"WITH s AS (SELECT outcome, list_sort(list(dur_ms)) AS v FROM fx_requests GROUP BY 1) SELECT outcome, len(v) AS n, {at('v', '0.5')} AS median FROM s")
def upper_median(spark, sf):
    return O.upper_median(C.requests(spark, sf), "dur_ms", ["outcome"])


@query("requests", f"WITH s AS (SELECT outcome, list_sort(list(dur_ms)) AS v FROM fx_requests GROUP BY 1) SELECT outcome, len(v) AS n, {at('v', '0.5')} AS p50, {at('v', '0.95')} AS p95, {at('v', '0.99')} AS p99 FROM s")
def pct_p50_p95_p99(spark, sf):
    return O.order_statistics(C.requests(spark, sf), "dur_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, ["outcome"])


AXES = ["io", "decode", "reproject", "build"]


def samples(spark, sf):
    """A run (10 of them) with the four parts of the work of each request."""
    r = C.requests(spark, sf).withColumn("run", F.col("event_id") % 10)
    return r.select("run", *[F.when(F.col("outcome") == o, F.col("dur_ms")).otherwise(0.0).alias(a) for a, o in zip(AXES, ("view", "click", "error", "purchase"), strict=True)], F.lit(100).alias("points"))


@query("requests", f"""
WITH e AS (SELECT event_id % 10 AS run, count(*) * 100 AS points, sum(dur_ms) FILTER (outcome = 'view') AS io, sum(dur_ms) FILTER (outcome = 'click') AS decode, sum(dur_ms) FILTER (outcome = 'error') AS reproject, sum(dur_ms) FILTER (outcome = 'purchase') AS build FROM fx_requests GROUP BY 1),
l AS (UNPIVOT (SELECT io, decode, reproject, build FROM e) ON io, decode, reproject, build INTO NAME axis VALUE ms),
m AS (SELECT axis, {at('list_sort(list(coalesce(ms, 0)))', '0.5')} AS med FROM l GROUP BY axis), p AS (SELECT {at('list_sort(list(points))', '0.5')} AS pts FROM e)
SELECT axis, round(med, 3) AS median, round(med * 100 / (SELECT sum(med) FROM m), 3) AS pct, round(med / pts * 1e6, 1) AS per_million FROM m, p
""")
def axis_report(spark, sf):
    out = CV.axis_report(samples(spark, sf), "run", AXES, "points")
    return out.select("axis", F.round("median", 3).alias("median"), F.round("pct", 3).alias("pct"), F.round("per_million", 1).alias("per_million"))


def curve(spark, sf, which=None, of=2):
    r = C.requests(spark, sf).where("k is not null").withColumn("load", F.col("k") * 1000.0)
    r = r if which is None else r.where(F.col("event_id") % of == which)
    return CV.bucket_curve(r, "load", "dur_ms", 7000.0)


def curve_sql(name: str, where: str = "true") -> str:
    return f"{name} AS (SELECT pts, len(v) AS n, {at('v', '0.5')} AS median FROM (SELECT (floor(k * 1000 / 7000.0::DOUBLE + 0.5) * 7000)::DOUBLE AS pts, list_sort(list(dur_ms)) AS v FROM fx_requests WHERE k IS NOT NULL AND {where} GROUP BY 1) WHERE len(v) >= 3)"


BOTH = f"{curve_sql('a', 'event_id % 2 = 0')}, {curve_sql('b', 'event_id % 2 = 1')}, nf AS (SELECT coalesce(max(abs(a.median - b.median) / ((a.median + b.median) / 2)), 0) AS floor FROM a JOIN b USING (pts))"


@query("requests", f"WITH {curve_sql('c')} SELECT * FROM c")
def bucket_curve(spark, sf):
    return curve(spark, sf)


@query("requests", f"WITH {BOTH} SELECT round(floor, 9) AS floor FROM nf")
def noise_floor(spark, sf):
    return CV.noise_floor(curve(spark, sf, 0), curve(spark, sf, 1)).select(F.round("floor", 9).alias("floor"))


REPEATS = f"{curve_sql('e', 'event_id % 4 = 0')}, {curve_sql('f', 'event_id % 4 = 2')}, noise AS (SELECT coalesce(max(abs(e.median - f.median) / ((e.median + f.median) / 2)), 0) AS floor FROM e JOIN f USING (pts))"


@query("requests", f"""
WITH {BOTH}, {REPEATS}, r AS (SELECT pts, a.median AS am, b.median AS bm, a.median / b.median AS exact FROM a JOIN b USING (pts))
SELECT pts, am AS a, bm AS b, floor(exact * 1000 + 0.5) / 1000 AS ratio, CASE WHEN abs(exact - 1) <= greatest(0.1::DOUBLE, floor) THEN 'tie' WHEN exact < 1 THEN 'win' ELSE 'loss' END AS verdict FROM r, noise
""")
def curve_compare(spark, sf):
    """Two halves of the requests, against the noise between two repeats of the first."""
    floor = CV.noise_floor(curve(spark, sf, 0, 4), curve(spark, sf, 2, 4))
    return CV.compared(curve(spark, sf, 0), curve(spark, sf, 1), floor).select("pts", "a", "b", "ratio", "verdict")


@query("requests", f"WITH {curve_sql('c')} SELECT pts, n, median FROM c ORDER BY n DESC, pts LIMIT 1")
def plateau_mode(spark, sf):
    return CV.plateau(curve(spark, sf))


@query("requests", f"WITH {curve_sql('c')} SELECT floor(max(median) / min(median) * 100 + 0.5) / 100 AS flatness FROM c")
def flatness(spark, sf):
    return CV.flatness(curve(spark, sf))


@query("requests", f"WITH {curve_sql('c')} SELECT n AS run, pts, round(abs(pts - 40000) / 40000, 9) AS mismatch FROM (SELECT n, pts, row_number() OVER (ORDER BY abs(pts - 40000), n) AS r FROM c) WHERE r = 1")
def sweep_match(spark, sf):
    """The bucket nearest to a target load."""
    runs = curve(spark, sf).withColumnRenamed("n", "run")
    return CV.best_match(runs, 40_000.0, "pts", "run").select("run", "pts", F.round("mismatch", 9).alias("mismatch"))


@query("requests", f"WITH {BOTH} SELECT a.pts AS load_a, b.pts AS load_b FROM a, b WHERE a.pts > 0 AND b.pts > 0 AND abs(a.pts - b.pts) / b.pts <= 0.1::DOUBLE")
def pairs_within(spark, sf):
    a, b = (curve(spark, sf, i).withColumn("run", F.col("n")) for i in (0, 1))
    return CV.pairs_within(a, b, "pts").select("load_a", "load_b")


DELTAS = "d AS (SELECT *, t_ms - lag(t_ms) OVER (PARTITION BY sid ORDER BY t_ms, event_id) AS delta FROM fx_requests)"


@query("requests", f"WITH {DELTAS} SELECT count(delta) AS frames, max(delta) AS longest, count(*) FILTER (delta > 3600000) AS slow FROM d")
def frame_deltas(spark, sf):
    d = SE.deltas(C.requests(spark, sf), ["sid"], ORDER, "t_ms")
    return SE.frame_summary(d, "delta", 3_600_000.0)


@query("requests", f"WITH {DELTAS}, v AS (SELECT list_sort(list(delta)) AS v FROM d WHERE delta IS NOT NULL) SELECT len(v) AS n, {at('v', '0.5')} AS p50, {at('v', '0.95')} AS p95, {at('v', '0.99')} AS p99 FROM v")
def frame_percentiles(spark, sf):
    d = SE.deltas(C.requests(spark, sf), ["sid"], ORDER, "t_ms")
    return O.order_statistics(d, "delta", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("requests", """
WITH c AS (SELECT *, CASE WHEN lag(outcome) OVER w IS NOT DISTINCT FROM outcome THEN 0 ELSE 1 END AS ch FROM fx_requests WINDOW w AS (PARTITION BY sid ORDER BY t_ms, event_id)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY sid ORDER BY t_ms, event_id) AS run FROM c), p AS (SELECT sid, run, min(t_ms) AS since, max(t_ms) AS until, max(outcome) AS value FROM r GROUP BY 1, 2 HAVING max(t_ms) - min(t_ms) >= 3600000)
SELECT sid, since, until, value FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY since) AS k FROM p) WHERE k = 1
""")
def settle_detection(spark, sf):
    """The first stretch of an hour in which a session's outcome stays the same."""
    return SE.settled(C.requests(spark, sf), ["sid"], "t_ms", ["event_id"], "outcome", 3_600_000.0)


@query("requests", """
WITH c AS (SELECT sid, event_id, t_ms, k, lag(k) OVER w AS before, row_number() OVER w AS rn FROM fx_requests WINDOW w AS (PARTITION BY sid ORDER BY t_ms, event_id))
SELECT sid, event_id, k FROM c WHERE rn = 1 OR before IS DISTINCT FROM k
""")
def distinct_until_changed(spark, sf):
    return SE.changed_only(C.requests(spark, sf), ["sid"], ORDER, "k").select("sid", "event_id", "k")


RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY t_ms, event_id) AS up, count(*) OVER (PARTITION BY sid) AS cnt, lag(dur_ms) OVER (PARTITION BY sid ORDER BY t_ms, event_id) AS bef FROM fx_requests)"


@query("requests", f"WITH {RANKED} SELECT sid, count(*) AS n, round(avg(dur_ms) FILTER (up <= 3), 6) AS first_mean, round(avg(dur_ms) FILTER (up > cnt - 3), 6) AS last_mean FROM r GROUP BY sid")
def drift_first_last(spark, sf):
    d = SE.drift(C.requests(spark, sf), ["sid"], ORDER, "dur_ms")
    return d.select("sid", "n", F.round("first_mean", 6).alias("first_mean"), F.round("last_mean", 6).alias("last_mean"))


@query("requests", f"WITH {RANKED} SELECT sid, round(avg(dur_ms) FILTER (up <= cnt // 4), 6) AS first_quarter, round(avg(dur_ms) FILTER (up > cnt - cnt // 4), 6) AS last_quarter, count(*) FILTER (dur_ms - bef > 1000) AS jumps FROM r GROUP BY sid")
def drift_quarters(spark, sf):
    d = SE.quarter_drift(C.requests(spark, sf), ["sid"], ORDER, "dur_ms", 1000.0)
    return d.select("sid", F.round("first_quarter", 6).alias("first_quarter"), F.round("last_quarter", 6).alias("last_quarter"), "jumps")


@query("requests", f"WITH {RANKED}, g AS (SELECT sid, avg(k) FILTER (up <= 3) AS f, avg(k) FILTER (up > cnt - 3) AS l, max(k) AS peak FROM r GROUP BY sid) SELECT sid, peak, coalesce(l > f * 1.8::DOUBLE, false) AND peak > 12 AS unbounded FROM g WHERE f IS NOT NULL AND l IS NOT NULL AND peak IS NOT NULL")
def inflight_bounded(spark, sf):
    """Sessions whose number in flight grows without bound."""
    r = C.requests(spark, sf)
    d = SE.drift(r, ["sid"], ORDER, "k").where("first_mean is not null and last_mean is not null")
    return SE.unbounded(d, r.groupBy("sid").agg(F.max("k").alias("peak")).where("peak is not null"), ["sid"]).select("sid", "peak", "unbounded")


@query("requests", "SELECT sid, count(*) FILTER (outcome IN ('click', 'purchase', 'error')) AS started, count(*) FILTER (outcome IN ('click', 'purchase')) AS done, count(*) FILTER (outcome = 'error') AS in_flight FROM fx_requests GROUP BY sid")
def inflight_counters(spark, sf):
    o = F.col("outcome")
    return SE.in_flight(C.requests(spark, sf), ["sid"], o.isin("click", "purchase", "error"), o.isin("click", "purchase"))


@query("requests", "WITH e AS (SELECT t_ms AS t, 1 AS s FROM fx_requests UNION ALL SELECT t_ms + dur_ms, -1 FROM fx_requests), g AS (SELECT sum(s) OVER (ORDER BY t, s ROWS UNBOUNDED PRECEDING) AS c FROM e) SELECT max(c)::BIGINT AS most FROM g")
def max_concurrency(spark, sf):
    """How many requests are open at once at most."""
    r = C.requests(spark, sf).withColumn("end", F.col("t_ms") + F.col("dur_ms"))
    return I.concurrency(r, "t_ms", "end", 3_600_000.0)


@query("requests", "WITH w AS (SELECT count(*) OVER (ORDER BY t_ms RANGE BETWEEN CURRENT ROW AND 60000 FOLLOWING) AS c FROM fx_requests) SELECT max(c) AS most FROM w")
def burst_window(spark, sf):
    """How many requests come within a minute at most."""
    return I.burst(C.requests(spark, sf), "t_ms", 60_000)


@query("requests", "SELECT concat('host', sid % 50) AS host, min(k) AS request_limit, count(*) AS owners FROM fx_requests WHERE k > 0 GROUP BY 1")
def host_throttle_min(spark, sf):
    owners = C.requests(spark, sf).select(F.concat(F.lit("host"), (F.col("sid") % 50).cast("string")).alias("host"), F.col("k").alias("request_limit"))
    return SE.host_limits(owners)


@query("requests", "WITH s AS (SELECT sid, k, min(t_ms) AS t0 FROM fx_requests WHERE outcome = 'click' AND k IS NOT NULL GROUP BY 1, 2), e AS (SELECT sid, k, max(t_ms) AS t1, sum(dur_ms) AS bytes FROM fx_requests WHERE outcome = 'view' AND k IS NOT NULL GROUP BY 1, 2) SELECT sid, k, t0 AS t_start, t1 AS t_end, round(bytes, 6) AS bytes, t1 - t0 AS ms FROM s JOIN e USING (sid, k) WHERE t1 >= t0")
def request_lifecycle(spark, sf):
    """Requests that began with a click and ended with a view."""
    r = C.requests(spark, sf).where("k is not null").withColumnsRenamed({"t_ms": "t", "dur_ms": "bytes"})
    out = SE.lifecycles(r.where("outcome = 'click'").select("sid", "k", "t"), r.where("outcome = 'view'").select("sid", "k", "t", "bytes"), ["sid", "k"])
    return out.withColumn("bytes", F.round("bytes", 6)).select("sid", "k", "t_start", "t_end", "bytes", "ms")


@query("requests", "SELECT sid, k, event_id, outcome FROM (SELECT *, row_number() OVER (PARTITION BY sid, k ORDER BY t_ms, event_id) AS rn FROM fx_requests WHERE k IS NOT NULL) WHERE rn = 1")
def answered_once(spark, sf):
    """The first answer of each request of a session."""
    r = C.requests(spark, sf).where("k is not null").withColumn("req", F.struct("sid", "k"))
    return SE.answered_once(r.select("req", "t_ms", "event_id", "outcome"), "req", ORDER).select("req.sid", "req.k", "event_id", "outcome")


@query("requests", "SELECT sid, event_id FROM fx_requests JOIN (SELECT sid, max(t_ms) AS top FROM fx_requests GROUP BY 1) USING (sid) WHERE t_ms = top")
def latest_click(spark, sf):
    return SE.latest_only(C.requests(spark, sf), ["sid"], "t_ms").select("sid", "event_id")


@query("requests", "SELECT outcome, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 3) AS pct FROM fx_requests GROUP BY 1")
def state_histogram(spark, sf):
    counts = C.requests(spark, sf).groupBy("outcome").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("outcome", "n", F.round(F.col("n") * 100.0 / F.col("total"), 3).alias("pct"))


@query("requests", "SELECT CASE WHEN outcome = 'error' AND k % 2 = 0 THEN 'LOUD' WHEN outcome = 'error' THEN 'UNCLEAR' ELSE 'OK' END AS verdict, count(*) AS n FROM fx_requests WHERE k IS NOT NULL GROUP BY 1")
def verdict_counts(spark, sf):
    """Failures whose message names its reason, and others."""
    r = C.requests(spark, sf).where("k is not null")
    text = F.when(F.col("k") % 2 == 0, "HTTP 503 for range 0-9").otherwise("undefined is not an object")
    loud = clear_message(text, "http|range|timeout", "undefined|nan")
    verdict = F.when(F.col("outcome") != "error", "OK").when(loud, "LOUD").otherwise("UNCLEAR")
    return r.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("", "SELECT * FROM (VALUES (80.0::DOUBLE, 100.0::DOUBLE, '-20%'), (120.0::DOUBLE, 100.0::DOUBLE, '+20%'), (5.0::DOUBLE, 0.0::DOUBLE, 'n/a')) t(ours, base, delta)")
def pct_delta(spark, sf):
    rows = spark.createDataFrame([(80.0, 100.0), (120.0, 100.0), (5.0, 0.0)], "ours double, base double")
    return rows.withColumn("delta", N.percent_delta(F.col("ours"), F.col("base")))


@query("", "SELECT n::INT AS n, round(1 / ((1 - 0.84::DOUBLE) + 0.84::DOUBLE / n), 9) AS speedup FROM range(1, 9) t(n)")
def amdahl(spark, sf):
    return spark.range(1, 9).select(F.col("id").cast("int").alias("n"), F.round(N.amdahl(F.lit(0.84), F.col("id")), 9).alias("speedup"))


@query("requests", """
WITH c AS (SELECT sid % 20 AS ds, count(*) FILTER (k % 2 = 0) AS uncapped, count(*) FILTER (k % 2 = 1) AS capped FROM fx_requests WHERE k IS NOT NULL GROUP BY 1)
SELECT ds, uncapped, capped, uncapped <= 100 * 1.05::DOUBLE OR abs(capped - uncapped) / uncapped <= 0.05::DOUBLE AS pass FROM c
""")
def budget_regression(spark, sf):
    """Points with and without a cap, side by side."""
    r = C.requests(spark, sf).where("k is not null").select((F.col("sid") % 20).alias("ds"), F.when(F.col("k") % 2 == 0, "uncapped").otherwise("capped").alias("cap"))
    wide = r.groupBy("ds").pivot("cap", ["uncapped", "capped"]).count().na.fill(0)
    ok = (F.col("uncapped") <= 100 * 1.05) | (F.abs(F.col("capped") - F.col("uncapped")) / F.col("uncapped") <= 0.05)
    return wide.withColumn("pass", ok)


@query("requests", "WITH a AS (SELECT event_id // 2 AS p, dur_ms AS v FROM fx_requests WHERE event_id % 2 = 0), b AS (SELECT event_id // 2 AS p, dur_ms AS v FROM fx_requests WHERE event_id % 2 = 1) SELECT round(avg(abs(a.v - b.v)), 6) AS difference FROM a JOIN b USING (p)")
def mean_abs_diff(spark, sf):
    """How far even and odd requests differ on average."""
    r = C.requests(spark, sf).withColumn("p", F.floor(F.col("event_id") / 2))
    out = SE.mean_difference(r.where("event_id % 2 = 0"), r.where("event_id % 2 = 1"), "p", "dur_ms")
    return out.select(F.round("difference", 6).alias("difference"))


@query("points", """
WITH l AS (SELECT (pulse_id % 640)::INT AS px, (point_source_id % 480)::INT AS py FROM fx_points WHERE greatest(red % 256, green % 256, blue % 256) > 10)
SELECT round(avg(px) / 640, 9) AS mean_x, min(px) / 640.0::DOUBLE AS min_x, max(px) / 640.0::DOUBLE AS max_x, round(avg(py) / 480, 9) AS mean_y, min(py) / 480.0::DOUBLE AS min_y, max(py) / 480.0::DOUBLE AS max_y, count(*) / 307200.0::DOUBLE AS coverage FROM l
""")
def pixel_summary(spark, sf):
    """Where the bright ones of all points lie on a picture."""
    p = C.points(spark, sf).select((F.col("pulse_id") % 640).cast("int").alias("px"), (F.col("point_source_id") % 480).cast("int").alias("py"), *[(F.col(c) % 256).alias(c) for c in ("red", "green", "blue")])
    out = SE.lit_pixels(p, 640, 480)
    return out.withColumns({c: F.round(c, 9) for c in ("mean_x", "mean_y")})


@query("requests", f"WITH s AS (SELECT CASE k % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'xyz' ELSE 'all' END AS variant, list_sort(list(dur_ms)) AS v FROM fx_requests WHERE k IS NOT NULL GROUP BY 1), m AS (SELECT variant, {at('v', '0.5')} AS med FROM s), w AS (SELECT max(med) FILTER (variant = 'none') AS n, max(med) FILTER (variant = 'xyz') AS x, max(med) FILTER (variant = 'all') AS a FROM m) SELECT round(n / 5e5 * 1e6, 6) AS decompress, round((x - n) / 5e5 * 1e6, 6) AS positions, round((a - n) / 5e5 * 1e6, 6) AS all_dimensions, round(n / x, 9) AS share FROM w")
def decode_costs(spark, sf):
    """The cost of decompression, of positions and of all dimensions."""
    r = C.requests(spark, sf).where("k is not null").withColumn("variant", F.get(F.array(*map(F.lit, ("none", "xyz", "all"))), F.col("k") % 3))
    out = SE.variant_costs(O.upper_median(r, "dur_ms", ["variant"]), 5e5)
    return out.select(*[F.round(c, 6).alias(c) for c in ("decompress", "positions", "all_dimensions")], F.round("share", 9).alias("share"))


@query("requests", "WITH a AS (SELECT DISTINCT sid, k FROM fx_requests WHERE outcome = 'click' AND k IS NOT NULL AND k % 10 = 3), f AS (SELECT sid, k, sum(dur_ms) AS b FROM fx_requests WHERE outcome = 'view' AND k IS NOT NULL GROUP BY 1, 2) SELECT count(*) AS requests, round(coalesce(sum(b), 0), 3) AS bytes FROM a LEFT JOIN f USING (sid, k)")
def bytes_by_url(spark, sf):
    """Requests to URLs of a pattern and what they brought."""
    r = C.requests(spark, sf).where("k is not null").withColumns({"url": F.concat(F.lit("http://h/"), F.col("k").cast("string")), "bytes": F.col("dur_ms")})
    out = SE.bytes_by_pattern(r.where("outcome = 'click'"), r.where("outcome = 'view'"), ["sid", "k"], "/[0-9]*3$")
    return out.withColumn("bytes", F.round("bytes", 3))


@query("requests", "SELECT event_id, k::DOUBLE AS shown, round(k / 50.0::DOUBLE, 9) AS ratio, k / 50.0::DOUBLE >= 0.9 AND sid % 2 = 0 AS fresh FROM fx_requests WHERE k IS NOT NULL")
def staleness(spark, sf):
    """Whether what a log line says is shown is nearly all that is there."""
    r = C.requests(spark, sf).where("k is not null").select("event_id", F.concat(F.lit("tiles shown="), F.col("k").cast("string"), F.lit(" ok")).alias("line"), F.lit(50.0).alias("actual"), (F.col("sid") % 2).alias("failed"))
    return SE.staleness(r, 0.9).select("event_id", "shown", F.round("ratio", 9).alias("ratio"), "fresh")


@query("requests", "SELECT sid % 7 AS g, floor(CASE WHEN max(t_ms) > min(t_ms) THEN (count(*) - 1) * 1000 * 1e6 / (max(t_ms) - min(t_ms)) END + 0.5)::BIGINT AS fps FROM fx_requests GROUP BY 1")
def frame_rate(spark, sf):
    """Frames per second, with time a million times as fast."""
    r = C.requests(spark, sf).select((F.col("sid") % 7).alias("g"), (F.col("t_ms") / 1e6).alias("t"))
    return SE.frame_rate(r, "t", ["g"])


@query("requests", "SELECT concat('s', k % 4) AS suite, count(*) AS total, count(*) FILTER (outcome = 'error') AS failures, count(*) FILTER (outcome <> 'error') AS passes FROM fx_requests WHERE k IS NOT NULL GROUP BY 1")
def suite_summary(spark, sf):
    r = C.requests(spark, sf).where("k is not null")
    return SE.suite_summary(r.select(F.concat(F.lit("s"), (F.col("k") % 4).cast("string")).alias("suite"), (F.col("outcome") == "error").alias("failed")))


@query("requests", f"""
WITH e AS (SELECT event_id % 10 AS run, count(*) * 100 AS points, sum(dur_ms) FILTER (outcome = 'view') AS io, sum(dur_ms) FILTER (outcome = 'click') AS decode, sum(dur_ms) FILTER (outcome = 'error') AS reproject, sum(dur_ms) FILTER (outcome = 'purchase') AS build FROM fx_requests GROUP BY 1),
l AS (UNPIVOT (SELECT io, decode, reproject, build FROM e) ON io, decode, reproject, build INTO NAME axis VALUE ms),
m AS (SELECT axis, {at('list_sort(list(coalesce(ms, 0)))', '0.5')} AS med FROM l GROUP BY axis), p AS (SELECT {at('list_sort(list(points))', '0.5')} AS pts FROM e)
SELECT axis, round(med * 100 / (SELECT sum(med) FROM m), 3) AS pct, round(med / pts * 1e6, 1) AS per_million FROM m, p ORDER BY med DESC, list_position(['io', 'decode', 'reproject', 'build'], axis) LIMIT 1
""")
def top_axis(spark, sf):
    """The part of the work that takes longest."""
    out = CV.top_axis(CV.axis_report(samples(spark, sf), "run", AXES, "points"), AXES)
    return out.select("axis", F.round("pct", 3).alias("pct"), F.round("per_million", 1).alias("per_million"))


@query("requests", "WITH s AS (SELECT sid, floor(t_ms / 259200000.0::DOUBLE)::BIGINT AS part, bool_or(outcome = 'click') AS loaded, bool_or(outcome = 'view') AS fired, count(*) FILTER (outcome = 'error') AS processing FROM fx_requests GROUP BY 1, 2) SELECT sid, part FROM s WHERE loaded AND fired AND processing = 0")
def settled_state(spark, sf):
    """Parts of sessions, of three days each, that end at rest."""
    o = F.col("outcome")
    s = C.requests(spark, sf).groupBy("sid", F.floor(F.col("t_ms") / 259_200_000.0).alias("part")).agg(F.bool_or(o == "click").alias("loaded"), F.bool_or(o == "view").alias("fired"), F.count_if(o == "error").alias("processing"))
    return SE.settled_states(s, F.col("loaded"), F.col("fired"), F.col("processing")).select("sid", "part")


@query("requests", f"""
WITH r AS (SELECT CASE outcome WHEN 'view' THEN 'header' WHEN 'click' THEN 'hier' ELSE 'point' END AS kind, dur_ms * k / 100 AS ttfb, dur_ms - dur_ms * k / 100 AS body, k * 1000 AS bytes FROM fx_requests WHERE k IS NOT NULL),
g AS (SELECT kind, list_sort(list(ttfb)) AS f, list_sort(list(body)) AS b, sum(bytes)::BIGINT AS bytes, sum(ttfb) / (sum(ttfb) + sum(body)) AS waiting FROM r GROUP BY 1)
SELECT kind, len(f) AS n, {at('f', '0.5')} AS ttfb_median, {at('b', '0.5')} AS body_median, bytes, round(waiting, 9) AS waiting FROM g
""")
def first_byte_split(spark, sf):
    """Waiting for the first byte and for the body, by kind of range."""
    k, dur, o = F.col("k"), F.col("dur_ms"), F.col("outcome")
    first = dur * k / 100
    r = C.requests(spark, sf).where("k is not null").select(F.when(o == "view", "header").when(o == "click", "hier").otherwise("point").alias("kind"), first.alias("ttfb"), (dur - first).alias("body"), (k * 1000).alias("bytes"))
    return SE.first_byte_report(r).withColumn("waiting", F.round("waiting", 9))


@query("requests", """
WITH n AS (SELECT sid % 20 AS run, floor(t_ms / 86400000.0::DOUBLE)::BIGINT AS tick, count(*) FILTER (outcome = 'click') AS ready, count(*) FILTER (outcome = 'error') AS u FROM fx_requests GROUP BY 1, 2)
SELECT run, tick, ready, (sum(u) OVER (PARTITION BY run ORDER BY tick))::BIGINT AS unloads, sum(u) OVER (PARTITION BY run) > 0 AS evicts FROM n
""")
def soak_series(spark, sf):
    """Daily samples of long runs."""
    o = F.col("outcome")
    return SE.soak(C.requests(spark, sf).withColumn("run", F.col("sid") % 20), ["run"], "t_ms", 86_400_000.0, o == "click", o == "error")


@query("requests", "SELECT sid, strftime(make_timestamp(floor(max(t_ms))::BIGINT * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS last_seen FROM fx_requests GROUP BY 1")
def report_time(spark, sf):
    """When each session was seen last, as text."""
    return C.requests(spark, sf).groupBy("sid").agg(N.iso_time(F.max("t_ms")).alias("last_seen"))


@query("requests", f"""
WITH s AS (SELECT sid, k, min(t_ms) AS t0 FROM fx_requests WHERE outcome = 'click' AND k IS NOT NULL GROUP BY 1, 2), e AS (SELECT sid, k, max(t_ms) AS t1, sum(dur_ms) AS bytes FROM fx_requests WHERE outcome = 'view' AND k IS NOT NULL GROUP BY 1, 2),
l AS (SELECT t0, t1, bytes FROM s JOIN e USING (sid, k) WHERE t1 >= t0), v AS (SELECT list_sort(list(t1 - t0)) AS v, sum(bytes) AS bytes FROM l),
o AS (SELECT sum(s) OVER (ORDER BY t, s ROWS UNBOUNDED PRECEDING) AS c FROM (SELECT t0 AS t, 1 AS s FROM l UNION ALL SELECT t1, -1 FROM l)), m AS (SELECT max(c)::BIGINT AS most FROM o)
SELECT len(v) AS n, {at('v', '0.5')} AS p50, {at('v', '0.95')} AS p95, round(bytes, 3) AS bytes, most FROM v, m
""")
def lifecycle_summary(spark, sf):
    """Percentiles, bytes and overlap of all requests that ended."""
    r = C.requests(spark, sf).where("k is not null").withColumnsRenamed({"t_ms": "t", "dur_ms": "bytes"})
    out = SE.lifecycles(r.where("outcome = 'click'").select("sid", "k", "t"), r.where("outcome = 'view'").select("sid", "k", "t", "bytes"), ["sid", "k"])
    times, most = O.order_statistics(out, "ms", {"p50": 0.5, "p95": 0.95}), I.concurrency(out, "t_start", "t_end", 3_600_000.0)
    return times.crossJoin(F.broadcast(out.agg(F.round(F.sum("bytes"), 3).alias("bytes")))).crossJoin(F.broadcast(most)).select("n", "p50", "p95", "bytes", "most")
