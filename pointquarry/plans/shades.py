"""Queries on colours: ramps, palettes, style rules, hues."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointquarry.functions import colors as CO
from pointquarry.operators import orderstats as O
from pointquarry.operators import shading as S
from pointquarry.plans.registry import query
from pointquarry.sources import clouds as C


def channel_sql(h: str) -> str:
    """A channel of full saturation and half lightness, 0 to 255."""
    w = f"(CASE WHEN {h} < 0 THEN {h} + 1 WHEN {h} > 1 THEN {h} - 1 ELSE {h} END)"
    return f"floor((CASE WHEN {w} * 6 < 1 THEN {w} * 6 WHEN {w} * 2 < 1 THEN 1 WHEN {w} * 3 < 2 THEN (2.0::DOUBLE / 3 - {w}) * 6 ELSE 0 END) * 255 + 0.5)::INT"


def ramp_sql(value: str, lo: str, hi: str) -> str:
    h = f"((1 - least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({value} - {lo}) / (CASE WHEN {hi} = {lo} THEN 1 ELSE {hi} - {lo} END)))) * 0.66::DOUBLE)"
    return ", ".join(f"{channel_sql(f'({h} + {s})')} AS {c}" for c, s in zip(CO.CHANNELS, ("1.0::DOUBLE / 3", "0", "-1.0::DOUBLE / 3"), strict=True))


def color_sums(points, *by):
    return points.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(f"color.{c}").alias(f"sum_{c}") for c in CO.CHANNELS])


SUMS = "count(*) AS n, sum(red)::BIGINT AS sum_red, sum(green)::BIGINT AS sum_green, sum(blue)::BIGINT AS sum_blue"
ROBUST = "WITH s AS (SELECT list_sort(list(z)) AS v FROM fx_keyed WHERE d = 0 AND classification NOT IN (7, 18)), r AS (SELECT v[floor(len(v) * 0.01)::BIGINT + 1] AS lo, v[floor(len(v) * 0.99)::BIGINT + 1] AS hi FROM s)"


@query("keyed", ROBUST + f", c AS (SELECT d, {ramp_sql('z', 'lo', 'hi')} FROM fx_keyed, r) SELECT d, {SUMS} FROM c GROUP BY d")
def height_ramp(spark, sf):
    """Colours by height, over the range of the root node without outliers."""
    p = C.keyed_points(spark, sf)
    r = S.height_range(C.visible(p.where("d = 0")), (0.0, 100000.0))
    return color_sums(S.height_colored(p, r), "d")


@query("keyed", ROBUST + " SELECT lo, hi FROM r")
def percentile_range(spark, sf):
    return O.robust_range(C.visible(C.keyed_points(spark, sf).where("d = 0")), "z")


@query("points", f"WITH r AS (SELECT min(z) AS lo, max(z) AS hi FROM fx_points), c AS (SELECT classification, {ramp_sql('z', 'lo', 'hi')} FROM fx_points, r) SELECT classification, {SUMS} FROM c GROUP BY 1")
def naive_ramp(spark, sf):
    """Colours by height over the whole range, outliers included."""
    return color_sums(S.colored(C.points(spark, sf), "height"), "classification")


@query("keyed", f"WITH r AS (SELECT *, min(intensity) OVER (PARTITION BY node_key) AS lo, max(intensity) OVER (PARTITION BY node_key) AS hi FROM fx_keyed), c AS (SELECT node_key, {ramp_sql('intensity', 'lo', 'hi')} FROM r) SELECT node_key, {SUMS} FROM c GROUP BY 1")
def intensity_ramp(spark, sf):
    """Colours by intensity, over the range of each node."""
    return color_sums(S.colored(C.keyed_points(spark, sf), "intensity"), "node_key")


@query("points", "WITH c(k, red, green, blue) AS (VALUES (1, 180, 180, 180), (2, 166, 116, 64), (5, 38, 115, 38), (6, 220, 90, 70), (7, 255, 0, 110), (9, 60, 130, 220), (18, 150, 150, 150)) SELECT classification, count(*) AS n, max(c.red) AS red, max(c.green) AS green, max(c.blue) AS blue FROM fx_points JOIN c ON k = classification GROUP BY 1")
def classification_palette(spark, sf):
    p = S.colored(C.points(spark, sf), "classification")
    return p.groupBy("classification").agg(F.count("*").alias("n"), *[F.max(f"color.{c}").alias(c) for c in CO.CHANNELS])


@query("points", "WITH c(k, red, green, blue) AS (VALUES (1, 230, 25, 75), (2, 245, 130, 48), (3, 255, 225, 25), (4, 60, 180, 75), (5, 0, 130, 200), (6, 145, 30, 180), (7, 240, 50, 230)) SELECT return_number, count(*) AS n, max(c.red) AS red, max(c.green) AS green, max(c.blue) AS blue FROM fx_points JOIN c ON k = least(7, greatest(1, return_number)) GROUP BY 1")
def return_palette(spark, sf):
    p = S.colored(C.points(spark, sf), "return")
    return p.groupBy("return_number").agg(F.count("*").alias("n"), *[F.max(f"color.{c}").alias(c) for c in CO.CHANNELS])


@query("keyed", "WITH m AS (SELECT node_key, red AS r, green AS g, blue AS b, max(greatest(red, green, blue)) OVER (PARTITION BY node_key) > 255 AS big FROM fx_keyed), c AS (SELECT node_key, (CASE WHEN big THEN r >> 8 ELSE r END) % 256 AS red, (CASE WHEN big THEN g >> 8 ELSE g END) % 256 AS green, (CASE WHEN big THEN b >> 8 ELSE b END) % 256 AS blue FROM m) SELECT node_key, " + SUMS + " FROM c GROUP BY 1")
def rgb_shift(spark, sf):
    """The points' own colours, in 8 bits where their node needs it."""
    return color_sums(S.colored(C.keyed_points(spark, sf), "rgb"), "node_key")


@query("points", "SELECT CASE WHEN z <= 20000 THEN 'rgb(43,131,186)' WHEN z <= 40000 THEN 'rgb(171,221,164)' WHEN z <= 60000 THEN 'rgb(255,255,191)' WHEN z <= 80000 THEN 'rgb(253,174,97)' ELSE 'rgb(215,25,28)' END AS color, count(*) AS n FROM fx_points GROUP BY 1")
def ramp_style(spark, sf):
    p = C.points(spark, sf).withColumn("color", CO.ramp_style(F.col("z"), 0.0, 100000.0))
    return p.groupBy("color").agg(F.count("*").alias("n"))


@query("keyed", """
WITH m AS (SELECT red, green, blue, max(greatest(red, green, blue)) OVER (PARTITION BY node_key) > 255 AS big FROM fx_keyed),
c AS (SELECT CASE WHEN big THEN red >> 8 ELSE red END AS r, CASE WHEN big THEN green >> 8 ELSE green END AS g, CASE WHEN big THEN blue >> 8 ELSE blue END AS b FROM m),
h AS (SELECT greatest(r, g, b) AS mx, (greatest(r, g, b) - least(r, g, b))::DOUBLE AS df, r, g, b FROM c WHERE greatest(r, g, b) > 10 AND greatest(r, g, b) - least(r, g, b) >= 12),
k AS (SELECT least(35, floor((((CASE WHEN mx = r THEN (g - b) / df WHEN mx = g THEN (b - r) / df + 2 ELSE (r - g) / df + 4 END) * 60) % 360 + 360) % 360 / 10))::INT AS bin FROM h),
hist AS (SELECT i::INT AS bin, count(k.bin) AS n FROM range(36) t(i) LEFT JOIN k ON k.bin = t.i GROUP BY i),
tot AS (SELECT sum(n) AS coloured, max(n) AS top FROM hist),
arcs AS (SELECT s.bin AS st, l.i + 1 AS len, sum(h.n) OVER (PARTITION BY s.bin ORDER BY l.i) AS acc FROM hist s, range(36) l(i), hist h WHERE h.bin = (s.bin + l.i) % 36)
SELECT coloured::BIGINT AS coloured, (min(len) * 10)::DOUBLE AS span_deg, (SELECT min(bin) * 10 FROM hist, tot WHERE n = top)::INT AS dominant_deg FROM arcs, tot WHERE acc >= coloured * 0.9::DOUBLE GROUP BY coloured
""")
def hue_arc(spark, sf):
    """How far the hues of all points spread."""
    p = S.true_colored(C.keyed_points(spark, sf)).select("color.*")
    return S.hue_arc(p)
