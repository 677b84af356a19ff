"""Queries on points: classes, budgets, bounds, attributes."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointquarry.operators import profile as P
from pointquarry.plans.registry import query
from pointquarry.sources import clouds as C

PROFILE_SQL = """
WITH levels AS (SELECT *, coalesce(sum(point_count) OVER (ORDER BY d, node_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM fx_nodes
), s AS (SELECT classification, count(*) AS n, min(z) AS z_min, max(z) AS z_max, avg(z) AS z_mean FROM fx_keyed WHERE node_key IN (SELECT node_key FROM levels WHERE before < 400000) GROUP BY classification
), base AS (SELECT max(z_mean) FILTER (classification = 2) AS g, max(z_max) - min(z_min) AS span FROM s)
SELECT classification, CASE classification WHEN 0 THEN 'created/never' WHEN 1 THEN 'unclassified' WHEN 2 THEN 'ground' WHEN 3 THEN 'low veg' WHEN 4 THEN 'med veg' WHEN 5 THEN 'high veg' WHEN 6 THEN 'building'
  WHEN 7 THEN 'LOW NOISE' WHEN 8 THEN 'model key' WHEN 9 THEN 'water' WHEN 17 THEN 'bridge deck' WHEN 18 THEN 'HIGH NOISE' ELSE '?' END AS name,
  n, round(n * 100.0::DOUBLE / sum(n) OVER (), 2) AS pct, z_min, z_max, round(z_mean, 3) AS z_mean, coalesce(classification <> 2 AND z_mean > g + 0.3::DOUBLE * span, false) AS floats
FROM s, base ORDER BY classification
"""


@query("nodes", PROFILE_SQL)
def class_profile(spark, sf):
    """Heights of each class in the shallow nodes, with classes that float above ground."""
    shallow = P.shallow_nodes(C.nodes(spark, sf), 400_000).select("node_key")
    stats = P.floating_classes(P.class_profile(C.keyed_points(spark, sf).join(shallow, "node_key", "left_semi")))
    return stats.select("classification", "name", "n", F.round("pct", 2).alias("pct"), "z_min", "z_max", F.round("z_mean", 3).alias("z_mean"), "floats").orderBy("classification")


@query("points", """
WITH s AS (SELECT classification, avg(z) AS m FROM fx_points GROUP BY 1), r AS (SELECT max(z) - min(z) AS span FROM fx_points)
SELECT classification, round(m, 3) AS z_mean FROM s, r WHERE classification <> 2 AND m > (SELECT m FROM s WHERE classification = 2) + 0.001::DOUBLE * span
""")
def floating_classes(spark, sf):
    """Classes above ground by a small part of the span."""
    out = P.floating_classes(P.class_profile(C.points(spark, sf)), part=0.001)
    return out.where("floats").select("classification", F.round("z_mean", 3).alias("z_mean"))


@query("points", "SELECT classification, count(*) AS n FROM fx_points WHERE classification NOT IN (7, 18) GROUP BY 1")
def hide_noise(spark, sf):
    return C.visible(C.points(spark, sf)).groupBy("classification").agg(F.count("*").alias("n"))


@query("points", "SELECT return_number AS ReturnNumber, count(*) AS n, sum(intensity)::BIGINT AS intensity_sum, max(number_of_returns) AS most_returns FROM fx_points GROUP BY 1")
def attribute_projection(spark, sf):
    """Only the resolved dimensions are read."""
    cloud = C.with_dimension_names(C.points(spark, sf))
    found, _ = C.resolve_attributes(cloud.columns, ["Intensity", "Nowhere", "ReturnNumber", "NumberOfReturns"])
    got = cloud.select(*[a.name for a in found])
    return got.groupBy("ReturnNumber").agg(F.count("*").alias("n"), F.sum("Intensity").alias("intensity_sum"), F.max("NumberOfReturns").alias("most_returns"))


@query("", """
SELECT * FROM (VALUES (0, 'Classification', 'UNSIGNED_BYTE', true), (1, 'Intensity', 'UNSIGNED_SHORT', true), (2, 'ReturnNumber', 'UNSIGNED_BYTE', true),
  (3, 'NumberOfReturns', 'UNSIGNED_BYTE', true), (4, 'PointSourceId', 'UNSIGNED_SHORT', true), (5, 'Nowhere', 'FLOAT', false)) t(ordinal, name, component_type, present)
""")
def attribute_types(spark, sf):
    """Component types of all dimensions and of a missing one."""
    names = C.with_dimension_names(C.points(spark, sf)).columns
    found, _ = C.resolve_attributes(names, "all")
    rows = [(i, a.name, a.component_type, True) for i, a in enumerate(found)]
    return spark.createDataFrame([*rows, (len(rows), "Nowhere", "FLOAT", "Nowhere" in names)], "ordinal int, name string, component_type string, present boolean")


@query("keyed", "SELECT 'z' AS name, min(z) AS lo, max(z) AS hi FROM fx_keyed WHERE d = 0 UNION ALL SELECT 'intensity', min(intensity)::DOUBLE, max(intensity)::DOUBLE FROM fx_keyed WHERE d = 0")
def attribute_range(spark, sf):
    """Ranges in the root node."""
    return P.attribute_range(C.keyed_points(spark, sf).where("node_key = '0-0-0-0'"), ["z", "intensity"])


BUDGET = """
WITH o AS (SELECT *, coalesce(sum(point_count) OVER (ORDER BY d, node_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM fx_nodes)
"""


@query("nodes", BUDGET + "SELECT node_key, point_count, before, least(point_count, 20000 - before)::BIGINT AS take FROM o WHERE before < 20000")
def point_budget_cut(spark, sf):
    return P.point_budget(C.nodes(spark, sf), 20_000).select("node_key", "point_count", "before", "take")


@query("nodes", BUDGET + "SELECT b AS budget, sum(least(point_count, b - before))::BIGINT AS points, count(*) AS nodes, sum(least(point_count, b - before))::BIGINT * 32 AS bytes FROM o, (VALUES (1000), (5000), (20000)) v(b) WHERE before < b GROUP BY b")
def budget_sweep(spark, sf):
    """What loads of several budgets take, 32 bytes a point."""
    before = P.in_depth_order(C.nodes(spark, sf)).withColumn("budget", F.explode(F.array(*[F.lit(b) for b in (1000, 5000, 20_000)])))
    take = before.where("before < budget").withColumn("take", F.least("point_count", F.col("budget") - F.col("before")))
    return take.groupBy("budget").agg(F.sum("take").alias("points"), F.count("*").alias("nodes"), (F.sum("take") * 32).alias("bytes"))


@query("nodes", "SELECT d, count(*) AS nodes, sum(point_count)::BIGINT AS points, max(point_count) AS largest FROM fx_nodes GROUP BY d")
def node_depth_histogram(spark, sf):
    return C.nodes(spark, sf).groupBy("d").agg(F.count("*").alias("nodes"), F.sum("point_count").alias("points"), F.max("point_count").alias("largest"))


@query("nodes", "SELECT count(*) AS nodes, coalesce(max(d), -1) AS deepest, sum(point_count)::BIGINT AS points FROM fx_nodes")
def hierarchy_summary(spark, sf):
    return C.nodes(spark, sf).agg(F.count("*").alias("nodes"), F.coalesce(F.max("d"), F.lit(-1)).alias("deepest"), F.sum("point_count").alias("points"))


@query("points", "SELECT min(x) AS min_x, max(x) AS max_x, (min(x) + max(x)) / 2 AS mid_x, min(y) AS min_y, max(y) AS max_y, (min(y) + max(y)) / 2 AS mid_y, min(z) AS min_z, max(z) AS max_z, (min(z) + max(z)) / 2 AS mid_z FROM fx_points")
def bbox_summary(spark, sf):
    return P.bounds(C.points(spark, sf), ["x", "y", "z"])


@query("points", "SELECT classification, count(*) AS n FROM fx_points WHERE x > 20000 AND x < 60000 AND y > 10000 AND y < 50000 GROUP BY 1")
def bbox_filter(spark, sf):
    return C.points(spark, sf).where("x > 20000 and x < 60000 and y > 10000 and y < 50000").groupBy("classification").agg(F.count("*").alias("n"))


@query("keyed", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY node_key ORDER BY x, y, z, classification, pulse_id, point_source_id, ship_ts, red, green) - 1 AS p FROM fx_keyed)
SELECT d, count(*) AS n, sum(floor(x * 1000 + 0.5)::BIGINT)::BIGINT AS sum_x FROM r WHERE p % 5 = 0 GROUP BY d
""")
def decimate_5(spark, sf):
    """Every fifth point of each node."""
    return P.checksum(P.every_nth(C.keyed_points(spark, sf), C.ORDER, 5, "node_key"), ["x"], ["d"])


@query("points", "SELECT classification, count(*) AS n, sum(floor(x * 1000 + 0.5)::BIGINT)::BIGINT AS sum_x, sum(floor(y * 1000 + 0.5)::BIGINT)::BIGINT AS sum_y, sum(floor(z * 1000 + 0.5)::BIGINT)::BIGINT AS sum_z FROM fx_points GROUP BY 1")
def class_checksum(spark, sf):
    return P.checksum(C.points(spark, sf), ["x", "y", "z"], ["classification"])


@query("nodes", "SELECT d, node_key, point_count FROM fx_nodes WHERE d <= 3 AND point_count > 0 ORDER BY d, node_key LIMIT 60")
def node_ordering(spark, sf):
    """The first sixty nodes by depth and key, as a profile samples them."""
    return C.nodes(spark, sf).where("d <= 3 and point_count > 0").orderBy("d", "node_key").limit(60).select("d", "node_key", "point_count")


@query("points", "SELECT classification, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM fx_points), 2) AS pct FROM fx_points GROUP BY 1 ORDER BY n DESC, classification LIMIT 15")
def class_top15(spark, sf):
    """The largest classes and their share."""
    return P.class_profile(C.points(spark, sf)).orderBy(F.desc("n"), "classification").limit(15).select("classification", "n", F.round("pct", 2).alias("pct"))


@query("", """
SELECT i, u, v, red, green, blue FROM (SELECT range AS i, (range % 1597) / 1597.0::DOUBLE AS u, (range * 31 % 2503) / 2503.0::DOUBLE AS v, (range % 256)::INT AS red, (range * 7 % 256)::INT AS green, (range * 13 % 256)::INT AS blue FROM range(5000))
""")
def synthetic_lattice(spark, sf):
    return C.lattice(spark, 5000).select("i", "u", "v", "red", "green", "blue")


@query("nodes", "WITH b AS (SELECT node_key, point_count - 5 AS budget FROM fx_nodes) SELECT node_key, budget, CASE WHEN budget > 0 THEN budget * 8 END AS cache, CASE WHEN budget > 0 THEN budget * 8 END AS overflow FROM b")
def budget_limits(spark, sf):
    """What the points of each node beyond five may take in memory."""
    b = C.nodes(spark, sf).select("node_key", (F.col("point_count") - 5).alias("budget"))
    cache, overflow = P.memory_limits(F.col("budget"))
    return b.withColumns({"cache": cache, "overflow": overflow})
