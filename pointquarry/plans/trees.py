"""Queries on the octree and on positions: children, location, nearest points, tiles, geodesy."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointquarry.functions import geodesy as G
from pointquarry.functions import numbers as N
from pointquarry.functions.octree import geometric_error, key_of, screen_error
from pointquarry.operators import nearest as NN
from pointquarry.operators import reproject as R
from pointquarry.operators import tree as T
from pointquarry.plans.registry import query
from pointquarry.scratch import small, written
from pointquarry.sinks import tiles as K
from pointquarry.sinks import trees as KT
from pointquarry.sources import clouds as C

#: A source rectangle in metres of UTM zone 10, into which the cube is mapped.
WEST, SOUTH = 490_000.0, 4_870_000.0
SPAN = 4656.0
KEYS = ["x", "y", "z", "classification", "pulse_id", "point_source_id", "ship_ts", "red", "green"]


#: The stated query set of the searches for nearest points: pulses whose id is divisible by it.
ASKED = 100


def seeds(spark, sf, every=1):
    """A position near the first point of each pulse, or of those whose id is divisible by ``every``."""
    p = C.points(spark, sf).where(F.col("pulse_id") % every == 0)
    s = p.groupBy("pulse_id").agg(F.min(F.struct(*[c for c in KEYS if c != "pulse_id"])).alias("b"))
    return s.select(F.col("pulse_id").alias("seed_id"), (F.col("b.x") + 0.3).alias("x"), F.col("b.y").alias("y"), (F.col("b.z") + 0.3).alias("z"))


SEEDS = """fx_first AS (SELECT *, row_number() OVER (PARTITION BY pulse_id ORDER BY x, y, z, classification, point_source_id, ship_ts, red, green) AS rn FROM fx_points WHERE pulse_id % {every} = 0),
seeds AS (SELECT pulse_id AS seed_id, x + 0.3::DOUBLE AS x, y, z + 0.3::DOUBLE AS z FROM fx_first WHERE rn = 1)"""
LOCATED = SEEDS + """, steps AS (SELECT seed_id, x, y, z, unnest(range(0, 5)) AS d FROM seeds WHERE x BETWEEN 0 AND 131072 AND y BETWEEN 0 AND 131072 AND z BETWEEN 0 AND 131072),
keys AS (SELECT seed_id, d, concat_ws('-', d, least(power(2, d) - 1, floor(x / (131072 / power(2, d))))::INT, least(power(2, d) - 1, floor(y / (131072 / power(2, d))))::INT, least(power(2, d) - 1, floor(z / (131072 / power(2, d))))::INT) AS node_key FROM steps),
met AS (SELECT k.*, n.node_key IS NULL AS gap FROM keys k LEFT JOIN fx_nodes n USING (node_key)),
stop AS (SELECT seed_id, coalesce(min(d) FILTER (gap), 5) AS first_gap FROM met GROUP BY 1),
located AS (SELECT m.seed_id, m.node_key, m.d::INT AS d FROM met m JOIN stop s USING (seed_id) WHERE m.d = s.first_gap - 1)"""
NEAREST = LOCATED.replace("{every}", str(ASKED)) + """, pairs AS (SELECT l.seed_id, l.node_key, k.* EXCLUDE (node_key), s.x AS sx, s.y AS sy, s.z AS sz,
  row_number() OVER (PARTITION BY l.seed_id ORDER BY (k.x - s.x) * (k.x - s.x) + (k.y - s.y) * (k.y - s.y) + (k.z - s.z) * (k.z - s.z), k.x, k.y, k.z, k.classification, k.pulse_id, k.point_source_id, k.ship_ts, k.red, k.green) AS rn
  FROM located l JOIN seeds s USING (seed_id) JOIN fx_keyed k ON k.node_key = l.node_key WHERE k.classification NOT IN (7, 18)),
nearest AS (SELECT seed_id, node_key, x, y, z, classification, intensity, sx, sy, sz, sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy) + (z - sz) * (z - sz)) AS distance FROM pairs WHERE rn = 1)"""


@query("nodes", """
SELECT p.node_key, c.node_key AS child_key, ((c.kx & 1) | ((c.ky & 1) << 1) | ((c.kz & 1) << 2))::INT AS octant FROM fx_nodes c
JOIN fx_nodes p ON p.d = c.d - 1 AND p.kx = c.kx >> 1 AND p.ky = c.ky >> 1 AND p.kz = c.kz >> 1
""")
def children_discovery(spark, sf):
    n = C.nodes(spark, sf)
    return T.children(n, n).select("node_key", "child_key", "octant")


@query("nodes", "WITH " + LOCATED.replace("{every}", "1") + " SELECT * FROM located")
def locate_deepest(spark, sf):
    return T.locate(seeds(spark, sf), C.nodes(spark, sf), C.SIDE, C.MAX_DEPTH)


def nearest(asked, spark, sf):
    at = T.locate(asked, C.nodes(spark, sf), C.SIDE, C.MAX_DEPTH).select("seed_id", "node_key")
    shown = C.visible(C.keyed_points(spark, sf))
    return NN.nearest_in_node(asked.join(at, "seed_id"), shown, ["x", "y", "z", "classification", "intensity"], KEYS)


@query("nodes", "WITH " + NEAREST + " SELECT seed_id, node_key, x, y, z, classification, intensity, round(distance, 6) AS distance FROM nearest")
def nearest_in_node(spark, sf):
    """The nearest visible point in the deepest node around each seed."""
    return nearest(seeds(spark, sf, ASKED), spark, sf).withColumn("distance", F.round("distance", 6))


def ecef_sql(lon: str, lat: str, h: str) -> tuple[str, str, str]:
    """The SQL of geocentric coordinates."""
    n = f"(6378137.0::DOUBLE / sqrt(1 - {G.E2!r}::DOUBLE * sin(radians({lat})) * sin(radians({lat}))))"
    return (
        f"(({n} + {h}) * cos(radians({lat})) * cos(radians({lon})))",
        f"(({n} + {h}) * cos(radians({lat})) * sin(radians({lon})))",
        f"(({n} * {1 - G.E2!r}::DOUBLE + {h}) * sin(radians({lat})))",
    )


def place_sql(x: str, y: str, z: str) -> tuple[str, str, str]:
    return f"({y} / 1e6 - 123.0::DOUBLE)", f"({x} / 1e6 + 44.0::DOUBLE)", f"({z} / 1000.0::DOUBLE)"


def position(x, y, z):
    return F.col(y) / 1e6 - 123.0, F.col(x) / 1e6 + 44.0, F.col(z) / 1000.0


A, B = ecef_sql(*place_sql("x", "y", "z")), ecef_sql(*place_sql("sx", "sy", "sz"))


@query("nodes", "WITH " + NEAREST + f" SELECT seed_id, round(sqrt({' + '.join(f'power({a} - {b}, 2)' for a, b in zip(A, B, strict=True))}), 3) AS meters FROM nearest")
def snap_point(spark, sf):
    """The straight distance on the globe between each seed and the point it snaps to."""
    asked = written(seeds(spark, sf, ASKED), "asked")
    hits = nearest(asked, spark, sf).join(asked.withColumnsRenamed({"x": "sx", "y": "sy", "z": "sz"}), "seed_id")
    return hits.select("seed_id", F.round(NN.snap_distance(position("sx", "sy", "sz"), position("x", "y", "z")), 3).alias("meters"))


@query("keyed", """
WITH f AS (SELECT *, row_number() OVER (PARTITION BY node_key ORDER BY x, y, z, classification, pulse_id, point_source_id, ship_ts, red, green) - 1 AS feature_id FROM fx_keyed)
SELECT node_key, feature_id, classification::DOUBLE AS classification, intensity::DOUBLE AS intensity FROM f WHERE feature_id IN (0, 3)
""")
def pick_attributes(spark, sf):
    """The attributes of two features of each tile."""
    features = NN.feature_ids(C.keyed_points(spark, sf), KEYS)
    asked = C.nodes(spark, sf).select("node_key", F.explode(F.array(F.lit(0), F.lit(3))).alias("feature_id"))
    got = NN.picked(features, asked, ["classification", "intensity"])
    return got.select("node_key", F.col("feature_id").cast("long").alias("feature_id"), *[F.col("attributes")[a].alias(a) for a in ("classification", "intensity")])


@query("points", "SELECT pulse_id, " + ", ".join(f"round(sum({e}), 2) AS {a}" for a, e in zip(("ex", "ey", "ez"), A, strict=True)) + " FROM fx_points WHERE x IS NOT NULL GROUP BY pulse_id")
def ecef(spark, sf):
    """Geocentric coordinates, summed by pulse."""
    p = K.with_geocentric(C.placed(C.points(spark, sf)))
    return p.groupBy("pulse_id").agg(*[F.round(F.sum(a), 2).alias(a) for a in K.AXES])


QUANT = "WITH e AS (SELECT *, " + ", ".join(f"{e} AS {a}" for a, e in zip(("ex", "ey", "ez"), A, strict=True)) + " FROM fx_keyed), b AS (SELECT *, " + ", ".join(f"min({a}) OVER (PARTITION BY node_key) AS min_{a}, max({a}) OVER (PARTITION BY node_key) AS max_{a}" for a in ("ex", "ey", "ez")) + " FROM e), q AS (SELECT *, " + ", ".join(f"least(65535, greatest(0, floor(({a} - min_{a}) / (CASE WHEN max_{a} = min_{a} THEN 1 ELSE max_{a} - min_{a} END) * 65535 + 0.5)))::INT AS q_{a}" for a in ("ex", "ey", "ez")) + " FROM b)"


@query("keyed", "WITH e AS (SELECT node_key, " + ", ".join(f"{e} AS {a}" for a, e in zip(("ex", "ey", "ez"), A, strict=True)) + " FROM fx_keyed) SELECT node_key, count(*) AS n, " + ", ".join(f"round((min({a}) + max({a})) / 2, 3) AS mid_{a}, round(max({a}) - min({a}), 3) AS ext_{a}" for a in ("ex", "ey", "ez")) + " FROM e GROUP BY node_key")
def tile_volumes(spark, sf):
    """The middle and the extent of each tile on the globe."""
    p = K.with_geocentric(C.placed(C.keyed_points(spark, sf)))
    out = p.groupBy("node_key").agg(F.count("*").alias("n"), *[f(a).alias(f"{f.__name__}_{a}") for a in K.AXES for f in (F.min, F.max)])
    return out.select("node_key", "n", *[c for a in K.AXES for c in (F.round((F.col(f"min_{a}") + F.col(f"max_{a}")) / 2, 3).alias(f"mid_{a}"), F.round(F.col(f"max_{a}") - F.col(f"min_{a}"), 3).alias(f"ext_{a}"))])


@query("keyed", QUANT + " SELECT node_key, count(*) AS n, min(q_ex) AS least_x, max(q_ex) AS most_x, min(q_ez) AS least_z, max(q_ez) AS most_z, round(avg(q_ey), 0)::BIGINT AS mean_y FROM q GROUP BY node_key")
def quantized_positions(spark, sf):
    """Positions in 16 bits a coordinate, by tile."""
    q = K.quantised_positions(C.placed(C.keyed_points(spark, sf)))
    return q.groupBy("node_key").agg(F.count("*").alias("n"), F.min("q_ex").alias("least_x"), F.max("q_ex").alias("most_x"), F.min("q_ez").alias("least_z"), F.max("q_ez").alias("most_z"), F.round(F.avg("q_ey"), 0).cast("long").alias("mean_y"))


@query("keyed", QUANT + " SELECT d, count(*) AS n, " + ", ".join(f"round(avg(abs(min_{a} + q_{a} / 65535.0::DOUBLE * (CASE WHEN max_{a} = min_{a} THEN 1 ELSE max_{a} - min_{a} END) - {a})), 5) AS off_{a}" for a in ("ex", "ey", "ez")) + ", true AS within_step FROM q GROUP BY d")
def dequantize_error(spark, sf):
    """How far positions read back are off on average, and whether all are within half a step."""
    r = K.restored(K.quantised_positions(C.placed(C.keyed_points(spark, sf))))
    good = [F.abs(F.col(f"r_{a}") - F.col(a)) <= F.col(f"ext_{a}") / 65535 * 0.5 + 1e-6 for a in K.AXES]
    return r.groupBy("d").agg(F.count("*").alias("n"), *[F.round(F.avg(F.abs(F.col(f"r_{a}") - F.col(a))), 5).alias(f"off_{a}") for a in K.AXES], F.min(good[0] & good[1] & good[2]).alias("within_step"))


@query("nodes", "SELECT node_key, d, (1000.0::DOUBLE / 16) / power(2, d) AS error, round((1000.0::DOUBLE / 16) / power(2, d) * 540 / (500 * tan(0.5::DOUBLE)), 6) AS pixels FROM fx_nodes")
def geometric_errors(spark, sf):
    """Error of each node and how large it looks from 500 m."""
    e = geometric_error(1000.0, F.col("d"))
    return C.nodes(spark, sf).select("node_key", "d", e.alias("error"), F.round(screen_error(e, F.lit(500.0), 1080.0, 1.0), 6).alias("pixels"))


@query("nodes", "SELECT node_key, d FROM fx_nodes WHERE d = 0 OR (1000.0::DOUBLE / 16) / power(2, d) * 2 * 540 / (500 * tan(0.5::DOUBLE)) > 40")
def lod_cut(spark, sf):
    t = T.tiles(C.nodes(spark, sf), 1000.0, "s/")
    return T.lod_cut(t, F.lit(500.0), 1080.0, 1.0, 40.0).select("node_key", "d")


@query("nodes", "SELECT node_key, CASE WHEN d > 0 THEN concat_ws('-', d - 1, kx >> 1, ky >> 1, kz >> 1) END AS parent_key, (1000.0::DOUBLE / 16) / power(2, d) AS error, 'ADD' AS refine, CASE WHEN d = 4 THEN concat('s/page/', node_key, '.json') ELSE concat('s/', node_key, '.pnts') END AS uri FROM fx_nodes")
def tiles_flat(spark, sf):
    """Tiles of nodes, and proxies of the pages at depth 4."""
    n = C.nodes(spark, sf)
    return T.tiles(n.where("d < 4"), 1000.0, "s/", n.where("d = 4")).select("node_key", "parent_key", "error", "refine", "uri")


@query("nodes", "SELECT node_key, d, point_count FROM fx_nodes WHERE d >= 1 AND kx >> (d - 1) = 0 AND ky >> (d - 1) = 0 AND kz >> (d - 1) = 0")
def subtree(spark, sf):
    """All nodes below 1-0-0-0."""
    return T.subtree(C.nodes(spark, sf), 1, 0, 0, 0).select("node_key", "d", "point_count")


EDGE = "(-123.0::DOUBLE + {x} / 1e6)", "(44.0::DOUBLE + {y} / 1e6)"


@query("nodes", """
WITH b AS (SELECT node_key, kx * (131072 / power(2, d)) AS x0, ky * (131072 / power(2, d)) AS y0, kz * (131072 / power(2, d)) AS z0, 131072 / power(2, d) AS s FROM fx_nodes)
SELECT node_key, round(radians(-123.0::DOUBLE + x0 / 1e6), 12) AS west, round(radians(44.0::DOUBLE + y0 / 1e6), 12) AS south, round(radians(-123.0::DOUBLE + (x0 + s) / 1e6), 12) AS east, round(radians(44.0::DOUBLE + (y0 + s) / 1e6), 12) AS north, z0 AS min_h, z0 + s AS max_h FROM b
""")
def node_regions(spark, sf):
    """The region of each node, from samples of its edges."""
    cubes = T.node_cubes(C.nodes(spark, sf), C.SIDE)
    rects = cubes.select("node_key", "min_x", "min_y", (F.col("min_x") + F.col("side")).alias("max_x"), (F.col("min_y") + F.col("side")).alias("max_y"))
    at = T.edge_samples(rects, ["node_key"]).select("node_key", (F.col("x") / 1e6 - 123.0).alias("lon"), (F.col("y") / 1e6 + 44.0).alias("lat"))
    at = T.checked_samples(at, "lon", "lat")
    lons = T.longitude_bounds(at, "lon", ["node_key"])
    lats = at.groupBy("node_key").agg(F.min("lat").alias("south"), F.max("lat").alias("north"))
    heights = cubes.select("node_key", F.col("min_z").alias("min_h"), (F.col("min_z") + F.col("side")).alias("max_h"))
    out = lons.join(lats, "node_key").join(heights, "node_key")
    return out.select("node_key", *[F.round(F.radians(c), 12).alias(c) for c in ("west", "south", "east", "north")], "min_h", "max_h")


@query("", "SELECT * FROM (VALUES ('crosses', 170.0::DOUBLE, -170.0::DOUBLE), ('tie', -180.0::DOUBLE, 0.0::DOUBLE), ('one', 5.0::DOUBLE, 5.0::DOUBLE), ('plain', -20.0::DOUBLE, 30.0::DOUBLE), ('wraps', 179.0::DOUBLE, -178.0::DOUBLE)) t(k, west, east)")
def longitude_gaps(spark, sf):
    """Bounds of longitudes, across the antimeridian too."""
    rows = [("crosses", 170.0), ("crosses", -170.0), ("crosses", 175.0), ("tie", -180.0), ("tie", 0.0), ("one", 5.0), ("one", 365.0), ("plain", -20.0), ("plain", 30.0), ("wraps", 182.0), ("wraps", 179.0)]
    return T.longitude_bounds(spark.createDataFrame(rows, "k string, lon double"), "lon", ["k"])


@query("nodes", """
WITH asked AS (SELECT node_key, d, kx, ky, kz FROM fx_nodes UNION SELECT concat_ws('-', d + 1, kx * 2, ky * 2, kz * 2), d + 1, kx * 2, ky * 2, kz * 2 FROM fx_nodes WHERE d < 4)
SELECT a.node_key, n.point_count, CASE WHEN n.point_count IS NULL THEN 'missing' WHEN n.point_count = 0 THEN 'empty' ELSE 'data' END AS status
FROM asked a LEFT JOIN (SELECT node_key, CASE WHEN point_count < 3 THEN 0 ELSE point_count END AS point_count FROM fx_nodes) n USING (node_key)
""")
def key_lookup_missing_vs_empty(spark, sf):
    """Asked keys that are there, empty (few points count as none here) or missing."""
    n = C.nodes(spark, sf)
    first = n.where("d < 4").select(key_of(F.col("d") + 1, *[F.col(p) * 2 for p in T.PLACES]).alias("node_key"))
    asked = n.select("node_key").union(first).distinct()
    known = n.select("node_key", F.when(F.col("point_count") < 3, 0).otherwise(F.col("point_count")).alias("point_count"))
    return T.lookup(asked, known).select("node_key", "point_count", "status")


@query("nodes", "SELECT node_key, d, CASE WHEN d = 3 THEN point_count * 2 ELSE point_count END AS point_count FROM fx_nodes WHERE d <= 3")
def page_merge(spark, sf):
    """Nodes of a loaded page replace older ones."""
    n = C.nodes(spark, sf).select("node_key", "d", "point_count")
    held = n.where("d <= 2").union(n.where("d = 3 and point_count % 2 = 0"))
    loaded = n.where("d = 3").withColumn("point_count", F.col("point_count") * 2)
    nodes, _ = T.merged_pages(held, loaded, n.where("d = 4").select("node_key"), F.lit("4-0-0-0"))
    return nodes


@query("nodes", """
WITH up AS (SELECT node_key, d, CASE WHEN d > 0 THEN concat_ws('-', d - 1, kx >> 1, ky >> 1, kz >> 1) END AS parent FROM fx_nodes),
r AS (SELECT node_key, d FROM up WHERE d = 0 UNION ALL SELECT up.node_key, up.d FROM up JOIN r ON up.parent = r.node_key)
SELECT node_key, d FROM r
""")
def hierarchy_bfs(spark, sf):
    """Nodes that the root reaches without a gap."""
    return T.reachable(C.nodes(spark, sf))


@query("nodes", """
WITH w AS (SELECT node_key AS leaf, d, kx, ky, kz FROM fx_nodes)
SELECT leaf, string_agg(concat_ws('-', k, kx >> (d - k), ky >> (d - k), kz >> (d - k)), '/' ORDER BY k) AS path FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM w) GROUP BY leaf
""")
def parent_chain(spark, sf):
    """The path from the root to each node."""
    n = C.nodes(spark, sf)
    step = F.transform(F.sequence(F.lit(0), F.col("d")), lambda k: F.concat_ws("-", k.cast("string"), *[F.floor(F.col(p) / F.pow(F.lit(2.0), F.col("d") - k)).cast("int").cast("string") for p in T.PLACES]))
    return n.select(F.col("node_key").alias("leaf"), F.array_join(step, "/").alias("path"))


@query("", "SELECT " + ", ".join(f"{v} AS {k}" for k, v in {"narrow": "4656.0::DOUBLE", "tall": "9000.0::DOUBLE", "feet": "10000.0::DOUBLE"}.items()))
def root_span(spark, sf):
    """Metric spans of a cloud without a usable width, of a tall one, and of one in mixed units."""
    one = spark.range(1)
    flat = R.root_span(F.lit(0.0), F.lit(4656.0), F.lit(0.0), 1.0, 1.0, False, F.lit(False))
    tall = R.root_span(F.lit(100.0), F.lit(4656.0), F.lit(9000.0), 1.0, 1.0, False, F.lit(True))
    feet = R.root_span(F.lit(0.0), F.lit(10000.0), F.lit(0.0), 1.0, 0.3048, False, F.lit(False))
    return one.select(flat.alias("narrow"), tall.alias("tall"), feet.alias("feet"))


@query("", f"""
SELECT round(max(sqrt({' + '.join(f'power({a} - {b}, 2)' for a, b in zip(ecef_sql('0.0::DOUBLE', 't', '0.0::DOUBLE'), ecef_sql('1.0::DOUBLE', 't', '0.0::DOUBLE'), strict=True))})), 3) AS span FROM (SELECT unnest(range(0, 9)) / 8.0::DOUBLE * 0.001 AS t)
""")
def degree_span(spark, sf):
    """The span of one degree along the equator."""
    rect = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 0.001)], "k string, min_x double, min_y double, max_x double, max_y double")
    return R.horizontal_span(rect, lambda x, y: (x, y), ["k"]).select(F.round("span", 3).alias("span"))


MERCATOR = "SELECT classification, count(*) AS n, round(avg(6378137.0::DOUBLE * radians(-123.0::DOUBLE + y / 1e6)), 3) AS web_x, round(avg(6378137.0::DOUBLE * asinh(tan(radians(44.0::DOUBLE + x / 1e6)))), 3) AS web_y, true AS exact FROM fx_points GROUP BY 1"


@query("points", MERCATOR)
def projections_round_trip(spark, sf):
    """Where points lie in the web's projection on average, and whether positions come back from four projections within a hundredth of a millimetre."""
    web = G.WebMercator().forward(F.lit(-123.0) + F.col("y") / 1e6, F.lit(44.0) + F.col("x") / 1e6)
    p = C.points(spark, sf).withColumns({"e": F.lit(WEST) + F.col("x") / 10, "n": F.lit(SOUTH) + F.col("y") / 10})
    lon, lat = G.utm(10).inverse(F.col("e"), F.col("n"))
    p = p.withColumns({"lon": lon, "lat": lat})
    good = F.lit(True)
    for i, proj in enumerate((G.utm(10), G.ConformalConic(43.0, 45.5, 41.75, -120.5, 400000.0, 0.0, 0.3048), G.WebMercator(), G.LongLat())):
        # Each step is a column of its own, so that no expression is built twice.
        p = p.withColumns(dict(zip((f"x{i}", f"y{i}"), proj.forward(F.col("lon"), F.col("lat")), strict=True)))
        p = p.withColumns(dict(zip((f"lon{i}", f"lat{i}"), proj.inverse(F.col(f"x{i}"), F.col(f"y{i}")), strict=True)))
        good = good & (F.abs(F.col(f"lon{i}") - F.col("lon")) < 1e-10) & (F.abs(F.col(f"lat{i}") - F.col("lat")) < 1e-10)
    return p.withColumn("good", good).groupBy("classification").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 3).alias(a) for c, a in zip(web, ("web_x", "web_y"), strict=True)], F.min("good").alias("exact"))


@query("points", "SELECT count(*) AS n, true AS within_tolerance FROM fx_points")
def grid_reproject(spark, sf):
    """Positions by the control grid, and whether all are within a millimetre of the exact ones."""
    low, high = (WEST, SOUTH), (WEST + SPAN, SOUTH + SPAN)
    p = C.points(spark, sf).select((F.lit(WEST) + F.col("x") / C.SIDE * SPAN).alias("x"), (F.lit(SOUTH) + F.col("y") / C.SIDE * SPAN).alias("y"))
    cells, grid = R.chosen_grid(spark, G.utm(10), low, high)
    e = R.grid_error(R.by_grid(p, grid, low, high, cells), G.utm(10))
    return p.agg(F.count("*").alias("n")).crossJoin(e).select("n", (F.col("max_error") <= R.TOLERANCE).alias("within_tolerance"))


PACKED = QUANT.replace("FROM fx_keyed)", "FROM fx_keyed WHERE classification NOT IN (7, 18))") + ", m AS (SELECT *, max(greatest(red, green, blue)) OVER (PARTITION BY node_key) AS most FROM q)"
BACK = ", ".join(f"round(avg(min_{a} + q_{a} / 65535.0::DOUBLE * (CASE WHEN max_{a} = min_{a} THEN 1 ELSE max_{a} - min_{a} END)), 3) AS {b}" for a, b in zip(("ex", "ey", "ez"), "xyz", strict=True))
SHADES = ("red", "green", "blue")


@query("keyed", PACKED + f" SELECT node_key, count(*) AS n, {BACK}, " + ", ".join(f"sum(CASE WHEN most > 255 THEN {c} >> 8 ELSE {c} END)::BIGINT AS {c}" for c in SHADES) + ", sum(classification)::DOUBLE AS classes, sum(intensity)::DOUBLE AS intensities, true AS whole FROM m GROUP BY node_key")
def pnts_tiles(spark, sf):
    """Binary tiles of all nodes with two attributes, and what a reader finds in them; whole ones have the size in their header."""
    from pointquarry.operators.shading import true_colored

    p = true_colored(C.placed(C.visible(C.keyed_points(spark, sf))))
    found, _ = C.resolve_attributes(["Classification", "Intensity"])
    t = written(K.tile_slices(p, found, {"Classification": "classification", "Intensity": "intensity"}, KEYS), "tiles")
    whole = K.tile_sizes(t).where(F.col("whole") & (F.col("bytes") % 8 == 0) & (F.col("bytes") > 28 + 9 * F.col("n")))
    read = K.slice_points(t, found).join(small(whole.select("node_key")), "node_key").groupBy("node_key")
    sums = [F.sum(c).alias(a) for c, a in (("Classification", "classes"), ("Intensity", "intensities"))]
    return read.agg(F.count("*").alias("n"), *[F.round(F.avg(a), 3).alias(a) for a in "xyz"], *[F.sum(c).alias(c) for c in SHADES], *sums, F.lit(True).alias("whole"))


@query()
def tilesets_json_base64(spark, sf):
    """The tile tree as a JSON document and its data URI."""
    n = T.node_cubes(C.nodes(spark, sf), C.SIDE)
    t = T.tiles(C.nodes(spark, sf), 1000.0, "s/").join(n.select("node_key", F.array("min_x", "min_y", "min_z", *[F.col(f"min_{a}") + F.col("side") for a in "xyz"]).alias("region")), "node_key")
    return KT.tileset(t, 125.0)


@query("nodes", """
WITH t AS (SELECT node_key, d, concat_ws('-', d - d % 2, kx >> (d % 2), ky >> (d % 2), kz >> (d % 2)) AS page_key, (1000.0::DOUBLE / 16) / power(2, d) AS error, concat('s/', node_key, '.pnts') AS uri FROM fx_nodes),
links AS (SELECT concat_ws('-', d - 2, kx >> 2, ky >> 2, kz >> 2) AS page_key, (1000.0::DOUBLE / 16) / power(2, d) AS error, concat('s/page/', node_key, '.json') AS uri, concat_ws('-', d - 1, kx >> 1, ky >> 1, kz >> 1) AS up FROM fx_nodes WHERE d > 0 AND d % 2 = 0),
every AS (SELECT page_key, error, uri, 0 AS link FROM t WHERE page_key IN (SELECT node_key FROM fx_nodes) UNION ALL SELECT page_key, error, uri, 1 FROM links WHERE page_key IN (SELECT node_key FROM fx_nodes) AND up IN (SELECT node_key FROM fx_nodes))
SELECT page_key, count(*) AS tiles, sum(link)::BIGINT AS links, sum(error) AS errors, md5(string_agg(uri, ',' ORDER BY uri)) AS uris FROM every GROUP BY page_key
""")
def page_documents(spark, sf):
    """What each document of the tile tree holds: tiles, links to further documents, errors and contents."""
    n = T.node_cubes(C.nodes(spark, sf), C.SIDE).withColumn("region", F.array("min_x", "min_y", "min_z", *[F.col(f"min_{a}") + F.col("side") for a in "xyz"]))
    docs = KT.page_documents(n, 1000.0, "s/", levels=2)
    uris = F.regexp_extract_all("json", F.lit('"uri":"([^"]*)"'))
    errors = F.slice(F.regexp_extract_all("json", F.lit('"geometricError":([^,}]*)')), 2, 1 << 30)
    total = F.aggregate(errors, F.lit(0.0), lambda a, e: a + e.cast("double"))
    return docs.select("page_key", F.size(uris).cast("long").alias("tiles"), F.size(F.filter(uris, lambda u: F.endswith(u, F.lit(".json")))).cast("long").alias("links"), total.alias("errors"), F.md5(F.array_join(F.array_sort(uris), ",")).alias("uris"))


@query("", "SELECT * FROM (VALUES ('a', 8::BIGINT, 0::BIGINT), ('b', 2::BIGINT, 24::BIGINT), ('c', 1::BIGINT, 30::BIGINT)) t(name, size, byte_offset)")
def column_layout(spark, sf):
    """Where the columns of three values each begin in a batch table."""
    specs = spark.createDataFrame([(0, "a", 8), (1, "b", 2), (2, "c", 1)], "i int, name string, size int")
    folded = specs.agg(F.array_sort(F.collect_list(F.struct("i", "name", "size"))).alias("s"))
    kind = "struct<end:bigint,out:array<struct<name:string,size:bigint,byte_offset:bigint>>>"
    start = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<struct<name:string,size:bigint,byte_offset:bigint>>").alias("out")).cast(kind)

    def step(acc, s):
        at = (F.ceil(acc["end"] / s["size"]) * s["size"]).cast("long")
        return F.struct((at + s["size"] * 3).cast("long").alias("end"), F.concat(acc["out"], F.array(F.struct(s["name"].alias("name"), s["size"].cast("long").alias("size"), at.alias("byte_offset")))).alias("out")).cast(kind)

    return folded.select(F.explode(F.aggregate("s", start, step)["out"]).alias("c")).select("c.*")


@query("points", "SELECT classification, sum(((floor(x)::BIGINT % 256) + 256) % 256)::BIGINT AS bytes_sum, count(*) FILTER (x NOT BETWEEN 0 AND 65535) AS out_of_short FROM fx_points GROUP BY 1")
def component_wrap(spark, sf):
    """Values as unsigned bytes hold them, and how many exceed an unsigned short."""
    p = C.points(spark, sf)
    return p.groupBy("classification").agg(F.sum(N.wrapped(F.floor("x"), "UNSIGNED_BYTE")).alias("bytes_sum"), F.sum(F.when(~N.fits(F.col("x"), "UNSIGNED_SHORT"), 1).otherwise(0)).cast("long").alias("out_of_short"))


@query("nodes", """
WITH b AS (SELECT node_key, kx * (131072 / power(2, d)) AS x0, ky * (131072 / power(2, d)) AS y0, 131072 / power(2, d) AS s FROM fx_nodes),
c AS (SELECT node_key, greatest(x0, 20000) AS lx, least(x0 + s, 90000) AS hx, greatest(y0, 10000) AS ly, least(y0 + s, 80000) AS hy FROM b)
SELECT node_key, CASE WHEN hx >= lx AND hy >= ly THEN lx ELSE 20000 END::DOUBLE AS min_x, CASE WHEN hx >= lx AND hy >= ly THEN hx ELSE 90000 END::DOUBLE AS max_x,
  CASE WHEN hx >= lx AND hy >= ly THEN ly ELSE 10000 END::DOUBLE AS min_y, CASE WHEN hx >= lx AND hy >= ly THEN hy ELSE 80000 END::DOUBLE AS max_y FROM c
""")
def header_bounded_nodes(spark, sf):
    """The rectangles of nodes within the bounds of a header, as for coordinates in degrees."""
    header = {"min_x": 20000.0, "max_x": 90000.0, "min_y": 10000.0, "max_y": 80000.0}
    return T.bounded_rects(T.node_cubes(C.nodes(spark, sf), C.SIDE), header, angular=True)


@query("", "SELECT * FROM (VALUES ('good', true, true, true, true), ('flat', true, false, true, true), ('inverted', false, false, true, false), ('endless', true, true, false, false), ('line', true, true, true, false)) t(name, xy_usable, xy_has_span, z_usable, z_has_span)")
def axis_validity(spark, sf):
    """Which axes of several headers can be used."""
    inf = float("inf")
    rows = [("good", 0.0, 0.0, 0.0, 1.0, 1.0, 1.0), ("flat", 5.0, 5.0, 0.0, 5.0, 5.0, 2.0), ("inverted", 9.0, 0.0, 3.0, 1.0, 1.0, 3.0), ("endless", 0.0, 0.0, 0.0, 1.0, 1.0, inf), ("line", 0.0, 2.0, 4.0, 3.0, 2.0, 4.0)]
    names = ["x0", "y0", "z0", "x1", "y1", "z1"]
    h = spark.createDataFrame(rows, "name string, " + ", ".join(f"{n} double" for n in names))
    return h.select("name", G.axis_validity([F.col(n) for n in names[:3]], [F.col(n) for n in names[3:]]).alias("v")).select("name", "v.*")


@query("points", "SELECT radians(-123.0::DOUBLE + min(y) / 1e6) AS west, radians(44.0::DOUBLE + min(x) / 1e6) AS south, radians(-123.0::DOUBLE + max(y) / 1e6) AS east, radians(44.0::DOUBLE + max(x) / 1e6) AS north, min(z) AS min_h, max(z) AS max_h FROM fx_points")
def extent_region(spark, sf):
    """The region of the points themselves, for aiming a camera."""
    p = C.placed(C.points(spark, sf))
    b = p.agg(F.min("lon").alias("min_x"), F.min("lat").alias("min_y"), F.max("lon").alias("max_x"), F.max("lat").alias("max_y"), F.min("z").alias("min_h"), F.max("z").alias("max_h")).withColumn("k", F.lit(0))
    at = T.edge_samples(b, ["k", "min_h", "max_h"])
    lons = T.longitude_bounds(at, "x", ["k"])
    rest = at.groupBy("k").agg(F.min("y").alias("south"), F.max("y").alias("north"), F.max("min_h").alias("min_h"), F.max("max_h").alias("max_h"))
    return lons.join(rest, "k").select(*[F.radians(c).alias(c) for c in ("west", "south", "east", "north")], "min_h", "max_h")


@query("points", "SELECT classification, round(sum(floor(x * 100)::BIGINT * 0.01::DOUBLE + 500), 3) AS sum_x FROM fx_points GROUP BY 1")
def scaled_coordinates(spark, sf):
    """Coordinates of stored whole numbers."""
    p = C.points(spark, sf).withColumn("raw", F.floor(F.col("x") * 100))
    return p.groupBy("classification").agg(F.round(F.sum(G.from_scaled(F.col("raw"), 0.01, 500.0)), 3).alias("sum_x"))


@query("points", "SELECT lpad(classification::VARCHAR, 3, ' ') || lpad(count(*)::VARCHAR, 10, ' ') || lpad(printf('%.2f', round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM fx_points), 2)), 8, ' ') || '%' || lpad(printf('%.1f', round(avg(z), 1)), 10, ' ') AS line FROM fx_points GROUP BY classification")
def class_report(spark, sf):
    """Lines of a class profile."""
    from pointquarry.operators.profile import class_profile
    from pointquarry.sinks.reports import class_line

    return class_profile(C.points(spark, sf)).select(class_line(*map(F.col, ("classification", "n", "pct", "z_mean"))).alias("line"))


@query("keyed", "SELECT node_key, list([x, y, z] ORDER BY x, y, z, pulse_id).flatten()::VARCHAR AS flat FROM fx_keyed GROUP BY node_key")
def flat_triplets(spark, sf):
    """The coordinates of each tile, one after another, as text."""
    p = C.keyed_points(spark, sf)
    rows = F.array_sort(F.collect_list(F.struct("x", "y", "z", "pulse_id")))
    flat = F.flatten(F.transform(rows, lambda r: F.array(r["x"], r["y"], r["z"])))
    return p.groupBy("node_key").agg(F.concat(F.lit("["), F.array_join(flat, ", "), F.lit("]")).alias("flat"))


@query("points", "SELECT classification, count(*) AS n, min(pulse_id) AS least FROM fx_points WHERE point_source_id % 4 = 1 GROUP BY 1")
def pick_owned(spark, sf):
    """Hits on one of several clouds; a quarter of the hits are on nothing."""
    drawn = F.col("point_source_id") % 4
    hits = C.points(spark, sf).withColumn("primitive", F.when(drawn < 3, drawn))
    return NN.owned(hits, F.lit(1)).groupBy("classification").agg(F.count("*").alias("n"), F.min("pulse_id").alias("least"))
