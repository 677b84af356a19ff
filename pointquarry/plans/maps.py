"""Queries on map projections and on nearest points of positions on the globe."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pointquarry.functions import wkt
from pointquarry.operators import space
from pointquarry.plans.registry import query
from pointquarry.plans.trees import ASKED, KEYS, ecef_sql
from pointquarry.sources import clouds as C

#: Semi-major axis and inverse flattening of the ellipsoids that the SQL below writes out.
SHAPES = {"airy": (6377563.396, 299.3249646), "bessel": (6377397.155, 299.1528128), "clrk66": (6378206.4, 294.9786982), "krass": (6378245.0, 298.3), "GRS80": (6378137.0, 298.257222101), "WGS84": (6378137.0, 298.257223563)}
#: A projection's text, its ellipsoid, and the middle of the positions that the query gives it.
MAPS = {
    "tmerc": ("+proj=tmerc +lat_0=49 +lon_0=-2 +k=0.9996012717 +x_0=400000 +y_0=-100000 +ellps=airy", "airy", -2.0, 53.0),
    "merc": ("+proj=merc +lon_0=51 +lat_ts=42 +ellps=krass", "krass", 52.0, 44.0),
    "aea": ("+proj=aea +lat_1=29.5 +lat_2=45.5 +lat_0=23 +lon_0=-96 +ellps=clrk66", "clrk66", -94.0, 37.0),
    "sterea": ("+proj=sterea +lat_0=52.15616055555555 +lon_0=5.38763888888889 +k=0.9999079 +x_0=155000 +y_0=463000 +ellps=bessel", "bessel", 5.0, 52.0),
    "laea": ("+proj=laea +lat_0=52 +lon_0=10 +x_0=4321000 +y_0=3210000 +ellps=GRS80", "GRS80", 11.0, 50.0),
    "stere": ("+proj=stere +lat_0=-90 +lat_ts=-71 +lon_0=70 +x_0=6000000 +y_0=6000000", "WGS84", 75.0, -75.0),
    "omerc": ("+proj=omerc +no_uoff +lat_0=57 +lonc=-133.6666666666667 +alpha=323.1301023611111 +gamma=323.1301023611111 +k=0.9999 +x_0=5000000 +y_0=-5000000 +ellps=GRS80", "GRS80", -134.0, 57.0),
    "lcc": ("+proj=lcc +lat_1=43 +lat_2=45.5 +lat_0=41.75 +lon_0=-120.5 +x_0=400000 +ellps=GRS80", "GRS80", -121.0, 44.0),
}


def sql_of(kind: str) -> tuple[str, str]:
    """The published formulas of a projection over ``l`` and ``p``, longitude and latitude in radians, as SQL."""
    text, shape, _, _ = MAPS[kind]
    n = {k: float(v) for k, v in wkt.pairs_of(text).items() if k not in ("proj", "ellps", "no_uoff")}
    a, f = SHAPES[shape][0], 1 / SHAPES[shape][1]
    e2 = f * (2 - f)
    e = math.sqrt(e2)
    d = lambda v: f"({v!r})::DOUBLE"
    lat0, lon0, k, x0, y0 = math.radians(n.get("lat_0", 0.0)), math.radians(n.get("lon_0", n.get("lonc", 0.0))), n.get("k", 1.0), n.get("x_0", 0.0), n.get("y_0", 0.0)
    dl, s = f"(l - {d(lon0)})", f"({d(e)} * sin(p))"
    t = f"(tan({d(math.pi / 4)} - p / 2) / pow((1 - {s}) / (1 + {s}), {d(e / 2)}))"
    tf = lambda v: math.tan(math.pi / 4 - v / 2) / ((1 - e * math.sin(v)) / (1 + e * math.sin(v))) ** (e / 2)
    mf = lambda v: math.cos(v) / math.sqrt(1 - e2 * math.sin(v) ** 2)
    q = f"({d(1 - e2)} * (sin(p) / (1 - {s} * {s}) - ln((1 - {s}) / (1 + {s})) / {d(2 * e)}))"
    qf = lambda v: (1 - e2) * (math.sin(v) / (1 - e2 * math.sin(v) ** 2) - math.log((1 - e * math.sin(v)) / (1 + e * math.sin(v))) / (2 * e))
    if kind == "tmerc":
        m = f / (2 - f)
        series = (m / 2 - 2 * m**2 / 3 + 5 * m**3 / 16 + 41 * m**4 / 180, 13 * m**2 / 48 - 3 * m**3 / 5 + 557 * m**4 / 1440, 61 * m**3 / 240 - 103 * m**4 / 140, 49561 * m**4 / 161280)
        r = a / (1 + m) * (1 + m**2 / 4 + m**4 / 64)
        beta0 = math.atan(math.sinh(math.asinh(math.tan(lat0)) - e * math.atanh(e * math.sin(lat0))))
        m0 = r * (beta0 + sum(h * math.sin(2 * i * beta0) for i, h in enumerate(series, 1)))
        beta = f"atan(sinh(asinh(tan(p)) - {d(e)} * atanh({s})))"
        eta = f"atanh(cos({beta}) * sin({dl}))"
        xi = f"asin(sin({beta}) * cosh({eta}))"
        north = f"({xi}" + "".join(f" + {d(h)} * sin({2 * i} * {xi}) * cosh({2 * i} * {eta})" for i, h in enumerate(series, 1)) + ")"
        east = f"({eta}" + "".join(f" + {d(h)} * cos({2 * i} * {xi}) * sinh({2 * i} * {eta})" for i, h in enumerate(series, 1)) + ")"
        return f"{d(x0)} + {d(k * r)} * {east}", f"{d(y0)} + {d(k)} * ({d(r)} * {north} - {d(m0)})"
    if kind == "merc":
        r = a * mf(math.radians(n["lat_ts"]))
        return f"{d(x0)} + {d(r)} * {dl}", f"{d(y0)} - {d(r)} * ln({t})"
    if kind in ("aea", "lcc"):
        p1, p2 = math.radians(n["lat_1"]), math.radians(n["lat_2"])
        if kind == "aea":
            c = (mf(p1) ** 2 - mf(p2) ** 2) / (qf(p2) - qf(p1))
            g = mf(p1) ** 2 + c * qf(p1)
            rho, rho0 = f"({d(a / c)} * sqrt({d(g)} - {d(c)} * {q}))", a / c * math.sqrt(g - c * qf(lat0))
        else:
            c = (math.log(mf(p1)) - math.log(mf(p2))) / (math.log(tf(p1)) - math.log(tf(p2)))
            g = mf(p1) / (c * tf(p1) ** c)
            rho, rho0 = f"({d(a * g)} * pow({t}, {d(c)}))", a * g * tf(lat0) ** c
        return f"{d(x0)} + {rho} * sin({d(c)} * {dl})", f"{d(y0)} + {d(rho0)} - {rho} * cos({d(c)} * {dl})"
    if kind == "sterea":
        c = math.sqrt(1 + e2 * math.cos(lat0) ** 4 / (1 - e2))
        w1 = ((1 + math.sin(lat0)) / (1 - math.sin(lat0)) * ((1 - e * math.sin(lat0)) / (1 + e * math.sin(lat0))) ** e) ** c
        s0 = (w1 - 1) / (w1 + 1)
        g = (c + math.sin(lat0)) * (1 - s0) / ((c - math.sin(lat0)) * (1 + s0))
        chi0 = math.asin((g * w1 - 1) / (g * w1 + 1))
        r = 2 * k * a * math.sqrt(1 - e2) / (1 - e2 * math.sin(lat0) ** 2)
        w = f"({d(g)} * pow((1 + sin(p)) / (1 - sin(p)) * pow((1 - {s}) / (1 + {s}), {d(e)}), {d(c)}))"
        sx, cx, ll = f"(({w} - 1) / ({w} + 1))", f"(2 * sqrt({w}) / ({w} + 1))", f"({d(c)} * {dl})"
        b = f"(1 + {sx} * {d(math.sin(chi0))} + {cx} * {d(math.cos(chi0))} * cos({ll}))"
        return f"{d(x0)} + {d(r)} * {cx} * sin({ll}) / {b}", f"{d(y0)} + {d(r)} * ({sx} * {d(math.cos(chi0))} - {cx} * {d(math.sin(chi0))} * cos({ll})) / {b}"
    if kind == "laea":
        top = qf(math.pi / 2)
        beta0, r = math.asin(qf(lat0) / top), a * math.sqrt(top / 2)
        stretch, beta = a * mf(lat0) / (r * math.cos(beta0)), f"asin({q} / {d(top)})"
        b = f"({d(r)} * sqrt(2 / (1 + {d(math.sin(beta0))} * sin({beta}) + {d(math.cos(beta0))} * cos({beta}) * cos({dl}))))"
        return f"{d(x0)} + {b} * {d(stretch)} * cos({beta}) * sin({dl})", f"{d(y0)} + {b} / {d(stretch)} * ({d(math.cos(beta0))} * sin({beta}) - {d(math.sin(beta0))} * cos({beta}) * cos({dl}))"
    if kind == "stere":
        south, ts = t.replace("- p / 2", "+ p / 2").replace(f"(1 - {s}) / (1 + {s})", f"(1 + {s}) / (1 - {s})"), abs(math.radians(n["lat_ts"]))
        rho = f"({d(a * mf(ts) / tf(ts))} * {south})"
        return f"{d(x0)} + {rho} * sin({dl})", f"{d(y0)} + {rho} * cos({dl})"
    az, turn = math.radians(n["alpha"]), math.radians(n["gamma"])
    b = math.sqrt(1 + e2 * math.cos(lat0) ** 4 / (1 - e2))
    g = a * b * k * math.sqrt(1 - e2) / (1 - e2 * math.sin(lat0) ** 2)
    dd = b * math.sqrt(1 - e2) / (math.cos(lat0) * math.sqrt(1 - e2 * math.sin(lat0) ** 2))
    ff = dd + math.sqrt(dd * dd - 1)
    h, g0 = ff * tf(lat0) ** b, math.asin(math.sin(az) / dd)
    l0 = lon0 - math.asin((ff - 1 / ff) / 2 * math.tan(g0)) / b
    qq, bl = f"({d(h)} / pow({t}, {d(b)}))", f"({d(b)} * (l - {d(l0)}))"
    ss, tt = f"(({qq} - 1 / {qq}) / 2)", f"(({qq} + 1 / {qq}) / 2)"
    uu = f"((-sin({bl}) * {d(math.cos(g0))} + {ss} * {d(math.sin(g0))}) / {tt})"
    v, u = f"({d(g / (2 * b))} * ln((1 - {uu}) / (1 + {uu})))", f"({d(g / b)} * atan2({ss} * {d(math.cos(g0))} + sin({bl}) * {d(math.sin(g0))}, cos({bl})))"
    return f"{d(x0)} + {v} * {d(math.cos(turn))} + {u} * {d(math.sin(turn))}", f"{d(y0)} + {u} * {d(math.cos(turn))} - {v} * {d(math.sin(turn))}"


def maps_sql() -> str:
    parts = []
    for kind, (_, _, lon, lat) in MAPS.items():
        x, y = sql_of(kind)
        parts.append(f"SELECT '{kind}' AS kind, classification, count(*) AS n, round(avg({x}), 3) AS x, round(avg({y}), 3) AS y, round(avg(degrees(l)), 8) AS lon, round(avg(degrees(p)), 8) AS lat FROM (SELECT classification, radians({lon!r}::DOUBLE + (y - 50000) / 40000.0::DOUBLE) AS l, radians({lat!r}::DOUBLE + (x - 50000) / 40000.0::DOUBLE) AS p FROM fx_points) GROUP BY classification")
    return " UNION ALL ".join(parts)


@query("points", maps_sql())
def projected_places(spark, sf):
    """Where points lie on average in eight projections, and the positions that these give back."""
    p = C.points(spark, sf)
    measured = []
    for kind, (text, _, lon, lat) in MAPS.items():
        found = wkt.projection_of(text)
        # Each step is a column of its own, so that no expression is built twice.
        p = p.withColumns({f"l_{kind}": F.lit(lon) + (F.col("y") - 50000) / 40000.0, f"p_{kind}": F.lit(lat) + (F.col("x") - 50000) / 40000.0})
        p = p.withColumns(dict(zip((f"x_{kind}", f"y_{kind}"), found.forward(F.col(f"l_{kind}"), F.col(f"p_{kind}")), strict=True)))
        back = found.inverse(F.col(f"x_{kind}"), F.col(f"y_{kind}"))
        measured.append(F.struct(F.lit(kind).alias("kind"), *[F.round(F.avg(c), d).alias(n) for c, d, n in ((F.col(f"x_{kind}"), 3, "x"), (F.col(f"y_{kind}"), 3, "y"), (back[0], 8, "lon"), (back[1], 8, "lat"))]))
    means = p.groupBy("classification").agg(F.count("*").alias("n"), F.array(*measured).alias("m"))
    return means.select("classification", "n", F.explode("m").alias("m")).select("m.kind", "classification", "n", "m.x", "m.y", "m.lon", "m.lat")


#: A cloud in degrees and one in feet of a conic projection, and positions on the globe near every hundredth pulse.
FEET = "+proj=lcc +lat_1=43 +lat_2=45.5 +lat_0=41.75 +lon_0=-120.5 +x_0=400000 +ellps=GRS80 +units=ft"
LON, LAT, HEIGHT = "(y / 1e6 - 123.0::DOUBLE)", "(x / 1e6 + 44.0::DOUBLE)", "(z / 1000.0::DOUBLE)"
NAMES = ", ".join(KEYS)


def snapped_sql() -> str:
    east, north = (c.replace("(l - ", "(radians(lon) - ").replace("sin(p)", "sin(radians(lat))").replace("- p / 2", "- radians(lat) / 2") for c in sql_of("lcc"))
    globe = ", ".join(f"{c} AS {n}" for c, n in zip(ecef_sql("lon", "lat", "h"), ("ex", "ey", "ez"), strict=True))
    return f"""
WITH p AS (SELECT {NAMES}, {LON} AS lon, {LAT} AS lat, {HEIGHT} AS h FROM fx_points),
s AS (SELECT pulse_id AS seed_id, min({LON}) + 0.0004::DOUBLE AS lon, min({LAT}) - 0.0003::DOUBLE AS lat, min({HEIGHT}) + 12.5::DOUBLE AS h FROM fx_points WHERE pulse_id % {ASKED} = 0 GROUP BY pulse_id),
pe AS (SELECT *, {globe} FROM p), se AS (SELECT *, {globe} FROM s),
pf AS (SELECT *, {east} AS ex, {north} AS ey, h AS ez FROM p), sf AS (SELECT *, {east} AS ex, {north} AS ey, h AS ez FROM s),
a AS (SELECT 'degrees' AS cloud, seed_id, {NAMES}, power(pe.ex - se.ex, 2) + power(pe.ey - se.ey, 2) + power(pe.ez - se.ez, 2) AS d2 FROM pe, se),
b AS (SELECT 'feet' AS cloud, seed_id, {NAMES}, power(pf.ex - sf.ex, 2) + power(pf.ey - sf.ey, 2) + power(pf.ez - sf.ez, 2) AS d2 FROM pf, sf),
r AS (SELECT *, row_number() OVER (PARTITION BY cloud, seed_id ORDER BY d2, {NAMES}) AS rn FROM (SELECT * FROM a UNION ALL SELECT * FROM b))
SELECT cloud, seed_id, x, y, z, round(sqrt(d2), 3) AS meters FROM r WHERE rn = 1
"""


@query("points", snapped_sql())
def snap_geocentric(spark, sf):
    """The nearest point to positions on the globe: of a cloud in degrees, and of the same in feet of a projection."""
    names = [c for c in KEYS if c not in ("x", "y", "z")]
    p = C.points(spark, sf).select(*names, *[F.col(c).alias(f"own_{c}") for c in "xyz"], (F.col("y") / 1e6 - 123.0).alias("lon"), (F.col("x") / 1e6 + 44.0).alias("lat"), (F.col("z") / 1000.0).alias("h"))
    s = p.where(F.col("pulse_id") % ASKED == 0).groupBy(F.col("pulse_id").alias("seed_id")).agg((F.min("lon") + 0.0004).alias("lon"), (F.min("lat") - 0.0003).alias("lat"), (F.min("h") + 12.5).alias("height"))
    order = ["own_x", "own_y", "own_z", *names]
    out = []
    for cloud, projection, z_unit in (("degrees", None, 1.0), ("feet", wkt.projection_of(FEET), 0.3048)):
        x, y = (F.col("lon"), F.col("lat")) if projection is None else projection.forward(F.col("lon"), F.col("lat"))
        held = p.withColumns({"x": x, "y": y, "z": F.col("h") / z_unit}).drop("lon", "lat", "h")
        hits = space.snap_geographic(s, held, ["own_x", "own_y", "own_z"], order, projection, z_unit if projection else 1.0, z_unit)
        out.append(hits.select(F.lit(cloud).alias("cloud"), "seed_id", *[F.col(f"own_{c}").alias(c) for c in "xyz"], F.round("distance", 3).alias("meters")))
    return out[0].union(out[1])
