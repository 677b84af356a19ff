"""The exact search for nearest points against all distances."""

import random

import numpy as np
import pytest

from pointquarry.cloud import PointCloud
from pointquarry.functions import geodesy, wkt
from pointquarry.operators import space

KIND = "k long, ex double, ey double, ez double"


def brute(seeds, points):
    found = {}
    for i, *s in seeds:
        best = min(((sum((a - b) ** 2 for a, b in zip(p[1:], s, strict=True)), p[0]) for p in points), default=None)
        if best:
            found[i] = (best[1], best[0] ** 0.5)
    return found


def searched(spark, seeds, points, **settings):
    s = spark.createDataFrame(seeds, KIND.replace("k long", "seed_id long"))
    rows = space.nearest_points(s, spark.createDataFrame(points, KIND), ["k"], ["k"], **settings).collect()
    assert len(rows) == len({r.seed_id for r in rows})
    return {r.seed_id: (r.k, pytest.approx(r.distance, abs=1e-9)) for r in rows}


@pytest.mark.parametrize("shape", ["cube", "surface", "line", "one", "clusters"])
def test_all_shapes(spark, shape, monkeypatch):
    draw = random.Random(shape)
    u = lambda: draw.uniform(-500, 500)
    points = {
        "cube": lambda i: (i, u(), u(), u()),
        "surface": lambda i: (i, u(), u(), 0.0),
        "line": lambda i: (i, u(), 7.0, -3.0),
        "one": lambda i: (i, 1.0, 2.0, 3.0),
        "clusters": lambda i: (i, (i % 3) * 1e6 + draw.random(), draw.random(), draw.random()),
    }[shape]
    points = [points(i) for i in range(1500)]
    seeds = [(i, u(), u(), u()) for i in range(40)] + [(100, 1e7, -1e7, 5e6), (101, *points[3][1:]), (102, 0.5e6, 0.0, 0.0)]
    monkeypatch.setattr(space, "FEW", 0 if shape == "cube" else 1 << 16)
    assert searched(spark, seeds, points, cell_points=4) == brute(seeds, points)


def test_odd_rows(spark):
    points = [(1, 0.0, 0.0, 0.0), (2, 0.0, 0.0, 0.0), (3, float("nan"), 0.0, 0.0), (4, None, 0.0, 0.0), (5, float("inf"), 0.0, 0.0)]
    seeds = [(1, 3.0, 4.0, 0.0), (1, 3.0, 4.0, 0.0), (2, None, 0.0, 0.0)]
    s = spark.createDataFrame(seeds, KIND.replace("k long", "seed_id long"))
    rows = space.nearest_points(s, spark.createDataFrame(points, KIND), ["k"], ["k"]).collect()
    assert [tuple(r) for r in rows] == [(1, 1, 5.0)]
    assert searched(spark, [(1, 0.0, 0.0, 0.0)], points[2:]) == {}


def test_positions_of_a_cloud(spark):
    draw = np.random.default_rng(1)
    lon, lat, h = draw.uniform(9.0, 9.01, 800), draw.uniform(51.0, 51.01, 800), draw.uniform(0, 50, 800)
    degrees = spark.createDataFrame([(float(a), float(b), float(c), 2) for a, b, c in zip(lon, lat, h, strict=True)], "x double, y double, z double, classification int")
    seeds = spark.createDataFrame([(i, float(lon[i]) + 2e-5, float(lat[i]) + 1e-5, float(h[i]) + 1) for i in range(10)], "seed_id long, lon double, lat double, height double")
    cloud = PointCloud.of(degrees, 0.02, 0, (8.99, 50.99, 0.0), crs="+proj=longlat")
    hits = {r.seed_id: r for r in cloud.snap_positions(seeds, ["x", "y", "z"]).collect()}
    la, lo = np.radians(lat), np.radians(lon)
    n = geodesy.SEMI_MAJOR / np.sqrt(1 - geodesy.E2 * np.sin(la) ** 2)
    xyz = np.stack([(n + h) * np.cos(la) * np.cos(lo), (n + h) * np.cos(la) * np.sin(lo), (n * (1 - geodesy.E2) + h) * np.sin(la)], axis=1)
    for r in seeds.collect():
        la, lo = np.radians(r.lat), np.radians(r.lon)
        m = geodesy.SEMI_MAJOR / np.sqrt(1 - geodesy.E2 * np.sin(la) ** 2)
        d = np.linalg.norm(xyz - [(m + r.height) * np.cos(la) * np.cos(lo), (m + r.height) * np.cos(la) * np.sin(lo), (m * (1 - geodesy.E2) + r.height) * np.sin(la)], axis=1)
        assert hits[r.seed_id].x == lon[d.argmin()]
        assert hits[r.seed_id].distance == pytest.approx(d.min(), abs=1e-6)
    text = "+proj=tmerc +lat_0=51 +lon_0=9 +k=1 +x_0=0 +y_0=0 +units=ft +vunits=ft"
    across, up, _ = wkt.units_of(text)
    placed = degrees.select(*[c.alias(a) for a, c in zip("xy", wkt.projection_of(text).forward(degrees.x, degrees.y), strict=True)], (degrees.z / up).alias("z"), "classification")
    feet = PointCloud.of(placed, 4000.0, 0, (-100.0, -100.0, 0.0), crs=text, unit=across, z_unit=up)
    near = {r.seed_id: r.distance for r in feet.snap_positions(seeds, ["x"]).collect()}
    assert near == pytest.approx({i: r.distance for i, r in hits.items()}, abs=2e-3)
