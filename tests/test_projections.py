"""Projections against worked examples of public guidance, and back again."""

import math

import pytest
from pyspark.sql import functions as F

from pointquarry.functions import geodesy, projections, wkt


def degrees(d, m=0.0, s=0.0):
    return math.copysign(abs(d) + m / 60 + s / 3600, d)


#: Texts, a position in degrees on their own datum, and the published place.
EXAMPLES = {
    "tmerc with an origin": ("+proj=tmerc +lat_0=49 +lon_0=-2 +k=0.9996012717 +x_0=400000 +y_0=-100000 +ellps=airy", 0.5, 50.5, 577274.99, 69740.50),
    "mercator by scale": ("+proj=merc +lon_0=110 +k=0.997 +x_0=3900000 +y_0=900000 +ellps=bessel", 120.0, -3.0, 5009726.58, 569150.82),
    "mercator by parallel": ("+proj=merc +lon_0=51 +lat_ts=42 +ellps=krass", 53.0, 53.0, 165704.29, 5171848.07),
    "double stereographic": (f"+proj=sterea +lat_0={degrees(52, 9, 22.178)} +lon_0={degrees(5, 23, 15.5)} +k=0.9999079 +x_0=155000 +y_0=463000 +ellps=bessel", 6.0, 53.0, 196105.283, 557057.739),
    "north pole": ("+proj=stere +lat_0=90 +lon_0=0 +k=0.994 +x_0=2000000 +y_0=2000000", 44.0, 73.0, 3320416.75, 632668.43),
    "south pole": ("+proj=stere +lat_0=-90 +lat_ts=-71 +lon_0=70 +x_0=6000000 +y_0=6000000", 120.0, -75.0, 7255380.79, 7053389.56),
    "equal area": ("+proj=laea +lat_0=52 +lon_0=10 +x_0=4321000 +y_0=3210000 +ellps=GRS80", 5.0, 50.0, 3962799.45, 2999718.85),
    "albers": ("+proj=aea +lat_1=29.5 +lat_2=45.5 +lat_0=23 +lon_0=-96 +ellps=clrk66", -75.0, 35.0, 1885472.7, 1535925.0),
    "conic of one parallel": ("+proj=lcc +lat_1=18 +lat_0=18 +lon_0=-77 +k_0=1 +x_0=250000 +y_0=150000 +ellps=clrk66", degrees(-76, 56, 37.26), degrees(17, 55, 55.8), 255966.58, 142493.51),
    "oblique at its centre": (f"+proj=omerc +lat_0=4 +lonc=115 +alpha={degrees(53, 18, 56.9537)} +gamma={degrees(53, 7, 48.3685)} +k=0.99984 +x_0=590476.87 +y_0=442857.65 +a=6377298.556 +rf=300.8017", degrees(115, 48, 19.8196), degrees(5, 23, 14.1129), 679245.73, 596562.78),
    "oblique at its equator": (f"+proj=omerc +no_uoff +lat_0=4 +lonc=115 +alpha={degrees(53, 18, 56.9537)} +gamma={degrees(53, 7, 48.3685)} +k=0.99984 +a=6377298.556 +rf=300.8017", degrees(115, 48, 19.8196), degrees(5, 23, 14.1129), 679245.73, 596562.78),
}


@pytest.mark.parametrize("name", EXAMPLES)
def test_published_places(spark, name):
    text, lon, lat, x, y = EXAMPLES[name]
    p = wkt.projection_of(text)
    row = spark.createDataFrame([(lon, lat)], "lon double, lat double").select(*p.forward(F.col("lon"), F.col("lat"))).first()
    assert row[0] == pytest.approx(x, abs=0.06)
    assert row[1] == pytest.approx(y, abs=0.06)
    back = spark.createDataFrame([tuple(row)], "x double, y double").select(*p.inverse(F.col("x"), F.col("y"))).first()
    assert back[0] == pytest.approx(lon, abs=1e-10)
    assert back[1] == pytest.approx(lat, abs=1e-10)


@pytest.mark.parametrize("south", [False, True])
def test_cones_of_both_hemispheres(spark, south):
    sign = -1 if south else 1
    for text in (f"+proj=lcc +lat_1={sign * 30} +lat_2={sign * 44} +lat_0={sign * 20} +lon_0=140", f"+proj=aea +lat_1={sign * 30} +lat_2={sign * 44} +lat_0={sign * 20} +lon_0=140"):
        p = wkt.projection_of(text)
        rows = spark.range(50).select((F.col("id") * 0.4 + 130).alias("lon"), (F.col("id") * sign * 0.9 + sign * 5).alias("lat"))
        there = rows.select("lon", "lat", *[c.alias(n) for c, n in zip(p.forward(F.col("lon"), F.col("lat")), "xy", strict=True)])
        off = there.select(*[c.alias(n) for c, n in zip(p.inverse(F.col("x"), F.col("y")), ("lon1", "lat1"), strict=True)], "lon", "lat")
        worst = off.select(F.max(F.abs(F.col("lon1") - F.col("lon"))), F.max(F.abs(F.col("lat1") - F.col("lat")))).first()
        assert max(worst) < 1e-9


def test_datum_shift(spark):
    p = wkt.projection_of("+proj=tmerc +lat_0=49 +lon_0=-2 +k=0.9996012717 +x_0=400000 +y_0=-100000 +datum=OSGB36")
    assert isinstance(p, projections.Datum)
    lon, lat = -2.0, 53.0
    x, y = spark.range(1).select(*p.forward(F.lit(lon), F.lit(lat))).first()
    plain = spark.range(1).select(*p.inner.forward(F.lit(lon), F.lit(lat))).first()
    assert 20 < math.hypot(x - plain[0], y - plain[1]) < 200
    back = spark.range(1).select(*p.inverse(F.lit(x), F.lit(y))).first()
    # Heights are not kept, so that the way back is good to a millimetre or so.
    assert back[0] == pytest.approx(lon, abs=3e-8)
    assert back[1] == pytest.approx(lat, abs=3e-8)


def test_geodetic_of_geocentric(spark):
    rows = spark.range(400).select((F.col("id") * 0.89 - 179).alias("lon"), (F.col("id") * 0.45 - 89.9).alias("lat"), (F.col("id") * 50 - 500.0).alias("h"))
    xyz = rows.select("*", *[c.alias(n) for c, n in zip(geodesy.geocentric(F.col("lon"), F.col("lat"), F.col("h")), "xyz", strict=True)])
    back = xyz.select("lon", "lat", "h", *[c.alias(n) for c, n in zip(geodesy.geodetic(F.col("x"), F.col("y"), F.col("z")), ("lon1", "lat1", "h1"), strict=True)])
    worst = back.select(F.max(F.abs(F.col("lon") - F.col("lon1"))), F.max(F.abs(F.col("lat") - F.col("lat1"))), F.max(F.abs(F.col("h") - F.col("h1")))).first()
    assert worst[0] < 1e-12 and worst[1] < 9e-11 and worst[2] < 1e-5


def test_texts_name_their_projection():
    geographic = 'GEOGCS["NAD83",DATUM["D",SPHEROID["GRS 1980",6378137,298.257222101]],UNIT["degree",0.0174532925199433]]'
    text = f'PROJCS["a state zone",{geographic},PROJECTION["Transverse_Mercator"],PARAMETER["latitude_of_origin",31],PARAMETER["central_meridian",-110.1666666666667],PARAMETER["scale_factor",0.9999],PARAMETER["false_easting",700000],PARAMETER["false_northing",0],UNIT["foot",0.3048]]'
    found = wkt.projection_of(text)
    assert (found.inner.lat0, found.inner.x0, found.to_meter) == (31.0, 700000 * 0.3048, 0.3048)
    oblique = f'PROJCS["zone 1",{geographic},PROJECTION["Hotine_Oblique_Mercator"],PARAMETER["latitude_of_center",57],PARAMETER["longitude_of_center",-133.6666666666667],PARAMETER["azimuth",323.1301023611111],PARAMETER["rectified_grid_angle",323.1301023611111],PARAMETER["scale_factor",0.9999],PARAMETER["false_easting",5000000],PARAMETER["false_northing",-5000000],UNIT["metre",1]]'
    assert wkt.projection_of(oblique) == projections.ObliqueMercator(57.0, -133.6666666666667, 323.1301023611111, 323.1301023611111, 0.9999, 5e6, -5e6, True)
    shifted = 'GEOGCS["g",DATUM["D",SPHEROID["Bessel",6377397.155,299.1528128],TOWGS84[598.1,73.7,418.2,0.202,0.045,-2.455,6.7]],UNIT["degree",0.0174532925199433]]'
    assert wkt.projection_of(shifted).shift == (598.1, 73.7, 418.2, 0.202, 0.045, -2.455, 6.7)
    for wrong in ("+proj=krovak", "+proj=utm +zone=3 +datum=NAD27", "+proj=stere +lat_0=40 +lon_0=1"):
        with pytest.raises(ValueError):
            wkt.projection_of(wrong)
