"""Columns against values known from the formats."""

import random

import pytest
from pyspark.sql import functions as F

from pointquarry.functions import colors, geodesy, numbers, transfer, wkt
from pointquarry.operators import curves, reproject, series, shading
from pointquarry.operators import tree
from pointquarry.operators.intervals import exact_ranges, greedy_runs, islands
from pointquarry.operators.orderstats import order_statistics, robust_range
from pointquarry.sources import clouds


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_rounding_and_truncation(spark):
    assert one(spark, *[numbers.half_up(F.lit(x)) for x in (2.5, -2.5, 0.49)]) == (3, -2, 0)
    assert one(spark, *[numbers.truncated(F.lit(x)) for x in (3.9, -3.9)]) == (3, -3)
    assert one(spark, *[numbers.or_default(F.lit(x), 1) for x in (0.0, float("nan"), 4.0)]) == (1.0, 1.0, 4.0)


def test_component_types(spark):
    assert numbers.component_range("SHORT") == (-32768, 32767)
    assert numbers.component_range("FLOAT") is None
    assert one(spark, numbers.wrapped(F.lit(300), "UNSIGNED_BYTE"), numbers.wrapped(F.lit(-1), "UNSIGNED_SHORT"), numbers.wrapped(F.lit(200), "BYTE")) == (44, 65535, -56)
    assert one(spark, numbers.aligned(F.lit(9), 8), numbers.aligned(F.lit(8), 8)) == (16, 8)


@pytest.mark.parametrize("size,want", [(100_000, 8000), (1 << 20, 8000), (5 << 20, 10000), (8 << 20, 16000)])
def test_timeouts(spark, size, want):
    assert one(spark, transfer.timeout_ms(F.lit(0), F.lit(size), 8000)) == (want,)


@pytest.mark.parametrize(
    "status,received,header,violation,retryable",
    [
        (200, 100, None, "range ignored", False),
        (206, 100, None, None, False),
        (206, 0, None, "cut short", True),
        (206, 50, "bytes 0-49/*", "cut short", True),
        (206, 101, None, "too many bytes", False),
        (206, 50, "bytes 0-49/50", None, False),
    ],
)
def test_range_contract(spark, status, received, header, violation, retryable):
    v = transfer.range_verdict(F.lit(0), F.lit(100), F.lit(status), F.lit(received), transfer.total_size(F.lit(header).cast("string")))
    assert one(spark, v["violation"], v["retryable"]) == (violation, retryable)


def test_paths(spark):
    parts = transfer.request_parts(F.lit("s1/page/2-0-1-3.json"))
    assert one(spark, parts["sid"], parts["kind"], parts["key"]) == ("s1", "page", "2-0-1-3")
    parts = transfer.request_parts(F.lit("s1/2-0-1-3.pnts"))
    assert one(spark, parts["kind"], parts["key"]) == ("tile", "2-0-1-3")
    assert one(spark, transfer.server_key(F.lit("https://a.example/x")), transfer.server_key(F.lit("http://a:8080/x"))) == ("a.example:443", "a:8080")
    assert one(spark, transfer.base_name(F.lit("http://a/b/c.js?x=1")), transfer.file_stem(F.lit("/d/cloud.copc.laz"))) == ("c.js", "cloud")
    assert one(spark, *[transfer.response_status(F.lit(o)) for o in ("empty", "json", "no client", "boom")]) == (404, 200, 503, 500)


def test_colors(spark):
    low, high = colors.ramp(F.lit(0.0), F.lit(0.0), F.lit(1.0)), colors.ramp(F.lit(1.0), F.lit(0.0), F.lit(1.0))
    assert one(spark, high["red"], high["green"], high["blue"]) == (255, 0, 0)
    assert one(spark, low["red"], low["green"], low["blue"]) == (0, 10, 255)
    assert one(spark, colors.class_color(F.lit(2))["red"], colors.class_color(F.lit(99))["red"]) == (166, 150)
    assert one(spark, colors.return_color(F.lit(0))["red"], colors.return_color(F.lit(12))["red"]) == (230, 240)
    assert one(spark, colors.eight_bit(F.lit(54272), F.lit(60000)), colors.eight_bit(F.lit(200), F.lit(255))) == (212, 200)
    assert one(spark, colors.ramp_style(F.lit(10.0), 0, 10), colors.ramp_style(F.lit(99.0), 0, 10)) == (colors.RAMP[-1],) * 2
    with pytest.raises(ValueError):
        colors.ramp_style(F.lit(1.0), 0, 1, [])


def test_color_mode_falls_back_to_height(spark):
    p = spark.createDataFrame([(1.0,), (2.0,)], "z double")
    assert {tuple(r.color) for r in shading.colored(p, "rgb").collect()} == {(0, 10, 255), (255, 0, 0)}


def test_geodesy(spark):
    x, y, z = one(spark, *geodesy.geocentric(F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    assert (x, y, z) == (6378137.0, 0.0, 0.0)
    assert one(spark, geodesy.geocentric(F.lit(12.0), F.lit(90.0), F.lit(0.0))[2])[0] == pytest.approx(6356752.314245, abs=1e-6)
    e, n = one(spark, *geodesy.utm(10).forward(F.lit(-123.0), F.lit(0.0)))
    assert (e, n) == pytest.approx((500000.0, 0.0), abs=1e-6)
    assert one(spark, geodesy.utm(31).forward(F.lit(3.0), F.lit(45.0))[1])[0] == pytest.approx(4982950.400, abs=0.01)
    near = one(spark, geodesy.source_metric(F.lit(3.0), F.lit(0.0), F.lit(0.0), 0.3048, 1.0), geodesy.source_metric(F.lit(0.0), F.lit(0.0), F.lit(1.0), 0.3048, 1.0))
    assert near[0] < near[1]
    assert one(spark, *[geodesy.wrapped_longitude(F.lit(v)) for v in (180.0, -190.0, 540.0)]) == (-180.0, 170.0, -180.0)
    with pytest.raises(Exception, match="out of range"):
        one(spark, geodesy.checked_position(F.lit(0.0), F.lit(91.0)))


def test_reference_systems(spark):
    assert wkt.chosen_system(None, "header", "default") == "header"
    assert wkt.chosen_system("forced", "header", None) == "forced"
    with pytest.raises(ValueError):
        wkt.chosen_system(None, "", None)
    assert wkt.projection_of("+proj=utm +zone=10 +units=m") == geodesy.utm(10)
    assert isinstance(wkt.projection_of("+proj=longlat"), geodesy.LongLat)
    with pytest.raises(ValueError):
        wkt.projection_of("+proj=krovak")
    utm = 'PROJCS["UTM 10N",GEOGCS["WGS 84",DATUM["D",SPHEROID["S",6378137,298.25]],UNIT["degree",0.0174]],PROJECTION["Transverse_Mercator"],PARAMETER["latitude_of_origin",0],PARAMETER["central_meridian",-123],PARAMETER["scale_factor",0.9996],PARAMETER["false_easting",500000],UNIT["metre",1]]'
    assert wkt.projection_of(utm) == geodesy.utm(10)
    assert wkt.projection_of(f'COMPD_CS["c",{utm},VERT_CS["v",UNIT["metre",1]]]') == geodesy.utm(10)
    newer = 'PROJCRS["c",BASEGEOGCRS["g"],CONVERSION["x",METHOD["Lambert Conic Conformal (2SP)",ID["EPSG",9802]],PARAMETER["Latitude of false origin",30],PARAMETER["Longitude of false origin",-90],PARAMETER["Latitude of 1st standard parallel",31],PARAMETER["Latitude of 2nd standard parallel",33],PARAMETER["Easting at false origin",100,LENGTHUNIT["foot",0.3048]]],CS[Cartesian,2],LENGTHUNIT["foot",0.3048]]'
    assert wkt.projection_of(newer) == geodesy.ConformalConic(31.0, 33.0, 30.0, -90.0, 100 * 0.3048, 0.0, 0.3048)
    assert isinstance(wkt.projection_of('GEOGCS["WGS 84",UNIT["degree",0.0174]]'), geodesy.LongLat)
    feet = wkt.projection_of("+proj=tmerc +lon_0=-123 +k=0.9996 +x_0=500000 +units=ft")
    lon, lat = one(spark, *feet.inverse(F.lit(500000 / 0.3048), F.lit(4e6 / 0.3048)))
    assert lon == pytest.approx(-123) and lat == pytest.approx(one(spark, geodesy.utm(10).inverse(F.lit(500000.0), F.lit(4e6))[1])[0])


def test_well_known_text_of_any_depth():
    deep = "A[" * 5000 + "1" + "]" * 5000
    assert wkt.units_of(f'PROJCS["p",{deep},UNIT["foot",0.3048]]') == (0.3048, 0.3048, False)
    assert wkt.units_of("") == wkt.units_of("]]][[") == (1.0, 1.0, False)
    assert wkt.tree_of('A["say ""x"" [1]",2]').nodes[0].parts == ['say "x" [1]', 2.0]


def test_grid_falls_back(spark):
    assert reproject.chosen_grid(spark, geodesy.LongLat(), (0.0, 0.0), (1.0, 1.0))[0] == 8
    assert reproject.chosen_grid(spark, geodesy.LongLat(), (0.0, 0.0), (0.0, 1.0)) is None
    assert reproject.chosen_grid(spark, geodesy.utm(10), (1e5, 1e5), (9e5, 9e6)) is None


def test_merging_of_ranges(spark):
    draw = random.Random(11)
    rows = [(i % 5, draw.randrange(4000), draw.choice([1, 7, 40, 900])) for i in range(300)]
    df = spark.createDataFrame(draw.sample(rows, len(rows)), "f int, off long, len long")
    for gap, most in ((0, 50), (13, 700), (90, 10**6)):
        want = []
        for f, off, size in sorted(rows):
            last = want[-1] if want and want[-1][0] == f else None
            if last and off - last[2] <= gap and max(last[2], off + size) - last[1] <= most:
                last[2:] = [max(last[2], off + size), last[3] + 1]
            else:
                want.append([f, off, off + size, 1])
        got = greedy_runs(df, gap, most, ["f"]).collect()
        assert sorted((r.f, r.run_start, r.run_end, r.n) for r in got) == [tuple(w) for w in want]


def test_order_statistics_by_brute_force(spark):
    values = [(k, float((i * 37 % 101) ** 2 % 97)) for k in "ab" for i in range(101 if k == "a" else 4)] + [("a", None), ("a", float("nan"))]
    got = {r.k: (r.n, r.p0, r.p5, r.p9) for r in order_statistics(spark.createDataFrame(values, "k string, v double"), "v", {"p0": 0.0, "p5": 0.5, "p9": 0.99}, ["k"]).collect()}
    for k in "ab":
        s = sorted(v for g, v in values if g == k and v is not None and v == v)
        assert got[k] == (len(s), s[0], s[len(s) // 2], s[min(len(s) - 1, int(0.99 * len(s)))])
    assert robust_range(spark.createDataFrame([(float(i),) for i in range(31)], "v double"), "v").first().lo is None


def test_curves(spark):
    runs = spark.createDataFrame([(r, float(i), 10.0 * (r + 1), 50.0 * (r + 1)) for r in range(2) for i in range(2)], "run int, a double, b double, points double")
    report = {r.axis: r for r in curves.axis_report(runs, "run", ["a", "b"], "points").collect()}
    assert report["b"].median == 40.0
    assert report["b"].per_million == pytest.approx(40.0 / 200.0 * 1e6)
    empty = spark.createDataFrame([], "pts double, median double")
    assert curves.noise_floor(empty, empty).first().floor == 0.0


def test_throttle_and_once(spark):
    owners = spark.createDataFrame([("h", 6), ("h", 12), ("h", 0), ("g", -1)], "host string, request_limit int")
    assert [(r.host, r.request_limit) for r in series.host_limits(owners).collect()] == [("h", 6)]
    answers = spark.createDataFrame([(1, 5, "late"), (1, 2, "first"), (2, 1, "only")], "req int, t int, what string")
    assert {r.req: r.what for r in series.answered_once(answers, "req", ["t"]).collect()} == {1: "first", 2: "only"}


def test_attributes_keep_order_and_repeats():
    found, missing = clouds.resolve_attributes(["X", "Y", "Z", "Intensity", "Custom"], ["Custom", "Nowhere", "Intensity", "Custom"])
    assert [(a.name, a.component_type) for a in found] == [("Custom", "FLOAT"), ("Intensity", "UNSIGNED_SHORT"), ("Custom", "FLOAT")]
    assert missing == ["Nowhere"]
    assert [a.name for a in clouds.resolve_attributes(["X", "Y", "Z", "Custom"], "all")[0]] == ["Custom"]


def test_hiding_classes(spark):
    p = spark.createDataFrame([(2,), (7,), (18,), (None,)], "classification int")
    assert clouds.visible(p).count() == 2
    assert clouds.visible(p, []).count() == 4
    assert clouds.visible(p.withColumnRenamed("classification", "c")).count() == 4


def test_a_packed_file_is_one_island_in_many_cells(spark):
    """A million ranges of one file without gaps."""
    n = 1_000_000
    ranges = spark.range(n).selectExpr("'a' as f", "id * 100 as off", "100L as len")
    runs = greedy_runs(ranges, 0, 1 << 20, ["f"])
    per = (1 << 20) // 100
    got = runs.agg(F.count("*"), F.sum("n"), F.max("n"), F.max("run_end")).first()
    assert tuple(got) == (-(-n // per), n, per, n * 100)
    assert islands(ranges, 0, ["f"]).agg(F.max("run")).first()[0] == 1


def test_islands_in_cells_equal_islands(spark):
    rng = random.Random(4)
    rows = [(f, rng.randrange(4000), rng.randrange(1, 60)) for f in "ab" for _ in range(150)]
    df = spark.createDataFrame(rows, "f string, off long, len long")
    want = {}
    for f in "ab":
        run, reach = 0, None
        for off, size in sorted((o, s) for g, o, s in rows if g == f):
            run += reach is None or off - reach > 5
            reach = max(reach or 0, off + size)
            want.setdefault((f, run), []).append((off, size))
    for width in (7, 500, 1 << 22):
        got = {}
        for r in islands(df, 5, ["f"], width).collect():
            got.setdefault((r.f, r.run), []).append((r.off, r.len))
        assert {k: sorted(v) for k, v in got.items()} == want


def test_exact_ranges_take_the_last_of_equal_offsets(spark):
    known = spark.createDataFrame([("a", 0, 10, 1), ("a", 0, 4, 2), ("a", 9, 3, 1)], "f string, off long, len long, at int")
    asked = spark.createDataFrame([("a", 0, 10), ("a", 0, 4), ("a", 9, 3), ("b", 9, 3)], "f string, off long, len long")
    assert sorted((r.off, r.len) for r in exact_ranges(asked, known, ["f"], "at").collect()) == [(0, 4), (9, 3)]


def test_regions_beyond_a_pole_raise(spark):
    good = spark.createDataFrame([(1.0, 90.0)], "lon double, lat double")
    assert tree.checked_samples(good, "lon", "lat").first().lat == 90.0
    with pytest.raises(Exception, match="out of range"):
        tree.checked_samples(spark.createDataFrame([(1.0, 90.5)], "lon double, lat double"), "lon", "lat").collect()
