"""Binary tiles and tile trees read back."""

import json

import numpy as np
import pytest

from pointquarry.operators import tree
from pointquarry.sinks import tiles, trees
from pointquarry.sources.clouds import Attribute

XYZ = np.array([[-2.5e6, -3.8e6, 4.4e6], [-2.50001e6, -3.80002e6, 4.40003e6]])
RGB = np.array([[255, 0, 0], [0, 255, 0]])


def test_bare_tile():
    t = tiles.parsed_tile(tiles.tile_bytes(XYZ, RGB, []))
    assert t["feature_bytes"] == 18
    assert np.abs(t["xyz"] - XYZ).max() <= (XYZ.max(axis=0) - XYZ.min(axis=0)).max() / 65535
    assert (t["rgb"] == RGB).all()


def test_tile_with_attributes():
    a = [(Attribute("Classification", "UNSIGNED_BYTE"), np.array([2.0, 6.0])), (Attribute("Intensity", "UNSIGNED_SHORT"), np.array([1000.0, 40000.0])), (Attribute("GpsTime", "DOUBLE"), np.array([0.5, 1.5]))]
    raw = tiles.tile_bytes(XYZ, RGB, a)
    t = tiles.parsed_tile(raw)
    assert len(raw) % 8 == 0
    assert {k: v.tolist() for k, v in t["attributes"].items()} == {"Classification": [2, 6], "Intensity": [1000, 40000], "GpsTime": [0.5, 1.5]}
    assert t["head"]["BATCH_LENGTH"] == 2


def test_values_wrap_and_lengths_must_agree():
    a = [(Attribute("Classification", "UNSIGNED_BYTE"), np.array([300.0, -1.0]))]
    assert tiles.parsed_tile(tiles.tile_bytes(XYZ, RGB, a))["attributes"]["Classification"].tolist() == [44, 255]
    with pytest.raises(ValueError):
        tiles.tile_bytes(XYZ, RGB[:1], [])


def test_empty_and_flat_tiles():
    assert tiles.parsed_tile(tiles.tile_bytes(np.zeros((0, 3)), np.zeros((0, 3)), []))["head"]["POINTS_LENGTH"] == 0
    assert tiles.parsed_tile(tiles.tile_bytes(XYZ[:1], RGB[:1], []))["head"]["QUANTIZED_VOLUME_SCALE"] == [1.0, 1.0, 1.0]


def test_tiles_of_a_cloud_hold_all_points(spark):
    rows = [(f"1-0-0-{k}", float(i), 44.0 + i / 1e4, float(k), k, i) for k in range(3) for i in range(50)]
    p = spark.createDataFrame(rows, "node_key string, lon double, lat double, h double, Classification int, i int")
    p = p.selectExpr("*", "named_struct('red', i, 'green', 0, 'blue', 255) as color")
    out = {r.node_key: r for r in tiles.point_tiles(p, [Attribute("Classification", "UNSIGNED_BYTE")], {"Classification": "Classification"}, ["i"]).collect()}
    assert {k: r.n for k, r in out.items()} == {f"1-0-0-{k}": 50 for k in range(3)}
    t = tiles.parsed_tile(bytes(out["1-0-0-2"].pnts))
    assert t["rgb"][:, 0].tolist() == list(range(50))
    assert set(t["attributes"]["Classification"].tolist()) == {2}


def test_tree(spark):
    nodes = spark.createDataFrame([("0-0-0-0", 0, 0, 0, 0), ("1-0-0-0", 1, 0, 0, 0), ("1-1-0-0", 1, 1, 0, 0)], "node_key string, d int, kx int, ky int, kz int")
    pages = spark.createDataFrame([("2-0-0-1", 2, 0, 0, 1)], "node_key string, d int, kx int, ky int, kz int")
    flat = tree.tiles(nodes, 200.0, "s/", pages).selectExpr("*", "array(0D, 0D, 1D, 1D, 0D, 9D) as region")
    doc = json.loads(trees.tileset(flat, 25.0).first().json)
    assert doc["root"]["geometricError"] == 12.5
    assert [c["content"]["uri"] for c in doc["root"]["children"]] == ["s/1-0-0-0.pnts", "s/1-1-0-0.pnts"]
    proxy = doc["root"]["children"][0]["children"][0]
    assert proxy["content"]["uri"] == "s/page/2-0-0-1.json"
    assert "children" not in proxy


def test_cloud_facade(spark, sf_dir, tmp_path):
    from pointquarry.cloud import PointCloud
    from pointquarry.sinks.reports import markdown, write_json
    from pointquarry.sources import clouds

    p = clouds.points(spark, sf_dir).selectExpr("490000 + x / 100 as x", "4870000 + y / 100 as y", "z / 100 as z", "classification", "intensity", "return_number", "number_of_returns", "red", "green", "blue", "d")
    p.selectExpr("x - 490000 as x", "y - 4870000 as y", "z", "* except (x, y, z)").write.parquet(str(tmp_path / "cloud"))
    cloud = PointCloud.open(spark, str(tmp_path / "cloud"), 1310.72, 4, default_crs="+proj=utm +zone=10", point_budget=1000, color_by="height")
    assert cloud.visible.count() <= 1000
    tile = cloud.tiles().first()
    assert tiles.parsed_tile(bytes(tile.pnts))["head"]["POINTS_LENGTH"] == tile.n
    seeds = spark.createDataFrame([(1, 300.0, 200.0, 500.0)], "seed_id long, x double, y double, z double")
    hit = cloud.snap(seeds, ["x", "y", "z", "classification"], 4).first()
    assert hit.classification not in (7, 18)
    assert {r.name for r in cloud.attribute_range(["z", "intensity"]).collect()} == {"z", "intensity"}
    asked = spark.createDataFrame([(hit.node_key, 0)], "node_key string, feature_id int")
    assert set(cloud.pick(asked, ["intensity"]).first().attributes) == {"intensity"}
    assert cloud.tile_tree(100.0, "s/").count() == cloud.nodes.count()
    assert markdown(cloud.attribute_range(["z"]), "Ranges").startswith("## Ranges\n\n| name | lo | hi |")
    write_json(cloud.attribute_range(["z"]), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 1
    with pytest.raises(ValueError):
        markdown(spark.range(10), "Long", most=5)


def test_pages_of_a_tree(spark):
    keys = ["0-0-0-0", "1-0-0-0", "1-1-0-0", "1-0-1-0", "2-0-0-0", "2-1-0-0", "3-0-0-0", "4-1-0-0", "6-9-9-9"]
    rows = [(k, *map(int, k.split("-")), [0.0] * 6) for k in keys]
    nodes = spark.createDataFrame([*rows, rows[1]], "node_key string, d int, kx int, ky int, kz int, region array<double>")
    docs = trees.page_documents(nodes, 160.0, "s/", levels=2)
    got = {r.page_key: json.loads(r.json) for r in docs.collect()}
    assert set(got) == {"0-0-0-0", "2-0-0-0", "2-1-0-0", "4-1-0-0", "6-9-9-9"}
    first = got["0-0-0-0"]
    assert (first["geometricError"], first["root"]["geometricError"]) == (20.0, 10.0)
    assert [c["content"]["uri"] for c in first["root"]["children"]] == ["s/1-0-0-0.pnts", "s/1-1-0-0.pnts", "s/1-0-1-0.pnts"]
    proxies = first["root"]["children"][0]["children"]
    assert [c["content"]["uri"] for c in proxies] == ["s/page/2-0-0-0.json", "s/page/2-1-0-0.json"]
    assert "children" not in proxies[0]
    second = got["2-0-0-0"]
    assert second["geometricError"] == second["root"]["geometricError"] == 2.5
    assert second["root"]["children"][0]["children"][0]["content"]["uri"] == "s/page/4-1-0-0.json"
    asked = spark.createDataFrame([("2-1-0-0",)], "page_key string")
    assert json.loads(trees.asked_documents(asked, docs).first().json) == got["2-1-0-0"]
    with pytest.raises(Exception, match="no such page: 9-9-9-9"):
        trees.asked_documents(spark.createDataFrame([("9-9-9-9",)], "page_key string"), docs).collect()
    assert trees.page_documents(nodes.limit(0), 160.0, "s/").collect() == []


def test_a_large_tile_is_packed_in_slices(spark):
    rows = [(f"0-0-0-{k}", float(i % 97) / 9, 44.0 + i / 1e4, float(k), 300.0 + i, (i * 7919) % 5000) for k, n in ((0, 5000), (1, 3)) for i in range(n)]
    p = spark.createDataFrame(rows, "node_key string, lon double, lat double, h double, Intensity double, i int").repartition(5)
    p = p.selectExpr("*", "named_struct('red', i % 256, 'green', 256 + i % 7, 'blue', 255) as color")
    found = [Attribute("Intensity", "UNSIGNED_SHORT"), Attribute("i", "INT")]
    args = (found, {"Intensity": "Intensity", "i": "i"}, ["i"])
    slices = tiles.tile_slices(p, *args, slice_points=300)
    held = slices.collect()
    assert sorted(r.first for r in held if r.node_key == "0-0-0-1") == [-1, 0]
    assert len(held) >= 2 + 17 + 1
    assert max(len(piece["bytes"]) for r in held for piece in r.pieces) < 6 * 300 + 1
    assert {(r.node_key, r.n, r.whole) for r in tiles.tile_sizes(slices).collect()} == {("0-0-0-0", 5000, True), ("0-0-0-1", 3, True)}
    cut = slices.where("first < 600 or first >= 900")
    assert {(r.node_key, r.whole) for r in tiles.tile_sizes(cut).collect()} == {("0-0-0-0", False), ("0-0-0-1", True)}
    # The pieces are the tile that is packed at once.
    own = {k: sorted((r for r in tiles.with_geocentric(p).collect() if r.node_key == k), key=lambda r: r.i) for k in ("0-0-0-0", "0-0-0-1")}
    for key, points in own.items():
        once = tiles.tile_bytes(np.array([[r.ex, r.ey, r.ez] for r in points]), np.array([[r.color.red, r.color.green, r.color.blue] for r in points]), [(a, np.array([float(r[a.name]) for r in points])) for a in found])
        assert tiles.joined([(x["at"], bytes(x["bytes"])) for r in held if r.node_key == key for x in r.pieces]) == once
    whole = tiles.point_tiles(p, *args)
    read = lambda df: sorted(tuple(r) for r in df.collect())
    assert read(tiles.slice_points(slices, found)) == read(tiles.tile_points(whole, found))


def test_points_stay_in_their_tasks_for_colors(spark):
    from pointquarry.operators.shading import true_colored

    p = spark.createDataFrame([("a", 256, 0, 512), ("a", 1, 2, 300), ("b", 7, 8, 9)], "node_key string, red int, green int, blue int")
    colored = true_colored(p)
    assert "Window" not in colored._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r.color) for r in colored.collect()) == [(0, 0, 1), (1, 0, 2), (7, 8, 9)]
