"""Hierarchies of small files written here."""

import struct

import pytest

from pointquarry.sources import copc


def entry(d, x, y, z, off, size, n):
    return struct.pack(copc.ENTRY, d, x, y, z, off, size, n)


def cloud(path, deep=True):
    """A file with a root page, a page below it that is named twice, and one deeper still."""
    page2 = entry(5, 0, 0, 0, 900, 10, 7)
    page1 = entry(3, 1, 1, 1, 700, 10, 5) + (entry(4, 2, 2, 2, 5000, len(page2), -1) if deep else b"")
    root = entry(0, 0, 0, 0, 600, 100, 50) + entry(1, 0, 0, 1, 700, 20, 0) + entry(3, 1, 1, 1, 4000, len(page1), -1) * 2
    head = bytearray(copc.HEADER_BYTES)
    head[:4], head[377:381] = b"LASF", b"copc"
    struct.pack_into("<6d", head, copc.BOUNDS_AT, 10, 0, 20, 1, 30, 2)
    struct.pack_into("<Q", head, copc.COUNT_AT, 62)
    struct.pack_into("<5d2Q", head, copc.INFO_AT, 50, 50, 50, 50, 1.5, 3000, len(root))
    raw = bytearray(6000)
    for at, part in ((0, head), (3000, root), (4000, page1), (5000, page2)):
        raw[at : at + len(part)] = part
    path.write_bytes(raw)


def test_header_and_hierarchy(spark, tmp_path):
    cloud(tmp_path / "a.copc.laz")
    files = copc.paths_of(spark, str(tmp_path))
    h = copc.headers(files).first()
    assert (h.point_count, h.min, h.max, h.cube, h.spacing) == (62, [0.0, 1.0, 2.0], [10.0, 20.0, 30.0], [0.0, 0.0, 0.0, 100.0, 100.0, 100.0], 1.5)
    found = {(r.node_key, r.point_count, r.is_page) for r in copc.hierarchy(files).collect()}
    assert found == {("0-0-0-0", 50, False), ("1-0-0-1", 0, False), ("3-1-1-1", 5, False), ("5-0-0-0", 7, False)}


def test_a_cloud_is_opened_by_its_header(spark, tmp_path):
    from pointquarry.cloud import PointCloud

    cloud(tmp_path / "a.copc.laz")
    raw = bytearray((tmp_path / "a.copc.laz").read_bytes())
    text = b'PROJCS["m",GEOGCS["g"],PROJECTION["Popular_Visualisation_Pseudo_Mercator"],UNIT["metre",1]]'
    records = struct.pack(copc.RECORD, b"copc", 1, 160) + bytes(160) + struct.pack(copc.RECORD, copc.CRS_USER, copc.CRS_RECORD, len(text)) + text
    raw[5500 : 5500 + len(records)] = records
    struct.pack_into("<H", raw, copc.HEADER_SIZE_AT, 5500)
    struct.pack_into("<I", raw, copc.RECORDS_AT, 2)
    (tmp_path / "a.copc.laz").write_bytes(raw)
    header = copc.headers(copc.paths_of(spark, str(tmp_path))).first()
    assert header.crs == text.decode()
    points = spark.createDataFrame([(10.0, 20.0, 5.0, 2, 9), (99.0, 99.0, 99.0, 1, 3)], "x double, y double, z double, classification int, d int")
    opened = PointCloud.of_header(points, header, 4)
    assert sorted(r.node_key for r in opened.nodes.collect()) == ["3-7-7-7", "4-1-3-0"]
    lons = sorted(r.lon for r in opened.placed().collect())
    assert lons[0] == pytest.approx(10 / 6378137 * 57.29577951, abs=1e-9)
    moved = PointCloud.of(points.selectExpr("x + 5e5 as x", "y + 4e6 as y", "z", "classification", "d"), 100.0, 4, low=(5e5, 4e6, 0.0), default_crs="+proj=utm +zone=10")
    assert sorted(r.node_key for r in moved.nodes.collect()) == ["3-7-7-7", "4-1-3-0"]
    with pytest.raises(Exception, match="out of range"):
        PointCloud.of(points, 100.0, 4, low=(5e5, 4e6, 0.0), crs="+proj=longlat")


def test_depth_limit_keeps_the_pointer(spark, tmp_path):
    cloud(tmp_path / "a.copc.laz")
    found = {(r.node_key, r.is_page) for r in copc.hierarchy(copc.paths_of(spark, str(tmp_path)), max_depth=3).collect()}
    assert found == {("0-0-0-0", False), ("1-0-0-1", False), ("3-1-1-1", False), ("4-2-2-2", True)}


def test_failures(spark, tmp_path):
    (tmp_path / "b.copc.laz").write_bytes(b"x" * 1000)
    with pytest.raises(ValueError, match="no COPC file"):
        copc.header_of(str(tmp_path / "b.copc.laz"), copc.read_range)
    with pytest.raises(ValueError, match="of 10 bytes"):
        copc.read_range(str(tmp_path / "b.copc.laz"), 995, 1005)
    with pytest.raises(OSError):
        copc.read_range(str(tmp_path / "missing"), 0, 1, attempts=2, wait_s=0.0)
    with pytest.raises(ValueError, match="cut short"):
        list(copc.entries_of(b"x" * 33))
