"""Files written here, read by runs, decoded and cut by filters."""

import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import GreaterThanOrEqual, LessThanOrEqual

from pointquarry.sinks import copc as sink
from pointquarry.sources import copc, las
from pointquarry.sources.copc_source import CopcReader, register, runs_of
from pointquarry.stores import store_uri


@pytest.fixture
def reads(monkeypatch):
    """Ranges that are read in this process."""
    seen, real = [], copc.read_range
    monkeypatch.setattr(copc, "read_range", lambda path, begin, end, **k: seen.append((begin, end)) or real(path, begin, end, **k))
    return seen


def sparse(path, n=10_000, gap_after=1000, gap=1 << 20):
    """A file whose root page names ``n`` pages of one node each, packed one after another with a gap after every ``gap_after``."""
    size = struct.calcsize(copc.ENTRY)
    at, page, pointers = 1 << 20, [], []
    for i in range(n):
        key = (5, i % 32, i // 32 % 32, i // 1024)
        page.append((at, struct.pack(copc.ENTRY, *key, 700, 10, i + 1)))
        pointers.append(struct.pack(copc.ENTRY, *key, at, size, -1))
        at += size + (gap if (i + 1) % gap_after == 0 else 0)
    root = b"".join(pointers)
    head = bytearray(copc.HEADER_BYTES)
    head[:4], head[377:381] = b"LASF", b"copc"
    struct.pack_into("<5d2Q", head, copc.INFO_AT, 16, 16, 16, 16, 1.0, 4096, len(root))
    with open(path, "wb") as f:
        for place, body in ((0, bytes(head)), (4096, root), *page):
            f.seek(place)
            f.write(body)
    return root


def test_pages_are_read_by_runs(spark, tmp_path, reads):
    root = sparse(tmp_path / "a.copc.laz")
    reader = CopcReader({"path": str(tmp_path)})
    rows = [r for part in reader.partitions() for r in reader.read(part)]
    assert sorted(r[8] for r in rows) == list(range(1, 10_001))
    assert len([r for r in reads if r[0] >= 1 << 20]) == 10
    assert (4096, 4096 + len(root)) in reads
    register(spark)
    assert spark.read.format("copc").load(str(tmp_path)).agg(F.sum("point_count")).first()[0] == 50_005_000


def test_a_pushed_box_reads_fewer_ranges(spark, tmp_path, reads):
    sparse(tmp_path / "a.copc.laz")
    counts = {}
    for name, filters in (("all", []), ("box", [LessThanOrEqual(("max_x",), 1.0), LessThanOrEqual(("min_z",), 0.5), LessThanOrEqual(("min_x",), 0.5)]), ("none", [GreaterThanOrEqual(("max_y",), 99.0)]), ("depth", [LessThanOrEqual(("d",), 4)])):
        reads.clear()
        reader = CopcReader({"path": str(tmp_path), "max_gap": "0"})
        assert list(reader.pushFilters(filters)) == filters
        rows = [r for part in reader.partitions() for r in reader.read(part)]
        counts[name] = (len(reads), len(rows))
    assert counts["box"][1] == 32
    assert counts["box"][0] > counts["all"][0] > counts["none"][0]  # 32 lone pages, 10 runs, none
    assert counts["none"] == counts["depth"]
    assert sum(e - b for b, e in reads) < 1000 + 32 * 10_000
    register(spark)
    box = spark.read.format("copc").load(str(tmp_path)).where("min_x <= 0.5 and min_z <= 0.5 and d <= 5")
    assert box.count() == 32
    assert spark.read.format("copc").load(str(tmp_path)).where("d = 4").count() == 0


def test_runs_have_both_limits():
    assert runs_of([(0, 10), (10, 10), (25, 5), (100, 1)], 5, 100) == [(0, 30), (100, 101)]
    assert runs_of([(0, 10), (10, 10), (20, 10)], 5, 20) == [(0, 20), (20, 30)]
    assert runs_of([(5, 50), (0, 100), (0, 100)], 0, 1000) == [(0, 100)]
    assert runs_of([], 1, 1) == []


def columns(n, seed):
    draw = np.random.default_rng(seed)
    whole = {c: draw.integers(0, m, n) for c, m in (("intensity", 1 << 16), ("return_number", 16), ("number_of_returns", 16), ("classification", 256), ("user_data", 256), ("point_source_id", 1 << 16), ("scanner_channel", 4), ("scan_direction", 2), ("edge_of_flight_line", 2), ("synthetic", 2), ("key_point", 2), ("withheld", 2), ("overlap", 2), ("red", 1 << 16), ("green", 1 << 16), ("blue", 1 << 16), ("nir", 1 << 16))}
    return whole | {"scan_angle": draw.integers(-30_000, 30_001, n), "gps_time": draw.random(n) * 1e9} | {a: draw.integers(-(1 << 31), 1 << 31, n) * 0.25 + 7.5 for a in "xyz"}


@pytest.mark.parametrize("form", [6, 7, 8])
@pytest.mark.parametrize("spare", [0, 5])
def test_records_come_back(form, spare):
    given = columns(500, form)
    raw, size = las.encoded(given, form, [0.25] * 3, [7.5] * 3), las.LAYOUTS[form].itemsize
    assert size == {6: 30, 7: 36, 8: 38}[form]
    wide = b"".join(raw[i * size : (i + 1) * size] + b"\xff" * spare for i in range(500))
    got = las.decoded(wide, 500, form, size + spare, [0.25] * 3, [7.5] * 3)
    for name, values in got.items():
        assert (values.astype(np.asarray(given[name]).dtype) == given[name]).all(), name


def test_wrong_records_raise():
    with pytest.raises(ValueError, match="not read"):
        las.decoded(b"", 0, 3, 34, [1] * 3, [0] * 3)
    with pytest.raises(ValueError, match="no codec"):
        las.decoded(b"", 0, 6, 30, [1] * 3, [0] * 3, "laz")
    with pytest.raises(ValueError, match="are not"):
        las.decoded(b"x" * 29, 1, 6, 30, [1] * 3, [0] * 3)
    with pytest.raises(ValueError, match="does not fit"):
        las.encoded({"x": np.array([1e12]), "y": np.zeros(1), "z": np.zeros(1)}, 6, [0.01] * 3, [0.0] * 3)
    las.register_codec("backwards", lambda raw, n, size: raw[::-1])
    given = {a: np.array([1.0, 2.0]) for a in "xyz"}
    raw = las.encoded(given, 6, [1.0] * 3, [0.0] * 3)
    assert las.decoded(raw[::-1], 2, 6, 30, [1.0] * 3, [0.0] * 3, "backwards")["y"].tolist() == [1.0, 2.0]
    del las.CODECS["backwards"]


def test_points_of_a_compressed_file_raise(spark, tmp_path):
    n = 4
    table = pa.table({**{c: np.zeros(n, np.int64) for c in ("d", "kx", "ky", "kz")}, **{a: np.arange(n) * 1.0 for a in "xyz"}})
    raw = bytearray(sink.file_bytes(table, (0.0, 0.0, 0.0), 8.0, 0.5, None, 6, 2))
    (tmp_path / "plain.copc.laz").write_bytes(raw)
    register(spark)
    load = lambda: spark.read.format("copc").option("table", "points").load(str(tmp_path))
    assert sorted(r.x for r in load().collect()) == [0.0, 1.0, 2.0, 3.0]
    raw[copc.FORM_AT] |= las.COMPRESSED
    (tmp_path / "plain.copc.laz").write_bytes(raw)
    with pytest.raises(Exception, match="no codec 'laz'"):
        load().collect()


def test_names_of_stores():
    assert store_uri("s3a://b/k") == "s3://b/k"
    assert store_uri("dbfs:/x/y") == "/dbfs/x/y"
    assert store_uri("file:/x") == store_uri("file:///x") == "/x"
    assert store_uri("wasbs://c@a.blob.core.windows.net/p") == "abfss://c@a.dfs.core.windows.net/p"
    assert store_uri("/x/a:b") == "/x/a:b"
    with pytest.raises(ValueError, match="no byte reader"):
        store_uri("what://x")


def test_more_returns_than_their_field_holds(spark, tmp_path):
    from pointquarry.sinks.copc import write_copc

    points = spark.range(40).selectExpr("0 as d", "0 as kx", "0 as ky", "0 as kz", "id * 1.0D as x", "0D as y", "0D as z", "cast(id as int) as return_number", "cast(id * 100 as int) as number_of_returns")
    write_copc(points, str(tmp_path), (0.0, 0.0, 0.0), 64.0, 0.5, crs="some text").collect()
    register(spark)
    got = spark.read.format("copc").option("table", "points").load(str(tmp_path)).select("x", "return_number", "number_of_returns").collect()
    assert sorted(tuple(r) for r in got) == [(float(i), i, i * 100) for i in range(40)]
    assert spark.read.format("copc").option("table", "headers").load(str(tmp_path)).first().crs == "some text"
    with pytest.raises(ValueError, match="number_of_returns does not fit"):
        las.encoded({a: np.zeros(1) for a in "xyz"} | {"number_of_returns": np.array([16])}, 6, [1.0] * 3, [0.0] * 3)


def test_ids_of_more_sources_than_their_field_holds(spark, tmp_path):
    from pointquarry.sinks.copc import write_copc

    points = spark.range(3).selectExpr("0 as d", "0 as kx", "0 as ky", "0 as kz", "id * 1.0D as x", "0D as y", "0D as z", "cast(65535 + id * 100000 as int) as point_source_id", "cast(id * 8 as int) as return_number")
    write_copc(points, str(tmp_path), (0.0, 0.0, 0.0), 64.0, 0.5).collect()
    register(spark)
    got = spark.read.format("copc").option("table", "points").load(str(tmp_path)).select("point_source_id", "return_number").collect()
    assert sorted(tuple(r) for r in got) == [(65535, 0), (165535, 8), (265535, 16)]


def test_points_are_planned_without_opening_files(tmp_path, reads, monkeypatch):
    n = 5000
    draw = np.random.default_rng(3)
    places = {c: draw.integers(0, 8, n) for c in ("kx", "ky", "kz")}
    table = pa.table({"d": np.full(n, 3), **places, **{a: np.arange(n) * 1.0 for a in "xyz"}})
    for name in "ab":
        (tmp_path / f"{name}.copc.laz").write_bytes(sink.file_bytes(table, (0.0, 0.0, 0.0), 8.0, 0.5, None, 6, 2))
    reader = CopcReader({"path": str(tmp_path), "table": "points", "run_bytes": "10000"})
    parts = reader.partitions()
    assert reads == []
    assert len(parts) > 20
    batches = [b for part in parts for b in reader.read(part)]
    assert sorted(x for b in batches for x in b.column("x").to_pylist()) == sorted([*range(n), *range(n)])
    # Nodes of a part come together, not a batch each.
    assert len(batches) <= len(parts)
    keys = {x: k for b in batches for x, k in zip(b.column("x").to_pylist(), b.column("node_key").to_pylist(), strict=True)}
    assert all(keys[i] == f"3-{x}-{y}-{z}" for i, (x, y, z) in enumerate(zip(*places.values(), strict=True)))


def test_files_hold_no_more_points_than_asked(spark, tmp_path):
    from pointquarry.sinks.copc import write_copc

    points = spark.range(0, 1000, 1, 3).selectExpr("0 as d", "0 as kx", "0 as ky", "0 as kz", "id * 1.0D as x", "0D as y", "0D as z")
    written = write_copc(points, str(tmp_path), (0.0, 0.0, 0.0), 1024.0, 0.5, file_points=100)
    assert "Exchange" not in written._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.points for r in written.collect()) == [33, 33, 34] + [100] * 9
    register(spark)
    assert sorted(r.x for r in spark.read.format("copc").option("table", "points").load(str(tmp_path)).collect()) == [float(i) for i in range(1000)]
    assert write_copc(points.limit(0), str(tmp_path / "none"), (0.0, 0.0, 0.0), 1024.0).collect() == []
