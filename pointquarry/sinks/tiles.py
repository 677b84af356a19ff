"""Binary point tiles: positions in 16 bits a coordinate, colours, attributes.

Numbers are computed as columns; only the packing of a tile's bytes runs in Python, over
columnar batches of one tile.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointquarry.functions.geodesy import geocentric
from pointquarry.functions.numbers import dequantised, or_default, quantised
from pointquarry.scratch import small, written
from pointquarry.sources.clouds import Attribute

HEADER = "<4s6I"
# The array type of each component type.
ARRAY_TYPES = {"BYTE": "<i1", "UNSIGNED_BYTE": "<u1", "SHORT": "<i2", "UNSIGNED_SHORT": "<u2", "INT": "<i4", "UNSIGNED_INT": "<u4", "FLOAT": "<f4", "DOUBLE": "<f8"}
AXES = ("ex", "ey", "ez")
#: Points of a slice of a tile, at most.
SLICE = 1 << 15


def with_geocentric(points: DataFrame) -> DataFrame:
    """Adds the geocentric ``ex``, ``ey`` and ``ez`` of lon, lat and h."""
    return points.withColumns(dict(zip(AXES, geocentric(*map(F.col, ("lon", "lat", "h"))), strict=True)))


def quantised_positions(points: DataFrame, by: str = "node_key") -> DataFrame:
    """Adds the tile's lower corner (``min_*``), extent (``ext_*``, 1 where it is 0) and ``q_*`` (0 to 65535)."""
    w, p = W.partitionBy(by), with_geocentric(points)
    p = p.withColumns({f"min_{a}": F.min(a).over(w) for a in AXES} | {f"max_{a}": F.max(a).over(w) for a in AXES})
    p = p.withColumns({f"ext_{a}": or_default(F.col(f"max_{a}") - F.col(f"min_{a}"), 1) for a in AXES})
    return p.withColumns({f"q_{a}": quantised(F.col(a), F.col(f"min_{a}"), F.col(f"ext_{a}")) for a in AXES})


def restored(quantised_: DataFrame) -> DataFrame:
    """Adds ``r_*``, the coordinates that a reader of a tile gets back."""
    return quantised_.withColumns({f"r_{a}": dequantised(F.col(f"q_{a}"), F.col(f"min_{a}"), F.col(f"ext_{a}")) for a in AXES})


def padded(text: dict, before: int) -> bytes:
    raw = json.dumps(text, separators=(",", ":")).encode()
    return raw + b" " * (-(before + len(raw)) % 8)


def frame(n: int, low: np.ndarray, high: np.ndarray, attributes: list[Attribute]) -> tuple[list[tuple[int, bytes]], list[tuple[int, int]], tuple[int, str] | None]:
    """What a tile of n points between two corners has beside their values: pieces (place, bytes), heads and padding; then
    (place, bytes of a point) of the positions, the colours and each attribute; and the place and type of the batch ids."""
    extent = np.where(high > low, high - low, 1.0)
    center = (low + high) / 2
    head = {
        "POINTS_LENGTH": n,
        "RTC_CENTER": center.tolist(),
        "QUANTIZED_VOLUME_OFFSET": (low - center).tolist(),
        "QUANTIZED_VOLUME_SCALE": extent.tolist(),
        "POSITION_QUANTIZED": {"byteOffset": 0},
        "RGB": {"byteOffset": 6 * n},
    }
    n_features, n_body, ids, layout, places = 9 * n, 0, None, {}, []
    if attributes and n:
        kind = "UNSIGNED_SHORT" if n <= 65536 - 1 else "UNSIGNED_INT"
        size = np.dtype(ARRAY_TYPES[kind]).itemsize
        ids = (9 * n + -(9 * n) % size, kind)
        n_features = ids[0] + n * size
        n_features += -n_features % 8
        head |= {"BATCH_LENGTH": n, "BATCH_ID": {"byteOffset": ids[0], "componentType": kind}}
        for a in attributes:
            size = np.dtype(ARRAY_TYPES[a.component_type]).itemsize
            n_body += -n_body % size
            layout[a.name] = {"byteOffset": n_body, "componentType": a.component_type, "type": "SCALAR"}
            places.append((n_body, size))
            n_body += n * size
    feature_head = padded(head, struct.calcsize(HEADER))
    features_at = struct.calcsize(HEADER) + len(feature_head)
    table = padded(layout, features_at + n_features) if layout else b""
    body_at = features_at + n_features + len(table)
    whole = body_at + n_body + -(body_at + n_body) % 8
    pieces = [(0, struct.pack(HEADER, b"pnts", 1, whole, len(feature_head), n_features, len(table), n_body) + feature_head), (features_at + n_features, table)]
    places = [(features_at, 6), (features_at + 6 * n, 3), *((body_at + at, size) for at, size in places)]
    ids = ids and (features_at + ids[0], ids[1])
    # Zeros stand where nothing else does.
    taken = sorted([(at, at + len(raw)) for at, raw in pieces] + [(at, at + n * size) for at, size in places] + ([(ids[0], ids[0] + n * np.dtype(ARRAY_TYPES[ids[1]]).itemsize)] if ids else []))
    ends = [0, *(end for _, end in taken)]
    return pieces + [(end, b"\0" * (at - end)) for end, at in zip(ends, [*(at for at, _ in taken), whole], strict=True) if at > end], places, ids


def typed(values: np.ndarray, a: Attribute) -> np.ndarray:
    """Values as an attribute stores them; whole numbers wrap."""
    dtype = np.dtype(ARRAY_TYPES[a.component_type])
    return values.astype(np.int64).astype(dtype) if dtype.kind in "iu" else values.astype(dtype)


def run_pieces(first: int, count: int, runs: list[bytes], places: list[tuple[int, int]], ids: tuple[int, str] | None) -> list[tuple[int, bytes]]:
    """Where the values of ``count`` points from the point ``first`` on belong, and their batch ids."""
    pieces = [(at + first * size, raw) for raw, (at, size) in zip(runs, places, strict=False)]
    if ids:
        own = np.arange(first, first + count, dtype=ARRAY_TYPES[ids[1]])
        pieces.append((ids[0] + first * own.itemsize, own.tobytes()))
    return pieces


def joined(pieces: list[tuple[int, bytes]]) -> bytes:
    """The tile of all its pieces; a gap between them or an overlap raises."""
    out = bytearray()
    for at, raw in sorted(pieces):
        if at != len(out):
            raise ValueError(f"a piece of a tile is at {at}, not {len(out)}")
        out += raw
    return bytes(out)


def tile_bytes(xyz: np.ndarray, rgb: np.ndarray, attributes: list[tuple[Attribute, np.ndarray]]) -> bytes:
    """One tile of n points: geocentric positions (n, 3), colours (n, 3), and attributes of n values each."""
    n = len(xyz)
    if len(rgb) != n or any(len(v) != n for _, v in attributes):
        raise ValueError("positions, colours and attributes differ in length")
    low, high = (xyz.min(axis=0), xyz.max(axis=0)) if n else (np.zeros(3), np.zeros(3))
    pieces, places, ids = frame(n, low, high, [a for a, _ in attributes])
    q = np.clip(np.floor((xyz - low) / np.where(high > low, high - low, 1.0) * 65535 + 0.5), 0, 65535).astype("<u2")
    runs = [q.tobytes(), rgb.astype("u1").tobytes(), *(typed(v, a).tobytes() for a, v in attributes)]
    return joined(pieces + run_pieces(0, n, runs, places, ids))


def parsed_tile(raw: bytes) -> dict:
    """The parts of a tile: its JSON heads, positions in metres, colours, attributes."""
    magic, version, size, n_fj, n_fb, n_bj, n_bb = struct.unpack_from(HEADER, raw)
    if magic != b"pnts" or version != 1 or size != len(raw):
        raise ValueError("no point tile")
    at = struct.calcsize(HEADER)
    head = json.loads(raw[at : at + n_fj])
    features = raw[at + n_fj : at + n_fj + n_fb]
    at += n_fj + n_fb
    layout = json.loads(raw[at : at + n_bj]) if n_bj else {}
    body, n = raw[at + n_bj : at + n_bj + n_bb], head["POINTS_LENGTH"]
    q = np.frombuffer(features, "<u2", 3 * n).reshape(-1, 3)
    xyz = q / 65535 * np.array(head["QUANTIZED_VOLUME_SCALE"]) + np.array(head["QUANTIZED_VOLUME_OFFSET"]) + np.array(head["RTC_CENTER"])
    rgb = np.frombuffer(features, "u1", 3 * n, 6 * n).reshape(-1, 3)
    return {"head": head, "xyz": xyz, "rgb": rgb, "attributes": {k: np.frombuffer(body, ARRAY_TYPES[v["componentType"]], n, v["byteOffset"]) for k, v in layout.items()}, "feature_bytes": n_fb}


def tile_slices(points: DataFrame, attributes: list[Attribute], columns: dict[str, str], order: list[str], by: str = "node_key", slice_points: int = SLICE) -> DataFrame:
    """Tiles of points with lon, lat, h and ``color`` in slices (key, n, first, pieces): of at most ``slice_points`` points from the point
    ``first`` of the tile on, and one with its heads and padding (``first`` is -1). A piece says where its bytes belong in the tile.

    ``columns`` says which column holds an attribute. Points of a tile are in ``order``. They are sorted by ranges of key and order and
    packed slice by slice, so a tile of any size goes over many tasks and none holds more than a slice; the sum of the slices before says
    where one belongs.
    """
    rows = with_geocentric(points)
    boxes = written(rows.groupBy(by).agg(F.count("*").alias("n"), *[f(a).alias(f"{m}_{a}") for a in AXES for f, m in ((F.min, "min"), (F.max, "max"))]), "boxes")
    boxed = small(boxes)
    q = [F.coalesce(quantised(F.col(a), F.col(f"min_{a}"), or_default(F.col(f"max_{a}") - F.col(f"min_{a}"), 1)).cast("long"), F.lit(0)) for a in AXES]
    rgb = [F.coalesce(F.col(f"color.{c}").cast("int"), F.lit(0)).bitwiseAND(F.lit(255)) for c in ("red", "green", "blue")]
    names = [columns[a.name] for a in attributes]
    # An attribute that is in the order goes along once.
    held = [f"o{order.index(c)}" if c in order else f"a{i}" for i, c in enumerate(names)]
    own = [F.col(c).cast("double").alias(h) for c, h in zip(names, held, strict=True) if h[0] == "a"]
    keys = [f"o{i}" for i in range(len(order))]
    packed_rows = rows.join(boxed, by).select(by, (q[0] + F.shiftleft(q[1], 16) + F.shiftleft(q[2], 32)).alias("q"), (rgb[0] + F.shiftleft(rgb[1], 8) + F.shiftleft(rgb[2], 16)).alias("rgb"), *own, *[F.col(c).alias(k) for c, k in zip(order, keys, strict=True)])
    dealt = packed_rows.repartitionByRange(by, *keys).sortWithinPartitions(by, *keys)

    def pack(key: str, batches: list[pa.RecordBatch], part: int, place: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches)
        runs = [t.column("q").to_numpy().astype("<i8").view("<u2").reshape(-1, 4)[:, :3].tobytes(), t.column("rgb").to_numpy().astype("<i4").view("u1").reshape(-1, 4)[:, :3].tobytes()]
        runs += [typed(t.column(h).to_numpy().astype(np.float64), a).tobytes() for h, a in zip(held, attributes, strict=True)]
        columns_ = [pa.array([key], pa.string()), pa.array([part], pa.int32()), pa.array([place], pa.int64()), pa.array([len(t)], pa.int64()), pa.array([runs], pa.list_(pa.binary()))]
        return pa.RecordBatch.from_arrays(columns_, ["node_key", "part", "place", "points", "runs"])

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, last, waiting, count = TaskContext.get().partitionId(), 0, None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            # Rows come in order of their keys: a tile ends where the key changes.
            codes = pc.fill_null(batch.column(by).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist()]
            for begin, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                key = batch.column(by)[begin].as_py()
                if count and key != last:
                    yield pack(last, waiting, part, place)
                    place, waiting, count = place + 1, [], 0
                last = key
                while begin < end:
                    waiting.append(batch.slice(begin, min(end - begin, slice_points - count)))
                    begin, count = begin + waiting[-1].num_rows, count + waiting[-1].num_rows
                    if count == slice_points:
                        yield pack(last, waiting, part, place)
                        place, waiting, count = place + 1, [], 0
        if count:
            yield pack(last, waiting, part, place)

    packed = written(dealt.mapInArrow(of_task, "node_key string, part int, place long, points long, runs array<binary>"), "slices")
    before = W.partitionBy("node_key").orderBy("part", "place").rowsBetween(W.unboundedPreceding, -1)
    known = packed.select("node_key", "part", "place", F.coalesce(F.sum("points").over(before), F.lit(0)).alias("first")).join(boxes.withColumnRenamed(by, "node_key"), "node_key").drop("node_key")
    corners = [f"{m}_{a}" for m in ("min", "max") for a in AXES]
    names_ = ["node_key", "n", "first", "pieces"]
    kind = pa.list_(pa.struct([("at", pa.int64()), ("bytes", pa.binary())]))

    def framed(row: dict) -> tuple:
        low, high = (np.array([row[f"{m}_{a}"] for a in AXES], float) for m in ("min", "max"))
        return frame(row["n"], low, high, attributes)

    def row_of(row: dict, first: int, pieces: list[tuple[int, bytes]]) -> pa.RecordBatch:
        held_ = pa.array([[{"at": at, "bytes": raw} for at, raw in pieces]], kind)
        return pa.RecordBatch.from_arrays([pa.array([row["node_key"]], pa.string()), pa.array([row["n"]], pa.int64()), pa.array([first], pa.int64()), held_], names_)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield row_of(row, -1, framed(row)[0])

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                _, places, ids = framed(row)
                yield row_of(row, row["first"], run_pieces(row["first"], row["points"], row["runs"], places, ids))

    schema = "node_key string, n long, first long, pieces array<struct<at:bigint,bytes:binary>>"
    placed_ = packed.join(small(known), ["part", "place"]).select("node_key", "n", "first", "points", "runs", *corners)
    return boxes.select(F.col(by).alias("node_key"), "n", *corners).mapInArrow(heads, schema).unionByName(placed_.mapInArrow(bodies, schema))


def point_tiles(points: DataFrame, attributes: list[Attribute], columns: dict[str, str], order: list[str], by: str = "node_key") -> DataFrame:
    """A row (key, n, pnts) per tile from points with lon, lat, h and ``color``, as ``tile_slices`` has them.

    A tile is one value of a row here, and one task's; slices have no such bound.
    """

    def whole(group: pa.Table) -> pa.Table:
        raw = joined([(p["at"], p["bytes"]) for pieces in group.column("pieces").to_pylist() for p in pieces])
        return pa.table({"node_key": group.column("node_key")[:1], "n": group.column("n")[:1], "pnts": pa.array([raw], pa.binary())})

    return tile_slices(points, attributes, columns, order, by).groupBy("node_key").applyInArrow(whole, "node_key string, n long, pnts binary")


def tile_sizes(slices: DataFrame) -> DataFrame:
    """A row (key, n, bytes, whole) per tile in slices: ``whole`` if the pieces follow each other from the magic word to the size in the header."""
    p = slices.select("node_key", "n", F.explode(F.transform("pieces", lambda p: F.struct(p["at"].alias("at"), F.octet_length(p["bytes"]).cast("long").alias("size"), F.when(p["at"] == 0, F.hex(F.substring(p["bytes"], 1, 12))).alias("head")))).alias("p")).select("node_key", "n", "p.*").where("size > 0")
    follows = F.col("at") == F.lag(F.col("at") + F.col("size"), 1, 0).over(W.partitionBy("node_key").orderBy("at"))
    stated = F.conv(F.concat(*[F.substring("head", 17 + 2 * i, 2) for i in (3, 2, 1, 0)]), 16, 10).cast("long")
    tiles = p.withColumn("follows", follows).groupBy("node_key").agg(F.first("n").alias("n"), F.sum("size").alias("bytes"), F.min("follows").alias("follow"), F.max("head").alias("head"))
    return tiles.select("node_key", "n", "bytes", (F.col("follow") & F.startswith("head", F.lit("706E7473")) & (stated == F.col("bytes"))).alias("whole"))


def slice_points(slices: DataFrame, attributes: list[Attribute]) -> DataFrame:
    """The points that a reader finds in tiles in slices, by the places that the heads name: as ``tile_points`` gives them."""
    names = [a.name for a in attributes]
    heads = slices.where("first < 0").select("node_key", F.filter("pieces", lambda p: F.octet_length(p["bytes"]) > 0).alias("heads"))

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                head, own = ({p["at"]: p["bytes"] for p in row[c]} for c in ("heads", "pieces"))
                magic, version, _, n_fj, n_fb, n_bj, _ = struct.unpack_from(HEADER, head[0])
                if magic != b"pnts" or version != 1:
                    raise ValueError("no point tile")
                at = struct.calcsize(HEADER)
                feature, at = json.loads(head[0][at : at + n_fj]), at + n_fj
                layout = json.loads(head[at + n_fb]) if n_bj else {}
                places = [(at + feature["POSITION_QUANTIZED"]["byteOffset"], "<u2", 3), (at + feature["RGB"]["byteOffset"], "u1", 3)]
                places += [(at + n_fb + n_bj + layout[a]["byteOffset"], ARRAY_TYPES[layout[a]["componentType"]], 1) for a in names]
                q, rgb, *values = (np.frombuffer(own[begin + row["first"] * np.dtype(kind).itemsize * width], kind).reshape(-1, width) for begin, kind, width in places)
                xyz = q / 65535 * np.array(feature["QUANTIZED_VOLUME_SCALE"]) + np.array(feature["QUANTIZED_VOLUME_OFFSET"]) + np.array(feature["RTC_CENTER"])
                columns = [*xyz.T, *rgb.T.astype(np.int32), *[v[:, 0].astype(np.float64) for v in values]]
                yield pa.RecordBatch.from_arrays([pa.array([row["node_key"]] * len(xyz), pa.string()), *[pa.array(v) for v in columns]], ["node_key", "x", "y", "z", "red", "green", "blue", *names])

    kinds = ", ".join([*[f"{a} double" for a in "xyz"], *[f"{c} int" for c in ("red", "green", "blue")], *[f"`{a}` double" for a in names]])
    return slices.where("first >= 0").join(small(heads), "node_key").mapInArrow(of_task, f"node_key string, {kinds}")


def tile_points(tiles: DataFrame, attributes: list[Attribute]) -> DataFrame:
    """The points that a reader finds in tiles (node_key, pnts): x, y, z, red, green, blue and ``attributes`` as doubles."""
    names = [a.name for a in attributes]

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, raw in zip(batch.column("node_key"), batch.column("pnts"), strict=True):
                t = parsed_tile(raw.as_py())
                values = [*t["xyz"].T, *t["rgb"].T.astype(np.int32), *[t["attributes"][a].astype(np.float64) for a in names]]
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(t["xyz"]), pa.string()), *[pa.array(v) for v in values]], ["node_key", "x", "y", "z", "red", "green", "blue", *names])

    kinds = ", ".join([*[f"{a} double" for a in "xyz"], *[f"{c} int" for c in ("red", "green", "blue")], *[f"`{a}` double" for a in names]])
    return tiles.select("node_key", "pnts").mapInArrow(of_task, f"node_key string, {kinds}")
