"""Point clouds as COPC files with plain point records: an octree per file, pages of its hierarchy, chunks of its nodes."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointquarry.sources import copc, las
from pointquarry.stores import opened

# Fixed values of the public format: lengths of the header and of the heads of records, and places of further fields.
HEADER, RECORD_HEAD, LONG_HEAD, INFO = 375, 54, 60, 160
VERSION_AT, DATA_AT, LONG_AT, RETURNS_AT = 24, 96, 235, 255
#: Points of a file, and the depth below which each subtree has a page of its own.
FILE_POINTS, PAGE_DEPTH = 1 << 20, 2
COLUMNS = {"x": "double", "y": "double", "z": "double", "intensity": "int", "return_number": "int", "number_of_returns": "int", "classification": "int", "point_source_id": "int", "gps_time": "double", "red": "int", "green": "int", "blue": "int"}


def record(user: bytes, kind: int, body: bytes, layout: str = copc.RECORD) -> bytes:
    return struct.pack(layout, user, kind, len(body)) + body


def pages(chunks: list[tuple[tuple[int, int, int, int], int, int, int]], at: int, page_depth: int) -> tuple[bytes, int]:
    """The pages of a hierarchy that begin at ``at``, and the length of the first. A chunk is (key, offset, length, points)."""
    first, below = [], {}
    for key, *rest in chunks:
        d = key[0]
        if d < page_depth:
            first.append((*key, *rest))
        else:
            up = (page_depth, *(k >> (d - page_depth) for k in key[1:]))
            below.setdefault(up, []).append((*key, *rest))
    size = struct.calcsize(copc.ENTRY)
    at += size * (len(first) + len(below))
    bodies = []
    for up, rows in sorted(below.items()):
        body = b"".join(struct.pack(copc.ENTRY, *r) for r in rows)
        first.append((*up, at, len(body), -1))
        bodies.append(body)
        at += len(body)
    return b"".join([*(struct.pack(copc.ENTRY, *r) for r in first), *bodies]), size * len(first)


def file_bytes(points: pa.Table, low: tuple[float, float, float], side: float, scale: float, crs: str | None, form: int, page_depth: int) -> bytes:
    """A whole file. Points are in the order of their nodes; the hierarchy is an extended record at the end. Counts of returns and ids
    of sources that are too large for their field stand in extra bytes of the records, beside the most that the field holds."""
    keys = np.stack([points.column(c).to_numpy() for c in ("d", "kx", "ky", "kz")], axis=1).astype(np.int64)
    order = np.lexsort(keys.T[::-1])
    columns = {c: points.column(c).to_numpy()[order] for c in COLUMNS if c in points.column_names}
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
    ends = np.append(starts[1:], len(keys))
    extra = las.too_wide(columns)
    raw = las.encoded(columns, form, [scale] * 3, list(low), extra)
    size = len(raw) // len(keys)
    records = [record(copc.CRS_USER, copc.CRS_RECORD, crs.encode() + b"\0")] if crs else []
    if extra:
        records.append(record(copc.EXTRA_USER, copc.EXTRA_RECORD, b"".join(struct.pack(copc.EXTRA, las.WIDE_TYPE, 0, c.encode()) for c in extra)))
    data_at = HEADER + RECORD_HEAD + INFO + sum(map(len, records))
    evlr_at = data_at + len(raw)
    page_at = evlr_at + LONG_HEAD
    chunks = [(tuple(keys[a].tolist()), data_at + a * size, (b - a) * size, b - a) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    hierarchy, first = pages(chunks, page_at, page_depth)
    head = bytearray(HEADER)
    head[:4], head[VERSION_AT : VERSION_AT + 2] = b"LASF", bytes([1, 4])
    struct.pack_into("<H", head, copc.HEADER_SIZE_AT, HEADER)
    struct.pack_into("<2I", head, DATA_AT, data_at, 1 + len(records))
    struct.pack_into("<BH", head, copc.FORM_AT, form, size)
    struct.pack_into("<3d", head, copc.SCALE_AT, *[scale] * 3)
    struct.pack_into("<3d", head, copc.OFFSET_AT, *low)
    struct.pack_into("<6d", head, copc.BOUNDS_AT, *(f(columns[a]) for a in "xyz" for f in (np.max, np.min)))
    struct.pack_into("<QI", head, LONG_AT, evlr_at, 1)
    struct.pack_into("<Q", head, copc.COUNT_AT, len(keys))
    returns = np.bincount(np.clip(columns.get("return_number", np.zeros(len(keys), int)), 0, 15), minlength=16)[1:16]
    struct.pack_into("<15Q", head, RETURNS_AT, *returns.tolist())
    half = side / 2
    info = struct.pack("<5d2Q", *(v + half for v in low), half, side / 128, page_at, first).ljust(INFO, b"\0")
    return b"".join([bytes(head), record(b"copc", 1, info), *records, raw, record(b"copc", 1000, hierarchy, copc.LONG_RECORD), hierarchy])


def write_copc(points: DataFrame, folder: str, low: tuple[float, float, float], side: float, scale: float = 0.01, crs: str | None = None, form: int = 7, file_points: int = FILE_POINTS, page_depth: int = PAGE_DEPTH) -> DataFrame:
    """Write points with their places in the octree (``d``, ``kx``, ``ky``, ``kz``) to files of at most ``file_points`` each, and return
    (path, points, bytes) of each file.

    A file holds a part of the points of any node and is an octree of its own, so no node is too large for a task: a task holds one file's
    points. A task writes its rows as they come, a file after another, so nothing is shuffled. Columns not in ``COLUMNS`` are left out,
    missing ones are zero; coordinates become whole multiples of ``scale``. Null values raise. Without points there are no files.
    """
    held = points.select("d", "kx", "ky", "kz", *[F.col(c).cast(t).alias(c) for c, t in COLUMNS.items() if c in points.columns])

    def write(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        if any(c.null_count for c in table.columns):
            raise ValueError("a point with a null value cannot be written")
        raw = file_bytes(table, low, side, scale, crs, form, page_depth)
        path = f"{folder}/{uuid.uuid4().hex}.copc.laz"
        system, inner = opened(path)
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        with system.open_output_stream(inner) as f:
            f.write(raw)
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([table.num_rows], pa.int64()), pa.array([len(raw)], pa.int64())], ["path", "points", "bytes"])

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, count = [], 0
        for batch in batches:
            while batch.num_rows:
                rows.append(batch.slice(0, file_points - count))
                count += rows[-1].num_rows
                batch = batch.slice(rows[-1].num_rows)
                if count == file_points:
                    yield write(rows)
                    rows, count = [], 0
        if rows:
            yield write(rows)

    return held.mapInArrow(of_task, "path string, points long, bytes long")
