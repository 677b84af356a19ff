"""Octree headers and hierarchies of Cloud-Optimized Point Cloud files.

Spark lists the files and their bytes are read by ranges on the executors: a header, the
pages of the hierarchy, nothing else. Point data stay compressed, as no LAZ codec is at hand.
"""

from __future__ import annotations

import struct
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pointquarry.sources.http import reader_of
from pointquarry.sources.las import EXTRA_TYPES, LAYOUTS, WIDE
from pointquarry.stores import opened

# Fixed values of the public format: the length of the header part read, places in it, and the layout of its fields.
HEADER_BYTES = 589
INFO_AT = 429
ENTRY = "<4iQ2i"
HEADER_SIZE_AT, RECORDS_AT, LONG_RECORDS_AT = 94, 100, 235
RECORD, LONG_RECORD = "<2x16sHH32x", "<2x16sHQ32x"
CRS_USER, CRS_RECORD = b"LASF_Projection", 2112
EXTRA_USER, EXTRA_RECORD, EXTRA = b"LASF_Spec", 4, "<2xBB32s156x"
FORM_AT, RECORD_AT = 104, 105
SCALE_AT, OFFSET_AT, BOUNDS_AT, COUNT_AT = 131, 155, 179, 247

ReadRange = Callable[[str, int, int], bytes]


def read_range(path: str, begin: int, end: int, attempts: int = 4, wait_s: float = 0.3) -> bytes:
    """Bytes [begin, end) of a file; failures of the store are tried again, a short answer is an error. URLs are
    read by HTTP, with its own policy."""
    for k in range(attempts):
        try:
            if path.startswith(("http://", "https://")):
                data = reader_of(path).read(begin, end)
                break
            system, inner = opened(path)
            with system.open_input_file(inner) as f:
                data = f.read_at(end - begin, begin)
            break
        except OSError:
            if k + 1 == attempts or path.startswith(("http://", "https://")):
                raise
            time.sleep(min(3.0, wait_s * 2**k))
    if len(data) != end - begin:
        raise ValueError(f"{path}: {len(data)} of {end - begin} bytes at {begin}")
    return data


def records_of(path: str, raw: bytes, reader: ReadRange) -> Iterator[tuple[bytes, int, int, int]]:
    """User, kind, place and size of each record behind the header and at the end of the file. Only the heads of records are read."""
    starts = [(struct.unpack_from("<H", raw, HEADER_SIZE_AT)[0], struct.unpack_from("<I", raw, RECORDS_AT)[0], RECORD)]
    starts.append((*struct.unpack_from("<QI", raw, LONG_RECORDS_AT), LONG_RECORD))
    for at, n, layout in starts:
        head = struct.calcsize(layout)
        for _ in range(n):
            user, kind, size = struct.unpack(layout, reader(path, at, at + head))
            yield user.rstrip(b"\0"), kind, at + head, size
            at += head + size


def crs_of(path: str, raw: bytes, reader: ReadRange) -> str | None:
    """The reference system in well-known text, from the records behind the header or at the
    end of the file; null without one. Only the heads of records are read, and the text."""
    for user, kind, at, size in records_of(path, raw, reader):
        if user == CRS_USER and kind == CRS_RECORD:
            return reader(path, at, at + size).rstrip(b"\0").decode() or None if size else None
    return None


def extra_of(path: str, raw: bytes, reader: ReadRange) -> list[tuple[str, str, int]]:
    """Columns of ``WIDE`` that extra bytes of the records hold whole: (column, type, place in the record)."""
    form, record = struct.unpack_from("<BH", raw, FORM_AT)
    form &= 0x3F
    if form not in LAYOUTS or record == LAYOUTS[form].itemsize:
        return []
    found, place = [], LAYOUTS[form].itemsize
    for user, kind, at, size in records_of(path, raw, reader):
        if user == EXTRA_USER and kind == EXTRA_RECORD:
            for number, options, name in struct.iter_unpack(EXTRA, reader(path, at, at + size)):
                column, known = name.rstrip(b"\0").decode("latin-1"), EXTRA_TYPES.get(number)
                if column in WIDE and known:
                    found.append((column, known, place))
                place += int(known[-1]) if known else options
    return found


def header_of(path: str, reader: ReadRange) -> dict:
    raw = reader(path, 0, HEADER_BYTES)
    if raw[:4] != b"LASF" or raw[377:381] != b"copc":
        raise ValueError(f"{path} is no COPC file")
    bounds = struct.unpack_from("<6d", raw, BOUNDS_AT)  # max and min of x, y, z in turn
    x, y, z, half, spacing, page_off, page_len = struct.unpack_from("<5d2Q", raw, INFO_AT)
    return {
        "path": path,
        "point_count": struct.unpack_from("<Q", raw, COUNT_AT)[0],
        "scale": list(struct.unpack_from("<3d", raw, SCALE_AT)),
        "offset": list(struct.unpack_from("<3d", raw, OFFSET_AT)),
        "min": list(bounds[1::2]),
        "max": list(bounds[0::2]),
        "cube": [x - half, y - half, z - half, x + half, y + half, z + half],
        "spacing": spacing,
        "page_off": page_off,
        "page_len": page_len,
        "crs": crs_of(path, raw, reader),
    }


def point_header_of(path: str, reader: ReadRange) -> dict:
    """The header with the format of point records, their length, and the columns in their extra bytes."""
    raw = reader(path, 0, HEADER_BYTES)
    return header_of(path, reader) | {"form": raw[FORM_AT], "record": struct.unpack_from("<H", raw, RECORD_AT)[0], "extra": extra_of(path, raw, reader)}


def entries_of(raw: bytes) -> Iterator[tuple[int, ...]]:
    if len(raw) % struct.calcsize(ENTRY):
        raise ValueError("a page of the hierarchy is cut short")
    return struct.iter_unpack(ENTRY, raw)


HEADER_SCHEMA = "path string, point_count long, scale array<double>, offset array<double>, min array<double>, max array<double>, cube array<double>, spacing double, page_off long, page_len long, crs string"
ENTRY_SCHEMA = "path string, node_key string, d int, x int, y int, z int, off long, len long, point_count long, is_page boolean"


def paths_of(spark: SparkSession, folder: str, pattern: str = "*.copc.laz") -> DataFrame:
    """The files below a folder, as Spark lists them; their contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length")


def headers(files: DataFrame, reader: ReadRange = read_range) -> DataFrame:
    """A row per file: bounds, cube, spacing, the place of the first hierarchy page, the reference system."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in HEADER_SCHEMA.split(", ")]
        for batch in batches:
            rows = [header_of(p, reader) for p in batch.column("path").to_pylist()]
            kinds = [pa.string(), pa.int64(), *[pa.list_(pa.float64())] * 5, pa.float64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

    return files.select("path").mapInArrow(of_task, HEADER_SCHEMA)


def page_entries(pages: DataFrame, reader: ReadRange = read_range) -> DataFrame:
    """Nodes and page pointers in the given pages (``path``, ``page_off``, ``page_len``)."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, off, size in zip(*(batch.column(c).to_pylist() for c in ("path", "page_off", "page_len")), strict=True):
                rows = list(entries_of(reader(path, off, off + size)))
                d, x, y, z, at, n_bytes, count = zip(*rows, strict=True) if rows else [()] * 7
                columns = [pa.array([path] * len(rows)), pa.array(["-".join(map(str, r[:4])) for r in rows], pa.string())]
                columns += [pa.array(c, pa.int32()) for c in (d, x, y, z)] + [pa.array(c, pa.int64()) for c in (at, n_bytes, count)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([c < 0 for c in count], pa.bool_())], [c.split()[0] for c in ENTRY_SCHEMA.split(", ")])

    return pages.select("path", "page_off", "page_len").mapInArrow(of_task, ENTRY_SCHEMA)


def hierarchy(files: DataFrame, max_depth: int | None = None, reader: ReadRange = read_range) -> DataFrame:
    """All nodes of the files, and the pointers to pages deeper than ``max_depth``.

    Pages are followed level by level, each level read in parallel and each page once. A
    level is cached, so no page is read again; the driver only learns whether there is another.
    """
    from pyspark.sql import functions as F

    todo = headers(files, reader).select("path", "page_off", "page_len")
    found, seen = None, None
    while True:
        level = page_entries(todo, reader).persist()
        nodes = level.where("not is_page")
        deep = level.where("is_page" if max_depth is None else f"is_page and d <= {max_depth}")
        left = level.where("false" if max_depth is None else f"is_page and d > {max_depth}")
        part = nodes.unionByName(left)
        found = part if found is None else found.unionByName(part)
        seen = todo if seen is None else seen.unionByName(todo)
        todo = deep.select("path", F.col("off").alias("page_off"), F.col("len").alias("page_len")).distinct().join(seen, ["path", "page_off", "page_len"], "left_anti")
        if todo.isEmpty():
            return found
