"""``spark.read.format("copc")``: headers, nodes and points of COPC files, read by planned ranges.

``register(spark)`` makes it known to a session and lets filters be pushed to it. Options: ``path`` (a file or a folder, as ``load`` sets it),
``table`` (``nodes``, ``headers`` or ``points``), ``codec`` of compressed points, ``max_gap`` and ``max_bytes`` of a read, and ``run_bytes`` of a
partition of points. Filters on the depth ``d`` and on the sides of nodes' boxes (``min_x`` to ``max_z``) cut pages before they are read and
nodes of which points would be; Spark applies them again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from pointquarry.sources import copc, las
from pointquarry.stores import opened

SIDES = ("min_x", "min_y", "min_z", "max_x", "max_y", "max_z")
NODES = "path string, node_key string, d int, x int, y int, z int, off long, len long, point_count long, " + ", ".join(f"{s} double" for s in SIDES)
POINTS = "path string, node_key string, d int, x double, y double, z double, intensity int, return_number int, number_of_returns int, classification int, scan_angle int, user_data int, point_source_id int, gps_time double, withheld boolean, overlap boolean, red int, green int, blue int, nir int, " + ", ".join(f"{s} double" for s in SIDES)


#: Points that a batch has at least, but for the last of a part.
BATCH = 1 << 15


def runs_of(ranges: Iterable[tuple[int, int]], max_gap: int, max_bytes: int) -> list[tuple[int, int]]:
    """Reads that cover all ranges (offset, length): in the order of offsets a range joins the read before it where the gap
    and the whole are not too long."""
    found: list[list[int]] = []
    for at, size in sorted(set(ranges)):
        if found and at - found[-1][1] <= max_gap and at + size - found[-1][0] <= max_bytes:
            found[-1][1] = max(found[-1][1], at + size)
        else:
            found.append([at, at + size])
    return [tuple(r) for r in found]


def by_runs(path: str, ranges: list[tuple[int, int]], max_gap: int, max_bytes: int) -> Iterator[tuple[tuple[int, int], bytes]]:
    """The bytes of each range, read by runs, each run once."""
    todo, i = sorted(set(ranges)), 0
    for begin, end in runs_of(todo, max_gap, max_bytes):
        raw = copc.read_range(path, begin, end)
        while i < len(todo) and todo[i][0] + todo[i][1] <= end and todo[i][0] >= begin:
            at, size = todo[i]
            yield todo[i], raw[at - begin : at - begin + size]
            i += 1


def sides_of(cube: list[float], d: int, x: int, y: int, z: int) -> tuple[float, ...]:
    side = (cube[3] - cube[0]) / (1 << d)
    low = [c + k * side for c, k in zip(cube[:3], (x, y, z), strict=True)]
    return (*low, *(c + side for c in low))


@dataclass
class Cut:
    """What filters say of depths and boxes. What is below a page is not shallower and not outside its box, so a page that fails is not read."""

    least_d: int = 0
    most_d: int = 1 << 31
    below: dict | None = None
    above: dict | None = None

    @classmethod
    def of(cls, filters: list[Filter]) -> Cut:
        cut = cls(below={}, above={})
        for f in filters:
            name, value = f.attribute[-1], f.value
            if name == "d":
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    cut.most_d = min(cut.most_d, value)
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    cut.least_d = max(cut.least_d, value)
            elif name in SIDES[:3] and isinstance(f, (LessThan, LessThanOrEqual)):
                cut.below[name] = min(cut.below.get(name, float("inf")), value)
            elif name in SIDES[3:] and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                cut.above[name] = max(cut.above.get(name, float("-inf")), value)
        return cut

    def may_hold(self, d: int, sides: tuple[float, ...]) -> bool:
        own = dict(zip(SIDES, sides, strict=True))
        return d <= self.most_d and all(own[c] <= v for c, v in self.below.items()) and all(own[c] >= v for c, v in self.above.items())


def usable(f: Filter) -> bool:
    names = getattr(f, "attribute", ("",))
    kinds = (LessThan, LessThanOrEqual, GreaterThan, GreaterThanOrEqual)
    return names[-1] == "d" and isinstance(f, (*kinds, EqualTo)) or names[-1] in SIDES and isinstance(f, kinds)


def nodes_of(path: str, header: dict, cut: Cut, max_gap: int, max_bytes: int) -> Iterator[tuple]:
    """Rows of a file's nodes. Pages are followed level by level, the pages of a level by runs, and each page once."""
    todo, seen = [(header["page_off"], header["page_len"])], set()
    while todo:
        seen |= set(todo)
        more = set()
        for _, raw in by_runs(path, todo, max_gap, max_bytes):
            for d, x, y, z, at, size, count in copc.entries_of(raw):
                sides = sides_of(header["cube"], d, x, y, z)
                if cut.may_hold(d, sides):
                    if count < 0:
                        more.add((at, size))
                    elif d >= cut.least_d:
                        yield (path, f"{d}-{x}-{y}-{z}", d, x, y, z, at, size, count, *sides)
        todo = sorted(more - seen)


@dataclass
class Part(InputPartition):
    """A file, or those of its nodes whose bytes begin from ``begin`` on and before ``end``."""

    path: str
    begin: int = 0
    end: int = 1 << 63

    def __init__(self, path: str, begin: int = 0, end: int = 1 << 63):
        self.path, self.begin, self.end = path, begin, end


class CopcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.table = options.get("path"), options.get("table", "nodes")
        self.pattern, self.codec = options.get("pattern", ".copc.laz"), options.get("codec", "laz")
        self.max_gap, self.max_bytes = int(options.get("max_gap", 64 << 10)), int(options.get("max_bytes", 8 << 20))
        self.run_bytes = int(options.get("run_bytes", 64 << 20))
        self.cut = Cut.of([])

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        self.cut = Cut.of([f for f in filters if usable(f)])
        return filters

    def files(self) -> list[tuple[str, int]]:
        """Paths and sizes of the files."""
        system, inner = opened(self.folder)
        prefix = self.folder[: len(self.folder.rstrip("/")) - len(inner.rstrip("/"))]
        info = system.get_file_info(inner)
        if info.type == fs.FileType.File:
            return [(self.folder, info.size)]
        found = system.get_file_info(fs.FileSelector(inner, recursive=True))
        return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(self.pattern))

    def partitions(self) -> list[Part]:
        """A file each; for points each stretch of ``run_bytes`` of a file. The planner lists files and opens none: a task reads
        the hierarchy of its file, as far as filters let it, and the nodes that begin in its stretch."""
        if self.table != "points":
            return [Part(path) for path, _ in self.files()]
        step = max(1, self.run_bytes)
        return [Part(path, at, at + step) for path, size in self.files() for at in range(0, max(1, size), step)]

    def read(self, part: Part) -> Iterator[tuple | pa.RecordBatch]:
        if self.table == "headers":
            h = copc.header_of(part.path, copc.read_range)
            yield tuple(h[c.split()[0]] for c in copc.HEADER_SCHEMA.split(", "))
        elif self.table == "nodes":
            yield from nodes_of(part.path, copc.header_of(part.path, copc.read_range), self.cut, self.max_gap, self.max_bytes)
        else:
            yield from self.points(part)

    def points(self, part: Part) -> Iterator[pa.RecordBatch]:
        """The points of a part, in batches of whole nodes of about ``BATCH`` points."""
        h = copc.point_header_of(part.path, copc.read_range)
        known = {(r[6], r[7]): r for r in nodes_of(part.path, h, self.cut, self.max_gap, self.max_bytes) if r[8] and part.begin <= r[6] < part.end}
        codec = self.codec if h["form"] & las.COMPRESSED else "none"
        held: list[tuple[tuple, bytes]] = []
        count = 0
        for place, raw in by_runs(part.path, list(known), self.max_gap, self.max_bytes):
            node = known[place]
            held.append((node, las.plain_records(raw, node[8], h["record"], codec)))
            count += node[8]
            if count >= BATCH:
                yield batch_of(held, h)
                held, count = [], 0
        if held:
            yield batch_of(held, h)


def batch_of(held: list[tuple[tuple, bytes]], h: dict) -> pa.RecordBatch:
    """The points of nodes (a row of ``nodes_of``, plain records) of a file."""
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    counts = [node[8] for node, _ in held]
    n = sum(counts)
    found = las.decoded(b"".join(raw for _, raw in held), n, h["form"] & 0x3F, h["record"], h["scale"], h["offset"], extra=h["extra"])
    of_nodes = {"path": 0, "node_key": 1, "d": 2} | {c: 9 + i for i, c in enumerate(SIDES)}
    columns, names = [], []
    for name, kind in (x.split() for x in POINTS.split(", ")):
        if name in of_nodes:
            column = pa.array([node[of_nodes[name]] for node, _ in held], kinds[kind]).take(pa.array(np.repeat(np.arange(len(held)), counts)))
        else:
            column = pa.array(found[name]).cast(kinds[kind]) if name in found else pa.nulls(n, kinds[kind])
        columns.append(column)
        names.append(name)
    return pa.RecordBatch.from_arrays(columns, names)


class CopcSource(DataSource):
    """Headers, nodes or points of COPC files."""

    @classmethod
    def name(cls) -> str:
        return "copc"

    def schema(self) -> str:
        return {"nodes": NODES, "headers": copc.HEADER_SCHEMA, "points": POINTS}[self.options.get("table", "nodes")]

    def reader(self, schema) -> CopcReader:
        return CopcReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the source known to a session. Spark pushes filters to Python sources only where its setting says so."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CopcSource)
