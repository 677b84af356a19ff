"""Point clouds, octree nodes, byte ranges and request logs, from the shared tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointquarry.functions.octree import key_of, place_at

#: The cube of the derived clouds: a power of two, so that halves are exact.
SIDE = 131072.0
#: Deepest level of the derived octree.
MAX_DEPTH = 4
#: Stored bytes of a point.
POINT_BYTES = 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per point; ``order`` columns make ties between points definite."""
    t = table(spark, sf_dir, "lineitem")
    code = F.get(F.array(*[F.lit(c) for c in (2, 1, 5, 6, 9, 18)]), F.col("l_linenumber") - 1)
    return t.select(
        F.col("l_extendedprice").cast("double").alias("x"),
        ((F.col("l_partkey") % 2000) * 50).cast("double").alias("y"),
        (F.col("l_quantity") * 2000).cast("double").alias("z"),
        F.coalesce(code, F.lit(7)).cast("int").alias("classification"),
        (F.floor("l_extendedprice").cast("long") % 65536).cast("int").alias("intensity"),
        F.col("l_linenumber").alias("return_number"),
        F.count("*").over(W.partitionBy("l_orderkey")).cast("int").alias("number_of_returns"),
        (F.round(F.col("l_discount") * 100).cast("int") * 6000).alias("red"),
        (F.round(F.col("l_tax") * 100).cast("int") * 8000).alias("green"),
        (F.col("l_quantity").cast("int") * 1300).alias("blue"),
        F.col("l_suppkey").cast("int").alias("point_source_id"),
        F.col("l_orderkey").alias("pulse_id"),
        ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 5).cast("int").alias("d"),
        F.col("l_shipdate").alias("ship_ts"),
    )


#: Columns that order all points, so that "the first" is definite.
ORDER = ["x", "y", "z", "classification", "pulse_id", "point_source_id", "ship_ts", "red", "green"]


def keyed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with the key of their octree node."""
    p = points(spark, sf_dir)
    for axis in "xyz":
        p = p.withColumn(f"k{axis}", place_at(F.col(axis), 0.0, SIDE, F.col("d")))
    return p.withColumn("node_key", key_of(*map(F.col, ("d", "kx", "ky", "kz"))))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per octree node that has points."""
    return keyed_points(spark, sf_dir).groupBy("d", "kx", "ky", "kz", "node_key").agg(F.count("*").alias("point_count"))


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte ranges of several files."""
    t = table(spark, sf_dir, "orders")
    return t.select(
        (F.col("o_custkey") % 8).cast("int").alias("file_id"),
        (F.col("o_orderkey") * 256 + F.col("o_custkey") % 64).alias("off"),
        (F.floor(F.col("o_totalprice") / 2000).cast("long") + 1).alias("len"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile requests of sessions: a hit, a page, an empty tile, an error or an opening each."""
    t = table(spark, sf_dir, "events")
    return t.select(
        "event_id",
        F.col("user_id").alias("sid"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1000.0).alias("t_ms"),
        (F.col("value") * 60000.0).alias("dur_ms"),
        F.col("event_type").alias("outcome"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def placed(p: DataFrame) -> DataFrame:
    """Points put on the globe: ``lon``, ``lat`` and ``h``."""
    return p.withColumns({"lon": F.col("y") / 1e6 - 123.0, "lat": F.col("x") / 1e6 + 44.0, "h": F.col("z") / 1000.0})


def lattice(spark: SparkSession, n: int) -> DataFrame:
    """A deterministic lattice of coloured points and well spread places in the unit square."""
    i = F.col("id")
    return spark.range(n).select(
        F.col("id").alias("i"),
        ((i % 1597) / 1597.0).alias("u"),
        ((i * 31 % 2503) / 2503.0).alias("v"),
        (i % 100).cast("int").alias("gx"),
        (F.floor(i / 100) % 100).cast("int").alias("gy"),
        (i % 256).cast("int").alias("red"),
        ((i * 7) % 256).cast("int").alias("green"),
        ((i * 13) % 256).cast("int").alias("blue"),
    )


# Component types of the standard dimensions, and the dimensions taken when none are named.
COMPONENT_TYPES = {
    "Classification": "UNSIGNED_BYTE",
    "Intensity": "UNSIGNED_SHORT",
    "ReturnNumber": "UNSIGNED_BYTE",
    "NumberOfReturns": "UNSIGNED_BYTE",
    "ScanAngle": "SHORT",
    "GpsTime": "DOUBLE",
    "PointSourceId": "UNSIGNED_SHORT",
    "UserData": "UNSIGNED_BYTE",
}
USUAL = ["Classification", "Intensity", "ReturnNumber", "NumberOfReturns"]
POSITION = ["X", "Y", "Z"]


@dataclass(frozen=True)
class Attribute:
    name: str
    component_type: str


def resolve_attributes(available: list[str], asked: list[str] | str | None = None) -> tuple[list[Attribute], list[str]]:
    """The attributes asked for (none: the usual ones, ``all``: all but the position) in that
    order, repeats included, and the names that the cloud lacks."""
    names = USUAL if asked is None else [a for a in available if a not in POSITION] if asked == "all" else list(asked)
    return [Attribute(n, COMPONENT_TYPES.get(n, "FLOAT")) for n in names if n in available], [n for n in names if n not in available]


def with_dimension_names(p: DataFrame) -> DataFrame:
    """Points with the names of dimensions that point-cloud files use."""
    return p.select(
        *[F.col(a.lower()).alias(a) for a in POSITION],
        F.col("classification").alias("Classification"),
        F.col("intensity").alias("Intensity"),
        F.col("return_number").alias("ReturnNumber"),
        F.col("number_of_returns").alias("NumberOfReturns"),
        F.col("point_source_id").alias("PointSourceId"),
    )


def visible(p: DataFrame, hide: list[int] | None = None, class_col: str = "classification") -> DataFrame:
    """Points whose class is not hidden (noise by default); all where there is no class."""
    hide = [7, 18] if hide is None else hide
    if not hide or class_col not in p.columns:
        return p
    code: Column = F.col(class_col).cast("int")
    return p.where(code.isNull() | ~code.isin(hide))


def chosen_datasets(asked: DataFrame, catalogue: DataFrame, order: str) -> DataFrame:
    """The entry (id, label) of a catalogue for each ``asked_id``; the first by ``order`` where the id is unknown."""
    first = catalogue.agg(F.min_by(F.struct("id", "label"), order).alias("__first"))
    met = asked.join(catalogue.select(F.struct("id", "label").alias("__met"), F.col("id").alias("asked_id")), "asked_id", "left")
    entry = F.coalesce("__met", "__first").alias("entry")
    return met.crossJoin(F.broadcast(first)).select(*asked.columns, entry).select(*asked.columns, "entry.id", "entry.label")
