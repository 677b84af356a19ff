"""A point cloud with the options it was opened with; every method is a lazy DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from pointquarry.functions.geodesy import LongLat, checked_position
from pointquarry.functions.octree import key_of, place_at
from pointquarry.functions.wkt import chosen_system, projection_of, units_of
from pointquarry.operators import nearest, profile, reproject, shading, space, tree
from pointquarry.sinks import tiles as tile_sink
from pointquarry.sources import clouds


@dataclass(frozen=True)
class Options:
    """How a cloud is shown: hidden classes (none: noise), colours, attributes, the points
    drawn at most (0: all), the reference system (``crs`` wins over the file's, ``default_crs`` fills in)."""

    hide: list[int] | None = None
    color_by: str = "rgb"
    attributes: list[str] | str | None = None
    point_budget: int = 0
    crs: str | None = None
    default_crs: str | None = None
    unit: float = 1.0
    z_unit: float = 1.0


@dataclass(frozen=True)
class PointCloud:
    """Points with their octree keys, over a cube at ``low`` of ``side``."""

    points: DataFrame
    side: float
    options: Options = field(default_factory=Options)
    order: tuple[str, ...] = ("x", "y", "z")
    header_crs: str | None = None
    low: tuple[float, float, float] = (0.0, 0.0, 0.0)

    @classmethod
    def of(cls, points: DataFrame, side: float, max_depth: int, low: tuple[float, float, float] = (0.0, 0.0, 0.0), header_crs: str | None = None, **options) -> PointCloud:
        """Points with x, y, z and a depth ``d`` (0 where there is none); deeper ones than ``max_depth``
        are points of the nodes at that depth. The middle of the cube must have a longitude and a latitude."""
        depth = F.least(F.col("d"), F.lit(max_depth)) if "d" in points.columns else F.lit(0)
        p = points.withColumn("d", depth.cast("int"))
        for a, at in zip("xyz", low, strict=True):
            p = p.withColumn(f"k{a}", place_at(F.col(a), at, side, F.col("d")))
        cloud = cls(p.withColumn("node_key", key_of(*map(F.col, ("d", "kx", "ky", "kz")))), side, Options(**options), header_crs=header_crs, low=tuple(low))
        if cloud.options.crs or header_crs or cloud.options.default_crs:
            middle = cloud.projection.inverse(*(F.lit(float(low[i] + side / 2)) for i in (0, 1)))
            points.sparkSession.range(1).select(checked_position(*middle)).first()
        return cloud

    @classmethod
    def open(cls, spark: SparkSession, path: str, side: float, max_depth: int, **settings) -> PointCloud:
        """A Parquet table of points, see ``of``."""
        return cls.of(spark.read.parquet(path), side, max_depth, **settings)

    @classmethod
    def of_header(cls, points: DataFrame, header: Row, max_depth: int, **options) -> PointCloud:
        """Points of the file that a row of ``copc.headers`` describes: its cube and its reference system,
        with the units that this names."""
        cube = header["cube"]
        forced = options.get("crs") or header["crs"] or options.get("default_crs") or ""
        across, up, _ = units_of(forced)
        return cls.of(points, cube[3] - cube[0], max_depth, tuple(cube[:3]), header["crs"], **{"unit": across, "z_unit": up} | options)

    @property
    def projection(self):
        return projection_of(chosen_system(self.options.crs, self.header_crs, self.options.default_crs))

    @property
    def nodes(self) -> DataFrame:
        return self.points.groupBy("d", "kx", "ky", "kz", "node_key").agg(F.count("*").alias("point_count"))

    @property
    def visible(self) -> DataFrame:
        """Points of classes that aren't hidden, within the budget of points."""
        shown = clouds.visible(self.points, self.options.hide)
        if self.options.point_budget <= 0:
            return shown
        counted = shown.groupBy("d", "kx", "ky", "kz", "node_key").agg(F.count("*").alias("point_count"))
        cut = profile.point_budget(counted, self.options.point_budget).select("node_key", "take")
        ranked = nearest.feature_ids(shown, list(self.order)).join(cut, "node_key")
        return ranked.where(F.col("feature_id") < F.col("take")).drop("feature_id", "take")

    def placed(self) -> DataFrame:
        """Visible points with ``lon``, ``lat`` and ``h``."""
        b = self.points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
        p = self.visible if b[0] is None else reproject.reprojected(self.visible, self.projection, (b[0], b[1]), (b[2], b[3]))
        return p.withColumn("h", F.col("z") * self.options.z_unit)

    def colored(self) -> DataFrame:
        heights = None
        if self.options.color_by == "height":
            r = self.points.agg(F.min("z"), F.max("z")).first()
            heights = shading.height_range(clouds.visible(self.points.where("d = 0"), self.options.hide), (r[0] or 0.0, r[1] or 0.0))
        return shading.colored(self.placed(), self.options.color_by, heights)

    def tiles(self, columns: dict[str, str] | None = None) -> DataFrame:
        """A binary tile per node; ``columns`` says which column holds an attribute."""
        columns = columns or {"Classification": "classification", "Intensity": "intensity", "ReturnNumber": "return_number", "NumberOfReturns": "number_of_returns"}
        there = [n for n, c in columns.items() if c in self.points.columns]
        found, _ = clouds.resolve_attributes(there, self.options.attributes)
        return tile_sink.point_tiles(self.colored(), found, columns, list(self.order))

    def tile_tree(self, root_span: float, base: str) -> DataFrame:
        return tree.tiles(self.nodes, root_span, base)

    def attribute_range(self, names: list[str]) -> DataFrame:
        """Ranges in the root node."""
        return profile.attribute_range(self.points.where("d = 0"), names)

    def snap(self, seeds: DataFrame, keep: list[str], max_depth: int = 32) -> DataFrame:
        """The nearest visible point in the deepest node around each seed (seed_id, x, y, z)."""
        at = tree.locate(seeds, self.nodes, self.side, max_depth, low=self.low).select("seed_id", "node_key")
        shown = clouds.visible(self.points, self.options.hide)
        return nearest.nearest_in_node(seeds.join(at, "seed_id"), shown, keep, list(self.order), self.options.unit, self.options.z_unit)

    def snap_positions(self, seeds: DataFrame, keep: list[str]) -> DataFrame:
        """The nearest visible point to each position (seed_id, lon, lat, height in metres), in metres:
        on the globe for a cloud in degrees, along the source axes for a projected one."""
        shown, projection = clouds.visible(self.points, self.options.hide), self.projection
        own = None if isinstance(projection, LongLat) else projection
        return space.snap_geographic(seeds, shown, keep, list(self.order), own, 1.0 if own is None else self.options.unit, self.options.z_unit)

    def pick(self, asked: DataFrame, attributes: list[str]) -> DataFrame:
        """The attributes of features (node_key, feature_id) as tiles number them."""
        shown = clouds.visible(self.points, self.options.hide)
        return nearest.picked(nearest.feature_ids(shown, list(self.order)), asked, attributes)
