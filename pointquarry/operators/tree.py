"""The octree: children, location, tiles, pages, levels of detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointquarry.functions.geodesy import wrapped_longitude
from pointquarry.functions.octree import child, geometric_error, key_of, node_side, parent, place_at, screen_error, within

PLACES = ["kx", "ky", "kz"]
#: Parts into which an edge of a rectangle is cut when it is projected.
SEGMENTS = 8


def children(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """The children of each node that are among ``known`` (nodes and pages), by octant.

    The other way round it is one equi-join: each known row names its parent.
    """
    named = known.select(F.col("node_key").alias("child_key"), (F.col("d") - 1).alias("pd"), *[parent(F.col(p)).alias(f"p{p}") for p in PLACES], sum((F.shiftleft(F.col(p).bitwiseAND(F.lit(1)), i) for i, p in enumerate(PLACES)), F.lit(0)).alias("octant")).where("pd >= 0").dropDuplicates(["child_key"])
    named = named.withColumn("node_key", key_of(F.col("pd"), *[F.col(f"p{p}") for p in PLACES])).select("node_key", "child_key", "octant")
    return named.join(nodes.select("node_key"), "node_key", "left_semi")


def descend(keys: DataFrame) -> DataFrame:
    """All eight possible children of each node."""
    out = keys.withColumn("octant", F.explode(F.sequence(F.lit(0), F.lit(7))))
    moved = out.select((F.col("d") + 1).alias("d"), *[child(F.col(p), F.col("octant"), i).alias(p) for i, p in enumerate(PLACES)], "octant")
    return moved.withColumn("node_key", key_of(F.col("d"), *map(F.col, PLACES)))


def locate(seeds: DataFrame, nodes: DataFrame, side: float, max_depth: int, id_col: str = "seed_id", low: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """The deepest node around each seed that is reached without a gap from the root.

    A seed names its key at each depth (in a cube at ``low`` of ``side``), the keys meet the nodes in one equi-join, and the
    depths found are a prefix as long as their number says. Seeds outside the cube, or
    without a root, have no row.
    """
    inside = seeds
    for a, at in zip("xyz", low, strict=True):
        inside = inside.where(within(F.col(a), at, side))
    each = inside.select(id_col, "x", "y", "z", F.explode(F.sequence(F.lit(0), F.lit(max_depth))).alias("d"))
    at = each.withColumn("node_key", key_of(F.col("d"), *[place_at(F.col(a), b, side, F.col("d")) for a, b in zip("xyz", low, strict=True)]))
    met = at.join(nodes.select("node_key"), "node_key").select(id_col, "d", "node_key")
    depths = met.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("d", "node_key"))).alias("path"))
    prefix = F.filter("path", lambda s, i: s["d"] == i)
    return depths.where(F.size(prefix) > 0).select(id_col, F.element_at(prefix, -1)["node_key"].alias("node_key"), F.element_at(prefix, -1)["d"].alias("d"))


def node_cubes(nodes: DataFrame, side: float) -> DataFrame:
    """Adds the lower corner and the side of each node."""
    return nodes.withColumn("side", node_side(side, F.col("d"))).withColumns({f"min_{a}": F.col(f"k{a}") * F.col("side") for a in "xyz"})


def tiles(nodes: DataFrame, root_span: float, base: str, pages: DataFrame | None = None) -> DataFrame:
    """A row per tile: key, parent, error, refinement and content; pages are proxies without children."""
    own = nodes.select("node_key", "d", *PLACES, F.lit(False).alias("proxy"))
    if pages is not None:
        own = own.unionByName(pages.select("node_key", "d", *PLACES, F.lit(True).alias("proxy")))
    up = F.when(F.col("d") > 0, key_of(F.col("d") - 1, *[parent(F.col(p)) for p in PLACES]))
    uri = F.when(F.col("proxy"), F.concat(F.lit(base + "page/"), "node_key", F.lit(".json"))).otherwise(F.concat(F.lit(base), "node_key", F.lit(".pnts")))
    return own.select("node_key", up.alias("parent_key"), "d", geometric_error(root_span, F.col("d")).alias("error"), F.lit("ADD").alias("refine"), uri.alias("uri"))


def subtree(nodes: DataFrame, d: int, x: int, y: int, z: int) -> DataFrame:
    """A node and all below it, by key arithmetic alone."""
    shift = F.col("d") - d
    under = F.col("d") >= d
    for p, at in zip(PLACES, (x, y, z), strict=True):
        under = under & (F.floor(F.col(p) / F.pow(F.lit(2.0), shift)) == at)
    return nodes.where(under)


def lod_cut(tiles_: DataFrame, distance: Column, height: float, field_of_view: float, most_pixels: float) -> DataFrame:
    """The tiles drawn at a distance: those whose parent's error is too large to see (and the root)."""
    shown = screen_error(F.col("error") * 2, distance, height, field_of_view)
    return tiles_.where((F.col("d") == 0) | (shown > most_pixels))


def edge_samples(rects: DataFrame, keys: list[str]) -> DataFrame:
    """Places along the four edges of each rectangle (min_x, min_y, max_x, max_y), as ``x`` and ``y``."""
    t = F.col("i") / float(SEGMENTS)
    x = F.col("min_x") + (F.col("max_x") - F.col("min_x")) * t
    y = F.col("min_y") + (F.col("max_y") - F.col("min_y")) * t
    corners = F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ((x, F.col("min_y")), (x, F.col("max_y")), (F.col("min_x"), y), (F.col("max_x"), y))])
    return rects.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS)))).select(*keys, F.explode(corners).alias("c")).select(*keys, "c.x", "c.y")


def checked_samples(samples: DataFrame, lon: str, lat: str) -> DataFrame:
    """The samples as they are; an error where a position is not finite or beyond a pole."""
    good = ~F.isnan(lon) & (F.abs(F.col(lon)) < float("inf")) & F.col(lat).between(-90, 90)
    wrong = F.raise_error(F.concat(F.lit("region out of range: "), F.col(lon).cast("string"), F.lit(", "), F.col(lat).cast("string"))).cast("double")
    return samples.withColumn(lat, F.when(good, F.col(lat)).otherwise(wrong))


def longitude_bounds(df: DataFrame, lon: str, keys: list[str]) -> DataFrame:
    """(west, east) of each group: what is left of the circle without its largest gap.

    West exceeds east across the antimeridian. The gap over the end of the circle wins ties.
    """
    order = W.partitionBy(*keys).orderBy("lon")
    sorted_ = df.select(*keys, wrapped_longitude(F.col(lon)).alias("lon")).distinct()
    gaps = sorted_.withColumns({"next": F.lead("lon").over(order), "first": F.first("lon").over(order)})
    gaps = gaps.withColumns({"gap": F.coalesce(F.col("next") - F.col("lon"), F.col("first") + 360 - F.col("lon")), "inner": F.col("next").isNotNull()})
    # The largest gap; of equal ones that over the end, then the first.
    best = F.max(F.struct(F.col("gap"), (~F.col("inner")).alias("over"), (-F.col("lon")).alias("neg"), F.coalesce("next", "first").alias("west"), F.col("lon").alias("east")))
    return gaps.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.west").alias("west"), F.col("b.east").alias("east"))


def merged_pages(held: DataFrame, loaded: DataFrame, pointers: DataFrame, page_key: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes after a page was loaded (its rows win) and the pointers that are left."""
    newest = held.withColumn("__v", F.lit(0)).unionByName(loaded.withColumn("__v", F.lit(1)))
    best = newest.withColumn("__r", F.row_number().over(W.partitionBy("node_key").orderBy(F.desc("__v"))))
    return best.where("__r = 1").drop("__v", "__r"), pointers.where(F.col("node_key") != page_key)


def lookup(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds ``status`` to asked keys: ``missing`` is not ``empty``."""
    met = asked.join(nodes.select("node_key", "point_count"), "node_key", "left")
    status = F.when(F.col("point_count").isNull(), "missing").when(F.col("point_count") == 0, "empty").otherwise("data")
    return met.withColumn("status", status)


def reachable(nodes: DataFrame, root: str = "0-0-0-0", max_depth: int = 32) -> DataFrame:
    """Nodes that are reached from the root through nodes alone.

    Level by level, as many times as the tree is deep: a node stays if its parent stayed.
    """
    rows = nodes.select("node_key", "d", key_of(F.col("d") - 1, *[parent(F.col(p)) for p in PLACES]).alias("up"))
    deepest = nodes.agg(F.max("d")).first()[0]
    found = level = rows.where(F.col("node_key") == root).select("node_key", "d")
    for d in range(1, min(max_depth, deepest if deepest is not None else 0) + 1):
        level = rows.where(F.col("d") == d).join(level.select(F.col("node_key").alias("up")), "up", "left_semi").select("node_key", "d")
        found = found.unionByName(level)
    return found


def bounded_rects(cubes: DataFrame, header: dict[str, float], angular: bool) -> DataFrame:
    """The rectangle of each node: its cube's, or for coordinates in degrees the part within the
    header's bounds (all of these where they do not meet)."""
    sides = {a: (F.col(f"min_{a}"), F.col(f"min_{a}") + F.col("side")) for a in "xy"}
    if not angular:
        return cubes.select("node_key", *[c for a, (lo, hi) in sides.items() for c in (lo.alias(f"min_{a}"), hi.alias(f"max_{a}"))])
    low = {a: F.greatest(lo, F.lit(header[f"min_{a}"])) for a, (lo, _) in sides.items()}
    high = {a: F.least(hi, F.lit(header[f"max_{a}"])) for a, (_, hi) in sides.items()}
    meet = (high["x"] >= low["x"]) & (high["y"] >= low["y"])
    return cubes.select("node_key", *[c for a in "xy" for c in (F.when(meet, low[a]).otherwise(header[f"min_{a}"]).alias(f"min_{a}"), F.when(meet, high[a]).otherwise(header[f"max_{a}"]).alias(f"max_{a}"))])


def level_chunks(chunks: DataFrame) -> DataFrame:
    """Number, smallest and largest size, and the span of offsets of the chunks (d, off, len) of each level."""
    return chunks.groupBy("d").agg(F.count("*").alias("nodes"), F.min("len").alias("smallest"), F.max("len").alias("largest"), F.min("off").alias("first_off"), F.max("off").alias("last_off"), (F.max("off") - F.min("off")).alias("spread"))
