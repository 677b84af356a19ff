"""Tile trees as nested JSON, built from flat tiles level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointquarry.operators.tree import PLACES, tiles


def tile_json(children: Column | None) -> Column:
    """A tile's JSON text; proxies have no children."""
    own = F.to_json(F.struct(F.struct(F.col("region")).alias("boundingVolume"), F.col("error").alias("geometricError"), "refine", F.struct("uri").alias("content")))
    if children is None:
        return own
    inner = F.concat(F.substring(own, F.lit(1), F.length(own) - 1), F.lit(',"children":['), children, F.lit("]}"))
    return F.when(F.endswith("uri", F.lit(".json")), own).otherwise(inner)


def nested(flat: DataFrame, root: str = "0-0-0-0") -> DataFrame:
    """One row with the tree below ``root`` as JSON text.

    Tiles (node_key, parent_key, d, error, refine, uri, region) are folded from the deepest
    level up: a level's texts are joined by parent. The text itself is one value, so this
    is for the head of a tree; deeper parts are trees of their own behind proxies.
    """
    depths = [r["d"] for r in flat.select("d").distinct().orderBy(F.desc("d")).collect()]
    below = None
    for d in depths:
        level = flat.where(F.col("d") == d)
        if below is None:
            text = level.select("node_key", "parent_key", tile_json(F.lit("")).alias("json"))
        else:
            text = level.join(below, "node_key", "left").select("node_key", "parent_key", tile_json(F.coalesce("inner", F.lit(""))).alias("json"))
        below = text.groupBy(F.col("parent_key").alias("node_key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("node_key").alias("k"), "json"))), lambda s: s["json"]), ",").alias("inner"))
    return text.where(F.col("node_key") == root).select("json")


def tileset(flat: DataFrame, root_error: float, root: str = "0-0-0-0") -> DataFrame:
    """The whole document and its data URI. The document's error is ``root_error``."""
    doc = F.concat(F.lit(f'{{"asset":{{"version":"1.0"}},"geometricError":{root_error!r},"root":'), "json", F.lit("}"))
    return nested(flat, root).select(doc.alias("json")).withColumn("uri", F.concat(F.lit("data:application/json;base64,"), F.base64(F.col("json").cast("binary"))))


def page_documents(nodes: DataFrame, root_span: float, base: str, levels: int = 3) -> DataFrame:
    """(page_key, json): the whole tree as documents of ``levels`` levels each, so none has more than ``8 ** levels`` tiles and as many links.

    ``nodes`` have their place (node_key, d, kx, ky, kz) and a ``region``. Those at every ``levels``-th depth begin a document of their own,
    and the document above has a proxy that links to it. All documents are folded together, from their lowest level up: ``levels`` joins by parent,
    however deep the tree is, and no value is larger than a document. Children stand in the order of octants. The error of the first document is twice its
    root's, that of others their root's. Nodes whose parents are absent are in no document but start theirs; repeated nodes count once.
    """
    octant = sum((F.shiftleft(F.col(p).bitwiseAND(F.lit(1)), i) for i, p in enumerate(PLACES)), F.lit(0))
    flat = tiles(nodes, root_span, base).join(nodes.select("node_key", octant.alias("octant"), "region"), "node_key").dropDuplicates(["node_key"]).withColumn("step", F.col("d") % levels)
    proxies = flat.where("step = 0 and d > 0").withColumn("uri", F.concat(F.lit(base + "page/"), "node_key", F.lit(".json")))

    def of_parents(level: DataFrame) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("octant", "json")))
        return level.groupBy(F.col("parent_key").alias("node_key")).agg(F.array_join(F.transform(ordered, lambda s: s["json"]), ",").alias("inner"))

    below = of_parents(proxies.select("parent_key", "octant", tile_json(None).alias("json")))
    for step in range(levels - 1, -1, -1):
        level = flat.where(F.col("step") == step).join(below, "node_key", "left")
        level = level.select("node_key", "parent_key", "d", "error", "octant", tile_json(F.coalesce("inner", F.lit(""))).alias("json"))
        if step:
            below = of_parents(level)
    error = F.when(F.col("d") == 0, F.col("error") * 2).otherwise(F.col("error"))
    head, tail = F.lit('{"asset":{"version":"1.0"},"geometricError":'), F.lit("}")
    return level.select(F.col("node_key").alias("page_key"), F.concat(head, error.cast("string"), F.lit(',"root":'), "json", tail).alias("json"))


def asked_documents(asked: DataFrame, documents: DataFrame) -> DataFrame:
    """The documents of the asked keys (``page_key``); a key without one raises."""
    met = asked.select("page_key").join(documents, "page_key", "left")
    wrong = F.raise_error(F.concat(F.lit("no such page: "), "page_key")).cast("string")
    return met.select("page_key", F.coalesce("json", wrong).alias("json"))
