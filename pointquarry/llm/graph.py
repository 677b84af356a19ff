"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointquarry.llm.common import staged


def local_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, node): a star for each component of the given edges, around its smallest node."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(names))
    while True:
        least = root.copy()
        np.minimum.at(least, x, root[y])
        np.minimum.at(least, y, root[x])
        least = least[least]
        if (least == root).all():
            break
        root = least
    far = np.flatnonzero(root != np.arange(len(names)))
    return names[root[far]], names[far]


def looked_up(hop: DataFrame, onward: DataFrame, few: int = 1 << 17, salts: int = 16) -> DataFrame:
    """(node, old, root): each node with the label of its label, where that has another one. ``onward`` is
    broadcast if it has at most ``few`` rows; else the nodes of a hot label are salted."""
    root = F.coalesce("next", "mid").alias("root")
    n = onward.count()
    if not n:
        return hop.select("node", "old", F.col("mid").alias("root"))
    if n <= few:
        return hop.join(F.broadcast(onward), "mid", "left").select("node", "old", root)
    salted = hop.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int"))
    copies = onward.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, ["mid", "salt"], "left").select("node", "old", root)


def components(edges: DataFrame, src: str = "src", dst: str = "dst", edges_per_task: int = 1 << 20) -> DataFrame:
    """(node, root) for each node of an edge (longs): root is the smallest node of its component.

    First the edges are dealt into parts of ``edges_per_task``, and each part becomes stars
    around the smallest nodes of its own components: fewer edges, and shorter ways. The stars of a single part
    are the components, so no rounds follow. Else each round gives a node the smallest label among its neighbours' and then
    the label of its label, which halves the way to the root; each round is written to
    the shared folder, so no plan grows and a lost executor costs one round. Only
    the number of changed labels comes to the driver. Loops and repeated edges are
    harmless; edges with a null end are ignored; no edges give no rows.
    """
    given = staged(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null"), "given-edges")

    def of_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(x.column("a").to_numpy(), x.column("b").to_numpy()) for x in batches]
        if held:
            a, b = (np.concatenate(x) for x in zip(*held, strict=True))
            root, node = local_stars(a, b)
            # A node whose edges are all loops is kept by one.
            loops = np.setdiff1d(a[a == b], np.concatenate([root, node]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([root, loops])), pa.array(np.concatenate([node, loops]))], ["a", "b"])

    def of_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stars in of_part(batches):
            root, node = (stars.column(c).to_numpy() for c in ("a", "b"))
            roots, far = np.unique(root), node != root
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node[far], roots])), pa.array(np.concatenate([root[far], roots]))], ["node", "root"])

    parts = max(1, -(-given.count() // edges_per_task))
    if parts == 1:
        return staged(given.repartition(1).mapInArrow(of_all, "node long, root long"), "labels")
    pairs = given.repartition(parts).mapInArrow(of_part, "a long, b long")
    both = staged(pairs.union(pairs.select("b", "a")).distinct(), "edges")
    labels = staged(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy("a").agg(F.min("r").alias("m"))
        hop = staged(labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("mid")), "hops")
        # A label that is a root has no other label: members of a large component, who share
        # one, are looked up once together, and in the end not at all.
        onward = hop.where("mid < node").select(F.col("node").alias("mid"), F.col("mid").alias("next"))
        moved = staged(looked_up(hop, staged(hop.select("mid").distinct().join(onward, "mid"), "onward")), "labels")
        labels = moved.select("node", "root")
        if moved.where("root <> old").isEmpty():
            return labels
