"""Approximate nearest neighbours by learned partitions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointquarry.llm.common import staged
from pointquarry.llm.router import Router, fitted

#: Entries or queries of a part that meet in one task.
BLOCK = 8192
#: Queries whose products with a block are held at once.
CHUNK = 256


def matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 0)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, h, g): finite vectors that aren't zero, of floats if these are given and else of doubles, and their hash."""
    v = F.col("v")
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v")).where("id is not null and v is not null")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists(v, lambda x: x != 0)).withColumns({"h": F.xxhash64(v), "g": F.hash(v)})


def route(router: Router, sizes: list[int] | None, least: int) -> Callable[[Column], Column]:
    """The most probable part of each vector; with ``sizes`` (rows per part) all parts to visit,
    the most probable first, until they have the router's mass and ``least`` rows."""

    @F.arrow_udf("array<int>")
    def of(vectors: pa.Array) -> pa.Array:
        if not len(vectors):
            return pa.array([], pa.list_(pa.int32()))
        out = []
        for a in range(0, len(vectors), CHUNK * 16):
            p = router.probabilities(matrix(vectors.slice(a, CHUNK * 16)))
            if sizes is None:
                out += [[int(i)] for i in p.argmax(axis=1)]
                continue
            order = np.argsort(-p, axis=1, kind="stable")
            sorted_p, held = np.take_along_axis(p, order, axis=1), np.array(sizes)[order]
            go = (np.cumsum(sorted_p, axis=1) - sorted_p < router.mass) | (np.cumsum(held, axis=1) - held < least)
            out += [row[g].tolist() for row, g in zip(order.astype(int), go, strict=True)]
        return pa.array(out, pa.list_(pa.int32()))

    return of


def best_of_block(queries: pa.Table, entries: pa.Table, k: int) -> pa.Table:
    """For each query its k best ids of a block: the largest product, ties to smaller ids."""
    kind = pa.list_(pa.struct([("neg", pa.float64()), ("id", pa.int64())]))
    best: list[list[dict]] = []
    if len(entries):
        x, ids = matrix(entries.column("v")), entries.column("ids").to_pylist()
        first = np.array([i[0] for i in ids])
        q = matrix(queries.column("v")) if len(queries) else np.zeros((0, x.shape[1]))
        largest = np.sqrt((x * x).sum(axis=1).max())
        for a in range(0, len(q), CHUNK):
            part = np.nan_to_num(q[a : a + CHUNK] @ x.T, nan=-np.inf)
            kth = np.partition(part, -min(k, x.shape[0]), axis=1)[:, -min(k, x.shape[0])]
            for row, scores, least in zip(q[a : a + CHUNK], part, kth, strict=True):
                # All that may tie with the k-th, summed row by row: equal pairs of vectors have equal scores in every block.
                at = np.flatnonzero(scores >= least - 1e-12 * largest * np.sqrt((row * row).sum()))
                exact = (x[at] * row).sum(axis=1)
                by = np.lexsort((first[at], -exact))[:k]
                found = sorted((-float(exact[j]), i) for j in by for i in ids[at[j]])[:k]
                best.append([{"neg": s, "id": i} for s, i in found])
    else:
        best = [[] for _ in range(len(queries))]
    return pa.table({"h": queries.column("h"), "g": queries.column("g"), "best": pa.array(best, kind)})


def search(
    vectors: DataFrame,
    asks: Column | None = None,
    k: int = 20,
    rows_per_part: int = 512,
    max_parts: int = 2048,
    sample_per_part: int = 32,
    recall: float = 0.96,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The ``k`` nearest rows of each query row by inner product, in double precision.

    ``asks`` is a condition on ``id`` that says which rows are queries (null: all). A neighbour
    graph of a bounded sample (distinct vectors of the smallest hashes, 8,192 of them or ``sample_per_part`` for each part)
    is cut into balanced parts, one for ``rows_per_part`` rows; a small classifier learns how neighbours spread
    over the parts. Parts grow in number with the rows up to ``max_parts``, which bounds the sample at 65,536 vectors; beyond
    a million rows it is the parts that grow. Every row is dealt to its most
    probable part. A query visits its most probable parts until they hold the
    probability mass that gave ``recall`` on a part of the sample that was not learnt, and
    at least k rows. All rows of these parts are ranked by the exact product.

    Rows of equal vectors are one entry of the index with its k + 1 smallest ids, as ties go to
    these and no other can be among the nearest; equal queries are searched once. Parts are cut
    into blocks of entries and of queries, so that a task holds a bounded number of each
    however hot a part is. The driver gets the sample and a count for each part.

    Vectors null, zero, or with null or non-finite components take no part; neither do null
    ids. Vectors of different lengths have no product. Those of the most frequent length (ties: the longest) are indexed; those of
    any other length are compared with all of their own, in the same blocks. Rows
    repeated in full count once; an id with several vectors is a row for each, none of
    which is a candidate of another. Fewer candidates than k give fewer rows; an empty table gives none.

    Returns query_id, rank (from 1), vec_id, score.
    """
    rows = usable(vectors, id_col, vector_col)
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).first()
    common = F.size("v") == (length["n"] if length else 0)
    asked = F.lit(True) if asks is None else asks
    held = staged(rows.groupBy("h", "g", "id").agg(F.first("v").alias("v")), "vectors")
    place = F.row_number().over(W.partitionBy("h", "g").orderBy("id"))
    entries = staged(held.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("h", "g").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("id")).alias("ids")), "entries")
    n = entries.where(common).count()
    parts = 2 ** max(0, min(int(math.log2(max_parts)), max(3, round(math.log2(max(1, n) / rows_per_part))), int(math.log2(max(1, n // 2 or 1)))))
    drawn = entries.where(common).orderBy("h", "g").limit(max(8192, sample_per_part * parts)).select("v").toArrow()
    router = fitted(matrix(drawn.column("v")), parts, k, recall)
    # Other lengths are parts of their own, with numbers below zero.
    alone = (-F.size("v")).alias("part")
    dealt = staged(entries.where(common).withColumn("part", F.get(route(router, None, 0)("v"), 0)).union(entries.where(~common).select("*", alone)), "dealt")
    ids = [0] * parts
    for r in dealt.where("part >= 0").groupBy("part").agg(F.sum(F.size("ids")).alias("ids")).collect():
        ids[r["part"]] = r["ids"]
    asking = held.where(asked).select("h", "g").distinct()
    of_query = dealt.drop("part").join(asking, ["h", "g"], "left_semi").select("h", "g", "v")
    visits = of_query.where(common).select("h", "g", "v", F.explode(route(router, ids, k + 1)("v")).alias("part"))
    queries = staged(visits.union(of_query.where(~common).select("h", "g", "v", alone)), "routed")

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).alias(name))

    cells = staged(blocks(dealt, "ebs").join(blocks(queries, "qbs"), "part"), "cells")
    cell = ["part", "eb", "qb"]
    own = lambda n: F.pmod(F.xxhash64("h", "g"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = queries.join(cells, "part").withColumn("qb", own("qbs")).withColumn("eb", every("ebs")).drop("ebs", "qbs")
    right = dealt.join(cells, "part").withColumn("eb", own("ebs")).withColumn("qb", every("qbs")).drop("ebs", "qbs")

    def of_cell(_: tuple, qs: pa.Table, es: pa.Table) -> pa.Table:
        return best_of_block(qs, es, k + 1)

    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(of_cell, "h long, g int, best array<struct<neg:double,id:long>>")
    merged = found.groupBy("h", "g").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k + 1).alias("best"))
    hits = held.where(asked).select(F.col("id").alias("query_id"), "h", "g").join(merged, ["h", "g"])
    others = F.slice(F.filter("best", lambda b: b["id"] != F.col("query_id")), 1, k)
    return hits.select("query_id", F.posexplode(others).alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), (-F.col("b.neg")).alias("score"))
