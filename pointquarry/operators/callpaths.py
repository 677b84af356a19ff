"""Sampled call trees: the way to the busiest node of each name, and where time itself goes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hops from a node towards the root, and milliseconds of a sample.
HOPS, SAMPLE_MS = 25, 0.25


def busiest_paths(nodes: DataFrame, hops: int = HOPS) -> DataFrame:
    """(name, id, hits, length, path): for each name its node of the most hits (of equal ones the smallest id), and the names from
    the root, or from ``hops`` - 1 nodes above, down to it.

    ``nodes`` have ``id``, ``parent`` (null at a root), ``name`` and ``hits``. The chains of all names climb together, a join on the parent for
    each step, in one recursive query; one that loops ends with the hops. Names without a hit have no row, null names are ``(anon)``.
    Parents that are absent end a chain. Ids are distinct.
    """
    named = nodes.select("id", "parent", F.coalesce("name", F.lit("(anon)")).alias("name"), F.coalesce("hits", F.lit(0)).alias("hits"))
    best = named.where("hits > 0").groupBy("name").agg(F.min(F.struct((-F.col("hits")).alias("less"), "id")).alias("b")).select("name", F.col("b.id").alias("id"), (-F.col("b.less")).alias("hits"))
    climbed = nodes.sparkSession.sql(
        f"""
        WITH RECURSIVE up(target, id, parent, step, name) MAX RECURSION LEVEL {hops + 1} AS (
          SELECT b.name, n.id, n.parent, 1, n.name FROM {{best}} b JOIN {{named}} n ON n.id = b.id
          UNION ALL
          SELECT up.target, n.id, n.parent, up.step + 1, n.name FROM up JOIN {{named}} n ON n.id = up.parent WHERE up.step < {hops}
        )
        SELECT target, step, name FROM up
        """,
        best=best,
        named=named,
    )
    chain = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("step")).alias("s"), F.col("name").alias("n")))), lambda x: x["n"])
    paths = climbed.groupBy("target").agg(F.count("*").alias("length"), F.array_join(chain, " > ").alias("path"))
    return best.join(paths.withColumnRenamed("target", "name"), "name").select("name", "id", "hits", "length", "path")


def self_times(nodes: DataFrame, by: list[str], top: int = 15, least_ms: float = 1.0, sample_ms: float = SAMPLE_MS) -> DataFrame:
    """Time in nodes themselves by the columns ``by``: the ``top`` largest (ties by the columns), less those below ``least_ms``, with their
    share of all samples. Without a hit there is no row."""
    total = nodes.agg(F.sum("hits").alias("all"))
    summed = nodes.where("hits > 0").groupBy(*by).agg(F.sum("hits").alias("hits"))
    first = summed.orderBy(F.desc("hits"), *by).limit(top).withColumn("self_ms", F.col("hits") * sample_ms)
    return first.where(F.col("self_ms") >= least_ms).crossJoin(F.broadcast(total)).select(*by, "hits", "self_ms", (F.col("hits") * 100.0 / F.col("all")).alias("pct"))
