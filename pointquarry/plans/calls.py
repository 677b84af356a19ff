"""Queries on call trees: the octree's nodes stand for sampled frames, their points for hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointquarry.operators import callpaths as P
from pointquarry.plans.registry import query
from pointquarry.sources import clouds as C

FRAMES = "fx_frames AS (SELECT node_key AS id, CASE WHEN d > 0 THEN concat_ws('-', d - 1, kx >> 1, ky >> 1, kz >> 1) END AS parent, concat('f', (kx * 7 + ky * 3 + kz + d) % 23) AS name, concat('lib', ky % 3) AS url, point_count AS hits FROM fx_nodes)"


def frames(spark, sf) -> DataFrame:
    n = C.nodes(spark, sf)
    up = F.when(F.col("d") > 0, F.concat_ws("-", F.col("d") - 1, *[F.shiftright(p, 1) for p in ("kx", "ky", "kz")]))
    name = F.concat(F.lit("f"), (F.col("kx") * 7 + F.col("ky") * 3 + F.col("kz") + F.col("d")) % 23)
    return n.select(F.col("node_key").alias("id"), up.alias("parent"), name.alias("name"), F.concat(F.lit("lib"), F.col("ky") % 3).alias("url"), F.col("point_count").alias("hits"))


@query("nodes", f"""
WITH {FRAMES}, best AS (SELECT name, id, hits FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY hits DESC, id) AS rn FROM fx_frames WHERE hits > 0) WHERE rn = 1),
up AS (
  SELECT best.name AS target, f.id, f.parent, 1 AS step, f.name FROM best JOIN fx_frames f ON f.id = best.id
  UNION ALL SELECT up.target, f.id, f.parent, up.step + 1, f.name FROM up JOIN fx_frames f ON f.id = up.parent WHERE up.step < 25
)
SELECT best.name, best.id, best.hits, count(*) AS length, string_agg(up.name, ' > ' ORDER BY step DESC) AS path FROM best JOIN up ON up.target = best.name GROUP BY best.name, best.id, best.hits
""")
def call_paths(spark, sf):
    """The path from the root to the busiest frame of each name."""
    return P.busiest_paths(frames(spark, sf))


@query("nodes", f"""
WITH {FRAMES}, s AS (SELECT name, url, sum(hits)::BIGINT AS hits FROM fx_frames WHERE hits > 0 GROUP BY name, url ORDER BY hits DESC, name, url LIMIT 15)
SELECT name, url, hits, hits * 0.25::DOUBLE AS self_ms, round(hits * 100.0::DOUBLE / (SELECT sum(hits) FROM fx_frames), 6) AS pct FROM s WHERE hits * 0.25::DOUBLE >= 1
""")
def self_time_top15(spark, sf):
    """Where time itself goes, by function and library."""
    return P.self_times(frames(spark, sf), ["name", "url"]).withColumn("pct", F.round("pct", 6))
