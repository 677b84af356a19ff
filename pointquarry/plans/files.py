"""Queries on COPC files that Spark writes from the points and reads back by ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointquarry.plans.registry import query
from pointquarry.scratch import shared_path
from pointquarry.sinks.copc import write_copc
from pointquarry.sources import clouds as C
from pointquarry.sources.copc_source import register

CRS = 'PROJCS["WGS 84 / UTM zone 10N",GEOGCS["WGS 84",DATUM["D",SPHEROID["WGS 84",6378137,298.257223563]],UNIT["degree",0.0174532925199433]],PROJECTION["Transverse_Mercator"],PARAMETER["central_meridian",-123],PARAMETER["scale_factor",0.9996],PARAMETER["false_easting",500000],UNIT["metre",1]]'


def files(spark, sf, table: str, **options) -> DataFrame:
    """All points in files of 20,000, and a table of these as the data source gives it."""
    folder = shared_path(spark, "copc")
    held = C.keyed_points(spark, sf).withColumn("gps_time", F.col("pulse_id").cast("double"))
    # Only files that are listed here are complete; the folder has no others once the write is done.
    written = write_copc(held, folder, (0.0, 0.0, 0.0), C.SIDE, crs=CRS, file_points=20_000)
    written.agg(F.sum("points")).first()
    register(spark)
    return spark.read.format("copc").options(table=table, **{k: str(v) for k, v in options.items()}).load(folder)


@query("keyed", """
SELECT node_key, classification, count(*) AS n, sum(round(x * 100)::BIGINT)::BIGINT AS x, sum(round(y * 100)::BIGINT)::BIGINT AS y, sum(round(z * 100)::BIGINT)::BIGINT AS z, sum(intensity)::BIGINT AS intensity, sum(return_number)::BIGINT AS returns, sum(number_of_returns)::BIGINT AS of_returns,
  sum(point_source_id % 65536)::BIGINT AS sources, sum(pulse_id)::DOUBLE AS pulses, sum(red)::BIGINT AS red, sum(green)::BIGINT AS green, sum(blue)::BIGINT AS blue FROM fx_keyed GROUP BY node_key, classification
""")
def copc_points(spark, sf):
    """What the decoded records of all files hold, by node and class: numbers and sums, coordinates in hundredths."""
    p = files(spark, sf, "points")
    sums = {"intensity": "intensity", "return_number": "returns", "number_of_returns": "of_returns", "point_source_id": "sources", "gps_time": "pulses", "red": "red", "green": "green", "blue": "blue"}
    value = {"point_source_id": F.col("point_source_id") % 65536}
    return p.groupBy("node_key", "classification").agg(F.count("*").alias("n"), *[F.sum(F.round(F.col(a) * 100).cast("long")).alias(a) for a in "xyz"], *[F.sum(value.get(c, F.col(c))).alias(n) for c, n in sums.items()])


@query("keyed", """
SELECT node_key, d, sum(1)::BIGINT AS points, round(kx * 131072 / power(2, d), 3) AS min_x, round((kz + 1) * 131072 / power(2, d), 3) AS max_z FROM fx_keyed
WHERE d <= 3 AND kx * 131072 / power(2, d) <= 40000 AND (kz + 1) * 131072 / power(2, d) >= 60000 GROUP BY node_key, d, kx, kz
""")
def copc_nodes_in_box(spark, sf):
    """Nodes of all files down to a depth that meet a box: pages outside are not read."""
    n = files(spark, sf, "nodes").where((F.col("d") <= 3) & (F.col("min_x") <= 40000.0) & (F.col("max_z") >= 60000.0))
    return n.groupBy("node_key", "d", "min_x", "max_z").agg(F.sum("point_count").alias("points")).select("node_key", "d", "points", F.round("min_x", 3).alias("min_x"), F.round("max_z", 3).alias("max_z"))


@query("points", f"SELECT count(*) AS points, true AS full_cube, '{CRS}' AS crs, min(x) AS min_x, max(x) AS max_x, min(z) AS min_z, max(z) AS max_z FROM fx_points")
def copc_headers(spark, sf):
    """The headers of all files together: their points, bounds, cube and reference system."""
    h = files(spark, sf, "headers")
    bounds = [f(F.col(c)[i]).alias(n) for n, c, i, f in (("min_x", "min", 0, F.min), ("max_x", "max", 0, F.max), ("min_z", "min", 2, F.min), ("max_z", "max", 2, F.max))]
    whole = F.min(F.col("cube")[3] - F.col("cube")[0] == C.SIDE).alias("full_cube")
    return h.groupBy("crs").agg(F.sum("point_count").alias("points"), whole, *bounds)
