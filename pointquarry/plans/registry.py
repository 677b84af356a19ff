"""Where queries and the SQL that checks them are registered, and the views that the SQL starts from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

POINTS = """fx_points AS (SELECT CAST(l_extendedprice AS DOUBLE) AS x, CAST((l_partkey % 2000) * 50 AS DOUBLE) AS y, CAST(l_quantity * 2000 AS DOUBLE) AS z,
  CAST(CASE l_linenumber WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 5 WHEN 4 THEN 6 WHEN 5 THEN 9 WHEN 6 THEN 18 ELSE 7 END AS INT) AS classification,
  CAST(CAST(floor(l_extendedprice) AS BIGINT) % 65536 AS INT) AS intensity, l_linenumber AS return_number,
  CAST(count(*) OVER (PARTITION BY l_orderkey) AS INT) AS number_of_returns,
  CAST(round(l_discount * 100) AS INT) * 6000 AS red, CAST(round(l_tax * 100) AS INT) * 8000 AS green, CAST(l_quantity AS INT) * 1300 AS blue,
  CAST(l_suppkey AS INT) AS point_source_id, l_orderkey AS pulse_id, CAST((l_orderkey * 7 + l_linenumber) % 5 AS INT) AS d, l_shipdate AS ship_ts
FROM lineitem)"""
KEYED = """fx_places AS (SELECT *, CAST(least(power(2, d) - 1, floor(x / (131072 / power(2, d)))) AS INT) AS kx, CAST(least(power(2, d) - 1, floor(y / (131072 / power(2, d)))) AS INT) AS ky,
  CAST(least(power(2, d) - 1, floor(z / (131072 / power(2, d)))) AS INT) AS kz FROM fx_points),
fx_keyed AS (SELECT *, concat_ws('-', d, kx, ky, kz) AS node_key FROM fx_places)"""
NODES = "fx_nodes AS (SELECT d, kx, ky, kz, node_key, count(*) AS point_count FROM fx_keyed GROUP BY ALL)"
RANGES = "fx_ranges AS (SELECT CAST(o_custkey % 8 AS INT) AS file_id, o_orderkey * 256 + (o_custkey % 64) AS off, CAST(floor(o_totalprice / 2000) AS BIGINT) + 1 AS len FROM orders)"
REQUESTS = "fx_requests AS (SELECT event_id, user_id AS sid, epoch_us(ts) / 1000.0::DOUBLE AS t_ms, value * 60000.0::DOUBLE AS dur_ms, event_type AS outcome, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"


def oracle(views: str, sql: str) -> str:
    """SQL that starts from the named views (points, keyed, nodes, ranges, requests); each brings those it needs."""
    need = {"points": [POINTS], "keyed": [POINTS, KEYED], "nodes": [POINTS, KEYED, NODES], "ranges": [RANGES], "requests": [REQUESTS]}
    parts = list(dict.fromkeys(p for v in views.split() for p in need[v]))
    body = sql.strip()
    if not parts:
        return body
    return f"WITH RECURSIVE {', '.join(parts)}{', ' + body[5:] if body.startswith('WITH ') else ' ' + body}"


def query(views: str = "", sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if SQL can express it."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = oracle(views, sql)
        return f

    return register
