"""Queries on byte ranges, requests and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from pointquarry.functions import transfer as TF
from pointquarry.functions import wkt
from pointquarry.operators import intervals as I
from pointquarry.operators import tree as T
from pointquarry.plans.registry import query
from pointquarry.sources import clouds as C
from pointquarry.streaming import sessions as ST

GAP, BYTES = 1500, 8192
ISLANDS = """i AS (SELECT *, max(off + len) OVER (PARTITION BY file_id ORDER BY off, len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM fx_ranges),
j AS (SELECT *, sum(CASE WHEN reach IS NULL OR off - reach > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY off, len) AS run FROM i)"""
GREEDY = f"""o AS (SELECT file_id, off, off + len AS fin, row_number() OVER (PARTITION BY file_id ORDER BY off, len) AS rn FROM fx_ranges),
g AS (SELECT file_id, rn, off AS s, fin AS e, 1 AS n, 1 AS run FROM o WHERE rn = 1 UNION ALL
  SELECT o.file_id, o.rn, CASE WHEN o.off - g.e <= {GAP} AND o.fin - g.s <= {BYTES} THEN g.s ELSE o.off END, CASE WHEN o.off - g.e <= {GAP} AND o.fin - g.s <= {BYTES} THEN greatest(g.e, o.fin) ELSE o.fin END,
    CASE WHEN o.off - g.e <= {GAP} AND o.fin - g.s <= {BYTES} THEN g.n + 1 ELSE 1 END, CASE WHEN o.off - g.e <= {GAP} AND o.fin - g.s <= {BYTES} THEN g.run ELSE g.run + 1 END
  FROM g JOIN o ON o.file_id = g.file_id AND o.rn = g.rn + 1),
runs AS (SELECT file_id, min(s) AS run_start, max(e) AS run_end, count(*) AS n FROM g GROUP BY file_id, run)"""


@query("ranges", f"WITH {GREEDY} SELECT * FROM runs")
def coalesce_runs(spark, sf):
    """Runs under limits on the gap and on the bytes of a read."""
    return I.greedy_runs(C.ranges(spark, sf), GAP, BYTES, ["file_id"])


@query("ranges", "WITH " + GREEDY.replace(f"<= {GAP} ", f"<= {1 << 40} ").replace(f"<= {BYTES} ", f"<= {1 << 18} ") + " SELECT * FROM runs")
def packed_runs(spark, sf):
    """Runs under a limit on the bytes of a read alone: each file is one island, cut into blocks."""
    return I.jump_runs(C.ranges(spark, sf), 1 << 40, 1 << 18, ["file_id"])


@query("ranges", f"WITH {ISLANDS.format(gap=GAP)} SELECT file_id, min(off) AS run_start, max(off + len) AS run_end, count(*) AS n, sum(len)::BIGINT AS data FROM j GROUP BY file_id, run")
def coalesce_islands(spark, sf):
    """Runs under a limit on the gap alone."""
    return I.runs_of_islands(I.islands(C.ranges(spark, sf), GAP, ["file_id"]), ["file_id"]).drop("run")


FEASIBLE = " UNION ALL ".join(f"SELECT {g}::BIGINT AS gap, sum(n)::BIGINT AS ranges, count(*) AS runs, sum(data)::BIGINT AS data, sum(e - s)::BIGINT AS span FROM (SELECT file_id, run, count(*) AS n, sum(len) AS data, min(off) AS s, max(off + len) AS e FROM (SELECT *, sum(CASE WHEN reach IS NULL OR off - reach > {g} THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY off, len) AS run FROM i) GROUP BY file_id, run)" for g in (0, 512, 1500, 4096))


@query("ranges", "WITH i AS (SELECT *, max(off + len) OVER (PARTITION BY file_id ORDER BY off, len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM fx_ranges), f AS (" + FEASIBLE + ") SELECT gap, ranges, runs, data, span, round((span - data) * 100.0::DOUBLE / span, 3) AS waste_pct FROM f")
def coalesce_feasibility(spark, sf):
    """What several gap limits save and waste."""
    return I.feasibility(C.ranges(spark, sf), [0, 512, 1500, 4096], ["file_id"]).withColumn("waste_pct", F.round("waste_pct", 3))


@query("ranges", "SELECT file_id, off, max(len) AS len FROM fx_ranges GROUP BY file_id, off")
def range_exact_match(spark, sf):
    """Asked ranges that are exactly one of a node."""
    r = C.ranges(spark, sf)
    asked = r.groupBy("file_id", "off").agg(F.max("len").alias("len"))
    longer = asked.withColumn("len", F.col("len") + 1)
    return I.exact_ranges(asked.union(longer), r, ["file_id"], "len")


@query("ranges", f"""
WITH {GREEDY}, asked AS (SELECT DISTINCT file_id, off + (len % 7) * 100 AS off, len + 50 AS len FROM fx_ranges)
SELECT file_id, off, len, b.s AS run_start, b.e AS run_end FROM (SELECT a.file_id, a.off, a.len, min({{'s': r.run_start, 'e': r.run_end}}) AS b FROM asked a LEFT JOIN runs r ON r.file_id = a.file_id AND r.run_start <= a.off AND r.run_end >= a.off + a.len GROUP BY 1, 2, 3)
""")
def region_cache_lookup(spark, sf):
    """The region that holds each asked range whole."""
    r = C.ranges(spark, sf)
    regions = I.greedy_runs(r, GAP, BYTES, ["file_id"])
    asked = r.select("file_id", (F.col("off") + F.col("len") % 7 * 100).alias("off"), (F.col("len") + 50).alias("len")).distinct()
    return I.covering_region(asked, regions, BYTES, ["file_id"])


def responses(spark, sf):
    """Answers of servers that keep or break the contract of byte ranges."""
    r = C.ranges(spark, sf)
    kind = F.col("off") % 5
    status = F.when(kind == 0, 200).otherwise(206)
    received = F.when(kind == 1, F.col("len")).when(kind == 2, F.col("len") + 3).otherwise(F.floor(F.col("len") / 2))
    header = F.when(kind == 3, F.concat(F.lit("bytes 0-1/"), (F.col("off") + F.floor(F.col("len") / 2)).cast("string"))).when(kind == 4, F.concat(F.lit("bytes 0-1/"), (F.col("off") + F.col("len") * 2).cast("string")))
    return r.select("file_id", "off", "len", status.alias("status"), received.cast("long").alias("received"), header.alias("content_range"))


def learnt(spark, sf):
    return I.learnt_total(responses(spark, sf).withColumn("total", TF.total_size(F.col("content_range"))), ["file_id"])


RESPONSES = """resp AS (SELECT *, CASE WHEN off % 5 = 0 THEN 200 ELSE 206 END AS status, (CASE off % 5 WHEN 1 THEN len WHEN 2 THEN len + 3 ELSE len // 2 END)::BIGINT AS received,
  CASE off % 5 WHEN 3 THEN off + len // 2 WHEN 4 THEN off + len * 2 END AS total FROM fx_ranges)"""


@query("ranges", f"""
WITH {RESPONSES}, l AS (SELECT *, first_value(total IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY off, len ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS known FROM resp), v AS (SELECT *, CASE WHEN status <> 206 THEN 'range ignored' WHEN received = len THEN NULL WHEN received > len THEN 'too many bytes' WHEN known IS NOT NULL AND off + received >= known THEN NULL ELSE 'cut short' END AS violation FROM l)
SELECT file_id, violation, violation IS NOT DISTINCT FROM 'cut short' AS retryable, count(*) AS n FROM v GROUP BY ALL
""")
def range_contract(spark, sf):
    """Breaches of the contract by file; the size that a file's first telling response taught holds."""
    v = TF.range_verdict(F.col("off"), F.col("off") + F.col("len"), F.col("status"), F.col("received"), F.col("known"))
    return learnt(spark, sf).select("file_id", v.alias("v")).groupBy("file_id", "v.violation", "v.retryable").agg(F.count("*").alias("n"))


@query("ranges", f"""
WITH {RESPONSES}, l AS (SELECT *, first_value(total IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY off, len ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS known FROM resp)
SELECT file_id, known, count(*) AS n FROM l GROUP BY 1, 2
""")
def known_total(spark, sf):
    """The size of each file that its first telling response taught."""
    return learnt(spark, sf).groupBy("file_id", "known").agg(F.count("*").alias("n"))


@query("ranges", "SELECT file_id, off, len, greatest(8000.0::DOUBLE, ceil(len * 9000 / 1048576.0::DOUBLE) * 2000) AS timeout_ms FROM fx_ranges")
def range_timeouts(spark, sf):
    """The time given to each read."""
    return C.ranges(spark, sf).select("file_id", "off", "len", TF.timeout_ms(F.lit(0), F.col("len") * 9000, 8000.0).alias("timeout_ms"))


@query("requests", "SELECT event_id, sid::VARCHAR AS sid, CASE WHEN outcome = 'view' THEN 'page' ELSE 'tile' END AS kind, concat_ws('-', k % 5, k % 2, k % 3, 0) AS key FROM fx_requests WHERE k IS NOT NULL")
def request_paths(spark, sf):
    """The parts of request paths."""
    r = C.requests(spark, sf).where("k is not null")
    key = F.concat_ws("-", *[x.cast("string") for x in (F.col("k") % 5, F.col("k") % 2, F.col("k") % 3, F.lit(0))])
    base = F.concat(F.col("sid").cast("string"), F.lit("/"))
    path = F.when(F.col("outcome") == "view", TF.content_uri(base, key, "page")).otherwise(TF.content_uri(base, key))
    return r.select("event_id", TF.request_parts(path).alias("p")).select("event_id", "p.*")


@query("", "SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) || CASE WHEN regexp_extract(url, '^https?://([^/?#]+)', 1) LIKE '%:%' THEN '' WHEN url LIKE 'https:%' THEN ':443' ELSE ':80' END AS server, CASE WHEN url IS NULL OR url = '' THEN '(none)' WHEN regexp_extract(url, '([^/]+)$', 1) = '' THEN url ELSE split_part(regexp_extract(url, '([^/]+)$', 1), '?', 1) END AS base FROM pages")
def url_parts(spark, sf):
    """Server and last segment of each URL."""
    p = C.table(spark, sf, "pages")
    return p.select("page_id", TF.server_key(F.col("url")).alias("server"), TF.base_name(F.col("url")).alias("base"))


@query("", "SELECT CASE WHEN url IS NULL THEN 'native' WHEN lower(url) LIKE '%blog%' THEN 'blog' WHEN lower(url) LIKE '%/en/%' OR lower(url) LIKE '%/de/%' THEN 'germanic' WHEN lower(url) LIKE '%utm_%' THEN 'tracked' ELSE 'other' END AS label, count(*) AS n FROM pages GROUP BY 1")
def frame_classifier(spark, sf):
    """The first matching label of each URL."""
    rules = {"blog": ["blog"], "germanic": ["/en/", "/de/"], "tracked": ["utm_"]}
    label = F.when(F.col("url").isNull(), "native").otherwise(TF.classified(F.col("url"), rules, F.lit("other")))
    return C.table(spark, sf, "pages").groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query("requests", "SELECT outcome, count(*) AS n, round(sum(coalesce(nullif(CASE WHEN k % 2 = 0 THEN 0 ELSE dur_ms END, 0), nullif(t_ms % 1000, 0), 0)), 1) AS bytes FROM fx_requests GROUP BY 1")
def resource_size_fallback(spark, sf):
    """The first size of each resource that is known and not 0."""
    r = C.requests(spark, sf)
    size = TF.first_size(F.when(F.col("k") % 2 == 0, F.lit(0.0)).otherwise(F.col("dur_ms")), F.col("t_ms") % 1000)
    return r.groupBy("outcome").agg(F.count("*").alias("n"), F.round(F.sum(size), 1).alias("bytes"))


@query("", "SELECT doc_id, substring(text, 3, 5) AS part FROM (SELECT item_id AS doc_id, regexp_replace(coalesce(text, ''), '[^ -~]', '', 'g') AS text FROM benchmark)")
def binary_slice(spark, sf):
    """Bytes 2 to 7 of texts."""
    raw = F.regexp_replace(F.coalesce("text", F.lit("")), "[^ -~]", "").cast("binary")
    b = C.table(spark, sf, "benchmark")
    return b.select(F.col("item_id").alias("doc_id"), TF.bytes_between(raw, F.lit(2), F.lit(7)).cast("string").alias("part"))


SYSTEMS = [
    ("utm", 'PROJCS["UTM 10N",GEOGCS["WGS 84",DATUM["D",SPHEROID["S",6378137,298.25]],UNIT["degree",0.0174]],PROJECTION["Transverse_Mercator"],UNIT["metre",1]]'),
    ("feet", 'COMPD_CS["mixed",PROJCS["State Plane",GEOGCS["NAD83",UNIT["degree",0.0174]],UNIT["foot",0.3048]],VERT_CS["NAVD88",UNIT["metre",1.0]]]'),
    ("geo", 'COMPD_CS["geo",GEOGCS["WGS 84",UNIT["degree",0.0174]],VERT_CS["h",UNIT["foot",0.3048]]]'),
    ("proj", "+proj=lcc +lat_1=43 +units=ft +vunits=m +no_defs"),
    ("factor", "+proj=tmerc +to_meter=0.5 +vto_meter=2"),
    ("bare", "+proj=longlat"),
    ("deep", 'PROJCS["deep",' + "A[" * 40 + '"x"' + "]" * 40 + ',GEOGCS["g",UNIT["degree",0.0174]],UNIT["foot",0.3048]]'),
    ("axes", 'COMPOUNDCRS["axes",PROJCRS["p",CS[Cartesian,2],AXIS["e",east,LENGTHUNIT["metre",2.5]]],VERTCRS["v",CS[vertical,1],AXIS["up",up],LENGTHUNIT["foot",0.3048]]]'),
]


@query("", "SELECT * FROM (VALUES ('utm', 1.0::DOUBLE, 1.0::DOUBLE, false), ('feet', 0.3048::DOUBLE, 1.0::DOUBLE, true), ('geo', 1.0::DOUBLE, 0.3048::DOUBLE, true), ('proj', 0.3048::DOUBLE, 1.0::DOUBLE, false), ('factor', 0.5::DOUBLE, 2.0::DOUBLE, false), ('bare', 1.0::DOUBLE, 1.0::DOUBLE, false), ('deep', 0.3048::DOUBLE, 0.3048::DOUBLE, false), ('axes', 2.5::DOUBLE, 0.3048::DOUBLE, true)) t(name, horizontal, vertical, inner_part)")
def wkt_units(spark, sf):
    """Units of reference systems in several notations."""
    s = spark.createDataFrame(SYSTEMS, "name string, def string")
    return s.select("name", wkt.units(F.col("def")).alias("u")).select("name", "u.horizontal", "u.vertical", F.col("u.compound").alias("inner_part"))


@query("requests", """
WITH o AS (SELECT *, max(CASE WHEN outcome = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY t_ms, event_id) AS active FROM fx_requests),
a AS (SELECT event_id, sid, CASE WHEN active = 0 THEN 'inactive' WHEN dur_ms > 40000 THEN 'timeout' WHEN outcome = 'click' THEN 'data' WHEN outcome = 'view' THEN 'json' WHEN outcome = 'purchase' THEN 'empty' ELSE 'error' END AS answer FROM o WHERE outcome <> 'signup')
SELECT event_id, sid, answer, CASE WHEN answer IN ('data', 'json') THEN 200 WHEN answer = 'empty' THEN 404 ELSE 500 END AS status FROM a
""")
def stream_sessions(spark, sf):
    """Answers of a stream of requests, with the state of sessions."""
    schema = C.table(spark, sf, "events").schema
    # A pattern, as the table may be one file: streams take folders or patterns.
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]")
    r = stream.select("event_id", F.col("user_id").alias("sid"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000.0).alias("t_ms"), (F.col("value") * 60000.0).alias("dur_ms"), F.col("event_type").alias("outcome"))
    return ST.with_status(ST.answer_all(r)).select("event_id", "sid", "answer", "status")


#: Sessions a thousand times as fast, whose errors close them.
CLOSING = "e AS (SELECT event_id, sid, t_ms / 1000.0::DOUBLE AS t, dur_ms, CASE outcome WHEN 'error' THEN 'close' ELSE outcome END AS outcome FROM fx_requests), w AS (SELECT *, last_value(CASE WHEN outcome IN ('signup', 'close') THEN outcome END IGNORE NULLS) OVER (PARTITION BY sid ORDER BY t, event_id) AS state, min(CASE WHEN outcome = 'close' THEN t END) OVER (PARTITION BY sid ORDER BY t, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS closed FROM e)"


def closing(requests):
    return requests.withColumns({"t_ms": F.col("t_ms") / 1000.0, "outcome": F.when(F.col("outcome") == "error", ST.CLOSE).otherwise(F.col("outcome"))})


@query("requests", f"WITH {CLOSING} SELECT event_id, sid, CASE WHEN state IS DISTINCT FROM 'signup' THEN 'inactive' WHEN t + least(dur_ms, 40000) > closed THEN 'aborted' WHEN dur_ms > 40000 THEN 'timeout' WHEN outcome = 'click' THEN 'data' WHEN outcome = 'view' THEN 'json' ELSE 'empty' END AS answer FROM w WHERE outcome NOT IN ('signup', 'close')")
def stream_closes(spark, sf):
    """Answers of sessions that close, which fails what is unanswered."""
    schema = C.table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]")
    r = stream.select("event_id", F.col("user_id").alias("sid"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000.0).alias("t_ms"), (F.col("value") * 60000.0).alias("dur_ms"), F.col("event_type").alias("outcome"))
    return ST.answer_all(closing(r)).select("event_id", "sid", "answer")


@query("requests", f"WITH {CLOSING} SELECT event_id, sid, closed AS closed_ms FROM w WHERE outcome NOT IN ('signup', 'close') AND t + least(dur_ms, 40000) > closed")
def pending_at_close(spark, sf):
    """Requests without an answer when their session closes."""
    return ST.pending_at_close(closing(C.requests(spark, sf)))


@query("ranges", "SELECT file_id % 5 AS d, count(*) AS nodes, min(len) AS smallest, max(len) AS largest, min(off) AS first_off, max(off) AS last_off, max(off) - min(off) AS spread FROM fx_ranges GROUP BY 1")
def chunk_levels(spark, sf):
    """Sizes and offsets of chunks by level."""
    return T.level_chunks(C.ranges(spark, sf).withColumn("d", F.col("file_id") % 5))


@query("", "SELECT c_custkey, c_nationkey + 3 AS asked_id, coalesce(n.n_nationkey, f.id) AS id, coalesce(n.n_name, f.label) AS label FROM customer LEFT JOIN nation n ON n.n_nationkey = c_nationkey + 3, (SELECT n_nationkey AS id, n_name AS label FROM nation ORDER BY n_nationkey LIMIT 1) f")
def dataset_choice(spark, sf):
    """The entry of a catalogue that each asks for, or the first."""
    asked = C.table(spark, sf, "customer").select("c_custkey", (F.col("c_nationkey") + 3).alias("asked_id"))
    return C.chosen_datasets(asked, C.table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label")), "id")
