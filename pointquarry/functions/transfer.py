"""Byte-range responses, request paths and names as columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# HTTP codes after which a range is asked for again.
RETRYABLE = [429, 500, 502, 503, 504]
MIB = 1 << 20


def timeout_ms(begin: Column, end: Column, base_ms: float) -> Column:
    """Two seconds for each begun MiB, the base at least."""
    return F.greatest(F.lit(float(base_ms)), F.ceil((end - begin) / F.lit(float(MIB))) * 2000.0)


def total_size(content_range: Column) -> Column:
    """The total of a Content-Range header; null if unknown."""
    return F.nullif(F.regexp_extract(content_range, r"/\s*(\d+)\s*$", 1), F.lit("")).cast("long")


def range_verdict(begin: Column, end: Column, status: Column, received: Column, total: Column) -> Column:
    """(violation, retryable) of a response; a null violation is a good one.

    ``total`` is the size learnt before, or else that of this response.
    """
    wanted = end - begin
    violation = (
        F.when(status != 206, "range ignored")
        .when(received == wanted, F.lit(None).cast("string"))
        .when(received > wanted, "too many bytes")
        .when(total.isNotNull() & (begin + received >= total), F.lit(None).cast("string"))
        .otherwise("cut short")
    )
    return F.struct(violation.alias("violation"), F.coalesce(violation == "cut short", F.lit(False)).alias("retryable"))


def retryable_status(status: Column) -> Column:
    return status.isin(RETRYABLE)


def request_parts(path: Column) -> Column:
    """(sid, kind, key) of ``sid/key.pnts`` or ``sid/page/key.json``."""
    rest = F.regexp_extract(path, r"^[^/]*/(.*)$", 1)
    page = F.startswith(rest, F.lit("page/"))
    return F.struct(
        F.substring_index(path, "/", 1).alias("sid"),
        F.when(page, "page").otherwise("tile").alias("kind"),
        F.when(page, F.regexp_extract(rest, r"^page/(.*)\.json$", 1)).otherwise(F.regexp_extract(rest, r"^(.*)\.pnts$", 1)).alias("key"),
    )


def content_uri(base: Column, key: Column, kind: str = "tile") -> Column:
    return F.concat(base, key, F.lit(".pnts")) if kind == "tile" else F.concat(base, F.lit("page/"), key, F.lit(".json"))


def server_key(url: Column) -> Column:
    """Host and port of a URL, the scheme's port where it names none."""
    host = F.regexp_extract(url, r"^https?://([^/?#]+)", 1)
    return F.when(host.contains(":"), host).otherwise(F.concat(host, F.when(F.startswith(url, F.lit("https:")), ":443").otherwise(":80")))


def base_name(url: Column, missing: str = "(none)") -> Column:
    """The last segment of a URL without its query."""
    last = F.regexp_extract(url, r"([^/]+)$", 1)
    return F.when(url.isNull() | (url == ""), F.lit(missing)).when(last == "", url).otherwise(F.substring_index(last, "?", 1))


def file_stem(path: Column) -> Column:
    """The last segment without the endings of point-cloud files."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*[/\\]", ""), r"(\.copc)?\.laz$", "")


def classified(name: Column, rules: Mapping[str, Sequence[str]], default: Column) -> Column:
    """The first label with a part that stands in the name, whatever its case."""
    lower, out = F.lower(name), F
    for label, parts in rules.items():
        hit = lower.contains(parts[0])
        for p in parts[1:]:
            hit = hit | lower.contains(p)
        out = out.when(hit, F.lit(label))
    return out.otherwise(default)


def clear_message(message: Column, clear: str, opaque: str) -> Column:
    """Whether an error message names its reason: it matches ``clear`` and not ``opaque``."""
    return message.rlike(f"(?i){clear}") & ~message.rlike(f"(?i){opaque}")


def first_size(*sizes: Column) -> Column:
    """The first of several sizes that is known and not 0, or else 0."""
    return F.coalesce(*[F.nullif(s, F.lit(0).cast("double")) for s in sizes], F.lit(0.0))


def response_status(outcome: Column) -> Column:
    """The HTTP status of an answer: data and pages 200, an empty tile 404, no client 503, errors 500."""
    return F.when(outcome == "empty", 404).when(outcome.isin("data", "json"), 200).when(outcome == "no client", 503).otherwise(500)


def bytes_between(data: Column, begin: Column, end: Column) -> Column:
    """A half-open slice of binary data."""
    return F.substring(data, begin.cast("int") + 1, (end - begin).cast("int"))
