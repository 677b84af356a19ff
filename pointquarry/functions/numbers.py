"""Rounding, truncation, wrapping and alignment as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Nearest whole number, halves toward plus infinity."""
    return F.floor(x + F.lit(0.5))


def truncated(x: Column) -> Column:
    """A 32-bit whole number, cut toward zero."""
    return x.cast("int")


def or_default(x: Column, default: float) -> Column:
    """``x``, or the default where it is 0, NaN or null."""
    return F.when(x.isNull() | F.isnan(x) | (x == 0), F.lit(float(default))).otherwise(x)


def clamped(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def aligned(x: Column, size: int) -> Column:
    """The next multiple of ``size``."""
    return (F.ceil(x / F.lit(size)) * F.lit(size)).cast("long")


def quantised(x: Column, low: Column, extent: Column) -> Column:
    """``x`` within [low, low + extent] as 0 to 65535."""
    return clamped(half_up((x - low) / extent * F.lit(65535.0)), 0, 65535).cast("int")


def dequantised(q: Column, low: Column, extent: Column) -> Column:
    return q / F.lit(65535.0) * extent + low


# Bits and signedness of the integer component types of a batch table.
INTEGER_TYPES = {
    "BYTE": (8, True),
    "UNSIGNED_BYTE": (8, False),
    "SHORT": (16, True),
    "UNSIGNED_SHORT": (16, False),
    "INT": (32, True),
    "UNSIGNED_INT": (32, False),
}


def component_range(kind: str) -> tuple[int, int] | None:
    """Smallest and largest value of a component type; none for FLOAT and DOUBLE."""
    if kind not in INTEGER_TYPES:
        return None
    bits, signed = INTEGER_TYPES[kind]
    return (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1) if signed else (0, 2**bits - 1)


def fits(x: Column, kind: str) -> Column:
    """Whether a value is within its component type."""
    bounds = component_range(kind)
    return F.lit(True) if bounds is None else x.between(*bounds)


def wrapped(x: Column, kind: str) -> Column:
    """The value as a component type holds it: cut toward zero, then modulo its width."""
    bounds = component_range(kind)
    if bounds is None:
        return x.cast("float" if kind == "FLOAT" else "double")
    low, high = bounds
    return (F.pmod(x.cast("long") - F.lit(low), F.lit(high - low + 1)) + F.lit(low)).cast("long")


def amdahl(parallel: Column, workers: Column) -> Column:
    """Speed-up of a part that runs on several workers."""
    return F.lit(1.0) / ((F.lit(1.0) - parallel) + parallel / workers)


def percent_delta(ours: Column, base: Column) -> Column:
    """Signed whole per cent against a base, ``n/a`` without one."""
    delta = (ours - base) / base * 100
    rounded = half_up(delta).cast("long")
    return F.when(base == 0, F.lit("n/a")).otherwise(F.concat(F.when(delta > 0, "+").otherwise(""), rounded.cast("string"), F.lit("%")))


def iso_time(ms: Column) -> Column:
    """The time of milliseconds since 1970 in UTC, as ISO 8601 text, whatever zone the session has."""
    t = F.floor(ms)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(t / 86_400_000).cast("int"))
    part = [F.pmod(F.floor(t / by), F.lit(n)) for by, n in ((3_600_000, 24), (60_000, 60), (1000, 60), (1, 1000))]
    return F.concat(day.cast("string"), F.format_string("T%02d:%02d:%02d.%03dZ", *part))
