"""Colours of points as columns: ramps, palettes and style rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pointquarry.functions.numbers import clamped, half_up, or_default

# Colours of classification codes, of other codes, and of return numbers from 1 on.
CLASS_COLORS = {
    0: (155, 155, 155),
    1: (180, 180, 180),
    2: (166, 116, 64),
    3: (124, 197, 84),
    4: (70, 168, 60),
    5: (38, 115, 38),
    6: (220, 90, 70),
    7: (255, 0, 110),
    9: (60, 130, 220),
    11: (120, 120, 120),
    17: (200, 200, 90),
}
OTHER_CLASS = (150, 150, 150)
RETURN_COLORS = [(230, 25, 75), (245, 130, 48), (255, 225, 25), (60, 180, 75), (0, 130, 200), (145, 30, 180), (240, 50, 230)]
# The default colours of a style ramp.
RAMP = ["rgb(43,131,186)", "rgb(171,221,164)", "rgb(255,255,191)", "rgb(253,174,97)", "rgb(215,25,28)"]

CHANNELS = ("red", "green", "blue")
#: Hue of the lowest value, as a part of the circle; the highest has hue 0.
TOP_HUE = 0.66


def rgb(r: Column, g: Column, b: Column) -> Column:
    return F.struct(*[c.cast("int").alias(n) for n, c in zip(CHANNELS, (r, g, b), strict=True)])


def channel(hue: Column, low: Column, high: Column) -> Column:
    """One channel of a hue between the darkest and the lightest of a colour."""
    h = F.when(hue < 0, hue + 1).when(hue > 1, hue - 1).otherwise(hue)
    return F.when(h * 6 < 1, low + (high - low) * h * 6).when(h * 2 < 1, high).when(h * 3 < 2, low + (high - low) * (F.lit(2.0) / 3 - h) * 6).otherwise(low)


def hsl(hue: Column, saturation: Column, lightness: Column) -> Column:
    """Red, green and blue (0 to 255) of a hue, saturation and lightness (0 to 1)."""
    high = F.when(lightness <= 0.5, lightness * (saturation + 1)).otherwise(lightness + saturation - lightness * saturation)
    low = lightness * 2 - high
    return rgb(*[half_up(channel(hue + shift, low, high) * 255) for shift in (F.lit(1.0) / 3, F.lit(0.0), F.lit(-1.0) / 3)])


def ramp(value: Column, low: Column, high: Column) -> Column:
    """Blue for the lowest value to red for the highest; without a span all are lowest."""
    t = clamped((value - low) / or_default(high - low, 1), 0.0, 1.0)
    return hsl((F.lit(1.0) - t) * TOP_HUE, F.lit(1.0), F.lit(0.5))


def class_color(code: Column) -> Column:
    """The colour of a classification code, grey for others."""
    table = F.create_map(*[x for k, v in CLASS_COLORS.items() for x in (F.lit(k), rgb(*map(F.lit, v)))])
    return F.coalesce(table[code], rgb(*map(F.lit, OTHER_CLASS)))


def return_color(number: Column) -> Column:
    """The colour of a return number; those beyond the palette take its ends."""
    table = F.array(*[rgb(*map(F.lit, v)) for v in RETURN_COLORS])
    return F.get(table, clamped(number.cast("int") - 1, 0, len(RETURN_COLORS) - 1).cast("int"))


def eight_bit(value: Column, largest: Column) -> Column:
    """A channel in 8 bits: the upper ones if any value needs more, modulo 256."""
    return F.pmod(F.when(largest > 255, F.shiftright(value.cast("int"), 8)).otherwise(value.cast("int")), F.lit(256))


def ramp_style(value: Column, low: float, high: float, palette: Sequence[str] = tuple(RAMP)) -> Column:
    """The colour of the first of equal steps whose upper end a value does not pass; the last beyond."""
    if not palette:
        raise ValueError("a palette needs a colour")
    span = (high - low) or 1
    out = F
    for k, color in enumerate(palette, 1):
        out = out.when(value <= low + span * k / len(palette), F.lit(color))
    return out.otherwise(F.lit(palette[-1]))


def hue_bin(r: Column, g: Column, b: Column, bins: int = 36, dark: int = 10, grey: int = 12) -> Column:
    """The bin of a colour's hue; null if it is near black or grey."""
    most, least = F.greatest(r, g, b), F.least(r, g, b)
    d = (most - least).cast("double")
    h = F.when(most == r, (g - b) / d).when(most == g, (b - r) / d + 2).otherwise((r - g) / d + 4)
    bin_ = F.least(F.lit(bins - 1), F.floor((h * 60 % 360 + 360) % 360 / (360 / bins)))
    return F.when((most > dark) & (d >= grey), bin_).cast("int")
