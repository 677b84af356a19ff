"""Geodesy as columns: geocentric coordinates, distances, longitudes, map projections."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS84 ellipsoid.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)


@dataclass(frozen=True)
class Ellipsoid:
    """Semi-major axis in metres and flattening."""

    a: float = SEMI_MAJOR
    f: float = FLATTENING

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)

    @property
    def e(self) -> float:
        return math.sqrt(self.e2)

    @property
    def n(self) -> float:
        """The third flattening."""
        return self.f / (2 - self.f)


WGS84 = Ellipsoid()


def geocentric(lon: Column, lat: Column, height: Column, on: Ellipsoid = WGS84) -> tuple[Column, Column, Column]:
    """Earth-centred coordinates in metres of degrees and an ellipsoidal height."""
    la, lo = F.radians(lat), F.radians(lon)
    n = F.lit(on.a) / F.sqrt(F.lit(1.0) - F.lit(on.e2) * F.sin(la) * F.sin(la))
    flat = (n + height) * F.cos(la)
    return flat * F.cos(lo), flat * F.sin(lo), (n * F.lit(1 - on.e2) + height) * F.sin(la)


def geodetic(x: Column, y: Column, z: Column, on: Ellipsoid = WGS84) -> tuple[Column, Column, Column]:
    """Degrees and ellipsoidal height of Earth-centred coordinates, by Bowring's formula: within a
    few micrometres up to 20 kilometres from the surface."""
    b, p = on.a * (1 - on.f), F.sqrt(x * x + y * y)
    u = F.atan2(z * on.a, p * b)
    lat = F.atan2(z + F.pow(F.sin(u), 3) * (on.e2 / (1 - on.e2) * b), p - F.pow(F.cos(u), 3) * (on.e2 * on.a))
    s = F.sin(lat)
    height = p * F.cos(lat) + z * s - F.sqrt(F.lit(1.0) - s * s * on.e2) * on.a
    return F.degrees(F.atan2(y, x)), F.degrees(lat), height


def chord(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Straight distance between two points."""
    return F.sqrt(sum(((p - q) * (p - q) for p, q in zip(a[1:], b[1:], strict=True)), (a[0] - b[0]) * (a[0] - b[0])))


def source_metric(dx: Column, dy: Column, dz: Column, unit: float, z_unit: float) -> Column:
    """Squared distance in horizontal units, heights scaled to them."""
    z = dz * F.lit(z_unit / unit)
    return dx * dx + dy * dy + z * z


def wrapped_longitude(lon: Column) -> Column:
    """Degrees from -180 on, below 180."""
    return F.pmod(F.pmod(lon + 180, F.lit(360.0)) + 360, F.lit(360.0)) - 180


def geodetic_latitude(conformal: Column, on: Ellipsoid = WGS84) -> Column:
    """The latitude of a conformal one, both in radians, by a series."""
    n = on.n
    series = (
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
        7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
        56 * n**3 / 15 - 136 * n**4 / 35,
        4279 * n**4 / 630,
    )
    return sum((F.lit(d) * F.sin(2 * k * conformal) for k, d in enumerate(series, 1)), conformal)


@dataclass(frozen=True)
class TransverseMercator:
    """Series of the ellipsoidal transverse Mercator projection (UTM with its defaults)."""

    lon0: float
    scale: float = 0.9996
    x0: float = 500000.0
    y0: float = 0.0
    lat0: float = 0.0
    on: Ellipsoid = WGS84

    @property
    def _radius(self) -> float:
        n = self.on.n
        return self.on.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    @property
    def _series(self) -> tuple[float, ...]:
        n = self.on.n
        return (
            n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
            13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
            61 * n**3 / 240 - 103 * n**4 / 140,
            49561 * n**4 / 161280,
        )

    @property
    def _north(self) -> float:
        """The false northing less the scaled arc of the meridian from the equator to the origin."""
        s, e = math.sin(math.radians(self.lat0)), self.on.e
        xi = math.atan(math.sinh(math.atanh(s) - e * math.atanh(e * s)))
        arc = sum((a * math.sin(2 * k * xi) for k, a in enumerate(self._series, 1)), xi)
        return self.y0 - self.scale * self._radius * arc

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        lo, s = F.radians(lon - self.lon0), F.sin(F.radians(lat))
        e = self.on.e
        t = F.sinh(F.atanh(s) - F.lit(e) * F.atanh(F.lit(e) * s))
        xi, eta = F.atan2(t, F.cos(lo)), F.atanh(F.sin(lo) / F.sqrt(t * t + F.lit(1.0)))
        x = sum((F.lit(a) * F.cos(2 * k * xi) * F.sinh(2 * k * eta) for k, a in enumerate(self._series, 1)), eta)
        y = sum((F.lit(a) * F.sin(2 * k * xi) * F.cosh(2 * k * eta) for k, a in enumerate(self._series, 1)), xi)
        r = F.lit(self.scale * self._radius)
        return r * x + self.x0, r * y + self._north

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        n = self.on.n
        back = (
            n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
            n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
            17 * n**3 / 480 - 37 * n**4 / 840,
            4397 * n**4 / 161280,
        )
        r = self.scale * self._radius
        xi, eta = (y - self._north) / r, (x - self.x0) / r
        xi1 = sum((F.lit(-b) * F.sin(2 * k * xi) * F.cosh(2 * k * eta) for k, b in enumerate(back, 1)), xi)
        eta1 = sum((F.lit(-b) * F.cos(2 * k * xi) * F.sinh(2 * k * eta) for k, b in enumerate(back, 1)), eta)
        chi = F.asin(F.sin(xi1) / F.cosh(eta1))
        return F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))) + self.lon0, F.degrees(geodetic_latitude(chi, self.on))


def utm(zone: int, south: bool = False) -> TransverseMercator:
    return TransverseMercator(zone * 6 - 183, y0=1e7 if south else 0.0)


@dataclass(frozen=True)
class ConformalConic:
    """Lambert's conformal conic projection with two standard parallels."""

    lat1: float
    lat2: float
    lat0: float
    lon0: float
    x0: float = 0.0
    y0: float = 0.0
    to_meter: float = 1.0
    scale: float = 1.0
    on: Ellipsoid = WGS84

    def _constants(self) -> tuple[float, float, float]:
        e, e2 = self.on.e, self.on.e2
        m = lambda p: math.cos(p) / math.sqrt(1 - e2 * math.sin(p) ** 2)
        t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
        p1, p2, p0 = (math.radians(v) for v in (self.lat1, self.lat2, self.lat0))
        n = math.sin(p1) if p1 == p2 else (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
        f = self.scale * self.on.a * m(p1) / (n * t(p1) ** n)
        return n, f, f * t(p0) ** n

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        n, af, rho0 = self._constants()
        e, p = self.on.e, F.radians(lat)
        es = F.lit(e) * F.sin(p)
        t = F.tan(F.lit(math.pi / 4) - p / 2) / F.pow((1 - es) / (1 + es), F.lit(e / 2))
        rho, theta = F.lit(af) * F.pow(t, F.lit(n)), F.lit(n) * F.radians(lon - self.lon0)
        return (rho * F.sin(theta) + self.x0) / self.to_meter, (F.lit(rho0) - rho * F.cos(theta) + self.y0) / self.to_meter

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        n, af, rho0 = self._constants()
        sign = math.copysign(1.0, n)
        dx, dy = x * self.to_meter - self.x0, F.lit(rho0) - (y * self.to_meter - self.y0)
        t = F.pow(F.sqrt(dx * dx + dy * dy) / abs(af), F.lit(1 / abs(n)))
        p = geodetic_latitude(F.lit(math.pi / 2) - 2 * F.atan(t), self.on)
        # South of the equator the cone opens to the other side, and t grows to the other pole.
        return F.degrees(F.atan2(sign * dx, sign * dy) / n) + self.lon0, F.degrees(p if n > 0 else -p)


@dataclass(frozen=True)
class WebMercator:
    """The spherical Mercator projection of web maps."""

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return F.radians(lon) * SEMI_MAJOR, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * SEMI_MAJOR

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        return F.degrees(x / SEMI_MAJOR), F.degrees(2 * F.atan(F.exp(y / SEMI_MAJOR)) - math.pi / 2)


@dataclass(frozen=True)
class LongLat:
    """Degrees as they are."""

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return lon, lat

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        return x, y


def checked_position(lon: Column, lat: Column) -> Column:
    """True, or an error where a position is not finite or out of range."""
    good = lon.between(-180, 180) & lat.between(-90, 90) & ~F.isnan(lon) & ~F.isnan(lat)
    return F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("position out of range: "), lon.cast("string"), F.lit(", "), lat.cast("string"))).cast("boolean"))


def axis_validity(low: list[Column], high: list[Column]) -> Column:
    """Which axes of header bounds can be used (finite, not inverted) and which have a span:
    flat ones both, heights of their own; one flat axis with a span is enough."""
    finite = [~F.isnan(v) & (F.abs(v) < float("inf")) for v in (*low, *high)]
    usable = [finite[i] & finite[i + 3] & (high[i] >= low[i]) for i in range(3)]
    flat, heights = usable[0] & usable[1], usable[2]
    return F.struct(
        flat.alias("xy_usable"),
        (flat & ((high[0] > low[0]) | (high[1] > low[1]))).alias("xy_has_span"),
        heights.alias("z_usable"),
        (heights & (high[2] > low[2])).alias("z_has_span"),
    )


def from_scaled(value: Column, scale: float, offset: float) -> Column:
    """A coordinate of its stored whole number."""
    return value * F.lit(scale) + F.lit(offset)
