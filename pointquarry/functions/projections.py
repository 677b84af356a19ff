"""Further map projections of an ellipsoid, and changes of datum, as columns.

Each has ``forward`` from degrees to lengths in metres and ``inverse``. Formulas are those of the public guidance on map
projections; latitudes come back by series of the third flattening, without iteration.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from pointquarry.functions.geodesy import WGS84, Ellipsoid, geocentric, geodetic, geodetic_latitude


def isometric(lat: Column, on: Ellipsoid) -> Column:
    """The isometric latitude of one in radians."""
    s = F.sin(lat)
    return F.atanh(s) - F.atanh(s * on.e) * on.e


def isometric_of(lat: float, on: Ellipsoid) -> float:
    s = math.sin(lat)
    return math.atanh(s) - on.e * math.atanh(on.e * s)


def of_isometric(psi: Column, on: Ellipsoid) -> Column:
    """The latitude in radians of an isometric one."""
    return geodetic_latitude(F.atan(F.sinh(psi)), on)


def parallel(lat: float, on: Ellipsoid) -> float:
    """The radius of a parallel over the semi-major axis."""
    return math.cos(lat) / math.sqrt(1 - on.e2 * math.sin(lat) ** 2)


def authalic(lat: Column, on: Ellipsoid) -> Column:
    """Twice the area from the equator to a latitude, by radian of longitude and square of the semi-major axis."""
    s = F.sin(lat)
    return (s / (F.lit(1.0) - s * s * on.e2) + F.atanh(s * on.e) / on.e) * (1 - on.e2)


def authalic_of(lat: float, on: Ellipsoid) -> float:
    s = math.sin(lat)
    return (1 - on.e2) * (s / (1 - on.e2 * s * s) + math.atanh(on.e * s) / on.e)


def of_authalic(q: Column, on: Ellipsoid) -> Column:
    """The latitude in radians that has this area."""
    n, xi = on.n, F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), q / authalic_of(math.pi / 2, on))))
    series = (
        4 * n / 3 + 4 * n**2 / 45 - 16 * n**3 / 35 - 2582 * n**4 / 14175,
        46 * n**2 / 45 + 152 * n**3 / 945 - 11966 * n**4 / 14175,
        3044 * n**3 / 2835 + 3802 * n**4 / 14175,
        6059 * n**4 / 4725,
    )
    return sum((F.lit(d) * F.sin(2 * k * xi) for k, d in enumerate(series, 1)), xi)


def stepwise(values: tuple[Column, ...], *steps: Callable[[tuple[Column, ...]], tuple[Column, ...]]) -> tuple[Column, Column]:
    """Two columns after all steps, each of which sees the results of the one before as values and not as expressions: a
    step that uses one many times doesn't compute it as often."""
    widths = [len(values)]

    def taken(step: Callable) -> Callable[[Column], Column]:
        def of(held: Column) -> Column:
            found = step(tuple(held[f"v{i}"] for i in range(widths[-1])))
            widths.append(len(found))
            return F.struct(*[c.alias(f"v{i}") for i, c in enumerate(found)])

        return of

    held = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    for step in steps:
        held = F.element_at(F.transform(F.array(held), taken(step)), 1)
    return held["v0"], held["v1"]


@dataclass(frozen=True)
class Mercator:
    """The ellipsoidal Mercator projection, by its scale on the equator or a true parallel."""

    lon0: float = 0.0
    scale: float = 1.0
    x0: float = 0.0
    y0: float = 0.0
    lat_ts: float | None = None
    on: Ellipsoid = WGS84

    @property
    def _radius(self) -> float:
        return self.on.a * (self.scale if self.lat_ts is None else parallel(math.radians(self.lat_ts), self.on))

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return F.radians(lon - self.lon0) * self._radius + self.x0, isometric(F.radians(lat), self.on) * self._radius + self.y0

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        return F.degrees((x - self.x0) / self._radius) + self.lon0, F.degrees(of_isometric((y - self.y0) / self._radius, self.on))


@dataclass(frozen=True)
class AlbersConic:
    """Albers' equal-area conic projection with two standard parallels."""

    lat1: float
    lat2: float
    lat0: float
    lon0: float
    x0: float = 0.0
    y0: float = 0.0
    on: Ellipsoid = WGS84

    def _constants(self) -> tuple[float, float, float]:
        """n, C and the radius of the origin's parallel over the semi-major axis."""
        p1, p2, p0 = (math.radians(v) for v in (self.lat1, self.lat2, self.lat0))
        m1, m2 = parallel(p1, self.on) ** 2, parallel(p2, self.on) ** 2
        q1, q2 = authalic_of(p1, self.on), authalic_of(p2, self.on)
        n = math.sin(p1) if p1 == p2 else (m1 - m2) / (q2 - q1)
        c = m1 + n * q1
        return n, c, math.sqrt(c - n * authalic_of(p0, self.on)) / n

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        n, c, rho0 = self._constants()
        rho, theta = F.sqrt(F.lit(c) - authalic(F.radians(lat), self.on) * n) / n, F.radians(lon - self.lon0) * n
        return rho * F.sin(theta) * self.on.a + self.x0, (F.lit(rho0) - rho * F.cos(theta)) * self.on.a + self.y0

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        n, c, rho0 = self._constants()
        sign = math.copysign(1.0, n)
        dx, dy = (x - self.x0) / self.on.a, F.lit(rho0) - (y - self.y0) / self.on.a
        q = (F.lit(c) - (dx * dx + dy * dy) * (n * n)) / n
        return F.degrees(F.atan2(dx * sign, dy * sign) / n) + self.lon0, F.degrees(of_authalic(q, self.on))


@dataclass(frozen=True)
class ObliqueStereographic:
    """The double stereographic projection: to a conformal sphere, and from that to a plane."""

    lat0: float
    lon0: float
    scale: float = 1.0
    x0: float = 0.0
    y0: float = 0.0
    on: Ellipsoid = WGS84

    def _constants(self) -> tuple[float, float, float, float]:
        """n, the constant of isometric latitudes, the origin's latitude on the sphere, and twice the scaled radius."""
        p, e2 = math.radians(self.lat0), self.on.e2
        w = 1 - e2 * math.sin(p) ** 2
        n = math.sqrt(1 + e2 * math.cos(p) ** 4 / (1 - e2))
        chi = math.asin(math.sin(p) / n)
        radius = self.on.a * math.sqrt(1 - e2) / w
        return n, math.atanh(math.sin(chi)) - n * isometric_of(p, self.on), chi, 2 * radius * self.scale

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        n, c, chi0, r = self._constants()
        psi, lo = isometric(F.radians(lat), self.on) * n + c, F.radians(lon - self.lon0) * n
        s, k = F.tanh(psi), F.lit(1.0) / F.cosh(psi)
        b = F.lit(1.0) + s * math.sin(chi0) + k * F.cos(lo) * math.cos(chi0)
        return k * F.sin(lo) / b * r + self.x0, (s * math.cos(chi0) - k * F.cos(lo) * math.sin(chi0)) / b * r + self.y0

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        n, c, chi0, r = self._constants()
        dx, dy = (x - self.x0) / r, (y - self.y0) / r
        d2 = dx * dx + dy * dy
        # Sine and cosine of the angle from the origin, over the distance.
        k, g = F.lit(2.0) / (d2 + F.lit(1.0)), (F.lit(1.0) - d2) / (d2 + F.lit(1.0))
        s = g * math.sin(chi0) + dy * k * math.cos(chi0)
        lo = F.atan2(dx * k, g * math.cos(chi0) - dy * k * math.sin(chi0))
        return F.degrees(lo / n) + self.lon0, F.degrees(of_isometric((F.atanh(s) - c) / n, self.on))


@dataclass(frozen=True)
class PolarStereographic:
    """The stereographic projection from a pole (``lat0`` 90 or -90), by its scale there or a true parallel."""

    lat0: float
    lon0: float
    scale: float = 1.0
    x0: float = 0.0
    y0: float = 0.0
    lat_ts: float | None = None
    on: Ellipsoid = WGS84

    def _constants(self) -> tuple[float, float]:
        sign, e = math.copysign(1.0, self.lat0), self.on.e
        if self.lat_ts is None or abs(self.lat_ts) == 90:
            return sign, 2 * self.on.a * self.scale / math.sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e))
        p = abs(math.radians(self.lat_ts))
        return sign, self.on.a * parallel(p, self.on) * math.exp(isometric_of(p, self.on))

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        sign, r = self._constants()
        rho, lo = F.exp(-isometric(F.radians(lat) * sign, self.on)) * r, F.radians(lon - self.lon0)
        return rho * F.sin(lo) + self.x0, rho * F.cos(lo) * -sign + self.y0

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        sign, r = self._constants()
        dx, dy = x - self.x0, (y - self.y0) * -sign
        return F.degrees(F.atan2(dx, dy)) + self.lon0, F.degrees(of_isometric(-F.log(F.sqrt(dx * dx + dy * dy) / r), self.on)) * sign


@dataclass(frozen=True)
class EqualAreaAzimuthal:
    """Lambert's azimuthal equal-area projection, from an origin that is no pole."""

    lat0: float
    lon0: float
    x0: float = 0.0
    y0: float = 0.0
    on: Ellipsoid = WGS84

    def _constants(self) -> tuple[float, float, float]:
        """The origin's authalic latitude, the authalic radius, and the stretch of the axes."""
        p, top = math.radians(self.lat0), authalic_of(math.pi / 2, self.on)
        beta, r = math.asin(authalic_of(p, self.on) / top), self.on.a * math.sqrt(top / 2)
        return beta, r, self.on.a * parallel(p, self.on) / (r * math.cos(beta))

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        beta0, r, d = self._constants()
        beta, lo = F.asin(authalic(F.radians(lat), self.on) / authalic_of(math.pi / 2, self.on)), F.radians(lon - self.lon0)
        b = F.sqrt(F.lit(2.0) / (F.lit(1.0) + F.sin(beta) * math.sin(beta0) + F.cos(beta) * F.cos(lo) * math.cos(beta0))) * r
        return b * F.cos(beta) * F.sin(lo) * d + self.x0, b / d * (F.sin(beta) * math.cos(beta0) - F.cos(beta) * F.cos(lo) * math.sin(beta0)) + self.y0

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        beta0, r, d = self._constants()
        dx, dy = (x - self.x0) / (r * d), (y - self.y0) * (d / r)
        d2 = dx * dx + dy * dy
        # Sine and cosine of the angle from the origin; the sine over the distance.
        k, g = F.sqrt(F.lit(1.0) - d2 / 4), F.lit(1.0) - d2 / 2
        q = (g * math.sin(beta0) + dy * k * math.cos(beta0)) * authalic_of(math.pi / 2, self.on)
        return F.degrees(F.atan2(dx * k, g * math.cos(beta0) - dy * k * math.sin(beta0))) + self.lon0, F.degrees(of_authalic(q, self.on))


@dataclass(frozen=True)
class ObliqueMercator:
    """Hotine's oblique Mercator projection by an azimuth at its centre; false coordinates hold at the
    centre, or with ``natural`` where the central line meets the aposphere's equator."""

    lat0: float
    lon0: float
    azimuth: float
    rectified: float
    scale: float = 1.0
    x0: float = 0.0
    y0: float = 0.0
    natural: bool = False
    on: Ellipsoid = WGS84

    def _constants(self) -> tuple[float, ...]:
        """B, A / B, the logarithm of H, the central line's angle and longitude at the equator, and the centre's place on the line."""
        p, e2, az = math.radians(self.lat0), self.on.e2, math.radians(self.azimuth)
        b = math.sqrt(1 + e2 * math.cos(p) ** 4 / (1 - e2))
        a = self.on.a * b * self.scale * math.sqrt(1 - e2) / (1 - e2 * math.sin(p) ** 2)
        d = max(1.0, b * math.sqrt(1 - e2) / parallel(p, self.on) / (1 - e2 * math.sin(p) ** 2))
        sign = math.copysign(1.0, p)
        f = d + math.sqrt(d * d - 1) * sign
        angle = math.asin(math.sin(az) / d)
        lon = math.radians(self.lon0) - math.asin((f - 1 / f) / 2 * math.tan(angle)) / b
        centre = a / b * math.atan2(math.sqrt(d * d - 1), math.cos(az)) * sign
        return b, a / b, math.log(f) - b * isometric_of(p, self.on), angle, lon, 0.0 if self.natural else centre

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        b, ab, h, angle, lon0, centre = self._constants()
        q, lo = isometric(F.radians(lat), self.on) * b + h, (F.radians(lon) - lon0) * b
        s, v = F.sinh(q), F.sin(lo)
        across = F.atanh((v * -math.cos(angle) + s * math.sin(angle)) / F.cosh(q)) * -ab
        along = F.atan2(s * math.cos(angle) + v * math.sin(angle), F.cos(lo)) * ab - centre
        g = math.radians(self.rectified)
        return across * math.cos(g) + along * math.sin(g) + self.x0, along * math.cos(g) - across * math.sin(g) + self.y0

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        b, ab, h, angle, lon0, centre = self._constants()
        g, dx, dy = math.radians(self.rectified), x - self.x0, y - self.y0
        across, along = (dx * math.cos(g) - dy * math.sin(g)) / -ab, (dy * math.cos(g) + dx * math.sin(g) + centre) / ab
        s, v = F.sinh(across), F.sin(along)
        psi = (F.atanh((v * math.cos(angle) + s * math.sin(angle)) / F.cosh(across)) - h) / b
        lon = F.lit(lon0) - F.atan2(s * math.cos(angle) - v * math.sin(angle), F.cos(along)) / b
        return F.degrees(lon), F.degrees(of_isometric(psi, self.on))


@dataclass(frozen=True)
class Datum:
    """A projection whose degrees are of another datum: its ellipsoid, and three shifts in metres, or with three rotations in
    seconds of arc and a scale in millionths, that lead to WGS 84 (position vectors are turned)."""

    inner: object
    on: Ellipsoid
    shift: tuple[float, ...]

    def _moved(self, p: tuple[Column, ...], back: bool) -> tuple[Column, ...]:
        dx, dy, dz, rx, ry, rz, ppm = (*self.shift, *[0.0] * (7 - len(self.shift)))
        rx, ry, rz = (math.radians(r / 3600) for r in (rx, ry, rz))
        k = 1 + ppm * 1e-6
        if back:
            x, y, z = ((c - d) / k for c, d in zip(p, (dx, dy, dz), strict=True))
            return x + y * rz - z * ry, y - x * rz + z * rx, z + x * ry - y * rx
        x, y, z = p
        return (x - y * rz + z * ry) * k + dx, (x * rz + y - z * rx) * k + dy, (y * rx - x * ry + z) * k + dz

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        steps = (lambda p: geocentric(*p, F.lit(0.0)), lambda p: self._moved(p, back=True), lambda p: geodetic(*p, self.on)[:2], lambda p: self.inner.forward(*p))
        return stepwise((lon, lat), *steps)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        steps = (lambda p: self.inner.inverse(*p), lambda p: geocentric(*p, F.lit(0.0), self.on), lambda p: self._moved(p, back=False), lambda p: geodetic(*p)[:2])
        return stepwise((x, y), *steps)
