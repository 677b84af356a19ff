"""Coordinate reference systems in well-known text or as projection strings: their units, and
the projection they name.

A text is read once into a tree of its nodes, however deep they nest, after the grammar of the public
standard (ISO 19162 and the older OGC 01-009): a keyword, and in brackets strings, numbers, names and nodes.
A projection string is a map of its ``+key=value`` pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from pointquarry.functions import geodesy, projections

# Fixed values of the public standards: metres of named units, and the keywords of kinds of nodes.
NAMED_UNITS = {"m": 1.0, "ft": 0.3048, "us-ft": 1200 / 3937}
PROJECTED, GEOGRAPHIC = {"PROJCS", "PROJCRS"}, {"GEOGCS", "GEOGCRS", "GEOGRAPHICCRS"}
VERTICAL, COMPOUND = {"VERT_CS", "VERTCS", "VERTCRS", "VERTICALCRS"}, {"COMPD_CS", "COMPOUNDCRS"}
LENGTH, METHOD = {"UNIT", "LENGTHUNIT"}, {"PROJECTION", "METHOD"}
# Names of projections and of their parameters in both versions of the standard.
METHODS = {
    "transverse_mercator": "tmerc",
    "lambert_conformal_conic_2sp": "lcc",
    "lambert_conformal_conic_1sp": "lcc",
    "lambert_conic_conformal_(2sp)": "lcc",
    "lambert_conic_conformal_(1sp)": "lcc",
    "lambert_conformal_conic": "lcc",
    "lambert_conformal_conic_2sp_belgium": "lcc",
    "mercator": "merc",
    "mercator_1sp": "merc",
    "mercator_2sp": "merc",
    "mercator_(variant_a)": "merc",
    "mercator_(variant_b)": "merc",
    "albers": "aea",
    "albers_conic_equal_area": "aea",
    "albers_equal_area": "aea",
    "oblique_stereographic": "sterea",
    "double_stereographic": "sterea",
    "polar_stereographic": "stere",
    "polar_stereographic_(variant_a)": "stere",
    "polar_stereographic_(variant_b)": "stere",
    "lambert_azimuthal_equal_area": "laea",
    "hotine_oblique_mercator": "omerc_natural",
    "hotine_oblique_mercator_(variant_a)": "omerc_natural",
    "hotine_oblique_mercator_azimuth_natural_origin": "omerc_natural",
    "oblique_mercator": "omerc",
    "hotine_oblique_mercator_(variant_b)": "omerc",
    "hotine_oblique_mercator_azimuth_center": "omerc",
    "popular_visualisation_pseudo_mercator": "webmerc",
    "mercator_auxiliary_sphere": "webmerc",
}
PARAMETERS = {
    "latitude_of_origin": "lat_0",
    "latitude_of_natural_origin": "lat_0",
    "latitude_of_false_origin": "lat_0",
    "latitude_of_center": "lat_0",
    "latitude_of_projection_centre": "lat_0",
    "longitude_of_center": "lon_0",
    "longitude_of_projection_centre": "lon_0",
    "latitude_of_standard_parallel": "lat_ts",
    "longitude_of_origin": "lon_0",
    "azimuth": "alpha",
    "azimuth_of_initial_line": "alpha",
    "azimuth_at_projection_centre": "alpha",
    "rectified_grid_angle": "gamma",
    "angle_from_rectified_to_skew_grid": "gamma",
    "scale_factor_on_initial_line": "k",
    "scale_factor_at_projection_centre": "k",
    "central_meridian": "lon_0",
    "longitude_of_natural_origin": "lon_0",
    "longitude_of_false_origin": "lon_0",
    "standard_parallel_1": "lat_1",
    "latitude_of_1st_standard_parallel": "lat_1",
    "standard_parallel_2": "lat_2",
    "latitude_of_2nd_standard_parallel": "lat_2",
    "scale_factor": "k",
    "scale_factor_at_natural_origin": "k",
    "false_easting": "x_0",
    "easting_at_false_origin": "x_0",
    "easting_at_projection_centre": "x_0",
    "false_northing": "y_0",
    "northing_at_false_origin": "y_0",
    "northing_at_projection_centre": "y_0",
}
# Semi-major axis and inverse flattening of named ellipsoids, and ellipsoid and shift of named datums.
ELLIPSOIDS = {
    "WGS84": (6378137.0, 298.257223563),
    "GRS80": (6378137.0, 298.257222101),
    "airy": (6377563.396, 299.3249646),
    "mod_airy": (6377340.189, 299.3249646),
    "bessel": (6377397.155, 299.1528128),
    "clrk66": (6378206.4, 294.9786982),
    "clrk80": (6378249.145, 293.4663),
    "intl": (6378388.0, 297.0),
    "krass": (6378245.0, 298.3),
    "aust_SA": (6378160.0, 298.25),
}
DATUMS = {
    "WGS84": ("WGS84", ()),
    "NAD83": ("GRS80", ()),
    "OSGB36": ("airy", (446.448, -125.157, 542.06, 0.15, 0.247, 0.842, -20.489)),
    "potsdam": ("bessel", (598.1, 73.7, 418.2, 0.202, 0.045, -2.455, 6.7)),
    "ire65": ("mod_airy", (482.53, -130.596, 564.557, -1.042, -0.214, -0.631, 8.15)),
}
TOKEN = re.compile(r'"((?:[^"]|"")*)"|([A-Za-z_]\w*)|([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)|([\[(])|([\])])')


@dataclass
class Node:
    """A node of well-known text; ``parts`` are strings, numbers and nodes in their order."""

    kind: str
    parts: list = field(default_factory=list)

    @property
    def nodes(self) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node)]

    def walk(self) -> Iterator[Node]:
        """This node and all below, in the order of the text."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += reversed(node.nodes)

    def first(self, kinds: set[str]) -> Node | None:
        return next((n for n in self.walk() if n.kind in kinds), None)

    def number(self) -> float | None:
        return next((p for p in self.parts if isinstance(p, float)), None)

    def name(self) -> str:
        return next((p for p in self.parts if isinstance(p, str)), "")

    def length_unit(self) -> float | None:
        """Metres of the node's own unit, which stands in it or in its axes."""
        for holder in ([self], [n for n in self.nodes if n.kind == "AXIS"]):
            found = [u.number() for h in holder for u in h.nodes if u.kind in LENGTH and u.number() is not None]
            if found:
                return found[-1]
        return None


def tree_of(text: str) -> Node:
    """The nodes of a text below a nameless root; brackets that never close end with the text."""
    root = Node("")
    path, word = [root], ""
    for string, name, number, opened, closed in (m.groups() for m in TOKEN.finditer(text)):
        if opened:
            node = Node(word.upper())
            path[-1].parts.append(node)
            path.append(node)
        elif closed:
            path = path[:-1] or path
        elif number:
            path[-1].parts.append(float(number))
        elif string is not None:
            path[-1].parts.append(string.replace('""', '"'))
        word = name or ""
    return root


def pairs_of(text: str) -> dict[str, str]:
    """The ``+key=value`` pairs of a projection string; a key alone has an empty value."""
    words = (w[1:].partition("=") for w in text.split() if w.startswith("+"))
    return {key: value for key, _, value in words}


def named(pairs: dict[str, str], unit: str, factor: str) -> float | None:
    if pairs.get(unit) in NAMED_UNITS:
        return NAMED_UNITS[pairs[unit]]
    return float(pairs[factor]) if pairs.get(factor) else None


def units_of(text: str) -> tuple[float, float, bool]:
    """Metres of the horizontal and of the vertical unit, and whether the text is compound. An unknown
    horizontal unit is 1, an unknown vertical one the horizontal one."""
    root, pairs = tree_of(text), pairs_of(text)
    projected, vertical = root.first(PROJECTED), root.first(VERTICAL)
    across = projected.length_unit() if projected else named(pairs, "units", "to_meter")
    across = 1.0 if across is None else across
    up = vertical.length_unit() if vertical else None
    up = named(pairs, "vunits", "vto_meter") if up is None else up
    compound = bool(root.nodes) and root.nodes[0].kind in COMPOUND and root.first(PROJECTED | GEOGRAPHIC) is not None
    return across, across if up is None else up, compound


def units(text: Column) -> Column:
    """A struct of ``horizontal``, ``vertical`` and ``compound`` for each text; null texts have null."""

    @F.arrow_udf("struct<horizontal:double,vertical:double,compound:boolean>")
    def of_batch(texts: pa.Array) -> pa.Array:
        kind = pa.struct([("horizontal", pa.float64()), ("vertical", pa.float64()), ("compound", pa.bool_())])
        return pa.array([None if t is None else dict(zip(("horizontal", "vertical", "compound"), units_of(t), strict=True)) for t in texts.to_pylist()], kind)

    return of_batch(text)


@dataclass(frozen=True)
class Scaled:
    """A projection in another unit than metres."""

    inner: object
    to_meter: float

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return tuple(c / self.to_meter for c in self.inner.forward(lon, lat))

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        return self.inner.inverse(x * self.to_meter, y * self.to_meter)


def chosen_system(forced: str | None, header: str | None, default: str | None) -> str:
    """Which reference system holds for a dataset: a forced one, its own, or the default."""
    found = forced or header or default
    if not found:
        raise ValueError("the dataset names no coordinate reference system; give one")
    return found


def settings_of(text: str) -> tuple[str | None, dict[str, float], float]:
    """The kind of projection, its numbers with lengths in metres, and the metres of its unit."""
    root = tree_of(text)
    projected = root.first(PROJECTED)
    if projected is not None:
        unit, method = projected.length_unit() or 1.0, projected.first(METHOD)
        kind = METHODS.get(re.sub(r"\s+", "_", method.name().strip().lower())) if method else None
        given = {PARAMETERS.get(re.sub(r"\s+", "_", n.name().lower())): n for n in projected.walk() if n.kind == "PARAMETER"}
        given.pop(None, None)
        lengths = {k: n.length_unit() or unit for k, n in given.items() if k in ("x_0", "y_0")}
        return kind, {k: (n.number() or 0.0) * lengths.get(k, 1.0) for k, n in given.items()}, unit
    if root.first(GEOGRAPHIC) is not None:
        return "longlat", {}, 1.0
    pairs = pairs_of(text)
    kind = {"latlong": "longlat"}.get(pairs.get("proj"), pairs.get("proj"))
    if kind == "merc" and float(pairs.get("a") or 0) == float(pairs.get("b") or 0) == 6378137.0:
        kind = "webmerc"
    if kind == "omerc" and {"no_uoff", "no_off"} & pairs.keys():
        kind = "omerc_natural"
    if kind == "utm":
        zone = geodesy.utm(int(pairs["zone"]), "south" in pairs)
        return "tmerc", {"lon_0": zone.lon0, "k": zone.scale, "x_0": zone.x0, "y_0": zone.y0}, named(pairs, "units", "to_meter") or 1.0
    other = {"k_0": "k", "lonc": "lon_0"}
    numbers = {other.get(k, k): float(v) for k, v in pairs.items() if k in {*PARAMETERS.values(), *other} and v}
    return kind, numbers, named(pairs, "units", "to_meter") or 1.0


def ellipsoid(a: float, f: float) -> geodesy.Ellipsoid:
    """The ellipsoid of an axis and a flattening. Headers round that of WGS 84; within a hundredth of its inverse it is meant."""
    rounded = a == geodesy.SEMI_MAJOR and f and abs(1 / f - 1 / geodesy.FLATTENING) < 0.01
    return geodesy.WGS84 if rounded else geodesy.Ellipsoid(a, f)


def datum_of(text: str) -> tuple[geodesy.Ellipsoid, tuple[float, ...]]:
    """The ellipsoid that a text names (WGS 84 where it names none) and the shift from its datum to WGS 84, empty without one."""
    root, pairs = tree_of(text), pairs_of(text)
    sphere = root.first({"SPHEROID", "ELLIPSOID"})
    if sphere is not None:
        a, inverse = [p for p in sphere.parts if isinstance(p, float)][:2]
        own = root.first({"TOWGS84"})
        return ellipsoid(a, 1 / inverse if inverse else 0.0), tuple(p for p in own.parts if isinstance(p, float)) if own else ()
    name, shift = DATUMS.get(pairs.get("datum", "WGS84"), (None, ()))
    name = pairs.get("ellps", name)
    if pairs.get("a") and (pairs.get("b") or pairs.get("rf")):
        a = float(pairs["a"])
        flat = 1 / float(pairs["rf"]) if pairs.get("rf") else (a - float(pairs["b"])) / a
    elif name in ELLIPSOIDS:
        a, flat = ELLIPSOIDS[name][0], 1 / ELLIPSOIDS[name][1]
    else:
        raise ValueError(f"{text[:60]!r} names an ellipsoid or datum that is not known here; give +a and +rf, and +towgs84")
    given = tuple(float(v) for v in pairs.get("towgs84", "").split(",") if v)
    return ellipsoid(a, flat), given or shift


def unshifted(kind: str | None, n: dict[str, float], unit: float, on: geodesy.Ellipsoid):
    """The projection of its settings, on its own ellipsoid; none for another kind."""
    lat0, lon0, k, x0, y0 = (n.get(c, d) for c, d in (("lat_0", 0.0), ("lon_0", 0.0), ("k", 1.0), ("x_0", 0.0), ("y_0", 0.0)))
    first = n.get("lat_1", lat0)
    if kind == "lcc":
        return geodesy.ConformalConic(first, n.get("lat_2", first), n.get("lat_0", first), lon0, x0, y0, unit, k, on)
    made = {
        "tmerc": lambda: geodesy.TransverseMercator(lon0, k, x0, y0, lat0, on),
        "merc": lambda: projections.Mercator(lon0, k, x0, y0, n.get("lat_ts", n.get("lat_1")), on),
        "aea": lambda: projections.AlbersConic(first, n.get("lat_2", first), lat0, lon0, x0, y0, on),
        "sterea": lambda: projections.ObliqueStereographic(lat0, lon0, k, x0, y0, on),
        "stere": lambda: projections.PolarStereographic(lat0 or n.get("lat_ts", 0.0), lon0, k, x0, y0, n.get("lat_ts"), on),
        "laea": lambda: projections.EqualAreaAzimuthal(lat0, lon0, x0, y0, on),
        "omerc": lambda: projections.ObliqueMercator(lat0, lon0, n.get("alpha", 90.0), n.get("gamma", n.get("alpha", 90.0)), k, x0, y0, False, on),
        "omerc_natural": lambda: projections.ObliqueMercator(lat0, lon0, n.get("alpha", 90.0), n.get("gamma", n.get("alpha", 90.0)), k, x0, y0, True, on),
    }.get(kind)
    found = made() if made else None
    return found if found is None or unit == 1 else Scaled(found, unit)


def projection_of(text: str):
    """The projection that well-known text or a proj string names, with its ellipsoid and the shift of its datum.

    Known are longitude and latitude, UTM, transverse and oblique Mercator, Mercator, Lambert's conformal conic and
    azimuthal equal-area, Albers' conic, the double and the polar stereographic one, and the web's. Others raise, and so do datums that only a grid of
    shifts describes, and stereographic ones of the ellipsoid from elsewhere than a pole.
    """
    kind, n, unit = settings_of(text)
    if kind == "webmerc":
        return geodesy.WebMercator()
    if kind == "stere" and abs(n.get("lat_0", n.get("lat_ts", 0.0))) != 90 and not ("lat_0" not in n and "lat_ts" in n):
        kind = None
    on, shift = datum_of(text)
    found = geodesy.LongLat() if kind == "longlat" else unshifted(kind, n, unit, on)
    if found is None:
        raise ValueError(f"no projection known for {text[:60]!r}")
    return projections.Datum(found, on, shift) if any(shift) or kind == "longlat" and shift else found
