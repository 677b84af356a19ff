"""Point records of LAS 1.4 files (formats 6 to 8): from bytes to columns and back, and codecs for compressed ones."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

# The layout of point records of the public format, and the bit of a header's format that says compressed.
CORE = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("returns", "u1"), ("flags", "u1"), ("classification", "u1"), ("user_data", "u1"), ("scan_angle", "<i2"), ("point_source_id", "<u2"), ("gps_time", "<f8")]
RGB, NIR = [("red", "<u2"), ("green", "<u2"), ("blue", "<u2")], [("nir", "<u2")]
LAYOUTS = {6: np.dtype(CORE), 7: np.dtype(CORE + RGB), 8: np.dtype(CORE + RGB + NIR)}
COMPRESSED = 0x80
# The types of extra bytes by their numbers, the largest count of 4 bits, and the largest values in the fields of columns that may need more.
EXTRA_TYPES = {1: "u1", 2: "i1", 3: "<u2", 4: "<i2", 5: "<u4", 6: "<i4", 7: "<u8", 8: "<i8", 9: "<f4", 10: "<f8"}
MOST_RETURNS = 15
WIDE = {"return_number": MOST_RETURNS, "number_of_returns": MOST_RETURNS, "point_source_id": (1 << 16) - 1}
WIDE_TYPE = 5

#: Bytes of a chunk, the number of its points, and the length of a record, to the plain bytes of its records.
Codec = Callable[[bytes, int, int], bytes]


def plain(raw: bytes, n: int, size: int) -> bytes:
    return raw


CODECS: dict[str, Codec] = {"none": plain}


def register_codec(name: str, codec: Codec) -> None:
    """Make a codec known to readers in this process; executors import the module that registers theirs."""
    CODECS[name] = codec


def codec_of(name: str) -> Codec:
    if name not in CODECS:
        raise ValueError(f"no codec {name!r} is registered; points of this file stay compressed")
    return CODECS[name]


def plain_records(raw: bytes, n: int, size: int, codec: str) -> bytes:
    """The plain bytes of a chunk's ``n`` records of ``size`` each."""
    plain_bytes = codec_of(codec)(raw, n, size)
    if len(plain_bytes) != n * size:
        raise ValueError(f"{len(plain_bytes)} bytes are not {n} records of {size}")
    return plain_bytes


def decoded(raw: bytes, n: int, form: int, size: int, scale: list[float], offset: list[float], codec: str = "none", extra: list[tuple[str, str, int]] | None = None) -> dict[str, np.ndarray]:
    """Columns of the ``n`` records of a chunk: coordinates as scaled whole numbers with their offsets, the packed bits
    of returns and flags apart. Bytes beyond a record's own layout (``size`` is longer) are passed over, but for those of
    ``extra`` (column, type, place in the record), which hold a column whole."""
    if form not in LAYOUTS:
        raise ValueError(f"point format {form} is not read, only 6, 7 and 8")
    layout, bytes_of = LAYOUTS[form], plain_records(raw, n, size, codec)
    if size < layout.itemsize:
        raise ValueError(f"{len(bytes_of)} bytes are not {n} records of {size}")
    fields = [(c, layout[c], layout.fields[c][1]) for c in layout.names] + [(f"extra {c}", np.dtype(t), at) for c, t, at in extra or []]
    wide = np.dtype(dict(zip(("names", "formats", "offsets"), map(list, zip(*fields, strict=True)), strict=True)) | {"itemsize": size})
    r = np.frombuffer(bytes_of, wide)
    found = {a.lower(): r[a] * s + o for a, s, o in zip("XYZ", scale, offset, strict=True)}
    found |= {"intensity": r["intensity"], "return_number": r["returns"] & 15, "number_of_returns": r["returns"] >> 4}
    flags = r["flags"]
    found |= {"synthetic": (flags & 1) > 0, "key_point": (flags & 2) > 0, "withheld": (flags & 4) > 0, "overlap": (flags & 8) > 0}
    found |= {"scanner_channel": (flags >> 4) & 3, "scan_direction": (flags >> 6) & 1, "edge_of_flight_line": flags >> 7}
    found |= {c: r[c] for c in layout.names if c not in ("X", "Y", "Z", "intensity", "returns", "flags")}
    return found | {c: r[f"extra {c}"] for c, _, _ in extra or []}


def too_wide(columns: dict[str, np.ndarray]) -> list[str]:
    """The columns of ``WIDE`` that hold values beyond their field."""
    return [c for c, most in WIDE.items() if c in columns and len(columns[c]) and np.max(columns[c]) > most]


def encoded(columns: dict[str, np.ndarray], form: int, scale: list[float], offset: list[float], extra: list[str] | None = None) -> bytes:
    """Records of columns as ``decoded`` names them; those not given are zero. Columns of ``extra`` stand whole behind the
    record's own fields, which hold the most they can. Values beyond their type raise."""
    layout = np.dtype(LAYOUTS[form].descr + [(f"extra {c}", EXTRA_TYPES[WIDE_TYPE]) for c in extra or []])
    n = len(columns["x"])
    r = np.zeros(n, layout)

    def put(name: str, values: np.ndarray) -> None:
        kind = layout[name]
        if kind.kind != "f" and n:
            least, most = np.iinfo(kind).min, np.iinfo(kind).max
            if values.min() < least or values.max() > most:
                raise ValueError(f"{name} does not fit in {kind}")
        r[name] = values

    zero = np.zeros(n, np.int64)
    get = lambda c: np.asarray(columns.get(c, zero)).astype(np.int64)
    for a, s, o in zip("XYZ", scale, offset, strict=True):
        put(a, np.rint((np.asarray(columns[a.lower()], float) - o) / s))
    whole = {c: get(c) for c in WIDE}
    for c, values in whole.items():
        if c in (extra or []):
            put(f"extra {c}", values)
        elif n and (values.min() < 0 or values.max() > WIDE[c]):
            raise ValueError(f"{c} does not fit in its field")
    kept = {c: np.minimum(v, WIDE[c]) for c, v in whole.items()}
    put("returns", kept["return_number"] | kept["number_of_returns"] << 4)
    put("point_source_id", kept["point_source_id"])
    bits = (("synthetic", 0), ("key_point", 1), ("withheld", 2), ("overlap", 3), ("scanner_channel", 4), ("scan_direction", 6), ("edge_of_flight_line", 7))
    put("flags", sum((get(c) << b for c, b in bits), zero))
    for c in layout.names:
        if c not in ("X", "Y", "Z", "returns", "flags", "point_source_id") and not c.startswith("extra "):
            put(c, np.asarray(columns.get(c, zero)) if layout[c].kind == "f" else get(c))
    return r.tobytes()
