"""Web archives packaged as ZIP files: WARC records, an index, and range reads of both."""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointquarry.llm.common import scratch_path, staged
from pointquarry.stores import opened

# The structures of a ZIP file (signature and fields, little-endian) that the reader needs.
END = "<4s4H2IH"
END64_LOCATOR = "<4sIQI"
END64 = "<4sQ2H2I4Q"
ENTRY = "<4s6H3I5H2I"
LOCAL = "<4s5H3I2H"
END_SIGN, LOCATOR_SIGN, END64_SIGN, ENTRY_SIGN, LOCAL_SIGN = b"PK\5\6", b"PK\6\7", b"PK\6\6", b"PK\1\2", b"PK\3\4"
FULL16, FULL32, STORED, ZIP64_FIELD = 0xFFFF, 0xFFFFFFFF, 0, 1

#: Members of a package.
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Neighbouring records are read at once up to so many bytes.
READ = 4 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Package:
    """A ZIP file read by ranges: the end record, the central directory, then parts of stored members."""

    def __init__(self, path: str):
        system, inner = opened(path)
        self.file = system.open_input_file(inner)
        self.size = self.file.size()
        self.members = self.directory()

    def __enter__(self) -> Package:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()

    def range(self, at: int, size: int) -> bytes:
        if at < 0 or at + size > self.size:
            raise ValueError(f"bytes {at} to {at + size} are not within the archive")
        return self.file.read_at(size, at)

    def directory(self) -> dict[str, tuple[int, int, int, int]]:
        """name: (method, stored size, size, place of the local header), by the central directory."""
        tail_at = max(0, self.size - struct.calcsize(END) - FULL16)
        tail = self.range(tail_at, self.size - tail_at)
        at = len(tail)
        while True:
            at = tail.rfind(END_SIGN, 0, at)
            if at < 0:
                raise ValueError("no end record: this is no ZIP file")
            if at + struct.calcsize(END) <= len(tail) and at + struct.calcsize(END) + struct.unpack_from(END, tail, at)[7] == len(tail):
                break
        _, _, _, _, count, size, start, _ = struct.unpack_from(END, tail, at)
        end_at = tail_at + at
        if count == FULL16 or size == FULL32 or start == FULL32:
            locator_at = end_at - struct.calcsize(END64_LOCATOR)
            sign, _, end64_at, _ = struct.unpack(END64_LOCATOR, self.range(locator_at, struct.calcsize(END64_LOCATOR))) if locator_at >= 0 else (b"", 0, 0, 0)
            if sign == LOCATOR_SIGN:
                sign, *_, count, size, start = struct.unpack(END64, self.range(end64_at, struct.calcsize(END64)))
                if sign != END64_SIGN:
                    raise ValueError("no ZIP64 end record where its locator says")
        raw, members, p = self.range(start, size), {}, 0
        for _ in range(count):
            sign, _, _, flags, method, _, _, _, packed, whole, n_name, n_extra, n_comment, _, _, _, local = struct.unpack_from(ENTRY, raw, p)
            if sign != ENTRY_SIGN:
                raise ValueError("a broken central directory")
            p += struct.calcsize(ENTRY)
            name = raw[p : p + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra, q = raw[p + n_name : p + n_name + n_extra], 0
            while q + 4 <= len(extra):
                tag, n = struct.unpack_from("<2H", extra, q)
                if tag == ZIP64_FIELD:
                    longs = list(struct.unpack_from(f"<{n // 8}Q", extra, q + 4))
                    whole = longs.pop(0) if whole == FULL32 else whole
                    packed = longs.pop(0) if packed == FULL32 else packed
                    local = longs.pop(0) if local == FULL32 else local
                q += 4 + n
            members[name] = (method, packed, whole, local)
            p += n_name + n_extra + n_comment
        return members

    def stored(self, name: str) -> tuple[int, int]:
        """Where the bytes of a stored member begin, and how many they are."""
        method, packed, _, local = self.members[name]
        if method != STORED:
            raise ValueError(f"{name} is compressed; only stored members can be read by ranges")
        head = struct.unpack(LOCAL, self.range(local, struct.calcsize(LOCAL)))
        if head[0] != LOCAL_SIGN:
            raise ValueError(f"no local header of {name} where the directory says")
        return local + struct.calcsize(LOCAL) + head[9] + head[10], packed


def field(value: str) -> str:
    """A value of a header line: nothing in it can end the line."""
    return quote(value, safe="".join(chr(c) for c in range(0x21, 0x7F)))


def record_bytes(page: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """A WARC record with an HTTP response, as a gzip member of its own. A revisit has the
    headers of the response only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {field(url)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    whole = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(whole, 6, mtime=0)


def parsed_record(raw: bytes) -> dict:
    """The headers of a record, its payload, and the digest of the payload read."""
    whole = zlib.decompress(raw, 31)
    head, _, rest = whole.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    h = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(h["content-length"])]
    if len(block) != int(h["content-length"]):
        raise ValueError("a record ends before its length")
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = h["warc-type"] == "revisit"
    size = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1]) if revisit else len(payload)
    digest = h["warc-payload-digest"].partition(":")[2] if revisit else hashlib.sha1(payload).hexdigest()
    if f"sha1:{digest}" != h["warc-payload-digest"]:
        raise ValueError(f"the payload of {h['warc-record-id']} differs from its digest")
    page = lambda x: x.removeprefix("<urn:page:").removesuffix(">") if x else None
    return {
        "page": page(h["warc-record-id"]),
        "type": h["warc-type"],
        "url": h.get("warc-target-uri"),
        "refers_to": page(h.get("warc-refers-to")),
        "bytes": size,
        "digest": digest,
        "payload": None if revisit else payload,
    }


class Writer:
    """A package being written: records stream into a stored member, their places into the index."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        system, inner = opened(self.path)
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        self.out = system.open_output_stream(inner)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.index, self.at = [], 0

    def add(self, record: bytes, page: str, url: str | None, kind: str, digest: str) -> None:
        self.data.write(record)
        place = {"page": page, "url": url, "mime": "text/html" if kind == "response" else "warc/revisit", "digest": f"sha1:{digest}", "offset": self.at, "length": len(record)}
        self.index.append(json.dumps(place))
        self.at += len(record)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.index).encode())
        self.zip.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps({"profile": "data-package", "resources": [{"path": DATA}, {"path": INDEX}]}))
        self.zip.close()
        self.out.close()
        return self.path, len(self.index), self.at


def with_types(pages: DataFrame, least_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page, url, html, digest, refers_to): which page a row's record revisits, if any.

    Digests are counted on narrow rows with partial aggregates. Only digests that repeat
    are joined to the pages; they are written first, so that adaptive execution can split a hot one.
    """
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes"), F.col(html_col).cast("string").alias("html"))
    rest = rows.where(F.col("bytes") >= least_bytes)
    repeated = rest.groupBy("digest").agg(F.max("page").alias("top"), F.count("*").alias("n")).where("n > 1").select("digest", "top")
    repeated = staged(repeated, "repeated-payloads")
    # Small payloads never match; their keys are spread, as one null key for all would be a hot one.
    key = F.when(F.col("bytes") >= least_bytes, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page", "url", "digest").cast("string")))
    joined = rows.withColumn("key", key).join(repeated.withColumnRenamed("digest", "key"), "key", "left")
    return joined.select("page", "url", "html", "digest", F.when(~F.col("page").eqNullSafe(F.col("top")), F.col("top")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = 32 << 20, least_bytes: int = 1000, date: str = "2000-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a WARC record per row into packages below ``folder``, and return their list (path, records, bytes).

    Each task streams its rows into packages of about ``archive_bytes``: a stored member of
    gzip records and a stored index. Of equal payloads of at least ``least_bytes`` the row of the
    largest id is a response, others revisit it; rows that share that id are all responses, and
    so are all rows of smaller payloads. Names are new for each attempt of a task and only the
    list says which packages count, so a repeated task leaves no record twice.

    A null payload is empty, a null URL has no header; a null id is written as ``null`` and
    comes before all others. An empty table gives no package.
    """
    typed = with_types(pages, least_bytes, id_col, url_col, html_col)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, w = [], None
        for batch in batches:
            for page, url, html, digest, refers in zip(*(batch.column(c) for c in ("page", "url", "html", "digest", "refers_to")), strict=True):
                w = w or Writer(folder)
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                name, link = str(page.as_py()) if page.is_valid else "null", url.as_py()
                to = str(refers.as_py()) if refers.is_valid else None
                w.add(record_bytes(name, link, payload, digest.as_py(), to, date), name, link, "response" if to is None else "revisit", digest.as_py())
                if w.at >= archive_bytes:
                    done.append(w.close())
                    w = None
        if w:
            done.append(w.close())
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*done, strict=True) if done else [(), (), ()], (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "records", "bytes"])

    return typed.mapInArrow(write, "path string, records long, bytes long")


def list_records(archives: DataFrame) -> DataFrame:
    """The index of each package of ``archives`` (column ``path``): a row per record with its URL,
    kind, digest and its place in the package, found by the directory and the index alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with Package(path) as p:
                    start, _ = p.stored(DATA)
                    rows = [json.loads(x) for x in p.range(*p.stored(INDEX)).split(b"\n") if x]
                    columns = [pa.array([path] * len(rows), pa.string())]
                    columns += [pa.array([r[k] for r in rows], pa.string()) for k in ("page", "url", "mime", "digest")]
                    columns += [pa.array([start + r["offset"] for r in rows], pa.int64()), pa.array([r["length"] for r in rows], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["path", "page", "url", "mime", "digest", "offset", "length"])

    return archives.select("path").mapInArrow(read, "path string, page string, url string, mime string, digest string, offset long, length long")


def read_records(places: DataFrame, payloads: bool = False) -> DataFrame:
    """Read the records at the given places (``path``, ``offset``, ``length``) by ranges, nothing else.

    Records that follow one another are read at once. Each is decompressed and parsed
    alone, and the digest of its payload is verified; a broken one raises.
    """

    def rows(found: list[dict]) -> pa.RecordBatch:
        kinds = {"page": pa.string(), "type": pa.string(), "url": pa.string(), "refers_to": pa.string(), "bytes": pa.int64(), "digest": pa.string()} | ({"payload": pa.binary()} if payloads else {})
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in kinds.items()], list(kinds))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, path = None, None
        for batch in batches:
            spans = list(zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True))
            i = 0
            while i < len(spans):
                j, end = i + 1, spans[i][1] + spans[i][2]
                while j < len(spans) and spans[j][0] == spans[i][0] and spans[j][1] == end and end + spans[j][2] - spans[i][1] <= READ:
                    end, j = end + spans[j][2], j + 1
                if spans[i][0] != path:
                    if package:
                        package.file.close()
                    path = spans[i][0]
                    package = Package(path)
                begin = spans[i][1]
                raw = package.range(begin, end - begin)
                yield rows([parsed_record(raw[a - begin : a - begin + n]) for _, a, n in spans[i:j]])
                i = j
        if package:
            package.file.close()

    return places.select("path", "offset", "length").mapInArrow(read, "page string, type string, url string, refers_to string, bytes long, digest string" + ", payload binary" * payloads)


def round_trip(pages: DataFrame, archive_bytes: int = 32 << 20, least_bytes: int = 1000, payloads: bool = False) -> DataFrame:
    """Write the pages to packages in the shared folder and read all their records back."""
    spark = pages.sparkSession
    archives = staged(write_archives(pages, scratch_path(spark, "archives"), archive_bytes, least_bytes), "archive-list")
    each = archives.repartition(max(1, archives.count()))
    return read_records(list_records(each), payloads)
