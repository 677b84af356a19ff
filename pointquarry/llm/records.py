"""Token ids in files of length-delimited records, with an offset index beside each file."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointquarry.llm import tokens
from pointquarry.llm.common import scratch_path, staged
from pointquarry.stores import opened

# The polynomial of CRC-32C (reflected) and the constant by which checksums of records are masked.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
#: A record: the length of its payload and the masked checksum of that, the payload and its masked checksum.
LENGTH, CHECK = "<Q", "<I"
FRAME = 16
#: A payload begins with the bytes of an id, whether the document has an id, and that id; token ids follow.
HEAD = "<BBxxxxxxq"
#: An index: a mark, the bytes of an id, the number of records, and then where each record begins and the last one ends.
INDEX, MARK = "<8sQQ", b"TOKIDX01"
#: Bytes of a record that are checked in one step, and bytes that are read at once.
SEGMENT, READ = 512, 4 << 20


def stepped(state: np.ndarray, steps: int) -> np.ndarray:
    """CRC states after so many zero bytes."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
    for _ in range(steps):
        state = table[state & 0xFF] ^ (state >> 8)
    return state


@lru_cache(maxsize=4)
def zeros(steps: int) -> tuple[np.ndarray, np.ndarray]:
    """What so many zero bytes make of the lower and of the upper half of a state."""
    half = np.arange(1 << 16, dtype=np.uint32)
    return stepped(half, steps), stepped(half << 16, steps)


def checksums(parts: list[bytes | memoryview]) -> np.ndarray:
    """The masked CRC-32C of each part (of 4 bytes or more), all together.

    A part is filled with zeros at its front up to whole segments, which leave a state of zero as it is; the segments of all
    parts go side by side, four bytes a step, and then each part's segments are put together.
    """
    sizes = np.array([len(p) for p in parts], np.int64)
    count = -(-sizes // SEGMENT)
    ends = np.cumsum(count) * SEGMENT
    data = np.zeros(int(count.sum()) * SEGMENT, np.uint8)
    for p, n, e in zip(parts, sizes.tolist(), ends.tolist(), strict=True):
        data[e - n : e] = np.frombuffer(p, np.uint8)
        data[e - n : e - n + 4] ^= 0xFF
    low, high = zeros(4)
    state = np.zeros(len(data) // SEGMENT, np.uint32)
    for step in np.ascontiguousarray(data.view("<u4").reshape(-1, SEGMENT // 4).T):
        state ^= step
        state = low[state & 0xFFFF] ^ high[state >> 16]
    low, high = zeros(SEGMENT)
    by = np.argsort(-count, kind="stable")
    first, many = (np.cumsum(count) - count)[by], count[by]
    total = np.zeros(len(parts), np.uint32)
    for j in range(int(many[0]) if len(many) else 0):
        n = int(np.searchsorted(-many, -j, side="left"))
        total[:n] = low[total[:n] & 0xFFFF] ^ high[total[:n] >> 16] ^ state[first[:n] + j]
    found = np.empty(len(parts), np.uint32)
    found[by] = total
    found ^= np.uint32(0xFFFFFFFF)
    return ((found >> 15) | (found << 17)) + np.uint32(MASK)


def framed(payloads: list[bytes]) -> list[bytes]:
    """Each payload as a record."""
    heads = [struct.pack(LENGTH, len(p)) for p in payloads]
    return [h + c.tobytes() + p + d.tobytes() for h, c, p, d in zip(heads, checksums(heads).astype(CHECK), payloads, checksums(payloads).astype(CHECK), strict=True)]


class Writer:
    """One file of records and its index, under a name of its own, so that a task that runs again disturbs nothing."""

    def __init__(self, folder: str, width: int, first: tuple):
        self.path, self.width, self.first = f"{folder}/tokens-{uuid.uuid4().hex}.rec", width, first
        self.system, self.inner = opened(self.path)
        self.system.create_dir(self.inner.rpartition("/")[0], recursive=True)
        self.file, self.offsets, self.ids = self.system.open_output_stream(self.inner), [0], 0

    def add(self, records: list[bytes], ids: int) -> None:
        self.file.write(b"".join(records))
        for r in records:
            self.offsets.append(self.offsets[-1] + len(r))
        self.ids += ids

    def close(self) -> dict:
        self.file.close()
        with self.system.open_output_stream(f"{self.inner}.idx") as f:
            f.write(struct.pack(INDEX, MARK, self.width, len(self.offsets) - 1) + np.array(self.offsets, "<u8").tobytes())
        return {"path": self.path, "id": self.first[0], "hash": self.first[1], "row": self.first[2], "records": len(self.offsets) - 1, "ids": self.ids}


def write_tokens(docs: DataFrame, folder: str, vocabulary: str | None = None, end: int = 0, file_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each whole text, append the id ``end``, and write the ids in ascending order of the documents' ids.

    Texts are dealt by ranges of ids, about ``file_bytes`` of text each (ties by a hash of the text and the place of the row, so a
    frequent id is dealt too); a task encodes its range in order and begins a new file when one has ``file_bytes``.
    Ids take two bytes where the vocabulary has at most 65,536, else four. Returns a row per file, (path, start, records, ids), where ``start`` is the
    number of ids in all files before it; these rows alone come to the driver. The index of a file is beside it, with the suffix ``.idx``.
    Files of a task that failed or ran twice are in no row.

    Null ids come first and are kept as null; ids that are no whole numbers of 64 bits become null. Null and empty texts have the
    end id alone. Rows of one id all stay, in a fixed order. A text of any length is encoded whole, in the memory of its task. An
    empty table gives no files. Other columns are not read.
    """
    path = vocabulary or tokens.default_path("byte_bpe_50k.json")
    width = tokens.width_of(path)
    final = end.to_bytes(width, "little")
    rows = docs.select(F.expr(f"try_cast(`{id_col}` AS long)").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // file_bytes))
    keyed = rows.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange(parts, "id", "hash", "row").sortWithinPartitions("id", "hash", "row")
    kinds = {"path": pa.string(), "id": pa.int64(), "hash": pa.int64(), "row": pa.int64(), "records": pa.int64(), "ids": pa.int64()}

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, done = None, []
        for batch in batches:
            for part in slices(batch):
                names = part.column("id").to_pylist()
                coded = [x + final for x in tokens.packed_ids(part.column("text"), path, width)]
                payloads = [struct.pack(HEAD, width, name is not None, name or 0) + x for name, x in zip(names, coded, strict=True)]
                w = w or Writer(folder, width, tuple(part.column(c)[0].as_py() for c in ("id", "hash", "row")))
                w.add(framed(payloads), sum(map(len, coded)) // width)
                if w.offsets[-1] >= file_bytes:
                    done.append(w.close())
                    w = None
        if w:
            done.append(w.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[c] for d in done], t) for c, t in kinds.items()], list(kinds))

    files = staged(dealt.mapInArrow(write, "path string, id long, hash long, row long, records long, ids long"), "token-files")
    found = files.orderBy(F.col("id").asc_nulls_first(), "hash", "row").select("path", "records", "ids").collect()
    starts = np.cumsum([0, *(r["ids"] for r in found)]).tolist()
    return docs.sparkSession.createDataFrame([(r["path"], s, r["records"], r["ids"]) for r, s in zip(found, starts, strict=False)], "path string, start long, records long, ids long")


def slices(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``most`` bytes of text; a longer text is a part."""
    sizes = np.cumsum(np.diff(np.frombuffer(batch.column("text").buffers()[1], np.int32)[batch.column("text").offset :][: len(batch) + 1]))
    begin = 0
    while begin < len(batch):
        end = max(begin + 1, int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + most, side="right")))
        yield batch.slice(begin, end - begin)
        pa.default_memory_pool().release_unused()
        begin = end


def list_tokens(files: DataFrame) -> DataFrame:
    """(path, offset, length, start, n): a row for each record of the files, from their indexes alone; ``start`` is the number
    of ids before it in all files, ``n`` that of its own."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(batch.column(c).to_pylist() for c in ("path", "start")), strict=True):
                system, inner = opened(f"{path}.idx")
                with system.open_input_file(inner) as f:
                    raw = f.read()
                mark, width, n = struct.unpack_from(INDEX, raw)
                if mark != MARK or len(raw) != struct.calcsize(INDEX) + 8 * (n + 1):
                    raise ValueError(f"{path}.idx is no index of records")
                at = np.frombuffer(raw, "<u8", offset=struct.calcsize(INDEX)).astype(np.int64)
                ids = (np.diff(at) - FRAME - struct.calcsize(HEAD)) // width
                columns = [pa.array([path] * n, pa.string()), at[:-1], np.diff(at), start + np.cumsum(ids) - ids, ids]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["path", "offset", "length", "start", "n"])

    return files.select("path", "start").mapInArrow(read, "path string, offset long, length long, start long, n long")


def unframed(raw: bytes, begins: list[int], sizes: list[int], path: str) -> list[memoryview]:
    """The payloads of records of which the bytes are given; a broken one raises."""
    whole = memoryview(raw)
    heads = [whole[b : b + 8] for b in begins]
    payloads = [whole[b + 12 : b + n - 4] for b, n in zip(begins, sizes, strict=True)]
    if any(struct.unpack(LENGTH, h)[0] != len(p) for h, p in zip(heads, payloads, strict=True)):
        raise ValueError(f"a record of {path} has another length than its index says")
    checks = np.array([struct.unpack_from(CHECK, raw, b + 8)[0] for b in begins] + [struct.unpack_from(CHECK, raw, b + n - 4)[0] for b, n in zip(begins, sizes, strict=True)], np.uint32)
    if (np.concatenate([checksums(heads), checksums(payloads)]) != checks).any():
        raise ValueError(f"a record of {path} fails its checksum")
    return payloads


def read_tokens(places: DataFrame, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 and, if asked for, ids): the records at the given places (rows of ``list_tokens``),
    in their order. For a shuffled epoch give them in a seeded order, such as ``orderBy(xxhash64("path", "offset", lit(seed)))``.

    Records that follow one another in a file are read at once. Both checksums of each are verified; a broken one raises.
    ``ids_crc32`` is that of all its ids as little-endian numbers of four bytes.
    """
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.list_(pa.int64())} if ids else {})

    def rows(raw: bytes, begins: list[int], sizes: list[int], starts: list[int], path: str) -> pa.RecordBatch:
        found = {c: [] for c in kinds}
        for p, start in zip(unframed(raw, begins, sizes, path), starts, strict=True):
            width, known, name = struct.unpack_from(HEAD, p)
            own = np.frombuffer(p, f"<u{width}", offset=struct.calcsize(HEAD))
            found["doc_id"].append(name if known else None)
            found["start"].append(start)
            found["n_tokens"].append(len(own))
            found["ids_crc32"].append(zlib.crc32(own.astype("<u4").tobytes()))
            if ids:
                found["ids"].append(own.astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(found[c], t) for c, t in kinds.items()], list(kinds))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, path = None, None
        for batch in batches:
            paths, (at, length) = batch.column("path").to_pylist(), (batch.column(c).to_numpy() for c in ("offset", "length"))
            starts, i = batch.column("start").to_pylist(), 0
            while i < len(paths):
                j = i + 1
                while j < len(paths) and paths[j] == paths[i] and at[j] == at[j - 1] + length[j - 1] and at[j] + length[j] - at[i] <= READ:
                    j += 1
                if paths[i] != path:
                    if file:
                        file.close()
                    path = paths[i]
                    system, inner = opened(path)
                    file = system.open_input_file(inner)
                raw = file.read_at(int(at[j - 1] + length[j - 1] - at[i]), int(at[i]))
                yield rows(raw, (at[i:j] - at[i]).tolist(), length[i:j].tolist(), starts[i:j], path)
                i = j
        if file:
            file.close()

    return places.select("path", "offset", "length", "start").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)


def round_trip(docs: DataFrame, vocabulary: str | None = None, end: int = 0, file_bytes: int = 32 << 20, ids: bool = False) -> DataFrame:
    """Write the texts' token ids to files in the shared folder and read all records back, a task for each file."""
    files = write_tokens(docs, scratch_path(docs.sparkSession, "tokens"), vocabulary, end, file_bytes)
    return read_tokens(list_tokens(files.repartition(max(1, files.count()))), ids)
