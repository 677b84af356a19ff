"""Benchmark passages in training documents, by an FM-index of each shard."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointquarry.llm.common import LOWER, UPPER, plain, staged
from pointquarry.llm.fmindex import MOST_SYMBOLS, FMIndex

#: Bytes of words stay, A-Z lower-cased; all others become blanks. UTF-8 beyond ASCII is words.
WORD_BYTES = bytes(LOWER.encode()[UPPER.index(chr(b))] if chr(b) in UPPER else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
#: The symbols of the end of a shard and of the gap between its documents come before words.
GAP, FIRST_WORD = 1, 2


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


@dataclass
class Phrases:
    """Distinct windows of the benchmark: places of words in ``words``, right-aligned after -1."""

    words: pa.Array
    windows: np.ndarray
    lengths: np.ndarray
    items: list[tuple[str, ...]]


def phrases_of(items: Iterator[tuple[str, str | None]], window: int) -> Phrases:
    symbols: dict[bytes, int] = {}
    of_window: dict[tuple[int, ...], dict[str, None]] = defaultdict(dict)
    for item, text in items:
        ids = [symbols.setdefault(w, len(symbols)) for w in words_of((text or "").encode())]
        for at in range(max(1, len(ids) - window + 1) if ids else 0):
            of_window[tuple(ids[at : at + window])][item] = None
    rows = np.full((len(of_window), window), -1, np.int64)
    for r, ids in zip(rows, of_window, strict=True):
        r[window - len(ids) :] = ids
    return Phrases(pa.array(symbols, pa.binary()), rows, (rows >= 0).sum(axis=1), [tuple(x) for x in of_window.values()])


def leaks_in(texts: list[bytes | None], p: Phrases) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
    """For the texts of a shard: the numbers of words, merged spans of words [start, end)
    inside occurrences of windows, and the items of these windows."""
    # The shard is one run of bytes; a newline is no byte of a word and so parts the documents.
    flat = b"\n".join(t or b"" for t in texts).translate(WORD_BYTES)
    is_word = np.frombuffer(flat, np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(is_word, prepend=False, append=False))
    begin, size = edge[::2], edge[1::2] - edge[::2]
    packed = pa.py_buffer(flat.translate(None, b" "))
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), packed]).dictionary_encode()
    of_doc = np.searchsorted(begin, np.cumsum([0] + [len(t or b"") + 1 for t in texts]))
    sizes = np.diff(of_doc).tolist()
    starts = of_doc + np.arange(len(of_doc))
    text = np.full(starts[-1], GAP, np.int32)
    gaps = np.zeros(starts[-1], bool)
    gaps[starts[1:] - 1] = True
    text[~gaps] = coded.indices.to_numpy() + FIRST_WORD
    index = FMIndex(text, FIRST_WORD + len(coded.dictionary))
    local = pc.index_in(p.words, value_set=coded.dictionary)
    symbol = np.append(pc.fill_null(local, -2 - FIRST_WORD).to_numpy() + FIRST_WORD, -1)
    windows = symbol[p.windows]
    here = np.flatnonzero((windows > -2).all(axis=1))
    lo, hi = index.search(windows[here])
    n = hi - lo
    which = np.repeat(here, n)
    rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    at = index.locate(rows)
    doc = np.searchsorted(starts, at, side="right") - 1
    edges = np.zeros(starts[-1] + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + p.lengths[which], -1)
    inside = np.concatenate([[0], np.cumsum(edges) > 0]).astype(np.int8)
    begins, ends = np.flatnonzero(np.diff(inside) == 1), np.flatnonzero(np.diff(inside) == -1)
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
        d = int(np.searchsorted(starts, b, side="right")) - 1
        spans[d].append((b - int(starts[d]), e - int(starts[d])))
    items: list[set[str]] = [set() for _ in texts]
    for d, w in np.unique(np.stack([doc, which], axis=1), axis=0).tolist() if len(doc) else []:
        items[d].update(p.items[w])
    return sizes, spans, [sorted(x) for x in items]


def leaks_of_long(text: bytes, p: Phrases, most: int) -> tuple[int, list[tuple[int, int]], list[str]]:
    """As ``leaks_in`` of one text, in pieces of less than ``most`` words, of which each begins
    with the last words of the one before, one fewer than a window has."""
    is_word = np.frombuffer(text.translate(WORD_BYTES), np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(is_word, prepend=False, append=False))
    begin, end = edge[::2], edge[1::2]
    n, again = len(begin), p.windows.shape[1] - 1
    edges = np.zeros(n + 1, np.int64)
    items: set[str] = set()
    at = 0
    while n:
        to = min(n, at + most - 1)
        _, (found,), (names,) = leaks_in([text[begin[at] : end[to - 1]]], p)
        items.update(names)
        for b, e in found:
            edges[at + b] += 1
            edges[at + e] -= 1
        if to == n:
            break
        at = to - again
    turns = np.diff(np.concatenate([[0], np.cumsum(edges) > 0]).astype(np.int8))
    return n, list(zip(np.flatnonzero(turns == 1).tolist(), np.flatnonzero(turns == -1).tolist(), strict=True)), sorted(items)


def leaks_bounded(texts: list[bytes | None], p: Phrases, most: int = MOST_SYMBOLS) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
    """As ``leaks_in``, with no index of more than ``most`` symbols (or two windows, if these
    are more): texts of more words are searched in pieces, others in runs that fit."""
    most = max(most, 2 * p.windows.shape[1])
    sizes, spans, items = [], [], []
    run: list[bytes | None] = []
    held = 0
    for i, t in enumerate([*texts, b""]):
        # A word takes two bytes at least, but the last one; and each text has a gap.
        need = (len(t or b"") + 1) // 2 + 1
        if run and (i == len(texts) or held + need > most):
            for all_of, part in zip((sizes, spans, items), leaks_in(run, p), strict=True):
                all_of += part
            run, held = [], 0
        if i == len(texts):
            break
        if need > most:
            for all_of, one in zip((sizes, spans, items), leaks_of_long(t, p, most), strict=True):
                all_of.append(one)
        else:
            run.append(t)
            held += need
    return sizes, spans, items


def without(text: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them; a blank is left."""
    flat = text.translate(WORD_BYTES)
    mask = np.frombuffer(flat, np.uint8) != 0x20
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at = [], 0
    for b, e in spans:
        out.append(text[at : begins[b]])
        at = ends[e - 1]
    return b" ".join([*out, text[at:]]).decode()


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def scan(docs: DataFrame, phrases: Phrases, text_col: str, shard_bytes: int, clean: bool) -> DataFrame:
    """Each task cuts its rows into shards of about ``shard_bytes`` and searches the index of each."""
    sent = docs.sparkSession.sparkContext.broadcast((phrases.words, phrases.windows, phrases.lengths, phrases.items))
    keep = [c for c in docs.columns if clean or c != text_col]

    def of_shard(rows: pa.Table) -> pa.RecordBatch:
        texts = [x.as_buffer().to_pybytes() if x.is_valid else None for x in rows.column(text_col)]
        sizes, spans, items = leaks_bounded(texts, Phrases(*sent.value))
        out = [rows.column(c).combine_chunks() for c in keep]
        out = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in out]
        out += [
            pa.array(sizes, pa.int64()),
            pa.array([[{"start": b, "end": e} for b, e in s] for s in spans], SPANS),
            pa.array(items, pa.list_(pa.string())),
        ]
        if clean:
            out.append(pa.array([without(t, s) if s else None for t, s in zip(texts, spans, strict=True)], pa.string()))
        return pa.RecordBatch.from_arrays(out, [*keep, "__words", "__spans", "__items", *["__clean"] * clean])

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, held = [], 0
        for batch in batches:
            lengths = np.array([x.as_buffer().size if x.is_valid else 0 for x in batch.column(text_col)])
            begin = 0
            for i, size in enumerate(lengths):
                held += int(size) + 1
                if held >= shard_bytes:
                    pending.append(batch.slice(begin, i + 1 - begin))
                    yield of_shard(pa.Table.from_batches(pending))
                    pending, held, begin = [], 0, i + 1
            if begin < len(batch):
                pending.append(batch.slice(begin))
        if pending:
            yield of_shard(pa.Table.from_batches(pending))

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep)
    return docs.mapInArrow(of_task, f"{kept + ', ' if kept else ''}__words long, __spans array<struct<start:int,end:int>>, __items array<string>" + ", __clean string" * clean)


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    shard_bytes: int = 3 << 20,
    max_words: int = 2_000_000,
    clean: bool = True,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Words of documents that stand in an occurrence of a window of a benchmark item.

    Windows are ``window`` consecutive words; an item of fewer is one window. A shard is a
    run of a task's documents; its FM-index holds every word of them. Windows are searched
    backward through the ranks of a wavelet matrix, all at a time, and their
    occurrences located by sampled suffixes; occurrences that touch merge into spans.
    Documents are not shuffled and indexes are bounded, however hot a passage is: a shard of
    too many words has several, and so has a text, whose pieces overlap by a window less one word.

    The benchmark goes to each task if it has at most ``max_words`` words, which is
    counted first. A larger one is dealt into parts by its items; the documents are
    written with a row number, searched for each part, and their spans merged by that number.

    Returns the columns of ``docs`` (without the text unless ``clean``), ``__words``, ``__spans``
    (of words, merged, sorted), ``__items`` (ids as strings, sorted as such), ``__hit`` (words
    in spans) and with ``clean`` also ``__clean`` (the text without the spans, null without any).

    Null and empty texts have no words and no hits; items without words have no windows.
    Rows are independent and may repeat. Empty tables of either kind give no hits. Columns of
    ``docs`` that begin with two underscores are left out.
    """
    docs = plain(docs)
    ids = F.coalesce(F.col(item_col).cast("string"), F.lit("null"))
    bench = benchmark.select(ids.alias("item"), F.col(item_text).alias("text"))
    total = bench.agg(F.sum(F.regexp_count("text", F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")))).first()[0] or 0
    parts = max(1, math.ceil(total / max_words))
    if parts == 1:
        found = scan(docs, phrases_of(map(tuple, bench.collect()), window), text_col, shard_bytes, clean)
        return found.withColumn("__hit", hit_words("__spans"))
    rows = staged(docs.withColumn("__row", F.monotonically_increasing_id()), "leaks")
    each = []
    for k in range(parts):
        part = bench.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == k)
        each.append(staged(scan(rows.select("__row", text_col), phrases_of(map(tuple, part.collect()), window), text_col, shard_bytes, False), "leaks-part"))
    united = each[0]
    for e in each[1:]:
        united = united.unionByName(e)
    spans = united.groupBy("__row").agg(
        F.max("__words").alias("__words"),
        F.array_sort(F.flatten(F.collect_list("__spans"))).alias("__all"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("__items")))).alias("__items"),
    )
    merged = F.aggregate(
        "__all",
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda done, s: F.when((F.size(done) > 0) & (F.element_at(done, -1)["end"] >= s["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(done, F.array(s))),
    )
    out = rows.join(spans.withColumn("__spans", merged), "__row")
    if clean:

        @F.arrow_udf("string")
        def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
            return pa.array([without(t.encode(), [(x["start"], x["end"]) for x in s]) if s else None for t, s in zip(texts.to_pylist(), spans.to_pylist(), strict=True)], pa.string())

        out = out.withColumn("__clean", cut(text_col, "__spans"))
    keep = [c for c in docs.columns if clean or c != text_col]
    return out.select(*keep, "__words", "__spans", "__items", *["__clean"] * clean, hit_words("__spans").alias("__hit"))


def hit_words(spans: str):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
