"""Tokens of two vocabularies aligned by the bytes they stand for, and how usual each link is in the corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointquarry.llm import tokens
from pointquarry.llm.common import staged
from pointquarry.llm.records import slices

#: Most frequent groups whose weights go to every task, at most, and groups that a task gathers before it adds them up.
FREQUENT, GATHERED = 1 << 17, 1 << 20
#: The sum of counts of groups by eighths of powers of two finds the frequency from which a group is frequent.
LEVELS = 8

KINDS = {
    "row": pa.int64(),
    "n_a": pa.int64(),
    "n_b": pa.int64(),
    "n_groups": pa.int64(),
    "digest": pa.string(),
    "keys": pa.list_(pa.int64()),
    "counts": pa.list_(pa.int64()),
    "key": pa.int64(),
    "name": pa.string(),
    "freq": pa.int64(),
}
ENCODED = "row long, n_a long, n_b long, n_groups long, digest string, keys array<long>, counts array<long>, key long, name string, freq long"


#: Of a text or word without tokens.
NOTHING = (0, 0, b"", b"")


def columns_of(entries: list[tuple]) -> dict[str, pa.Array]:
    kinds = {"n_a": pa.int64(), "n_b": pa.int64(), "names": pa.binary(), "keys": pa.binary()}
    return {c: pa.array([e[k] for e in entries], t) for k, (c, t) in enumerate(kinds.items())}


class Aligner:
    """Groups of words and of whole texts: names such as ``a1,a2|b1``, each between two places where tokens of both end."""

    def __init__(self, a_path: str, b_path: str, seed: int):
        self.a_path, self.b_path, self.seed = a_path, tokens.checked_pieces(b_path), seed
        self.a_bytes, self.b_bytes = tokens.byte_level_bytes(a_path), tokens.piece_bytes(b_path)
        if not all(self.a_bytes) or not all(self.b_bytes):
            raise ValueError("a token without bytes ends nowhere of its own")
        self.a_ids = tokens.ByteLevel(a_path, tuple)
        self.words = tokens.Remembered(self.of_words)

    def of_words(self, words: list[str]) -> dict[str, pa.Array]:
        return columns_of([self.entry(a, b, f" {w}") for a, b, w in zip(self.a_ids.of(words), tokens.piece_ids(self.b_path, words), words, strict=True)])

    def of_texts(self, texts: list[str]) -> pa.Table:
        """The same for whole texts; an empty one has no tokens."""
        a = tokens.byte_level(self.a_path).encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)
        b = tokens.pieces(self.b_path).encode(texts, num_threads=1)
        return pa.table(columns_of([self.entry(x.ids, y, f" {t}") if t else NOTHING for x, y, t in zip(a, b, texts, strict=True)]))

    def entry(self, a: list[int], b: list[int], text: str) -> tuple:
        """(a's tokens, b's tokens, the groups' names, their keys); no groups if the tokens' bytes aren't those of the text."""
        given = text.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != given or b"".join(map(self.b_bytes.__getitem__, b)) != given:
            return NOTHING
        names, i, j = [], 0, 0
        while i < len(a):
            x, y, first, second = len(self.a_bytes[a[i]]), len(self.b_bytes[b[j]]), i, j
            i, j = i + 1, j + 1
            while x != y:
                if x < y:
                    x, i = x + len(self.a_bytes[a[i]]), i + 1
                else:
                    y, j = y + len(self.b_bytes[b[j]]), j + 1
            names.append(f"{a[first]}|{b[second]}" if i - first == j - second == 1 else f"{','.join(map(str, a[first:i]))}|{','.join(map(str, b[second:j]))}")
        keys = np.array([xxhash.xxh64_intdigest(n, self.seed) for n in names], np.uint64)
        return len(a), len(b), ";".join([*names, ""]).encode(), keys.tobytes()


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str, seed: int) -> Aligner:
    return Aligner(a_path, b_path, seed)


def grouped(entries: pa.Table, index: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[dict[str, list], pa.Table]:
    """Columns of the texts that consist of the entries ``index[begin:end]``, and (key, name, freq) of all their groups."""
    n_a, n_b = (np.concatenate([[0], np.cumsum(entries.column(c).to_numpy()[index])]) for c in ("n_a", "n_b"))
    own_names, own_keys = (entries.column(c).combine_chunks() for c in ("names", "keys"))
    names = own_names.cast(pa.large_binary()).take(pa.array(index))
    at, data = np.frombuffer(names.buffers()[1], np.int64), memoryview(names.buffers()[2] or b"")
    keys = np.frombuffer(b"".join(own_keys.to_pylist()), np.int64)
    distinct, where, codes = np.unique(keys, return_index=True, return_inverse=True)
    size = pc.binary_length(own_keys).to_numpy().astype(np.int64) // 8
    groups = np.concatenate([[0], np.cumsum(size[index])])
    starts = np.cumsum(size) - size
    occurring = codes[np.repeat(starts[index] - groups[:-1], size[index]) + np.arange(groups[-1])]
    text = np.repeat(np.arange(len(begins)), groups[ends] - groups[begins])
    pairs, counts = np.unique(text * max(1, len(distinct)) + occurring, return_counts=True)
    cut = np.searchsorted(pairs, np.arange(len(begins) + 1) * max(1, len(distinct)))
    found = {
        "n_a": pa.array(n_a[ends] - n_a[begins]),
        "n_b": pa.array(n_b[ends] - n_b[begins]),
        "n_groups": pa.array(groups[ends] - groups[begins]),
        "digest": pa.array([hashlib.sha256(data[a : b - 1]).hexdigest() if b > a else "" for a, b in zip(at[begins].tolist(), at[ends].tolist(), strict=True)], pa.string()),
        "keys": pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(distinct[pairs % max(1, len(distinct))])),
        "counts": pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(counts, pa.int64())),
    }
    word = np.searchsorted(starts + size, where, side="right")
    named = [n.split(b";")[p] for n, p in zip(own_names.take(pa.array(word)).to_pylist(), (where - starts[word]).tolist(), strict=True)]
    return found, pa.table({"key": pa.array(distinct), "name": pa.array(named, pa.binary()).cast(pa.string()), "freq": pa.array(np.bincount(occurring, minlength=len(distinct)), pa.int64())})


def added(parts: list[pa.Table]) -> pa.Table:
    """One row for each key and name."""
    total = pa.concat_tables(parts).group_by(["key", "name"]).aggregate([("freq", "sum")])
    return total.rename_columns({"freq_sum": "freq"}).select(["key", "name", "freq"])


def batch_of(columns: dict[str, pa.Array | pa.ChunkedArray], n: int) -> pa.RecordBatch:
    """A batch with all columns of ``KINDS``; those not given are null."""
    plain = {c: x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for c, x in columns.items()}
    return pa.RecordBatch.from_arrays([plain[c].cast(t) if c in plain else pa.nulls(n, t) for c, t in KINDS.items()], list(KINDS))


def encode(docs: DataFrame, a_path: str, b_path: str, seed: int) -> DataFrame:
    """Two kinds of rows: each text (``row``, ``text``) with its distinct groups and their counts, and each
    group with its name and its frequency in a part of the texts."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, n = aligner(a_path, b_path, seed), [], 0
        for batch in batches:
            for part in slices(batch):
                rows, texts = part.column("row"), part.column("text")
                words, begins, ends = tokens.words_of_all(texts, first=False)
                coded = words.dictionary_encode()
                entries, index = known.words.of(coded.dictionary), coded.indices.to_numpy()
                # An empty text has no tokens, and one with a word whose bytes are not given back is looked at as a whole.
                lost = np.concatenate([[0], np.cumsum((entries.column("n_a").to_numpy() == 0)[index])])
                odd = np.flatnonzero((lost[ends] > lost[begins]) | (pc.binary_length(texts).to_numpy() == 0))
                fine = np.setdiff1d(np.arange(len(texts)), odd)
                several = [(fine, entries, index, begins[fine], ends[fine])]
                if len(odd):
                    whole = known.of_texts(texts.take(pa.array(odd)).to_pylist())
                    several.append((odd, whole, np.arange(len(odd)), np.arange(len(odd)), np.arange(1, len(odd) + 1)))
                for at, own, places, b, e in several:
                    found, groups = grouped(own, *chosen(places, b, e))
                    yield batch_of({"row": rows.take(pa.array(at)), **found}, len(at))
                    held.append(groups)
                    n += len(groups)
                if n > GATHERED:
                    total = added(held)
                    held, n = [total], len(total)
                    if n > GATHERED // 2:
                        yield batch_of({c: total.column(c) for c in total.column_names}, n)
                        held, n = [], 0
        if held:
            total = added(held)
            yield batch_of({c: total.column(c) for c in total.column_names}, len(total))

    return docs.select("row", "text").mapInArrow(of_task, ENCODED)


def chosen(index: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries of the given texts alone, one text after another, and where they begin and end then."""
    size = ends - begins
    last = np.cumsum(size)
    places = np.repeat(begins - (last - size), size) + np.arange(int(last[-1]) if len(last) else 0)
    return index[places], last - size, last


def weighted(dictionary: DataFrame) -> DataFrame:
    """(key, freq, count, best): for each group the count of its link in the corpus, and whether that is the highest of the
    link's B id. Token ends rise, so a group holds one link: of the last tokens of both sides, which end with it."""
    sides = F.split("name", r"\|")
    links = dictionary.select("key", "freq", *[F.element_at(F.split(F.element_at(sides, k), ","), -1).cast("int").alias(c) for k, c in ((1, "a"), (2, "b"))])
    pairs = staged(links.groupBy("a", "b").agg(F.sum("freq").alias("count")), "link-counts")
    best = pairs.groupBy("b").agg(F.max("count").alias("best"))
    return links.join(pairs.join(best, "b"), ["a", "b"]).select("key", "freq", "count", (F.col("count") == F.col("best")).cast("int").alias("best"))


def frequent_from(weights: DataFrame, most: int) -> int:
    """The frequency that at most ``most`` groups reach."""
    level = F.floor(F.log2("freq") * LEVELS).cast("int")
    rows = weights.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.min("freq").alias("least")).orderBy(F.desc("level")).collect()
    total, least = 0, 1 << 62
    for r in rows:
        total += r["n"]
        if total > most:
            break
        least = r["least"]
    return least


def align_tokens(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, seed: int = 42, frequent: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each whole text with a blank before it by a byte-level vocabulary (A) and a piece vocabulary (B), and cut it into groups
    where tokens of both end.

    A link is a pair of an A token and a B token that end at one place; its count is how many links of the corpus hold the same ids.
    Each distinct group is interned once, by a hash of its ids: its link is expanded once and counted by the group's frequency, and the
    weights go back to the texts by the group's key. The weights of at most ``frequent`` groups go to every task as arrays (24 bytes a
    group); those of all rarer ones are joined, so no frequent key is shuffled.

    Returns the id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose count is the highest of their B id, ties included),
    ``count_sum`` and ``groups_sha256`` (of ``a1,a2|b1;a3|b2,b3``; empty without tokens).

    Null and empty texts, and texts that the tokens of A or B don't give back byte for byte, have no tokens. A text of any length is
    encoded whole, in the memory of its task. Rows repeat and count as often; an empty table gives an empty one. Other columns
    are not read. Two groups of one hash are found out and raise; another ``seed`` settles that.
    """
    a_path, b_path = a_path or tokens.default_path("byte_bpe_50k.json"), b_path or tokens.default_path("piece_bpe_32k.model")
    given = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    both = staged(encode(given, a_path, b_path, seed), "aligned")
    own = staged(given.select("row", "id"), "aligned-ids")
    dictionary = staged(both.where("key is not null").groupBy("key").agg(F.sum("freq").alias("freq"), F.min("name").alias("name"), F.max("name").alias("last")), "groups")
    if not dictionary.where("name <> last").isEmpty():
        raise ValueError("two groups have one hash: give another seed")
    weights = staged(weighted(dictionary), "group-weights")
    least = frequent_from(weights, frequent)
    top = weights.where(F.col("freq") >= least).select("key", "count", "best").toArrow().sort_by("key")
    sent = docs.sparkSession.sparkContext.broadcast(tuple(top.column(c).to_numpy() for c in ("key", "count", "best")))

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, count, best = sent.value
        for batch in batches:
            lists = batch.column("keys")
            offsets, own, n = lists.offsets.to_numpy(), lists.values.to_numpy(), batch.column("counts").values.to_numpy()
            at = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
            seen = keys[at] == own if len(keys) else np.zeros(len(own), bool)
            sums = [np.concatenate([[0], np.cumsum(np.where(seen, n * w[at], 0) if len(keys) else np.zeros(len(own), np.int64))]) for w in (best, count)]
            left = np.concatenate([[0], np.cumsum(~seen)])[offsets]
            rest = [pa.ListArray.from_arrays(pa.array(left - left[0], pa.int32()), pa.array(x[offsets[0] : offsets[-1]][~seen[offsets[0] : offsets[-1]]])) for x in (own, n)]
            columns = [*(batch.column(c) for c in ("row", "n_a", "n_b", "n_groups", "digest")), *(pa.array(s[offsets[1:]] - s[offsets[:-1]]) for s in sums), *rest]
            yield pa.RecordBatch.from_arrays(columns, ["row", "n_a", "n_b", "n_groups", "digest", "n_best", "count_sum", "keys", "counts"])

    texts = both.where("row is not null").select("row", "n_a", "n_b", "n_groups", "digest", "keys", "counts")
    texts = staged(texts.mapInArrow(of_task, "row long, n_a long, n_b long, n_groups long, digest string, n_best long, count_sum long, keys array<long>, counts array<long>"), "aligned-texts")
    rare = texts.select("row", F.explode(F.arrays_zip("keys", "counts")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.counts").alias("n"))
    joined = rare.join(weights.where(F.col("freq") < least), "key").groupBy("row").agg(F.sum(F.col("n") * F.col("best")).alias("rare_best"), F.sum(F.col("n") * F.col("count")).alias("rare_sum"))
    out = own.join(texts.drop("keys", "counts"), "row").join(joined, "row", "left")
    return out.select(
        F.col("id").alias(id_col),
        "n_a",
        "n_b",
        "n_groups",
        F.col("n_groups").alias("n_links"),
        (F.col("n_best") + F.coalesce("rare_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("rare_sum", F.lit(0))).alias("count_sum"),
        F.col("digest").alias("groups_sha256"),
    )
