"""Near copies by SimHash fingerprints and covering hash tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointquarry.llm.common import staged
from pointquarry.llm.graph import components

#: Shingles whose bits are counted at once.
CHUNK = 1 << 16


def fingerprint_of(text: bytes, words_per_shingle: int, seed: int) -> int:
    """The SimHash of a UTF-8 text, as an unsigned number."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < words_per_shingle:
        shingles, n = [b" ".join(words)], 1
    else:
        n = len(words) - words_per_shingle + 1
        shingles = map(b" ".join, zip(*(words[i:] for i in range(words_per_shingle)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, n).astype("<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = hashes[at : at + CHUNK]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def simhash(text: Column, words_per_shingle: int = 3, seed: int = 42) -> Column:
    """A 64-bit fingerprint of each whole text, as a long with the same bits.

    Words are split at ASCII white space after A-Z is lower-cased. Null and wordless
    texts give zero; a text of fewer words than a shingle is one shingle.
    """

    @F.arrow_udf("long")
    def of_batch(texts: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint_of(x.as_buffer().to_pybytes(), words_per_shingle, seed) if x.is_valid else 0 for x in texts), np.uint64, len(texts))
        return pa.array(found.view(np.int64))

    return of_batch(text.cast("string"))


def covering_masks(radius: int) -> list[int]:
    """Bit masks of which one at least misses all differences of any two close values.

    Each bit gets a non-zero vector of radius + 1 coordinates over the two-element field;
    each non-zero vector v gives the mask of bits whose vectors have an odd product
    with v. At most ``radius`` vectors can't span the space, so some v is orthogonal to
    the vectors of all differing bits, and both values agree on its mask. The bits take
    all vectors in turn; for radius 6, where there are more vectors than bits, those whose
    first coordinate is one: then each mask has 32 bits, and one has all.
    """
    if not 0 <= radius <= 6:
        raise ValueError("radius must be 0 to 6")
    n = 2 ** (radius + 1) - 1
    vectors = [1 + i % n for i in range(64)] if n <= 64 else [64 + i for i in range(64)]
    return [sum(1 << i for i in range(64) if (v & vectors[i]).bit_count() % 2) for v in range(1, n + 1)]


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Links between distinct fingerprints that differ in at most ``radius`` bits.

    ``prints`` has one column ``fp`` without repeats. Each fingerprint is put into
    the bucket of each covering mask. No pairs are made in a bucket: each fingerprint
    of a bucket with others names the centres within radius/2 flips of the bits outside the
    mask, and those that name one centre are within the radius of each other by the
    triangle inequality; two within the radius share the centre half-way. A centre
    has at most 65 distinct fingerprints (for radius 2), and each is linked to the
    smallest, so the links grow with the fingerprints and none of them is lost.
    Other radii have too many centres, or none half-way; ``bucket_links`` serves them.
    """
    if radius not in (0, 2):
        return bucket_links(prints, radius)
    masks = covering_masks(radius)
    rows = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("v"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(masks)])).alias("b")).select("fp", "b.*")
    shared = rows.groupBy("v", "key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where(F.col("lo") < F.col("hi")).select("v", "key")
    close = rows.join(shared, ["v", "key"], "left_semi")
    flips = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << b)).cast("long") for b in range(64) if not m >> b & 1]) for m in masks])
    centres = close.select("fp", F.explode(F.get(flips, F.col("v"))).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre")).distinct()
    stars = centres.groupBy("centre").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    return stars.select(F.array_min("fps").alias("dst"), F.explode("fps").alias("src")).where("src <> dst").distinct()


def spanning(fps: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Links that join the fingerprints of a bucket as all its pairs within the radius do:
    one less than the members of each component. A fingerprint that was reached is compared
    with those not reached yet, so a dense bucket takes few rounds. The search begins
    at the member nearest to the majority of all bits: copies of one text then name that text
    in each bucket, and their links are the same ones again and again."""
    bits = np.unpackbits(fps.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    middle = np.packbits(2 * bits > len(fps), bitorder="little").view(np.uint64)[0]
    fps = fps[np.argsort(np.bitwise_count(fps ^ middle), kind="stable")]
    src, dst, left, queue = [], [], fps, np.zeros(0, np.uint64)
    while len(left):
        if not len(queue):
            queue, left = left[:1], left[1:]
        pivot, queue = queue[0], queue[1:]
        near = np.bitwise_count(left ^ pivot) <= radius
        found = left[near]
        src += found.view(np.int64).tolist()
        dst += [int(np.int64(pivot.view(np.int64)))] * len(found)
        queue, left = np.concatenate([queue, found]), left[~near]
    return src, dst


def in_cells(rows: DataFrame, keys: list[str], node: str, total: int, block: int, sample: int = 1 << 16) -> DataFrame:
    """Adds ``cell``, by which together with ``keys`` the members of a bucket are dealt to tasks.

    Members of a bucket that a sample of ``sample`` nodes says to hold more than ``block`` of the ``total``
    are cut into blocks; each pair of blocks is a cell, and a row goes to every cell of its block. So
    all pairs of a bucket still meet, and no task holds more than two blocks. Each hot bucket
    has a thousandth of the sample at least, so the table of these is bounded and broadcast.
    """
    if total <= block:
        return rows.withColumn("cell", F.lit(0))
    every = max(1, total // sample)
    drawn = rows.where(F.pmod(F.xxhash64(node), F.lit(every)) == 0)
    seen = drawn.groupBy(*keys).agg(F.count("*").alias("seen")).where(F.col("seen") >= max(block / every, sample / 1024))
    hot = staged(seen.select(*keys, F.ceil(F.col("seen") * every / block).cast("int").alias("blocks")), "hot-buckets")
    n = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.hash(F.col(node), F.lit(17)), n)
    cells = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.least(own, j) * n + F.greatest(own, j))
    return rows.join(F.broadcast(hot), keys, "left").withColumn("cell", F.explode(cells)).drop("blocks")


def bucket_links(prints: DataFrame, radius: int, rows_per_task: int = 1 << 20, block: int = 1 << 18) -> DataFrame:
    """Links that join distinct fingerprints as all pairs within ``radius`` do.

    The fingerprints are dealt to the buckets of all covering masks, ``rows_per_task`` in a task
    or so, and those of a bucket of more than ``block`` in blocks of which each two meet. A task
    sorts its rows by bucket and links the members of each bucket that are within
    the radius, by a spanning forest and never by all pairs.
    """
    masks, total = covering_masks(radius), prints.count()
    rows = prints.select("fp", F.posexplode(F.array(*[F.lit(signed(m)) for m in masks])).alias("v", "mask"))
    rows = in_cells(rows.select("v", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp"), ["v", "key"], "fp", total, block)
    tasks = max(prints.sparkSession.sparkContext.defaultParallelism, -(-total * len(masks) // rows_per_task))
    dealt = rows.repartition(tasks, "v", "key", "cell").select("v", "fp", "cell")

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("v").to_numpy(), b.column("fp").to_numpy().view(np.uint64), b.column("cell").to_numpy()) for b in batches]
        if not held:
            return
        v, fp, cell = (np.concatenate(x) for x in zip(*held, strict=True))
        key = fp & np.array(masks, np.uint64)[v]
        order = np.lexsort((fp, cell, key, v))
        v, fp, key, cell = v[order], fp[order], key[order], cell[order]
        starts = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])]))
        sizes = np.diff(np.append(starts, len(v)))
        two = starts[sizes == 2]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
        src, dst = fp[two + 1].view(np.int64).tolist(), fp[two].view(np.int64).tolist()
        for a, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            more = spanning(fp[a : a + n], radius)
            src += more[0]
            dst += more[1]
        yield pa.RecordBatch.from_arrays([pa.array(dst, pa.int64()), pa.array(src, pa.int64())], ["dst", "src"])

    return dealt.mapInArrow(of_task, "dst long, src long").distinct()


def near_copies(docs: DataFrame, radius: int = 2, words_per_shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Groups of documents whose fingerprints link, directly or by others.

    Returns the id (as it is), ``fp`` (long), ``component_id`` (smallest id of the group)
    and ``first_fp`` (smallest fingerprint among those rows that hold that id), and the
    columns named in ``carry``, which should be narrow. Equal
    fingerprints are one vertex, so copies cost one row each. Fingerprints are written
    once to the shared folder, texts are never shuffled.

    Null and wordless texts have fingerprint zero and link like others. Rows repeated
    in full stay repeated. Null ids come last: a group of only null ids has a null
    ``component_id``. An empty table gives an empty table.
    """
    prints = staged(docs.select(F.col(id_col).alias("id"), simhash(F.col(text_col), words_per_shingle, seed).alias("fp"), F.struct(*carry).alias("carry") if carry else F.lit(0).alias("carry")), "simhash")
    vertices = prints.groupBy("fp").agg(F.min("id").alias("first"))
    roots = components(links(vertices.select("fp"), radius))
    least = vertices.join(roots.withColumnsRenamed({"node": "fp"}), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    best = least.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), F.col("first"), F.col("fp"))).alias("m"))
    groups = least.join(best, "root").select("fp", F.col("m.first").alias("component_id"), F.col("m.fp").alias("first_fp"))
    return prints.join(groups, "fp").select(F.col("id").alias(id_col), "fp", "component_id", "first_fp", *[F.col("carry")[c].alias(c) for c in carry])
