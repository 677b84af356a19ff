"""Near copies by SimHash and min-wise candidates, each verified by its exact Jaccard similarity."""

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
from pointquarry.llm.simhash import bucket_links, fingerprint_of, in_cells

#: Words of a shingle, and the similarity of near copies as a fraction.
WORDS, PART, WHOLE = 5, 4, 5
#: Keys of a document by min-wise hashes: at a similarity of 0.8 one of 20 keys of 5 agrees with 0.9996.
BANDS, ROWS = 20, 5
#: Members of a bucket up to which all its pairs are candidates, and bits within which more gather around one.
FEW, WIDE = 16, 16
#: Places of the bitmap by which texts are chosen for verification. Others that meet cost time only.
PLACES = 1 << 24
#: Shingles whose min-wise hashes are taken at once.
CHUNK = 1 << 13
#: Nodes of a block that is compared as a whole, and nodes that a task compares with one.
MEMBERS, ASKING = 512, 1024
SALTS = np.random.default_rng(5).integers(1, 2**63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles_of(text: bytes) -> np.ndarray:
    """Hashes of the distinct five-word shingles, sorted. A text of fewer words is one shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - WORDS + 1)
    parts = map(b" ".join, zip(*(words[i:] for i in range(WORDS)), strict=False)) if len(words) >= WORDS else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(7)), np.uint64, n))


def bands_of(shingles: np.ndarray) -> list[int]:
    """A key for each band of min-wise hashes; none without shingles."""
    if not len(shingles):
        return []
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), CHUNK):
        part = (shingles[at : at + CHUNK, None] ^ SALTS[0]) * SALTS[1]
        np.minimum(least, part.min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]


def bytes_of(x: pa.Scalar) -> bytes:
    return x.as_buffer().to_pybytes() if x.is_valid else b""


def printed(docs: DataFrame, words_per_shingle: int) -> DataFrame:
    """(__id, __hash, node, n, fp, bands): ``node`` is a hash of the set of ``n`` shingles, so copies share it."""
    kind = pa.struct([("node", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64()))])

    @F.arrow_udf("struct<node:bigint,n:bigint,fp:bigint,bands:array<bigint>>")
    def of_batch(texts: pa.Array) -> pa.Array:
        out = []
        for t in map(bytes_of, texts):
            s = shingles_of(t)
            whole = np.array([xxhash.xxh64_intdigest(s.tobytes(), 11), fingerprint_of(t, words_per_shingle, 42)], np.uint64).view(np.int64).tolist()
            out.append({"node": whole[0], "n": len(s), "fp": whole[1], "bands": np.array(bands_of(s), np.uint64).view(np.int64).tolist()})
        return pa.array(out, kind)

    return docs.select("__id", "__hash", of_batch(F.col("text").cast("string")).alias("p")).select("__id", "__hash", "p.*")


def sized(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be near copies at all."""
    return WHOLE * np.minimum(a, b) >= PART * np.maximum(a, b)


def pairs_of(fp: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidates of a bucket, by places: all pairs of a few members. Of more, each with the member
    nearest to the majority of bits among those not near to an earlier one, and with the next by size;
    the rest of the pairs is left to ``prefix_blocks``."""
    if len(fp) <= FEW:
        a, b = np.triu_indices(len(fp), 1)
    else:
        bits = np.unpackbits(fp.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
        middle = np.packbits(2 * bits > len(fp), bitorder="little").view(np.uint64)[0]
        left = np.argsort(np.bitwise_count(fp ^ middle), kind="stable")
        by_size = np.argsort(n, kind="stable")
        hubs, members = [by_size[:-1]], [by_size[1:]]
        while len(left) > 1:
            hub, left = left[0], left[1:]
            near = np.bitwise_count(fp[left] ^ fp[hub]) <= WIDE
            hubs.append(np.full(near.sum(), hub))
            members.append(left[near])
            left = left[~near]
        a, b = np.concatenate(hubs), np.concatenate(members)
    fit = sized(n[a], n[b])
    return a[fit], b[fit]


def band_links(nodes: DataFrame, total: int, rows_per_task: int = 1 << 19, block: int = 1 << 17) -> DataFrame:
    """Candidates (src, dst, ns, nd, partial), with their sizes, among nodes that share the key of a band; ``partial`` where
    the bucket has others too. A bucket of more than ``block`` nodes is dealt in blocks of which each two meet."""
    tasks = max(nodes.sparkSession.sparkContext.defaultParallelism, -(-total * BANDS // rows_per_task))
    rows = in_cells(nodes.select(F.explode("bands").alias("key"), "node", "n", "fp"), ["key"], "node", total, block)
    dealt = rows.repartition(tasks, "key", "cell")

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [tuple(b.column(c).to_numpy() for c in ("key", "cell", "node", "n", "fp")) for b in batches]
        if not held:
            return
        key, cell, node, n, fp = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((node, cell, key))
        key, cell, node, n, fp = key[order], cell[order], node[order], n[order], fp[order].view(np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])]))
        sizes = np.diff(np.append(starts, len(key)))
        two = starts[sizes == 2]
        two = two[sized(n[two], n[two + 1])]
        src, dst, partial = [two + 1], [two], [np.zeros(len(two), bool)]
        for at, m in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            a, b = pairs_of(fp[at : at + m], n[at : at + m])
            src.append(at + b)
            dst.append(at + a)
            partial.append(np.full(len(a), m > FEW))
        src, dst, partial = (np.concatenate(x) for x in (src, dst, partial))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node[src], node[dst], n[src], n[dst], partial)], ["src", "dst", "ns", "nd", "partial"])

    return dealt.mapInArrow(of_task, "src long, dst long, ns long, nd long, partial boolean")


def print_links(nodes: DataFrame, radius: int) -> DataFrame:
    """Candidates (src, dst, ns, nd, partial) by fingerprints: the first nodes of linked ones, and nodes of one
    fingerprint with its first. These are spanning forests, so others may be near too."""
    first = nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("first"))
    same = nodes.select("fp", "node", "n").join(first, "fp").where("node <> first.node").select(F.col("node").alias("src"), F.col("first.node").alias("dst"), F.col("n").alias("ns"), F.col("first.n").alias("nd"))
    near = bucket_links(first.select("fp"), radius)
    a, b = (first.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}")) for c in ("src", "dst"))
    linked = near.join(a, "src").join(b, "dst").select("first_src.node", "first_dst.node", "first_src.n", "first_dst.n")
    return same.union(linked).withColumn("partial", F.lit(True))


def shingle_sets(docs: DataFrame, nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(node, s): the shingles of all ends of the pairs. Texts are read again where a bitmap of the ends' first rows has a place
    for their id and hash, so only the shingles of candidates are written, and of copies those of the first alone."""
    ends = asked.select(F.col("a").alias("node")).union(asked.select("b")).distinct()
    texts = staged(nodes.join(ends, "node").select("node", "first.*"), "near-texts")
    places = texts.select(F.pmod(F.xxhash64("__id", "__hash"), F.lit(PLACES)).cast("int").alias("p")).distinct().toArrow().column("p").to_numpy()
    bitmap = np.zeros(PLACES, bool)
    bitmap[places] = True
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(bitmap))

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(sent.value).astype(bool)
        for batch in batches:
            found = batch.filter(pa.array(wanted[batch.column("place").to_numpy()]))
            for at in range(0, len(found), 256):
                part = found.slice(at, 256)
                sets = [shingles_of(bytes_of(t)).view(np.int64) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("__id"), part.column("__hash"), pa.array(sets, pa.list_(pa.int64()))], ["__id", "__hash", "s"])

    place = F.pmod(F.xxhash64("__id", "__hash"), F.lit(PLACES)).alias("place")
    read = docs.select("__id", "__hash", place, F.col("text").cast("string").alias("text")).where("text is not null").mapInArrow(of_task, "__id long, __hash long, s array<long>")
    return staged(read.join(texts, ["__id", "__hash"]).groupBy("node").agg(F.first("s").alias("s")), "near-sets")


def verified(asked: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b, na, nb) whose sets share 4/5 of their union or more, counted exactly. The end that is in
    fewer pairs gets its set first, so the set of a hub is not shuffled with each of its pairs."""
    ends = asked.select(F.col("a").alias("node")).union(asked.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("m"))
    ma, mb = (ends.withColumnsRenamed({"node": c, "m": f"m{c}"}) for c in "ab")
    turned = F.col("ma") > F.col("mb")
    pairs = asked.join(ma, "a").join(mb, "b").select("a", "b", "na", "nb", F.when(turned, F.col("b")).otherwise(F.col("a")).alias("few"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("hub"))
    few, hub = (sets.withColumnsRenamed({"node": c, "s": f"s_{c}"}) for c in ("few", "hub"))
    shared = F.size(F.array_intersect("s_few", "s_hub"))
    counted = pairs.join(few, "few").join(hub, "hub").select("a", "b", "na", "nb", shared.alias("both"))
    return staged(counted.where(F.col("both") * WHOLE >= (F.col("na") + F.col("nb") - F.col("both")) * PART).select("a", "b"), "near-links")


def rooted(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root, first, n) of all nodes."""
    roots = components(links, "a", "b")
    return staged(nodes.select("node", "first", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "near-roots")


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Adds ``ra`` and ``rb``, the roots of the ends, to the pairs of which these differ."""
    ra, rb = (roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
    return pairs.join(ra, "a").join(rb, "b").where("ra <> rb")


def prefix_blocks(nodes: DataFrame, sets: DataFrame, spread: float = 8.0) -> DataFrame:
    """(node, block): the blocks of nodes in which one of another root may share 4/5 of the union with a node.

    A join by prefixes: shingles are ordered by how many of the given nodes have them, the rarest first.
    Of two sets that are near copies the first fifths (and one more) share a shingle, at places after
    which both still hold enough for the similarity. Passages that many nodes share come last in this order
    and so make no pairs. In the list of a shingle only pairs of different roots are
    looked at: nodes of other roots than the most frequent one with all behind them. A list gives each node the blocks of its
    partners, not the partners, so a family just below the similarity gives few rows. Long
    lists are dealt in parts of the most frequent root's nodes, 1 / ``spread`` of its root many.
    """
    tokens = sets.join(nodes.select("node", "root", "n"), "node").select("node", "root", "n", F.explode("s").alias("t"))
    df = tokens.groupBy("t").agg(F.count("*").alias("df"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    ordered = tokens.join(df, "t").groupBy("node", "root", "n").agg(F.array_sort(F.collect_list(F.struct("df", "t", (F.col("lo") < F.col("hi")).alias("mixed")))).alias("s"))
    prefix = F.slice("s", 1, (F.col("n") - F.ceil(F.col("n") * PART / WHOLE) + 1).cast("int"))
    held = staged(ordered.select("node", "root", "n", F.posexplode(prefix).alias("at", "x")).where("x.mixed").select("node", "root", "n", "at", "x.t"), "near-prefixes")
    by_root = held.groupBy("t", "root").agg(F.count("*").alias("m"))
    lists = staged(by_root.groupBy("t").agg(F.max_by("root", F.struct("m", "root")).alias("most"), F.max("m").alias("top")), "near-lists")
    salts = F.ceil(F.sqrt("top") / spread).cast("int")
    own = F.when(F.col("root") == F.col("most"), F.array(F.pmod(F.hash("node"), salts))).otherwise(F.sequence(F.lit(0), salts - 1))
    dealt = held.join(lists, "t").join(nodes.select("node", "block"), "node").select("t", F.explode(own).alias("salt"), "node", "root", "n", "at", (F.col("root") == F.col("most")).alias("common"), "block")
    parts = max(nodes.sparkSession.sparkContext.defaultParallelism, -(-held.count() // (1 << 19)))

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("t", "salt", "node", "root", "n", "at", "common", "block")) for b in batches if len(b)]
        if not held:
            return
        t, salt, node, root, n, at, common, block = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((common, salt, t))
        t, salt, node, root, n, at, common, block = (x[order] for x in (t, salt, node, root, n, at, common, block))

        def close(i: np.ndarray | int, j: np.ndarray | slice) -> np.ndarray:
            room = 1 + np.minimum(n[i] - 1 - at[i], n[j] - 1 - at[j])
            return (root[j] != root[i]) & sized(n[i], n[j]) & (room * (PART + WHOLE) >= PART * (n[i] + n[j]))

        starts = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (salt[1:] != salt[:-1])]))
        ends = np.append(starts[1:], len(t))
        two = starts[ends - starts == 2]
        two = two[close(two, two + 1)]
        asking, blocks = [node[two]], [block[two + 1]]
        for begin, end in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist(), strict=True):
            # Nodes of the most frequent root come last and are not compared with one another.
            for i in range(begin, begin + np.searchsorted(common[begin:end], True)):
                found = np.unique(block[i + 1 : end][close(i, slice(i + 1, end))])
                asking.append(np.full(len(found), node[i]))
                blocks.append(found)
        rows = np.unique(np.stack([np.concatenate(asking), np.concatenate(blocks)], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], ["node", "block"])

    return staged(dealt.repartition(parts, "t", "salt").mapInArrow(of_task, "node long, block long").distinct(), "near-blocks")


def compared(nodes: DataFrame, sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """Links (a, b) of nodes that share 4/5 of their union or more with one of another root in a wanted block, counted exactly: of each
    node one link for each block and root.

    A task holds the sets of a block's members and counts what each node that asks for it shares with all of them; a block for which many
    ask goes to several tasks.
    """
    sized_ = wanted.groupBy("block").agg(F.ceil(F.count("*") / ASKING).cast("int").alias("chunks"))
    columns = ["block", "chunk", "asks", "node", "root", "n", "s"]
    whole = nodes.join(sets, "node")
    members = whole.join(sized_, "block").withColumns({"asks": F.lit(False), "chunk": F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))})
    asking = wanted.join(sized_, "block").join(whole.drop("block"), "node").withColumns({"asks": F.lit(True), "chunk": F.pmod(F.hash("node"), F.col("chunks"))})
    both = members.select(columns).unionByName(asking.select(columns))

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, ready = None, [], None
        for batch in batches:
            lists = batch.column("s")
            values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            names, roots, sizes = (batch.column(c).to_numpy() for c in ("node", "root", "n"))
            a, b = [], []
            for i, (block, chunk, asks) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("block", "chunk", "asks")), strict=True)):
                own = values[offsets[i] : offsets[i + 1]]
                if (block, chunk) != place:
                    place, held, ready = (block, chunk), [], None
                if not asks:
                    held.append((names[i], roots[i], sizes[i], own))
                    continue
                if ready is None:
                    ready = tuple(np.array([h[k] for h in held], np.int64) for k in range(3)), np.concatenate([h[3] for h in held] or [own[:0]]), np.repeat(np.arange(len(held)), [len(h[3]) for h in held])
                (node, root, n), shingles, of = ready
                mine = np.sort(own)
                at = np.minimum(np.searchsorted(mine, shingles), len(mine) - 1)
                shared = np.bincount(of[mine[at] == shingles], minlength=len(node))
                good = np.flatnonzero((root != roots[i]) & (shared * WHOLE >= (n + sizes[i] - shared) * PART))
                first = good[np.unique(root[good], return_index=True)[1]]
                a += [names[i]] * len(first)
                b += node[first].tolist()
            a, b = np.array(a, np.int64), np.array(b, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    dealt = both.repartition("block", "chunk").sortWithinPartitions("block", "chunk", "asks", "node")
    return staged(dealt.mapInArrow(of_task, "a long, b long").distinct(), "near-links")


def firsts(docs: DataFrame, radius: int, words_per_shingle: int) -> DataFrame:
    """(__id, __hash) of the document of the smallest id of each group of near copies.

    ``docs`` has ``__id``, ``__hash`` (of the text) and ``text``. Near copies share 4/5 or more of
    their distinct five-word shingles (words between ASCII white space, A-Z lower-cased); groups
    are what such pairs connect. Candidates are fingerprints within ``radius`` bits and documents that
    share a band of min-wise hashes. Of each candidate the similarity is counted, so no other pair
    is linked. Each document is compared with its most frequent candidate first, and then with those that
    are in no group with it yet. In buckets of which only a part of the pairs were candidates the groups
    with a pair that failed are joined by prefixes and compared in blocks, so every near copy that met in a
    bucket is linked. Equal sets are one node. Null and wordless texts are copies of one another.
    """
    prints = staged(printed(docs, words_per_shingle), "near-prints")
    one = prints.groupBy("node").agg(F.min(F.struct("__id", "__hash")).alias("first"), F.first("n").alias("n"), F.min("fp").alias("fp"), F.first("bands").alias("bands"))
    nodes = staged(one, "near-nodes")
    found = print_links(nodes, radius).union(band_links(nodes, nodes.count())).where("src <> dst")
    found = found.where(F.least("ns", "nd") * WHOLE >= F.greatest("ns", "nd") * PART)
    turned = F.col("src") < F.col("dst")
    ends = [F.when(turned, F.col(x)).otherwise(F.col(y)).alias(c) for c, x, y in (("a", "src", "dst"), ("b", "dst", "src"), ("na", "ns", "nd"), ("nb", "nd", "ns"))]
    asked = found.select(*ends, "dst", "partial").groupBy("a", "b", "na", "nb").agg(F.max("partial").alias("partial"), F.max("dst").alias("hub"), F.count("*").alias("met"))
    asked = staged(asked, "near-asked")
    sets = shingle_sets(docs, nodes, asked)
    best = asked.groupBy(F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("member")).agg(F.max_by(F.struct("a", "b", "na", "nb"), F.struct("met", "hub")).alias("p"))
    links = verified(best.select("p.*").distinct(), sets)
    left = staged(apart(asked, rooted(nodes, links)).drop("ra", "rb"), "near-left")
    links = links.union(verified(left, sets))
    roots = rooted(nodes, links)
    failed = staged(apart(left.where("partial"), roots).select("ra", "rb"), "near-failed")
    if not failed.isEmpty():
        open_roots = failed.select(F.explode(F.array("ra", "rb")).alias("root")).distinct()
        # Blocks are parts of the families that failed pairs connect, so nodes that may be near are in few of them.
        family = components(failed, "ra", "rb").select(F.col("node").alias("root"), F.col("root").alias("family"))
        rest = staged(roots.join(open_roots, "root", "left_semi").select("node", "root", "n").join(family, "root"), "near-open")
        many = rest.groupBy("family").agg(F.ceil(F.count("*") / MEMBERS).alias("parts"))
        rest = staged(rest.join(many, "family").select("node", "root", "n", F.xxhash64("family", F.pmod(F.hash("node"), "parts")).alias("block")), "near-rest")
        more = compared(rest, sets, prefix_blocks(rest, sets))
        if not more.isEmpty():
            roots = rooted(nodes, links.union(more))
    return roots.groupBy("root").agg(F.min("first").alias("f")).select("f.__id", "f.__hash")
