"""Near copies against brute force: scattered, appended and replaced edits, at similarities on both sides of 0.8."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pointquarry.llm import graph, nearcopies, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
KINDS = ("scattered", "appended", "replaced")


def edited(rng, words, kind, share):
    """A text with ``share`` of its words edited."""
    n, k = len(words), max(1, round(len(words) * share))
    new = [f"n{x}" for x in rng.integers(0, 10**9, k)]
    if kind == "appended":
        return words + new
    out = list(words)
    places = rng.choice(n, k, replace=False) if kind == "scattered" else np.arange(k) + rng.integers(0, n - k + 1)
    for p, w in zip(places.tolist(), new, strict=True):
        out[p] = w
    return out


def similarity(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(x & y) / len(x | y)


def pairs(n):
    """Documents 2i and 2i + 1, of which the second is an edit of the first, with kind and similarity."""
    rng = np.random.default_rng(11)
    out = []
    for i in range(n):
        kind = KINDS[i % 3]
        words = [f"w{x}" for x in rng.zipf(1.3, int(rng.integers(60, 500))) % 50_000]
        share = rng.uniform(0.004, 0.12) if kind == "scattered" else rng.uniform(0.02, 0.5)
        other = edited(rng, words, kind, share)
        out.append((kind, similarity(words, other), " ".join(words), " ".join(other)))
    return out


def test_pairs_are_found_by_their_exact_similarity(spark, sf_dir):
    made = pairs(900)
    rows = [(2 * i + k, t, None, None, None) for i, p in enumerate(made) for k, t in enumerate(p[2:])]
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), sf_dir).collect()}
    assert kept >= set(range(0, 1800, 2))
    for kind in KINDS:
        near = [2 * i + 1 not in kept for i, p in enumerate(made) if p[0] == kind and p[1] >= 0.8]
        print(kind, "found", sum(near), "of", len(near))
        assert len(near) > 30 and np.mean(near) >= 0.99
        apart = [2 * i + 1 not in kept for i, p in enumerate(made) if p[0] == kind and 0.35 <= p[1] < 0.8]
        print(kind, "wrong", sum(apart), "of", len(apart))
        assert len(apart) > 30 and not any(apart)


def test_a_large_group_hangs_together(spark, sf_dir):
    rng = np.random.default_rng(12)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 300)]
    rows = [(i, " ".join(edited(rng, base, "scattered", 0.01) if i else base), None, None, None) for i in range(300)]
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), sf_dir).collect()] == [0]


def test_prefixes_miss_no_pair(spark):
    rng = np.random.default_rng(13)
    bases = [rng.choice(10**6, 60, replace=False) for _ in range(8)]
    shared = rng.choice(10**6, 40, replace=False)
    sets = {}
    for i in range(160):
        own = set(rng.choice(bases[i % 8], int(rng.integers(50, 61)), replace=False).tolist())
        sets[i] = own | (set(shared.tolist()) if i % 3 else set()) | set(rng.integers(0, 10**6, int(rng.integers(0, 8))).tolist())
    roots = {i: i % 8 if i % 5 else i for i in sets}
    nodes = spark.createDataFrame([(i, roots[i], len(s)) for i, s in sets.items()], "node long, root long, n long")
    given = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "node long, s array<long>")
    want = {(i, j) for i in sets for j in sets if i < j and roots[i] != roots[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert len(want) > 100
    for spread, parts in ((8.0, 10**6), (0.5, 10**6), (8.0, 3)):
        placed = nodes.withColumn("block", F.col("node") % parts)
        found = nearcopies.compared(placed, given, nearcopies.prefix_blocks(placed, given, spread)).collect()
        pairs = {(r.a, r.b) for r in found}
        assert pairs <= want
        joined = {(x, roots[y]) for p in pairs for x, y in (p, p[::-1])}
        assert all((i, roots[j]) in joined or (j, roots[i]) in joined for i, j in want)
        # With a block for each node, every pair is a link of its own.
        assert parts == 3 or pairs == want


def test_a_pair_far_from_its_crowd_is_linked(spark, sf_dir):
    """Copies of a crowd's text whose own edits agree: near each other, but not near the crowd's middle."""
    rng = np.random.default_rng(14)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 300)]
    texts = [" ".join(edited(rng, base, "scattered", 0.004)) for _ in range(200)]
    apart = edited(rng, base, "replaced", 0.14)
    texts += [" ".join(edited(rng, apart, "scattered", 0.004)) for _ in range(3)]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), sf_dir).collect()) == [0, 200]


@pytest.mark.parametrize("block", [10, 50, 10**6])
def test_buckets_in_blocks_link_alike(spark, block):
    rng = np.random.default_rng(15)
    middle = int(rng.integers(1, 2**62))
    fps = sorted({middle ^ sum(1 << int(b) for b in rng.choice(62, int(rng.integers(0, 5)), replace=False)) for _ in range(150)})
    prints = spark.createDataFrame([(x,) for x in fps], "fp long")
    roots = {r.node: r.root for r in graph.components(simhash.bucket_links(prints, 4, block=block)).collect()}
    parent = {x: x for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in fps:
        for y in fps:
            if (x ^ y).bit_count() <= 4:
                a, b = sorted((find(x), find(y)))
                parent[b] = a
    assert {x: roots.get(x, x) for x in fps} == {x: find(x) for x in fps}


def test_edges_of_one_part_take_no_rounds(spark):
    rng = np.random.default_rng(16)
    edges = [(i, i + 1) for i in range(400) if i % 50] + [(int(a), int(b)) for a, b in rng.integers(1000, 1400, (300, 2))] + [(2000, 2000), (1, 1), (None, 3)]
    given = spark.createDataFrame(edges, "src long, dst long")
    spark.sparkContext.setJobGroup("components-at-once", "")
    at_once = sorted(map(tuple, graph.components(given).collect()))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("components-at-once"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert at_once == sorted(map(tuple, graph.components(given, edges_per_task=40).collect()))
    assert (2000, 2000) in at_once and (1, 1) in at_once
    # Each round is many jobs, and each job is memory of the driver.
    assert jobs <= 8


def test_short_and_wordless_texts(spark, sf_dir):
    rows = [(1, "a b", None, None, None), (2, "A  b", None, None, None), (3, "a b c", None, None, None), (4, "", None, None, None), (5, None, None, None, None), (6, " \n", None, None, None)]
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), sf_dir).collect())
    assert kept == [1, 3, 4]


@pytest.mark.parametrize("text,n", [(b"", 0), (b"a b", 1), (b"a b c d e", 1), (b"a b c d e f", 2), (b"x " * 50, 1)])
def test_shingles(text, n):
    assert len(nearcopies.shingles_of(text)) == n
    assert len(nearcopies.bands_of(nearcopies.shingles_of(text))) == (nearcopies.BANDS if n else 0)
