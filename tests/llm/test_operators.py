"""The corpus operators against brute force, round trips and held-out labels."""

import collections
import hashlib
import io
import math
import os
import re
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from pointquarry.llm import chat, common, decontam, fmindex, graph, langid, license_scan, linededup, mixing, neighbours, queries, router, simhash, toxicity, warc

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORDS.findall((text or "").translate(ASCII))


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").toPandas()


# 1: licences


def test_licenses_by_brute_force(spark, sf_dir):
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    got = {r.doc_id: r for r in queries.op1_license_scan(spark, sf_dir).collect()}
    for d in table(spark, sf_dir, "documents").itertuples():
        w, at = words(d.text), []
        for label, p in phrases.items():
            at += [(i, label) for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        r = got[d.doc_id]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(at), ",".join(sorted({x for _, x in at})))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1


def test_license_templates(spark):
    mit = license_scan.NOTICES[3].text.title()
    rows = [(1, f"x\n{mit}"), (2, "Permission is hereby granted, free of charge, to nobody"), (3, "GNU General Public License"), (4, None), (5, ""), (6, "under the MIT license"), (7, "cc-by-nc cc by nc")]
    got = {r.id: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "id int, text string")).collect()}
    assert got[1]["__labels"] == ["mit"]
    assert got[1]["__score"] == 1.0
    assert got[2]["__labels"] == []
    assert got[4]["__words"] == got[5]["__words"] == 0
    assert got[6]["__base"] == 0
    assert (got[7]["__base"], got[7]["__first"], got[7]["__last"]) == (2, 0, 3)


# 2: mixing


def test_mixing_nears_its_targets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").set_index("doc_id")
    runs = [queries.op2_mixing(spark, sf_dir).toPandas().sort_values("doc_id").reset_index(drop=True) for _ in range(2)]
    assert runs[0].equals(runs[1])
    m = runs[0].assign(source=lambda x: docs.loc[x.doc_id, "source"].to_numpy())
    assert (m["taken"] <= 2 * m["size"]).all()
    assert all(m.set_index("doc_id")["size"][i] == len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs.text.items())
    by = m.fillna({"source": "\U0010ffff"}).groupby("source").agg(size=("size", "sum"), told=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by.told).all()
    assert (by.target <= 2 * by["size"] + 1e-6).all()
    assert by.target.sum() == pytest.approx(min(1.5, 2) * by["size"].sum())
    assert (abs(by.taken - by.target) <= 0.02 * by.target + 64).all()


@pytest.mark.parametrize("most,epochs", [(2.0, 1.5), (2.0, 0.4), (3.0, 2.5)])
def test_sources_of_short_texts_reach_their_targets(spark, most, epochs):
    small = F.when(F.col("id") < 1000, F.lit("a")).otherwise(F.concat(F.lit("b"), (F.col("id") % 2).cast("string")))
    rows = spark.range(120_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x "), F.when(F.col("id") < 1000, 10).otherwise(12)).alias("text"), small.alias("source"))
    m = mixing.mix(rows, [30, 1, 2], epochs, most, carry=("source",))
    by = m.groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken"), F.max(F.col("taken") / F.col("size")).alias("times")).collect()
    assert len(by) == 3
    print(by)
    assert all(abs(r.taken - r.target) <= 16 and r.times <= most for r in by)


def test_apportionment_by_brute_force(spark):
    weights = [53, 24, 23, 7, 1, 0]
    claims = spark.createDataFrame([(i, 100, w) for i, w in enumerate(weights)], "i int, seats int, w int")
    got = [r.quota for r in mixing.sainte_lague(claims, "seats", "w", [], "i").orderBy("i").collect()]
    won = [0] * len(weights)
    for _ in range(100):
        won[max(range(len(weights)), key=lambda i: (weights[i] / (2 * won[i] + 1), -i))] += 1
    assert got == won


# 3: SimHash


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(ids, fps, radius):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius and find(i) != find(j):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(d, least.get(find(i), d))
    return [least[find(i)] for i in range(len(ids))]


def test_simhash_by_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").sort_values("doc_id")
    got = queries.op3_simhash(spark, sf_dir).toPandas().sort_values("doc_id")
    fps = [fingerprint(t) for t in docs.text]
    assert got.fingerprint.tolist() == [f"{x:016x}" for x in fps]
    assert got.component_id.tolist() == grouped(docs.doc_id.tolist(), fps, 2)


@pytest.mark.parametrize("radius", [2, 3, 6])
def test_links_of_any_radius(spark, radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = sorted({int(b) ^ sum(1 << int(i) for i in rng.choice(64, k, replace=False)) for b in base for k in range(radius + 2) for _ in range(4)})
    df = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    roots = {r.node: r.root for r in graph.components(simhash.links(df, radius)).collect()}
    want = grouped([simhash.signed(x) for x in fps], fps, radius)
    assert [roots.get(simhash.signed(x), simhash.signed(x)) for x in fps] == want


@pytest.mark.parametrize("few", [1, 10**6])
def test_labels_of_labels(spark, few):
    hop = spark.createDataFrame([(i, i, 5 if i > 4 else max(0, i - 1)) for i in range(60)], "node long, old long, mid long")
    onward = hop.where("mid < node").selectExpr("node as mid", "mid as next")
    asked = hop.select("mid").distinct().join(onward, "mid")
    label = {r.node: r.mid for r in hop.collect()}
    assert {r.node: r.root for r in graph.looked_up(hop, asked, few).collect()} == {i: label[label[i]] for i in label}


@pytest.mark.parametrize("per_task", [1 << 20, 7])
def test_components_by_brute_force(spark, per_task):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(i, i + 1) for i in range(200, 260)] + [(500, 500), (None, 3)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "src long, dst long"), edges_per_task=per_task).collect()}
    root = {x: x for p in pairs[:-1] for x in p}
    for _ in root:
        for a, b in pairs[:-1]:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root
    assert graph.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_masks_cover_all_differences():
    for radius in range(7):
        masks, rng = simhash.covering_masks(radius), np.random.default_rng(0)
        assert min(m.bit_count() for m in masks) >= 28
        for _ in range(300):
            flips = sum(1 << int(i) for i in rng.choice(64, radius, replace=False))
            assert any(not m & flips for m in masks)


# 4: nearest neighbours


def test_neighbours_by_brute_force(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    x, ids = np.stack(e.embedding).astype(float), e.vec_id.to_numpy()
    got = queries.op4_neighbours(spark, sf_dir).toPandas()
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        score[i] = -np.inf
        near = ids[np.lexsort((ids, -score))[:20]]
        g = got[got.query_id == ids[i]].sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21))
        assert g.score.tolist() == pytest.approx([score[ids == v][0] for v in g.vec_id], abs=1e-12)
        hits, total = hits + len(set(near) & set(g.vec_id)), total + 20
    assert hits / total >= 0.9


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, float(i % 3)]) for i in range(6)] + [(0, [1.0, 0.0]), (6, None), (7, [0.0, 0.0]), (8, [1.0, None]), (9, [nan, 1.0]), (10, [inf, 1.0]), (None, [1.0, 1.0]), (11, [1.0]), (12, [])]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") == 0, k=20).toPandas()
    assert got.vec_id.tolist() == [1, 2, 3, 4, 5]
    assert got.score.tolist() == [1.0] * 5
    assert neighbours.search(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
    assert neighbours.search(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")).count() == 0


def test_many_equal_vectors_tie_to_small_ids(spark):
    df = spark.range(300).selectExpr("id as vec_id", "if(id < 280, array(1F, 0F), array(0F, cast(id as float))) as embedding")
    got = neighbours.search(df, F.col("id") % 100 == 0, k=20).toPandas()
    for q in (0, 100, 200):
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == [i for i in range(22) if i != q][:20]


def test_parts_are_balanced():
    x = np.random.default_rng(0).normal(size=(256, 8)).astype(np.float32)
    part = router.balanced_parts(x, router.neighbour_graph(x, 10), 8, 1)
    assert np.bincount(part).tolist() == [32] * 8


def nearest_by_brute_force(rows, asked, k):
    found = {}
    for q, v in asked:
        same = [(-float(np.dot(np.array(v, float), np.array(x, float))), i) for i, x in rows if i != q and len(x) == len(v)]
        found[q] = [i for _, i in sorted(same)[:k]]
    return found


def test_vectors_of_every_length_are_searched(spark):
    rng = np.random.default_rng(21)
    rows = [(i, rng.normal(size=8).round(3).tolist()) for i in range(60)] + [(100 + i, rng.normal(size=5).round(3).tolist()) for i in range(7)] + [(200, [1.0]), (201, []), (202, [2.0, 0.5, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as part", "2 as h", "3 as v")
    got = collections.defaultdict(list)
    for r in sorted(neighbours.search(df, k=3).collect()):
        got[r.query_id].append(r.vec_id)
    want = nearest_by_brute_force(rows, rows, 3)
    for q, v in rows:
        if len(v) != 8:
            assert got[q] == want[q]
    assert np.mean([len(set(got[q]) & set(want[q])) / 3 for q, v in rows if len(v) == 8]) >= 0.9


def test_many_parts_of_clustered_vectors(spark):
    rng = np.random.default_rng(22)
    middles = rng.normal(size=(300, 16))
    middles /= np.linalg.norm(middles, axis=1, keepdims=True)
    rows = [(i, (middles[i % 300] + 0.05 * rng.normal(size=16)).round(4).tolist()) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(set)
    for r in neighbours.search(df, F.col("id") % 100 == 0, k=10, rows_per_part=12).collect():
        got[r.query_id].add(r.vec_id)
    want = nearest_by_brute_force(rows, [rows[i] for i in range(0, 6000, 100)], 10)
    assert np.mean([len(got[q] & set(w)) / 10 for q, w in want.items()]) >= 0.9


# 5: archives


def pages(spark):
    long = "é" * 700
    rows = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", long), (3, None, long), (4, "http://a/\r\nX: y", None), (5, "u", ""), (6, "http://a/6", long + "!"), (7, "u", "<p>one</p>"), (9, "u", long)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archives_round_trip(spark):
    got = {int(r.page): r for r in warc.round_trip(pages(spark), archive_bytes=200, payloads=True).collect()}
    html = {r.page_id: (r.html or "").encode() for r in pages(spark).collect()}
    assert {k: (r.bytes, r.digest) for k, r in got.items()} == {k: (len(v), hashlib.sha1(v).hexdigest()) for k, v in html.items()}
    assert {k: r.refers_to for k, r in got.items() if r.type == "revisit"} == {2: "9", 3: "9"}
    assert all(bytes(r.payload) == html[k] for k, r in got.items() if r.type == "response")
    assert got[4].url == "http://a/%0D%0AX:%20y"
    assert got[3].url is None


def test_archives_of_no_pages(spark):
    assert warc.round_trip(pages(spark).limit(0)).count() == 0
    same = spark.createDataFrame([(1, "u", "x" * 2000)] * 2 + [(None, "u", "x" * 2000)], "page_id long, url string, html string")
    assert sorted((r.page, r.type, r.refers_to) for r in warc.round_trip(same).collect()) == [("1", "response", None)] * 2 + [("null", "revisit", "1")]


@pytest.mark.parametrize("limit", [1 << 40, 10])
def test_directories_of_both_kinds(tmp_path, monkeypatch, limit):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2 if limit == 10 else 65535)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.comment = b"PK\5\6 in a comment"
        for i in range(4):
            z.writestr(f"m{i}", bytes([i]) * (100 + i))
        z.writestr("packed", b"x" * 100, zipfile.ZIP_DEFLATED)
    with warc.Package(str(tmp_path / "a.zip")) as p:
        assert set(p.members) == {"m0", "m1", "m2", "m3", "packed"}
        assert all(p.range(*p.stored(f"m{i}")) == bytes([i]) * (100 + i) for i in range(4))
        with pytest.raises(ValueError, match="compressed"):
            p.stored("packed")
    (tmp_path / "b.zip").write_bytes(b"no archive")
    with pytest.raises(ValueError, match="no ZIP file"):
        warc.Package(str(tmp_path / "b.zip"))


def test_broken_records():
    raw = warc.record_bytes("1", "u", b"abc", hashlib.sha1(b"abd").hexdigest(), None, "d")
    with pytest.raises(ValueError, match="differs"):
        warc.parsed_record(raw)
    with pytest.raises(zlib.error):
        warc.parsed_record(raw[:30])


# 6: toxicity


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op6_toxicity(spark, sf).toPandas().set_index("doc_id")
    labels = table(spark, sf, "labels").set_index("doc_id").toxic
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in got.held_out.items())
    assert got.score.between(0, 1).all()
    assert ((got.score >= 0.7) == (got.predicted == 1)).all()
    test = got[got.held_out].join(labels, how="inner").dropna(subset=["toxic"])
    caught = test[test.toxic == 1].predicted.mean()
    wrong = test[test.toxic == 0].predicted.mean()
    assert caught >= 0.75  # a part of the labels is noise: some toxic ones have no toxic word
    assert wrong <= 0.05


def test_block_max_search_is_exact():
    rng = np.random.default_rng(3)
    vectors = []
    for i in range(900):
        at = i % 4 * 100 + np.sort(rng.choice(100, 12, replace=False, p=(q := 1 / np.arange(1, 101)) / q.sum()))
        w = rng.random(12)
        vectors.append((at, w / np.linalg.norm(w)))
    vectors.append((np.zeros(0, np.int64), np.zeros(0)))
    index, dense = toxicity.BlockMaxIndex(vectors, 400), np.zeros((901, 400))
    for row, (at, w) in zip(dense, vectors, strict=True):
        row[at] = w
    got = index.cosines(vectors[:60], 10)
    assert (got == 0).mean() > 0.1  # blocks were passed over
    for i, scores in enumerate(got):
        assert np.sort(scores)[::-1][:10] == pytest.approx(np.sort(dense @ dense[i])[::-1][:10])
        seen = scores > 0
        assert scores[seen] == pytest.approx((dense @ dense[i])[index.order][seen])
    own = index.cosines(vectors[:60], 10, without=np.arange(60))
    assert all(own[i, index.order == i] == 0 for i in range(60))


def toxicity_by_brute_force(docs: dict[int, str | None], labels: dict[int, int], k: int, relevance: bool) -> dict[int, tuple[float, list[str]]]:
    """All cosines with dense loops; ids of at least 1."""

    def terms(text):
        out = collections.Counter()
        for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(common.UPPER, common.LOWER))):
            raw = w.encode()
            out[raw, 0] += 1
            if len(raw) > 6:
                out[raw[:6].decode(errors="ignore").encode(), 6] += 1
        return out

    tf = {i: terms(t) for i, t in docs.items()}
    known = sorted((i for i in labels if zlib.crc32(str(i).encode()) % 3 != 1), key=str)
    bad = sum(labels[i] for i in known)
    good, prior = len(known) - bad, bad / len(known)
    df, a, c = collections.Counter(), collections.Counter(), collections.Counter()
    for t in tf.values():
        df.update(set(t))
    for i in known:
        (a if labels[i] else c).update(set(tf[i]))
    weight = {t: (math.log((1 + len(docs)) / (1 + df[t])) + 1) * (math.log2(1 + ((a[t] + 5 * prior) / bad) / ((c[t] + 5 * (1 - prior)) / good)) if relevance else 1) for t in a | c}
    unseen = math.log((1 + len(docs)) / 2) + 1

    def vector(i):
        w = {t: (1 + math.log(n)) * weight.get(t, unseen) for t, n in tf[i].items() if t in weight or not t[1]}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items() if t in weight}

    vectors = {i: vector(i) for i in docs}

    def share(i, leave):
        cos = {j: round(min(1.0, sum(x * vectors[j].get(t, 0) for t, x in vectors[i].items())), 12) for j in known if not (leave and j == i)}
        cos = {j: x for j, x in cos.items() if x > 0}
        least = sorted(cos.values())[-min(k, len(cos))] if cos else 0
        near = {j: 1 / (1.05 - x) for j, x in cos.items() if x >= least}
        first = sorted(near, key=lambda j: (-cos[j], str(j)))[:5]
        return (sum(w * labels[j] for j, w in near.items()) + prior) / (sum(near.values()) + 1), [str(j) for j in first]

    def logit(p):
        p = min(max(p, 1e-3), 1 - 1e-3)
        return math.log(p / (1 - p))

    x, y = np.array([logit(share(i, True)[0]) for i in known]), np.array([labels[i] for i in known], float)
    slope, shift = 1.0, 0.0
    for _ in range(200):  # the penalised likelihood, by plain Newton steps
        p = 1 / (1 + np.exp(-(slope * x + shift)))
        g = np.array([((y - p) * x).sum() + 1 - slope, (y - p).sum()])
        r = p * (1 - p)
        d = np.linalg.solve([[(r * x * x).sum() + 1, (r * x).sum()], [(r * x).sum(), r.sum() + 1e-3]], g)
        slope, shift = slope + d[0], shift + d[1]
    out = {}
    for i in docs:
        s, near = share(i, False)
        out[i] = 1 / (1 + math.exp(-(slope * logit(s) + shift))), near
    return out


@pytest.mark.parametrize("relevance", [True, False])
def test_toxicity_equals_brute_force(spark, relevance):
    sf = "/root/testdata/sf0.001"
    docs = {i: t for i, t in table(spark, sf, "documents")[["doc_id", "text"]].itertuples(index=False) if i is not None}
    docs |= {10**6: None, 10**6 + 1: "", 10**6 + 2: "qqzz 123"}
    rated = table(spark, sf, "labels").dropna(subset=["toxic"])
    labels = {int(i): int(t) for i, t in zip(rated.doc_id, rated.toxic, strict=True) if i in docs}
    given = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = toxicity.score_toxicity(given, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"), neighbours=5, relevance=relevance).collect()
    want = toxicity_by_brute_force(docs, labels, 5, relevance)
    assert len(got) == len(docs)
    for r in got:
        assert r.score == pytest.approx(want[r.doc_id][0], abs=1e-6)
        assert r.evidence == want[r.doc_id][1]


def test_toxicity_of_a_very_long_text(spark):
    insults, clean = "vile rotten nasty", "lake river stone tree"
    rows = [(i, f"{insults if i % 4 == 0 else clean} w{i} {clean if i % 8 else ''}") for i in range(200)] + [(1000, f"{clean} " * 300_000), (1001, f"{insults} " * 300_000)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    assert got[1000] < 0.3 and got[1001] > 0.7


def test_one_long_example_drops_no_other(spark):
    rows = [(i, "vile rotten nasty words" if i % 2 else "lake river stone tree") for i in range(40)]
    docs = spark.createDataFrame([(i, t + " filler" * 2000 if i == 0 or i == 1 else t) for i, t in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels, max_bytes=4000).collect()}
    assert all((s > 0.7) == (i % 2 == 1) for i, s in got.items() if i > 1)
    assert toxicity.fitting([("a", 5), ("b", 99), ("c", 4), ("d", 2)], 10) == ["a", "c"]


def test_words_that_no_example_has_weigh(spark):
    rows = [(i, f"vile rotten nasty w{i}" if i % 2 else f"lake river stone w{i}") for i in range(60)]
    rows += [(100, "vile"), (101, "vile " + " ".join(f"new{i}" for i in range(10_000)))]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels, neighbours=3).collect()}
    assert got[101].score < got[100].score


def test_words_of_a_batch_are_counted_at_once():
    vocabulary = np.unique(np.array([h for w in (b"vile", b"rottenness") for h in toxicity.term_hashes(w)], np.uint64))
    known = toxicity.Numbered(vocabulary)
    texts = pa.array(["vile VILE new new rottenly", None, "", "rottenness rotten"])
    n, doc, term, weight = toxicity.asked(texts, known, np.array([1.0, 2.0, 3.0]), 5.0)
    place = {h: i for i, h in enumerate(vocabulary.tolist())}
    vile, (whole, stem) = place[toxicity.term_hashes(b"vile")[0]], (place[h] for h in toxicity.term_hashes(b"rottenness"))
    log2 = 1 + math.log(2)
    first = np.linalg.norm([log2 * (vile + 1), stem + 1, log2 * 5, 5])
    last = np.linalg.norm([whole + 1, stem + 1, 5])
    want = {(0, vile): log2 * (vile + 1) / first, (0, stem): (stem + 1) / first, (3, whole): (whole + 1) / last, (3, stem): (stem + 1) / last}
    assert n == 4 and {k: w for *k, w in zip(doc.tolist(), term.tolist(), weight.tolist(), strict=True) for k in [tuple(k)]} == pytest.approx(want)


def test_examples_vote_on_themselves_in_tasks(spark, monkeypatch):
    """The driver builds no index: it would hold all that a task's search needs."""

    driver, make = os.getpid(), toxicity.BlockMaxIndex.__init__

    def made(self, *given):
        assert os.getpid() != driver
        make(self, *given)

    docs = spark.createDataFrame([(i, f"vile rotten nasty w{i}" if i % 2 else f"lake river stone w{i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    want = sorted((r.doc_id, r.score) for r in toxicity.score_toxicity(docs, labels).collect())
    monkeypatch.setattr(toxicity.BlockMaxIndex, "__init__", made)
    assert sorted((r.doc_id, r.score) for r in toxicity.score_toxicity(docs, labels).collect()) == want


def test_stems_end_with_a_letter():
    assert toxicity.stem_of("überéal".encode(), 6) == "über".encode()
    assert toxicity.stem_of("abcdéf".encode(), 6) == "abcdé".encode()
    assert toxicity.stem_of("abcdeéf".encode(), 6) == b"abcde"


def test_toxicity_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x y"), (1, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score_toxicity(docs, none).collect()] == [0.0] * 4
    assert toxicity.score_toxicity(docs.limit(0), none).count() == 0
    whole = docs.selectExpr("*", "1 as held_out", "2 as row", "3 as score")
    assert toxicity.score_toxicity(whole, none, whole=True).columns == [*whole.columns, "__score"]


# 7: benchmark leaks


def hits(docs, items, n=10):
    windows = {}
    for i, t in items:
        w = words(t)
        for a in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[a : a + n]), set()).add(i)
    out = []
    for t in docs:
        w, inside, found = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for a in range(len(w) - size + 1):
                if tuple(w[a : a + size]) in windows:
                    inside |= set(range(a, a + size))
                    found |= windows[tuple(w[a : a + size])]
        out.append((len(w), len(inside), sorted(map(str, found))))
    return out


@pytest.mark.parametrize("shard,most", [(3 << 20, 2_000_000), (4000, 2_000_000), (3 << 20, 300)])
def test_leaks_by_brute_force(spark, sf_dir, shard, most):
    docs, bench = table(spark, sf_dir, "documents").sort_values("doc_id"), table(spark, sf_dir, "benchmark")
    items = [*zip(bench.item_id, bench.text, strict=True), (900, "der"), (901, ""), (902, None)]
    extra = spark.createDataFrame([(a, b) for a, b in items], "item_id long, text string")
    read = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = decontam.find_leaks(read, extra, shard_bytes=shard, max_words=most).orderBy("doc_id").collect()
    assert [(r["__words"], r["__hit"], r["__items"]) for r in got] == hits(docs.text, items)
    for r in got:
        assert (r["__clean"] is None) == (r["__hit"] == 0)


def test_leaks_in_a_text_of_more_words_than_an_index_holds(spark):
    n, passage = fmindex.MOST_SYMBOLS, "p0 p1 p2 p3 p4 p5 p6 p7 p8 p9 p10 p11"
    long = " ".join(["w"] * (n - 6) + passage.split() + ["w"] * 60_000 + passage.split())
    docs = spark.createDataFrame([(1, "a b"), (2, long), (3, passage)], "doc_id long, text string").repartition(1)
    items = spark.createDataFrame([(7, passage)], "item_id long, text string")
    got = decontam.find_leaks(docs, items, clean=False).orderBy("doc_id").collect()
    assert [(r["__words"], r["__hit"], r["__items"]) for r in got] == [(2, 0, []), (n + 60_018, 24, ["7"]), (12, 12, ["7"])]
    assert [tuple(x) for x in got[1]["__spans"]] == [(n - 6, n + 6), (n + 60_006, n + 60_018)]


@pytest.mark.parametrize("most", [8, 9, 13, 40, 1000])
def test_pieces_have_the_leaks_of_the_whole(most):
    rng = np.random.default_rng(most)
    texts = [" ".join(rng.choice(list("abc"), n)).encode() for n in (0, 1, 3, 4, 30, 200, 7, 90)] + [None, b"", b" a, b;"]
    p = decontam.phrases_of(((str(i), " ".join(rng.choice(list("abc"), int(rng.integers(1, 9))))) for i in range(12)), 4)
    assert decontam.leaks_bounded(texts, p, most) == decontam.leaks_in(texts, p)
    assert decontam.leaks_bounded([], p, most) == ([], [], [])


def test_leaks_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "A b  c", 5), (3, "A b  c", 5)], "doc_id long, text string, __x int")
    items = spark.createDataFrame([(1, "b C")], "item_id long, text string")
    got = decontam.find_leaks(docs, items).orderBy("doc_id").collect()
    assert [(r["__words"], r["__hit"], r["__clean"]) for r in got] == [(0, 0, None), (0, 0, None), (3, 2, "A  "), (3, 2, "A  ")]
    assert [r["__hit"] for r in decontam.find_leaks(docs, items.limit(0)).collect()] == [0] * 4
    assert decontam.find_leaks(docs.limit(0), items).count() == 0


def test_index_counts_and_places():
    text = np.random.default_rng(1).integers(1, 5, 500)
    index = fmindex.FMIndex(text, 5)
    for n in (1, 2, 4):
        for at in range(0, 60, 7):
            p = text[at : at + n]
            lo, hi = index.search(p[None, :])
            found = sorted(index.locate(np.arange(lo[0], hi[0])).tolist())
            assert found == [i for i in range(len(text) - n + 1) if (text[i : i + n] == p).all()]


# 8: chat text


def test_chats_read_back(spark):
    rows = [(1, 0, "system", "be \\ brief"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "<</SYS>>\\</s>"), (2, 0, "assistant", None), (2, 0, "assistant", None), (3, 1, "tool<<TEXT>>", "x<<ROLE>>\n"), (None, None, None, "t"), (4, 0, "user", "a"), (4, 1, "user", "b")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.format_chats(t).select("*", chat.parsed_turns(F.col("formatted")).alias("read"), chat.learnt_text(F.col("segments")).alias("learnt")).collect()}
    for c, r in out.items():
        want = sorted(((x[1] is not None, x[1] or 0, x[2] or "", x[3] or "") for x in rows if x[0] == c))
        assert [(x.role, x.text) for x in r["read"]] == [x[2:] for x in want]
        assert r.learnt == "".join(x[3] for x in want if x[2] == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted
    assert [out[c].valid for c in (1, 2, 3, 4)] == [True, False, False, False]
    assert out[4].first_bad == 1


def test_chats_of_the_tables(spark, sf_dir):
    got = {r.conv_id: r for r in queries.op8_chat_format(spark, sf_dir).collect()}
    convs = table(spark, sf_dir, "conversations")
    assert set(got) == {*convs.conv_id, -7}
    assert got[-7].loss_chars == len("</s>[INST] ok [/INST]")
    for c, g in convs.groupby("conv_id"):
        g = g.assign(role=g.role.fillna(""), text=g.text.fillna("")).sort_values(["turn", "role", "text"])
        learnt = "".join(g.text[g.role == "assistant"])
        assert got[c].n_turns == len(g)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in zip(g.role, g.text, strict=True)).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


# 9: languages


def test_languages_on_held_out_documents(spark, sf_dir):
    got = queries.op9_language_id(spark, sf_dir).toPandas().set_index("doc_id")
    docs = table(spark, sf_dir, "documents").set_index("doc_id")
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in got.held_out.items())
    assert got.score.between(0, 1).all()
    test = got[got.held_out].join(docs)
    test = test[test.lang.notna() & test.text.fillna("").str.contains(r"[^\W\d_]")]
    assert (test.lang_pred == test.lang).mean() >= 0.9


def test_languages_equal_brute_force(spark, sf_dir):
    """All n-grams in dictionaries, cosines with dense vectors; only the clustering is shared."""

    def grams(text):
        kept = "".join(c.translate(ASCII) if (c.isascii() and c.isalpha()) or not c.isascii() else " " for c in text)
        raw = (" " + " ".join(kept.split(" ")).strip() + " ").encode()
        raw = re.sub(rb" +", b" ", raw)
        return collections.Counter(raw[i : i + 3] for i in range(len(raw) - 2)) if raw.strip() else collections.Counter()

    docs = table(spark, sf_dir, "documents")
    letters = docs.text.fillna("").str.contains(r"[^\W\d_]")
    train = docs[docs.lang.notna() & letters & np.array([zlib.crc32(str(i).encode()) % 5 != 0 for i in docs.doc_id])].copy()
    train["draw"] = [r.d for r in spark.createDataFrame([(int(i),) for i in train.doc_id], "i long").select(F.xxhash64("i").alias("d")).collect()]
    train = train.sort_values(["lang", "draw"])
    counts = [grams(t) for t in train.text]
    df = collections.Counter(g for c in counts for g in c)
    order = sorted(df)
    idf = {g: math.log((1 + len(train)) / (1 + n)) + 1 for g, n in df.items()}
    place = {g: i for i, g in enumerate(order)}

    def unit(c):
        x = np.zeros(len(order))
        for g, n in c.items():
            if g in place:
                x[place[g]] = (1 + math.log(n)) * idf[g]
        rest = sum(((1 + math.log(n)) * (math.log(1 + len(train)) + 1)) ** 2 for g, n in c.items() if g not in place)
        return x / max(1e-12, math.sqrt((x * x).sum() + rest))

    x = np.array([unit(c) for c in counts], np.float32)
    names = sorted(set(train.lang))
    cents = {n: langid.clustered(x[(train.lang == n).to_numpy()], 4, 42) for n in names}
    got = langid.identify_languages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")).toPandas().set_index("doc_id")
    for d in docs[letters].itertuples():
        best = {n: float((cents[n] @ unit(grams(d.text))).max()) for n in names}
        assert got.score[d.doc_id] == pytest.approx(min(1.0, max(best.values())), abs=1e-4)
        assert best[got.lang_pred[d.doc_id]] >= max(best.values()) - 1e-4


def test_ngrams_of_pieces_equal_those_of_the_whole(monkeypatch):
    text = ("wörter und 漢字 mixed " * 700).encode()
    whole = langid.ngram_counts(text)
    monkeypatch.setattr(langid, "PIECE", 100)
    assert all((a == b).all() for a, b in zip(whole, langid.ngram_counts(text), strict=True))
    assert int(whole[1].sum()) == len(b" " + text.strip() + b" ") - 2


def test_languages_of_clashing_names_and_long_texts(spark):
    rows = [(i, "der die das und nicht " if i % 2 else "the and of with that ", "de" if i % 2 else "en") for i in range(40)]
    rows.append((99, "die das und nicht " * 200_000, None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as draw", "2 as place", "3 as p", "4 as held_out", "'x' as score")
    got = {r.doc_id: r.lang_pred for r in langid.identify_languages(docs).collect()}
    assert got[99] == "de" and got[2] == "en" and len(got) == 41


def test_languages_of_odd_texts(spark):
    rows = [(i, "der die das und nicht " * 3 if i % 2 else "the and of with that " * 3, "de" if i % 2 else "en") for i in range(40)]
    rows += [(100, None, "de"), (101, "", None), (102, "12 34 !?", "en"), (None, "the of and", None), (103, "die das und " * 5000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify_languages(docs).collect()}
    assert (got[100], got[101], got[102], got[None], got[103]) == ("und", "und", "und", "en", "de")
    assert {r.lang_pred for r in langid.identify_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify_languages(docs.limit(0)).count() == 0


# 10: lines


def test_lines_by_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").sort_values("doc_id")
    held = {}
    key = lambda x: x.strip("\x20\t\n\x0b\x0c\r").translate(ASCII)
    for d in docs.itertuples():
        for line in (d.text or "").split("\n"):
            held.setdefault(key(line), set()).add(d.doc_id)
    got = {r.doc_id: r for r in queries.op10_line_dedup(spark, sf_dir).collect()}
    for d in docs.itertuples():
        lines = (d.text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(held[key(x)]) < 2 or min(held[key(x)]) == d.doc_id]
        r = got[d.doc_id]
        assert (r.n_lines, r.n_dropped, r.kept_sha256) == (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())


@pytest.mark.parametrize("most", [2, 3])
def test_lines_of_odd_tables(spark, most):
    rows = [(1, "a long line here\nx"), (1, "a long line here\nx"), (2, " A LONG line here\t\ny"), (None, "a long line here"), (3, None), (4, ""), (5, "a long line here\r\na long line here")]
    docs = spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id long, text string, id int, row int")
    got = sorted((r.doc_id or 99, r["__lines"], r["__dropped"], r["__kept"]) for r in linededup.dedup_lines(docs, min_docs=most).collect())
    assert got == [(1, 2, 0, "a long line here\nx"), (1, 2, 0, "a long line here\nx"), (2, 2, 1, "y"), (3, 1, 0, ""), (4, 1, 0, ""), (5, 2, 2, ""), (99, 1, 1, "")]
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


# what they share


def test_empty_documents_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert license_scan.scan_licenses(empty).count() == 0
    assert mixing.mix(empty, [3, 1, 2]).count() == 0
    assert simhash.near_copies(empty).count() == 0
    assert simhash.near_copies(empty, 6, 2).count() == 0
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_clashing_columns(spark):
    rows = [(1, "under the mit license", 1, 2, "a", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __words int, __hit int, id string, row int")
    items = spark.createDataFrame([(1, "mit license")], "item_id long, text string")
    assert license_scan.scan_licenses(docs).first()["__words"] == 4
    assert linededup.dedup_lines(docs).columns == ["doc_id", "text", "id", "row", "__lines", "__dropped", "__kept"]
    assert decontam.find_leaks(docs, items).first()["__hit"] == 2
    assert mixing.mix(docs.withColumn("source", docs.text), [1]).first()["size"] == 4
    assert simhash.near_copies(docs).first().component_id == 1


def test_null_and_repeated_documents(spark):
    rows = [(1, "a b c d", "en", "s", 7)] * 3 + [(None, None, None, None, None), (2, "", None, None, 0), (None, "a b c d", None, None, 7)]
    docs = spark.createDataFrame(rows, DOCS)
    m = mixing.mix(docs, [3, 1, 2]).collect()
    assert len(m) == 6
    assert all(r.taken <= 2 * r["size"] for r in m)
    groups = sorted((r.doc_id or 0, r.component_id) for r in simhash.near_copies(docs).collect())
    assert groups == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 1), (2, 2)]


def test_whole_long_texts_count(spark):
    text = "word " * 400_000 + "under the mit license"
    docs = spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string")
    r = license_scan.scan_licenses(docs).where("doc_id = 1").first()
    assert (r["__words"], r["__first"]) == (400_004, 400_000)
    items = spark.createDataFrame([(1, "under the mit license")], "item_id long, text string")
    assert decontam.find_leaks(docs, items).where("doc_id = 1").first()["__hit"] == 4


def test_scratch_is_the_shared_folder(spark):
    def qualified(path):
        found = spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(found).toString()

    assert qualified(common.scratch_path(spark, "x")).startswith(qualified(spark.conf.get("spark.checkpoint.dir")))
    assert io  # the folder is read by URI, never by a local path
