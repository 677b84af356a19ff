"""Aligned tokens against whole encodings, token by token."""

import hashlib
from bisect import bisect_right
from collections import Counter

import pytest

from pointquarry.llm import alignment, queries, tokens

from test_records import made_texts

A, B = tokens.default_path("byte_bpe_50k.json"), tokens.default_path("piece_bpe_32k.model")


def brute(docs):
    """Rows of (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), by the texts' whole encodings."""
    first, second, links = tokens.byte_level_bytes(A), tokens.piece_bytes(B), []
    found = []
    for doc_id, text in docs:
        whole = f" {text or ''}"
        a, b = tokens.byte_level(A).encode(whole, add_special_tokens=False).ids, tokens.pieces(B).encode(text or "")
        if not text or b"".join(first[i] for i in a) != whole.encode() or b"".join(second[i] for i in b) != whole.encode():
            a = b = []
        ends = []
        for ids, size in ((a, first), (b, second)):
            at, places = 0, []
            for i in ids:
                at += len(size[i])
                places.append(at)
            ends.append(places)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, own, before = [], [], 0
        for cut in cuts:
            sides = [ids[bisect_right(places, before) : bisect_right(places, cut)] for ids, places in zip((a, b), ends, strict=True)]
            groups.append("|".join(",".join(map(str, s)) for s in sides))
            own += [(x, y) for x, e in zip(a, ends[0], strict=True) if e == cut for y, f in zip(b, ends[1], strict=True) if f == cut] if len(a) < 400 else [(sides[0][-1], sides[1][-1])]
            before = cut
        links.append(own)
        found.append((doc_id, len(a), len(b), len(groups), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    count = Counter(x for own in links for x in own)
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    return sorted((*f[:5], sum(count[x] == best[x[1]] for x in own), sum(count[x] for x in own), f[5]) for f, own in zip(found, links, strict=True))


def rows(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


def test_query_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("length(text) < 4000").collect()
    kept = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(alignment.align_tokens(kept)) == brute([tuple(d) for d in docs])
    assert queries.op11_token_alignment(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


@pytest.mark.parametrize("frequent", [1 << 17, 40, 0])
def test_frequent_and_rare_groups_alike(spark, frequent):
    texts = [*made_texts(80, 5), None, "", " ", "\n", "▁", "a ▁ b", "the the the", "the the the", "x" * 3000, "word " * 1_500, "<s></s><unk><|endoftext|>"]
    docs = [(i // 2, t) for i, t in enumerate(texts)]
    given = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, row int, key string")
    assert rows(alignment.align_tokens(given, frequent=frequent)) == brute(docs)


def test_empty_table(spark):
    assert alignment.align_tokens(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_two_groups_of_one_hash_raise(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    real = alignment.encode
    monkeypatch.setattr(alignment, "encode", lambda *a: real(*a).withColumn("key", alignment.F.when(alignment.F.col("key").isNotNull(), alignment.F.lit(7).cast("long"))))
    with pytest.raises(ValueError, match="another seed"):
        alignment.align_tokens(docs)


def test_vocabularies_are_checked():
    assert tokens.checked_pieces(B) == B
    assert all(tokens.byte_level_bytes(A))
    assert all(tokens.piece_bytes(B))
