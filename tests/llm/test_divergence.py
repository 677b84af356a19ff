"""The audit of sources against arithmetic with whole numbers of any length."""

import re
from collections import Counter
from fractions import Fraction
from math import floor

import numpy as np
import pytest

from pointquarry.llm import divergence, queries

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least=3, top=200):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(ASCII))) for text, lang, source in docs]
    rows = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df, total = Counter(t for d in mine for t in set(d[2])), Counter(t for d in mine for t in d[2])
        kept = [t for t in df if df[t] >= least]
        counts = {s: Counter(t for d in mine if d[1] == s for t in d[2]) for s in {d[1] for d in mine}}

        def share(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + floor(Fraction(10**9 * (c[t] + 1), n + len(kept))) for t in kept}

        p, q = {s: share(c) for s, c in counts.items()}, share(total)
        for s in counts:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in counts if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
                rows += [(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(rows)


def test_query_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source").collect()
    assert sorted(map(tuple, queries.op12_source_divergence(spark, sf_dir).collect())) == brute([tuple(d) for d in docs])


@pytest.mark.parametrize("terms,sources", [(4096, 256), (2, 2), (3, 1)])
def test_tiles_of_any_size_give_the_same(spark, monkeypatch, terms, sources):
    monkeypatch.setattr(divergence, "TERMS", terms)
    monkeypatch.setattr(divergence, "SOURCES", sources)
    monkeypatch.setattr(divergence, "HELD", 4)
    rows = [(f"Ab c{'d' * (i % 5)} é{'x' * (i % 3)} ZZ zz 12 a_b", ["en", "", None, "de"][i % 4], [None, "", "s1", "s2", "s3"][i % 5]) for i in range(60)]
    rows += [("word " * 50_000, "en", "s1"), (None, "xx", "a"), ("", "xx", "b"), ("once", "xx", None), ("lone lone", "yy", "z")] + [("same same", "en", "s2")] * 5
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, source string, term string, n int")
    got = sorted(map(tuple, divergence.audit_sources(docs).collect()))
    assert got == brute(rows)
    assert [r for r in got if r[0] == "xx" and r[2] == "pair" and r[4] != 0] == []


def test_empty_table_and_many_equal_values(spark):
    kind = "text string, lang string, source string"
    assert divergence.audit_sources(spark.createDataFrame([], kind)).collect() == []
    rows = [(" ".join(f"t{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)), "l", "a")] * 3 + [("other words here", "l", "b")] * 3
    got = sorted(map(tuple, divergence.audit_sources(spark.createDataFrame(rows, kind)).collect()))
    assert got == brute(rows)
    assert max(r[5] for r in got) == 200


def test_shares_of_large_counts_are_exact():
    counts = np.array([0, 5, 10**12, 8 * 10**15], np.int64)
    total = 9 * 10**15
    assert divergence.shares(counts, total, 7).tolist() == [1 + 10**9 * (int(c) + 1) // (total + 7) for c in counts]
