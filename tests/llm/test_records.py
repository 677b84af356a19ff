"""Token records against whole encodings, a plain checksum and broken files."""

import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pointquarry.llm import common, queries, records, tokens

SIGNS = list(" \n\t\r　▁\xa0 'sdtrelvmaZé,.!09́ \x00\x1c\x85​<|>中×ß") + ["<|endoftext|>", "<s>", "  ", "\n\n", " '", "'s", " the", "\U0001f600"]


def whole(texts):
    found = tokens.byte_level(tokens.default_path("byte_bpe_50k.json")).encode_batch(texts, add_special_tokens=False)
    return [e.ids for e in found]


def made_texts(n, seed):
    draw = random.Random(seed)
    return ["".join(draw.choice(SIGNS) for _ in range(draw.randint(0, 60))) for _ in range(n)]


def plain_checksum(data):
    c = 0xFFFFFFFF
    for x in data:
        c ^= x
        for _ in range(8):
            c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
    c ^= 0xFFFFFFFF
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def test_words_give_the_ids_of_whole_texts(sf_dir):
    import duckdb

    texts = [*made_texts(4000, 3), *(r[0] or "" for r in duckdb.sql(f"SELECT text FROM '{sf_dir}/documents.parquet'").fetchall())]
    path = tokens.default_path("byte_bpe_50k.json")
    assert tokens.packed_ids(pa.array(texts), path, 2) == [np.array(x, "<u2").tobytes() for x in whole(texts)]
    assert tokens.packed_ids(pa.array(texts[:50]), path, 4) == [np.array(x, "<u4").tobytes() for x in whole(texts[:50])]


def test_words_are_forgotten_and_learnt_again(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 20)
    monkeypatch.setattr(tokens, "LONGEST", 4)
    asked = []
    known = tokens.Remembered(lambda words: asked.extend(words) or {"upper": pa.array([w.upper() for w in words], pa.string())})
    for i in range(50):
        words = [f"w{j}" for j in range(i, i + 15)] + ["w" * 9]
        assert known.of(pa.array(words)).column("upper").to_pylist() == [w.upper() for w in words]
        assert known.table.num_rows <= 20
    assert 64 <= len(asked) - asked.count("w" * 9) < 300


@pytest.mark.parametrize("size", [4, 7, 8, 511, 512, 513, 1500])
def test_checksums(size):
    parts = [random.Random(size + i).randbytes(size + i) for i in range(4)] + [bytes(size)]
    assert records.checksums(parts).tolist() == [plain_checksum(p) for p in parts]
    assert plain_checksum(b"123456789") == (((0xE3069283 >> 15) | (0xE3069283 << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def test_query_by_brute_force(spark, sf_dir):
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    want, start = [], 0
    for d, ids in zip(docs, whole([r.text or "" for r in docs]), strict=True):
        ids.append(0)
        want.append((d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, queries.op13_token_records(spark, sf_dir).collect())) == want


def test_odd_rows(spark):
    long = "very long text, " * 200_000
    rows = [(3, "b"), (None, "no id"), (1, None), (1, ""), (2, long), (3, "b"), (3, "a"), (-5, "<|endoftext|>")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_tokens int, path string")
    got = records.round_trip(docs, file_bytes=64, ids=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, -5, 1, 1, 2, 3, 3, 3]
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)]).tolist()[:-1]
    own = {i: [r.ids for r in got if r.doc_id == i] for i in (None, -5, 1, 2)}
    assert own == {None: [whole(["no id"])[0] + [0]], -5: [whole(["<|endoftext|>"])[0] + [0]], 1: [[0], [0]], 2: [whole([long])[0] + [0]]}
    assert sorted(r.ids for r in got if r.doc_id == 3) == sorted(x + [0] for x in whole(["a", "b", "b"]))
    assert records.round_trip(docs.limit(0)).collect() == []


def test_a_shuffled_epoch_reads_the_same_records(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    listed = records.list_tokens(records.write_tokens(docs, common.scratch_path(spark, "epoch"), file_bytes=1 << 16))
    dealt = [records.read_tokens(listed.orderBy(F.xxhash64("path", "offset", F.lit(seed))), ids=False).collect() for seed in (1, 1, 2)]
    assert dealt[0] == dealt[1] != dealt[2]
    assert sorted(dealt[0]) == sorted(dealt[2])


def test_broken_records_raise():
    payload = struct.pack(records.HEAD, 2, True, 9) + b"\1\0\2\0"
    [raw] = records.framed([payload])
    assert bytes(records.unframed(raw, [0], [len(raw)], "f")[0]) == payload
    for at in (0, 9, 20, len(raw) - 1):
        bad = bytearray(raw)
        bad[at] ^= 4
        with pytest.raises(ValueError, match="record of f"):
            records.unframed(bytes(bad), [0], [len(raw)], "f")
