"""The pipeline's stages on a small corpus and on the shared one."""

import pytest

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def small(spark, sf_dir, tmp_path_factory):
    bench, other = (r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").take(2))
    base = " ".join(f"word{i} tail{i % 7}" for i in range(120))
    near = base.replace("word30 ", "other ")
    rows = [(1, base, "en", "a", None), (2, base, "en", "b", None), (3, near, "en", "a", None), (4, f"before {bench} after", "en", None, None), (5, other, "en", "b", None), (6, "common line here\nown words six", "en", "a", None), (7, "common line here\nown words seven", "en", "a", None), (8, None, None, None, None), (None, "no id but some words of its own", None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def test_each_stage_takes_effect(spark, small, sf_dir):
    stages = dict(corpus_pipeline.STAGES)
    lines = {r.doc_id: r.text for r in stages["line_dedup"](spark, small, sf_dir).collect()}
    assert (lines[6], lines[7]) == ("common line here\nown words six", "own words seven")
    near = sorted(r.doc_id or 0 for r in stages["near_dedup"](spark, small, sf_dir).collect())
    assert near == [0, 1, 4, 5, 6, 7, 8]
    clean = {r.doc_id: r for r in stages["decontamination"](spark, small, sf_dir).collect()}
    assert 5 not in clean
    assert [w for w in clean[4].text.split() if w.isalnum()] == ["before", "after"]
    assert clean[4].n_chars == len(clean[4].text)
    mixed = stages["mixing"](spark, small, sf_dir).collect()
    assert all(0 < r.taken <= 2 * r["size"] for r in mixed)
    for name in list(stages)[:4]:
        assert stages[name](spark, small, sf_dir).columns == small.columns
        assert stages[name](spark, small.limit(0), sf_dir).count() == 0
        clashing = small.selectExpr("*", "'x' as __hash", "doc_id as id", "1 as row", "2 as fp", "text as taken_")
        assert stages[name](spark, clashing, sf_dir).columns == [*small.columns, "id", "row", "fp", "taken_"]
    clashing = small.selectExpr("*", "1 as size", "2 as taken")
    assert stages["mixing"](spark, clashing, sf_dir).columns == [*small.columns, "size", "source_size", "target", "taken"]


def test_run_keeps_clean_documents(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert out.doc_id.is_unique
    assert set(out.columns) == {"doc_id", "text", "lang", "source", "n_chars", "size", "source_size", "target", "taken"}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert 0.5 * docs < len(out) <= docs
