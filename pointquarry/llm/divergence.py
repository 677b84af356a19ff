"""Audit of sources: how far the words of each are from those of the others and of the language."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointquarry.llm.common import staged
from pointquarry.llm.langid import LETTER_BYTES

#: Shares are parts of so many, in steps of a thousand.
SCALE, STEPS = 1_000_000_000, 3
#: Terms and groups of a tile, and terms of all groups that a task counts before it hands them on.
TERMS, SOURCES, HELD = 4096, 256, 1 << 18


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): how often a term stands in a group and in how many of its documents, summed in
    tasks and then by group and term. Each group has a row without a term, too."""

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def handed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in groups.items():
                terms, m = [None, *n], 1 + len(n)
                columns = [pa.array([lang], pa.string()).take(pa.array(np.zeros(m, np.int64))), pa.array([source], pa.string()).take(pa.array(np.zeros(m, np.int64)))]
                columns += [pa.array(terms, pa.binary()).cast(pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in n)], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
            groups.clear()

        for batch in batches:
            for text, lang, source in zip(batch.column("text"), batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True):
                n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
                terms = text.as_buffer().to_pybytes().translate(LETTER_BYTES).split()
                n.update(terms)
                docs.update(set(terms))
            if sum(len(n) for n, _ in groups.values()) > HELD:
                yield from handed_on()
        yield from handed_on()

    counted = docs.mapInArrow(of_task, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: np.ndarray | int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exactly: one thousand after another, so that no product
    leaves 64 bits while there are less than 9e15 words."""
    whole = np.asarray(total + terms, np.int64)
    found, rest = np.divmod(counts + 1, whole)
    for _ in range(STEPS):
        more, rest = np.divmod(rest * 1000, whole)
        found = found * 1000 + more
    return found + 1


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q)."""
    d = p - q
    return d * d // q


def tile(key: tuple, rows: pa.Table, top: int) -> pa.Table:
    """Partial results of one block of terms and one or two sets of groups: each ordered pair of groups with its sum over
    the block, and on the diagonal the ``top`` terms of each group."""
    lang, _, first, second = (k.as_py() for k in key)
    heads = rows.filter(rows.column("term").is_null()).sort_by("source")
    names, of_tile = heads.column("source").to_pylist(), heads.column("tile").to_numpy()
    own, terms, whole, block_terms = heads.column("n").to_numpy(), *(heads.column(c)[0].as_py() for c in ("terms", "total", "block_terms"))
    cells = rows.filter(rows.column("term").is_valid())
    coded = cells.column("term").combine_chunks().dictionary_encode()
    at, words = coded.indices.to_numpy(), coded.dictionary
    row = np.searchsorted(np.array(names, object), np.array(cells.column("source").to_pylist(), object))
    counts, totals = np.zeros((len(names), len(words)), np.int64), np.zeros(len(words), np.int64)
    counts[row, at], totals[at] = cells.column("n").to_numpy(), cells.column("total").to_numpy()
    p, absent = shares(counts, own[:, None], terms), shares(np.zeros(len(names), np.int64), own, max(1, terms))
    # Terms of the block that no group here has.
    others_only = block_terms - len(words)
    left, right = (np.flatnonzero(of_tile == t) for t in (first, second))
    source, item, value = [], [], []
    for a, b in [(left, right)] if first == second else [(left, right), (right, left)]:
        for g in a.tolist():
            others = b[b != g]
            source += [names[g]] * len(others)
            item += [names[o] for o in others.tolist()]
            value += (distances(p[g], p[others]).sum(axis=1) + others_only * distances(absent[g], absent[others])).tolist()
    part = ["pair"] * len(item)
    if first == second:
        q = shares(totals, whole, terms)
        texts = words.to_pylist()
        order = np.argsort(np.array([t.encode() for t in texts], object), kind="stable") if texts else np.zeros(0, np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        for g in range(len(names)):
            more = np.flatnonzero((counts[g] > 0) & (p[g] > q))
            f = distances(p[g][more], q[more])
            best = np.lexsort((place[more], -f))[:top]
            source += [names[g]] * len(best)
            item += [texts[i] for i in more[best].tolist()]
            value += f[best].tolist()
            part += ["term"] * len(best)
    return pa.table({"lang": pa.array([lang] * len(item), pa.string()), "source": pa.array(source, pa.string()), "part": pa.array(part, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})


def audit_sources(docs: DataFrame, least_docs: int = 3, top: int = 200, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """How each source of a language differs from its other sources and from the language as a whole.

    Terms are the words of letters and non-ASCII characters, A-Z lower-cased; a language keeps those that stand in
    ``least_docs`` of its documents or more. The share of a kept term in a group is smoothed by one:
    p = 1 + floor(10^9 * (count + 1) / (N + V)), with N the group's kept words and V the language's kept terms. Two shares differ by
    f = floor((p - q)^2 / q). Rows (lang, source, part, item, value, rank) are, for part ``pair``, every other source of the
    language with the sum of f over all kept terms, and for part ``term`` the ``top`` terms of larger share than in the whole language.
    Ranks go by value descending and then by item in the order of bytes.

    Kept terms are dealt in blocks of about ``TERMS`` and the sources of a language, where there are many, in sets of about ``SOURCES``. A
    task makes a dense matrix of a block's terms for one or two sets and compares all their pairs; partial sums of pairs are added, and the
    first terms of blocks ranked together. Memory is bounded by the tile, whatever the number of words. Counts are exact in 64 bits
    below 9e15 words.

    Null texts, languages and sources are empty strings. A group without kept terms has shares like any other; without any
    kept term in the language its pairs have the value 0. A lone source has no pairs. Texts of any length are read whole;
    repeated rows count each; an empty table gives no rows. Other columns are not read.
    """
    given = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])
    counts = staged(term_counts(given), "term-counts")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("lang", "term", "total")
    cells = staged(counts.where("term is not null").select("lang", "source", "term", "n").join(staged(kept, "kept-terms"), ["lang", "term"]), "kept-counts")
    of_source = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    of_lang = cells.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("total"))
    names = counts.where("term is null").select("lang", "source")
    langs = staged(
        names.groupBy("lang").agg(F.count("*").alias("sources")).join(of_lang, "lang", "left").select(
            "lang",
            F.coalesce("terms", F.lit(0)).cast("long").alias("terms"),
            F.coalesce("total", F.lit(0)).cast("long").alias("total"),
            F.greatest(F.lit(1), F.ceil(F.col("terms") / TERMS)).cast("int").alias("blocks"),
            F.ceil(F.col("sources") / SOURCES).cast("int").alias("tiles"),
        ),
        "audit-langs",
    )

    def set_of(source: Column, tiles: Column) -> Column:
        return F.pmod(F.xxhash64(source), tiles).cast("int")

    others = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    heads = names.join(of_source, ["lang", "source"], "left").join(langs, "lang").withColumns({"term": F.lit(None).cast("string"), "n": F.coalesce("n", F.lit(0)), "block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
    block = F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block")
    of_block = cells.select("lang", "term").distinct().join(langs, "lang").groupBy("lang", block).agg(F.count("*").alias("block_terms"))
    heads = heads.join(of_block, ["lang", "block"], "left").fillna(0, ["block_terms"])
    each = cells.join(langs.select("lang", "blocks", "tiles"), "lang").select("*", block, *[F.lit(0).cast("long").alias(c) for c in ("terms", "block_terms")])
    columns = ["lang", "block", "source", "term", "n", "total", "terms", "block_terms", "tiles"]
    both = heads.select(columns).unionByName(each.select(columns)).withColumn("tile", set_of(F.col("source"), F.col("tiles"))).select("*", others)
    both = both.withColumns({"first": F.least("tile", "other"), "second": F.greatest("tile", "other")}).select("lang", "block", "first", "second", "source", "term", "n", "total", "terms", "block_terms", "tile")
    parts = staged(both.groupBy("lang", "block", "first", "second").applyInArrow(lambda key, rows: tile(key, rows, top), "lang string, source string, part string, item string, value long"), "audit-tiles")
    by = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(by))
    terms = parts.where("part = 'term'").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return pairs.select("lang", "source", "part", "item", "value", "rank").unionByName(terms.select("lang", "source", "part", "item", "value", "rank"))
