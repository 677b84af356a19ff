"""Removing lines that repeat across documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointquarry.llm.common import BLANKS, LOWER, UPPER, plain, staged

#: The place of a null id in the order of ids: after all others.
LAST = 2**63 - 1


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop lines found in many documents, all but those of the first one.

    Lines are exploded, their keys hashed (96 bits and the length), documents
    counted for each hash, and the texts put together again from what stays. A key of
    at least ``min_chars`` code points in at least ``min_docs`` documents stays only
    in the document of the smallest id. Only ids, positions and hashes are shuffled
    for the counts, with partial counts before the shuffle; a hot line is an ordinary
    skewed join that adaptive execution splits. Texts are shuffled once.

    Returns the columns of ``docs`` and ``__lines`` (lines before dropping),
    ``__dropped`` and ``__kept`` (the text that stays).

    A null or empty text is one empty line. Rows of one id are one document; a row
    repeated in full is treated alike each time. Null ids are one document after all
    others. An empty table gives an empty table. Other columns pass through, but for those that
    begin with two underscores.
    """
    docs = plain(docs)
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    keyed = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"),
        F.xxhash64(F.col(text_col)).alias("row"),
        lines.alias("lines"),
    )
    places = keyed.select("id", "row", F.posexplode("lines").alias("pos", "line")).withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    hashed = places.select("id", "row", "pos", F.xxhash64("key").alias("h"), F.hash("key").alias("g"), F.char_length("key").alias("n"))
    of_key = ["h", "g", "n"]
    if min_docs <= 2:
        held = hashed.groupBy(*of_key).agg(F.min("id").alias("first"), F.max("id").alias("last"))
        repeated = held.where(F.col("first") < F.col("last")) if min_docs == 2 else held
    else:
        pairs = hashed.select(*of_key, "id").distinct()
        repeated = pairs.groupBy(*of_key).agg(F.min("id").alias("first"), F.count("*").alias("docs")).where(F.col("docs") >= min_docs)
    # Written first, both sides of the join are plain shuffles, of which adaptive execution splits the hot ones.
    repeated = staged(repeated.select(*of_key, "first"), "repeated-lines")
    gone = hashed.join(repeated, of_key).where(F.col("id") > F.col("first"))
    gone = gone.groupBy("id", "row").agg(F.array_sort(F.collect_set("pos")).alias("__gone"))
    joined = docs.withColumns({"__id": F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), "__row": F.xxhash64(F.col(text_col))}).join(
        gone.withColumnsRenamed({"id": "__id", "row": "__row"}), ["__id", "__row"], "left"
    )
    # The mask is true at each dropped position; it is built in one pass over the sorted positions.
    before = F.concat(F.array(F.lit(-1)), F.col("__gone"))
    steps = F.zip_with(F.col("__gone"), before, lambda at, prev: F.when(at.isNotNull(), F.concat(F.array_repeat(F.lit(False), at - prev - 1), F.array(F.lit(True)))))
    mask = F.flatten(F.filter(steps, lambda x: x.isNotNull()))
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = joined.withColumns({"__mask": mask, "__parts": F.split(text, "\n", -1)})
    kept = F.array_join(F.filter("__parts", lambda x, i: ~F.coalesce(F.get(F.col("__mask"), i), F.lit(False))), "\n")
    return out.select(
        *docs.columns,
        F.size("__parts").cast("long").alias("__lines"),
        F.coalesce(F.when(F.col("__gone").isNotNull(), F.size("__gone")), F.lit(0)).cast("long").alias("__dropped"),
        F.when(F.col("__gone").isNull(), text).otherwise(kept).alias("__kept"),
    )
