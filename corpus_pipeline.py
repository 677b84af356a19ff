"""The corpus pipeline: toxic documents go, then repeated lines, near copies and benchmark
passages, and what stays is mixed by source.

Columns of documents that begin with two underscores are the operators' own: stages leave them out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointquarry.llm import decontam, linededup, mixing, nearcopies, toxicity
from pointquarry.llm.common import plain, scratch_path, table

#: Toxicity from which a document goes.
TOXIC = 0.7
#: Weights of the sources in the order of code points, in turn, and the size of the mix.
WEIGHTS, EPOCHS, MOST = [3, 1, 2], 1.5, 2.0
#: Two-word shingles and 6 of 64 bits find candidates among near copies, beside bands of min-wise hashes.
SHINGLE, RADIUS = 2, 6


def with_text(docs: DataFrame, text: Column, changed: Column, columns: list[str]) -> DataFrame:
    """The columns of documents, with another text and its length where it changed."""
    new = docs.withColumns({"__changed": changed, "__text": text})
    n_chars = F.when(F.col("__changed"), F.char_length("__text").cast("long")).otherwise(F.col("n_chars"))
    return new.withColumns({"text": F.when(F.col("__changed"), F.col("__text")).otherwise(F.col("text")), "n_chars": n_chars}).select(*columns)


def keyed(docs: DataFrame) -> DataFrame:
    """Adds what tells rows apart: the id (null last) and a hash of the text."""
    return plain(docs).withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(linededup.LAST)), "__hash": F.xxhash64("text")})


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents scored as toxic go.

    Rows are scored whole and each for itself: repeated rows share their fate, null and empty texts have the
    score of a text without terms and stay, null ids are scored but never learnt from. An empty
    table stays empty; without labels nothing goes.
    """
    docs = plain(docs)
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), whole=True)
    return scored.where(F.col("__score") < TOXIC).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: repeated lines go from the texts; n_chars follows where a text changed.

    No row goes, even if no line of it stays. Of documents with a common line the smallest id keeps it (null ids
    are one document after all others); rows of one id are one document, so repeated rows stay alike. A
    null text is one empty line and stays null. Texts of any length; an empty table stays empty.
    """
    out = linededup.dedup_lines(docs)
    return with_text(out, F.col("__kept"), F.col("__dropped") > 0, plain(docs).columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of each group of near copies, linked by pairs that share 0.8 or more of their
    five-word shingles, the document of the smallest id stays.

    Ties of id go to the smaller hash of the text; a row repeated in full stays once. A null id comes after all
    others. Null, empty and wordless texts are copies of one another, so one of them stays; a text of fewer than
    five words is one shingle. Texts of any length are compared whole; an empty table stays empty.
    """
    stay = nearcopies.firsts(keyed(docs).select("__id", "__hash", "text"), RADIUS, SHINGLE)
    return keyed(docs).join(stay, ["__id", "__hash"]).dropDuplicates(["__id", "__hash"]).select(*plain(docs).columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: benchmark passages go from the texts, and documents that were nothing else.

    n_chars follows where a text changed. Rows are searched each for itself, so repeated rows stay alike; null
    and empty texts and null ids stay. Texts of any length are searched whole; an empty table or benchmark changes nothing.
    """
    out = decontam.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    left = out.where((F.col("__hit") == 0) | (F.col("__hit") < F.col("__words")))
    return with_text(left, F.col("__clean"), F.col("__hit") > 0, plain(docs).columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the documents that the mix takes, with ``taken``, the words it takes of each
    (whole rounds first, and then a part of its words). Rows repeated in full
    are one document here.

    A consumer has to apply ``taken``: rows hold whole texts. Documents of which nothing is taken go, and so do null and
    wordless texts. Null ids are told apart by their texts, null sources are one source after all others. An
    empty table stays empty.
    """
    parts = mixing.mix(keyed(docs).select("__id", "__hash", "text", "source"), WEIGHTS, EPOCHS, MOST, id_col="__id", carry=("__hash",))
    taken = parts.groupBy("__id", "__hash").agg(F.sum("size").alias("__size"), F.first("source_size").alias("__source_size"), F.first("target").alias("__target"), F.sum("taken").alias("__taken"))
    both = keyed(docs).join(taken.where(F.col("__taken") > 0), ["__id", "__hash"]).dropDuplicates(["__id", "__hash"])
    own = ("size", "source_size", "target", "taken")
    return both.select(*[c for c in plain(docs).columns if c not in own], *[F.col(f"__{c}").alias(c) for c in own])


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: No SQL expresses the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
