"""Helpers that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointquarry.scratch import shared_path as scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: ASCII white space, the characters [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def word_array(text: Column) -> Column:
    """The words of letters, digits and non-ASCII characters, A-Z lower-cased."""
    spaced = F.trim(F.regexp_replace(ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def plain(docs: DataFrame) -> DataFrame:
    """``docs`` without columns whose names begin with two underscores: those are the operators' own."""
    return docs.drop(*[c for c in docs.columns if c.startswith("__")])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by whatever store Spark can read it from."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back.

    This cuts the lineage, so what follows neither computes ``df`` twice nor
    loses it with an executor. The driver removes it when it ends. Without columns clashing in name, any schema works.
    """
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
