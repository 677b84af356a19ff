"""Small results as text: a Markdown table, class lines, JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def markdown(df: DataFrame, title: str, most: int = 1000) -> str:
    """A result of at most ``most`` rows as a Markdown table; more are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]) + "\n"


def class_line(code: Column, n: Column, pct: Column, mean: Column) -> Column:
    """A line of a class profile with aligned numbers."""
    return F.concat(F.lpad(code.cast("string"), 3, " "), F.lpad(F.format_string("%d", n), 10, " "), F.lpad(F.format_string("%.2f", F.round(pct, 2)), 8, " "), F.lit("%"), F.lpad(F.format_string("%.1f", F.round(mean, 1)), 10, " "))


def write_json(df: DataFrame, path: str) -> None:
    """A small result as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)
