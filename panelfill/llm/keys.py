"""What tells documents apart: rows that repeat an id with another text are documents of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelfill.session import stored


def mark() -> Column:
    """64 bits of (doc_id, text); a null text counts as empty, and a null id differs from every other."""
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def twins(rows: DataFrame) -> DataFrame | None:
    """(key, mark) of the documents whose key stands for more than one mark; None if there are none."""
    marks = rows.select("key", "mark")
    shared = marks.groupBy("key").agg(F.min("mark").alias("low"), F.max("mark").alias("high")).filter("low < high")
    shared = stored(shared.select("key"), "shared")
    return None if shared.isEmpty() else stored(marks.distinct().join(shared, "key", "left_semi"), "twins")
