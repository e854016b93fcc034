"""Exact dedup by skew-safe combining."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 64


def normalised(text: Column) -> Column:
    """Null as empty; every run of space, \\t, \\n, \\v, \\f, \\r as one space. Plain replacements first: they are cheap."""
    flat = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    return F.when(F.contains(flat, F.lit("  ")), F.regexp_replace(flat, " +", " ")).otherwise(flat)


def exact_dedup(docs: DataFrame, salts: int | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Three stages, each comparing the whole normalised text and not only its digest: rows are combined
    inside each task (the map side of the first grouping), then by salted digest, then the salts' winners
    by digest. A group that holds a third of all rows so reaches the last stage as at most ``salts`` rows; by
    default there are as many salts as shuffle partitions, 64 at least, so the group is spread over all tasks.
    Rows find their group again through digest, second hash, length and salt, so that join is spread as well.

    Null text counts as empty. A null doc_id never wins unless all of a group are null; then all of them
    stay. Rows that repeat both doc_id and text count as rows of the group and get the same answer. An empty
    table gives an empty table; further columns are ignored.
    """
    salts = salts or max(SALTS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select("doc_id", normalised(F.col("text")).alias("norm")).select(
        "doc_id",
        "norm",
        F.unhex(F.sha2("norm", 256)).alias("digest"),
        F.xxhash64("norm").alias("second"),
        F.length("norm").alias("chars"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"),
    )
    key = ["digest", "second", "chars"]
    salted = rows.groupBy(*key, "salt", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    best = salted.groupBy(*key, "norm").agg(
        F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.collect_set("salt").alias("salts")
    )
    winners = best.select(*key, "keep_id", "group_size", F.explode("salts").alias("salt"))
    return (
        rows.drop("norm")
        .join(winners, [*key, "salt"])
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """One row of each normalised text, with the columns of ``docs``: the smallest id, null last, then the smallest text, then the other columns.

    Rows are combined as in :func:`exact_dedup`: in the tasks, by salt, then the salts' winners. A row travels as one
    struct in the order it is compared in, so beside the normalised text the text goes along once. Columns that have
    no order (maps) do not decide and follow the row that wins.
    """
    col = lambda c: F.col(f"`{c}`")
    others = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]
    loose = [f.name for f in others if re.search("map<|variant", f.dataType.simpleString())]
    firm = [f.name for f in others if f.name not in loose]
    first = [F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text").alias("text")]
    columns = {"row": F.struct(*first, *([F.struct(*map(col, firm)).alias("firm")] if firm else []))}
    if loose:
        columns["loose"] = F.struct(*map(col, loose))
    rows = docs.select(normalised(F.col("text")).alias("norm"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"), *[c.alias(n) for n, c in columns.items()])
    best = [F.min("row").alias("row"), *([F.min_by("loose", "row").alias("loose")] if loose else [])]
    found = rows.groupBy("norm", "salt").agg(*best).groupBy("norm").agg(*best)
    place = {"doc_id": "row.id", "text": "row.text"} | {c: f"row.firm.`{c}`" for c in firm} | {c: f"loose.`{c}`" for c in loose}
    return found.select(*[F.col(place[c]).alias(c) for c in docs.columns])


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256
FROM t JOIN g USING (norm)
"""
