"""Join shapes of the pipeline.

Only the code book gets a broadcast hint, after a row count. Other small sides come from stored
tables, whose size Spark knows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def in_keys(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(keys, on, "left_semi")


def not_in_keys(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(keys, on, "left_anti")


def with_answer_codes(results: DataFrame, codes: DataFrame, model: str = "attribute_model", value: str = "selected_value") -> DataFrame:
    """Attach question and answer keys to results named by (model, zero-based value)."""
    return results.join(codes, (F.col(model) == F.col("attribute")) & (F.col(value) == F.col("attribute_value")))


def lookup_both_sides(pairs: DataFrame, lookup: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Attach ``columns`` of a lookup to both sides of a pair table (``<key>_1`` and ``<key>_2``)."""
    small = lookup.select(key, *columns)
    for side in (1, 2):
        renamed = small.select(
            F.col(key).alias(f"{key}_{side}"), *[F.col(c).alias(f"{c}{side}") for c in columns]
        )
        pairs = pairs.join(renamed, f"{key}_{side}")
    return pairs


def first_match(left: DataFrame, right: DataFrame, on: list[str], order: Sequence[Column]) -> DataFrame:
    """Left join that takes only the first right row of each key."""
    rest = [c for c in right.columns if c not in on]
    first = right.groupBy(*on).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return left.join(first.select(*on, "_first.*"), on, "left")


def join_labels(frames: Sequence[DataFrame], on: list[str]) -> DataFrame:
    """Full outer join of several label columns on the respondent."""
    out = frames[0]
    for other in frames[1:]:
        out = out.join(other, on, "full")
    return out


def key_pairs(audiences: DataFrame, keys: str = "keys") -> DataFrame:
    """Unordered pairs of the keys listed in each row, as ``(key_1, key_2, expression)``.

    The keys of one audience (two, as audiences are built here) are an array, so its pairs come
    from that row alone and no self-join is needed.
    """
    sorted_keys = F.array_sort(F.array_distinct(F.col(keys)))
    pairs = F.flatten(
        F.transform(
            sorted_keys,
            lambda a: F.transform(
                F.filter(sorted_keys, lambda b: b > a), lambda b: F.struct(a.alias("key_1"), b.alias("key_2"))
            ),
        )
    )
    return (
        audiences.select(*[c for c in audiences.columns if c != keys], F.explode(pairs).alias("p"))
        .select("*", "p.key_1", "p.key_2")
        .drop("p")
        .withColumn("expression", F.concat(F.lit("A"), F.col("key_1"), F.lit(" AND A"), F.col("key_2")))
    )


def common_keys(*frames: DataFrame) -> DataFrame:
    """Distinct keys present in every frame."""
    out = frames[0]
    for other in frames[1:]:
        out = out.intersect(other)
    return out
