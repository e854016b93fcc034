"""Running totals that never gather one group in one task.

A window over a whole group would run in a single task however large the group is. Here the rows are
partitioned by ranges of the order column and stored with the number of their range; totals are first summed
per (group, range), and the window runs inside a range only; what precedes the range comes from the small table
of totals. Ranges are taken over all rows, so that each holds about as many, also when one group dominates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelfill.session import stored

MIN_BUCKETS = 8


def bucket_count(df: DataFrame) -> int:
    """Ranges that the rows are cut into: those of a shuffle, which the session sizes for its data."""
    return max(MIN_BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def range_buckets(df: DataFrame, order: str, buckets: int | None = None) -> DataFrame:
    """Adds ``_bucket``, a non-decreasing function of ``order`` with about equal numbers of rows, and stores the result.

    The bucket is the number of a range partition; equal values share one. Stored, since ranges taken again could differ.
    """
    ranged = df.repartitionByRange(buckets or bucket_count(df), order)
    return stored(ranged.withColumn("_bucket", F.spark_partition_id()), "ranges")


def hash_buckets(df: DataFrame, uniform: str, buckets: int | None = None) -> DataFrame:
    """The same for a column that is uniform on [0, 1) by construction: no quantiles needed."""
    buckets = buckets or bucket_count(df)
    return df.withColumn("_bucket", F.floor(F.col(uniform) * buckets))


def running_totals(
    bucketed: DataFrame, group: Sequence[str], order: Sequence[str], totals: dict[str, str]
) -> DataFrame:
    """For each row, the total of a column over the earlier rows of its group.

    ``totals`` maps a column to the name of its running total (which excludes the row itself);
    ``all_<column>`` is the total of the group. Rows must be unique in (group, order), and
    ``_bucket`` must not decrease along the first order column.
    """
    keys = [*group, "_bucket"]
    per_bucket = bucketed.groupBy(*keys).agg(*[F.sum(c).alias(f"_sum_{c}") for c in totals])
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *keys,
        *[F.coalesce(F.sum(f"_sum_{c}").over(earlier), F.lit(0)).alias(f"_before_{c}") for c in totals],
        *[F.sum(f"_sum_{c}").over(whole).alias(f"all_{c}") for c in totals],
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = bucketed.select(
        "*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_local_{c}") for c in totals]
    )
    joined = local.join(offsets, keys)
    return joined.select(
        *[c for c in bucketed.columns if c != "_bucket"],
        *[(F.col(f"_before_{c}") + F.col(f"_local_{c}")).alias(name) for c, name in totals.items()],
        *[f"all_{c}" for c in totals],
    )
