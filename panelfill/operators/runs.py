"""Rows of one key that lie next to each other, as one row: no sort and no state in the tasks that read them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StructField, StructType

from panelfill.session import ship


def _pack(keys: Sequence[str], values: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            first = np.zeros(n, bool)
            first[0] = True
            for key in keys:
                differs = pc.not_equal(batch[key].slice(1), batch[key].slice(0, n - 1))
                first[1:] |= pc.fill_null(differs, True).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(first)
            ends = pa.array(np.append(at, n), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, batch[value]) for value in values]
            yield pa.record_batch([*[batch[key].take(pa.array(at)) for key in keys], *lists], [*keys, *values])

    return run


def packed_runs(df: DataFrame, keys: Sequence[str], *values: str) -> DataFrame:
    """One row per run of adjacent rows with equal ``keys``; each of ``values`` becomes the array of its values, in one order.

    Nothing is dealt or sorted: a key has as many rows as runs, one at least, and a later grouping brings them together. Tables
    that are written respondent by respondent shrink to about one row each before they are shuffled.
    """
    ship(df.sparkSession)
    rows = df.select(*keys, *values)
    fields = [*rows.select(*keys).schema, *[StructField(v, ArrayType(rows.schema[v].dataType)) for v in values]]
    return rows.mapInArrow(_pack(list(keys), list(values)), StructType(fields))
