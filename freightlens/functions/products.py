"""Sums over rows that are easier as matrices: each task adds up its Arrow batches, Spark adds up the tasks by position."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def summed(rows: DataFrame, size: int, add: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of `add(matrix)`, a vector of `size` numbers, over all batches; `rows` has double columns only, and NULL is NaN.

    A task sends `size` numbers, and as many reach the driver, whatever the number of rows. No rows give zeros.
    """
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += add(np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]))
        yield pa.record_batch([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["at", "value"])

    out = np.zeros(size)
    got = rows.mapInArrow(partial, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out[got["at"].to_numpy()] = got["value"].to_numpy()
    return out


def cross_products(df: DataFrame, columns: list[Column]) -> np.ndarray:
    """X'X of the columns as a full symmetric matrix; a missing cell counts as zero."""
    size = len(columns)
    upper = np.triu_indices(size)

    def add(x: np.ndarray) -> np.ndarray:
        x = np.where(np.isnan(x), 0.0, x)
        return (x.T @ x)[upper]

    out = np.zeros((size, size))
    out[upper] = summed(df.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)]), len(upper[0]), add)
    return out + np.triu(out, 1).T
