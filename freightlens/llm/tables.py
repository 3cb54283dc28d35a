"""Reading the tables, and small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from types import SimpleNamespace

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: What one call inside a task takes at a time: bytes of text, and rows.
BATCH_CHARS = 1_000_000
BATCH_ROWS = 256


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared(spark: SparkSession, thing: object):
    """Broadcast the fields of an object. Broadcast values are pickled by reference to their class, and executors need no copy
    of this package, so the fields travel in a class of the standard library."""
    return spark.sparkContext.broadcast(SimpleNamespace(**vars(thing)))


def spare_name(df: DataFrame, stem: str) -> str:
    """A column name that `df` does not have, in any case of its letters."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def text_slices(batch: pa.RecordBatch, text: int, chars: int = BATCH_CHARS) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of rows whose texts have about `chars` bytes together (one row at least, `BATCH_ROWS` at most): first row
    and the texts. A whole text is never cut."""
    column = batch.column(text)
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    first, held = 0, 0
    for i, size in enumerate(sizes):
        if i > first and (held + size > chars or i - first == BATCH_ROWS):
            yield first, column.slice(first, i - first).to_pylist()
            first, held = i, 0
        held += size
    if first < len(sizes):
        yield first, column.slice(first).to_pylist()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once a row, also where the body reads it inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def join_split(rows: DataFrame, to: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """`rows` LEFT JOIN `to`, which has one row per `key`. Keys in `hot`, a table of proven size, meet by broadcast, so no
    task gathers their rows; the rest meet by a shuffle."""
    out = [*rows.columns, *[c for c in to.columns if c != key]]
    told = to.withColumn("_told", F.lit(True))
    first = rows.join(F.broadcast(told.join(F.broadcast(hot.select(key)), key, "left_semi")), key, "left")
    rest = first.where("_told IS NULL").select(*rows.columns).join(told, key, "left")
    return first.where("_told").select(*out).unionByName(rest.select(*out))
