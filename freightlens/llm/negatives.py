"""Hard negatives by a secondary-sort shuffle.

Anchors meet all rows in a grid of cells: strips of anchors by blocks of rows, both dealt by row number, so no key can make
a cell larger than another. A cell multiplies its two matrices a slice at a time and keeps, for each of its anchors, only
what can count: the best rows of the anchor's label, then, once these are known, the first rows in each positive's window.
Scores are never listed whole; what leaves a cell is a few records an anchor.

Records are packed into bytes that sort as (anchor, descending score, positives first, id). `repartitionAndSortWithinPartitions`
deals them by anchor and sorts; an iterator then reads each partition once, opens a window at each positive and emits the
negatives that fall in it, holding open windows alone. Sorting spills in Spark's shuffle, so an anchor may have any number
of records.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from freightlens.session import stage

#: A packed record. Unsigned big-endian numbers sort as bytes do; signed ones are moved up by 2^63 first.
RECORD = np.dtype([("anchor", ">u8"), ("anchor_id", ">u8"), ("falling", ">u8"), ("kind", "u1"), ("id", ">u8"), ("row", ">u8")])
POSITIVE, NEGATIVE = 0, 1
MIDDLE = 1 << 63
LONG = (-MIDDLE, MIDDLE - 1)
#: What one task of a sorted shuffle reads, about.
RECORDS_A_TASK = 2_000_000


@dataclass(frozen=True)
class Mining:
    """Positives per anchor, negatives per positive, and the window of a negative's score in per cent of the positive's.

    A component counts as floor(scale * x). About `strip` anchors and `block` rows make a cell, with smaller blocks, of
    `least_block` rows or more, where there are fewer than tasks; `slice_rows` anchors are multiplied at a time. These
    four change the speed only.
    """

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    scale: int = 256
    strip: int = 16_384
    block: int = 65_536
    least_block: int = 2_048
    slice_rows: int = 64


def _matrix(vectors: pa.Array, scale: int) -> np.ndarray:
    """Vectors as rows of whole numbers; shorter ones are filled with zeros."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = np.diff(vectors.offsets.to_numpy()) if len(vectors) else np.zeros(0, np.int64)
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = values
    return np.floor(out * scale)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products as longs. Doubles are exact below 2^53; beyond, Python's integers are, cut to the range of a long."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if width * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 2**53:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T
    return np.clip(exact, *LONG).astype(np.int64)


def _up(values: np.ndarray) -> np.ndarray:
    return values.astype(np.int64).view(np.uint64) ^ np.uint64(MIDDLE)


def _best(scores: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` highest scores, higher first, ties by place."""
    falling, places = ~scores, np.arange(len(scores))
    if len(scores) > most:
        last = np.partition(falling, most - 1)[most - 1]
        below = np.flatnonzero(falling < last)
        places = np.concatenate([below, np.flatnonzero(falling == last)[: most - len(below)]])
    return places[np.lexsort((places, falling[places]))]


def _cell(anchors: pa.Table, rows: pa.Table, plan: Mining) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(anchor, places in `rows`, scores, kind) of what each anchor of a cell keeps. Anchors that carry their positives'
    scores keep negatives, others positives. `rows` are in order of (id, row), so ties go by place."""
    labels, numbers = rows["label"].to_numpy(), rows["row"].to_numpy()
    a_labels, a_numbers = anchors["label"].to_numpy(), anchors["row"].to_numpy()
    left, right = _matrix(anchors["vector"], plan.scale), _matrix(rows["vector"], plan.scale)
    windows = anchors["scores"].to_pylist() if "scores" in anchors.column_names else None
    for label in np.unique(a_labels):
        mine = np.flatnonzero(a_labels == label)
        theirs = np.flatnonzero((labels == label) if windows is None else (labels != label))
        if not len(theirs):
            continue
        facing = right[theirs]
        for first in range(0, len(mine), plan.slice_rows):
            part = mine[first : first + plan.slice_rows]
            for anchor, scores in zip(part.tolist(), _scores(left[part], facing)):
                if windows is None:
                    among = np.flatnonzero(numbers[theirs] != a_numbers[anchor])
                    kept = among[_best(scores[among], plan.positives)]
                    yield anchor, theirs[kept], scores[kept], POSITIVE
                    continue
                kept = set()
                for score in set(windows[anchor]):
                    lowest, highest = -(-score * plan.low // 100), score * plan.high // 100
                    among = np.flatnonzero((scores >= lowest) & (scores <= highest)) if lowest <= highest else theirs[:0]
                    kept.update(among[_best(scores[among], plan.negatives)].tolist())
                kept = np.array(sorted(kept), np.int64)
                yield anchor, theirs[kept], scores[kept], NEGATIVE


def _packed(anchors: pa.Table, rows: pa.Table, plan: Mining) -> pa.Table:
    rows = rows.sort_by([("id", "ascending"), ("row", "ascending")])
    ids, numbers = rows["id"].to_numpy(), rows["row"].to_numpy()
    a_ids, a_numbers = anchors["id"].to_numpy(), anchors["row"].to_numpy()
    found = []
    for anchor, places, scores, kind in _cell(anchors, rows, plan):
        record = np.empty(len(places), RECORD)
        record["anchor"], record["anchor_id"] = a_numbers[anchor], _up(a_ids[anchor : anchor + 1])[0]
        record["falling"], record["kind"] = ~_up(scores), kind
        record["id"], record["row"] = _up(ids[places]), numbers[places]
        found.append(record)
    data = np.concatenate([np.empty(0, RECORD), *found]).astype(RECORD)  # it turns fields to native order
    ends = np.arange(len(data) + 1, dtype=np.int32) * RECORD.itemsize
    keys = pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(ends), pa.py_buffer(data.tobytes())])
    return pa.table({"record": keys})


def _records(anchors: DataFrame, rows: DataFrame, strips: int, blocks: int, plan: Mining) -> DataFrame:
    """Every strip of anchors against every block of rows: one column `record`."""
    deal = lambda parts, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = anchors.select("*", deal(strips, 1).alias("strip"), every(blocks).alias("block"))
    right = rows.select("id", "row", "label", "vector", deal(blocks, 2).alias("block"), every(strips).alias("strip"))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        return _packed(left, right, plan)

    return left.groupBy("strip", "block").cogroup(right.groupBy("strip", "block")).applyInArrow(cell, "record binary")


def _sorted(records: DataFrame, parts: int, read):
    """Records dealt by anchor and sorted, each partition read by an iterator over their fields."""
    keyed = records.rdd.map(lambda r: (bytes(r[0]), None))
    dealt = keyed.repartitionAndSortWithinPartitions(parts, lambda key: zlib.crc32(key[:8]))
    return dealt.mapPartitions(lambda pairs: read(_fields(key for key, _ in pairs)))


def _fields(keys: Iterator[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
    """(anchor, anchor_id, score, kind, id), unpacked."""
    number = int.from_bytes
    for key in keys:
        yield (number(key[:8]), number(key[8:16]) - MIDDLE, MIDDLE - 1 - number(key[16:24]), key[24], number(key[25:33]) - MIDDLE)


def first_positives(records, most: int):
    """The first `most` records of each anchor: (anchor, score)."""
    last, seen = None, 0
    for anchor, _, score, _, _ in records:
        seen = seen + 1 if anchor == last else 1
        last = anchor
        if seen <= most:
            yield anchor, score


def in_windows(records, plan: Mining):
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): sorted records read once. A positive, of
    the first few of its anchor, opens a window; a negative goes to each open one that holds its score. Windows that are
    full, or that the falling scores have passed, close."""
    last, positives, windows = None, 0, []
    for anchor, anchor_id, score, kind, key in records:
        if anchor != last:
            last, positives, windows = anchor, 0, []
        if kind == POSITIVE:
            positives += 1
            if positives <= plan.positives and plan.low * score <= plan.high * score:
                windows.append([score, key, 0])
            continue
        windows = [w for w in windows if w[2] < plan.negatives and plan.low * w[0] <= 100 * score]
        for window in windows:
            if 100 * score <= plan.high * window[0]:
                window[2] += 1
                yield anchor_id, window[1], window[2], key, window[0], score


def mine(vectors: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", plan: Mining = Mining()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Rows with a NULL key, label or vector, or with a NULL or non-finite component, take no part. Scores are inner products
    of whole numbers, exact (beyond a long's range: cut to it); vectors of unequal length meet over the shorter one, an empty
    one scores 0. Ties go by the smaller key. Repeated rows are rows of their own: each is an anchor, a positive, a negative;
    an anchor is only kept from itself. Anchors without a positive, and positives without a negative, give no rows; nor does
    an empty table. Other columns are ignored.
    """
    spark, parallel = vectors.sparkSession, vectors.sparkSession.sparkContext.defaultParallelism
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    kind = vectors.schema[vector].dataType.simpleString()
    whole = F.forall(F.col(vector), lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & whole).select(
        F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
        F.col(vector).cast(kind if kind == "array<float>" else "array<double>").alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"), F.monotonically_increasing_id().alias("row"))
    rows = stage(rows, "vectors")
    anchors = rows.where("is_anchor").drop("is_anchor").toDF("id", "label", "vector", "row")  # columns of its own
    total, asked = rows.agg(F.count("*"), F.count_if("is_anchor")).first()
    if not asked:
        return spark.createDataFrame([], out)
    strips = ceil(asked / plan.strip)
    blocks = max(ceil(total / plan.block), min(ceil(total / plan.least_block), 2 * parallel))
    parts = max(2 * parallel, ceil(asked * blocks * plan.positives * (1 + plan.negatives) / RECORDS_A_TASK))

    near = stage(_records(anchors, rows, strips, blocks, plan), "positives")
    first = _sorted(near, parts, lambda records: first_positives(records, plan.positives))
    scores = spark.createDataFrame(first, "row long, score long", verifySchema=False).groupBy("row").agg(F.collect_list("score").alias("scores"))
    far = _records(anchors.join(scores, "row"), rows, strips, blocks, plan)
    found = _sorted(near.unionByName(far), parts, lambda records: in_windows(records, plan))
    return spark.createDataFrame(found, out, verifySchema=False)
