"""SimHash near-duplicates: a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most four bits differ in at most four of their eight bytes, so they share
four positional bytes at least. The index lists fingerprints under triples of positional bytes; a set of 20 triples
meets every set of four positions, so no pair is missed. Of each pair that meets, the shared positional bytes are
tallied, pairs with fewer than four are dropped, and the rest are verified by counting differing bits.

Equal fingerprints enter the index once. Lists with more than `LONG_LIST` fingerprints are not paired but split
further: pairs in them share one byte more (five choices), and in lists still long the 32 bits left, in five blocks,
must have an equal block. Both steps keep every link, so nothing is capped. A pair that meets in several lists is
reported at the first of them, and links inside what is connected already are not sought.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType

from freightlens.llm.components import connect
from freightlens.llm.tables import spare_name
from freightlens.session import stage

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
BYTES = 8
MIN_SHARED = BYTES - MAX_BITS
LONG_LIST = 64


def _fingerprint(text: str | None, size: int) -> int:
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    last = max(len(words) - size, 0)
    starts, stops = (ends - lengths)[: last + 1].tolist(), ends[min(size, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], "<u8")
    ones = np.zeros(64, np.int64)
    for first in range(0, len(hashes), 65_536):
        part = hashes[first : first + 65_536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


@F.arrow_udf(LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array([_fingerprint(t.as_py(), SHINGLE_WORDS) for t in texts], pa.int64())


def fingerprint(text: Column) -> Column:
    """The SimHash of a whole text as a long: ASCII lower case, words between ASCII blanks, shingles of four words with
    repeats (fewer words: all of them), XXH64 with seed 42, a bit set where over half of the hashes have it. NULL,
    empty and blank texts give 0."""
    return _fingerprints(text)


def hex_digits(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def position_triples() -> list[tuple[int, ...]]:
    """20 triples of the eight positions such that any four positions hold one: Turan's construction over three groups."""
    group = [0, 0, 0, 1, 1, 1, 2, 2]
    found = []
    for triple in combinations(range(BYTES), 3):
        counts = [sum(group[p] == g for p in triple) for g in range(3)]
        if any(counts[g] == 3 or counts[g] == 2 and counts[(g + 1) % 3] == 1 for g in range(3)):
            found.append(triple)
    return found


def _mask(positions: tuple[int, ...]) -> int:
    value = sum(0xFF << 8 * p for p in positions)
    return value - (1 << 64) if value >= 1 << 63 else value


def _bit_blocks(positions: tuple[int, ...]) -> list[int]:
    """The bits outside `positions`, dealt into one block more than bits may differ."""
    free = [8 * p + i for p in range(BYTES) if p not in positions for i in range(8)]
    blocks = [sum(1 << b for b in free[k :: MAX_BITS + 1]) for k in range(MAX_BITS + 1)]
    return [v - (1 << 64) if v >= 1 << 63 else v for v in blocks]


def _entries(source: DataFrame, masks: dict[int, list[tuple[int, int]]] | None, start: list[int]) -> DataFrame:
    """Index entries (list, bits, fp): `start` masks for each fingerprint, or the refinements of each entry's list."""
    if masks is None:
        choices = F.array(*[F.struct(F.lit(i).alias("list"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(start)])
    else:
        table = F.array(*[F.array(*[F.struct(F.lit(i).alias("list"), F.lit(m).alias("mask")) for i, m in masks[k]]) for k in sorted(masks)])
        choices = F.transform(F.get(table, F.col("list")), lambda x: F.struct(
            x["list"].alias("list"), F.col("fp").bitwiseAND(x["mask"]).alias("bits")))
    carried = [c for c in source.columns if c in ("fp", "part")]
    return source.select(*carried, F.explode(choices).alias("e")).select(*carried, "e.list", "e.bits")


def _quads() -> list[tuple[int, tuple[int, ...]]]:
    """Every triple with one position more: (number of the triple, positions)."""
    return [(k, (*t, p)) for k, t in enumerate(position_triples()) for p in range(BYTES) if p not in t]


def _first_lists() -> tuple[list[int], list[int]]:
    """For each set of shared positions (as bits): the one triple, and the one of its quads, at which a pair is reported."""
    triples, quads = [], []
    for shared in range(1 << BYTES):
        held = lambda positions: all(shared >> p & 1 for p in positions)
        triple = next((k for k, t in enumerate(position_triples()) if held(t)), -1)
        triples.append(triple)
        quads.append(next((i for i, (k, q) in enumerate(_quads()) if k == triple and held(q)), -1))
    return triples, quads


def _pairs(entries: DataFrame, step: int) -> DataFrame:
    """Verified links among entries of the same list whose ends are not connected yet. A pair that meets in several lists
    is reported at the first of them alone."""
    apart = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    same = [(F.shiftrightunsigned(apart, 8 * p).bitwiseAND(F.lit(255)) == 0).cast("int") for p in range(BYTES)]
    tally, shared = sum(same[1:], same[0]), sum((s * (1 << p) for p, s in enumerate(same)), F.lit(0))
    first = F.get(F.array(*map(F.lit, _first_lists()[min(step, 1)])), shared)
    at = F.col("x.list") if step < 2 else F.floor(F.col("x.list") / (MAX_BITS + 1)).cast("int")
    x, y = entries.alias("x"), entries.alias("y")
    meet = (F.col("x.list") == F.col("y.list")) & (F.col("x.bits") == F.col("y.bits")) & (F.col("x.fp") < F.col("y.fp"))
    near = (tally >= MIN_SHARED) & (F.bit_count(apart) <= MAX_BITS)
    return x.join(y, meet & (F.col("x.part") != F.col("y.part")) & near & (first == at)).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))


def spanning_links(fingerprints: DataFrame, long_list: int = LONG_LIST) -> DataFrame:
    """Links (a, b) between values of column fp that connect exactly what links of at most four differing bits connect.

    Components need no more than that, and a dense group has a square number of links. So each list is first linked to its
    smallest and its largest member where they are near, which is linear, and of the pairs only those are sought whose
    ends these links have not connected.
    """
    triples, quads = position_triples(), _quads()
    blocks = [(k, block | _mask(q)) for k, (_, q) in enumerate(quads) for block in _bit_blocks(q)]
    steps = [
        (None, [_mask(t) for t in triples]),
        ({k: [(i, _mask(q)) for i, (j, q) in enumerate(quads) if j == k] for k in range(len(triples))}, []),
        ({k: [(i, m) for i, (j, m) in enumerate(blocks) if j == k] for k in range(len(quads))}, []),
    ]
    nodes = fingerprints.select("fp").distinct()
    index = Window.partitionBy("list", "bits")
    ends = _entries(nodes, None, steps[0][1]).select("fp", F.min("fp").over(index).alias("low"), F.max("fp").over(index).alias("high"))
    near = lambda end: F.when((F.col(end) != F.col("fp")) & (F.bit_count(F.col(end).bitwiseXOR(F.col("fp"))) <= MAX_BITS), F.col(end))
    stars = ends.select("fp", F.explode(F.array_compact(F.array(near("low"), near("high")))).alias("end"))
    found = stage(connect(stars.select(F.col("fp").alias("a"), F.col("end").alias("b"))), "stars")
    source = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("part"))
    found = found.select(F.col("node").alias("a"), F.col("root").alias("b"))
    for n, (masks, start) in enumerate(steps):
        entries = _entries(source, masks, start)
        if n < len(steps) - 1:
            entries = entries.withColumns({"size": F.count("*").over(index), "parts": F.min("part").over(index) != F.max("part").over(index)})
            entries = stage(entries.where("parts"), "index")
            source = entries.where(F.col("size") > long_list)
            entries = entries.where(F.col("size") <= long_list)
        found = found.unionByName(_pairs(entries, n))
        if n < len(steps) - 1 and not source.take(1):
            break
    return found


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", long_list: int = LONG_LIST) -> DataFrame:
    """(key, fingerprint long, component_id) for every row of `docs`.

    component_id is the smallest key among the documents reachable over links, itself included. Rows with a NULL key
    take part in linking and get the component of their fingerprint (NULL when no member has a key). Repeated rows
    stay repeated. An empty table gives no rows.
    """
    prints = stage(docs.select(F.col(key).alias("key"), fingerprint(F.col(text)).alias("fp")), "prints")
    nodes = prints.groupBy("fp").agg(F.min("key").alias("low"))
    roots = stage(connect(spanning_links(nodes, long_list)), "roots")
    joined = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    linked = joined.join(roots.select(F.col("root").alias("_r")).distinct(), F.col("root") == F.col("_r"), "left_semi")
    lowest = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = joined.join(lowest, "root", "left").select("fp", F.coalesce("component_id", "low").alias("component_id"))
    return prints.join(classes, "fp").select(F.col("key").alias(key), F.col("fp").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one document of each group of near-duplicates: the one with the smallest key.

    All columns stay as they are. Of rows that repeat a kept key, the one with the smallest text stays
    (any of several that repeat both). Rows without a
    key cannot be named in a group and stay.
    """
    name, place = spare_name(docs, "_kept"), spare_name(docs, "_place")
    kept = near_duplicates(docs, key, text).where(F.col("component_id") == F.col(key)).select(F.col(key).alias(name)).distinct()
    order = Window.partitionBy(key).orderBy(F.col(text).asc_nulls_first())
    known = docs.where(F.col(key).isNotNull()).join(kept, F.col(key) == F.col(name), "left_semi")
    known = known.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place)
    return known.unionByName(docs.where(F.col(key).isNull()))
