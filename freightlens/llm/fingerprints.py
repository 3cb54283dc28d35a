"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Every shingle of five words is hashed once. The hash's lowest bits choose a bin and each bin keeps its smallest hash.
An empty bin takes the value of another: bins have fixed random lists of others to try, and the first one filled is
taken; where none of the list is filled, the filled bin that comes first in the bin's own random order, so that every
empty bin ends at a filled one. Of each bin, the low-order bits of its value are stored. Likeness is the share of equal
bins, corrected for bits that are equal by chance. All of it runs inside the row with DataFrame functions.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window, functions as F

from freightlens.llm.tables import let, spare_name

WORDS = 5
BINS = 128
BITS = 8
TRIES = 8
VALUE_BITS = 57  # of a hash, besides the seven that choose one of 128 bins
EMPTY = (1 << VALUE_BITS) - 1


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


#: A last hash of each bin, which marks it as empty if no other is found, in the order in which Spark sorts longs.
LAST = sorted(_signed((b << VALUE_BITS) | EMPTY) for b in range(BINS))
#: For each bin, the other bins to try when it is empty.
PROBES = [random.Random(b).sample([x for x in range(BINS) if x != b], TRIES) for b in range(BINS)]


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """A hash of every run of five lower-cased words between blanks (fewer words: of all); empty without words."""
    def hashed(found: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(found) - words + 1, F.lit(1)))
        every = F.transform(starts, lambda i: F.xxhash64(F.slice(found, i, words)))
        return F.when(F.size(found) > 0, every).otherwise(F.array().cast("array<bigint>"))

    return let(F.array_remove(F.split(F.lower(text), r"\s+"), ""), hashed)


def _is_filled(value: Column) -> Column:
    return value.bitwiseAND(F.lit(EMPTY)) != EMPTY


def _bins(hashes: Column) -> Column:
    """The smallest hash of each bin, the leading bits of a hash being its bin: sorted, the first of each bin is kept."""
    def first_of_bin(ordered: Column) -> Column:
        bin_of = lambda h: F.shiftright(h, VALUE_BITS)
        return F.filter(ordered, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(ordered, i - 1))))

    return let(F.sort_array(F.concat(hashes, F.array(*map(F.lit, LAST)))), first_of_bin)


def _densified(bins: Column) -> Column:
    """Bins with each empty one filled from another."""
    probes = F.array(*[F.array(*map(F.lit, p)) for p in PROBES])

    def fill(filled: Column) -> Column:
        def tried(i: Column, k: int) -> Column:
            return let(F.get(bins, F.get(F.get(probes, i), F.lit(k))), lambda v: F.when(_is_filled(v), v))

        def by_own_order(i: Column) -> Column:
            return F.array_min(F.transform(filled, lambda f: F.struct(F.xxhash64(i, f["bin"]).alias("rank"), f["value"].alias("value"))))["value"]

        return F.transform(bins, lambda v, i: F.when(_is_filled(v), v).otherwise(F.coalesce(*[tried(i, k) for k in range(TRIES)], by_own_order(i))))

    return let(F.filter(F.transform(bins, lambda v, i: F.struct(i.alias("bin"), v.alias("value"))), lambda f: _is_filled(f["value"])), fill)


def fingerprint(text: Column) -> Column:
    """The low-order bits of every bin, as an array of numbers; empty for NULL texts and texts without a word."""
    def packed(hashes: Column) -> Column:
        low = F.transform(let(_bins(hashes), _densified), lambda v: v.bitwiseAND(F.lit((1 << BITS) - 1)).cast("smallint"))
        return F.when(F.size(hashes) > 0, low).otherwise(F.array().cast("array<smallint>"))

    return let(shingle_hashes(F.coalesce(text, F.lit(""))), packed)


def digits(print_: Column) -> Column:
    """A fingerprint as hexadecimal text, two digits a bin; empty for an empty one."""
    table = F.array(*[F.lit(f"{v:02x}") for v in range(1 << BITS)])
    return F.array_join(F.transform(print_, lambda v: F.get(table, v)), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1: the share of equal bins, less those equal by chance. Two
    empty fingerprints are alike (1), an empty and another are not (0)."""
    chance = 1 / (1 << BITS)
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(BINS))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(
        F.greatest((equal - chance) / (1 - chance), F.lit(0.0)))


def with_next(docs: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """Add next_<column>, its value in the next row by descending key (then by column `order`; rows without a key come
    last), the first row following the last.

    Rows are dealt into ranges of the key, about as many as there are shuffle partitions, and looked up in a window over
    their range. The first row of a range is also sent to the range before it, so that no window spans the table. Two
    numbers per range reach the driver. One row is its own next.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)]) if parts > 1 else F.array(F.lit(0.5))
    bounds = sorted(set(docs.agg(F.approx_percentile(key, shares, F.lit(10 * parts + 1_000)).alias("b")).first()["b"] or []))
    step = max(int(len(bounds) ** 0.5), 1)
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)] or [[0]]
    coarse = F.array(*[F.lit(g[0]) for g in groups])
    fine = F.array(*[F.array(*map(F.lit, g)) for g in groups])
    below = lambda limits: F.size(F.filter(limits, lambda b: b <= F.col(key)))
    at = let(below(coarse), lambda g: F.when(g == 0, F.lit(0)).otherwise((g - 1) * step + below(F.get(fine, g - 1))))
    span, guest, home = (spare_name(docs, n) for n in ("_range", "_guest", "_home"))
    ranged = docs.withColumn(span, F.when(F.col(key).isNull(), F.lit(-1)).otherwise(at))
    heads = {r[span]: r["first"] for r in ranged.groupBy(span).agg(F.max(key).alias("first")).collect()}
    order_of = sorted(heads, reverse=True)
    before = dict(zip(order_of[1:] + order_of[:1], order_of))  # the range whose last row is followed by this one's first
    rows = [F.when((F.col(span) == r) & F.col(key).eqNullSafe(F.lit(heads[r]).cast(docs.select(key).schema[0].dataType)), F.lit(before[r])) for r in heads]
    visits = F.coalesce(*rows) if rows else F.lit(None).cast("int")
    both = F.array(F.struct(F.col(span).alias(home), F.lit(0).alias(guest)), F.struct(visits.alias(home), F.lit(1).alias(guest)))
    sent = ranged.select(*docs.columns, F.explode(F.filter(both, lambda x: x[home].isNotNull())).alias(span)).select(*docs.columns, f"{span}.*")
    window = Window.partitionBy(home).orderBy(guest, F.col(key).desc_nulls_last(), F.col(order))
    return sent.select("*", *[F.lead(c).over(window).alias(f"next_{c}") for c in columns]).where(F.col(guest) == 0).drop(home, guest)


def fingerprinted(docs: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """`docs` with the fingerprint of each whole text."""
    return docs.withColumn(into, fingerprint(F.col(text)))


def half_edited(text: Column, other: Column) -> Column:
    """The text with its last half replaced by as much of the beginning of another."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))
