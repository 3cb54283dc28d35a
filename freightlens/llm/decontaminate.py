"""Benchmark decontamination: q-gram lemma filtering over overlapping diagonal bands, then banded alignment.

Benchmark items are normalised (lower-cased letters and digits, all else one space) and cut into overlapping patterns
of `pattern` characters, the last one flush with the end. They start so densely (`stride` is the edit budget + 1) that what
is found does not depend on where an excerpt starts: of an item of 96 characters or more, every verbatim excerpt of 87
normalised characters is found, and every one of 87 + 2e with e edits (9 at most); of a shorter item, the whole less its
edit budget.

A region of a document that holds a pattern within k edits keeps at least len - q + 1 - k*q of its q-grams, all on at
most k + 1 neighbouring diagonals. So the q-grams shared with an item are gathered in diagonal bands of twice that width,
each overlapping the next by half; patterns that reach the bound in a band are verified by an alignment restricted to it.
Bands of a pattern that lie side by side share one bit-parallel alignment, so a dense stretch is read once a pattern.

An item that repeats a q-gram often (rule lines, dumps of tables) would pair each of its places with each place of a text
that repeats it too. Its bands are as wide as the item: they count places of the document that share any q-gram with it,
each place once, which the lemma bounds by the same number. So nothing is multiplied out, and nothing is lost.

The benchmark is a query set, held in blocks of bounded size: each block is one broadcast, each document is read once a
block, whole, in one task; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from freightlens.llm.tables import shared, text_slices
from freightlens.llm.text_codes import letter_tables, normalise, rolling_hash


@dataclass(frozen=True)
class Leaks:
    """q: characters of a q-gram. pattern, stride: characters of a pattern and between patterns of one item.
    rate: edits allowed per pattern character. block_chars: benchmark characters of one broadcast block.
    slice_chars: normalised characters scanned at once (memory only; slices overlap)."""

    q: int = 8
    pattern: int = 96
    stride: int = 10
    rate: float = 0.1
    block_chars: int = 1_000_000
    slice_chars: int = 500_000


#: An item that holds a q-gram more often than this gets bands as wide as itself.
REPEATS = 4
#: Memory only: stretches aligned together, bands between joints of a stretch, patterns whose letters are laid out
#: together, bands or shared q-grams held at once.
LANES, JOINT, LAID_OUT, HELD = 4_096, 32, 512, 2_000_000
FOUND = "item_id long, start long, end long, edits int, patterns int, item_patterns int"


class PatternIndex:
    """Patterns and q-grams of one block of the benchmark; plain arrays, so that it can be broadcast. A q-gram is held once
    for each place in a text of an item, however many patterns cover it."""

    def __init__(self, items: list[tuple[int, str]], leaks: Leaks):
        tables = letter_tables()
        texts, owners, units, starts = [], [], [], []
        for item, text in items:
            codes, _ = normalise(text, tables)
            if len(codes) < leaks.q:
                continue
            last = max(len(codes) - leaks.pattern, 0)
            for start in [*range(0, last, leaks.stride), last]:
                owners.append(item)
                units.append(len(texts))
                starts.append(start)
            texts.append(codes)
        self.owner = owners
        self.parts: dict[int, int] = {}
        for item in owners:
            self.parts[item] = self.parts.get(item, 0) + 1
        lengths = np.array([len(t) for t in texts], np.int64)
        self.text = np.concatenate(texts).astype(np.uint32) if texts else np.empty(0, np.uint32)
        unit, self.start = np.array(units, np.int64), np.array(starts, np.int64)
        self.begin = (np.cumsum(lengths) - lengths)[unit] + self.start
        self.longest = int(lengths.max(initial=0)) + 1  # keeps (text, place) apart as one number
        self.order = unit * self.longest + self.start  # ascending
        self.width = leaks.pattern
        size = np.minimum(lengths, leaks.pattern)
        budget = np.minimum((size * leaks.rate).astype(np.int64), np.maximum((size - leaks.q) // leaks.q, 0))
        self.grams, self.need = size - leaks.q + 1, size - leaks.q + 1 - budget * leaks.q  # of the patterns of a text
        self.reach = size + budget  # most characters of a document that a found pattern covers
        self.size, self.budget = size[unit], budget[unit]
        self.patterns = np.searchsorted(unit, np.arange(len(texts) + 1))  # where the patterns of a text begin
        self.alphabet, self.letters = np.unique(self.text, return_inverse=True)
        grams = [rolling_hash(t, leaks.q) for t in texts]
        self.repeats = np.array([np.unique(g, return_counts=True)[1].max(initial=0) > REPEATS for g in grams], bool)
        places = [np.unique(g, return_index=True)[1] if r else np.arange(len(g)) for g, r in zip(grams, self.repeats)]
        hashes = np.concatenate([g[p] for g, p in zip(grams, places)] or [np.empty(0, np.uint64)])
        order = np.argsort(hashes, kind="stable")
        self.unit = np.repeat(np.arange(len(texts)), [len(p) for p in places])[order].astype(np.int32)
        self.place = np.concatenate(places or [np.empty(0, int)])[order].astype(np.int32)
        self.keys, self.first = np.unique(hashes[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(hashes)))
        self.flags = np.zeros(1 << 22, bool)
        self.flags[self.keys >> np.uint64(42)] = True

    @property
    def codes(self) -> np.ndarray:
        """The patterns themselves, a row each."""
        out = np.zeros((len(self.size), self.width), np.uint32)
        for i, (begin, size) in enumerate(zip(self.begin, self.size)):
            out[i, :size] = self.text[begin : begin + size]
        return out


def _runs(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each run, `many` numbers each."""
    return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)


def _shared(codes: np.ndarray, index: PatternIndex, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the document whose q-gram an item has, and which q-gram it is."""
    hashes = rolling_hash(codes, q)
    near = np.flatnonzero(index.flags[hashes >> np.uint64(42)])
    slot = np.minimum(np.searchsorted(index.keys, hashes[near]), len(index.keys) - 1)
    real = index.keys[slot] == hashes[near]
    return near[real], slot[real]


def _bands(codes: np.ndarray, near: np.ndarray, slot: np.ndarray, index: PatternIndex, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pattern, band) pairs that reach the bound; band b covers diagonals [b*width, (b+2)*width) of the item's text."""
    many = index.count[slot]
    entry = _runs(index.first[slot], many)
    at, unit, place = np.repeat(near, many), index.unit[entry].astype(np.int64), index.place[entry]
    wide = index.repeats[unit]
    if wide.any():
        yield from _wide_bands(at[wide], unit[wide], index, width)
        at, unit, place = at[~wide], unit[~wide], place[~wide]
    if len(at):
        yield _narrow_bands(codes, at, unit, place, index, width)


def _wide_bands(at: np.ndarray, unit: np.ndarray, index: PatternIndex, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bands of items that repeat themselves: all diagonals where a pattern can cover enough shared places."""
    order = np.lexsort((at, unit))
    at, unit = at[order], unit[order]
    end = np.arange(len(at)) + index.need[unit] - 1
    inside = end < len(at)
    end = np.minimum(end, len(at) - 1)
    dense = np.flatnonzero(inside & (unit[end] == unit) & (at[end] - at < index.reach[unit]))
    if not len(dense):
        return
    unit, low, high = unit[dense], at[end[dense]] - index.reach[unit[dense]], at[dense] + index.reach[unit[dense]]
    joint = np.append(True, (unit[1:] != unit[:-1]) | (low[1:] > high[:-1]))  # low and high ascend within an item
    last = np.append(np.flatnonzero(joint)[1:] - 1, len(unit) - 1)
    unit, low, high = unit[joint], low[joint], high[last]
    many = index.patterns[unit + 1] - index.patterns[unit]
    pattern, low, high = _runs(index.patterns[unit], many), np.repeat(low, many), np.repeat(high, many)
    begin = (low - index.start[pattern]) // width
    count = np.maximum((high - index.size[pattern] - index.start[pattern]) // width, begin) - begin + 1
    part = np.cumsum(count) // HELD
    for i in range(int(part[-1]) + 1):
        now = part == i
        yield np.repeat(pattern[now], count[now]), _runs(begin[now], count[now])


def _narrow_bands(codes: np.ndarray, at: np.ndarray, unit: np.ndarray, place: np.ndarray, index: PatternIndex, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bands of all other items: each place of the item counts once in every band that covers its diagonal."""
    shift, bands = index.longest + 1, len(codes) + index.longest + 2  # keeps the numbers packed below from meeting
    key = unit * bands + (at - place) // width + shift
    packed = np.concatenate([key, key - 1])  # a hit counts in both bands that cover its diagonal
    packed *= index.longest
    packed += np.tile(place, 2)
    packed.sort()
    packed = packed[np.append(True, packed[1:] != packed[:-1])]  # a q-gram's place counts once a band
    key, place = np.divmod(packed, index.longest)
    unit = key // bands
    # stretches from one shared q-gram to the one with which a pattern would have enough of them
    end = np.arange(len(key)) + index.need[unit] - 1
    inside = end < len(key)
    end = np.minimum(end, len(key) - 1)
    dense = np.flatnonzero(inside & (key[end] == key) & (place[end] - place < index.grams[unit]))
    key, unit, first, last = key[dense], unit[dense], place[dense], place[end[dense]]
    low = np.searchsorted(index.order, unit * index.longest + np.maximum(last - index.grams[unit] + 1, 0))
    high = np.searchsorted(index.order, unit * index.longest + first, side="right")  # patterns that cover the stretch
    many = np.maximum(high - low, 0)
    pairs = np.unique(np.stack([_runs(low, many), np.repeat(key % bands - shift, many)]), axis=1)
    return pairs[0], pairs[1]


def _align(codes: np.ndarray, pattern: np.ndarray, band: np.ndarray, index: PatternIndex, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Fewest edits of each whole pattern against the text, ending on the diagonals of its band or within `width` of them,
    and where the first best alignment ends. Diagonals are scored in blocks of `width`, each once for all bands that share it."""
    shift, span = int(-band.min()) + 1, int(band.max() - band.min()) + 5
    block = np.unique(np.concatenate([pattern * span + band + shift + i for i in (-1, 0, 1, 2)]))
    of = block // span
    # stretches of neighbouring blocks, with a joint here and there
    begins = np.append(True, (block[1:] != block[:-1] + 1) | (of[1:] != of[:-1]))
    since = np.arange(len(block)) - np.maximum.accumulate(np.where(begins, np.arange(len(block)), 0))
    lane = np.flatnonzero(since % JOINT == 0)
    count = np.diff(np.append(lane, len(block)))
    end = index.start[of[lane]] + (block[lane] % span - shift) * width + index.size[of[lane]]  # first end that counts
    edits, where = np.empty(len(block), np.int32), np.empty(len(block), np.int64)
    letters = np.minimum(np.searchsorted(index.alphabet, codes), len(index.alphabet) - 1)
    letters[index.alphabet[letters] != codes] = len(index.alphabet)
    order = np.lexsort((count, of[lane] // LAID_OUT))
    group = np.flatnonzero(np.append(True, np.diff(of[lane][order] // LAID_OUT) != 0))
    for lo, hi in zip(group, np.append(group[1:], len(order))):
        table = _letter_masks(index, int(of[lane[order[lo]]]) // LAID_OUT * LAID_OUT)
        for i in range(lo, hi, LANES):
            some = order[i : min(i + LANES, hi)]
            best, place = _score(letters, of[lane[some]], end[some], int(count[some].max()), table, index, width)
            mine = np.arange(best.shape[1]) < count[some][:, None]
            slots = (lane[some][:, None] + np.arange(best.shape[1]))[mine]
            edits[slots], where[slots] = best[mine], place[mine]
    four = np.searchsorted(block, pattern * span + band + shift - 1)[:, None] + np.arange(4)
    chosen = four[np.arange(len(four)), edits[four].argmin(1)]
    return edits[chosen], where[chosen]


def _letter_masks(index: PatternIndex, first: int) -> np.ndarray:
    """For each of the next `LAID_OUT` patterns, letter and word of 64 characters: the places of the letter, as bits."""
    size, begin = index.size[first : first + LAID_OUT], index.begin[first : first + LAID_OUT]
    out = np.zeros((len(size), len(index.alphabet) + 1, -(-index.width // 64)), np.uint64)
    for j in range(int(size.max())):
        has = np.flatnonzero(size > j)
        out[has, index.letters[begin[has] + j], j // 64] |= np.uint64(1 << (j % 64))
    return out


def _score(letters: np.ndarray, pattern: np.ndarray, end: np.ndarray, blocks: int, table: np.ndarray, index: PatternIndex, width: int):
    """(stretch, block): fewest edits of the pattern among the ends of a block, and the first such end. Bit-parallel columns
    of the alignment, all stretches together, a character at a time; the start in the text is free."""
    one, all_ones, high, words = np.uint64(1), ~np.uint64(0), np.uint64(63), table.shape[2]
    warm = index.width + width  # characters before the first end that counts
    size, none = index.size[pattern], table.shape[1] - 1
    last_word, last_bit = (size - 1) // 64, one << ((size - 1) % 64).astype(np.uint64)
    top = [np.where(last_word == w, last_bit, np.uint64(0)) if (last_word == w).any() else None for w in range(words)]
    row, masks = pattern % LAID_OUT * table.shape[1], [np.ascontiguousarray(table[:, :, w]).ravel() for w in range(words)]
    steps = warm + blocks * width
    begin = end - warm
    before, after = max(-int(begin.min()), 0), max(int(begin.max()) + steps - len(letters), 0)
    text = np.pad(letters, (before, after), constant_values=none)
    up, down = [np.full(len(pattern), all_ones) for _ in range(words)], [np.zeros(len(pattern), np.uint64) for _ in range(words)]
    score = size.astype(np.int32)
    best = np.full((blocks, len(pattern)), 1 << 30, np.int32)
    place = np.zeros((blocks, len(pattern)), np.int64)
    for step in range(steps):
        if step >= warm:  # the end before this character
            b = (step - warm) // width
            better = score < best[b]
            place[b][better] = (begin + step)[better]
            np.minimum(score, best[b], out=best[b])
        letter = row + text[begin + (before + step)]
        for w in range(words):
            same = masks[w][letter]
            vertical = same | down[w]
            if w:
                same |= less
            across = (((same & up[w]) + up[w]) ^ up[w]) | same
            rise, fall = down[w] | ~(across | up[w]), up[w] & across
            if top[w] is not None:
                score += (rise & top[w]) != 0
                score -= (fall & top[w]) != 0
            carry = (rise >> high, fall >> high) if w + 1 < words else None
            rise, fall = rise << one, fall << one
            if w:
                rise |= more
                fall |= less
            up[w], down[w] = fall | ~(vertical | rise), rise & vertical
            if carry:
                more, less = carry
    return best.T, place.T


def _finds(codes: np.ndarray, index: PatternIndex, leaks: Leaks) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays of pattern, first, last, edits of the patterns found in a normalised text."""
    if not len(index.keys) or not len(codes):
        return
    width = int(index.budget.max()) + 1
    overlap = leaks.pattern + 6 * width
    todo = [(start, min(start + leaks.slice_chars + overlap, len(codes)))
            for start in range(0, max(len(codes) - overlap, 1), leaks.slice_chars)]
    while todo:
        start, stop = todo.pop()
        part = codes[start:stop]
        near, slot = _shared(part, index, leaks.q)
        if index.count[slot].sum() > HELD and stop - start > 4 * overlap:  # memory only
            middle = (start + stop) // 2 // width * width  # bands stay where they are
            todo += [(start, middle + overlap), (middle, stop)]
            continue
        for pattern, band in _bands(part, near, slot, index, width):
            if len(pattern):
                edits, last = _align(part, pattern, band, index, width)
                good = np.flatnonzero(edits <= index.budget[pattern])
                size, last = index.size[pattern[good]], np.minimum(last[good], len(part))
                yield pattern[good], start + np.maximum(last - size, 0), start + last, edits[good]


def matches(codes: np.ndarray, index: PatternIndex, leaks: Leaks) -> Iterator[tuple[int, int, int, int]]:
    """(pattern, first, last, edits) of every pattern found in a normalised text, places in that text."""
    for found in _finds(codes, index, leaks):
        yield from zip(*(x.tolist() for x in found))


def _found(texts: list[str | None], index: PatternIndex, leaks: Leaks, tables) -> list[dict[int, tuple]]:
    """For each text, its items: (start, end, edits, patterns found). Short texts are scanned together."""
    out: list[dict[int, tuple]] = [{} for _ in texts]
    parts, places = zip(*(normalise(t or "", tables) for t in texts))
    gap = np.zeros(1, np.uint32)  # in no pattern
    joined = np.concatenate([x for p in parts for x in (p, gap)])
    begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
    seen: dict[tuple[int, int], set[int]] = {}
    for pattern, first, last, edits in _finds(joined, index, leaks):
        if not len(pattern):
            continue
        row = np.searchsorted(begins, last, side="left") - 1
        key = row * len(index.owner) + pattern
        order = np.argsort(key, kind="stable")
        cut = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
        least = [np.minimum.reduceat(x[order], cut).tolist() for x in (first, edits)]
        for k, low, high, e in zip(key[order][cut].tolist(), least[0], np.maximum.reduceat(last[order], cut).tolist(), least[1]):
            r, p = divmod(k, len(index.owner))
            item, source, begin = index.owner[p], places[r], int(begins[r])
            start = int(source[max(low - begin, 0)])
            end = int(source[min(high - begin, len(source)) - 1]) + 1
            old = out[r].get(item, (start, end, e))
            out[r][item] = (min(start, old[0]), max(end, old[1]), min(e, old[2]))
            seen.setdefault((r, item), set()).add(p)
    return [{item: (*span, len(seen[row, item])) for item, span in found.items()} for row, found in enumerate(out)]


def _blocks(benchmark: DataFrame, leaks: Leaks, item: str, text: str) -> Iterator[PatternIndex]:
    """The benchmark in blocks of about `block_chars` characters, dealt by a hash of the item; one at a time on the driver."""
    known = benchmark.select(F.col(item).cast("long").alias("item"), F.col(text).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    total = known.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-total // leaks.block_chars)
    for block in range(count):
        rows = known.where(F.pmod(F.xxhash64("item"), F.lit(count)) == block).sort("item", "text").collect()
        yield PatternIndex([(r["item"], r["text"]) for r in rows], leaks)


def find_leaks(docs: DataFrame, benchmark: DataFrame, leaks: Leaks = Leaks(), key: str = "doc_id", text: str = "text",
               item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document row and benchmark item found in it: key, item_id, start and end (code points of the original
    text, over all patterns found), edits (of the best pattern), patterns (found) and item_patterns (all of the item).

    Items with the same id count as one item with all their texts. NULL or empty texts hold nothing, items with fewer
    than q normalised characters are too short to be evidence and are never found; NULL items are ignored. Repeated
    documents give repeated rows; a NULL key is kept as it is. Empty tables give no rows.
    """
    schema = StructType([docs.select(key).schema[0], *docs.sparkSession.createDataFrame([], FOUND).schema])

    def apply(frame: DataFrame, sent) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = letter_tables()
            for batch in batches:
                for first, texts in text_slices(batch, 1, leaks.slice_chars):
                    keys = batch.column(0).slice(first, len(texts)).to_pylist()
                    rows = [(k, item, s, e, d, n, sent.value.parts[item])
                            for k, found in zip(keys, _found(texts, sent.value, leaks, tables))
                            for item, (s, e, d, n) in sorted(found.items())]
                    if rows:
                        kinds = [batch.schema[0].type, pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], schema.fieldNames())

        return frame.mapInArrow(run, schema)

    out = docs.sparkSession.createDataFrame([], schema)
    for index in _blocks(benchmark, leaks, item, item_text):
        out = out.unionByName(apply(docs.select(key, text), shared(docs.sparkSession, index)))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, leaks: Leaks = Leaks(), text: str = "text",
               item: str = "item_id", item_text: str = "text") -> DataFrame:
    """`docs`, all columns, without the rows that hold a benchmark item. Filters in place: no shuffle, no key needed."""
    def apply(frame: DataFrame, sent) -> DataFrame:
        place = frame.columns.index(text)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = letter_tables()
            for batch in batches:
                clean = [not found for _, texts in text_slices(batch, place, leaks.slice_chars)
                         for found in _found(texts, sent.value, leaks, tables)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return frame.mapInArrow(run, frame.schema)

    for index in _blocks(benchmark, leaks, item, item_text):
        docs = apply(docs, shared(docs.sparkSession, index))
    return docs
