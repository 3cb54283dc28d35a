"""Histogram trees for boosting and forests, grown in two phases.

Inputs are coded once into at most 63 bins and a bin for missing values, a byte each; a split is a feature and the set of
bins that go left, so ordered and declared categorical inputs are treated alike. Gradients, weights and counts are whole
numbers, so sums do not depend on how rows are spread.

First phase, on Spark: every task adds up the histograms of the open nodes over its rows, the sums are merged by key, and
the best splits follow from them, level by level, for a group of trees at once. Second phase, in tasks: a forest's node
whose rows fit `LOCAL_ROWS`, or a boosting whose training rows do, goes to one task, which finishes it. A boosting over more
rows, but not more than `HELD_SHARE` times that bound in each of the tasks that run at once, is grown by all of them in one
barrier stage: each keeps its rows and margins, and they exchange the histograms of a level as files in the shared folder,
if that is one that tasks can open (a barrier call of Spark takes a second). All ways add the same numbers and draw from hashes of rows, trees and node paths, so the trees are the same for any bound.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil
from threading import Lock

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from freightlens.functions.scalars import unpivot_cells
from freightlens.session import discard, local_path, new_folder, stage
from freightlens.sources.shipments import ID

BINS = 64
#: Rows that one task finishes; about 30 MB of codes.
LOCAL_ROWS = 1_000_000
#: A task of a barrier stage keeps up to so many times `LOCAL_ROWS`; a row takes about 100 bytes.
HELD_SHARE = 4
#: Cells of the joint histogram of several inputs, which then take one count, and the rows of a node from which that pays.
GROUP_CELLS, GROUPED_ROWS = BINS * BINS, 6_000
#: Codes of groups of inputs that one read of a row brings.
GROUPS_A_READ = 8
#: Histogram cells that are held at once in a task.
CELLS = 1_000_000
TREES_AT_ONCE = 16
#: Nodes whose histograms are counted for two inputs at once; 4,096 cells a node then stay in a core's cache.
PAIRED_NODES = 16
#: Bytes of trees that one process holds; larger ensembles stay in a table.
HELD_BYTES = 64 << 20
#: Bytes of trees, and rows, that meet in a task where a table of trees is applied.
BLOCK_BYTES, PART_ROWS = 32 << 20, 1_000_000
TREES = "which int, tree int, nodes binary"
#: Rounds after which margins are written again in distributed boosting.
REFRESH = 3
#: Steps from the root that all rows take together.
SHARED_STEPS = 6
WEIGHT_UNIT, GRADIENT_UNIT = 1 << 16, 1 << 8
NODE = np.dtype([("feature", "<i2"), ("mask", "<u8"), ("left", "<i4"), ("right", "<i4"), ("value", "<f8"), ("cover", "<f8")])
#: Chances of up to 0, 1, 2, ... copies of a row in a bag: the Poisson law of mean one.
BAG = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)]))
ROWS = "h long, y int, w long, code binary"
#: Distributed boosting reads an Arrow batch of rows as one row: each column's values, end to end.
BLOCKS = "h binary, y binary, w binary, code binary, margin binary"


@dataclass(frozen=True)
class Spec:
    """What a single ensemble is grown by; `picks` inputs are tried, drawn by node in a forest and by tree in a boosting."""

    boosted: bool
    rounds: int
    depth: int
    picks: int
    rate: float = 1.0
    subsample: float = 1.0
    min_rows: int = 1
    min_gain: float = 0.0
    l2: float = 0.0
    seed: int = 42


@dataclass(frozen=True)
class Coding:
    """Per input, in order: ascending cut points (code 1 + cuts below the value), or the levels of a category and their codes."""

    cuts: list
    levels: list

    def codes(self, columns: list[np.ndarray]) -> np.ndarray:
        """Codes of values, a row each; missing values and unknown levels have code 0."""
        out = np.zeros((len(columns[0]) if columns else 0, len(columns)), np.uint8)
        for j, values in enumerate(columns):
            values = np.asarray(values, float)
            known = ~np.isnan(values)
            if self.levels[j] is None:
                out[known, j] = np.searchsorted(self.cuts[j], values[known]) + 1
            else:
                names, numbers = self.levels[j]
                place = np.minimum(np.searchsorted(names, values), max(len(names) - 1, 0))
                known &= names[place] == values if len(names) else False
                out[known, j] = numbers[place[known]]
        return out

    def categorical(self) -> np.ndarray:
        return np.array([x is not None for x in self.levels], bool)

    def widths(self) -> list[int]:
        """The number of codes of each input, that of missing values included."""
        return [int(max(at[1], default=0)) + 1 if at is not None else len(cuts) + 2 for cuts, at in zip(self.cuts, self.levels)]


def fit_coding(train: DataFrame, inputs: list[str], categories: list[str] = ()) -> Coding:
    """Quantiles of the ordered inputs, by one aggregate, and the levels of the categories. With more levels than bins, the
    rarer share bins."""
    ordered = [c for c in inputs if c not in categories]
    shares = [i / (BINS - 1) for i in range(1, BINS - 1)]
    row = train.agg(*[F.percentile_approx(F.col(c), shares, 10_000).alias(c) for c in ordered]).first() if ordered else {}
    levels = {c: [] for c in categories}
    if categories:
        counted = unpivot_cells(train, list(categories)).where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))
        for r in sorted(counted.collect(), key=lambda r: (r["column"], -r["n"], r["value"])):  # levels of declared columns
            levels[r["column"]].append(r["value"])
    cuts, coded = [], []
    for c in inputs:
        held = levels.get(c)
        cuts.append(None if held is not None else np.unique(np.array(row[c] or [], float)))
        by_value = sorted((v, 1 + i % (BINS - 1)) for i, v in enumerate(held)) if held is not None else None
        coded.append(by_value and (np.array([v for v, _ in by_value]), np.array([k for _, k in by_value], np.uint8)) if held else (None if held is None else (np.zeros(0), np.zeros(0, np.uint8))))
    return Coding(cuts, coded)


def coded(df: DataFrame, inputs: list[str], coding: Coding, label: str, weight: str) -> DataFrame:
    """The rows as training sees them: a hash of the key, the label, the weight in units, and the codes."""
    packed = df.select(F.xxhash64(ID).alias("h"), F.col(label).cast("int").alias("y"),
                       F.round(F.col(weight) * WEIGHT_UNIT).cast("long").alias("w"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(inputs)])

    def run(batches):
        for batch in batches:
            codes = coding.codes([c.to_numpy(zero_copy_only=False) for c in batch.columns[3:]])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _cells(codes)], names=["h", "y", "w", "code"])

    return packed.mapInArrow(run, ROWS)


def _cells(codes: np.ndarray) -> pa.Array:
    """A binary value of each row of codes."""
    ends = np.arange(len(codes) + 1, dtype=np.int32) * np.int32(codes.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(codes))])


def _unpacked(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    h, y, w = (batch[c].to_numpy() for c in ("h", "y", "w"))
    parts = batch["code"].chunks if isinstance(batch["code"], pa.ChunkedArray) else [batch["code"]]
    held = []
    for part in parts:
        if len(part):
            _, ends, cells = part.buffers()
            first, last = np.frombuffer(ends, np.int32)[[part.offset, part.offset + len(part)]]
            held.append(np.frombuffer(cells, np.uint8)[first:last])
    return h.view(np.uint64), y, w, np.concatenate(held).reshape(len(h), -1) if len(h) else np.zeros((0, 1), np.uint8)


def _blocks(batches) -> Iterator[pa.RecordBatch]:
    """Batches of rows as blocks whose margins are zero."""
    for batch in batches:
        if batch.num_rows:
            h, y, w, codes = _unpacked(batch)
            yield _block(h, y.astype(np.int32), w, codes, np.zeros(len(h)))


def _block(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in columns], names=["h", "y", "w", "code", "margin"])


def _opened(batches) -> Iterator[tuple[np.ndarray, ...]]:
    """(h, y, w, codes, margin) of each block."""
    for batch in batches:
        for cells in zip(*(batch[c] for c in ("h", "y", "w", "code", "margin"))):
            h, y, w, codes, margin = (np.frombuffer(c.as_buffer(), t) for c, t in zip(cells, (np.uint64, np.int32, np.int64, np.uint8, float)))
            yield h, y, w, codes.reshape(len(h), -1), margin


def _mix(x: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _salt(seed: int, tree: int, use: int) -> np.uint64:
    return np.uint64(np.random.SeedSequence([seed, tree, use]).generate_state(1, np.uint64)[0])


def _copies(h: np.ndarray, spec: Spec, tree: int) -> np.ndarray:
    """How often each row counts in a tree: its copies in a bag, or whether a boosting round draws it."""
    if spec.boosted and spec.subsample >= 1:
        return np.ones(len(h), np.int64)
    u = (_mix(h ^ _salt(spec.seed, tree, 0)) >> np.uint64(11)) * 2.0**-53
    return (u < spec.subsample).astype(np.int64) if spec.boosted else np.searchsorted(BAG, u, "right").astype(np.int64)


def _terms(spec: Spec, y: np.ndarray, w: np.ndarray, copies: np.ndarray, margin: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Whole-number gradient and curvature of each row: of the logistic loss, or weighted label and weight."""
    if not spec.boosted:
        return y * w * copies, w * copies
    p = np.exp(-margin)
    p += 1.0
    np.divide(1.0, p, out=p)
    scaled = w * float(GRADIENT_UNIT)
    g, c = (y - p) * scaled, p * (1 - p) * scaled
    for x in (g, c):
        np.rint(x, out=x)
    np.maximum(c, 1, out=c)
    for x in (g, c):
        x *= copies
    return g, c


class Growing:
    """A tree and its open nodes."""

    def __init__(self, spec: Spec, tree: int, categorical: np.ndarray, path: int = 1, depth: int = 0):
        self.spec, self.tree, self.categorical, self.depth = spec, tree, categorical, depth
        self.nodes = np.zeros(1, NODE)
        self.nodes["feature"] = -1
        self.open, self.paths = np.zeros(1, np.int64), np.array([path], np.uint64)

    def picks(self) -> np.ndarray:
        """The inputs that each open node tries."""
        width = len(self.categorical)
        if self.spec.picks >= width:
            return np.tile(np.arange(width), (len(self.open), 1))
        at = np.zeros(len(self.open), np.uint64) if self.spec.boosted else self.paths
        with np.errstate(over="ignore"):
            drawn = _mix(_mix(at ^ _salt(self.spec.seed, self.tree, 1))[:, None] + np.arange(width, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return np.sort(np.argsort(drawn, axis=1, kind="stable")[:, : self.spec.picks], axis=1)

    def best(self, sums: np.ndarray, picks: np.ndarray):
        """Of histograms (node, pick, bin, [g, h, n]): gain, pick, bins that go left, and the left and all sums of each node.
        Without n, h stands for it, as a row of a boosting has a curvature of one unit at least."""
        l2, cat = self.spec.l2 * WEIGHT_UNIT * GRADIENT_UNIT, self.categorical[picks]
        order = None
        if cat.any():  # levels by their mean, empty ones last; ordered inputs as they are
            mean = np.where(sums[..., -1] > 0, sums[..., 0] / np.maximum(sums[..., 1] + l2, 1), np.inf)
            order = np.where(cat[..., None], np.argsort(mean, axis=2, kind="stable"), np.arange(BINS))
            sums = np.take_along_axis(sums, order[..., None], axis=2)
        left = np.cumsum(sums, axis=2)
        total = left[:, 0, -1]
        left = left[:, :, :-1]
        right = total[:, None, None] - left
        least = max(self.spec.min_rows, 1)
        fits = (left[..., -1] >= least) & (right[..., -1] >= least)
        power = lambda s: s[..., 0] ** 2 / np.maximum(s[..., 1] + l2, 1e-300)
        score = np.where(fits, power(left) + power(right), -np.inf).reshape(len(sums), -1)
        place = score.argmax(axis=1)
        pick, cut = np.divmod(place, BINS - 1)
        nodes = np.arange(len(sums))
        gain = score[nodes, place] - power(total)
        if order is None:
            mask = (np.uint64(2) << cut.astype(np.uint64)) - np.uint64(1)
        else:
            bits = np.uint64(1) << order[nodes, pick].astype(np.uint64)
            mask = np.bitwise_or.reduce(np.where(np.arange(BINS) <= cut[:, None], bits, np.uint64(0)), axis=1)
        return gain, pick, mask, left[nodes, pick, cut], total

    def advance(self, found) -> np.ndarray:
        """Split the open nodes that gain; their children are open next. Returns which of them split."""
        spec, (gain, feature, mask, left, total) = self.spec, found
        unit = WEIGHT_UNIT * GRADIENT_UNIT if spec.boosted else 1.0
        least = np.maximum(2 * spec.min_gain * unit if spec.boosted else spec.min_gain * total[:, 1] / 2, 1e-9 * np.maximum(total[:, 1], 1))
        splits = (gain > least) & (self.depth < spec.depth)
        self._set(self.open, total)
        parents, base = self.open[splits], len(self.nodes)
        grown = np.zeros(2 * len(parents), NODE)
        grown["feature"] = -1
        self.nodes = np.concatenate([self.nodes, grown])
        self.nodes["feature"][parents], self.nodes["mask"][parents] = feature[splits], mask[splits]
        children = base + np.arange(2 * len(parents))
        self.nodes["left"][parents], self.nodes["right"][parents] = children[::2], children[1::2]
        self._set(children[::2], left[splits])
        self._set(children[1::2], total[splits] - left[splits])
        self.paths = np.repeat(self.paths[splits] * np.uint64(2), 2) + np.tile(np.arange(2, dtype=np.uint64), len(parents))
        self.open, self.depth = children, self.depth + 1
        if self.depth >= spec.depth:
            self.open, self.paths = children[:0], self.paths[:0]
        return splits

    def _set(self, at: np.ndarray, sums: np.ndarray) -> None:
        l2 = self.spec.l2 * WEIGHT_UNIT * GRADIENT_UNIT
        self.nodes["value"][at] = self.spec.rate * sums[:, 0] / np.maximum(sums[:, 1] + l2, 1e-300)
        if sums.shape[1] > 2:
            self.nodes["cover"][at] = sums[:, 2]


def route(nodes: np.ndarray, codes: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """The node in which each row of codes ends. The first steps are taken by all rows, a leaf being its own child; the rest
    by those that are not yet in one."""
    at = np.zeros(len(codes), np.int64) if at is None else at
    if not len(codes):
        return at
    leaf = nodes["feature"] < 0
    feature, mask = np.where(leaf, 0, nodes["feature"]).astype(np.int64), nodes["mask"].copy()
    child = np.where(leaf[:, None], np.arange(len(nodes))[:, None], np.column_stack([nodes["right"], nodes["left"]])).astype(np.int64).ravel()
    flat, first = np.ascontiguousarray(codes).ravel(), np.arange(len(codes)) * codes.shape[1]

    def step(here: np.ndarray, first: np.ndarray) -> np.ndarray:
        goes_left = (mask.take(here) >> flat.take(first + feature.take(here)).astype(np.uint64)) & np.uint64(1)
        return child.take(2 * here + goes_left.view(np.int64))

    if len(nodes) == 1:
        return at
    for _ in range(SHARED_STEPS):
        new = step(at, first)
        if (new == at).all():
            return at
        at[:] = new
    rows = np.flatnonzero(~leaf[at])
    while len(rows):
        new = step(at[rows], first[rows])
        at[rows] = new
        rows = rows[~leaf[new]]
    return at


def _sums(slots: np.ndarray, rows: np.ndarray, codes: np.ndarray, picks: np.ndarray, terms: list[np.ndarray], count: int) -> np.ndarray:
    """Histograms (node, pick, bin, term) of `count` nodes over some rows; `slots` names each row's node. Doubles hold the
    whole sums."""
    k, terms = picks.shape[1], [t[rows].astype(float, copy=False) for t in terms]
    out = np.empty((count, k, BINS, len(terms)))
    one = (picks == picks[0]).all()  # all nodes try the same inputs
    paired = k // 2 * 2 if one and count <= PAIRED_NODES and len(rows) > BINS * BINS * count else 0
    if paired:  # one count over the codes of two inputs holds the histograms of both
        base = slots * (BINS * BINS)
        for j in range(0, paired, 2):
            a, b = (codes[:, picks[0, i]][rows] for i in (j, j + 1))
            cell = base + (a.astype(np.uint16) * np.uint16(BINS) + b)
            for i, term in enumerate(terms):
                both = np.bincount(cell, term, count * BINS * BINS).reshape(count, BINS, BINS)
                out[:, j, :, i], out[:, j + 1, :, i] = both.sum(axis=2), both.sum(axis=1)
    base = slots * BINS
    for j in range(paired, k):
        cell = base + (codes[:, picks[0, j]][rows] if one else codes[rows, picks[slots, j]])
        for i, term in enumerate(terms):
            out[:, j, :, i] = np.bincount(cell, term, count * BINS).reshape(count, BINS)
    return out


def grow(growing: Growing, codes: np.ndarray, terms: list[np.ndarray], rows: np.ndarray | None = None) -> np.ndarray:
    """Finish a tree from all of its rows, or some of those given; returns the leaf of each row (the root, if left out)."""
    at, rows = np.zeros(len(codes), np.int64), np.arange(len(codes)) if rows is None else rows
    codes, terms = np.asfortranarray(codes), [t.astype(float) for t in terms]
    flat, slots = codes.ravel(order="F"), np.zeros(len(rows), np.int64)  # each row's place among the open nodes
    while len(growing.open):
        picks, opened, base = growing.picks(), growing.open, len(growing.nodes)
        step, found = max(CELLS // (picks.shape[1] * BINS), 1), []
        if len(picks) > step:
            order = np.argsort(slots, kind="stable")
            rows, slots = rows[order], slots[order]
        for first in range(0, len(picks), step):
            part = slice(*np.searchsorted(slots, [first, first + step])) if len(picks) > step else slice(None)
            here = picks[first : first + step]
            found.append(growing.best(_sums(slots[part] - first, rows[part], codes, here, terms, len(here)), here))
        gain, pick, mask, left, total = (np.concatenate(x) for x in zip(*found))
        feature = picks[np.arange(len(picks)), pick]
        splits = growing.advance((gain, feature, mask, left, total))
        if not splits.all():
            moved = splits.take(slots)
            at[rows[~moved]] = opened[slots[~moved]]
            rows, slots = rows[moved], slots[moved]
        goes_right = 1 - ((mask[:, None] >> np.arange(BINS, dtype=np.uint64)) & np.uint64(1)).astype(np.int64)
        child = (2 * (np.cumsum(splits) - 1)[:, None] + goes_right).ravel()  # by open node and code
        slots = child.take(slots * BINS + flat.take((feature * len(codes)).take(slots) + rows))
        if not len(growing.open):
            at[rows] = base + slots
    return at


class Share:
    """Some or all rows of a boosting, held by one task: codes by input, joint codes of groups of inputs, and margins."""

    def __init__(self, h: np.ndarray, y: np.ndarray, w: np.ndarray, codes: np.ndarray, widths: list[int]):
        self.h, self.y, self.w, self.margin = h, y, w, np.zeros(len(y))
        self.columns = [np.ascontiguousarray(codes[:, j]) for j in range(len(widths))]
        self.groups: list[list[int]] = []
        self.sizes: list[list[int]] = []
        for j in sorted(range(len(widths)), key=lambda j: -widths[j]):  # the widest first, each where it fits
            fits = [i for i, s in enumerate(self.sizes) if int(np.prod(s)) * widths[j] <= GROUP_CELLS]
            if not fits:
                self.groups.append([])
                self.sizes.append([])
            at = fits[0] if fits else -1
            self.groups[at].append(j)
            self.sizes[at].append(widths[j])
        self.packed = []
        for first in range(0, len(self.groups), GROUPS_A_READ):
            cells = np.zeros((len(y), GROUPS_A_READ), np.uint16)
            for i, (inputs, sizes) in enumerate(zip(self.groups[first : first + GROUPS_A_READ], self.sizes[first:])):
                for j, size in zip(inputs, sizes):
                    cells[:, i] = cells[:, i] * np.uint16(size) + self.columns[j]
            self.packed.append(cells.view(complex).ravel())  # 16 bytes that move together

    def histograms(self, nodes: list[np.ndarray], picks: np.ndarray, terms: np.ndarray, counted: bool) -> np.ndarray:
        """(node, pick, bin, [g, h] or [g, h, n]) of some nodes, each given by its rows. Doubles hold the whole sums."""
        out = np.zeros((len(nodes), len(picks), BINS, 3 if counted else 2))
        place, small = {int(j): i for i, j in enumerate(picks)}, []
        for node, rows in enumerate(nodes):
            if len(rows) < GROUPED_ROWS:
                small.append(node)
                continue
            every = len(rows) == len(self.y)
            values, read = terms if every else terms.take(rows), None
            for i, (inputs, sizes) in enumerate(zip(self.groups, self.sizes)):
                if i % GROUPS_A_READ == 0:
                    part = self.packed[i // GROUPS_A_READ]
                    read = (part if every else part.take(rows)).view(np.uint16).reshape(-1, GROUPS_A_READ)
                if not any(j in place for j in inputs):
                    continue
                cell, joint = read[:, i % GROUPS_A_READ].astype(np.intp), np.zeros(int(np.prod(sizes)), complex)
                np.add.at(joint, cell, values)
                joint = joint.reshape(sizes)
                number = np.bincount(cell, minlength=joint.size).reshape(sizes) if counted else None
                for axis, (j, size) in enumerate(zip(inputs, sizes)):
                    if j in place:
                        rest = tuple(a for a in range(len(sizes)) if a != axis)
                        here, own = out[node, place[j], :size], joint.sum(axis=rest)
                        here[:, 0], here[:, 1] = own.real, own.imag
                        if counted:
                            here[:, 2] = number.sum(axis=rest)
        if small:
            rows = np.concatenate([nodes[i] for i in small])
            base = np.repeat(np.arange(len(small)) * BINS, [len(nodes[i]) for i in small])
            values = terms.take(rows)
            for i, j in enumerate(picks):
                cell, own = base + self.columns[j].take(rows), np.zeros(len(small) * BINS, complex)
                np.add.at(own, cell, values)
                out[small, i, :, 0], out[small, i, :, 1] = own.real.reshape(-1, BINS), own.imag.reshape(-1, BINS)
                if counted:
                    out[small, i, :, 2] = np.bincount(cell, minlength=len(own)).reshape(-1, BINS)
        return out

    def halves(self, rows: np.ndarray, feature: int, mask: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows that a split sends left, and the others."""
        codes = self.columns[feature].take(rows)
        if mask & (mask + 1):
            goes_left = ((mask >> np.arange(BINS, dtype=object)) & 1).astype(bool).take(codes)
        else:  # all codes up to one
            goes_left = codes < mask.bit_length()
        return rows.compress(goes_left), rows.compress(~goes_left)


def boost(share: Share, spec: Spec, categorical: np.ndarray, merge: Callable[[np.ndarray], np.ndarray] | None = None) -> list[np.ndarray]:
    """The trees of a boosting. With other shares, `merge` adds up the whole numbers that all of them hold. Of two siblings
    the lighter is counted; the other is exactly its parent less that."""
    trees, counted = [], spec.min_rows > 1
    share.margin[:] = 0.0
    for tree in range(spec.rounds):
        copies = _copies(share.h, spec, tree)
        terms = np.empty(len(copies), complex)
        terms.real, terms.imag = _terms(spec, share.y, share.w, copies, share.margin)
        growing = Growing(spec, tree, categorical)
        picks = growing.picks()[0]
        held = [tuple(np.flatnonzero(x) for x in (copies, copies == 0))]  # drawn and other rows of each open node
        done, light, parents = [], np.zeros(1, np.int64), None
        growing.nodes["cover"] = len(held[0][0])
        while len(held):
            sums = share.histograms([held[i][0] for i in light], picks, terms, counted)
            sums = merge(sums) if merge else sums
            if parents is not None:
                whole = np.empty((len(held), *sums.shape[1:]))
                whole[light], whole[light ^ 1] = sums, parents - sums
                sums = whole
            gain, pick, mask, left, total = growing.best(sums, np.tile(picks, (len(held), 1)))
            feature, opened, base = picks[pick], growing.open, len(growing.nodes)
            splits = growing.advance((gain, feature, mask, left[:, :2], total[:, :2]))  # covers are those of this share for now
            parents = sums[splits]
            light = 2 * np.arange(len(parents)) + (2 * left[splits, 1] > total[splits, 1])
            children = []
            for node, goes_on, (drawn, idle), f, m in zip(opened, splits, held, feature, mask):
                if goes_on:
                    children += list(zip(share.halves(drawn, f, int(m)), share.halves(idle, f, int(m))))
                else:
                    done.append((node, drawn, idle))
            growing.nodes["cover"][base:] = [len(drawn) for drawn, _ in children]
            if not len(growing.open):
                done += [(base + i, *rows) for i, rows in enumerate(children)]
            held = children if len(growing.open) else []
        if tree < spec.rounds - 1:
            for node, drawn, idle in done:
                share.margin[drawn] += growing.nodes["value"][node]
                share.margin[idle] += growing.nodes["value"][node]
        trees.append(growing.nodes)
    if merge and trees:
        covers = merge(np.concatenate([nodes["cover"] for nodes in trees]))
        for nodes, cover in zip(trees, np.split(covers, np.cumsum([len(nodes) for nodes in trees])[:-1])):
            nodes["cover"] = cover
    return trees


def grow_ensemble(spec: Spec, trees: range, categorical: np.ndarray, widths: list[int], h, y, w, codes) -> Iterator[np.ndarray]:
    """Trees of an ensemble whose rows are all here: every round of a boosting, or some trees of a forest."""
    if spec.boosted:
        yield from boost(Share(h, y, w, codes, widths), spec, categorical)
        return
    columns = np.asfortranarray(codes)
    for tree in trees:
        copies = _copies(h, spec, tree)
        growing = Growing(spec, tree, categorical)
        grow(growing, columns, [*_terms(spec, y, w, copies, None), copies], np.flatnonzero(copies))
        yield growing.nodes


def fit_many(rows: DataFrame, specs: list[Spec], coding: Coding, local_rows: int = LOCAL_ROWS) -> list[list[np.ndarray]]:
    """The trees of each ensemble on the same coded rows, all on the driver: for ensembles that are known to be small."""
    return held(grow_table(rows, specs, coding, local_rows), specs)


def grow_table(rows: DataFrame, specs: list[Spec], coding: Coding, local_rows: int = LOCAL_ROWS) -> DataFrame | None:
    """A staged table (which, tree, nodes) of the trees of each ensemble, all on the same coded rows (a staged table); none
    without rows. Ensembles whose rows fit a task are grown side by side, forests in blocks of trees; else one after another
    on Spark. A forest's trees never meet on the driver."""
    total, categorical, widths, spark = rows.count(), coding.categorical(), coding.widths(), rows.sparkSession
    if not total:
        return None
    if total > local_rows:
        parts, slots = [], _slots(spark)
        boosted = {i: s for i, s in enumerate(specs) if s.boosted and s.rounds} if total <= HELD_SHARE * local_rows * slots else {}
        together = _boost_together(rows, boosted, coding, slots) if boosted else None
        if together is not None:
            parts.append(together)
        for i, s in enumerate(specs):
            if together is not None and i in boosted:
                continue
            if s.boosted:
                made = [(i, t, nodes.tobytes()) for t, nodes in enumerate(_boost(rows, s, categorical, local_rows))]
                parts.append(stage(spark.createDataFrame(made, TREES), "trees"))
            else:
                parts += _forest(rows, s, i, categorical, local_rows)
        return reduce(DataFrame.unionByName, parts)
    parallel = spark.sparkContext.defaultParallelism
    jobs = []
    for i, s in enumerate(specs):
        step = s.rounds if s.boosted else max(ceil(s.rounds / (2 * parallel)), 1)
        jobs += [(i, range(first, min(first + step, s.rounds))) for first in range(0, s.rounds, step)]

    def run(key, table):
        job = key[0].as_py()
        which, numbers = jobs[job]
        order = table.sort_by([("h", "ascending"), ("y", "ascending")])  # margins do not depend on it; equal runs are easier to compare
        return _made([(which, tree, nodes) for tree, nodes in zip(numbers, grow_ensemble(specs[which], numbers, categorical, widths, *_unpacked(order)))])

    dealt = rows.withColumn("job", F.explode(F.sequence(F.lit(0), F.lit(len(jobs) - 1)))).repartitionById(len(jobs), "job")
    return stage(dealt.groupBy("job").applyInArrow(run, TREES), "trees")


def _made(trees: list[tuple[int, int, np.ndarray]]) -> pa.Table:
    which, tree, nodes = zip(*trees) if trees else ((), (), ())
    return pa.table({"which": pa.array(which, pa.int32()), "tree": pa.array(tree, pa.int32()),
                     "nodes": pa.array([n.tobytes() for n in nodes], pa.binary())})


def held(table: DataFrame | None, specs: list[Spec]) -> list[list[np.ndarray]]:
    """The trees of a table that the caller knows to be small."""
    grown: list[list] = [[None] * s.rounds if table is not None else [] for s in specs]
    for r in table.collect() if table is not None else []:
        grown[r["which"]][r["tree"]] = np.frombuffer(bytes(r["nodes"]), NODE)
    return grown


@dataclass
class Stored:
    """Ensembles too large for one process: a staged table of trees, the number of their blocks, and rounds by ensemble."""

    table: DataFrame
    blocks: int
    rounds: list[int]

    def of(self, which: int) -> Stored:
        """One of the ensembles, as number 0."""
        rows = self.table.where(F.col("which") == which).withColumn("which", F.lit(0))
        return Stored(rows, self.blocks, [self.rounds[which]])


def together(stored: list[Stored]) -> Stored:
    """Several ensembles of one fit, numbered in this order."""
    tables = [s.table.withColumn("which", F.lit(i)) for i, s in enumerate(stored)]
    return Stored(reduce(DataFrame.unionByName, tables), stored[0].blocks, [s.rounds[0] for s in stored])


def grown(rows: DataFrame, specs: list[Spec], coding: Coding, most: int | None = None) -> list[list[np.ndarray]] | Stored:
    """The trees of each ensemble: on the driver up to `most` bytes of all together, else in a table."""
    table = grow_table(rows, specs, coding)
    sizes = [] if table is None else table.select("which", "tree", F.length("nodes").alias("n")).orderBy("which", "tree").collect()  # a number per tree
    if sum(r["n"] for r in sizes) <= (HELD_BYTES if most is None else most):
        return held(table, specs)
    dealt, block, size = [], -1, BLOCK_BYTES
    for r in sizes:
        if size + r["n"] > BLOCK_BYTES:
            block, size = block + 1, 0
        size += r["n"]
        dealt.append((r["which"], r["tree"], block))
    numbers = rows.sparkSession.createDataFrame(dealt, "which int, tree int, block int")
    return Stored(table.join(F.broadcast(numbers), ["which", "tree"]), block + 1, [s.rounds for s in specs])


def add_stored(rows: DataFrame, columns: list[Column], coding: Coding, stored: Stored, width: int, add, part_rows: int = PART_ROWS) -> DataFrame:
    """The rows with `_v`: `width` sums over all trees of a table. `add(which, nodes, codes, out)` adds a tree's values of rows of
    codes to `out` (width x rows). Blocks of trees meet parts of rows in tasks; partial sums are added in the order of the
    blocks. Rows get a number of their own, since keys may repeat."""
    spark = rows.sparkSession
    keyed = stage(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    parts, inputs = max(ceil(keyed.count() / part_rows), 1), len(columns)

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                ids = batch["_row"].to_numpy()
                codes = coding.codes([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
                part = int(_mix(ids[:1].view(np.uint64))[0] % np.uint64(parts))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array(ids[:1]), pa.array([ids.tobytes()], pa.binary()),
                                                  pa.array([codes.tobytes()], pa.binary())], names=["part", "start", "ids", "code"])

    def run(key, left, right):
        if not left.num_rows:
            return pa.table({"block": pa.array([], pa.int32()), "start": pa.array([], pa.int64()), "ids": pa.array([], pa.binary()), "sums": pa.array([], pa.binary())})
        codes = [np.frombuffer(c, np.uint8).reshape(-1, inputs) for c in left["code"].to_pylist()]
        ends, codes = np.cumsum([len(c) for c in codes])[:-1], np.concatenate(codes)
        out = np.zeros((width, len(codes)))
        for row in right.sort_by([("which", "ascending"), ("tree", "ascending")]).to_batches(1):
            add(row["which"][0].as_py(), np.frombuffer(row["nodes"][0].as_buffer(), NODE), codes, out)
        return pa.table({"block": pa.array([key[0].as_py()] * left.num_rows, pa.int32()), "start": left["start"], "ids": left["ids"],
                         "sums": pa.array([np.ascontiguousarray(x).tobytes() for x in np.split(out, ends, axis=1)], pa.binary())})

    def total(key, table):
        table = table.sort_by("block")
        ids = np.frombuffer(table["ids"][0].as_py(), np.int64)
        out = np.zeros((width, len(ids)))
        for sums in table["sums"].to_pylist():
            out += np.frombuffer(sums).reshape(width, -1)
        return pa.table({"_row": pa.array(ids), "_v": pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * width), pa.array(out.T.ravel()))})

    packed = keyed.select("_row", *[c.cast("double").alias(f"x{i}") for i, c in enumerate(columns)]).mapInArrow(pack, "part int, start long, ids binary, code binary")
    each = lambda df, name, n: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).groupBy("block", "part")
    partial = each(packed, "block", stored.blocks).cogroup(each(stored.table, "part", parts)).applyInArrow(run, "block int, start long, ids binary, sums binary")
    summed = stage(partial.groupBy("start").applyInArrow(total, "_row long, _v array<double>"), "sums")
    return keyed.join(summed, "_row").drop("_row")


def add_votes(which: int, nodes: np.ndarray, codes: np.ndarray, out: np.ndarray) -> None:
    out[which] += nodes["value"][route(nodes, codes)]


def stored_probabilities(rows: DataFrame, columns: list[Column], coding: Coding, stored: Stored, boosted: list[bool], name: str) -> DataFrame:
    """The rows with an array of probabilities, one of each ensemble in the table."""
    scored = add_stored(rows, columns, coding, stored, len(boosted), add_votes)
    each = [F.lit(1.0) / (F.lit(1.0) + F.exp(-F.get("_v", F.lit(i)))) if b else F.get("_v", F.lit(i)) / F.lit(float(max(stored.rounds[i], 1)))
            for i, b in enumerate(boosted)]
    return scored.withColumn(name, F.array(*each)).drop("_v")


def _level(rows: DataFrame, spec: Spec, growing: list[Growing], since: list[np.ndarray]) -> None:
    """Histograms of all open nodes in one pass over the rows, and their splits. `since` are boosting trees that the rows'
    margins lack; those rows are blocks."""
    plan = [(g.tree, g.nodes, g.open, g.picks()) for g in growing]
    firsts = np.cumsum([0, *(p.shape[0] * p.shape[1] * BINS for *_, p in plan)])

    def run(batches):
        held = np.zeros((int(firsts[-1]), 3), np.int64)
        parts = _opened(batches) if spec.boosted else ((*_unpacked(batch), None) for batch in batches)
        for h, y, w, codes, margin in parts:
            for nodes in since:
                margin = margin + nodes["value"][route(nodes, codes)]
            for (tree, nodes, at_open, picks), first in zip(plan, firsts):
                copies = _copies(h, spec, tree)
                g, c = _terms(spec, y, w, copies, margin)
                slot = np.full(len(nodes), -1)
                slot[at_open] = np.arange(len(at_open))
                slots = slot[route(nodes, codes)]
                kept = np.flatnonzero((slots >= 0) & (copies > 0))
                if len(kept):
                    sums = _sums(slots[kept], kept, codes, picks, [g, c, copies], len(picks))
                    held[first : first + sums.size // 3] += sums.reshape(-1, 3).astype(np.int64)
        cells = np.flatnonzero(held[:, 2])
        yield pa.RecordBatch.from_arrays([pa.array(cells), *[pa.array(held[cells, i]) for i in range(3)]], names=["cell", "g", "c", "n"])

    merged = rows.mapInArrow(run, "cell long, g long, c long, n long").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("c").alias("c"), F.sum("n").alias("n"))
    held = np.zeros((int(firsts[-1]), 3))
    sums = merged.toArrow()  # open nodes x inputs x bins, whatever the data
    held[sums["cell"].to_numpy()] = np.column_stack([sums[c].to_numpy() for c in ("g", "c", "n")])
    for g, (_, _, _, picks), first, last in zip(growing, plan, firsts, firsts[1:]):
        gain, pick, *rest = g.best(held[first:last].reshape(*picks.shape, BINS, 3), picks)
        g.advance((gain, picks[np.arange(len(picks)), pick], *rest))


#: A barrier stage takes all slots, so one runs at a time.
_barrier = Lock()
#: Seconds between looks for a file of another task, and those after which a task no longer waits for it.
LOOK, PATIENCE = 0.0005, 1_800.0


class Meeting:
    """Tasks that run at once add up numbers by files in a folder that all of them can open."""

    def __init__(self, folder: str, me: int, tasks: int):
        self.folder, self.me, self.tasks, self.turn = folder, me, tasks, 0

    def merge(self, mine: np.ndarray) -> np.ndarray:
        """The sum of the whole numbers of all tasks. Who has read all files of a turn knows that its own one of the last was read."""
        self.turn += 1
        total = mine.astype(np.int64)
        own = self._path(self.turn, self.me)
        with open(f"{own}.tmp", "wb") as f:
            f.write(total.tobytes())
        os.replace(f"{own}.tmp", own)
        for other in range(self.tasks):
            if other != self.me:
                total += np.frombuffer(self._read(self._path(self.turn, other)), np.int64).reshape(mine.shape)
        if self.turn > 1:
            os.remove(self._path(self.turn - 1, self.me))
        return total.astype(float)

    def _path(self, turn: int, task: int) -> str:
        return os.path.join(self.folder, f"{turn}-{task}")

    def _read(self, path: str) -> bytes:
        until = time.monotonic() + PATIENCE
        while True:
            try:
                with open(path, "rb") as f:
                    return f.read()
            except FileNotFoundError:
                if time.monotonic() > until:
                    raise
                time.sleep(LOOK)


def _met(folder: str, context: BarrierTaskContext) -> Meeting | None:
    """The meeting of a stage's tasks, unless one of them does not see the files of all others."""
    me, names = context.partitionId(), context.allGather(uuid.uuid4().hex)
    here, tasks = os.path.join(folder, names[0]), len(names)  # another one in each attempt of the stage
    try:
        os.makedirs(here, exist_ok=True)
        with open(os.path.join(here, f"here-{me}"), "wb"):
            pass
    except OSError:
        pass
    context.barrier()
    seen = all(os.path.exists(os.path.join(here, f"here-{i}")) for i in range(tasks))
    return Meeting(here, me, tasks) if all(s == "1" for s in context.allGather(str(int(seen)))) else None


def _slots(spark: SparkSession) -> int:
    """The tasks that run at once; none where their number may change, which a barrier stage does not bear."""
    context = spark.sparkContext._jsc.sc()
    if context.getConf().getBoolean("spark.dynamicAllocation.enabled", False):
        return 0
    return context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile())


def _boost_together(rows: DataFrame, specs: dict[int, Spec], coding: Coding, slots: int) -> DataFrame | None:
    """A staged table of the trees of boostings, grown by `slots` tasks at once. All of them add up the same numbers, so
    each grows every tree, and the first returns them. None if tasks cannot open the shared folder."""
    categorical, widths, spark = coding.categorical(), coding.widths(), rows.sparkSession
    folder = new_folder(spark, "meeting")
    at = local_path(spark, folder)
    if at is None:
        return None

    def run(batches):
        context = BarrierTaskContext.get()
        parts = [_unpacked(batch) for batch in batches if batch.num_rows]
        h, y, w = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t) for i, t in enumerate((np.uint64, np.int32, np.int64)))
        codes = np.concatenate([p[3] for p in parts]) if parts else np.zeros((0, len(widths)), np.uint8)
        del parts
        meeting = _met(at, context)
        if meeting:
            share = Share(h, y, w, codes, widths)
            del codes
            for which, spec in specs.items():
                trees = boost(share, spec, categorical, meeting.merge)
                if meeting.me == 0:
                    yield from _made([(which, tree, nodes) for tree, nodes in enumerate(trees)]).to_batches()

    try:
        with _barrier:
            made = stage(rows.repartition(slots).mapInArrow(run, TREES, barrier=True), "trees")
    finally:
        discard(spark, folder)
    return None if made.isEmpty() else made


def _boost(rows: DataFrame, spec: Spec, categorical: np.ndarray, local_rows: int) -> list[np.ndarray]:
    trees: list[np.ndarray] = []
    spark, since, path = rows.sparkSession, [], None
    rows = rows.mapInArrow(_blocks, BLOCKS)
    for tree in range(spec.rounds):
        if path is None or len(since) == REFRESH:
            before, path = path, new_folder(spark, "margins")
            (_with_margin(rows, since) if since else rows).write.parquet(path)
            rows, since = spark.read.schema(BLOCKS).parquet(path), []
            if before:
                discard(spark, before)  # no later round reads it
        growing = Growing(spec, tree, categorical)
        while len(growing.open):
            _level(rows, spec, [growing], since)
        trees.append(growing.nodes)
        since = [*since, growing.nodes]
    if path:
        discard(spark, path)
    return trees


def _with_margin(rows: DataFrame, since: list[np.ndarray]) -> DataFrame:
    def run(batches):
        for h, y, w, codes, margin in _opened(batches):
            for nodes in since:
                margin = margin + nodes["value"][route(nodes, codes)]
            yield _block(h, y, w, codes, margin)

    return rows.mapInArrow(run, BLOCKS)


def _forest(rows: DataFrame, spec: Spec, which: int, categorical: np.ndarray, local_rows: int) -> list[DataFrame]:
    """A staged table a group of trees: levels on Spark while an open node holds more rows than a task may, then its rows meet."""
    out = []
    for first in range(0, spec.rounds, TREES_AT_ONCE):
        group = [Growing(spec, t, categorical) for t in range(first, min(first + TREES_AT_ONCE, spec.rounds))]
        ready: list[list] = [[] for _ in group]
        while any(len(g.open) for g in group):
            busy = [g for g in group if len(g.open)]
            _level(rows, spec, busy, [])
            for g, done in zip(group, ready):
                large = g.nodes["cover"][g.open] > local_rows
                done += [(int(n), int(p), g.depth) for n, p in zip(g.open[~large], g.paths[~large])]
                g.open, g.paths = g.open[large], g.paths[large]
        out.append(stage(_finish(rows, spec, which, categorical, group, ready), "trees"))
    return out


def _finish(rows: DataFrame, spec: Spec, which: int, categorical: np.ndarray, group: list[Growing], ready: list[list]) -> DataFrame:
    """The trees (which, tree, nodes): the subtrees of all ready nodes grow each in a task of its own, and those of a tree meet
    in one, where they are grafted."""
    plan = [(g.tree, g.nodes, {n: p for n, p, _ in done}) for g, done in zip(group, ready)]
    depths = {(g.tree, p): d for g, done in zip(group, ready) for _, p, d in done}
    tops = {g.tree: (g.nodes, [(n, p) for n, p, _ in done]) for g, done in zip(group, ready)}

    def deal(batches):
        for batch in batches:
            h, codes = batch["h"].to_numpy().view(np.uint64), _unpacked(batch)[3]
            for tree, nodes, paths in plan:
                at, copies = route(nodes, codes), _copies(h, spec, tree)
                kept = np.flatnonzero(np.isin(at, list(paths)) & (copies > 0))
                if len(kept):
                    part = batch.take(pa.array(kept))
                    path = pa.array([paths[n] for n in at[kept].tolist()], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kept), tree, np.int32)), path, *[part[c] for c in ("h", "y", "w", "code")]],
                                                     names=["tree", "path", "h", "y", "w", "code"])

    def run(key, table):
        tree, path = (k.as_py() for k in key)
        h, y, w, codes = _unpacked(table)
        copies = _copies(h, spec, tree)
        growing = Growing(spec, tree, categorical, path, depths[tree, path])
        grow(growing, codes, [*_terms(spec, y, w, copies, None), copies])
        return pa.table({"tree": pa.array([tree], pa.int32()), "path": pa.array([path], pa.int64()), "nodes": pa.array([growing.nodes.tobytes()], pa.binary())})

    def graft(key, table):
        tree = key[0].as_py()
        top, done = tops[tree]
        place = {p: i for i, p in enumerate(table["path"].to_pylist())}
        made, size = [top.copy()], len(top)
        for node, path in done:
            sub = np.frombuffer(table["nodes"][place[path]].as_py(), NODE).copy()
            inner = sub["feature"] >= 0
            for side in ("left", "right"):
                sub[side][inner] += size - 1
            made[0][node] = sub[0]
            made.append(sub[1:])
            size += len(sub) - 1
        return _made([(which, tree, np.concatenate(made))])

    spark = rows.sparkSession
    whole = [(which, g.tree, g.nodes.tobytes()) for g, done in zip(group, ready) if not done]
    out = spark.createDataFrame(whole, TREES)
    if depths:
        dealt = rows.mapInArrow(deal, "tree int, path long, " + ROWS)
        pieces = dealt.groupBy("tree", "path").applyInArrow(run, "tree int, path long, nodes binary")
        out = out.unionByName(pieces.groupBy("tree").applyInArrow(graft, TREES))
    return out


def probability(columns: list[Column], coding: Coding, trees: list[np.ndarray], boosted: bool, spark) -> Column:
    """The probability of failure of rows with these inputs; NULL never."""
    return F.get(probabilities(columns, coding, [trees], [boosted], spark), F.lit(0))


def probabilities(columns: list[Column], coding: Coding, ensembles: list[list[np.ndarray]], boosted: list[bool], spark) -> Column:
    """An array with a probability from each of several ensembles over the same coding: rows are coded once."""
    shared = spark.sparkContext.broadcast((coding.cuts, coding.levels, ensembles))

    @F.arrow_udf("array<double>")
    def score(rows: pa.Array) -> pa.Array:
        cuts, levels, models = shared.value
        codes = Coding(cuts, levels).codes([c.to_numpy(zero_copy_only=False) for c in rows.flatten()])
        out = np.zeros((len(codes), len(models)))
        for i, trees in enumerate(models):
            for nodes in trees:
                out[:, i] += nodes["value"][route(nodes, codes)]
            out[:, i] = 1.0 / (1.0 + np.exp(-out[:, i])) if boosted[i] else out[:, i] / max(len(trees), 1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * len(models)), pa.array(out.ravel()))

    return score(F.struct(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(columns)]))
