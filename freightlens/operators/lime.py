"""Local surrogate explanations from one shared sample of perturbed shipments, scored with any model.

A perturbed copy draws a bin for each feature (the quartile of a continuous one, the level of a categorical one) from
training frequencies, and a value within it; neither depends on the row that is explained, only the pattern of bins that
the copy shares with the row does. So `samples` copies are drawn and scored once for all rows. They are a table of bin
numbers and predictions, of a size that the caller sets, and each row's weighted ridge is solved from it in one pass. Rows
of a task that fall in the same bins share their sums and differ by their own prediction only; the systems of a batch are
solved together.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist
from typing import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from freightlens.functions.quantiles import exact_quantiles
from freightlens.sources.shipments import ID


#: Patterns of bins whose sums a task keeps.
PATTERNS = 50_000


@dataclass(frozen=True)
class Bins:
    """Per feature: ordered (low, high, share, mean, deviation) of the bins; a level is a bin from its value to itself."""

    continuous: dict[str, list[tuple[float, float, float, float, float]]]
    categorical: dict[str, list[tuple[float, float, float, float, float]]]

    def all(self):
        return {**self.continuous, **self.categorical}


def fit_bins(train: DataFrame, continuous: list[str], categorical: list[str] = (), staged: bool = False) -> Bins:
    """Quartile bins with their training frequencies, and level frequencies (codes, a few per feature)."""
    cuts = exact_quantiles(train, {c: F.col(c) for c in continuous}, [0.0, 0.25, 0.5, 0.75, 1.0], staged=staged)
    made = {}
    for c, q in cuts.items():
        edges = sorted(set(q))
        made[c] = list(zip(edges[:-1], edges[1:])) or [(edges[0], edges[0])]
    inside = lambda c, b, i: F.when(_in_bin(F.col(c), b, i), F.col(c))
    seen = train.agg(F.count("*").alias("n"), *[
        f(inside(c, b, i)).alias(f"{c}__{i}_{k}") for c, bins in made.items() for i, b in enumerate(bins)
        for k, f in (("n", F.count), ("mean", F.avg), ("sd", F.stddev_pop))]).first()
    n = max(seen["n"], 1)
    cont = {c: [(lo, hi, seen[f"{c}__{i}_n"] / n, seen[f"{c}__{i}_mean"] or lo, seen[f"{c}__{i}_sd"] or 0.0) for i, (lo, hi) in enumerate(bins)]
            for c, bins in made.items()}
    cat = {}
    for c in categorical:
        levels = train.groupBy(c).agg(F.count("*").alias("n")).orderBy(c).collect()  # codes of one feature
        cat[c] = [(float(r[0]), float(r[0]), r["n"] / n, float(r[0]), 0.0) for r in levels if r[0] is not None]
    return Bins(cont, cat)


def _in_bin(value: Column, bounds: tuple[float, float], index: int) -> Column:
    low, high = bounds
    return ((value >= low) if index == 0 else (value > low)) & (value <= high)


def _bin_of(value: Column, bins) -> Column:
    out = F.lit(len(bins) - 1)
    for i in range(len(bins) - 2, -1, -1):
        out = F.when(value <= bins[i][1], i).otherwise(out)
    return out


def within(part: tuple, u: float) -> float:
    """The value at probability u of the normal law with the bin's mean and deviation, cut to the bin."""
    low, high, _, mean, deviation = part
    if high <= low or deviation <= 0:
        return float(min(max(mean, low), high))
    law = NormalDist(mean, deviation)
    below, above = law.cdf(low), law.cdf(high)
    inner = below + u * (above - below)
    return float(min(max(law.inv_cdf(inner), low), high)) if 0 < inner < 1 else low + u * (high - low)


def perturb(spark, bins: Bins, samples: int, seed: int = 42) -> DataFrame:
    """(_s, _bins, features...): copies 1 to samples - 1, each drawn from its own number, so a repeated task repeats them."""
    parts = bins.all()
    shares = {c: np.cumsum([p[2] for p in held]) / max(sum(p[2] for p in held), 1e-300) for c, held in parts.items()}

    def draw(batches):
        for pdf in batches:
            rows = []
            for s in pdf["_s"].tolist():
                u = np.random.default_rng([seed, s]).random((len(parts), 2))
                picked = [min(int(np.searchsorted(shares[c], u[j, 0], "right")), len(held) - 1) for j, (c, held) in enumerate(parts.items())]
                rows.append([s, picked, *(within(held[i], u[j, 1]) for j, (i, held) in enumerate(zip(picked, parts.values())))])
            yield pd.DataFrame(rows, columns=["_s", "_bins", *parts])

    numbers = spark.range(1, max(samples, 1)).withColumnRenamed("id", "_s")
    return numbers.mapInPandas(draw, "_s long, _bins array<int>, " + ", ".join(f"`{c}` double" for c in parts))


def explain_rows(rows: DataFrame, bins: Bins, predict: Callable[[DataFrame], DataFrame], samples: int = 5000,
                 top: int = 10, seed: int = 42, ridge: float = 1.0) -> DataFrame:
    """(ID, intercept, local_prediction, contributions): weights of the `top` features around each row.

    `predict` maps a frame of features to the same frame with a probability column `p`. Copy 0 is the row itself. A missing
    value shares no bin with any copy; rows without a prediction have no explanation.
    """
    names = list(bins.all())
    size, width = len(names), 0.75 * np.sqrt(len(names))
    design = predict(perturb(rows.sparkSession, bins, samples, seed)).select("_s", "_bins", "p").where("p IS NOT NULL").orderBy("_s").collect()
    drawn = np.array([r["_bins"] for r in design], np.int16).reshape(-1, size)  # `samples` rows, whatever the data
    found = np.array([r["p"] for r in design], float)
    shared = rows.sparkSession.sparkContext.broadcast((drawn, found))
    codes = F.array(*[F.coalesce(F.when(F.col(c).isNotNull(), _bin_of(F.col(c), parts)), F.lit(-1)) for c, parts in bins.all().items()])
    own = predict(rows.select(ID, *names)).where("p IS NOT NULL").select(ID, "p", codes.alias("codes"))

    def sums_of(pattern: np.ndarray) -> np.ndarray:
        """Weighted sums of products of [1, features kept, prediction] over all copies."""
        drawn, found = shared.value
        kept = (drawn == pattern).astype(float)
        x = np.column_stack([np.ones(len(kept)), kept, found])
        return x.T @ (x * np.exp(-(size - kept.sum(axis=1)) / width**2)[:, None] ** 0.5)

    def solve(batches):
        known: dict[bytes, np.ndarray] = {}  # sums by pattern, for all batches of a task
        for pdf in batches:
            if not len(pdf):
                continue
            held, group = np.unique(np.stack(pdf["codes"].to_numpy()), axis=0, return_inverse=True)
            keys = [p.tobytes() for p in held]
            if len(known) + len(keys) > PATTERNS:
                known.clear()
            for key, p in zip(keys, held):
                if key not in known:
                    known[key] = sums_of(p)
            p = pdf["p"].to_numpy(float)
            itself = np.column_stack([np.ones((len(p), size + 1)), p])  # all features kept: weight one
            m = np.stack([known[k] for k in keys])[np.ravel(group)] + itself[:, :, None] * itself[:, None, :]
            mean, centre = m[:, 0, 1:-1] / m[:, :1, 0], m[:, 0, -1] / m[:, 0, 0]
            xx = m[:, 1:-1, 1:-1] - m[:, 0, 0, None, None] * (mean[:, :, None] * mean[:, None, :])
            xy = m[:, 1:-1, -1] - m[:, 0, :1] * mean * centre[:, None]
            best = np.argsort(-np.abs(_ridges(xx, xy, ridge)), axis=1, kind="stable")[:, :top]
            chosen = np.take_along_axis(np.take_along_axis(xx, best[:, :, None], 1), best[:, None, :], 2)
            coef = _ridges(chosen, np.take_along_axis(xy, best, 1), ridge)
            intercept = centre - (np.take_along_axis(mean, best, 1) * coef).sum(axis=1)
            order = np.argsort(-np.abs(coef), axis=1, kind="stable")
            named, weights = np.array(names, object)[np.take_along_axis(best, order, 1)], np.take_along_axis(coef, order, 1)
            yield pd.DataFrame({ID: pdf[ID], "intercept": intercept, "local_prediction": intercept + coef.sum(axis=1),
                                "feature": list(named), "weight": list(weights)})

    solved = own.mapInPandas(solve, f"{ID} string, intercept double, local_prediction double, feature array<string>, weight array<double>")
    both = F.arrays_zip("feature", "weight")
    return solved.select(ID, "intercept", "local_prediction", F.transform(both, lambda c: F.struct(
        c["feature"].alias("feature"), c["weight"].alias("weight"),
        F.when(c["weight"] > 0, "increases_risk").otherwise("decreases_risk").alias("direction"))).alias("contributions"))


def _ridges(xx: np.ndarray, xy: np.ndarray, penalty: float) -> np.ndarray:
    """Coefficients of each row's centred weighted sums."""
    return np.linalg.solve(xx + penalty * np.eye(xx.shape[-1]), xy[..., None])[..., 0]
