"""Exact linear-interpolated quantiles of many columns without one task holding every distinct value."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from freightlens.session import stage

HELD = 2_000_000    # most values that one task gathers, over all columns and probabilities together
ACCURACY = 10_000   # sketch accuracy: rank error at most rows / ACCURACY


def exact_quantiles(
    df: DataFrame, columns: dict[str, Column], probs: list[float], held: int = HELD, staged: bool = False,
) -> dict[str, list[float | None]]:
    """{name: [value per prob]}; missing cells are skipped, an empty column gives None.

    `percentile` would keep a map of all distinct values on one reducer. Here every (column, prob) starts
    with the whole column as its bracket; mergeable sketches narrow brackets to the few values around
    their ranks, counting what lies below, until all that is left fits one budget and is read off
    exactly. The values are written once unless `df` is `staged` already.
    """
    names = list(columns)
    values = df.select(*[columns[n].cast("double").alias(n) for n in names])
    return _bracketed(values if staged else stage(values, "quantiles"), names, probs, held)


def _bracketed(values: DataFrame, names: list[str], probs: list[float], held: int):
    max_held = max(held // max(len(names) * len(probs), 1), 1)
    # one sketch a column, read with the counts, gives the first brackets of all its ranks
    edges = [min(max(p + side * 3.0 / ACCURACY, 0.0), 1.0) for p in probs for side in (-1, 1)]
    first = values.agg(
        *[F.count(n).alias(f"n_{n}") for n in names],
        *[F.min(n).alias(f"lo_{n}") for n in names],
        *[F.max(n).alias(f"hi_{n}") for n in names],
        *[F.percentile_approx(n, F.array(*map(F.lit, edges)), ACCURACY).alias(f"s_{n}") for n in names if edges],
    ).first()
    targets = []
    for n in names:
        count = first[f"n_{n}"]
        for i, p in enumerate(probs):
            if count:
                h = (count - 1) * p
                targets.append({
                    "name": n, "slot": i, "h": h, "r0": math.floor(h), "r1": math.ceil(h),
                    "lo": first[f"lo_{n}"], "hi": first[f"hi_{n}"], "below": 0, "inside": count,
                    "new": tuple(first[f"s_{n}"][2 * i : 2 * i + 2]),
                })
    sketched = True
    while True:
        wide = [t for t in targets if t["inside"] > max_held and t["lo"] < t["hi"]]
        if not wide:
            break
        if not sketched:
            _narrow(values, wide)
        counted = []
        for j, t in enumerate(wide):
            counted += [
                F.count_if(F.col(t["name"]) < F.lit(t["new"][0])).alias(f"below{j}"),
                F.count_if(F.col(t["name"]).between(*t["new"])).alias(f"inside{j}"),
            ]
        seen, moved = values.agg(*counted).first(), False
        for j, t in enumerate(wide):
            below, inside = seen[f"below{j}"], seen[f"inside{j}"]
            if below <= t["r0"] and t["r1"] < below + inside and inside < t["inside"]:
                t["lo"], t["hi"], t["below"], t["inside"] = *t["new"], below, inside
                moved = True
        if not moved and not sketched:
            _halve(values, wide)
        sketched = False
    gathered = [
        F.sort_array(F.collect_list(F.when(_inside(t), F.col(t["name"])))).alias(f"v{j}")
        if t["lo"] < t["hi"] else F.array(F.lit(t["lo"])).alias(f"v{j}")
        for j, t in enumerate(targets)
    ]
    read = [
        F.struct(
            F.get(f"v{j}", F.lit(t["r0"] - t["below"] if t["lo"] < t["hi"] else 0)).alias("a"),
            F.get(f"v{j}", F.lit(t["r1"] - t["below"] if t["lo"] < t["hi"] else 0)).alias("b"),
        ).alias(f"v{j}")
        for j, t in enumerate(targets)
    ]
    out: dict[str, list[float | None]] = {n: [None] * len(probs) for n in names}
    if targets:
        got = values.agg(*gathered).select(*read).first()
        for j, t in enumerate(targets):
            a, b = got[f"v{j}"]
            frac = t["h"] - t["r0"]
            out[t["name"]][t["slot"]] = (1 - frac) * a + frac * b if frac else a
    return out


def _inside(t: dict) -> Column:
    return F.col(t["name"]).between(F.lit(t["lo"]), F.lit(t["hi"]))


def _narrow(values: DataFrame, wide: list[dict]) -> None:
    """Asks a sketch of what is left in each bracket for a closer one."""
    asked = []
    for j, t in enumerate(wide):
        near = (t["r0"] - t["below"]) / t["inside"] - 2.0 / ACCURACY
        far = (t["r1"] + 1 - t["below"]) / t["inside"] + 2.0 / ACCURACY
        pair = F.array(F.lit(min(max(near, 0.0), 1.0)), F.lit(min(max(far, 0.0), 1.0)))
        asked.append(F.percentile_approx(F.when(_inside(t), F.col(t["name"])), pair, ACCURACY).alias(f"b{j}"))
    bounds = values.agg(*asked).first()
    for j, t in enumerate(wide):
        t["new"] = tuple(bounds[f"b{j}"])


def _halve(values: DataFrame, wide: list[dict]) -> None:
    """A value so frequent that sketches cannot narrow its bracket: split the bracket at that value."""
    pivots = values.agg(*[
        F.percentile_approx(F.when(_inside(t), F.col(t["name"])), F.lit((t["r0"] - t["below"] + 0.5) / t["inside"]), ACCURACY)
        .alias(f"p{j}") for j, t in enumerate(wide)
    ]).first()
    counts = []
    for j, t in enumerate(wide):
        c, p = F.col(t["name"]), F.lit(pivots[f"p{j}"])
        counts += [F.count_if(c < p).alias(f"lt{j}"), F.count_if(c <= p).alias(f"le{j}"),
                   F.max(F.when(_inside(t) & (c < p), c)).alias(f"prev{j}"),
                   F.min(F.when(_inside(t) & (c > p), c)).alias(f"next{j}")]
    got = values.agg(*counts).first()
    for j, t in enumerate(wide):
        p, lt, le = pivots[f"p{j}"], got[f"lt{j}"], got[f"le{j}"]
        if t["r1"] < lt:
            t["hi"], t["inside"] = got[f"prev{j}"], lt - t["below"]
        elif t["r0"] >= le:
            t["lo"], t["inside"], t["below"] = got[f"next{j}"], t["inside"] - (le - t["below"]), le
        elif t["r0"] >= lt and t["r1"] < le:
            t["lo"] = t["hi"] = p
            t["below"], t["inside"] = lt, le - lt
        else:  # the two order statistics sit on both sides of the pivot: they are neighbours, keep them as values
            low = got[f"prev{j}"] if t["r0"] < lt else p
            high = p if t["r1"] < le else got[f"next{j}"]
            frac = t["h"] - t["r0"]
            t["lo"] = t["hi"] = (1 - frac) * low + frac * high
            t["h"], t["r1"] = float(t["r0"]), t["r0"]
            t["inside"] = 1
