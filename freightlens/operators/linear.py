"""Linear-logistic models: fitting by Newton steps, and scoring and exact attribution as plain column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from freightlens.functions.products import summed
from freightlens.functions.scalars import add_all, snap
from freightlens.sources.shipments import ID


@dataclass(frozen=True)
class LinearModel:
    """p = 1 / (1 + exp(-(intercept + sum(weight * feature))))."""

    intercept: float
    weights: dict[str, float] = field(default_factory=dict)
    version: str = "linear-1"


# Parameters of the demonstration model used by the registered queries.
DEMO = LinearModel(-13.9, {
    "temp_range_c": 0.83, "transit_days": 0.70, "sensor_gap_hours": 0.50,
    "rh_range": 0.40, "vibration_rate": -0.01, "door_opens": 0.05,
})


def _margins(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Margins (row, model) of rows whose leading columns are the inputs; `at` has an intercept and weights a model."""
    return x[:, : at.shape[1] - 1] @ at[:, 1:].T + at[:, 0]


def _curves(rows: DataFrame, at: np.ndarray, folds: list) -> list[tuple[float, float, float, np.ndarray, np.ndarray]]:
    """Per model, over the rows outside its fold: weight, weight of failures, loss, gradient and curvature, in one pass."""
    wide = at.shape[1]
    size = 3 + wide + wide * wide

    def add(x: np.ndarray) -> np.ndarray:
        y, w, fold = x[:, -3], x[:, -2], x[:, -1]
        ahead = np.column_stack([np.ones(len(x)), x[:, :-3]])
        margins, out = _margins(x, at), []
        for i, left_out in enumerate(folds):
            kept = slice(None) if left_out is None else fold != left_out
            a, m, yi, wi = ahead[kept], margins[kept, i], y[kept], w[kept]
            loss = np.maximum(m, 0.0) - yi * m + np.log1p(np.exp(-np.abs(m)))
            p = 1.0 / (1.0 + np.exp(-np.clip(m, -700.0, 700.0)))
            out += [[wi.sum(), wi @ yi, wi @ loss], a.T @ (wi * (p - yi)), ((a * (wi * p * (1.0 - p))[:, None]).T @ a).ravel()]
        return np.concatenate(out)

    got = summed(rows, size * len(folds), add).reshape(len(folds), size)
    return [(g[0], g[1], g[2], g[3 : 3 + wide], g[3 + wide :].reshape(wide, wide)) for g in got]


def fit_logits(rows: DataFrame, problems: list[tuple[int | None, float]], iterations: int = 1000, tol: float = 1e-12) -> np.ndarray:
    """An intercept and weights for each (fold left out or None, penalty): the least mean weighted logistic loss plus half
    the penalty times the squared weights, by Newton steps with halving.

    `rows` are doubles: inputs, label, weight, fold. Each step is one job for all problems, whose results are a few hundred
    numbers a problem. Rows of one class have an infinite intercept.
    """
    wide = len(rows.columns) - 2
    at, way, step = np.zeros((len(problems), wide)), np.zeros((len(problems), wide)), np.ones(len(problems))
    loss, going = np.full(len(problems), np.inf), list(range(len(problems)))
    for _ in range(iterations):
        new = at[going] - step[going, None] * way[going]
        for i, there, (total, failures, sum_loss, slope, bend) in zip(list(going), new, _curves(rows, new, [problems[i][0] for i in going])):
            if not total > 0:
                raise ValueError("no rows to fit a logistic model")
            if np.isnan(sum_loss) or np.isnan(slope).any():
                raise ValueError("a logistic model takes no missing input, label or weight")
            if failures in (0.0, total):
                at[i] = 0.0
                at[i, 0] = np.inf if failures else -np.inf
                going.remove(i)
                continue
            ridge = np.append(0.0, np.full(wide - 1, problems[i][1]))
            here = sum_loss / total + 0.5 * ridge @ there**2
            if here > loss[i] and step[i] > 1e-6:
                step[i] /= 2.0
                continue
            fall = loss[i] - here
            if fall < 0:
                going.remove(i)
                continue
            at[i], loss[i], step[i] = there, here, 1.0
            slope = slope / total + ridge * there
            way[i] = np.linalg.lstsq(bend / total + np.diag(ridge), slope, rcond=None)[0]
            if fall <= tol * here or slope @ way[i] <= tol * here:
                going.remove(i)
        if not going:
            break
    return at


def held_out_f1(rows: DataFrame, at: np.ndarray, folds: list[int]) -> np.ndarray:
    """F1 of the failure class at a cut of one half, of each model on its own fold; 0 where it calls or finds none."""
    def add(x: np.ndarray) -> np.ndarray:
        own = x[:, -1:] == np.array(folds, float)
        called, true = _margins(x, at) > 0, x[:, -3:-2] == 1
        return np.concatenate([(own & called & true).sum(axis=0), (own & called).sum(axis=0), (own & true).sum(axis=0)]).astype(float)

    tp, called, true = summed(rows, 3 * len(folds), add).reshape(3, -1)
    return 2 * tp / np.maximum(called + true, 1)


def margin(model: LinearModel) -> Column:
    return add_all([F.lit(model.intercept)] + [F.col(f) * F.lit(w) for f, w in model.weights.items()])


def probability(model: LinearModel) -> Column:
    return snap(F.lit(1.0) / (F.lit(1.0) + F.exp(-margin(model))))


def score(df: DataFrame, model: LinearModel = DEMO, name: str = "p") -> DataFrame:
    return df.withColumn(name, probability(model))


def soft_vote(columns: list[str], weights: list[float] | None = None) -> Column:
    """Weighted mean of probability columns; weights are normalised."""
    weights = weights or [1.0] * len(columns)
    total = sum(weights)
    return add_all([F.col(c) * F.lit(w / total) for c, w in zip(columns, weights)])


def fit_means(df: DataFrame, model: LinearModel = DEMO) -> dict[str, float]:
    row = df.agg(*[F.avg(f).alias(f) for f in model.weights]).first()
    return {f: row[f] or 0.0 for f in model.weights}


def attributions(model: LinearModel, means: dict[str, float]) -> dict[str, Column]:
    """Attribution per feature in margin units: weight * (value - mean). They sum to margin - mean margin."""
    return {f: snap(F.lit(w) * (F.col(f) - F.lit(means[f]))) for f, w in model.weights.items()}


def contribution_array(values: dict[str, Column]) -> Column:
    """Array of (feature, shap_value, direction), largest effect first, names breaking ties.

    Sorting uses a leading negated size field, so the native array sort applies.
    """
    entries = F.array(*[
        F.struct((-F.abs(v)).alias("k"), F.lit(f).alias("feature"), v.alias("shap_value")) for f, v in values.items()
    ])
    return F.transform(F.sort_array(entries), lambda e: F.struct(
        e["feature"].alias("feature"), e["shap_value"].alias("shap_value"),
        F.when(e["shap_value"] > 0, "increases_risk").otherwise("decreases_risk").alias("direction"),
    ))


def explain(df: DataFrame, means: dict[str, float], model: LinearModel = DEMO, name: str = "contributions") -> DataFrame:
    return df.withColumn(name, contribution_array(attributions(model, means)))


def top_k(contributions: str, k: int = 5) -> Column:
    return F.slice(F.col(contributions), 1, k)


def global_importance(df: DataFrame, means: dict[str, float], model: LinearModel = DEMO) -> DataFrame:
    """Mean absolute attribution per feature, ranked; one wide aggregate, six result rows."""
    wide = df.agg(*[F.avg(F.abs(v)).alias(f) for f, v in attributions(model, means).items()])
    rows = F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), snap(f).alias("mean_abs_shap")) for f in model.weights]))
    return wide.select(rows).orderBy(F.desc("mean_abs_shap"), "feature")


