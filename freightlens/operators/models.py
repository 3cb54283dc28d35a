"""Classifiers behind one small interface: fit on a training table, score any table. Trees are this package's histogram
trees, logistic models take Newton steps over sums of Spark tasks."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from dataclasses import dataclass, field, replace
from functools import reduce
from math import ceil, isqrt

import numpy as np
from pyspark.sql import DataFrame, functions as F

from freightlens.functions.scalars import add_all, ratio
from freightlens.operators import balance, features, linear, trees
from freightlens.operators.folds import hashed_order, stratified_folds
from freightlens.session import stage
from freightlens.sources.shipments import ID, TARGET


@dataclass(frozen=True)
class Settings:
    """Learner settings; `kind` picks the estimator, the rest follow the usual names."""

    kind: str = "gbt"
    rounds: int = 300
    depth: int = 6
    rate: float = 0.1
    subsample: float = 0.8
    feature_share: str = "0.8"
    min_rows: int = 1
    min_gain: float = 0.0
    leaf_penalty: float = 1.0
    categorical: bool = False
    encode: bool = False
    seed: int = 42
    grid: tuple[float, ...] = (0.001, 0.01, 0.1, 1.0, 10.0)


# The default settings of each model. Forest depth is unbounded; 30 stands for that.
PRESETS = {
    "gbt_a": Settings(),
    "gbt_b": Settings(depth=5, categorical=True),
    "gbt_c": Settings(subsample=1.0, feature_share="all", encode=True),
    "random_forest": Settings("forest", 500, 30, subsample=1.0, feature_share="auto"),
    "logistic_reg": Settings("logistic", 1000),
}
# Ranges of the search, one per preset; learning rates are drawn on a logarithmic scale. Leaf counts of
# 15 to 63 are depths of 4 to 6 here.
SEARCH_SPACES = {
    "gbt_a": {"depth": (3, 10), "rate": (0.01, 0.3), "rounds": (100, 1000), "subsample": (0.6, 1.0), "feature_share": (0.6, 1.0),
              "min_rows": (1, 10), "min_gain": (0.0, 5.0)},
    "gbt_b": {"depth": (4, 6), "rate": (0.01, 0.3), "rounds": (100, 1000), "subsample": (0.6, 1.0), "feature_share": (0.6, 1.0), "min_rows": (5, 50)},
    "gbt_c": {"depth": (4, 10), "rate": (0.01, 0.3), "rounds": (100, 1000)},
}
#: Independent folds that are fitted at once.
FOLDS_AT_ONCE = 5


@dataclass
class TreeModel:
    """Trees as flat arrays, or in a table if they are too large for one process, and the coding of inputs that they read."""

    coding: trees.Coding
    trees: list[np.ndarray] | trees.Stored
    boosted: bool


@dataclass
class Fitted:
    """A trained model; `score` adds the probability of failure as a column."""

    settings: Settings
    inputs: list[str]
    model: object
    stats: dict = field(default_factory=dict)
    encoding: dict = field(default_factory=dict)

    def ready(self, df: DataFrame) -> DataFrame:
        """The rows with all inputs of the model."""
        return _encode_with(df, self.encoding) if self.encoding else df

    def score(self, df: DataFrame, name: str = "p") -> DataFrame:
        keep = [c for c in df.columns if c != name]
        if isinstance(self.model, TreeModel):
            if isinstance(self.model.trees, trees.Stored):
                columns = [F.col(c) for c in self.inputs]
                scored = trees.stored_probabilities(self.ready(df), columns, self.model.coding, self.model.trees, [self.model.boosted], "_p")
                return scored.select(*keep, F.get("_p", F.lit(0)).alias(name))
            value = trees.probability([F.col(c) for c in self.inputs], self.model.coding, self.model.trees, self.model.boosted, df.sparkSession)
            return self.ready(df).select(*keep, value.alias(name))
        rows = self.ready(df)
        scaled = {c: (F.col(c) - F.lit(self.stats[c][0])) / F.lit(self.stats[c][1] or 1.0) if self.stats else F.col(c) for c in self.inputs}
        known = [F.coalesce(v.cast("double"), F.lit(float("nan"))) * F.lit(self.model.weights[c]) for c, v in scaled.items()]
        margin = add_all([F.lit(self.model.intercept), *known])
        return rows.select(*keep, (F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))).alias(name))


def target_encode(df: DataFrame, columns: list[str], fold: str = "fold", label: str = TARGET, strength: float = 10.0) -> DataFrame:
    """Add `<column>_te`: out-of-fold mean label per category, shrunk to the overall mean of the other folds.

    Sums per (category, fold) are combined map-side; each row then meets total minus own fold, so
    its own label never enters its code.
    """
    out = df
    for column in columns:
        out = out.join(_fold_codes(df, column, fold, label, strength), [column, fold])
    return out


def _fold_codes(df: DataFrame, column: str, fold: str, label: str, strength: float) -> DataFrame:
    cells = df.groupBy(column, fold).agg(F.count("*").alias("n"), F.sum(label).alias("s"))
    per_level = cells.groupBy(column).agg(F.sum("n").alias("n_all"), F.sum("s").alias("s_all"))
    per_fold = cells.groupBy(fold).agg(F.sum("n").alias("n_f"), F.sum("s").alias("s_f"))
    whole = per_fold.agg(F.sum("n_f").alias("N"), F.sum("s_f").alias("S"), F.collect_list(F.struct(fold, "n_f", "s_f")).alias("f"))
    prior = whole.select("N", "S", F.inline("f")).select(fold, ratio(F.col("S") - F.col("s_f"), F.col("N") - F.col("n_f")).alias("_prior"))
    n, s = F.col("n_all") - F.col("n"), F.col("s_all") - F.col("s")
    return cells.join(per_level, column).join(F.broadcast(prior), fold).select(
        column, fold, ((s + strength * F.col("_prior")) / (n + strength)).alias(f"{column}_te")
    )


def _fit_encoding(train: DataFrame, columns: list[str], label: str, strength: float = 10.0):
    """Codes for scoring time: shrunk mean label per category of the training rows, as a joinable table."""
    prior = train.agg(F.avg(label)).first()[0] or 0.0
    return {
        c: (stage(train.groupBy(c).agg(((F.sum(label) + strength * prior) / (F.count("*") + strength)).alias(f"{c}_te")), "codes"), prior)
        for c in columns
    }


def _encode_with(df: DataFrame, encoding: dict) -> DataFrame:
    for column, (codes, prior) in encoding.items():
        df = df.join(codes, column, "left").withColumn(f"{column}_te", F.coalesce(f"{column}_te", F.lit(prior)))
    return df


def fit(train: DataFrame, inputs: list[str], settings: Settings, label: str = TARGET, staged: bool = False) -> Fitted:
    """Train on rows with ID, inputs, label and, if present, `weight`; rows that are `staged` are not written again."""
    return fit_all(train, inputs, [settings], label, staged)[0]


def fit_all(train: DataFrame, inputs: list[str], settings: list[Settings], label: str = TARGET, staged: bool = False) -> list[Fitted]:
    """Train several models on the same rows, side by side. Those that read the same inputs in the same form share all
    preparation: codes, bins and coded rows are made once."""
    if "weight" not in train.columns:
        train = balance.with_class_weight(train, label)
        staged = False
    train = train if staged else stage(train.select(ID, *inputs, label, "weight"), "train")
    groups: dict[tuple, list[int]] = {}
    for i, s in enumerate(settings):
        groups.setdefault((s.kind == "logistic" and i, s.encode, s.categorical), []).append(i)

    def one(group: tuple) -> list[tuple[int, Fitted]]:
        (_, encode, categorical), members = group
        rows, used, encoding = _encoded(train, inputs, label) if encode else (train, list(inputs), {})
        if settings[members[0]].kind == "logistic":
            return [(i, _fit_logistic(rows, used, settings[i], label, encoding)) for i in members]
        coding = trees.fit_coding(rows, used, [c for c in features.CATEGORICAL if c in used] if categorical else [])
        coded = stage(trees.coded(rows, used, coding, label, "weight"), "coded")
        specs = [_spec(settings[i], len(used)) for i in members]
        grown = trees.grown(coded, specs, coding)
        each = [grown.of(k) for k in range(len(specs))] if isinstance(grown, trees.Stored) else grown
        return [(i, Fitted(settings[i], used, TreeModel(coding, t, spec.boosted), {}, encoding)) for i, spec, t in zip(members, specs, each)]

    made = dict(pair for pairs in at_once(one, list(groups.items())) for pair in pairs)
    return [made[i] for i in range(len(settings))]


def _spec(s: Settings, width: int) -> trees.Spec:
    if s.kind not in ("gbt", "forest"):
        raise ValueError(f"unknown learner {s.kind!r}")
    boosted = s.kind == "gbt"
    share = {"all": width, "auto": width if boosted else max(isqrt(width), 1)}
    picks = share[s.feature_share] if s.feature_share in share else max(ceil(float(s.feature_share) * width), 1)
    return trees.Spec(boosted, s.rounds, s.depth, picks, s.rate if boosted else 1.0, s.subsample, s.min_rows, s.min_gain,
                      s.leaf_penalty if boosted else 0.0, s.seed)


def _encoded(train: DataFrame, inputs: list[str], label: str) -> tuple[DataFrame, list[str], dict]:
    """Rows whose categories are replaced by out-of-fold codes, the inputs then, and the codes for scoring."""
    columns = [c for c in features.CATEGORICAL if c in inputs]
    folded = stage(stratified_folds(train, 5, hashed_order(), label, name="_fold"), "encode")
    return target_encode(folded, columns, "_fold", label), [f"{c}_te" if c in columns else c for c in inputs], _fit_encoding(train, columns, label)


def _fit_logistic(train: DataFrame, used: list[str], settings: Settings, label: str, encoding: dict) -> Fitted:
    """Ridge logistic regression; of several penalties, the one with the best 3-fold F1 of the failure class."""
    stats = features.fit_standard(train, used)
    rows = features.standardize(train, stats).select(ID, *[F.col(c).cast("double").alias(c) for c in used], F.col(label).cast("double").alias(label), "weight")
    searched = len(settings.grid) > 1
    rows = stage(stratified_folds(rows, 3, hashed_order(), label, name="_cv") if searched else rows.withColumn("_cv", F.lit(0)), "train")
    cells = rows.select(*used, label, "weight", F.col("_cv").cast("double"))
    n = rows.count()
    penalties = [_penalty(c, n) for c in settings.grid]
    best = penalties[0]
    if searched:
        tried = [(fold, penalty) for penalty in penalties for fold in range(3)]
        found = linear.held_out_f1(cells, linear.fit_logits(cells, tried, settings.rounds), [fold for fold, _ in tried])
        best = penalties[int(np.argmax(found.reshape(-1, 3).mean(axis=1)))]
    (intercept, *weights), = linear.fit_logits(cells, [(None, best)], settings.rounds)
    return Fitted(settings, used, linear.LinearModel(float(intercept), dict(zip(used, map(float, weights))), "logistic"), stats, encoding)


def _penalty(c: float, n: int) -> float:
    return 1.0 / (c * max(n, 1))


def draw_settings(base: Settings, trial: int, seed: int = 42, space: dict = SEARCH_SPACES["gbt_a"]) -> Settings:
    """The trial-th random point of the search space."""
    rng, picked = np.random.default_rng([seed, trial]), {}
    for name, (low, high) in space.items():
        if name == "rate":
            value = float(np.exp(rng.uniform(np.log(low), np.log(high))))
        else:
            value = int(rng.integers(low, high + 1)) if isinstance(low, int) else float(rng.uniform(low, high))
        picked[name] = str(round(value, 3)) if name == "feature_share" else value
    return replace(base, **picked)


def trial_objectives(models: list[Fitted], tune: DataFrame, label: str = TARGET, recall_floor: float = 0.95) -> list[float]:
    """F1 at a cut of one half, minus ten when recall misses the floor. Models over the same inputs and bins: rows are coded
    and read once for all of them."""
    first = models[0]
    columns, boosted, grown = [F.col(c) for c in first.inputs], [m.model.boosted for m in models], [m.model.trees for m in models]
    if isinstance(grown[0], trees.Stored):
        rows = first.ready(tune).withColumn("y", F.col(label))
        scored = trees.stored_probabilities(rows, columns, first.model.coding, trees.together(grown), boosted, "p").select("y", "p")
    else:
        values = trees.probabilities(columns, first.model.coding, grown, boosted, tune.sparkSession)
        scored = first.ready(tune).select(F.col(label).alias("y"), values.alias("p"))
    called = lambda i: F.get("p", F.lit(i)) >= 0.5
    row = scored.agg(F.count_if(F.col("y") == 1).alias("all"), *[
        F.count_if(called(i) & (F.col("y") == k)).alias(f"{n}{i}") for i in range(len(models)) for n, k in (("tp", 1), ("fp", 0))]).first()
    out = []
    for i in range(len(models)):
        tp, fp = row[f"tp{i}"], row[f"fp{i}"]
        f1 = 2 * tp / max(tp + fp + row["all"], 1)
        out.append(f1 if tp / max(row["all"], 1) >= recall_floor else f1 - 10.0)
    return out


def random_search(train: DataFrame, tune: DataFrame, inputs: list[str], base: Settings, n_trials: int = 30, seed: int = 42,
                  space: dict = SEARCH_SPACES["gbt_a"], label: str = TARGET) -> tuple[Settings, list[tuple[int, Settings, float]]]:
    """Best settings of `n_trials` random points and the log of all trials, which are fitted and judged together."""
    drawn = [draw_settings(base, trial, seed, space) for trial in range(n_trials)]
    found = trial_objectives(fit_all(train, inputs, drawn, label), stage(tune, "search-tune"), label)
    log = list(zip(range(n_trials), drawn, found))
    return max(log, key=lambda t: t[2])[1], log


def oof_predictions(df: DataFrame, inputs: list[str], settings: dict[str, Settings], n_folds: int = 5, label: str = TARGET) -> DataFrame:
    """(ID, label, fold, p_<name>...): every row scored by models that never saw it. Folds are fitted side by side."""
    rows = stage(stratified_folds(df.select(ID, *inputs, label), n_folds, hashed_order(), label), "oof")

    def one(f: int) -> DataFrame:
        train, test = rows.where(F.col("fold") != f), rows.where(F.col("fold") == f)
        for name, model in zip(settings, fit_all(train, inputs, list(settings.values()), label)):
            test = model.score(test, f"p_{name}")
        return test.select(ID, label, "fold", *[f"p_{n}" for n in settings])

    return reduce(DataFrame.unionByName, at_once(one, range(n_folds)))


def at_once(work, items, most: int = FOLDS_AT_ONCE) -> list:
    """Independent pieces of work in a bounded pool, results in order; each thread sees the caller's staging scope."""
    with ThreadPoolExecutor(most) as pool:
        return [f.result() for f in [pool.submit(copy_context().run, work, x) for x in items]]


@dataclass
class Ensemble:
    """Weighted mean of member probabilities, or a logistic meta-model over them."""

    members: dict[str, Fitted]
    weights: list[float] | None = None
    meta: Fitted | None = None

    def score(self, df: DataFrame, name: str = "p") -> DataFrame:
        keep = df.columns
        for n, m in self.members.items():
            df = m.score(df, f"p_{n}")
        if self.meta:
            return self.meta.score(df, name).select(*keep, name)
        return df.withColumn(name, linear.soft_vote([f"p_{n}" for n in self.members], self.weights)).select(*keep, name)


def fit_vote(train: DataFrame, inputs: list[str], settings: dict[str, Settings], weights=None, label: str = TARGET) -> Ensemble:
    return Ensemble(dict(zip(settings, fit_all(train, inputs, list(settings.values()), label))), weights)


def fit_stacking(train: DataFrame, inputs: list[str], settings: dict[str, Settings], n_folds: int = 5, label: str = TARGET) -> Ensemble:
    """Meta-model on out-of-fold probabilities; members are refitted on all rows."""
    level = stage(oof_predictions(train, inputs, settings, n_folds, label), "level-1")
    meta = fit(level, [f"p_{n}" for n in settings], Settings("logistic", 100, grid=(1.0,)), label)
    return Ensemble(dict(zip(settings, fit_all(train, inputs, list(settings.values()), label))), None, meta)
