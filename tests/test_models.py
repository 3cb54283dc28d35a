from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from freightlens.operators import models
from freightlens.session import stage
from freightlens.sources.shipments import ID

INPUTS = ["a", "b"]


@pytest.fixture(scope="module")
def sample(spark):
    """900 rows, two inputs on scales of their own, a label with noise."""
    r = np.random.default_rng(5)
    data = []
    for i in range(900):
        a, b = float(r.normal()), float(100.0 * r.normal())
        data.append((f"k{i}", a, b, int(r.random() < 1.0 / (1.0 + np.exp(-(1.5 * a - 0.01 * b - 0.5))))))
    return stage(spark.createDataFrame(data, f"{ID} string, a double, b double, silent_failure int").repartition(5), "sample")


def test_search_counts_hits_of_every_trial(sample):
    base = models.Settings(rounds=3, depth=2)
    best, log = models.random_search(sample, sample, INPUTS, base, 2, space={"depth": (2, 3)})
    assert best in [s for _, s, _ in log]
    for trial, settings, objective in log:
        assert settings == models.draw_settings(base, trial, 42, {"depth": (2, 3)})
        got = models.fit(sample, INPUTS, settings).score(sample).select(F.col("p") >= 0.5, "silent_failure").collect()
        tp, called, true = sum(c and y for c, y in got), sum(c for c, _ in got), sum(y for _, y in got)
        f1 = 2 * tp / (called + true)
        assert objective == pytest.approx(f1 if tp / true >= 0.95 else f1 - 10.0)
    assert best == max(log, key=lambda t: t[2])[1]
    assert replace(best, depth=2) == base


def test_logistic_models_reach_the_least_loss_in_a_few_passes(sample, monkeypatch):
    """Collinear, almost separable rows: the gradient of the penalised loss vanishes, every fold and penalty side by side."""
    rows = sample.select(ID, "a", (F.col("a") * 20).alias("b"), (F.col("a") + F.col("b") / 1000 > 0).cast("int").alias("silent_failure"), F.lit(1.0).alias("weight"))
    passes, curves = [], models.linear._curves
    monkeypatch.setattr(models.linear, "_curves", lambda *a: passes.append(len(a[2])) or curves(*a))
    fitted = models.fit(rows, INPUTS, models.PRESETS["logistic_reg"])
    assert len(passes) < 100 and max(passes) == 15
    got = fitted.score(rows).select("a", "b", "silent_failure", "p").toPandas()
    weights = np.array([fitted.model.weights[c] for c in INPUTS])
    x = np.column_stack([(got[c] - fitted.stats[c][0]) / fitted.stats[c][1] for c in INPUTS])
    slopes = [min(abs(x.T @ (got.p - got.silent_failure) / len(got) + weights / (c * len(got))).max() for c in fitted.settings.grid)]
    assert max(slopes) < 1e-6 and abs((got.p - got.silent_failure).mean()) < 1e-6


def test_one_class_has_a_certain_model(sample):
    rows = sample.where("silent_failure = 1").withColumn("weight", F.lit(1.0))
    fitted = models.fit(rows, INPUTS, models.Settings("logistic", 50, grid=(1.0,)))
    assert {r["p"] for r in fitted.score(rows).select("p").collect()} == {1.0}


def test_missing_inputs_stop_the_fit(sample):
    rows = sample.withColumn("a", F.when(F.col(ID) != "k3", F.col("a"))).withColumn("weight", F.lit(1.0))
    with pytest.raises(ValueError, match="missing"):
        models.fit(rows, INPUTS, models.Settings("logistic", 50, grid=(1.0,)))
