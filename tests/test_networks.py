"""Matrix sums, the dense autoencoder, and the exact two-sample law, each against a plainer computation."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from freightlens.functions.products import cross_products
from freightlens.operators import balance, networks
from freightlens.operators.iterative import bayesian_ridge


def test_cross_products(spark):
    x = np.random.default_rng(1).normal(size=(500, 4))
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double, d double").repartition(7)
    assert np.allclose(cross_products(df, [F.col(c) for c in "abcd"]), x.T @ x)
    holes = df.withColumn("b", F.when(F.col("b") > 0, F.col("b")))
    y = x.copy()
    y[:, 1] = np.where(y[:, 1] > 0, y[:, 1], 0.0)
    assert np.allclose(cross_products(holes, [F.lit(1.0), *[F.col(c) for c in "abcd"]]), np.c_[np.ones(500), y].T @ np.c_[np.ones(500), y])
    assert not cross_products(df.where("false"), [F.col("a"), F.col("b")]).any()
    intercept, w = bayesian_ridge(np.c_[np.ones(500), x[:, :3], x[:, :3] @ [1.0, -2.0, 0.5]].T @ np.c_[np.ones(500), x[:, :3], x[:, :3] @ [1.0, -2.0, 0.5]], 3)
    assert np.allclose(w, [1.0, -2.0, 0.5], atol=1e-3) and abs(intercept) < 1e-3


def test_gradient_by_differences():
    widths, draw = (3, 5, 2, 5, 3), np.random.default_rng(0)
    x, w = draw.normal(size=(20, 3)), networks.start_weights((3, 5, 2, 5, 3), 7)
    w = w + draw.normal(0.0, 0.1, len(w))  # zero offsets would sit on the kink
    got = networks.loss_and_gradient(x, w, widths)
    loss = lambda v: ((networks.rebuild(x, v, widths)[-1] - x) ** 2).sum()
    unit = np.eye(len(w)) * 1e-6
    want = [(loss(w + e) - loss(w - e)) / 2e-6 for e in unit]
    assert got[0] == 20 and np.isclose(got[1], loss(w)) and np.allclose(got[2:], want, rtol=1e-4, atol=1e-4)


def test_network_learns_and_ignores_partitions(spark):
    draw = np.random.default_rng(3)
    z = draw.normal(size=(400, 1))
    rows = np.c_[z, 2 * z, -z, z + 0.01 * draw.normal(size=(400, 1))]
    df = spark.createDataFrame(rows.tolist(), "a double, b double, c double, d double")
    df = df.withColumn("d", F.when(F.rand(1) > 0.02, F.col("d")))
    model = networks.fit_network(df, ["a", "b", "c", "d"], (8, 2, 8), 40)
    assert all(b <= a for a, b in zip(model.losses, model.losses[1:])) and model.losses[-1] < 0.1 * model.losses[0]
    odd = spark.createDataFrame([(1.0, -2.0, 1.0, -1.0), (1.0, 2.0, -1.0, 1.0), (None, None, None, None)], df.schema)
    broken, usual, empty = [r[0] for r in networks.network_error(odd, model).select("recon_error").collect()]
    assert broken > 5 * usual and empty >= 0.0
    again = networks.fit_network(df.repartition(5), ["a", "b", "c", "d"], (8, 2, 8), 1)
    once = networks.fit_network(df, ["a", "b", "c", "d"], (8, 2, 8), 1)
    assert np.allclose(once.weights, again.weights)
    assert len(networks.fit_network(df.where("false"), ["a", "b"], (3,), 5).losses) >= 1


@pytest.mark.parametrize("n,m", [(1, 1), (2, 3), (4, 4), (3, 6), (5, 4)])
def test_ks_law_counts_all_orders(n, m):
    gaps = []
    for first in combinations(range(n + m), n):
        i = np.cumsum(np.isin(np.arange(n + m), first))
        gaps.append(np.abs(i / n - (np.arange(1, n + m + 1) - i) / m).max())
    for d in sorted({round(g, 9) for g in gaps}):
        assert balance.ks_exact(d, n, m) == pytest.approx(np.mean(np.array(gaps) >= d - 1e-9), abs=1e-12)
    assert balance.ks_exact(0.0, n, m) == 1.0 and balance.ks_exact(None, n, m) is None


def test_ks_law_meets_the_series():
    for d in (0.02, 0.03):
        lam = d * (9_000 * 9_500 / 18_500) ** 0.5
        series = 2 * sum((-1) ** (j - 1) * np.exp(-2 * j * j * lam * lam) for j in range(1, 100))
        assert balance.ks_exact(d, 9_000, 9_500) == pytest.approx(series, rel=0.1)


def test_comparison_of_models(spark):
    from freightlens.operators import metrics

    rows = [("a", 0, 3, 1, 2, 4), ("a", 1, 5, 1, 0, 4), ("b", 0, 8, 2, 2, 8), ("one class", 0, 4, 1, 0, 0)]
    counts = spark.createDataFrame(rows, "model string, fold int, tn bigint, fp bigint, fn bigint, tp bigint")
    table = {r["model"]: r for r in metrics.confusion_table(counts, ["model"]).collect()}
    assert (table["a"]["tn"], table["a"]["tp"], table["a"]["tp_share"], table["a"]["fp_share"]) == (8, 8, 0.8, 0.2)
    assert table["one class"]["tp_share"] is None and table["one class"]["fp_share"] == 0.2
    got = {(r["model"], r["metric"]): (r["value"], r["is_best"]) for r in metrics.comparison_table(counts, ["model"]).collect()}
    assert got["a", "recall"] == (0.8, True) == got["b", "recall"] and got["one class", "recall"] == (0.0, False)
    assert metrics.confusion_table(counts.where("false"), ["model"]).count() == 0
