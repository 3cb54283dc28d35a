from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from freightlens.operators import balance, neighbors
from freightlens.operators.neighbors import KnnPlan, knn_join
from freightlens.sources.shipments import ID, TARGET

TIGHT = KnnPlan(leaf_rows=40, donor_block=30, query_block=25, sample_rows=200)


def brute(q, d, k, exclude_self, nullable=()):
    out = {}
    width = len(next(iter(q.values())))
    for qi, qv in q.items():
        found = []
        for di, dv in d.items():
            if exclude_self and qi == di:
                continue
            acc, present = 0.0, 0
            for j in range(width):
                if qv[j] is not None and dv[j] is not None:
                    acc += (qv[j] - dv[j]) * (qv[j] - dv[j])
                    present += 1
            found.append((acc * width / present if nullable else acc, di))
        out[qi] = [(di, r + 1) for r, (_, di) in enumerate(sorted(found)[:k])]
    return out


@pytest.mark.parametrize("nullable,exclude_self", [([], True), ([], False), (["c"], False)])
def test_equals_full_search_with_hot_copies(spark, nullable, exclude_self):
    rng = np.random.default_rng(3)
    points = {f"r{i:03d}": [float(rng.integers(0, 30)), float(rng.integers(0, 5)), float(rng.integers(0, 9))] for i in range(200)}
    for i in range(100):  # a third of all rows are copies of one point
        points[f"h{i:03d}"] = [4.0, 2.0, 1.0]
    if nullable:
        for i in range(0, 200, 7):
            points[f"r{i:03d}"][2] = None
    df = spark.createDataFrame([(k, *v) for k, v in points.items()], "id string, a double, b double, c double").repartition(4)
    dims = ["a", "b"] if nullable else ["a", "b", "c"]
    got = {}
    for r in knn_join(df, df, 4, dims, "id", "id", nullable, exclude_self=exclude_self, plan=TIGHT).collect():
        got.setdefault(r["query_id"], []).append((r["donor_id"], r["rank"]))
    want = brute(points, points, 4, exclude_self, nullable)
    assert {k: sorted(v, key=lambda t: t[1]) for k, v in got.items()} == want


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(5)
    data = [(f"{i}", float(rng.normal()), float(rng.normal()), int(i % 5 == 0)) for i in range(200)]
    return spark.createDataFrame(data, f"{ID} string, a double, b double, {TARGET} int")


def test_smote_counts_and_convexity(small):
    out = balance.smote(small, ["a", "b"], 0.5, plan=TIGHT)
    assert out.where(f"{TARGET} = 1").count() == 80 and out.where(f"{TARGET} = 0").count() == 160
    again = balance.smote(small.repartition(3), ["a", "b"], 0.5, plan=TIGHT)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))
    real = np.array([[r["a"], r["b"]] for r in small.where(f"{TARGET} = 1").collect()])
    for r in out.where("is_synthetic").collect():
        p = np.array([r["a"], r["b"]])
        assert min(np.linalg.norm(p - a) + np.linalg.norm(p - b) - np.linalg.norm(a - b) for a in real for b in real) < 1e-9


def test_adasyn_total_and_tomek_pairs(small):
    made = balance.adasyn(small, ["a", "b"], 1.0, plan=TIGHT).where("is_synthetic").count()
    assert abs(made - 120) <= 40
    pts = {r[ID]: ([r["a"], r["b"]], r[TARGET]) for r in small.collect()}
    near = {k: v[0][0] for k, v in brute({k: v[0] for k, v in pts.items()}, {k: v[0] for k, v in pts.items()}, 1, True).items()}
    want = {(k, n) for k, n in near.items() if near[n] == k and pts[k][1] == 0 and pts[n][1] == 1}
    links = balance.tomek_links(small, ["a", "b"], plan=TIGHT)
    assert {(r["id_0"], r["id_1"]) for r in links.collect()} == want
    grown = balance.smote_tomek(small, ["a", "b"], 0.5, plan=TIGHT)
    assert grown.count() <= 240 and grown.where("is_synthetic").count() > 0


def test_ks_of_equal_and_shifted_samples(small):
    same = small.withColumn("side", F.lit(True)).unionByName(small.withColumn("side", F.lit(False)))
    rows = balance.ks_two_sample(same, F.col("side"), ["a"]).collect()
    assert rows[0]["statistic"] == 0 and not rows[0]["diverges"]
    apart = small.withColumn("side", F.lit(True)).unionByName(small.withColumn("a", F.col("a") + 100).withColumn("side", F.lit(False)))
    rows = balance.ks_two_sample(apart, F.col("side"), ["a"]).collect()
    assert rows[0]["statistic"] == 1 and rows[0]["diverges"]


@pytest.mark.parametrize("nullable", [0, 2])
def test_estimates_leave_few_pairs_and_lose_none(nullable):
    """Far from the origin and with near ties, every true neighbour is among a few candidates."""
    rng = np.random.default_rng(7)
    d = 1e6 + rng.normal(size=(900, 12))
    d[400:500] = d[300:400] + 1e-9 * rng.normal(size=(100, 12))
    q, width = d[:350] + 0.1, 12 - nullable
    if nullable:
        d[::5, 10], q[::4, 11] = np.nan, np.nan
    diff = q[:, None] - d[None]
    exact = np.where(np.isnan(diff), 0.0, diff**2).sum(axis=2) * 12 / (~np.isnan(diff)).sum(axis=2)
    near, off = neighbors._estimates(q, d, width)(0, len(q))
    assert (abs(near - exact) <= off[:, None]).all()
    kth = np.sort(exact, axis=1)[:, 4]
    for bound in (np.full(len(q), np.inf), kth, kth * 2):
        r, c = neighbors._candidates(near.copy(), off, bound, 5)
        found = set(zip(r.tolist(), c.tolist()))
        assert set(zip(*(x.tolist() for x in np.nonzero(exact <= kth[:, None])))) <= found and len(found) <= 50 * len(q)
    d[0, 0] = np.nan
    assert neighbors._estimates(q, d, width) is None


def test_rounds_over_leaves_equal_full_search(spark, monkeypatch):
    """Queries that reach many leaves go on until none is left within their bound."""
    rng = np.random.default_rng(9)
    points = {f"r{i:03d}": rng.normal(size=5).tolist() for i in range(300)}
    df = spark.createDataFrame([(k, *v) for k, v in points.items()], "id string, a double, b double, c double, d double, e double")
    rounds, visits = [], neighbors._visits
    monkeypatch.setattr(neighbors, "_visits", lambda boxes, width, first, last: rounds.append((first, last)) or visits(boxes, width, first, last))
    got = {}
    for r in knn_join(df, df, 3, list("abcde"), "id", "id", exclude_self=True, plan=replace(TIGHT, first_leaves=1)).collect():
        got.setdefault(r["query_id"], []).append((r["donor_id"], r["rank"]))
    assert rounds == [(0, 1), (1, 4), (4, 16)]
    assert {k: sorted(v, key=lambda t: t[1]) for k, v in got.items()} == brute(points, points, 3, True)
