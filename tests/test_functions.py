import random

import pytest
from pyspark.sql import functions as F

from freightlens.functions.quantiles import exact_quantiles
from freightlens.functions.ranks import range_buckets, row_ranks, running_totals


def linear(values, p):
    v = sorted(values)
    h = (len(v) - 1) * p
    lo = int(h)
    hi = min(lo + 1, len(v) - 1)
    return (1 - (h - lo)) * v[lo] + (h - lo) * v[hi]


@pytest.mark.parametrize("shape", ["spread", "hot", "two_values", "constant"])
def test_bracketed_quantiles_equal_the_sorted_list(spark, shape):
    rng = random.Random(1)
    values = {
        "spread": [rng.gauss(0, 1) for _ in range(3000)],
        "hot": [7.0] * 1500 + [rng.random() * 20 for _ in range(1500)],
        "two_values": [1.0] * 1499 + [2.0] * 1501,
        "constant": [3.0] * 500,
    }[shape]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(5)
    probs = [0.0, 0.01, 0.25, 0.5, 0.95, 1.0]
    got = exact_quantiles(df, {"x": F.col("x")}, probs, held=300)["x"]
    assert got == pytest.approx([linear(values, p) for p in probs], abs=1e-12)


def test_quantiles_of_an_empty_column(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert exact_quantiles(df, {"x": F.col("x")}, [0.5]) == {"x": [None]}
    assert exact_quantiles(df, {"x": F.col("x")}, [0.5], held=1, staged=True) == {"x": [None]}


def test_two_level_ranks_and_totals(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("g"), (F.col("id") * 37 % 101).alias("o"))
    got = {(r["g"], r["o"], r["id"]): r["rank"] for r in row_ranks(df, ["g"], F.expr("o div 10"), [F.col("o"), F.col("id")]).collect()}
    for g in range(3):
        keys = sorted(k for k in got if k[0] == g)
        assert [got[k] for k in keys] == list(range(len(keys)))
    hist = df.groupBy("g", F.col("o").alias("k")).agg(F.count("*").alias("n"))
    for down in (False, True):
        out = running_totals(range_buckets(hist, ["g", "k"]) if not down else hist.withColumn("_bucket", F.expr("k div 7")), ["g"], "k", ["n"], down).collect()
        for r in out:
            want = sum(x["n"] for x in out if x["g"] == r["g"] and (x["k"] > r["k"] if down else x["k"] < r["k"]))
            assert r["n_before"] == want and r["n_total"] == sum(x["n"] for x in out if x["g"] == r["g"])


def test_staged_folders_of_a_scope_go_with_it(spark):
    import os

    from freightlens.session import new_folder, stage, staging

    with staging(spark):
        outer = stage(spark.range(3), "outer")
        with staging(spark):
            inner = new_folder(spark, "inner")
            spark.range(2).write.parquet(inner)
        assert not os.path.exists(inner) and outer.count() == 3
        kept = outer.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(kept)
    assert not os.path.exists(kept)
