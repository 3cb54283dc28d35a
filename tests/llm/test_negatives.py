import math
import random

import numpy as np
from pyspark.sql import functions as F

from freightlens.llm import negatives
from freightlens.llm.negatives import Mining, mine

SCHEMA = "vec_id long, label int, embedding array<float>"


def by_hand(rows, anchor, plan=Mining()):
    usable = [(k, l, [math.floor(plan.scale * float(np.float32(x))) for x in v]) for k, l, v in rows
              if k is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, (a, label, mine_) in enumerate(usable):
        if not anchor(a):
            continue
        scored = [(sum(x * y for x, y in zip(mine_, v)), k, l) for j, (k, l, v) in enumerate(usable) if j != i]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for p, pid, _ in [s for s in scored if s[2] == label][: plan.positives]:
            fit = [s for s in scored if s[2] != label and plan.low * p <= 100 * s[0] <= plan.high * p][: plan.negatives]
            out += [(a, pid, rank, nid, p, n) for rank, (n, nid, _) in enumerate(fit, 1)]
    return sorted(out)


def found(spark, rows, anchor, plan=Mining(), schema=SCHEMA):
    rows = [(k, l, v and [x if x is None else float(x) for x in v]) for k, l, v in rows]
    frame = spark.createDataFrame(rows, schema).repartition(5).withColumns({"row": F.lit(0), "id": F.lit("x"), "scores": F.lit(1), "strip": F.lit(2)})
    return sorted(tuple(r) for r in mine(frame, anchor, plan=plan).collect())


def sample(n=160, dims=6, labels=4, seed=1):
    r = random.Random(seed)
    centres = [[r.gauss(0, 0.4) for _ in range(dims)] for _ in range(labels)]
    return [(i, i % labels, [c + r.gauss(0, 0.3) for c in centres[r.choice([i % labels, 0])]]) for i in range(n)]


def test_equal_brute_force_however_cells_are_cut(spark):
    rows = sample()
    rows += [(500 + i, 1, [0.5, 0.5, 0, 0, 0, 0]) for i in range(40)] + [(700 + i, 2, [0.3, 0.3, 0, 0, 0, 0]) for i in range(40)]  # ties
    want = by_hand(rows, lambda k: k % 10 == 0)
    assert len(want) > 100
    for plan in (Mining(), Mining(strip=5, block=17, least_block=4, slice_rows=2)):
        assert found(spark, rows, F.col("vec_id") % 10 == 0, plan) == want


def test_rows_that_take_no_part_and_repeated_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(None, 1, [1.0] * 6), (10, None, [1.0] * 6), (20, 1, None), (30, 1, [None] + [1.0] * 5), (40, 1, [nan] * 6), (50, 2, [inf] * 6), (60, 1, [-inf] * 6)]
    rows = sample(60) + odd + [(0, 0, [0.4] * 6)] * 3 + [(11, 2, [0.35] * 6)] * 4
    want = by_hand(rows, lambda k: k % 10 == 0)
    assert found(spark, rows, F.col("vec_id") % 10 == 0, Mining(strip=4, block=9, least_block=9)) == want


def test_zero_and_negative_scores(spark):
    rows = [(0, 0, [1.0, 0.0]), (5, 0, [0.0, 1.0]), (3, 1, [0.0, 2.0]), (4, 1, [0.0, -1.0]), (7, 0, [-1.0, 0.0]), (8, 1, [-0.8, 0.0]), (9, 1, [-0.6, 0.0])]
    want = by_hand(rows, lambda k: k == 0)
    assert want == [(0, 5, 1, 3, 0, 0), (0, 5, 2, 4, 0, 0)]
    assert found(spark, rows, F.col("vec_id") == 0) == want


def test_short_and_empty_vectors_and_large_numbers(spark):
    rows = [(0, 0, [1e6, 3.0]), (1, 0, [1e6]), (2, 1, [9e5, 1.0]), (3, 1, []), (4, 0, [])]
    assert found(spark, rows, F.col("vec_id") == 0, Mining(scale=1 << 8)) == by_hand(rows, lambda k: k == 0)
    big = [(0, 0, [1.1e7]), (1, 0, [1.1e7]), (2, 1, [9e6]), (3, 1, [9.000001e6])]
    assert found(spark, big, F.col("vec_id") == 0) == by_hand(big, lambda k: k == 0)
    assert found(spark, [(k, l, [x * 1e3 for x in v]) for k, l, v in big], F.col("vec_id") == 0) == []  # all cut to a long's range, so equal


def test_no_anchor_no_positive_no_rows(spark):
    assert found(spark, sample(20), F.col("vec_id") < 0) == []
    assert found(spark, [], F.col("vec_id") % 10 == 0) == []
    assert found(spark, [(0, 0, [1.0]), (1, 1, [0.9])], F.col("vec_id") == 0) == []


def test_iterator_holds_open_windows_alone():
    plan = Mining(positives=2, negatives=1)
    records = [(1, 10, 100, 0, 5), (1, 10, 96, 1, 8), (1, 10, 95, 1, 9), (1, 10, 80, 0, 6), (1, 10, 79, 1, 3), (1, 10, 76, 1, 4), (1, 10, 70, 0, 7), (1, 10, 60, 1, 2), (2, 20, 9, 1, 1)]
    assert list(negatives.in_windows(iter(records), plan)) == [(10, 5, 1, 9, 100, 95), (10, 6, 1, 4, 80, 76)]
