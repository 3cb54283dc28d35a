from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from freightlens.operators import models, trees, treeshap
from freightlens.session import stage
from freightlens.sources.shipments import ID


def shape(nodes):
    """A tree from the root on, whatever the order of its nodes."""
    out, stack = [], [0]
    while stack:
        n = nodes[stack.pop()]
        out.append((int(n["feature"]), int(n["mask"]), float(n["value"]), float(n["cover"])))
        if n["feature"] >= 0:
            stack += [int(n["right"]), int(n["left"])]
    return out


@pytest.fixture(scope="module")
def sample(spark):
    """2,000 rows of which a third repeat one, with missing values, a category, and a label that depends on both inputs."""
    r = np.random.default_rng(3)
    data = []
    for i in range(2000):
        a, b, c = float(r.normal()), float(r.integers(0, 30)), float(r.integers(0, 6))
        if i % 3 == 0:
            a, b, c = 0.5, 3.0, 2.0
        y = int((a > 0.3) ^ (c in (1.0, 4.0)) ^ (r.random() < 0.1))
        data.append((f"k{i}", a if r.random() > 0.05 else None, b, c, y, 1.0 + 2.0 * y))
    return stage(spark.createDataFrame(data, f"{ID} string, a double, b double, c double, y int, weight double").repartition(7), "sample")


@pytest.fixture(scope="module")
def coded(sample):
    coding = trees.fit_coding(sample, ["a", "b", "c"], ["c"])
    return coding, stage(trees.coded(sample, ["a", "b", "c"], coding, "y", "weight"), "coded")


@pytest.mark.parametrize("spec", [
    trees.Spec(True, 12, 4, 2, 0.3, 0.7, l2=1.0), trees.Spec(True, 3, 3, 3, 0.3, min_rows=40, min_gain=0.5), trees.Spec(False, 5, 30, 2), trees.Spec(False, 18, 5, 1, min_rows=5)])
def test_trees_are_the_same_for_any_bound(coded, spec):
    coding, rows = coded
    whole, = trees.fit_many(rows, [spec], coding)
    assert len(whole) == spec.rounds and max(map(len, whole)) > 5
    for bound in (1, 150, 1_500):
        parts, = trees.fit_many(rows, [spec], coding, bound)
        assert [shape(t) for t in parts] == [shape(t) for t in whole]


def test_ensembles_side_by_side_equal_single_ones(coded):
    coding, rows = coded
    specs = [trees.Spec(True, 4, 3, 2, 0.3, seed=1), trees.Spec(False, 3, 6, 2), trees.Spec(True, 2, 2, 3, 0.1, 0.5)]
    together = trees.fit_many(rows, specs, coding)
    for spec, grown in zip(specs, together):
        assert [shape(t) for t in grown] == [shape(t) for t in trees.fit_many(rows, [spec], coding)[0]]


def test_best_split_equals_brute_force():
    r = np.random.default_rng(5)
    for categorical in (False, True):
        for _ in range(20):
            codes = r.integers(0, 6, (60, 2)).astype(np.uint8)
            y, w = r.integers(0, 2, 60), np.full(60, trees.WEIGHT_UNIT)
            spec = trees.Spec(False, 1, 1, 2, min_rows=3)
            growing = trees.Growing(spec, 0, np.array([categorical] * 2))
            trees.grow(growing, codes, [y * w, w, np.ones(60, np.int64)])
            gini = lambda s: len(s) * (1 - s.mean() ** 2 - (1 - s).mean() ** 2) if len(s) else 0.0
            sets = [set(k) for n in range(1, 6) for k in __import__("itertools").combinations(range(6), n)] if categorical else [set(range(k)) for k in range(1, 6)]
            costs = []
            for f in range(2):
                for s in sets:
                    left = np.isin(codes[:, f], list(s))
                    if left.sum() >= 3 and (~left).sum() >= 3:
                        costs.append(gini(y[left]) + gini(y[~left]))
            root = growing.nodes[0]
            left = ((root["mask"] >> codes[:, root["feature"]].astype(np.uint64)) & np.uint64(1)) == 1
            assert gini(y[left]) + gini(y[~left]) == pytest.approx(min(costs))


def test_codes_follow_cuts_and_levels(spark, sample):
    coding = trees.fit_coding(sample, ["b", "c"], ["c"])
    codes = coding.codes([np.array([np.nan, -5.0, coding.cuts[0][0], 1e9]), np.array([np.nan, 2.0, 77.0, 0.0])])
    assert codes[:, 0].tolist() == [0, 1, 1, len(coding.cuts[0]) + 1]
    assert codes[0, 1] == codes[2, 1] == 0 and codes[1, 1] == 1  # the most frequent level comes first
    many = spark.range(500).select(F.col("id").cast("string").alias(ID), (F.col("id") % 100).alias("c"))
    held = trees.fit_coding(many, ["c"], ["c"]).levels[0]
    assert len(held[0]) == 100 and set(held[1].tolist()) == set(range(1, trees.BINS))
    empty = trees.fit_coding(many.where("c < 0"), ["c"], [])
    assert empty.codes([np.array([1.0, np.nan])]).tolist() == [[1], [0]]


def test_empty_table_and_one_class(spark, coded):
    coding, rows = coded
    assert trees.fit_many(rows.limit(0), [trees.Spec(True, 3, 3, 3)], coding) == [[]]
    flat, = trees.fit_many(rows.where("y = 1"), [trees.Spec(False, 3, 3, 3)], coding)
    assert [t["value"].tolist() for t in flat] == [[1.0]] * 3


def expect(nodes, x, known, at=0):
    n = nodes[at]
    if n["feature"] < 0:
        return n["value"]
    sides = (int(n["left"]), int(n["right"]))
    if int(n["feature"]) in known:
        return expect(nodes, x, known, sides[0] if int(n["mask"]) >> int(x[n["feature"]]) & 1 else sides[1])
    return sum(nodes["cover"][s] / n["cover"] * expect(nodes, x, known, s) for s in sides)


def test_attributions_equal_all_orders_of_features():
    """Grown trees that meet features again on a path."""
    r = np.random.default_rng(8)
    codes = r.integers(0, 12, (200, 4)).astype(np.uint8)
    y, w = ((codes[:, 0] > 5) ^ (codes[:, 1] > 3) ^ (codes[:, 2] % 3 == 0)).astype(np.int64), np.full(200, trees.WEIGHT_UNIT)
    for depth in (1, 3, 6):
        growing = trees.Growing(trees.Spec(False, 1, depth, 4), 0, np.array([False, False, True, False]))
        trees.grow(growing, codes, [y * w, w, np.ones(200, np.int64)])
        points = codes[:12]
        got = np.zeros((4, 12))
        treeshap.attribute(growing.nodes, points, got)
        for i, x in enumerate(points):
            want = np.zeros(4)
            for order in permutations(range(4)):
                for k, f in enumerate(order):
                    want[f] += (expect(growing.nodes, x, set(order[: k + 1])) - expect(growing.nodes, x, set(order[:k]))) / 24
            assert got[:, i] == pytest.approx(want, abs=1e-12)
            assert treeshap.expected(growing.nodes) == pytest.approx(expect(growing.nodes, x, set()))


def test_blocks_hold_whole_trees():
    grown = [np.zeros(n, trees.NODE) for n in (3, 3, 10, 1, 1)]
    assert [[len(t) for t in b] for b in treeshap.blocks(grown, 6)] == [[3, 3], [10], [1, 1]]
    assert treeshap.blocks([], 6) == []


def test_boosting_on_spark_keeps_one_table_of_margins(coded, monkeypatch):
    """A block is a row of its own, margins are written every few rounds, and what no round reads is gone."""
    coding, rows = coded
    made, gone = [], []
    monkeypatch.setattr(trees, "new_folder", lambda spark, label, real=trees.new_folder: made.append(real(spark, label)) or made[-1])
    monkeypatch.setattr(trees, "discard", lambda spark, path, real=trees.discard: gone.append(path) or real(spark, path))
    spec = trees.Spec(True, 2 * trees.REFRESH + 1, 2, 2, 0.3, 0.7)
    grown, = trees.fit_many(rows, [spec], coding, 1)
    assert len(grown) == spec.rounds and len(made) == 3 and gone == made
    blocks = rows.mapInArrow(trees._blocks, trees.BLOCKS)
    assert blocks.count() < 50 and sum(len(r["h"]) // 8 for r in blocks.collect()) == 2000


def test_routes_of_shallow_and_deep_trees():
    """Every row ends where single steps lead it, whatever the depth."""
    r = np.random.default_rng(2)
    codes = r.integers(0, 64, (500, 4)).astype(np.uint8)
    for depth in (0, 1, 5, 6, 7, 20):
        nodes = np.zeros(2 * depth + 1, trees.NODE)
        nodes["feature"] = -1
        for i in range(depth):  # a chain: the left child is a leaf
            nodes[2 * i]["feature"], nodes[2 * i]["mask"] = i % 4, np.uint64(1) << np.uint64(3 * i % 64)
            nodes[2 * i]["left"], nodes[2 * i]["right"] = 2 * i + 1, 2 * i + 2
        want = []
        for row in codes:
            at = 0
            while nodes[at]["feature"] >= 0:
                at = nodes[at]["left" if int(nodes[at]["mask"]) >> int(row[nodes[at]["feature"]]) & 1 else "right"]
            want.append(int(at))
        assert trees.route(nodes, codes).tolist() == want


def test_large_ensembles_stay_in_a_table(sample, monkeypatch):
    """Above the bound no tree reaches the driver; scores, objectives and attributions are those of held trees, whatever keys repeat."""
    settings = [models.Settings("forest", 7, 6, feature_share="auto"), models.Settings(rounds=5, depth=3)]
    rows = sample.withColumn(ID, F.when(F.col(ID) > "k5", F.col(ID)))
    small = models.fit_all(sample, ["a", "b", "c"], settings, "y")
    monkeypatch.setattr(trees, "held", None)
    monkeypatch.setattr(trees, "HELD_BYTES", 0)
    monkeypatch.setattr(trees, "BLOCK_BYTES", 3_000)
    monkeypatch.setattr(treeshap, "PART_ROWS", 700)
    large = models.fit_all(sample, ["a", "b", "c"], settings, "y")
    for a, b in zip(small, large):
        assert isinstance(b.model.trees, trees.Stored) and b.model.trees.blocks > 2
        want, got = (sorted(tuple(r) for r in m.score(rows.fillna("", [ID]), "p").select(ID, "b", "c", "p").collect()) for m in (a, b))
        assert len(got) == 2000 and np.array([r[3] for r in got]) == pytest.approx(np.array([r[3] for r in want]), abs=1e-12)
        assert models.trial_objectives([b], sample, "y") == pytest.approx(models.trial_objectives([a], sample, "y"))
        one, two = ({r[ID]: r for r in treeshap.tree_shap(m, sample, ID).collect()} for m in (a, b))
        assert len(two) == 2000
        for k in ("k0", "k7", "k1999"):
            assert two[k]["base_value"] == pytest.approx(one[k]["base_value"])
            assert [c["feature"] for c in two[k]["contributions"]] == [c["feature"] for c in one[k]["contributions"]]
            assert [c["shap_value"] for c in two[k]["contributions"]] == pytest.approx([c["shap_value"] for c in one[k]["contributions"]], abs=1e-12)
    assert models.trial_objectives(large, sample, "y") == pytest.approx(models.trial_objectives(small, sample, "y"))


def test_tasks_of_one_stage_grow_the_same_boosting(coded, monkeypatch):
    """Tasks that keep their rows and exchange histograms grow the trees of a single task, covers included, in one stage for
    all ensembles. Where they cannot open the shared folder, levels are jobs as before."""
    coding, rows = coded
    specs = [trees.Spec(True, 6, 4, 2, 0.3, 0.7, l2=1.0), trees.Spec(True, 3, 6, 3, 0.1, min_rows=7, min_gain=0.2)]
    want = [[shape(t) for t in grown] for grown in trees.fit_many(rows, specs, coding)]
    jobs, boost = [], trees._boost
    monkeypatch.setattr(trees, "_boost", lambda *a: jobs.append(1) or boost(*a))
    assert [[shape(t) for t in grown] for grown in trees.fit_many(rows, specs, coding, 300)] == want and not jobs
    monkeypatch.setattr(trees, "local_path", lambda spark, path: None)
    assert [[shape(t) for t in grown] for grown in trees.fit_many(rows, specs[1:], coding, 300)] == want[1:] and jobs


def test_joint_histograms_equal_those_of_each_input(monkeypatch):
    """Inputs of few codes share a count; dropped inputs, subsets of rows and small nodes included."""
    r = np.random.default_rng(4)
    widths = [64, 3, 10, 63, 4, 64, 2, 40, 64, 5, 64, 64, 64, 64, 64, 64, 64, 64, 64, 64, 64, 64, 64]
    codes = np.column_stack([r.integers(0, n, 9_000) for n in widths]).astype(np.uint8)
    share = trees.Share(np.zeros(9_000, np.uint64), np.zeros(9_000), np.ones(9_000), codes, widths)
    assert sorted(sum(share.groups, [])) == list(range(len(widths))) and all(np.prod(s) <= trees.GROUP_CELLS for s in share.sizes)
    terms, picks = r.integers(-9, 9, 9_000) + 1j * r.integers(1, 9, 9_000), np.array([0, 1, 4, 6, 7, 22])
    nodes = [np.arange(9_000), np.arange(500, 8_000), np.arange(0, 9_000, 7), np.zeros(0, np.int64)]
    for counted in (False, True):
        got = share.histograms(nodes, picks, terms, counted)
        for i, rows in enumerate(nodes):
            for k, j in enumerate(picks):
                for t, values in enumerate((terms.real, terms.imag, np.ones(9_000))[: 2 + counted]):
                    assert (got[i, k, :, t] == np.bincount(codes[rows, j], values[rows], trees.BINS)).all()


def test_patterns_give_the_attributions_of_the_walk(monkeypatch):
    """Many rows look up what each pattern of ways adds: as the walk, with categories, features met again and trees too deep for it."""
    r = np.random.default_rng(6)
    codes = r.integers(0, 20, (9_000, 4)).astype(np.uint8)
    y = ((codes[:, 0] > 9) ^ (codes[:, 1] > 5) ^ (codes[:, 2] % 3 == 0) ^ (r.random(9_000) < 0.1)).astype(np.int64)
    walked = []
    monkeypatch.setattr(treeshap, "attribute", lambda *a, real=treeshap.attribute: walked.append(1) or real(*a))
    for depth, patterns in ((0, True), (1, True), (6, True), (9, True), (14, False)):
        growing = trees.Growing(trees.Spec(False, 1, depth, 4), 0, np.array([False, False, True, False]))
        trees.grow(growing, codes, [y * trees.WEIGHT_UNIT, np.full(9_000, trees.WEIGHT_UNIT), np.ones(9_000, np.int64)])
        want, got = np.zeros((4, 9_000)), np.zeros((9_000, 4)).T
        treeshap.attribute(growing.nodes, codes, want)
        walked.clear()
        treeshap.attribute_many(growing.nodes, codes, got)
        assert got == pytest.approx(want, abs=1e-12) and bool(walked) == (not patterns or depth == 0)
        few = np.zeros((4, 50))
        treeshap.attribute_many(growing.nodes, codes[:50], few)
        assert few == pytest.approx(want[:, :50], abs=1e-12)


def test_rows_of_several_batches_are_attributed_together(sample, monkeypatch):
    """The rows of a task meet the trees in larger pieces than Arrow batches; every row keeps its own attributions."""
    fitted = models.fit(sample, ["a", "b", "c"], models.Settings(rounds=3, depth=3), "y")
    want = {r[ID]: r["contributions"] for r in treeshap.tree_shap(fitted, sample, ID).collect()}
    monkeypatch.setattr(treeshap, "HELD_ROWS", 150)
    monkeypatch.setattr(treeshap, "PATTERN_ROWS", 100)
    sample.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        got = {r[ID]: r["contributions"] for r in treeshap.tree_shap(fitted, sample.coalesce(1), ID).collect()}
    finally:
        sample.sparkSession.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == want.keys() and len(got) == 2000
    for k in got:
        assert {c["feature"]: c["shap_value"] for c in got[k]} == pytest.approx({c["feature"]: c["shap_value"] for c in want[k]}, abs=1e-12)


def test_boostings_of_several_threads_take_turns(coded):
    """Folds that are fitted at once, among jobs of their own, each get the stage that takes all slots."""
    coding, rows = coded
    specs = [trees.Spec(True, 4, 3, 2, 0.3, 0.7, seed=i) for i in range(3)]

    def one(spec):
        rows.repartition(20).count()
        return [shape(t) for t in trees.fit_many(rows, [spec], coding, 300)[0]]

    assert models.at_once(one, specs) == [[shape(t) for t in grown] for grown in trees.fit_many(rows, specs, coding)]
