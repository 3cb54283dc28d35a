import json
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freightlens.catalog import learning
from freightlens.operators import (
    anomaly, audit, baselines, collinearity, decide, experiments, explain, features, folds, impute, iterative, lime, linear,
    metrics, models, outliers, profile, thresholds, treeshap, validate,
)
from freightlens.plans import ablation
from freightlens.session import checkpoint_root, new_folder, stage
from freightlens.sources.shipments import ID, ORDERED_COLUMNS, RAW_SCHEMA, TARGET, read_raw_csv, read_shipments_csv, write_csv

GOOD = dict(zip(ORDERED_COLUMNS, ["s1", "2.5", "3", "2", "5", "8", "2", "1", "0.5", "0.4", "0.1", "0.6", "1", "50", "0.5", "1", "2", "3", "4", "6", "1", "1", "0", "0"]))


def check_rows(spark, *changes):
    rows = [{**GOOD, **c} for c in changes]
    df = spark.createDataFrame([tuple(r[c] for c in ORDERED_COLUMNS) for r in rows], RAW_SCHEMA)
    return [r["_errors"] for r in validate.annotate(df).collect()]


def test_edge_rows(spark):
    got = check_rows(
        spark, {}, {"transit_days": None}, {"rh_max": None}, {"temp_recovery_rate": "NaN"}, {"temp_std_c": "NaN"}, {"rh_mean": "high"},
        {"door_opens": "2.5"}, {"leg_count": "0"}, {"leg_count": "4"}, {"fill_ratio": "1.2"}, {"rh_mean": "-0.1"}, {"product_volume_l": "0"},
        {"temp_max_c": "1"}, {ID: ""}, {"transit_days": "0"})
    assert got == [
        [], ["missing:transit_days"], [], [], ["missing:temp_std_c"], ["type:rh_mean"], ["type:door_opens"], ["range:leg_count"],
        ["range:leg_count"], ["range:fill_ratio"], ["range:rh_mean"], ["range:product_volume_l"], ["cross:temp_max_lt_min"],
        [f"missing:{ID}"], []]


def test_csv_round_trip(spark, rows):
    path = new_folder(spark, "csv")
    write_csv(rows.select(*ORDERED_COLUMNS), path)
    assert read_shipments_csv(spark, path).count() == rows.count()
    assert validate.annotate(read_raw_csv(spark, path)).where("size(_errors) > 0").count() == 0


def test_profile_of_odd_tables(spark):
    df = spark.createDataFrame([("a", 1.0, None, 1), ("a", 1.0, None, 1), ("b", 2.0, None, 1)], f"{ID} string, x double, empty double, {TARGET} int")
    assert profile.duplicates(df).first()[0] == 1
    assert tuple(profile.identifier(df).first()) == (ID, False, 2)
    assert profile.identifier(df, "none").first()["is_unique"] is None
    audit_row = profile.target_audit(df).first()
    assert audit_row["n_negative"] == 0 and audit_row["drift_alert"]
    assert {r["column"]: r["flagged"] for r in profile.missingness(df).collect()} == {"empty": True}
    empty = df.limit(0)
    assert profile.duplicates(empty).first()[0] == 0 and profile.target_audit(empty).first()["prevalence"] is None
    path = new_folder(spark, "report")
    profile.save_report(profile.full_report(df.withColumns({c: F.lit(0.5) for c in ("fill_ratio", "rh_mean", "temp_max_c", "temp_min_c")})), path)
    assert spark.read.json(path).count() > 10


def test_features_guard_zero_and_missing(spark):
    df = spark.createDataFrame([(4.0, 0.0, 2, 1.0, 3.0, 1.0, None, 0.2)], "vibration_index double, transit_days double, door_opens int, "
                               "sensor_gap_hours double, temp_max_c double, temp_min_c double, rh_max double, rh_mean double")
    r = features.engineer(df, features.ExcursionScaler(0.0, 0.0, 0.0, 0.0)).first()
    assert r["vibration_rate"] == 0 and r["door_open_rate"] == 0 and r["rh_range"] is None and r["temp_range_c"] == 2
    with pytest.raises(ValueError):
        features.feature_set("FS-Z")


def test_folds_are_balanced_and_stable(rows):
    out = folds.stratified_folds(rows.select(ID, TARGET), 5, folds.hashed_order())
    again = folds.stratified_folds(rows.select(ID, TARGET).repartition(3), 5, folds.hashed_order())
    assert out.exceptAll(again.select(*out.columns)).count() == 0 and out.count() == rows.count()
    per = out.groupBy(TARGET).pivot("fold").count().collect()
    assert all(max(r[1:]) - min(r[1:]) <= 1 for r in per)


def test_vif_filter_drops_copies(rows):
    df = rows.withColumn("copy", F.col("transit_days") * 2)
    keep, dropped = collinearity.fit_vif_filter(df, ["transit_days", "copy", "rh_std"])
    assert dropped and {d[0] for d in dropped} <= {"transit_days", "copy"} and "rh_std" in keep


def test_threshold_rules(spark):
    df = spark.createDataFrame([(1, 0.29), (0, 0.29), (1, 0.6), (0, 0.1)], f"{TARGET} int, p double")
    cells = {round(r["theta"], 2): r for r in thresholds.sweep(df).collect()}
    assert cells[0.29]["tp"] == 2 and cells[0.30]["tp"] == 1
    assert thresholds.pick_cost(thresholds.sweep(df)).first()["theta"] == pytest.approx(0.11)
    flat = spark.createDataFrame([(1, 0.2), (0, 0.2)], f"{TARGET} int, p double")
    assert thresholds.optimize(flat, "youden_j") == float("inf")
    one = spark.createDataFrame([(1, 0.2), (1, 0.4)], f"{TARGET} int, p double")
    assert metrics.roc_auc(one).first()[0] is None
    with pytest.raises(ValueError):
        thresholds.optimize(df, "coin")


def test_exact_histogram_auc_equals_pairs(spark):
    rng = np.random.default_rng(0)
    data = [(int(rng.random() < 0.4), float(np.round(rng.normal(), 1))) for _ in range(300)]
    df = spark.createDataFrame(data, f"{TARGET} int, s double")
    got = metrics.rank_metrics(thresholds.exact_histogram(df, "s")).first()["roc_auc"]
    pos, neg = [s for y, s in data if y], [s for y, s in data if not y]
    assert got == pytest.approx(np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]))


def test_bootstrap_brackets_the_value(rows):
    r = metrics.bootstrap_ci(linear.score(rows), 0.3, replicates=200).first()
    assert r["ci_lower"] <= r["value"] <= r["ci_upper"] and r["n_replicates"] == 200


@pytest.mark.parametrize("settings", [
    models.Settings(rounds=3, depth=3, feature_share="all"), models.Settings(rounds=2, depth=3, categorical=True),
    models.Settings("forest", 4, 12, feature_share="auto"), models.Settings(rounds=3, depth=3, encode=True)])
def test_tree_attributions_add_up(rows, settings):
    fitted = models.fit(rows, features.RAW_FEATURES, settings)
    total = treeshap.tree_shap(fitted, rows, ID, 50).select(ID, (F.col("base_value") + F.aggregate("contributions", F.lit(0.0), lambda a, c: a + c["shap_value"])).alias("t"))
    worst = total.join(treeshap.margin(fitted, rows, ID), ID).agg(F.max(F.abs(F.col("t") - F.col("margin")))).first()[0]
    assert worst < 1e-9
    assert metrics.all_metrics(fitted.score(rows), 0.5).first()["roc_auc"] > 0.75


def test_local_surrogate_of_a_linear_model(rows):
    scored = linear.score(rows)
    names = list(linear.DEMO.weights)
    risky = scored.orderBy(F.desc("p"), ID).limit(3).select(ID, *names)
    out = lime.explain_rows(risky, lime.fit_bins(scored, names), linear.score, 400, 3).collect()
    assert len(out) == 3 and all(len(r["contributions"]) == 3 for r in out)
    assert all({c["feature"] for c in r["contributions"]} & {"temp_range_c", "transit_days"} for r in out)


def test_local_surrogate_equals_a_direct_weighted_ridge(spark, rows):
    scored = linear.score(rows)
    names = list(linear.DEMO.weights)
    bins, two = lime.fit_bins(scored, names), scored.orderBy(ID).limit(2).select(ID, *names)
    copies = linear.score(lime.perturb(spark, bins, 300)).collect()
    got = {r[ID]: r for r in lime.explain_rows(two, bins, linear.score, 300, len(names)).collect()}
    own = {r[ID]: r for r in linear.score(two).collect()}
    for c in copies:  # every value stands in the bin that was drawn
        for n, i in zip(names, c["_bins"]):
            assert bins.all()[n][i][0] <= c[n] <= bins.all()[n][i][1]
    assert len(copies) == 299 and got.keys() == own.keys()
    for key, r in got.items():
        place = [next((i for i, p in enumerate(bins.all()[n]) if own[key][n] <= p[1]), len(bins.all()[n]) - 1) for n in names]
        z = np.array([[1.0] * len(names)] + [[float(a == b) for a, b in zip(c["_bins"], place)] for c in copies])
        y = np.array([own[key]["p"]] + [c["p"] for c in copies])
        w = np.sqrt(np.exp(-((z - 1) ** 2).sum(1) / (0.75**2 * len(names))))
        mx, my = w @ z / w.sum(), w @ y / w.sum()
        coef = np.linalg.solve((z - mx).T @ ((z - mx) * w[:, None]) + np.eye(len(names)), ((z - mx) * w[:, None]).T @ (y - my))
        assert {c["feature"]: c["weight"] for c in r["contributions"]} == pytest.approx(dict(zip(names, coef)), abs=1e-9)
        assert r["intercept"] == pytest.approx(my - mx @ coef)


def test_draws_within_a_bin_follow_the_cut_normal_law():
    part = (0.0, 2.0, 0.25, 0.5, 0.4)
    values = [lime.within(part, (i + 0.5) / 2000) for i in range(2000)]
    assert values == sorted(values) and 0.0 <= values[0] and values[-1] <= 2.0
    points = np.linspace(0, 2, 200_001)
    weight = np.exp(-((points - 0.5) ** 2) / (2 * 0.4**2))
    assert np.mean(values) == pytest.approx((points * weight).sum() / weight.sum(), abs=1e-3)
    assert lime.within((1.0, 1.0, 0.5, 1.0, 0.0), 0.3) == 1.0 and 5.0 <= lime.within((5.0, 6.0, 0.1, -90.0, 0.1), 0.5) <= 6.0


def test_rows_with_missing_values_or_no_prediction(spark, rows):
    scored = linear.score(rows)
    names = list(linear.DEMO.weights)
    bins = lime.fit_bins(scored, names)
    holes = scored.orderBy(ID).limit(3).select(ID, *names).withColumn(names[0], F.when(F.lit(False), 1.0))
    assert lime.explain_rows(holes, bins, linear.score, 50).count() == 0  # the linear model has no prediction then
    steady = lambda df: df.withColumn("p", F.lit(0.25))
    out = lime.explain_rows(holes, bins, steady, 50).collect()
    assert len(out) == 3 and all(r["local_prediction"] == pytest.approx(0.25) for r in out)
    assert lime.explain_rows(scored.limit(0).select(ID, *names), bins, linear.score, 50).count() == 0


def test_declared_categories_have_any_number_of_levels(rows):
    wide = rows.withColumn("carrier_id", (F.crc32(F.col(ID).cast("binary")) % 40).cast("int"))
    fitted = models.fit(wide, features.RAW_FEATURES, models.Settings(rounds=1, depth=2, categorical=True))
    levels = [x for x in fitted.model.coding.levels if x is not None]
    assert len(levels) == len(features.CATEGORICAL) and max(len(names) for names, _ in levels) == 40
    assert treeshap.tree_shap(fitted, wide, ID).count() == wide.count()
    assert len(fitted.model.trees[0]) > 1


def test_learning_rates_are_drawn_on_a_logarithmic_scale():
    rates = [models.draw_settings(models.Settings(), t).rate for t in range(200)]
    assert 0.3 < np.mean([r < 0.055 for r in rates]) < 0.7 and min(rates) >= 0.01 and max(rates) <= 0.3


def test_batch_digest_notices_any_change_and_is_chained(spark):
    heads = [__import__("hashlib").sha256(str(i).encode()).hexdigest() for i in range(3000)]
    frame = spark.createDataFrame([(h,) for h in heads], "chain_head string")
    digest = lambda df, **kw: audit.batch_digest(df, **kw).first()["digest"]
    whole = digest(frame)
    assert whole == digest(frame.repartition(7)) and audit.batch_digest(frame).first()["n_chains"] == 3000
    assert len({whole, digest(frame.where(F.col("chain_head") != heads[5])), digest(frame.unionByName(frame.limit(1))), digest(frame, previous="1" * 64), digest(frame.limit(0))}) == 5


def test_chained_imputation_learns_nothing_from_the_test_part(rows):
    base = rows.withColumn("rh_max", F.when(F.col(ID).cast("int") % 20 != 0, F.col("rh_max"))).select(ID, *features.RAW_FEATURES, TARGET)
    train, test = base.where(f"int({ID}) % 2 = 0"), base.where(f"int({ID}) % 2 = 1 OR int({ID}) % 40 = 0")
    other = test.withColumns({c: F.col(c) * 3 for c in ("rh_mean", "temp_mean_c")})
    a, b = (ablation.fill_missing(train, t, "mice") for t in (test, other))
    assert a[0].exceptAll(b[0]).count() == 0 and a[0].where("rh_max IS NULL").count() == 0
    assert a[1].where("rh_max IS NULL").count() == 0 and a[1].count() == test.count()


def test_chained_imputation_recovers_a_linear_column(spark):
    rng = np.random.default_rng(2)
    data = [(str(i), float(a), float(b), float(3 * a - 2 * b + 1)) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))]
    full = spark.createDataFrame(data, f"{ID} string, a double, b double, c double")
    holes = full.withColumn("c", F.when(F.col(ID).cast("int") % 9 != 0, F.col("c"))).withColumn("b", F.when(F.col(ID).cast("int") % 50 != 1, F.col("b")))
    out = iterative.mice(holes, ["a", "b", "c"], 5)
    err = out.join(full.select(ID, F.col("c").alias("t"), F.col("b").alias("u")), ID).agg(F.max(F.abs(F.col("c") - F.col("t"))), F.max(F.abs(F.col("b") - F.col("u")))).first()
    assert err[0] < 0.05 and err[1] < 0.05
    forest = iterative.missforest(holes, ["a", "b", "c"], 1, 10, 5)
    assert forest.where("c IS NULL OR b IS NULL").count() == 0 and forest.count() == 300


def test_training_labels_of_the_test_part_are_never_read(rows):
    base = rows.withColumn("rh_max", F.when(F.col(ID).cast("int") % 20 != 0, F.col("rh_max")))
    train, test = base.where(f"int({ID}) % 2 = 0"), base.where(f"int({ID}) % 2 = 1 OR int({ID}) % 40 = 0")
    flipped = test.withColumn(TARGET, 1 - F.col(TARGET))
    a = ablation.fill_missing(train, test, "class_conditional_median")[1].select(ID, "rh_max", "temp_recovery_rate")
    b = ablation.fill_missing(train, flipped, "class_conditional_median")[1].select(ID, "rh_max", "temp_recovery_rate")
    assert a.exceptAll(b).count() == 0 and a.where("rh_max IS NULL").count() == 0


def test_subspace_error_falls_with_width(rows):
    normal = rows.where(f"{TARGET} = 0")
    sizes = [anomaly.reconstruction_error(rows, anomaly.fit_subspace(normal, features.RAW_FEATURES, k)).agg(F.avg("recon_error"), F.min("recon_error")).first() for k in (2, 16)]
    assert sizes[0][0] > sizes[1][0] and sizes[1][1] >= 0


def test_isolation_forest_finds_far_rows(spark):
    rng = np.random.default_rng(1)
    data = [(str(i), *map(float, rng.normal(size=2)), 0) for i in range(500)] + [(f"x{i}", 20.0 + i, -20.0, 1) for i in range(10)]
    df = spark.createDataFrame(data, f"{ID} string, a double, b double, {TARGET} int")
    best = baselines.isolation_forest(df, ["a", "b"], (30,), 10 / 510).first()
    assert best["roc_auc"] > 0.99
    assert baselines.two_means(df, ["a", "b"], 2)[1].first()["adjusted_rand"] > 0.9


def test_forests_score_rows_as_single_walks_do(spark):
    """Trees of any shape, a single leaf too, filled up to their depth; several forests in one reading, NULL never above a cut."""
    rng = np.random.default_rng(4)
    data = [(str(i), float(a), float(b) if i % 7 else None) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))]
    df = spark.createDataFrame(data, f"{ID} string, a double, b double").repartition(3)
    leaf = pd.DataFrame({"feature": [-1], "cut": [0.0], "left": [-1], "path": [2.5]})
    trees = [*baselines.isolation_trees(df.fillna(0.0), ["a", "b"], 5, 300), leaf]
    expected = float(baselines._harmonic_path(baselines.SUBSAMPLE))

    def walk(tree, x):
        t, at = tree.reset_index(drop=True), 0
        while t["feature"][at] >= 0:
            at = t["left"][at] + (x[t["feature"][at]] is not None and x[t["feature"][at]] > t["cut"][at])
        return t["path"][at]

    got = baselines.isolation_columns(df, ["a", "b"], {"s": trees, "one": trees[:1]}).collect()
    assert len(got) == 300
    for r in got:
        paths = [walk(t, (r["a"], r["b"])) for t in trees]
        assert r["s"] == pytest.approx(2.0 ** (-np.mean(paths) / expected)) and r["one"] == pytest.approx(2.0 ** (-paths[0] / expected))


def test_plain_stages_bound_the_rows_of_a_task(spark):
    """Rows of few values are tiny when encoded; learners that keep partitions as objects still get a bounded number at once."""
    rows = spark.range(600_000).select(*[(F.col("id") % 3).cast("double").alias(f"x{i}") for i in range(10)]).coalesce(1)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(8 << 20))
    try:
        most = lambda df: max(r["count"] for r in df.groupBy(F.spark_partition_id().alias("part")).count().collect())
        assert most(stage(rows, "encoded")) == 600_000 and most(stage(rows, "plain", plain=True)) < 450_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_lime_stages_what_it_reads(spark, sf):
    assert learning._lime_rows(spark, sf).columns == [ID, *linear.DEMO.weights, TARGET, "p"]


def test_action_rules(spark):
    df = spark.createDataFrame([
        ("a", "High", ["temp_range_c"], 0.1, 0.9), ("b", "Medium", ["temp_range_c"], 0.1, 0.4), ("c", "Medium", ["door_opens", "sensor_gap_hours"], 0.1, 0.4),
        ("d", "Low", [], 0.9, 0.2), ("e", "Low", [], 0.1, 0.2)], f"{ID} string, risk_tier string, dominant_features array<string>, anomaly_score double, p double")
    got = {r[ID]: r["rule_id"] for r in decide.recommend(df, anomaly="anomaly_score", probability="p").collect()}
    assert got == {"a": "thermal_intervention", "b": "default", "c": "door_discipline", "d": "ae_discordance", "e": "diffuse"}


def test_audit_chain_detects_edits(rows):
    record = lambda *c: F.concat_ws("|", *[F.col(x).cast("string") for x in c])
    chained = stage(audit.decision_chain(rows.select(ID, "door_opens", "leg_count"), [record(ID, "door_opens"), record(ID, "leg_count")]))
    assert audit.verify_chain(chained).where("NOT intact").count() == 0
    edited = chained.withColumn("chain", F.transform("chain", lambda x, i: x.withField("record", F.when(i == 0, F.lit("forged")).otherwise(x["record"]))))
    assert audit.verify_chain(edited).where("intact").count() == 0
    assert audit.batch_digest(chained).first() == audit.batch_digest(chained.repartition(5)).first()
    assert audit.table_fingerprint(rows).first() == audit.table_fingerprint(rows.repartition(7)).first()


def test_payload_sink(spark, rows):
    df = linear.explain(linear.score(rows), linear.fit_means(rows)).withColumn("risk_tier", decide.risk_tier("p", 0.2))
    path = new_folder(spark, "payloads")
    explain.save_payloads(explain.payload(df, 0.2, "2024-01-01 00:00:00", "linear-1"), path)
    line = json.loads(spark.read.text(path).first()["value"])
    assert len(line["top_contributing_features"]) == 5 and line["threshold_used"] == 0.2
    assert spark.read.json(path).count() == rows.count()


def test_registry(spark):
    path = new_folder(spark, "registry")
    row = spark.createDataFrame([("smote", "gbt_a", 0.5), ("adasyn", "gbt_b", 0.7)], "balancing string, model string, f1_mean double")
    experiments.register(row, path)
    experiments.register(row.withColumn("balancing", F.lit("none")), path)
    table = experiments.load_registry(spark, path)
    assert table.count() == 4 and table.select("exp_id").distinct().count() == 4
    assert experiments.best(table).first()["model"] == "gbt_b"
    assert experiments.filter_registry(table, model="_b$", nope="x").count() == 2


def test_failed_variant_becomes_a_row(spark, rows):
    base = ablation.Experiment(model="no_such_model", n_splits=2, imputation="global_median", balancing="class_weight")
    out, best = ablation.run_stage(base, rows.select(*ORDERED_COLUMNS), "threshold", ["f1_max"])
    assert out.first()["status"].startswith("failed") and best == base


def test_variants_share_what_they_do_not_change(spark, rows, monkeypatch):
    fits, real = [], models.fit
    monkeypatch.setattr(models, "fit", lambda train, inputs, settings, *a, **k: fits.append(settings) or real(train, inputs, settings, *a, **k))
    quick = {**models.PRESETS, "gbt_a": models.Settings(rounds=3, depth=3)}
    base = ablation.Experiment(n_splits=2, imputation="global_median", balancing="class_weight", presets=quick)
    data, registry = rows.select(*ORDERED_COLUMNS), new_folder(spark, "registry")
    out, best = ablation.run_stage(base, data, "threshold", registry=registry)
    assert len(fits) == 2 and [r["status"] for r in out.collect()] == ["ok"] * 3
    alone = ablation.run(replace(base, threshold=best.threshold), data)
    assert alone.agg(F.avg("f1")).first()[0] == pytest.approx(out.agg(F.max("f1_mean")).first()[0])
    ablation.run_stage(base, data, "threshold", ["f1_max"], registry)  # a rerun leaves one row of each id
    table = experiments.load_registry(spark, registry)
    assert table.count() == 3 and table.select("exp_id").distinct().count() == 3


def test_registry_with_two_writers_and_a_rerun(spark):
    path = new_folder(spark, "registry")
    assert experiments.load_registry(spark, path).count() == 0
    make = lambda model, f1, day: spark.createDataFrame([(model, f1, f"2024-01-0{day}")], "model string, f1_mean double, timestamp string").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    models.at_once(lambda m: experiments.register(make(m, 0.5, 1), path), [f"m{i % 4}" for i in range(8)])
    assert sorted(r["model"] for r in experiments.load_registry(spark, path).collect()) == ["m0", "m1", "m2", "m3"]
    experiments.register(make("m1", 0.9, 3), path)
    experiments.register(make("m1", 0.1, 2), path)
    assert {r["model"]: r["f1_mean"] for r in experiments.load_registry(spark, path).collect()} == {"m0": 0.5, "m1": 0.9, "m2": 0.5, "m3": 0.5}


def test_winsorize_keeps_rows_and_missing(spark):
    df = spark.createDataFrame([(float(i),) for i in range(20)] + [(500.0,), (None,)], "x double")
    out = outliers.winsorize(df, outliers.fit_fences(df, ["x"]))
    assert out.count() == 22 and out.where("x IS NULL").count() == 1 and out.agg(F.max("x")).first()[0] < 500


def test_class_medians_without_label(spark):
    df = spark.createDataFrame([(None, None), (1.0, 0), (3.0, 1), (None, 1)], f"rh_max double, {TARGET} int")
    med = impute.fit_class_medians(df, ["rh_max"])
    assert sorted(r[0] for r in impute.fill_class_medians(df, med).collect()) == [1.0, 1.0, 3.0, 3.0]


def test_shared_folder_is_read_from_the_session(spark):
    assert checkpoint_root(spark) == spark.conf.get("spark.checkpoint.dir")
