"""Queries that train models. All use the full settings of each model, also those that fit many of them (out-of-fold
predictions, ensembles, search, experiments). Every one reads all rows."""

from pyspark.sql import functions as F

from freightlens.catalog.decisions import FOLD_SQL
from freightlens.catalog.registry import query
from freightlens.catalog.views import over, snap
from freightlens.functions.scalars import snap as snapped
from freightlens.operators import anomaly, baselines, experiments, explain, features, iterative, lime, linear, metrics, models, networks, thresholds, treeshap
from freightlens.operators.folds import hashed_order, stratified_folds
from freightlens.plans import ablation
from freightlens.plans.scoring import prepared, scored
from freightlens.session import new_folder, stage
from freightlens.sources.shipments import ID, TARGET, shipments

INPUTS = features.RAW_FEATURES
TRIO = {n: models.PRESETS[n] for n in ("gbt_a", "gbt_b", "gbt_c")}


def _rows(spark, sf):
    return stage(prepared(spark, sf).select(ID, *INPUTS, TARGET), "model-rows")


def _split(rows):
    folded = stage(stratified_folds(rows, 5, hashed_order()), "split")
    return folded.where("fold <> 0").drop("fold"), folded.where("fold = 0").drop("fold")


def _model_query(name):
    @query(name)
    def run(spark, sf):
        train, test = _split(_rows(spark, sf))
        return metrics.all_metrics(models.fit(train, INPUTS, models.PRESETS[name]).score(test), 0.5)


for _name in models.PRESETS:
    _model_query(_name)


@query("lr_grid")
def lr_grid(spark, sf):
    train, test = _split(_rows(spark, sf))
    fitted = models.fit(train, INPUTS, models.PRESETS["logistic_reg"])
    return metrics.all_metrics(fitted.score(test), 0.5)


@query("target_encode", over(f"""SELECT f.shipment_id, f.carrier_id, f.fold,
  {snap('((la.s-coalesce(lf.s,0))+cast(10 AS double)*((t.s-tf.s)/cast(t.n-tf.n AS double)))/((la.n-coalesce(lf.n,0))+cast(10 AS double))')} AS carrier_id_te
  FROM folded f JOIN (SELECT carrier_id, count(*) AS n, sum(silent_failure) AS s FROM folded GROUP BY carrier_id) la ON la.carrier_id=f.carrier_id
  JOIN (SELECT carrier_id, fold, count(*) AS n, sum(silent_failure) AS s FROM folded GROUP BY carrier_id, fold) lf ON lf.carrier_id=f.carrier_id AND lf.fold=f.fold
  JOIN (SELECT fold, count(*) AS n, sum(silent_failure) AS s FROM folded GROUP BY fold) tf ON tf.fold=f.fold,
  (SELECT count(*) AS n, sum(silent_failure) AS s FROM folded) t""", FOLD_SQL.format(src="shipments")))
def target_encode(spark, sf):
    rows = stratified_folds(shipments(spark, sf).select(ID, "carrier_id", TARGET))
    return models.target_encode(rows, ["carrier_id"]).select(ID, "carrier_id", "fold", snapped("carrier_id_te").alias("carrier_id_te"))


@query("oof_predictions")
def oof_predictions(spark, sf):
    return models.oof_predictions(_rows(spark, sf), INPUTS, TRIO)


@query("soft_vote_trained")
def soft_vote_trained(spark, sf):
    train, test = _split(_rows(spark, sf))
    return metrics.all_metrics(models.fit_vote(train, INPUTS, TRIO).score(test), 0.5)


@query("stacking")
def stacking(spark, sf):
    train, test = _split(_rows(spark, sf))
    return metrics.all_metrics(models.fit_stacking(train, INPUTS, TRIO).score(test), 0.5)


@query("random_search")
def random_search(spark, sf):
    """Every trial of every model's search space, with all that it drew."""
    train, tune = _split(_rows(spark, sf))
    rows = []
    for name, space in models.SEARCH_SPACES.items():
        _, log = models.random_search(train, tune, INPUTS, models.PRESETS[name], space=space)
        rows += [(name, t, s.depth, s.rate, s.rounds, s.subsample, s.feature_share, s.min_rows, s.min_gain, o) for t, s, o in log]
    return spark.createDataFrame(rows, "model string, trial int, depth int, rate double, rounds int, subsample double, feature_share string, "
                                       "min_rows int, min_gain double, objective double")


@query("kmeans")
def kmeans(spark, sf):
    return baselines.two_means(_rows(spark, sf), INPUTS)[1]


@query("isolation_forest")
def isolation_forest(spark, sf):
    return baselines.isolation_forest(_rows(spark, sf), INPUTS)


def _errors(spark, sf, fn):
    rows = _rows(spark, sf)
    subspace = anomaly.fit_subspace(rows.where(F.col(TARGET) == 0), INPUTS)
    out = stage(fn(rows, subspace), "errors")
    return anomaly.flag(out, anomaly.error_cut(out)).select(ID, snapped("recon_error").alias("recon_error"), "is_anomaly")


@query("pca_recon_error")
def pca_recon_error(spark, sf):
    return _errors(spark, sf, anomaly.reconstruction_error)


@query("ppca_recon_error")
def ppca_recon_error(spark, sf):
    return _errors(spark, sf, anomaly.probabilistic_error)


@query("mlp_recon_error")
def mlp_recon_error(spark, sf):
    rows = _rows(spark, sf)
    out = stage(networks.network_error(rows, networks.fit_network(rows.where(F.col(TARGET) == 0), INPUTS)), "errors")
    return anomaly.flag(out, anomaly.error_cut(out)).select(ID, snapped("recon_error").alias("recon_error"), "is_anomaly")


@query("tree_shap")
def tree_shap(spark, sf):
    rows = _rows(spark, sf)
    return treeshap.tree_shap(models.fit(rows, INPUTS, models.PRESETS["gbt_a"]), rows, ID)


@query("tree_shap_forest")
def tree_shap_forest(spark, sf):
    rows = _rows(spark, sf)
    return treeshap.tree_shap(models.fit(rows, INPUTS, models.PRESETS["random_forest"]), rows, ID)


def _lime(rows):
    """Every shipment at or above the cost-optimal threshold, explained with the full number of samples."""
    names = list(linear.DEMO.weights)
    bins = lime.fit_bins(rows, names, staged=True)
    risky = rows.where(F.col("p") >= thresholds.optimize(rows, "asymmetric_cost")).select(ID, *names)
    return lime.explain_rows(risky, bins, lambda df: linear.score(df, linear.DEMO)), risky


def _lime_rows(spark, sf):
    return stage(scored(spark, sf).select(ID, *linear.DEMO.weights, TARGET, "p"), "lime", plain=True)


@query("lime")
def lime_query(spark, sf):
    return _lime(_lime_rows(spark, sf))[0]


@query("lime_agreement")
def lime_agreement(spark, sf):
    rows = _lime_rows(spark, sf)
    local, risky = _lime(rows)
    exact = linear.explain(risky, linear.fit_means(rows))
    return explain.mean_agreement(explain.agreement(exact, local))


@query("impute_mice")
def impute_mice(spark, sf):
    out = iterative.mice(shipments(spark, sf).select(ID, *INPUTS), INPUTS)
    return out.select(ID, *[snapped(c).alias(c) for c in ("rh_max", "temp_recovery_rate")])


@query("impute_missforest")
def impute_missforest(spark, sf):
    out = iterative.missforest(shipments(spark, sf).select(ID, *INPUTS), INPUTS)
    return out.select(ID, *[snapped(c).alias(c) for c in ("rh_max", "temp_recovery_rate")])


BASE = ablation.Experiment()


@query("experiment_single")
def experiment_single(spark, sf):
    return ablation.run(BASE, stage(shipments(spark, sf), "experiment"))


@query("ablation_stage")
def ablation_stage(spark, sf):
    """The threshold stage, its variants appended to a registry and read back from it."""
    registry = new_folder(spark, "registry")
    ablation.run_stage(BASE, stage(shipments(spark, sf), "experiment"), "threshold", registry=registry)
    return experiments.load_registry(spark, registry).drop("runtime_s", "timestamp")
