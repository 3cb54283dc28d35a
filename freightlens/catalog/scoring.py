"""Queries on features, imputation, outliers, scoring, thresholds and metrics."""

from pyspark.sql import functions as F

from freightlens.catalog.registry import query
from freightlens.catalog.views import ORDERED, over, snap
from freightlens.functions.scalars import snap as snapped
from freightlens.operators import collinearity, features, folds, impute, linear, metrics, outliers, thresholds
from freightlens.operators.decide import risk_tier, tier_distribution
from freightlens.plans.scoring import NO_SCALER, intervention_list, prepared, scored, staged_shipments, tiered
from freightlens.sources.shipments import ID, TARGET, shipments

FILLED = """med AS (SELECT quantile_cont(rh_max,0.5) AS rh, quantile_cont(temp_recovery_rate,0.5) AS tr FROM shipments),
filled AS (SELECT shipments.* REPLACE (coalesce(rh_max, rh) AS rh_max, coalesce(temp_recovery_rate, tr) AS temp_recovery_rate)
  FROM shipments, med)"""


def engineered(source: str, name: str) -> str:
    return f"""z_{name} AS (SELECT avg(temp_max_c-temp_min_c) AS rm, stddev_samp(temp_max_c-temp_min_c) AS rs,
  avg(sensor_gap_hours) AS gm, stddev_samp(sensor_gap_hours) AS gs FROM {source}),
{name} AS (SELECT *, transit_days*temp_range_c AS transit_x_temp_range, rh_range*temp_range_c AS rh_range_x_temp_range FROM (
  SELECT s.*, temp_max_c-temp_min_c AS temp_range_c,
   cast(0.4 AS double)*((temp_max_c-temp_min_c-rm)/(CASE WHEN rs=0 THEN 1 ELSE rs END))
   + cast(0.6 AS double)*((sensor_gap_hours-gm)/(CASE WHEN gs=0 THEN 1 ELSE gs END)) AS excursion_intensity,
   coalesce(vibration_index/nullif(transit_days,0),0) AS vibration_rate, rh_max-rh_mean AS rh_range,
   coalesce(cast(door_opens AS double)/nullif(transit_days,0),0) AS door_open_rate,
   ln(1+transit_days) AS log1p_transit_days, ln(1+sensor_gap_hours) AS log1p_sensor_gap_hours, ln(1+door_opens) AS log1p_door_opens,
   door_opens*sensor_gap_hours AS door_x_sensor_gap FROM {source} s, z_{name}))"""


RAW_FEATURES = engineered("shipments", "feats")
FEATURES = engineered("filled", "ff")


def margin_sql(model: linear.LinearModel) -> str:
    return " + ".join([f"cast({model.intercept} AS double)"] + [f"{f}*cast({w} AS double)" for f, w in model.weights.items()])


def probability_sql(model: linear.LinearModel) -> str:
    return snap(f"1/(1+exp(-({margin_sql(model)})))")


SCORED = f"scored AS (SELECT *, {probability_sql(linear.DEMO)} AS p FROM ff),\n" \
         "sm AS (SELECT *, cast(floor(p*1000000+0.5) AS bigint) AS m, silent_failure AS y FROM scored)"
VIEWS = (FILLED, FEATURES, SCORED)


def raw_engineered(spark, sf, scaler=False):
    base = staged_shipments(spark, sf)
    return features.engineer(base, features.fit_excursion(base) if scaler else NO_SCALER)


def _feature_query(name, columns, scaler=False):
    body = "SELECT shipment_id, " + ", ".join(f"{snap(c)} AS {c}" for c in columns) + " FROM feats"

    @query(name, over(body, RAW_FEATURES))
    def run(spark, sf):
        return raw_engineered(spark, sf, scaler).select(ID, *[snapped(c).alias(c) for c in columns])


_feature_query("fe_temp_range", ["temp_range_c"])
_feature_query("fe_excursion_intensity", ["excursion_intensity"], True)
_feature_query("fe_vibration_rate", ["vibration_rate"])
_feature_query("fe_rh_range", ["rh_range"])
_feature_query("fe_door_open_rate", ["door_open_rate"])
_feature_query("fe_log1p", features.LOGS)
_feature_query("fe_interactions", features.INTERACTIONS)

ENGINEERED = features.CORE + features.DOOR_RATE + features.LOGS + features.INTERACTIONS


def _set_query(label):
    columns = features.feature_set(label)
    listed = ", ".join(f"{snap(c)} AS {c}" if c in ENGINEERED else c for c in columns)

    @query("feature_set_" + label.lower().replace("-", "_"), over(f"SELECT shipment_id, {listed}, silent_failure FROM feats", RAW_FEATURES))
    def run(spark, sf):
        rows = features.select_features(raw_engineered(spark, sf, "excursion_intensity" in columns), label)
        return rows.withColumns({c: snapped(c) for c in columns if c in ENGINEERED} or {ID: F.col(ID)})


for _label in features.FEATURE_SETS:
    _set_query(_label)

FOLD_SQL = """folded AS (SELECT *, cast((row_number() OVER (PARTITION BY silent_failure
  ORDER BY (cast(shipment_id AS bigint)*7919)%1000003, shipment_id)-1)%5 AS int) AS fold FROM {src})"""


@query("stratified_folds", over("SELECT shipment_id, silent_failure, fold FROM folded", FOLD_SQL.format(src="shipments")))
def stratified_folds(spark, sf):
    return folds.stratified_folds(shipments(spark, sf).select(ID, TARGET)).select(ID, TARGET, "fold")


@query("tune_eval_split", over("""SELECT shipment_id, silent_failure, CASE WHEN (row_number() OVER (PARTITION BY silent_failure
  ORDER BY (cast(shipment_id AS bigint)*104729)%1000003, shipment_id)-1)%2=0 THEN 'tune' ELSE 'eval' END AS part FROM shipments"""))
def tune_eval_split(spark, sf):
    return folds.tune_eval(shipments(spark, sf).select(ID, TARGET)).select(ID, TARGET, "part")


@query("fe_fold_zscore", over(f"""SELECT f.shipment_id, f.fold, {snap('''cast(0.4 AS double)*((temp_max_c-temp_min_c-rm)/(CASE WHEN rs=0 THEN 1 ELSE rs END))
   + cast(0.6 AS double)*((sensor_gap_hours-gm)/(CASE WHEN gs=0 THEN 1 ELSE gs END))''')} AS excursion_intensity
  FROM folded f JOIN (SELECT a.k AS fold, avg(temp_max_c-temp_min_c) AS rm, stddev_samp(temp_max_c-temp_min_c) AS rs,
  avg(sensor_gap_hours) AS gm, stddev_samp(sensor_gap_hours) AS gs FROM (SELECT unnest([0,1,2,3,4]) AS k) a JOIN folded b ON b.fold<>a.k GROUP BY a.k) s
  ON f.fold=s.fold""", FOLD_SQL.format(src="shipments")))
def fe_fold_zscore(spark, sf):
    base = staged_shipments(spark, sf).select(ID, TARGET, "temp_max_c", "temp_min_c", "sensor_gap_hours")
    return features.fold_excursion(folds.stratified_folds(base)).select(ID, "fold", snapped("excursion_intensity").alias("excursion_intensity"))


SCALED = ["transit_days", "temp_mean_c", "temp_std_c", "rh_mean", "vibration_index", "feature_x1"]


@query("standardize", over("SELECT shipment_id, " + ", ".join(
    snap(f"({c}-(SELECT avg({c}) FROM shipments))/(SELECT stddev_pop({c}) FROM shipments)") + f" AS {c}" for c in SCALED) + " FROM shipments"))
def standardize(spark, sf):
    base = staged_shipments(spark, sf).select(ID, *SCALED)
    out = features.standardize(base, features.fit_standard(base, SCALED))
    return out.select(ID, *[snapped(c).alias(c) for c in SCALED])


ALL_NUMERIC = [c for c in ORDERED if c not in ("shipment_id", "silent_failure")] + [
    "temp_range_c", "vibration_rate", "rh_range", "door_open_rate", "log1p_transit_days", "log1p_sensor_gap_hours",
    "log1p_door_opens", "door_x_sensor_gap", "excursion_intensity", "transit_x_temp_range", "rh_range_x_temp_range"]
CORR = "corrs AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {snap(f'corr(cast({c} AS double), cast(silent_failure AS double))')} AS pearson_r FROM feats"
    for c in ALL_NUMERIC) + ")"


@query("feature_correlations", over("SELECT feature, pearson_r, abs(pearson_r) AS abs_r FROM corrs", RAW_FEATURES, CORR))
def feature_correlations(spark, sf):
    return features.correlations(raw_engineered(spark, sf, True))


_words = ", ".join("(" + ", ".join("'" + w.replace("'", "''") + "'" for w in (f, fam, d)) + ")" for f, fam, _, d in features.DESCRIPTIONS)


@query("feature_dictionary", over(f"""SELECT feature, pearson_r, coalesce(family,'unknown') AS family, coalesce(description, feature) AS description
  FROM corrs LEFT JOIN (VALUES {_words}) AS w(f, family, description) ON feature=f""", RAW_FEATURES, CORR))
def feature_dictionary(spark, sf):
    return features.with_descriptions(features.correlations(raw_engineered(spark, sf, True)).drop("abs_r"))


VIF3 = ["temp_mean_c", "temp_max_c", "rh_mean"]


@query("vif_report", over(f"""SELECT feature, {snap('vif')} AS vif, n AS n_rows FROM (
  SELECT n, unnest(['temp_mean_c','temp_max_c','rh_mean']) AS feature,
    unnest([aa*(bb*cc-bc*bc)/det, bb*(aa*cc-ac*ac)/det, cc*(aa*bb-ab*ab)/det]) AS vif FROM (
  SELECT *, aa*(bb*cc-bc*bc)-ab*(ab*cc-bc*ac)+ac*(ab*bc-bb*ac) AS det FROM (
  SELECT count(*) AS n, sum(a*a) AS aa, sum(a*b) AS ab, sum(a*c) AS ac, sum(b*b) AS bb, sum(b*c) AS bc, sum(c*c) AS cc
  FROM (SELECT {', '.join(f'{c} AS {v}' for c, v in zip(VIF3, 'abc'))} FROM shipments))))"""))
def vif_report(spark, sf):
    return collinearity.vif_report(shipments(spark, sf), VIF3)


@query("vif_filter")
def vif_filter(spark, sf):
    base = raw_engineered(spark, sf)
    columns = [c for c in features.feature_set("FS-B") if c not in features.CATEGORICAL and c != "excursion_intensity"]
    return collinearity.vif_filter(base.select(ID, *columns), columns)


CLASS_MED = """cm AS (SELECT silent_failure AS y, quantile_cont(rh_max,0.5) AS rh, quantile_cont(temp_recovery_rate,0.5) AS tr
  FROM shipments GROUP BY silent_failure)"""


@query("impute_class_median", over(
    "SELECT shipment_id, coalesce(rh_max, rh) AS rh_max, coalesce(temp_recovery_rate, tr) AS temp_recovery_rate FROM shipments JOIN cm ON y=silent_failure",
    CLASS_MED))
def impute_class_median(spark, sf):
    base = staged_shipments(spark, sf)
    medians = impute.fit_class_medians(base, staged=True)
    return impute.fill_class_medians(base, medians).select(ID, *impute.IMPUTED)


@query("impute_global_median", over("SELECT shipment_id, rh_max, temp_recovery_rate FROM filled", FILLED))
def impute_global_median(spark, sf):
    base = staged_shipments(spark, sf)
    return impute.fill_medians(base, impute.fit_medians(base, staged=True)).select(ID, *impute.IMPUTED)


FENCED = [c for c in ORDERED if c not in ("shipment_id", "silent_failure", *features.CATEGORICAL)]
FENCES = "fences AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, q1-1.5*(q3-q1) AS lo, q3+1.5*(q3-q1) AS hi FROM (SELECT quantile_cont(cast({c} AS double),0.25) AS q1, quantile_cont(cast({c} AS double),0.75) AS q3 FROM shipments)"
    for c in FENCED) + ")"


@query("outlier_fences", over(f"SELECT feature, {snap('lo')} AS lower_fence, {snap('hi')} AS upper_fence FROM fences", FENCES))
def outlier_fences(spark, sf):
    base = staged_shipments(spark, sf)
    return outliers.fence_table(base, outliers.fit_fences(base, staged=True)).select("feature", "lower_fence", "upper_fence")


@query("outlier_report", over(" UNION ALL ".join(
    f"SELECT '{c}' AS feature, {snap('max(lo)')} AS lower_fence, {snap('max(hi)')} AS upper_fence, count(*) FILTER ({c}<lo OR {c}>hi) AS n_outliers, "
    f"{snap(f'count(*) FILTER ({c}<lo OR {c}>hi)*cast(100 AS double)/count(*)')} AS outlier_pct FROM shipments, (SELECT * FROM fences WHERE feature='{c}')"
    for c in FENCED), FENCES))
def outlier_report(spark, sf):
    base = staged_shipments(spark, sf)
    return outliers.fence_table(base, outliers.fit_fences(base, staged=True))


@query("winsorize", over("SELECT shipment_id, " + ", ".join(
    snap(f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c},(SELECT lo FROM fences WHERE feature='{c}')),(SELECT hi FROM fences WHERE feature='{c}')) END") + f" AS {c}"
    for c in FENCED) + " FROM shipments", FENCES))
def winsorize(spark, sf):
    base = staged_shipments(spark, sf)
    out = outliers.winsorize(base, outliers.fit_fences(base, staged=True))
    return out.select(ID, *[snapped(c).alias(c) for c in FENCED])


@query("class_weights", over(f"""SELECT silent_failure, {snap('CASE WHEN silent_failure=1 THEN w ELSE 1 END')} AS weight, count(*) AS n_rows
  FROM shipments, (SELECT cast(count(*) FILTER (silent_failure=0) AS double)/greatest(count(*) FILTER (silent_failure=1),1) AS w FROM shipments)
  GROUP BY silent_failure, w"""))
def class_weights(spark, sf):
    from freightlens.operators.balance import with_class_weight

    rows = with_class_weight(shipments(spark, sf))
    return rows.groupBy(TARGET, "weight").agg(F.count("*").alias("n_rows")).withColumn("weight", snapped("weight"))


@query("linear_score", over("SELECT shipment_id, p FROM scored", *VIEWS))
def linear_score(spark, sf):
    return scored(spark, sf).select(ID, "p")


def sweep_view(lo, hi):
    return f"""sw AS (SELECT cast(i AS double)/100 AS theta, tn, fp, fn, tp,
  {snap('CASE WHEN tp+fn=0 THEN 0 ELSE cast(tp AS double)/(tp+fn) END')} AS recall,
  {snap('CASE WHEN tp+fp=0 THEN 0 ELSE cast(tp AS double)/(tp+fp) END')} AS precision,
  {snap('CASE WHEN 2*tp+fp+fn=0 THEN 0 ELSE cast(2*tp AS double)/(2*tp+fp+fn) END')} AS f1,
  cast(fp AS double)+20*fn+2*tp AS cost FROM (
  SELECT i, count(*) FILTER (y=0 AND m<i*10000) AS tn, count(*) FILTER (y=0 AND m>=i*10000) AS fp,
   count(*) FILTER (y=1 AND m<i*10000) AS fn, count(*) FILTER (y=1 AND m>=i*10000) AS tp
  FROM sm, (SELECT unnest(range({lo},{hi}+1)) AS i) GROUP BY i))"""


@query("threshold_sweep", over("SELECT * FROM sw", *VIEWS, sweep_view(5, 50)))
def threshold_sweep(spark, sf):
    return thresholds.sweep(scored(spark, sf))


COST_PICK = """pick AS (SELECT * FROM (SELECT theta, recall, precision, f1, cost, true AS floor_reached FROM sw WHERE floor(recall*10000+0.5)>=9500
   ORDER BY cost, theta LIMIT 1) UNION ALL SELECT * FROM (SELECT theta, recall, precision, f1, cost, false FROM sw
   WHERE NOT EXISTS (SELECT 1 FROM sw WHERE floor(recall*10000+0.5)>=9500) ORDER BY floor(recall*10000+0.5) DESC, theta LIMIT 1))"""


@query("threshold_cost", over("SELECT * FROM pick", *VIEWS, sweep_view(5, 50), COST_PICK))
def threshold_cost(spark, sf):
    return thresholds.pick_cost(thresholds.sweep(scored(spark, sf)))


@query("threshold_f1", over("SELECT theta, recall, precision, f1 FROM sw ORDER BY floor(f1*10000+0.5) DESC, theta LIMIT 1", *VIEWS, sweep_view(5, 94)))
def threshold_f1(spark, sf):
    return thresholds.pick_f1(thresholds.sweep(scored(spark, sf), thresholds.F1_GRID))


CURVE = """h AS (SELECT m, count(*) FILTER (y=1) AS pos, count(*) FILTER (y=0) AS neg FROM sm GROUP BY m),
curve AS (SELECT m, pos, neg, cast(sum(pos) OVER (ORDER BY m DESC) AS bigint) AS tp, cast(sum(neg) OVER (ORDER BY m DESC) AS bigint) AS fp,
  cast(sum(pos) OVER () AS bigint) AS ps, cast(sum(neg) OVER () AS bigint) AS ns FROM h)"""


@query("threshold_youden", over(f"""SELECT CASE WHEN g>0 THEN cast(m AS double)/1000000 ELSE cast('inf' AS double) END AS theta,
  {snap('CASE WHEN g>0 THEN cast(tp AS double)/ps ELSE 0 END')} AS tpr, {snap('CASE WHEN g>0 THEN cast(fp AS double)/ns ELSE 0 END')} AS fpr
  FROM (SELECT *, cast(tp AS double)*ns-cast(fp AS double)*ps AS g FROM curve ORDER BY g DESC, m DESC LIMIT 1)""", *VIEWS, CURVE))
def threshold_youden(spark, sf):
    return thresholds.pick_youden(scored(spark, sf))


RAW_SCORE = """raw_h AS (SELECT vibration_index/(vibration_index+cast(7 AS double)) AS s, count(*) FILTER (silent_failure=1) AS pos,
  count(*) FILTER (silent_failure=0) AS neg FROM shipments GROUP BY 1),
raw_c AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp, sum(pos) OVER () AS ps, sum(neg) OVER () AS ns FROM raw_h)"""


def _raw_scores(spark, sf):
    """A score with all its digits, as a trained model gives it."""
    return shipments(spark, sf).select(TARGET, (F.col("vibration_index") / (F.col("vibration_index") + 7.0)).alias("p"))


@query("roc_auc_raw", over(f"""SELECT {snap('sum(cast(neg AS double)*(cast(tp AS double)-pos/cast(2 AS double)))/(max(cast(ps AS double))*max(cast(ns AS double)))')} AS roc_auc
  FROM raw_c""", RAW_SCORE))
def roc_auc_raw(spark, sf):
    return metrics.roc_auc(_raw_scores(spark, sf))


@query("youden_raw", over(f"""SELECT s AS theta, {snap('cast(tp AS double)/ps')} AS tpr, {snap('cast(fp AS double)/ns')} AS fpr
  FROM raw_c ORDER BY cast(tp AS double)*ns-cast(fp AS double)*ps DESC, s DESC LIMIT 1""", RAW_SCORE))
def youden_raw(spark, sf):
    return thresholds.pick_youden(_raw_scores(spark, sf))


def point_sql(prefix=""):
    tn, fp, fn, tp = [f"cast({prefix}{k} AS double)" for k in ("tn", "fp", "fn", "tp")]
    div = lambda a, b: f"coalesce(({a})/nullif({b},0),0)"
    return {
        "f1": div(f"2*{tp}", f"2*{tp}+{fp}+{fn}"), "recall": div(tp, f"{tp}+{fn}"), "precision": div(tp, f"{tp}+{fp}"),
        "specificity": div(tn, f"{tn}+{fp}"),
        "mcc": div(f"{tp}*{tn}-{fp}*{fn}", f"sqrt(({tp}+{fp})*({tp}+{fn})*({tn}+{fp})*({tn}+{fn}))"),
    }


CONF = """conf AS (SELECT count(*) FILTER (y=0 AND m<300000) AS tn, count(*) FILTER (y=0 AND m>=300000) AS fp,
  count(*) FILTER (y=1 AND m<300000) AS fn, count(*) FILTER (y=1 AND m>=300000) AS tp FROM sm)"""
POINTS = ", ".join(f"{snap(e)} AS {n}" for n, e in point_sql().items())
AUC = snap("(SELECT sum(cast(neg AS double)*(tp-pos/cast(2 AS double)))/(cast(max(ps) AS double)*max(ns)) FROM curve)")
AP = snap("(SELECT sum(cast(pos AS double)*(cast(tp AS double)/(tp+fp)))/max(ps) FROM curve)")
LOSS = snap("(SELECT avg(-CASE WHEN y=1 THEN ln(q) ELSE ln(1-q) END) FROM (SELECT y, least(greatest(p,2.220446049250313e-16),1-2.220446049250313e-16) AS q FROM sm))")
BRIER = snap("(SELECT avg((p-y)*(p-y)) FROM sm)")


@query("classification_metrics", over(f"SELECT tn, fp, fn, tp, {POINTS} FROM conf", *VIEWS, CONF))
def classification_metrics(spark, sf):
    return metrics.classification_metrics(scored(spark, sf), 0.30)


@query("roc_auc", over(f"SELECT {AUC} AS roc_auc", *VIEWS, CURVE))
def roc_auc(spark, sf):
    return metrics.roc_auc(scored(spark, sf))


@query("average_precision", over(f"SELECT {AP} AS pr_auc", *VIEWS, CURVE))
def average_precision(spark, sf):
    return metrics.average_precision(scored(spark, sf))


@query("log_loss_brier", over(f"SELECT {LOSS} AS log_loss, {BRIER} AS brier", *VIEWS))
def log_loss_brier(spark, sf):
    return metrics.log_loss_brier(scored(spark, sf))


ALL_METRICS = f"am AS (SELECT {POINTS}, {AUC} AS roc_auc, {AP} AS pr_auc, {LOSS} AS log_loss, {BRIER} AS brier, cast(0.3 AS double) AS threshold, tn, fp, fn, tp FROM conf)"


@query("all_metrics", over("SELECT * FROM am", *VIEWS, CURVE, CONF, ALL_METRICS))
def all_metrics(spark, sf):
    return metrics.all_metrics(scored(spark, sf), 0.30)


@query("target_gate", over("""SELECT metric, value, target, value>=target AS passed FROM (SELECT unnest(['f1','roc_auc','recall','precision']) AS metric,
  unnest([f1,roc_auc,recall,precision]) AS value, unnest([cast(0.90 AS double),0.92,0.95,0.55]) AS target FROM am)""", *VIEWS, CURVE, CONF, ALL_METRICS))
def target_gate(spark, sf):
    return metrics.target_gate(metrics.all_metrics(scored(spark, sf), 0.30))


@query("bootstrap_ci")
def bootstrap_ci(spark, sf):
    return metrics.bootstrap_ci(scored(spark, sf), 0.30)


@query("roc_curve_points", over(f"SELECT cast(m AS double)/1000000 AS threshold, {snap('cast(fp AS double)/ns')} AS fpr, {snap('cast(tp AS double)/ps')} AS tpr FROM curve", *VIEWS, CURVE))
def roc_curve_points(spark, sf):
    return metrics.roc_points(scored(spark, sf))


@query("pr_curve_points", over(f"SELECT cast(m AS double)/1000000 AS threshold, {snap('cast(tp AS double)/(tp+fp)')} AS precision, {snap('cast(tp AS double)/ps')} AS recall FROM curve", *VIEWS, CURVE))
def pr_curve_points(spark, sf):
    return metrics.pr_points(scored(spark, sf))


TIERED = """tiered AS (SELECT sm.*, pick.theta AS theta, CASE WHEN m>=cast(floor((pick.theta+cast(0.35 AS double))*1000000+0.5) AS bigint) THEN 'High'
  WHEN m>=cast(floor(pick.theta*1000000+0.5) AS bigint) THEN 'Medium' ELSE 'Low' END AS risk_tier FROM sm, pick)"""
TIER_VIEWS = (*VIEWS, sweep_view(5, 50), COST_PICK, TIERED)


@query("risk_tier", over("SELECT shipment_id, p, theta, risk_tier FROM tiered", *TIER_VIEWS))
def risk_tier_query(spark, sf):
    return intervention_list(spark, sf)


@query("risk_distribution", over(f"SELECT risk_tier, count(*) AS count, {snap('count(*)*cast(100 AS double)/(SELECT count(*) FROM tiered)')} AS pct FROM tiered GROUP BY risk_tier", *TIER_VIEWS))
def risk_distribution(spark, sf):
    return tier_distribution(tiered(scored(spark, sf))[0])


THERMAL = linear.LinearModel(-9.0, {"temp_range_c": 0.9, "door_opens": 0.1}, "linear-thermal")
TRANSIT = linear.LinearModel(-9.5, {"transit_days": 0.8, "sensor_gap_hours": 0.5}, "linear-transit")
MODELS = {"full": linear.DEMO, "thermal": THERMAL, "transit": TRANSIT}


@query("soft_vote", over(f"SELECT shipment_id, {snap('p1*cast(0.5 AS double)+p2*cast(0.25 AS double)+p3*cast(0.25 AS double)')} AS p_vote FROM (SELECT shipment_id, "
       + ", ".join(f"{probability_sql(m)} AS p{i}" for i, m in enumerate(MODELS.values(), 1)) + " FROM ff)", FILLED, FEATURES))
def soft_vote(spark, sf):
    rows = prepared(spark, sf).withColumns({f"p{i}": linear.probability(m) for i, m in enumerate(MODELS.values(), 1)})
    return rows.select(ID, snapped(linear.soft_vote(["p1", "p2", "p3"], [2.0, 1.0, 1.0])).alias("p_vote"))
