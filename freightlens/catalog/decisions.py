"""Queries on attribution, decisions, anomaly flags, audit records and the experiment registry."""

from pyspark.sql import functions as F

from freightlens.catalog.registry import query
from freightlens.catalog.scoring import FEATURES, FILLED, FOLD_SQL, MODELS, TIER_VIEWS, VIEWS, point_sql, probability_sql
from freightlens.catalog.views import over, snap
from freightlens.functions.scalars import micros, snap as snapped, unpivot_structs
from freightlens.operators import anomaly, audit, baselines, decide, experiments, explain, features, folds, linear, metrics
from freightlens.plans.scoring import prepared, scored, staged_shipments, tiered
from freightlens.session import new_folder, stage
from freightlens.sources.shipments import ID, TARGET, shipments

W = linear.DEMO.weights
SHAP = "means AS (SELECT " + ", ".join(f"avg({f}) AS m_{f}" for f in W) + " FROM ff),\n" \
       "shap AS (SELECT t.*, " + ", ".join(snap(f"cast({w} AS double)*({f}-m_{f})") + f" AS s_{f}" for f, w in W.items()) + " FROM {src} t, means)"
LONG = "long AS (SELECT shipment_id, unnest([" + ", ".join(f"'{f}'" for f in W) + "]) AS feature, unnest([" \
       + ", ".join(f"s_{f}" for f in W) + "]) AS v FROM shap)"
RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY shipment_id ORDER BY abs(v) DESC, feature) AS r FROM long)"
SHAP_VIEWS = (FILLED, FEATURES, SHAP.format(src="ff"), LONG, RANKED)
EXPLAINED = (*TIER_VIEWS, SHAP.format(src="tiered"), LONG, RANKED)


@query("linear_shap", over("SELECT shipment_id, " + ", ".join(f"s_{f}" for f in W) + " FROM shap", *SHAP_VIEWS[:3]))
def linear_shap(spark, sf):
    rows = prepared(spark, sf)
    values = linear.attributions(linear.DEMO, linear.fit_means(rows))
    return rows.select(ID, *[v.alias(f"s_{f}") for f, v in values.items()])


@query("global_importance", over("SELECT feature, " + snap("avg(abs(v))") + " AS mean_abs_shap FROM long GROUP BY feature", *SHAP_VIEWS))
def global_importance(spark, sf):
    rows = prepared(spark, sf)
    return linear.global_importance(rows, linear.fit_means(rows))


def explained(spark, sf):
    rows = prepared(spark, sf)
    return linear.explain(linear.score(rows, linear.DEMO), linear.fit_means(rows))


@query("top_contributions", over("SELECT shipment_id, cast(r AS int) AS position, feature, v AS shap_value FROM ranked WHERE r<=5", *SHAP_VIEWS))
def top_contributions(spark, sf):
    top = explained(spark, sf).select(ID, F.posexplode(linear.top_k("contributions", 5)).alias("position", "c"))
    return top.select(ID, (F.col("position") + 1).alias("position"), "c.feature", "c.shap_value")


@query("local_explanation", over("""SELECT shipment_id, string_agg(feature || ':' || direction, ',' ORDER BY r) AS explanation,
  max(CASE WHEN r=1 THEN v END) AS leading_value FROM (SELECT *, CASE WHEN v>0 THEN 'increases_risk' ELSE 'decreases_risk' END AS direction FROM ranked)
  GROUP BY shipment_id""", *SHAP_VIEWS))
def local_explanation(spark, sf):
    words = F.transform("contributions", lambda c: F.concat_ws(":", c["feature"], c["direction"]))
    return explained(spark, sf).select(
        ID, F.concat_ws(",", words).alias("explanation"), F.get("contributions", F.lit(0))["shap_value"].alias("leading_value")
    )


@query("dominant_features", over("""SELECT s.shipment_id, coalesce(string_agg(l.feature, ',' ORDER BY l.feature), '') AS dominant
  FROM ff s LEFT JOIN (SELECT * FROM long WHERE abs(v)>cast(0.15 AS double)) l ON l.shipment_id=s.shipment_id GROUP BY s.shipment_id""", *SHAP_VIEWS))
def dominant_features(spark, sf):
    return explained(spark, sf).select(ID, F.concat_ws(",", decide.dominant_features("contributions")).alias("dominant"))


# a second ranking to compare with: attribution of the thermal-only model's inputs and transit inputs in one model
OTHER = linear.LinearModel(-12.0, {"temp_range_c": 0.5, "transit_days": 0.9, "rh_range": 2.0, "door_opens": 0.3, "sensor_gap_hours": 0.2}, "linear-2")
OTHER_SQL = "olong AS (SELECT shipment_id, unnest([" + ", ".join(f"'{f}'" for f in OTHER.weights) + "]) AS feature, unnest([" + ", ".join(
    snap(f"cast({w} AS double)*({f}-m_{f})") for f, w in OTHER.weights.items()) + "]) AS v FROM ff, means),\n" \
    "oranked AS (SELECT *, row_number() OVER (PARTITION BY shipment_id ORDER BY abs(v) DESC, feature) AS r FROM olong)"


@query("shap_lime_agreement", over(f"""SELECT a.shipment_id, first_top, second_top, {snap('n/cast(3 AS double)')} AS overlap_ratio FROM
  (SELECT shipment_id, string_agg(feature, ',' ORDER BY feature) AS first_top FROM ranked WHERE r<=3 GROUP BY shipment_id) a JOIN
  (SELECT shipment_id, string_agg(feature, ',' ORDER BY feature) AS second_top FROM oranked WHERE r<=3 GROUP BY shipment_id) b ON a.shipment_id=b.shipment_id JOIN
  (SELECT x.shipment_id, count(y.feature) AS n FROM (SELECT * FROM ranked WHERE r<=3) x LEFT JOIN (SELECT * FROM oranked WHERE r<=3) y
    ON x.shipment_id=y.shipment_id AND x.feature=y.feature GROUP BY x.shipment_id) c ON a.shipment_id=c.shipment_id""", *SHAP_VIEWS, OTHER_SQL))
def shap_lime_agreement(spark, sf):
    rows = prepared(spark, sf)
    means = linear.fit_means(rows)
    both = linear.explain(linear.explain(rows, means), means, OTHER, "other")
    return explain.agreement(both, both, 3, "contributions", "other")


@query("importance_drift", over(f"""SELECT coalesce(a.feature,b.feature) AS feature, cast(a.r AS int) AS old_rank, cast(b.r AS int) AS new_rank,
  {snap('coalesce(b.i,0)-coalesce(a.i,0)')} AS change FROM
  (SELECT *, row_number() OVER (ORDER BY i DESC, feature) AS r FROM (SELECT feature, {snap('avg(abs(v))')} AS i FROM long GROUP BY feature)) a FULL JOIN
  (SELECT *, row_number() OVER (ORDER BY i DESC, feature) AS r FROM (SELECT feature, {snap('avg(abs(v))')} AS i FROM olong GROUP BY feature)) b
  ON a.feature=b.feature""", *SHAP_VIEWS, OTHER_SQL))
def importance_drift(spark, sf):
    rows = prepared(spark, sf)
    means = linear.fit_means(rows)
    return explain.importance_drift(linear.global_importance(rows, means), linear.global_importance(rows, means, OTHER))


def decided(spark, sf):
    rows = prepared(spark, sf)
    means = linear.fit_means(rows)
    graded, theta = tiered(linear.score(rows, linear.DEMO))
    full = linear.explain(graded, means).withColumn("dominant_features", decide.dominant_features("contributions"))
    return full, theta


ERR_COLS = ["transit_days", "temp_range_c", "sensor_gap_hours", "vibration_index", "rh_mean"]
ERROR = "nrm AS (SELECT " + ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS d_{c}" for c in ERR_COLS) + " FROM ff WHERE silent_failure=0),\n" \
    "err AS (SELECT ff.*, " + snap("(" + "+".join(f"(({c}-a_{c})/d_{c})*(({c}-a_{c})/d_{c})" for c in ERR_COLS) + f")/cast({len(ERR_COLS)} AS double)") + " AS e FROM ff, nrm)"


def with_error(rows):
    stats = features.fit_standard(rows.where(F.col(TARGET) == 0), ERR_COLS)
    return anomaly.mean_error(rows, stats).withColumn("recon_error", snapped("recon_error"))


@query("payload_build", over(f"""SELECT t.shipment_id, floor(p*10000+0.5)/10000 AS failure_probability, risk_tier, floor(theta*10000+0.5)/10000 AS threshold_used,
  string_agg(feature, ',' ORDER BY r) AS top_features, max(CASE WHEN r=1 THEN v END) AS top_value, 'linear-1' AS model_version, 'LinearSHAP' AS explanation_method,
  floor(max(x.e)*10000+0.5)/10000 AS anomaly_reconstruction_score, 'LIME' AS corroboration_method,
  floor({snap('max(c.n)/cast(3 AS double)')}*10000+0.5)/10000 AS corroboration_agreement, '2024-01-01 00:00:00' AS run_at
  FROM tiered t JOIN ranked k ON k.shipment_id=t.shipment_id JOIN err x ON x.shipment_id=t.shipment_id JOIN
  (SELECT y.shipment_id, count(z.feature) AS n FROM (SELECT * FROM ranked WHERE r<=3) y LEFT JOIN (SELECT * FROM oranked WHERE r<=3) z
    ON y.shipment_id=z.shipment_id AND y.feature=z.feature GROUP BY y.shipment_id) c ON c.shipment_id=t.shipment_id
  WHERE r<=5 GROUP BY t.shipment_id, p, risk_tier, theta""", *EXPLAINED, OTHER_SQL, ERROR))
def payload_build(spark, sf):
    """All eleven fields; a second model's attributions stand in for the corroborating explanation."""
    decided_rows, theta = decided(spark, sf)
    rows = with_error(decided_rows)
    both = linear.explain(rows, linear.fit_means(rows), OTHER, "other")
    agreed = explain.agreement(both, both, 3, "contributions", "other").select(ID, "overlap_ratio")
    out = explain.payload(rows.join(agreed, ID), theta, "2024-01-01 00:00:00", linear.DEMO.version, "LinearSHAP", "recon_error", "overlap_ratio")
    top = F.col("top_contributing_features")
    return out.select(
        ID, "failure_probability", "risk_tier", "threshold_used", F.concat_ws(",", F.transform(top, lambda c: c["feature"])).alias("top_features"),
        F.get(top, F.lit(0))["shap_value"].alias("top_value"), "model_version", "explanation_method", "anomaly_reconstruction_score",
        "corroboration_method", "corroboration_agreement", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("run_at"),
    )


def _rule_sql(with_anomaly=False):
    rank = "CASE risk_tier WHEN 'High' THEN 2 WHEN 'Medium' THEN 1 ELSE 0 END"
    out = "CASE " + ("WHEN anomaly_score>0.8 AND p<0.5 THEN 'ae_discordance' " if with_anomaly else "")
    for rule_id, wanted, lowest, _, _ in decide.ACTION_RULES:
        out += f"WHEN {rank}>={decide.TIER_RANK[lowest]} AND list_has_any(dom, [{', '.join(repr(w) for w in wanted)}]) THEN '{rule_id}' "
    return out + "WHEN len(dom)=0 THEN 'diffuse' ELSE 'default' END"


_actions = ", ".join(f"('{r[0]}', '{r[-2]}')" for r in decide.ACTION_RULES) + ", " + ", ".join(
    f"('{r[0]}', '{r[1]}')" for r in (decide.DISCORDANCE, decide.DIFFUSE, decide.DEFAULT))
DOM = """domi AS (SELECT t.*, coalesce(l.dom, []) AS dom FROM tiered t LEFT JOIN
  (SELECT shipment_id, list(feature ORDER BY feature) AS dom FROM long WHERE abs(v)>cast(0.15 AS double) GROUP BY shipment_id) l ON l.shipment_id=t.shipment_id)"""


@query("action_map", over(f"""SELECT shipment_id, risk_tier, rule_id, action, array_to_string(dom, ',') AS dominant FROM
  (SELECT *, {_rule_sql()} AS rule_id FROM domi) JOIN (VALUES {_actions}) AS a(k, action) ON k=rule_id""", *EXPLAINED, DOM))
def action_map(spark, sf):
    out = decide.recommend(decided(spark, sf)[0])
    return out.select(ID, "risk_tier", "rule_id", "action", F.concat_ws(",", "dominant_features").alias("dominant"))


@query("anomaly_flag", over("""SELECT shipment_id, e AS recon_error, cast(CASE WHEN e>(SELECT quantile_cont(e,0.95) FROM err WHERE silent_failure=0) THEN 1 ELSE 0 END AS int) AS is_anomaly
  FROM err""", FILLED, FEATURES, ERROR))
def anomaly_flag(spark, sf):
    rows = with_error(prepared(spark, sf))
    return anomaly.flag(rows, anomaly.error_cut(rows)).select(ID, "recon_error", "is_anomaly")


@query("decision_record", over(f"""SELECT shipment_id, p, risk_tier, {snap('anomaly_score')} AS anomaly_score, rule_id, action, array_to_string(dom, ',') AS dominant FROM
  (SELECT *, {_rule_sql(True)} AS rule_id FROM (SELECT domi.*, x.anomaly_score FROM domi JOIN
     (SELECT shipment_id, cume_dist() OVER (ORDER BY e) AS anomaly_score FROM err) x ON x.shipment_id=domi.shipment_id))
  JOIN (VALUES {_actions}) AS a(k, action) ON k=rule_id""", *EXPLAINED, DOM, ERROR))
def decision_record(spark, sf):
    rows, _ = decided(spark, sf)
    out = decide.recommend(anomaly.percentile_score(with_error(rows)), anomaly="anomaly_score", probability="p")
    return out.select(ID, "p", "risk_tier", snapped("anomaly_score").alias("anomaly_score"), "rule_id", "action",
                      F.concat_ws(",", "dominant_features").alias("dominant"))


RECORDS_SQL = ["shipment_id || '|ingested|' || cast(door_opens AS varchar) || '|' || cast(leg_count AS varchar)",
               "shipment_id || '|scored|' || cast(m AS varchar)", "shipment_id || '|tiered|' || risk_tier"]
GENESIS = "0" * 64


def chained(spark, sf):
    rows, _ = tiered(scored(spark, sf))
    text = lambda *parts: F.concat_ws("|", *[p.cast("string") for p in parts])
    c = F.col
    return audit.decision_chain(rows, [
        text(c(ID), F.lit("ingested"), c("door_opens"), c("leg_count")), text(c(ID), F.lit("scored"), micros("p")),
        text(c(ID), F.lit("tiered"), c("risk_tier")),
    ])


@query("audit_chain", over(f"""SELECT shipment_id, sha256(sha256(sha256('{GENESIS}' || {RECORDS_SQL[0]}) || {RECORDS_SQL[1]}) || {RECORDS_SQL[2]}) AS chain_head
  FROM tiered""", *TIER_VIEWS))
def audit_chain(spark, sf):
    return chained(spark, sf).select(ID, "chain_head")


@query("audit_verify", over("SELECT shipment_id, cast(shipment_id AS bigint) % 17 NOT IN (3, 5) AS intact FROM tiered", *TIER_VIEWS))
def audit_verify(spark, sf):
    """Stored chains of which some were changed: a record where the id leaves 3 by 17, a digest where it leaves 5."""
    stored = stage(chained(spark, sf), "chains")
    left = F.col(ID).cast("bigint") % 17
    changed = F.transform("chain", lambda link, i: F.struct(
        F.when((left == 3) & (i == 1), F.concat(link["record"], F.lit("0"))).otherwise(link["record"]).alias("record"),
        F.when((left == 5) & (i == 0), F.sha2(link["digest"], 256)).otherwise(link["digest"]).alias("digest")))
    return audit.verify_chain(stored.withColumn("chain", changed))


@query("audit_batch_digest", over(f"""SELECT n_chains, sha256('{GENESIS}' || '=' || sha256(leaves)) AS digest FROM (
  SELECT cast(sum(n) AS bigint) AS n_chains, string_agg(digit || '=' || sha256(heads), '|' ORDER BY digit) AS leaves FROM (
    SELECT substr(head, 1, 1) AS digit, sum(n) AS n, string_agg(head || ':' || cast(n AS varchar), '|' ORDER BY head) AS heads FROM (
      SELECT sha256(sha256(sha256('{GENESIS}' || {RECORDS_SQL[0]}) || {RECORDS_SQL[1]}) || {RECORDS_SQL[2]}) AS head, count(*) AS n FROM tiered GROUP BY ALL)
    GROUP BY digit))""", *TIER_VIEWS))
def audit_batch_digest(spark, sf):
    return audit.batch_digest(chained(spark, sf))


@query("audit_reconstruct", over("""SELECT s.shipment_id, s.transit_days, s.carrier_id, s.silent_failure, t.p, t.risk_tier
  FROM shipments s JOIN tiered t ON s.shipment_id=t.shipment_id""", *TIER_VIEWS))
def audit_reconstruct(spark, sf):
    """Recorded decisions joined back to the shipment they were made for."""
    base = staged_shipments(spark, sf)
    recorded = tiered(scored(spark, sf, base=base))[0].select(ID, "p", "risk_tier")
    return base.select(ID, "transit_days", "carrier_id", TARGET).join(recorded, ID)


@query("table_fingerprint")
def table_fingerprint(spark, sf):
    return audit.table_fingerprint(shipments(spark, sf))


@query("adjusted_rand", over(f"""SELECT {snap('(b-l*r/a)/((l+r)/2-l*r/a)')} AS adjusted_rand FROM (SELECT
  (SELECT sum(cast(n AS double)*(n-1)/2) FROM (SELECT count(*) AS n FROM shipments GROUP BY leg_count, silent_failure)) AS b,
  (SELECT sum(cast(n AS double)*(n-1)/2) FROM (SELECT count(*) AS n FROM shipments GROUP BY leg_count)) AS l,
  (SELECT sum(cast(n AS double)*(n-1)/2) FROM (SELECT count(*) AS n FROM shipments GROUP BY silent_failure)) AS r,
  (SELECT cast(count(*) AS double)*(count(*)-1)/2 FROM shipments) AS a)"""))
def adjusted_rand(spark, sf):
    return baselines.adjusted_rand(shipments(spark, sf), "leg_count", TARGET)


# --- experiment registry over real fold results of three fixed models at three thresholds ---------------
THETAS = (20, 30, 50)
CELLS = [(name, t) for name in MODELS for t in THETAS]


def fold_results(spark, sf):
    """Metrics per (experiment, fold): all experiments are counted in one pass over the scored rows."""
    rows = folds.stratified_folds(prepared(spark, sf))
    rows = rows.withColumns({f"p_{n}": linear.probability(m) for n, m in MODELS.items()})
    counted = []
    for i, (name, t) in enumerate(CELLS):
        counted += [c.alias(f"{k}_{i}") for c, k in zip(
            metrics.confusion_aggregates(f"p_{name}", TARGET, t / 100), ("tn", "fp", "fn", "tp"))]
    wide = rows.groupBy("fold").agg(*counted)
    return wide.select("fold", unpivot_structs([
        F.struct(F.lit(f"linear_{n}_{t}").alias("exp_id"), F.lit(f"linear_{n}").alias("model"), F.lit(t / 100).alias("threshold"),
                 *[F.col(f"{k}_{i}").alias(k) for k in ("tn", "fp", "fn", "tp")]) for i, (n, t) in enumerate(CELLS)
    ])).withColumns(metrics.point_metrics())


def registry_rows(spark, sf):
    return metrics.aggregate_folds(fold_results(spark, sf), ["exp_id", "model", "threshold"], metrics.POINT_METRICS)


_folded = FOLD_SQL.format(src="ff")
_cells = " UNION ALL ".join(
    f"SELECT 'linear_{n}_{t}' AS exp_id, 'linear_{n}' AS model, cast({t / 100} AS double) AS threshold, fold, silent_failure AS y, "
    f"cast(floor(({probability_sql(MODELS[n])})*1000000+0.5) AS bigint)>={t * 10000} AS hit FROM folded" for n, t in CELLS)
FOLDS = f"""cells AS (SELECT exp_id, model, threshold, fold, count(*) FILTER (y=0 AND NOT hit) AS tn, count(*) FILTER (y=0 AND hit) AS fp,
  count(*) FILTER (y=1 AND NOT hit) AS fn, count(*) FILTER (y=1 AND hit) AS tp FROM ({_cells}) GROUP BY exp_id, model, threshold, fold),
pf AS (SELECT exp_id, model, threshold, fold, {', '.join(f'{e} AS {n}' for n, e in point_sql().items())} FROM cells),
reg AS (SELECT exp_id, model, threshold, {', '.join(f"{snap(f'avg({n})')} AS {n}_mean, {snap(f'stddev_samp({n})')} AS {n}_std" for n in metrics.POINT_METRICS)}
  FROM pf GROUP BY exp_id, model, threshold)"""
REG_VIEWS = (FILLED, FEATURES, _folded, FOLDS)


@query("fold_metrics_agg", over("SELECT * FROM reg", *REG_VIEWS))
def fold_metrics_agg(spark, sf):
    return registry_rows(spark, sf)


SUMMED = """ct AS (SELECT model, threshold, cast(sum(tn) AS bigint) AS tn, cast(sum(fp) AS bigint) AS fp, cast(sum(fn) AS bigint) AS fn,
  cast(sum(tp) AS bigint) AS tp FROM cells GROUP BY model, threshold)"""


@query("confusion_tables", over(f"""SELECT *, {', '.join(f"{snap(f'cast({a} AS double)/nullif({a}+{b},0)')} AS {a}_share" for a, b in
  (('tn', 'fp'), ('fp', 'tn'), ('fn', 'tp'), ('tp', 'fn')))} FROM ct""", *REG_VIEWS, SUMMED))
def confusion_tables(spark, sf):
    return metrics.confusion_table(fold_results(spark, sf), ["model", "threshold"])


@query("model_comparison", over("SELECT *, value = max(value) OVER (PARTITION BY metric, threshold) AS is_best FROM (" + " UNION ALL ".join(
    f"SELECT model, threshold, '{n}' AS metric, {snap(e)} AS value FROM ct" for n, e in point_sql().items()) + ")", *REG_VIEWS, SUMMED))
def model_comparison(spark, sf):
    return metrics.comparison_table(fold_results(spark, sf), ["model", "threshold"])


@query("registry_best", over("SELECT * FROM reg ORDER BY f1_mean DESC, exp_id LIMIT 1", *REG_VIEWS))
def registry_best(spark, sf):
    return experiments.best(registry_rows(spark, sf))


@query("registry_filter", over("SELECT * FROM reg WHERE regexp_matches(model, 't[hr]a?')", *REG_VIEWS))
def registry_filter(spark, sf):
    return experiments.filter_registry(registry_rows(spark, sf), model="t[hr]a?", unknown="x")


@query("registry_summary", over(f"SELECT model, count(*) AS n_experiments, {snap('max(f1_mean)')} AS best, {snap('avg(f1_mean)')} AS mean FROM reg GROUP BY model", *REG_VIEWS))
def registry_summary(spark, sf):
    return experiments.summary(registry_rows(spark, sf))


@query("registry_append", over("""SELECT 'exp_' || substr(sha256(concat_ws('|', 'global_median', '', '', model, cast(threshold AS varchar), '')), 1, 12) AS exp_id,
  'global_median' AS imputation, model, cast(threshold AS varchar) AS threshold, f1_mean, recall_mean, precision_mean, mcc_mean, mcc_std FROM reg""", *REG_VIEWS))
def registry_append(spark, sf):
    """Registered experiments, read back from the registry table."""
    path = new_folder(spark, "registry")
    rows = registry_rows(spark, sf).withColumn("imputation", F.lit("global_median")).withColumn("timestamp", F.lit("2024-01-01").cast("timestamp"))
    experiments.register(rows.withColumn("threshold", F.col("threshold").cast("string")), path)
    return experiments.load_registry(spark, path).select(
        "exp_id", "imputation", "model", "threshold", "f1_mean", "recall_mean", "precision_mean", "mcc_mean", "mcc_std")


@query("ablation_table", over("SELECT model, threshold, f1_mean, recall_mean, precision_mean, f1_mean - max(f1_mean) OVER () AS gap_to_best FROM reg", *REG_VIEWS))
def ablation_table(spark, sf):
    """The table behind the ablation charts: each variant with its distance from the best."""
    rows = stage(registry_rows(spark, sf), "registry-rows")
    best = F.broadcast(rows.agg(F.max("f1_mean").alias("_best")))  # one row
    return rows.join(best).select("model", "threshold", "f1_mean", "recall_mean", "precision_mean", (F.col("f1_mean") - F.col("_best")).alias("gap_to_best"))
