"""A spread of registered queries against their SQL answers on the smallest tables (tools/check.py runs all of them)."""

import check
import pytest

import __spark_entry__ as entry_module

QUERIES, ORACLE = entry_module.queries(), entry_module.oracle_sql()
SPREAD = [
    "scan_shipments", "validate_types", "quarantine_summary", "profile_descriptive", "profile_duplicates", "feature_set_fs_f",
    "feature_correlations", "stratified_folds", "fe_fold_zscore", "outlier_report", "vif_report", "impute_class_median",
    "knn_topk", "threshold_sweep", "threshold_cost", "threshold_youden", "all_metrics", "risk_distribution", "action_map",
    "decision_record", "audit_chain", "registry_best", "ks_two_sample", "target_encode", "telemetry_rollup", "telemetry_sessions",
]


@pytest.fixture(scope="module")
def con(sf):
    return check.connect(sf)


@pytest.mark.parametrize("name", SPREAD)
def test_same_rows_as_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    cur = con.execute(ORACLE[name])
    assert check.compare([tuple(r) for r in df.collect()], df.columns, cur.fetchall(), [d[0] for d in cur.description]) is None


def test_every_answer_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert len(QUERIES) > 110


def test_entry(spark):
    got = entry_module.entry(spark)
    assert got.columns == ["shipment_id", "p", "theta", "risk_tier"] and got.count() == 1473
