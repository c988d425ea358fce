"""Sources, sinks and small guards: A2, A3, A10, A11, A12, B21, E7, S2."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from txnwatch.operators.features import fit_encoder
from txnwatch.operators.iforest import fit_isolation_forest, score_forest
from txnwatch.operators.logistic import fit_logistic
from txnwatch.plans import dashboard as dash
from txnwatch.plans import monitoring as mon
from txnwatch.plans.training import ModelBundle, load_models, save_models
from txnwatch.schema import NUMERIC_FEATURES
from txnwatch.sources import store
from txnwatch.sources.fixtures import fixture_views, raw_from_events
from txnwatch.sources.tables import choose_source, has_required_columns, read_table, require_columns, write_raw

from conftest import SF_SMALL


def test_required_columns(spark):
    raw = raw_from_events(read_table(spark, SF_SMALL, "events"))
    assert has_required_columns(raw)
    assert not has_required_columns(raw.drop("Class"))
    with pytest.raises(ValueError):
        require_columns(raw, ["Time", "nope"])


def test_choose_source_first_valid_wins_and_is_cached(spark):
    root = tempfile.mkdtemp(prefix="src-")
    raw = raw_from_events(read_table(spark, SF_SMALL, "events"))
    write_raw(raw.drop("Class"), f"{root}/bad", "csv")
    write_raw(raw, f"{root}/good", "csv")
    got = choose_source(spark, [(f"{root}/missing", "csv"), (f"{root}/bad", "csv"), (f"{root}/good", "csv")],
                        cache_path=f"{root}/cache")
    assert got.count() == raw.count()
    again = choose_source(spark, [], cache_path=f"{root}/cache")  # cached copy is used
    assert again.count() == raw.count()
    with pytest.raises(ValueError):
        choose_source(spark, [(f"{root}/bad", "csv")], cache_path=f"{root}/cache", force_refresh=True)


def test_json_summary_round_trip(spark):
    path = tempfile.mkdtemp(prefix="json-") + "/summary"
    store.write_json_summary(spark, {"rows": 3, "auc": 0.5}, path)
    assert store.read_json_summary(spark, path) == {"rows": 3, "auc": 0.5}


def test_models_round_trip(spark):
    txn, _ = fixture_views(read_table(spark, SF_SMALL, "events"))
    data = txn.select("transaction_id", "label", *NUMERIC_FEATURES, "channel", "merchant_category").cache()
    clf = fit_logistic(data, "label", fit_encoder(data))
    forest = fit_isolation_forest(data.select("transaction_id", *NUMERIC_FEATURES), NUMERIC_FEATURES,
                                  "transaction_id", n_trees=5)
    root = tempfile.mkdtemp(prefix="models-")
    save_models(spark, ModelBundle(clf, forest, {"roc_auc": 0.5}), root)
    back = load_models(spark, root)
    a = data.select(clf.probability()).collect()
    b = data.select(back.classifier.probability()).collect()
    assert a == b
    s1 = score_forest(data.select("transaction_id", *NUMERIC_FEATURES), forest).select("anomaly_score").collect()
    s2 = score_forest(data.select("transaction_id", *NUMERIC_FEATURES), back.forest).select("anomaly_score").collect()
    assert s1 == s2
    assert back.metrics == {"roc_auc": 0.5}


def test_initialize_and_reset_store(spark):
    root = tempfile.mkdtemp(prefix="init-") + "/store"
    store.initialize_store(spark, root)
    tx, pr = store.read_monitoring_tables(spark, root)
    assert tx.count() == 0 and pr.count() == 0
    assert tx.columns[0] == "transaction_id" and "prediction_id" in pr.columns
    txn, pred = fixture_views(read_table(spark, SF_SMALL, "events"))
    store.write_monitoring_data(txn, pred, root)
    store.reset_store(spark, root)
    tx, pr = store.read_monitoring_tables(spark, root)
    assert tx.count() == 0 and pr.count() == 0


def test_empty_frames_flow_through(spark):
    txn, pred = fixture_views(read_table(spark, SF_SMALL, "events"))
    frame = mon.monitoring_frame(txn, pred)
    empty = dash.dashboard_filter(frame, "1999-01-01", "1999-01-02", None, None)
    assert dash.filtered_fraud_trend(empty).count() == 0
    assert dash.risk_distribution_ordered(empty).count() == 0
    assert dash.filtered_channel_rates(empty).count() == 0
    assert dash.filtered_top_alerts(empty).count() == 0
    k = dash.filtered_kpis(empty).first()
    assert k.total_transactions == 0 and k.fraud_rate_pct == 0.0 and k.avg_risk_score is None


def test_current_timestamp_type(spark):
    t = spark.range(1).select(F.current_timestamp().alias("now")).first().now
    assert isinstance(t, dt.datetime)


def test_dashboard_report_matches_single_queries(spark):
    txn, pred = fixture_views(read_table(spark, SF_SMALL, "events"))
    frame = mon.monitoring_frame(txn, pred)
    rep = dash.dashboard_report(frame, "2024-01-02", "2024-01-20", ["web", "atm"], ["low", "medium", "high"])
    filtered = dash.dashboard_filter(frame, "2024-01-02", "2024-01-20", ["web", "atm"], ["low", "medium", "high"])
    (got,), (exp,) = rep["kpis"], dash.filtered_kpis(filtered).collect()
    assert got.asDict().keys() == exp.asDict().keys()
    for k, v in exp.asDict().items():  # unrounded means may differ in the last bit (summation order)
        assert got[k] == pytest.approx(v, rel=1e-12)
    assert rep["trend"] == dash.filtered_fraud_trend(filtered).collect()
    assert rep["top_alerts"] == dash.filtered_top_alerts(filtered).collect()
    assert len(rep["date_bounds"]) == 1
