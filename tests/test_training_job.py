"""The whole batch job (M9): properties of what it writes."""

import math
import tempfile

from pyspark.sql import functions as F

from txnwatch.plans import training
from txnwatch.sources import store
from txnwatch.sources.fixtures import raw_from_events
from txnwatch.sources.tables import read_table

from conftest import SF_SMALL


def test_training_job_properties(spark):
    raw = raw_from_events(read_table(spark, SF_SMALL, "events"))
    root = tempfile.mkdtemp(prefix="job-")
    summary = training.run_training(spark, raw, root, sample_size=600)
    tx, pr = store.read_monitoring_tables(spark, root)
    n_tx = tx.count()
    assert n_tx == raw.count()  # the sample size bounds the fits, not the rows that are scored and stored
    # one prediction per transaction, no orphans, keys unique
    assert pr.count() == n_tx
    assert pr.select("transaction_id").distinct().count() == n_tx
    assert store.validate(tx, pr) == {"pk_violations": 0, "tx_null_violations": 0, "pred_null_violations": 0,
                                      "fk_orphans": 0}
    # risk in range; band and decision consistent with the score
    bad = pr.where(
        (F.col("risk_score") < 0)
        | (F.col("risk_score") > 100)
        | ((F.col("risk_score") >= 75) != (F.col("risk_band") == "high"))
        | ((F.col("risk_band") == "high") != (F.col("decision") == "block"))
        | ((F.col("risk_band") == "medium") != (F.col("decision") == "review"))
        | ((F.col("anomaly_score") < 0) != (F.col("anomaly_flag") == 1))
    ).count()
    assert bad == 0
    # summary and files
    assert summary["rows_processed"] == n_tx and summary["sample_size"] == 600
    assert 0.0 <= summary["success_rate_pct"] <= 100.0
    assert math.isnan(summary["metric_roc_auc"]) or 0.0 <= summary["metric_roc_auc"] <= 1.0
    assert store.read_json_summary(spark, f"{root}/run_summary") == summary
    exported = spark.read.option("header", True).csv(f"{root}/processed_transactions")
    assert exported.count() == n_tx
    back = training.load_models(spark, root)
    assert back.forest.nodes["tree_id"].nunique() == 120


def test_command_line_job_from_raw_csv(spark):
    from txnwatch.sources.tables import write_raw

    root = tempfile.mkdtemp(prefix="cli-")
    write_raw(raw_from_events(read_table(spark, SF_SMALL, "events")), f"{root}/raw", "csv")
    summary = training.main(["--raw", f"{root}/raw", "--out", f"{root}/out", "--sample-size", "300"])
    tx, pr = store.read_monitoring_tables(spark, f"{root}/out")
    assert tx.count() == summary["rows_processed"] == pr.count()


def test_more_frauds_than_the_sample_size(spark):
    """All fraud rows go into the sample; normal rows must still be there, or no model can be fitted."""
    i = F.col("event_id")
    raw = spark.range(240).withColumnRenamed("id", "event_id").select(
        "event_id", (i * 977.0).alias("Time"), (i * 37 % 101 + 0.5).alias("Amount"), (i % 3 == 0).cast("int").alias("Class")
    )
    root = tempfile.mkdtemp(prefix="frauds-")
    summary = training.run_training(spark, raw, root, sample_size=60)
    assert (summary["rows_processed"], summary["fraud_rows"], summary["sample_size"]) == (240, 80, 60)
    assert 0.0 < summary["metric_test_positive_rate"] < 1.0
    assert store.read_monitoring_tables(spark, root)[1].count() == 240
