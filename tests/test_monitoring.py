"""Monitoring aggregates with a hot key: one transaction with thousands of
predictions. The per-transaction pre-aggregation must equal the fan-out join."""

from pyspark.sql import functions as F

from txnwatch.plans import monitoring as mon
from txnwatch.sources.fixtures import fixture_views
from txnwatch.sources.tables import read_table

from conftest import SF_SMALL


def fanout_reference(txn, pred):
    j = txn.join(pred, "transaction_id", "left")
    fraud = F.when(F.coalesce("is_fraud", F.lit(0)) == 1, 1).otherwise(0)
    ok = F.when(F.coalesce("is_success", F.lit(0)) == 1, 1.0).otherwise(0.0)
    return j.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(fraud).alias("fraud"),
        F.avg(ok).alias("ok"),
        F.avg(F.coalesce("risk_score", F.lit(0.0))).alias("risk"),
    ).first()


def test_hot_transaction_fanout(spark):
    txn, pred = fixture_views(read_table(spark, SF_SMALL, "events"))
    hot_id = pred.orderBy("transaction_id").first().transaction_id
    copies = F.explode(F.sequence(F.lit(1), F.lit(5000))).alias("_copy")
    hot = pred.where(F.col("transaction_id") == hot_id).select("*", copies).drop("_copy")
    pred_hot = pred.unionByName(hot)
    ref = fanout_reference(txn, pred_hot)
    got = mon.overview_kpis(txn, pred_hot).first()
    assert got.total_transactions == ref.n
    assert got.fraud_transactions == ref.fraud
    assert got.success_rate_pct == round(100 * ref.ok, 2)
    assert abs(got.avg_risk_score - round(ref.risk, 2)) < 1e-9
    trend = mon.fraud_trend(txn, pred_hot).agg(F.sum("total_transactions")).first()[0]
    assert trend == ref.n
