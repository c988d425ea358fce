"""Risk blend, bump, bands, decisions: the reference's tests with exact values."""

from pyspark.sql import functions as F

from txnwatch.functions.scoring import (
    anomaly_to_risk,
    bumped_risk,
    combine_risk_components,
    decision_from_band,
    risk_band,
)


def test_combined_risk_values(spark):
    df = spark.createDataFrame([(0.05, 0.1, 5.0), (0.9, 0.9, 85.0)], "ml double, an double, rule double")
    low, high = [r[0] for r in df.select(combine_risk_components("ml", "an", "rule")).collect()]
    assert abs(low - 6.0) < 1e-12
    assert abs(high - 89.0) < 1e-12
    assert high > low and high <= 100.0


def test_band_and_decision(spark):
    df = spark.createDataFrame([(20.0,), (55.0,), (90.0,), (45.0,), (75.0,), (44.999,)], "s double")
    rows = df.select(risk_band("s").alias("b"), decision_from_band(risk_band("s")).alias("d")).collect()
    assert [r.b for r in rows] == ["low", "medium", "high", "medium", "high", "low"]
    assert [r.d for r in rows] == ["approve", "review", "block", "review", "block", "approve"]
    other = spark.createDataFrame([("zzz",), (None,)], "b string").select(decision_from_band("b")).collect()
    assert [r[0] for r in other] == ["approve", "approve"]


def test_anomaly_risk_monotone(spark):
    df = spark.createDataFrame([(0, 0.8), (1, 0.2), (2, -0.3), (3, -1.1)], "i int, a double")
    risks = [r[0] for r in df.orderBy("i").select(anomaly_to_risk("a")).collect()]
    assert risks[0] < risks[1] < risks[2] < risks[3]


def test_bump_precedes_banding(spark):
    df = spark.createDataFrame([(40.0, 1), (50.0, 1), (55.0, 1), (40.0, 0), (95.0, 1)], "r double, f int")
    out = [r[0] for r in df.select(bumped_risk("r", "f")).collect()]
    assert out == [50.0, 60.0, 55.0, 40.0, 95.0]
    bumped = [x for x, (r, f) in zip(out, [(40.0, 1), (50.0, 1)])]
    assert all(x < 65.0 for x in bumped)  # a bumped score stays below 65, so never high
