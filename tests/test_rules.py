"""Rule engine: the reference's two cases with exact values, boundaries, NULL and NaN."""

import math

import pytest
from pyspark.sql import functions as F

from txnwatch.functions.rules import rule_columns
from txnwatch.schema import NO_RULE_REASON

SCHEMA = "Amount double, hour int, velocity_1h double, amount_to_avg_ratio double, channel string"


def score(spark, rows):
    rc = rule_columns()
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select(rc.score.alias("s"), rc.reasons.alias("r"), rc.reasons_text.alias("t")).collect()


def test_high_risk_row(spark):
    (r,) = score(spark, [(2500.0, 2, 7.0, 5.2, "atm")])
    assert r.s == 93.0  # 30 + 25 + 20 + 10 + 8
    assert r.r == [
        "Very high transaction amount",
        "Amount is far above account baseline",
        "High velocity in one-hour window",
        "Transaction during high-risk hours",
        "Large ATM withdrawal pattern",
    ]
    assert r.t == "; ".join(r.r)


def test_low_risk_row(spark):
    (r,) = score(spark, [(55.0, 13, 1.0, 0.8, "web")])
    assert r.s == 0.0
    assert r.r == []
    assert r.t == NO_RULE_REASON


@pytest.mark.parametrize(
    "row, expected",
    [
        ((999.99, 12, 1.0, 1.0, "web"), 0.0),
        ((1000.0, 12, 1.0, 1.0, "web"), 20.0),
        ((1999.99, 12, 1.0, 1.0, "web"), 20.0),
        ((2000.0, 12, 1.0, 1.0, "web"), 30.0),
        ((10.0, 12, 1.0, 1.99, "web"), 0.0),
        ((10.0, 12, 1.0, 2.0, "web"), 15.0),
        ((10.0, 12, 1.0, 3.99, "web"), 15.0),
        ((10.0, 12, 1.0, 4.0, "web"), 25.0),
        ((10.0, 12, 3.99, 1.0, "web"), 0.0),
        ((10.0, 12, 4.0, 1.0, "web"), 12.0),
        ((10.0, 12, 5.99, 1.0, "web"), 12.0),
        ((10.0, 12, 6.0, 1.0, "web"), 20.0),
        ((10.0, 5, 1.0, 1.0, "web"), 10.0),
        ((10.0, 6, 1.0, 1.0, "web"), 0.0),
        ((500.0, 12, 1.0, 1.0, "atm"), 0.0),
        ((500.01, 12, 1.0, 1.0, "atm"), 8.0),
        ((500.01, 12, 1.0, 1.0, "ATM"), 8.0),  # case-blind channel
    ],
)
def test_boundaries(spark, row, expected):
    (r,) = score(spark, [row])
    assert r.s == expected


def test_null_takes_default_and_nan_never_fires(spark):
    rows = [(None, None, None, None, None), (float("nan"), 12, float("nan"), float("nan"), "atm")]
    a, b = score(spark, rows)
    assert a.s == 10.0  # default hour 0 is a high-risk hour
    assert b.s == 0.0


def test_score_never_exceeds_cap(spark):
    (r,) = score(spark, [(1e9, 0, 100.0, 100.0, "atm")])
    assert r.s <= 100.0 and not math.isnan(r.s)
