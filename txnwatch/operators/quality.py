"""Data-quality checks and guards.

Every check is one distributed pass; results are small (violating keys, or
one row of counts).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnwatch.schema import (
    CHANNELS,
    MERCHANT_CATEGORIES,
    MODEL_FEATURES,
    PREDICTION_NOT_NULL,
    TRANSACTION_NOT_NULL,
)
from txnwatch.sources.tables import require_columns

__all__ = [
    "build_feature_frame",
    "key_violations",
    "null_counts",
    "total_nulls",
    "live_input_checks",
    "split_valid",
    "require_positive",
    "TRANSACTION_NOT_NULL",
    "PREDICTION_NOT_NULL",
]


def build_feature_frame(df: DataFrame, key: str | None = None) -> DataFrame:
    """B1: project to the model features (plus an optional key); raise when any is missing."""
    require_columns(df, MODEL_FEATURES, "features")
    return df.select(*([key] if key else []), *MODEL_FEATURES)


def require_positive(value: int, name: str) -> None:
    """Positive-size guard."""
    if value is None or int(value) <= 0:
        raise ValueError(f"{name} must be positive.")


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count.

    A plain aggregate: map-side partial counts, so a hot key costs one row per
    task before the shuffle.
    """
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .where(F.col("occurrences") > 1)
    )


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with ``{column}_nulls`` for every column, in one pass."""
    return df.agg(*[F.sum(F.col(c).isNull().cast("bigint")).alias(f"{c}_nulls") for c in columns])


def total_nulls(df: DataFrame, columns: Sequence[str]) -> int:
    row = df.agg(F.sum(sum((F.col(c).isNull().cast("bigint") for c in columns), F.lit(0)))).first()
    return int(row[0] or 0)


# ---------------------------------------------------------------------------
# Bounds of the live form.
# ---------------------------------------------------------------------------
LIVE_BOUNDS = {
    "amount_min": 0.0,
    "hour_min": 0,
    "hour_max": 23,
    "velocity_min": 1,
    "avg_min": 1.0,
}


def live_input_checks(
    amount: str = "Amount",
    hour: str = "hour",
    velocity: str = "velocity_1h",
    avg: str = "avg_amount_24h",
    channel: str = "channel",
    category: str = "merchant_category",
) -> list[tuple[str, Column]]:
    """Named validity predicates of a live input row (True = valid)."""
    b = LIVE_BOUNDS

    def num_ok(c: str, lo, hi=None) -> Column:
        x = F.col(c).cast("double")
        ok = x.isNotNull() & ~F.isnan(x) & (x >= F.lit(float(lo)))
        return ok & (x <= F.lit(float(hi))) if hi is not None else ok

    return [
        ("amount", num_ok(amount, b["amount_min"])),
        ("hour", num_ok(hour, b["hour_min"], b["hour_max"])),
        # The form's upper bound on velocity is not a fact about accounts: the busiest are the riskiest and stay.
        ("velocity", num_ok(velocity, b["velocity_min"])),
        ("avg_amount", num_ok(avg, b["avg_min"])),
        ("channel", F.coalesce(F.col(channel).isin(CHANNELS), F.lit(False))),
        ("merchant_category", F.coalesce(F.col(category).isin(MERCHANT_CATEGORIES), F.lit(False))),
    ]


def first_violation(checks: list[tuple[str, Column]]) -> Column:
    """Name of the first failed check, NULL when the row is valid."""
    expr = None
    for name, ok in checks:
        expr = F.when(~ok, F.lit(name)) if expr is None else expr.when(~ok, F.lit(name))
    return expr


def split_valid(df: DataFrame, checks: list[tuple[str, Column]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows with a ``violation`` column)."""
    checks = checks or live_input_checks()
    tagged = df.withColumn("violation", first_violation(checks))
    return tagged.where(F.col("violation").isNull()).drop("violation"), tagged.where(F.col("violation").isNotNull())
