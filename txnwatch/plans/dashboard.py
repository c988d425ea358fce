"""Filtered dashboard aggregates.

These follow the dataframe (not the SQL) semantics: counts need a non-NULL
id, NULL outcomes count as 0 in the trend and channel frames, but the
headline KPIs skip NULLs; rounding is half-to-even.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.functions.scalars import band_rank, to_day
from txnwatch.functions.scoring import reaches
from txnwatch.plans.monitoring import ALERT_COLUMNS
from txnwatch.schema import ALERT_THRESHOLD, DASHBOARD_ALERT_LIMIT


def with_transaction_date(frame: DataFrame) -> DataFrame:
    """Drop rows without a timestamp (B11) and add ``transaction_date`` (E5)."""
    return frame.where(F.col("transaction_timestamp").isNotNull()).withColumn(
        "transaction_date", to_day("transaction_timestamp")
    )


def dashboard_filter(frame: DataFrame, start_date, end_date, channels: Sequence[str] | None,
                     bands: Sequence[str] | None) -> DataFrame:
    """B8 + B9: inclusive date range, channel and band membership.

    ``isin`` drops NULLs, so a transaction without a prediction (NULL band)
    leaves the filtered frame; Catalyst then turns the LEFT JOIN into an
    inner one and pushes the band list into the predictions scan.
    ``None`` for a list means "no filter on that column".
    """
    dated = with_transaction_date(frame)
    lo, hi = F.lit(start_date).cast("date"), F.lit(end_date).cast("date")
    cond = F.col("transaction_date").between(lo, hi)
    if "txn_date" in frame.columns:  # stored table: the same range on the partition column
        cond = cond & F.col("txn_date").between(lo, hi)
    if channels is not None:
        cond = cond & F.col("channel").isin(list(channels))
    if bands is not None:
        cond = cond & F.col("risk_band").isin(list(bands))
    return dated.where(cond)


def filtered_fraud_trend(filtered: DataFrame) -> DataFrame:
    """trend of the filtered frame; empty in, empty out."""
    g = filtered.groupBy(F.col("transaction_date").alias("txn_date")).agg(
        F.count("transaction_id").alias("total_transactions"),
        F.sum(F.coalesce(F.col("is_fraud"), F.lit(0)).cast("double")).alias("_fraud"),
        F.avg(F.coalesce(F.col("is_success"), F.lit(0)).cast("double")).alias("_ok"),
        F.avg(F.coalesce(F.col("risk_score"), F.lit(0.0))).alias("_risk"),
    )
    fraud = F.bround(F.col("_fraud"), 0).cast("bigint")
    return g.select(
        "txn_date",
        "total_transactions",
        fraud.alias("fraud_transactions"),
        F.bround(fraud / F.col("total_transactions") * F.lit(100.0), 3).alias("fraud_rate_pct"),
        F.bround(F.col("_ok") * F.lit(100.0), 3).alias("success_rate_pct"),
        F.bround(F.col("_risk"), 3).alias("avg_risk_score"),
    ).orderBy("txn_date")


def risk_distribution_ordered(filtered: DataFrame) -> DataFrame:
    """F6 + G5: count per non-NULL band; low, medium, high, then others; count desc."""
    counts = (
        filtered.where(F.col("risk_band").isNotNull())
        .groupBy("risk_band")
        .agg(F.count(F.lit(1)).alias("transactions"))
    )
    return counts.orderBy(band_rank("risk_band").asc(), F.col("transactions").desc())


def filtered_channel_rates(filtered: DataFrame) -> DataFrame:
    """per channel of the filtered frame, most rows first."""
    return (
        filtered.groupBy("channel")
        .agg(
            F.count("transaction_id").alias("transactions"),
            F.bround(F.avg(F.coalesce(F.col("is_success"), F.lit(0)).cast("double")) * F.lit(100.0), 3).alias(
                "success_rate_pct"
            ),
            F.bround(F.avg(F.coalesce(F.col("risk_score"), F.lit(0.0))), 3).alias("avg_risk_score"),
        )
        .orderBy(F.col("transactions").desc())
    )


def filtered_kpis(filtered: DataFrame) -> DataFrame:
    """F8: headline figures; means skip NULLs, fraud rate is 0 on an empty frame."""
    total = F.count(F.lit(1))
    fraud = F.sum(F.when(F.col("is_fraud") == 1, F.lit(1)).otherwise(F.lit(0)))
    return filtered.agg(
        total.alias("total_transactions"),
        F.coalesce(fraud, F.lit(0)).cast("bigint").alias("fraud_transactions"),
        F.coalesce(F.try_divide(fraud * F.lit(100.0), total), F.lit(0.0)).alias("fraud_rate_pct"),
        (F.avg(F.col("is_success").cast("double")) * F.lit(100.0)).alias("success_rate_pct"),
        F.avg("risk_score").alias("avg_risk_score"),
    )


def filtered_top_alerts(filtered: DataFrame, limit: int = DASHBOARD_ALERT_LIMIT,
                        threshold: float = ALERT_THRESHOLD) -> DataFrame:
    """Alerts of the filtered frame (NULL risk counts as 0), top ``limit`` by risk."""
    alerts = filtered.where(reaches(F.coalesce(F.col("risk_score"), F.lit(0.0)), threshold))
    return alerts.select(*ALERT_COLUMNS).orderBy(F.col("risk_score").desc(), F.col("transaction_id")).limit(limit)


def date_bounds(frame: DataFrame) -> DataFrame:
    """first and last transaction date."""
    dated = with_transaction_date(frame)
    return dated.agg(F.min("transaction_date").alias("min_date"), F.max("transaction_date").alias("max_date"))


def distinct_values(frame: DataFrame, column: str) -> DataFrame:
    """sorted distinct non-NULL values of a column."""
    return frame.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def dashboard_report(frame: DataFrame, start_date, end_date, channels: Sequence[str] | None,
                     bands: Sequence[str] | None) -> dict:
    """The whole dashboard for one selection: the filtered frame is persisted
    once (memory, spilling to disk) and the six small results are computed from
    it, then it is released. Every result is small (days, bands, channels, 20
    alerts, one KPI row), so they are returned as lists of rows."""
    from pyspark import StorageLevel

    filtered = dashboard_filter(frame, start_date, end_date, channels, bands).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return {
            "kpis": filtered_kpis(filtered).collect(),
            "trend": filtered_fraud_trend(filtered).collect(),
            "risk_distribution": risk_distribution_ordered(filtered).collect(),
            "channel_rates": filtered_channel_rates(filtered).collect(),
            "top_alerts": filtered_top_alerts(filtered).collect(),
            "date_bounds": date_bounds(frame).collect(),
        }
    finally:
        filtered.unpersist()
