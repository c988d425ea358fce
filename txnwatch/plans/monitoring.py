"""Monitoring queries over the stored tables.

SQL semantics: a NULL label or outcome counts as 0 and stays in the
denominator; a missing prediction counts as risk 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnwatch.functions.scalars import to_day
from txnwatch.functions.scoring import reaches
from txnwatch.schema import ALERT_THRESHOLD, PREDICTION_COLUMNS, SQL_ALERT_LIMIT, TRANSACTION_COLUMNS


def _fraud01() -> Column:
    return F.when(F.coalesce(F.col("is_fraud"), F.lit(0)) == 1, F.lit(1)).otherwise(F.lit(0))


def _success01() -> Column:
    return F.when(F.coalesce(F.col("is_success"), F.lit(0)) == 1, F.lit(1.0)).otherwise(F.lit(0.0))


def _risk0() -> Column:
    return F.coalesce(F.col("risk_score"), F.lit(0.0))


def monitoring_frame(transactions: DataFrame, predictions: DataFrame) -> DataFrame:
    """Transactions LEFT JOIN predictions, 12 + 8 columns.

    A transaction with several predictions appears once per prediction (D3).
    A ``txn_date`` partition column of the stored table is carried along so
    date filters can prune partitions.
    """
    if "txn_date" in transactions.columns and "txn_date" in predictions.columns:
        # stored tables: the date is part of the key, so a date filter on the
        # frame is inferred for both sides and prunes both tables' partitions
        t = transactions.select(*TRANSACTION_COLUMNS, "txn_date")
        p = predictions.select(*PREDICTION_COLUMNS, "txn_date")
        return t.join(p, ["transaction_id", "txn_date"], "left")
    extra = ["txn_date"] if "txn_date" in transactions.columns else []
    t = transactions.select(*TRANSACTION_COLUMNS, *extra)
    p = predictions.select(*PREDICTION_COLUMNS)
    return t.join(p, "transaction_id", "left")


def latest_prediction(predictions: DataFrame, order_col: str = "created_at") -> DataFrame:
    """Optional D3 pre-step: keep one prediction per transaction, the latest.

    ``max_by`` is a plain aggregate with map-side partial aggregation, so a
    transaction with many predictions never gathers them in one place.
    """
    value_cols = [c for c in predictions.columns if c not in ("transaction_id",)]
    packed = F.struct(*[F.col(c) for c in value_cols])
    return (
        predictions.groupBy("transaction_id")
        .agg(F.max_by(packed, F.struct(F.col(order_col), F.col("prediction_id"))).alias("_p"))
        .select("transaction_id", "_p.*")
    )


def prediction_totals(predictions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per transaction: number of predictions and the sum of their risk.

    A plain aggregate with map-side partial aggregation, so a transaction with
    a huge number of predictions (a hot key) collapses to one row per task
    before the shuffle. With it, the monitoring aggregates join 1:1.
    """
    return predictions.groupBy(*(keys or ["transaction_id"])).agg(
        F.count(F.lit(1)).alias("_n_pred"), F.sum("risk_score").alias("_risk_sum")
    )


def _weighted(transactions: DataFrame, predictions: DataFrame) -> DataFrame:
    """Transactions with ``_w`` = the number of rows each contributes to
    ``transactions LEFT JOIN predictions`` (at least 1) and ``_risk`` = the sum
    of ``coalesce(risk_score, 0)`` over those rows. Aggregating with these
    weights gives exactly the fan-out join's COUNT, SUM and AVG."""
    keys = ["transaction_id"]
    if "txn_date" in transactions.columns and "txn_date" in predictions.columns:
        keys.append("txn_date")  # stored tables: the same key as the joined frame, and date filters prune both
    t = transactions.select(*TRANSACTION_COLUMNS, *keys[1:])
    j = t.join(prediction_totals(predictions, keys), keys, "left")
    return j.withColumns(
        {
            "_w": F.greatest(F.coalesce(F.col("_n_pred"), F.lit(0)), F.lit(1)),
            "_risk": F.coalesce(F.col("_risk_sum"), F.lit(0.0)),
        }
    )


def _weighted_measures(digits: int) -> list[Column]:
    total = F.sum("_w")
    fraud = F.sum(_fraud01() * F.col("_w"))
    return [
        total.alias("total_transactions"),
        fraud.cast("bigint").alias("fraud_transactions"),
        F.round(F.lit(100.0) * F.sum(_success01() * F.col("_w")) / total, digits).alias("success_rate_pct"),
        F.round(F.sum("_risk") / total, digits).alias("avg_risk_score"),
    ]


def overview_kpis(transactions: DataFrame, predictions: DataFrame) -> DataFrame:
    """one row of totals over ``transactions LEFT JOIN predictions``
    (computed from per-transaction prediction totals, see ``_weighted``)."""
    return _weighted(transactions, predictions).agg(*_weighted_measures(2))


def fraud_trend(transactions: DataFrame, predictions: DataFrame) -> DataFrame:
    """per day totals, fraud share, success share and mean risk, by date."""
    g = _weighted(transactions, predictions).groupBy(to_day("transaction_timestamp").alias("txn_date"))
    total, fraud, ok, risk = _weighted_measures(3)
    return g.agg(
        total,
        fraud,
        F.round(F.lit(100.0) * F.sum(_fraud01() * F.col("_w")) / F.sum("_w"), 3).alias("fraud_rate_pct"),
        ok,
        risk,
    ).orderBy("txn_date")


def risk_distribution(predictions: DataFrame) -> DataFrame:
    """predictions per band (NULL band kept as its own group), most first."""
    return (
        predictions.groupBy("risk_band")
        .agg(F.count(F.lit(1)).alias("transactions"))
        .orderBy(F.col("transactions").desc())
    )


def channel_success_rates(transactions: DataFrame, predictions: DataFrame) -> DataFrame:
    """per channel count, success share and mean risk, most rows first."""
    _, _, ok, risk = _weighted_measures(3)
    return (
        _weighted(transactions, predictions)
        .groupBy("channel")
        .agg(F.sum("_w").alias("transactions"), ok, risk)
        .orderBy(F.col("transactions").desc())
    )


def _totals_measures(digits: int) -> list[Column]:
    """The measures of ``_weighted_measures`` from the sums that the store keeps by day and channel."""
    total = F.sum("total")
    return [
        total.alias("total_transactions"),
        F.sum("fraud").alias("fraud_transactions"),
        F.round(F.lit(100.0) * F.sum("success") / total, digits).alias("success_rate_pct"),
        F.round(F.sum("risk") / total, digits).alias("avg_risk_score"),
    ]


def overview_from_totals(totals: DataFrame) -> DataFrame:
    """F1 from ``store.read_totals``: neither table is read, nothing is joined."""
    return totals.agg(*_totals_measures(2))


def trend_from_totals(totals: DataFrame) -> DataFrame:
    """F2 from ``store.read_totals``; a date filter prunes its partitions."""
    total, fraud, ok, risk = _totals_measures(3)
    rate = F.round(F.lit(100.0) * F.sum("fraud") / F.sum("total"), 3).alias("fraud_rate_pct")
    return totals.groupBy("txn_date").agg(total, fraud, rate, ok, risk).orderBy("txn_date")


def channels_from_totals(totals: DataFrame) -> DataFrame:
    """F4 from ``store.read_totals``."""
    _, _, ok, risk = _totals_measures(3)
    return totals.groupBy("channel").agg(F.sum("total").alias("transactions"), ok, risk).orderBy(F.col("transactions").desc())


# The columns of an alert, in order.
ALERT_COLUMNS = [
    "transaction_id",
    "transaction_timestamp",
    "account_id",
    "channel",
    "merchant_category",
    "Amount",
    "risk_score",
    "risk_band",
    "decision",
    "ml_probability",
    "rule_score",
    "rule_reasons",
]


def recent_alerts(transactions: DataFrame, predictions: DataFrame, limit: int = SQL_ALERT_LIMIT,
                  threshold: float = ALERT_THRESHOLD) -> DataFrame:
    """Inner join, ``risk_score >= threshold``, highest risk first, top ``limit``.

    The filter reaches the predictions scan; ``orderBy + limit`` plans as a
    per-partition top-k (TakeOrderedAndProject), so only ``limit`` rows per
    task move. Ties at the cut are broken by ``transaction_id``.
    """
    if limit <= 0:
        raise ValueError("limit must be positive")
    p = predictions.select(*PREDICTION_COLUMNS).where(reaches("risk_score", threshold))
    j = transactions.select(*TRANSACTION_COLUMNS).join(p, "transaction_id", "inner")
    return j.select(*ALERT_COLUMNS).orderBy(F.col("risk_score").desc(), F.col("transaction_id")).limit(limit)


def recent_alerts_sql(spark, transactions_view: str, predictions_view: str, limit: int = SQL_ALERT_LIMIT,
                      threshold: float = ALERT_THRESHOLD) -> DataFrame:
    """The same query as SQL text over registered views, with the
    threshold and the limit bound as parameters."""
    for v in (transactions_view, predictions_view):
        if not v.replace("_", "").isalnum():
            raise ValueError(f"bad view name {v!r}")
    shown = ", ".join(f"{'t' if c in TRANSACTION_COLUMNS else 'p'}.{c}" for c in ALERT_COLUMNS)
    text = (
        f"SELECT {shown} FROM {transactions_view} t INNER JOIN {predictions_view} p USING (transaction_id) "
        "WHERE p.risk_score >= :threshold AND NOT isnan(p.risk_score) "
        "ORDER BY p.risk_score DESC, t.transaction_id LIMIT :limit"
    )
    return spark.sql(text, args={"threshold": float(threshold), "limit": int(limit)})


def processed_output(transactions: DataFrame, predictions: DataFrame) -> DataFrame:
    """Five transaction columns + the prediction columns, joined by key
    (never by position)."""
    t = transactions.select("transaction_id", "transaction_timestamp", "Amount", "is_fraud", "is_success")
    return t.join(predictions.select(*PREDICTION_COLUMNS), "transaction_id", "inner")


def fk_orphans(predictions: DataFrame, transactions: DataFrame) -> DataFrame:
    """Predictions whose transaction does not exist (anti join)."""
    return predictions.join(transactions.select("transaction_id"), "transaction_id", "left_anti")
