"""Fixture views over the provided tables.

The test data has no card transactions, so ``events`` stands in. ``txn`` is
the stored ``transactions`` table, ``pred`` the stored ``predictions`` table
(keyed draws stand in for model output), ``raw`` the raw input of sampling.
Every column is a deterministic function of ``events``, so Spark and DuckDB
agree; each Spark builder has a DuckDB SQL twin used by the oracle.

Two rows-subsets are part of the fixture definition, not cost caps:
``is_fraud`` is NULL when ``event_id % 97 = 0`` (unlabelled rows) and ``pred``
has no row when ``event_id % 53 = 0`` (transactions without a prediction, so
LEFT JOIN semantics are exercised). Both leave every row of ``events`` in play.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.functions.draws import keyed_uniform
from txnwatch.functions.rules import rule_columns, rule_sql_duckdb
from txnwatch.functions.scalars import hour_of, micros_ntz, padded_id, ratio_with_epsilon, success_probability
from txnwatch.functions.scoring import add_risk_columns, risk_sql_duckdb
from txnwatch.operators.rolling import add_account_rollups
from txnwatch.schema import MERCHANT_CATEGORIES, PREDICTION_COLUMNS, TRANSACTION_COLUMNS

# ---------------------------------------------------------------------------
# Fixed values of the fixture definition.
# ---------------------------------------------------------------------------
EVENT_CHANNEL = {"view": "mobile", "purchase": "pos", "error": "atm", "click": "web", "signup": "web"}
ACCOUNT_BASE = 100000
DEFAULT_ACCOUNTS = 8  # account_id = 100000 + user_id % 8: eight hot accounts
UNLABELLED_EVERY = 97
NO_PREDICTION_EVERY = 53
FRAUD_RATE_HIGH = 0.10
FRAUD_RATE_LOW = 0.01
HIGH_VALUE_OVER = 100


def _channel(event_type):
    expr = None
    for et, ch in EVENT_CHANNEL.items():
        expr = F.when(event_type == et, F.lit(ch)) if expr is None else expr.when(event_type == et, F.lit(ch))
    return expr


def _category(props):
    k = F.get_json_object(props, "$.k").cast("int") % F.lit(len(MERCHANT_CATEGORIES))
    expr = None
    for i, name in enumerate(MERCHANT_CATEGORIES):
        expr = F.when(k == i, F.lit(name)) if expr is None else expr.when(k == i, F.lit(name))
    return expr


def transactions_from_events(events: DataFrame, accounts: int | None = DEFAULT_ACCOUNTS) -> DataFrame:
    """``txn``: the 12 stored transaction columns plus ``event_id`` and ``label``."""
    account = (
        F.lit(ACCOUNT_BASE) + F.col("user_id") % F.lit(accounts) if accounts else F.col("user_id")
    ).cast("bigint")
    base = events.select(
        "event_id",
        padded_id("TXN", F.col("event_id") + 1).alias("transaction_id"),
        F.col("ts").alias("transaction_timestamp"),
        account.alias("account_id"),
        _channel(F.col("event_type")).alias("channel"),
        _category(F.col("props")).alias("merchant_category"),
        F.round(F.col("value") * 10, 2).alias("Amount"),
        hour_of("ts").alias("hour"),
        "value",
    )
    rolled = add_account_rollups(base)
    label = F.when(
        keyed_uniform("fraud", "event_id")
        < F.when(F.col("value") > HIGH_VALUE_OVER, F.lit(FRAUD_RATE_HIGH)).otherwise(F.lit(FRAUD_RATE_LOW)),
        F.lit(1),
    ).otherwise(F.lit(0))
    with_label = rolled.withColumns(
        {
            "amount_to_avg_ratio": ratio_with_epsilon("Amount", "avg_amount_24h"),
            "label": label,
        }
    )
    out = with_label.withColumns(
        {
            "is_fraud": F.when(F.col("event_id") % UNLABELLED_EVERY == 0, F.lit(None).cast("int")).otherwise(
                F.col("label")
            ),
            "is_success": F.when(
                keyed_uniform("ok", "event_id")
                < success_probability("label", "velocity_1h", "Amount", "channel"),
                F.lit(1),
            ).otherwise(F.lit(0)),
        }
    )
    return out.select(*TRANSACTION_COLUMNS, "event_id", "label")


def predictions_from_transactions(txn: DataFrame) -> DataFrame:
    """``pred``: one prediction per transaction except ``event_id % 53 = 0``."""
    return predictions_of_all(txn.where(F.col("event_id") % NO_PREDICTION_EVERY != 0))


def predictions_of_all(txn: DataFrame) -> DataFrame:
    """``pred_all``: one prediction per transaction."""
    rc = rule_columns()
    scored = txn.select(
        "transaction_id",
        keyed_uniform("ml", "event_id").alias("ml_probability"),
        (F.lit(2.0) * keyed_uniform("an", "event_id") - F.lit(1.0)).alias("anomaly_score"),
        rc.score.alias("rule_score"),
        rc.reasons_text.alias("rule_reasons"),
    )
    scored = scored.withColumn("anomaly_flag", (F.col("anomaly_score") < 0).cast("int"))
    return add_risk_columns(scored).select(*PREDICTION_COLUMNS)


def raw_from_events(events: DataFrame) -> DataFrame:
    """``raw``: Time (seconds since 2024-01-01), Amount, Class, plus the key."""
    label = F.when(
        keyed_uniform("fraud", "event_id")
        < F.when(F.col("value") > HIGH_VALUE_OVER, F.lit(FRAUD_RATE_HIGH)).otherwise(F.lit(FRAUD_RATE_LOW)),
        F.lit(1),
    ).otherwise(F.lit(0))
    base_us = micros_ntz(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    return events.select(
        "event_id",
        ((micros_ntz("ts") - base_us) / F.lit(1_000_000.0)).alias("Time"),
        F.round(F.col("value") * 10, 2).alias("Amount"),
        label.alias("Class"),
    )


def fixture_views(events: DataFrame, accounts: int | None = DEFAULT_ACCOUNTS) -> tuple[DataFrame, DataFrame]:
    txn = transactions_from_events(events, accounts)
    return txn, predictions_from_transactions(txn)


# ---------------------------------------------------------------------------
# DuckDB twins (oracle only)
# ---------------------------------------------------------------------------
def _u_sql(salt: str) -> str:
    return f"(('0x' || substr(md5('{salt}:' || CAST(event_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _label_sql() -> str:
    return (
        f"(CASE WHEN {_u_sql('fraud')} < (CASE WHEN value > {HIGH_VALUE_OVER} THEN {FRAUD_RATE_HIGH} "
        f"ELSE {FRAUD_RATE_LOW} END) THEN 1 ELSE 0 END)"
    )


def _rolling_sql(window_us: int, what: str) -> str:
    lower = window_us - 1
    frame = f"PARTITION BY account_id ORDER BY us RANGE BETWEEN {lower} PRECEDING AND CURRENT ROW"
    peers = "PARTITION BY account_id, us ORDER BY transaction_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING"
    if what == "count":
        return f"(count(Amount) OVER ({frame}) - count(Amount) OVER ({peers}))"
    return (
        f"(sum(CAST(Amount AS DECIMAL(18,2))) OVER ({frame}) "
        f"- coalesce(sum(CAST(Amount AS DECIMAL(18,2))) OVER ({peers}), 0))"
    )


def fixture_ctes_sql(accounts: int | None = DEFAULT_ACCOUNTS, source: str = "events") -> str:
    """``txn_ev`` (txn + event_id, label), ``txn`` and ``pred`` as DuckDB CTEs (no WITH keyword)."""
    account = f"({ACCOUNT_BASE} + user_id % {accounts})" if accounts else "user_id"
    channel = "CASE " + " ".join(f"WHEN event_type = '{k}' THEN '{v}'" for k, v in EVENT_CHANNEL.items()) + " END"
    category = (
        f"CASE CAST(json_extract_string(props, '$.k') AS INTEGER) % {len(MERCHANT_CATEGORIES)} "
        + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(MERCHANT_CATEGORIES))
        + " END"
    )
    hour_us = 3_600_000_000
    day_us = 24 * hour_us
    score_sql, reasons_sql = rule_sql_duckdb()
    risk_sql, band_sql, decision_sql = risk_sql_duckdb("ml_probability", "anomaly_score", "anomaly_flag", "rule_score")
    txn_cols = ", ".join(TRANSACTION_COLUMNS)
    pred_cols = ", ".join(PREDICTION_COLUMNS)
    return f"""
fx_base AS (
  SELECT event_id, value,
         printf('TXN%08d', event_id + 1) AS transaction_id,
         ts AS transaction_timestamp,
         CAST({account} AS BIGINT) AS account_id,
         {channel} AS channel,
         {category} AS merchant_category,
         round(value * 10, 2) AS Amount,
         CAST(hour(ts) AS INTEGER) AS hour,
         epoch_us(ts) AS us
  FROM {source}
),
fx_roll AS (
  SELECT *,
         {_rolling_sql(hour_us, 'count')} AS c1h,
         {_rolling_sql(day_us, 'count')} AS c24h,
         {_rolling_sql(day_us, 'sum')} AS s24h
  FROM fx_base
),
fx_feat AS (
  SELECT *,
         coalesce(CAST(c1h AS DOUBLE), 1.0) AS velocity_1h,
         coalesce(CASE WHEN c24h > 0 THEN CAST(s24h AS DOUBLE) / CAST(c24h AS DOUBLE) END, Amount) AS avg_amount_24h,
         {_label_sql()} AS label
  FROM fx_roll
),
fx_feat2 AS (
  SELECT *, Amount / (avg_amount_24h + 1e-6) AS amount_to_avg_ratio,
         greatest(0.05, least(0.995,
           (CASE WHEN label = 1 THEN 0.55 ELSE 0.985 END)
           - (CAST(velocity_1h >= 4 AS DOUBLE) * 0.08 + CAST(Amount > 1000 AS DOUBLE) * 0.05
              + CAST(channel = 'atm' AS DOUBLE) * 0.03))) AS p_ok
  FROM fx_feat
),
txn_ev AS (
  SELECT transaction_id, transaction_timestamp, account_id, channel, merchant_category, Amount, hour,
         velocity_1h, avg_amount_24h, amount_to_avg_ratio,
         CASE WHEN event_id % {UNLABELLED_EVERY} = 0 THEN NULL ELSE label END AS is_fraud,
         CASE WHEN {_u_sql('ok')} < p_ok THEN 1 ELSE 0 END AS is_success,
         event_id, label
  FROM fx_feat2
),
txn AS (SELECT {txn_cols} FROM txn_ev),
fx_pred1 AS (
  SELECT transaction_id, event_id,
         {_u_sql('ml')} AS ml_probability,
         2.0 * {_u_sql('an')} - 1.0 AS anomaly_score,
         {score_sql} AS rule_score,
         {reasons_sql} AS rule_reasons
  FROM txn_ev
),
fx_pred2 AS (
  SELECT *, CAST(anomaly_score < 0 AS INTEGER) AS anomaly_flag FROM fx_pred1
),
fx_pred3 AS (SELECT *, {risk_sql} AS risk_score FROM fx_pred2),
fx_pred4 AS (SELECT *, {band_sql} AS risk_band FROM fx_pred3),
fx_pred5 AS (SELECT *, {decision_sql} AS decision FROM fx_pred4),
pred_all AS (SELECT {pred_cols} FROM fx_pred5),
pred AS (SELECT {pred_cols} FROM fx_pred5 WHERE event_id % {NO_PREDICTION_EVERY} <> 0),
raw AS (
  SELECT event_id,
         (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1000000.0::DOUBLE AS Time,
         round(value * 10, 2) AS Amount,
         {_label_sql()} AS Class
  FROM {source}
)"""


def with_fixtures_sql(body: str, accounts: int | None = DEFAULT_ACCOUNTS) -> str:
    """Prefix a query that uses ``txn``/``pred``/``raw``/``txn_ev`` with the fixture CTEs."""
    return "WITH " + fixture_ctes_sql(accounts) + "\n" + body
