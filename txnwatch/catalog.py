"""Query catalog: every registered operator as ``(spark, sf_dir) -> DataFrame``
plus, where one exists, the equivalent DuckDB SQL over the same tables.

All queries read the provided tables (mostly ``events``, through the fixture
views) and run over them whole. Floating results are rounded the same way on
both sides so value hashes compare; SQL rounding is half away from zero,
dataframe rounding half to even, as in the reference.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnwatch.plans import dashboard as dash
from txnwatch.plans import monitoring as mon
from txnwatch.sources.fixtures import fixture_ctes_sql, predictions_from_transactions, transactions_from_events
from txnwatch.sources.tables import read_table


@dataclass(frozen=True)
class Entry:
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doc: str


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None, doc: str = ""):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(fn, sql, doc or (fn.__doc__ or "").strip())
        return fn

    return deco


def views(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The ``txn`` and ``pred`` fixture views over ``events``: plain plans, so that each query prunes what it does not use."""
    txn = transactions_from_events(read_table(spark, sf_dir, "events"))
    return txn, predictions_from_transactions(txn)


def r6(col: str):
    return F.round(F.col(col), 6).alias(col)


# Dashboard selection used by the filtered queries: a date range inside the
# data, three of the four channels, all bands (the app's default band list).
DASH_START = "2024-01-03"
DASH_END = "2024-01-27"
DASH_CHANNELS = ["atm", "mobile", "web"]
DASH_BANDS = ["low", "medium", "high"]


def _sql_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


MF_SQL = """mf AS (
  SELECT t.*, p.ml_probability, p.anomaly_score, p.anomaly_flag, p.rule_score, p.risk_score,
         p.risk_band, p.decision, p.rule_reasons
  FROM txn t LEFT JOIN pred p ON t.transaction_id = p.transaction_id
)"""

FLT_SQL = f"""flt AS (
  SELECT *, CAST(transaction_timestamp AS DATE) AS transaction_date FROM mf
  WHERE transaction_timestamp IS NOT NULL
    AND CAST(transaction_timestamp AS DATE) BETWEEN DATE '{DASH_START}' AND DATE '{DASH_END}'
    AND channel IN ({_sql_list(DASH_CHANNELS)})
    AND risk_band IN ({_sql_list(DASH_BANDS)})
)"""


def _with(body: str, *extra_ctes: str) -> str:
    """Fixture CTEs, then ``extra_ctes`` in order, then the query body."""
    return "WITH " + fixture_ctes_sql() + "".join(",\n" + cte for cte in extra_ctes) + "\n" + body


def _filtered(spark, sf_dir):
    txn, pred = views(spark, sf_dir)
    return dash.dashboard_filter(mon.monitoring_frame(txn, pred), DASH_START, DASH_END, DASH_CHANNELS, DASH_BANDS)


# ---------------------------------------------------------------------------
# Monitoring SQL
# ---------------------------------------------------------------------------
# What each row of ``transactions LEFT JOIN predictions`` counts for: a missing label or
# outcome is 0, a missing prediction is risk 0.
FACTS_SQL = """facts AS (
  SELECT CAST(t.transaction_timestamp AS DATE) AS day, t.channel,
         CAST(t.is_fraud IS NOT DISTINCT FROM 1 AS BIGINT) AS fraud,
         CAST(t.is_success IS NOT DISTINCT FROM 1 AS DOUBLE) AS ok,
         ifnull(p.risk_score, 0.0::DOUBLE) AS risk, p.risk_score IS NOT NULL AS scored
  FROM txn t LEFT JOIN pred p USING (transaction_id)
)"""


def facts_measures(digits: int) -> str:
    return (
        "count(*) AS total_transactions, CAST(sum(fraud) AS BIGINT) AS fraud_transactions, "
        f"round(avg(ok) * 100.0::DOUBLE, {digits}) AS success_rate_pct, round(avg(risk), {digits}) AS avg_risk_score"
    )


TREND_SQL = f"SELECT day AS txn_date, {facts_measures(3)}, round(100.0::DOUBLE * sum(fraud) / count(*), 3) AS fraud_rate_pct FROM facts GROUP BY day"


@register("fraud_trend", _with(TREND_SQL + " ORDER BY day", FACTS_SQL))
def q_fraud_trend(spark, sf_dir):
    """F2 daily fraud trend (flagship)."""
    return mon.fraud_trend(*views(spark, sf_dir))


@register("overview_kpis", _with(f"SELECT {facts_measures(2)} FROM facts", FACTS_SQL))
def q_overview_kpis(spark, sf_dir):
    """F1 overview KPIs over the LEFT JOIN."""
    return mon.overview_kpis(*views(spark, sf_dir))


@register(
    "risk_distribution",
    _with("""SELECT risk_band, count(*) AS transactions FROM pred GROUP BY risk_band ORDER BY transactions DESC"""),
)
def q_risk_distribution(spark, sf_dir):
    """F3 predictions per band."""
    _, pred = views(spark, sf_dir)
    return mon.risk_distribution(pred)


@register(
    "channel_success_rates",
    _with(
        "SELECT channel, total_transactions AS transactions, success_rate_pct, avg_risk_score "
        f"FROM (SELECT channel, {facts_measures(3)} FROM facts GROUP BY channel)",
        FACTS_SQL,
    ),
)
def q_channel_success_rates(spark, sf_dir):
    """F4 success and risk per channel."""
    return mon.channel_success_rates(*views(spark, sf_dir))


_ALERT_SQL_COLS = (
    "t.transaction_id, t.transaction_timestamp, t.account_id, t.channel, t.merchant_category, t.Amount, "
    "round(p.risk_score, 6) AS risk_score, p.risk_band, p.decision, p.ml_probability, p.rule_score, p.rule_reasons"
)


@register(
    "top_alerts",
    _with(
        f"""SELECT {_ALERT_SQL_COLS}
FROM txn t JOIN pred p ON t.transaction_id = p.transaction_id
WHERE p.risk_score >= 45
ORDER BY p.risk_score DESC, t.transaction_id
LIMIT 50"""
    ),
)
def q_top_alerts(spark, sf_dir):
    """G1 / D2 top 50 alerts by risk (the limit is the feature)."""
    txn, pred = views(spark, sf_dir)
    return mon.recent_alerts(txn, pred, limit=50).withColumn("risk_score", F.round("risk_score", 6))


_MF_SELECT = (
    "transaction_id, transaction_timestamp, account_id, channel, merchant_category, Amount, hour, velocity_1h, "
    "avg_amount_24h, amount_to_avg_ratio, is_fraud, is_success, ml_probability, anomaly_score, anomaly_flag, "
    "rule_score, round(risk_score, 6) AS risk_score, risk_band, decision, rule_reasons"
)


@register("monitoring_frame", _with(f"SELECT {_MF_SELECT} FROM mf", MF_SQL))
def q_monitoring_frame(spark, sf_dir):
    """A8 / D1 the joined monitoring frame (20 columns)."""
    txn, pred = views(spark, sf_dir)
    return mon.monitoring_frame(txn, pred).withColumn("risk_score", F.round("risk_score", 6))


@register(
    "join_fanout",
    _with(
        """SELECT count(*) AS total_transactions,
       count(p.transaction_id) AS matched_predictions,
       CAST(sum(CASE WHEN coalesce(t.is_fraud, 0) = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fraud_transactions,
       round(avg(coalesce(p.risk_score, 0.0::DOUBLE)), 6) AS avg_risk_score
FROM txn t LEFT JOIN pred2 p ON t.transaction_id = p.transaction_id""",
        """pred2 AS (
  SELECT * FROM pred
  UNION ALL
  SELECT * FROM pred WHERE (CAST(substr(transaction_id, 4) AS BIGINT) - 1) % 11 = 0
)""",
    ),
)
def q_join_fanout(spark, sf_dir):
    """D3 several predictions per transaction: each one counts (per-transaction
    totals, so a transaction with many predictions is no hot join key)."""
    txn, pred = views(spark, sf_dir)
    event_id = F.substring("transaction_id", 4, 100).cast("bigint") - 1
    pred2 = pred.unionByName(pred.where(event_id % 11 == 0))
    w = mon._weighted(txn, pred2)
    return w.agg(
        F.sum("_w").alias("total_transactions"),
        F.sum(F.coalesce(F.col("_n_pred"), F.lit(0))).alias("matched_predictions"),
        F.sum(F.when(F.coalesce("is_fraud", F.lit(0)) == 1, 1).otherwise(0) * F.col("_w")).cast("bigint").alias(
            "fraud_transactions"
        ),
        F.round(F.sum("_risk") / F.sum("_w"), 6).alias("avg_risk_score"),
    )


@register(
    "processed_output",
    _with(
        """SELECT t.transaction_id, t.transaction_timestamp, t.Amount, t.is_fraud, t.is_success,
       p.ml_probability, p.anomaly_score, p.anomaly_flag, p.rule_score, round(p.risk_score, 6) AS risk_score,
       p.risk_band, p.decision, p.rule_reasons
FROM txn t JOIN pred p ON t.transaction_id = p.transaction_id"""
    ),
)
def q_processed_output(spark, sf_dir):
    """A5 / D4 processed export, joined by key."""
    txn, pred = views(spark, sf_dir)
    return mon.processed_output(txn, pred).withColumn("risk_score", F.round("risk_score", 6))


@register(
    "fk_orphans",
    _with(
        """SELECT a.transaction_id, a.rule_score, a.risk_band
FROM pred_more a
WHERE NOT EXISTS (SELECT 1 FROM txn_kept k WHERE k.transaction_id = a.transaction_id)""",
        """pred_more AS (
  SELECT transaction_id, rule_score, risk_band FROM pred
  UNION ALL
  SELECT transaction_id, 0.0::DOUBLE AS rule_score, 'low' AS risk_band FROM txn_ev WHERE event_id % 53 = 0
)""",
        "txn_kept AS (SELECT transaction_id FROM txn_ev WHERE event_id % 53 <> 0)",
    ),
)
def q_fk_orphans(spark, sf_dir):
    """B19 / D5 predictions without a transaction (anti join)."""
    txn, pred = views(spark, sf_dir)
    missing = txn.where(F.col("event_id") % 53 == 0).select(
        "transaction_id", F.lit(0.0).alias("rule_score"), F.lit("low").alias("risk_band")
    )
    pred_all = pred.select("transaction_id", "rule_score", "risk_band").unionByName(missing)
    kept = txn.where(F.col("event_id") % 53 != 0)
    return mon.fk_orphans(pred_all, kept)


# ---------------------------------------------------------------------------
# Dashboard
# ---------------------------------------------------------------------------
@register("dashboard_filter", _with(f"SELECT {_MF_SELECT}, transaction_date FROM flt", MF_SQL, FLT_SQL))
def q_dashboard_filter(spark, sf_dir):
    """B8 + B9 date range, channel and band filters."""
    return _filtered(spark, sf_dir).withColumn("risk_score", F.round("risk_score", 6))


@register(
    "filtered_fraud_trend",
    _with(
        """SELECT txn_date, total_transactions, fraud_transactions,
       round_even(fraud_transactions / total_transactions * 100.0::DOUBLE, 3) AS fraud_rate_pct,
       round_even(ok * 100.0::DOUBLE, 3) AS success_rate_pct,
       round_even(risk, 3) AS avg_risk_score
FROM (
  SELECT transaction_date AS txn_date, count(transaction_id) AS total_transactions,
         CAST(round_even(sum(CAST(coalesce(is_fraud, 0) AS DOUBLE)), 0) AS BIGINT) AS fraud_transactions,
         avg(CAST(coalesce(is_success, 0) AS DOUBLE)) AS ok,
         avg(coalesce(risk_score, 0.0::DOUBLE)) AS risk
  FROM flt GROUP BY transaction_date
) g ORDER BY txn_date""",
        MF_SQL,
        FLT_SQL,
    ),
)
def q_filtered_fraud_trend(spark, sf_dir):
    """F5 trend of the filtered frame."""
    return dash.filtered_fraud_trend(_filtered(spark, sf_dir))


@register(
    "risk_distribution_ordered",
    _with(
        """SELECT risk_band, count(*) AS transactions FROM flt WHERE risk_band IS NOT NULL
GROUP BY risk_band
ORDER BY CASE risk_band WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 99 END, transactions DESC""",
        MF_SQL,
        FLT_SQL,
    ),
)
def q_risk_distribution_ordered(spark, sf_dir):
    """F6 + G5 band counts in band order."""
    return dash.risk_distribution_ordered(_filtered(spark, sf_dir))


@register(
    "filtered_channel_rates",
    _with(
        """SELECT channel, count(transaction_id) AS transactions,
       round_even(avg(CAST(coalesce(is_success, 0) AS DOUBLE)) * 100.0::DOUBLE, 3) AS success_rate_pct,
       round_even(avg(coalesce(risk_score, 0.0::DOUBLE)), 3) AS avg_risk_score
FROM flt GROUP BY channel ORDER BY transactions DESC""",
        MF_SQL,
        FLT_SQL,
    ),
)
def q_filtered_channel_rates(spark, sf_dir):
    """F7 channel rates of the filtered frame."""
    return dash.filtered_channel_rates(_filtered(spark, sf_dir))


@register(
    "filtered_kpis",
    _with(
        """SELECT count(*) AS total_transactions,
       CAST(coalesce(sum(CASE WHEN is_fraud = 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS fraud_transactions,
       round(coalesce(sum(CASE WHEN is_fraud = 1 THEN 1 ELSE 0 END) * 100.0::DOUBLE / nullif(count(*), 0), 0.0), 6) AS fraud_rate_pct,
       round(avg(CAST(is_success AS DOUBLE)) * 100.0::DOUBLE, 6) AS success_rate_pct,
       round(avg(risk_score), 6) AS avg_risk_score
FROM flt""",
        MF_SQL,
        FLT_SQL,
    ),
)
def q_filtered_kpis(spark, sf_dir):
    """F8 headline KPIs of the filtered frame (means skip NULLs)."""
    k = dash.filtered_kpis(_filtered(spark, sf_dir))
    return k.select(
        "total_transactions", "fraud_transactions", r6("fraud_rate_pct"), r6("success_rate_pct"), r6("avg_risk_score")
    )


@register(
    "filtered_top_alerts",
    _with(
        """SELECT transaction_id, transaction_timestamp, account_id, channel, merchant_category, Amount,
       round(risk_score, 6) AS risk_score, risk_band, decision, ml_probability, rule_score, rule_reasons
FROM flt WHERE coalesce(risk_score, 0.0) >= 45
ORDER BY risk_score DESC, transaction_id LIMIT 20""",
        MF_SQL,
        FLT_SQL,
    ),
)
def q_filtered_top_alerts(spark, sf_dir):
    """G2 top 20 alerts of the filtered frame (the limit is the feature)."""
    return dash.filtered_top_alerts(_filtered(spark, sf_dir)).withColumn("risk_score", F.round("risk_score", 6))


@register(
    "date_bounds",
    _with(
        """SELECT min(CAST(transaction_timestamp AS DATE)) AS min_date, max(CAST(transaction_timestamp AS DATE)) AS max_date
FROM mf WHERE transaction_timestamp IS NOT NULL""",
        MF_SQL,
    ),
)
def q_date_bounds(spark, sf_dir):
    """F10 first and last date."""
    txn, pred = views(spark, sf_dir)
    return dash.date_bounds(mon.monitoring_frame(txn, pred))


@register(
    "distinct_channels",
    _with("SELECT DISTINCT channel FROM mf WHERE channel IS NOT NULL ORDER BY channel", MF_SQL),
)
def q_distinct_channels(spark, sf_dir):
    """F11 sorted distinct channels."""
    txn, pred = views(spark, sf_dir)
    return dash.distinct_values(mon.monitoring_frame(txn, pred), "channel")


@register(
    "distinct_categories",
    _with("SELECT DISTINCT merchant_category FROM mf WHERE merchant_category IS NOT NULL ORDER BY 1", MF_SQL),
)
def q_distinct_categories(spark, sf_dir):
    """F11 sorted distinct merchant categories."""
    txn, pred = views(spark, sf_dir)
    return dash.distinct_values(mon.monitoring_frame(txn, pred), "merchant_category")


# The remaining operators register themselves on import.
from txnwatch import catalog_models, catalog_ops, catalog_stream  # noqa: E402,F401
