"""Catalog entries for the streaming operators and the store (registered on import).

Each query lays the fixture rows (derived from ``events``) out as a file
source under the shared checkpoint folder, in time order, runs the stream over
all available input one file a trigger, and returns what the sink holds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from txnwatch.catalog import FACTS_SQL, TREND_SQL, _with, facts_measures, register, views
from txnwatch.plans import monitoring as mon
from txnwatch.plans.monitoring import monitoring_frame
from txnwatch.schema import TRANSACTION_COLUMNS
from txnwatch.sources import store
from txnwatch.sources.fixtures import predictions_from_transactions
from txnwatch.streaming import live

#: Triggers of a stream; its source has as many files, or more where the rows have more partitions.
FILES = 6


def _scratch(spark, name: str) -> str:
    return f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"


def _source(spark, rows, root: str):
    rows = rows.checkpoint(eager=True)  # ranged and sorted from here
    files = max(FILES, rows._jdf.rdd().getNumPartitions())
    live.write_time_ordered_files(rows, f"{root}/source", files=files)
    return live.stream_source(spark, f"{root}/source", rows.schema, files_per_trigger=-(-files // FILES))


@register(
    "live_stream_trend",
    _with(
        f"SELECT * FROM ({TREND_SQL}) WHERE CAST(txn_date AS TIMESTAMP) + INTERVAL 2 DAY "
        "<= (SELECT max(transaction_timestamp) FROM txn)",
        FACTS_SQL,
    ),
)
def q_live_stream_trend(spark, sf_dir):
    """K4 daily trend over a stream with a 1-day watermark; closed days only."""
    txn, pred = views(spark, sf_dir)
    root = _scratch(spark, "trend")
    src = _source(spark, monitoring_frame(txn, pred), root)
    live.run_available(live.daily_trend_stream(src), f"{root}/sink", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/sink")


@register(
    "live_stream_rollups",
    _with("SELECT transaction_id, account_id, velocity_1h, round(avg_amount_24h, 6) AS avg_amount_24h FROM txn"),
)
def q_live_stream_rollups(spark, sf_dir):
    """K5 per-account rolling features of arriving rows from the stored history."""
    txn, _ = views(spark, sf_dir)
    root = _scratch(spark, "rollups")
    src = _source(spark, txn.select(*live.ROLL_COLUMNS), root)
    live.run_batches(src, live.append_rollups(root), f"{root}/checkpoint")
    out = live.read_rollups(spark, root, txn.schema)
    return out.select("transaction_id", "account_id", "velocity_1h", F.round("avg_amount_24h", 6).alias("avg_amount_24h"))


LATE = "event_id % 29 = 0"
# Rows of ``LATE`` arrive in a last file of their own, after all others, and one file comes twice.
# A late row is counted in its own frame with all that is stored by then; rows before it stand as they were.
@register(
    "live_late_rollups",
    _with(
        """SELECT a.transaction_id, CAST(count(b.Amount) AS DOUBLE) AS velocity_1h
FROM ev a JOIN ev b ON a.account_id = b.account_id AND b.us > a.us - 3600000000
  AND (b.us < a.us OR (b.us = a.us AND b.transaction_id <= a.transaction_id)) AND (a.late OR NOT b.late)
GROUP BY a.transaction_id""",
        f"ev AS (SELECT transaction_id, account_id, Amount, epoch_us(transaction_timestamp) AS us, {LATE} AS late FROM txn_ev)",
    ),
)
def q_live_late_rollups(spark, sf_dir):
    """K5 with late rows, rows that come twice in one batch, and a replayed file."""
    txn, _ = views(spark, sf_dir)
    rows = txn.select(*live.ROLL_COLUMNS, "event_id")
    root = _scratch(spark, "late")
    write = live.append_rollups(root)
    rows = _on_time_then_late(spark, rows, root, write)
    return live.read_rollups(spark, root, rows.schema).select("transaction_id", "velocity_1h")


def _on_time_then_late(spark, rows, root, write):
    """Run the sink over the rows in time order without ``LATE`` ones, then over these, each twice in a batch, and once more."""
    rows = rows.checkpoint(eager=True)
    on_time, late = (rows.where(c).drop("event_id") for c in (f"NOT ({LATE})", LATE))
    live.run_batches(_source(spark, on_time, root), write, f"{root}/checkpoint")
    files = max(1, rows._jdf.rdd().getNumPartitions() // FILES)
    for again in ("late", "replay"):
        live.write_time_ordered_files(late.unionByName(late), f"{root}/{again}", files=files)
        live.run_batches(live.stream_source(spark, f"{root}/{again}", late.schema), write, f"{root}/checkpoint-{again}")
    return rows


@register("live_late_trend", _with(TREND_SQL, FACTS_SQL))
def q_live_late_trend(spark, sf_dir):
    """K4 with rows far behind the watermark: the corrected trend is the trend over all rows."""
    txn, pred = views(spark, sf_dir)
    root = _scratch(spark, "late-trend")
    rows = monitoring_frame(txn.select(*TRANSACTION_COLUMNS), pred).select(*live.TREND_COLUMNS)
    number = (F.substring("transaction_id", 4, 8).cast("bigint") - 1).alias("event_id")
    _on_time_then_late(spark, rows.select("*", number), root, live.append_day_sums(root))
    return live.read_day_trend(spark, root)


# One bad value of each kind that a live form can send, on rows picked by event_id.
def _spoiled(txn):
    bad = F.col("event_id") % 41
    return txn.withColumns(
        {
            "Amount": F.when(bad == 0, -F.col("Amount")).when(bad == 1, F.lit(float("nan"))).otherwise(F.col("Amount")),
            "hour": F.when(bad == 2, F.lit(24)).otherwise(F.col("hour")),
            "velocity_1h": F.when(bad == 3, F.lit(0.0)).otherwise(F.col("velocity_1h")),
            "avg_amount_24h": F.when(bad == 4, F.lit(None)).otherwise(F.col("avg_amount_24h")),
            "channel": F.when(bad == 5, F.lit("fax")).otherwise(F.col("channel")),
            "merchant_category": F.when(bad == 6, F.lit(None)).otherwise(F.col("merchant_category")),
        }
    )


SPOILED_SQL = """spoiled AS (
  SELECT * REPLACE (
    CASE event_id % 41 WHEN 0 THEN -Amount WHEN 1 THEN 'nan'::DOUBLE ELSE Amount END AS Amount,
    CASE event_id % 41 WHEN 2 THEN 24 ELSE hour END AS hour,
    CASE event_id % 41 WHEN 3 THEN 0.0 ELSE velocity_1h END AS velocity_1h,
    CASE event_id % 41 WHEN 4 THEN NULL ELSE avg_amount_24h END AS avg_amount_24h,
    CASE event_id % 41 WHEN 5 THEN 'fax' ELSE channel END AS channel,
    CASE event_id % 41 WHEN 6 THEN NULL ELSE merchant_category END AS merchant_category)
  FROM txn_ev
),
judged AS (
  SELECT *, CASE
    WHEN Amount IS NULL OR isnan(Amount) OR Amount < 0 THEN 'amount'
    WHEN hour IS NULL OR hour NOT BETWEEN 0 AND 23 THEN 'hour'
    WHEN velocity_1h IS NULL OR isnan(velocity_1h) OR velocity_1h < 1 THEN 'velocity'
    WHEN avg_amount_24h IS NULL OR isnan(avg_amount_24h) OR avg_amount_24h < 1 THEN 'avg_amount'
    WHEN channel IS NULL OR channel NOT IN ('web', 'mobile', 'pos', 'atm') THEN 'channel'
    WHEN merchant_category IS NULL OR merchant_category NOT IN
      ('grocery', 'electronics', 'travel', 'health', 'entertainment', 'utilities') THEN 'merchant_category'
  END AS violation FROM spoiled
)"""


@register("live_input_quarantine", _with("SELECT transaction_id, violation FROM judged WHERE violation IS NOT NULL", SPOILED_SQL))
def q_live_input_quarantine(spark, sf_dir):
    """B16 validity of live inputs; the bad rows and the check each failed."""
    from txnwatch.operators.quality import split_valid

    txn, _ = views(spark, sf_dir)
    _, bad = split_valid(_spoiled(txn))
    return bad.select("transaction_id", "violation")


def _live_append_sql() -> str:
    from txnwatch.functions.rules import rule_sql_duckdb
    from txnwatch.functions.scoring import risk_sql_duckdb

    def u(salt):
        return f"(('0x' || substr(md5('{salt}:' || CAST(event_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"

    rule, _ = rule_sql_duckdb()
    risk, band, decision = risk_sql_duckdb("ml_probability", "anomaly_score", "anomaly_flag", "rule_score")
    return _with(
        """SELECT s.transaction_id, s.violation, p.rule_score, p.risk_band, p.decision,
       CASE WHEN s.violation IS NULL AND p.decision IS NOT NULL THEN CAST(p.decision <> 'block' AS INTEGER) END AS is_success
FROM judged s LEFT JOIN la5 p USING (transaction_id)""",
        SPOILED_SQL,
        """la0 AS (
  SELECT * EXCLUDE (avg_amount_24h, amount_to_avg_ratio),
         greatest(avg_amount_24h, 1.0) AS avg_amount_24h,
         Amount / greatest(avg_amount_24h, 1.0) AS amount_to_avg_ratio
  FROM judged WHERE violation IS NULL
)""",
        f"""la1 AS (
  SELECT transaction_id, {u('ml')} AS ml_probability, 2.0 * {u('an')} - 1.0 AS anomaly_score,
         {rule} AS rule_score
  FROM la0 WHERE event_id % 53 <> 0
)""",
        "la2 AS (SELECT *, CAST(anomaly_score < 0 AS INTEGER) AS anomaly_flag FROM la1)",
        f"la3 AS (SELECT *, {risk} AS risk_score FROM la2)",
        f"la4 AS (SELECT *, {band} AS risk_band FROM la3)",
        f"la5 AS (SELECT *, {decision} AS decision FROM la4)",
    )


@register("live_store_append", _live_append_sql())
def q_live_store_append(spark, sf_dir):
    """K1-K3 stream -> validate (B16) -> score -> outcome -> append to both tables; stored and quarantined rows are all rows."""
    txn, _ = views(spark, sf_dir)
    root = _scratch(spark, "append")
    src = _source(spark, _spoiled(txn), root)
    live.run_batches(src, live.append_to_store(f"{root}/store", predictions_from_transactions), f"{root}/checkpoint")
    tx, preds = store.read_monitoring_tables(spark, f"{root}/store")
    good = tx.select("transaction_id", "is_success").join(
        preds.select("transaction_id", "rule_score", "risk_band", "decision"), "transaction_id", "left"
    )
    bad = live.read_quarantine(spark, f"{root}/store").select("transaction_id", "violation")
    out = good.withColumn("violation", F.lit(None).cast("string")).unionByName(bad, allowMissingColumns=True)
    return out.select("transaction_id", "violation", "rule_score", "risk_band", "decision", "is_success")


# ---------------------------------------------------------------------------
# The store (A6, A7, A12, B17-B20, D1 = F1)
# ---------------------------------------------------------------------------
LATER = "event_id % 7 = 0"


@register(
    "store_late_prediction",
    _with(
        f"""SELECT via, {facts_measures(6)}, count(*) FILTER (WHERE scored) AS matched
FROM (SELECT facts.*, scored, unnest(['frame', 'overview']) AS via FROM facts) GROUP BY via""",
        FACTS_SQL,
    ),
)
def q_store_late_prediction(spark, sf_dir):
    """A7 predictions that come after their transactions: the overview and the joined frame count the same."""
    txn, _ = views(spark, sf_dir)
    txn = txn.checkpoint(eager=True)
    pred = predictions_from_transactions(txn)
    root = _scratch(spark, "late-prediction")
    soon = predictions_from_transactions(txn.where(f"NOT ({LATER})"))
    store.append_live_predictions(txn, soon, root)
    store.append_live_predictions(txn.limit(0), pred, root)
    tx, pr = store.read_monitoring_tables(spark, root)
    joined = monitoring_frame(tx, pr).agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.sum(mon._fraud01()).cast("bigint").alias("fraud_transactions"),
        F.round(F.avg(mon._success01()) * 100.0, 6).alias("success_rate_pct"),
        F.round(F.avg(mon._risk0()), 6).alias("avg_risk_score"),
        F.count("risk_score").alias("matched"),
    )
    matched = F.sum(F.coalesce("_n_pred", F.lit(0))).alias("matched")
    overview = mon._weighted(tx, pr).agg(*mon._weighted_measures(6), matched)
    return joined.withColumn("via", F.lit("frame")).unionByName(overview.withColumn("via", F.lit("overview")))


@register(
    "store_second_prediction",
    _with(
        f"""SELECT CASE WHEN {LATER} AND event_id % 53 <> 0 THEN 2 WHEN event_id % 53 <> 0 THEN 1 ELSE 0 END AS predictions,
       count(*) AS transactions FROM txn_ev GROUP BY 1"""
    ),
)
def q_store_second_prediction(spark, sf_dir):
    """D3 scoring again in another run adds predictions; a replay of a run adds none; ids stay unique."""
    txn, _ = views(spark, sf_dir)
    txn = txn.checkpoint(eager=True)
    root = _scratch(spark, "second-prediction")
    again = txn.where(LATER)
    store.append_live_predictions(txn, predictions_from_transactions(txn), root, run="first")
    for _ in range(2):
        store.append_live_predictions(again, predictions_from_transactions(again), root, run="second")
    tx, pr = store.read_monitoring_tables(spark, root)
    unique = pr.agg(F.count_distinct("prediction_id"), F.count(F.lit(1))).first()
    if unique[0] != unique[1]:
        raise ValueError("prediction ids are not unique")
    counts = pr.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("n"))
    each = tx.select("transaction_id").join(counts, "transaction_id", "left")
    return each.groupBy(F.coalesce("n", F.lit(0)).cast("int").alias("predictions")).agg(F.count(F.lit(1)).alias("transactions"))


# Predictions of ``LATER`` transactions come twice: with the others or after them, and from a second run.
TWICE_SQL = f"""twice AS (
  SELECT facts.* FROM facts
  UNION ALL SELECT CAST(t.transaction_timestamp AS DATE), t.channel, CAST(t.is_fraud IS NOT DISTINCT FROM 1 AS BIGINT),
         CAST(t.is_success IS NOT DISTINCT FROM 1 AS DOUBLE), p.risk_score, true
  FROM txn t JOIN txn_ev e USING (transaction_id) JOIN pred p USING (transaction_id) WHERE e.{LATER}
)"""


def _totals_store(spark, sf_dir):
    """A store written by a refresh and appends: late predictions, a second run, and a merge of the segments."""
    txn, _ = views(spark, sf_dir)
    txn = txn.checkpoint(eager=True)
    root = _scratch(spark, "totals")
    soon, later = txn.where(f"event_id % 2 = 0 AND NOT ({LATER})"), txn.where(LATER)
    store.write_monitoring_data(txn.where("event_id % 2 = 0"), predictions_from_transactions(soon), root, run="first")
    store.append_live_predictions(txn, predictions_from_transactions(txn), root, run="first")
    store.append_live_predictions(later, predictions_from_transactions(later), root, run="second")
    store.compact_store(spark, root, most=1)
    return store.read_totals(spark, root)


@register("store_totals_overview", _with(f"SELECT {facts_measures(2)} FROM twice", FACTS_SQL, TWICE_SQL))
def q_store_totals_overview(spark, sf_dir):
    """F1 from the sums that each write adds; no table is read and nothing joined."""
    return mon.overview_from_totals(_totals_store(spark, sf_dir))


@register("store_totals_trend", _with(TREND_SQL.replace("FROM facts", "FROM twice"), FACTS_SQL, TWICE_SQL))
def q_store_totals_trend(spark, sf_dir):
    """F2 from the sums that each write adds."""
    return mon.trend_from_totals(_totals_store(spark, sf_dir))


@register(
    "store_totals_channels",
    _with(
        "SELECT channel, total_transactions AS transactions, success_rate_pct, avg_risk_score "
        f"FROM (SELECT channel, {facts_measures(3)} FROM twice GROUP BY channel)",
        FACTS_SQL,
        TWICE_SQL,
    ),
)
def q_store_totals_channels(spark, sf_dir):
    """F4 from the sums that each write adds."""
    return mon.channels_from_totals(_totals_store(spark, sf_dir))


@register(
    "store_key_across_dates",
    _with("SELECT count(*) AS stored, count(DISTINCT transaction_id) AS ids, 1 AS refused, 0 AS added_by_replay FROM txn"),
)
def q_store_key_across_dates(spark, sf_dir):
    """B17 a stored id under another date is refused, and the table keeps its key."""
    txn, _ = views(spark, sf_dir)
    txn = txn.checkpoint(eager=True)
    root = _scratch(spark, "key")
    store.append_live_predictions(txn, predictions_from_transactions(txn), root)
    moved = txn.where(LATER).withColumn("transaction_timestamp", F.expr("transaction_timestamp + INTERVAL 3 DAYS"))
    refused = 0
    try:
        store.append_live_predictions(moved, predictions_from_transactions(moved), root)
    except ValueError:
        refused = 1
    added = store.append_live_predictions(txn, predictions_from_transactions(txn), root)
    tx, _ = store.read_monitoring_tables(spark, root)
    return tx.agg(F.count(F.lit(1)).alias("stored"), F.count_distinct("transaction_id").alias("ids")).select(
        "stored", "ids", F.lit(refused).alias("refused"), F.lit(added).alias("added_by_replay")
    )
