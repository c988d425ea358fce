"""Catalog entries for windows, scalar functions, draws, rules and scoring,
sampling, splitting, metrics and quality checks (registered on import)."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import functions as F

from txnwatch.catalog import MF_SQL, REGISTRY, _with, register, views
from txnwatch.functions import scalars as S
from txnwatch.functions.draws import keyed_hex_id, keyed_integer, keyed_uniform, weighted_choice
from txnwatch.functions.rules import rule_columns
from txnwatch.functions.scoring import (
    anomaly_to_risk,
    bumped_risk,
    combine_risk_components,
    decision_from_band,
    reaches,
    risk_band,
)
from txnwatch.operators import metrics as M
from txnwatch.operators import quality as Q
from txnwatch.operators.prefix import row_numbers
from txnwatch.operators.rolling import add_account_rollups, rolling_count_mean
from txnwatch.operators.sampling import stratified_sample, stratified_split
from txnwatch.plans.monitoring import monitoring_frame
from txnwatch.schema import (
    CHANNEL_WEIGHTS,
    CHANNELS,
    DAY_US,
    MERCHANT_CATEGORIES,
    MERCHANT_WEIGHTS,
    MODEL_FEATURES,
    PREDICTION_COLUMNS,
    TRANSACTION_COLUMNS,
)
from txnwatch.sources.fixtures import predictions_of_all, raw_from_events
from txnwatch.sources.tables import read_table


def _u(salt: str, key: str = "event_id") -> str:
    return f"(('0x' || substr(md5('{salt}:' || CAST({key} AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _cuts(weights) -> list[float]:
    total = float(sum(weights))
    return list(accumulate(w / total for w in weights[:-1]))


def _choice_sql(u: str, values, weights) -> str:
    parts = [f"WHEN {u} < {c!r} THEN '{v}'" for v, c in zip(values, _cuts(weights))]
    return "(CASE " + " ".join(parts) + f" ELSE '{values[-1]}' END)"


# ---------------------------------------------------------------------------
# Windows (W1-W4)
# ---------------------------------------------------------------------------
@register("velocity_1h", _with("SELECT transaction_id, account_id, velocity_1h FROM txn"))
def q_velocity_1h(spark, sf_dir):
    """W1 rolling 1h count per account (ties taken one by one)."""
    txn, _ = views(spark, sf_dir)
    return txn.select("transaction_id", "account_id", "velocity_1h")


@register(
    "avg_amount_24h",
    _with("SELECT transaction_id, account_id, avg_amount_24h, amount_to_avg_ratio FROM txn"),
)
def q_avg_amount_24h(spark, sf_dir):
    """W2 rolling 24h mean per account and the batch ratio."""
    txn, _ = views(spark, sf_dir)
    return txn.select("transaction_id", "account_id", "avg_amount_24h", "amount_to_avg_ratio")


ROLL_DAYS = 30
_ROLL_US = ROLL_DAYS * DAY_US


@register(
    "rolling_ties",
    f"""WITH o AS (
  SELECT o_orderkey, o_custkey % 50 AS account, o_totalprice AS amt, epoch_us(o_orderdate) AS us FROM orders
), r AS (
  SELECT o_orderkey,
    count(amt) OVER w - count(amt) OVER p AS roll_count,
    sum(CAST(amt AS DECIMAL(18,2))) OVER w - coalesce(sum(CAST(amt AS DECIMAL(18,2))) OVER p, 0) AS roll_sum
  FROM o
  WINDOW w AS (PARTITION BY account ORDER BY us RANGE BETWEEN {_ROLL_US - 1} PRECEDING AND CURRENT ROW),
         p AS (PARTITION BY account, us ORDER BY o_orderkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
)
SELECT o_orderkey, roll_count,
       round(CASE WHEN roll_count > 0 THEN CAST(roll_sum AS DOUBLE) / CAST(roll_count AS DOUBLE) END, 6) AS roll_mean
FROM r""",
)
def q_rolling_ties(spark, sf_dir):
    """W1/W2 semantics on tied timestamps: 30-day count and mean per customer group of orders."""
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey",
        (F.col("o_custkey") % 50).alias("account"),
        F.col("o_totalprice").alias("amt"),
        F.col("o_orderdate").alias("ts"),
    )
    r = rolling_count_mean(o, _ROLL_US, account="account", ts="ts", amount="amt", tie="o_orderkey")
    return r.select("o_orderkey", "roll_count", F.round("roll_mean", 6).alias("roll_mean"))


# A third of all rows belong to one account; the bound is small, so that the groups of this account are hot at every size.
HOT_ACCOUNT, HOT_GROUP_ROWS = 1, 64


@register(
    "rolling_hot_account",
    _with(
        """SELECT transaction_id, count(*) OVER w - count(*) OVER p AS n,
  round(CAST(sum(CAST(Amount AS DECIMAL(18,2))) OVER d - coalesce(sum(CAST(Amount AS DECIMAL(18,2))) OVER p, 0) AS DOUBLE)
        / (count(*) OVER d - count(*) OVER p), 6) AS mean_24h
FROM hot
WINDOW w AS (PARTITION BY account_id ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW),
       d AS (PARTITION BY account_id ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW),
       p AS (PARTITION BY account_id, us ORDER BY transaction_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)""",
        """hot AS (SELECT transaction_id, Amount, epoch_us(transaction_timestamp) AS us,
  CASE WHEN event_id % 3 = 0 THEN 1 ELSE account_id END AS account_id FROM txn_ev)""",
    ),
)
def q_rolling_hot_account(spark, sf_dir):
    """W1, W2 where one account has a third of all rows: its groups are measured and take the split form."""
    txn, _ = views(spark, sf_dir)
    account = F.when(F.col("event_id") % 3 == 0, HOT_ACCOUNT).otherwise(F.col("account_id"))
    rows = txn.select("transaction_id", account.alias("account_id"), "transaction_timestamp", "Amount").checkpoint(eager=True)
    rolled = add_account_rollups(rows, hot_rows=HOT_GROUP_ROWS)
    return rolled.select("transaction_id", F.col("velocity_1h").cast("bigint").alias("n"), F.round("avg_amount_24h", 6).alias("mean_24h"))


@register(
    "sequential_id",
    "SELECT event_id, printf('TXN%08d', row_number() OVER (ORDER BY ts, event_id)) AS seq_id FROM events",
)
def q_sequential_id(spark, sf_dir):
    """W4 sequential ids by row order (distributed prefix count)."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts")
    n = row_numbers(ev, ["ts", "event_id"], "_n")
    return n.select("event_id", S.padded_id("TXN", "_n").alias("seq_id"))


# ---------------------------------------------------------------------------
# Scalar functions (E1-E5, E8-E11, E16-E21) and timestamp parsing
# ---------------------------------------------------------------------------
@register(
    "scalar_functions",
    _with(
        f"""SELECT t.transaction_id,
  TIMESTAMP '2024-01-01 00:00:00' + to_microseconds(CAST(round(r.Time * 1000000) AS BIGINT)) AS e1_offset_ts,
  t.hour AS e2_hour,
  printf('TXN%08d', t.account_id) AS e3_padded,
  strftime(t.transaction_timestamp, '%Y-%m-%d') AS e4_day_text,
  CAST(t.transaction_timestamp AS DATE) AS e5_date,
  t.Amount / (t.avg_amount_24h + 1e-6) AS e8_ratio_eps,
  t.Amount / greatest(t.avg_amount_24h, 1.0) AS e9_ratio_floor,
  CAST(t.velocity_1h >= 4 AS DOUBLE) * 0.08 + CAST(t.Amount > 1000 AS DOUBLE) * 0.05 + CAST(t.channel = 'atm' AS DOUBLE) * 0.03 AS e10_friction,
  greatest(0.1, least(500.0, t.Amount)) AS e11_clip,
  round(t.Amount / 3, 2) AS e16_round_half_up,
  round_even(t.Amount / 3, 2) AS e16_round_half_even,
  lower(upper(t.merchant_category)) AS e17_lower,
  CASE p.risk_band WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 99 END AS e19_band_rank,
  'LIVE' || upper(substr(md5('live:' || CAST(t.event_id AS VARCHAR)), 1, 10)) AS e20_live_id,
  CAST(900000 + floor((('0x' || substr(md5('live_account:' || CAST(t.event_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0::DOUBLE) * 100000) AS BIGINT) AS e20_live_account,
  CASE WHEN p.decision <> 'block' THEN 1 ELSE 0 END AS e21_outcome
FROM txn_ev t JOIN raw r ON r.event_id = t.event_id LEFT JOIN pred p ON p.transaction_id = t.transaction_id"""
    ),
)
def q_scalar_functions(spark, sf_dir):
    """E1-E5, E8-E11, E16, E17, E19-E21, one column each."""
    txn, pred = views(spark, sf_dir)
    raw = raw_from_events(read_table(spark, sf_dir, "events")).select("event_id", "Time")
    j = txn.join(raw, "event_id").join(pred.select("transaction_id", "risk_band", "decision"), "transaction_id", "left")
    return j.select(
        "transaction_id",
        S.offset_timestamp("Time").alias("e1_offset_ts"),
        S.hour_of("transaction_timestamp").alias("e2_hour"),
        S.padded_id("TXN", "account_id").alias("e3_padded"),
        S.day_text("transaction_timestamp").alias("e4_day_text"),
        S.to_day("transaction_timestamp").alias("e5_date"),
        S.ratio_with_epsilon("Amount", "avg_amount_24h").alias("e8_ratio_eps"),
        S.ratio_with_floor("Amount", "avg_amount_24h").alias("e9_ratio_floor"),
        S.friction_penalty("velocity_1h", "Amount", "channel").alias("e10_friction"),
        S.clip(F.col("Amount"), 0.1, 500.0).alias("e11_clip"),
        F.round(F.col("Amount") / 3, 2).alias("e16_round_half_up"),
        F.bround(F.col("Amount") / 3, 2).alias("e16_round_half_even"),
        F.lower(F.upper("merchant_category")).alias("e17_lower"),
        S.band_rank("risk_band").alias("e19_band_rank"),
        keyed_hex_id("LIVE", "live", "event_id").alias("e20_live_id"),
        keyed_integer("live_account", "event_id", 900000, 1000000).alias("e20_live_account"),
        S.outcome_flag("decision").alias("e21_outcome"),
    )


@register(
    "timestamp_parse",
    """SELECT event_id, CASE event_id % 5
    WHEN 0 THEN ts
    WHEN 1 THEN date_trunc('second', ts) - INTERVAL 2 HOUR
    WHEN 2 THEN date_trunc('second', ts)
  END AS parsed FROM events""",
)
def q_timestamp_parse(spark, sf_dir):
    """E6 tolerant parsing of texts made from event times: plain, ISO with a zone, ISO in UTC, garbage and NULL."""
    ev = read_table(spark, sf_dir, "events")
    second = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = (
        F.when(F.col("event_id") % 5 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .when(F.col("event_id") % 5 == 1, F.concat(second, F.lit("+02:00")))
        .when(F.col("event_id") % 5 == 2, F.concat(second, F.lit("Z")))
        .when(F.col("event_id") % 5 == 3, F.concat(F.lit("on "), second))
    )
    parsed = S.parse_timestamp(text)
    utc = F.timestamp_add("MICROSECOND", F.unix_micros(parsed), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return ev.select("event_id", utc.alias("parsed"))


# ---------------------------------------------------------------------------
# Keyed draws
# ---------------------------------------------------------------------------
@register("keyed_draw", f"SELECT event_id, {_u('fraud')} AS u_fraud, {_u('ok')} AS u_ok FROM events")
def q_keyed_draw(spark, sf_dir):
    """C5 keyed uniform draws, independent of partitioning."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select("event_id", keyed_uniform("fraud", "event_id").alias("u_fraud"),
                     keyed_uniform("ok", "event_id").alias("u_ok"))


@register(
    "weighted_assignment",
    f"""SELECT event_id,
  {_choice_sql(_u('channel'), CHANNELS, CHANNEL_WEIGHTS)} AS channel,
  {_choice_sql(_u('category'), MERCHANT_CATEGORIES, MERCHANT_WEIGHTS)} AS merchant_category
FROM events""",
)
def q_weighted_assignment(spark, sf_dir):
    """E13 weighted categorical assignment by keyed draw."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        "event_id",
        weighted_choice("channel", "event_id", CHANNELS, CHANNEL_WEIGHTS).alias("channel"),
        weighted_choice("category", "event_id", MERCHANT_CATEGORIES, MERCHANT_WEIGHTS).alias("merchant_category"),
    )


@register(
    "keyed_bernoulli",
    f"""SELECT event_id,
  CAST(100000 + floor({_u('acct')} * 899999) AS BIGINT) AS account_id,
  CASE WHEN {_u('out')} < 0.5 THEN 1 ELSE 0 END AS outcome
FROM events""",
)
def q_keyed_bernoulli(spark, sf_dir):
    """E14 uniform integer assignment and Bernoulli outcome."""
    from txnwatch.functions.draws import keyed_bernoulli

    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        "event_id",
        keyed_integer("acct", "event_id", 100000, 999999).alias("account_id"),
        keyed_bernoulli("out", "event_id", 0.5).alias("outcome"),
    )


@register(
    "success_probability",
    _with(
        """SELECT transaction_id,
  greatest(0.05, least(0.995, (CASE WHEN label = 1 THEN 0.55 ELSE 0.985 END)
    - (CAST(velocity_1h >= 4 AS DOUBLE) * 0.08 + CAST(Amount > 1000 AS DOUBLE) * 0.05
       + CAST(channel = 'atm' AS DOUBLE) * 0.03))) AS success_probability
FROM txn_ev"""
    ),
)
def q_success_probability(spark, sf_dir):
    """E12 success probability with friction penalty."""
    txn, _ = views(spark, sf_dir)
    return txn.select(
        "transaction_id", S.success_probability("label", "velocity_1h", "Amount", "channel").alias("success_probability")
    )


# ---------------------------------------------------------------------------
# Rules and scoring
# ---------------------------------------------------------------------------
def _rule_sql():
    from txnwatch.functions.rules import rule_sql_duckdb

    return rule_sql_duckdb()


@register(
    "rule_score",
    _with(f"SELECT transaction_id, {_rule_sql()[0]} AS rule_score, {_rule_sql()[1]} AS rule_reasons FROM txn"),
)
def q_rule_score(spark, sf_dir):
    """R1 rule table over every transaction."""
    txn, _ = views(spark, sf_dir)
    rc = rule_columns()
    return txn.select("transaction_id", rc.score.alias("rule_score"), rc.reasons_text.alias("rule_reasons"))


@register(
    "anomaly_risk",
    _with("SELECT transaction_id, round(1.0 / (1.0 + exp(3.0 * anomaly_score)), 6) AS anomaly_risk FROM pred_all"),
)
def q_anomaly_risk(spark, sf_dir):
    """R2 / E15 logistic anomaly risk."""
    pred = predictions_of_all(views(spark, sf_dir)[0])
    return pred.select("transaction_id", F.round(anomaly_to_risk("anomaly_score"), 6).alias("anomaly_risk"))


@register(
    "combined_risk",
    _with(
        """SELECT transaction_id,
  round(greatest(0.0, least(100.0, ml_probability * 100.0 * 0.6
    + (1.0 / (1.0 + exp(3.0 * anomaly_score))) * 100.0 * 0.2 + rule_score * 0.2)), 6) AS combined_risk
FROM pred_all"""
    ),
)
def q_combined_risk(spark, sf_dir):
    """R3 blend of the three signals, clipped to 0-100."""
    pred = predictions_of_all(views(spark, sf_dir)[0])
    c = combine_risk_components("ml_probability", anomaly_to_risk("anomaly_score"), "rule_score")
    return pred.select("transaction_id", F.round(c, 6).alias("combined_risk"))


_PRED_SQL_COLS = (
    "transaction_id, ml_probability, anomaly_score, anomaly_flag, rule_score, round(risk_score, 6) AS risk_score, "
    "risk_band, decision, rule_reasons"
)


@register("hybrid_score", _with(f"SELECT {_PRED_SQL_COLS} FROM pred_all"))
def q_hybrid_score(spark, sf_dir):
    """R7 full hybrid scoring (fixed model inputs), R4 bump included."""
    pred = predictions_of_all(views(spark, sf_dir)[0])
    return pred.select(*PREDICTION_COLUMNS).withColumn("risk_score", F.round("risk_score", 6))


@register("risk_band", _with("SELECT transaction_id, round(risk_score, 6) AS risk_score, risk_band FROM pred_all"))
def q_risk_band(spark, sf_dir):
    """R5 / B14 risk band from the score."""
    pred = predictions_of_all(views(spark, sf_dir)[0])
    return pred.select("transaction_id", F.round("risk_score", 6).alias("risk_score"), "risk_band")


@register("decision", _with("SELECT transaction_id, risk_band, decision FROM pred_all"))
def q_decision(spark, sf_dir):
    """R6 decision from the band."""
    pred = predictions_of_all(views(spark, sf_dir)[0])
    return pred.select("transaction_id", "risk_band", "decision")


@register("anomaly_flag", _with("SELECT transaction_id, anomaly_score, anomaly_flag FROM pred_all"))
def q_anomaly_flag(spark, sf_dir):
    """M7 anomaly flag = decision score below zero."""
    pred = predictions_of_all(views(spark, sf_dir)[0])
    return pred.select("transaction_id", "anomaly_score", "anomaly_flag")


# Boundary values of the scores, spread over the events: exact cuts, just below them, NaN and NULL.
_EDGE_SCORES = [75.0, 74.999999, 45.0, 44.999999, None, float("nan"), 0.0, 100.0, 54.9, 55.0]


def _pick(column, values):
    expr = F.lit(None).cast("double")
    for i, v in enumerate(values):
        expr = F.when(column == i, F.lit(v).cast("double")).otherwise(expr)
    return expr


def _pick_sql(key: str, values) -> str:
    text = {None: "NULL"}
    arms = [f"WHEN {i} THEN {text.get(v) or ('CAST(' + repr(str(v)) + ' AS DOUBLE)')}" for i, v in enumerate(values)]
    return f"(CASE {key} " + " ".join(arms) + " END)"


@register(
    "risk_edges",
    f"""SELECT event_id,
  CASE WHEN isnan(s) THEN 'low' WHEN s >= 75.0 THEN 'high' WHEN s >= 45.0 THEN 'medium' ELSE 'low' END AS band,
  CASE WHEN isnan(s) THEN 'approve' WHEN s >= 75.0 THEN 'block' WHEN s >= 45.0 THEN 'review' ELSE 'approve' END AS decision,
  coalesce(s >= 45.0 AND NOT isnan(s), false) AS alert,
  s + CASE WHEN NOT isnan(s) AND s < 55.0 THEN 10.0 ELSE 0.0 END AS bumped,
  CASE WHEN s IS NULL THEN NULL WHEN isnan(s) THEN NULL ELSE round(greatest(0.0, least(100.0, 0.6 * s + 10.0 + 10.0)), 6) END AS blended,
  greatest(10.0, least(90.0, CASE WHEN isnan(s) THEN NULL ELSE s END)) AS clipped,
  isnan(s) AS nan_clipped
FROM (SELECT event_id, {_pick_sql("event_id % 10", _EDGE_SCORES)} AS s FROM events)""",
)
def q_risk_edges(spark, sf_dir):
    """R3-R6, E11 and the alert threshold at exact cuts, NaN and NULL."""
    s = F.col("s")
    ev = read_table(spark, sf_dir, "events").select("event_id", _pick(F.col("event_id") % 10, _EDGE_SCORES).alias("s"))
    clipped = S.clip(s, 10.0, 90.0)
    # Spark has no greatest() that skips a NaN: the SQL shows NaN as NULL next to a flag, and NULL as the bound.
    return ev.select(
        "event_id",
        risk_band(s).alias("band"),
        decision_from_band(risk_band(s)).alias("decision"),
        F.coalesce(reaches(s, 45.0), F.lit(False)).alias("alert"),
        bumped_risk(s, F.lit(1)).alias("bumped"),
        F.round(F.nanvl(combine_risk_components(s / 100.0, F.lit(0.5), F.lit(50.0)), F.lit(None)), 6).alias("blended"),
        F.when(s.isNull() | F.isnan(s), F.lit(90.0)).otherwise(clipped).alias("clipped"),
        F.when(s.isNotNull(), F.isnan(clipped)).alias("nan_clipped"),
    )


_EDGE_VELOCITY = [4.0, 3.999, None, float("nan"), 10.0]
_EDGE_AMOUNT = [1000.0, 1000.01, float("nan"), None, 5.0, 2e9, -1.0]


@register(
    "friction_edges",
    f"""SELECT event_id,
  round(CASE WHEN v >= 4 AND NOT isnan(v) THEN 0.08 WHEN v IS NULL THEN NULL ELSE 0.0 END
    + CASE WHEN a > 1000 AND NOT isnan(a) THEN 0.05 WHEN a IS NULL THEN NULL ELSE 0.0 END
    + CASE WHEN event_type = 'error' THEN 0.03 ELSE 0.0 END, 6)::DOUBLE AS penalty
FROM (SELECT event_id, event_type, {_pick_sql("event_id % 5", _EDGE_VELOCITY)} AS v,
             {_pick_sql("event_id % 7", _EDGE_AMOUNT)} AS a FROM events)""",
)
def q_friction_edges(spark, sf_dir):
    """E10 at its bounds, NaN and NULL."""
    ev = read_table(spark, sf_dir, "events").select(
        "event_id",
        _pick(F.col("event_id") % 5, _EDGE_VELOCITY).alias("v"),
        _pick(F.col("event_id") % 7, _EDGE_AMOUNT).alias("a"),
        F.when(F.col("event_type") == "error", F.lit("atm")).otherwise(F.lit("web")).alias("c"),
    )
    return ev.select("event_id", F.round(S.friction_penalty("v", "a", "c"), 6).alias("penalty"))


# ---------------------------------------------------------------------------
# Sampling and splitting
# ---------------------------------------------------------------------------
SAMPLE_SIZE = 2000


@register(
    "stratified_sample",
    _with(
        f"""SELECT event_id, Time, Amount, Class FROM raw WHERE Class = 1
UNION ALL
SELECT event_id, Time, Amount, Class FROM (
  SELECT *, row_number() OVER (ORDER BY {_u('sample42')}, event_id) AS rn FROM raw WHERE Class = 0
) WHERE rn <= greatest({SAMPLE_SIZE} - (SELECT count(*) FROM raw WHERE Class = 1), 0)"""
    ),
)
def q_stratified_sample(spark, sf_dir):
    """C1 + S1 all fraud rows plus the smallest-draw non-fraud rows (sampling is the feature)."""
    raw = raw_from_events(read_table(spark, sf_dir, "events"))
    return stratified_sample(raw, SAMPLE_SIZE, label="Class", key="event_id").select("event_id", "Time", "Amount", "Class")


@register("filter_label", _with("SELECT event_id, Time, Amount, Class FROM raw WHERE Class = 1"))
def q_filter_label(spark, sf_dir):
    """B6 equality filter on the label."""
    raw = raw_from_events(read_table(spark, sf_dir, "events"))
    return raw.where(F.col("Class") == 1).select("event_id", "Time", "Amount", "Class")


@register(
    "train_test_split_sizes",
    _with(
        """SELECT label, CAST(n AS BIGINT) AS n_rows,
       CAST(base + CASE WHEN rk <= leftover THEN 1 ELSE 0 END AS BIGINT) AS n_test,
       CAST(n - base - CASE WHEN rk <= leftover THEN 1 ELSE 0 END AS BIGINT) AS n_train
FROM sp_r""",
        "sp_c AS (SELECT label, count(*) AS n FROM txn_ev GROUP BY label)",
        "sp_t AS (SELECT sum(n) AS total, CAST(ceil(0.2 * sum(n)) AS BIGINT) AS nt FROM sp_c)",
        """sp_a AS (SELECT sp_c.label, sp_c.n, (sp_c.n * sp_t.nt) // sp_t.total AS base,
                (sp_c.n * sp_t.nt) % sp_t.total AS rem, sp_t.nt FROM sp_c, sp_t)""",
        """sp_r AS (SELECT *, row_number() OVER (ORDER BY rem DESC, label) AS rk,
                nt - sum(base) OVER () AS leftover FROM sp_a)""",
    ),
)
def q_train_test_split_sizes(spark, sf_dir):
    """C3 stratified split with exact per-class test sizes."""
    txn, _ = views(spark, sf_dir)
    sp = stratified_split(txn.select("transaction_id", "label"), "label", "transaction_id")
    tr = sp.train.groupBy("label").agg(F.count(F.lit(1)).alias("n_train"))
    te = sp.test.groupBy("label").agg(F.count(F.lit(1)).alias("n_test"))
    j = tr.join(te, "label", "full").fillna(0, ["n_train", "n_test"])
    return j.select("label", (F.col("n_train") + F.col("n_test")).alias("n_rows"), "n_test", "n_train")


# ---------------------------------------------------------------------------
# Metrics (F12, H6-H9)
# ---------------------------------------------------------------------------
@register(
    "class_weights",
    _with(
        """SELECT label, n_rows, CAST(n_rows AS DOUBLE) / CAST(n AS DOUBLE) AS share,
       CAST(n AS DOUBLE) / (CAST(k AS DOUBLE) * n_rows) AS balanced_weight
FROM (SELECT label, count(*) AS n_rows, sum(count(*)) OVER () AS n, count(*) OVER () AS k
      FROM txn_ev GROUP BY label)"""
    ),
)
def q_class_weights(spark, sf_dir):
    """F12 class counts, shares and balanced weights."""
    txn, _ = views(spark, sf_dir)
    return M.class_weights(txn, "label")


_SCORED = "s AS (SELECT round(p.risk_score, 6) AS score, p.ml_probability, t.label FROM txn_ev t JOIN pred p ON p.transaction_id = t.transaction_id)"


def _scored(spark, sf_dir):
    txn, pred = views(spark, sf_dir)
    return txn.select("transaction_id", "label").join(
        pred.select("transaction_id", F.round("risk_score", 6).alias("score"), "ml_probability"), "transaction_id"
    )


@register(
    "classification_metrics",
    _with(
        """SELECT tp, fp, fn, test_positive_rate, n_rows,
  coalesce(CAST(tp AS DOUBLE) / nullif(CAST(tp + fp AS DOUBLE), 0), 0.0) AS precision,
  coalesce(CAST(tp AS DOUBLE) / nullif(CAST(tp + fn AS DOUBLE), 0), 0.0) AS recall,
  coalesce(2.0 * (coalesce(CAST(tp AS DOUBLE) / nullif(CAST(tp + fp AS DOUBLE), 0), 0.0))
               * (coalesce(CAST(tp AS DOUBLE) / nullif(CAST(tp + fn AS DOUBLE), 0), 0.0))
     / nullif(coalesce(CAST(tp AS DOUBLE) / nullif(CAST(tp + fp AS DOUBLE), 0), 0.0)
              + coalesce(CAST(tp AS DOUBLE) / nullif(CAST(tp + fn AS DOUBLE), 0), 0.0), 0), 0.0) AS f1_score
FROM (SELECT CAST(sum(CASE WHEN ml_probability >= 0.5 AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
             CAST(sum(CASE WHEN ml_probability >= 0.5 AND label <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
             CAST(sum(CASE WHEN ml_probability < 0.5 AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
             avg(CAST(label = 1 AS DOUBLE)) AS test_positive_rate, count(*) AS n_rows
      FROM s)""",
        _SCORED,
    ),
)
def q_classification_metrics(spark, sf_dir):
    """H8 + H9 precision, recall, F1 at 0.5 and positive rate."""
    return M.classification_metrics(_scored(spark, sf_dir), "ml_probability", "label")


@register(
    "roc_auc",
    _with(
        """SELECT round(CAST(sum(pos * (2 * (neg_cum - neg) + neg)) AS DOUBLE)
              / (2.0::DOUBLE * CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)), 6) AS roc_auc
FROM (SELECT *, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_cum
      FROM (SELECT score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
                   sum(CASE WHEN label <> 1 THEN 1 ELSE 0 END) AS neg FROM s GROUP BY score))""",
        _SCORED,
    ),
)
def q_roc_auc(spark, sf_dir):
    """H6 exact ROC AUC of the risk score against the label."""
    return M.roc_auc(_scored(spark, sf_dir), "score", "label").select(F.round("roc_auc", 6).alias("roc_auc"))


@register(
    "average_precision",
    _with(
        """SELECT round(sum(CAST(pos AS DOUBLE) * CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE)) / CAST(sum(pos) AS DOUBLE), 6)
       AS average_precision
FROM (SELECT *, sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
              sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp
      FROM (SELECT score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
                   sum(CASE WHEN label <> 1 THEN 1 ELSE 0 END) AS neg FROM s GROUP BY score))""",
        _SCORED,
    ),
)
def q_average_precision(spark, sf_dir):
    """H7 average precision (step sum) of the risk score."""
    ap = M.average_precision(_scored(spark, sf_dir), "score", "label")
    return ap.select(F.round("average_precision", 6).alias("average_precision"))


# ---------------------------------------------------------------------------
# Quality and constraints
# ---------------------------------------------------------------------------
@register("feature_frame", _with(f"SELECT transaction_id, {', '.join(MODEL_FEATURES)} FROM txn"))
def q_feature_frame(spark, sf_dir):
    """B1 projection to the model features."""
    txn, _ = views(spark, sf_dir)
    return Q.build_feature_frame(txn, key="transaction_id")


@register(
    "pk_violations",
    """SELECT l_orderkey, l_linenumber, count(*) AS occurrences FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
)
def q_pk_violations(spark, sf_dir):
    """B17 duplicate keys (composite key with duplicates in lineitem)."""
    li = read_table(spark, sf_dir, "lineitem")
    return Q.key_violations(li, ["l_orderkey", "l_linenumber"])


_NULL_COLS = TRANSACTION_COLUMNS + [c for c in PREDICTION_COLUMNS if c != "transaction_id"]


@register(
    "null_violations",
    _with(
        "SELECT " + ", ".join(f"CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS {c}_nulls" for c in _NULL_COLS)
        + " FROM mf",
        MF_SQL,
    ),
)
def q_null_violations(spark, sf_dir):
    """B18 NULL counts per column of the joined frame, one pass."""
    txn, pred = views(spark, sf_dir)
    return Q.null_counts(monitoring_frame(txn, pred), _NULL_COLS)


@register(
    "live_features",
    _with(
        """SELECT transaction_id, greatest(avg_amount_24h, 1.0) AS avg_amount_safe,
       Amount / greatest(avg_amount_24h, 1.0) AS amount_to_avg_ratio_live FROM txn"""
    ),
)
def q_live_features(spark, sf_dir):
    """K1 live feature row: floored 24h average and the live ratio (E9), batch form."""
    from txnwatch.streaming.live import live_features

    txn, _ = views(spark, sf_dir)
    return live_features(txn).select(
        "transaction_id",
        F.col("avg_amount_24h").alias("avg_amount_safe"),
        F.col("amount_to_avg_ratio").alias("amount_to_avg_ratio_live"),
    )


# ---------------------------------------------------------------------------
# Sources and sinks (A1, A4, A9) and the optional D3 pre-step
# ---------------------------------------------------------------------------
RAW_FILE_SCHEMA = "event_id bigint, Time double, Amount double, Class int"


@register("src_raw", _with("SELECT event_id, Time, Amount, Class FROM raw"))
def q_src_raw(spark, sf_dir):
    """A4 + A1 raw table written as CSV with a header, read back with a fixed schema."""
    import uuid

    from pyspark.sql import types as T

    from txnwatch.sources.tables import read_raw, write_raw

    raw = raw_from_events(read_table(spark, sf_dir, "events"))
    path = f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/raw-csv-{uuid.uuid4().hex}"
    write_raw(raw, path, "csv")
    return read_raw(spark, path, "csv", schema=T._parse_datatype_string(RAW_FILE_SCHEMA))


@register("top_alerts_sql", REGISTRY["top_alerts"].sql)
def q_top_alerts_sql(spark, sf_dir):
    """A9 top alerts as SQL text with bound parameters over temp views."""
    import uuid

    from txnwatch.plans.monitoring import recent_alerts_sql

    txn, pred = views(spark, sf_dir)
    tag = uuid.uuid4().hex[:12]
    tv, pv = f"txw_transactions_{tag}", f"txw_predictions_{tag}"
    txn.createOrReplaceTempView(tv)
    pred.createOrReplaceTempView(pv)
    return recent_alerts_sql(spark, tv, pv, limit=50).withColumn("risk_score", F.round("risk_score", 6))


@register(
    "latest_prediction",
    _with(
        """SELECT count(*) AS total_transactions,
       count(p.transaction_id) AS matched_predictions,
       round(avg(coalesce(p.risk_score, 0.0::DOUBLE)), 6) AS avg_risk_score,
       CAST(sum(CASE WHEN p.version = 1 THEN 1 ELSE 0 END) AS BIGINT) AS from_later_version
FROM txn t LEFT JOIN (
  SELECT transaction_id, arg_max(risk_score, version) AS risk_score, max(version) AS version
  FROM pred_v GROUP BY transaction_id
) p ON t.transaction_id = p.transaction_id""",
        """pred_v AS (
  SELECT transaction_id, risk_score, 0 AS version FROM pred
  UNION ALL
  SELECT transaction_id, risk_score / 2.0, 1 AS version FROM pred
  WHERE (CAST(substr(transaction_id, 4) AS BIGINT) - 1) % 11 = 0
)""",
    ),
)
def q_latest_prediction(spark, sf_dir):
    """D3 option: keep the latest of several predictions per transaction (max_by), then join."""
    from txnwatch.plans.monitoring import latest_prediction

    txn, pred = views(spark, sf_dir)
    event_id = F.substring("transaction_id", 4, 100).cast("bigint") - 1
    base = pred.select("transaction_id", "risk_score", F.lit(0).alias("version"))
    later = pred.where(event_id % 11 == 0).select(
        "transaction_id", (F.col("risk_score") / 2.0).alias("risk_score"), F.lit(1).alias("version")
    )
    versions = base.unionByName(later).withColumn("prediction_id", F.lit(0).cast("bigint"))
    latest = latest_prediction(versions, order_col="version")
    j = txn.select("transaction_id").join(latest, "transaction_id", "left")
    return j.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.count("version").alias("matched_predictions"),
        F.round(F.avg(F.coalesce("risk_score", F.lit(0.0))), 6).alias("avg_risk_score"),
        F.sum(F.when(F.col("version") == 1, 1).otherwise(0)).cast("bigint").alias("from_later_version"),
    )
