"""Hybrid risk scoring (R2-R6) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# ---------------------------------------------------------------------------
# Blend weights, anomaly slope, bump, band cut points, decisions.
# ---------------------------------------------------------------------------
ML_WEIGHT = 0.6
ANOMALY_WEIGHT = 0.2
RULE_WEIGHT = 0.2
ANOMALY_SLOPE = 3.0
BUMP_POINTS = 10.0
BUMP_BELOW = 55.0
HIGH_FROM = 75.0
MEDIUM_FROM = 45.0
DECISIONS = {"high": "block", "medium": "review"}
DEFAULT_DECISION = "approve"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def reaches(x: Column | str, bound: float) -> Column:
    """``x >= bound`` as numbers compare: false for NaN, NULL for NULL. The first part reaches a scan."""
    x = _c(x)
    return (x >= F.lit(bound)) & ~F.isnan(x.cast("double"))


def anomaly_to_risk(anomaly_score: Column | str) -> Column:
    """R2: logistic with slope 3; a lower (more anomalous) score means more risk."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(ANOMALY_SLOPE) * _c(anomaly_score)))


def combine_risk_components(ml_probability: Column | str, anomaly_risk: Column | str,
                            rule_score: Column | str) -> Column:
    """clip(60·ml + 20·anomaly_risk + 0.2·rule, 0, 100); NULL when an input is NULL.

    A NaN input gives NaN: Spark orders NaN above every number, so ``least`` would
    turn it into 100; the larger of the negatives keeps it. The blend appears once in
    the expression, so a filter that Catalyst rewrites through it stays small.
    """
    ml, ar, rule = _c(ml_probability), _c(anomaly_risk), _c(rule_score)
    combined = ml * F.lit(100.0) * F.lit(ML_WEIGHT) + ar * F.lit(100.0) * F.lit(ANOMALY_WEIGHT) + rule * F.lit(RULE_WEIGHT)
    capped = -F.greatest(F.lit(-100.0), -combined)
    return F.when(ml.isNull() | ar.isNull() | rule.isNull(), F.lit(None).cast("double")).otherwise(
        F.greatest(F.lit(0.0), capped)
    )


def bumped_risk(risk: Column | str, anomaly_flag: Column | str) -> Column:
    """+10 when flagged and below 55.

    A bumped score is below 65 and any other score keeps its value in
    [0, 100], so the clip that follows the bump never binds and is omitted
    (NaN stays NaN, as with a clip).
    """
    r = _c(risk)
    return r + F.when((_c(anomaly_flag) == 1) & (r < F.lit(BUMP_BELOW)), F.lit(BUMP_POINTS)).otherwise(F.lit(0.0))


def risk_band(score: Column | str) -> Column:
    """>=75 high, >=45 medium, else low; NaN and NULL are low."""
    s = -_c(score)  # a NaN is above every number also with its sign turned, so it reaches no cut
    return F.when(s <= -HIGH_FROM, F.lit("high")).when(s <= -MEDIUM_FROM, F.lit("medium")).otherwise(F.lit("low"))


def decision_from_band(band: Column | str) -> Column:
    """High -> block, medium -> review, anything else -> approve."""
    b = _c(band)
    expr = None
    for name, decision in DECISIONS.items():
        expr = F.when(b == name, F.lit(decision)) if expr is None else expr.when(b == name, F.lit(decision))
    return expr.otherwise(F.lit(DEFAULT_DECISION))


def risk_columns(ml_probability: Column | str, anomaly_score: Column | str, anomaly_flag: Column | str,
                 rule_score: Column | str) -> dict[str, Column]:
    """R2-R6 as three expressions (for a single select). Prefer
    ``add_risk_columns``, which stages them so no expression is repeated."""
    combined = combine_risk_components(ml_probability, anomaly_to_risk(anomaly_score), rule_score)
    score = bumped_risk(combined, anomaly_flag)
    band = risk_band(score)
    return {"risk_score": score, "risk_band": band, "decision": decision_from_band(band)}


def add_risk_columns(df, ml_probability: str = "ml_probability", anomaly_score: str = "anomaly_score",
                     anomaly_flag: str = "anomaly_flag", rule_score: str = "rule_score"):
    """R2-R6 on a DataFrame: blend, bump, band, decision, each step reading the
    previous step's column, so the generated code stays small (no repeated
    sub-expressions) and inside whole-stage codegen."""
    staged = df.withColumn(
        "_combined", combine_risk_components(ml_probability, anomaly_to_risk(anomaly_score), rule_score)
    )
    staged = staged.withColumn("risk_score", bumped_risk("_combined", anomaly_flag)).drop("_combined")
    staged = staged.withColumn("risk_band", risk_band("risk_score"))
    return staged.withColumn("decision", decision_from_band("risk_band"))


def risk_sql_duckdb(ml: str, anomaly: str, flag: str, rule: str) -> tuple[str, str, str]:
    """The same chain as DuckDB SQL text, for the oracle; its numbers are written out, so a wrong constant above shows."""
    blend = f"least(100.0, greatest(0.0, 60.0 * {ml} + 20.0 / (1.0 + exp(3.0 * {anomaly})) + 0.2 * {rule}))"
    score = f"(CASE WHEN {flag} = 1 AND {blend} < 55.0 THEN {blend} + 10.0 ELSE {blend} END)"
    band = "(CASE WHEN risk_score < 45.0 THEN 'low' WHEN risk_score < 75.0 THEN 'medium' ELSE 'high' END)"
    decision = "(CASE risk_band WHEN 'low' THEN 'approve' WHEN 'medium' THEN 'review' WHEN 'high' THEN 'block' END)"
    return score, band, decision
