"""Rule engine (R1) compiled to two column expressions.

The rule table is data: a list of groups, each group a list of exclusive
branches (first match wins). ``rule_score`` sums the points of the matching
branch of every group; ``rule_reasons`` collects their texts in table order.
Both are plain ``CASE WHEN`` expressions, so scoring a row costs no Python.

Input handling: a NULL input takes the documented default (amount 0, hour 0,
velocity 1, ratio 1, channel ""); a NaN input never fires a rule (Spark
orders NaN above every number, so it is guarded explicitly).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from txnwatch.schema import NO_RULE_REASON, REASON_SEPARATOR

# ---------------------------------------------------------------------------
# Rule table (thresholds, points, reason texts) and defaults.
# ---------------------------------------------------------------------------
RULE_INPUT_DEFAULTS = {
    "Amount": 0.0,
    "hour": 0,
    "velocity_1h": 1.0,
    "amount_to_avg_ratio": 1.0,
    "channel": "",
}

RULE_TABLE = [
    # (input, comparison, threshold, points, reason); groups are exclusive branches
    [
        ("Amount", ">=", 2000, 30, "Very high transaction amount"),
        ("Amount", ">=", 1000, 20, "High transaction amount"),
    ],
    [
        ("amount_to_avg_ratio", ">=", 4, 25, "Amount is far above account baseline"),
        ("amount_to_avg_ratio", ">=", 2, 15, "Amount above normal account baseline"),
    ],
    [
        ("velocity_1h", ">=", 6, 20, "High velocity in one-hour window"),
        ("velocity_1h", ">=", 4, 12, "Elevated velocity in one-hour window"),
    ],
    [
        ("hour", "<=", 5, 10, "Transaction during high-risk hours"),
    ],
    [
        ("atm_large", "==", True, 8, "Large ATM withdrawal pattern"),
    ],
]
ATM_CHANNEL = "atm"
ATM_AMOUNT_OVER = 500
RULE_SCORE_CAP = 100.0


@dataclass(frozen=True)
class RuleColumns:
    score: Column
    reasons: Column  # array<string>, table order
    reasons_text: Column  # joined with "; ", or the default text


def _numeric_input(name: str) -> Column:
    col = F.col(name).cast("double")
    return F.coalesce(col, F.lit(float(RULE_INPUT_DEFAULTS[name])))


def _inputs() -> dict[str, Column]:
    amount = _numeric_input("Amount")
    channel = F.lower(F.coalesce(F.col("channel").cast("string"), F.lit(RULE_INPUT_DEFAULTS["channel"])))
    return {
        "Amount": amount,
        "amount_to_avg_ratio": _numeric_input("amount_to_avg_ratio"),
        "velocity_1h": _numeric_input("velocity_1h"),
        # the reference converts hour with int(): truncate toward zero
        "hour": F.coalesce(F.col("hour").cast("double"), F.lit(0.0)),
        "atm_large": (channel == ATM_CHANNEL) & ~F.isnan(amount) & (amount > ATM_AMOUNT_OVER),
    }


def _condition(inputs: dict[str, Column], name: str, op: str, threshold) -> Column:
    x = inputs[name]
    if op == "==":
        return x == F.lit(threshold)
    if name == "hour":
        x = x - (x % F.lit(1.0))  # int() truncation toward zero; NaN stays NaN
    cmp = x >= F.lit(threshold) if op == ">=" else x <= F.lit(threshold)
    return ~F.isnan(x) & cmp


def rule_columns() -> RuleColumns:
    """Compile the rule table to ``score`` and ``reasons`` columns."""
    inputs = _inputs()
    score_terms: list[Column] = []
    reason_terms: list[Column] = []
    for group in RULE_TABLE:
        points_expr = None
        reason_expr = None
        for name, op, threshold, points, reason in group:
            cond = _condition(inputs, name, op, threshold)
            if points_expr is None:
                points_expr = F.when(cond, F.lit(float(points)))
                reason_expr = F.when(cond, F.lit(reason))
            else:
                points_expr = points_expr.when(cond, F.lit(float(points)))
                reason_expr = reason_expr.when(cond, F.lit(reason))
        score_terms.append(points_expr.otherwise(F.lit(0.0)))
        reason_terms.append(reason_expr)
    total = score_terms[0]
    for term in score_terms[1:]:
        total = total + term
    score = F.least(total, F.lit(RULE_SCORE_CAP))
    reasons = F.array_compact(F.array(*reason_terms))
    # concat_ws skips NULL arguments, so the text needs no array at all
    joined = F.concat_ws(REASON_SEPARATOR, *reason_terms)
    text = F.when(joined == "", F.lit(NO_RULE_REASON)).otherwise(joined)
    return RuleColumns(score=score, reasons=reasons, reasons_text=text)


def rule_sql_duckdb() -> tuple[str, str]:
    """The rule table as DuckDB SQL (score, reasons) over an unqualified row, for the oracle.

    Its numbers and texts are written out, so a wrong entry above shows; inputs
    in the fixtures are never NULL or NaN.
    """
    score = """least(100.0, 0.0::DOUBLE
        + CASE WHEN Amount >= 2000 THEN 30 WHEN Amount >= 1000 THEN 20 ELSE 0 END
        + CASE WHEN amount_to_avg_ratio >= 4 THEN 25 WHEN amount_to_avg_ratio >= 2 THEN 15 ELSE 0 END
        + CASE WHEN velocity_1h >= 6 THEN 20 WHEN velocity_1h >= 4 THEN 12 ELSE 0 END
        + CASE WHEN hour <= 5 THEN 10 ELSE 0 END
        + CASE WHEN lower(channel) = 'atm' AND Amount > 500 THEN 8 ELSE 0 END)"""
    reasons = """ifnull(nullif(concat_ws('; ',
        CASE WHEN Amount >= 2000 THEN 'Very high transaction amount'
             WHEN Amount >= 1000 THEN 'High transaction amount' END,
        CASE WHEN amount_to_avg_ratio >= 4 THEN 'Amount is far above account baseline'
             WHEN amount_to_avg_ratio >= 2 THEN 'Amount above normal account baseline' END,
        CASE WHEN velocity_1h >= 6 THEN 'High velocity in one-hour window'
             WHEN velocity_1h >= 4 THEN 'Elevated velocity in one-hour window' END,
        CASE WHEN hour <= 5 THEN 'Transaction during high-risk hours' END,
        CASE WHEN lower(channel) = 'atm' AND Amount > 500 THEN 'Large ATM withdrawal pattern' END), ''),
        'No high-risk rule triggered')"""
    return score, reasons
