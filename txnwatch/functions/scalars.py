"""Scalar column functions (E1-E22 in the survey).

All are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from txnwatch.schema import BASE_TIMESTAMP, RISK_BAND_ORDER, UNKNOWN_BAND_RANK


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def micros_ntz(ts: Column | str) -> Column:
    """Microseconds since the epoch of a TIMESTAMP_NTZ (or TIMESTAMP) column.

    Computed on the wall-clock value, so the session time zone (and DST) never
    shifts window bounds.
    """
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, _c(ts).cast("timestamp_ntz"))


def offset_timestamp(seconds: Column | str, base: str = BASE_TIMESTAMP) -> Column:
    """Base date + an offset in seconds -> TIMESTAMP_NTZ (microsecond precision)."""
    base_us = F.lit(base).cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", F.round(_c(seconds).cast("double") * 1_000_000).cast("bigint"), base_us)


def hour_of(ts: Column | str) -> Column:
    """E2."""
    return F.hour(_c(ts)).cast("int")


def padded_id(prefix: str, n: Column | str, width: int = 8) -> Column:
    """``TXN00000001``."""
    return F.format_string(f"{prefix}%0{width}d", _c(n).cast("bigint"))


def day_text(ts: Column | str) -> Column:
    """``%Y-%m-%d`` text."""
    return F.date_format(_c(ts), "yyyy-MM-dd")


def to_day(ts: Column | str) -> Column:
    """E5: timestamp -> date."""
    return F.to_date(_c(ts))


def parse_timestamp(text: Column | str) -> Column:
    """Tolerant parse; bad text -> NULL. Zone suffixes are moved to UTC."""
    return F.try_to_timestamp(_c(text))


def ratio_with_epsilon(amount: Column | str, avg: Column | str) -> Column:
    """Batch ratio ``Amount / (avg + 1e-6)``."""
    return _c(amount) / (_c(avg) + F.lit(1e-6))


def ratio_with_floor(amount: Column | str, avg: Column | str) -> Column:
    """Live ratio ``amount / max(avg, 1)``; not the same as E8."""
    return _c(amount) / F.greatest(_c(avg), F.lit(1.0))


def clip(x: Column, lo: float, hi: float | None) -> Column:
    """Clip; NULL stays NULL (Spark's greatest/least skip NULLs) and NaN stays NaN (Spark orders it last)."""
    capped = x if hi is None else -F.greatest(F.lit(-hi), -x)
    return F.when(x.isNull(), F.lit(None)).otherwise(F.greatest(F.lit(lo), capped))


def friction_penalty(velocity: Column | str, amount: Column | str, channel: Column | str) -> Column:
    """Weighted boolean flags (case-exact channel, strict amount bound)."""
    # With signs turned, a NaN reaches no bound.
    return (
        (-_c(velocity) <= -4).cast("double") * F.lit(0.08)
        + (-_c(amount) < -1000).cast("double") * F.lit(0.05)
        + (_c(channel) == "atm").cast("double") * F.lit(0.03)
    )


def success_probability(label: Column | str, velocity: Column | str, amount: Column | str,
                        channel: Column | str) -> Column:
    """Base 0.55 (fraud) / 0.985, minus friction, clipped to [0.05, 0.995]."""
    base = F.when(_c(label) == 1, F.lit(0.55)).otherwise(F.lit(0.985))
    return clip(base - friction_penalty(velocity, amount, channel), 0.05, 0.995)


def band_rank(band: Column | str) -> Column:
    """Low 0, medium 1, high 2, anything else (incl. NULL) 99."""
    expr = None
    for name, rank in RISK_BAND_ORDER.items():
        cond = _c(band) == name
        expr = F.when(cond, F.lit(rank)) if expr is None else expr.when(cond, F.lit(rank))
    return expr.otherwise(F.lit(UNKNOWN_BAND_RANK))


def outcome_flag(decision: Column | str) -> Column:
    """1 unless the decision is ``block``."""
    return F.when(_c(decision) != "block", F.lit(1)).otherwise(F.lit(0))
