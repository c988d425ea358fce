"""Keyed pseudo-random draws.

A draw is a pure function of ``(salt, key)``: the first 32 bits of
``md5(salt || ':' || key)`` scaled to [0, 1). It does not depend on
partitioning, task retries or row order, so a lost executor recomputes the
same values, and DuckDB computes the same doubles for the oracle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def keyed_uniform(salt: str, key: Column | str) -> Column:
    """Uniform draw in [0, 1) keyed by ``key``."""
    key_col = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(F.lit(f"{salt}:"), key_col.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(TWO_POW_32)


def keyed_bernoulli(salt: str, key: Column | str, p: Column | float) -> Column:
    """1 with probability ``p`` else 0 (E14 outcome)."""
    p_col = p if isinstance(p, Column) else F.lit(float(p))
    return F.when(keyed_uniform(salt, key) < p_col, F.lit(1)).otherwise(F.lit(0))


def keyed_integer(salt: str, key: Column | str, low: int, high: int) -> Column:
    """Integer in [low, high) (E14 account assignment)."""
    return (F.lit(low) + F.floor(keyed_uniform(salt, key) * F.lit(high - low))).cast("bigint")


def weighted_choice(salt: str, key: Column | str, values: Sequence[str], weights: Sequence[float]) -> Column:
    """Pick ``values[i]`` with probability ``weights[i]`` (E13), by cumulative cut points."""
    if len(values) != len(weights) or not values:
        raise ValueError("values and weights must be non-empty and of equal length")
    total = float(sum(weights))
    u = keyed_uniform(salt, key)
    expr = None
    cumulative = 0.0
    for value, weight in zip(values[:-1], weights[:-1]):
        cumulative += weight / total
        cond = u < F.lit(cumulative)
        expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    last = F.lit(values[-1])
    return last if expr is None else expr.otherwise(last)


def keyed_hex_id(prefix: str, salt: str, key: Column | str, length: int = 10) -> Column:
    """Deterministic id ``prefix`` + upper hex (E20); idempotent under replays."""
    key_col = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(F.lit(f"{salt}:"), key_col.cast("string")))
    return F.concat(F.lit(prefix), F.upper(F.substring(digest, 1, length)))
