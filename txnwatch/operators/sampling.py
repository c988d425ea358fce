"""Class-aware sampling and splitting.

Draws are keyed (see ``functions.draws``), so results do not depend on
partitioning or retries. Exact takes never rank a whole class in one task:
a threshold on the draw keeps a small superset, then only the survivors get
exact ranks via distributed prefix sums.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnwatch.functions.draws import keyed_uniform
from txnwatch.operators.prefix import row_numbers
from txnwatch.operators.quality import require_positive
from txnwatch.schema import RANDOM_SEED, TEST_SIZE


def take_smallest(df: DataFrame, m: int, draw: Column, key: str, total: int | None = None) -> DataFrame:
    """The ``m`` rows with the smallest ``(draw, key)``, exactly.

    Keeps rows with ``draw < p`` for a slack threshold ``p`` (widened until at
    least ``m`` survive), then ranks the survivors.
    """
    if m <= 0:
        return df.where(F.lit(False))
    n = total if total is not None else df.count()
    if m >= n:
        return df
    with_draw = df.withColumn("_u", draw)
    p = min(1.0, (m + 6.0 * math.sqrt(m) + 10.0) / n)
    while True:
        survivors = with_draw.where(F.col("_u") < F.lit(p)) if p < 1.0 else with_draw
        if p >= 1.0 or survivors.count() >= m:
            break
        p = min(1.0, p * 2.0)
    ranked = row_numbers(survivors, [F.col("_u"), F.col(key)], "_rk")
    return ranked.where(F.col("_rk") <= m).drop("_u", "_rk")


def stratified_sample(df: DataFrame, sample_size: int, label: str = "Class", key: str = "event_id",
                      seed: int = RANDOM_SEED, least_other: int = 0) -> DataFrame:
    """Keep every fraud row, fill up with non-fraud rows to ``sample_size``.

    Returns everything when ``sample_size`` reaches the row count; may return
    more than asked when fraud rows alone exceed it. A row whose label is not 1
    (NULL included) is non-fraud. However many fraud rows there are, ``least_other``
    non-fraud rows (or all, if fewer) come with them: a fit needs both classes.
    """
    require_positive(sample_size, "sample_size")
    is_fraud = F.col(label).eqNullSafe(1)
    n, n_fraud = df.agg(F.count(F.lit(1)), F.count(F.when(is_fraud, 1))).first()
    if sample_size >= n:
        return df
    n_non = n - n_fraud
    target = min(max(sample_size - n_fraud, least_other, 0), n_non)
    fraud = df.where(is_fraud)
    non = take_smallest(df.where(~is_fraud), target, keyed_uniform(f"sample{seed}", key), key, n_non)
    return fraud.unionByName(non)


def shuffled_order(key: str, seed: int = RANDOM_SEED) -> list[Column]:
    """A keyed random order (use with ``orderBy`` or ``row_numbers``)."""
    return [keyed_uniform(f"shuffle{seed}", key), F.col(key)]


def split_allocation(class_counts: dict, test_size: float = TEST_SIZE) -> dict:
    """Test rows per class: ``ceil(test_size * n)`` in all, split in proportion,
    leftovers to the largest remainders (ties to the smaller label)."""
    if len(class_counts) < 2:
        raise ValueError("stratified split needs at least two classes")
    if min(class_counts.values()) < 2:
        raise ValueError("every class needs at least two rows for a stratified split")
    n = sum(class_counts.values())
    n_test = math.ceil(test_size * n)
    base = {c: (k * n_test) // n for c, k in class_counts.items()}
    rem = {c: (k * n_test) % n for c, k in class_counts.items()}
    left = n_test - sum(base.values())
    for c in sorted(class_counts, key=lambda c: (-rem[c], c))[:left]:
        base[c] += 1
    return base


@dataclass
class Split:
    train: DataFrame
    test: DataFrame
    allocation: dict


def stratified_split(df: DataFrame, label: str, key: str, test_size: float = TEST_SIZE,
                     seed: int = RANDOM_SEED) -> Split:
    """C3 + C4: exact per-class test sizes; test rows are each class's smallest draws.

    One numbering of the rows over ``(label, draw, key)`` gives every row its rank
    within its class (global rank minus the rows of smaller labels).
    """
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    if None in counts:
        raise ValueError("labels must not be NULL")
    alloc = split_allocation(counts, test_size)
    start, acc = {}, 0
    for c in sorted(counts):
        start[c] = acc
        acc += counts[c]
    start_expr = None
    quota_expr = None
    for c in sorted(counts):
        cond = F.col(label) == F.lit(c)
        start_expr = F.when(cond, F.lit(start[c])) if start_expr is None else start_expr.when(cond, F.lit(start[c]))
        quota_expr = F.when(cond, F.lit(alloc[c])) if quota_expr is None else quota_expr.when(cond, F.lit(alloc[c]))
    ranked = row_numbers(df, [F.col(label), keyed_uniform(f"split{seed}", key), F.col(key)], "_rk")
    tagged = ranked.withColumn("_is_test", (F.col("_rk") - start_expr) <= quota_expr).drop("_rk")
    return Split(
        train=tagged.where(~F.col("_is_test")).drop("_is_test"),
        test=tagged.where(F.col("_is_test")).drop("_is_test"),
        allocation=alloc,
    )
