"""Classifier metrics as distributed aggregates.

Scores are first reduced to one row per distinct score (a partial
aggregate); the running counts over scores are distributed prefix sums, so
no metric sorts all rows in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.operators.prefix import prefix_sums

EXACT = "decimal(38,0)"


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """rows per class, share, and balanced weight ``n / (k * n_c)``."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"))
    totals = counts.agg(F.sum("n_rows").alias("n"), F.count(F.lit(1)).alias("k")).first()
    n, k = int(totals["n"] or 0), int(totals["k"] or 0)
    return counts.select(
        label,
        "n_rows",
        (F.col("n_rows") / F.lit(float(max(n, 1)))).alias("share"),
        (F.lit(float(n)) / (F.lit(float(k)) * F.col("n_rows"))).alias("balanced_weight"),
    )


def _score_groups(df: DataFrame, score: str, label: str) -> DataFrame:
    return (
        df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(score)
        .agg(
            F.sum((F.col(label) == 1).cast("bigint")).alias("_pos"),
            F.sum((F.col(label) != 1).cast("bigint")).alias("_neg"),
        )
    )


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """H6: exact ROC AUC (ties count one half); NaN with one class only.

    ``AUC = sum_s pos_s * (2 * neg_below_s + neg_s) / (2 * P * N)`` over distinct
    scores ``s``, in exact decimal before the final division.
    """
    g = prefix_sums(_score_groups(df, score, label), [F.col(score)], {"_neg_cum": F.col("_neg")})
    term = F.col("_pos").cast(EXACT) * (F.lit(2).cast(EXACT) * (F.col("_neg_cum") - F.col("_neg")) + F.col("_neg"))
    agg = g.agg(F.sum(term).alias("_num"), F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"))
    return agg.select(
        F.when(
            (F.coalesce(F.col("_p"), F.lit(0)) > 0) & (F.coalesce(F.col("_n"), F.lit(0)) > 0),
            F.col("_num").cast("double") / (F.lit(2.0) * F.col("_p").cast("double") * F.col("_n").cast("double")),
        )
        .otherwise(F.lit(float("nan")))
        .alias("roc_auc")
    )


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """H7: average precision ``sum_k (R_k - R_{k-1}) * P_k`` over distinct
    thresholds, highest score first (a step sum, not a trapezoid)."""
    g = prefix_sums(
        _score_groups(df, score, label), [F.col(score).desc()], {"_tp": F.col("_pos"), "_fp": F.col("_neg")}
    )
    precision_k = F.col("_tp").cast("double") / (F.col("_tp") + F.col("_fp")).cast("double")
    agg = g.agg(F.sum(F.col("_pos").cast("double") * precision_k).alias("_num"), F.sum("_pos").alias("_p"))
    return agg.select(
        F.when(F.coalesce(F.col("_p"), F.lit(0)) > 0, F.col("_num") / F.col("_p").cast("double"))
        .otherwise(F.lit(float("nan")))
        .alias("average_precision")
    )


def classification_metrics(df: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """H8 + H9: precision, recall, F1 at ``score >= threshold`` (0 on zero
    division) and the positive rate, in one aggregate."""
    pred = F.col(score) >= F.lit(threshold)
    pos = F.col(label) == 1
    c = df.where(F.col(label).isNotNull()).agg(
        F.sum((pred & pos).cast("bigint")).alias("tp"),
        F.sum((pred & ~pos).cast("bigint")).alias("fp"),
        F.sum((~pred & pos).cast("bigint")).alias("fn"),
        F.avg(pos.cast("double")).alias("test_positive_rate"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    precision = F.coalesce(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double")), F.lit(0.0))
    with_pr = c.withColumns({"precision": precision, "recall": recall})
    f1 = F.coalesce(
        F.try_divide(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
        F.lit(0.0),
    )
    return with_pr.withColumn("f1_score", f1)
