"""Training and batch scoring job.

``run_training`` is one batch job over every raw row: enrich -> sample and split
-> fit -> score -> store both tables -> export -> summary. The sample size
bounds the rows that the models are fitted on and nothing else. Paths come from
the caller; lineage is cut with ``checkpoint`` (shared checkpoint folder)
where a frame feeds several later steps.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnwatch.functions.draws import keyed_bernoulli, keyed_integer, weighted_choice
from txnwatch.functions.rules import rule_columns
from txnwatch.functions.scalars import day_text, hour_of, offset_timestamp, padded_id, ratio_with_epsilon, success_probability
from txnwatch.functions.scoring import add_risk_columns
from txnwatch.operators import metrics as M
from txnwatch.operators.features import fit_encoder
from txnwatch.operators.iforest import Forest, fit_isolation_forest, score_forest
from txnwatch.operators.logistic import LogisticModel, fit_logistic
from txnwatch.operators.prefix import row_numbers
from txnwatch.operators.quality import build_feature_frame
from txnwatch.operators.rolling import HOT_ROWS, add_account_rollups
from txnwatch.operators.sampling import shuffled_order, stratified_sample, stratified_split
from txnwatch.schema import (
    CATEGORICAL_FEATURES,
    CHANNEL_WEIGHTS,
    CHANNELS,
    DEFAULT_SAMPLE_SIZE,
    MERCHANT_CATEGORIES,
    MERCHANT_WEIGHTS,
    MODEL_FEATURES,
    NUMERIC_FEATURES,
    PREDICTION_COLUMNS,
    RANDOM_SEED,
    RAW_SCHEMA,
)
from txnwatch.session import ensure_checkpoint_dir
from txnwatch.sources import store


@dataclass
class ModelBundle:
    classifier: LogisticModel
    forest: Forest
    metrics: dict


def enrich_transactions(raw: DataFrame, key: str = "event_id", seed: int = RANDOM_SEED) -> DataFrame:
    """Raw rows (Time, Amount, Class, key) -> the transactions table.

    Ids follow a keyed order of the rows (W4 over C2). Account, channel, category
    and outcome are those of the raw table where it has them; a raw table
    without them gets keyed draws (E13, E14). Then the per-account
    rolling features (W1, W2), hour, day, ratio (E8) and success (E12). Raw
    columns that no step uses are left behind.
    """
    given = {c for c in ("account_id", "channel", "merchant_category", "is_success") if c in raw.columns}
    slim = raw.select(key, "Time", "Amount", "Class", *sorted(given))
    with_ts = slim.withColumn("transaction_timestamp", offset_timestamp("Time"))
    numbered = row_numbers(with_ts, shuffled_order(key, seed), "_n")
    drawn = {
        "account_id": keyed_integer(f"account{seed}", key, 100_000, 999_999),
        "channel": weighted_choice(f"channel{seed}", key, CHANNELS, CHANNEL_WEIGHTS),
        "merchant_category": weighted_choice(f"category{seed}", key, MERCHANT_CATEGORIES, MERCHANT_WEIGHTS),
    }
    base = numbered.withColumns(
        {"transaction_id": padded_id("TXN", "_n")} | {c: v for c, v in drawn.items() if c not in given}
    ).drop("_n", "Time")
    rolled = add_account_rollups(base, hot_rows=HOT_ROWS)
    out = rolled.withColumns(
        {
            "hour": hour_of("transaction_timestamp"),
            "day": day_text("transaction_timestamp"),
            "amount_to_avg_ratio": ratio_with_epsilon("Amount", "avg_amount_24h"),
            "is_fraud": F.col("Class").cast("int"),
        }
    )
    if "is_success" in given:
        return out
    return out.withColumn(
        "is_success",
        keyed_bernoulli(f"success{seed}", key, success_probability("Class", "velocity_1h", "Amount", "channel")),
    )


def train_models(train: DataFrame, test: DataFrame, label: str = "is_fraud", key: str = "transaction_id",
                 exact: bool = True, seed: int = RANDOM_SEED) -> ModelBundle:
    """M8: classifier on all training rows, forest on the non-fraud ones, metrics on the test rows."""
    encoder = fit_encoder(train)
    clf = fit_logistic(train, label, encoder, exact=exact)
    scored = test.select(key, label, clf.probability().alias("ml_probability"))
    metrics = _metrics(scored, label)
    forest = fit_isolation_forest(normal_rows(train, label).select(key, *NUMERIC_FEATURES), NUMERIC_FEATURES, key, seed=seed)
    return ModelBundle(clf, forest, metrics)


def normal_rows(train: DataFrame, label: str) -> DataFrame:
    """The rows that the forest learns from, those of label 0; all rows where there is none."""
    normal = train.where(F.col(label) == 0)
    return train if normal.isEmpty() else normal


def _metrics(scored: DataFrame, label: str) -> dict:
    """H6-H10 on the test rows; a failing ranking metric is NaN."""
    cm = M.classification_metrics(scored, "ml_probability", label).first()
    auc = M.roc_auc(scored, "ml_probability", label).first()[0]
    ap = M.average_precision(scored, "ml_probability", label).first()[0]
    return {
        "roc_auc": float(auc) if auc is not None else math.nan,
        "pr_auc": float(ap) if ap is not None else math.nan,
        "precision": float(cm["precision"]),
        "recall": float(cm["recall"]),
        "f1_score": float(cm["f1_score"]),
        "test_positive_rate": float(cm["test_positive_rate"] or 0.0),
    }


def score_transactions(df: DataFrame, bundle: ModelBundle, key: str = "transaction_id") -> DataFrame:
    """Rules + classifier + forest -> the 8 prediction columns, keyed.

    The forest is the only Python step (Arrow batches); everything else is
    column expressions.
    """
    features = build_feature_frame(df, key=key)
    with_anomaly = score_forest(features, bundle.forest)
    rc = rule_columns()
    scored = with_anomaly.withColumns(
        {
            "ml_probability": bundle.classifier.probability(),
            "rule_score": rc.score,
            "rule_reasons": rc.reasons_text,
        }
    )
    return add_risk_columns(scored).select(*PREDICTION_COLUMNS)


def run_summary(transactions: DataFrame, predictions: DataFrame, sample_size: int, metrics: dict) -> dict:
    """one aggregate per table over all stored rows, plus the metrics."""
    t = transactions.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("is_fraud").alias("fraud"),
        F.avg(F.col("is_success").cast("double")).alias("ok"),
    ).first()
    p = predictions.agg(F.avg("risk_score").alias("risk")).first()
    summary = {
        "sample_size": int(sample_size),
        "rows_processed": int(t["rows"]),
        "fraud_rows": int(t["fraud"] or 0),
        "success_rate_pct": float((t["ok"] or 0.0) * 100.0),
        "avg_risk_score": float(p["risk"] or 0.0),
    }
    summary.update({f"metric_{k}": float(v) for k, v in metrics.items()})
    return summary


def save_models(spark: SparkSession, bundle: ModelBundle, root: str) -> None:
    """Models as JSON text (coefficients, encoder, forest nodes)."""
    rows = [("classifier", bundle.classifier.to_json()), ("forest", bundle.forest.to_json())]
    spark.createDataFrame(rows, "name string, model string").coalesce(1).write.mode("overwrite").parquet(
        f"{root.rstrip('/')}/models"
    )
    store.write_json_summary(spark, bundle.metrics, f"{root.rstrip('/')}/metrics")
    lists = {"numeric_features": NUMERIC_FEATURES, "categorical_features": CATEGORICAL_FEATURES, "features": MODEL_FEATURES}
    store.write_json_summary(spark, lists, f"{root.rstrip('/')}/model_metadata")


def load_metadata(spark: SparkSession, root: str) -> dict:
    """The feature lists the models were trained on."""
    return store.read_json_summary(spark, f"{root.rstrip('/')}/model_metadata")


def load_models(spark: SparkSession, root: str) -> ModelBundle:
    rows = {r["name"]: r["model"] for r in spark.read.parquet(f"{root.rstrip('/')}/models").collect()}
    metrics = store.read_json_summary(spark, f"{root.rstrip('/')}/metrics")
    return ModelBundle(LogisticModel.from_json(rows["classifier"]), Forest.from_json(rows["forest"]), metrics)


def run_training(spark: SparkSession, raw: DataFrame, root: str, sample_size: int = DEFAULT_SAMPLE_SIZE,
                 key: str = "event_id", exact: bool = True, seed: int = RANDOM_SEED) -> dict:
    """M9: the whole batch job; returns the run summary and writes everything under ``root``."""
    ensure_checkpoint_dir(spark)
    txn = enrich_transactions(raw, key=key, seed=seed).checkpoint(eager=True)
    # All fraud rows of a large table may outnumber the sample; the fits still see normal rows, half the sample size.
    sampled = stratified_sample(txn, sample_size, label="is_fraud", key=key, seed=seed, least_other=-(-sample_size // 2))
    split = stratified_split(sampled.where(F.col("is_fraud").isNotNull()), "is_fraud", "transaction_id", seed=seed)
    bundle = train_models(split.train, split.test, exact=exact, seed=seed)
    save_models(spark, bundle, root)
    preds = score_transactions(txn, bundle).checkpoint(eager=True)
    store.write_monitoring_data(txn, preds, root)
    processed = txn.select("transaction_id", "transaction_timestamp", "Amount", "is_fraud", "is_success").join(
        preds, "transaction_id"
    )
    processed.write.mode("overwrite").option("header", True).csv(f"{root.rstrip('/')}/processed_transactions")
    summary = run_summary(txn, preds, sample_size, bundle.metrics)
    store.write_json_summary(spark, summary, f"{root.rstrip('/')}/run_summary")
    return summary


def raw_file_schema(spark: SparkSession, path: str) -> T.StructType:
    """Types of a raw CSV by its header line: known columns as in ``RAW_SCHEMA``, ids and labels as whole numbers, others text."""
    known = {f.name: f.dataType for f in RAW_SCHEMA.fields} | {"event_id": T.LongType(), "account_id": T.LongType(), "is_success": T.IntegerType()}
    header = spark.read.option("header", True).csv(path).columns
    return T.StructType([T.StructField(c, known.get(c, T.StringType())) for c in header])


def main(argv: list[str] | None = None) -> dict:
    """``spark-submit txnwatch/plans/training.py --raw PATH --out ROOT``.

    ``--raw`` is a raw transactions file (CSV with a header, or Parquet) with
    ``Time, Amount, Class`` and a key column; ``--events`` reads the provided
    events table instead (the fixture source).
    """
    import argparse
    import json

    from pyspark.sql import SparkSession

    from txnwatch.session import ship_package
    from txnwatch.sources.fixtures import raw_from_events
    from txnwatch.sources.tables import read_raw, read_table, require_columns

    ap = argparse.ArgumentParser(description="Train, score and store (batch job).")
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--raw", help="raw transactions file")
    src.add_argument("--events", help="folder with events.parquet")
    ap.add_argument("--format", default="csv", choices=["csv", "parquet"])
    ap.add_argument("--key", default="event_id", help="unique row key of the raw file")
    ap.add_argument("--out", required=True, help="output root (store, models, summary)")
    ap.add_argument("--sample-size", type=int, default=DEFAULT_SAMPLE_SIZE)
    ap.add_argument("--mllib", action="store_true", help="fit the classifier with MLlib instead of Newton")
    args = ap.parse_args(argv)

    spark = SparkSession.builder.appName("txnwatch-training").getOrCreate()
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    if args.events:
        raw = raw_from_events(read_table(spark, args.events, "events"))
    else:
        # One given schema, so that a CSV is not read once more to infer it.
        raw = read_raw(spark, args.raw, args.format, schema=raw_file_schema(spark, args.raw) if args.format == "csv" else None)
        require_columns(raw, ["Time", "Amount", "Class", args.key], "source columns")
    summary = run_training(spark, raw, args.out, sample_size=args.sample_size, key=args.key, exact=not args.mllib)
    print(json.dumps(summary, sort_keys=True))
    return summary


if __name__ == "__main__":
    main()
