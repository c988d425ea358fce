"""Catalog entries for feature encoding, classifier, isolation forest and the
training job (registered on import). Fitted models have no SQL oracle; the
driver records a rows-only check for them, and tests check their properties
(see tests/test_models.py)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from txnwatch.catalog import REGISTRY, _with, register, views
from txnwatch.operators.categories import category_index, category_places, fit_category_logistic
from txnwatch.operators.features import ScalerParams, fit_encoder, fit_one_hot, fit_standard_scaler
from txnwatch.operators.iforest import (
    NODE_SCHEMA,
    Forest,
    average_path_length,
    fit_isolation_forest,
    node_table,
    score_forest,
)
from txnwatch.operators.logistic import fit_logistic
from txnwatch.operators.sampling import stratified_split
from txnwatch.plans import training
from txnwatch.sources import store
from txnwatch.schema import CATEGORICAL_FEATURES, CHANNELS, MERCHANT_CATEGORIES, NUMERIC_FEATURES
from txnwatch.sources.fixtures import raw_from_events
from txnwatch.sources.tables import read_table

_SCALE_SQL = ", ".join(
    f"round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () > 0 THEN stddev_pop({c}) OVER () ELSE 1.0 END, 6) AS {c}"
    for c in NUMERIC_FEATURES
)


@register("standard_scale", _with(f"SELECT transaction_id, {_SCALE_SQL} FROM txn"))
def q_standard_scale(spark, sf_dir):
    """M1 standardisation with the population deviation."""
    txn, _ = views(spark, sf_dir)
    params = fit_standard_scaler(txn, NUMERIC_FEATURES)
    return txn.select("transaction_id", *[F.round(c, 6).alias(n) for c, n in zip(params.columns(), NUMERIC_FEATURES)])


_ONEHOT_SQL = ", ".join(
    [f"CASE WHEN channel = '{v}' THEN 1.0 ELSE 0.0 END AS \"channel={v}\"" for v in sorted(CHANNELS)]
    + [f"CASE WHEN merchant_category = '{v}' THEN 1.0 ELSE 0.0 END AS \"merchant_category={v}\""
       for v in sorted(MERCHANT_CATEGORIES)]
)


@register("one_hot", _with(f"SELECT transaction_id, {_ONEHOT_SQL} FROM txn"))
def q_one_hot(spark, sf_dir):
    """M2 one-hot encoding, all categories kept, unknown -> zeros."""
    txn, _ = views(spark, sf_dir)
    params = fit_one_hot(txn, CATEGORICAL_FEATURES)
    return txn.select("transaction_id", *params.columns())


_MANY = ["channel", "merchant_category", "account_id"]
_INDEX_SQL = " UNION ".join(f"SELECT {i} AS no, CAST({c} AS VARCHAR) AS value FROM txn WHERE {c} IS NOT NULL" for i, c in enumerate(_MANY))


@register(
    "one_hot_places",
    _with(
        f"""SELECT transaction_id, {", ".join(f"i{i}.place AS at_{c}" for i, c in enumerate(_MANY))} FROM txn """
        + " ".join(
            f"LEFT JOIN (SELECT no, value, row_number() OVER (ORDER BY no, value) - 1 AS place FROM ({_INDEX_SQL})) i{i} "
            f"ON i{i}.no = {i} AND i{i}.value = CAST(txn.{c} AS VARCHAR)"
            for i, c in enumerate(_MANY)
        )
    ),
)
def q_one_hot_places(spark, sf_dir):
    """M2 for many categories: the places that are 1, every account a category, from a table of categories."""
    txn, _ = views(spark, sf_dir)
    rows = txn.select("transaction_id", *_MANY)
    return category_places(rows, category_index(rows, _MANY), _MANY).select("transaction_id", *[f"at_{c}" for c in _MANY])


def _split(spark, sf_dir):
    """Model inputs (read by many passes: split, fit, score), checkpointed once."""
    txn, _ = views(spark, sf_dir)
    cols = ["transaction_id", "label", *NUMERIC_FEATURES, *CATEGORICAL_FEATURES]
    inputs = txn.select(*cols).checkpoint(eager=True)
    return inputs, stratified_split(inputs, "label", "transaction_id")


@register("logistic_fit", None)
def q_logistic_fit(spark, sf_dir):
    """M3 balanced logistic regression with MLlib; coefficient table (rows-only)."""
    _, sp = _split(spark, sf_dir)
    model = fit_logistic(sp.train, "label", fit_encoder(sp.train), exact=False)
    return model.coefficient_table(spark)


@register("logistic_fit_exact", None)
def q_logistic_fit_exact(spark, sf_dir):
    """M3 exact fit (the default): distributed Newton passes, intercept penalised (rows-only)."""
    _, sp = _split(spark, sf_dir)
    model = fit_logistic(sp.train, "label", fit_encoder(sp.train), exact=True)
    return model.coefficient_table(spark)


@register("logistic_score", None)
def q_logistic_score(spark, sf_dir):
    """M4 fraud probability of every transaction from the fitted model (rows-only)."""
    txn, sp = _split(spark, sf_dir)
    model = fit_logistic(sp.train, "label", fit_encoder(sp.train))
    return txn.select("transaction_id", model.probability().alias("ml_probability"))


def _forest(spark, sf_dir):
    txn, sp = _split(spark, sf_dir)
    normal = sp.train.where(F.col("label") == 0).select("transaction_id", *NUMERIC_FEATURES)
    return txn, fit_isolation_forest(normal, NUMERIC_FEATURES, "transaction_id")


@register("iforest_fit", None)
def q_iforest_fit(spark, sf_dir):
    """M5 isolation forest node table, 120 trees (rows-only)."""
    _, forest = _forest(spark, sf_dir)
    return node_table(spark, forest)


@register("iforest_score", None)
def q_iforest_score(spark, sf_dir):
    """M6 + M7 decision score and flag of every transaction (rows-only)."""
    txn, forest = _forest(spark, sf_dir)
    scored = score_forest(txn.select("transaction_id", *NUMERIC_FEATURES), forest)
    return scored.select("transaction_id", "anomaly_score", "anomaly_flag")


@register("run_summary", None)
def q_run_summary(spark, sf_dir):
    """M9 + F9 the whole training job over the events table; one summary row (rows-only)."""
    raw = raw_from_events(read_table(spark, sf_dir, "events"))
    root = f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/training-run-{uuid.uuid4().hex}"
    summary = training.run_training(spark, raw, root)
    return spark.createDataFrame([summary])


# Fixed model parameters for the scoring check (arbitrary constants, not fitted).
FIXED_INTERCEPT = -3.0
FIXED_NUMERIC = {"Amount": 0.8, "hour": -0.3, "velocity_1h": 0.5, "avg_amount_24h": -0.2, "amount_to_avg_ratio": 0.6}
FIXED_CATEGORY_STEP = 0.1  # weight of the i-th sorted category of each column: i * step


def _fixed_model(txn):
    from txnwatch.operators.features import FeatureEncoder
    from txnwatch.operators.logistic import LogisticModel

    enc = FeatureEncoder(fit_standard_scaler(txn, NUMERIC_FEATURES), fit_one_hot(txn, CATEGORICAL_FEATURES))
    coef = [FIXED_NUMERIC[c] for c in NUMERIC_FEATURES] + [
        i * FIXED_CATEGORY_STEP for c in CATEGORICAL_FEATURES for i, _ in enumerate(enc.onehot.categories[c])
    ]
    return LogisticModel(enc, FIXED_INTERCEPT, coef, "fixed")


def _fixed_score_sql() -> str:
    terms = [f"{FIXED_INTERCEPT}"]
    for c in NUMERIC_FEATURES:
        terms.append(
            f"{FIXED_NUMERIC[c]} * (({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () > 0 "
            f"THEN stddev_pop({c}) OVER () ELSE 1.0 END)"
        )
    for col, values in (("channel", sorted(CHANNELS)), ("merchant_category", sorted(MERCHANT_CATEGORIES))):
        for i, v in enumerate(values):
            terms.append(f"{i * FIXED_CATEGORY_STEP} * (CASE WHEN {col} = '{v}' THEN 1.0 ELSE 0.0 END)")
    margin = " + ".join(terms)
    return _with(f"SELECT transaction_id, round(1.0 / (1.0 + exp(-({margin}))), 6) AS ml_probability FROM txn")


@register("logistic_score_fixed", _fixed_score_sql())
def q_logistic_score_fixed(spark, sf_dir):
    """M4 scoring with fixed coefficients over fitted encoders: scaled numeric
    features, one-hot categories, dot product, logistic."""
    txn, _ = views(spark, sf_dir)
    model = _fixed_model(txn)
    return txn.select("transaction_id", F.round(model.probability(), 6).alias("ml_probability"))


# A forest of two small trees over the raw features (arbitrary numbers, not fitted).
FIXED_PSI = 8
FIXED_OFFSET = -0.55
FIXED_NODES = [
    # tree, node, depth, feature, threshold, left, right, size
    (0, 0, 0, 0, 500.0, 1, 2, 8),
    (0, 1, 1, 1, 11.0, 3, 4, 6),
    (0, 2, 1, -1, 0.0, -1, -1, 2),
    (0, 3, 2, -1, 0.0, -1, -1, 3),
    (0, 4, 2, -1, 0.0, -1, -1, 3),
    (1, 0, 0, 4, 1.5, 1, 2, 8),
    (1, 1, 1, -1, 0.0, -1, -1, 7),
    (1, 2, 1, -1, 0.0, -1, -1, 1),
]


def _fixed_forest() -> Forest:
    import pandas as pd

    rows = [(*n, n[2] + average_path_length(n[7]) if n[3] < 0 else 0.0) for n in FIXED_NODES]
    nodes = pd.DataFrame(rows, columns=[f.name for f in NODE_SCHEMA.fields])
    plain = ScalerParams(dict.fromkeys(NUMERIC_FEATURES, 0.0), dict.fromkeys(NUMERIC_FEATURES, 1.0))
    return Forest(NUMERIC_FEATURES, plain, nodes, FIXED_PSI, FIXED_OFFSET, 2)


_C = "(2 * (ln({n} - 1.0) + 0.5772156649015329) - 2 * ({n} - 1.0) / {n})"


@register(
    "iforest_score_fixed",
    _with(
        f"""SELECT transaction_id, round(s, 6) AS anomaly_score, CAST(s < 0 AS INTEGER) AS anomaly_flag FROM (
  SELECT transaction_id, -pow(2.0, -((
      CASE WHEN Amount > 500 THEN 1 + 1.0 WHEN hour <= 11 THEN 2 + {_C.format(n=3)} ELSE 2 + {_C.format(n=3)} END
      + CASE WHEN amount_to_avg_ratio <= 1.5 THEN 1 + {_C.format(n=7)} ELSE 1.0 END) / 2.0) / {_C.format(n=8)}) + 0.55 AS s
  FROM txn)"""
    ),
)
def q_iforest_score_fixed(spark, sf_dir):
    """M6 + M7 scores and flags of a fixed forest for every transaction."""
    txn, _ = views(spark, sf_dir)
    scored = score_forest(txn.select("transaction_id", *NUMERIC_FEATURES), _fixed_forest())
    return scored.select("transaction_id", F.round("anomaly_score", 6).alias("anomaly_score"), "anomaly_flag")


_FOREST_SQL = REGISTRY["iforest_score_fixed"].sql


@register(
    "models_round_trip",
    f"SELECT transaction_id, ml_probability, anomaly_score, anomaly_flag FROM ({_fixed_score_sql()}) JOIN ({_FOREST_SQL}) USING (transaction_id)",
)
def q_models_round_trip(spark, sf_dir):
    """A11 models that were written and read again score every transaction as the ones written would."""
    txn, _ = views(spark, sf_dir)
    root = f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/models-{uuid.uuid4().hex}"
    training.save_models(spark, training.ModelBundle(_fixed_model(txn), _fixed_forest(), {"roc_auc": 0.75}), root)
    bundle = training.load_models(spark, root)
    if bundle.metrics != {"roc_auc": 0.75} or training.load_metadata(spark, root)["numeric_features"] != NUMERIC_FEATURES:
        raise ValueError("metrics or feature lists did not come back")
    rows = txn.select("transaction_id", *NUMERIC_FEATURES, F.round(bundle.classifier.probability(), 6).alias("ml_probability"))
    scored = score_forest(rows, bundle.forest)
    return scored.select("transaction_id", "ml_probability", F.round("anomaly_score", 6).alias("anomaly_score"), "anomaly_flag")


@register(
    "run_summary_json",
    _with(
        """SELECT 2000 AS sample_size, count(*) AS rows_processed, CAST(sum(is_fraud) AS BIGINT) AS fraud_rows,
  round(100.0::DOUBLE * avg(is_success), 6) AS success_rate_pct, round((SELECT avg(risk_score) FROM pred), 6) AS avg_risk_score,
  0.25::DOUBLE AS metric_pr_auc FROM txn"""
    ),
)
def q_run_summary_json(spark, sf_dir):
    """F9 the summary of a run, A10 written as JSON and read again."""
    txn, pred = views(spark, sf_dir)
    path = f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/summary-{uuid.uuid4().hex}"
    store.write_json_summary(spark, training.run_summary(txn, pred, 2000, {"pr_auc": 0.25}), path)
    kinds = "sample_size long, rows_processed long, fraud_rows long, success_rate_pct double, avg_risk_score double, metric_pr_auc double"
    out = spark.createDataFrame([store.read_json_summary(spark, path)], kinds)
    return out.withColumns({c: F.round(c, 6) for c in ("success_rate_pct", "avg_risk_score")})


_SPLIT_SIZES = "(SELECT count(*) AS n, CAST(ceil(0.2 * count(*)) AS BIGINT) AS n_test FROM txn_ev)"


@register(
    "logistic_fit_check",
    _with(f"SELECT n - n_test AS rows_fitted, true AS converged, 0.0::DOUBLE AS max_gradient FROM {_SPLIT_SIZES}"),
)
def q_logistic_fit_check(spark, sf_dir):
    """M3 the fit ends where the gradient vanishes."""
    _, sp = _split(spark, sf_dir)
    model = fit_logistic(sp.train, "label", fit_encoder(sp.train))
    rows = sp.train.count()
    return spark.createDataFrame(
        [(rows, model.converged, round(model.max_gradient / rows, 6))], "rows_fitted bigint, converged boolean, max_gradient double"
    )


@register(
    "logistic_categories_check",
    _with(
        f"""SELECT count(*) AS rows_scored, {" + ".join(f"count(DISTINCT {c})" for c in _MANY)} AS categories, true AS converged,
       0.0::DOUBLE AS max_gradient FROM txn_ev"""
    ),
)
def q_logistic_categories_check(spark, sf_dir):
    """M3, M4 with every account a category: the fit over all rows ends where the gradient vanishes, and scores every row."""
    txn, _ = views(spark, sf_dir)
    rows = txn.select("transaction_id", "label", *NUMERIC_FEATURES, *_MANY).checkpoint(eager=True)
    model = fit_category_logistic(rows, "label", NUMERIC_FEATURES, _MANY)
    scored = model.probability(rows).where(F.col("ml_probability").between(0, 1))
    return scored.agg(F.count(F.lit(1)).alias("rows_scored")).select(
        "rows_scored",
        F.lit(model.table.count()).cast("bigint").alias("categories"),
        F.lit(model.converged).alias("converged"),
        F.lit(round(model.max_gradient / rows.count(), 6)).alias("max_gradient"),
    )


@register(
    "iforest_fit_check",
    _with(
        """SELECT 120 AS trees, least(256, n) AS sample_size, true AS depth_in_bounds,
       CAST(floor(0.02 * (n - 1)) AS BIGINT) + 1 AS flagged, n AS rows_fitted
FROM (SELECT count(*) AS n FROM txn_ev WHERE label = 0)"""
    ),
)
def q_iforest_fit_check(spark, sf_dir):
    """M5 trees, rows per tree, depth, and the rows below the fitted offset."""
    txn, _ = views(spark, sf_dir)
    normal = txn.where(F.col("label") == 0).select("transaction_id", *NUMERIC_FEATURES).checkpoint(eager=True)
    forest = fit_isolation_forest(normal, NUMERIC_FEATURES, "transaction_id")
    roots = forest.nodes[forest.nodes["node_id"] == 0]
    scored = score_forest(normal, forest).agg(F.sum("anomaly_flag").alias("flagged"), F.count(F.lit(1)).alias("rows_fitted"))
    return scored.select(
        F.lit(int(forest.nodes["tree_id"].nunique())).alias("trees"),
        F.lit(int(roots["size"].max())).alias("sample_size"),
        F.lit(bool(forest.nodes["depth"].max() <= forest.max_depth and roots["size"].nunique() == 1)).alias("depth_in_bounds"),
        "flagged",
        "rows_fitted",
    )


@register(
    "job_store_counts",
    _with(
        """SELECT count(*) AS rows_stored, count(*) AS rows_scored, CAST(sum(label) AS BIGINT) AS fraud_rows,
       round(100.0 * avg(is_success), 6) AS success_rate_pct, sum(velocity_1h) AS velocity_sum,
       round(sum(avg_amount_24h), 2) AS avg_amount_sum, count(*) AS rows_processed
FROM txn_ev"""
    ),
)
def q_job_store_counts(spark, sf_dir):
    """The job enriches, scores, stores and sums up every raw row; the sample only bounds the fits."""
    txn, _ = views(spark, sf_dir)
    given = txn.select("event_id", "account_id", "channel", "merchant_category", "is_success")
    raw = raw_from_events(read_table(spark, sf_dir, "events")).join(given, "event_id").checkpoint(eager=True)
    root = f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/job-{uuid.uuid4().hex}"
    summary = training.run_training(spark, raw, root, sample_size=2000)
    tx, pr = store.read_monitoring_tables(spark, root)
    scored = pr.agg(F.count_distinct("transaction_id")).first()[0]
    return tx.agg(
        F.count(F.lit(1)).alias("rows_stored"),
        F.lit(scored).alias("rows_scored"),
        F.sum("is_fraud").alias("fraud_rows"),
        F.round(100.0 * F.avg("is_success"), 6).alias("success_rate_pct"),
        F.sum("velocity_1h").alias("velocity_sum"),
        F.round(F.sum("avg_amount_24h"), 2).alias("avg_amount_sum"),
        F.lit(summary["rows_processed"]).cast("bigint").alias("rows_processed"),
    )
