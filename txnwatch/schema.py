"""Column lists, table schemas and the fixed values results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for identical results)
# ---------------------------------------------------------------------------
NUMERIC_FEATURES = ["Amount", "hour", "velocity_1h", "avg_amount_24h", "amount_to_avg_ratio"]
CATEGORICAL_FEATURES = ["channel", "merchant_category"]
MODEL_FEATURES = NUMERIC_FEATURES + CATEGORICAL_FEATURES

REQUIRED_SOURCE_COLUMNS = ["Time", "Amount", "Class"]

CHANNELS = ["web", "mobile", "pos", "atm"]
CHANNEL_WEIGHTS = [0.42, 0.32, 0.22, 0.04]
MERCHANT_CATEGORIES = ["grocery", "electronics", "travel", "health", "entertainment", "utilities"]
MERCHANT_WEIGHTS = [0.24, 0.19, 0.14, 0.13, 0.12, 0.18]

BASE_TIMESTAMP = "2024-01-01 00:00:00"
RANDOM_SEED = 42
DEFAULT_SAMPLE_SIZE = 12_000
TEST_SIZE = 0.2
ALERT_THRESHOLD = 45.0
SQL_ALERT_LIMIT = 50
DASHBOARD_ALERT_LIMIT = 20
NO_RULE_REASON = "No high-risk rule triggered"
REASON_SEPARATOR = "; "
RISK_BAND_ORDER = {"low": 0, "medium": 1, "high": 2}
UNKNOWN_BAND_RANK = 99
IFOREST_TREES = 120
IFOREST_CONTAMINATION = 0.02
IFOREST_MAX_SAMPLES = 256
LOGISTIC_MAX_ITER = 1000

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US

# ---------------------------------------------------------------------------
# Stored tables
# ---------------------------------------------------------------------------
# Names and order of the stored columns.
TRANSACTION_COLUMNS = [
    "transaction_id",
    "transaction_timestamp",
    "account_id",
    "channel",
    "merchant_category",
    "Amount",
    "hour",
    "velocity_1h",
    "avg_amount_24h",
    "amount_to_avg_ratio",
    "is_fraud",
    "is_success",
]

PREDICTION_COLUMNS = [
    "transaction_id",
    "ml_probability",
    "anomaly_score",
    "anomaly_flag",
    "rule_score",
    "risk_score",
    "risk_band",
    "decision",
    "rule_reasons",
]

TRANSACTIONS_SCHEMA = T.StructType(
    [
        T.StructField("transaction_id", T.StringType(), False),
        T.StructField("transaction_timestamp", T.TimestampNTZType(), False),
        T.StructField("account_id", T.LongType(), False),
        T.StructField("channel", T.StringType(), False),
        T.StructField("merchant_category", T.StringType(), False),
        T.StructField("Amount", T.DoubleType(), False),
        T.StructField("hour", T.IntegerType(), False),
        T.StructField("velocity_1h", T.DoubleType(), False),
        T.StructField("avg_amount_24h", T.DoubleType(), False),
        T.StructField("amount_to_avg_ratio", T.DoubleType(), False),
        T.StructField("is_fraud", T.IntegerType(), True),
        T.StructField("is_success", T.IntegerType(), True),
    ]
)

PREDICTIONS_SCHEMA = T.StructType(
    [
        T.StructField("prediction_id", T.LongType(), False),
        T.StructField("transaction_id", T.StringType(), False),
        T.StructField("ml_probability", T.DoubleType(), False),
        T.StructField("anomaly_score", T.DoubleType(), False),
        T.StructField("anomaly_flag", T.IntegerType(), False),
        T.StructField("rule_score", T.DoubleType(), False),
        T.StructField("risk_score", T.DoubleType(), False),
        T.StructField("risk_band", T.StringType(), False),
        T.StructField("decision", T.StringType(), False),
        T.StructField("rule_reasons", T.StringType(), False),
        T.StructField("created_at", T.TimestampType(), True),
    ]
)

# Columns that must never be NULL (B18); is_fraud and is_success may be.
TRANSACTION_NOT_NULL = [c for c in TRANSACTION_COLUMNS if c not in ("is_fraud", "is_success")]
PREDICTION_NOT_NULL = PREDICTION_COLUMNS

RAW_SCHEMA = T.StructType(
    [T.StructField("Time", T.DoubleType(), True)]
    + [T.StructField(f"V{i}", T.DoubleType(), True) for i in range(1, 29)]
    + [T.StructField("Amount", T.DoubleType(), True), T.StructField("Class", T.IntegerType(), True)]
)
