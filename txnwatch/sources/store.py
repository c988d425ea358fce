"""The monitoring store: transactions and predictions under one root.

Both tables are partitioned by ``txn_date``, the date of the transaction, so date
filters prune files. ``predictions`` carries ``prediction_id``, ``created_at`` and
the ``run`` that scored it. Two smaller datasets go with them: ``keys`` (every stored
transaction and prediction by a hash of the transaction id, for look-ups) and ``totals`` (what
each write adds to the sums by day and channel of the joined table, see ``read_totals``).

A write becomes visible as a whole, by a new snapshot (``sources.snapshots``); one that dies leaves the store
as it was. Constraints that a database would enforce (primary key, NOT NULL, foreign key) are
explicit DataFrame checks, run before a write unless the caller says otherwise.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnwatch.operators import quality
from txnwatch.schema import PREDICTION_COLUMNS, PREDICTIONS_SCHEMA, TRANSACTION_COLUMNS, TRANSACTIONS_SCHEMA
from txnwatch.sources import snapshots
from txnwatch.sources.snapshots import KEYS, Segment


def _exists(spark: SparkSession, path: str) -> bool:
    target, fs = snapshots._files(spark, path)
    return fs.exists(target)


def conform_transactions(df: DataFrame) -> DataFrame:
    """B2 + B13: project to the stored columns and cast to the stored types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TRANSACTIONS_SCHEMA.fields])


def conform_predictions(df: DataFrame) -> DataFrame:
    cols = [F.col(c).cast(PREDICTIONS_SCHEMA[c].dataType).alias(c) for c in PREDICTION_COLUMNS]
    return df.select(*cols)


def with_prediction_ids(predictions: DataFrame, start: int = 0, keep: list[str] | None = None) -> DataFrame:
    """``prediction_id`` unique and above ``start`` (increasing, not dense),
    ``created_at`` now; ``keep`` names extra columns to carry along.

    ``monotonically_increasing_id`` needs no shuffle; callers take it right
    before a write or a checkpoint of a deterministic input, so task retries
    reproduce the same ids.
    """
    return predictions.withColumns(
        {
            "prediction_id": (F.monotonically_increasing_id() + F.lit(int(start)) + F.lit(1)).cast("bigint"),
            "created_at": F.current_timestamp(),
        }
    ).select(*[f.name for f in PREDICTIONS_SCHEMA.fields], *(keep or []))


def validate(transactions: DataFrame, predictions: DataFrame) -> dict[str, int]:
    """B17-B19 counts; all zero means the tables satisfy the constraints."""
    return {
        "pk_violations": quality.key_violations(transactions, ["transaction_id"]).count(),
        "tx_null_violations": quality.total_nulls(transactions, quality.TRANSACTION_NOT_NULL),
        "pred_null_violations": quality.total_nulls(predictions, quality.PREDICTION_NOT_NULL),
        "fk_orphans": predictions.join(transactions.select("transaction_id"), "transaction_id", "left_anti").count(),
    }


_DATE = T.StructField("txn_date", T.DateType(), True)
TX_FILE_SCHEMA = T.StructType([*TRANSACTIONS_SCHEMA.fields, _DATE])
PRED_FILE_SCHEMA = T.StructType([*PREDICTIONS_SCHEMA.fields, T.StructField("run", T.StringType(), True), _DATE])
#: A row for each transaction (``run`` NULL) and for each prediction.
KEY_SCHEMA = T.StructType(
    [TRANSACTIONS_SCHEMA[c] for c in ("transaction_id", "transaction_timestamp", "channel", "is_fraud", "is_success")]
    + [T.StructField("run", T.StringType(), True), _DATE]
)
#: What a write adds to the rows, frauds, successes and risk of ``transactions LEFT JOIN predictions``.
TOTALS_SCHEMA = T.StructType(
    [T.StructField("channel", T.StringType(), True)]
    + [T.StructField(c, T.LongType(), True) for c in ("total", "fraud", "success")]
    + [T.StructField("risk", T.DoubleType(), True), _DATE]
)
#: What a key row says of its transaction, beside the id.
ABOUT = [c for c in KEY_SCHEMA.names if c not in ("transaction_id", "run")]
FACTS = [*ABOUT, "is_new"]
TX, PRED, TOTALS = "transactions", "predictions", "totals"
LAYOUT = {
    TX: (TX_FILE_SCHEMA, "txn_date", "transaction_timestamp"),
    PRED: (PRED_FILE_SCHEMA, "txn_date", "risk_score"),
    TOTALS: (TOTALS_SCHEMA, "txn_date", "channel"),
}
#: Sorted by these within a date, row-group statistics skip data for range filters (time, risk_score >= 45).
HIGH_WATER = "max_prediction_id"

#: The scoring run of predictions that name none.
DEFAULT_RUN = "default"


def _with_run(predictions: DataFrame, run: str) -> DataFrame:
    """The stored prediction columns and the run; a ``run`` column of the input is kept."""
    named = F.coalesce(F.col("run").cast("string"), F.lit(run)) if "run" in predictions.columns else F.lit(run)
    return predictions.select(
        *[F.col(c).cast(PREDICTIONS_SCHEMA[c].dataType).alias(c) for c in PREDICTION_COLUMNS], named.alias("run")
    )


def _with_facts(predictions: DataFrame, facts: DataFrame) -> DataFrame:
    """Predictions with what is known of their transaction: its date, the partition column of the predictions table, and
    what their key rows and sums repeat (``FACTS``), so that one join serves them all. ``is_new`` is NULL for an orphan."""
    return predictions.join(facts.select("transaction_id", *FACTS), "transaction_id", "left")


def _flag(column: str) -> Column:
    return F.coalesce(F.col(column) == 1, F.lit(False)).cast("bigint")


def _added_totals(facts: DataFrame, predictions: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """What new rows add to the sums of the joined table, by date and channel.

    ``facts`` has a row for each transaction that is new (``is_new``) or gets a new prediction. In the joined table a
    transaction takes max(predictions, 1) rows, so the first prediction of a stored one adds risk but no row.
    ``stored`` counts the predictions that were there before.
    """
    new = predictions.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("more"), F.sum("risk_score").alias("risk"))
    rows = facts.join(new, "transaction_id", "left")
    had: Column = F.lit(0)
    if stored is not None:
        rows, had = rows.join(stored, "transaction_id", "left"), F.coalesce("had", F.lit(0))
    before = F.when(F.col("is_new"), 0).otherwise(F.greatest(had, F.lit(1)))
    weighed = rows.withColumn("w", (F.greatest(had + F.coalesce("more", F.lit(0)), F.lit(1)) - before).cast("bigint"))
    return weighed.groupBy("txn_date", "channel").agg(
        F.sum("w").alias("total"),
        F.sum(F.col("w") * _flag("is_fraud")).alias("fraud"),
        F.sum(F.col("w") * _flag("is_success")).alias("success"),
        F.coalesce(F.sum("risk"), F.lit(0.0)).alias("risk"),
    )


def _sums_of_new(new: DataFrame, pred: DataFrame, had: DataFrame | None = None) -> DataFrame:
    """``_added_totals`` where ids are unique, without a join: new transactions are a row each, and so is a prediction that is
    not the first of its transaction. ``pred`` carries ``FACTS``; ``had`` counts the predictions stored before."""
    cell = ["txn_date", "channel", "is_fraud", "is_success"]
    each = pred.where(F.col("is_new").isNotNull()).groupBy("transaction_id", *cell).agg(
        F.count(F.lit(1)).alias("more"), F.sum("risk_score").alias("risk")
    )
    before: Column = F.lit(0)
    if had is not None:
        each, before = each.join(had, "transaction_id", "left"), F.coalesce("had", F.lit(0))
    rows = each.select(*cell, (F.col("more") - F.when(before == 0, 1).otherwise(0)).alias("w"), "risk").unionByName(
        new.select(*cell, F.lit(1).cast("bigint").alias("w"), F.lit(0.0).alias("risk"))
    )
    return rows.groupBy("txn_date", "channel").agg(
        F.sum("w").alias("total"),
        F.sum(F.col("w") * _flag("is_fraud")).alias("fraud"),
        F.sum(F.col("w") * _flag("is_success")).alias("success"),
        F.coalesce(F.sum("risk"), F.lit(0.0)).alias("risk"),
    )


def _write_segment(root: str, tx: DataFrame, n_tx: int, pred: DataFrame, totals: DataFrame) -> tuple[Segment, int]:
    """Write the files of one segment; the segment and the largest prediction id in it.

    ``tx`` are the ``n_tx`` new transactions; ``pred`` carries ``FACTS``, which its key rows repeat. Give frames that are cheap to read again.
    """
    name = snapshots.new_name()
    n_pred, top = pred.agg(F.count(F.lit(1)), F.max("prediction_id")).first()
    if n_tx:
        snapshots.write_by(tx.select(*TX_FILE_SCHEMA.names), root, TX, name, *LAYOUT[TX][1:])
    if n_pred:
        snapshots.write_by(pred.select(*PRED_FILE_SCHEMA.names), root, PRED, name, *LAYOUT[PRED][1:])
    new = tx.select("transaction_id", *ABOUT, F.lit(None).cast("string").alias("run"))
    scored = pred.where(F.col("is_new").isNotNull()).select("transaction_id", *ABOUT, "run")
    buckets = snapshots.write_keys(new.unionByName(scored).select(*KEY_SCHEMA.names), "transaction_id", root, name, n_tx + n_pred)
    snapshots.write_by(totals.select(*TOTALS_SCHEMA.names), root, TOTALS, name, *LAYOUT[TOTALS][1:])
    any_rows = int(n_tx + n_pred > 0)
    return Segment(name, {TX: n_tx, PRED: n_pred, TOTALS: any_rows, KEYS: n_tx + n_pred}, buckets), int(top or 0)


def _refuse(**counts: DataFrame) -> None:
    """Raise if any of the counts is not 0; each is a frame of one number, and one job takes them all."""
    each = [df.toDF("n").select(F.lit(name).alias("check"), F.col("n").cast("bigint")) for name, df in counts.items()]
    found = reduce(DataFrame.unionByName, each).where("n > 0").collect()
    if found:
        raise ValueError(f"constraint violations: { {r['check']: r['n'] for r in found} }")


def _count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)))


def _nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(reduce(Column.__add__, [F.count(F.lit(1)) - F.count(c) for c in columns]))


def write_monitoring_data(transactions: DataFrame, predictions: DataFrame, root: str,
                          check: bool = True, run: str = DEFAULT_RUN) -> None:
    """Full refresh of both tables, in one snapshot: readers see the old tables or the new ones.

    Rows are computed once (checkpoints): the checks, dates, ids, keys and totals read them.
    """
    spark = transactions.sparkSession
    base = snapshots.current(spark, root)
    tx = conform_transactions(transactions).withColumn("txn_date", F.to_date("transaction_timestamp")).checkpoint(eager=True)
    # Ids are taken from stored rows, so that a task that runs again gives the same ones.
    facts = tx.withColumn("is_new", F.lit(True))
    dated = _with_facts(_with_run(predictions, run), facts).checkpoint(eager=True)
    if check:
        # A prediction without a date has no transaction, unless a transaction without a time is refused anyway.
        _refuse(
            pk_violations=_count(quality.key_violations(tx, ["transaction_id"])),
            tx_null_violations=_nulls(tx, quality.TRANSACTION_NOT_NULL),
            pred_null_violations=_nulls(dated, quality.PREDICTION_NOT_NULL),
            fk_orphans=_count(dated.where(F.col("txn_date").isNull())),
        )
    ided = with_prediction_ids(dated, keep=["run", *FACTS])
    totals = _sums_of_new(tx, dated) if check else _added_totals(facts, dated)
    segment, top = _write_segment(root, tx, tx.count(), ided, totals)
    snapshots.publish(spark, root, base, [segment], {HIGH_WATER: top})
    snapshots.expire(spark, root)


def initialize_store(spark: SparkSession, root: str) -> None:
    """An empty store where none is."""
    base = snapshots.current(spark, root)
    if not base.version:
        snapshots.publish(spark, root, base, [], {HIGH_WATER: 0})


def reset_store(spark: SparkSession, root: str) -> None:
    """Drop all rows (a new, empty snapshot; the files go when the old ones expire)."""
    snapshots.publish(spark, root, snapshots.current(spark, root), [], {HIGH_WATER: 0})


def read_monitoring_tables(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Both tables of one snapshot with their stored schemas. The
    tables keep the ``txn_date`` partition column (a prediction's is its
    transaction's date), which date filters and the monitoring join use to
    skip whole partitions of both tables."""
    now = snapshots.current(spark, root)
    tx = snapshots.read(spark, root, TX, now, TX_FILE_SCHEMA).select(*TRANSACTION_COLUMNS, "txn_date")
    pr = snapshots.read(spark, root, PRED, now, PRED_FILE_SCHEMA).select(*[f.name for f in PREDICTIONS_SCHEMA.fields], "txn_date")
    return tx, pr


def read_totals(spark: SparkSession, root: str) -> DataFrame:
    """The sums of ``transactions LEFT JOIN predictions`` by date and channel, as every write added to them.

    A row for each date, channel and segment, so the overview, the trend and the channel rates (F1, F2, F4)
    need neither the tables nor a join (``plans.monitoring.*_from_totals``).
    """
    return snapshots.read(spark, root, TOTALS, snapshots.current(spark, root), TOTALS_SCHEMA)


def _one_each(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key, checkpointed. Only the keys are shuffled to see whether any comes twice; whole rows only if one does."""
    rows = df.checkpoint(eager=True)
    return rows if quality.key_violations(rows, keys).isEmpty() else rows.dropDuplicates(keys).checkpoint(eager=True)


def append_live_predictions(transactions: DataFrame, predictions: DataFrame, root: str,
                            run: str = DEFAULT_RUN, check: bool = True) -> int:
    """Append transactions whose id is not stored yet, and predictions
    that their run has not stored yet, both in one snapshot.

    The key of a transaction is its id: an id that is stored under another
    timestamp is refused. The key of a prediction is (transaction, run): a replay of the
    same run adds nothing, another run adds its own predictions, and a
    prediction may come later than its transaction, whose stored date it
    takes. What is stored about the ids of the batch is looked up in their key
    buckets; the tables are not read. Returns the number of new transactions.
    """
    spark = transactions.sparkSession
    initialize_store(spark, root)
    base = snapshots.current(spark, root)
    tx = conform_transactions(transactions).withColumn("txn_date", F.to_date("transaction_timestamp"))
    tx = _one_each(tx, ["transaction_id"])
    pr = _one_each(_with_run(predictions, run), ["transaction_id", "run"])
    moved = had = None
    if any(s.rows.get(KEYS) for s in base.segments):
        ids = tx.select("transaction_id").union(pr.select("transaction_id"))  # one that comes twice is found once
        stored = snapshots.look_up(spark, root, base, ids, KEY_SCHEMA).checkpoint(eager=True)
        known = stored.where(F.col("run").isNull())
        was = known.select("transaction_id", F.col("transaction_timestamp").alias("_was"), F.lit(True).alias("_known"))
        met = tx.join(was, "transaction_id", "left").checkpoint(eager=True)
        moved = met.where(F.col("_known") & ~F.col("transaction_timestamp").eqNullSafe(F.col("_was")))
        new_tx = met.where(F.col("_known").isNull()).select(*tx.columns)
        scored = stored.where(F.col("run").isNotNull()).select("transaction_id", "run")
        new_pr = pr.join(scored, ["transaction_id", "run"], "left_anti")
        had = scored.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("had"))
        facts = known.select("transaction_id", *ABOUT, F.lit(False).alias("is_new")).unionByName(
            new_tx.select("transaction_id", *ABOUT, F.lit(True).alias("is_new"))
        )
    else:  # nothing is stored: no join below moves a row for it
        new_tx, new_pr, facts = tx, pr, tx.withColumn("is_new", F.lit(True))
    start = int(base.marks.get(HIGH_WATER, 0))
    ided = with_prediction_ids(_with_facts(new_pr, facts), start, keep=["run", *FACTS]).checkpoint(eager=True)
    if check:
        _refuse(
            **({} if moved is None else {"changed_timestamps": _count(moved)}),
            tx_null_violations=_nulls(tx, quality.TRANSACTION_NOT_NULL),
            pred_null_violations=_nulls(pr, quality.PREDICTION_NOT_NULL),
            # A prediction that its run has stored is of a stored transaction.
            fk_orphans=_count(ided.where(F.col("is_new").isNull())),
        )
    n_tx = new_tx.count()
    if not n_tx and ided.where(F.col("is_new").isNotNull()).isEmpty():
        return 0
    rows = new_tx.where(F.col("transaction_id").isNotNull())
    segment, top = _write_segment(root, rows, n_tx, ided, _sums_of_new(new_tx, ided, had))
    marks = base.marks | {HIGH_WATER: max(top, int(base.marks.get(HIGH_WATER, 0)))}
    snapshots.publish(spark, root, base, [*base.segments, segment], marks)
    compact_store(spark, root)
    return segment.rows[TX]


def compact_store(spark: SparkSession, root: str, most: int = snapshots.MOST_SEGMENTS) -> int:
    """Merge small segments once there are more than ``most``; how many were merged."""
    return snapshots.compact(spark, root, LAYOUT, (KEY_SCHEMA, "transaction_id"), most)


def write_json_summary(spark: SparkSession, summary: dict, path: str) -> None:
    """A10: one-row JSON file (run summary, metrics)."""
    spark.createDataFrame([(json.dumps(summary, sort_keys=True),)], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(path)


def read_json_summary(spark: SparkSession, path: str) -> dict:
    row = spark.read.text(path).first()
    return json.loads(row[0]) if row else {}
