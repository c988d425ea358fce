"""Live scoring on Structured Streaming (K1-K5).

* K1 ``live_features``: stateless projection (floored 24h average, live ratio).
* K2 ``score_stream``: the batch ``score_transactions`` applied to a streaming
  DataFrame; invalid rows go to a quarantine output first (B16).
* K3 ``append_to_store``: ``foreachBatch`` sink that keeps invalid rows in a
  quarantine table, scores the others, sets the outcome from the decision and
  appends to both stored tables. A replayed micro-batch or file adds nothing to the store.
* K4 ``daily_trend_stream``: the daily trend (F2) over arriving rows with an
  event-time watermark; a day is emitted once it is closed, and rows behind the watermark are left out.
  ``append_day_sums`` leaves none out: each micro-batch adds sums by day, so a late row corrects a
  day that was closed, and is kept in a side table.
* K5 ``append_rollups``: per-account 1h count and 24h mean for arriving rows.
  Each micro-batch is joined by the stored rows of its accounts on the days that its windows reach
  (``rollups_with_history``) and goes through the batch operator; no state is held by
  account, and no row is dropped for being late: its frame is what is stored by then.

What the sinks of K4 and K5 have seen is told by their key buckets (``sources.snapshots``), so neither a
replay nor a row that comes twice, in one batch or in two, counts again, and no trigger reads the whole history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnwatch.functions.scalars import micros_ntz, outcome_flag, ratio_with_floor
from txnwatch.operators.quality import live_input_checks, split_valid
from txnwatch.schema import DAY_US
from txnwatch.sources import snapshots, store


def live_features(df: DataFrame) -> DataFrame:
    """K1: ``avg_amount_24h`` floored at 1 and the live ratio ``Amount / avg``."""
    safe = F.greatest(F.col("avg_amount_24h").cast("double"), F.lit(1.0))
    return df.withColumns(
        {"avg_amount_24h": safe, "amount_to_avg_ratio": ratio_with_floor(F.col("Amount"), safe)}
    )


def score_stream(stream: DataFrame, scorer) -> tuple[DataFrame, DataFrame]:
    """K2: (scored predictions, quarantined inputs) for a streaming input.

    ``scorer`` is a DataFrame -> DataFrame function such as
    ``lambda df: training.score_transactions(df, bundle)``; stateless, so it
    runs unchanged on a stream.
    """
    good, bad = split_valid(stream, live_input_checks())
    return scorer(live_features(good)), bad


def append_to_store(root: str, scorer, rollups_from_store: bool = False, run: str = store.DEFAULT_RUN):
    """K3: a ``foreachBatch`` function scoring each micro-batch and appending
    both tables idempotently.

    A live row has no label yet, and its outcome follows from the decision (E21).
    Invalid rows are written to ``quarantine`` under ``root`` with the check they
    failed, in a folder of their batch, so that a replay replaces them.

    With ``rollups_from_store`` the batch's ``velocity_1h`` and
    ``avg_amount_24h`` are computed from the stored last 24 hours of its
    accounts plus the batch itself (``rollups_with_history``) instead of being
    taken from the input.
    """

    def write(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        if rollups_from_store:
            store.initialize_store(spark, root)
            history, _ = store.read_monitoring_tables(spark, root)
            feats = rollups_with_history(batch, history).select("transaction_id", "velocity_1h", "avg_amount_24h")
            batch = batch.drop("velocity_1h", "avg_amount_24h").join(feats, "transaction_id")
        good, bad = split_valid(batch.checkpoint(eager=True), live_input_checks())
        bad.write.mode("overwrite").parquet(f"{root.rstrip('/')}/quarantine/batch={int(epoch_id)}")
        tx = live_features(good).drop("is_fraud", "is_success")
        # Scored once: the outcome and the predictions read the same rows.
        scored = scorer(tx).checkpoint(eager=True)
        outcome = scored.select("transaction_id", outcome_flag("decision").alias("is_success"))
        rows = tx.join(outcome, "transaction_id", "left").withColumn("is_fraud", F.lit(None).cast("int"))
        store.append_live_predictions(rows, scored, root, run=run)

    return write


def read_quarantine(spark: SparkSession, root: str) -> DataFrame:
    """The invalid rows kept so far, each with the check it failed."""
    return spark.read.parquet(f"{root.rstrip('/')}/quarantine")


def event_time(ts: str):
    """A watermark needs TIMESTAMP; read the TIMESTAMP_NTZ wall clock as UTC
    through epoch microseconds, so windows and dates do not depend on the
    session time zone."""
    return F.timestamp_micros(micros_ntz(ts))


def daily_trend_stream(stream: DataFrame, ts: str = "transaction_timestamp", watermark: str = "1 day") -> DataFrame:
    """K4: F2 measures per day for arriving scored rows, emitted when a day closes.

    The input carries the transaction columns and ``risk_score`` (NULL when no
    prediction); NULL label, outcome and risk count as 0, as in F2.
    """
    fraud = F.when(F.coalesce(F.col("is_fraud"), F.lit(0)) == 1, F.lit(1)).otherwise(F.lit(0))
    ok = F.when(F.coalesce(F.col("is_success"), F.lit(0)) == 1, F.lit(1.0)).otherwise(F.lit(0.0))
    g = (
        stream.withColumn("_ts", event_time(ts))
        .withWatermark("_ts", watermark)
        .groupBy(F.window("_ts", "1 day").alias("w"))
        .agg(
            F.count(F.lit(1)).alias("total_transactions"),
            F.sum(fraud).cast("bigint").alias("fraud_transactions"),
            F.avg(ok).alias("_ok"),
            F.avg(F.coalesce(F.col("risk_score"), F.lit(0.0))).alias("_risk"),
        )
    )
    return g.select(
        F.date_from_unix_date(F.floor(F.unix_micros(F.col("w.start")) / F.lit(DAY_US)).cast("int")).alias("txn_date"),
        "total_transactions",
        "fraud_transactions",
        F.round(F.lit(100.0) * F.col("fraud_transactions") / F.col("total_transactions"), 3).alias("fraud_rate_pct"),
        F.round(F.lit(100.0) * F.col("_ok"), 3).alias("success_rate_pct"),
        F.round(F.col("_risk"), 3).alias("avg_risk_score"),
    )


ROLL_COLUMNS = ["transaction_id", "account_id", "transaction_timestamp", "Amount"]


def rollups_with_history(batch: DataFrame, history: DataFrame, lookback_us: int = DAY_US) -> DataFrame:
    """K5, scalable form: rolling features for the rows of a micro-batch, one for each transaction id.

    The context of a row is what is stored of its account on its own day and the days that
    ``lookback_us`` reaches back to: (account, day) keys, so a row that is 300 days late brings two days with it,
    not all that lie between. The bucketed operator (``operators.rolling``) computes the windows over
    context and batch, and only batch rows are returned. Exact for any arrival order as long as the
    history holds the earlier rows. When ``history`` is a stored table, only the ``txn_date`` partitions of these days are read.
    """
    from txnwatch.operators.rolling import HOT_ROWS, add_account_rollups

    batch = once_by_id(batch.select(*ROLL_COLUMNS))
    back = -(-int(lookback_us) // DAY_US)
    day = F.to_date("transaction_timestamp")
    reach = batch.select("account_id", F.explode(F.array(*[F.date_sub(day, k) for k in range(back + 1)])).alias("_day"))
    reach = reach.where(F.col("account_id").isNotNull() & F.col("_day").isNotNull()).distinct()
    days = [r[0] for r in reach.select("_day").distinct().collect()]  # of one batch
    stored = F.col("txn_date") if "txn_date" in history.columns else day
    ctx = (
        history.where(stored.isin(days) if days else F.lit(False))
        .select(*ROLL_COLUMNS, stored.alias("_day"))
        .join(reach, ["account_id", "_day"], "left_semi")
        .join(batch.select("transaction_id"), "transaction_id", "left_anti")
        .select(*ROLL_COLUMNS, F.lit(False).alias("_in_batch"))
    )
    together = batch.withColumn("_in_batch", F.lit(True)).unionByName(ctx).checkpoint(eager=True)
    rolled = add_account_rollups(together, hot_rows=HOT_ROWS)
    return rolled.where(F.col("_in_batch")).drop("_in_batch")


def once_by_id(rows: DataFrame, key: str = "transaction_id") -> DataFrame:
    """One row for each id: of several the least one, column by column, so that a repetition gives the same."""
    others = [c for c in rows.columns if c != key]
    least = rows.groupBy(key).agg(F.min(F.struct(*others)).alias("_row"))
    return least.select(*[F.col(c) if c == key else F.col(f"_row.{c}").alias(c) for c in rows.columns])


def _append_new(path: str, batch: DataFrame, layout: dict, derive, key: str = "transaction_id") -> None:
    """Write what ``derive`` makes of the rows whose id is not stored yet, as one snapshot.

    ``derive(new rows, snapshot)`` returns the frames by dataset and the marks; ``layout`` is as in ``snapshots.compact``.
    """
    spark = batch.sparkSession
    base = snapshots.current(spark, path)
    ids = T.StructType([batch.schema[key]])
    rows = once_by_id(batch, key).withColumn("txn_date", F.to_date("transaction_timestamp")).checkpoint(eager=True)
    seen = snapshots.look_up(spark, path, base, rows.select(key), ids)
    new = rows.join(seen, key, "left_anti").checkpoint(eager=True)
    n = new.count()
    if not n:
        return
    frames, marks = derive(new, base)
    name, counts = snapshots.new_name(), {snapshots.KEYS: n}
    for dataset, df in frames.items():
        schema, partition, sort = layout[dataset]
        out = df.select(*schema.names).checkpoint(eager=True)
        counts[dataset] = out.count()
        if counts[dataset]:
            snapshots.write_by(out, path, dataset, name, partition, sort)
    buckets = snapshots.write_keys(new.select(key), key, path, name, n)
    snapshots.publish(spark, path, base, [*base.segments, snapshots.Segment(name, counts, buckets)], base.marks | marks)
    snapshots.compact(spark, path, layout, (ids, key))


def _rolled_layout(schema: T.StructType) -> dict:
    fields = [schema[c] for c in ROLL_COLUMNS]
    fields += [T.StructField(c, T.DoubleType()) for c in ("velocity_1h", "avg_amount_24h")]
    return {"rolled": (T.StructType([*fields, T.StructField("txn_date", T.DateType())]), "txn_date", "transaction_timestamp")}


def append_rollups(root: str):
    """K5: a ``foreachBatch`` function that appends each micro-batch with its rolling features to the
    rolled rows under ``root``, which are also the history of later batches. A row that comes again adds nothing."""
    path = f"{root.rstrip('/')}/rolled"

    def write(batch: DataFrame, epoch_id: int) -> None:
        layout = _rolled_layout(batch.schema)

        def derive(new: DataFrame, base: snapshots.Snapshot):
            history = snapshots.read(new.sparkSession, path, "rolled", base, layout["rolled"][0])
            rolled = rollups_with_history(new, history)
            return {"rolled": rolled.withColumn("txn_date", F.to_date("transaction_timestamp"))}, {}

        _append_new(path, batch.select(*ROLL_COLUMNS), layout, derive)

    return write


def read_rollups(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """Rows with rolling features written so far; empty before the first batch."""
    path = f"{root.rstrip('/')}/rolled"
    return snapshots.read(spark, path, "rolled", snapshots.current(spark, path), _rolled_layout(schema)["rolled"][0])


TREND_COLUMNS = ["transaction_id", "transaction_timestamp", "is_fraud", "is_success", "risk_score"]
_LATE_SCHEMA = T.StructType(
    [
        T.StructField("transaction_id", T.StringType()),
        T.StructField("transaction_timestamp", T.TimestampNTZType()),
        T.StructField("is_fraud", T.IntegerType()),
        T.StructField("is_success", T.IntegerType()),
        T.StructField("risk_score", T.DoubleType()),
        T.StructField("txn_date", T.DateType()),
    ]
)
_SUMS_SCHEMA = T.StructType([f for f in store.TOTALS_SCHEMA.fields if f.name != "channel"])
TREND_LAYOUT = {"sums": (_SUMS_SCHEMA, "txn_date", "total"), "late": (_LATE_SCHEMA, "txn_date", "transaction_timestamp")}
NEWEST = "newest_event_us"


def append_day_sums(root: str, delay_us: int = DAY_US):
    """K4 with corrections: a ``foreachBatch`` function that adds each micro-batch's sums by day.

    Sums of a day add up over the batches, so the trend (``read_day_trend``) always counts every row that has come,
    whenever it came. A row whose day was closed when it came (it ended ``delay_us`` or more before the
    newest event of the earlier batches) is also kept in the side table ``read_late_rows``. A row that comes again adds nothing.
    """
    path = f"{root.rstrip('/')}/trend"

    def write(batch: DataFrame, epoch_id: int) -> None:
        def derive(new: DataFrame, base: snapshots.Snapshot):
            us = micros_ntz("transaction_timestamp")
            fraud, ok = (F.coalesce(F.col(c) == 1, F.lit(False)).cast("bigint") for c in ("is_fraud", "is_success"))
            sums = new.groupBy("txn_date").agg(
                F.count(F.lit(1)).alias("total"), F.sum(fraud).alias("fraud"), F.sum(ok).alias("success"),
                F.coalesce(F.sum("risk_score"), F.lit(0.0)).alias("risk"),
            )
            newest = base.marks.get(NEWEST)
            ends = (F.floor(us / F.lit(DAY_US)) + 1) * F.lit(DAY_US)
            late = new.where(ends + F.lit(int(delay_us)) <= F.lit(newest)) if newest is not None else new.limit(0)
            last = new.agg(F.max(us)).first()[0]
            known = [int(x) for x in (newest, last) if x is not None]
            return {"sums": sums, "late": late}, {NEWEST: max(known)} if known else {}

        _append_new(path, batch.select(*[F.col(c).cast(_LATE_SCHEMA[c].dataType).alias(c) for c in TREND_COLUMNS]), TREND_LAYOUT, derive)

    return write


def read_day_trend(spark: SparkSession, root: str) -> DataFrame:
    """F2 over all rows that have come so far."""
    from txnwatch.plans.monitoring import trend_from_totals

    path = f"{root.rstrip('/')}/trend"
    return trend_from_totals(snapshots.read(spark, path, "sums", snapshots.current(spark, path), _SUMS_SCHEMA))


def read_late_rows(spark: SparkSession, root: str) -> DataFrame:
    """Rows that came after their day was closed; they are in the trend."""
    path = f"{root.rstrip('/')}/trend"
    return snapshots.read(spark, path, "late", snapshots.current(spark, path), _LATE_SCHEMA)


def write_time_ordered_files(df: DataFrame, path: str, ts: str = "transaction_timestamp", files: int = 8) -> None:
    """Lay out rows as up to ``files`` Parquet files, each a contiguous time range.

    A file stream takes files by modification time, so the files get the times of their order.
    """
    spark = df.sparkSession
    df.repartitionByRange(files, ts).sortWithinPartitions(ts).write.mode("overwrite").parquet(path)
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = sorted((f for f in fs.listStatus(hpath) if f.getPath().getName().startswith("part-")), key=lambda f: f.getPath().getName())
    last = max((f.getModificationTime() for f in parts), default=0)
    for n, f in enumerate(parts):
        fs.setTimes(f.getPath(), last - 1000 * (len(parts) - n), -1)


def stream_source(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def _finish(writer, checkpoint: str) -> int:
    """Run over all available input; the number of micro-batches that had rows."""
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return len({p["batchId"] for p in q.recentProgress if p["numInputRows"]})


def run_available(query_df: DataFrame, sink_path: str, checkpoint: str, mode: str = "append") -> int:
    """Run a streaming query over all available input to a Parquet sink."""
    return _finish(query_df.writeStream.format("parquet").option("path", sink_path).outputMode(mode), checkpoint)


def run_batches(stream: DataFrame, write, checkpoint: str) -> int:
    """Run a ``foreachBatch`` function over all available input."""
    return _finish(stream.writeStream.foreachBatch(write), checkpoint)
