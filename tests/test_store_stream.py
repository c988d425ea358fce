"""Monitoring store round trip, idempotent appends, constraints, streams = batch."""

import os
import tempfile

from pyspark.sql import functions as F

from txnwatch.plans import monitoring as mon
from txnwatch.sources import snapshots, store
from txnwatch.sources.fixtures import fixture_views, predictions_from_transactions
from txnwatch.sources.tables import read_table
from txnwatch.streaming import live

from conftest import SF_SMALL


def _views(spark):
    return fixture_views(read_table(spark, SF_SMALL, "events"))


def test_round_trip_and_constraints(spark):
    txn, pred = _views(spark)
    root = tempfile.mkdtemp(prefix="store-")
    store.write_monitoring_data(txn, pred, root, check=True)
    tx, pr = store.read_monitoring_tables(spark, root)
    assert tx.count() == txn.count() and pr.count() == pred.count()
    assert pr.select("prediction_id").distinct().count() == pr.count()
    assert store.validate(tx, pr) == {"pk_violations": 0, "tx_null_violations": 0, "pred_null_violations": 0,
                                      "fk_orphans": 0}
    a = mon.fraud_trend(tx, pr).collect()
    b = mon.fraud_trend(txn, pred).collect()
    assert a == b
    # a filter on the partition column reads one day of files only
    day = tx.where(F.col("txn_date") == F.lit("2024-01-05").cast("date"))
    names = [r[0] for r in day.select(F.input_file_name()).distinct().collect()]
    assert names and all("txn_date=2024-01-05" in n for n in names)


def test_append_is_idempotent(spark):
    txn, _ = _views(spark)
    root = tempfile.mkdtemp(prefix="append-")
    part = txn.where(F.col("event_id") < 500)
    first = store.append_live_predictions(part, predictions_from_transactions(part), root)
    again = store.append_live_predictions(part, predictions_from_transactions(part), root)
    tx, pr = store.read_monitoring_tables(spark, root)
    assert first == 500 and again == 0
    assert tx.count() == 500 and pr.count() == predictions_from_transactions(part).count()


def test_stream_trend_multi_batch_equals_batch(spark):
    txn, pred = _views(spark)
    rows = mon.monitoring_frame(txn, pred).checkpoint()
    root = tempfile.mkdtemp(prefix="trend-")
    live.write_time_ordered_files(rows, f"{root}/source", files=6)
    src = live.stream_source(spark, f"{root}/source", rows.schema, files_per_trigger=1)
    assert live.run_available(live.daily_trend_stream(src), f"{root}/sink", f"{root}/ckpt") == 6
    got = {r.txn_date: r for r in spark.read.parquet(f"{root}/sink").collect()}
    exp = {r.txn_date: r for r in mon.fraud_trend(txn, pred).collect()}
    assert got and set(got) < set(exp)
    for d, r in got.items():
        assert r.asDict() == exp[d].asDict()


def test_stream_rollups_equal_batch_over_several_triggers(spark):
    txn, _ = _views(spark)
    rows = txn.select(*live.ROLL_COLUMNS).checkpoint()
    root = tempfile.mkdtemp(prefix="roll-")
    live.write_time_ordered_files(rows, f"{root}/source", files=6)
    src = live.stream_source(spark, f"{root}/source", rows.schema, files_per_trigger=1)
    assert live.run_batches(src, live.append_rollups(root), f"{root}/ckpt") == 6
    rolled = live.read_rollups(spark, root, rows.schema)
    got = {r.transaction_id: (r.velocity_1h, r.avg_amount_24h) for r in rolled.collect()}
    exp = {r.transaction_id: (r.velocity_1h, r.avg_amount_24h) for r in txn.collect()}
    assert got == exp


def test_a_model_scores_a_stream_and_bad_rows_are_kept(spark):
    from txnwatch.plans import training
    from txnwatch.sources.fixtures import raw_from_events

    txn, _ = _views(spark)
    raw = raw_from_events(read_table(spark, SF_SMALL, "events"))
    root = tempfile.mkdtemp(prefix="model-")
    training.run_training(spark, raw, root, sample_size=500)
    bundle = training.load_models(spark, root)
    assert training.load_metadata(spark, root)["numeric_features"]
    rows = txn.withColumn("Amount", F.when(F.col("event_id") % 10 == 0, F.lit(-1.0)).otherwise(F.col("Amount"))).checkpoint()
    live.write_time_ordered_files(rows, f"{root}/source", files=5)
    src = live.stream_source(spark, f"{root}/source", rows.schema, files_per_trigger=1)
    write = live.append_to_store(f"{root}/live", lambda df: training.score_transactions(df, bundle))
    assert live.run_batches(src, write, f"{root}/ckpt") == 5
    tx, pr = store.read_monitoring_tables(spark, f"{root}/live")
    bad = live.read_quarantine(spark, f"{root}/live")
    assert bad.count() == 100 and tx.count() == pr.count() == 900
    joined = tx.join(pr, "transaction_id")
    assert joined.where((F.col("decision") != "block") != (F.col("is_success") == 1)).count() == 0
    assert tx.where(F.col("is_fraud").isNotNull()).count() == 0


def test_ids_are_not_reused_after_a_lost_write(spark, monkeypatch):
    import pytest

    txn, _ = _views(spark)
    root = tempfile.mkdtemp(prefix="marks-")
    for n, part in enumerate((txn.where("event_id < 500"), txn.where("event_id >= 500"))):
        if n:
            with monkeypatch.context() as m, pytest.raises(RuntimeError, match="lost"):
                m.setattr(snapshots, "publish", _lost)
                store.append_live_predictions(part, predictions_from_transactions(part), root)
        store.append_live_predictions(part, predictions_from_transactions(part), root)
    tx, pr = store.read_monitoring_tables(spark, root)
    assert tx.count() == txn.count()
    assert pr.count() == pr.select("prediction_id").distinct().count() == predictions_from_transactions(txn).count()


def _lost(*_args, **_kwargs):
    raise RuntimeError("lost")


def _state(spark, root):
    return [sorted(map(tuple, t.collect()), key=repr) for t in (*store.read_monitoring_tables(spark, root), store.read_totals(spark, root))]


def test_a_write_that_dies_between_the_tables_changes_nothing(spark, monkeypatch):
    import pytest

    txn, pred = _views(spark)
    root = tempfile.mkdtemp(prefix="crash-")
    store.write_monitoring_data(txn.where("event_id < 300"), pred.join(txn.where("event_id < 300"), "transaction_id", "left_semi"), root)
    before = _state(spark, root)
    part = txn.where("event_id >= 300")
    whole = snapshots.write_by

    def dies_at(dataset):
        def write(df, root, name, *rest):
            if name == dataset:
                raise RuntimeError("lost")
            return whole(df, root, name, *rest)

        return write

    for dataset in (store.PRED, store.TOTALS):
        for write in (lambda: store.append_live_predictions(part, predictions_from_transactions(part), root),
                      lambda: store.write_monitoring_data(txn, pred, root)):
            with monkeypatch.context() as m, pytest.raises(RuntimeError, match="lost"):
                m.setattr(snapshots, "write_by", dies_at(dataset))
                write()
            assert _state(spark, root) == before
    assert store.append_live_predictions(part, predictions_from_transactions(part), root) == part.count()
    tx, pr = store.read_monitoring_tables(spark, root)
    assert tx.count() == txn.count() and pr.count() == pred.count()


def test_the_second_of_two_writers_is_refused(spark, monkeypatch):
    import pytest

    txn, _ = _views(spark)
    root = tempfile.mkdtemp(prefix="race-")
    one, other = txn.where("event_id < 10"), txn.where("event_id between 10 and 19")
    store.initialize_store(spark, root)
    stale = snapshots.current(spark, root)
    store.append_live_predictions(one, predictions_from_transactions(one), root)
    with monkeypatch.context() as m, pytest.raises(snapshots.ConflictError):
        m.setattr(snapshots, "current", lambda *_: stale)
        store.append_live_predictions(other, predictions_from_transactions(other), root)
    assert store.read_monitoring_tables(spark, root)[0].count() == 10
    assert store.append_live_predictions(other, predictions_from_transactions(other), root) == 10


def _bytes_opened(df) -> int:
    return sum(os.path.getsize(f.removeprefix("file:").replace("///", "/")) for f in df.inputFiles())


def test_a_look_up_reads_the_same_however_large_the_store_is(spark, monkeypatch):
    from txnwatch.sources.tables import read_table

    monkeypatch.setattr(snapshots, "BUCKET_ROWS", 64)
    txn, _ = fixture_views(read_table(spark, "/root/testdata/sf0.01", "events"))
    txn = txn.checkpoint()
    ids = spark.createDataFrame([(f"TXN{n:08d}",) for n in (7, 900001, 900002)], "transaction_id string")
    opened, whole = [], []
    for rows in (2048, 4096, 8192):
        root = tempfile.mkdtemp(prefix="flat-")
        part = txn.where(F.col("event_id") < rows)
        store.append_live_predictions(part, predictions_from_transactions(part), root)
        snapshot = snapshots.current(spark, root)
        found = snapshots.look_up(spark, root, snapshot, ids, store.KEY_SCHEMA)
        assert {r["transaction_id"] for r in found.collect()} == {"TXN00000007"}
        opened.append(_bytes_opened(found))
        whole.append(_bytes_opened(snapshots.read(spark, root, snapshots.KEYS, snapshot, store.KEY_SCHEMA)))
    assert whole[2] > 3 * whole[0]
    assert max(opened) < 1.2 * min(opened) and max(opened) < whole[0] / 5


def test_small_segments_are_merged_and_old_snapshots_expire(spark):
    txn, _ = _views(spark)
    root = tempfile.mkdtemp(prefix="merge-")
    for n in range(6):
        part = txn.where(F.col("event_id") % 6 == n)
        store.append_live_predictions(part, predictions_from_transactions(part), root)
    before = _state(spark, root)[:2]
    assert len(snapshots.current(spark, root).segments) == 6
    assert store.compact_store(spark, root, most=3) == 6
    assert len(snapshots.current(spark, root).segments) == 1
    assert _state(spark, root)[:2] == before
    assert len(os.listdir(f"{root}/transactions")) == 7  # readers of older snapshots go on
    assert snapshots.expire(spark, root, keep=1) == 6
    assert len([f for f in os.listdir(f"{root}/transactions") if f.startswith("seg=")]) == 1
    assert len([f for f in os.listdir(f"{root}/_snapshots") if f.endswith(".json")]) == 1
    again = txn.where("event_id < 50")
    assert store.append_live_predictions(again, predictions_from_transactions(again), root) == 0
    assert _state(spark, root)[:2] == before


def test_totals_equal_the_joined_tables(spark):
    txn, _ = _views(spark)
    root = tempfile.mkdtemp(prefix="totals-")
    later = txn.where("event_id % 7 = 0")
    store.append_live_predictions(txn.where("event_id < 400"), predictions_from_transactions(txn.where("event_id < 400 and event_id % 7 <> 0")), root)
    store.append_live_predictions(txn.where("event_id >= 400"), predictions_from_transactions(txn), root)
    for _ in range(2):
        store.append_live_predictions(later, predictions_from_transactions(later), root, run="second")
    store.append_live_predictions(later.limit(0), predictions_from_transactions(later), root, run="third")
    tx, pr = store.read_monitoring_tables(spark, root)
    totals = store.read_totals(spark, root)
    assert mon.overview_from_totals(totals).collect() == mon.overview_kpis(tx, pr).collect()
    assert mon.trend_from_totals(totals).collect() == mon.fraud_trend(tx, pr).collect()
    assert sorted(mon.channels_from_totals(totals).collect()) == sorted(mon.channel_success_rates(tx, pr).collect())
    plan = mon.trend_from_totals(totals)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "transactions" not in plan.split("FileScan")[1].split("Location")[1][:80]


def test_orphans_and_missing_values_are_refused(spark):
    import pytest

    txn, pred = _views(spark)
    root = tempfile.mkdtemp(prefix="refuse-")
    with pytest.raises(ValueError, match="fk_orphans"):
        store.append_live_predictions(txn.where("event_id < 10"), pred, root)
    with pytest.raises(ValueError, match="null_violations"):
        store.write_monitoring_data(txn.withColumn("channel", F.lit(None).cast("string")), pred, root)


def test_rollups_with_history_equal_whole_table(spark):
    txn, _ = _views(spark)
    cols = ["transaction_id", "account_id", "transaction_timestamp", "Amount"]
    rows = txn.select(*cols, "event_id", "velocity_1h", "avg_amount_24h")
    # arrival order differs from time order: history is every third event
    history = rows.where(F.col("event_id") % 3 != 0).select(*cols)
    batch = rows.where(F.col("event_id") % 3 == 0).select(*cols)
    got = {r.transaction_id: (r.velocity_1h, r.avg_amount_24h) for r in live.rollups_with_history(batch, history).collect()}
    exp = {r.transaction_id: (r.velocity_1h, r.avg_amount_24h)
           for r in rows.where(F.col("event_id") % 3 == 0).collect()}
    assert got.keys() == exp.keys() and len(got) > 0
    for k, (v, a) in exp.items():
        assert got[k][0] == v and abs(got[k][1] - a) < 1e-9


def test_append_with_rollups_from_store(spark):
    txn, _ = _views(spark)
    root = tempfile.mkdtemp(prefix="hist-")
    write = live.append_to_store(root, predictions_from_transactions, rollups_from_store=True)
    first = txn.where(F.col("event_id") < 600)
    second = txn.where(F.col("event_id") >= 600).withColumn("velocity_1h", F.lit(-1.0))  # inputs are ignored
    write(first, 0)
    write(second, 1)
    write(second, 1)  # replay adds nothing
    tx, _ = store.read_monitoring_tables(spark, root)
    got = {r.transaction_id: r.velocity_1h for r in tx.collect()}
    assert live.read_quarantine(spark, root).count() == 0
    exp = {r.transaction_id: r.velocity_1h for r in txn.collect()}
    assert got == exp


def test_a_row_many_days_late_reads_two_days(spark):
    rows = spark.sql(
        "SELECT concat('h', id) AS transaction_id, id % 3 AS account_id, cast(id AS double) AS Amount, "
        "timestamp_ntz'2023-01-01 12:00:00' + make_dt_interval(cast(id AS int)) AS transaction_timestamp FROM range(400)"
    ).select(*live.ROLL_COLUMNS)
    root = tempfile.mkdtemp(prefix="late-")
    write = live.append_rollups(root)
    write(rows, 0)
    stored = live.read_rollups(spark, root, rows.schema)
    late = spark.sql(
        "SELECT * FROM VALUES ('late', 1L, 5.0D, timestamp_ntz'2023-04-11 12:30:00'), ('new', 2L, 1.0D, timestamp_ntz'2024-02-04 13:00:00') "
        "AS t(transaction_id, account_id, Amount, transaction_timestamp)"
    ).select(*live.ROLL_COLUMNS)
    seen = []
    history = stored.where("txn_date is not null")

    class Watched:
        """The history, noting what is read of it."""

        columns = history.columns

        def where(self, condition):
            out = history.where(condition)
            seen.extend(r[0] for r in out.select("txn_date").distinct().collect())
            return out

    got = {r.transaction_id: (r.velocity_1h, r.avg_amount_24h) for r in live.rollups_with_history(late, Watched()).collect()}
    assert sorted(map(str, seen)) == ["2023-04-10", "2023-04-11", "2024-02-03", "2024-02-04"]
    assert got["late"] == (2.0, 52.5) and got["new"][0] == 1.0
    plan = history.where(F.col("txn_date").isin(seen))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan


def test_a_row_twice_in_a_batch_counts_once(spark):
    rows = spark.sql(
        "SELECT * FROM VALUES ('a', 1L, 5.0D, timestamp_ntz'2024-01-01 10:00:00'), ('a', 1L, 5.0D, timestamp_ntz'2024-01-01 10:00:00'), "
        "('b', 1L, 7.0D, timestamp_ntz'2024-01-01 10:30:00') AS t(transaction_id, account_id, Amount, transaction_timestamp)"
    ).select(*live.ROLL_COLUMNS)
    root = tempfile.mkdtemp(prefix="twice-")
    write = live.append_rollups(root)
    for epoch in (0, 0, 1):
        write(rows, epoch)
    got = [(r.transaction_id, r.velocity_1h) for r in live.read_rollups(spark, root, rows.schema).orderBy("transaction_id").collect()]
    assert got == [("a", 1.0), ("b", 2.0)]


def test_late_rows_correct_the_trend_and_are_kept(spark):
    txn, pred = _views(spark)
    rows = mon.monitoring_frame(txn, pred).checkpoint()
    root = tempfile.mkdtemp(prefix="sums-")
    write = live.append_day_sums(root)
    late = F.col("transaction_id").isin([f"TXN{n:08d}" for n in range(1, 60)])  # of the first days
    write(rows.where(~late), 0)
    assert live.read_late_rows(spark, root).count() == 0
    write(rows.where(late), 1)
    write(rows.where(late), 1)
    assert live.read_day_trend(spark, root).collect() == mon.fraud_trend(txn, pred).collect()
    assert live.read_late_rows(spark, root).count() == 59


def test_first_append_keeps_one_row_of_each_key(spark):
    """Keys that come twice in a batch are stored once, in a store that is empty and in one that is not."""
    txn, _ = _views(spark)
    part = txn.where("event_id < 60").checkpoint()
    twice = part.unionByName(part.where("event_id < 20"))
    root = tempfile.mkdtemp(prefix="once-")
    assert store._one_each(part, ["transaction_id"]).count() == 60 == store._one_each(twice, ["transaction_id"]).count()
    assert store.append_live_predictions(twice, predictions_from_transactions(twice), root) == 60
    assert store.append_live_predictions(twice, predictions_from_transactions(twice), root, run="second") == 0
    tx, pr = store.read_monitoring_tables(spark, root)
    assert tx.count() == 60 and pr.count() == 2 * predictions_from_transactions(part).count()


def test_sums_of_new_rows_need_no_join(spark):
    """What a write adds to the sums comes from rows that carry their transaction: as the joined form says, without a join."""
    day = "DATE'2024-01-01' AS txn_date"
    facts = spark.range(6).selectExpr("concat('t', id) AS transaction_id", day, "if(id < 3, 'web', 'pos') AS channel",
                                      "CAST(id % 2 AS INT) AS is_fraud", "CAST(1 AS INT) AS is_success", "id < 4 AS is_new",
                                      "timestamp_ntz'2024-01-01 00:00:00' AS transaction_timestamp")
    pairs = [("t0", 1.0), ("t0", 2.0), ("t1", 4.0), ("t4", 8.0), ("t5", 16.0), ("t5", 32.0), (None, 64.0)]
    pred = spark.createDataFrame(pairs, "transaction_id string, risk_score double")
    had = spark.createDataFrame([("t4", 2)], "transaction_id string, had bigint")
    carried = store._with_facts(pred, facts).checkpoint()
    new = facts.where("is_new").checkpoint()
    rows = lambda df: sorted(map(tuple, df.select("channel", "total", "fraud", "success", "risk").collect()))
    touched = facts.where("is_new OR transaction_id IN ('t4', 't5')")
    assert rows(store._sums_of_new(new, carried, had)) == rows(store._added_totals(touched, pred, had))
    first = store._sums_of_new(new, carried)
    assert "Join" not in first._jdf.queryExecution().executedPlan().toString()
