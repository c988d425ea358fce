"""Rolling windows: frame edges, ties, NULLs, bucket-size independence, brute force."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from txnwatch.operators.rolling import account_window_stats, add_account_rollups, hot_buckets
from txnwatch.schema import DAY_US, HOUR_US
from txnwatch.sources.tables import read_table

from conftest import SF_SMALL

T0 = dt.datetime(2024, 1, 1, 10, 0, 0)
US = dt.timedelta(microseconds=1)
SCHEMA = "transaction_id string, account_id long, transaction_timestamp timestamp_ntz, Amount double"


def rollups(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    out = add_account_rollups(df, **kw).orderBy("transaction_id").collect()
    return {r.transaction_id: (r.velocity_1h, r.avg_amount_24h) for r in out}


def test_window_edges(spark):
    rows = [
        ("a", 1, T0, 10.0),
        ("b", 1, T0 + dt.timedelta(hours=1) - US, 20.0),
        ("c", 1, T0 + dt.timedelta(hours=1), 30.0),
        ("d", 1, T0 + dt.timedelta(hours=24), 40.0),
        ("e", 2, T0, 99.0),
    ]
    got = rollups(spark, rows)
    assert got["a"] == (1.0, 10.0)
    assert got["b"] == (2.0, 15.0)  # 1h - 1us apart: inside
    assert got["c"] == (2.0, 20.0)  # exactly 1h apart: a is out of the 1h frame, in the 24h frame
    assert got["d"] == (1.0, 30.0)  # exactly 24h after a: a is out; b, c, d in
    assert got["e"] == (1.0, 99.0)  # other account


def test_ties_are_taken_one_by_one(spark):
    rows = [("t2", 1, T0, 2.0), ("t1", 1, T0, 1.0), ("t3", 1, T0, 3.0)]
    got = rollups(spark, rows)
    assert got == {"t1": (1.0, 1.0), "t2": (2.0, 1.5), "t3": (3.0, 2.0)}


def test_null_amounts(spark):
    rows = [("a", 1, T0, None), ("b", 1, T0 + dt.timedelta(minutes=1), 4.0), ("c", 2, T0, None)]
    got = rollups(spark, rows)
    assert got["a"][0] == 0.0 and got["a"][1] is None
    assert got["b"] == (1.0, 4.0)
    assert got["c"][0] == 0.0


def brute_force(pdf, window_us):
    out = {}
    for _, g in pdf.groupby("account"):
        g = g.sort_values(["us", "key"])
        us, keys, amt = g["us"].tolist(), g["key"].tolist(), g["amt"].tolist()
        for i in range(len(g)):
            frame = [amt[j] for j in range(i + 1) if us[j] > us[i] - window_us]
            frame = [a for a in frame if a is not None and a == a]
            out[keys[i]] = (len(frame), sum(frame) / len(frame) if frame else None)
    return out


@pytest.mark.parametrize("how", [{"bucket_us": 30 * DAY_US}, {"bucket_us": 41 * DAY_US}, {"split": True}])
def test_matches_brute_force_with_ties(spark, how):
    o = read_table(spark, SF_SMALL, "orders").select(
        F.col("o_orderkey").alias("key"),
        (F.col("o_custkey") % 5).alias("account"),
        F.col("o_orderdate").alias("ts"),
        F.col("o_totalprice").alias("amt"),
    )
    window = 30 * DAY_US
    got = account_window_stats(o, {"w": window}, account="account", ts="ts", amount="amt", tie="key",
                               **how).collect()
    pdf = o.toPandas()
    pdf["us"] = (pdf["ts"] - pd.Timestamp("1970-01-01")) // pd.Timedelta(microseconds=1)
    exp = brute_force(pdf, window)
    assert pdf.duplicated(["account", "us"]).any()  # the fixture has ties
    for r in got:
        n, mean = exp[r.key]
        assert r.w_count == n
        assert abs(float(r.w_sum) / n - mean) < 1e-9 * max(1.0, abs(mean))


def test_rows_without_account_or_time_and_all_digits(spark):
    rows = [
        ("a", None, T0, 1.0),
        ("b", 1, None, 2.0),
        ("c", 1, T0, 0.00003),
        ("d", 1, T0 + US, 0.00004),
        ("e", 2, T0, 3e14),
        ("f", 2, T0 + US, 0.5),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.transaction_id: r for r in account_window_stats(df, {"w": HOUR_US}).collect()}
    assert got["a"].w_count is None and got["b"].w_sum is None
    assert float(got["d"].w_sum) == 0.00007 and got["d"].w_count == 2
    assert str(got["f"].w_sum) == "300000000000000.500000000000"


def test_hot_hour_by_global_prefix_sums(spark):
    """One account-hour with every row: the split form gives the same and no group holds it."""
    rows = [(f"x{i:05d}", 7, T0 + dt.timedelta(seconds=i % 1700), float(i % 13)) for i in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert hot_buckets(df, HOUR_US, 100).count() == 1
    plain = account_window_stats(df, {"w": HOUR_US // 6}).orderBy("transaction_id").collect()
    split = account_window_stats(df, {"w": HOUR_US // 6}, split=True)
    assert split.orderBy("transaction_id").collect() == plain


def test_hot_account_is_split_across_buckets(spark):
    """One account holding every row: groups follow (account, day)."""
    rows = [(f"x{i:05d}", 7, T0 + dt.timedelta(minutes=7 * i), float(i % 13)) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = add_account_rollups(df).collect()
    assert len(out) == 3000
    # 1h window holds at most ceil(60 / 7) rows at 7-minute spacing
    assert max(r.velocity_1h for r in out) == 9.0


def test_a_hot_account_is_measured_and_spread(spark):
    """One account has a third of all rows, on one day; NULL accounts and times stay."""
    rows = [(f"t{n:05d}", 7 if n % 3 == 0 else n % 40, T0 + n * 500_000 * US, float(n % 11)) for n in range(6000)]
    rows += [("x1", None, T0, 1.0), ("x2", 7, None, 2.0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(8).checkpoint()
    assert [r["account_id"] for r in hot_buckets(df, DAY_US, 1000).collect()] == [7]
    plain, split = add_account_rollups(df), add_account_rollups(df, hot_rows=1000)
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, split.collect()), key=str)
    tasks = split.where("account_id = 7").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) >= 4 and max(r["count"] for r in tasks) < 1200
    assert "Union" in split._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in add_account_rollups(df, hot_rows=10_000)._jdf.queryExecution().executedPlan().toString()


def test_tasks_grow_with_the_bytes(spark, monkeypatch):
    """Where many bytes are read, (account, bucket) groups go to more tasks than the least; results stay."""
    from txnwatch.operators import rolling

    df = spark.range(400).select(
        F.format_string("t%04d", "id").alias("transaction_id"), (F.col("id") % 5).alias("account_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 1000).cast("timestamp_ntz").alias("transaction_timestamp"),
        (F.col("id") % 9).cast("double").alias("Amount"),
    ).checkpoint()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = add_account_rollups(df).orderBy("transaction_id").collect()
    monkeypatch.setattr(rolling, "TASK_BYTES", 400)
    many = add_account_rollups(df)
    dealt = many._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [account_id" in dealt and many.rdd.getNumPartitions() > least
    assert many.orderBy("transaction_id").collect() == plain


def test_few_tasks_are_dealt_finer_and_markers_carry_no_texts(spark, monkeypatch):
    """A task's memory: more tasks from small inputs on, up to a number, and texts only on the rows themselves."""
    from txnwatch.operators import rolling

    df = spark.range(300).select(
        F.format_string("t%04d", "id").alias("transaction_id"), (F.col("id") % 5).alias("account_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 1000).cast("timestamp_ntz").alias("transaction_timestamp"),
        (F.col("id") % 9).cast("double").alias("Amount"), F.lit("a long text").alias("text"),
    ).checkpoint()
    marked = rolling._marked(df, {"w": HOUR_US}, "account_id", "transaction_timestamp", "Amount", "transaction_id", DAY_US)
    texts = {(r["_kind"], r["text"]) for r in marked.select("_kind", "text").distinct().collect()}
    assert texts == {(0, "a long text"), (1, None), (-1, None)}
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = add_account_rollups(df).orderBy("transaction_id").collect()
    monkeypatch.setattr(rolling, "FINE_BYTES", 400)
    many = add_account_rollups(df)
    assert many.rdd.getNumPartitions() > least + 5
    assert many.orderBy("transaction_id").collect() == plain
    monkeypatch.setattr(rolling, "FINE_TASKS", least + 5)
    assert add_account_rollups(df).rdd.getNumPartitions() == least + 5


def test_markers_are_made_behind_the_exchange(spark):
    """The task that deals rows out holds what it sends: a row and its context, which is without texts, but no markers."""
    from txnwatch.operators import rolling

    names = ("account_id", "transaction_timestamp", "Amount", "transaction_id")
    df = spark.range(200).select(
        F.format_string("t%04d", "id").alias("transaction_id"), F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("account_id"),
        F.when(F.col("id") % 11 > 0, F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 1000)).cast("timestamp_ntz").alias("transaction_timestamp"),
        (F.col("id") % 9).cast("double").alias("Amount"), F.lit("a long text").alias("text"),
    ).checkpoint()
    plan = add_account_rollups(df)._jdf.queryExecution().optimizedPlan().toString()
    behind, _, sent = plan.partition("RepartitionByExpression [account_id")
    assert behind.count("Generate explode") == 1 and sent.count("Generate explode") == 1
    copies = rolling._copied(df, DAY_US, *names)
    assert copies.count() == 2 * df.count()
    assert copies.where("_ctx = 1 and (text is not null or transaction_id is not null)").isEmpty()
    kinds = rolling._marked(df, {"w": HOUR_US, "d": DAY_US}, *names, DAY_US).groupBy("_kind").count().collect()
    assert {r["_kind"]: r["count"] for r in kinds} == {k: 200 for k in (-1, 0, 1, 2)}
