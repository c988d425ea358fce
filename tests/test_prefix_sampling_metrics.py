"""Prefix sums, exact quantiles, sampling, splitting and metrics against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnwatch.functions.draws import keyed_uniform
from txnwatch.operators import metrics as M
from txnwatch.operators.prefix import PARTITION_BYTES, exact_quantile, partitions_for, prefix_sums, row_numbers
from txnwatch.operators.sampling import split_allocation, stratified_sample, stratified_split
from txnwatch.sources.fixtures import raw_from_events
from txnwatch.sources.tables import read_table

from conftest import SF_SMALL


@pytest.mark.parametrize("parts", [3, 8])
def test_prefix_sums_match_cumsum(spark, parts):
    ev = read_table(spark, SF_SMALL, "events").select("event_id", "ts", "value")
    got = prefix_sums(ev, ["ts", "event_id"], {"cum": F.col("value"), "n": F.lit(1).cast("bigint")}, parts)
    pdf = got.toPandas().sort_values(["ts", "event_id"])
    ref = ev.toPandas().sort_values(["ts", "event_id"])
    assert np.allclose(pdf["cum"].to_numpy(), ref["value"].cumsum().to_numpy())
    assert (pdf["n"].to_numpy() == np.arange(1, len(ref) + 1)).all()


def test_row_numbers_hot_leading_value(spark):
    df = spark.range(5000).select(F.lit(1).alias("hot"), F.col("id"))
    got = row_numbers(df, ["hot", "id"], "rn", 8).toPandas().sort_values("id")
    assert (got["rn"].to_numpy() == np.arange(1, 5001)).all()


def test_whole_sums_take_no_second_exchange(spark):
    """One value of the leading column for all rows: the sums are those of the sorted order, in balanced partitions."""
    df = spark.range(6000).select(F.lit(1).alias("hot"), "id", F.when(F.col("id") % 7 > 0, F.col("id") % 5).cast("int").alias("v"))
    got = prefix_sums(df, ["hot", F.col("id").desc()], {"cum": F.col("v"), "n": F.lit(1)}, 8)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan
    rows = got.withColumn("part", F.spark_partition_id()).toPandas().sort_values("id", ascending=False)
    assert (rows["cum"].to_numpy() == rows["v"].fillna(0).cumsum().to_numpy()).all()
    assert (rows["n"].to_numpy() == np.arange(1, 6001)).all()
    assert rows["part"].value_counts().max() < 2 * 6000 / 8
    assert prefix_sums(df.limit(0), ["id"], {"cum": F.col("v")}, 4).count() == 0


def test_partitions_grow_with_the_bytes(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert partitions_for(spark.range(10)) == least
    large = spark.range(PARTITION_BYTES)  # 8 bytes a row, never run
    assert partitions_for(large.select("id")) in (8, 9) or partitions_for(large) == least > 9
    assert partitions_for(large.crossJoin(large)) <= max(least, 18)
    huge = spark.range(100 * PARTITION_BYTES)
    assert 800 <= partitions_for(huge) <= 900


def test_partitions_of_a_checkpointed_join_follow_its_rows(spark):
    """Without column statistics a join is estimated as the product of its sides, and a checkpoint keeps that estimate."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    joined = spark.range(20_000).join(spark.range(20_000).withColumn("v", F.col("id") * 2), "id").checkpoint()
    assert partitions_for(joined) == least
    assert row_numbers(joined, ["id"]).where("row_number = id + 1").count() == 20_000


def test_exact_quantile_matches_numpy(spark):
    ev = read_table(spark, SF_SMALL, "events").select("event_id", "value")
    vals = ev.toPandas()["value"].to_numpy()
    for q in (0.0, 0.02, 0.5, 0.99, 1.0):
        assert abs(exact_quantile(ev, "value", q) - np.percentile(vals, 100 * q)) < 1e-9


def test_stratified_sample(spark):
    raw = raw_from_events(read_table(spark, SF_SMALL, "events"))
    pdf = raw.withColumn("u", keyed_uniform("sample42", "event_id")).toPandas()
    n_fraud = int((pdf["Class"] == 1).sum())
    got = stratified_sample(raw, 300).toPandas()
    assert len(got) == 300
    assert int((got["Class"] == 1).sum()) == n_fraud
    exp = pdf[pdf["Class"] == 0].sort_values(["u", "event_id"]).head(300 - n_fraud)["event_id"]
    assert set(got[got["Class"] == 0]["event_id"]) == set(exp)
    assert stratified_sample(raw, 10_000).count() == len(pdf)  # size >= rows: everything
    assert stratified_sample(raw, 1).count() == n_fraud  # fraud alone exceeds the size
    with pytest.raises(ValueError):
        stratified_sample(raw, 0)


def test_sample_of_many_frauds_keeps_other_rows(spark):
    rows = spark.range(90).select(F.col("id").alias("event_id"), (F.col("id") % 3 > 0).cast("int").alias("Class"))
    for size, least, other in ((40, 20, 20), (40, 50, 30), (70, 20, 20), (75, 5, 15), (40, 0, 0)):
        got = {r[0]: r[1] for r in stratified_sample(rows, size, least_other=least).groupBy("Class").count().collect()}
        assert got == {1: 60} | ({0: other} if other else {})


def test_stratified_split(spark):
    raw = raw_from_events(read_table(spark, SF_SMALL, "events"))
    sp = stratified_split(raw, "Class", "event_id")
    tr, te = sp.train.toPandas(), sp.test.toPandas()
    assert set(tr["event_id"]).isdisjoint(te["event_id"])
    assert len(tr) + len(te) == raw.count()
    counts = te.groupby("Class").size().to_dict()
    assert counts == {k: v for k, v in sp.allocation.items() if v}
    assert sum(sp.allocation.values()) == int(np.ceil(0.2 * raw.count()))


def test_allocation_guards():
    with pytest.raises(ValueError):
        split_allocation({0: 100})
    with pytest.raises(ValueError):
        split_allocation({0: 100, 1: 1})
    assert split_allocation({0: 98, 1: 2}) == {0: 20, 1: 0}
    assert split_allocation({0: 9788, 1: 212}) == {0: 1958, 1: 42}


def brute_auc(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y == 1]
    neg = [s for s, y in zip(scores, labels) if y != 1]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


def test_auc_and_ap(spark):
    rows = [(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 0), (0.2, 0), (0.1, 1), (0.1, 0)]
    df = spark.createDataFrame(rows, "s double, y int")
    auc = M.roc_auc(df, "s", "y").first()[0]
    assert abs(auc - brute_auc(*zip(*rows))) < 1e-12
    three = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1)], "s double, y int")
    assert abs(M.average_precision(three, "s", "y").first()[0] - (0.5 * 1.0 + 0.5 * 2.0 / 3.0)) < 1e-12


def test_metric_guards(spark):
    one_class = spark.createDataFrame([(0.3, 0), (0.6, 0)], "s double, y int")
    assert np.isnan(M.roc_auc(one_class, "s", "y").first()[0])
    assert np.isnan(M.average_precision(one_class, "s", "y").first()[0])
    r = M.classification_metrics(one_class, "s", "y").first()
    assert (r.precision, r.recall, r.f1_score) == (0.0, 0.0, 0.0)
