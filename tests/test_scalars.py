"""Scalar helpers on inline rows: timestamp parsing, clipping, ids, draws."""

import datetime as dt

from pyspark.sql import functions as F

from txnwatch.functions.draws import keyed_uniform, weighted_choice
from txnwatch.functions.scalars import clip, offset_timestamp, parse_timestamp, ratio_with_epsilon, ratio_with_floor


def test_parse_timestamp_tolerant(spark):
    rows = [("2024-01-01 00:00:00",), ("2024-01-01T05:30:00+02:00",), ("garbage",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    got = [r[0] for r in df.select(parse_timestamp("t")).collect()]
    assert got[0] == dt.datetime(2024, 1, 1, 0, 0)
    assert got[1] == dt.datetime(2024, 1, 1, 3, 30)  # moved to UTC
    assert got[2] is None and got[3] is None


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-5.0,), (500.0,), (50.0,)], "x double")
    assert [r[0] for r in df.select(clip(F.col("x"), 0.0, 100.0)).collect()] == [None, 0.0, 100.0, 50.0]


def test_ratios_differ(spark):
    df = spark.createDataFrame([(10.0, 0.5)], "a double, b double")
    eps, flo = df.select(ratio_with_epsilon("a", "b"), ratio_with_floor("a", "b")).first()
    assert abs(eps - 10.0 / 0.500001) < 1e-12 and flo == 10.0


def test_offset_timestamp(spark):
    df = spark.createDataFrame([(0.0,), (3600.5,)], "t double")
    got = [r[0] for r in df.select(offset_timestamp("t")).collect()]
    assert got == [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 1, 0, 0, 500000)]


def test_draws_are_partition_independent(spark):
    a = spark.range(2000).repartition(3).select("id", keyed_uniform("x", "id").alias("u")).toPandas()
    b = spark.range(2000).repartition(7).select("id", keyed_uniform("x", "id").alias("u")).toPandas()
    assert a.sort_values("id")["u"].tolist() == b.sort_values("id")["u"].tolist()
    shares = (
        spark.range(20000).select(weighted_choice("c", "id", ["a", "b"], [0.8, 0.2]).alias("c"))
        .groupBy("c").count().toPandas().set_index("c")["count"] / 20000
    )
    assert abs(shares["a"] - 0.8) < 0.02
