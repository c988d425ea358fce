"""Many categories: places from a table, fit and scores without a CASE or a collect of categories."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnwatch.operators.categories import category_index, category_places, fit_category_logistic
from txnwatch.operators.features import fit_encoder
from txnwatch.operators.logistic import fit_logistic
from txnwatch.schema import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from txnwatch.sources.fixtures import transactions_from_events
from txnwatch.sources.tables import read_table

from conftest import SF_SMALL

ROWS = [(1, "b", "x"), (2, "a", None), (3, None, "y"), (4, "b", "y"), (5, "é", "x"), (5, "é", "x")]


def test_index_and_places(spark):
    df = spark.createDataFrame(ROWS, "k int, c string, e string")
    index = category_index(df, ["e", "c"])
    assert [tuple(r) for r in index.orderBy("place").collect()] == [
        ("e", "x", 0), ("e", "y", 1), ("c", "a", 2), ("c", "b", 3), ("c", "é", 4)]
    new = spark.createDataFrame([(1, "zzz", "x"), (2, "a", None)], "k int, c string, e string")
    got = category_places(new, index, ["e", "c"]).orderBy("k").collect()
    assert [(r["at_e"], r["at_c"]) for r in got] == [(0, None), (None, 2)]
    assert category_places(df, index, ["e", "c"]).count() == len(ROWS)
    empty = category_index(df.limit(0), ["e", "c"])
    assert empty.count() == 0 and category_places(df, empty, ["c"]).where("at_c is null").count() == len(ROWS)


def test_same_model_as_the_dense_fit(spark):
    txn = transactions_from_events(read_table(spark, SF_SMALL, "events")).checkpoint()
    dense = fit_logistic(txn, "label", fit_encoder(txn))
    model = fit_category_logistic(txn, "label", NUMERIC_FEATURES, CATEGORICAL_FEATURES)
    assert model.converged and dense.converged
    both = model.probability(txn.withColumn("dense", dense.probability())).select("dense", "ml_probability").toPandas()
    assert len(both) == txn.count() and np.abs(both["dense"] - both["ml_probability"]).max() < 1e-6
    wanted = dict(zip(dense.feature_names(), dense.coefficients, strict=True))
    for r in model.table.collect():
        assert abs(r["coefficient"] - wanted[f"{r['column']}={r['value']}"]) < 1e-5


def test_a_hundred_thousand_categories(spark):
    """A third of all rows in one category, 100,000 others; unknown ones score by intercept and numbers alone."""
    many = 100_000
    df = spark.range(150_000).select(
        F.when(F.col("id") < 50_000, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % many)).alias("c"),
        (F.col("id") % 17).cast("double").alias("v"),
        (F.xxhash64("id") % 5 == 0).cast("int").alias("y"),
    )
    model = fit_category_logistic(df, "y", ["v"], ["c"])
    assert model.converged and model.table.count() == many + 1
    new = spark.createDataFrame([("hot", 3.0), ("c1", 3.0), ("never seen", 3.0), (None, 3.0)], "c string, v double")
    scored = model.probability(new)
    assert "CASE" not in scored._jdf.queryExecution().optimizedPlan().toString()
    p = {r["c"]: r["ml_probability"] for r in scored.collect()}
    assert p["never seen"] == p[None] and len(set(p.values())) == 3 and all(0 < x < 1 for x in p.values())


def test_one_class_is_refused(spark):
    df = spark.createDataFrame([("a", 1.0, 0), ("b", 2.0, 0)], "c string, v double, y int")
    with pytest.raises(ValueError):
        fit_category_logistic(df, "y", ["v"], ["c"])


def test_blocks_hold_the_rows():
    """Rows are put into blocks once; a pass over them gives the loss and the slopes of the rows."""
    import pyarrow as pa

    from txnwatch.operators.categories import BLOCK_ROWS, _blocks, _slopes

    n, rng = BLOCK_ROWS + 7, np.random.default_rng(3)
    x, y = rng.normal(size=(n, 2)), rng.integers(0, 2, n).astype(float)
    at = [[i % 3] if i % 5 else [] for i in range(n)]
    whole = pa.RecordBatch.from_arrays([pa.array(x.tolist()), pa.array(at, pa.list_(pa.int64())), pa.array(y), pa.array(np.full(n, 2.0))],
                                       names=["x", "at", "_y", "_w"])
    blocks = list(_blocks(iter([whole.slice(5), whole.slice(0, 5), whole.slice(0, 0)])))
    assert len(blocks) == 3
    beta = np.array([0.1, -0.2, 0.3, 0.5, -0.5, 0.7])
    (out,) = _slopes(beta, 2)(iter(blocks))
    full = np.column_stack([np.ones(n), x, [[float(k in a) for k in range(3)] for a in at]])
    z = full @ beta
    off = 2.0 * (1 / (1 + np.exp(-z)) - y)
    want = np.concatenate([[np.sum(2.0 * (np.logaddexp(0, z) - y * z))], full.T @ off])
    got = np.zeros(7)
    got[out.column("k").to_numpy()] = out.column("x").to_numpy()
    assert np.allclose(got, want)
