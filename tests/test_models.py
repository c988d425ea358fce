"""Properties of the fitted models (no exact oracle exists for them)."""

import dataclasses
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnwatch.operators import logistic
from txnwatch.operators.features import fit_encoder
from txnwatch.operators.iforest import candidate_trees, fit_isolation_forest, score_forest, tree_tails
from txnwatch.operators.logistic import fit_logistic
from txnwatch.schema import NUMERIC_FEATURES
from txnwatch.sources.fixtures import transactions_from_events
from txnwatch.sources.tables import read_table

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def txn(spark):
    t = transactions_from_events(read_table(spark, SF_SMALL, "events"))
    return t.select("transaction_id", "label", *NUMERIC_FEATURES, "channel", "merchant_category").cache()


@pytest.fixture(scope="module")
def forest(txn):
    return fit_isolation_forest(txn.select("transaction_id", *NUMERIC_FEATURES), NUMERIC_FEATURES, "transaction_id")


def test_forest_shape(forest):
    nodes = forest.nodes
    assert nodes["tree_id"].nunique() == 120
    assert forest.psi == 256
    assert nodes["depth"].max() <= math.ceil(math.log2(256))
    assert (nodes.groupby("tree_id")["node_id"].count() <= 2 * 256 - 1).all()
    roots = nodes[nodes["node_id"] == 0]
    assert (roots["size"] == 256).all()


def test_forest_flags_contamination_share(txn, forest):
    scored = score_forest(txn.select("transaction_id", *NUMERIC_FEATURES), forest).toPandas()
    share = float((scored["anomaly_flag"] == 1).mean())
    n = len(scored)
    assert abs(share - 0.02) <= 1.0 / n + 1e-9
    assert ((scored["anomaly_score"] < 0) == (scored["anomaly_flag"] == 1)).all()


def test_forest_outlier_scores_low(spark, txn, forest):
    far = spark.createDataFrame([("far", 1e7, 3, 50.0, 1e7, 1e6)], "transaction_id string, Amount double, "
                                "hour int, velocity_1h double, avg_amount_24h double, amount_to_avg_ratio double")
    med = score_forest(txn.select("transaction_id", *NUMERIC_FEATURES), forest).agg(
        F.percentile("anomaly_score", 0.5)).first()[0]
    out = score_forest(far, forest).first()
    assert out.anomaly_score < med and out.anomaly_flag == 1


def test_forest_independent_of_partitioning(txn):
    a = fit_isolation_forest(txn.select("transaction_id", *NUMERIC_FEATURES).repartition(2), NUMERIC_FEATURES,
                             "transaction_id", n_trees=10)
    b = fit_isolation_forest(txn.select("transaction_id", *NUMERIC_FEATURES).repartition(8), NUMERIC_FEATURES,
                             "transaction_id", n_trees=10)
    cols = ["tree_id", "node_id", "feature", "size"]
    sa = a.nodes.sort_values(["tree_id", "node_id"])[cols].reset_index(drop=True)
    sb = b.nodes.sort_values(["tree_id", "node_id"])[cols].reset_index(drop=True)
    assert sa.equals(sb)
    assert abs(a.offset - b.offset) < 1e-12


def test_candidates_are_independent_draws(spark):
    """One hash a row decides how many trees; pairs come as from one draw a row and tree."""
    rows, trees, frac = 20_000, 12, 0.05
    pairs = candidate_trees(spark.range(rows), "id", trees, frac, 7).toPandas()
    assert not pairs.duplicated().any()
    took = np.zeros((rows, trees))
    took[pairs["id"], pairs["tree_id"]] = 1
    assert np.abs(took.mean(0) - frac).max() < 5 * math.sqrt(frac * (1 - frac) / rows)
    both = (took.T @ took / rows)[np.triu_indices(trees, 1)]
    assert np.abs(both - frac**2).max() < 5 * math.sqrt(frac**2 / rows)
    pmf = [math.comb(trees, k) * frac**k * (1 - frac) ** (trees - k) for k in range(trees + 1)]
    for k, tail in enumerate(tree_tails(trees, frac), 1):
        assert abs(tail - sum(pmf[k:])) < 1e-12
        assert abs((took.sum(1) >= k).mean() - tail) < 5 * math.sqrt(tail / rows) + 1e-9
    assert candidate_trees(spark.range(10), "id", 3, 1.0, 7).count() == 30
    assert abs(tree_tails(120, 1e-10)[0] - 120e-10) < 1e-16


def test_one_aggregate_before_the_trees(spark, txn):
    from txnwatch.operators.features import fit_scaler_and_count, fit_standard_scaler

    scaler, n = fit_scaler_and_count(txn, NUMERIC_FEATURES)
    assert n == txn.count() and scaler == fit_standard_scaler(txn, NUMERIC_FEATURES)
    plan = candidate_trees(txn, "transaction_id", 120, 1e-4, 1)._jdf.queryExecution().optimizedPlan().toString()
    rare = [line for line in plan.splitlines() if "Filter" in line]
    assert rare and all("transform" not in line for line in rare)  # the choice of trees comes after the draw


def test_logistic_exact_and_mllib_agree(spark, txn):
    enc = fit_encoder(txn)
    exact = fit_logistic(txn, "label", enc, exact=True)
    approx = fit_logistic(txn, "label", enc, exact=False)
    p = txn.select(exact.probability().alias("a"), approx.probability().alias("b")).toPandas()
    assert float((p["a"] - p["b"]).abs().max()) < 0.02
    # gradient of the penalised objective vanishes at the exact solution
    x = txn.select(*enc.columns(), F.col("label").cast("double").alias("y")).toPandas()
    counts = x["y"].value_counts().to_dict()
    w = x["y"].map(lambda y: len(x) / (2 * counts[y])).to_numpy()
    design = np.column_stack([np.ones(len(x))] + [x[c].to_numpy() for c in enc.names()])
    beta = np.array([exact.intercept] + exact.coefficients)
    prob = 1 / (1 + np.exp(-design @ beta))
    grad = beta + design.T @ (w * (prob - x["y"].to_numpy()))
    assert float(np.abs(grad).max()) < 1e-6


def test_unknown_category_scores(spark, txn):
    enc = fit_encoder(txn)
    model = fit_logistic(txn, "label", enc)
    row = spark.createDataFrame([(100.0, 3, 1.0, 100.0, 1.0, "zzz", "zzz")],
                                "Amount double, hour int, velocity_1h double, avg_amount_24h double, "
                                "amount_to_avg_ratio double, channel string, merchant_category string")
    p = row.select(model.probability()).first()[0]
    assert 0.0 < p < 1.0


def test_damped_newton_converges_on_heavy_tails(spark):
    from txnwatch.operators.features import FeatureEncoder, OneHotParams, ScalerParams

    enc = FeatureEncoder(ScalerParams({"a": 0.0, "b": 0.0}, {"a": 1.0, "b": 1.0}), OneHotParams({}))
    for seed in range(4):
        rng = np.random.default_rng(seed)
        x = rng.standard_cauchy((300, 2)) * 10.0
        y = (rng.random(300) < 0.1).astype(int)
        y[:2] = [0, 1]
        df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, y int")
        model = fit_logistic(df, "y", enc)
        assert model.converged


def test_quantile_without_a_sort(spark):
    from txnwatch.operators.prefix import exact_quantile

    rng = np.random.default_rng(3)
    for values in (rng.standard_cauchy(999), np.repeat([1.0, 2.0, 5.0], 40), np.array([7.0]), rng.random(50) * 1e-12):
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
        for q in (0.0, 0.02, 0.5, 0.977, 1.0):
            assert abs(exact_quantile(df, "x", q) - np.quantile(values, q)) <= 1e-12 * max(1.0, abs(np.quantile(values, q)))


@dataclasses.dataclass
class _Plain:
    """An encoder of given columns."""

    features: list

    def names(self):
        return self.features

    def columns(self):
        return [F.col(c) for c in self.features]


def _wide(spark, rows, features):
    names = [f"x{i}" for i in range(features)]
    noise = [(F.randn(seed=i) * F.lit(1.0 + i % 3)).alias(c) for i, c in enumerate(names)]
    df = spark.range(0, rows, 1, 2).select("id", *noise)
    margin = sum((F.col(c) * F.lit((-1.0) ** i / (1 + i)) for i, c in enumerate(names[:20])), F.lit(0.3))
    return df.select(*names, (margin + F.randn(seed=999) > 0.8).cast("int").alias("y")).checkpoint(), _Plain(names)


def test_many_features_keep_the_objective(spark, monkeypatch):
    """50 features by Newton's method and by L-BFGS give one model."""
    df, encoder = _wide(spark, 600, 50)
    newton = logistic.fit_logistic(df, "y", encoder)
    monkeypatch.setattr(logistic, "WIDE", 10)
    lbfgs = logistic.fit_logistic(df, "y", encoder)
    assert (newton.method, lbfgs.method) == ("newton", "lbfgs") and newton.converged and lbfgs.converged
    assert abs(newton.intercept - lbfgs.intercept) < 1e-6
    assert max(abs(a - b) for a, b in zip(newton.coefficients, lbfgs.coefficients, strict=True)) < 1e-6


def test_rows_for_the_forest_fall_back_to_all(spark):
    from txnwatch.plans.training import normal_rows

    some = spark.createDataFrame([(1, 0), (2, 1), (3, None)], "k int, y int")
    assert [r["k"] for r in normal_rows(some, "y").collect()] == [1]
    assert normal_rows(some.where("y = 1"), "y").count() == 1
    assert normal_rows(some.limit(0), "y").count() == 0


def test_forest_walk_is_that_of_each_row(monkeypatch):
    """Batches longer than a walk's rows, NaN and values on a threshold: the mean path is that of walking each tree by hand."""
    import pandas as pd

    from txnwatch.operators import iforest

    monkeypatch.setattr(iforest, "WALKED", 7)
    rng = np.random.default_rng(5)
    x = rng.integers(0, 9, size=(40, 2)).astype(float)
    rows = [(t, *n) for t in range(4) for n in iforest._grow_tree(x[rng.permutation(40)[:16]], rng, 4)]
    nodes = pd.DataFrame(rows, columns=[f.name for f in iforest.NODE_SCHEMA.fields])
    forest = iforest.Forest(["a", "b"], None, nodes, 16, -0.5, 4)
    x[3, 1], x[4, 0] = np.nan, nodes["threshold"].max()
    table = {(r.tree_id, r.node_id): r for r in nodes.itertuples()}

    def path(row, tree):
        at = table[tree, 0]
        while at.feature >= 0:
            at = table[tree, at.left if row[at.feature] <= at.threshold else at.right]
        return at.leaf_path

    class Held:
        value = forest.arrays()

    got = pd.concat(iforest._scorer(Held, 2, True, 0.0)(iter([pd.DataFrame(x, columns=["_f0", "_f1"])])))
    expected = [-(2.0 ** (-np.mean([path(r, t) for t in range(4)]) / iforest.average_path_length(16))) for r in x]
    assert np.allclose(got["anomaly_score"], expected, rtol=0, atol=1e-12)
