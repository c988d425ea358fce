"""Isolation forest (M5-M7), after Liu, Ting and Zhou (2008).

Fit
  * one aggregate gives the row count and the scaler;
  * one keyed draw a row says how many trees take it as a candidate (binomial, by its
    tail probabilities; most rows go to none and cost one hash), and only rows with
    a tree choose which: those of their smallest draws. That is the same as an
    independent draw per row and tree. Each tree keeps exactly its
    ``psi = min(max_samples, n)`` smallest draws among its candidates
    (a window over ~psi rows per tree, never over the data);
  * ``groupBy("tree_id").applyInPandas`` grows one tree per group (psi rows):
    random feature among the non-constant ones, uniform threshold between
    the node's min and max, depth limit ``ceil(log2 psi)``;
  * the node table has at most ``trees * (2 psi - 1)`` rows: a proven bound,
    so it is collected and broadcast.
  * offset = the ``contamination`` quantile of the training scores, exact and
    linearly interpolated, from distributed ranks.

Score
  ``mapInPandas`` walks all trees level by level for a whole Arrow batch
  (vectorised, no per-row Python). ``score = -2^(-mean path / c(psi))``;
  ``decision = score - offset``; flagged when ``decision < 0``.

Trees are seeded from ``(seed, tree_id)`` and samples from keyed draws, so
the forest does not depend on partitioning or retries.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnwatch.operators.features import ScalerParams, fit_scaler_and_count
from txnwatch.operators.prefix import exact_quantile
from txnwatch.session import ship_package
from txnwatch.schema import IFOREST_CONTAMINATION, IFOREST_MAX_SAMPLES, IFOREST_TREES, RANDOM_SEED

EULER_GAMMA = 0.5772156649015329
#: Rows of a batch that walk the trees together.
WALKED = 512
NODE_SCHEMA = T.StructType(
    [
        T.StructField("tree_id", T.IntegerType(), False),
        T.StructField("node_id", T.IntegerType(), False),
        T.StructField("depth", T.IntegerType(), False),
        T.StructField("feature", T.IntegerType(), False),
        T.StructField("threshold", T.DoubleType(), False),
        T.StructField("left", T.IntegerType(), False),
        T.StructField("right", T.IntegerType(), False),
        T.StructField("size", T.IntegerType(), False),
        T.StructField("leaf_path", T.DoubleType(), False),
    ]
)


def average_path_length(n: float) -> float:
    """c(n): mean path length of an unsuccessful search in a BST of n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER_GAMMA) - 2.0 * (n - 1.0) / n


def _grow_tree(x: np.ndarray, rng: np.random.Generator, max_depth: int) -> list[tuple]:
    rows = []
    stack = [(0, np.arange(len(x)), 0)]
    next_id = 1
    while stack:
        node_id, idx, depth = stack.pop()
        n = len(idx)
        split = None
        if depth < max_depth and n > 1:
            sub = x[idx]
            lo, hi = sub.min(axis=0), sub.max(axis=0)
            candidates = np.flatnonzero(hi > lo)
            if len(candidates):
                f = int(rng.choice(candidates))
                thr = float(rng.uniform(lo[f], hi[f]))
                if thr >= hi[f]:
                    thr = float(lo[f])
                go_left = sub[:, f] <= thr
                split = (f, thr, idx[go_left], idx[~go_left])
        if split is None:
            rows.append((node_id, depth, -1, 0.0, -1, -1, n, depth + average_path_length(n)))
            continue
        f, thr, li, ri = split
        left_id, right_id = next_id, next_id + 1
        next_id += 2
        rows.append((node_id, depth, f, thr, left_id, right_id, n, 0.0))
        stack.append((right_id, ri, depth + 1))
        stack.append((left_id, li, depth + 1))
    return rows


def _tree_builder(feature_cols: list[str], seed: int, max_depth: int):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree_id = int(pdf["tree_id"].iloc[0])
        x = pdf[feature_cols].to_numpy(dtype=float)
        rng = np.random.default_rng([seed, tree_id])
        rows = _grow_tree(x, rng, max_depth)
        out = pd.DataFrame(rows, columns=[f.name for f in NODE_SCHEMA.fields if f.name != "tree_id"])
        out.insert(0, "tree_id", tree_id)
        return out.astype({"tree_id": "int32", "node_id": "int32", "depth": "int32", "feature": "int32",
                           "left": "int32", "right": "int32", "size": "int32"})

    return build


@dataclass
class Forest:
    features: list[str]
    scaler: ScalerParams
    nodes: pd.DataFrame  # NODE_SCHEMA rows
    psi: int
    offset: float
    max_depth: int

    def arrays(self) -> dict:
        n_trees = int(self.nodes["tree_id"].max()) + 1
        width = int(self.nodes["node_id"].max()) + 1
        out = {
            "feature": np.full((n_trees, width), -1, dtype=np.int64),
            "threshold": np.zeros((n_trees, width)),
            "left": np.zeros((n_trees, width), dtype=np.int64),
            "right": np.zeros((n_trees, width), dtype=np.int64),
            "leaf_path": np.zeros((n_trees, width)),
        }
        t = self.nodes["tree_id"].to_numpy()
        n = self.nodes["node_id"].to_numpy()
        for k in out:
            out[k][t, n] = self.nodes[k].to_numpy()
        out["left"] = np.maximum(out["left"], 0)
        out["right"] = np.maximum(out["right"], 0)
        out["c_psi"] = average_path_length(self.psi)
        out["depth"] = self.max_depth
        return out

    def to_json(self) -> str:
        return json.dumps(
            {
                "features": self.features,
                "scaler": self.scaler.to_dict(),
                "psi": self.psi,
                "offset": self.offset,
                "max_depth": self.max_depth,
                "nodes": self.nodes.to_dict(orient="list"),
            }
        )

    @staticmethod
    def from_json(text: str) -> "Forest":
        d = json.loads(text)
        nodes = pd.DataFrame(d["nodes"])
        return Forest(d["features"], ScalerParams(**d["scaler"]), nodes, d["psi"], d["offset"], d["max_depth"])


def _draw(seed: int, salt: str, key: str, *more):
    h = F.xxhash64(F.lit(seed), F.lit(salt), *more, F.col(key))
    return F.pmod(h, F.lit(2**53)).cast("double") / F.lit(float(2**53))


def tree_tails(n_trees: int, frac: float) -> list[float]:
    """P(a row is a candidate of k trees or more) for k = 1, 2, ..., as far as 53 bits tell it from 0."""
    terms, term = [], n_trees * math.log1p(-frac)
    for k in range(1, n_trees + 1):
        term += math.log(n_trees - k + 1) - math.log(k) + math.log(frac) - math.log1p(-frac)
        terms.append(math.exp(term))
    tails = np.cumsum(terms[::-1])[::-1]
    return [float(min(t, 1.0)) for t in tails if t >= 2.0**-53]


def candidate_trees(df: DataFrame, key: str, n_trees: int, frac: float, seed: int) -> DataFrame:
    """One row per (row, tree) with each pair there with probability ``frac``, independently: adds ``tree_id``."""
    trees = F.sequence(F.lit(0), F.lit(n_trees - 1))
    if frac >= 1.0:
        return df.withColumn("tree_id", F.explode(trees))
    tails = tree_tails(n_trees, frac)
    taken = df.withColumn("_d", _draw(seed, "trees", key)).where(F.col("_d") < F.lit(tails[0]))
    how_many = F.size(F.filter(F.array(*[F.lit(t) for t in tails]), lambda t: F.col("_d") < t))
    mixed = F.array_sort(F.transform(trees, lambda t: F.struct(F.xxhash64(F.lit(seed), F.lit("which"), t, F.col(key)).alias("h"), t.alias("t"))))
    chosen = F.transform(F.slice(mixed, F.lit(1), how_many), lambda s: s["t"])
    return taken.withColumn("tree_id", F.explode(chosen)).drop("_d")


def tree_samples(df: DataFrame, key: str, feature_cols: list[str], n_trees: int, psi: int, n: int,
                 seed: int) -> DataFrame:
    """``(tree_id, key, features)``: exactly ``psi`` rows per tree, without replacement."""
    frac = min(1.0, (psi + 6.0 * math.sqrt(psi) + 10.0) / max(n, 1))
    while True:
        pairs = candidate_trees(df.select(key, *feature_cols), key, n_trees, frac, seed).withColumn(
            "_u", _draw(seed, "rank", key, F.col("tree_id"))
        )
        if frac >= 1.0:
            break
        pairs = pairs.checkpoint(eager=True)  # about trees x psi rows: counted and then ranked
        per_tree = pairs.groupBy("tree_id").count().collect()  # one row per tree
        if len(per_tree) == n_trees and min(r["count"] for r in per_tree) >= psi:
            break
        frac = min(1.0, frac * 2.0)
    w = Window.partitionBy("tree_id").orderBy("_u", key)
    return pairs.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= psi).drop("_rk", "_u")


def _scaled(df: DataFrame, scaler: ScalerParams, feature_cols: list[str], prefix: str = "_f") -> list:
    return [
        ((F.col(c).cast("double") - F.lit(scaler.means[c])) / F.lit(scaler.scales[c])).alias(f"{prefix}{i}")
        for i, c in enumerate(feature_cols)
    ]


def fit_isolation_forest(
    df: DataFrame,
    feature_cols: list[str],
    key: str,
    n_trees: int = IFOREST_TREES,
    max_samples: int = IFOREST_MAX_SAMPLES,
    contamination: float = IFOREST_CONTAMINATION,
    seed: int = RANDOM_SEED,
) -> Forest:
    """M5: fit on ``df`` (standardised first, as the reference does)."""
    ship_package(df.sparkSession)
    scaler, n = fit_scaler_and_count(df, feature_cols)
    if n == 0:
        raise ValueError("cannot fit an isolation forest on no rows")
    psi = min(max_samples, n)
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    scaled = df.select(key, *_scaled(df, scaler, feature_cols))
    fcols = [f"_f{i}" for i in range(len(feature_cols))]
    sample = tree_samples(scaled, key, fcols, n_trees, psi, n, seed)
    # The per-tree samples are small (trees x psi rows) whatever the input
    # size, so AQE would coalesce them into one task; an explicit hash
    # repartition by tree keeps the tree builds parallel (the groupBy reuses it).
    slots = max(1, min(n_trees, df.sparkSession.sparkContext.defaultParallelism * 2))
    nodes = (
        sample.repartition(slots, "tree_id")
        .groupBy("tree_id")
        .applyInPandas(_tree_builder(fcols, seed, max_depth), NODE_SCHEMA)
        .toPandas()  # at most n_trees * (2 psi - 1) rows
    )
    forest = Forest(feature_cols, scaler, nodes, psi, 0.0, max_depth)
    # One scoring pass over the training rows, kept for the passes of the quantile.
    train_scores = score_forest(df.select(*feature_cols), forest, raw=True).select("anomaly_score").checkpoint(eager=True)
    offset = exact_quantile(train_scores, "anomaly_score", contamination)
    forest.offset = float(offset)
    return forest


def _scorer(arrays_bc, n_features: int, raw: bool, offset: float):
    def run(batches):
        a = arrays_bc.value
        n_trees, width = a["feature"].shape
        # One flat table of nodes; a place in it is tree * width + node.
        roots = (np.arange(n_trees) * width).astype(np.intp)
        feature, threshold, leaf_path = (a[k].ravel() for k in ("feature", "threshold", "leaf_path"))
        is_leaf = feature < 0
        column = np.maximum(feature, 0).astype(np.intp)
        here = np.arange(feature.size)
        left, right = (np.where(is_leaf, here, (a[k] + roots[:, None]).ravel()).astype(np.intp) for k in ("left", "right"))
        for pdf in batches:
            x = np.column_stack([pdf[f"_f{i}"].to_numpy(dtype=float) for i in range(n_features)])
            m = len(pdf)
            mean_path = np.zeros(m)
            for start in range(0, m, WALKED):  # so many rows that the walk stays in the cache
                part = np.ascontiguousarray(x[start : start + WALKED])
                flat, first = part.ravel(), (np.arange(len(part)) * n_features)[:, None]
                node = np.repeat(roots[None, :], len(part), axis=0)
                for _ in range(a["depth"]):  # leaves lead to themselves
                    low = flat.take(column.take(node) + first) <= threshold.take(node)
                    node = np.where(low, left.take(node), right.take(node))
                mean_path[start : start + WALKED] = leaf_path.take(node).mean(axis=1)
            score = -np.power(2.0, -mean_path / a["c_psi"]) if a["c_psi"] > 0 else np.full(m, -1.0)
            out = pdf.drop(columns=[f"_f{i}" for i in range(n_features)])
            decision = score if raw else score - offset
            out["anomaly_score"] = decision
            out["anomaly_flag"] = (decision < 0).astype("int32")
            yield out

    return run


def score_forest(df: DataFrame, forest: Forest, raw: bool = False) -> DataFrame:
    """M6 + M7: add ``anomaly_score`` (decision function) and ``anomaly_flag``.

    ``raw=True`` returns the un-offset score (used to fit the offset).
    All columns of ``df`` pass through.
    """
    spark = df.sparkSession
    ship_package(spark)
    arrays_bc = spark.sparkContext.broadcast(forest.arrays())
    k = len(forest.features)
    prepared = df.select("*", *_scaled(df, forest.scaler, forest.features))
    schema = T.StructType(
        list(df.schema.fields)
        + [T.StructField("anomaly_score", T.DoubleType(), True), T.StructField("anomaly_flag", T.IntegerType(), True)]
    )
    return prepared.mapInPandas(_scorer(arrays_bc, k, raw, forest.offset), schema)


def node_table(spark, forest: Forest) -> DataFrame:
    return spark.createDataFrame(forest.nodes, NODE_SCHEMA)
