"""Logistic regression with balanced class weights (M3, M4).

Objective (L2, intercept included in the penalty when ``exact``):
``1/2 |w|^2 + sum_i c_i * logloss_i`` with ``c_i = n / (2 n_class)``.

* ``exact=True`` (default): damped Newton on exactly this objective. Each pass
  sums loss, gradient and Hessian per partition (``mapInPandas``); Spark adds the
  partitions up position by position, so 1 + d + d^2 numbers reach the driver however many
  partitions there are. A step that does not lower the loss is halved, and the fit is
  ``converged`` only when the gradient vanishes; otherwise it warns.
* With more than ``WIDE`` features the same objective goes through L-BFGS, whose passes add up d + 2 numbers.
* ``exact=False``: MLlib ``LogisticRegression`` with ``weightCol`` and
  ``regParam = 1/n``, no standardisation (same minimiser up to the intercept
  penalty, which MLlib leaves free); it needs gradients only, but more passes.

Scoring (M4) is a column expression from the fitted coefficients, so it
runs in whole-stage codegen with no model object on the executors.
"""

from __future__ import annotations

import json
import warnings
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnwatch.operators.features import FeatureEncoder
from txnwatch.schema import LOGISTIC_MAX_ITER


#: Features up to which a d x d system is solved; beyond it the same objective goes through L-BFGS.
WIDE = 1000
#: Steps that L-BFGS remembers, and its passes for each one that ``max_iter`` allows Newton's method.
MEMORY, PASSES = 20, 10


@dataclass
class LogisticModel:
    encoder: FeatureEncoder
    intercept: float
    coefficients: list[float]
    method: str
    converged: bool = True
    max_gradient: float = 0.0

    def feature_names(self) -> list[str]:
        return self.encoder.names()

    def margin(self) -> Column:
        total = F.lit(self.intercept)
        for col, w in zip(self.encoder.columns(), self.coefficients):
            total = total + col * F.lit(float(w))
        return total

    def probability(self) -> Column:
        """M4: P(class 1)."""
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.margin()))

    def coefficient_table(self, spark) -> DataFrame:
        rows = [("(intercept)", float(self.intercept))] + [
            (n, float(w)) for n, w in zip(self.feature_names(), self.coefficients)
        ]
        return spark.createDataFrame(rows, "feature string, coefficient double")

    def to_json(self) -> str:
        return json.dumps(
            {"encoder": self.encoder.to_dict(), "intercept": self.intercept, "coefficients": self.coefficients,
             "method": self.method, "converged": self.converged, "max_gradient": self.max_gradient}
        )

    @staticmethod
    def from_json(text: str) -> "LogisticModel":
        d = json.loads(text)
        return LogisticModel(FeatureEncoder.from_dict(d["encoder"]), d["intercept"], d["coefficients"], d["method"],
                             d.get("converged", True), d.get("max_gradient", 0.0))


def balanced_weight(label: str, counts: dict) -> Column:
    n = sum(counts.values())
    k = len(counts)
    expr = None
    for c, n_c in counts.items():
        cond = F.col(label) == F.lit(c)
        w = F.lit(n / (k * n_c))
        expr = F.when(cond, w) if expr is None else expr.when(cond, w)
    return expr


def _class_counts(df: DataFrame, label: str) -> dict:
    counts = {r[0]: int(r[1]) for r in df.groupBy(label).count().collect()}
    if None in counts:
        raise ValueError("labels must not be NULL")
    if len(counts) < 2:
        raise ValueError("logistic regression needs two classes")
    return counts


def fit_logistic(train: DataFrame, label: str, encoder: FeatureEncoder, exact: bool = True,
                 max_iter: int = LOGISTIC_MAX_ITER) -> LogisticModel:
    counts = _class_counts(train, label)
    n = sum(counts.values())
    data = train.select(
        *encoder.columns(), F.col(label).cast("double").alias("_y"), balanced_weight(label, counts).alias("_w")
    )
    if exact:
        return _fit_newton(data, encoder, max_iter) if len(encoder.names()) <= WIDE else _fit_lbfgs(data, encoder, PASSES * max_iter)
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    names = encoder.names()
    assembled = VectorAssembler(inputCols=names, outputCol="_features").transform(data)
    lr = LogisticRegression(
        featuresCol="_features",
        labelCol="_y",
        weightCol="_w",
        regParam=1.0 / n,
        elasticNetParam=0.0,
        standardization=False,
        fitIntercept=True,
        maxIter=max_iter,
        tol=1e-6,
    )
    m = lr.fit(assembled)
    done = m.summary.totalIterations < max_iter
    return LogisticModel(encoder, float(m.intercept), [float(x) for x in m.coefficients.toArray()], "mllib", done, float("nan"))


def _partials(names: list[str], beta: np.ndarray):
    d = len(names) + 1

    def run(batches):
        g = np.zeros(d)
        h = np.zeros((d, d))
        loss = 0.0
        for pdf in batches:
            x = np.column_stack([np.ones(len(pdf))] + [pdf[c].to_numpy(dtype=float) for c in names])
            y = pdf["_y"].to_numpy(dtype=float)
            w = pdf["_w"].to_numpy(dtype=float)
            z = x @ beta
            p = 0.5 * (1.0 + np.tanh(0.5 * z))
            g += x.T @ (w * (p - y))
            h += (x * (w * p * (1.0 - p))[:, None]).T @ x
            loss += float(np.sum(w * (np.logaddexp(0.0, z) - y * z)))
        yield pd.DataFrame({"sums": [np.concatenate([[loss], g, h.ravel()]).tolist()]})

    return run


def _fit_newton(data: DataFrame, encoder: FeatureEncoder, max_iter: int, tol: float = 1e-9) -> LogisticModel:
    names = encoder.names()
    cols = [f"f{i}" for i in range(len(names))]
    spark = data.sparkSession
    from txnwatch.session import ensure_checkpoint_dir, ship_package

    ensure_checkpoint_dir(spark)
    ship_package(spark)
    rows = data.toDF(*cols, "_y", "_w").checkpoint(eager=True)  # reused by every pass
    d = len(names) + 1
    weight = float(rows.agg(F.sum("_w")).first()[0] or 1.0)

    def at(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss, gradient and Hessian with the penalty 1/2 |beta|^2 (intercept included)."""
        parts = rows.mapInPandas(_partials(cols, beta.copy()), "sums array<double>")
        sums = parts.select(F.posexplode("sums").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect()
        total = np.zeros(1 + d + d * d)
        for k, x in sums:
            total[k] = x
        loss = float(total[0]) + 0.5 * float(beta @ beta)
        return loss, total[1 : 1 + d] + beta, total[1 + d :].reshape(d, d) + np.eye(d)

    beta = np.zeros(d)
    loss, gradient, hessian = at(beta)
    passes = 1
    limit = tol * max(1.0, weight)
    while float(np.abs(gradient).max()) > limit and passes < max_iter:
        step = np.linalg.solve(hessian, gradient)
        size, slope = 1.0, float(gradient @ step)
        while True:
            trial = beta - size * step
            found = at(trial)
            passes += 1
            if found[0] <= loss - 1e-4 * size * slope or passes >= max_iter:
                break
            if size * slope <= 1e-12 * max(1.0, abs(loss)):  # below what the loss can resolve
                break
            size /= 2.0
        if not found[0] <= loss + 1e-9 * max(1.0, abs(loss)):
            break
        beta, (loss, gradient, hessian) = trial, found
    largest = float(np.abs(gradient).max())
    if largest > limit:
        warnings.warn(f"logistic fit stopped after {passes} passes with a gradient of {largest:.3g}", stacklevel=2)
    return LogisticModel(encoder, float(beta[0]), [float(b) for b in beta[1:]], "newton", largest <= limit, largest)


def _slopes(beta: np.ndarray):
    """Loss and gradient of each task's rows."""

    def run(batches):
        total = np.zeros(len(beta) + 1)
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(beta) - 1)
            y, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_y", "_w"))
            z = beta[0] + x @ beta[1:]
            off = w * (0.5 * (1.0 + np.tanh(0.5 * z)) - y)
            total[0] += float(np.sum(w * (np.logaddexp(0.0, z) - y * z)))
            total[1] += off.sum()
            total[2:] += x.T @ off
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

    return run


def _fit_lbfgs(data: DataFrame, encoder: FeatureEncoder, max_passes: int, tol: float = 1e-9) -> LogisticModel:
    """The objective of ``_fit_newton`` for many features: a pass adds up d + 2 numbers instead of d x d.

    The rows travel as one array of features; the driver holds ``MEMORY`` pairs of d numbers.
    """
    from txnwatch.session import ensure_checkpoint_dir, ship_package

    ensure_checkpoint_dir(data.sparkSession)
    ship_package(data.sparkSession)
    names = data.columns[:-2]
    rows = data.select(F.array(*[F.col(f"`{c}`").cast("double") for c in names]).alias("x"), "_y", "_w").checkpoint(eager=True)
    d = len(names) + 1
    weight = float(rows.agg(F.sum("_w")).first()[0] or 1.0)

    def at(beta: np.ndarray) -> tuple[float, np.ndarray]:
        parts = rows.mapInArrow(_slopes(beta.copy()), "sums array<double>")
        total = np.zeros(d + 1)
        for k, x in parts.select(F.posexplode("sums").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect():
            total[k] = x
        return float(total[0]) + 0.5 * float(beta @ beta), total[1:] + beta

    beta, largest, done = minimise(at, d, tol * max(1.0, weight), max_passes)
    return LogisticModel(encoder, float(beta[0]), [float(b) for b in beta[1:]], "lbfgs", done, largest)


def minimise(at: Callable[[np.ndarray], tuple[float, np.ndarray]], d: int, limit: float, max_passes: int) -> tuple[np.ndarray, float, bool]:
    """L-BFGS from zero on a strictly convex loss: (place, largest part of the gradient there, whether that is within ``limit``).

    ``at`` gives loss and gradient; the driver holds ``MEMORY`` pairs of d numbers. Warns where the passes do not suffice.
    """

    def direction(gradient: np.ndarray) -> np.ndarray:
        q, scales = gradient.copy(), []
        for s, y in reversed(pairs):
            scales.append(float(s @ q) / float(s @ y))
            q -= scales[-1] * y
        if pairs:
            s, y = pairs[-1]
            q *= float(s @ y) / float(y @ y)
        for (s, y), scale in zip(pairs, reversed(scales), strict=True):
            q += (scale - float(y @ q) / float(s @ y)) * s
        return q

    beta, pairs = np.zeros(d), deque(maxlen=MEMORY)
    loss, gradient = at(beta)
    passes = 1
    while float(np.abs(gradient).max()) > limit and passes < max_passes:
        step = direction(gradient)
        size = 1.0 if pairs else min(1.0, 1.0 / float(np.linalg.norm(gradient)))
        slope = float(gradient @ step)
        while True:
            found = at(beta - size * step)
            passes += 1
            # Near the end the loss resolves less than the gradient does: a smaller gradient will do.
            flat = abs(found[0] - loss) <= 1e-12 * max(1.0, abs(loss)) and np.abs(found[1]).max() < np.abs(gradient).max()
            if found[0] <= loss - 1e-4 * size * slope or flat or passes >= max_passes or size < 1e-10:
                break
            size /= 2.0
        if found[0] > loss + 1e-9 * max(1.0, abs(loss)) or size < 1e-10:
            break
        s, y = -size * step, found[1] - gradient
        if float(s @ y) > 0:  # always, up to rounding: the penalty makes the objective strictly convex
            pairs.append((s, y))
        beta, (loss, gradient) = beta + s, found
    largest = float(np.abs(gradient).max())
    if largest > limit:
        warnings.warn(f"logistic fit stopped after {passes} passes with a gradient of {largest:.3g}", stacklevel=3)
    return beta, largest, largest <= limit
