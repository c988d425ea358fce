"""Columns with many categories: one-hot places from a table, and a logistic fit over them (M2, M3, M4).

``features.OneHotParams`` writes a CASE for every category, right for the tens that
a channel has. Here the categories stay in a table (column, value, place): their
places are numbered by a distributed row number, rows find theirs by a join, and a
row's features are its numbers and the few places that are 1. Spark broadcasts the
table after measuring it or shuffles, where AQE splits a hot category; nothing here
broadcasts it by hand. What reaches the driver is as long as the model is wide
(places, gradients and coefficients as numbers, no category).

Defined results: NULL is no category and has no place; a category that the table
does not hold has none either (all zeros). Values count as text. Repeated rows count
each. An empty frame gives an empty table; a fit needs two classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnwatch.operators.features import ScalerParams, fit_standard_scaler
from txnwatch.operators.logistic import PASSES, _class_counts, balanced_weight, minimise
from txnwatch.operators.prefix import row_numbers
from txnwatch.schema import LOGISTIC_MAX_ITER
from txnwatch.session import ensure_checkpoint_dir, ship_package


def category_index(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(column, value, place)``: every category of every column, numbered from 0 by column as listed, then value.

    One aggregate over the rows with map-side combining, so that a hot category is one row a task; then one range shuffle
    of the categories alone.
    """
    pairs = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for i, c in enumerate(cols)])
    found = df.select(F.inline(pairs)).where(F.col("value").isNotNull()).distinct()
    return row_numbers(found, ["no", "value"], "_n").select("column", "value", (F.col("_n") - 1).alias("place"))


def with_category(df: DataFrame, table: DataFrame, col: str, what: str, name: str) -> DataFrame:
    """Add ``name``: column ``what`` of the row of ``table`` that holds the category of ``col`` (NULL: none)."""
    own = table.where(F.col("column") == col).select(F.col("value").alias("_value"), F.col(what).alias(name))
    return df.join(own, F.col(col).cast("string") == F.col("_value"), "left").drop("_value")


def category_places(df: DataFrame, index: DataFrame, cols: list[str], prefix: str = "at_") -> DataFrame:
    """M2: add ``at_<column>``, the place that is 1 for the row (NULL: none)."""
    for c in cols:
        df = with_category(df, index, c, "place", f"{prefix}{c}")
    return df


#: Rows of a block, and its columns: numbers, places a row, places, labels and weights, as bytes.
BLOCK_ROWS = 4096
_BLOCK = {"x": np.float64, "size": np.int32, "at": np.int64, "y": np.float64, "w": np.float64}


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows put together once, so that each pass of a fit reads a block and not its rows one by one."""
    for whole in batches:
        for start in range(0, whole.num_rows, BLOCK_ROWS):
            batch = whole.slice(start, BLOCK_ROWS)
            at = batch.column("at")
            parts = [batch.column("x").flatten(), at.value_lengths(), at.flatten(), batch.column("_y"), batch.column("_w")]
            packed = [p.to_numpy(zero_copy_only=False).astype(t, copy=False).tobytes() for p, t in zip(parts, _BLOCK.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in packed], names=list(_BLOCK))


def _slopes(beta: np.ndarray, numbers: int):
    """Loss and gradient of each task's blocks, as (k, x) for the parts that are not zero; k = 0 is the loss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(beta) + 1)
        for block in (b for batch in batches for b in batch.to_pylist()):
            x, size, at, y, w = (np.frombuffer(block[c], t) for c, t in _BLOCK.items())
            x = x.reshape(len(y), numbers)
            row = np.repeat(np.arange(len(y)), size)
            place = at + 1 + numbers
            z = beta[0] + x @ beta[1 : 1 + numbers] + np.bincount(row, beta[place], len(y))
            off = w * (0.5 * (1.0 + np.tanh(0.5 * z)) - y)
            total[0] += float(np.sum(w * (np.logaddexp(0.0, z) - y * z)))
            total[1] += off.sum()
            total[2 : 2 + numbers] += x.T @ off
            total[1:] += np.bincount(place, off[row], len(beta))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["k", "x"])

    return run


@dataclass
class CategoryModel:
    """A logistic model whose coefficients of categories are a table (column, value, place, coefficient)."""

    scaler: ScalerParams
    columns: list[str]
    intercept: float
    numbers: list[float]
    table: DataFrame
    converged: bool
    max_gradient: float

    def probability(self, df: DataFrame, name: str = "ml_probability") -> DataFrame:
        """M4: ``df`` with P(class 1); a join a column, no CASE."""
        names = [f"_c{i}" for i in range(len(self.columns))]
        out = df
        for c, n in zip(self.columns, names, strict=True):
            out = with_category(out, self.table, c, "coefficient", n)
        margin: Column = F.lit(self.intercept)
        for col, w in zip(self.scaler.columns(), self.numbers, strict=True):
            margin = margin + col * F.lit(w)
        for n in names:
            margin = margin + F.coalesce(F.col(n), F.lit(0.0))
        return out.withColumn(name, F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))).drop(*names)


def fit_category_logistic(train: DataFrame, label: str, numeric: list[str], cols: list[str],
                          max_passes: int = PASSES * LOGISTIC_MAX_ITER, tol: float = 1e-9) -> CategoryModel:
    """M3 over numbers and one-hot categories: the penalised objective of ``fit_logistic``, by L-BFGS on sparse rows.

    A pass shuffles at most d + 2 numbers a task, fewer where a task has few categories, and d + 2 reach the driver.
    """
    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    counts = _class_counts(train, label)
    scaler = fit_standard_scaler(train, numeric)
    index = category_index(train, cols).checkpoint(eager=True)
    d = 1 + len(numeric) + index.count()
    at_names = [f"_at_{c}" for c in cols]
    placed = category_places(train, index, cols, "_at_")
    numbers = F.array(*scaler.columns()) if numeric else F.array().cast("array<double>")
    rows = placed.select(
        numbers.alias("x"),
        F.array_compact(F.array(*at_names)).alias("at"),
        F.col(label).cast("double").alias("_y"),
        balanced_weight(label, counts).alias("_w"),
    )
    blocks = rows.mapInArrow(_blocks, ", ".join(f"{c} binary" for c in _BLOCK)).checkpoint(eager=True)
    weight = float(sum(counts.values()))  # balanced weights add up to the rows

    def at(beta: np.ndarray) -> tuple[float, np.ndarray]:
        parts = blocks.mapInArrow(_slopes(beta.copy(), len(numeric)), "k bigint, x double")
        sums = parts.groupBy("k").agg(F.sum("x").alias("x")).toPandas()  # d + 1 numbers at most
        total = np.zeros(d + 1)
        total[sums["k"].to_numpy()] = sums["x"].to_numpy()
        return float(total[0]) + 0.5 * float(beta @ beta), total[1:] + beta

    beta, largest, done = minimise(at, d, tol * max(1.0, weight), max_passes)
    own = beta[1 + len(numeric):]
    by_place = spark.createDataFrame(pa.table({"place": np.arange(len(own)), "coefficient": own}))
    table = index.join(by_place, "place").select("column", "value", "place", "coefficient").checkpoint(eager=True)
    return CategoryModel(scaler, list(cols), float(beta[0]), [float(b) for b in beta[1 : 1 + len(numeric)]], table, done, largest)
