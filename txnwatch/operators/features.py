"""Feature encoding (M1, M2).

Fitting reduces the data to a handful of numbers (means, deviations,
category lists) in one aggregate; transforming is plain column arithmetic,
so the encoded features stay inside whole-stage codegen.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnwatch.schema import CATEGORICAL_FEATURES, NUMERIC_FEATURES


@dataclass
class ScalerParams:
    """M1: population mean and deviation per column (deviation 0 -> 1)."""

    means: dict[str, float]
    scales: dict[str, float]

    def columns(self, suffix: str = "") -> list[Column]:
        return [
            ((F.col(c).cast("double") - F.lit(self.means[c])) / F.lit(self.scales[c])).alias(c + suffix)
            for c in self.means
        ]

    def to_dict(self) -> dict:
        return {"means": self.means, "scales": self.scales}


def fit_standard_scaler(df: DataFrame, cols: list[str] = NUMERIC_FEATURES) -> ScalerParams:
    return fit_scaler_and_count(df, cols)[0]


def fit_scaler_and_count(df: DataFrame, cols: list[str] = NUMERIC_FEATURES) -> tuple[ScalerParams, int]:
    """The scaler and the number of rows, in one aggregate."""
    row = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in cols],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}") for c in cols],
    ).first()
    means = {c: float(row[f"m_{c}"]) if row[f"m_{c}"] is not None else 0.0 for c in cols}
    scales = {}
    for c in cols:
        s = row[f"s_{c}"]
        scales[c] = float(s) if s is not None and not math.isnan(s) and s > 0 else 1.0
    return ScalerParams(means, scales), int(row["n_rows"])


@dataclass
class OneHotParams:
    """M2: sorted known categories per column; unknown -> all zeros, none dropped."""

    categories: dict[str, list[str]] = field(default_factory=dict)

    def names(self) -> list[str]:
        return [f"{c}={v}" for c, vals in self.categories.items() for v in vals]

    def columns(self) -> list[Column]:
        return [
            F.when(F.col(c) == F.lit(v), F.lit(1.0)).otherwise(F.lit(0.0)).alias(f"{c}={v}")
            for c, vals in self.categories.items()
            for v in vals
        ]

    def to_dict(self) -> dict:
        return {"categories": self.categories}


def fit_one_hot(df: DataFrame, cols: list[str] = CATEGORICAL_FEATURES) -> OneHotParams:
    """Distinct values per column. Each is a feature of the model, so the list is as long as the model is wide."""
    cats = {}
    for c in cols:
        distinct = df.select(c).where(F.col(c).isNotNull()).distinct()
        cats[c] = sorted(str(r[0]) for r in distinct.collect())
    return OneHotParams(cats)


@dataclass
class FeatureEncoder:
    scaler: ScalerParams
    onehot: OneHotParams

    def names(self) -> list[str]:
        return list(self.scaler.means) + self.onehot.names()

    def columns(self) -> list[Column]:
        return self.scaler.columns() + self.onehot.columns()

    def encode(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        return df.select(*(keep or []), *self.columns())

    def to_dict(self) -> dict:
        return {**self.scaler.to_dict(), **self.onehot.to_dict()}

    @staticmethod
    def from_dict(d: dict) -> "FeatureEncoder":
        return FeatureEncoder(ScalerParams(d["means"], d["scales"]), OneHotParams(d["categories"]))


def fit_encoder(train: DataFrame) -> FeatureEncoder:
    return FeatureEncoder(fit_standard_scaler(train), fit_one_hot(train))
