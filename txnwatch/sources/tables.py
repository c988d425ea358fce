"""Readers for the provided tables and for raw transaction files (A1-A4)."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from txnwatch.schema import REQUIRED_SOURCE_COLUMNS

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One provided table as a DataFrame (Parquet: pushdown and pruning apply)."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def has_required_columns(df: DataFrame, required: Sequence[str] = REQUIRED_SOURCE_COLUMNS) -> bool:
    """A2: required-column check by set inclusion (driver side, no job)."""
    return set(required) <= set(df.columns)


def read_raw(spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType | None = None) -> DataFrame:
    """A1: read a raw transaction file (CSV with header, or Parquet)."""
    if fmt == "csv":
        reader = spark.read.option("header", True)
        reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
        return reader.csv(path)
    if fmt == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unsupported format {fmt!r}")


def _path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hpath)


def _readable(spark: SparkSession, path: str, fmt: str) -> DataFrame | None:
    """The table if it can be read (its first row as well) and has the required columns. Of a CSV only the header
    and the first row are read here; types are inferred for the source that is chosen, once."""
    try:
        if not _path_exists(spark, path):
            return None
        df = spark.read.option("header", True).csv(path) if fmt == "csv" else read_raw(spark, path, fmt)
        if not has_required_columns(df):
            return None
        df.limit(1).collect()
    except (PySparkException, Py4JError):
        return None
    return df


def choose_source(
    spark: SparkSession,
    candidates: Sequence[tuple[str, str]],
    cache_path: str | None = None,
    force_refresh: bool = False,
) -> DataFrame:
    """A3: first valid source wins.

    ``candidates`` are ``(path, format)`` pairs in preference order. A cached
    copy at ``cache_path`` (Parquet) is used first unless ``force_refresh``;
    an invalid cached copy is ignored. The winner is written to the cache. A
    candidate that cannot be read is passed over like one without the columns.
    """
    if cache_path and not force_refresh and _path_exists(spark, cache_path):
        cached = _readable(spark, cache_path, "parquet")
        if cached is not None:
            return cached
    for path, fmt in candidates:
        if _readable(spark, path, fmt) is not None:
            df = read_raw(spark, path, fmt)
            if cache_path:
                df.write.mode("overwrite").parquet(cache_path)
                return spark.read.parquet(cache_path)
            return df
    raise ValueError("no candidate source has the required columns " + ", ".join(REQUIRED_SOURCE_COLUMNS))


def write_raw(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A4: write a raw table without an index column."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")


def require_columns(df: DataFrame, columns: Sequence[str], what: str = "columns") -> None:
    """Raise when any column is missing (driver side)."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required {what}: {missing}")
