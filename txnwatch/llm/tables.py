"""Reading the text tables and shared helpers of this subpackage."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnwatch.session import ensure_checkpoint_dir, ship_package

#: Columns of ``documents``; every filtering stage returns exactly these.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Rows and bytes of an Arrow batch of texts: both the JVM and the Python worker hold a few of them.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def prepare(spark: SparkSession) -> None:
    """Shared checkpoint folder, the package on the workers, and Arrow batches that are small enough for texts."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def release(spark: SparkSession) -> None:
    """Let finished rounds go: shuffle and checkpoint files of frames that nothing refers to are removed when
    the driver collects its garbage, which a job of many small rounds would not make it do by itself."""
    gc.collect()
    try:
        jvm = spark.sparkContext._jvm
    except Exception:  # Spark Connect: the server looks after its own
        return
    jvm.System.gc()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the id and the text (and ``more``), under fixed names: other columns of the
    input, whatever they are called, never meet an operator's own columns."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c) for c in more])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_fold(col: Column) -> Column:
    """crc32 of the decimal text of an id (NULL: the empty text)."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))
