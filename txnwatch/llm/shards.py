"""Contiguous shards of near-equal bytes from global prefix sums.

The rows are ranged by (id, size, crc, arrival), so a hot id or a run of
repeated rows is split over partitions; only three numbers a row are shuffled,
never the text. The ranged rows are written to the shared checkpoint folder,
so that partition numbers hold when an executor is lost. Each partition sums
its own rows; the totals of the partitions (one row each) give every partition
its global offset, and a row's shard is where the middle of its bytes falls
when the total is cut at equal targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnwatch.llm.tables import prepare, shuffle_partitions, text_rows

#: Bytes that a row costs besides its text.
ROW_BYTES = 16


def shard_by_bytes(
    docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Shards are contiguous in (doc_id, size, crc) order with nulls first, and
    hold total / shards bytes give or take one row. A null text counts as no
    text (crc 0), repeated rows each take a slot, an empty table gives no rows,
    a row larger than a shard leaves neighbouring shards short or empty.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    spark = docs.sparkSession
    prepare(spark)
    n = partitions or shuffle_partitions(spark)
    raw = F.col("text").cast("binary")
    rows = text_rows(docs, id_col, text_col).select(
        "doc_id",
        (F.coalesce(F.octet_length(raw), F.lit(0)).cast("bigint") + ROW_BYTES).alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0).cast("bigint")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("arrival"),
    )
    order = ["doc_id", "size", "text_crc32", "arrival"]
    ranged = (
        rows.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .select(
            "doc_id", "size", "text_crc32", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")
        )
        .checkpoint(eager=True)
    )
    # One row per partition: the only ordered pass over all of them.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(every).alias("bytes_all"),
    )
    upto = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        ranged.withColumns({"local": F.sum("size").over(upto), "nth": F.row_number().over(upto)})
        .join(F.broadcast(offsets), "part")
        .withColumn("middle", ((F.col("bytes_before") + F.col("local")) * 2 - F.col("size")).cast("decimal(38,0)"))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.expr(f"int((middle * {int(shards)}) div (bytes_all * 2))").alias("shard"),
            (F.col("rows_before") + F.col("nth")).alias("nth"),
        )
    )
    firsts = placed.groupBy("shard").agg(F.min("nth").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("nth") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
