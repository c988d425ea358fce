"""Distributed prefix sums (running totals in a global order).

A window with an ORDER BY and no PARTITION BY runs in one task. Instead:

1. ``repartitionByRange`` on the full order (a hot value of the leading
   column is split across partitions because the later columns are part of
   the range key); each row records its range partition id;
2. the ranged rows are checkpointed to the shared checkpoint folder, so the
   partition ids stay fixed even if an executor is lost and the range bounds
   would be re-sampled on recomputation;
3. local running sums: whole numbers are added up in the sorted partition itself
   (``mapInArrow``, no second shuffle), other sums by a running window per range
   partition (balanced by construction); for plain row numbers, the row's position
   within its partition is read from ``monotonically_increasing_id`` (consecutive
   within a partition; no further shuffle);
4. per-partition totals (one row per partition, a proven bound) are
   collected, turned into offsets and joined back by broadcast.

The number of partitions grows with the bytes that the plan reads, or
with the rows where that estimate is out of hand (``partitions_for``). Only the sums of whole numbers leave the JVM. The order columns must make the order total
(end with a unique key) for a deterministic result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnwatch.session import ensure_checkpoint_dir

PID = "_pid"
#: Bytes of a range partition, by the optimizer's estimate.
PARTITION_BYTES = 128 << 20


def partitions_for(df: DataFrame, each: int = PARTITION_BYTES) -> int:
    """Partitions for ``df``: one for ``each`` bytes, ``spark.sql.shuffle.partitions`` at least.

    The size is the optimizer's estimate of the result or, where joins blow that up, what the plan's leaves read; leaves
    of unknown size (reported as Spark's default of exabytes) count nothing. A checkpointed leaf keeps the
    estimate of the plan that made it, blown up by that plan's joins. So where such a leaf is read and the estimate asks for more than the least, the
    rows are counted, and their number by the width of the schema bounds it.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(s for s in sizes if s < 1 << 60)
    size = min(int(str(plan.stats().sizeInBytes())), known)
    checkpointed = any(leaves.apply(i).getClass().getSimpleName() == "LogicalRDD" for i in range(leaves.size()))
    if checkpointed and size > least * each:
        size = min(size, df.count() * row_bytes(df.schema))
    return max(least, -(-size // each))


FIXED_WIDTH = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


def row_bytes(schema: T.StructType) -> int:
    """Bytes of a row in memory, as Spark lays it out: 8 for each column, and 32 more for each that has no fixed width."""
    return 16 + sum(8 if isinstance(f.dataType, FIXED_WIDTH) else 40 for f in schema.fields)


def _ranged(df: DataFrame, order_cols: list[Column], n: int, ordered: bool = False, local_index: bool = False) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    ranged = df.repartitionByRange(n, *order_cols)
    if ordered or local_index:
        ranged = ranged.sortWithinPartitions(*order_cols)
    ranged = ranged.withColumn(PID, F.spark_partition_id())
    if local_index:
        ranged = ranged.withColumn(
            "_local", F.monotonically_increasing_id() - F.shiftleft(F.col(PID).cast("bigint"), 33)
        )
    return ranged.checkpoint(eager=True)


def _offsets(ranged: DataFrame, totals: dict[str, Column]) -> tuple[DataFrame, dict]:
    """Exclusive running totals of the per-partition totals, as a small frame,
    and the grand totals."""
    spark = ranged.sparkSession
    names = list(totals)
    rows = ranged.groupBy(PID).agg(*[t.alias(k) for k, t in totals.items()]).collect()  # one row per partition
    rows.sort(key=lambda r: r[PID])
    types = {k: ranged.select(totals[k].alias(k)).schema[k].dataType for k in names}
    running = {k: 0 for k in names}
    out = []
    for r in rows:
        out.append((int(r[PID]), *[running[k] for k in names]))
        for k in names:
            running[k] = running[k] + (r[k] or 0)
    schema = T.StructType(
        [T.StructField(PID, T.IntegerType(), False)]
        + [T.StructField(f"_o_{k}", types[k], False) for k in names]
    )
    exact = {T.LongType: int, T.DecimalType: Decimal}
    fixed = [(p, *[exact.get(type(types[k]), float)(v) for k, v in zip(names, vs)]) for p, *vs in out]
    return spark.createDataFrame(fixed, schema), running


def _running(names: list[str]):
    """Running sums of the ``_v_`` columns over a task's rows as they come: one number a column is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upto = dict.fromkeys(names, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            sums = []
            for k in names:
                total = np.cumsum(batch.column(f"_v_{k}").to_numpy(zero_copy_only=False)) + upto[k]
                upto[k] = total[-1]
                sums.append(pa.array(total, pa.int64()))
            columns = [f"_c_{k}" for k in names]
            yield pa.RecordBatch.from_arrays([*batch.columns, *sums], names=[*batch.schema.names, *columns])

    return run


def prefix_sums(
    df: DataFrame,
    order: Sequence[Column | str],
    values: dict[str, Column],
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``name`` = inclusive running sum of ``values[name]`` in ``order``.

    Integral values sum as bigint, others as double; NULL counts 0.
    """
    if not values:
        raise ValueError("no values to sum")
    n = num_partitions or partitions_for(df)
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    names = list(values)
    whole = all(t in ("tinyint", "smallint", "int", "bigint") for _, t in df.select(*values.values()).dtypes)
    given = {f"_v_{k}": F.coalesce(v.cast("bigint") if whole else v, F.lit(0)) for k, v in values.items()}
    ranged = _ranged(df.withColumns(given), order_cols, n, ordered=whole)
    off, _ = _offsets(ranged, {k: F.sum(f"_v_{k}") for k in names})
    if whole:
        fields = [T.StructField(f"_c_{k}", T.LongType()) for k in names]
        local = ranged.mapInArrow(_running(names), T.StructType([*ranged.schema.fields, *fields]))
    else:
        w = Window.partitionBy(PID).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = ranged.withColumns({f"_c_{k}": F.sum(f"_v_{k}").over(w) for k in names})
    joined = local.join(F.broadcast(off), PID, "left")
    out = joined.withColumns({k: F.col(f"_c_{k}") + F.coalesce(F.col(f"_o_{k}"), F.lit(0)) for k in names})
    drop = [PID] + [f"_{p}_{k}" for k in names for p in ("v", "c", "o")]
    return out.drop(*drop)


def row_numbers(df: DataFrame, order: Sequence[Column | str], name: str = "row_number",
                num_partitions: int | None = None) -> DataFrame:
    """1-based position of each row in ``order`` (W4): one range shuffle, no window."""
    n = num_partitions or partitions_for(df)
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = _ranged(df, order_cols, n, local_index=True)
    off, _ = _offsets(ranged, {"_n": F.count(F.lit(1))})
    out = ranged.join(F.broadcast(off), PID, "left").withColumn(
        name, F.col("_local") + F.lit(1) + F.coalesce(F.col("_o__n"), F.lit(0))
    )
    return out.drop(PID, "_local", "_o__n")


QUANTILE_CELLS = 4096


def exact_quantile(df: DataFrame, col: str, q: float) -> float | None:
    """Linear-interpolated quantile (numpy's default), exact and without a sort.

    The value of a rank is found by refining a histogram: each pass counts the
    rows between two bounds in ``QUANTILE_CELLS`` cells, with each cell's least
    and largest value, and goes on in the cell that holds the rank until that
    cell is a single value. One more aggregate gives the next larger value.
    NULL and NaN are left out. Give a frame that is cheap to read again.
    """
    if not 0.0 <= q <= 1.0:
        raise ValueError("q must be in [0, 1]")
    x = F.col("x")
    vals = df.select(F.col(col).cast("double").alias("x")).where(x.isNotNull() & ~F.isnan(x))
    n, low, high = vals.agg(F.count("x"), F.min("x"), F.max("x")).first()
    if not n:
        return None
    position = (n - 1) * q
    below = int(np.floor(position))
    rank = below + 1  # among the rows from low on
    while low < high:
        inside = vals.where(x.between(low, high))
        cell = F.least(F.floor((x - low) / (high - low) * QUANTILE_CELLS), F.lit(QUANTILE_CELLS - 1))
        cells = inside.groupBy(cell.alias("cell")).agg(F.count("x").alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).collect()
        for c in sorted(cells, key=lambda r: r["a"]):
            if rank <= c["n"]:
                low, high = c["a"], c["b"]
                break
            rank -= c["n"]
    if position == below:
        return float(low)
    upto, above = vals.agg(F.count(F.when(x <= low, 1)), F.min(F.when(x > low, x))).first()
    second = low if upto >= below + 2 else above
    return float(low + (second - low) * (position - below))
