"""Per-account rolling windows.

Semantics (pandas ``rolling("1h")`` on a time index): the frame of a row at
time t is ``(t - W, t]``; a row exactly W older is out. Rows with the same
timestamp are taken one by one in ``tie`` order, so the k-th tied row sees
only the earlier ties. NULL amounts are not counted.

Plan: one scan and one exchange.

* Time is cut into buckets as long as the longest window, so a row's frames lie
  in its own bucket and the one before. Each row is copied to its own bucket
  and, as context, to the next one; rows are dealt by ``(account, bucket)``, to more
  tasks where more bytes are read. The task that deals them out holds what it sends,
  so the markers below are made behind the exchange.
* ``count(t-W, t] = C(t) - C(t-W)`` with C the running count in that group.
  Lower bounds are marker rows at ``t - W``, sorted after data rows of the same
  instant, whose running count is ``C(t - W)``. Running frames are linear in the
  rows; a sliding RANGE frame would be rows x frame.
* The markers' values come back to their row by a second window over
  ``(account, bucket, tie)``, which the same exchange already serves.
* Sums are exact decimals (12 places), so that the difference of two running
  sums loses nothing.

A group holds one account for two buckets. Where that is still too much for a
task, ``split`` takes the same running sums over
the global order of (account, time) with distributed prefix sums, which no key
can skew, at the price of a second exchange that brings the markers back. With ``hot_rows`` the
groups are measured first (``hot_buckets``); accounts with a larger group go through the
split form, all others through the plain one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnwatch.functions.scalars import micros_ntz
from txnwatch.operators.prefix import FIXED_WIDTH, partitions_for, prefix_sums
from txnwatch.schema import DAY_US, HOUR_US

#: Exact for amounts below 1e15 with twelve decimal places; sums have ten more digits.
AMOUNT_TYPE = "decimal(27,12)"
SUM_TYPE = "decimal(37,12)"
#: Rows of one account and bucket that a task takes with ease.
HOT_ROWS = 1_000_000
#: Bytes read for a task of the plain form: files unfold several times in memory, and a row is there with its markers.
TASK_BYTES = 2 << 20
#: While tasks are few they are dealt finer, so that a task's memory is flat from small inputs on: bytes for each, up to so many tasks.
FINE_BYTES, FINE_TASKS = 256 << 10, 1024
#: Hot accounts up to which they are told apart by a broadcast of their numbers (about 2 MB).
BROADCAST_ACCOUNTS = 1 << 17
#: Rows without account or time belong to no window; they are spread over so many groups.
LOOSE_GROUPS = 1 << 20


def _bucket(us: Column, bucket_us: int) -> Column:
    return F.floor(us / F.lit(bucket_us)).cast("bigint")


def hot_buckets(df: DataFrame, bucket_us: int, rows: int, account: str = "account_id",
                ts: str = "transaction_timestamp") -> DataFrame:
    """(account, bucket, rows) of the groups with more than ``rows`` rows; partial counts, so no group is gathered."""
    keyed = df.select(F.col(account), _bucket(micros_ntz(ts), bucket_us).alias("bucket"))
    return keyed.groupBy(account, "bucket").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > rows)


def _copied(df: DataFrame, bucket_us: int, account: str, ts: str, amount: str, tie: str) -> DataFrame:
    """Each row in its own ``_bucket`` (``_ctx`` 0) and, as context, in the next one (``_ctx`` 1), where only account, time and
    amount are of use: what has no fixed width is left out there."""
    given = [c for c in df.columns if c not in (account, ts, amount) and not isinstance(df.schema[c].dataType, FIXED_WIDTH)]
    usable = F.col(account).isNotNull() & F.col(ts).isNotNull()
    loose = F.lit(-1) - F.pmod(F.xxhash64(tie), F.lit(LOOSE_GROUPS))
    bucket = F.when(usable, _bucket(micros_ntz(ts), bucket_us)).otherwise(loose)
    out = df.select(*[F.col(f"`{c}`") for c in df.columns], bucket.alias("_bucket"), F.explode(F.array(F.lit(0), F.lit(1))).alias("_ctx"))
    changed = {c: F.when(F.col("_ctx") == 0, F.col(f"`{c}`")) for c in given}
    return out.withColumns(changed | {"_bucket": F.col("_bucket") + F.when(usable, F.col("_ctx")).otherwise(0)})


def _marked(df: DataFrame, windows: dict[str, int], account: str, ts: str, amount: str, tie: str,
            context_us: int | None, tasks: int | None = None) -> DataFrame:
    """Rows and their markers: ``_kind`` 0 for a row, i for the lower bound of window i, -1 for the
    context copy in the next bucket, which has no markers. Only a row itself carries texts and the like.
    With buckets the rows are dealt by them first, to ``tasks`` tasks: a task holds all rows that it deals out."""
    carried = [c for c in df.columns if c not in (account, ts, tie) and not isinstance(df.schema[c].dataType, FIXED_WIDTH)]
    columns = [F.col(f"`{c}`") for c in df.columns] + ([F.col("_bucket")] if context_us else [])
    us, amt = micros_ntz(ts), F.col(amount).cast(AMOUNT_TYPE)
    own = F.struct(F.lit(0).alias("k"), us.alias("u"), amt.alias("a"))
    variants = F.array(own, *[
        F.struct(F.lit(i).alias("k"), (us - F.lit(int(w))).alias("u"), F.lit(None).cast(AMOUNT_TYPE).alias("a"))
        for i, w in enumerate(windows.values(), start=1)
    ])
    if context_us:
        df = _copied(df, context_us, account, ts, amount, tie)
        df = df.repartition(*([tasks] if tasks else []), F.col(account), F.col("_bucket"))
        context = F.struct(F.lit(-1).alias("k"), us.alias("u"), amt.alias("a"))
        variants = F.when(F.col("_ctx") == 0, variants).otherwise(F.array(context))
    out = df.select(*columns, F.explode(variants).alias("_v"))
    out = out.select("*", F.col("_v.k").alias("_kind"), F.col("_v.u").alias("_us"), F.col("_v.a").alias("_amt")).drop("_v")
    return out.withColumns({c: F.when(F.col("_kind") == 0, F.col(f"`{c}`")) for c in carried})


def account_window_stats(
    df: DataFrame,
    windows: dict[str, int],
    account: str = "account_id",
    ts: str = "transaction_timestamp",
    amount: str = "Amount",
    tie: str = "transaction_id",
    bucket_us: int | None = None,
    split: bool = False,
    hot_rows: int | None = None,
) -> DataFrame:
    """Add ``{name}_count`` (bigint) and ``{name}_sum`` (decimal) for each window.

    ``hot_rows`` measures the groups (one aggregate, run at once; give a frame that is cheap to read
    again) and splits the accounts that have a larger one; results do not depend on it.

    ``windows`` maps a name to a window length in microseconds. ``tie`` must be
    a unique, non-NULL row key; it orders rows with equal timestamps. Rows with
    a NULL account or timestamp get NULL statistics.
    """
    if not windows:
        raise ValueError("at least one window is required")
    bucket_us = bucket_us or max(windows.values())
    if bucket_us < max(windows.values()):
        raise ValueError("a bucket must be as long as the longest window")
    if hot_rows is not None and not split:
        hot = hot_buckets(df, bucket_us, hot_rows, account, ts).where(F.col(account).isNotNull()).select(account).distinct().checkpoint()
        n = hot.count()
        if n:
            few = F.broadcast(hot) if n <= BROADCAST_ACCOUNTS else hot
            parts = [
                account_window_stats(df.join(few, account, how).select(*df.columns), windows, account, ts, amount, tie, bucket_us, split=form)
                for how, form in (("left_anti", False), ("left_semi", True))
            ]
            return parts[0].unionByName(parts[1])
    names = list(windows)
    # At one instant rows and context come in tie order, markers after them.
    place = F.when(F.col("_kind") > 0, F.col("_kind")).otherwise(0)
    if split:
        marked = _marked(df, windows, account, ts, amount, tie, None).withColumn("_place", place)
        one = F.col("_amt").isNotNull().cast("bigint")
        summed = prefix_sums(marked, [F.col(account), "_us", "_place", F.col(tie)], {"_cn": one, "_cs": F.col("_amt")})
        group = Window.partitionBy(tie)
    else:
        # More groups of (account, bucket) in a task are more memory: the tasks grow in number with the input.
        n = max(partitions_for(df, TASK_BYTES), min(partitions_for(df, FINE_BYTES), FINE_TASKS))
        tasks = n if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None
        marked = _marked(df, windows, account, ts, amount, tie, bucket_us, tasks).withColumn("_place", place)
        running = Window.partitionBy(account, "_bucket").orderBy("_us", "_place", tie)
        running = running.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        zero = F.lit(0).cast(SUM_TYPE)
        sums = {"_cn": F.count("_amt").over(running), "_cs": F.coalesce(F.sum("_amt").over(running), zero)}
        summed = marked.withColumns(sums).where(F.col("_kind") >= 0)
        group = Window.partitionBy(account, "_bucket", tie)
    lows = {
        f"_low_{what}{i}": F.max(F.when(F.col("_kind") == i, F.col(f"_c{what}"))).over(group)
        for i in range(1, len(names) + 1)
        for what in "ns"
    }
    stats = summed.withColumns(lows).where(F.col("_kind") == 0)
    usable = F.col(account).isNotNull() & F.col(ts).isNotNull()
    values = []
    for i, name in enumerate(names, start=1):
        n, total = F.col("_cn") - F.col(f"_low_n{i}"), F.col("_cs") - F.col(f"_low_s{i}")
        values.append(F.when(usable, n).cast("bigint").alias(f"{name}_count"))
        values.append(F.when(usable, total).cast(SUM_TYPE).alias(f"{name}_sum"))
    return stats.select(*[F.col(f"`{c}`") for c in df.columns], *values)


def rolling_mean(count_col: str, sum_col: str):
    """Mean from an exact sum and a count; NULL when the frame has no values."""
    return F.when(F.col(count_col) > 0, F.col(sum_col).cast("double") / F.col(count_col).cast("double"))


def add_account_rollups(
    df: DataFrame,
    account: str = "account_id",
    ts: str = "transaction_timestamp",
    amount: str = "Amount",
    tie: str = "transaction_id",
    bucket_us: int | None = None,
    split: bool = False,
    hot_rows: int | None = None,
) -> DataFrame:
    """W1 + W2: ``velocity_1h`` (1h count, missing -> 1.0) and ``avg_amount_24h``
    (24h mean, missing -> own Amount), both double."""
    stats = account_window_stats(
        df, {"_w1h": HOUR_US, "_w24h": DAY_US}, account=account, ts=ts, amount=amount, tie=tie,
        bucket_us=bucket_us, split=split, hot_rows=hot_rows,
    )
    return stats.withColumns(
        {
            "velocity_1h": F.coalesce(F.col("_w1h_count").cast("double"), F.lit(1.0)),
            "avg_amount_24h": F.coalesce(rolling_mean("_w24h_count", "_w24h_sum"), F.col(amount).cast("double")),
        }
    ).drop("_w1h_count", "_w1h_sum", "_w24h_count", "_w24h_sum")


def rolling_count_mean(
    df: DataFrame,
    window_us: int,
    account: str,
    ts: str,
    amount: str,
    tie: str,
    bucket_us: int | None = None,
    prefix: str = "roll",
    split: bool = False,
) -> DataFrame:
    """Generic form: ``{prefix}_count`` and ``{prefix}_mean`` over ``(t - W, t]``."""
    stats = account_window_stats(df, {"_w": window_us}, account=account, ts=ts, amount=amount, tie=tie,
                                 bucket_us=bucket_us, split=split)
    return stats.withColumns(
        {f"{prefix}_count": F.col("_w_count"), f"{prefix}_mean": rolling_mean("_w_count", "_w_sum")}
    ).drop("_w_count", "_w_sum")
