"""Tables under one root that change together, by versioned snapshots of immutable segments.

A write puts its files into a new segment, a folder of its own in each dataset
(``<dataset>/seg=<name>/...``), and then publishes a snapshot: one small JSON file that lists the
segments. Readers take the newest snapshot, so they see all datasets of a write or none; a writer that dies
before it publishes leaves files that no snapshot names. Publishing is a rename that
fails where the version exists, so of two writers that started from one version the later one is refused.

Keys are looked up in a dataset of their own, ``keys``, whose segments are bucketed by a hash of the
key. A bucket holds ``BUCKET_ROWS`` rows or so whatever the size of the segment, so what a batch reads to look
its keys up is bounded by the batch and does not grow with the store.

Many small segments are merged into one (``compact``): those of a similar size together, so that a row
is rewritten a logarithmic number of times. Snapshots that are no longer kept go, and the segments that only they named.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = "keys"
#: Rows of a bucket of keys, and the most buckets of one segment.
BUCKET_ROWS, MOST_BUCKETS = 1 << 16, 1 << 20
#: Up to this many buckets are opened by their paths; beyond it the segment's folder is listed.
OPENED = 512
#: Snapshots kept for readers that started earlier, and segments from which on small ones are merged.
KEPT, MOST_SEGMENTS = 8, 24
#: A merge takes all segments that are not this many times larger than the smaller ones together.
TIER = 2


class ConflictError(RuntimeError):
    """Another writer published since this one read its snapshot; read again and repeat."""


@dataclass(frozen=True)
class Segment:
    """``rows`` by dataset, and the number of buckets of its keys."""

    name: str
    rows: dict[str, int] = field(default_factory=dict)
    buckets: int = 1

    def size(self) -> int:
        return sum(self.rows.values())


@dataclass(frozen=True)
class Snapshot:
    """Version 0 is the root before anything was published."""

    version: int = 0
    segments: tuple[Segment, ...] = ()
    marks: dict = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"version": self.version, "marks": self.marks, "segments": [vars(s) for s in self.segments]})

    @staticmethod
    def parsed(text: str) -> Snapshot:
        raw = json.loads(text)
        return Snapshot(raw["version"], tuple(Segment(**s) for s in raw["segments"]), raw["marks"])


def _folder(root: str) -> str:
    return f"{root.rstrip('/')}/_snapshots"


def _files(spark: SparkSession, path: str):
    """(path, file system) of Hadoop, which every store that Spark reads has."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, root: str) -> list[int]:
    path, fs = _files(spark, _folder(root))
    if not fs.exists(path):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(path)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _at(spark: SparkSession, root: str, version: int) -> Snapshot:
    path, fs = _files(spark, f"{_folder(root)}/{version:020d}.json")
    stream = fs.open(path)
    try:
        data = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)
    finally:
        stream.close()
    return Snapshot.parsed(bytes(data).decode())


def current(spark: SparkSession, root: str) -> Snapshot:
    """The newest published snapshot."""
    versions = _versions(spark, root)
    return _at(spark, root, versions[-1]) if versions else Snapshot()


def publish(spark: SparkSession, root: str, base: Snapshot, segments: tuple[Segment, ...] | list[Segment], marks: dict) -> Snapshot:
    """Make ``segments`` the content of the root, if ``base`` is still its newest snapshot."""
    new = Snapshot(base.version + 1, tuple(segments), marks)
    target, fs = _files(spark, f"{_folder(root)}/{new.version:020d}.json")
    draft, _ = _files(spark, f"{_folder(root)}/.draft-{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    try:
        stream.write(bytearray(new.text().encode()))
    finally:
        stream.close()
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs
    none = sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        hadoop.FileContext.getFileContext(target.toUri(), sc._jsc.hadoopConfiguration()).rename(draft, target, none)
    except Exception as error:
        fs.delete(draft, False)
        if fs.exists(target):
            raise ConflictError(f"version {new.version} of {root} exists") from error
        raise
    return new


# ---------------------------------------------------------------- datasets
def new_name() -> str:
    return uuid.uuid4().hex


def dataset_path(root: str, dataset: str, segment: str = "") -> str:
    base = f"{root.rstrip('/')}/{dataset}"
    return f"{base}/seg={segment}" if segment else base


def write_by(df: DataFrame, root: str, dataset: str, segment: str, partition: str, *sort: str) -> None:
    """One dataset of a segment, partitioned by a column and sorted within.

    REBALANCE by the partition column: each task writes few values (files ~ tasks + values, not
    tasks x values) and a hot value is split over several tasks.
    """
    rows = df.hint("rebalance", partition).sortWithinPartitions(partition, *sort)
    rows.write.mode("overwrite").partitionBy(partition).parquet(dataset_path(root, dataset, segment))


def read(spark: SparkSession, root: str, dataset: str, snapshot: Snapshot, schema: T.StructType) -> DataFrame:
    """A dataset as of a snapshot. The schema is given, not inferred."""
    paths = [dataset_path(root, dataset, s.name) for s in snapshot.segments if s.rows.get(dataset)]
    if not paths:
        return spark.createDataFrame([], schema)
    full = T.StructType([*schema.fields, T.StructField("seg", T.StringType())])
    found = spark.read.schema(full).option("basePath", dataset_path(root, dataset)).parquet(*paths)
    return found.select(*schema.names)


# ---------------------------------------------------------------- keys
def buckets_for(rows: int) -> int:
    """A power of two, so that the buckets of a smaller segment are those of a larger one folded."""
    return min(1 << max(-(-rows // BUCKET_ROWS) - 1, 0).bit_length(), MOST_BUCKETS)


def bucket_of(key: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_keys(df: DataFrame, key: str, root: str, segment: str, rows: int) -> int:
    """Write the rows of ``df`` by the bucket of their key; the number of buckets."""
    buckets = buckets_for(rows)
    bucketed = df.withColumn("bucket", bucket_of(key, buckets))
    # Buckets are of one size, so a bucket is dealt to one task.
    dealt = bucketed.repartition(min(buckets, 4096), "bucket") if buckets > 1 else bucketed.coalesce(1)
    dealt.sortWithinPartitions("bucket", key).write.mode("overwrite").partitionBy("bucket").parquet(dataset_path(root, KEYS, segment))
    return buckets


def look_up(spark: SparkSession, root: str, snapshot: Snapshot, keys: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of the key dataset whose key (the one column of ``keys``) is asked for.

    Only buckets that an asked key falls into are opened. Which they are is found in the cluster; at most
    their numbers, ``OPENED`` of them, come to the driver.
    """
    key = keys.columns[0]
    full = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("seg", T.StringType())])
    held = [s for s in snapshot.segments if s.rows.get(KEYS)]
    if not held:
        return spark.createDataFrame([], schema)
    base = spark.read.schema(full).option("basePath", dataset_path(root, KEYS))
    most = max(s.buckets for s in held)
    asked = [r[0] for r in keys.select(bucket_of(key, most).alias("bucket")).distinct().limit(OPENED + 1).collect()] if most > 1 else [0]
    paths = []
    for s in held:
        folder = dataset_path(root, KEYS, s.name)
        if s.buckets == 1 or len(asked) > OPENED:
            paths.append(folder)
            continue
        for b in sorted({b & (s.buckets - 1) for b in asked}):
            path, fs = _files(spark, f"{folder}/bucket={b}")
            if fs.exists(path):  # an empty bucket has no folder
                paths.append(f"{folder}/bucket={b}")
    if not paths:
        return spark.createDataFrame([], schema)
    return base.parquet(*paths).join(keys, key, "left_semi").select(*schema.names)


# ---------------------------------------------------------------- upkeep
def mergeable(segments: tuple[Segment, ...], most: int = MOST_SEGMENTS) -> list[Segment]:
    """The small segments to merge: from the smallest on, until one outweighs those before it ``TIER`` times."""
    if len(segments) <= most:
        return []
    chosen: list[Segment] = []
    for s in sorted(segments, key=Segment.size):
        if len(chosen) > 1 and s.size() > TIER * sum(c.size() for c in chosen):
            break
        chosen.append(s)
    return chosen if len(chosen) > 1 else []


def compact(
    spark: SparkSession, root: str, layout: dict[str, tuple[T.StructType, str, str]], keys: tuple[T.StructType, str], most: int = MOST_SEGMENTS
) -> int:
    """Merge small segments into one, publish, and ``expire``; how many segments were merged.

    ``layout`` has the schema, the partition column and the sort column of each dataset, ``keys`` the schema and the key.
    """
    base = current(spark, root)
    chosen = mergeable(base.segments, most)
    if not chosen:
        return 0
    old, name, rows = Snapshot(segments=tuple(chosen)), new_name(), {}
    for dataset, (schema, partition, sort) in layout.items():
        rows[dataset] = sum(s.rows.get(dataset, 0) for s in chosen)
        if rows[dataset]:
            write_by(read(spark, root, dataset, old, schema), root, dataset, name, partition, sort)
    rows[KEYS] = sum(s.rows.get(KEYS, 0) for s in chosen)
    buckets = write_keys(read(spark, root, KEYS, old, keys[0]), keys[1], root, name, rows[KEYS]) if rows[KEYS] else 1
    left = [s for s in base.segments if s not in chosen]
    publish(spark, root, base, [*left, Segment(name, rows, buckets)], base.marks)
    expire(spark, root)
    return len(chosen)


def expire(spark: SparkSession, root: str, keep: int = KEPT) -> int:
    """Drop all but the newest ``keep`` snapshots and the segments that only dropped ones name; how many segments went.

    Files of writers that have not published yet are in no snapshot and stay.
    """
    versions = _versions(spark, root)
    old, kept = versions[:-keep], versions[-keep:]
    if not old:
        return 0
    living = {s.name for v in kept for s in _at(spark, root, v).segments}
    gone = {s.name: s for v in old for s in _at(spark, root, v).segments if s.name not in living}
    for s in gone.values():
        for dataset in s.rows:
            path, fs = _files(spark, dataset_path(root, dataset, s.name))
            fs.delete(path, True)
    for v in old:  # the segments go first: an interrupted run is repeated by the next one
        path, fs = _files(spark, f"{_folder(root)}/{v:020d}.json")
        fs.delete(path, False)
    return len(gone)

