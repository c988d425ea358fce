"""Near duplicates by chosen-path set similarity join.

A document is its set of distinct five-word shingles. Documents with the same
set form a class and need no comparison. For each of ``trees`` independent
trees a class chooses tokens by min-wise hashing, one a level; classes that
chose the same tokens so far share a node. Nodes start at ``START`` levels and are
compared exhaustively. The classes of nodes of more than ``LARGE`` classes go through a
forest of ``FOREST`` more trees instead, whose nodes branch on the next chosen token
while they are larger than that, down to ``LEVELS`` levels.

Links only have to give the right components, so two classes that are already
connected are never compared. First every class meets the smallest class of
each of its nodes. In what is left, classes of different components of a node
meet: in nodes of at most ``SMALL`` classes as pairs, in larger ones in blocks, where the
classes outside the node's largest component are held against all of the node,
and at most one link is kept for a class and a component. Every link is confirmed on
the full sets of both texts. A pair at the threshold of 0.75 shares a node of
two levels in at least one of 16 trees with probability 1 - (1 - 0.75**2)**16,
that is, all but two in a million; more similar ones almost surely. In the forest
it shares a node of whatever level with 1 - (1 - 0.75**6)**67 at least, which is the same.

Class ids are 64 bits of a 128-bit digest of the set. Sketches bound what is
shuffled; texts are read again only for classes in a candidate pair, found with
a filter of fixed size, and travel compressed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnwatch.llm import textvec as tv
from txnwatch.llm.filters import HashFilter
from txnwatch.llm.graphs import components, merged
from txnwatch.llm.tables import prepare, release, text_rows

SHINGLE = 5
PERCENT = 75
TREES = 16
START, LEVELS = 2, 6
#: Trees for classes of large nodes: as likely to join a pair by six levels as ``TREES`` are by two.
FOREST = 67
SMALL = 48
LARGE = 1 << 14
#: Classes of a block of a larger node.
BLOCK = 1 << 10
#: A pair at the threshold agrees on 72 of 96 hashes, with a deviation of 4.2; 50 is five deviations below.
AGREE = 50


def _functions(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    xor, mul = (np.random.default_rng(seed + k).integers(0, 2**64, n, dtype=tv.U) for k in (0, 1))
    return xor, mul | tv.U(1)


_SKETCH = _functions(61, TREES * LEVELS)
_WOOD = _functions(63, FOREST * LEVELS)
_BLOCK = 2048


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; none without words, one for fewer words than ``size``."""
    for _, _, data, offsets in tv.chunks(column):
        data = tv.LOWER[data]
        words = tv.Words(data, offsets)
        hashes = tv.Hasher(data).spans(words.start, words.end)
        grams, at = tv.grams(hashes, words.text, size)
        bounds = np.searchsorted(words.text[at], np.arange(len(offsets)))
        for k in range(len(offsets) - 1):
            if words.counts[k] >= size:
                yield np.unique(grams[bounds[k] : bounds[k + 1]])
            elif words.counts[k]:
                few = hashes[words.bounds[k] : words.bounds[k + 1]]
                yield tv.mix((few * tv.PLACE[: len(few)]).sum(keepdims=True, dtype=tv.U) + tv.U(len(few)))
            else:
                yield np.zeros(0, tv.U)


def _minima(shingles: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    xor, mul = functions
    low = np.full(len(xor), np.iinfo(tv.U).max, tv.U)
    for k in range(0, len(shingles), _BLOCK):
        part = shingles[None, k : k + _BLOCK] ^ xor[:, None]
        part *= mul[:, None]
        np.minimum(low, part.min(1), out=low)
    return low


def _paths(low: np.ndarray) -> np.ndarray:
    """Node keys of each tree (row) by level; the path of a tree at level d is its first d chosen tokens."""
    levels = low.reshape(-1, LEVELS)
    path, mine = np.arange(len(levels), dtype=tv.U), []
    for d in range(LEVELS):
        path = tv.mix(path * tv.PLACE[d] + levels[:, d])
        if d + 1 >= START:
            mine.append(path)
    return np.stack(mine, 1).astype(np.int64, casting="unsafe")


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, ids, paths, marks = [], [], [], []
        for s in shingle_sets(batch.column("text")):
            sizes.append(len(s))
            if not len(s):
                ids.append(None)
                paths.append(None)
                marks.append(None)
                continue
            low = _minima(s, _SKETCH)
            ids.append(int.from_bytes(xxhash.xxh3_128_digest(s.tobytes())[:8], "little", signed=True))
            paths.append(_paths(low).tobytes())
            marks.append((tv.mix(low) & tv.U(255)).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()),
             pa.array(paths, pa.binary()), pa.array(marks, pa.binary())],
            names=["doc_id", "text_hash", "n_shingles", "cls", "paths", "marks"],
        )


def _node_rows(cls: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    """A row for each class and tree: the node keys at all levels."""
    width = LEVELS - START + 1
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(cls, len(keys) // max(1, len(cls)))), *[pa.array(np.ascontiguousarray(keys[:, k])) for k in range(width)]],
        names=["cls", *[f"k{START + k}" for k in range(width)]],
    )


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = LEVELS - START + 1
    for batch in batches:
        cls = batch.column("cls").to_numpy()
        data, _ = tv.raw(batch.column("paths"))
        yield _node_rows(cls, np.frombuffer(data.tobytes(), np.int64)[: len(cls) * TREES * width].reshape(-1, width))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 64):
            part = batch.slice(at, 64)
            keys = [_paths(_minima(s, _WOOD)) for s in _texts_sets(part.column("blob").to_pylist())]
            yield _node_rows(part.column("cls").to_numpy(), np.concatenate(keys))


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches agree as often as pairs near the threshold do."""
    for batch in batches:
        one, other = (np.frombuffer(tv.raw(batch.column(c))[0].tobytes(), np.uint8) for c in ("marks_a", "marks_b"))
        wide = TREES * LEVELS
        n = len(batch)
        same = (one[: n * wide].reshape(n, wide) == other[: n * wide].reshape(n, wide)).sum(1)
        yield batch.select(["a", "b", "text_a", "text_b"]).filter(pa.array(same >= AGREE))


def _texts_sets(blobs: list[bytes]) -> list[np.ndarray]:
    unpack = zstandard.ZstdDecompressor().decompress
    return list(shingle_sets(pa.array([unpack(x) for x in blobs], pa.large_binary())))


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                sets = [_texts_sets(part.column(c).to_pylist()) for c in ("blob_a", "blob_b")]
                keep = []
                for x, y in zip(*sets, strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _compare_block(percent: int):
    """Links between the searching classes of a block and its targets: one for a class and a component."""

    def run(table: pa.Table) -> pa.Table:
        cls, label = (table.column(c).to_numpy() for c in ("cls", "label"))
        seeks = np.flatnonzero(table.column("seeks").to_numpy(zero_copy_only=False))
        targets = np.flatnonzero(~table.column("seeks").to_numpy(zero_copy_only=False))
        found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(seeks) and len(targets):
            sets = _texts_sets(table.column("blob").to_pylist())
            sizes = np.array([len(s) for s in sets])
            starts = np.concatenate([[0], np.cumsum(sizes)])
            words, numbers = np.unique(np.concatenate(sets), return_inverse=True)
            mine = [numbers[starts[k] : starts[k + 1]] for k in range(len(sets))]
            held = np.concatenate([mine[k] for k in targets])
            cuts = np.concatenate([[0], np.cumsum(sizes[targets])])[:-1]
            here = np.zeros(len(words), np.int32)
            for x in seeks:
                here[mine[x]] = 1
                both = np.add.reduceat(here[held], cuts)
                here[mine[x]] = 0
                like = (100 * both >= percent * (sizes[x] + sizes[targets] - both)) & (label[targets] != label[x])
                hit = targets[like]
                if len(hit):
                    hit = hit[np.unique(label[hit], return_index=True)[1]]
                    found_a.append(np.full(len(hit), cls[x]))
                    found_b.append(cls[hit])
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return run


def _packed(wanted: HashFilter):
    """Texts whose hash is in the filter, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            hit = np.flatnonzero(wanted.passes(batch.column("text_hash").to_numpy()))
            column, hashes = batch.column("text"), batch.column("text_hash")
            for at in range(0, len(hit), 1000):
                some = pa.array(hit[at : at + 1000])
                blobs = [pack(t.encode()) for t in column.take(some).to_pylist()]
                yield pa.RecordBatch.from_arrays([hashes.take(some), pa.array(blobs, pa.binary())], names=["text_hash", "blob"])

    return run


_NODE = "cls bigint, " + ", ".join(f"k{d} bigint" for d in range(START, LEVELS + 1))


class Join:
    """State of one join: the texts, the classes with their sketches, and the links found so far."""

    def __init__(self, docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"):
        if not PERCENT <= percent <= 100:
            raise ValueError(f"a percentage from {PERCENT} to 100: the trees and the sketches' bound are set for {PERCENT}")
        prepare(docs.sparkSession)
        self.percent = percent
        text = F.coalesce(F.col("text"), F.lit(""))
        self.texts = text_rows(docs, id_col, text_col).select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash"))
        kind = dict(self.texts.dtypes)["doc_id"]
        schema = f"doc_id {kind}, text_hash bigint, n_shingles bigint, cls bigint, paths binary, marks binary"
        sketched = self.texts.mapInArrow(_sketch, schema)
        # The smallest text of a class stands for it.
        self.rows = sketched.checkpoint()
        first = F.first
        self.classes = (
            self.rows.where(F.col("cls").isNotNull())
            .groupBy("cls")
            .agg(F.min("text_hash").alias("text_hash"), first("paths").alias("paths"), first("marks").alias("marks"))
            .checkpoint()
        )
        self.nodes = self.classes.select("cls", "paths").mapInArrow(_nodes, _NODE)

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are similar, judged on full sets."""
        side = self.classes.select("cls", "text_hash", "marks")
        one = side.toDF("a", "text_a", "marks_a")
        other = side.toDF("b", "text_b", "marks_b")
        close = (
            pairs.join(one, "a").join(other, "b").select("a", "b", "text_a", "text_b", "marks_a", "marks_b")
            .mapInArrow(_agreeing, "a bigint, b bigint, text_a bigint, text_b bigint")
            .checkpoint()
        )
        release(pairs.sparkSession)
        blobs = self.blobs(close.select(F.col("text_a").alias("text_hash")).union(close.select("text_b")))
        return (
            close.join(blobs.toDF("text_a", "blob_a"), "text_a")
            .join(blobs.toDF("text_b", "blob_b"), "text_b")
            .select("a", "b", "blob_a", "blob_b")
            .mapInArrow(_confirm(self.percent), "a bigint, b bigint")
            .checkpoint()
        )

    def blobs(self, wanted: DataFrame) -> DataFrame:
        """(text_hash, blob): each wanted text once, compressed."""
        wanted = wanted.distinct().checkpoint()
        found = (
            self.texts.select("text_hash", "text")
            .mapInArrow(_packed(HashFilter.of(wanted, "text_hash")), "text_hash bigint, blob binary")
            .groupBy("text_hash")
            .agg(F.first("blob").alias("blob"))
        )
        return found.join(wanted, "text_hash", "left_semi").checkpoint()

    def forest(self, wanted: DataFrame) -> DataFrame:
        """Nodes of the forest for the wanted classes."""
        text = wanted.join(self.classes.select("cls", "text_hash"), "cls").checkpoint()
        packed = text.join(self.blobs(text.select("text_hash")), "text_hash").select("cls", "blob")
        return packed.mapInArrow(_forest, _NODE).checkpoint()

    def in_blocks(self, members: DataFrame) -> DataFrame:
        """Links across the components of larger nodes: members are (node, size, cls, label)."""
        counts = members.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"))
        largest = counts.groupBy("node").agg(F.max(F.struct("n", "label")).alias("most")).select("node", F.col("most.label").alias("main"))
        blocks, searches = F.ceil(F.col("size") / BLOCK).cast("int"), F.ceil(F.col("size") / LARGE).cast("int")
        dealt = members.join(largest, "node").withColumns({"blocks": blocks, "searches": searches})
        own = lambda n, salt: F.pmod(F.xxhash64("cls", F.lit(salt)), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        targets = dealt.withColumn("block", own("blocks", 1)).select("node", "cls", "label", "block", every("searches").alias("search"))
        seekers = dealt.where(F.col("label") != F.col("main")).withColumn("search", own("searches", 2))
        seekers = seekers.select("node", "cls", "label", "search", every("blocks").alias("block"))
        rows = targets.withColumn("seeks", F.lit(False)).unionByName(seekers.withColumn("seeks", F.lit(True)))
        text = self.classes.select("cls", "text_hash")
        wanted = members.select("cls").distinct().join(text, "cls").checkpoint()
        blobs = wanted.join(self.blobs(wanted.select("text_hash")), "text_hash").select("cls", "blob")
        met = rows.join(blobs, "cls").groupBy("node", "block", "search")
        return met.applyInArrow(_compare_block(self.percent), "a bigint, b bigint").distinct().checkpoint()


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.drop("label").join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))


def _across(members: DataFrame, key: str) -> DataFrame:
    """Pairs of classes of one node that are in different components."""
    x, y = members.select(key, "cls", "label").alias("x"), members.select(key, "cls", "label").alias("y")
    met = x.join(y, (F.col(f"x.{key}") == F.col(f"y.{key}")) & (F.col("x.cls") < F.col("y.cls")) & (F.col("x.label") != F.col("y.label")))
    return met.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct()


def _mixed(members: DataFrame, key: str) -> DataFrame:
    """Members of nodes that hold more than one component."""
    ends = members.groupBy(key).agg(F.min("label").alias("low"), F.max("label").alias("high"))
    return members.join(ends.where(F.col("low") != F.col("high")).select(key), key)


def _leaves(nodes: DataFrame) -> DataFrame:
    """(node, size, cls): classes that are not alone in the node of the first level that is not too large;
    those of the last level stay as they are."""
    found, rest = [], nodes
    for d in range(START, LEVELS + 1):
        key = f"k{d}"
        sizes = rest.groupBy(key).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        sized = rest.join(sizes, key).checkpoint()
        fits = (F.col("size") <= LARGE) | F.lit(d == LEVELS)
        found.append(sized.where(fits).select(F.col(key).alias("node"), "size", "cls"))
        rest = sized.where(~fits).drop(key, "size")
        if not rest.limit(1).count():
            break
    return reduce(DataFrame.unionByName, found)


def links(join: Join) -> tuple[DataFrame, DataFrame]:
    """(links between classes, labels): links that connect exactly the components of all similar pairs."""
    top = f"k{START}"
    # Round one: every class with the smallest class of each of its nodes.
    nodes, spark = join.nodes, join.texts.sparkSession
    release(spark)
    pivots = nodes.groupBy(top).agg(F.min("cls").alias("pivot"), F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = nodes.join(pivots, top).checkpoint()
    stars = shared.where(F.col("cls") != F.col("pivot")).select(*_ordered(F.col("cls"), F.col("pivot"))).distinct()
    found = join.confirmed(stars)
    labels = components(found).withColumnRenamed("node", "cls")
    release(spark)
    # Round two: across the components of each node, small ones as pairs.
    members = _mixed(_labelled(shared.drop("pivot"), labels), top).checkpoint()
    branched = members.where(F.col("size") > LARGE).select("cls").distinct().checkpoint()
    members = members.where(F.col("size") <= LARGE).withColumnRenamed(top, "node").select("node", "size", "cls", "label")
    if branched.limit(1).count():
        leaves = _mixed(_labelled(_leaves(join.forest(branched)), labels), "node")
        members = members.unionByName(leaves).checkpoint()
        release(spark)
    more = join.confirmed(_across(members.where(F.col("size") <= SMALL), "node"))
    release(spark)
    found, labels = found.unionByName(more), merged(labels, more, "cls")
    release(spark)
    # Round three: larger nodes in blocks.
    large = _mixed(_labelled(members.where(F.col("size") > SMALL), labels), "node").checkpoint()
    if large.limit(1).count():
        more = join.in_blocks(large)
        release(spark)
        found, labels = found.unionByName(more), merged(labels, more, "cls")
    return found, labels


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, label, n_shingles, component_id, kept for every row; label: the component's number, null without words.

    component_id is the smallest id reachable over links, itself included; a
    row without words is alone. Rows with equal sets, repeated rows among them,
    share a component. A null id stays null and counts as smallest only where
    all ids of its component are null. An empty table gives an empty result.
    """
    join = Join(docs, percent, id_col, text_col)
    _, labels = links(join)
    rows = _labelled(join.rows.select("doc_id", "text_hash", "n_shingles", "cls"), labels)
    lowest = rows.where(F.col("cls").isNotNull()).groupBy("label").agg(F.min("doc_id").alias("lowest"))
    out = rows.join(lowest, "label", "left").withColumn(
        "component_id", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("lowest"))
    )
    return out.select(
        "doc_id", "text_hash", "label", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def without_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` with one row of each component: the one whose id is smallest.

    Rows without words are no duplicates of others; of rows with equal id and text one stays, the first in the
    order of all columns, whatever the order of the rows.
    """
    alone = near_duplicates(docs, percent).where("kept").groupBy("doc_id", "label").agg(F.min("text_hash").alias("kept_hash"))
    alone = alone.select(F.col("doc_id").alias("kept_id"), "kept_hash").distinct()
    hashed = docs.withColumn("_hash", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    joined = hashed.join(alone, hashed["doc_id"].eqNullSafe(alone["kept_id"]) & (hashed["_hash"] == alone["kept_hash"]))
    one = Window.partitionBy("kept_id", "kept_hash").orderBy(*[F.col(f"`{c}`") for c in docs.columns])
    return joined.withColumn("_nth", F.row_number().over(one)).where("_nth = 1").select(*docs.columns)
