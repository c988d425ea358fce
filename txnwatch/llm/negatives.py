"""Hard negatives by an R-tree that is packed by sort-tile-recursive (STR) order.

Vectors are whole numbers (``floor(scale * x)``), so scores are exact. STR cuts the rows
into slabs along one coordinate, each slab along the next, and so on: the first two
cuts make tiles (by quantiles found in Spark), the others the leaves inside a tile. Every node has its
minimum bounding box, and an anchor's positive and negative parts give the interval
of the inner products with all vectors of a box, coordinate by coordinate.

Anchors go in blocks through the tree, best box first. A box is left out if its interval
ends below the score window or strictly below the k-th score found so far, or starts above
the window. Boxes of whole tiles decide which blocks travel to which tiles; a task holds one
tile and takes the blocks that come to it one after another.

There are three rounds: the anchors' own tiles, which give a first k-th score; the other tiles that may
hold a better positive; and the windows below the positives' scores.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnwatch.llm.tables import prepare

SCALE = 256
LEAF_ROWS, FAN = 128, 8
#: Tiles: this many while they fit TILE_ROWS; then more, as long as their boxes take BOX_BYTES at most; then larger ones.
TILES, TILE_ROWS, BOX_BYTES = 32, 1 << 16, 1 << 25
#: Anchors of a block, and blocks that share one copy of a tile.
BLOCK_ANCHORS, BLOCKS_A_COPY = 1024, 64
LOWEST = np.iinfo(np.int64).min

VECTOR = "vec_id bigint, label bigint, dim int, v binary, c0 double, c1 double"
TILE = "tile int, dim int, ids binary, labels binary, v binary, cuts binary, lo binary, hi binary"
BLOCK = "block int, dim int, ids binary, labels binary, v binary, home binary"
FOUND = "block int, q int, anchor_id bigint, positive_id bigint, positive_score bigint, id bigint, score bigint"


# ---------------------------------------------------------------- rows
def _unpack(v: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(v, f"<i{len(v) // max(rows * dim, 1) or 1}").reshape(rows, dim)


def _least_type(v: np.ndarray) -> np.ndarray:
    top = int(max(abs(int(v.min(initial=0))), abs(int(v.max(initial=0)))))
    return v.astype("<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8")


def _packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = [np.asarray(x, np.int64) for x in batch.column("v").to_pylist()]
        firsts = [[float(x[k]) if len(x) > k else 0.0 for x in vectors] for k in (0, 1)]
        columns = [
            batch.column("vec_id"),
            batch.column("label"),
            pa.array([len(x) for x in vectors], pa.int32()),
            pa.array([_least_type(x).tobytes() for x in vectors], pa.binary()),
            *[pa.array(x, pa.float64()) for x in firsts],
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "dim", "v", "c0", "c1"])


def usable(df: DataFrame, id_col: str, vec_col: str, label: Column, scale: int) -> DataFrame:
    """The rows that take part, as whole numbers, each different row once."""
    vec = F.col(vec_col)
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & vec.isNotNull() & (F.size(vec) > 0) & ~bad)
    whole = F.transform(vec, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    rows = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), whole.alias("v"))
    return rows.where(F.col("label").isNotNull()).mapInArrow(_packed_rows, VECTOR).distinct()


# ---------------------------------------------------------------- packing
def _local(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of the driver: a row for each slab or tile, whose number is bounded."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def tiled(rows: DataFrame, anchor: Column, tile_rows: int | None = None) -> tuple[DataFrame, int, int]:
    """Rows with ``tile``, and ``block`` where they are anchors; the numbers of tiles and of blocks.

    Slabs and tiles are quantiles of the first two coordinates for each vector length. A tile that equal
    coordinates make too large is dealt over several by the id, and so are a tile's anchors over blocks.
    """
    spark = rows.sparkSession
    lengths = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each vector length
    total = sum(r["n"] for r in lengths)
    most = max(TILES, BOX_BYTES // (16 * max((r["dim"] for r in lengths), default=1)))
    size = tile_rows or max(min(TILE_ROWS, -(-total // TILES)), -(-total // most), 1)
    slabs = max(1, math.ceil(math.sqrt(-(-total // size))))
    cuts = [k / slabs for k in range(1, slabs)]

    def place(df: DataFrame, coordinate: str, keys: list[str], name: str) -> DataFrame:
        if not cuts:
            return df.withColumn(name, F.lit(0))
        bounds = df.groupBy(*keys).agg(F.percentile_approx(coordinate, cuts, 10_000).alias("bounds")).collect()
        table = _local(spark, [tuple(r) for r in bounds], ", ".join(f"{k} int" for k in keys) + ", bounds array<double>")
        below = F.size(F.filter("bounds", lambda b: b < F.col(coordinate)))
        return df.join(table, keys).withColumn(name, below).drop("bounds")

    placed = place(place(rows, "c0", ["dim"], "slab"), "c1", ["dim", "slab"], "cell").withColumn("is_anchor", anchor)
    counts = placed.groupBy("dim", "slab", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_anchor").cast("int")).alias("a")).collect()
    numbers, tile, block, held, last = [], 0, 0, 0, None
    for r in sorted(counts, key=lambda r: (r["dim"], r["slab"], r["cell"])):
        parts, block_parts = -(-r["n"] // (2 * size)), max(1, -(-r["a"] // BLOCK_ANCHORS))
        if last is not None and (held + r["a"] > BLOCK_ANCHORS or last != r["dim"]):
            block, held = block + 1, 0
        numbers.append((r["dim"], r["slab"], r["cell"], tile, parts, block, block_parts))
        tile, block, held, last = tile + parts, block + block_parts - 1, held + (r["a"] if block_parts == 1 else BLOCK_ANCHORS), r["dim"]
    if not numbers:
        return placed.withColumns({"tile": F.lit(0), "block": F.lit(0)}), 0, 0
    table = _local(spark, numbers, "dim int, slab int, cell int, tile0 int, parts int, block0 int, block_parts int")
    share = F.xxhash64("vec_id")
    out = placed.join(table, ["dim", "slab", "cell"]).select(
        "vec_id",
        "label",
        "dim",
        "v",
        "is_anchor",
        (F.col("tile0") + F.pmod(share, F.col("parts"))).cast("int").alias("tile"),
        (F.col("block0") + F.pmod(share, F.col("block_parts"))).cast("int").alias("block"),
    )
    return out, tile, block + 1


def str_order(v: np.ndarray, leaf: int = LEAF_ROWS, axis: int = 2) -> list[np.ndarray]:
    """Row numbers of the leaves: slabs along one coordinate after another, as many a level as the leaves need."""
    if len(v) <= leaf:
        return [np.arange(len(v))]
    axis %= v.shape[1]
    leaves = -(-len(v) // leaf)
    slabs = max(2, math.ceil(leaves ** (1 / (v.shape[1] - axis))))
    order = np.argsort(v[:, axis], kind="stable")
    return [part[sub] for part in np.array_split(order, slabs) for sub in str_order(v[part], leaf, axis + 1)]


def _raw(x: np.ndarray, kind: str = "<i8") -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def _group(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, labels and vectors of a group, in the order of the ids."""
    dim = table.column("dim")[0].as_py()
    ids, labels = (table.column(c).to_numpy() for c in ("vec_id", "label"))
    v = np.stack([_unpack(x, 1, dim)[0] for x in table.column("v").to_pylist()]).astype(np.int64)
    order = np.lexsort((*v.T[::-1], labels, ids))
    return ids[order], labels[order], v[order]


def _row(values: list, schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary(), "bigint": pa.int64()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table({n: pa.array([x], kinds[k]) for x, (n, k) in zip(values, fields, strict=True)})


def _tile(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    ids, labels, v = _group(table)
    leaves = str_order(v)
    order = np.concatenate(leaves)
    cuts = np.cumsum([len(x) for x in leaves])
    box = [_raw(v.min(0)), _raw(v.max(0))]
    return _row([key[0].as_py(), v.shape[1], _raw(ids[order]), _raw(labels[order]), _least_type(v[order]).tobytes(), _raw(cuts), *box], TILE)


def _block(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    home = np.unique(table.column("tile").to_numpy())
    ids, labels, v = _group(table)
    return _row([key[0].as_py(), v.shape[1], _raw(ids), _raw(labels), _least_type(v).tobytes(), _raw(home)], BLOCK)


# ---------------------------------------------------------------- search
def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products; an error where one is beyond 64 bits."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2**53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return np.array(a.astype(object) @ b.T.astype(object), dtype=object).astype(np.int64)


def intervals(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lowest, highest) inner product of each vector with anything in each box; widened against rounding."""
    up, down = np.maximum(a, 0).astype(float), np.minimum(a, 0).astype(float)
    lo, hi = lo.T.astype(float), hi.T.astype(float)
    least, most = up @ lo + down @ hi, up @ hi + down @ lo
    slack = 1e-9 * (up @ np.maximum(np.abs(lo), np.abs(hi)) - down @ np.maximum(np.abs(lo), np.abs(hi)))
    return least - slack, most + slack


class Queries:
    """What a block asks: for each query its anchor (row of ``v``), a window of scores and the k-th score so far."""

    def __init__(self, row: dict):
        n = len(row["ids"]) // 8
        self.block = row["block"]
        self.ids, self.labels = (np.frombuffer(row[c], "<i8") for c in ("ids", "labels"))
        self.v = _unpack(row["v"], n, row["dim"])
        ask = np.frombuffer(row["ask"], "<i8").reshape(-1, 7)
        self.q, self.row, self.low, self.high, self.kth, self.positive, self.score = ask.T.copy()

    @staticmethod
    def written(rows: np.ndarray, low, high, kth, positive, score, q=None) -> bytes:
        q = np.arange(len(rows)) if q is None else q
        return _raw(np.stack([np.broadcast_to(np.asarray(x, np.int64), len(rows)) for x in (q, rows, low, high, kth, positive, score)], 1))

    def wants(self, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Queries that a box with these intervals, one for each anchor, may answer."""
        return (most[self.row] >= np.maximum(self.low, self.kth)) & (least[self.row] <= self.high)


class Tree:
    """The boxes of one tile over its leaves."""

    def __init__(self, row: dict):
        n = len(row["ids"]) // 8
        self.ids, self.labels, ends = (np.frombuffer(row[c], "<i8") for c in ("ids", "labels", "cuts"))
        self.v = _unpack(row["v"], n, row["dim"])
        self.start, self.end = np.concatenate([[0], ends[:-1]]), ends
        lo, hi = np.minimum.reduceat(self.v, self.start), np.maximum.reduceat(self.v, self.start)
        self.levels = [(lo, hi)]
        while len(lo) > FAN:
            at = np.arange(0, len(lo), FAN)
            lo, hi = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
            self.levels.append((lo, hi))

    def search(self, ask: Queries, same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, score) of the first k rows of each query, by score and then id, with the same label or with another one."""
        kept = (np.zeros(0, np.int64),) * 3
        heap: list[tuple] = []

        def push(level: int, first: int, end: int) -> None:
            lo, hi = self.levels[level]
            least, most = intervals(ask.v, lo[first:end], hi[first:end])
            for j in range(end - first):
                wanted = ask.wants(least[:, j], most[:, j])
                if wanted.any():
                    heapq.heappush(heap, (-float(most[ask.row[wanted], j].max()), level, first + j, least[:, j], most[:, j]))

        push(len(self.levels) - 1, 0, len(self.levels[-1][0]))
        while heap:
            _, level, node, least, most = heapq.heappop(heap)
            wanted = np.flatnonzero(ask.wants(least, most))
            if not len(wanted):
                continue
            if level:
                push(level - 1, node * FAN, min((node + 1) * FAN, len(self.levels[level - 1][0])))
            else:
                kept = self._leaf(ask, wanted, slice(self.start[node], self.end[node]), same, k, kept)
        return kept

    def _leaf(self, ask: Queries, wanted: np.ndarray, rows: slice, same: bool, k: int, kept):
        anchors, inverse = np.unique(ask.row[wanted], return_inverse=True)
        scores = products(ask.v[anchors], self.v[rows])
        alike = (ask.labels[anchors][:, None] == self.labels[rows]) == same
        alike &= ask.ids[anchors][:, None] != self.ids[rows]
        scores = scores[inverse]
        fits = alike[inverse] & (scores >= np.maximum(ask.low, ask.kth)[wanted][:, None]) & (scores <= ask.high[wanted][:, None])
        which, where = np.nonzero(fits)
        if not len(which):
            return kept
        q = np.concatenate([kept[0], wanted[which]])
        place = np.concatenate([kept[1], where + rows.start])
        score = np.concatenate([kept[2], scores[which, where]])
        order = np.lexsort((self.ids[place], -score, q))
        q, place, score = q[order], place[order], score[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        ask.kth[q[nth == k - 1]] = np.maximum(ask.kth[q[nth == k - 1]], score[nth == k - 1])
        return q[nth < k], place[nth < k], score[nth < k]


def _routes(boxes: tuple[np.ndarray, ...], near: bool | None):
    """Blocks to the tiles that may answer them: their own (near), all others (not near), or all (None)."""
    tiles, dims, lows, highs = boxes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ask = Queries(row)
                of = np.flatnonzero(dims == row["dim"])
                if near is not None:
                    own = np.isin(tiles[of], np.frombuffer(row["home"], "<i8"))
                    of = of[own if near else ~own]
                if not len(of) or not len(ask.q):
                    continue
                least, most = intervals(ask.v, np.stack([lows[i] for i in of]), np.stack([highs[i] for i in of]))
                for j, i in enumerate(of):
                    wanted = np.flatnonzero(ask.wants(least[:, j], most[:, j]))
                    if not len(wanted):
                        continue
                    rows, place = np.unique(ask.row[wanted], return_inverse=True)
                    raw = Queries.written(place, *(x[wanted] for x in (ask.low, ask.high, ask.kth, ask.positive, ask.score, ask.q)))
                    values = [int(tiles[i]), 1, row["block"], row["dim"], _raw(ask.ids[rows]), _raw(ask.labels[rows]), _least_type(ask.v[rows]).tobytes(), b"", raw]
                    yield _row(values, ROUTED).to_batches()[0]

    return run


ROUTED = "tile int, kind int, block int, dim int, ids binary, labels binary, v binary, cuts binary, ask binary"


def _searched(same: bool, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            for row in batch.to_pylist():
                if not row["kind"]:
                    tree = Tree(row)
                    continue
                ask = Queries(row)
                q, place, score = tree.search(ask, same, k)
                columns = [np.full(len(q), ask.block), ask.q[q], ask.ids[ask.row[q]], ask.positive[q], ask.score[q], tree.ids[place], score]
                kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 5]
                names = [x.split()[0] for x in FOUND.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return run


def _search(blocks: DataFrame, tiles: DataFrame, boxes, near: bool | None, same: bool, k: int, copies: int) -> DataFrame:
    """(block, q, ..., id, score, nth): the first k answers of each query in the tiles it is sent to."""
    routed = blocks.mapInArrow(_routes(boxes, near), ROUTED).withColumn("copy", F.col("block") % copies)
    none = F.lit(None).cast("binary")
    held = tiles.select("tile", F.lit(0).alias("kind"), F.lit(-1).alias("block"), "dim", "ids", "labels", "v", "cuts", none.alias("ask"))
    held = held.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    parts = min(len(boxes[0]) * copies, 1 << 15)
    met = routed.unionByName(held).repartition(parts, "tile", "copy").sortWithinPartitions("tile", "copy", "kind", "block")
    return met.drop("copy").mapInArrow(_searched(same, k), FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("block", "q").orderBy(F.desc("score"), "id")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)


def _asked(blocks: DataFrame, answers: DataFrame | None, write) -> DataFrame:
    """Blocks with their queries, written from the answers to earlier ones (at most k for each anchor of a block)."""
    if answers is None:
        joined = blocks.withColumn("got", F.array().cast("array<struct<q:int,nth:int,id:bigint,score:bigint>>"))
    else:
        got = answers.groupBy("block").agg(F.collect_list(F.struct("q", "nth", "id", "score")).alias("got"))
        joined = blocks.join(got, "block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asks = []
            for ids, got in zip(batch.column("ids").to_pylist(), batch.column("got").to_pylist(), strict=True):
                rows = np.array([(g["q"], g["nth"], g["id"], g["score"]) for g in got or []], np.int64).reshape(-1, 4)
                asks.append(write(len(ids) // 8, rows))
            columns = [batch.column(c) for c in names] + [pa.array(asks, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "ask"])

    names = [x.split()[0] for x in BLOCK.split(", ")]
    return joined.mapInArrow(run, f"{BLOCK}, ask binary")


def _for_positives(k: int):
    def write(anchors: int, got: np.ndarray) -> bytes:
        kth = np.full(anchors, LOWEST)
        kth[got[got[:, 1] == k, 0]] = got[got[:, 1] == k, 3]
        return Queries.written(np.arange(anchors), LOWEST, np.iinfo(np.int64).max, kth, 0, 0)

    return write


def _for_negatives(low: int, high: int):
    def write(anchors: int, got: np.ndarray) -> bytes:
        row, _, positive, score = got[np.lexsort((got[:, 1], got[:, 0]))].T
        # Python's whole numbers: a percentage of a large score may pass 64 bits.
        least = np.array([-(-low * int(s) // 100) for s in score], np.int64)
        most = np.array([high * int(s) // 100 for s in score], np.int64)
        some = least <= most
        return Queries.written(row[some], least[some], most[some], LOWEST, positive[some], score[some])

    return write


def hard_negatives(
    df: DataFrame,
    anchor: Column,
    label: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = SCALE,
    tile_rows: int | None = None,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` is a condition on ``vec_id``; ``label`` an expression over the input. A row with a null id, label,
    vector or component, a component that is not finite, or an empty vector takes no part. Rows that
    are equal in id, label and vector count once; a row with the anchor's id is not an other row. Vectors of
    different lengths have no score. Ties go by id. A score beyond 64 bits is an error. An empty table has no rows.
    """
    spark = df.sparkSession
    prepare(spark)
    rows = usable(df, id_col, vec_col, label, scale).checkpoint()
    placed, n_tiles, n_blocks = tiled(rows, anchor, tile_rows)
    tiles = placed.groupBy("tile").applyInArrow(_tile, TILE).checkpoint()
    blocks = placed.where("is_anchor").groupBy("block").applyInArrow(_block, BLOCK).checkpoint()
    # A box a tile, BOX_BYTES in all.
    nodes = tiles.select("tile", "dim", "lo", "hi").collect()
    boxes = (
        np.array([r["tile"] for r in nodes], np.int64),
        np.array([r["dim"] for r in nodes], np.int64),
        [np.frombuffer(r["lo"], "<i8") for r in nodes],
        [np.frombuffer(r["hi"], "<i8") for r in nodes],
    )
    copies = -(-max(n_blocks, 1) // BLOCKS_A_COPY)
    if not nodes:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    own = _search(_asked(blocks, None, _for_positives(positives)), tiles, boxes, True, True, positives, copies)
    own = _first(own, positives).checkpoint()
    others = _search(_asked(blocks, own, _for_positives(positives)), tiles, boxes, False, True, positives, copies)
    best = _first(own.drop("nth").unionByName(others), positives)
    asked = _asked(blocks, best, _for_negatives(low, high)).checkpoint()
    found = _first(_search(asked, tiles, boxes, None, False, negatives, copies), negatives)
    return found.select(
        "anchor_id", "positive_id", F.col("nth").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
