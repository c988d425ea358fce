"""Long repeated byte strings over a whole corpus, by longest factors.

A byte goes if it lies in a string of ``length`` bytes that also starts elsewhere.
In terms of longest-previous-factor arrays: the string at a place goes if the
longest factor it shares with a suffix before it (or, where first copies go as
well, after it) has ``length`` bytes or more. Only that comparison matters, so
suffixes are put in order by a digest of their first bytes rather than by all of
them: equal strings are neighbours, the previous smaller place of a class is its
smallest one, and later copies are all the others.

A suffix for each byte would be twenty times the input. Three things keep it small:

* Every string of ``length`` bytes has an anchor, the least of the hashes of its 200-byte
  grams, which depends on nothing else. Anchors are one place in a
  hundred, and a string whose anchor occurs nowhere else is not repeated.
* Strings that start next to each other and share their anchor are compared
  as one block: if the union of a block, of length + block - 1 bytes, occurs
  elsewhere, so does each of them (a factor of that length starts there).
* Blocks that are not equal as a whole are halved in sixteens, down to single
  places, but only where the bytes that all strings of the block have in common
  occur in another block too.

So all strings are decided exactly, by 128-bit digests. Nothing is gathered by
content: counts are combined before each shuffle, and what is gathered by
text is as long as the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.llm import textvec as tv
from txnwatch.llm.filters import HashFilter
from txnwatch.llm.tables import prepare, text_rows

LENGTH = 400
GRAM = 200
BLOCKS = (256, 16, 1)
#: Repeated anchors up to which a filter of them is sent to the tasks; beyond it all anchors go on.
FILTERED = 1 << 21
#: Texts whose digests a task remembers, so that copies in its input are sent on once.
REMEMBERED = 100_000

#: Places within a text, which Spark keeps below 2 GB.
_PLACE_BITS = 31
_PLACE = tv.U((1 << _PLACE_BITS) - 1)
_LAST = np.iinfo(tv.U).max


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    rows = -(-len(values) // width)
    padded = np.full(rows * width, _LAST, tv.U)
    padded[: len(values)] = values
    grid = padded.reshape(rows, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first start, last start) of the anchors of one text: each start in between has that anchor."""
    if len(data) < length:
        return (np.zeros(0, tv.U), *(np.zeros(0, np.int64),) * 3)
    up, down = tv.powers(len(data))
    run = np.concatenate([np.zeros(1, tv.U), np.cumsum(tv.BYTE[data] * up[: len(data)], dtype=tv.U)])
    m = len(data) - gram + 1
    hashes = tv.mix((run[gram:] - run[:m]) * down[:m])
    keyed = (hashes & ~_PLACE) | np.arange(m, dtype=tv.U)
    least = (_least(keyed, length - gram + 1) & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    place = least[first]
    return hashes[place], place, first, np.append(first[1:], len(least)) - 1


class _Seen:
    """Whether a text came before in this task; forgets when full, which only costs a repeated row."""

    def __init__(self):
        self.known: set[int] = set()

    def again(self, key: int) -> bool:
        if key in self.known:
            return True
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known.add(key)
        return False


def _texts(batch: pa.RecordBatch, seen: _Seen | None) -> Iterator[tuple[int, np.ndarray]]:
    data, offsets = tv.raw(batch.column("text"))
    for k, key in enumerate(batch.column("txt").to_pylist()):
        if offsets[k + 1] - offsets[k] >= LENGTH and not (seen and seen.again(key)):
            yield key, data[offsets[k] : offsets[k + 1]]


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            hashes, keys, places = [np.zeros(0, tv.U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for key, data in _texts(batch, seen):
                h, place, _, _ = anchors(data, length)
                hashes.append(h)
                keys.append(np.full(len(h), key, np.int64))
                places.append(place)
            columns = [np.concatenate(x) for x in (hashes, keys, places)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0].view(np.int64)), pa.array(columns[1]), pa.array(columns[2].astype(np.int32))], names=["anchor", "txt", "place"]
            )

    return run


ROW = "txt bigint, at int, low int, high int, u1 bigint, u2 bigint, core bigint"


class _Blocks:
    """Rows of blocks, gathered for one batch. A start is a distance back from its anchor."""

    def __init__(self, length: int, block: int):
        self.length, self.block = length, block
        self.rows: dict[str, list[int]] = {k.split()[0]: [] for k in ROW.split(", ")}

    def add(self, key: int, data: bytes, at: int, low: int, high: int) -> None:
        length, block = self.length, self.block
        for j in range(low // block, high // block + 1):
            near, far = max(low, j * block), min(high, (j + 1) * block - 1)
            whole = xxhash.xxh3_128_digest(data[at - far : at - near + length])
            end = max(at + GRAM, at - (j + 1) * block + 1 + length)
            shared = xxhash.xxh3_64_intdigest(data[at - j * block : end])
            for name, value in zip(
                self.rows, (key, at, near, far, int.from_bytes(whole[:8], "little", signed=True),
                            int.from_bytes(whole[8:], "little", signed=True), shared - (1 << 63)), strict=True
            ):
                self.rows[name].append(value)

    def batch(self) -> pa.RecordBatch:
        kinds = {"bigint": pa.int64(), "int": pa.int32()}
        columns = [pa.array(self.rows[n], kinds[k]) for n, k in (x.split() for x in ROW.split(", "))]
        return pa.RecordBatch.from_arrays(columns, names=list(self.rows))


def _first_blocks(length: int, known: HashFilter | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            out = _Blocks(length, BLOCKS[0])
            for key, data in _texts(batch, seen):
                h, place, first, last = anchors(data, length)
                keep = np.flatnonzero(known.passes(h)) if known else np.arange(len(h))
                if len(keep):
                    raw = data.tobytes()
                    for k in keep:
                        out.add(key, raw, int(place[k]), int(place[k] - last[k]), int(place[k] - first[k]))
            yield out.batch()

    return run


def _finer_blocks(length: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = _Blocks(length, block)
            for key, blob, ranges in zip(*(batch.column(c).to_pylist() for c in ("txt", "blob", "ranges")), strict=True):
                data = unpack(blob)
                for r in ranges:
                    out.add(key, data, r["at"], r["low"], r["high"])
            yield out.batch()

    return run


def _packed(wanted: HashFilter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, pack = _Seen(), zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            keys, blobs = [], []
            keep = pa.array(wanted.passes(batch.column("txt").to_numpy()))
            for key, data in _texts(batch.filter(keep), seen):
                keys.append(key)
                blobs.append(pack(data.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], names=["txt", "blob"])

    return run


def _cut(length: int):
    """What is left of each text without its ranges of starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            keys = batch.column("txt")
            removed, spans, digests = [], [], []
            for blob, ranges in zip(batch.column("blob").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                data = np.frombuffer(unpack(blob), np.uint8)
                step = np.zeros(len(data) + 1, np.int64)
                np.add.at(step, [r["first"] for r in ranges], 1)
                np.add.at(step, [r["last"] + length for r in ranges], -1)
                gone = np.cumsum(step[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int((gone[1:] & ~gone[:-1]).sum()) + int(gone[:1].sum()))
                digests.append(hashlib.sha256(data[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())],
                names=["txt", "n_removed", "n_spans", "kept_sha256"],
            )

    return run


class Repeats:
    """The texts of one run and the places where a repeated string starts."""

    def __init__(self, docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text"):
        if length < 2 * GRAM or length - GRAM > BLOCKS[0]:
            raise ValueError(f"lengths from {2 * GRAM} to {GRAM + BLOCKS[0]} are supported")
        prepare(docs.sparkSession)
        self.length = length
        text = F.coalesce(F.col("text"), F.lit(""))
        self.texts = text_rows(docs, id_col, text_col).select("doc_id", text.alias("text"), F.xxhash64(text).alias("txt"))
        self.long = self.texts.where(F.octet_length("text") >= length).select("txt", "text")

    def _known(self) -> HashFilter | None:
        """Anchors that occur in two places, if they are few enough for a filter."""
        rows = self.long.mapInArrow(_anchor_rows(self.length), "anchor bigint, txt bigint, place int")
        ends = rows.groupBy("anchor").agg(
            F.min("txt").alias("t0"), F.max("txt").alias("t1"), F.min("place").alias("p0"), F.max("place").alias("p1")
        )
        twice = ends.where((F.col("t0") != F.col("t1")) | (F.col("p0") != F.col("p1"))).select("anchor").checkpoint()
        return HashFilter.of(twice, "anchor") if twice.count() <= FILTERED else None

    def blobs(self, keys: DataFrame) -> DataFrame:
        """(txt, blob): the compressed text of each key, once."""
        keys = keys.select("txt").distinct().checkpoint()
        found = self.long.mapInArrow(_packed(HashFilter.of(keys, "txt")), "txt bigint, blob binary")
        return found.groupBy("txt").agg(F.first("blob").alias("blob")).join(keys, "txt", "left_semi")

    def starts(self, keep_first: bool = False) -> DataFrame:
        """(txt, first, last): ranges of starts of strings that also start elsewhere; with ``keep_first``, at a
        smaller place, where texts are in the order of their digests."""
        rows = self.long.mapInArrow(_first_blocks(self.length, self._known()), ROW)
        found = None
        for level, block in enumerate(BLOCKS):
            rows = rows.checkpoint()
            place = F.struct("txt", (F.col("at") - F.col("high")).alias("start"), "at", "low", "high", "core")
            classes = rows.groupBy("u1", "u2").agg(F.min(place).alias("one"), F.max(place).alias("other")).checkpoint()
            several = (F.col("one.txt") != F.col("other.txt")) | (F.col("one.start") != F.col("other.start"))
            repeated = classes.where(several).select("u1", "u2", F.col("one.txt").alias("txt0"), F.col("one.start").alias("start0"))
            here = rows.join(repeated, ["u1", "u2"])
            start = F.col("at") - F.col("high")
            if keep_first:
                here = here.where((F.col("txt") != F.col("txt0")) | (start != F.col("start0")))
            here = here.select("txt", start.alias("first"), (F.col("at") - F.col("low")).alias("last")).distinct()
            found = here if found is None else found.unionByName(here)
            if block == BLOCKS[-1]:
                return found
            # Blocks whose common bytes lie in several classes are looked at more closely.
            cores = classes.groupBy(F.col("one.core").alias("core")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            mixed = classes.select("one.*").join(cores, "core").groupBy("txt").agg(F.collect_list(F.struct("at", "low", "high")).alias("ranges"))
            mixed = mixed.checkpoint()
            finer = mixed.join(self.blobs(mixed), "txt")
            rows = finer.mapInArrow(_finer_blocks(self.length, BLOCKS[level + 1]), ROW)

    def removed(self, keep_first: bool = False) -> DataFrame:
        """(txt, n_removed, n_spans, kept_sha256) for texts that lose bytes."""
        ranges = self.starts(keep_first).groupBy("txt").agg(F.collect_list(F.struct("first", "last")).alias("ranges")).checkpoint()
        return ranges.join(self.blobs(ranges), "txt").mapInArrow(
            _cut(self.length), "txt bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
        )


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row: first copies go as well.

    Null texts are empty; a text shorter than ``length`` loses nothing; equal
    texts of ``length`` bytes, repeated rows among them, lose everything. Texts
    are told apart by 64-bit digests.
    """
    run = Repeats(docs, length, id_col, text_col)
    cut = run.removed()
    rows = run.texts.select("doc_id", "txt", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    rows = rows.checkpoint()
    copies = rows.groupBy("txt").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    joined = rows.join(copies, "txt", "left").join(cut, "txt", "left")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    none = hashlib.sha256(b"").hexdigest()
    return joined.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(gone, none).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
