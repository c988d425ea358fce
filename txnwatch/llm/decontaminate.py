"""Benchmark decontamination by spaced seeds.

Words are runs of letters and digits, lower-cased. A seed is a fixed mask over up to
``SPAN`` words of which only six count, so that a changed word at an
ignored place does not break a match. Ten masks ignore different places: together they
hit every overlap with an item of ``SHORT`` words or more that the rule below accepts,
wherever its substitutions are (test_edges.py goes through all patterns). Seeds
of all benchmark items go into a filter of fixed size that is sent to the tasks.
Every place of every document is hashed under every mask; the few places that
pass the filter are joined with the benchmark's seeds by hash. Each hit gives an
alignment of a document with an item, and all words of it are
compared one by one: an overlap counts if enough words agree despite substitutions.

Items of fewer than ``SHORT`` words are sought whole with at most one other word, under masks of
their own length that leave out one place each. ``not_sought`` lists items too short for that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.llm import textvec as tv
from txnwatch.llm.filters import HashFilter
from txnwatch.llm.licenses import padded_words, words_of
from txnwatch.llm.tables import prepare, text_rows

# Masks of weight 6. Heavier ones with the same cover are twice as many (weight 7) or more.
MASKS = (
    "11101011", "10110111", "11101101", "11110011", "11111001", "11110101",
    "1110111", "1111101", "1111011", "111111",
)
SPAN = 8
#: Items of fewer words are sought whole, with at most one other word.
SHORT = 12
#: Shorter items say too little to be sought.
LEAST_WORDS = 4
#: An overlap counts from so many equal words, or that share of a shorter item's words.
EQUAL_WORDS = 13
EQUAL_SHARE = 0.6
IDENTITY = 0.75
#: Seeds of the benchmark up to which they are broadcast; beyond, both sides are shuffled and salted.
BROADCAST_SEEDS = 1 << 20
SALTS = 16


def _shapes(lengths: range | None = None) -> list[tuple[int, np.ndarray]]:
    """(number, places that count) of the masks, and of those for short items of the lengths."""
    shapes = [(k, np.flatnonzero(np.array(list(m)) == "1")) for k, m in enumerate(MASKS)]
    return shapes + [x for n in (lengths or ()) for x in _short_shapes(n)]


def _short_shapes(n: int) -> list[tuple[int, np.ndarray]]:
    return [(100 + SHORT * n + k, np.delete(np.arange(n), k)) for k in range(n)]


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bounds of the words by text, word hashes) by chunk."""
    for first, _, data, offsets in tv.chunks(column):
        data = tv.LOWER[data]
        words = tv.Words(data, offsets, tv.PUNCTUATION)
        yield first, words.bounds, tv.Hasher(data).spans(words.start, words.end)


def _seeds(hashes: np.ndarray, number: int, places: np.ndarray) -> np.ndarray:
    """Hash of every place where the mask fits, whatever text it lies in."""
    m = len(hashes) - int(places[-1])
    if m <= 0:
        return np.zeros(0, tv.U)
    total = np.full(m, number, tv.U) * tv.PLACE[40]
    for p in places:
        total += hashes[p : p + m] * tv.PLACE[p]
    return tv.mix(total)


def _benchmark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, words as packed hashes, seed hashes and places) of each item."""
    for batch in batches:
        items, packed, seeds, places = [], [], [], []
        keys = batch.column("item").to_pylist()
        for first, bounds, hashes in _texts(batch.column("text")):
            for k in range(len(bounds) - 1):
                own = hashes[bounds[k] : bounds[k + 1]]
                n = len(own)
                if n < LEAST_WORDS:
                    continue
                shapes = _shapes() if n >= SHORT else _short_shapes(n)
                found = [_seeds(own, *s) for s in shapes]
                items.append(keys[first + k])
                packed.append(own.tobytes())
                seeds.append(np.concatenate(found).astype(np.int64).tolist())
                places.append(np.concatenate([np.arange(len(f)) for f in found]).tolist())
        yield pa.RecordBatch.from_arrays(
            [pa.array(items, pa.int64()), pa.array(packed, pa.binary()), pa.array(seeds, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))],
            names=["item", "words", "seeds", "places"],
        )


def _search(known: HashFilter, lengths: list[int], reach: int):
    """Stretches of words up to ``reach`` around the places that pass the filter, with those places and their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("row", "start", "words", "seeds", "places")}
            for first, bounds, hashes in _texts(batch.column("text")):
                at, seed = [], []
                for number, places in _shapes(lengths):
                    h = _seeds(hashes, number, places)
                    hit = np.flatnonzero(known.passes(h))
                    text = np.searchsorted(bounds, hit, "right") - 1
                    hit = hit[hit + places[-1] < bounds[text + 1]]
                    at.append(hit)
                    seed.append(h[hit])
                at, seed = np.concatenate(at), np.concatenate(seed)
                order = np.argsort(at, kind="stable")
                at, seed = at[order], seed[order]
                text = np.searchsorted(bounds, at, "right") - 1
                # Places of a text that reach each other share a stretch.
                new = np.ones(len(at), bool)
                new[1:] = (text[1:] != text[:-1]) | (at[1:] - at[:-1] > 2 * reach)
                cuts = np.append(np.flatnonzero(new), len(at))
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    k = text[a]
                    low, high = max(bounds[k], at[a] - reach), min(bounds[k + 1], at[b - 1] + reach)
                    out["row"].append(first + k)
                    out["start"].append(low - bounds[k])
                    out["words"].append(hashes[low:high].tobytes())
                    out["seeds"].append(seed[a:b].astype(np.int64).tolist())
                    out["places"].append((at[a:b] - bounds[k]).tolist())
            rows = pa.array(out["row"], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), batch.column("text_hash").take(rows), pa.array(out["start"], pa.int64()),
                 pa.array(out["words"], pa.binary()), pa.array(out["seeds"], pa.list_(pa.int64())), pa.array(out["places"], pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "start", "words", "seeds", "places"],
            )

    return run


def overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int]:
    """(equal words, words) of the best stretch where item word k lies on doc word k + shift: an equal word
    adds one, another takes two; the longest of the best."""
    low, high = max(0, -shift), min(len(item), len(doc) - shift)
    if high <= low:
        return 0, 0
    same = doc[low + shift : high + shift] == item[low:high]
    run = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
    floor = np.minimum.accumulate(run)
    end = int((run - floor).argmax())
    start = int(run[: end + 1].argmin())
    return int(same[start:end].sum()), end - start


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        equal, length, share = [], [], []
        for doc, item, shift in zip(batch.column("words"), batch.column("item_words"), batch.column("shift").to_pylist(), strict=True):
            one, other = (np.frombuffer(x.as_buffer(), tv.U) for x in (doc, item))
            e, n = overlap(one, other, shift)
            enough = e >= min(EQUAL_WORDS, EQUAL_SHARE * len(other)) and e >= IDENTITY * n
            if len(other) < SHORT:
                n = len(other)
                e = int((one == other).sum()) if shift == 0 and len(one) == n else 0
                enough = e >= n - 1
            equal.append(e if enough else 0)
            length.append(n)
            share.append(e / len(other))
        keep = pa.array(np.array(equal, np.int64) > 0)
        found = pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), batch.column("item"), pa.array(equal, pa.int64()), pa.array(length, pa.int64()), pa.array(share, pa.float64())],
            names=["doc_id", "text_hash", "item", "equal_words", "overlap_words", "item_share"],
        )
        yield found.filter(keep)


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, item (hash of its text), equal_words, overlap_words, item_share for every overlap that counts.

    The best alignment of each document with each item. Texts and items that are
    null or have fewer than ``LEAST_WORDS`` words overlap with nothing; equal items
    are one; repeated rows of documents are one here (same id and text).
    """
    spark = docs.sparkSession
    prepare(spark)
    items = (
        benchmark.select(F.col("text"))
        .where(F.col("text").isNotNull())
        .select(F.xxhash64("text").alias("item"), "text")
        .dropDuplicates(["item"])
        .mapInArrow(_benchmark, "item bigint, words binary, seeds array<bigint>, places array<int>")
        .checkpoint()
    )
    size = (F.octet_length("words") / 8).cast("int")
    seeds = items.select("item", size.alias("size"), F.explode(F.arrays_zip("seeds", "places")).alias("s")).select(
        "item", "size", F.col("s.seeds").alias("seed"), F.col("s.places").alias("item_place")
    )
    lengths = [r[0] for r in items.where(size < SHORT).select(size.alias("n")).distinct().collect()]
    # No word of an item is further from a place that hit.
    reach = items.agg(F.max(size)).first()[0] or 0
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = text_rows(docs, id_col, text_col).select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    stretches = rows.mapInArrow(
        _search(HashFilter.of(seeds, "seed"), lengths, reach),
        f"doc_id {kind}, text_hash bigint, start bigint, words binary, seeds array<bigint>, places array<bigint>",
    ).checkpoint()
    numbered = stretches.withColumn("stretch", F.monotonically_increasing_id())
    hits = numbered.select("stretch", "start", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select(
        "stretch", (F.col("s.places") - F.col("start")).alias("place"), F.col("s.seeds").alias("seed")
    )
    if seeds.count() <= BROADCAST_SEEDS:
        met = hits.join(F.broadcast(seeds), "seed")
    else:
        salted = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = hits.withColumn("salt", F.pmod("stretch", F.lit(SALTS)).cast("int")).join(salted, ["seed", "salt"])
    aligned = met.select("stretch", "item", "size", (F.col("place") - F.col("item_place")).cast("int").alias("shift")).distinct()
    # Of a stretch, an alignment needs the words that lie on the item.
    before = F.least("shift", F.lit(0))
    lain = F.substring("words", 8 * F.greatest("shift", F.lit(0)) + 1, 8 * (F.col("size") + before)).alias("words")
    compared = (
        aligned.join(numbered.select("stretch", "doc_id", "text_hash", "words"), "stretch")
        .select("doc_id", "text_hash", "item", lain, before.cast("bigint").alias("shift"))
        .join(items.select("item", F.col("words").alias("item_words")), "item")
        .select("doc_id", "text_hash", "item", "words", "item_words", "shift")
        .mapInArrow(_verify, f"doc_id {kind}, text_hash bigint, item bigint, equal_words bigint, overlap_words bigint, item_share double")
    )
    best = F.max(F.struct("equal_words", "overlap_words", "item_share")).alias("best")
    return compared.groupBy("doc_id", "text_hash", "item").agg(best).select("doc_id", "text_hash", "item", "best.*")


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, contaminated, n_items, equal_words, item_share for every row: how many items overlap and the best of them.

    Repeated rows give repeated rows; an empty benchmark contaminates nothing.
    """
    by_text = (
        overlaps(docs, benchmark, id_col, text_col)
        .groupBy(F.col("doc_id").alias("found_id"), F.col("text_hash").alias("found_hash"))
        .agg(F.count(F.lit(1)).alias("n_items"), F.max("equal_words").alias("equal_words"), F.max("item_share").alias("item_share"))
    )
    rows = text_rows(docs, id_col, text_col).select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash"))
    joined = rows.join(by_text, rows["doc_id"].eqNullSafe(by_text["found_id"]) & (rows["text_hash"] == by_text["found_hash"]), "left")
    return joined.select(
        "doc_id",
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("equal_words", F.lit(0)).alias("equal_words"),
        F.coalesce("item_share", F.lit(0.0)).alias("item_share"),
    )


def not_sought(benchmark: DataFrame) -> DataFrame:
    """The rows of ``benchmark`` that overlap with nothing because they are null or have fewer than ``LEAST_WORDS`` words."""
    return benchmark.where(F.size(words_of(padded_words(F.col("text")))) < LEAST_WORDS)


def without_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that overlap with no item."""
    found = overlaps(docs, benchmark).select(F.col("doc_id").alias("found_id"), F.col("text_hash").alias("found_hash")).distinct()
    hashed = docs.withColumn("_hash", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    clean = hashed["doc_id"].eqNullSafe(found["found_id"]) & (hashed["_hash"] == found["found_hash"])
    return hashed.join(found, clean, "left_anti").select(*docs.columns)
