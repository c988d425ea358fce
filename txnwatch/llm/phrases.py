"""Phrase collocations: frequent phrases by Rabin-Karp fingerprints, scored by their loosest cut.

A text falls into pieces at ``[.,;:!?\\x0A-\\x0D]`` and a piece into words at blanks and
tabs. Everything is per language. NumPy prefix polynomials over bytes give each word a
fingerprint, and prefix polynomials over words one to each run of n words.

* A sketch goes first: places are counted in cells, the top bits of their fingerprints, and only fingerprints whose cell
  holds ``least`` places can be frequent. Cells travel at about a byte each. They are sized from the bytes of
  the texts and bounded, so beyond some hundred GB they would fill up; the sketch is then left out, which costs shuffle and no phrase.
* Every task adds up the fingerprints that are left, each with a digest of its own (``check``) and a pointer to a text
  that holds the phrase, and sends them in runs by range of fingerprints; the shuffle brings the runs of a range together,
  where they are merged. No phrase travels.
* A phrase is frequent only if both phrases that lack its first or last word are, so each
  length counts only the places that passed the length before, by filters sized from the
  frequent fingerprints. A filter lets some others through and loses none.
* Only frequent phrases are written out: texts that a pointer names are read again. Fingerprints whose
  digests differ, or whose texts do, have collided; their phrases are counted again by text, in all texts.
* Scores, cuts and containment are joins on the phrases themselves.

The empty phrase stands at every word, so its count is the number of words of the language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnwatch.llm import textvec as tv
from txnwatch.llm.filters import HashFilter
from txnwatch.llm.tables import prepare

MOST_WORDS = 5
LEAST_COUNT = 100
TOP = 2000
UNKNOWN = "und"
#: Rows that a task holds before it combines them, and distinct ones from which on it sends them off.
HELD, SENT = 1_500_000, 1_000_000
#: Bytes of text for each range of fingerprints, so that the distinct ones of a range fit a task; 2^8 to 2^20 ranges.
BYTES_A_RANGE, LEAST_RANGES, MOST_RANGES = 1 << 24, 8, 20
#: Cells of the sketch: one for so many bytes, 2^16 to 2^28 (32 MB as bits); a cell range is 2^16 cells or more.
BYTES_A_CELL, LEAST_CELLS, MOST_CELLS, RANGES = 16, 16, 28, 256

_CUT = np.zeros(256, bool)
_CUT[[10, 11, 12, 13, *b".,;:!?"]] = True
_APART = _CUT.copy()
_APART[[9, 32]] = True
#: A second, shorter polynomial with byte values of its own.
_V = np.uint32
_CHECK_BYTE = np.random.default_rng(20240301).integers(1, 2**32, 256, dtype=_V) | _V(1)
_CHECK_BASE = _V(0x9E3779B1)
_check_powers = [np.ones(1, _V), np.ones(1, _V)]

RUNS = "part int, fp binary, n binary, check binary, key binary"
LEVEL = "fp bigint, f bigint, c0 int, c1 int, k0 bigint, k1 bigint"
FOUND = "fp bigint, key bigint, lang string, words int, phrase string, n bigint"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_check_powers[0]) <= n:
        size = max(n + 1, 2 * tv.CHUNK_BYTES)
        for k, base in enumerate((_CHECK_BASE, _V(pow(int(_CHECK_BASE), -1, 1 << 32)))):
            run = np.full(size, base, _V)
            run[0] = 1
            _check_powers[k] = np.cumprod(run, dtype=_V)
    return _check_powers[0], _check_powers[1]


def _parts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, lower-case bytes, offsets) of about a megabyte; a longer text is cut between pieces."""
    for first, end, data, offsets in tv.chunks(column):
        data = tv.LOWER[data]
        if end - first > 1 or len(data) <= 2 * tv.CHUNK_BYTES:
            yield first, data, offsets
            continue
        cuts, at = np.flatnonzero(_CUT[data]) + 1, 0
        while at < len(data):
            k = np.searchsorted(cuts, at + tv.CHUNK_BYTES)
            stop = int(cuts[k]) if k < len(cuts) else len(data)
            yield first, data[at:stop], np.array([0, stop - at])
            at = stop


class Grams:
    """Fingerprints and digests of the runs of words of one part. ``seeds`` has a number for each text's language."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray, bits: int):
        self.data, self.bits = data, bits
        self.words = w = tv.Words(data, offsets, _APART)
        self.seed = seeds[w.text]
        count = len(w.start)
        up, down = tv.powers(max(count, 1))
        hashes = tv.Hasher(data).spans(w.start, w.end)
        self.run, self.down = np.concatenate([np.zeros(1, tv.U), np.cumsum(hashes * up[:count], dtype=tv.U)]), down
        up2, down2 = _powers(len(data))
        bytes2 = np.concatenate([np.zeros(1, _V), np.cumsum(_CHECK_BYTE[data] * up2[: len(data)], dtype=_V)])
        own = (bytes2[w.end] - bytes2[w.start]) * down2[w.start]
        own ^= own >> _V(15)
        self.run2, self.down2 = np.concatenate([np.zeros(1, _V), np.cumsum(own * up2[:count], dtype=_V)]) if count else np.zeros(1, _V), down2
        # A piece has a number that no other piece of the part has.
        self.piece = np.searchsorted(np.flatnonzero(_CUT[data]), w.start) + w.text

    def fingerprints(self, at: np.ndarray, n: int) -> np.ndarray:
        h = tv.mix((self.run[at + n] - self.run[at]) * self.down[at] + self.seed[at] + tv.U(n))
        return h if self.bits >= 64 else h & tv.U((1 << self.bits) - 1)

    def checks(self, at: np.ndarray, n: int) -> np.ndarray:
        own = (self.run2[at + n] - self.run2[at]) * self.down2[at] + _V(n * int(_CHECK_BASE) & 0xFFFFFFFF)
        return (own ^ (self.seed[at] >> tv.U(32)).astype(_V)).view(np.int32)

    def survivors(self, n: int, known: list[HashFilter]) -> tuple[np.ndarray, np.ndarray]:
        """(place, fingerprint) of the runs of n words whose shorter runs may be frequent; ``known[k]`` is for k + 1 words."""
        at = np.arange(len(self.words.start) if n else 0)
        hashes = self.fingerprints(at, 1) if n else np.zeros(0, tv.U)
        for k in range(2, n + 1):
            at = at[known[k - 2].passes(hashes)]
            follows = np.flatnonzero(at[1:] == at[:-1] + 1)
            at = at[follows]
            at = at[self.piece[at] == self.piece[at + k - 1]]
            hashes = self.fingerprints(at, k)
        return at, hashes

    def phrase(self, at: int, n: int) -> str:
        span = self.data[self.words.start[at] : self.words.end[at + n - 1]] if n else self.data[:0]
        return b" ".join(span.tobytes().split()).decode("utf-8", "replace")


def _seed(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode())


def _seeds(batch: pa.RecordBatch) -> np.ndarray:
    langs = batch.column("lang").to_pylist()
    table = {x: _seed(x) for x in set(langs)}
    return np.array([table[x] for x in langs], tv.U)


class _Tally:
    """Counts by fingerprint within a task, in bounded memory."""

    def __init__(self, ranges: int):
        self.ranges = ranges  # as a power of two
        self.held: list[tuple[np.ndarray, ...]] = []
        self.rows = 0

    def add(self, fp: np.ndarray, n: np.ndarray, check: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(self._combined(fp, n, check, key))
        self.rows += len(self.held[-1][0])
        if self.rows >= HELD:
            self.held = [self._combined(*(np.concatenate(x) for x in zip(*self.held, strict=True)))]
            self.rows = len(self.held[0][0])
            if self.rows >= SENT:
                yield from self.send()

    @staticmethod
    def _combined(fp, n, check, key):
        order = np.argsort(fp)
        fp, n, check, key = fp[order], n[order], check[order], key[order]
        new = np.ones(len(fp), bool)
        new[1:] = (fp[1:] != fp[:-1]) | (check[1:] != check[:-1])
        first = np.flatnonzero(new)
        if not len(first):
            return fp, n, check, key
        return fp[first], np.add.reduceat(n, first), check[first], np.minimum.reduceat(key, first)

    def send(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            fp, n, check, key = self._combined(*(np.concatenate(x) for x in zip(*self.held, strict=True)))
            part = (fp >> tv.U(64 - self.ranges)).astype(np.int32)
            starts = np.flatnonzero(np.diff(part, prepend=-1))
            ends = np.append(starts, len(part))
            cuts = list(zip(ends[:-1], ends[1:], strict=True))
            raw = [pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in (fp, n, check, key)]
            yield pa.RecordBatch.from_arrays([pa.array(part[starts]), *raw], names=["part", "fp", "n", "check", "key"])
        self.held, self.rows = [], 0


def _merged(least: int):
    """The frequent fingerprints of each range; runs come sorted by range, so one range is held at a time."""

    def added(rows: list[np.ndarray]) -> list[np.ndarray]:
        order = np.argsort(rows[0], kind="stable")
        fp, f, c0, c1, k0, k1 = (x[order] for x in rows)
        first = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]]))
        low, high = np.minimum.reduceat, np.maximum.reduceat
        return [fp[first], np.add.reduceat(f, first), low(c0, first), high(c1, first), low(k0, first), high(k1, first)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, rows = None, [], 0

        def frequent() -> pa.RecordBatch:
            sums = added([np.concatenate(x) for x in zip(*held, strict=True)])
            keep = sums[1] >= least
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in sums], names=["fp", "f", "c0", "c1", "k0", "k1"])

        for batch in batches:
            for now, *raw in zip(*(batch.column(c).to_pylist() for c in ("part", "fp", "n", "check", "key")), strict=True):
                if now != part and held:
                    yield frequent()
                    held, rows = [], 0
                part = now
                fp, n, check, key = (np.frombuffer(x, k) for x, k in zip(raw, ("<i8", "<i8", "<i4", "<i8"), strict=True))
                held.append([fp, n, check, check, key, key])
                rows += len(fp)
                if rows >= 2 * HELD:
                    held = [added([np.concatenate(x) for x in zip(*held, strict=True)])]
                    rows = len(held[0][0]) // 2
        if held:
            yield frequent()

    return run


class Cells:
    """Which cells hold ``least`` places or more."""

    def __init__(self, log2: int, flags: np.ndarray):
        self.log2, self.flags = log2, flags

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        cell = (hashes >> tv.U(64 - self.log2)).astype(np.int64)
        return (self.flags[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers as four planes of bytes, compressed: the upper ones are almost all zero."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unplaned(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _cell_counts(n: int, known: list[HashFilter], bits: int, log2: int):
    """Sorted cells and their counts for each range of cells, as gaps; in bounded memory."""
    width = (1 << log2) // RANGES

    def sent(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        cells, counts = np.unique(np.concatenate(held), return_counts=True)
        ends = np.searchsorted(cells, np.arange(RANGES + 1) * width)
        rows = []
        for part in range(RANGES):
            here = slice(ends[part], ends[part + 1])
            if ends[part] < ends[part + 1]:
                rows.append((part, _planes(np.diff(cells[here], prepend=part * width)), _planes(counts[here])))
        columns = list(zip(*rows, strict=True)) or [()] * 3
        kinds = (pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "gaps", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [np.zeros(0, np.int32)], 0  # a cell has at most MOST_CELLS bits
        for batch in batches:
            seeds = _seeds(batch)
            for first, data, offsets in _parts(batch.column("text")):
                grams = Grams(data, offsets, seeds[first : first + len(offsets) - 1], bits)
                _, hashes = grams.survivors(n, known)
                held.append((hashes >> tv.U(64 - log2)).astype(np.int32))
                rows += len(hashes)
                if rows >= 4 * HELD:
                    yield from sent(held)
                    held, rows = [np.zeros(0, np.int32)], 0
        yield from sent(held)

    return run


def _cell_flags(log2: int, least: int):
    """The flags of each range of cells; rows come sorted by range, so one range is held at a time."""
    width = (1 << log2) // RANGES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, counts = None, np.zeros(width, np.int64)

        def flags() -> pa.RecordBatch:
            raw = np.packbits(counts >= least, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([raw], pa.binary())], names=["part", "flags"])

        for batch in batches:
            for now, gaps, times in zip(*(batch.column(c).to_pylist() for c in ("part", "gaps", "counts")), strict=True):
                if now != part:
                    if part is not None:
                        yield flags()
                    part, counts = now, np.zeros(width, np.int64)
                counts[np.cumsum(_unplaned(gaps))] += _unplaned(times)
        if part is not None:
            yield flags()

    return run


def _sketch(rows: DataFrame, n: int, known: list[HashFilter], bits: int, log2: int, least: int) -> Cells:
    """At most 2^MOST_CELLS bits come to the driver, RANGES rows of them."""
    counted = rows.mapInArrow(_cell_counts(n, list(known), bits, log2), "part int, gaps binary, counts binary")
    met = counted.repartition("part").sortWithinPartitions("part").mapInArrow(_cell_flags(log2, least), "part int, flags binary")
    flags = np.zeros((RANGES, (1 << log2) // RANGES // 8), np.uint8)
    for r in met.collect():
        flags[r["part"]] = np.frombuffer(r["flags"], np.uint8)
    return Cells(log2, flags.ravel())


def _counts(n: int, known: list[HashFilter], bits: int, cells: Cells | None, ranges: int):
    """Counts of runs of n words; with n = 1 also the number of words, as the empty phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally(ranges)
        for batch in batches:
            seeds, keys = _seeds(batch), batch.column("key").to_numpy()
            for first, data, offsets in _parts(batch.column("text")):
                own = keys[first : first + len(offsets) - 1]
                grams = Grams(data, offsets, seeds[first : first + len(own)], bits)
                at, hashes = grams.survivors(n, known)
                if cells:
                    keep = cells.passes(hashes)
                    at, hashes = at[keep], hashes[keep]
                yield from tally.add(hashes, np.ones(len(at), np.int64), grams.checks(at, n), own[grams.words.text[at]])
                if n == 1:
                    some = np.flatnonzero(grams.words.counts)
                    at = grams.words.bounds[some]
                    yield from tally.add(grams.fingerprints(at, 0), grams.words.counts[some].astype(np.int64), grams.checks(at, 0), own[some])
        yield from tally.send()

    return run


def _written(known: list[HashFilter], wanted: HashFilter, pointers: tuple[HashFilter, HashFilter] | None, bits: int):
    """The phrases behind wanted fingerprints, with their counts in each part of the texts. With ``pointers`` (text
    keys; fingerprints joined with keys) only where they point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if pointers:
                batch = batch.filter(pa.array(pointers[0].passes(batch.column("key").to_numpy())))
            seeds, keys, langs = _seeds(batch), batch.column("key").to_numpy(), batch.column("lang").to_pylist()
            for first, data, offsets in _parts(batch.column("text")):
                grams = Grams(data, offsets, seeds[first : first + len(offsets) - 1], bits)
                rows: dict[tuple, int] = {}
                for n in range(len(known) + 1):
                    if n:
                        at, hashes = grams.survivors(n, known)
                        times = np.ones(len(at), np.int64)
                    else:
                        some = np.flatnonzero(grams.words.counts)
                        at, times = grams.words.bounds[some], grams.words.counts[some]
                        hashes = grams.fingerprints(at, 0)
                    keep = wanted.passes(hashes)
                    if pointers:
                        keep[keep] = pointers[1].passes(hashes[keep] ^ keys[first + grams.words.text[at[keep]]].view(tv.U))
                    for a, h, t in zip(at[keep].tolist(), hashes[keep].view(np.int64).tolist(), times[keep].tolist(), strict=True):
                        text = first + int(grams.words.text[a])
                        row = (h, int(keys[text]), langs[text], n, grams.phrase(a, n))
                        rows[row] = rows.get(row, 0) + t
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string())
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)] + [pa.array(rows.values(), pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["fp", "key", "lang", "words", "phrase", "n"])

    return run


def frequent_phrases(
    docs: DataFrame, least: int = LEAST_COUNT, most_words: int = MOST_WORDS, text_col: str = "text", lang_col: str = "lang", bits: int = 64
) -> DataFrame:
    """lang, words, phrase, f: every phrase of up to ``most_words`` words that occurs ``least`` times in its language.

    ``words`` 0 is the empty phrase with the number of words of the language (if that is ``least`` or
    more). Null texts are empty, a null language is ``und``, overlapping occurrences count, repeated
    rows count each, and an empty table has no phrase. ``bits`` shortens the fingerprints, which tests the collisions.
    """
    if least < 1 or most_words < 1:
        raise ValueError("least and most_words start at 1")
    prepare(docs.sparkSession)
    text, lang = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(lang_col), F.lit(UNKNOWN))
    rows = docs.select(text.alias("text"), lang.alias("lang"), F.xxhash64(text, lang).alias("key"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted_cells = size // BYTES_A_CELL
    log2 = min(max(wanted_cells.bit_length(), LEAST_CELLS), MOST_CELLS)
    ranges = min(max((size // BYTES_A_RANGE).bit_length(), LEAST_RANGES), MOST_RANGES)
    sketched = bits >= 64 and wanted_cells < (least << MOST_CELLS) // 2
    known: list[HashFilter] = []
    frequent = None
    for n in range(1, most_words + 1):
        cells = _sketch(rows, n, known, bits, log2, least) if sketched else None
        runs = rows.mapInArrow(_counts(n, list(known), bits, cells, ranges), RUNS).repartition("part").sortWithinPartitions("part")
        level = runs.mapInArrow(_merged(least), LEVEL).checkpoint()
        found = level.count()
        if not found:
            break
        known.append(HashFilter.of(level, "fp", found))
        frequent = level if frequent is None else frequent.unionByName(level)
    if frequent is None:
        return docs.sparkSession.createDataFrame([], "lang string, words int, phrase string, f bigint")
    ends = [F.min("c0").alias("c0"), F.max("c1").alias("c1"), F.min("k0").alias("k0"), F.max("k1").alias("k1")]
    frequent = frequent.groupBy("fp").agg(F.sum("f").alias("f"), *ends).checkpoint()
    wanted = HashFilter.of(frequent, "fp")
    pointers = frequent.select("fp", F.explode(F.array("k0", "k1")).alias("key")).select("key", F.col("fp").bitwiseXOR(F.col("key")).alias("both"))
    pointers = pointers.distinct().checkpoint()
    there = HashFilter.of(pointers, "key"), HashFilter.of(pointers, "both")
    seen = rows.mapInArrow(_written(known, wanted, there, bits), FOUND)
    seen = seen.join(frequent, "fp").where(F.col("key").isin(F.col("k0"), F.col("k1")))
    spelled = seen.select("fp", "lang", "words", "phrase", "f", (F.col("c0") != F.col("c1")).alias("apart")).distinct()
    each = spelled.groupBy("fp").agg(
        F.count(F.lit(1)).alias("spellings"), *[F.min(c).alias(c) for c in ("lang", "words", "phrase", "f", "apart")]
    )
    sure = each.where((F.col("spellings") == 1) & ~F.col("apart")).checkpoint()
    doubtful = frequent.join(sure, "fp", "left_anti").select("fp").checkpoint()
    out = sure.select("lang", "words", "phrase", "f")
    collided = doubtful.count()
    if collided:
        again = rows.mapInArrow(_written(known, HashFilter.of(doubtful, "fp", collided), None, bits), FOUND)
        exact = again.join(doubtful, "fp", "left_semi").groupBy("lang", "words", "phrase").agg(F.sum("n").alias("f"))
        out = out.unionByName(exact.where(F.col("f") >= least))
    return out


def _words(first: Column | int, count: Column) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), F.lit(first) if isinstance(first, int) else first, count), " ")


def collocations(
    docs: DataFrame, least: int = LEAST_COUNT, most_words: int = MOST_WORDS, top: int = TOP, text_col: str = "text", lang_col: str = "lang", bits: int = 64
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, k: the ``top`` best phrases of two words or more in each language.

    ``a`` counts the phrase, ``l`` and ``r`` its first ``k`` words and the rest, ``n`` all words; the score is
    floor(1000 a n / (l r)) at the cut that makes it least (the smallest such k). A phrase that never stands
    outside one longer frequent phrase goes. Ties in the score go by ``a``, then by the phrase's bytes. Nulls,
    repeated rows and empty tables are as in ``frequent_phrases``.
    """
    counts = frequent_phrases(docs, least, most_words, text_col, lang_col, bits).checkpoint()
    total = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    candidates = counts.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"))
    # A longer phrase is as rare as, or rarer than, what lies between: one word more is enough to look at.
    inner = F.array(_words(1, F.col("words") - 1), _words(2, F.col("words") - 1))
    within = candidates.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    alone = candidates.join(within, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).drop("longer")
    cuts = alone.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("*", _words(1, F.col("k")).alias("left"), _words(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    halves = [counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)) for side, name in (("left", "l"), ("right", "r"))]
    cuts = cuts.join(halves[0], ["lang", "left"]).join(halves[1], ["lang", "right"]).join(total, "lang")
    # Exact decimals of 38 digits: 1000 a n needs up to 36.
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(16,0)) * cast(n as decimal(16,0))) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))")
    scored = cuts.select("lang", "phrase", "a", "n", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
    loosest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min("cut").alias("cut")).select("lang", "phrase", "a", "n", "cut.*")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = loosest.withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "k")
