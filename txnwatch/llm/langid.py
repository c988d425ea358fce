"""Language identification with error-correcting output codes.

Every language gets a binary codeword; one classifier per code bit tells from
byte n-grams on which side of that bit a text lies. Decoding takes the
codeword with the least logistic loss over all bits, each bit weighted by how
well it separates the languages in training; where the two best codewords are
almost level the text is flagged as ambiguous.

Fitting counts hashed n-grams by language over labelled training texts, at most
``sample`` a language (a documented bound, chosen by a hash of the id); the
counting runs in tasks and only the sums, languages x 2**bits numbers, reach the
driver. Prediction reads whole texts and nothing but the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnwatch.llm import textvec as tv
from txnwatch.llm.tables import crc_fold, prepare, text_rows

UNKNOWN = "und"
ORDERS = (1, 2, 3, 4)
TABLE_BITS = 13
#: Most labelled texts a language that fitting reads.
SAMPLE = 4000
AMBIGUOUS = 0.02

#: Letters are lower-cased where that is one byte or one Latin two-byte character.
_BLANK = ord(" ")


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # n-gram table x bits
    bias: np.ndarray  # a bit's mean over the languages' centres
    scale: np.ndarray  # a bit's spread in training
    bit_weights: np.ndarray


def codewords(n: int) -> np.ndarray:
    """Codewords for n classes: the exhaustive code up to 6, else seeded columns with both signs, 15 bits a doubling."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        columns = range(1, 1 << (n - 1))
        return np.array([[1.0] * len(columns)] + [[1.0 if c >> (i - 1) & 1 == 0 else -1.0 for c in columns] for i in range(1, n)])
    rng = np.random.default_rng(8)
    bits = 15 * int(np.ceil(np.log2(n)))
    columns = []
    while len(columns) < bits:
        c = rng.permutation(np.where(np.arange(n) < n // 2, 1.0, -1.0))
        columns.append(c)
    return np.array(columns).T


def _normal(data: np.ndarray) -> np.ndarray:
    """ASCII lower-cased; everything ASCII that is no letter becomes a blank; Latin-1 capitals lower-cased."""
    out = tv.LOWER[data]
    out = np.where((out < 0x80) & ~((out >= 97) & (out <= 122)), _BLANK, out).astype(np.uint8)
    second = np.zeros(len(out), bool)
    second[1:] = out[:-1] == 0xC3
    out[second & (out >= 0x80) & (out <= 0x9E) & (out != 0x97)] += 0x20
    return out


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams that do not begin with a run of blanks, and the text of each."""
    b = _normal(data).astype(np.uint64)
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    letter = b != _BLANK
    slots, texts = [], []
    for n in ORDERS:
        m = len(b) - n + 1
        if m <= 0:
            break
        h = np.zeros(m, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + b[k : k + m] + np.uint64(n)
        ok = text[:m] == text[n - 1 :]
        # Two blanks in a row say nothing about a language.
        ok &= letter[:m] | letter[1 : m + 1] if n > 1 else letter[:m]
        slots.append(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int32)[ok])
        texts.append(text[:m][ok])
    if not slots:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(slots), np.concatenate(texts)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts by language of a task: (lang, slot, n)."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for first, end, data, offsets in tv.chunks(batch.column("text")):
            slots, texts = _grams(data, offsets)
            mine = np.array(langs[first:end], dtype=object)
            for lang in set(mine):
                own = np.isin(texts, np.flatnonzero(mine == lang))
                table = sums.setdefault(lang, np.zeros(1 << TABLE_BITS, np.int64))
                table += np.bincount(slots[own], minlength=1 << TABLE_BITS)
    for lang, table in sums.items():
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(table[at])], names=["lang", "slot", "n"]
        )


def training_rows(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """lang and text of at most about ``sample`` labelled texts a language, by a hash of id and text."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, sample / n)).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 20)) / float(1 << 20)
    return rows.where(draw < share).select("lang", "text")


def fit(training: DataFrame) -> Model:
    """A model from rows of (lang, text); without any row, a model that knows no language."""
    counted = training.mapInArrow(_count, "lang string, slot int, n bigint")
    rows = counted.groupBy("lang", "slot").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r["lang"] for r in rows})
    size = 1 << TABLE_BITS
    table = np.zeros((len(languages), size))
    place = {lang: i for i, lang in enumerate(languages)}
    for r in rows:
        table[place[r["lang"]], r["slot"]] = r["n"]
    codes = codewords(len(languages))
    if not languages:
        return Model([], codes, np.zeros((size, 1)), np.zeros(1), np.ones(1), np.ones(1))
    p = table / np.maximum(table.sum(1, keepdims=True), 1) + 0.1 / size
    p /= p.sum(1, keepdims=True)
    bits = codes.shape[1]
    weights = np.zeros((size, bits))
    for j in range(bits):
        one, other = codes[:, j] > 0, codes[:, j] < 0
        if one.any() and other.any():
            weights[:, j] = np.log(p[one].mean(0)) - np.log(p[other].mean(0))
    centres = p @ weights  # the mean bit score of each language
    low = np.where(codes < 0, centres, -np.inf).max(0)
    high = np.where(codes > 0, centres, np.inf).min(0)
    flat = ~(np.isfinite(low) & np.isfinite(high))
    bias = np.where(flat, 0.0, (np.where(flat, 0, low) + np.where(flat, 0, high)) / 2)
    gap = np.where(flat, 1.0, np.maximum(np.where(flat, 1, high) - np.where(flat, 0, low), 1e-6) / 2)
    weight = gap / gap.sum()
    return Model(languages, codes, weights, bias, gap, weight)


def decode(model: Model, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language number, score from 0 to 1, ambiguous) for mean bit scores."""
    margin = np.clip((scores - model.bias) / model.scale, -30, 30)
    loss = np.logaddexp(0, -2.0 * margin[:, None, :] * model.codes[None]) @ model.bit_weights
    weight = np.exp(-4.0 * (loss - loss.min(1, keepdims=True)))
    share = weight / weight.sum(1, keepdims=True)
    best = loss.argmin(1)
    top = np.sort(share, axis=1)
    second = top[:, -2] if top.shape[1] > 1 else np.zeros(len(top))
    return best, top[:, -1], top[:, -1] - second < AMBIGUOUS


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep`` columns, lang_pred, score and ambiguous for every row.

    ``und`` with score 0 where the text is null, empty or without letters, or
    where the model knows no language. Repeated rows give repeated rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    size = 1 << TABLE_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            scores = [np.zeros((0, model.weights.shape[1]))]
            for _, _, data, offsets in tv.chunks(column):
                slots, texts = _grams(data, offsets)
                n = len(offsets) - 1
                mine = np.zeros((n, model.weights.shape[1]))
                order = np.argsort(texts, kind="stable")
                slots, count = slots[order], np.bincount(texts, minlength=n)
                at = np.concatenate([[0], np.cumsum(count)])
                for k in range(n):
                    if count[k]:
                        mine[k] = np.bincount(slots[at[k] : at[k + 1]], minlength=size) @ model.weights / count[k]
                scores.append(mine)
            best, score, unsure = decode(model, np.concatenate(scores)) if model.languages else (np.zeros(len(batch), int),) * 3
            known = letters & bool(model.languages)
            named = np.array([*model.languages, UNKNOWN], dtype=object)[np.where(known, best, len(model.languages))]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("doc_id", *keep)],
                    pa.array(named, pa.string()),
                    pa.array(np.where(known, score, 0.0).astype(float)),
                    pa.array(known & (np.asarray(unsure) != 0)),
                ],
                names=["doc_id", *keep, "lang_pred", "score", "ambiguous"],
            )

    rows = text_rows(docs, id_col, text_col, *[c for c in keep if c != "text"])
    kinds = dict(rows.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in ("doc_id", *keep)] + ["lang_pred string", "score double", "ambiguous boolean"])
    return rows.mapInArrow(run, schema)


def held_out(id_col: Column) -> Column:
    return F.pmod(crc_fold(id_col), F.lit(3)) == 1


def with_known_language(docs: DataFrame, columns: tuple[str, ...], sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` whose language is told without doubt; rows without letters or on the edge between two go.

    Fitted on the labelled rows that are not held out.
    """
    rows = docs.select(*columns)
    model = fit(training_rows(rows.where(~held_out(F.col("doc_id"))), sample))
    told = predict(rows, model, keep=tuple(c for c in columns if c != "doc_id"))
    return told.where((F.col("lang_pred") != UNKNOWN) & ~F.col("ambiguous")).select(*columns)
