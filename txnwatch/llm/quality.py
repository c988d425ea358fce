"""Quality rules as a bitmask ledger.

Each text is measured once; every rule is evaluated once on the measurements
and its failure kept as one bit. A policy is a versioned set of rules, that
is, a mask: applying it, or asking what each rule alone removes, needs only
bit operations on the ledger and never the texts again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnwatch.llm import textvec as tv
from txnwatch.llm.tables import prepare, text_rows

WINDOW = 8

#: name: a failure, as SQL over the measurements. Bits are given in this order; append only.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines and n_lines > 3",
    "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
    "digits": "2 * n_digits > word_chars",
}
BASE_RULES = ("few_words", "repeated_windows")

#: Versioned policies; a stored ledger can be judged by any of them.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": BASE_RULES,
    "default-1": tuple(RULES),
}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_digits", "n_lines", "n_dup_lines", "n_repeat_words")

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(policy: str) -> int:
    return sum(bit(r) for r in POLICIES[policy])


def _later_copies(keys: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Per text, how many keys equal an earlier one of the same text."""
    both = tv.mix(keys + text.astype(tv.U) * tv.PLACE[63])
    _, first = np.unique(both, return_index=True)
    return np.bincount(text, minlength=texts) - np.bincount(text[first], minlength=texts)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got: dict[str, list[np.ndarray]] = {m: [] for m in MEASURES}
        for _, _, data, offsets in tv.chunks(batch.column("text")):
            texts = len(offsets) - 1
            words, spans = tv.Words(data, offsets), tv.Hasher(data)
            got["n_words"].append(words.counts)
            got["word_chars"].append(tv.per_text(words.inside & ((data & 0xC0) != 0x80), offsets))
            got["n_symbols"].append(tv.per_text(SYMBOL[data], offsets))
            got["n_digits"].append(tv.per_text((data >= 48) & (data <= 57), offsets))
            # Lines end at \n or with their text; only those with a word count.
            cut = np.unique(np.concatenate([np.flatnonzero(data == 10) + 1, offsets[1:]]))
            start = np.concatenate([[0], cut[:-1]]) if len(cut) else cut
            end = cut - ((cut > 0) & (data[np.maximum(cut, 1) - 1] == 10)) if len(data) else cut
            full = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
            start, end = start[full], end[full]
            text = np.searchsorted(offsets, start, "right") - 1
            got["n_lines"].append(np.bincount(text, minlength=texts))
            got["n_dup_lines"].append(_later_copies(spans.spans(start, end), text, texts))
            # Words in windows that occur twice or more in their text.
            hashes, at = tv.grams(spans.spans(words.start, words.end), words.text, WINDOW)
            keys = tv.mix(hashes + words.text[at].astype(tv.U) * tv.PLACE[63])
            _, which, count = np.unique(keys, return_inverse=True, return_counts=True)
            again = at[count[which] > 1]
            step = np.zeros(len(words.start) + 1, np.int64)
            np.add.at(step, again, 1)
            np.add.at(step, again + WINDOW, -1)
            got["n_repeat_words"].append(tv.per_text(np.cumsum(step[:-1]) > 0, words.bounds))
        columns = [np.concatenate(got[m]).astype(np.int64) if got[m] else np.zeros(0, np.int64) for m in MEASURES]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns)], names=["doc_id", *MEASURES])


def failure_bits() -> Column:
    total = F.lit(0).cast("bigint")
    for rule, sql in RULES.items():
        total = total.bitwiseOR(F.when(F.expr(sql), F.lit(bit(rule)).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return total


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements, and ``bits``: one bit per failed rule.

    One row per input row. A null or empty text has no words and fails
    ``few_words``; repeated rows give repeated rows; an empty table gives none.
    """
    prepare(docs.sparkSession)
    rows = text_rows(docs, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]
    schema = ", ".join([f"doc_id {kind}", *(f"{m} bigint" for m in MEASURES)])
    return rows.mapInArrow(_measure, schema).withColumn("bits", failure_bits())


def judge(rows: DataFrame, policy: str = "default-1") -> DataFrame:
    """The ledger with ``kept``: no rule of the policy failed."""
    return rows.withColumn("kept", F.col("bits").bitwiseAND(F.lit(mask(policy)).cast("bigint")) == 0)


def ablation(rows: DataFrame, policy: str = "default-1") -> DataFrame:
    """Per rule of the policy: rows that fail it, that fail it alone, and that would be kept without it.

    The ledger is first counted by bits (at most 2 ** rules rows); the rest is
    arithmetic on that.
    """
    names = POLICIES[policy]
    whole = F.lit(mask(policy)).cast("bigint")
    seen = F.col("bits").bitwiseAND(whole)
    by_bits = rows.groupBy(seen.alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).cast("bigint").alias("b")) for r in names]))
    each = by_bits.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.b")
    fails = F.col("bits").bitwiseAND(F.col("b")) != 0
    alone = F.col("bits") == F.col("b")
    return each.groupBy("rule").agg(
        F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("failed_alone"),
        F.sum(F.when(alone | (F.col("bits") == 0), F.col("n")).otherwise(0)).alias("kept_without"),
    )
