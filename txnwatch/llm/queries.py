"""The registered queries of this subpackage: each runs one operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnwatch.llm import bytebpe, decontaminate, langid, licenses, neardup, negatives, phrases, pieces, pii, quality, repeats, shards, tokens
from txnwatch.llm.oracle import SQL
from txnwatch.llm.tables import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether decoding gives the text back."""
    out = pieces.encode(read(spark, sf_dir, "documents"), pieces.load(spark))
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), "ids", "round_trip")


def op2_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base spans and those of the weakly supervised classifier."""
    return pii.digest(pii.detect(read(spark, sf_dir, "documents")))


def op3_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules of every document: measurements, failure bits, and the default policy's verdict."""
    rows = quality.judge(quality.ledger(read(spark, sf_dir, "documents")))
    base = sum(quality.bit(r) for r in quality.BASE_RULES)
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (rows.bits.bitwiseAND(base) != 0).alias("base_failed"),
        "kept",
        "bits",
    )


def op4_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notice templates in every document."""
    return licenses.scan(read(spark, sf_dir, "documents"), whole_below=10).drop("matches")


def op5_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that lie in a 400-byte string which also starts elsewhere."""
    return repeats.remove_repeats(read(spark, sf_dir, "documents")).withColumn("has_repeats", F.col("n_removed") > 0)


def op6_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return neardup.near_duplicates(read(spark, sf_dir, "documents")).drop("text_hash", "label")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat token files written from all documents."""
    path = tokens.scratch(spark, "tokens")
    tokens.write_token_files(read(spark, sf_dir, "documents"), path, *tokens.default_ranks())
    part = F.regexp_extract("file", r"part-(\d+)", 1).cast("int").alias("part")
    out = tokens.count_tokens(spark, path).select(part, "doc_no", "first_token", "n_tokens", "ended").checkpoint()
    tokens.remove(spark, path)
    return out


def op8_ecoc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; fitted on those whose id hash is not in the held-out third."""
    docs = read(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text", "lang", langid.held_out(F.col("doc_id")).alias("held_out"))
    model = langid.fit(langid.training_rows(rows.where(~F.col("held_out"))))
    out = langid.predict(rows, model, keep=("held_out",))
    return out.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op9_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of every document with the benchmark."""
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty contiguous shards of near-equal bytes over all documents."""
    return shards.shard_by_bytes(read(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three negatives below each of the five positives of every fiftieth vector."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2,000 phrases of each language over all documents."""
    return phrases.collocations(read(spark, sf_dir, "documents")).drop("k")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, decoded again."""
    return bytebpe.round_trip(read(spark, sf_dir, "documents"), *bytebpe.default_ranks())


QUERIES: dict[str, Query] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_weak_pii": op2_weak_pii,
    "op3_quality_ledger": op3_quality_ledger,
    "op4_license_join": op4_license_join,
    "op5_repeated_bytes": op5_repeated_bytes,
    "op6_chosen_path": op6_chosen_path,
    "op7_token_counts": op7_token_counts,
    "op8_ecoc_language": op8_ecoc_language,
    "op9_spaced_seeds": op9_spaced_seeds,
    "op10_byte_shards": op10_byte_shards,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_phrases": op12_phrases,
    "op13_byte_bpe": op13_byte_bpe,
}
ORACLE: dict[str, str] = {k: SQL[k] for k in QUERIES if k in SQL}
