"""Token counts by a separator scan over flat token files.

A flat file is nothing but token ids, two bytes each, with an end-of-document
id after each document and no index. Files are cut into blocks; in
each block a vectorised search finds the separators. A document that a block
boundary cuts is stitched by a prefix scan over the blocks of its file: the
last separator before a block and the number of separators before it.

Files are read and written by Spark alone, so they can be in any store that it
reaches. The writer is Spark's text writer with the end-of-document id as the
line separator.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txnwatch.llm.tables import prepare, text_rows
from txnwatch.session import ensure_checkpoint_dir

TOKEN_BYTES = 2
END_OF_DOCUMENT = 50256
BLOCK_TOKENS = 1 << 20


@lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines())}
    return tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def default_ranks() -> tuple[bytes, str]:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete files that this job wrote."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def write_token_files(
    docs: DataFrame, path: str, ranks: bytes, pattern: str, end: int = END_OF_DOCUMENT, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Write the tokens of every text as flat files, one a task. Null and empty texts are a lone separator."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(ranks, pattern).encode_ordinary
        for batch in batches:
            for at in range(0, len(batch), 1000):
                texts = batch.column("text").slice(at, 1000).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([np.asarray(encode(t or ""), "<u2").tobytes() for t in texts], pa.binary())], names=["tokens"]
                )

    tokens = text_rows(docs, id_col, text_col).select("text").mapInArrow(run, "tokens binary")
    separator = int(end).to_bytes(TOKEN_BYTES, "little").decode("latin-1")
    # The bytes pass through as they are: a cast to string does not look at them.
    writer = tokens.select(F.col("tokens").cast("string").alias("value")).write
    writer.option("encoding", "ISO-8859-1").option("lineSep", separator).option("compression", "none").text(path)


def _separators(end: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column("block").to_pylist()
            sizes, found = [], []
            for number, raw in zip(numbers, batch.column("raw"), strict=True):
                tokens = np.frombuffer(raw.as_buffer(), "<u2")
                sizes.append(len(tokens))
                found.append(np.flatnonzero(tokens == end) + number * block)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            ends = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), pa.array(sizes, pa.int64()), ends], names=["file", "block", "tokens", "ends"]
            )

    return run


def count_tokens(spark: SparkSession, path: str, end: int = END_OF_DOCUMENT, block: int = BLOCK_TOKENS) -> DataFrame:
    """file, doc_no, first_token, n_tokens, ended for every document of the flat files under ``path``.

    ``n_tokens`` leaves out the separator. Tokens after the last separator of
    a file are a document with ``ended`` false; two separators in a row hold
    an empty document; a file without a byte holds none. An odd last byte is an error.
    """
    prepare(spark)
    step = block * TOKEN_BYTES
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where(F.col("length") > 0)
    count = F.ceil(F.col("length") / step).cast("int")
    blocks = files.select(F.col("path").alias("file"), "content", F.explode(F.sequence(F.lit(0), count - 1)).alias("block")).select(
        "file", "block", F.substring("content", F.col("block") * step + 1, F.lit(step)).alias("raw")
    )
    scanned = blocks.mapInArrow(_separators(end, block), "file string, block int, tokens bigint, ends array<bigint>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    stitched = scanned.select(
        "file",
        "ends",
        (F.coalesce(F.max(F.array_max("ends")).over(before), F.lit(-1)) + 1).alias("open"),
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("earlier"),
        (F.col("block") == F.max("block").over(whole)).alias("final"),
        F.sum("tokens").over(whole).alias("total"),
    )
    here = F.size("ends")
    tail = F.col("final") & (F.when(here > 0, F.get("ends", here - 1) + 1).otherwise(F.col("open")) < F.col("total"))
    cuts = F.when(tail, F.concat("ends", F.array("total"))).otherwise(F.col("ends"))
    each = stitched.select("file", "open", "earlier", here.alias("n"), cuts.alias("cuts"))
    first = F.when(F.col("nth") == 0, F.col("open")).otherwise(F.get("cuts", F.col("nth") - 1) + 1)
    return each.select("*", F.posexplode("cuts").alias("nth", "cut")).select(
        "file",
        (F.col("earlier") + F.col("nth")).alias("doc_no"),
        first.alias("first_token"),
        (F.col("cut") - first).alias("n_tokens"),
        (F.col("nth") < F.col("n")).alias("ended"),
    )
