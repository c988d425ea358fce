"""Byte-level BPE by the tiktoken library with a local rank file, and raw-byte decoding.

The driver reads the rank file (its path is a parameter) and the lines travel with
the tasks, so workers need no copy of it.

The library holds every match of a text at once and looks ahead within white space,
so long texts are cut first, at safe boundaries: places where a match ends
whatever surrounds it. With a pattern whose matches are ``[space] letters``, ``[space] digits``,
``[space] others``, white space, or an apostrophe followed by letters, such a place is

* before white space that follows anything else (white space only begins a match), and
* after a letter or digit, where the next character is of another kind.

Such a pattern looks ahead only within white space and never behind, so the matches
of the segments are those of the whole text. A run of one kind has no such place and stays in one segment, however long it is;
only a long run of white space, on which the library's pattern search runs out of stack, is given to it as the one piece that it
is: all of the run at the end of the text, else all but its last character.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.llm.tables import prepare, text_rows

#: Texts of more characters are cut into segments of about this length.
SEGMENT = 1 << 16

#: Runs of white space from this length on do not go through the pattern.
BLANKS = 1 << 14

_SAFE = regex.compile(r"(?<=\P{White_Space})(?=\p{White_Space})|(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})")


def default_ranks() -> tuple[bytes, str]:
    """The lines of the public rank file for many languages, and its pattern."""
    import public_tokenizers

    return read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """The text in parts that end at safe boundaries, each at the first one from ``size`` characters on."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


@lru_cache(maxsize=2)
def encoding(ranks: bytes, pattern: str):
    """The library's encoding; one table for each worker."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def ids_of(text: str, ranks: bytes, pattern: str, size: int = SEGMENT, blanks: int = BLANKS) -> list[int]:
    """The ids of a text, as the library gives them for the whole text."""
    library = encoding(ranks, pattern)
    if len(text) <= min(size, blanks):
        return library.encode_ordinary(text)
    ids: list[int] = []
    at = 0
    for run in regex.finditer(rf"\p{{White_Space}}{{{blanks},}}", text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        ids += [i for part in segments(text[at : run.start()], size) for i in library.encode_ordinary(part)]
        ids += library._encode_single_piece(text[run.start() : end])
        at = end
    return ids + [i for part in segments(text[at:], size) for i in library.encode_ordinary(part)]


def _lists(values: list[np.ndarray], of: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *values]), of))


def encode(
    docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", size: int = SEGMENT
) -> DataFrame:
    """doc_id, ids, n_tokens, ids_sha256 (little-endian unsigned 32-bit ids) for every row; no special tokens.

    Null texts are empty: no ids. Repeated rows stay rows. Other columns, whatever they are called, are left out.
    """
    prepare(docs.sparkSession)
    schema = f"doc_id {_type(docs, id_col)}, ids array<int>, n_tokens bigint, ids_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.asarray(ids_of(t or "", ranks, pattern, size), "<u4") for t in batch.column("text").to_pylist()]
            digests = [hashlib.sha256(v.tobytes()).hexdigest() for v in ids]
            columns = [
                batch.column("doc_id"),
                _lists([v.astype(np.int32) for v in ids], pa.int32()),
                pa.array([len(v) for v in ids], pa.int64()),
                pa.array(digests, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "n_tokens", "ids_sha256"])

    return text_rows(docs, id_col, text_col).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """The rows of ``encode`` (doc_id, ids and any others) with ``decoded``: the bytes of the ids, which need not be valid UTF-8.

    Null ids are none: no bytes. An id without a rank is an error.
    """
    prepare(encoded.sparkSession)
    names = [c for c in encoded.columns if c != "decoded"]
    rows = encoded.select(*[F.col(f"`{c}`") for c in names])
    schema = rows.withColumn("decoded", F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = encoding(ranks, pattern).decode_bytes
        for batch in batches:
            raw = pa.array([whole(ids or []) for ids in batch.column("ids").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, raw], names=[*names, "decoded"])

    return rows.mapInArrow(run, schema)


def _type(df: DataFrame, column: str) -> str:
    return df.select(F.col(column)).schema[0].dataType.simpleString()


def round_trip(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` and ``decode`` of every row: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    done = decode(encode(docs, ranks, pattern, id_col, text_col), ranks, pattern)
    return done.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
