"""SentencePiece encoding and decoding as a weighted transducer.

The model file is compiled to three machines: the normaliser (dummy prefix,
white space to U+2581), a trie of pieces that reads characters and writes
ids, and byte fallback for characters that no piece holds. Composed with a text
they give a lattice, and the encoding is its shortest path in the tropical
semiring: (min, +).

Unigram models weigh a piece by its negative score. In BPE models the
order of merges decides, which no sum of piece weights can express; there the
machine remembers its last piece and a step costs 0 if merging the two pieces
on their own would leave them as they are, and infinity if not. A sequence of
pieces is the BPE encoding exactly if every adjacent pair passes, so one path
has a finite cost, and every prefix has one finite state.

No piece goes on after a blank mark that follows another character, so the
lattice falls apart at such marks (checked when the model is compiled). Parts
are kept in a bounded table per worker; nothing else outlives a text.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnwatch.llm.tables import prepare, text_rows

BLANK = "▁"
#: Parts whose encoding a worker keeps; beyond it the table starts anew.
KEPT_PARTS = 250_000
KEPT_PAIRS = 1_000_000
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
INFINITY = float("inf")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else _varint(data, at)
            value = data[at : at + size]
            at += size
        yield key >> 3, value


class Transducer:
    def __init__(self, model: bytes):
        self.kind, self.prefix, self.squeeze, self.escape = UNIGRAM, True, True, True
        self.texts: list[str] = []
        self.scores: list[float] = []
        kinds: list[int] = []
        for number, value in _fields(model):
            if number == 1:
                text, score, kind = "", 0.0, NORMAL
                for k, v in _fields(value):
                    if k == 1:
                        text = v.decode()
                    elif k == 2:
                        score = struct.unpack("<f", v)[0]
                    elif k == 3:
                        kind = v
                self.texts.append(text)
                self.scores.append(score)
                kinds.append(kind)
            elif number == 2:
                for k, v in _fields(value):
                    if k == 3:
                        self.kind = v
            elif number == 3:
                for k, v in _fields(value):
                    if k == 2 and v:
                        raise ValueError("only models with the identity normaliser are supported")
                    if k in (3, 4, 5):
                        setattr(self, ("prefix", "squeeze", "escape")[k - 3], bool(v))
        if self.kind not in (UNIGRAM, BPE) or USER in kinds or not self.escape:
            raise ValueError("unigram and BPE models without user-defined pieces are supported")
        self.unknown = kinds.index(UNKNOWN)
        self.byte = {int(t[1:-1], 16): i for i, (t, k) in enumerate(zip(self.texts, kinds, strict=True)) if k == BYTE}
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.texts, kinds, strict=True)) if k == NORMAL}
        self.trie: dict = {}
        for text, i in self.ids.items():
            if self.kind == BPE and self.merged(text) != [text]:
                continue  # no merging ends in this piece
            node = self.trie
            for c in text:
                node = node.setdefault(c, {})
            node[""] = i
        self.longest = max(map(len, self.ids), default=1)
        self.lowest = min((s for s, k in zip(self.scores, kinds, strict=True) if k == NORMAL), default=0.0) - 10.0
        alone = {t for t in self.ids if len(t) == 1}
        inner = any(BLANK in t.lstrip(BLANK) for t in self.ids)
        # Parts: blank marks with what follows up to the next one; an ASCII control without a piece is a part of its own.
        apart = "".join(re.escape(c) for c in map(chr, range(32)) if not any(c in t for t in self.ids) and c not in alone)
        cut = f"[{apart}]|" if apart else ""
        self.parts = re.compile("(?s).+" if inner else f"(?s){cut}{BLANK}*[^{BLANK}{apart}]+|{BLANK}+").findall
        self.pairs: dict[int, bool] = {}
        self.known = _Parts(self)
        self.out = [self._bytes(i, k) for i, k in enumerate(kinds)]

    def _bytes(self, i: int, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(self.texts[i][1:-1], 16)])
        if kind == CONTROL:
            return b""
        return (" ⁇ " if kind == UNKNOWN else self.texts[i]).encode()

    def normalised(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (BLANK if self.prefix else "") + text.replace(" ", BLANK)

    def fallback(self, char: str) -> tuple[int, ...]:
        return tuple(self.byte[b] for b in char.encode()) if len(self.byte) == 256 else (self.unknown,)

    def merged(self, text: str) -> list[str]:
        """BPE of a short text: the best-scored adjacent pair merges first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stands(self, one: int, other: int) -> bool:
        """Whether merging two pieces on their own leaves them as they are."""
        key = one * len(self.texts) + other
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            b = self.texts[other]
            known = self.merged(self.texts[one] + b) == [self.texts[one], b]
            self.pairs[key] = known
        return known

    def arcs(self, part: str, at: int) -> list[tuple[int, int]]:
        """(end, piece) for the pieces that start at a place, the shortest first; -1: byte fallback, where no piece is one character."""
        node, end, out = self.trie, at, []
        for c in part[at : at + self.longest]:
            node = node.get(c)
            if node is None:
                break
            end += 1
            piece = node.get("")
            if piece is not None:
                out.append((end, piece))
        if not out or out[0][0] != at + 1:
            out.insert(0, (at + 1, -1))
        return out

    def shortest(self, part: str) -> list[int]:
        """Ids on the shortest path through the lattice of one part."""
        return self._finite(part) if self.kind == BPE else self._lightest(part)

    def _finite(self, part: str) -> list[int]:
        """Where every cost is 0 or infinite: the one path of finite cost, found depth first with the longest piece first.

        A place has one finite state, so a place that leads nowhere is never tried again.
        """
        n, at, last = len(part), 0, -1
        closed, trail, arcs = set(), [], self.arcs(part, 0)
        pairs, size = self.pairs, len(self.texts)
        while at < n:
            while arcs:
                end, piece = arcs.pop()
                if end in closed:
                    continue
                if last >= 0 and piece >= 0:
                    fits = pairs.get(last * size + piece)
                    if not (self.stands(last, piece) if fits is None else fits):
                        continue
                trail.append((at, last, arcs, piece))
                at, last = end, piece
                arcs = self.arcs(part, at) if at < n else []
                break
            else:
                closed.add(at)
                at, last, arcs, _ = trail.pop()
        ids: list[int] = []
        for at, _, _, piece in trail:
            if piece >= 0:
                ids.append(piece)
            else:
                ids.extend(self.fallback(part[at]))
        return ids

    def _lightest(self, part: str) -> list[int]:
        """The path of least weight, place by place."""
        n = len(part)
        cost, back = [0.0] + [INFINITY] * n, [(0, -1)] * (n + 1)
        for at in range(n):
            for end, piece in self.arcs(part, at):
                weight = cost[at] - (self.scores[piece] if piece >= 0 else self.lowest)
                if weight < cost[end]:
                    cost[end], back[end] = weight, (at, piece)
        steps, at = [], n
        while at:
            before, piece = back[at]
            steps.append(self.fallback(part[before]) if piece < 0 else (piece,))
            at = before
        return [i for step in reversed(steps) for i in step]

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.known.__getitem__, self.parts(self.normalised(text)))), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        out = self.out
        text = b"".join([out[i] for i in ids.tolist()]).decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


class _Parts(dict):
    """Encodings of parts as packed ids, found on first use."""

    def __init__(self, machine: Transducer):
        self.machine = machine
        self.older: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        if len(self) >= KEPT_PARTS:  # what is used again comes back from the older half
            self.older = dict(self)
            self.clear()
        ids = self.older.get(part)
        if ids is None:
            found = self.machine.shortest(part)
            ids = struct.pack(f"{len(found)}i", *found)
        self[part] = ids
        return ids


@lru_cache(maxsize=2)
def compiled(model: bytes) -> Transducer:
    """Once a worker."""
    return Transducer(model)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load(spark: SparkSession, path: str | None = None) -> bytes:
    """The model's bytes, a parameter of the job that goes to the tasks with the code."""
    if path is None:
        path = default_model()
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])
    with open(path, "rb") as f:
        return f.read()


def _rows(batch: pa.RecordBatch, size: int = 1000) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(batch), size):
        yield batch.slice(at, size)


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) and round_trip (decoding gives the text back) for every row.

    A null or empty text has no ids and comes back as the empty text; repeated
    rows give repeated rows; an empty table gives none. A text that holds
    U+2581 itself does not come back, as in any SentencePiece model.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(model)
        for batch in batches:
            for part in _rows(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                found = [machine.encode(t) for t in texts]
                back = [machine.decode(ids) == t for ids, t in zip(found, texts, strict=True)]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *found])))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, pa.array(back, pa.bool_())], names=["doc_id", "ids", "round_trip"])

    rows = text_rows(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text from ids; null ids give the empty text."""
    prepare(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(model)
        for batch in batches:
            texts = [machine.decode(np.asarray(ids or [], np.int32)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string")
