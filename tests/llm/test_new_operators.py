"""Operators 11 to 13: brute force, edges, ties, repeated rows, empty tables, clashing columns, forced collisions."""

import hashlib
import pickle
import random

import numpy as np
import plain
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from txnwatch.llm import bytebpe, negatives, phrases
from txnwatch.llm.filters import HashFilter, log2_bits
from txnwatch.llm.queries import QUERIES

SF_SMALL = "/root/testdata/sf0.001"
LABEL = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"
CLASH = "fp n key lang_ words rank score tile block kind ask got ids decoded n_tokens cell slab v c0 dim nth copy part".split()


def clashing(df):
    return df.selectExpr("*", *[f"'x' AS `{c}`" for c in CLASH])


# ---------------------------------------------------------------- 13
def library():
    return bytebpe.encoding(*bytebpe.default_ranks())


def test_byte_bpe_query_is_the_library(spark):
    rows = QUERIES["op13_byte_bpe"](spark, SF_SMALL).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = library().encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_cuts_at_safe_boundaries_change_no_id():
    rnd = random.Random(3)
    alphabet = " \t\n\x1c\x85　  'sStdlvreLM09١٣!?é日本\U0001f600́̀_-"
    for _ in range(4000):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60)))
        for size in (1, 3, 7):
            assert bytebpe.ids_of(text, *bytebpe.default_ranks(), size, size + 1) == library().encode_ordinary(text), text
            assert "".join(bytebpe.segments(text, size)) == text


def test_white_space_that_the_library_cannot_search():
    ids = bytebpe.ids_of("a" + " " * 3_000_000 + "b" + "\n" * 50_000, *bytebpe.default_ranks())
    assert library().decode(ids) == "a" + " " * 3_000_000 + "b" + "\n" * 50_000


def test_byte_bpe_edges(spark):
    rows = [(1, ""), (2, None), (None, "x y"), (3, "tie"), (3, "tie"), (4, "z" * 300_000), (5, "<|endoftext|> \x00 ́")]
    df = clashing(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = bytebpe.round_trip(df, *bytebpe.default_ranks()).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == sorted((str(k), len(library().encode_ordinary(t or ""))) for k, t in rows)
    assert {r["decoded_sha256"] for r in got} == {hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows}
    assert bytebpe.round_trip(df.limit(0), *bytebpe.default_ranks()).collect() == []
    raw = bytebpe.decode(spark.createDataFrame([(1, [0x80, 5]), (2, None)], "doc_id int, ids array<int>"), *bytebpe.default_ranks())
    assert {r["doc_id"]: bytes(r["decoded"]) for r in raw.collect()} == {1: library().decode_bytes([0x80, 5]), 2: b""}


# ---------------------------------------------------------------- 12
def phrase_rows(df):
    return {(r["lang"], r["rank"]): tuple(r[c] for c in ("phrase", "a", "l", "r", "n", "score")) for r in df.collect()}


@pytest.mark.parametrize("least, bits, top", [(5, 64, 2000), (5, 64, 7), (3, 12, 2000), (12, 64, 2000)])
def test_phrases_are_those_of_brute_force(spark, least, bits, top):
    """With 12 bits almost all fingerprints collide, across phrases, lengths and languages."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(60).checkpoint()
    want = plain.phrases([(r["text"], r["lang"]) for r in docs.collect()], least, top)
    assert len(want) > 10
    assert phrase_rows(phrases.collocations(docs, least=least, top=top, bits=bits)) == want


def test_phrase_edges(spark, monkeypatch):
    monkeypatch.setattr(phrases.tv, "CHUNK_BYTES", 4096)  # a long text in many parts
    long = "The old  Mill\tstands. " * 2000 + "one " * 3000
    rows = [(long, "en"), (long, "en"), (None, "en"), ("", None), ("Äb cd " * 30, None), ("a b. a b, a b\x0ba b", "de"), (" \t.\n", "fr"), ("x y " * 20, "und")]
    df = clashing(spark.createDataFrame(rows, "text string, lang string"))
    got = phrase_rows(phrases.collocations(df, least=4))
    assert got == plain.phrases(rows, 4)
    assert any(k[0] == "und" for k in got) and any(v[0] == "the old mill stands" for v in got.values())
    assert phrases.collocations(df.limit(0)).collect() == []
    assert phrases.collocations(df.where("lang = 'fr'")).collect() == []


def test_arithmetic_beyond_64_bits(spark, monkeypatch):
    big = 3_000_000_000_000
    counts = [("en", 0, "", 4 * 10**15), ("en", 1, "a", big), ("en", 1, "b", big + 1), ("en", 2, "a b", big - 1)]
    frame = spark.createDataFrame(counts, "lang string, words int, phrase string, f bigint")
    monkeypatch.setattr(phrases, "frequent_phrases", lambda *_: frame)
    row = phrases.collocations(frame).first()
    assert row["score"] == 1000 * (big - 1) * 4 * 10**15 // (big * (big + 1))


def test_filter_grows_with_its_keys(spark):
    rng = np.random.default_rng(5)
    others = rng.integers(-(2**63), 2**63 - 1, 200_000)
    for keys in (2_000, 20_000, 200_000):
        own = rng.integers(-(2**63), 2**63 - 1, keys)
        built = HashFilter.of(spark.createDataFrame(pa.table({"h": own}).to_pandas()), "h")
        assert built.passes(own).all()
        assert built.passes(others).mean() < 0.03
        assert built.log2 == log2_bits(keys)
    assert log2_bits(10**12) == 28 and log2_bits(0) == 24


# ---------------------------------------------------------------- 11
def negative_rows(df):
    return sorted(tuple(r) for r in df.collect())


def vectors(seed, n, dim, values=None):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)) if values is None else rng.choice(values, size=(n, dim))
    return [(i, [float(x) for x in v[i]], int(rng.integers(0, 3))) for i in range(n)]


@pytest.mark.parametrize(
    "rows, tile_rows",
    [
        (vectors(1, 400, 6), None),
        (vectors(1, 400, 6), 30),
        (vectors(2, 400, 3, [0.0, 0.25, 0.5]), 25),  # ties everywhere
        (vectors(3, 300, 1), 40),
        ([(i, [0.5, 0.5], i % 2) for i in range(300)] + vectors(4, 100, 2), 20),  # one vector many times
    ],
)
def test_negatives_are_those_of_brute_force(spark, monkeypatch, rows, tile_rows):
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", 3)
    monkeypatch.setattr(negatives, "BLOCKS_A_COPY", 2)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = negative_rows(negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, F.expr(LABEL), tile_rows=tile_rows))
    assert got == plain.hard_negatives(rows) and got


def test_leaves_are_searched_best_first_and_pruned(monkeypatch):
    rng = np.random.default_rng(7)
    v = np.sort(rng.integers(-1000, 1000, (4000, 2)), axis=0).astype(np.int64)
    leaves = negatives.str_order(v, axis=0)
    order = np.concatenate(leaves)
    ids, labels = order.astype(np.int64), np.zeros(4000, np.int64)
    row = {"ids": negatives._raw(ids), "labels": negatives._raw(labels), "cuts": negatives._raw(np.cumsum([len(x) for x in leaves])), "dim": 2}
    tree = negatives.Tree(row | {"v": v[order].astype("<i2").tobytes()})
    ask = {"block": 0, "dim": 2, "ids": negatives._raw(np.array([-1])), "labels": negatives._raw(np.array([0])), "v": np.array([[3, 5]], "<i2").tobytes()}
    ask["ask"] = negatives.Queries.written(np.array([0]), negatives.LOWEST, np.iinfo(np.int64).max, negatives.LOWEST, 0, 0)
    opened = []
    whole = negatives.Tree._leaf
    monkeypatch.setattr(negatives.Tree, "_leaf", lambda self, *a: opened.append(a[2]) or whole(self, *a))
    _, place, score = tree.search(negatives.Queries(ask), True, 5)
    want = np.sort(v @ np.array([3, 5]))[::-1][:5]
    assert list(score) == list(want) and len(opened) < len(leaves) / 4


def test_negative_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(9, 120, 4) + [
        (None, [1.0] * 4, 1), (200, None, 1), (250, [1.0, None, 0.0, 0.0], 1), (300, [nan] * 4, 1), (350, [inf, 0.0, 0.0, 0.0], 2), (400, [], 0),
        (450, [1.0] * 4, None), (50, [0.1, 0.2], 0), (501, [0.3, 0.4], 0), (502, [0.1, 0.1], 1), (100, [0.0] * 4, 2), (551, [3e4, -3e4, 3e4, 1.0], 1),
    ]
    rows = [r for r in rows if r[0] not in (50, 100) or len(r[1]) != 4 or r[0] == 100]
    rows = [r for i, r in enumerate(rows) if r[0] is None or r[0] not in [x[0] for x in rows[:i]]]
    df = spark.createDataFrame(rows + rows[:40], "vec_id bigint, embedding array<double>, label int")
    got = negative_rows(negatives.hard_negatives(clashing(df), F.col("vec_id") % 50 == 0, F.expr(LABEL)))
    assert got == plain.hard_negatives(rows) and got
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 50 == 0, F.expr(LABEL)).collect() == []
    big = [(0, [2.0**30, 1.0], 2), (1, [2.0**14, 1.0], 2), (2, [2.0**13, 5.0], 3)]  # scores beyond the whole numbers of a double
    exact = spark.createDataFrame(big, "vec_id bigint, embedding array<double>, label int")
    got = negative_rows(negatives.hard_negatives(exact, F.col("vec_id") == 0, F.col("label")))
    assert got == [(0, 1, 1, 2, 2**60 + 2**16, 2**59 + 5 * 2**16)]


def test_a_filter_travels_compressed():
    flags = np.zeros(1 << 21, np.uint8)
    flags[::5000] = 7
    sent = pickle.dumps(HashFilter(flags.tobytes()))
    back = pickle.loads(sent)
    assert len(sent) < 1 << 16 and back.flags == flags.tobytes() and back.log2 == 24
