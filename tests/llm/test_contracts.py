"""Each query against its SQL or a plain version, over the whole small table."""

import collections

import numpy as np
import plain
import pytest
from oracle_check import duck, table_hash

import corpus_pipeline
from txnwatch.llm import decontaminate, pieces, tokens
from txnwatch.llm.queries import ORACLE, QUERIES

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()
    return {r["doc_id"]: r for r in rows}


def run(spark, name):
    return {r["doc_id"]: r for r in QUERIES[name](spark, SF_SMALL).collect()}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    ours = table_hash(df.columns, [tuple(r) for r in df.collect()])
    rel = duck(SF_SMALL).execute(ORACLE[name])
    assert ours == table_hash([d[0] for d in rel.description], rel.fetchall())


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))


def test_pieces_match_the_library_and_come_back(spark, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    got = run(spark, "op1_sentencepiece")
    assert set(got) == set(texts)
    for k, r in got.items():
        assert r["ids"] == library.encode(texts[k]["text"]) and r["n_ids"] == len(r["ids"]) and r["round_trip"]


def test_personal_data(spark, texts):
    import hashlib

    for k, r in run(spark, "op2_weak_pii").items():
        spans = plain.pii_spans(texts[k]["text"])
        assert r["base_sha256"] == hashlib.sha256(plain.written(spans).encode()).hexdigest()
        for kind in plain.PII:
            assert r[f"n_{kind}"] == sum(s[0] == kind for s in spans)
        found = [x for x in r["spans"].split(",") if x]
        assert set(plain.written(spans).split(",")) - {""} <= set(found)
        order = ["email", "ip", "card", "phone", "secret"]
        keys = [(order.index(a), int(b)) for a, b, _ in (x.split(":") for x in found)]
        assert keys == sorted(keys)


def test_quality(spark, texts):
    for k, r in run(spark, "op3_quality_ledger").items():
        for name, value in plain.quality(texts[k]["text"]).items():
            assert r[name] == value, (k, name)
        assert not (r["kept"] and r["base_failed"])


def test_repeated_bytes(spark, texts):
    got = run(spark, "op5_repeated_bytes")
    keys = sorted(texts)
    for k, want in zip(keys, plain.repeated_bytes([texts[k]["text"] for k in keys]), strict=True):
        r = got[k]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want
    assert any(r["n_removed"] for r in got.values())


def test_near_duplicates(spark, texts):
    got = run(spark, "op6_chosen_path")
    want = plain.near_components([(k, r["text"]) for k, r in texts.items()])
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in got.items()} == want
    assert all(r["kept"] == (k == r["component_id"]) for k, r in got.items())


def test_token_counts(spark, texts):
    rows = QUERIES["op7_token_counts"](spark, SF_SMALL).collect()
    ranks, pattern = tokens.default_ranks()
    encode = tokens._encoding(ranks, pattern).encode_ordinary
    want = collections.Counter(len(encode(r["text"])) for r in texts.values())
    assert collections.Counter(r["n_tokens"] for r in rows) == want
    assert all(r["ended"] for r in rows)


def test_languages_held_out(spark, texts):
    got = run(spark, "op8_ecoc_language")
    held = [k for k in texts if plain.crc(str(k)) % 3 == 1]
    assert {k for k, r in got.items() if r["held_out"]} == set(held)
    right = [got[k]["lang_pred"] == texts[k]["lang"] for k in held]
    assert np.mean(right) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_languages_by_plain_counts_codes_and_decoding(spark, texts):
    got = run(spark, "op8_ecoc_language")
    learned = [(r["lang"], r["text"]) for k, r in texts.items() if plain.crc(str(k)) % 3 != 1 and r["lang"] is not None and r["text"]]
    model = plain.language_model(learned)
    for k, r in texts.items():
        lang, score = plain.language(r["text"], model)
        assert got[k]["lang_pred"] == lang, k
        assert abs(got[k]["score"] - score) < 1e-6, k


def test_benchmark_overlaps(spark, texts):
    got = run(spark, "op9_spaced_seeds")
    import re

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(plain.LOWER))

    items = [words(r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    for k, r in got.items():
        w = words(texts[k]["text"])
        runs = {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
        shared = any(tuple(x[i : i + 8]) in runs for x in items for i in range(len(x) - 7))
        whole = " " + " ".join(w) + " "
        if any(" " + " ".join(x) + " " in whole for x in items):
            assert r["contaminated"], k
        if not shared:
            assert not r["contaminated"], k
    assert any(r["contaminated"] for r in got.values())
    assert decontaminate.SPAN == len(decontaminate.MASKS[0])


def test_pipeline_stages(spark, texts, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
        if name != "sentence_pieces":
            assert docs.columns == list(corpus_pipeline.DOCUMENT_COLUMNS)
    rows = {name: {r["doc_id"]: r for r in df.collect()} for name, df in seen.items()}
    first = rows["language"]
    assert set(texts) - set(first) == set()
    want = plain.near_components([(k, r["text"]) for k, r in first.items()])
    assert set(rows["near_duplicates"]) == {k for k, (_, low) in want.items() if k == low}
    assert set(rows["decontamination"]) <= set(rows["near_duplicates"])
    assert set(rows["personal_data"]) == set(rows["decontamination"]) == set(rows["sentence_pieces"])
    for k, r in rows["personal_data"].items():
        spans = plain.pii_spans(rows["decontamination"][k]["text"])
        assert not plain.pii_spans(r["text"]) and r["n_chars"] == len(r["text"])
        if not spans and "<SECRET>" not in r["text"] and "<PHONE>" not in r["text"]:
            assert r["text"] == rows["decontamination"][k]["text"]
    assert all(r["round_trip"] for r in rows["sentence_pieces"].values())
