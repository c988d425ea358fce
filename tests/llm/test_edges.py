"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns; hard cases against plain versions."""

import collections
import hashlib
import random

import numpy as np
import plain
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from txnwatch.llm import decontaminate, graphs, langid, licenses, neardup, pieces, pii, quality, repeats, shards, textvec, tokens

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHES = "shard kept label row start txt cls size part score lang_pred bits words hit held_out text_hash ids item word blob found".split()


def table(spark, rows, clash=False):
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    return df.selectExpr("*", *[f"'x' AS `{c}`" for c in CLASHES]) if clash else df


LONG = " ".join(f"word{i % 977} other{i % 13}\n" * (i % 3 == 0) + f"w{i}" for i in range(60_000))
EDGES = [
    (1, ""),
    (None, "an id that is null has a text of eight words"),
    (2, None),
    (3, LONG),
    (3, LONG),
    (4, "x" * 300_000),
    (5, " \t\n "),
    (6, "one two"),
    (6, "one two"),
    (6, "three four five six seven"),
    (7, "Ünï çødé 😀 日本語 \x00 zero", None),
    (8, "1.2.3.4 " * 3000),
]


def operators(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l m n"), (2, None), (3, ""), (4, "three four five six"), (None, "x y")], "item_id int, text string")
    model = langid.Model([], np.ones((0, 1)), np.zeros((1 << langid.TABLE_BITS, 1)), np.zeros(1), np.ones(1), np.ones(1))
    raw = pieces.load(spark)
    return {
        "pieces": lambda d: pieces.encode(d, raw),
        "pii": lambda d: pii.digest(pii.detect(d)),
        "quality": lambda d: quality.judge(quality.ledger(d)),
        "licenses": lambda d: licenses.scan(d),
        "repeats": lambda d: repeats.remove_repeats(d),
        "neardup": lambda d: neardup.near_duplicates(d),
        "langid": lambda d: langid.predict(d, model),
        "decontaminate": lambda d: decontaminate.report(d, bench),
        "shards": lambda d: shards.shard_by_bytes(d, 4),
    }


NAMES = ["pieces", "pii", "quality", "licenses", "repeats", "neardup", "langid", "decontaminate", "shards"]


@pytest.mark.parametrize("name", NAMES)
def test_edges_and_empty_tables(spark, name):
    op = operators(spark)[name]
    rows = op(table(spark, EDGES, clash=True)).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(e[0]) for e in EDGES)
    same = [tuple(x for c, x in r.asDict().items() if c not in ("slot", "shard")) for r in rows if r["doc_id"] == 3]
    assert same[0] == same[1]
    assert op(table(spark, [])).collect() == []


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_edges_and_empty_tables(spark, stage):
    name, fn = corpus_pipeline.STAGES[stage]
    out = fn(spark, table(spark, EDGES, clash=True), "/root/testdata/sf0.001")
    kept = [r["doc_id"] for r in out.collect()]
    if name != "sentence_pieces":
        assert out.columns == list(corpus_pipeline.DOCUMENT_COLUMNS)
    if name in ("decontamination", "personal_data", "sentence_pieces"):
        assert len(kept) == len(EDGES)
    if name == "near_duplicates":
        assert kept.count(3) == 1 and kept.count(6) == 2 and None in kept
    if name == "language":
        assert not {1, 2, 5, 8} & set(kept)
    assert fn(spark, table(spark, []), "/root/testdata/sf0.001").collect() == []


def test_token_files_of_edges(spark, tmp_path):
    ranks, pattern = tokens.default_ranks()
    path = str(tmp_path / "t")
    rows = [e for e in EDGES if e[0] != 4]
    tokens.write_token_files(table(spark, rows, clash=True).coalesce(2), path, ranks, pattern)
    encode = tokens._encoding(ranks, pattern).encode_ordinary
    want = sorted(len(encode(e[1] or "")) for e in rows)
    for block in (1, 7, 1000, 1 << 20)[1:]:
        got = tokens.count_tokens(spark, path, block=block).collect()
        assert sorted(r["n_tokens"] for r in got) == want and all(r["ended"] for r in got)


def test_scan_of_flat_files(spark, tmp_path):
    rng = random.Random(5)
    want = []
    for n in range(4):
        stream = [rng.choice([9, 0, 1, 2, 50256, 0x50C4 - 1]) for _ in range(rng.randint(0, 400))]
        (tmp_path / f"part-{n}.bin").write_bytes(np.array(stream, "<u2").tobytes())
        start = 0
        for at, t in enumerate([*stream, None]):
            if t == 50256 or (t is None and at > start):
                want.append((n, start, at - start, t is not None))
                start = at + 1
    for block in (1, 3, 64, 1000):
        got = tokens.count_tokens(spark, str(tmp_path), block=block).withColumn("n", F.regexp_extract("file", r"part-(\d+)", 1).cast("int"))
        rows = got.collect()
        assert sorted((r["n"], r["first_token"], r["n_tokens"], r["ended"]) for r in rows) == sorted(want)
        for n in range(4):
            assert sorted(r["doc_no"] for r in rows if r["n"] == n) == list(range(sum(w[0] == n for w in want)))


@pytest.mark.parametrize("filtered", [repeats.FILTERED, -1])
def test_repeated_bytes_of_hard_texts(spark, monkeypatch, filtered):
    monkeypatch.setattr(repeats, "FILTERED", filtered)
    rng = random.Random(7)
    passage = "".join(rng.choice("abcdef ") for _ in range(900))
    texts = []
    for k in range(40):
        a, b = sorted(rng.sample(range(901), 2))
        noise = lambda: "".join(rng.choice("uvwxyzé ") for _ in range(rng.randint(0, 300)))
        middle = passage[a:b]
        if k % 3 == 0 and middle:
            at = rng.randrange(len(middle))
            middle = middle[:at] + "#" + middle[at + 1 :]
        texts.append(noise() + middle + noise())
    texts += ["ab" * 350, "ab" * 198 + "a" * 500, "a" * 399, "a" * 400, "a" * 401, passage, passage, passage[:400], "", None, "a" * 401]
    texts += [passage[:500] + "zz" + passage[100:600], passage * 2]
    got = {r["doc_id"]: r for r in repeats.remove_repeats(table(spark, list(enumerate(texts)))).collect()}
    for k, want in enumerate(plain.repeated_bytes(texts)):
        r = got[k]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want, k


def test_planted_passages_go_and_clean_texts_stay(spark):
    rng = random.Random(11)
    prose = lambda n: " ".join(f"{rng.choice('bdklmnrst')}{rng.randrange(10**5)}" for _ in range(n))
    texts, planted, short = [], set(), set()
    for _ in range(40):
        passage = prose(rng.randint(51, 90))
        (planted if len(passage) >= 400 else short).update((len(texts), len(texts) + 1))
        texts += [f"{prose(rng.randint(1, 60))} {passage} {prose(rng.randint(1, 60))}" for _ in range(2)]
    clean = set(range(len(texts), len(texts) + 60))
    texts += [prose(rng.randint(1, 150)) for _ in clean]
    copies = set(range(len(texts), len(texts) + 120))
    texts += [prose(80)] * len(copies)
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    out = repeats.remove_repeats(table(spark, rows).repartition(23))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out.collect()}
    assert got == dict(enumerate(plain.repeated_bytes(texts)))
    lost = {k for k, r in got.items() if r[1]}
    assert len(planted) > 20 and planted <= lost and copies <= lost and not clean & lost
    # Over 50 words, but below 400 bytes: stays, unless what stands around it happens to be equal too.
    assert short and not short & lost


def test_first_copies_stay(spark):
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdef ") for _ in range(700))
    texts = [passage[:600] + "X" * 50, "Y" * 50 + passage, "Z" * 9 + passage[50:650], passage]
    run = repeats.Repeats(table(spark, list(enumerate(texts))))
    first = {(r["txt"], s) for r in run.starts(keep_first=True).collect() for s in range(r["first"], r["last"] + 1)}
    keys = {r["text"]: r["txt"] for r in run.texts.collect()}
    seen, want = set(), set()
    for key, t in sorted((keys[t], t) for t in texts):
        for s in range(len(t) - 399):
            if t[s : s + 400] in seen:
                want.add((key, s))
            seen.add(t[s : s + 400])
    assert first == want


@pytest.mark.parametrize("small, large, block", [(neardup.SMALL, neardup.LARGE, neardup.BLOCK), (2, 1 << 14, 7), (2, 16, 5)])
def test_near_duplicates_of_hard_texts(spark, monkeypatch, small, large, block):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "LARGE", large)
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(9)
    rows = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(rng.choice([5, 8, 20, 60, 200]))]
        for _ in range(rng.choice([2, 5, 90])):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(50)}"
            rows.append((len(rows), " ".join(w)))
    boiler = " ".join(f"boiler{i}" for i in range(30))
    rows += [(len(rows) + i, boiler + f" tail{i} more{i} and{i} so{i} on{i} a{i} b{i} c{i} d{i} e{i}") for i in range(150)]
    rng.shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(table(spark, rows)).collect()}
    want = plain.near_components(rows)
    if large > 1000:
        assert got == want
    else:  # branching may lose a link, but never makes one
        parts = {}
        for k, (_, low) in got.items():
            parts.setdefault(low, set()).add(want[k][1])
        assert all(len(p) == 1 for p in parts.values())


@pytest.mark.parametrize("large", [neardup.LARGE, 16])
def test_near_duplicates_in_branched_nodes(spark, monkeypatch, large):
    # Pairs at the threshold among texts that share 70 % of their shingles: all nodes of a pair branch to the last level.
    monkeypatch.setattr(neardup, "LARGE", large)
    rng = random.Random(33)
    rows, shared = [], " ".join(f"same{i}" for i in range(200))
    for k in range(150):
        own = [f"k{k}w{i}" for i in range(42)]
        rows.append((len(rows), f"{shared} {' '.join(own)}"))
        rows.append((len(rows), f"{shared} {' '.join(own[:8])} " + " ".join(f"k{k}x{i}" for i in range(34))))
    rng.shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(table(spark, rows)).collect()}
    want = plain.near_components(rows)
    assert got == want and len({c for _, c in want.values()}) == 150


def test_personal_data_of_hard_texts(spark):
    rng = random.Random(10)
    parts = ["@", ".", "a", "b1", "-", "+", "1", "22", "255", "256", "4111 1111 1111 1111", "(", ")", " ", "x@y.z", "1.2.3.4", "é", "_", "%", "\n", "+1 (555) 123-4567"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    texts += ["a" * 50_000, "1" * 50_000, "a@b" + ".c" * 30_000, "1.2.3.4.5.6.7.8", "a@b.c_d@e.f", "+1" + " " * 50_000, None, "😀 a@b.co 😀"]
    got = {r["doc_id"]: r for r in pii.digest(pii.detect(table(spark, list(enumerate(texts))))).collect()}
    for k, t in enumerate(texts):
        spans = plain.pii_spans(t)
        assert got[k]["base_sha256"] == hashlib.sha256(plain.written(spans).encode()).hexdigest(), (k, t[:80])


def test_secrets_are_found_and_words_are_not(spark):
    rng = random.Random(11)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows = [(k, f'some text with token = "{key()}" inside') for k in range(30)]
    rows += [(100 + k, f"plain words only number {k} of a clean text from year 1999") for k in range(60)]
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.detect(table(spark, rows))).collect()}
    assert all("secret" in got[k] for k in range(30))
    assert all(got[100 + k] == "" for k in range(60))


def test_expectation_maximisation_tells_good_labelers():
    rng = random.Random(12)
    counts = {}
    for _ in range(20_000):
        y = rng.random() < 0.3
        votes = tuple((1 if (rng.random() < p) == y else -1) for p in (0.95, 0.9, 0.6))
        counts[votes] = counts.get(votes, 0) + 1
    post, reliability, share = pii.expectation_maximisation(sorted(counts.items()))
    assert abs(share - 0.3) < 0.03
    assert abs(reliability[0][1][2] - 0.95) < 0.03 and abs(reliability[2][1][2] - 0.6) < 0.05
    assert post[(1, 1, 1)] > 0.9 > 0.1 > post[(-1, -1, -1)]


def test_ablation_counts(spark):
    rows = [(1, "short"), (2, "w " * 5), (3, " ".join(f"word{i}" for i in range(50))), (4, "# " * 40), (5, " ".join(f"#{i}" for i in range(30)))]
    led = quality.ledger(table(spark, rows))
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(led).collect()}
    assert kept == {1: False, 2: False, 3: True, 4: False, 5: False}
    got = {r["rule"]: r for r in quality.ablation(led).collect()}
    bits = {r["doc_id"]: r["bits"] for r in led.collect()}
    for rule in quality.POLICIES["default-1"]:
        b = quality.bit(rule)
        assert got[rule]["failed"] == sum(v & b != 0 for v in bits.values())
        assert got[rule]["failed_alone"] == sum(v == b for v in bits.values())
        assert got[rule]["kept_without"] == sum(v & ~b == 0 for v in bits.values())


def test_license_places(spark):
    rows = [
        (1, "MIT License, then the mit license. CC BY; Apache\nLicense"),
        (2, "cc by cc by"),
        (3, "this program is free software you can redistribute it and or modify it under the terms"),
        (4, "rights"),
        (5, "x " * 200 + "All rights reserved. " + "y " * 200),
    ]
    got = {r["doc_id"]: r for r in licenses.scan(table(spark, rows)).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (4, 0, 8, "apache,cc-by,mit")
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["last_word"]) == (2, 0, 2)
    assert got[4]["labels"] == "" and got[4]["score"] == 0 and got[4]["first_word"] is None
    assert got[5]["labels"] == "reserved" and got[5]["score"] == 1.0 and got[5]["n_words"] == 403


def test_neighbouring_short_notices_are_told_apart(spark):
    rows = [
        (1, "Licensed under CC BY-NC 4.0"),
        (2, "Licensed under CC BY-SA 4.0."),
        (3, "Licensed under CC BY 4.0"),
        (4, "released under the Apache License"),
        (5, "Released under the MIT License."),
        (6, "this program is free software you can redistribute it and or modify it under the terms of the gnu general license as published"),
    ]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(table(spark, rows), whole_below=10).collect()}
    assert got == {1: "cc-by,cc-by-nc", 2: "cc-by,cc-by-sa", 3: "cc-by", 4: "apache", 5: "mit", 6: "gpl"}
    at_threshold = {r["doc_id"]: r["labels"] for r in licenses.scan(table(spark, rows)).collect()}
    assert at_threshold[1] == "cc-by,cc-by-nc,cc-by-sa" and at_threshold[4] == "apache,mit"


@pytest.mark.parametrize("seeds", [decontaminate.BROADCAST_SEEDS, 0])
def test_substituted_benchmark_words_are_found(spark, monkeypatch, seeds):
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", seeds)
    rng = random.Random(13)
    items = [[f"i{k}w{j}" for j in range(40)] for k in range(6)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(9, "only five words right here")], "item_id int, text string")
    rows = []
    for k, w in enumerate(items):
        changed = [x if j % 9 else "zzz" for j, x in enumerate(w)]
        rows.append((k, " ".join([f"p{rng.random()}" for _ in range(300)] + changed + ["q"] * 200)))
    rows += [(50, " ".join(items[0][:8])), (51, "Only FIVE words, right here!"), (52, "five words right here"), (53, " ".join(items[0][::2]))]
    got = {r["doc_id"]: r["contaminated"] for r in decontaminate.report(table(spark, rows), bench).collect()}
    assert got == {**dict.fromkeys(range(6), True), 50: False, 51: True, 52: False, 53: False}


def _seedless(masks, free):
    """By length, (last words, equal words) of every pattern of equal (1) and other words that no mask hits; unless
    ``free``, only of those that can begin a best stretch."""
    masks, span = [int(m, 2) for m in masks], max(len(m) for m in masks)
    states = {(0, 0)}
    for n in range(1, 65):
        grown = {((b << 1 | x) & (1 << span) - 1, e + x) for b, e in states for x in (0, 1)}
        states = {(b, e) for b, e in grown if (free or e >= 2 * (n - e)) and not any(b & m == m for m in masks)}
        yield n, states


def test_every_accepted_overlap_has_a_seed():
    enough = lambda n: min(decontaminate.EQUAL_WORDS, decontaminate.EQUAL_SHARE * max(decontaminate.SHORT, n))
    for n, states in _seedless(decontaminate.MASKS, free=False):
        assert not [e for b, e in states if e >= enough(n) and e >= decontaminate.IDENTITY * n]
    # A longer pattern is made of ones of 32 to 63 words, and none of those has enough equal words.
    for n, states in _seedless(decontaminate.MASKS, free=True):
        assert n < 32 or max(e for _, e in states) < decontaminate.IDENTITY * n


def test_overlaps_against_all_alignments(spark):
    rng = random.Random(31)
    items, rows = [], []
    for n, changes in [(12, 1), (12, 2), (14, 3), (16, 3), (16, 4), (20, 4), (24, 5), (40, 9), (60, 15), (200, 45)] * 8:
        items.append([f"i{len(items)}w{j}" for j in range(n)])
        if len(items) % 4:
            at = rng.sample(range(n), changes)
        else:  # every fourth word is another
            at = range(len(items) // 4 % 4, n, 4)
        changed = [f"x{rng.randrange(10**12)}" if j in at else w for j, w in enumerate(items[-1])]
        noise = lambda: [f"p{rng.randrange(10**12)}" for _ in range(rng.randint(0, 90))]
        rows.append((len(rows), noise() + changed[rng.choice([0, 0, 3]) :] + noise()))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id int, text string")
    texts = {r["item"]: r["text"] for r in bench.select(F.xxhash64("text").alias("item"), "text").collect()}
    found = decontaminate.overlaps(table(spark, [(k, " ".join(w)) for k, w in rows]), bench).collect()
    got = {(r["doc_id"], texts[r["item"]]): (r["equal_words"], r["overlap_words"]) for r in found}
    want = {}
    for k, words in rows:
        item, doc, own = items[k], np.array(words), np.array(items[k])
        ends = [decontaminate.overlap(doc, own, shift) for shift in range(-len(own), len(doc))]
        ends = [(e, n) for e, n in ends if e >= min(13, 0.6 * len(item)) and e >= 0.75 * n]
        if ends:
            want[(k, " ".join(item))] = max(ends)
    assert got == want and len(want) > 50


def test_short_items_are_found_with_one_other_word(spark):
    items = {n: [f"i{n}w{j}" for j in range(n)] for n in range(1, 12)}
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()] + [(50, None)], "item_id int, text string")
    rows, want = [], {}
    for n, w in items.items():
        for gone in [(), *[(j,) for j in range(n)], (0, n - 1), (1, 2)]:
            changed = ["other" if j in gone else x for j, x in enumerate(w)]
            for before, after in (["a b c"], ["d e"]), ([], []):
                want[len(rows)] = n >= decontaminate.LEAST_WORDS and sum(x == y for x, y in zip(changed, w, strict=True)) >= n - 1
                rows.append((len(rows), " ".join(before + changed + after)))
        rows += [(len(rows), " ".join(w[1:])), (len(rows) + 1, " ".join(w[:-1]))]
        want |= {len(rows) - 2: False, len(rows) - 1: False}
    got = {r["doc_id"]: r["contaminated"] for r in decontaminate.report(table(spark, rows), bench).collect()}
    assert got == want
    assert {r["item_id"] for r in decontaminate.not_sought(bench).collect()} == {1, 2, 3, 50}


def test_best_overlap_against_all_stretches():
    rng = np.random.default_rng(14)
    for _ in range(200):
        doc, item = rng.integers(0, 3, rng.integers(1, 12)), rng.integers(0, 3, rng.integers(1, 9))
        shift = int(rng.integers(-8, 12))
        pairs = [(doc[k + shift], item[k]) for k in range(len(item)) if 0 <= k + shift < len(doc)]
        best = max((sum(1 if a == b else -2 for a, b in pairs[i:j]) for i in range(len(pairs) + 1) for j in range(i, len(pairs) + 1)), default=0)
        e, n = decontaminate.overlap(doc.astype(np.uint64), item.astype(np.uint64), shift)
        assert e - 2 * (n - e) == best


def test_shards_are_even_and_contiguous(spark):
    rng = random.Random(15)
    rows = [(rng.choice([None, k, 7]), "y" * rng.randint(0, 400)) for k in range(3000)]
    got = shards.shard_by_bytes(table(spark, rows), 10, partitions=13).collect()
    sizes = {}
    for r in got:
        sizes.setdefault(r["shard"], []).append(r)
    totals = [sum(r["size"] for r in v) for _, v in sorted(sizes.items())]
    assert len(totals) == 10 and max(totals) - min(totals) <= 2 * 416
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in sizes.values())
    order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in order]
    assert ids == sorted(ids)


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(1, 64)]
    star = [(100, 100 + i) for i in range(1, 300)]
    edges = spark.createDataFrame(chain + star, "a bigint, b bigint")
    got = dict(graphs.components(edges).collect())
    assert got == {**dict.fromkeys(range(1, 65), 1), **dict.fromkeys(range(100, 400), 100)}


def test_languages_of_odd_texts_by_a_fitted_model(spark):
    """Null, blank and letterless texts, very long ones, repeated rows and clashing columns before a real decoder."""
    taught = {"en": "the cat and the dog were in the house with", "de": "der Hund und die Katze waren in dem Haus mit", "fr": "le chien et le chat étaient dans la maison avec"}
    model = langid.fit(spark.createDataFrame([(k, v) for k, v in taught.items()] * 3, "lang string, text string"))
    assert model.languages == ["de", "en", "fr"]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "123 !? 4.5"), (5, taught["fr"] + " "), (6, taught["de"]), (6, taught["de"]), (7, (taught["en"] + " 12 ") * 20_000),
            (None, taught["en"]), (8, "日本語 😀"), (9, "x")]
    docs = spark.createDataFrame([(*r, "zz", 7.0, True, "s") for r in rows], "doc_id int, text string, lang_pred string, score double, ambiguous boolean, lang string")
    got = collections.defaultdict(set)
    out = langid.predict(docs, model)
    assert out.columns == ["doc_id", "lang_pred", "score", "ambiguous"] and out.count() == len(rows)
    for r in out.collect():
        assert 0.0 <= r["score"] <= 1.0
        got[r["doc_id"]].add((r["lang_pred"], r["score"]))
    assert all(got[k] == {("und", 0.0)} for k in (1, 2, 3, 4))
    assert [{p for p, _ in got[k]} for k in (5, 6, 7, None)] == [{"fr"}, {"de"}, {"en"}, {"en"}]
    assert len(got[6]) == 1 and {p for p, _ in got[8] | got[9]} <= {*taught}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_codewords_differ_in_many_bits():
    for n in (2, 3, 4, 6, 12, 40):
        codes = langid.codewords(n)
        gap = min((a != b).sum() for i, a in enumerate(codes) for b in codes[:i])
        assert codes.shape[0] == n and gap >= max(1, codes.shape[1] // 4)


def test_chunked_words_do_not_depend_on_the_chunk():
    texts = ["a bb  ccc\n", "", "é ü", " x", "y " * 2000]
    whole = [h for _, _, data, off in textvec.chunks(pa.array(texts)) for h in textvec.Hasher(data).spans(*(lambda w: (w.start, w.end))(textvec.Words(data, off)))]
    alone = [h for t in texts for _, _, data, off in textvec.chunks(pa.array([t])) for h in textvec.Hasher(data).spans(*(lambda w: (w.start, w.end))(textvec.Words(data, off)))]
    assert whole == alone


def test_unigram_models_take_the_lightest_path():
    def field(number, value):
        if isinstance(value, bytes):
            return bytes([number << 3 | 2]) + bytes([len(value)]) + value
        if isinstance(value, float):
            import struct

            return bytes([number << 3 | 5]) + struct.pack("<f", value)
        return bytes([number << 3, value])

    model = field(1, field(1, b"<unk>") + field(2, 0.0) + field(3, 2))
    for text, score in (("▁", -3.0), ("a", -2.0), ("b", -2.0), ("ab", -3.0), ("▁a", -3.5), ("ba", -2.5)):
        model += field(1, field(1, text.encode()) + field(2, score) + field(3, 1))
    model += field(2, field(3, 1)) + field(3, field(3, 1) + field(4, 0))
    machine = pieces.Transducer(model)
    assert [machine.texts[i] for i in machine.encode("aba")] == ["▁a", "ba"]
    assert [machine.texts[i] for i in machine.encode("ab")] == ["▁a", "b"]


def test_the_row_that_stays_does_not_depend_on_the_order_of_the_rows(spark):
    text = "the same words stand here in both of these rows"
    rows = [(1, text, "en", "s1", 5), (1, text, "de", "s2", 5), (1, text, "de", "s2", None), (2, text, "aa", "s0", 1)]
    kept = []
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, SCHEMA).coalesce(1)
        kept.append([tuple(r) for r in neardup.without_near_duplicates(df).collect()])
    assert kept[0] == kept[1] == [(1, text, "de", "s2", None)]


def test_a_similarity_that_the_trees_are_not_set_for_is_refused(spark):
    with pytest.raises(ValueError, match="75 to 100"):
        neardup.near_duplicates(table(spark, EDGES), percent=60)
