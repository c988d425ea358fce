"""License scan: phrases, and an exact containment join of text blocks with notice templates.

Words are the runs of ``[0-9a-z]`` and non-ASCII characters of the text with
A-Z lower-cased. A text is cut into blocks of 128 words that start every 64
words, so that any 64 consecutive words lie in one block. A block meets a
template when it holds at least ``threshold`` of the template's distinct words,
or all of them where the template has fewer than ``whole_below``.

The join is exact and filtered: template words are ordered by how many texts
of the whole corpus hold them, rarest first. With o words needed out of t, a
block that meets the template holds one of the first t - o + 1 (the prefix);
it has at least o distinct words (length); and a first shared word at position
j leaves at most t - j shared words (position). Only pairs that pass are
compared. Templates are a parameter of the job, so what is broadcast is as
large as that parameter and does not grow with the data.

All of it is DataFrame expressions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnwatch.llm.tables import prepare, text_rows

BLOCK_WORDS = 128
STRIDE = 64
THRESHOLD = 0.8

# Phrases of the base scan and their labels.
PHRASES: tuple[tuple[str, str], ...] = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Notices as their licenses state them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("mit", "Released under the MIT License."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("reserved", "All rights reserved."),
)

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def padded_words(text: Column) -> Column:
    """Every word between single blanks of its own: ' a  b '; '' without words."""
    spaced = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS, "  ")
    inner = F.trim(spaced)
    return F.when(inner == "", "").otherwise(F.concat(F.lit(" "), inner, F.lit(" ")))


def words_of(padded: Column) -> Column:
    return F.when(padded == "", F.array().cast("array<string>")).otherwise(F.split(F.trim(padded), "  "))


def _template_words(text: str) -> list[str]:
    out = "".join(c if c.isalnum() else " " for c in text.lower())
    return list(dict.fromkeys(out.split()))


def _phrase_columns(padded: Column) -> dict[str, Column]:
    """n_base, first_word, last_word, base_labels from the padded words."""
    total, firsts, lasts, labels = F.lit(0).cast("bigint"), [], [], []
    words_before = lambda s: F.length(F.regexp_replace(s, "[^ ]", "")).cast("bigint")
    for phrase, label in PHRASES:
        form = " " + phrase.replace(" ", "  ") + " "
        has = F.contains(padded, F.lit(form))
        count = (F.length(padded) - F.length(F.replace(padded, F.lit(form), F.lit("")))) / len(form)
        total = total + F.when(has, count.cast("bigint")).otherwise(0)
        # Two blanks stand for each word before the place.
        ahead = F.substring_index(padded, form, 1)
        upto = F.substring_index(padded, form, -1)
        whole = words_before(padded) / 2
        firsts.append(F.when(has, (words_before(ahead) / 2).cast("bigint")))
        lasts.append(F.when(has, (whole - words_before(upto) / 2 - len(phrase.split())).cast("bigint")))
        labels.append(F.when(has, F.lit(label)))
    return {
        "n_base": total,
        "first_word": F.array_min(F.array(*firsts)),
        "last_word": F.array_max(F.array(*lasts)),
        "base_labels": F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))),
    }


def blocks_of(words: Column, block: int = BLOCK_WORDS, stride: int = STRIDE) -> Column:
    """Distinct words of the blocks that start every ``stride`` words; a last block that adds none is left out."""
    last = F.greatest(F.lit(0), F.ceil((F.size(words) - (block - stride)) / stride) - 1).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.array_distinct(F.slice(words, k * stride + 1, block)))


def template_table(
    templates: Sequence[tuple[str, str]], frequency: dict[str, int], threshold: float, whole_below: int = 0
) -> list[tuple]:
    """(template, label, words in global order with the rarest first, words needed) for each template."""
    out = []
    for number, (label, text) in enumerate(templates):
        words = sorted(_template_words(text), key=lambda w: (frequency.get(w, 0), w))
        need = len(words) if len(words) < whole_below else math.ceil(threshold * len(words) - 1e-9)
        out.append((number, label, words, need))
    return out


def scan(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
    whole_below: int = 0,
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches for every row.

    ``matches`` lists the blocks found: template, label, first word of the
    block and containment. The score is 1 where a phrase stands, else the best
    containment found, else 0. Null and empty texts have no words and no
    labels; repeated rows give repeated rows; an empty table gives none. At
    ``threshold`` alone a short notice also meets those that differ from it by
    a word (CC BY-NC and CC BY-SA); ``whole_below=10`` tells them apart.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = text_rows(docs, id_col, text_col).select("doc_id", padded_words(F.col("text")).alias("padded"))
    vocabulary = F.array(*[F.lit(w) for w in sorted({w for _, t in templates for w in _template_words(t)})])
    # Texts that hold each template word: a table as small as the templates' vocabulary.
    held = rows.select(F.explode(F.array_intersect(words_of(F.col("padded")), vocabulary)).alias("word"))
    frequency = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = template_table(templates, frequency, threshold, whole_below)
    least = min(need for *_, need in table)
    entries = [
        (w, j + 1, number, label, words, need)
        for number, label, words, need in table
        for j, w in enumerate(words[: len(words) - need + 1])
    ]
    prefixes = spark.createDataFrame(
        entries, "hit string, position int, template int, label string, template_words array<string>, need int"
    )
    prefix_words = F.array(*[F.lit(w) for w in sorted({e[0] for e in entries})])

    numbered = F.transform(
        blocks_of(F.col("words")),
        lambda b, k: F.struct((k * STRIDE).cast("bigint").alias("word"), b.alias("b"), F.array_intersect(b, prefix_words).alias("hits")),
    )
    texts = (
        rows.withColumn("words", words_of(F.col("padded")))
        .select(
            "doc_id",
            F.monotonically_increasing_id().alias("row"),
            F.size("words").cast("bigint").alias("n_words"),
            *[c.alias(name) for name, c in _phrase_columns(F.col("padded")).items()],
            F.filter(numbered, lambda s: (F.size(s["b"]) >= least) & (F.size(s["hits"]) > 0)).alias("blocks"),
        )
    )
    kept = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    pairs = (
        texts.select("row", *kept, F.explode_outer("blocks").alias("block"))
        .select("row", *kept, "block.word", "block.b", F.explode_outer("block.hits").alias("hit"))
        .join(F.broadcast(prefixes), "hit", "left")
    )
    # A pair is judged once, at its first shared word, and only where enough words can follow.
    first = F.array_position(F.transform("template_words", lambda w: F.array_contains("b", w)), True)
    size = F.size("template_words")
    possible = (F.size("b") >= F.col("need")) & (size - F.col("position") + 1 >= F.col("need")) & (first == F.col("position"))
    shared = F.when(possible, F.size(F.array_intersect("template_words", "b")))
    match = F.when(
        shared >= F.col("need"),
        F.struct("word", "template", "label", (shared / size.cast("double")).alias("containment")),
    )
    out = (
        pairs.select("row", *kept, match.alias("match"))
        .groupBy("row")
        .agg(*[F.first(c).alias(c) for c in kept], F.array_sort(F.collect_list("match")).alias("matches"))
    )
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0))
    )
    labels = F.array_sort(F.array_union("base_labels", F.transform("matches", lambda m: m["label"])))
    return out.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        score.alias("score"),
        "matches",
    )
