"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from txnwatch.llm import licenses, quality

_LOWER = f"translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}')"

#: crc32 bit by bit would need eight steps a byte; this table has a step per byte.
_CRC = """
crc_table AS (
    SELECT list(c ORDER BY i) AS t FROM (
        SELECT i, list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS c
        FROM (SELECT unnest(range(256)) AS i))
)"""

OP10 = f"""
WITH {_CRC},
sized AS (
    SELECT doc_id, coalesce(strlen(text), 0) + 16 AS size, coalesce(hex(encode(text)), '') AS h FROM documents
),
summed AS (
    SELECT doc_id, size,
        xor(list_reduce(
            list_transform(range(1, length(h), 2), lambda k: ('0x' || substr(h, k, 2))::BIGINT),
            lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32
    FROM sized, crc_table
),
placed AS (
    SELECT *, row_number() OVER w AS nth, sum(size) OVER w AS upto, sum(size) OVER () AS total
    FROM summed WINDOW w AS (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING)
),
cut AS (SELECT *, ((2 * upto - size) * 40 // (2 * total))::INT AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, nth - min(nth) OVER (PARTITION BY shard) AS slot,
    NULL::INT AS grown_shard
FROM cut
"""

_BASE_MASK = sum(quality.bit(r) for r in quality.BASE_RULES)
_BITS = " + ".join(f"CASE WHEN {sql} THEN {quality.bit(rule)} ELSE 0 END" for rule, sql in quality.RULES.items())
_LINE = r"[^\x20\x09-\x0D]"

OP3 = rf"""
WITH texts AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
places AS (SELECT r, len(w) AS n, w, unnest(range(1, len(w) - 6)) AS i FROM texts WHERE len(w) >= 8),
windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i:i + 7]) AS c FROM places),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM windows WHERE c > 1) GROUP BY r),
lines AS (
    SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS d
    FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM texts)
    WHERE regexp_matches(line, '{_LINE}') GROUP BY r
),
measured AS (
    SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS n_digits,
        coalesce(lines.n, 0) AS n_lines, coalesce(lines.d, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
    FROM texts LEFT JOIN lines USING (r) LEFT JOIN covered USING (r)
),
judged AS (SELECT *, ({_BITS})::BIGINT AS bits FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    bits & {_BASE_MASK} <> 0 AS base_failed, bits & {quality.mask("default-1")} = 0 AS kept, bits
FROM judged
"""


def _op4() -> str:
    phrases = " UNION ALL ".join(
        f"SELECT r, i - 1 AS i, '{label}' AS label FROM places WHERE "
        + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split()))
        for phrase, label in licenses.PHRASES
    )
    templates = ", ".join(f"('{label}', {licenses._template_words(text)!r})" for label, text in licenses.TEMPLATES)
    return rf"""
WITH texts AS (
    SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
),
places AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM texts),
phrases AS ({phrases}),
base AS (
    SELECT r, count(*) AS n, min(i) AS first_word, max(i) AS last_word, list_sort(list_distinct(list(label))) AS labels
    FROM phrases GROUP BY r
),
blocks AS (
    SELECT r, list_distinct(w[k + 1:k + 128]) AS b
    FROM (SELECT r, w, unnest(range(0, greatest(1, len(w)), 64)) AS k FROM texts)
),
templates(label, t) AS (VALUES {templates}),
matches AS (
    SELECT r, label, len(list_intersect(t, b)) / len(t) AS c FROM blocks, templates
    WHERE len(list_intersect(t, b)) >= CASE WHEN len(t) < 10 THEN len(t) ELSE 0.8 * len(t) - 1e-9 END
),
own AS (SELECT r, max(c) AS c, list(label) AS labels FROM matches GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(base.n, 0) AS n_base, base.first_word, base.last_word,
    coalesce(array_to_string(base.labels, ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ','), '') AS labels,
    CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(own.c, 0.0)::DOUBLE END AS score
FROM texts LEFT JOIN base USING (r) LEFT JOIN own USING (r)
"""


# Thresholds are written out here, not taken from the operator.
OP12 = r"""
WITH pieces AS (
    SELECT row_number() OVER () AS p, lang, piece FROM (
        SELECT coalesce(lang, 'und') AS lang,
            unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)
),
worded AS (SELECT p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
    SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM (
        SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM worded, (SELECT unnest([1, 2, 3, 4, 5]) AS size))
),
counted AS (SELECT lang, size, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM worded GROUP BY lang),
candidates AS (SELECT * FROM counted WHERE size >= 2 AND f >= 100),
kept AS (
    SELECT * FROM candidates c WHERE NOT EXISTS (
        SELECT 1 FROM candidates d WHERE d.lang = c.lang AND d.size > c.size AND 100 * d.f >= 100 * c.f
            AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' '))
),
cuts AS (
    SELECT lang, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[:k], ' ') AS one, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS other
    FROM (SELECT *, unnest(range(1, size)) AS k FROM kept)
),
scored AS (
    SELECT cuts.*, x.f AS l, y.f AS r, n, 1000 * a * n // (x.f * y.f) AS score
    FROM cuts JOIN totals USING (lang)
    JOIN counted x ON x.lang = cuts.lang AND x.phrase = cuts.one JOIN counted y ON y.lang = cuts.lang AND y.phrase = cuts.other
),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM lowest)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""

OP11 = """
WITH whole AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
vectors AS (SELECT DISTINCT * FROM whole),
scores AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE a.vec_id % 50 = 0
),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INT AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.alike
    AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 3
"""


SQL: dict[str, str] = {
    "op3_quality_ledger": OP3,
    "op4_license_join": _op4(),
    "op10_byte_shards": OP10,
    "op11_hard_negatives": OP11,
    "op12_phrases": OP12,
}
