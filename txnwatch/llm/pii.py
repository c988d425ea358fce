"""Personal data by weak supervision, in DataFrame expressions only.

Base spans (email, ip, card, phone) are found by pattern and always stay.
Wider patterns propose candidates of kinds ``phone`` and ``secret``. Five
labelers look at each candidate (two at its shape, one at its variety, one at
cue words of a gazetteer near it, one at the characters around it) and vote
for, against, or abstain. Spark counts the candidates by vote pattern, which
gives a table of at most 2 * 3**5 rows whatever the corpus; expectation
maximisation on that table estimates how reliable each labeler is and how
likely each pattern is personal. The final span classifier (categorical naive
Bayes) is trained on sums of those probabilities over the features of all
candidates, again a small table, and scores every candidate.

Patterns use possessive repeats and look-behinds, so that a long run of
letters or digits is read once; they match exactly what the plain forms match.
Offsets come from the lengths of the pieces between matches.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnwatch.llm.tables import prepare, text_rows

#: Order of kinds in results; ``secret`` comes from the method alone.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]

_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS: dict[str, str] = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # Candidates of the method.
    "number": r"(?<![A-Za-z0-9])\(?[0-9][0-9().\x20-]{5,}[0-9](?![A-Za-z0-9])",
    "token": r"(?<![A-Za-z0-9])[A-Za-z0-9]{20,}+",
}
_NEEDS: dict[str, str] = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+", "number": "[0-9]", "token": "[0-9]"}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

# Cue words of the gazetteer, for and against, by kind.
CUES: dict[str, tuple[str, str]] = {
    "phone": (
        "phone|tel|telephone|call|mobile|cell|fax|contact|telefon|handy|anruf|telefono|teléfono|llamar|téléphone|portable|appel",
        "version|page|order|invoice|isbn|total|price|chapter|figure|table|section",
    ),
    "secret": (
        "token|key|secret|password|passwd|pwd|auth|bearer|credential|apikey|passwort|contraseña|clave|jeton",
        "sha|commit|checksum|digest|hash|uuid|revision|md5",
    ),
}

LABELERS = ("shape", "length", "variety", "cues", "around")
ROUNDS = 50
THRESHOLD = 0.5


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    return {
        "email": F.lit(True),
        "ip": match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
        "card": n.between(16, 19) & F.call_function("luhn_check", digits),
        "phone": n.between(8, 15),
        "number": n.between(7, 15),
        "token": match.rlike("[0-9]") & match.rlike("[A-Za-z]"),
    }[kind]


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every valid match of every pattern with its place, and a row with null kind for each text.

    Columns: row (of the input), doc_id, text_hash, kind, base, start, end
    (code points, end exclusive), match, before and after (the characters around it), free
    (no base span of the text overlaps it).
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = text_rows(docs, id_col, text_col).select("doc_id", text.alias("text"), F.monotonically_increasing_id().alias("row"))
    none = F.array().cast("array<string>")
    found = {}
    for kind, pattern in PATTERNS.items():
        has = F.col("text").rlike(_NEEDS[kind])
        found[f"m_{kind}"] = F.when(has, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none)
        found[f"s_{kind}"] = F.when(has, F.split("text", pattern, -1)).otherwise(none)

    def located(kind: str) -> Column:
        pieces = F.col(f"s_{kind}")
        return F.transform(
            F.col(f"m_{kind}"),
            lambda m, i: F.struct(
                F.lit(kind).alias("pattern"),
                i.alias("nth"),
                F.length(F.get(pieces, i)).alias("gap"),
                m.alias("match"),
                F.right(F.get(pieces, i), F.lit(32)).alias("before"),
                F.left(F.get(pieces, i + 1), F.lit(1)).alias("after"),
            ),
        )

    parts = [located(kind) for kind in PATTERNS]
    one = F.array(F.struct(
        F.lit(None).cast("string").alias("pattern"), F.lit(0).alias("nth"), F.lit(0).alias("gap"),
        F.lit("").alias("match"), F.lit("").alias("before"), F.lit("").alias("after"),
    ))
    key = ["row", "doc_id", "text_hash"]
    matches = (
        rows.withColumns(found)
        .select("row", "doc_id", F.xxhash64("text").alias("text_hash"), F.inline(F.concat(one, *parts)))
        .repartition(F.col("row"))
    )
    earlier = Window.partitionBy("row", "pattern").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("match")).over(earlier).cast("bigint")
    placed = matches.withColumn("end", end).withColumn("start", F.col("end") - F.length("match"))
    valid = F.col("pattern").isNull()
    for kind in PATTERNS:
        valid = valid | ((F.col("pattern") == kind) & _valid(kind, F.col("match")))
    kind = F.when(F.col("pattern") == "number", "phone").when(F.col("pattern") == "token", "secret").otherwise(F.col("pattern"))
    named = placed.where(valid).select(
        *key, kind.alias("kind"), F.coalesce(F.col("pattern").isin(*BASE_KINDS), F.lit(False)).alias("base"),
        "start", "end", "match", "before", "after",
    )
    order = Window.partitionBy("row").orderBy("start", F.desc("base"), "end")
    ahead = F.max(F.when(F.col("base"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.min(F.when(F.col("base"), F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    clash = F.coalesce(ahead > F.col("start"), F.lit(False)) | F.coalesce(behind < F.col("end"), F.lit(False))
    return named.withColumn("free", ~clash)


def _votes() -> dict[str, Column]:
    """Each labeler's vote: 1 for, 0 abstains, -1 against."""
    phone = F.col("kind") == "phone"
    match, near = F.col("match"), F.lower("before")
    digits = F.length(F.regexp_replace(match, "[^0-9]", ""))
    variety = F.size(F.array_distinct(F.split(F.regexp_replace(match, "[^A-Za-z0-9]", ""), "")))
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    cues = lambda side: F.when(phone, near.rlike(rf"(?<!\pL)(?:{CUES['phone'][side]})(?!\pL)")).otherwise(
        near.rlike(rf"(?<!\pL)(?:{CUES['secret'][side]})(?!\pL)")
    )
    return {
        "shape": F.when(
            phone,
            vote(match.rlike(r"^(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}$"), match.rlike("^[0-9]+$|[0-9] {2,}[0-9]")),
        ).otherwise(vote(match.rlike("^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"), match.rlike("^[A-Z]?[a-z]+[0-9]{1,4}$"))),
        "length": F.when(phone, vote(digits.between(10, 13), digits < 8)).otherwise(vote(F.length(match) >= 32, F.length(match) < 24)),
        "variety": F.when(phone, vote(variety >= 4, variety <= 2)).otherwise(vote(variety >= 10, variety <= 5)),
        "cues": vote(cues(0), cues(1)),
        "around": vote(
            F.col("before").rlike(r"(?:^|[:=\"'(]\s?|\s)$") & F.col("after").rlike(r"^(?:$|[\s\"').,;])"),
            F.col("before").rlike(r"[$#€£%/._-]$") | F.col("after").rlike(r"^[%/_€£]"),
        ),
    }


def expectation_maximisation(
    patterns: Sequence[tuple[tuple[int, ...], float]], rounds: int = ROUNDS
) -> tuple[dict[tuple[int, ...], float], list[list[list[float]]], float]:
    """Probability of the positive class for each vote pattern, each labeler's P(vote | class), and the share of positives.

    ``patterns``: (votes, count). Starts from the majority, which also keeps class 1 the positive one.
    """
    if not patterns:
        return {}, [], 0.5
    k = len(patterns[0][0])
    post = {v: 1 / (1 + math.exp(-2.0 * sum(v))) for v, _ in patterns}
    tables, share = [], 0.5
    for _ in range(rounds):
        total = sum(n for _, n in patterns)
        share = (1 + sum(post[v] * n for v, n in patterns)) / (2 + total)
        tables = []
        for j in range(k):
            sums = [[0.5, 0.5, 0.5], [0.5, 0.5, 0.5]]
            # A labeler that is right more often than wrong, as pseudo counts.
            sums[0][0] += 1
            sums[1][2] += 1
            for v, n in patterns:
                sums[1][v[j] + 1] += post[v] * n
                sums[0][v[j] + 1] += (1 - post[v]) * n
            tables.append([[x / sum(row) for x in row] for row in sums])
        for v, _ in patterns:
            odds = math.log(share / (1 - share)) + sum(math.log(t[1][x + 1] / t[0][x + 1]) for t, x in zip(tables, v, strict=True))
            post[v] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
    return post, tables, share


def _features() -> dict[str, Column]:
    """Small whole numbers from 0 on."""
    size = F.length("match")
    side = lambda c: (
        F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"[0-9]"), 2).when(c.rlike(r"\pL"), 3).when(c.rlike(r"[\"'(),.:;=]"), 4).otherwise(5)
    )
    return {
        **{name: F.col(name) + 1 for name in LABELERS},
        "size": F.least(F.lit(11), F.floor(size / 4)).cast("int"),
        "left": side(F.right("before", F.lit(1))),
        "right": side(F.col("after")),
    }


WIDTH = 12


def classify(candidates: DataFrame) -> tuple[DataFrame, dict]:
    """Candidates with ``score``, and the fitted model. Two aggregates of bounded size reach the driver."""
    voted = candidates.withColumns(_votes())
    seen = voted.groupBy("kind", *LABELERS).agg(F.count(F.lit(1)).alias("n")).collect()
    by_kind: dict[str, list] = defaultdict(list)
    for r in seen:
        by_kind[r["kind"]].append((tuple(r[x] for x in LABELERS), r["n"]))
    model: dict = {"labelers": {}, "weights": {}}
    soft = []
    for kind, patterns in sorted(by_kind.items()):
        post, tables, share = expectation_maximisation(sorted(patterns))
        model["labelers"][kind] = {"share": share, "tables": dict(zip(LABELERS, tables, strict=True))}
        soft += [(kind, *v, float(p)) for v, p in sorted(post.items())]
    if not soft:
        return voted.withColumn("score", F.lit(0.0)), model
    spark = candidates.sparkSession
    probable = spark.createDataFrame(soft, ", ".join(["kind string", *(f"{x} int" for x in LABELERS), "p double"]))
    names = list(_features())
    with_features = voted.withColumns({f"f_{k}": c for k, c in _features().items()})
    sums = (
        with_features.join(F.broadcast(probable), ["kind", *LABELERS])
        .select("kind", "p", F.posexplode(F.array(*[F.col(f"f_{k}") for k in names])).alias("feature", "value"))
        .groupBy("kind", "feature", "value")
        .agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
        .collect()
    )
    score = F.lit(0.0)
    for kind in sorted(by_kind):
        table = [[[1.0, 1.0] for _ in range(WIDTH)] for _ in names]
        for r in sums:
            if r["kind"] == kind:
                table[r["feature"]][r["value"]] = [1.0 + r["yes"], 1.0 + r["no"]]
        weights = []
        for row in table:
            yes, no = sum(a for a, _ in row), sum(b for _, b in row)
            weights.append([round(math.log(a / yes) - math.log(b / no), 9) for a, b in row])
        share = model["labelers"][kind]["share"]
        bias = round(math.log(share / (1 - share)), 9)
        model["weights"][kind] = {"bias": bias, **dict(zip(names, weights, strict=True))}
        odds = F.lit(bias)
        for k, row in zip(names, weights, strict=True):
            odds = odds + F.get(F.array(*[F.lit(x) for x in row]), F.col(f"f_{k}"))
        score = F.when(F.col("kind") == kind, 1 / (1 + F.exp(-odds))).otherwise(score)
    return with_features.withColumn("score", score).drop(*[f"f_{k}" for k in names]), model


def detect(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All accepted spans and a row with null kind for each text: row, doc_id, text_hash, kind, base, start, end, score.

    Nulls and empty texts have no spans; repeated rows each have theirs; an
    empty table gives an empty result. Spans of the method never overlap a base span.
    """
    found = spans(docs, id_col, text_col).checkpoint(eager=True)
    candidates = found.where(F.col("kind").isin("phone", "secret") & (F.col("base") | F.col("free")))
    scored, _ = classify(candidates)
    keep = ["row", "doc_id", "text_hash", "kind", "base", "start", "end"]
    sure = found.where(F.col("base") | F.col("kind").isNull()).select(*keep, F.lit(1.0).alias("score"))
    return sure.unionByName(scored.where(~F.col("base") & (F.col("score") >= threshold)).select(*keep, "score"))


def digest(accepted: DataFrame) -> DataFrame:
    """One row per input row: counts by base kind, the digest of the base spans, and all spans as text."""
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    item = F.struct(number.alias("k"), "start", "end", "base")
    grouped = accepted.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), item))).alias("all"),
        *[F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in BASE_KINDS],
    )
    names = F.array(*[F.lit(k) for k in KINDS])
    written = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"].cast("int") - 1), s["start"], s["end"])), ","
    )
    return grouped.select(
        "doc_id",
        *[f"n_{k}" for k in BASE_KINDS],
        F.sha2(written(F.filter("all", lambda s: s["base"])), 256).alias("base_sha256"),
        written(F.col("all")).alias("spans"),
    )


def redact(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``documents`` rows with every span replaced by ``<KIND>``; all rows and the other columns stay.

    Overlapping spans are merged and take the kind that starts first. n_chars follows the text.
    """
    accepted = detect(docs, threshold).where(F.col("kind").isNotNull())
    item = F.struct("start", "end", "kind")
    by_text = accepted.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(item)).alias("found"))
    # Pieces: the text between the last end and this start, then the mark; a span inside an earlier one adds nothing.
    reach = Window.partitionBy("doc_id", "text_hash").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        by_text.select("doc_id", "text_hash", F.inline("found"))
        .withColumn("from", F.coalesce(F.max("end").over(reach), F.lit(0).cast("bigint")))
        .groupBy("doc_id", "text_hash")
        .agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind", "from"))).alias("found"), F.max("end").alias("rest"))
        .withColumnRenamed("doc_id", "span_id")
    )
    hashed = docs.withColumn("_hash", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    joined = hashed.join(pieces, hashed["doc_id"].eqNullSafe(pieces["span_id"]) & (hashed["_hash"] == pieces["text_hash"]), "left")
    part = lambda s: F.when(s["start"] >= s["from"], F.concat(
        F.substr(F.col("text"), (s["from"] + 1).cast("int"), (s["start"] - s["from"]).cast("int")), F.lit("<"), F.upper(s["kind"]), F.lit(">")
    )).otherwise("")
    text = F.when(
        F.col("found").isNotNull(),
        F.concat(F.array_join(F.transform("found", part), ""), F.substr(F.col("text"), (F.col("rest") + 1).cast("int"))),
    ).otherwise(F.col("text"))
    chars = F.when(F.col("found").isNotNull(), F.length("new_text").cast("bigint")).otherwise(F.col("n_chars"))
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    return (
        joined.select(*others, text.alias("new_text"), "n_chars", "found")
        .select(*others, F.col("new_text").alias("text"), chars.alias("n_chars"))
        .select(*docs.columns)
    )
