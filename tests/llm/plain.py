"""Plain versions of the contracts, in Python over whole tables, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def pii_spans(text: str | None) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text or "", re.ASCII):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda d=digits: 16 <= len(d) <= 19 and luhn(d),
                "phone": lambda d=digits: 8 <= len(d) <= 15,
            }[kind]()
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def written(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def quality(text: str | None) -> dict:
    w = words(text)
    places = defaultdict(list)
    for i in range(len(w) - 7):
        places[tuple(w[i : i + 8])].append(i)
    covered = {p for at in places.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": dup,
        "n_repeat_words": len(covered),
        "base_failed": len(w) < 20 or 100 * len(covered) > 30 * len(w),
    }


def shingles(text: str | None) -> frozenset:
    w = words((text or "").translate(LOWER))
    if len(w) >= 5:
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    return frozenset([tuple(w)]) if w else frozenset()


def near_components(rows) -> dict:
    """id: (size of the set, smallest id reachable)."""
    sets = {k: shingles(t) for k, t in rows}
    up = {k: k for k in sets}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    holders = defaultdict(list)
    for k, s in sets.items():
        for g in s:
            holders[g].append(k)
    common = Counter()
    for held in holders.values():
        for i, a in enumerate(held):
            for b in held[:i]:
                common[a, b] += 1
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {k: (len(s), find(k)) for k, s in sets.items()}


def repeated_bytes(texts, length=400) -> list[tuple[int, int, int, str]]:
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, x in zip(b, gone, strict=True) if not x)
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def crc(text: str | None) -> int:
    return zlib.crc32((text or "").encode())


def phrases(rows, least: int, top: int = 2000, most: int = 5) -> dict:
    """(lang, rank): (phrase, a, l, r, n, score) for rows of (text, lang)."""
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for size in range(1, most + 1):
                counts.update((lang, tuple(w[i : i + size])) for i in range(len(w) - size + 1))
    frequent = {k: f for k, f in counts.items() if f >= least}
    dropped = set()
    for (lang, p), f in frequent.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                if 100 * f >= 100 * frequent[lang, p[i : i + size]]:
                    dropped.add((lang, p[i : i + size]))
    each = defaultdict(list)
    for (lang, p), a in frequent.items():
        if len(p) > 1 and (lang, p) not in dropped:
            n = total[lang]
            score, _, left, right = min(
                (1000 * a * n // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p))
            )
            each[lang].append((" ".join(p), a, left, right, n, score))
    out = {}
    for lang, found in each.items():
        found.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out |= {(lang, rank): x for rank, x in enumerate(found[:top], 1)}
    return out


def hard_negatives(rows, anchors: int = 50, positives: int = 5, negatives: int = 3) -> list[tuple]:
    """(anchor, positive, rank, negative, scores) for rows of (id, vector, label), in whole numbers of any size."""
    import math

    kept = {}
    for k, v, label in rows:
        if k is None or v is None or label is None or not len(v) or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept[k, (label + 1) % 10 if k % 7 == 0 else label, tuple(math.floor(256 * x) for x in v)] = None
    out = []
    for a, la, va in kept:
        if a % anchors:
            continue
        scored = [(-sum(x * y for x, y in zip(va, v, strict=True)), k, label) for k, label, v in kept if k != a and len(v) == len(va)]
        scored.sort()
        for minus, p, _ in [s for s in scored if s[2] == la][:positives]:
            fits = [s for s in scored if s[2] != la and 50 * -minus <= 100 * -s[0] <= 95 * -minus][:negatives]
            out += [(a, p, rank, s[1], -minus, -s[0]) for rank, s in enumerate(fits, 1)]
    return sorted(out)


def byte_grams(text: str) -> Counter:
    """Slots (of 2**13) of the byte n-grams of a text, n from 1 to 4, that do not begin with two blanks."""
    data = []
    for b in (text or "").encode():
        if 65 <= b <= 90:
            b += 32
        if b < 128 and not 97 <= b <= 122:
            b = 32
        if data and data[-1] == 0xC3 and 0x80 <= b <= 0x9E and b != 0x97:
            b += 32
        data.append(b)
    out = Counter()
    for n in (1, 2, 3, 4):
        for i in range(len(data) - n + 1):
            gram = data[i : i + n]
            if gram[0] == 32 and (n == 1 or gram[1] == 32):
                continue
            h = 0
            for b in gram:
                h = (h * 0x100000001B3 + b + n) % 2**64
            out[h * 0x9E3779B97F4A7C15 % 2**64 >> 51] += 1
    return out


def language_model(texts: list[tuple[str, str]]) -> tuple:
    """Languages, code words and, for each bit, weights by slot, middle, half gap and say, from (language, text)."""
    names = sorted({lang for lang, _ in texts})
    share = {}
    for lang in names:
        counts = sum((byte_grams(t) for own, t in texts if own == lang), Counter())
        total = sum(counts.values())
        raw = [counts[k] / max(total, 1) + 0.1 / 8192 for k in range(8192)]
        share[lang] = [x / sum(raw) for x in raw]
    assert 2 <= len(names) <= 6
    codes = {lang: [1 if i == 0 or not c >> (i - 1) & 1 else -1 for c in range(1, 2 ** (len(names) - 1))] for i, lang in enumerate(names)}
    bits = []
    for j in range(len(codes[names[0]])):
        one, other = ([lang for lang in names if codes[lang][j] == sign] for sign in (1, -1))
        weight = [
            math.log(sum(share[x][k] for x in one) / len(one)) - math.log(sum(share[x][k] for x in other) / len(other)) for k in range(8192)
        ]
        centre = {lang: sum(p * w for p, w in zip(share[lang], weight, strict=True)) for lang in names}
        low, high = max(centre[x] for x in other), min(centre[x] for x in one)
        bits.append((weight, (low + high) / 2, max(high - low, 1e-6) / 2))
    total = sum(gap for _, _, gap in bits)
    return names, codes, [(w, middle, gap, gap / total) for w, middle, gap in bits]


def language(text: str | None, model: tuple) -> tuple[str, float]:
    names, codes, bits = model
    if not any(unicodedata.category(c).startswith("L") for c in text or ""):
        return "und", 0.0
    grams = byte_grams(text)
    margins = []
    for weight, middle, gap, _ in bits:
        mean = sum(n * weight[k] for k, n in grams.items()) / sum(grams.values())
        margins.append(max(-30, min(30, (mean - middle) / gap)))
    loss = {
        lang: sum(say * math.log1p(math.exp(-2 * m * c)) for m, c, (_, _, _, say) in zip(margins, codes[lang], bits, strict=True))
        for lang in names
    }
    best = min(names, key=loss.get)
    return best, 1 / sum(math.exp(-4 * (x - loss[best])) for x in loss.values())
