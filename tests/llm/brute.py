"""Plain, quadratic or per-row versions of what the operators compute, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = WORD.findall(text)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if WORD.search(x) and x in lines[:i])
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(grams)
    inside = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), symbols, dup, len(inside), failed


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text: str | None) -> list[tuple[str, int, int]]:
    """Base spans by kind, then start."""
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and _luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    )
    return [(k, m.start(), m.end()) for k, rx, ok in kinds for m in re.finditer(rx, text) if ok(m[0])]


def shingles(text: str | None, width: int = 5) -> frozenset:
    words = WORD.findall((text or "").translate(UPPER))
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def components(docs: list[tuple[int, str | None]], percent: int = 75) -> list[tuple[int, int, int]]:
    """(doc_id, n_shingles, component_id) by testing all pairs."""
    sets = [(d, shingles(t)) for d, t in docs]
    comp = {d: d for d, _ in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, (a, p) in enumerate(sets):
        for b, q in sets[:i]:
            if p and q and 100 * len(p & q) >= percent * len(p | q):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return sorted((d, len(s), root(d)) for d, s in sets)


def repeated_passages(docs: list[tuple[int, str | None]], short: int = 200, words: int = 50) -> list[tuple]:
    """(doc_id, n_passages): maximal runs of over ``words`` words that repeated strings of ``short`` bytes cover."""
    raw = [(d, (t or "").encode()) for d, t in docs]
    often = Counter(b[i : i + short] for _, b in raw for i in range(len(b) - short + 1))
    out = []
    for d, b in raw:
        runs: list[list[int]] = []
        for i in range(len(b) - short + 1):
            if often[b[i : i + short]] > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + short
                else:
                    runs.append([i, i + short])
        out.append((d, sum(len(b[s:e].split()) > words for s, e in runs)))
    return sorted(out, key=repr)


def suffix_removed(docs: list[tuple[int, str | None]], length: int = 400) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) by counting every string of ``length`` bytes."""
    raw = [(d, (t or "").encode()) for d, t in docs]
    often = Counter(hashlib.blake2b(b[i : i + length], digest_size=12).digest() for _, b in raw for i in range(len(b) - length + 1))
    out = []
    for d, b in raw:
        gone = bytearray(len(b) + 1)
        reach = 0
        for i in range(len(b)):
            if i + length <= len(b) and often[hashlib.blake2b(b[i : i + length], digest_size=12).digest()] > 1:
                reach = i + length
            gone[i] = i < reach
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def frequent_lines(docs: list[tuple[int, str | None]], least: int = 10) -> list[tuple]:
    """(doc_id, n_lines, n_dropped, kept_sha256)."""
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(UPPER)
    where = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            where[key(line)].add(d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or len(where[key(x)]) < least]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def jump(key: int, shards: int) -> int:
    """The published loop, in unbounded integers."""
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def local_alignment(item: list, text: list, match: int = 2, mismatch: int = -1, gap: int = -1) -> int:
    best, row = 0, [0] * (len(text) + 1)
    for a in item:
        new = [0]
        for j, b in enumerate(text, 1):
            new.append(max(0, row[j - 1] + (match if a == b else mismatch), row[j] + gap, new[-1] + gap))
        row = new
        best = max(best, *row)
    return best
