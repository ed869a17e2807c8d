"""Plain versions of the operators' contracts, a text at a time and without Spark."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def in_fold(doc_id, folds, fold) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


def quality(text):
    ws, text = words(text), text or ""
    grams = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    counts = collections.Counter(grams)
    hit = set()
    for i, g in enumerate(grams):
        if counts[g] > 1:
            hit.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return {
        "n_words": len(ws),
        "word_chars": sum(map(len, ws)),
        "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": dup,
        "n_repeat_words": len(hit),
        "base_failed": len(ws) < 20 or 100 * len(hit) > 30 * len(ws),
    }


def later_chars(text, n):
    """Characters of words in a later copy of an n-gram."""
    ws, seen, hit = words(text), set(), set()
    for i in range(len(ws) - n + 1):
        g = tuple(ws[i : i + n])
        if g in seen:
            hit.update(range(i, i + n))
        seen.add(g)
    return sum(len(ws[i]) for i in hit)


def fingerprint(text) -> int:
    ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = words(ws)
    grams = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [" ".join(ws)] * bool(ws)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints: dict, bits: int = 3) -> dict:
    """Component of every distinct value, as its smallest member."""
    values = np.array(sorted(set(prints)), np.uint64)
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= bits):
            a, b = sorted((find(i), find(int(j) + i + 1)))
            parent[b] = a
    return {int(v): find(i) for i, v in enumerate(values)}


def repeated(sequences, window):
    """For each sequence which symbols lie in a window that occurs elsewhere too."""
    counts = collections.Counter(s[i : i + window] for s in sequences for i in range(len(s) - window + 1))
    out = []
    for s in sequences:
        gone = [False] * len(s)
        for i in range(len(s) - window + 1):
            if counts[s[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        out.append(gone)
    return out


def later(sequences, window):
    """The same for windows that occur earlier."""
    seen, out = set(), []
    for s in sequences:
        gone = [False] * len(s)
        for i in range(len(s) - window + 1):
            if s[i : i + window] in seen:
                gone[i : i + window] = [True] * window
            seen.add(s[i : i + window])
        out.append(gone)
    return out


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed([int(x) for x in digits])):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    out = []
    for n, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), n, m.end(), kind))
    return [(kind, a, b) for a, _, b, kind in sorted(out)]


def base_scores(rows):
    """``(n_tokens, n_known, N, base_score)`` of rows ``(doc_id, text)``."""

    def tokens(text):
        return [w for w in words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))] + [None]

    counts = collections.Counter()
    for doc_id, text in rows:
        if not in_fold(doc_id, 5, 1):
            counts.update(tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for _, text in rows:
        ts = tokens(text)
        score = sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in ts)
        out.append((len(ts), sum(counts[t] > 0 for t in ts), total, score))
    return out
