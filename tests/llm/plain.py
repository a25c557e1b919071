"""Brute-force versions of the operators' results, in plain Python."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def components(nodes, links):
    top = {n: n for n in nodes}

    def find(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    words = WORD.findall(lower_ascii(text or ""))
    if len(words) >= 5:
        return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return frozenset([tuple(words)]) if words else frozenset()


def near_duplicates(rows):
    """doc_id -> (n_shingles, component, kept)."""
    sets = {d: shingles(t) for d, t in rows}
    links = [
        (a, b)
        for a, b in itertools.combinations(sets, 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    found = components(sets, links)
    return {d: (len(sets[d]), found[d], found[d] == d) for d in sets}


def substrings(rows, window=35):
    """(n_words, n_removed, sha256 of what is kept), for each row."""
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def statistics(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered.update(range(i, i + 5))
    lines = [line for line in text.split("\n") if WORD.search(line)]
    n, repeated = len(words), len(covered)
    failed = n < 10 or 100 * repeated > 20 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeated, failed


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def fixed_formats(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    spans = lambda pattern, ok: [m.span() for m in re.finditer(pattern, text) if ok(m.group())]
    return {
        "email": spans(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": spans(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        "card": spans(r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": spans(r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    }


def written(spans):
    return ",".join(f"{k}:{a}:{b}" for k, found in spans.items() for a, b in found)


def vector_links(rows, threshold=0.98):
    """For rows (vec_id, vector, label): list of (n_links, component, kept)."""
    import numpy as np

    def usable(v, label):
        return label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    units = {}
    for i, (_, v, label) in enumerate(rows):
        if usable(v, label):
            x = np.array(v, np.float32).astype(np.float64)
            units[i] = x / np.sqrt((x * x).sum())
    near = defaultdict(set)
    for i, j in itertools.combinations(units, 2):
        if rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and float(units[i] @ units[j]) >= threshold:
            near[i].add(j)
            near[j].add(i)
    links = [(rows[i][0], rows[j][0]) for i in near for j in near[i]]
    top = components({r[0] for r in rows}, links)
    return [(len(near[i]), top[r[0]], top[r[0]] == r[0]) for i, r in enumerate(rows)]
