"""Importance resampling, filter audit and piecewise fingerprints against plain versions."""

import bisect
import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statloom.llm import filter_audit, importance, piecewise
from tests.llm.plain import WORD, lower_ascii

# Importance resampling ------------------------------------------------------

FEATURE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    words = FEATURE.findall(lower_ascii(text or ""))
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain_resampled(rows, target, longest=1, buckets=10_000, percent=10, min_words=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in rows for f in features(t, longest))
    t = Counter(bucket(f) for x in target for f in features(x, longest))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out, may = [], []
    for doc_id, text in rows:
        found = [gain(bucket(f)) for f in features(text, longest)]
        weight = sum(found) // len(found) if found else 0
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"2024:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        n_words = len(features(text, 1))
        if n_words >= min_words and doc_id is not None:
            may.append((-score, doc_id))
        out.append([doc_id, n_words, len(found), weight, score])
    may.sort()
    drawn = may[: len(may) * percent // 100]
    for row in out:
        key = (-row[4], row[0]) if row[4] is not None else None
        row.append(bisect.bisect_left(drawn, key) + 1 if key in drawn and row[1] >= min_words else None)
    return sorted(map(tuple, out), key=repr)


def resampled_rows(frame):
    return sorted(map(tuple, frame.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.fixture(scope="module")
def items(spark, doc_rows):
    texts = [t for _, t in doc_rows[5:40:3]] + [None, ""]
    return texts, spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "item_id BIGINT, text STRING, row STRING")


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_resampling_equals_plain(docs, doc_rows, items, longest):
    texts, target = items
    found = importance.resampled(docs, target, longest, percent=50)
    assert resampled_rows(found) == plain_resampled(doc_rows, texts, longest, percent=50)


def test_resampling_with_frequent_lines_and_few_drawn(docs, doc_rows, items, monkeypatch):
    monkeypatch.setattr(importance, "FREQUENT_LINES", 50)
    texts, target = items
    assert resampled_rows(importance.resampled(docs, target)) == plain_resampled(doc_rows, texts)


def test_resampling_of_rows_without_id_and_of_repeated_rows(spark, items):
    texts, target = items
    rows = [(None, texts[0]), (None, None), (7, texts[1]), (7, "one two"), (3, None), (-4, texts[2]), (8, "Ünïcode ÀB\nc\r\n\nc")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    assert resampled_rows(importance.resampled(docs, target, 2, percent=100)) == plain_resampled(rows, texts, 2, percent=100)


def test_resampling_of_nothing(docs, no_docs, doc_rows):
    target = no_docs.select("text")
    assert importance.resampled(no_docs, target).count() == 0
    assert resampled_rows(importance.resampled(docs, target)) == plain_resampled(doc_rows, [])
    drawn = importance.drawn_documents(docs, target, percent=100)
    assert drawn.columns == docs.columns and drawn.count() == sum(len(features(t, 1)) >= 20 for _, t in doc_rows)


def test_resampling_of_a_very_long_line(spark, items):
    texts, target = items
    rows = [(1, "word " * 300_000), (2, "a\n" * 200_000), (3, texts[0])]
    found = importance.resampled(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), target, percent=100)
    assert resampled_rows(found) == plain_resampled(rows, texts, percent=100)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n\r-É", max_size=60), st.integers(1, 4))
def test_lines_and_crossing_runs_make_all_runs(text, longest):
    lines = np.concatenate([importance.line_buckets(line, longest, 997)[1] for line in text.split("\n")])
    crossing = importance.crossing_buckets(text, longest, 997)
    assert Counter([*lines, *crossing]) == Counter(zlib.crc32(f.encode()) % 997 for f in features(text, longest))


# Filter audit ---------------------------------------------------------------


def plain_audit(rows, labels):
    """Filters applied one after the other to lists of documents."""
    first = {}
    for doc_id, text, _ in rows:
        text = text or ""
        if doc_id is not None:
            first[text] = min(first.get(text, doc_id), doc_id)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}

    def fails(doc_id, text):
        text = text or ""
        words = WORD.findall(text)
        out = set()
        if len(words) < 100:
            out.add("A")
        if 100 * len(set(words)) < 80 * len(words):
            out.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text):
            out.add("C")
        if re.search("[#$%&*|]", text):
            out.add("D")
        if doc_id is not None and first[text] < doc_id:
            out.add("E")
        return out

    parts = defaultdict(list)
    for doc_id, text, lang in rows:
        parts[lang or ""].append((doc_id, fails(doc_id, text)))
    out = []
    for part, docs in parts.items():
        shapley, told = Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d, bad in left if f in bad]
                redundant = sum(f in bad for _, bad in docs) - len(gone)
                left = [(d, bad) for d, bad in left if f not in bad]
                only = sum(bad == {f} for _, bad in docs)
                told.append((part, "".join(order), step, len(left), len(gone), redundant, only, sum(d in good for d in gone), sum(d in toxic for d in gone)))
                shapley[f] += len(gone)
        out += [(*row, shapley[row[1][row[2] - 1]]) for row in told]
    return sorted(out)


AUDIT = ("part", "filter_order", "step", *filter_audit.COUNTS, "shapley")


def audit_rows(docs, labels):
    return sorted(map(tuple, filter_audit.audit(docs, labels).select(*AUDIT).collect()))


def test_audit_equals_plain(spark, doc_rows):
    long = "Some WORDS make a longer text now "
    rows = [(i, t, ["en", "de", None, ""][i % 4]) for i, t in doc_rows]
    rows += [(500 + i, (long * 20 if i % 2 else " ".join(f"w{j}" for j in range(120))) + "#" * (i % 3), "en") for i in range(12)]
    rows += [(None, "", "fr"), (None, long, None), (3, long, "en"), (3, long, "en"), (3, "other", "de"), (900, long, "en")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 600, 2)] + [(4, 1, 0), (None, 1, 1), (8, None, None)]
    labels = [(d, q, None if t is None else int(t)) for d, q, t in labels]
    docs = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id BIGINT, text STRING, lang STRING, part STRING, mask INT").repartition(3)
    marks = spark.createDataFrame([(*r, "y") for r in labels], "doc_id BIGINT, quality INT, toxic INT, lang STRING")
    assert audit_rows(docs, marks) == plain_audit(rows, labels)


def test_audit_of_nothing_and_without_labels(docs, doc_rows, no_docs, no_labels):
    assert filter_audit.audit(no_docs, no_labels).count() == 0
    rows = [(i, t, "en") for i, t in doc_rows]
    found = audit_rows(docs, no_labels)
    assert len(found) == 600 and found == plain_audit(rows, [])


def test_audit_of_a_large_group_of_copies_and_very_long_texts(spark):
    rows = [(i, "same text", "en" if i % 3 else "de") for i in range(3000)] + [(5000, "ab " * 400_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")
    labels = [(i, i % 2, 0) for i in range(3000)]
    assert audit_rows(docs, spark.createDataFrame(labels, "doc_id BIGINT, quality INT, toxic INT")) == plain_audit(rows, labels)


# Fingerprints ---------------------------------------------------------------


def plain_fingerprint(text):
    """Byte by byte, with a piece's end decided from the seven bytes before it."""
    data = text.encode()

    def rolled(i):
        h = sum(int(piecewise._ROLL[k][data[i - 6 + k] if i - 6 + k >= 0 else 0]) for k in range(7)) & 0xFFFFFFFF
        h ^= h >> 15
        h = h * 0x2C1B3C6D & 0xFFFFFFFF
        return h ^ (h >> 13)

    hashes = [rolled(i) for i in range(len(data))]
    count = lambda b: sum(h & (b - 1) == b - 1 for h in hashes)
    lowest = 1
    while count(lowest) > 1 << 14:
        lowest *= 2
    block = lowest
    while block * 64 < len(data):
        block *= 2
    while count(block) > 256:
        block *= 2
    while block > lowest and count(block) < 16 and count(block // 2) <= 256:
        block //= 2

    def signature(b):
        out, start = "", 0
        for i, h in enumerate(hashes):
            if h & (b - 1) == b - 1 or i == len(data) - 1:
                out += chr(piecewise.ALPHABET[(zlib.crc32(data[start : i + 1]) * 0x9E3779B1 & 0xFFFFFFFF) >> 26])
                start = i + 1
        return out

    return f"{block}:{signature(block)}:{signature(2 * block)}"


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
    return row[-1]


def plain_likeness(one, two):
    if one == two:
        return 1.0
    (b1, s1, d1), (b2, s2, d2) = ((int(p[0]), *p[1:]) for p in (one.split(":"), two.split(":")))
    alike = lambda a, b: 1 - levenshtein(a, b) / max(len(a), len(b), 1)
    if b1 == b2:
        return max(alike(s1, s2), alike(d1, d2))
    return alike(s1, d2) if b1 == 2 * b2 else alike(d1, s2) if b2 == 2 * b1 else 0.0


def plain_fingerprints(rows):
    rows = sorted(rows, key=lambda r: -r[0])
    out = []
    for i, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        n = len(text)
        changed = text[: n - n // 2] + after[: n // 2]
        prints = [plain_fingerprint(t) for t in (text, changed, after)]
        out.append((
            doc_id, n, hashlib.sha256(changed.encode()).hexdigest(), prints[0], prints[1],
            round(plain_likeness(prints[0], prints[1]), 12), round(plain_likeness(prints[0], prints[2]), 12),
        ))
    return sorted(out)


def print_rows(frame):
    near = [F.round(c, 12).alias(c) for c in ("near_edited", "near_next")]
    return sorted(map(tuple, frame.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *near).collect()))


def test_fingerprints_equal_plain(docs, doc_rows):
    assert print_rows(piecewise.fingerprints(docs)) == plain_fingerprints(doc_rows)


@pytest.mark.parametrize("partitions", ["1", "40"])
def test_fingerprints_with_few_rows_in_many_ranges(spark, doc_rows, partitions):
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for rows in (doc_rows[:25], doc_rows[:1], doc_rows[3:5]):
            docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
            assert print_rows(piecewise.fingerprints(docs)) == plain_fingerprints(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_fingerprints_of_odd_rows(spark, no_docs):
    assert piecewise.fingerprints(no_docs).count() == 0
    rows = [(None, "a b c"), (None, "a b c"), (None, None), (2, "x" * 50), (2, "y" * 50), (2, "x" * 50), (1, "")]
    found = piecewise.fingerprints(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()
    assert len(found) == 7
    by_text = defaultdict(set)
    for row in found:
        by_text[(row["doc_id"], row["n_chars"])].add(row["fingerprint"])
    assert len(by_text[(None, 5)]) == 1 and len(by_text[(2, 50)]) == 2


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="abc é🙂\n", max_size=400), st.integers(1, 30))
def test_fingerprint_equals_plain(text, times):
    assert piecewise.fingerprint(text * times) == plain_fingerprint(text * times)


def test_fingerprint_in_slices(monkeypatch):
    draw = np.random.default_rng(1)
    text = "".join(map(chr, draw.integers(97, 122, 30_000)))
    whole = piecewise.fingerprint(text)
    monkeypatch.setattr(piecewise, "SLICE_BYTES", 777)
    assert piecewise.fingerprint(text) == whole == plain_fingerprint(text)
    assert piecewise.fingerprint("z" * 3_000_000).count(":") == 2


def test_an_edit_changes_few_pieces():
    draw = np.random.default_rng(2)
    text = "".join(map(chr, draw.integers(97, 122, 5000)))
    changed = text[:2000] + "an edit in the middle" + text[2030:]
    assert plain_likeness(piecewise.fingerprint(text), piecewise.fingerprint(changed)) > 0.9
    assert plain_likeness(piecewise.fingerprint(text), piecewise.fingerprint("".join(map(chr, draw.integers(97, 122, 5000))))) < 0.3
