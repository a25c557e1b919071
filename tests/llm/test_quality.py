import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.llm import quality_knn, quality_rules
from tests.llm import plain


def test_statistics_equal_brute_force(docs, doc_rows, no_labels):
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rows = quality_rules.quality_rules(docs, no_labels).collect()
    assert {r["doc_id"]: tuple(r[c] for c in columns) for r in rows} == {d: plain.statistics(t) for d, t in doc_rows}
    assert all(r["kept"] != r["base_failed"] and r["rule"] is None for r in rows)  # no labels, no learned rules


def test_overlapping_and_long_repeats(spark):
    texts = ["a b c d e " * 40, "x " * 3000, "p q r s t u p q r s t v p q r s t", "#*$ %&| <> a b c d e f g h\n\n \nA B\nA B\nA B"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    none = spark.createDataFrame([], "doc_id BIGINT, quality INT")
    got = {r["doc_id"]: tuple(r)[1:7] for r in quality_rules.quality_rules(df, none).collect()}
    assert got == {i: plain.statistics(t) for i, t in enumerate(texts)}


def labelled_texts(n=400):
    draw = random.Random(2)
    rows = []
    for i in range(n):
        words = ["".join(draw.choices("abcdefghijk", k=draw.randint(2, 8))) for _ in range(draw.randint(30, 120))]
        kind = i % 8
        if kind == 0:
            words = [w + draw.choice(["###", "$$$", "&&&"]) for w in words]
        elif kind == 1:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), int(kind > 1)))
    return rows


@pytest.fixture(scope="module")
def labelled(spark):
    rows = labelled_texts()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id BIGINT, text STRING")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 2 == 0 or i % 3 == 0], "doc_id BIGINT, quality INT")
    return rows, docs, labels


def test_rules_reject_what_the_labels_reject(labelled):
    rows, docs, labels = labelled
    x, bad = quality_rules.training_rows(docs, labels)
    rules = quality_rules.learn_rules(x, bad)
    assert rules and all(len(r) <= quality_rules.MAX_TERMS for r in rules)
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(docs, labels).collect()}
    assert all(kept[i] for i, _, q in rows if q == 1)
    assert sum(kept[i] for i, _, q in rows if q == 0) <= 2
    masks = [quality_rules._mask(r, x) for r in rules]
    assert np.any(masks, axis=0)[~bad].sum() == 0


def test_kept_documents_keep_their_columns(docs, no_docs, no_labels, doc_rows):
    kept = quality_rules.kept_documents(docs, no_labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, t in doc_rows if not plain.statistics(t)[-1]}
    assert quality_rules.kept_documents(no_docs, no_labels).count() == 0


def test_terms_do_not_depend_on_slices():
    texts = [t for _, t, _ in labelled_texts(30)] + ["", "a", "a\nb\nb", "é🙂 ..."]
    raw = [t.encode() for t in texts]

    def vectors(parts):
        offsets = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) for p in parts], out=offsets[1:])
        return quality_knn.term_vectors(np.frombuffer(b"".join(parts), np.uint8), offsets)

    whole = vectors(raw)
    assert np.array_equal(whole, np.concatenate([vectors([p]) for p in raw]))


def test_votes_on_held_out_documents(labelled):
    rows, docs, labels = labelled
    got = {r["doc_id"]: r for r in quality_knn.quality(docs, labels).collect()}
    assert len(got) == len(rows)
    for i, _, quality in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= got[i]["score"] <= 1 and got[i]["predicted"] == int(got[i]["score"] >= 0.3)
    held = [(got[i]["predicted"], quality) for i, _, quality in rows if got[i]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)


def test_scores_do_not_see_held_out_labels(labelled):
    _, docs, labels = labelled
    turned = labels.withColumn("quality", F.when(quality_knn.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    first = {r["doc_id"]: r["score"] for r in quality_knn.quality(docs, labels).collect()}
    assert {r["doc_id"]: r["score"] for r in quality_knn.quality(docs, turned).collect()} == first


def test_voters_equal_plain_cosines(labelled):
    rows, _, _ = labelled
    raw = [t.encode() for _, t, _ in rows[:120]]
    offsets = np.cumsum([0, *map(len, raw)])
    terms = quality_knn.term_vectors(np.frombuffer(b"".join(raw), np.uint8), offsets)
    voters = quality_knn.fit(terms[:90], np.array([q for _, _, q in rows[:90]], float))
    got = voters.scores(terms[90:])
    placed = voters.place(terms)
    for i, score in enumerate(got):
        near = sorted(((float(placed[90 + i] @ placed[j]), rows[j][2]) for j in range(90)), reverse=True)[: quality_knn.NEIGHBOURS]
        weights = [max(0.0, s) ** quality_knn.SHARPNESS + 1e-12 for s, _ in near]
        assert score == pytest.approx(sum(w * y for w, (_, y) in zip(weights, near)) / sum(weights), abs=1e-4)


def test_no_labels_and_no_documents(docs, doc_rows, no_docs, no_labels):
    rows = quality_knn.quality(docs, no_labels).collect()
    assert len(rows) == len(doc_rows) and {r["score"] for r in rows} == {0.5}
    assert quality_knn.quality(no_docs, no_labels).count() == 0
