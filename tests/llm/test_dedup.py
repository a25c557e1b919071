import random
from collections import Counter

import numpy as np
import pytest

from statloom.llm import embeddings, minhash, substrings
from statloom.llm.common import components
from tests.llm import plain


def by_id(rows, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in rows}


def test_components(spark):
    draw = random.Random(1)
    chain = [(i, i + 1) for i in range(100, 180)]
    some = [(draw.randrange(60), draw.randrange(60)) for _ in range(35)]
    edges = spark.createDataFrame([*chain, *some, (7, 7)], "a BIGINT, b BIGINT")
    want = plain.components({n for e in [*chain, *some] for n in e}, [*chain, *some])
    got = {r["node"]: r["component"] for r in components(edges, "t").collect()}
    assert got == {n: c for n, c in want.items() if n in got}
    assert all(n in got for e in [*chain, *some] for n in e if e[0] != e[1])


def test_near_duplicates_equal_brute_force(docs, doc_rows):
    got = by_id(minhash.near_duplicates(docs).collect(), "n_shingles", "component_id", "kept")
    assert got == plain.near_duplicates(doc_rows)


def test_large_group_of_near_copies_and_a_common_line(spark):
    """Near copies of which some are only linked through others; documents that share but a line."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choices("abcdefghij", k=6))
    base, line = [word() for _ in range(60)], [word() for _ in range(12)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(draw.randint(0, 3)):
            words[draw.randrange(60)] = word()
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(line + [word() for _ in range(draw.randint(1, 40))])) for i in range(60)]
    got = by_id(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect(), "n_shingles", "component_id", "kept")
    assert got == plain.near_duplicates(rows)


def test_a_family_about_a_base_that_none_is_linked_to(spark, monkeypatch):
    """Members a third away from the base; some are linked to each other only; the pairs tried stay below the rows."""
    draw = random.Random(8)
    word = lambda: "".join(draw.choices("abcdefghijklmnop", k=7))
    base = [word() for _ in range(400)]

    def changed(words, share):
        return [word() if draw.random() < share else w for w in words]

    rows = [(0, " ".join(base))]
    for i in range(1, 120):
        member = changed(base, 0.055)  # 5 shingles to a word: about 0.6 of the shingles are left, similarity 0.6 and below
        rows.append((10 * i, " ".join(member)))
        if i % 10 == 0:  # a chain that only leads to this member
            for j in range(1, 4):
                member = changed(member, 0.02)
                rows.append((10 * i + j, " ".join(member)))
    for i in range(60):  # the base without a passage: some pairs overlap enough
        at = draw.randrange(280)
        rows.append((5000 + i, " ".join(base[:at] + base[at + 120 :])))
    rows += [(7000 + i, " ".join(base[: 300 + i])) for i in range(0, 100, 20)]
    tried = {}
    plain_write = minhash.materialize

    def counted(frame, name):
        written = plain_write(frame, name)
        tried[name] = written.count()
        return written

    monkeypatch.setattr(minhash, "materialize", counted)
    got = by_id(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect(), "n_shingles", "component_id", "kept")
    want = plain.near_duplicates(rows)
    assert got == want
    assert len({c for _, c, _ in want.values()}) > 100 and any(got[10 * i + 3][1] == 10 * i for i in range(10, 120, 10))
    assert tried["minhash-around"] > 100 and tried["minhash-across"] < 2 * len(rows)


def test_short_and_long_sets_that_contain_each_other(spark):
    """Similarities about the threshold by growing a text, for sets smaller and larger than the sketches."""
    draw = random.Random(6)
    word = lambda: "".join(draw.choices("abcdefghijklm", k=6))
    rows = []
    for k, size in enumerate((8, 60, 150, 190, 230, 256, 300, 700, 1500)):
        words = [word() for _ in range(int(size * 1.8))]
        rows += [(k * 10 + i, " ".join(words[: int(size * r)])) for i, r in enumerate((1.0, 1.3, 1.36, 1.7))]
        noisy = [w if draw.random() < 0.97 else word() for w in words[:size]]
        rows.append((k * 10 + 5, " ".join(noisy)))
    got = by_id(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect(), "n_shingles", "component_id", "kept")
    assert got == plain.near_duplicates(rows)


def test_repeated_and_missing_ids(spark):
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (None, "one two three four five six"), (2, None), (3, "")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()
    assert Counter(map(tuple, got)) == Counter([(1, 2, 1, True), (1, 2, 1, True), (None, 2, None, True), (2, 0, 2, True), (3, 0, 3, True)])


def test_first_of_each_keeps_columns(docs, doc_rows, no_docs):
    kept = minhash.first_of_each(docs)
    assert kept.columns == docs.columns
    want = {d for d, (_, _, k) in plain.near_duplicates(doc_rows).items() if k}
    assert {r["doc_id"] for r in kept.collect()} == want
    assert minhash.first_of_each(no_docs).count() == 0 and minhash.near_duplicates(no_docs).count() == 0


def test_substrings_equal_brute_force(docs, doc_rows):
    want = dict(zip((d for d, _ in doc_rows), plain.substrings(doc_rows)))
    got = by_id(substrings.substring_dedup(docs).collect(), "n_words", "n_removed", "kept_sha256")
    assert got == want
    assert sum(n for _, n, _ in want.values()) > 1000


@pytest.mark.parametrize("share", [1e-4, 0.5])
def test_substrings_with_frequent_prefixes(spark, monkeypatch, share):
    """Many documents share seven or more words and go on differently; slices decide little by themselves."""
    monkeypatch.setattr(substrings, "HOT_SHARE", share / 10)
    monkeypatch.setattr(substrings, "SLICE_WINDOWS", 50)
    draw = random.Random(9)
    say = lambda n: " ".join("".join(draw.choices("abcdef", k=5)) for _ in range(n))
    head, passage = say(25), say(50)
    rows = [(i, f"{say(draw.randint(0, 5))} {head} {say(draw.randint(0, 40))} {passage if i % 3 == 0 else say(30)} {say(4)}") for i in range(60)]
    rows += [(100 + i, "again and again " * (20 + i)) for i in range(3)] + [(i, rows[0][1]) for i in (200, 201)]
    rows.append((0, rows[0][1]))  # a row that repeats
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(4)
    got = substrings.substring_dedup(df).collect()
    want = [(d, *r) for (d, _), r in zip(rows, plain.substrings(rows))]
    assert Counter(map(tuple, got)) == Counter(want)


def test_cut_documents_keep_their_columns(docs, doc_rows, no_docs):
    cut = substrings.without_repeats(docs)
    assert cut.columns == docs.columns and cut.dtypes == docs.dtypes
    rows = {r["doc_id"]: r for r in cut.collect()}
    assert len(rows) == len(doc_rows)
    for (d, text), (n, gone, _) in zip(doc_rows, plain.substrings(doc_rows)):
        assert len(plain.WORD.findall(rows[d]["text"] or "")) == n - gone
        if not gone:
            assert rows[d]["text"] == text
        elif rows[d]["text"] is not None:
            assert rows[d]["n_chars"] == len(rows[d]["text"])
    assert substrings.without_repeats(no_docs).count() == 0 and substrings.substring_dedup(no_docs).count() == 0


def vectors(seed=1):
    draw = np.random.default_rng(seed)
    rows = []
    for label in (0, 1, 2):
        x = draw.standard_normal((40, 16))
        near = x[:10] + 0.05 * draw.standard_normal((10, 16))
        close = x[0] + 0.06 * draw.standard_normal((70 if label == 1 else 5, 16))
        rows += [(v.tolist(), label) for v in (*x, *near, *close, *x[:4], *x[:4])]
    rows += [(None, 1), ([0.0] * 16, 1), ([None] + [1.0] * 15, 1), ([float("nan")] * 16, 1), (rows[0][0], None), ([1.0, 2.0], 1), ([1.0, 2.0], 1), ([], 2)]
    ids = draw.permutation(len(rows)).tolist()
    return [(i, v, label) for i, (v, label) in zip(ids, rows)]


@pytest.mark.parametrize("window", [32, 3])
def test_vectors_equal_brute_force(spark, monkeypatch, window):
    monkeypatch.setattr(embeddings, "WINDOW", window)
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", 16)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicate_vectors(df).collect()}
    want = {r[0]: w for r, w in zip(rows, plain.vector_links(rows))}
    assert got == want
    assert max(n for n, _, _ in want.values()) > 32


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT")
    assert embeddings.near_duplicate_vectors(df).count() == 0


def test_doubles_and_labels_of_any_kind(spark):
    rows = [
        (0, [1e300, 1.0], "a"), (1, [1e300, 2.0], "a"), (2, [1e-300, 0.0], "a"), (3, [1.0, 0.0], "b"), (4, [1.0, 1e-9], "b"),
        (5, [1.0, 0.0], None), (6, [0.0, 5e-324], "b"), (7, [0.0, 1.0], "b"), (8, [-1.0, 0.0], "b"),
    ]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id BIGINT, embedding ARRAY<DOUBLE>, label STRING, id INT, size STRING")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicate_vectors(df).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (1, 3), 4: (1, 3), 5: (0, 5), 6: (1, 6), 7: (1, 6), 8: (0, 8)}
    close = spark.createDataFrame([(0, [1.0], 1.2), (1, [1.0], 1.7), (2, [2.0], 1.2)], "vec_id BIGINT, embedding ARRAY<DOUBLE>, label DOUBLE")
    assert {r["vec_id"]: r["component_id"] for r in embeddings.near_duplicate_vectors(close).collect()} == {0: 0, 1: 1, 2: 0}


def test_vectors_without_a_common_direction_meet_in_windows(spark, monkeypatch):
    """Most stretches are no longer than the window, which then finds their links."""
    draw = np.random.default_rng(4)
    x = draw.standard_normal((400, 32))
    near = x[:60] + 0.17 * draw.standard_normal((60, 32))
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(np.concatenate([x, near]))]
    sizes, write = {}, embeddings.materialize

    def counted(frame, name):
        out = write(frame, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(embeddings, "materialize", counted)
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicate_vectors(df).collect()}
    assert got == {r[0]: w for r, w in zip(rows, plain.vector_links(rows))}
    assert sizes["vectors-large"] < 60 and sum(n for n, _, _ in got.values()) > 60


def around_a_centre(rows, pairs, spread, seed=2):
    """Vectors of one label close to each other, of which some have a partner just beyond the threshold."""
    draw = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    x = unit(unit(draw.standard_normal(64)) + spread * unit(draw.standard_normal((rows, 64))))
    aside = draw.standard_normal((pairs, 64))
    aside = unit(aside - (aside * x[:pairs]).sum(1, keepdims=True) * x[:pairs])
    x = np.concatenate([x, 0.9815 * x[:pairs] + np.sqrt(1 - 0.9815**2) * aside])
    ids = draw.permutation(len(x)).tolist()
    return [(i, v.tolist(), 0) for i, v in zip(ids, x)]


@pytest.mark.parametrize("rows, spread, block, move", [(1500, 0.25, 512, 256), (1500, 0.25, 256, 4), (1500, 0.7, 256, 4)])
def test_vectors_around_a_centre(spark, monkeypatch, rows, spread, block, move):
    """Signs split such vectors badly; with and without cost of moving them, so compared whole or by buckets."""
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", block)
    monkeypatch.setattr(embeddings, "MOVE", move, raising=False)
    rows = around_a_centre(rows, 200, spread)
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicate_vectors(df).collect()}
    assert got == {r[0]: w for r, w in zip(rows, plain.vector_links(rows))}


def test_vectors_over_more_partitions_than_rows(spark):
    rows = around_a_centre(16, 8, 2.0, 5)
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT").coalesce(1)
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicate_vectors(df).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {r[0]: w for r, w in zip(rows, plain.vector_links(rows))}
