import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.functions.vectors import bitmap_size, bitmap_words, word_chunks
from statloom.operators import hamming
from statloom.operators import neighbors as nb


def frame(spark, name, bits, labels=None):
    rows = [(i, None if b is None else "\n".join("".join(map(str, b[j : j + 32])) for j in range(0, len(b), 32))) for i, b in enumerate(bits)]
    if labels is not None:
        rows = [(*r, labels[i]) for i, r in enumerate(rows)]
    schema = f"{name} BIGINT, text STRING" + (", label STRING" if labels is not None else "")
    made = spark.createDataFrame(rows, schema)
    return made.withColumns({"words": bitmap_words("text"), "n_bits": bitmap_size("text")}).drop("text")


def brute(queries, train, k):
    return {
        q: [(t, d) for d, t in sorted((int((a != b).sum()), t) for t, b in enumerate(train) if b is not None)[:k]]
        for q, a in enumerate(queries) if a is not None
    }


def found(df):
    out = {}
    for r in df.orderBy("qid", "place").collect():
        out.setdefault(r["qid"], []).append((r["tid"], r["d"]))
    return out


def made(seed, n_train, n_queries, n_bits):
    """Some queries a few bits from training rows, others anywhere; blank borders that all share; equal rows."""
    rng = np.random.default_rng(seed)
    train = [rng.integers(0, 2, n_bits) for _ in range(n_train)]
    for b in train:
        b[: n_bits // 8] = 0
    train[5], train[6] = train[4].copy(), train[4].copy()
    queries = []
    for i in range(n_queries):
        b = train[int(rng.integers(0, n_train))].copy() if i % 4 else rng.integers(0, 2, n_bits)
        b[rng.integers(0, n_bits, i % 7)] ^= 1
        queries.append(b)
    return queries, train


@pytest.mark.parametrize("n_bits", [1, 20, 64, 100, 1024])
@pytest.mark.parametrize("method", ["broadcast", "indexed"])
def test_nearest_bitmaps_equal_brute_force(spark, monkeypatch, n_bits, method):
    monkeypatch.setattr(hamming, "BUCKET_ROWS", 20)
    queries, train = made(n_bits, 150, 40, n_bits)
    queries[3] = train[9] = None
    got = hamming.neighbors(frame(spark, "qid", queries), frame(spark, "tid", train, ["x"] * 150), 2, method, block_rows=64)
    assert found(got) == brute(queries, train, 2)


def test_most_near_queries_are_answered_by_the_index(spark, monkeypatch):
    queries, train = made(3, 400, 60, 1024)
    for t in range(0, 400, 2):  # every row has a near one
        train[t + 1] = train[t].copy()
        train[t + 1][[500, 900]] ^= 1
    queries = [train[2 * i].copy() for i in range(60)]
    for i, b in enumerate(queries):
        b[[200 + i, 700 + i]] ^= 1
    left = []
    plain = hamming._scan
    monkeypatch.setattr(hamming, "_scan", lambda q, *a: (left.append(q.count()), plain(q, *a))[1])
    got = hamming.neighbors(frame(spark, "qid", queries), frame(spark, "tid", train, ["x"] * 400), 2, "indexed")
    assert found(got) == brute(queries, train, 2)
    assert sum(left) == 0


def test_limits_and_errors(spark, monkeypatch):
    queries, train = made(1, 30, 5, 64)
    q, t = frame(spark, "qid", queries), frame(spark, "tid", train, ["x"] * 30)
    assert hamming.neighbors(q, t.where("false"), 3).count() == 0
    assert found(hamming.neighbors(q, t, 50)) == brute(queries, train, 50)
    with pytest.raises(ValueError):
        hamming.neighbors(q, t.union(frame(spark, "tid", [train[0][:32]], ["x"])), 3)
    with pytest.raises(Exception, match="does not have 64 bits"):
        hamming.neighbors(frame(spark, "qid", [train[0][:32]]), t, 3).collect()
    monkeypatch.setattr(nb, "BROADCAST_ROWS", 10)
    with pytest.raises(ValueError):
        hamming.neighbors(q, t, 3, "broadcast")
    assert found(hamming.neighbors(q, t, 3)) == brute(queries, train, 3)


def test_words_and_chunks(spark):
    text = "1" * 64 + "\r\n" + "01" * 20
    row = spark.createDataFrame([(text,)], "text STRING").select(bitmap_words("text").alias("w"), F.expr("0")).select("w", word_chunks("w").alias("c")).first()
    assert [w & (1 << 64) - 1 for w in row["w"]] == [(1 << 64) - 1, int(("01" * 20).ljust(64, "0"), 2)]
    assert row["c"] == [0xFFFF] * 4 + [0x5555, 0x5555, 0x5500, 0]
