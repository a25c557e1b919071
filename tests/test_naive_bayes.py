import math
import re

import pytest
from pyspark.sql import functions as F

from statloom.operators import naive_bayes as nb
from statloom.operators.evaluate import confusion, error_rate, misclassified_rows
from statloom.partitioning import spread
from statloom.plans.documents import classify_documents, feed_evaluation, spam_evaluation
from tests.conftest import POSTS


def train_all(docs, **options):
    return nb.train(docs.withColumn("is_test", F.lit(False)), **options)


def expected_model(rows, bag=True, base=2.0):
    """Plain Python: rows of (text, label, is_test)."""
    tokens = [[w.lower() for w in re.findall(r"[A-Za-z0-9_]{3,}", text)] for text, _, _ in rows]
    if not bag:
        tokens = [sorted(set(t)) for t in tokens]
    vocabulary = {w for t in tokens for w in t}
    base = len(vocabulary) if base is None else base
    out = {}
    for label in (1, 0):
        mine = [w for t, (_, y, held) in zip(tokens, rows) if not held and (y == 1) == (label == 1) for w in t]
        out[label] = {w: math.log((1 + mine.count(w)) / (base + len(mine))) for w in vocabulary}
    return out


def test_toy_posts_with_ready_words(spark):
    """Known values for the posts taken as ready token lists, short words kept."""
    docs = spark.createDataFrame([(y, False) for _, y in POSTS], "label INT, is_test BOOLEAN")
    rows = [(w, y, False) for text, y in POSTS for w in set(text.split())]
    model = nb.train(docs, words=spark.createDataFrame(rows, "word STRING, label INT, is_test BOOLEAN"))
    table = {r["word"]: r for r in model.words.collect()}
    prior = model.prior.first()
    assert len(table) == 32
    assert (prior["den0"], prior["den1"], prior["p1"]) == (26.0, 21.0, 0.5)
    assert table["stupid"]["log_p1"] == pytest.approx(-1.6582280766, abs=1e-9)
    assert table["stupid"]["log_p0"] == pytest.approx(-3.2580965380, abs=1e-9)
    assert table["my"]["log_p0"] == pytest.approx(-1.8718021769, abs=1e-9)
    entries = [(1, "love my dalmation"), (2, "stupid garbage")]
    asked = spark.createDataFrame([(i, w) for i, text in entries for w in text.split()], "doc_id INT, word STRING")
    scored = nb.score(spark.createDataFrame(entries, "doc_id INT, text STRING"), model, words=asked)
    got = {r["doc_id"]: (r["score0"], r["score1"], r["predicted"]) for r in scored.collect()}
    assert got[1] == (pytest.approx(-7.6948480724, abs=1e-9), pytest.approx(-9.8267144937, abs=1e-9), 0)
    assert got[2] == (pytest.approx(-7.2093402566, abs=1e-9), pytest.approx(-4.7027505145, abs=1e-9), 1)


@pytest.mark.parametrize("bag", [True, False])
@pytest.mark.parametrize("denominator", ["plus2", "vocab"])
def test_model_matches_plain_python(spark, posts, bag, denominator):
    split = posts.withColumn("is_test", F.col("doc_id") == 3)
    rows = [(r["text"] + " dog dog", r["label"], r["is_test"]) for r in split.collect()]
    split = split.withColumn("text", F.concat("text", F.lit(" dog dog")))
    model = nb.train(split, bag=bag, denominator=denominator)
    want = expected_model(rows, bag, 2.0 if denominator == "plus2" else None)
    got = model.words.collect()
    assert {r["word"] for r in got} == set(want[1])
    for r in got:
        assert r["log_p1"] == pytest.approx(want[1][r["word"]]) and r["log_p0"] == pytest.approx(want[0][r["word"]])
    assert model.prior.first()["p1"] == pytest.approx(2 / 5)


def test_classify_documents(spark, posts):
    entries = spark.createDataFrame([(1, "love my dalmation"), (2, "stupid garbage"), (3, "zzz yyy")], "doc_id BIGINT, text STRING")
    scored = {r["doc_id"]: r for r in classify_documents(posts, entries).collect()}
    assert scored[1]["predicted"] == 0 and scored[2]["predicted"] == 1
    # No known word: the priors are equal and a tie goes to class 0.
    assert scored[3]["predicted"] == 0
    assert scored[3]["score1"] == pytest.approx(math.log(0.5)) == scored[3]["score0"]


def test_single_class_priors(spark, posts):
    entries = spark.createDataFrame([(1, "stupid"), (2, ""), (3, None)], "doc_id BIGINT, text STRING")
    ones = nb.score(entries, train_all(posts.where("label = 1")))
    assert [(r["predicted"], r["score0"]) for r in ones.collect()] == [(1, -math.inf)] * 3
    zeros = nb.score(entries, train_all(posts.where("label = 0")))
    assert [(r["predicted"], r["score1"]) for r in zeros.collect()] == [(0, -math.inf)] * 3


def test_no_training_documents(spark, posts):
    model = nb.train(posts.withColumn("is_test", F.lit(True)))
    assert model.prior.first()["p1"] is None
    assert [r["predicted"] for r in nb.score(posts, model).collect()] == [0] * 6


def test_hot_words_path_gives_the_same_scores(posts):
    model = train_all(posts)
    small = sorted(nb.score(posts, model, keep=("label",)).collect())
    split = sorted(nb.score(posts, model, keep=("label",), broadcast_bytes=0).collect())
    assert [(r["doc_id"], r["label"], r["predicted"]) for r in small] == [(r["doc_id"], r["label"], r["predicted"]) for r in split]
    for a, b in zip(small, split):
        assert a["score1"] == pytest.approx(b["score1"]) and a["score0"] == pytest.approx(b["score0"])


def test_scores_join_with_scores(posts):
    """Scores of spread documents, read twice in one plan, small and split lookups."""
    docs = spread(posts, "doc_id").repartition(3, "doc_id")
    model = train_all(docs)
    frames = [nb.score(docs, model, broadcast_bytes=size).alias(f"s{size}") for size in (1 << 20, 0)]
    for a in frames:
        for b in (nb.score(docs, model), nb.score(docs, model, broadcast_bytes=0)):
            both = a.join(b.select("doc_id", F.col("score1").alias("other")), "doc_id")
            assert both.where("abs(score1 - other) < 1e-9").count() == both.count() == 6


def test_counts_add_up_over_parts(spark, posts):
    def counts(docs):
        return {r["word"]: (r["n1"], r["n0"]) for r in train_all(docs).words.collect()}

    whole, low, high = counts(posts), counts(posts.where("doc_id < 3")), counts(posts.where("doc_id >= 3"))
    for word, (n1, n0) in whole.items():
        assert (n1, n0) == tuple(a + b for a, b in zip(low.get(word, (0, 0)), high.get(word, (0, 0))))


def test_scores_do_not_depend_on_row_order(posts):
    turned = posts.orderBy(F.desc("doc_id")).repartition(5)
    a, b = (sorted(nb.score(posts, train_all(rows)).collect()) for rows in (posts, turned))
    for left, right in zip(a, b):
        assert tuple(left) == pytest.approx(tuple(right))


def test_save_and_load(spark, posts, tmp_path):
    model = train_all(posts)
    model.save(str(tmp_path / "model"))
    loaded = nb.NaiveBayesModel.load(spark, str(tmp_path / "model"))
    assert sorted(loaded.words.collect()) == sorted(model.words.collect())
    assert loaded.prior.collect() == model.prior.collect()


def test_drop_top_words(posts):
    kept = {r["word"] for r in train_all(posts, drop_top=3).words.collect()}
    assert {"dog", "him", "stupid"}.isdisjoint(kept) and "stop" in kept


def test_spam_evaluation_without_enough_mails(posts):
    result = spam_evaluation(posts)
    report = result.report.first()
    assert report["n_rows"] == 3 and result.errors.count() == report["errors"]


def test_feed_evaluation(spark):
    rows = [(i, "east" if i % 2 else "west", "common word " + ("sunrise" if i % 2 else "sunset")) for i in range(30)]
    rows += [(i, "west", "late entry") for i in range(100, 140)] + [(i, "north", "noise") for i in range(200, 210)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, source STRING, text STRING")
    result = feed_evaluation(docs, "east", "west", n_test=6, drop_top=2)
    words = {r["word"] for r in result.model.words.collect()}
    # The longer feed is cut to its first entries; the two most frequent words are gone.
    assert words == {"sunrise", "sunset"}
    assert tuple(result.report.first()) == (6, 0, 0.0)
    telling = nb.telling_words(result.model, -2.0).collect()
    assert [(r["label"], r["word"]) for r in telling] == [(0, "sunset"), (1, "sunrise")]


def test_reports(spark):
    scored = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, None)], "label INT, predicted INT")
    assert tuple(error_rate(scored).first()) == (4, 2, 0.5)
    assert misclassified_rows(scored).count() == 2
    assert {tuple(r) for r in confusion(scored).collect()} == {(1, 1, 1), (1, 0, 1), (0, 0, 1), (0, None, 1)}
    assert tuple(error_rate(scored.where("label = 9")).first()) == (0, 0, None)


def test_rows_without_a_label_belong_to_class_zero(spark):
    docs = spark.createDataFrame([(1, "cow cow", 0), (2, "cow", 1), (3, "cow cow cow", None)], "doc_id BIGINT, text STRING, label INT")
    model = train_all(docs)
    row = model.words.first()
    assert (row["n1"], row["n0"], model.prior.first()["n_docs"]) == (1, 5, 3)


def test_scoring_reads_the_documents_once(spark, posts):
    model = train_all(posts)
    scored = nb.score(posts, model, keep=("label",), broadcast_bytes=0)
    leaves = [leaf for leaf in str(scored._jdf.queryExecution().optimizedPlan().collectLeaves()).split("LogicalRDD")[1:] if "text" in leaf]
    assert len(leaves) == 1
    # Occurrences are added one by one in one form and by word in the other, so sums may differ in the last digit.
    for a, b in zip(scored.orderBy("doc_id").collect(), nb.score(posts, model, keep=("label",)).orderBy("doc_id").collect(), strict=True):
        assert a[:2] == b[:2] and a["predicted"] == b["predicted"]
        assert (a["score1"], a["score0"]) == pytest.approx((b["score1"], b["score0"]), rel=1e-12)
