import random

import pytest

from statloom.operators import lookup, words
from statloom.plans import catalog
from statloom.operators.lookup import lookup_join


def test_vocabulary_and_counts(posts):
    vocabulary = {r[0] for r in words.vocabulary(posts).collect()}
    assert "dog" in vocabulary and "my" not in vocabulary
    counts = dict(words.word_counts(posts).collect())
    assert set(counts) == vocabulary and counts["dog"] == 3 and counts["stupid"] == 3


def test_top_words_break_ties_by_word(posts):
    top = words.top_words(words.word_counts(posts), 4).collect()
    assert [tuple(r) for r in top] == [("dog", 3), ("him", 3), ("stupid", 3), ("stop", 2)]
    rest = words.without_words(words.word_counts(posts), words.top_words(words.word_counts(posts), 4))
    assert {"dog", "him", "stupid", "stop"}.isdisjoint(r["word"] for r in rest.collect())


def test_bag_and_set(spark):
    docs = spark.createDataFrame([(1, "red red blue"), (2, "of it"), (3, "Blue")], "doc_id BIGINT, text STRING")
    assert sorted(words.bag_of_words(docs).collect()) == [(1, "blue", 1), (1, "red", 2), (3, "blue", 1)]
    assert sorted(words.set_of_words(docs).collect()) == [(1, "blue", 1), (1, "red", 1), (3, "blue", 1)]


def test_vocabulary_joins(spark, posts):
    docs = spark.createDataFrame([(1, "stupid zebra zebra dog")], "doc_id BIGINT, text STRING")
    counts = words.word_counts(posts)
    known = words.in_vocabulary(words.bag_of_words(docs), counts)
    assert sorted(known.collect()) == [(1, "dog", 1), (1, "stupid", 1)]
    assert [tuple(r) for r in words.out_of_vocabulary(docs, words.vocabulary(posts)).collect()] == [("zebra", 2)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_lookup_join_with_hot_keys_equals_plain_join(spark, how):
    rng = random.Random(1)
    keys = ["hot"] * 300 + [f"k{rng.randrange(80)}" for _ in range(600)]
    left = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id INT, key STRING")
    table = {k: keys.count(k) for k in {*keys} if k != "k7"}
    right = spark.createDataFrame([(k, n, n * 10) for k, n in table.items()], "key STRING, n INT, v INT")
    columns = ["id", "key"] if how == "left_semi" else ["id", "key", "n", "v"]
    plain = sorted(left.join(right, "key", how).select(columns).collect(), key=str)
    assert sorted(lookup_join(left, right, "key", "n", how).collect(), key=str) == plain
    split = lookup_join(left, right, "key", "n", how, broadcast_bytes=0, hot_keys=10)
    assert sorted(split.collect(), key=str) == plain
    # The left side once; the table for its hot keys and for the join.
    assert split._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 3


def test_bag_of_words_adds_up_before_the_shuffle(spark):
    docs = spark.createDataFrame([(1, "Red red blue"), (2, None), (3, ""), (4, "an if"), (5, "two two two")], "doc_id BIGINT, text STRING")
    bag = words.bag_of_words(docs)
    assert sorted(bag.collect()) == [(1, "blue", 1), (1, "red", 2), (5, "two", 3)]
    plan = words.bag_of_words(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_count" in plan[plan.index("Exchange") :]
    # Documents that lie by id are not moved again.
    assert words.bag_of_words(docs.repartition(4, "doc_id"))._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_words_move_once_per_task_where_the_vocabulary_is_large(spark, posts, monkeypatch):
    docs = spark.createDataFrame([(i % 7 if i % 5 else None, "stupid zebra dog dog") for i in range(40)], "doc_id BIGINT, text STRING")
    rows, counts = words.bag_of_words(docs).union(words.set_of_words(docs)), words.word_counts(posts)
    want = sorted(words.in_vocabulary(rows, counts).collect(), key=str)
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 0)
    found = words.in_vocabulary(rows, counts)
    assert found.columns == rows.columns and sorted(found.collect(), key=str) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    moved = plan[plan.index("SortMergeJoin") :]
    assert "partial_collect_list" in moved and moved.index("Exchange") < moved.index("partial_collect_list")


def test_bags_move_texts_in_place_of_words(spark, tmp_path):
    spark.createDataFrame([(1, "red red blue"), (1, "blue"), (2, None)], "doc_id BIGINT, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0)], "doc_id BIGINT, toxic INT").write.parquet(f"{tmp_path}/labels.parquet")
    bag = catalog.bag_of_words(spark, str(tmp_path))
    plan = bag._jdf.queryExecution().executedPlan().toString()
    assert sorted(bag.collect()) == [(1, "blue", 2), (1, "red", 2)]
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Exchange hashpartitioning") > plan.index("Generate explode")
