import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statloom.operators import split


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "id BIGINT")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-(2**62), 2**62), min_size=1, max_size=40), st.data())
def test_nth_smallest(spark, values, data):
    n = data.draw(st.integers(1, len(values)))
    assert split.nth_smallest(ids(spark, values), "id", n) == sorted(values)[n - 1]


def test_nth_smallest_full_range_and_coarse_slots(spark, monkeypatch):
    monkeypatch.setattr(split, "FEW_ROWS", 0)
    monkeypatch.setattr(split, "BINS", 4)
    monkeypatch.setattr(split, "SMALL_BRACKET", 0)
    values = [-(2**63), 2**63 - 1, 0, -1, 1, 5, 6, 7, 1000]
    df = ids(spark, values)
    for n in (1, 3, 5, 9):
        assert split.nth_smallest(df, "id", n) == sorted(values)[n - 1]
    assert split.nth_smallest(df, "id", 0) is None


def test_positional_holdout(spark):
    df = ids(spark, [9, 2, 7, 4, 30])
    tested = split.positional_holdout(df, "id", 0.5).where("is_test")
    assert sorted(r["id"] for r in tested.collect()) == [2, 4]
    assert split.positional_holdout(df, "id", 0.1).where("is_test").count() == 0
    assert split.positional_holdout(df, "id", 1.0).where("is_test").count() == 5
    assert split.positional_holdout(df.where("id < 0"), "id", 0.5).count() == 0


def test_rows_without_a_key_come_last(spark):
    df = ids(spark, [5, None, 3, None])
    got = split.positional_holdout(df, "id", 0.5).collect()
    assert sorted(r["id"] for r in got if r["is_test"]) == [3, 5] and all(r["is_test"] is not None for r in got)
    drawn = split.counted_holdout(df, "id", 1).collect()
    assert sum(r["is_test"] for r in drawn) == 1 and all(r["id"] is not None for r in drawn if r["is_test"])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab/é😀", max_size=6), min_size=1, max_size=30), st.data())
def test_nth_smallest_text(spark, values, data):
    n = data.draw(st.integers(1, len(values)))
    df = spark.createDataFrame([(f"file:/in/{v}",) for v in values], "path STRING")
    want = sorted((f"file:/in/{v}" for v in values), key=str.encode)[n - 1]
    assert split.nth_smallest(df, "path", n) == want


def test_holdouts_by_path(spark, monkeypatch):
    names = [f"/mails/spam/{i}.txt" for i in range(25)]
    df = spark.createDataFrame([(n,) for n in names], "path STRING")
    first = split.positional_holdout(df, "path", 0.4).where("is_test")
    assert sorted(r["path"] for r in first.collect()) == sorted(names)[:10]
    for small in (100_000, 0):
        monkeypatch.setattr(split, "SMALL_BRACKET", small)
        first = split.positional_holdout(df, "path", 0.4).where("is_test")
        assert sorted(r["path"] for r in first.collect()) == sorted(names)[:10]
        tested = split.counted_holdout(df, "path", 5).where("is_test")
        assert sorted(r["path"] for r in tested.collect()) == sorted(digest_order(names)[:5])
    with pytest.raises(ValueError, match="integers or text"):
        split.nth_smallest(df.select(F.lit(1.5).alias("x")), "x", 1)


def digest_order(values, seed=42):
    return sorted(values, key=lambda v: (hashlib.md5(f"{seed}:{v}".encode()).hexdigest()[:15], v))


@pytest.mark.parametrize("small", [100_000, 0])
def test_counted_holdout_draws_exactly_n(spark, monkeypatch, small):
    monkeypatch.setattr(split, "SMALL_BRACKET", small)
    df = ids(spark, range(200))
    tested = split.counted_holdout(df, "id", 15).where("is_test")
    assert sorted(r["id"] for r in tested.collect()) == sorted(digest_order(range(200))[:15])


def scanned(spark, df):
    """``df`` with a counter of the rows that jobs read from it."""
    read = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    return df.mapInArrow(pass_on, df.schema), read


@pytest.mark.parametrize("small", [100_000, 0])
def test_a_rank_takes_two_scans(spark, monkeypatch, small):
    monkeypatch.setattr(split, "SMALL_BRACKET", small)
    for keys in (F.expr("(id * 7919) % 100003 * 1000003 - 5000000000"), F.expr("id % 3"), F.concat(F.lit("file:/mails/"), F.sha1(F.col("id").cast("string")))):
        values = spark.range(20_000).select(keys.alias("key"))
        ordered = sorted((r["key"] for r in values.collect()), key=lambda v: v.encode() if isinstance(v, str) else v)
        for n in (1, 777, 10_000, 20_000):
            df, read = scanned(spark, values)
            assert split.nth_smallest(df, "key", n) == ordered[n - 1]
            assert read.value <= 2 * 20_000
    df, read = scanned(spark, spark.range(5000))
    tested = split.counted_holdout(df, "id", 40)
    assert read.value <= 2 * 5000
    assert sorted(r["id"] for r in tested.where("is_test").collect()) == sorted(digest_order(range(5000))[:40])


def test_a_wrong_sketch_does_no_harm(spark, monkeypatch):
    monkeypatch.setattr(split, "_widened", lambda value, sign: value - sign * 5000)
    values = spark.range(20_000).select("id")
    assert split.nth_smallest(values, "id", 12_000) == 11_999


def test_counted_holdout_takes_at_most_half(spark):
    assert split.counted_holdout(ids(spark, range(7)), "id", 20).where("is_test").count() == 3
    assert split.counted_holdout(ids(spark, [1]), "id", 20).where("is_test").count() == 0


def test_drawn(spark):
    df = ids(spark, range(1000))
    some = df.where(split.drawn("id", 0.2)).count()
    assert 140 < some < 260
    assert df.where(split.drawn("id", 0.0)).count() == 0 and df.where(split.drawn("id", 1.0)).count() == 1000
    assert some != df.where(split.drawn("id", 0.2, seed=7) & split.drawn("id", 0.2)).count()


def test_labelled_union(spark):
    union = split.labelled_union(ids(spark, [1]), ids(spark, [2, 3]))
    assert sorted(union.collect()) == [(1, 1), (2, -1), (3, -1)]
    assert union.where(F.col("y") == 1).count() == 1
