import pytest
from pyspark.sql import functions as F

from statloom.functions.labels import DATING_CODES, DATING_NAMES, decode_label, encode_label, sign_label
from statloom.functions.text import blank_separated, explode_words, words
from statloom.functions.vectors import (
    bitmap_bits, bitmap_distance, bitmap_rows, components, linear_score, minmax_scaled, misclassified, squared_distance,
)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("The quick-brown fox; is at it", ["the", "quick", "brown", "fox"]),
        ("éclair naïve", ["clair"]),
        ("snake_case 100 a1 x", ["snake_case", "100"]),
        ("Kelvin ABC", ["elvin", "abc"]),
        ("a\r\nbcd\tEFG.hij", ["bcd", "efg", "hij"]),
        ("", []),
        (None, None),
    ],
)
def test_words(spark, text, expected):
    df = spark.createDataFrame([(text,)], "text STRING")
    assert df.select(words("text").alias("w")).first()["w"] == expected


def test_explode_words_counts_or_distinct(spark):
    df = spark.createDataFrame([(1, "Dog dog cat"), (2, ""), (3, None)], "id INT, text STRING")
    assert sorted(explode_words(df, "id").collect()) == [(1, "cat"), (1, "dog"), (1, "dog")]
    assert sorted(explode_words(df, "id", distinct=True).collect()) == [(1, "cat"), (1, "dog")]


def test_blank_separated(spark):
    df = spark.createDataFrame([(" This is  M.L.\tI\n",)], "t STRING")
    assert df.select(blank_separated("t")).first()[0] == ["This", "is", "M.L.", "I"]


def test_labels(spark):
    df = spark.createDataFrame([("3",), ("largeDoses",), ("didntLike",), ("other",), ("-1",), (None,)], "s STRING")
    codes = [r[0] for r in df.select(encode_label("s", DATING_CODES)).collect()]
    assert codes == [3, 3, 1, None, None, None]
    numbers = spark.createDataFrame([(0,), (1,), (3,), (4,), (None,)], "c INT")
    names = [r[0] for r in numbers.select(decode_label("c", DATING_NAMES)).collect()]
    assert names == [None, "not at all", "in large doses", None, None]


def test_sign_of_zero_is_plus(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (2.5,), (-1e-9,), (None,)], "v DOUBLE")
    assert [r[0] for r in df.select(sign_label("v")).collect()] == [1, 1, 1, -1, None]


def test_linear_score_and_misclassified(spark):
    df = spark.createDataFrame([([1.0, 2.0], 1), ([0.0, 0.0], -1)], "x ARRAY<DOUBLE>, y INT")
    xs = components("x", 2)
    rows = df.select(linear_score(xs, [3.0, -1.0], 0.5), misclassified(xs, F.col("y"), [1.0, 1.0], 0.0)).collect()
    assert rows == [(1.5, False), (0.5, True)]


def test_minmax_scaled_constant_is_null(spark):
    df = spark.createDataFrame([(5.0,)], "v DOUBLE")
    assert df.select(minmax_scaled(F.col("v"), 0.0, 20.0), minmax_scaled(F.col("v"), 5.0, 5.0)).first() == (0.25, None)


def test_bitmaps(spark):
    a, b = "0110\r\n1001\r\n", "1110\n0001\n"
    df = spark.createDataFrame([(a, b)], "a STRING, b STRING").select(
        bitmap_bits(F.col("a")).alias("va"), bitmap_bits(F.col("b")).alias("vb"),
        bitmap_rows(F.col("a"), 4).alias("ra"), bitmap_rows(F.col("b"), 4).alias("rb"),
    )
    row = df.select(
        "va", "ra", bitmap_distance("ra", "rb").alias("bits"), squared_distance("va", "vb").alias("d2")
    ).first()
    assert row["va"] == [0, 1, 1, 0, 1, 0, 0, 1]
    assert row["ra"] == [6, 9]
    assert row["bits"] == 2 and row["d2"] == 2.0
