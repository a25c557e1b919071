"""Nearest-neighbour evaluations on scaled features, vectors and bitmaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.labels import decode_label
from statloom.functions.vectors import minmax_scaled
from statloom.operators import hamming
from statloom.operators.evaluate import error_rate
from statloom.operators.neighbors import classify, vote
from statloom.operators.scaling import minmax_stats
from statloom.operators.split import positional_holdout


def scaled_vector(stats: DataFrame, features: Sequence[str]) -> Column:
    """Raw features as one scaled array.

    A column that is constant adds no distance.  A missing value stays missing,
    so that its row has no neighbours and is none.
    """
    row = stats.first()

    def entry(name: str) -> Column:
        scaled = minmax_scaled(F.col(name).cast("double"), row[f"{name}_min"], row[f"{name}_max"])
        return F.when(F.col(name).isNotNull(), F.coalesce(scaled, F.lit(0.0)))

    return F.array(*[entry(f) for f in features])


def _queries(rows: DataFrame, key: str, x: Column) -> DataFrame:
    return rows.select(F.col(key).alias("qid"), x.alias("x"))


def _points(rows: DataFrame, key: str, x: Column, label: str) -> DataFrame:
    return rows.select(F.col(key).alias("tid"), x.alias("x"), F.col(label).alias("label"))


def predict_holdout(split: DataFrame, key: str, x: Column, label: str = "label", k: int = 3, **options) -> DataFrame:
    """``(key, label, predicted)`` for the ``is_test`` rows, from all others."""
    test = split.where("is_test")
    found = classify(_queries(test, key, x), _points(split.where(~F.col("is_test")), key, x, label), k, **options)
    return test.select(key, label).join(found.withColumnRenamed("qid", key), key, "left")


def scaled_evaluation(
    rows: DataFrame, features: Sequence[str], key: str, label: str = "label", ratio: float = 0.5, k: int = 3,
    fit_on: str = "all", **options,
) -> DataFrame:
    """Error rate on the first ``ratio`` of the rows, scaled by all or only training rows."""
    split = positional_holdout(rows, key, ratio)
    base = split if fit_on == "all" else split.where(~F.col("is_test"))
    x = scaled_vector(minmax_stats(base, features), features)
    return error_rate(predict_holdout(split, key, x, label, k, **options), label)


def classify_new(
    new: DataFrame, known: DataFrame, features: Sequence[str], new_key: str, key: str, label: str,
    names: Sequence[str], k: int = 3, **options,
) -> DataFrame:
    """Name the class of new rows, scaled by the stored statistics of the known ones."""
    x = scaled_vector(minmax_stats(known, features), features)
    found = classify(_queries(new, new_key, x), _points(known, key, x, label), k, **options)
    return found.select(F.col("qid").alias(new_key), "predicted", decode_label("predicted", names).alias("answer"))


def bitmap_evaluation(train: DataFrame, test: DataFrame, key: str = "file", k: int = 3, **options) -> DataFrame:
    """Error rate of ``test`` bitmaps ``(key, words, n_bits, label)`` against ``train``, compared by differing bits."""
    queries = test.select(F.col(key).alias("qid"), "words", "n_bits")
    points = train.select(F.col(key).alias("tid"), "words", "n_bits", "label")
    found = vote(hamming.neighbors(queries, points, k, **options))
    return error_rate(test.select(key, "label").join(found.withColumnRenamed("qid", key), key, "left"))
