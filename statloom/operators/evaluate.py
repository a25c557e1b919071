"""Error reports over scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _wrong(label: str, predicted: str):
    return ~F.col(label).eqNullSafe(F.col(predicted))


def error_rate(scored: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Rows, errors and their ratio; NULL ratio when there is no row."""
    counts = scored.agg(
        F.count("*").alias("n_rows"), F.count_if(_wrong(label, predicted)).alias("errors")
    )
    return counts.withColumn("error_rate", F.try_divide(F.col("errors").cast("double"), F.col("n_rows")))


def misclassified_rows(scored: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    return scored.where(_wrong(label, predicted))


def confusion(scored: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    return scored.groupBy(label, predicted).agg(F.count("*").alias("n"))
