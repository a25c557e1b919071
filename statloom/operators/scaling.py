"""Min-max statistics and scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.vectors import minmax_scaled


def minmax_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row ``<column>_min, <column>_max`` per column, from a single pass."""
    bounds = [f(c).cast("double").alias(f"{c}_{n}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    return df.agg(*bounds)


def minmax_table(stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The statistics with one row per column: minimum, maximum, range."""
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                (F.col(f"{c}_min") + 0.0).alias("min_value"),
                (F.col(f"{c}_max") + 0.0).alias("max_value"),
                (F.col(f"{c}_max") - F.col(f"{c}_min")).alias("range_value"),
            )
            for c in columns
        ]
    )
    return stats.select(F.inline(rows))


def minmax_apply(df: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace ``columns`` by their scaled values, also on rows not used for ``stats``."""
    row = stats.first()
    scaled = {c: minmax_scaled(F.col(c).cast("double"), row[f"{c}_min"], row[f"{c}_max"]) for c in columns}
    return df.withColumns(scaled)
