"""Entropy, information gain, best split and majority label.

Entropies come from counts only: with ``s = sum(n * log2(n))`` over the label
counts of a group of ``t`` rows, ``t * H = t * log2(t) - s``, so every step is a
plain sum that is pre-aggregated before its shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions import sql

MIN_GAIN = 1e-9
WHOLE = -1


def _n_log_n(n: str) -> Column:
    return F.col(n) * F.log2(n)


def entropy(df: DataFrame, label: str = "label") -> DataFrame:
    """Shannon entropy of a column in bits, with the row count."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    sums = counts.agg(F.sum("n").alias("n_rows"), F.sum(_n_log_n("n")).alias("s"))
    return sums.select("n_rows", F.greatest(F.log2("n_rows") - F.col("s") / F.col("n_rows"), F.lit(0.0)).alias("entropy"))


def majority_label(df: DataFrame, group: str, label: str = "label") -> DataFrame:
    """Most frequent label per group, ties to the smaller label."""
    counts = df.groupBy(group, label).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("minus_n"), F.col(label)))
    return counts.groupBy(group).agg(best.alias("best")).select(
        group, F.col(f"best.{label}").alias(label), (-F.col("best.minus_n")).alias("n")
    )


def split_scores(rows: DataFrame, features: Sequence[str], node: str = "node_id") -> DataFrame:
    """Score every feature at every node in one pass.

    ``rows`` has ``node``, the features, ``label`` and a row weight ``n``.
    Result per node: ``n_rows``, ``m`` (input rows), ``label`` (majority),
    ``n_labels``, ``base_entropy`` and ``gains``, an array with one struct
    ``(idx, n_values, conditional_entropy, gain)`` per feature.
    """
    numbered = [(i, sql.name(f)) for i, f in enumerate(features)]
    choices = [f"struct({WHOLE} AS idx, CAST(NULL AS STRING) AS value)"]
    choices += [f"struct({i} AS idx, CAST({f} AS STRING) AS value)" for i, f in numbered]
    counts = (
        rows.select(node, "label", "n", F.expr(f"inline(array({', '.join(choices)}))"))
        .groupBy(node, "idx", "value", "label")
        .agg(F.expr("sum(n) AS n"), F.expr("count(*) AS m"))
    )
    per_value = counts.groupBy(node, "idx", "value").agg(
        F.expr("sum(n) AS t"),
        F.expr("sum(m) AS m"),
        F.expr("sum(n * log2(n)) AS s"),
        F.expr("min(struct(-n AS minus_n, label)) AS best"),
        F.expr("count(*) AS n_labels"),
    )
    per_node = per_value.groupBy(node).agg(
        *[
            F.expr(f"{total} FILTER (WHERE idx = {WHOLE}) AS {alias}")
            for total, alias in (
                ("sum(t)", "n_rows"), ("sum(m)", "m"), ("min(best)", "best"), ("max(n_labels)", "n_labels"),
                ("sum(t * log2(t) - s)", "base"),
            )
        ],
        *[F.expr(f"count(*) FILTER (WHERE idx = {i}) AS values{i}") for i, _ in numbered],
        *[F.expr(f"sum(t * log2(t) - s) FILTER (WHERE idx = {i}) AS bits{i}") for i, _ in numbered],
    )
    gains = [
        f"struct({i} AS idx, values{i} AS n_values, bits{i} / n_rows AS conditional_entropy, "
        f"greatest((base - bits{i}) / n_rows, 0D) AS gain)"
        for i, _ in numbered
    ]
    return per_node.selectExpr(
        node, "n_rows", "m", "best.label AS label", "n_labels", "base / n_rows AS base_entropy",
        f"array({', '.join(gains)}) AS gains",
    )


def information_gain(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """Gain and conditional entropy of ``label`` for each feature."""
    columns = [F.col(sql.name(f)).alias(f"_f{i}") for i, f in enumerate(features)]
    one = F.lit(1).cast("bigint").alias("n")
    rows = df.select(F.lit("/").alias("node_id"), *columns, F.col(sql.name(label)).alias("label"), one)
    names = F.array(*[F.lit(f) for f in features])
    return (
        split_scores(rows, [f"_f{i}" for i in range(len(features))])
        .select("n_rows", "base_entropy", F.inline("gains"))
        .select(
            "idx",
            F.get(names, F.col("idx")).alias("feature"),
            "n_rows",
            "base_entropy",
            "conditional_entropy",
            "gain",
        )
    )


def best_split(gains: DataFrame) -> DataFrame:
    """The feature with the highest gain, the first one on ties, none without gain."""
    return (
        gains.where(F.round("gain", 9) > MIN_GAIN)
        .orderBy(F.desc(F.round("gain", 9)), "idx")
        .limit(1)
        .select("feature", "gain")
    )


def split_rows(df: DataFrame, feature: str, value) -> DataFrame:
    """Rows where ``feature`` has ``value``, without that column."""
    return df.where(F.col(feature) == F.lit(value)).drop(feature)
