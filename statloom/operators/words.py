"""Vocabularies and word vectors as long rows ``(doc_id, word, n)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.text import explode_words
from statloom.operators import lookup
from statloom.operators.lookup import lookup_join, measure


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct words; repeats are removed before the shuffle."""
    return explode_words(docs, text=text).distinct()


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Occurrences per word, pre-aggregated before the shuffle."""
    return explode_words(docs, text=text).groupBy("word").agg(F.count("*").alias("n"))


def top_words(counts: DataFrame, k: int = 30) -> DataFrame:
    """The ``k`` most frequent words, ties in word order."""
    return counts.orderBy(F.desc("n"), "word").limit(k)


def without_words(table: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of ``table`` whose word is not in ``dropped``; Spark broadcasts a short list."""
    return table.join(dropped.select("word"), "word", "left_anti")


def bag_of_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Occurrences per document and word, added up before any shuffle; ids are unique."""
    return explode_words(docs, doc_id, text=text).groupBy(doc_id, "word").agg(F.count("*").alias("n"))


def set_of_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Words present in a document, ``n`` = 1; found within the row, no shuffle."""
    rows = explode_words(docs, doc_id, text=text, distinct=True)
    return rows.withColumn("n", F.lit(1).cast("bigint"))


def in_vocabulary(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Word rows whose word is in the vocabulary ``counts(word, n)``.

    Where the vocabulary is too large to broadcast, the rows of a task with one
    word are shuffled together: a word moves once per task, not once per document.
    """
    measured = measure(counts, "n")
    if measured[0] <= lookup.BROADCAST_BYTES:
        return lookup_join(rows, counts, "word", "n", how="left_semi", measured=measured)
    others = [c for c in rows.columns if c != "word"]
    listed = rows.withColumn("_task", F.spark_partition_id())
    return lookup_join(listed, counts, "word", "n", how="left_semi", measured=measured, gathered=others, salt_by="_task").select(rows.columns)


def out_of_vocabulary(docs: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """Words of ``docs`` missing from ``known``, with their occurrences.

    Counting first leaves one row per word on either side of the anti join.
    """
    return word_counts(docs, text).join(known.select("word"), "word", "left_anti")
