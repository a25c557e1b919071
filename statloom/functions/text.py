"""Tokenising expressions.

``\\w`` is ASCII-only in Java, so an accented letter separates words.  A run of
three or more word characters is exactly what splitting on non-word characters
and dropping short pieces leaves, and one regular expression finds it.  Case is
folded after matching: folding first could turn a non-ASCII letter into an
ASCII one and change where words end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"\w{3,}"
NON_BLANK = r"\S+"


def raw_words(text: Column | str) -> Column:
    """Words of three or more characters, case kept, as an array."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def words(text: Column | str) -> Column:
    """Lower-cased words of three or more characters, as an array."""
    return F.transform(raw_words(text), F.lower)


def blank_separated(text: Column | str) -> Column:
    """Pieces between white space, as an array; punctuation and case stay."""
    return F.regexp_extract_all(text, F.lit(NON_BLANK), F.lit(0))


def counted_words(text: Column | str) -> Column:
    """Distinct lower-cased words with their occurrences, as an array of ``(word, n)``.

    The words are sorted within the row and runs of equal ones are measured.
    """

    def runs(ordered: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        return F.transform(F.array(starts), lambda s: F.transform(s, lambda i, k: F.struct(
            F.get(ordered, i).alias("word"), (F.coalesce(F.get(s, k + 1), F.size(ordered)) - i).cast("bigint").alias("n")
        )))[0]

    found = F.transform(F.array(F.sort_array(words(text))), runs)[0]
    return F.when(F.size(words(text)) > 0, found)


def explode_words(docs: DataFrame, *keep: str, text: str = "text", distinct: bool = False) -> DataFrame:
    """One row per word occurrence, or per distinct word of a document.

    Distinct words are found inside the row, so neither form shuffles.
    """
    if distinct:
        return docs.select(*keep, F.explode(F.array_distinct(words(text))).alias("word"))
    return docs.select(*keep, F.explode(raw_words(text)).alias("word")).withColumn("word", F.lower("word"))
