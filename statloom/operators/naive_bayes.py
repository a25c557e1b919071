"""Two-class naive Bayes over word counts.

``log_pc(word) = ln((1 + n_c(word)) / (base + total of n_c))``: the vocabulary
holds the words of all documents, counts come from training documents only, and
``base`` is 2 (``plus2``) or the vocabulary size (``vocab``).  Class 0 is
everything that is not labelled 1, also rows without a label.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom import schemas
from statloom.functions.text import counted_words, explode_words, raw_words, words as text_words
from statloom.operators import lookup
from statloom.operators.lookup import lookup_join, measure
from statloom.operators.words import top_words, without_words
from statloom.storage import current_version, literal_table, materialize, save_version


@dataclass(frozen=True)
class NaiveBayesModel:
    """``words`` as in WORD_MODEL_SCHEMA, ``prior`` one row as in PRIOR_SCHEMA."""

    words: DataFrame
    prior: DataFrame

    def save(self, path: str) -> None:
        """Save as a new version of ``path``; both tables appear together."""
        save_version(path, {"words": self.words, "prior": self.prior})

    @staticmethod
    def load(spark: SparkSession, path: str) -> NaiveBayesModel:
        version = current_version(spark, path)
        return NaiveBayesModel(
            spark.read.schema(schemas.WORD_MODEL_SCHEMA).parquet(f"{version}/words"),
            spark.read.schema(schemas.PRIOR_SCHEMA).parquet(f"{version}/prior"),
        )


@dataclass(frozen=True)
class Statistics:
    """What training needs of documents; statistics of two sets of documents add up.

    ``words`` has ``(word, n_seen, n1, n0)``, ``docs`` one row ``(n_docs, n_pos,
    last_batch)``: training documents, those labelled 1, and the last batch of a
    stream that is in (or null).
    """

    words: DataFrame
    docs: DataFrame

    def merged(self, other: Statistics) -> Statistics:
        counts = ("n_seen", "n1", "n0")
        words = self.words.unionByName(other.words).groupBy("word").agg(*(F.sum(c).alias(c) for c in counts))
        totals = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_docs", "n_pos")]
        return Statistics(words, self.docs.unionByName(other.docs).agg(*totals, F.max("last_batch").alias("last_batch")))

    def save(self, path: str) -> None:
        """Save as a new version of ``path``; it may be made of the version before."""
        save_version(path, {"words": self.words, "docs": self.docs})

    @staticmethod
    def load(spark: SparkSession, path: str) -> Statistics:
        version = current_version(spark, path)
        return Statistics(
            spark.read.schema(schemas.WORD_COUNTS_SCHEMA).parquet(f"{version}/words"),
            spark.read.schema(schemas.DOC_COUNTS_SCHEMA).parquet(f"{version}/docs"),
        )

    def add_to(self, path: str) -> Statistics:
        """Merge into what ``path`` holds, if anything, and return the sum as saved.

        Statistics of a batch that is in already, by its number, are not added again.
        """
        spark = self.words.sparkSession
        try:
            known = Statistics.load(spark, path)
        except FileNotFoundError:
            self.save(path)
            return Statistics.load(spark, path)
        last, batch = known.docs.first()["last_batch"], self.docs.first()["last_batch"]
        if batch is None or last is None or batch > last:
            known.merged(self).save(path)
        return Statistics.load(spark, path)


def class_counts(words: DataFrame) -> DataFrame:
    """Per word: all occurrences, and those in training documents by class.

    ``words`` has one row per occurrence with ``word``, ``label``, ``is_test``.
    One pass gives vocabulary and counts; frequent words shrink before the
    shuffle.
    """
    train = ~F.col("is_test")
    return words.groupBy("word").agg(
        F.count("*").alias("n_seen"),
        F.count_if(train & (F.col("label") == 1)).alias("n1"),
        F.count_if(train & ~F.col("label").eqNullSafe(1)).alias("n0"),
    )


def train(
    docs: DataFrame,
    words: DataFrame | None = None,
    text: str = "text",
    bag: bool = True,
    denominator: str = "plus2",
    drop_top: int = 0,
) -> NaiveBayesModel:
    """Train on ``docs(text, label, is_test)``; rows with ``is_test`` only add vocabulary.

    ``bag`` counts every occurrence, otherwise a word counts once per document.
    ``drop_top`` removes the most frequent words from the vocabulary first.
    ``words`` may bring ready word rows instead of text.
    """
    return from_statistics(statistics(docs, words, text, bag), denominator, drop_top)


def statistics(
    docs: DataFrame, words: DataFrame | None = None, text: str = "text", bag: bool = True, batch: int | None = None
) -> Statistics:
    """Statistics of ``docs(text, label, is_test)``, of which those of other documents may be added; see :func:`train`."""
    if words is None:
        words = explode_words(docs, "label", "is_test", text=text, distinct=not bag)
    counts = materialize(class_counts(words), "word-counts")
    n_docs, n_pos = docs.where(~F.col("is_test")).agg(F.count("*"), F.count_if(F.col("label") == 1)).first()
    return Statistics(counts, literal_table(docs.sparkSession, [(n_docs, n_pos, batch)], schemas.DOC_COUNTS_SCHEMA))


def from_statistics(known: Statistics, denominator: str = "plus2", drop_top: int = 0) -> NaiveBayesModel:
    """The model of all documents whose statistics were added up."""
    if denominator not in ("plus2", "vocab"):
        raise ValueError(f"unknown denominator: {denominator}")
    counts = known.words
    if drop_top:
        frequent = top_words(counts.select("word", F.col("n_seen").alias("n")), drop_top)
        counts = without_words(counts, frequent)
    mass1, mass0, size = counts.agg(
        F.coalesce(F.sum("n1"), F.lit(0)), F.coalesce(F.sum("n0"), F.lit(0)), F.count("*")
    ).first()
    base = 2.0 if denominator == "plus2" else float(size)
    den1, den0 = base + mass1, base + mass0
    n_docs, n_pos = known.docs.select("n_docs", "n_pos").first()
    p1 = n_pos / n_docs if n_docs else None
    prior = literal_table(counts.sparkSession, [(n_docs, p1, den1, den0)], schemas.PRIOR_SCHEMA)
    model = counts.select(
        "word",
        "n_seen",
        "n1",
        "n0",
        F.ln((1 + F.col("n1")) / F.lit(den1)).alias("log_p1"),
        F.ln((1 + F.col("n0")) / F.lit(den0)).alias("log_p0"),
    )
    return NaiveBayesModel(model, prior)


def _log_prior(p: float | None) -> Column:
    if p is None:
        return F.lit(None).cast("double")
    return F.lit(math.log(p) if p > 0 else -math.inf)


@dataclass(frozen=True)
class Measured:
    """Size and weight of a model's word table, and its prior."""

    table: tuple[int, int]
    p1: float | None


def measured_model(model: NaiveBayesModel) -> Measured:
    table = model.words.select("word", "n_seen", "log_p1", "log_p0")
    return Measured(measure(table, "n_seen"), model.prior.first()["p1"])


def _once(word: Column) -> Column:
    return F.struct(word.alias("word"), F.lit(1).cast("bigint").alias("n"))


def score(
    docs: DataFrame,
    model: NaiveBayesModel,
    doc_id: str = "doc_id",
    text: str = "text",
    bag: bool = True,
    keep: tuple[str, ...] = (),
    words: DataFrame | None = None,
    broadcast_bytes: int | None = None,
    measured: Measured | None = None,
) -> DataFrame:
    """``score1``, ``score0`` and ``predicted`` for each document; ids are unique.

    Words are looked up and summed: the documents are read once.  Where the model
    is broadcast, every occurrence meets it where it is and only partial sums
    move; otherwise words are counted within the row, and one row per document
    and distinct word moves.  Words outside
    the vocabulary drop out; a document left without words still gets the prior.
    ``words`` may bring ready rows ``(doc_id, word)`` instead of text, and
    ``measured`` what :func:`measured_model` found, for many calls with one model.
    """
    measured = measured or measured_model(model)
    limit = lookup.BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    if words is None and bag and measured.table[0] <= limit:
        found = docs.select(doc_id, *keep, F.explode_outer(raw_words(text)).alias("word"))
        rows = found.withColumns({"word": F.lower("word"), "n": F.lit(1).cast("bigint")})
    elif words is None:
        listed = counted_words(text) if bag else F.transform(F.array_distinct(text_words(text)), _once)
        rows = docs.select(doc_id, *keep, F.inline_outer(listed))
    else:
        counts = words.groupBy(doc_id, "word").agg(F.count("*").alias("n"))
        rows = docs.select(doc_id, *keep).join(counts, doc_id, "left")
    table = model.words.select("word", "n_seen", "log_p1", "log_p0")
    known = lookup_join(rows, table, "word", "n_seen", "left", broadcast_bytes, measured=measured.table)
    kept = [F.first(c).alias(c) for c in keep]
    sums = known.groupBy(doc_id).agg(
        *kept, F.sum(F.col("n") * F.col("log_p1")).alias("sum1"), F.sum(F.col("n") * F.col("log_p0")).alias("sum0")
    )
    p1 = measured.p1
    score1 = F.coalesce("sum1", F.lit(0.0)) + _log_prior(p1)
    score0 = F.coalesce("sum0", F.lit(0.0)) + _log_prior(None if p1 is None else 1.0 - p1)
    return sums.select(
        doc_id,
        *keep,
        score1.alias("score1"),
        score0.alias("score0"),
        F.when(score1 > score0, 1).otherwise(0).alias("predicted"),
    )


def telling_words(model: NaiveBayesModel, above: float = -6.0) -> DataFrame:
    """Words with ``log_p > above`` by class, most likely first."""
    long = model.words.unpivot("word", ["log_p1", "log_p0"], "side", "log_p")
    return (
        long.where(F.col("log_p") > above)
        .select(F.substring("side", 6, 1).cast("int").alias("label"), "word", "log_p")
        .orderBy("label", F.desc("log_p"), "word")
    )
