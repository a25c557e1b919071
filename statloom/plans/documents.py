"""Document classification from raw text to an error report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.operators import naive_bayes
from statloom.operators.evaluate import error_rate, misclassified_rows
from statloom.operators.naive_bayes import NaiveBayesModel
from statloom.operators.split import counted_holdout
from statloom.sources.feeds import paired_feeds


@dataclass(frozen=True)
class Evaluation:
    model: NaiveBayesModel
    scored: DataFrame
    report: DataFrame
    errors: DataFrame


def evaluate(split: DataFrame, doc_id: str = "doc_id", bag: bool = True, drop_top: int = 0) -> Evaluation:
    """Train on the rows without ``is_test``, score and report the others."""
    model = naive_bayes.train(split, bag=bag, drop_top=drop_top)
    scored = naive_bayes.score(split.where("is_test"), model, doc_id, bag=bag, keep=("label",))
    return Evaluation(model, scored, error_rate(scored), misclassified_rows(scored))


def classify_documents(train: DataFrame, entries: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Set-of-words model of all of ``train``, applied to ``entries``."""
    model = naive_bayes.train(train.withColumn("is_test", F.lit(False)), bag=False)
    return naive_bayes.score(entries, model, doc_id, bag=False)


def spam_evaluation(mails: DataFrame, doc_id: str = "doc_id", n_test: int = 10, seed: int = 42) -> Evaluation:
    """Bag-of-words spam filter with ``n_test`` mails held out."""
    return evaluate(counted_holdout(mails, doc_id, n_test, seed), doc_id)


def feed_evaluation(
    docs: DataFrame, positive: str, negative: str, n_test: int = 20, drop_top: int = 30, seed: int = 42
) -> Evaluation:
    """Tell two feeds apart by their words, without the most frequent ones."""
    entries = paired_feeds(docs, positive, negative)
    return evaluate(counted_holdout(entries, "doc_id", n_test, seed), drop_top=drop_top)
