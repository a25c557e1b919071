"""Two feeds held in one document table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.operators.split import first_rows


def paired_feeds(docs: DataFrame, positive: str, negative: str, source: str = "source", key: str = "doc_id") -> DataFrame:
    """The first entries of two feeds, as many as the shorter one has, labelled 1 and 0."""
    sizes = dict(docs.where(F.col(source).isin(positive, negative)).groupBy(source).count().collect())
    length = min(sizes.get(positive, 0), sizes.get(negative, 0))
    taken = F.lit(False)
    for name in (positive, negative):
        feed = F.col(source) == name
        whole = sizes.get(name, 0) == length
        taken = taken | (feed if whole else feed & first_rows(docs.where(feed), key, length))
    return docs.where(taken).withColumn("label", F.when(F.col(source) == positive, 1).otherwise(0))
