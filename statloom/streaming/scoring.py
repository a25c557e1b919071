"""Learn from documents, and score them, as their files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from statloom.operators.naive_bayes import NaiveBayesModel, measured_model, score, statistics
from statloom.partitioning import spread


def document_stream(
    spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_batch: int = 1000
) -> DataFrame:
    """Parquet files of a folder as a stream, with the time that each file ``arrived``."""
    files = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )
    return files.withColumn("arrived", F.col("_metadata.file_modification_time"))


def score_stream(
    docs: DataFrame, model: NaiveBayesModel, out: str, checkpoint: str, doc_id: str = "doc_id",
    trigger: dict | None = None, once: tuple[str, str] | None = None, **options,
) -> StreamingQuery:
    """Start scoring a document stream into ``out``; returns the streaming query.

    Without ``trigger`` the files there are now are scored and the query ends;
    ``{"processingTime": "1 minute"}`` keeps it waiting for more.

    A document is scored within its batch, and each batch replaces its own
    folder: a batch delivered again leaves the same result.  No state is kept,
    unless ``once`` names a column of times and a delay, such as ``("arrived",
    "1 day")``: then a document whose id was scored already, up to that long
    before, is dropped, and the ids of that time are kept in the state store.
    The model is measured once, at the start.
    """
    measured = measured_model(model)
    if once:
        docs = docs.withWatermark(*once).dropDuplicatesWithinWatermark([doc_id])

    def write(batch: DataFrame, batch_id: int) -> None:
        scored = score(spread(batch, doc_id), model, doc_id, measured=measured, **options)
        scored.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (
        docs.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def scored_documents(spark: SparkSession, out: str, schema) -> DataFrame:
    """All scores written so far, with their ``batch_id``."""
    return spark.read.schema(schema).parquet(out)


def train_stream(docs: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, **options) -> StreamingQuery:
    """Start adding the statistics of arriving ``docs(text, label, is_test)`` to those saved at ``path``; returns the query.

    ``naive_bayes.from_statistics(Statistics.load(spark, path))`` is the model of
    all that has arrived.  A batch that is delivered again is not counted again:
    its number is saved with the sums.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        statistics(batch, batch=batch_id, **options).add_to(path)

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
