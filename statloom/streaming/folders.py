"""Folders of whole text files, read as their files arrive, with a manifest of what was read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from statloom.operators.split import labelled_union
from statloom.sources.files import bitmaps_of

#: One row per file that was read: its size in bytes, digest of its text, time of change and the batch that read it.
MANIFEST_SCHEMA = "path STRING, size BIGINT, sha256 STRING, arrived TIMESTAMP, run STRING, batch_id BIGINT"


def text_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """One row ``(path, text, arrived)`` per file of a folder, as a stream."""
    files = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder, wholetext=True)
    return files.select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("arrived")
    )


def labelled_stream(spark: SparkSession, positive: str, negative: str, files_per_batch: int = 1000) -> DataFrame:
    """Files of two folders as ``(path, text, arrived, label)`` with labels 1 and 0, as one stream."""
    return labelled_union(text_stream(spark, positive, files_per_batch), text_stream(spark, negative, files_per_batch), "label", (1, 0))


def gather(files: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Start adding arriving ``files(path, text, arrived, ...)`` to the table at ``out``; returns the query.

    A file is read once, by its path: what the manifest names is left out, also
    when the checkpoint was lost and the stream begins anew.  A batch writes its
    files first and their manifest last, each to a folder of its own run and
    number, so a batch delivered again replaces itself; files of a batch that
    never reached the manifest do not count (see :func:`gathered`) and are read
    again.  A file that changes after it was read is not read again.  Empty
    files hold no row, as in every reader of text; files of the same text are separate rows.
    """
    spark = files.sparkSession
    columns = files.columns

    def write(batch: DataFrame, batch_id: int) -> None:
        # The checkpoint's own id, the same for all starts from it.
        run = spark.read.json(f"{checkpoint}/metadata").first()["id"]
        place = f"run={run}/batch_id={batch_id}"
        earlier = manifest(spark, out).where((F.col("run") != run) | (F.col("batch_id") != batch_id)).select("path")
        batch.join(earlier, "path", "left_anti").select(columns).write.mode("overwrite").parquet(f"{out}/files/{place}")
        kept = spark.read.schema(batch.schema).parquet(f"{out}/files/{place}")
        entries = kept.select("path", F.octet_length("text").cast("bigint").alias("size"), F.sha2("text", 256).alias("sha256"), "arrived")
        entries.write.mode("overwrite").parquet(f"{out}/manifest/{place}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table of batches; without any batch it is empty."""
    to_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = to_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(to_path)
    return spark.read.schema(schema).parquet(path) if exists else spark.createDataFrame([], schema)


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """The files read so far; see ``MANIFEST_SCHEMA``."""
    return _read(spark, f"{out}/manifest", MANIFEST_SCHEMA)


def gathered(spark: SparkSession, out: str, schema: str = "path STRING, text STRING, arrived TIMESTAMP") -> DataFrame:
    """The files that :func:`gather` has read, by the columns in ``schema``; only batches that the manifest holds."""
    rows = _read(spark, f"{out}/files", f"{schema}, run STRING, batch_id BIGINT")
    batches = manifest(spark, out).select("run", "batch_id").distinct()
    return rows.join(batches, ["run", "batch_id"], "left_semi").drop("run", "batch_id")


def gathered_bitmaps(spark: SparkSession, out: str, width: int = 32) -> DataFrame:
    """Bitmaps ``<digit>_<n>.txt`` among the files read, as :func:`statloom.sources.files.bitmap_folder` gives them."""
    named = gathered(spark, out).select(F.element_at(F.split("path", "/"), -1).alias("file"), "text")
    return bitmaps_of(named, width)
