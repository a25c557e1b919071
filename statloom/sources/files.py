"""File readers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom import schemas
from statloom.functions.labels import DATING_CODES, encode_label
from statloom.functions.vectors import bitmap_bits, bitmap_rows, bitmap_size, bitmap_words
from statloom.operators.split import labelled_union


def text_folder(spark: SparkSession, folder: str) -> DataFrame:
    """One row ``(path, text)`` per file."""
    files = spark.read.text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def labelled_folders(spark: SparkSession, positive: str, negative: str) -> DataFrame:
    """Files of two folders as ``(path, text, label)`` with labels 1 and 0."""
    return labelled_union(text_folder(spark, positive), text_folder(spark, negative), "label", (1, 0))


def with_bitmap(df: DataFrame, text: str = "text", width: int = 32) -> DataFrame:
    """Add the bits ``v`` in reading order, the packed lines ``rows``, and the bits as 64-bit ``words`` with their number ``n_bits``."""
    bitmap = F.col(text)
    return df.withColumns({"v": bitmap_bits(bitmap), "rows": bitmap_rows(bitmap, width), "words": bitmap_words(bitmap), "n_bits": bitmap_size(bitmap)})


def bitmap_folder(spark: SparkSession, folder: str, width: int = 32) -> DataFrame:
    """Bitmaps ``<digit>_<n>.txt`` as ``(file, label, n, v, rows, words, n_bits)``."""
    files = spark.read.text(folder, wholetext=True)
    return bitmaps_of(files.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text")), width)


def bitmaps_of(files: DataFrame, width: int = 32) -> DataFrame:
    """``files(file, text)`` named ``<digit>_<n>.txt`` as ``(file, label, n, v, rows, words, n_bits)``."""

    def part(i: int) -> Column:
        return F.regexp_extract("file", r"^(\d+)_(\d+)", i).cast("int")

    named = files.select("file", part(1).alias("label"), part(2).alias("n"), "text")
    return with_bitmap(named, "text", width).drop("text")


#: How a missing value is written in delimited files.
NULL_FIELD = r"\N"


def _fields(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated fields of each line, after dropping outer spaces and line ends (tabs delimit empty fields)."""
    line = F.regexp_replace("value", r"^[ \r\n]+|[ \r\n]+$", "")
    return spark.read.text(path).select(F.split(line, "\t").alias("fields"))


def write_delimited(rows: DataFrame, path: str) -> None:
    """Columns as tab-delimited text for :func:`categorical_rows`; values hold no tabs or line ends."""
    columns = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(NULL_FIELD)) for c in rows.columns]
    rows.select(F.concat_ws("\t", *columns)).write.text(path)


def numeric_rows(
    spark: SparkSession, path: str, features: tuple[str, ...] = ("f1", "f2", "f3"),
    codes: Mapping[str, int] = DATING_CODES,
) -> DataFrame:
    """Tab-delimited numbers with the label last, as a number or a known text.

    Fields between the features and the last one are ignored.
    """
    lines = _fields(spark, path)
    numbers = [F.col("fields")[i].cast("double").alias(f) for i, f in enumerate(features)]
    return lines.select(*numbers, encode_label(F.element_at("fields", -1), codes).alias("label"))


def categorical_rows(spark: SparkSession, path: str, schema: str = schemas.LENSES_SCHEMA) -> DataFrame:
    """Tab-delimited texts named by ``schema``, the label last.

    Quotes and empty fields are values like any other, so this is no CSV; ``\\N``
    is a missing value, as is a field that a line lacks.
    """
    columns = T.StructType.fromDDL(schema)
    field = lambda i: F.nullif(F.get("fields", F.lit(i)), F.lit(NULL_FIELD))
    return _fields(spark, path).select(*[field(i).alias(f.name) for i, f in enumerate(columns)])
