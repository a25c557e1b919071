"""Tables between jobs, and saved models.

A saved model is a folder of versions, see :func:`save_version`.

Intermediate tables go to the shared folder named by ``spark.checkpoint.dir``
or, where that is unset, below ``spark.sql.warehouse.dir``, under the
application's id: a written table survives lost executors, ends the lineage and
lets the planner see the true size.  Results read these tables, so they stay
until :func:`remove_intermediate` is called.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


#: Folder of numbered files in a saved model, each with the name of a version's folder; the last one counts.
POINTERS = "_pointers"


def work_folder(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/intermediate"
    return f"{shared.rstrip('/')}/statloom/{spark.conf.get('spark.app.id', 'session')}"


def remove_intermediate(spark: SparkSession) -> None:
    """Delete what this application wrote between jobs; no result that reads it may be used afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(work_folder(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and go on from the written table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as part of the plan itself, so that reading them takes no job."""
    fields = T.StructType.fromDDL(schema)
    if not rows:
        return spark.createDataFrame([], fields)
    columns = {f.name: [row[i] for row in rows] for i, f in enumerate(fields)}
    return spark.createDataFrame(pa.table(columns), fields)


def _file_system(spark: SparkSession, path: str):
    """Hadoop's path class, and the file system that holds ``path``."""
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    return to_path, to_path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _pointers(spark: SparkSession, path: str) -> list[str]:
    to_path, files = _file_system(spark, path)
    folder = to_path(f"{path}/{POINTERS}")
    if not files.exists(folder):
        return []
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    return sorted(n for n in names if n.isdigit())


def current_version(spark: SparkSession, path: str) -> str:
    """The folder of the version that was saved last."""
    names = _pointers(spark, path)
    if not names:
        raise FileNotFoundError(f"no saved version: {path}")
    version = spark.read.text(f"{path}/{POINTERS}/{names[-1]}", wholetext=True).first()[0]
    return f"{path}/{version}"


def save_version(path: str, tables: dict[str, DataFrame]) -> None:
    """Save tables together as a new version of ``path``.

    All tables are written to a folder of their own first; only then a pointer
    file with the next number appears, by a rename, which is all or nothing.  So
    a save that fails leaves the version before as it was, and tables that were
    loaded from it, also those that the new version is made of, can be read on.
    Of two saves at a time both are kept, and the one that gets the higher number counts.
    """
    spark = next(iter(tables.values())).sparkSession
    version = f"version-{uuid.uuid4().hex}"
    for name, table in tables.items():
        table.write.parquet(f"{path}/{version}/{name}")
    to_path, files = _file_system(spark, path)
    draft = to_path(f"{path}/{POINTERS}/.{version}")
    stream = files.create(draft, False)
    stream.write(bytearray(version.encode()))
    stream.close()
    number = int((_pointers(spark, path) or ["0"])[-1]) + 1
    while files.exists(to_path(f"{path}/{POINTERS}/{number:012d}")) or not files.rename(draft, to_path(f"{path}/{POINTERS}/{number:012d}")):
        number += 1


def remove_old_versions(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete all but the last ``keep`` versions; nothing that was loaded from the others may be used afterwards."""
    to_path, files = _file_system(spark, path)
    for name in _pointers(spark, path)[: -max(1, keep)]:
        pointer = f"{path}/{POINTERS}/{name}"
        version = spark.read.text(pointer, wholetext=True).first()[0]
        files.delete(to_path(pointer), False)
        files.delete(to_path(f"{path}/{version}"), True)


def save_model(table: DataFrame, path: str) -> None:
    """Save a model of one table as a new version."""
    save_version(path, {"table": table})


def load_model(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{current_version(spark, path)}/table")
