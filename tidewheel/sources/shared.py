"""The folder that all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; one of our own only where the session names none (tests)."""
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), f"tidewheel-{os.getpid()}")


def _new_folder(spark: SparkSession) -> str:
    """A folder for one table, below one of the application, which :func:`clean` removes."""
    return f"{shared_folder(spark)}/tidewheel-{spark.sparkContext.applicationId}/cut-{uuid.uuid4().hex}"


def cut(df: DataFrame, folders: list[str] | None = None) -> DataFrame:
    """Writes ``df`` once into the shared folder and reads it back: what follows no longer depends on its lineage.

    An executor that is lost takes nothing with it. The folder is added to ``folders``, for :func:`drop` once no result
    reads it; what nobody drops stays until :func:`clean`.
    """
    path = _new_folder(df.sparkSession)
    df.write.parquet(path)
    if folders is not None:
        folders.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Log:
    """A table that only grows: each batch is appended once, none is written again."""

    def __init__(self, spark: SparkSession, folders: list[str]):
        self.spark, self.path, self.schema = spark, _new_folder(spark), None
        folders.append(self.path)

    def append(self, df: DataFrame) -> DataFrame:
        """All rows so far, these included."""
        df.write.mode("append").parquet(self.path)
        self.schema = df.schema
        return self.rows()

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def drop(spark: SparkSession, folders: list[str]) -> None:
    """Removes folders that :func:`cut` made, and empties the list."""
    jvm = spark.sparkContext._jvm
    while folders:
        path = jvm.org.apache.hadoop.fs.Path(folders.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clean(spark: SparkSession) -> None:
    """Removes all tables that this application cut; call it when no result is read any more."""
    drop(spark, [f"{shared_folder(spark)}/tidewheel-{spark.sparkContext.applicationId}"])
