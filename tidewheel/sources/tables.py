"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``directory`` (one file or a folder of files)."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
