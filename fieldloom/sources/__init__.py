"""Reading the tables of the lineage model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table of the model, stored as ``<directory>/<name>.parquet`` (a file or a folder of files)."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
