"""Spreading rows that are heavy to work on over all cores, where a table is too small to be read in as many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def _bytes(text: str) -> int:
    number = text.rstrip("bBkKmMgGtTiI")
    return int(number) * 1024 ** "bkmgt".index((text[len(number) :].lower() or "b")[0])


def keeps_busy(df: DataFrame, cores: int) -> bool:
    """Whether a scan of ``df`` surely has a task with rows for every core: by the size that the plan states, or by its files; nothing is run for it."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # a file's row groups are no smaller than a split unless its writer chose so; only the files of small tables are listed
    return size >= cores * _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes")) or len(df.inputFiles()) >= cores


def spread(df: DataFrame, by: str, factor: int = 2) -> DataFrame:
    """``df`` as it is if its scan keeps all cores busy, as any large table's does; else its rows over ``factor`` times the cores.

    So no more than the largest split times the cores is ever shuffled for this, whatever the size of the table.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if keeps_busy(df, cores) else df.repartition(factor * cores, by)
