"""Intermediate tables in the folder that all executors share.

Iterative operators cut their lineage by writing a table and reading it again. The folder is the one the cluster names in
``spark.checkpoint.dir``; only a session on a local master, where it may be unset, gets a temporary folder of its own.
The tables outlive lost executors, and go when the application ends or when the operator drops them.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, DataFrameReader, Observation, SparkSession
from pyspark.sql import functions as F

_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder for this application's intermediate tables."""
    context = spark.sparkContext
    if context.applicationId not in _roots:
        base = context.getConf().get("spark.checkpoint.dir")
        if not base:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="spark-fieldloom-")
        root = f"{base.rstrip('/')}/fieldloom-{context.applicationId}"
        path, files = _filesystem(spark, root)
        files.mkdirs(path)
        files.deleteOnExit(path)
        _roots[context.applicationId] = root
    return _roots[context.applicationId]


def _filesystem(spark: SparkSession, where: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class Scratch:
    """The intermediate tables of one run of an operator.

    broadcast_rows: tables with more rows are joined by a merge, unless a join asks for a broadcast. The optimizer goes by the size of the files, and numbers in order
    compress so well that a table within its threshold may not fit into the driver. None leaves it to the optimizer.
    """

    def __init__(self, spark: SparkSession, broadcast_rows: int | None = None) -> None:
        self.spark = spark
        self.root = f"{shared_root(spark)}/{uuid.uuid4().hex}"
        self.count = 0
        self.broadcast_rows = broadcast_rows
        self._rows: dict[str, int] = {}

    def cut(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and give the written table."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        table = self._bounded(self.spark.read.schema(df.schema), path, self._write(df, path))
        table._scratch_path = path
        return table

    def _write(self, df: DataFrame, path: str) -> int:
        """Write ``df`` and give its rows, which are counted on the way and only if there is a bound."""
        if self.broadcast_rows is None:
            df.write.parquet(path)
            return 0
        rows = Observation()
        df.observe(rows, F.count(F.lit(1)).alias("n")).write.parquet(path)
        return rows.get["n"]

    def _bounded(self, reader: DataFrameReader, path: str, rows: int) -> DataFrame:
        table = reader.parquet(path)
        return table if self.broadcast_rows is None or rows <= self.broadcast_rows else table.hint("merge")

    def group(self) -> str:
        """The name of a new group of tables with equal columns."""
        self.count += 1
        return f"group-{self.count}"

    def add(self, group: str, df: DataFrame) -> DataFrame:
        """Write ``df`` as one more part of a group, and give that part."""
        self.count += 1
        path = f"{self.root}/{group}/{self.count}"
        rows = self._write(df, path)
        self._rows[group] = self._rows.get(group, 0) + rows
        return self._bounded(self.spark.read.schema(df.schema), path, rows)

    def whole(self, group: str, like: DataFrame) -> DataFrame:
        """All parts of a group so far, as one scan: a union's plan would grow with each round. like: any of them."""
        return self._bounded(self.spark.read.schema(like.schema).option("recursiveFileLookup", "true"), f"{self.root}/{group}", self._rows[group])

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that nothing reads any more."""
        for table in tables:
            where = getattr(table, "_scratch_path", None)
            if where:
                path, files = _filesystem(self.spark, where)
                files.delete(path, True)
