"""Immutable snapshots of the tables, named by their content."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_digest(df: DataFrame, *keys: str) -> DataFrame:
    """``n_rows, digest``, one row or one per ``keys``: of the rows in any order; a row that stands twice counts twice. Merged before the shuffle."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    parts = [F.conv(F.substring(F.col("_hash"), 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)").alias(f"_h{i}") for i in range(4)]
    sums = df.select(*keys, F.sha2(row, 256).alias("_hash")).select(*keys, *parts)
    sums = sums.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *[F.sum(f"_h{i}").alias(f"_h{i}") for i in range(4)])
    return sums.select(*keys, "n_rows", F.sha2(F.concat_ws(",", "n_rows", *[F.coalesce(F.col(f"_h{i}"), F.lit(0)) for i in range(4)]), 256).alias("digest"))


def write_snapshot(tables: dict[str, DataFrame], root: str, version: str = "1") -> str:
    """Write the tables below ``root/<identity>`` and the pointer ``root/current`` last; returns the identity.

    The identity is the hash of the version and the tables' digests, so the same content, in any order, has the same. A failed run leaves no pointer.
    """
    spark = next(iter(tables.values())).sparkSession
    digests = {name: table_digest(df).first() for name, df in sorted(tables.items())}  # one row each
    said = json.dumps({"version": version, "tables": {n: [d["n_rows"], d["digest"]] for n, d in digests.items()}}, sort_keys=True, separators=(",", ":"))
    identity = spark.createDataFrame([(said,)], "s string").select(F.sha2("s", 256)).first()[0]
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{identity}/{name}.parquet")
    pointer = spark.createDataFrame([(json.dumps({"identity": identity} | json.loads(said), sort_keys=True),)], "value string")
    pointer.coalesce(1).write.mode("overwrite").text(f"{root}/current")
    return identity


def current_snapshot(spark: SparkSession, root: str) -> str:
    """The folder of the current snapshot; FileNotFoundError if there is none."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.text(f"{root}/current").head(1)
    except AnalysisException:
        rows = []
    if not rows:
        raise FileNotFoundError(f"no snapshot in {root}")
    return f"{root}/{json.loads(rows[0]['value'])['identity']}"
