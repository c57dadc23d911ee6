"""Deliveries as a stream: repeated ones dropped, counted per window of their time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arrivals_per_window(deliveries: DataFrame, key: str, time: str, window: str, lateness: str) -> DataFrame:
    """``window_start, n_rows, n_keys`` per window of ``time`` (a timestamp), of a stream or a table.

    Rows that agree in key and time are one delivery. A row that comes later than ``lateness`` behind the latest time of the batches before is left out,
    which bounds the state that is kept; so is one without time. n_keys is an estimate with a relative error of at most 1 % where a window has very many.
    """
    rows = deliveries.select(F.col(f"`{key}`").alias("key"), F.col(f"`{time}`").alias("time")).filter("time IS NOT NULL").withWatermark("time", lateness)
    once = rows.dropDuplicates(["key", "time"])
    counts = once.groupBy(F.window("time", window).alias("w")).agg(F.count(F.lit(1)).alias("n_rows"), F.approx_count_distinct("key", 0.01).alias("n_keys"))
    return counts.select(F.col("w.start").alias("window_start"), "n_rows", "n_keys")


def write_stream(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append each window to a Parquet table once it is complete; ends when the source is read up."""
    return rows.writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
