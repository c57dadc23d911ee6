"""The facts as they stand: of rows delivered several times, one per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.sources import read_table


def _of_each_key(df: DataFrame, key: str, order: str, best: Column) -> DataFrame:
    # the order is a number, so this aggregates by hash; the rows then follow by a semi-join on both, without being sorted or gathered by key
    chosen = df.groupBy(F.col(key).alias("_key")).agg(best.alias("_chosen"))
    return df.join(chosen, (F.col(order) == F.col("_chosen")) & F.col(key).eqNullSafe(F.col("_key")), "left_semi").select(key, *[c for c in df.columns if c != key])


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of the rows of a key, the one with the greatest ``order``, a number that no two of them share. Null keys are one key; a row without order is left out."""
    return _of_each_key(df, key, order, F.max(order))


def first_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of the rows of a key, the one with the least ``order``, as above."""
    return _of_each_key(df, key, order, F.min(order))


def first_by(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """Of the rows of a key, the first in an order over several columns; for small tables without a row number."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def insert_or_ignore(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """The rows of ``first`` and those of ``second`` with other keys; both have unique keys."""
    return first.unionByName(second.join(first.select(key), key, "left_anti"))


def edges(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The current edges: the last delivery of each id."""
    return last_wins(read_table(spark, d, "edges").select("id", *columns, "ingest_seq"), "id", "ingest_seq").drop("ingest_seq")


def fields(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The current fields: the last row of each id."""
    return last_wins(read_table(spark, d, "field").select("id", *columns, "ingest_seq"), "id", "ingest_seq").drop("ingest_seq")


def _plain_scope(df: DataFrame) -> DataFrame:
    return df.select("*", *[F.col(f"scope.{s}").alias(s) for s in ("country", "clearing", "product")])


def entry_points(spark: SparkSession, d: str) -> DataFrame:
    """The entry points, one row each: the last seen, then by line, scope and counts."""
    df = _plain_scope(read_table(spark, d, "entry_point"))
    order = [F.col("seen_at").desc_nulls_last(), F.col("line").desc_nulls_last()]
    order += [F.coalesce(c, F.lit("")) for c in ("country", "clearing", "product")] + [F.coalesce(c, F.lit(-1)) for c in ("edge_count", "resolution_percent")]
    return first_by(df, "id", *order, F.col("method_signature").asc_nulls_first())


def mappers(spark: SparkSession, d: str) -> DataFrame:
    """The mappers, one row each: by kind, file and scope."""
    df = _plain_scope(read_table(spark, d, "mapper"))
    return first_by(df, "id", F.col("kind").asc_nulls_first(), F.col("file").asc_nulls_first(), *[F.coalesce(c, F.lit("")) for c in ("country", "clearing", "product")])


def schemas(spark: SparkSession, d: str) -> DataFrame:
    """The schemas, one row each: the last seen, then by kind and file."""
    return first_by(read_table(spark, d, "schema_def"), "id", F.col("seen_at").desc_nulls_last(), F.col("kind").asc_nulls_first(), F.col("file").asc_nulls_first())


def coverage(spark: SparkSession, d: str) -> DataFrame:
    """The reports, one per repository and pair: the one with the most files, edges and fields; nulls count as none."""
    df = read_table(spark, d, "coverage")
    most = [F.coalesce(c, F.lit(-1)).desc() for c in ("files_scanned", "edges_emitted", "target_field_count", "mappers_detected", "coverage_percent")]
    n = F.row_number().over(Window.partitionBy("repo_id", "pair_id").orderBy(*most, F.coalesce(F.size("unmatched"), F.lit(-1)).desc()))
    return df.withColumn("_n", n).filter("_n = 1").drop("_n")
