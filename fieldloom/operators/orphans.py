"""References to records that are missing, deleted or not there yet.

Parents and children are tagged and united in long form, then grouped by parent table and key. Within a group, ordered by time, a running
count of the lifetimes that are open is the parent flag that holds for each child; the children without it are orphans.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.plans.skew import Salts


@dataclass(frozen=True)
class Parent:
    """A table that is referred to: its key and the columns from and up to when a record exists."""

    name: str
    rows: DataFrame
    key: str
    since: str
    until: str


@dataclass(frozen=True)
class Child:
    """A table with references: columns and the parent each leads to, a unique row number and the time at which a reference is made."""

    name: str
    rows: DataFrame
    columns: dict[str, str]
    row: str
    time: str


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def tagged_parents(parent: Parent) -> DataFrame:
    """Begin (+1) and end (-1) of every lifetime; a record without a begin, or with an end not after it, never exists."""
    lives = parent.rows.select(_c(parent.key).cast("string").alias("key"), _c(parent.since).alias("a"), _c(parent.until).alias("b"))
    lives = lives.filter("key IS NOT NULL AND a IS NOT NULL AND (b IS NULL OR b > a)").distinct()
    marks = F.array(F.struct(F.col("a").alias("time"), F.lit(1).alias("step")), F.struct(F.col("b").alias("time"), F.lit(-1).alias("step")))
    marks = lives.select(F.lit(parent.name).alias("parent"), "key", F.explode(marks).alias("m")).select("parent", "key", "m.time", "m.step")
    return marks.filter("time IS NOT NULL")


def tagged_children(child: Child) -> DataFrame:
    """Every reference that isn't null, one row each."""
    refs = F.array(*[F.struct(F.lit(p).alias("parent"), _c(c).cast("string").alias("key"), F.lit(c).alias("column_name")) for c, p in child.columns.items()])
    rows = child.rows.select(_c(child.row).cast("long").alias("ingest_seq"), _c(child.time).alias("time"), F.explode(refs).alias("r"))
    return rows.select(F.lit(child.name).alias("table_name"), "r.*", "time", "ingest_seq").filter("key IS NOT NULL")


def find_orphans(parents: list[Parent], children: list[Child]) -> DataFrame:
    """References without a parent at their time: ``table_name, column_name, ingest_seq, parent, key, time``.

    A parent exists from its ``since``, included, to its ``until``, excluded, or for good if that is null. A reference whose own time is
    null finds no parent. Keys are compared as they are; an empty text is a key. A record listed twice, or created anew, may have any number of
    lifetimes. Keys with very many references are salted, and their parents repeated for each salt, so that no group grows without bound.
    """
    marks = reduce(DataFrame.unionByName, [tagged_parents(p) for p in parents])
    refs = reduce(DataFrame.unionByName, [tagged_children(c) for c in children])
    salts = Salts(refs, "parent", "key")
    marks = salts.few(marks, ["parent", "key"]).withColumn("is_ref", F.lit(0))
    refs = salts.many(refs, ["parent", "key"], ["table_name", "column_name", "ingest_seq"]).withColumns({"is_ref": F.lit(1), "step": F.lit(0)})
    order = Window.partitionBy("parent", "key", "_salt").orderBy(F.col("time").asc_nulls_first(), "is_ref")
    alive = F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    united = refs.unionByName(marks, allowMissingColumns=True).withColumn("alive", alive)
    # before the first mark the count is 0, as it is where no parent is known at all
    return united.filter("is_ref = 1 AND alive = 0").select("table_name", "column_name", "ingest_seq", "parent", "key", "time")


def orphan_report(orphans: DataFrame, children: list[Child]) -> DataFrame:
    """Orphans and references per table, column and month: ``table_name, column_name, period, n_references, n_orphans``; a null time has a null period."""
    refs = reduce(DataFrame.unionByName, [tagged_children(c) for c in children])
    by = ["table_name", "column_name", F.date_format("time", "yyyy-MM").alias("period")]
    every = refs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_references"), F.lit(0).cast("long").alias("n_orphans"))
    lost = orphans.groupBy(*by).agg(F.lit(0).cast("long").alias("n_references"), F.count(F.lit(1)).alias("n_orphans"))
    both = every.unionByName(lost).groupBy("table_name", "column_name", "period")
    return both.agg(F.sum("n_references").alias("n_references"), F.sum("n_orphans").alias("n_orphans"))
