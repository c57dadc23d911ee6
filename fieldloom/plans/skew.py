"""Joins on keys of which a few may hold most rows.

Hot keys are not looked for one by one: keys fall into a fixed number of hash buckets, one cheap aggregation counts the rows of each, and
buckets with more rows than a task should have are split into as many salts as it takes. The rows of the other side are repeated for the
salts of their bucket; as salts are in proportion to rows, that adds at most half of them again, whatever the keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counts of this many buckets (16 bytes each) go to the driver.
BUCKETS = 1 << 16
#: A salt holds about so many rows, or twice the even share of a bucket if that is more.
ROWS = 20_000


def bucket_of(*keys: str | Column) -> Column:
    """The hash bucket of a key; another seed than Spark's own partitioning."""
    return F.pmod(F.xxhash64(F.lit("bucket"), *keys), F.lit(BUCKETS)).cast("int")


class Salts:
    """How many salts the hot buckets of some keys have, from the rows of ``counted``: the side with many rows per key, or any table with as skewed keys."""

    def __init__(self, counted: DataFrame, *keys: str | Column) -> None:
        counts = counted.groupBy(bucket_of(*keys).alias("bucket")).agg(F.count(F.lit(1)).alias("n")).toArrow()
        n = counts.column("n").to_pylist()
        most = max(ROWS, 2 * sum(n) // BUCKETS)
        self.hot = {b: -(-x // most) for b, x in zip(counts.column("bucket").to_pylist(), n, strict=True) if x > most}
        self._table: DataFrame | None = None
        if self.hot:  # at most BUCKETS / 2 rows
            rows = [(b, s) for b, s in sorted(self.hot.items())]
            self._table = F.broadcast(counted.sparkSession.createDataFrame(rows, "_bucket int, _salts int"))

    def many(self, df: DataFrame, keys: list[str | Column], spread_by: list[str | Column], name: str = "_salt") -> DataFrame:
        """Give each row of the side with many rows per key its salt, 0 where the key's bucket isn't hot."""
        if self._table is None:
            return df.withColumn(name, F.lit(0))
        salt = F.coalesce(F.pmod(F.xxhash64(*spread_by), F.col("_salts")).cast("int"), F.lit(0))
        return df.withColumn("_of", bucket_of(*keys)).join(self._table, F.col("_of") == F.col("_bucket"), "left").withColumn(name, salt).drop("_of", "_bucket", "_salts")

    def few(self, df: DataFrame, keys: list[str | Column], name: str = "_salt") -> DataFrame:
        """Repeat the rows of the other side for each salt their bucket has."""
        if self._table is None:
            return df.withColumn(name, F.lit(0))
        every = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
        return df.withColumn("_of", bucket_of(*keys)).join(self._table, F.col("_of") == F.col("_bucket"), "left").withColumn(name, F.explode(every)).drop("_of", "_bucket", "_salts")


def salted_join(many: DataFrame, few: DataFrame, on: list[tuple[str, str]], spread_by: list[str], how: str, salts: Salts | None = None) -> DataFrame:
    """Join ``many`` with ``few`` (inner, left or left_semi) on pairs of column names that differ between the sides.

    salts: those of the same keys, counted on a table that is cheaper to read than ``many``, which is else computed once more to count it.
    """
    salts = salts or Salts(many, *[a for a, _ in on])
    left = salts.many(many, [a for a, _ in on], spread_by, "_salt")
    right = salts.few(few, [b for _, b in on], "_salt_few")
    match = reduce(lambda x, y: x & y, [left[a] == right[b] for a, b in on], left["_salt"] == right["_salt_few"])
    return left.join(right, match, how).drop("_salt", "_salt_few")
