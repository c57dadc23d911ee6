"""Exact selection by refined histograms: quantiles per key, and the keys that hold most rows.

The value at a rank is found digit by digit. Each round counts the rows of every open interval by their next ``bits`` bits, counts that
merge before the shuffle, and keeps the one bin that holds the rank; a bin whose least and greatest value agree is resolved. No round
moves the values of a key: a key with a third of all rows sends, as any other, at most one row per bin and task.
"""

from __future__ import annotations

from fractions import Fraction
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.plans.scratch import Scratch
from fieldloom.plans.skew import salted_join

#: Open intervals up to this many rows (of about 50 bytes) are broadcast, more are joined by a salted shuffle.
BROADCAST_ROWS = 50_000


def as_rankable(column: str, kind: T.DataType) -> Column:
    """A value as a long of the same order: whole numbers, booleans, dates and timestamps; others raise TypeError."""
    c = F.col(f"`{column}`")
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("long")
    if isinstance(kind, T.BooleanType):
        return c.cast("int").cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{column}`)")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    raise TypeError(f"{column}: {kind.simpleString()} can't be ranked as a whole number")


def from_rankable(value: Column, kind: T.DataType) -> Column:
    """The inverse of ``as_rankable``."""
    if isinstance(kind, T.BooleanType):
        return value == 1
    if isinstance(kind, T.DateType):
        return F.date_from_unix_date(value.cast("int"))
    if isinstance(kind, T.TimestampNTZType):
        seconds = (value.cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
        return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(value)
    return value.cast(kind)


def select_ranks(rows: DataFrame, targets: DataFrame, scratch: Scratch, bits: int = 10) -> DataFrame:
    """The values at given ranks of each group.

    rows: ``g`` (group, not null) and ``v`` (long, not null), read once a round; targets: ``g`` and ``rank`` (from 1, at most the rows of
    the group). Returns ``g, rank, v``; a target of a group without rows gives none. Ties have one value, so their order doesn't matter.
    """
    ends = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    empty = targets.select("g", "rank", F.lit(0).cast("long").alias("v")).limit(0)
    if ends is None or ends["lo"] is None:
        return empty
    flip = 1 << 63  # as if unsigned, so that prefixes keep the order of signed values
    width = ((ends["lo"] + flip) ^ (ends["hi"] + flip)).bit_length()
    unsigned = F.col("v").bitwiseXOR(F.lit(-flip))
    rows = rows.select("g", "v", unsigned.alias("u"))

    def prefix(shift: int) -> Column:
        return F.lit(0).cast("long") if shift >= 64 else F.shiftrightunsigned("u", shift)

    open_targets, done, shift = targets.select("g", F.lit(0).cast("long").alias("p"), "rank", F.col("rank").alias("r")), [], width
    open_rows, first = 0, True
    while True:
        finer = max(0, shift - bits)
        if first:
            counted = rows.select("g", F.lit(0).cast("long").alias("p"), "v", prefix(finer).alias("d"))
        else:
            active = open_targets.select(F.col("g").alias("g2"), F.col("p").alias("p2")).distinct()
            keyed = rows.select("g", prefix(shift).alias("p"), "v", prefix(finer).alias("d"))
            if open_rows <= BROADCAST_ROWS:
                counted = keyed.join(F.broadcast(active), (F.col("g") == F.col("g2")) & (F.col("p") == F.col("p2")), "left_semi")
            else:
                counted = salted_join(keyed, active, [("g", "g2"), ("p", "p2")], ["v"], "left_semi")
        bins = counted.groupBy("g", "p", "d").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = Window.partitionBy("g", "p").orderBy("lo").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most 2**bits rows
        bins = bins.withColumn("upto", F.sum("n").over(upto)).withColumnsRenamed({"g": "bg", "p": "bp"})
        within = (F.col("g") == F.col("bg")) & (F.col("p") == F.col("bp")) & (F.col("r") > F.col("upto") - F.col("n")) & (F.col("r") <= F.col("upto"))
        # the targets of a group are few (one per quantile); its bins are at most 2**bits
        found = scratch.cut(
            open_targets.join(bins, within).select("g", F.col("d").alias("p"), "rank", (F.col("r") - F.col("upto") + F.col("n")).alias("r"), "lo", "hi")
        )
        resolved = (F.col("lo") == F.col("hi")) if finer else F.lit(True)
        done.append(found.filter(resolved).select("g", "rank", F.col("lo").alias("v")))
        open_targets = found.filter(~resolved).select("g", "p", "rank", "r")
        open_rows = open_targets.count() if finer else 0
        if not open_rows:
            break
        first, shift = False, finer
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def hot_keys(df: DataFrame, columns: list[str], share: float) -> DataFrame:
    """Values of each of ``columns`` that hold at least ``share`` of all rows of ``df``: ``key_name, key_value, n_rows``.

    The rows of a column are ranked by a hash of their key. A key with that share covers at least one in every run of as many ranks, so
    the keys at the multiples of that rank, found by exact selection, are the only candidates: at most 1 / share a column. Their rows are
    then counted with the key itself. Null is no key, but its rows count for the total; no rows give no keys.
    """
    spark = df.sparkSession
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("g"), F.col(f"`{c}`").cast("string").alias("key")) for c in columns])).alias("x"))
    long = long.select("x.g", "x.key", F.xxhash64("x.key").alias("v"))
    sizes = df.agg(F.count(F.lit(1)).alias("_all"), *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    least = max(1, ceil(Fraction(str(share)) * sizes["_all"]))
    wanted = [(c, rank) for i, c in enumerate(columns) for rank in range(least, sizes[f"n{i}"] + 1, least)]
    targets = spark.createDataFrame(wanted, "g string, rank long")
    rows = long.filter("key IS NOT NULL")
    candidates = select_ranks(rows.select("g", "v"), targets, Scratch(spark)).select(F.col("g").alias("cg"), F.col("v").alias("cv")).distinct()
    # at most len(columns) / share rows
    held = rows.join(F.broadcast(candidates), (F.col("g") == F.col("cg")) & (F.col("v") == F.col("cv")), "left_semi")
    counts = held.groupBy("g", "key").agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.filter(F.col("n_rows") >= least).select(F.col("g").alias("key_name"), F.col("key").alias("key_value"), "n_rows")


def per_key_quantiles(df: DataFrame, columns: list[str], value: str, probs: list[float]) -> DataFrame:
    """Exact quantiles of ``value`` for each key of each of ``columns``: ``key_name, key_value, n_values, q_<percent>``.

    The quantile p of n values is the value at rank ceil(p n), at least 1. Null keys form no group, null values aren't ranked; a key with
    null values only has no row.
    """
    kind = df.schema[value].dataType
    long = df.select(
        as_rankable(value, kind).alias("v"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("key_name"), F.col(f"`{c}`").cast("string").alias("key_value")) for c in columns])).alias("g"),
    ).filter("v IS NOT NULL AND g.key_value IS NOT NULL")
    scratch = Scratch(df.sparkSession)
    sizes = scratch.cut(long.groupBy("g").agg(F.count(F.lit(1)).alias("n_values")))
    fractions = [Fraction(str(p)) for p in probs]
    ranks = [F.greatest(F.lit(1), F.ceil(F.col("n_values") * f.numerator / f.denominator)).cast("long") for f in fractions]
    targets = sizes.select("g", F.explode(F.array_distinct(F.array(*ranks))).alias("rank"))
    found = select_ranks(long, targets, scratch)
    at = sizes.join(found, "g").groupBy("g", "n_values").agg(
        *[F.max(F.when(F.col("rank") == r, F.col("v"))).alias(f"_q{i}") for i, r in enumerate(ranks)]
    )
    named = [from_rankable(F.col(f"_q{i}"), kind).alias(f"q_{float(p) * 100:g}".replace(".", "_")) for i, p in enumerate(probs)]
    return at.select("g.key_name", "g.key_value", "n_values", *named)


def per_key_summary(df: DataFrame, columns: list[str], distinct: str, last: str) -> DataFrame:
    """Rows, distinct values of ``distinct`` and the latest ``last`` for each key of each of ``columns``.

    Returns ``key_name, key_value, n_rows, n_distinct, last_value``. A first aggregation by key and value spreads a hot key over its values
    and merges before the shuffle, the second merges what is left, so no task holds the rows of a key. Null keys form no group; null is no
    value for ``distinct`` and ``last``.
    """
    keys = F.explode(F.array(*[F.struct(F.lit(c).alias("key_name"), F.col(f"`{c}`").cast("string").alias("key_value")) for c in columns]))
    long = df.select(F.col(f"`{distinct}`").alias("d"), F.col(f"`{last}`").alias("l"), keys.alias("g")).select("d", "l", "g.*").filter("key_value IS NOT NULL")
    by_value = long.groupBy("key_name", "key_value", "d").agg(F.count(F.lit(1)).alias("n"), F.max("l").alias("l"))
    return by_value.groupBy("key_name", "key_value").agg(F.sum("n").alias("n_rows"), F.count("d").alias("n_distinct"), F.max("l").alias("last_value"))
