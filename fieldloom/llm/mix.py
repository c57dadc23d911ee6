"""Mixing sources to target shares of the tokens."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.plans.scratch import Scratch
from fieldloom.plans.skew import salted_join
from fieldloom.plans.spread import spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the tokenizer splits texts before its merges; fixed with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Sources up to this many are broadcast.
BROADCAST_SOURCES = 10_000


@lru_cache(maxsize=4)
def _encoding(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, text: str, name: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``df`` with the number of tokens of ``text``, 0 for null; strings that look like special tokens are plain text. The vocabulary file goes along to the executors."""
    df.sparkSession.sparkContext.addFile(tokenizer)
    name_of_file = Path(tokenizer).name

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoding = _encoding(SparkFiles.get(name_of_file))
        for texts in batches:
            yield pa.array([len(encoding.encode_ordinary(t)) if t else 0 for t in texts.to_pylist()], pa.int64())

    return df.withColumn(name, F.arrow_udf(count, "long")(F.col(f"`{text}`")))


def plain_source(source: Column) -> Column:
    """A source as it is compared: without outer blanks, in lower case."""
    return F.lower(F.btrim(source, F.lit(" \t\r\n")))


def source_rates(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """How often each source is used: ``source, n_documents, n_tokens, target_share, aimed_share, max_repeats, rate``.

    sizes: ``source, n_documents, n_tokens``; targets: ``source, target_share, max_repeats``. Only sources with tokens can contribute; the shares
    of the others are divided among them, which is the share aimed at (null for those). The mix has ``total_tokens`` or, if that is None, as many as it can while every source still meets
    its share. A rate is the source's part of that over its tokens, at most ``max_repeats`` (null: 1; below 0: 0). A source without target
    has rate 0, as has one without tokens.
    """
    t = targets.filter("source IS NOT NULL").groupBy(plain_source(F.col("source")).alias("s"))
    t = t.agg(F.sum(F.greatest("target_share", F.lit(0.0))).alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    joined = sizes.join(t, sizes["source"].eqNullSafe(F.col("s")), "full")
    cap = F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))
    usable = (F.col("n_tokens") > 0) & (F.col("target_share") > 0) & (cap > 0)
    rows = joined.select(
        F.coalesce("source", "s").alias("source"),
        F.coalesce("n_documents", F.lit(0).cast("long")).alias("n_documents"),
        F.coalesce("n_tokens", F.lit(0).cast("long")).alias("n_tokens"),
        "target_share",
        "max_repeats",
        F.when(usable, F.col("target_share")).alias("_share"),
        cap.alias("_cap"),
    )
    scratch = Scratch(sizes.sparkSession)
    rows = scratch.cut(rows)
    whole = rows.agg(F.sum("_share").alias("_whole"))  # one row, as is the next
    rows = rows.crossJoin(F.broadcast(whole)).withColumn("_share", F.col("_share") / F.col("_whole")).drop("_whole")
    largest = rows.agg(F.min(F.when(F.col("_share").isNotNull(), F.col("_cap") * F.col("n_tokens") / F.col("_share"))).alias("_total"))
    rows = rows.crossJoin(F.broadcast(largest)) if total_tokens is None else rows.withColumn("_total", F.lit(float(total_tokens)))
    rate = F.when(F.col("_share").isNotNull(), F.least(F.col("_cap").cast("double"), F.col("_total") * F.col("_share") / F.col("n_tokens"))).otherwise(F.lit(0.0))
    return rows.select("source", "n_documents", "n_tokens", "target_share", F.col("_share").alias("aimed_share"), "max_repeats", rate.alias("rate"))


def copies(rate: Column, doc_id: Column, seed: int) -> Column:
    """floor(rate), and one more with the probability of the rest: the hash of seed and document as a number in [0, 1)."""
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("long"), doc_id), 11) / F.lit(float(1 << 53))
    return (F.floor(rate) + F.when(drawn < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 42, tokenizer: str = TOKENIZER, doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The mixed documents and the report.

    The first has a row per copy, ``doc_id, source, n_tokens, copy`` (from 1); the same seed gives the same choice, whatever the order of the rows.
    The second has, per source, ``source, n_documents, n_tokens, target_share, aimed_share, max_repeats, rate, mixed_copies, mixed_tokens, actual_share``; a null
    source is listed, but never used. Documents with null or empty text have no tokens and are drawn like others of their source.
    """
    scratch = Scratch(documents.sparkSession)
    c = lambda x: F.col(f"`{x}`")
    texts = documents.select(c(doc_id).alias("doc_id"), plain_source(c("source")).alias("source"), c("text").alias("text"))
    texts = spread(texts, "doc_id")
    sized = scratch.cut(with_tokens(texts, "text", "n_tokens", tokenizer).drop("text"))
    sizes = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_tokens").alias("n_tokens"))
    rates = scratch.cut(source_rates(sizes, targets, total_tokens))
    used = rates.filter("rate > 0").select(F.col("source").alias("s"), "rate")
    if used.count() <= BROADCAST_SOURCES:
        rated = sized.join(F.broadcast(used), F.col("source") == F.col("s"))
    else:
        rated = salted_join(sized, used, [("source", "s")], ["doc_id"], "inner")
    drawn = rated.withColumn("n_copies", copies(F.col("rate"), F.col("doc_id"), seed))
    drawn = drawn.filter("n_copies > 0")
    mixed = drawn.select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy"))
    reached = drawn.groupBy(F.col("source").alias("m")).agg(F.sum("n_copies").alias("c"), F.sum(F.col("n_copies") * F.col("n_tokens")).alias("t"))
    whole = drawn.agg(F.sum(F.col("n_copies") * F.col("n_tokens")).alias("_whole"))  # one row
    report = rates.join(reached, F.col("source") == F.col("m"), "left")
    zero = F.lit(0).cast("long")
    report = report.select(*rates.columns, F.coalesce("c", zero).alias("mixed_copies"), F.coalesce("t", zero).alias("mixed_tokens"))
    share = F.when(F.col("_whole") > 0, F.col("mixed_tokens") / F.col("_whole"))
    return mixed, report.crossJoin(F.broadcast(whole)).withColumn("actual_share", share).drop("_whole")
