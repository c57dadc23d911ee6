"""Evaluation texts inside training texts: MinHash containment search over windows, verified by exact shingles.

A passage of ``run`` words is the set of its ``run - shingle + 1`` shingles. Texts differ in length by orders of magnitude, so a signature of a
whole text finds no short passage in it. Items are therefore partitioned by size: those of ``run`` words or more are cut into all their windows
of so many words, those with fewer are windows of their own length, one size class for each. Documents are cut into windows of each class that has items.
Within a class a window that is contained is equal, and its MinHash signature agrees with certainty. Neighbouring windows mostly share
their minima, so a text keeps far fewer signatures than windows. What shares a signature is verified by the words themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.arrays import let, windows
from fieldloom.plans.scratch import Scratch
from fieldloom.plans.skew import salted_join
from fieldloom.plans.spread import spread

SHINGLE = 5
#: Independent minima per signature: more of them mean fewer false candidates and more signatures per text.
MINIMA = 2
#: Up to so many signatures of evaluation texts (16 bytes each), and so many candidate pairs, are broadcast.
BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    """The longest runs of a-z and 0-9 after lower-casing."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def size_class(text: Column, run: int) -> Column:
    """How long the windows of an item are: ``run``, or all its words if it has fewer; null without words."""
    n = F.size(words_of(text))
    return F.when(n > 0, F.least(n, F.lit(run)))


def signatures(text: Column, run: int, shingle: int = SHINGLE) -> Column:
    """The distinct MinHash signatures of all windows of ``run`` words; empty for shorter texts, null for null."""
    shingle = min(shingle, run)

    def of(hashes: Column) -> Column:
        def minima(sets: list[Column]) -> Column:
            starts = F.sequence(F.lit(1), F.size(sets[0]) - (run - shingle))
            return F.transform(starts, lambda i: F.xxhash64(*[F.array_min(F.slice(s, i, run - shingle + 1)) for s in sets]))

        sets = F.struct(*[windows(hashes, shingle, lambda w, k=k: F.xxhash64(F.lit(k), w)).alias(f"s{k}") for k in range(MINIMA)])
        found = let(sets, lambda s: minima([s[f"s{k}"] for k in range(MINIMA)]))
        return F.when(F.size(hashes) >= run, F.array_distinct(found)).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words_of(text), lambda w: F.xxhash64(w)), of)


def passages(text: Column, run: int) -> Column:
    """All runs of ``run`` words as texts."""
    return let(words_of(text), lambda w: windows(w, run, lambda x: F.array_join(x, " ")))


def find_leaks(documents: DataFrame, items: DataFrame, run: int = 12, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Pairs of a document and an item that share at least ``run`` consecutive words, or all of an item with fewer: ``doc_id, item_id, run, containment``, one row each.

    ``run`` is the item's size class; ``containment`` the share of the item's distinct windows of so many words that the document has, 1 if it holds the whole
    item. Null texts, and those without words, share nothing. Repeated documents and items each have their own rows. Documents are read twice and
    shuffled only if the candidates are too many to broadcast.
    """
    scratch = Scratch(documents.sparkSession)
    docs = spread(documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("doc_text")), "doc_id")
    tests = scratch.cut(items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("item_text")).withColumn("run", size_class(F.col("item_text"), run)).filter("run IS NOT NULL"))
    classes = sorted(r["run"] for r in tests.select("run").distinct().collect())  # at most ``run``
    none = F.array().cast("array<bigint>")
    of_class = F.coalesce(*[F.when(F.col("run") == c, signatures(F.col("item_text"), c)) for c in classes], none)
    few = scratch.cut(tests.select("item_id", F.explode(of_class).alias("item_signature")))
    every = F.array_distinct(F.concat(none, *[F.coalesce(signatures(F.col("doc_text"), c), none) for c in classes])) if len(classes) != 1 else signatures(F.col("doc_text"), classes[0])
    many = docs.select("doc_id", F.explode(every).alias("signature"))
    if few.count() <= BROADCAST_ROWS:
        met = many.join(F.broadcast(few), F.col("signature") == F.col("item_signature"))
    else:
        met = salted_join(many, few, [("signature", "item_signature")], ["doc_id"], "inner")
    candidates = scratch.cut(met.select("doc_id", "item_id").distinct())
    pairs = candidates.withColumnRenamed("doc_id", "d")
    tested = pairs.join(tests, "item_id")
    if candidates.count() <= BROADCAST_ROWS:
        # the pairs go to the documents, then the texts of the items follow
        near = docs.join(F.broadcast(pairs), F.col("doc_id") == F.col("d")).join(tests, "item_id")
    else:
        near = docs.join(tested, F.col("doc_id") == F.col("d"))
    inside = lambda c: F.size(F.array_intersect(passages(F.col("item_text"), c), passages(F.col("doc_text"), c)))
    whole = lambda c: F.size(F.array_distinct(passages(F.col("item_text"), c)))
    share = F.coalesce(*[F.when(F.col("run") == c, inside(c) / whole(c)) for c in classes], F.lit(0.0))
    # one row per pair even if an id is no key after all
    found = near.select("doc_id", "item_id", "run", share.alias("containment")).filter("containment > 0")
    return found.groupBy("doc_id", "item_id").agg(F.max("run").alias("run"), F.max("containment").alias("containment"))


def leak_report(leaks: DataFrame, items: DataFrame) -> DataFrame:
    """Every item with the number of documents it leaked into and the largest containment: ``item_id, suite, split, n_documents,
    largest_containment``; 0 for those that didn't, null for those without words, as nothing is known of them."""
    counts = leaks.groupBy(F.col("item_id").alias("i")).agg(F.count(F.lit(1)).alias("n"), F.max("containment").alias("c"))
    joined = items.join(counts, F.col("item_id") == F.col("i"), "left")
    known = lambda c: F.when(F.size(words_of(F.col("text"))) > 0, c)
    return joined.select("item_id", "suite", "split", known(F.coalesce("n", F.lit(0).cast("long"))).alias("n_documents"), known(F.coalesce("c", F.lit(0.0))).alias("largest_containment"))
