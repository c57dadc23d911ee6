"""Groups of records from pairwise links: connected components by large-star and small-star steps.

An edge always leads from the greater key to the smaller. The large star links every greater neighbour of a key to the least key of its
neighbourhood, the small star every smaller neighbour; alternated until nothing changes, they leave each key linked to the least key of
its component. Both are an aggregation and a join on keys; the joins are salted where a key has very many links. The rounds run on 64-bit
hashes of the keys, once it is known that no two keys share one; the least text of a component is looked up at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.plans.scratch import Scratch
from fieldloom.plans.skew import salted_join

BLANKS = " \t\r\n"
#: Seeds to be tried for hashes that no two keys share, before the rounds run on the texts themselves.
SEEDS = 3


def normal_key(key: Column) -> Column:
    """A business key as it is compared: without outer blanks, in lower case."""
    return F.lower(F.btrim(key, F.lit(BLANKS)))


def _state(edges: DataFrame) -> tuple:
    """What two equal sets of edges have in common."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("v", "u"))).first()
    return tuple(row)


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))


def star_components(pairs: DataFrame, scratch: Scratch, max_rounds: int = 200) -> DataFrame:
    """Each linked key and the least key of its component: ``u, v`` with u > v; the least key itself has no row.

    pairs: columns ``a, b`` of one orderable type. A pair with a null, and a key linked to itself, link nothing; repeated and reversed
    pairs count once. Raises RuntimeError if it isn't done after ``max_rounds``, as can't happen with rounds that grow with the logarithm.
    """
    linked = pairs.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = scratch.cut(linked.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(edges)
    for _ in range(max_rounds):
        # large star: the least neighbour of v is smaller than v only if v leads anywhere, so the rest stay as they are
        to = salted_join(edges, _least(edges), [("v", "k")], ["u"], "left")
        large = scratch.cut(to.select("u", F.coalesce("m", "v").alias("v")).distinct())
        # small star
        to = salted_join(large, _least(large), [("u", "k")], ["v"], "inner")
        links = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = scratch.cut(to.select(F.explode(links).alias("e")).select("e.*").filter("u <> v").distinct())
        scratch.drop(edges, large)
        edges, before = small, state
        state = _state(edges)
        if state == before:
            return edges
    raise RuntimeError(f"components still change after {max_rounds} rounds")


def _hash(key: str, seed: int) -> Column:
    return F.when(F.col(key).isNotNull(), F.xxhash64(F.lit(seed), key))


def group_keys(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """One group for every record: ``group_key, business_key``, the group being the least key of the component.

    records: column ``k`` (text); nulls aren't records, repeated ones are one. pairs: ``a, b``, whose keys are among the records. A record without
    links is its own group.
    """
    scratch = Scratch(records.sparkSession)
    keys = scratch.cut(records.filter("k IS NOT NULL").distinct())
    total = keys.count()
    for seed in range(SEEDS):
        if keys.select(_hash("k", seed).alias("h")).distinct().count() == total:
            number = lambda c, seed=seed: _hash(c, seed)
            break
    else:
        number = F.col
    edges = star_components(pairs.select(number("a").alias("a"), number("b").alias("b")), scratch)
    # the least number of a component has no row of its own
    members = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), "v").distinct())
    known = scratch.cut(keys.select("k", number("k").alias("h")).join(members, F.col("h") == F.col("u"), "left").select("k", F.col("v").alias("c")))
    linked = known.filter("c IS NOT NULL")
    least = linked.groupBy(F.col("c").alias("of")).agg(F.min("k").alias("group_key"))
    groups = salted_join(linked, least, [("c", "of")], ["k"], "inner").select("group_key", F.col("k").alias("business_key"))
    return groups.unionByName(known.filter("c IS NULL").select(F.col("k").alias("group_key"), F.col("k").alias("business_key")))
