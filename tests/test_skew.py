from collections import Counter

from pyspark.sql import functions as F

from fieldloom.plans.skew import ROWS, Salts, bucket_of, salted_join


def test_a_hot_key_is_split_by_its_rows(spark):
    """With the real thresholds: a key of 100,000 rows gets salts in proportion, the others none, and no row is lost."""
    many = spark.range(160_000).select(F.when(F.col("id") < 100_000, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.pmod("id", F.lit(6_000)))).alias("k"), "id")
    few = spark.createDataFrame([("hot", 1), ("k7", 2), ("k7", 3), ("none", 4)], "name string, x int")
    salts = Salts(many, "k")
    assert list(salts.hot.values()) == [-(-100_000 // ROWS)]
    assert list(salts.hot) == [few.limit(1).select(bucket_of(F.lit("hot"))).first()[0]]
    salted = salts.many(many, ["k"], ["id"]).groupBy("k", "_salt").count().filter("k = 'hot'").collect()
    assert len(salted) == 5 and max(r["count"] for r in salted) < 1.2 * ROWS
    joined = salted_join(many, few, [("k", "name")], ["id"], "left", salts)
    assert sorted(joined.columns) == ["id", "k", "name", "x"]
    got = Counter((r["k"][:1], r["x"]) for r in joined.groupBy("k", "x").count().collect() for _ in range(r["count"]))
    plain = Counter((r["k"][:1], r["x"]) for r in many.join(few, F.col("k") == F.col("name"), "left").groupBy("k", "x").count().collect() for _ in range(r["count"]))
    assert got == plain and got["h", 1] == 100_000
    assert salted_join(many, few, [("k", "name")], ["id"], "left_semi").count() == many.join(few, F.col("k") == F.col("name"), "left_semi").count()


def test_empty_tables_and_null_keys(spark):
    none = spark.createDataFrame([], "k string, id long")
    few = spark.createDataFrame([("a", 1)], "name string, x int")
    assert salted_join(none, few, [("k", "name")], ["id"], "left").collect() == []
    nulls = spark.range(50_000).select(F.lit(None).cast("string").alias("k"), "id")
    assert list(Salts(nulls, "k").hot.values()) == [3]
    assert salted_join(nulls, few, [("k", "name")], ["id"], "left").filter("x IS NULL").count() == 50_000
    assert salted_join(nulls, few, [("k", "name")], ["id"], "inner").count() == 0
