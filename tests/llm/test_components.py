import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from fieldloom.llm import components
from fieldloom.llm.components import group_keys, normal_key
from fieldloom.plans import skew


def union_find(records, pairs):
    up = {r: r for r in records}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {(root(r), r) for r in records}


def check(spark, pairs, extra=()):
    records = [x for p in pairs for x in p] + list(extra)
    got = group_keys(spark.createDataFrame([(r,) for r in records] or [(None,)], "k string"), spark.createDataFrame(pairs, "a string, b string")).collect()
    expected = union_find({r for r in records if r is not None}, pairs)
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_chain_star_and_loners(spark):
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(120)]
    star = [("z", f"s{i}") for i in range(50)] + [("a0", f"t{i}") for i in range(50)]
    check(spark, chain + star + [("x", "x"), (None, "y"), ("w", None), (None, None)], ["alone", "", None, "alone"])


def test_empty(spark):
    check(spark, [])


def test_hot_key_is_salted(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS", 3)
    r = random.Random(5)
    check(spark, [("m", f"n{i}") for i in range(300)] + [(f"n{r.randint(0, 400)}", f"n{r.randint(0, 400)}") for _ in range(100)])


def test_keys_with_one_hash_are_told_apart(spark, monkeypatch):
    """Where hashes collide, the rounds run on the texts."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(components, "_hash", lambda key, seed: F.when(F.col(key).isNotNull(), F.length(key).cast("long")))
    check(spark, [("a", "b"), ("cc", "a"), ("x", "yy")], ["z"])


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 25).map(str) | st.none(), st.integers(0, 25).map(str)), max_size=30))
def test_random_graphs(spark, pairs):
    check(spark, pairs)


@pytest.mark.parametrize(("key", "normal"), [("  AbC\t", "abc"), ("\r\n", ""), (None, None), ("É ", "é")])
def test_normal_key(spark, key, normal):
    df = spark.createDataFrame([(key,)], "k string")
    assert df.select(normal_key(df["k"])).first()[0] == normal
