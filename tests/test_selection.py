import datetime as dt
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import selection
from fieldloom.operators.selection import hot_keys, per_key_quantiles, per_key_summary


def rows(seed=1, n=3000):
    r = random.Random(seed)
    keys = ["hot"] * 1000 + ["warm"] * 60 + [f"k{i}" for i in range(200)] + [None] * 100 + [""] * 30
    return [(r.choice(keys), r.choice([None, r.randint(-(2**62), 2**62), r.randint(-5, 5), 7]), dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=r.randint(0, 10**13)), r.choice("abc")) for _ in range(n)]


@pytest.mark.parametrize("broadcast_rows", [50_000, 0])
def test_quantiles_equal_a_sort(spark, broadcast_rows, monkeypatch):
    monkeypatch.setattr(selection, "BROADCAST_ROWS", broadcast_rows)
    data = rows()
    df = spark.createDataFrame(data, "k string, v long, t timestamp_ntz, rank string")
    probs = [0.0, 0.25, 0.5, 1.0]
    by = defaultdict(list)
    for k, v, *_ in data:
        if k is not None and v is not None:
            by[k].append(v)
    expected = {k: [len(v), *[sorted(v)[max(1, math.ceil(Fraction(str(p)) * len(v))) - 1] for p in probs]] for k, v in by.items()}
    got = {r["key_value"]: [r["n_values"], r["q_0"], r["q_25"], r["q_50"], r["q_100"]] for r in per_key_quantiles(df, ["k"], "v", probs).collect()}
    assert got == expected


def test_quantiles_of_times_keep_their_type(spark):
    df = spark.createDataFrame([("a", dt.datetime(1969, 12, 31, 23, 0, 0, 1)), ("a", dt.datetime(2024, 2, 29, 1, 2, 3, 4)), ("b", None)], "k string, t timestamp_ntz")
    got = per_key_quantiles(df, ["k"], "t", [0.5, 1.0]).collect()
    assert [(r["key_value"], r["q_50"], r["q_100"]) for r in got] == [("a", dt.datetime(1969, 12, 31, 23, 0, 0, 1), dt.datetime(2024, 2, 29, 1, 2, 3, 4))]


def test_quantiles_refuse_texts(spark):
    with pytest.raises(TypeError):
        per_key_quantiles(spark.createDataFrame([("a", "b")], "k string, v string"), ["k"], "v", [0.5])


@pytest.mark.parametrize("share", [0.02, 0.3, 1.0, 0.0001])
def test_hot_keys_equal_a_count(spark, share):
    data = rows(2)
    df = spark.createDataFrame(data, "k string, v long, t timestamp_ntz, rank string")
    expected = {("k", k, n) for k, n in Counter(x[0] for x in data).items() if k is not None and n >= Fraction(str(share)) * len(data)}
    expected |= {("rank", k, n) for k, n in Counter(x[3] for x in data).items() if n >= Fraction(str(share)) * len(data)}
    got = hot_keys(df, ["k", "rank"], share).collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_empty_and_null_only(spark):
    empty = spark.createDataFrame([], "k string, v long, t timestamp_ntz")
    nulls = spark.createDataFrame([(None, None, None)] * 3, "k string, v long, t timestamp_ntz")
    for df in (empty, nulls):
        assert hot_keys(df, ["k"], 0.02).collect() == []
        assert per_key_quantiles(df, ["k"], "v", [0.5]).collect() == []
        assert per_key_summary(df, ["k"], "v", "t").collect() == []


def test_summary(spark):
    data = rows(3, 500)
    df = spark.createDataFrame(data, "k string, v long, n_rows timestamp_ntz, key_name string")
    by = defaultdict(list)
    for x in data:
        if x[0] is not None:
            by[x[0]].append(x)
    got = {r["key_value"]: (r["n_rows"], r["n_distinct"], r["last_value"]) for r in per_key_summary(df, ["k"], "v", "n_rows").collect()}
    assert got == {k: (len(x), len({y[1] for y in x} - {None}), max(y[2] for y in x)) for k, x in by.items()}


def test_one_row_per_bin_and_task_moves(spark, monkeypatch):
    """A hot key's values don't cross the shuffle: what the bins' exchange reads is merged in each task first."""
    from fieldloom.operators import selection
    from fieldloom.plans.scratch import Scratch

    cuts, cut = [], Scratch.cut

    def watched(self, df):
        cuts.append(df)
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("partial_count") >= 1, plan
        return cut(self, df)

    monkeypatch.setattr(Scratch, "cut", watched)
    data = spark.range(200_000).select(F.lit("a").alias("g"), F.xxhash64("id").alias("v"))
    found = selection.select_ranks(data, spark.createDataFrame([("a", 100_000), ("a", 1)], "g string, rank long"), Scratch(spark)).collect()
    values = sorted(r["v"] for r in data.select("v").collect())
    assert {(r["rank"], r["v"]) for r in found} == {(1, values[0]), (100_000, values[99_999])} and len(cuts) > 1
