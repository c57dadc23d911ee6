import datetime as dt
import random
from collections import Counter

from fieldloom.operators.orphans import Child, Parent, find_orphans, orphan_report
from fieldloom.plans import skew

DAY = [dt.datetime(2024, 1, 1) + dt.timedelta(days=i) for i in range(60)]


def frames(spark, parents, children):
    p = spark.createDataFrame(parents, "id string, seen timestamp_ntz, gone timestamp_ntz, step int")
    c = spark.createDataFrame(children, "seq long, ref string, other string, at timestamp_ntz, key string")
    return [Parent("p", p, "id", "seen", "gone")], [Child("c", c, {"ref": "p", "other": "p"}, "seq", "at")]


def brute(parents, children):
    return {
        (column, c[0])
        for c in children
        for column, ref in (("ref", c[1]), ("other", c[2]))
        if ref is not None and not any(p[0] == ref and c[3] is not None and p[1] is not None and p[1] <= c[3] and (p[2] is None or p[2] > c[3]) for p in parents)
    }


def check(spark, parents, children):
    ps, cs = frames(spark, parents, children)
    got = find_orphans(ps, cs).collect()
    expected = brute(parents, children)
    assert {(r["column_name"], r["ingest_seq"]) for r in got} == expected and len(got) == len(expected)
    report = orphan_report(find_orphans(ps, cs), cs).collect()
    times = {c[0]: c[3] for c in children}
    month = lambda t: t and t.strftime("%Y-%m")
    assert {(r["column_name"], r["period"]): r["n_orphans"] for r in report if r["n_orphans"]} == Counter((a, month(times[s])) for a, s in expected)


def test_limits_of_a_lifetime(spark):
    parents = [("a", DAY[3], DAY[6], 1), ("a", DAY[8], None, 1), ("b", None, None, 1), ("c", DAY[5], DAY[4], 1), ("d", DAY[5], DAY[5], 1), ("", DAY[0], None, 1), (None, DAY[0], None, 1)]
    children = [(i, k, None, DAY[i], "x") for i, k in enumerate(["a"] * 10)] + [(100 + i, k, "a", DAY[5], "x") for i, k in enumerate(["b", "c", "d", "", None, "A", "a "])]
    check(spark, parents, [*children, (200, "a", None, None, "x")])


def test_random_with_ties_and_salt(spark, monkeypatch):
    r = random.Random(7)
    parents = [(r.choice("abcd"), r.choice([*DAY[:20], None]), r.choice([None, *DAY[:20]]), 1) for _ in range(12)] * 2
    children = [(i, r.choice(["a", "b", "c", "e", None]), r.choice("ab"), r.choice([*DAY[:20], None]), "x") for i in range(300)]
    check(spark, parents, children)
    monkeypatch.setattr(skew, "ROWS", 5)
    check(spark, parents, children)


def test_empty_tables(spark):
    check(spark, [], [])
    check(spark, [], [(1, "a", None, DAY[0], "x")])
