import json

from pyspark.sql import functions as F

from fieldloom.operators.reports import baseline_entries, browse_url, entry_point_lines, index_lines, pair_summary

P = "repo_id string, pair_id string, path string"


def test_pair_summary(spark):
    declared = spark.createDataFrame([("r", "p", "a", False), ("r", "p", "b", True), ("r", "p", "b", False), ("r", "p", "c", None), ("r", "q", "x", True), ("r", "q", "x", True)], f"{P}, ignored boolean")
    written = spark.createDataFrame([("r", "p", "a"), ("r", "p", "a"), ("r", "p", "b"), ("r", "p", "zz"), ("r", "q", None)], P)
    got = {r["pair_id"]: tuple(r)[2:] for r in pair_summary(declared, written).collect()}
    assert got == {"p": (3, 1, 1, 1, 50.0), "q": (1, 1, 0, 0, 100.0)}
    assert pair_summary(declared.limit(0), written).collect() == []


def test_baseline_entries(spark):
    states = spark.createDataFrame([("r", "p", 3, 66.67, ["c", "b"]), ("r", "q", 0, None, None)], "repo_id string, pair_id string, target_field_count long, coverage_percent double, unmatched array<string>")
    got = {r["pair"]: r["entry"] for r in baseline_entries(states).collect()}
    assert got["r:p"] == '{"coverage_percent":66.67,"target_field_count":3,"unmatched":["b","c"]}'
    assert json.loads(got["r:q"]) == {"coverage_percent": None, "target_field_count": 0, "unmatched": []}


def test_urls_and_lines(spark):
    df = spark.createDataFrame([("e1", "p1", "t1", "a", "s.x", None, "rename", 4, "H.f"), ("e2", "p1", "t2", None, None, "f(\n 1 )|", None, None, "H.f"), ("e3", None, "t3", "b", None, None, "rename", 1, "H.f")], "id string, entry_point_id string, target_field_id string, target_path string, source_path string, expression string, kind string, line int, static_helper_fqn string")
    got = sorted(tuple(r) for r in entry_point_lines(df).select("part", "key", "markdown").collect())
    assert got == [(1, "e1", "| a | s.x | rename |"), (1, "e2", "| t2 | f( 1 )\\| |  |"), (2, "H.f", "- `H.f` used by 2")]
    urls = df.select(browse_url("u/{repo}/{file}#L{line}", F.lit("r"), F.lit("s"), F.col("id"), F.col("line")).alias("u")).collect()
    assert [r["u"] for r in urls] == ["u/r/e1#L4", None, "u/r/e3#L1"]
    points = spark.createDataFrame([("i", "a.B", "m", None, "c", None, None)], "id string, class_fqn string, method_name string, country string, clearing string, product string, edge_count long")
    assert tuple(index_lines(points).first()) == ("COMMON", "c", "COMMON", "a.B", "m", "i", "- B.m (? edges)")
