import datetime as dt
import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions.globs import ScopeRule, glob_regex, indexed, matches_any, scope_of, with_generated
from fieldloom.operators.coverage import drift, pair_coverage, synthetic_edges, unmatched
from fieldloom.operators.extract import assembled_entry_points, classify_value, code_lines, methods, setter_edges, source_path, units
from fieldloom.operators.facts import first_wins, insert_or_ignore, last_wins
from fieldloom.operators.graph import edges_by_key, graph_links, graph_nodes, inverted_index, search, text_atoms, top_entry_points, unverifiable
from fieldloom.operators.impact import impact
from fieldloom.operators import lineage as lineage_operator
from fieldloom.operators.leaves import java_leaves, xsd_elements, xsd_leaves
from fieldloom.operators.lineage import diff_versions, field_links, key_links, reach, trace
from fieldloom.plans.scratch import Scratch
from fieldloom.queries import lineage
from fieldloom.sinks.documents import write_pages
from fieldloom.sinks.snapshot import current_snapshot, table_digest, write_snapshot
from fieldloom.streaming.arrivals import arrivals_per_window, write_stream


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_last_and_first_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), ("a", 2, "z"), (None, 5, "n"), ("b", 1, "y")], "id string, seq long, v string")
    assert rows(last_wins(df, "id", "seq")) == sorted([("a", 3, None), (None, 5, "n"), ("b", 1, "y")], key=repr)
    assert rows(first_wins(df, "id", "seq"))[0] == ("a", 1, "x")
    assert rows(last_wins(df.limit(0), "id", "seq")) == []


def test_insert_or_ignore(spark):
    a = spark.createDataFrame([("a", 1)], "id string, v long")
    b = spark.createDataFrame([("a", 2), ("b", 3)], "id string, v long")
    assert rows(insert_or_ignore(a, b, "id")) == [("a", 1), ("b", 3)]


def test_impact(spark):
    fields = spark.createDataFrame([("s#a", "s", "a", None), ("s#a.b", "s", "a.b", "K"), ("s#ab", "s", "ab", None), ("t#x_y", "t", "x_y", None)], "id string, schema_id string, path string, business_key string")
    edges = spark.createDataFrame(
        [("e1", "s#a", "t#x_y", "p", 1, ""), ("e2", "s#a.b", "t#x_y", None, 2, "u"), ("e3", "s#ab", "t#x_y", "p", 3, None), ("e4", "s#a", "t#gone", "p", 4, None), ("e5", None, "t#x_y", "p", 5, None)],
        "id string, source_field_id string, target_field_id string, entry_point_id string, line int, browse_url string",
    )
    points = spark.createDataFrame([("p", "DE", None, "C", "a.b.K", "m")], "id string, country string, clearing string, product string, class_fqn string, method_name string")
    seeds = spark.createDataFrame([("s", "a"), ("s", "a"), ("t", "a"), (None, "a")], "schema_id string, path string")
    got = rows(impact(edges, fields, points, seeds), "id", "source_path", "country", "clearing", "browse_url")
    assert got == [("e1", "a", "DE", "COMMON", None), ("e2", "a.b", "COMMON", "COMMON", "u")]


def test_coverage_and_drift(spark):
    paths = "repo_id string, pair_id string, path string"
    declared = spark.createDataFrame([("r", "p", x) for x in "abcdefgh"] + [("r", "q", "a")], paths)
    written = spark.createDataFrame([("r", "p", x) for x in "abcz"] + [("r", "o", "a")], paths)
    assert rows(pair_coverage(declared, written)) == [("r", "p", 8, 3, 37.5), ("r", "q", 1, 0, 0.0)]
    missing = unmatched(declared, written)
    assert len(rows(missing)) == 6
    ids = {r["target_path"]: r["id"] for r in synthetic_edges(missing).filter("pair_id = 'p'").collect()}
    assert ids == {x: "r.p.e_" + hashlib.sha1(f"unmapped\n{x}".encode()).hexdigest()[:8] for x in "defgh"}
    state = "repo_id string, pair_id string, coverage_percent double, unmatched array<string>"
    cur = spark.createDataFrame([("r", "p", 50.0, ["a", "c"]), ("r", "new", 10.0, ["x"]), ("r", "null", None, None)], state)
    base = spark.createDataFrame([("r", "p", 60.0, ["a", "b"]), ("r", "gone", 5.0, ["y"]), ("r", "null", None, ["z"])], state)
    got = {r["pair_id"]: (r["added"], r["removed"], r["coverage_drop"], r["regression"]) for r in drift(cur, base).collect()}
    assert got == {"p": (["c"], ["b"], 10.0, True), "new": (["x"], [], -10.0, True), "gone": ([], ["y"], 5.0, True), "null": ([], ["z"], 0.0, False)}
    assert not any(r["regression"] for r in drift(cur, cur).collect())
    assert not {r["pair_id"]: r["regression"] for r in drift(cur, base, max_added=1, max_drop=10.0).collect()}["p"]


def test_trace_equals_a_walk(spark):
    r = random.Random(3)
    links = {(r.randint(0, 30), r.randint(0, 30)) for _ in range(50)} | {(40, 41), (41, 40)}
    out = defaultdict(set)
    for a, b in links:
        out[a].add(b)
    expected = set()
    for seed in (0, 1, 2, 40, 99):
        level, seen = {seed}, {}
        for depth in range(1, 5):
            level = {y for x in level for y in out[x]} - set(seen)
            seen |= dict.fromkeys(level, depth)
        expected |= {(str(seed), str(f), k) for f, k in seen.items()}
    df = spark.createDataFrame([(str(a), str(b)) for a, b in links], "a string, b string")
    seeds = spark.createDataFrame([(x,) for x in ("0", "1", "2", "40", "99", None)], "seed string")
    assert set(rows(trace(df, seeds, max_depth=4))) == expected
    back = spark.createDataFrame([(str(b), str(a)) for a, b in links], "a string, b string")
    assert set(rows(trace(back, seeds, max_depth=4, upstream=True))) == expected


def test_walk_equals_joins(spark, monkeypatch):
    r = random.Random(5)
    links = {(f"s{r.randint(0, 5)}#{r.randint(0, 20)}", f"s{r.randint(0, 5)}#{r.randint(0, 20)}") for _ in range(300)} | {("hub", f"h#{i}") for i in range(200)}
    df = spark.createDataFrame(sorted(links), "a string, b string")
    seeds = spark.createDataFrame([(f"s{i}#{j}",) for i in range(6) for j in range(5)] + [("hub",), ("gone",), (None,), ("hub",)], "seed string")
    for upstream in (False, True):
        walked, joined = ([rows(f(df, seeds, 5, upstream, graph=g)) for f in (trace, reach)] for g in (None, False))
        assert walked == joined and all(walked)
    monkeypatch.setattr(lineage_operator, "CELLS", 3)  # one seed at a time, few links at once
    monkeypatch.setattr(lineage_operator, "STEP", 2)
    graph = lineage_operator._sent(df).value
    own = np.arange(len(graph.names))
    names = graph.names.to_pylist()
    got = [(names[block[s]], names[f], depth) for block in graph.blocks(own) for depth, of, to in graph.walk(block, 5, False) for s, f in zip(of, to, strict=True)]
    assert sorted(got) == rows(trace(df, spark.createDataFrame([(x,) for x in names], "seed string"), 5, graph=False))
    assert rows(trace(df.limit(0), seeds)) == rows(reach(df.limit(0), seeds)) == []


def test_traces_shuffle_no_pairs(spark, tmp_path):
    spark.createDataFrame([(f"s#{i}", f"s#{i + 1}") for i in range(9)], "source_field_id string, target_field_id string").write.parquet(f"{tmp_path}/edges.parquet")
    for name in ("q14_lineage_both_ways", "q15_impact_both_ways", "q15_impact_of_change", "q14_trace_lineage_up", "q14_trace_lineage_down"):
        plan = lineage.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[: plan.index("MapInArrow")] and "MapInArrow" in plan


def test_written_traces_repeat_little(spark, tmp_path):
    name = "sha2('{}' || id, 256)"
    hub = spark.range(20_000).selectExpr("'hub' || id % 2 AS a", f"{name.format('t')} AS b")
    links = hub.unionByName(spark.range(80).selectExpr(f"{name.format('s')} AS a", "'hub' || id % 2 AS b"))
    found = trace(links, spark.range(80).selectExpr(f"{name.format('s')} AS seed"))
    found.write.parquet(f"{tmp_path}/found")
    read = spark.read.parquet(f"{tmp_path}/found")
    assert read.count() == read.distinct().count() == 80 * 10_001
    assert sum(f.stat().st_size for f in (tmp_path / "found").glob("*.parquet")) < 8 * 80 * 10_001  # of about 130 bytes of text a row
    for upstream in (False, True):  # all ends, as the graph knows them and as joins find them
        few = spark.range(60).selectExpr("'f' || id % 20 AS a", "'f' || (id % 20 + id) AS b").filter("a <> b").distinct()
        assert rows(trace(few, None, upstream=upstream)) == rows(trace(few, None, upstream=upstream, graph=False)) != []


def test_trace_goes_on_by_business_key(spark):
    pairs = [("a", "b"), ("c", "d"), ("e", "e"), ("x", "b")]
    edges = spark.createDataFrame([*pairs, (None, "d")], "source_field_id string, target_field_id string")
    fields = spark.createDataFrame([("a", "S"), ("b", "K"), ("c", "K"), ("d", "L"), ("e", "L"), ("x", "S"), ("n", None)], "id string, business_key string")
    seeds = spark.createDataFrame([("a",)], "seed string")
    down = trace(field_links(edges), seeds, 7, keys=(fields, key_links(edges, fields)))
    assert rows(down) == [("a", "b", 1), ("a", "d", 2), ("a", "e", 3)]  # not from x, which only shares the key of the seed
    up = trace(field_links(edges), spark.createDataFrame([("d",)], "seed string"), 7, True, (fields, key_links(edges, fields, True)))
    assert rows(up) == [("d", "a", 2), ("d", "c", 1), ("d", "x", 2)]


def test_lineage_takes_chains_of_seven_links(spark, tmp_path):
    schema = "source_field_id string, target_field_id string"
    spark.createDataFrame([(f"s#{i}", f"s#{i + 1}") for i in range(9)], schema).write.parquet(f"{tmp_path}/edges.parquet")
    found = rows(lineage.q14_lineage_both_ways(spark, str(tmp_path)))
    assert found == sorted([("down", "s#0", f"s#{k}", k) for k in range(1, 8)] + [("up", "s#9", f"s#{9 - k}", k) for k in range(1, 8)], key=repr)
    assert rows(lineage.q15_impact_both_ways(spark, str(tmp_path))) == [("down", "s#0", 7, 7, 1), ("up", "s#9", 7, 7, 1)]


def test_graph_takes_two_thousand_entry_points(spark, tmp_path):
    columns = "'c.K' AS class_fqn, 'm' AS method_name, 's' AS method_signature, 1 AS line, current_timestamp() AS seen_at, 1.0D AS resolution_percent"
    scope = "named_struct('country', 'DE', 'clearing', 'X', 'product', 'P') AS scope"
    spark.range(2001).selectExpr("'p' || id AS id", "id AS edge_count", *columns.split(", "), scope).write.parquet(f"{tmp_path}/entry_point.parquet")
    spark.range(1).selectExpr("'e' AS id", "'p7' AS entry_point_id", "'f' AS source_field_id", "'g' AS target_field_id", "1L AS ingest_seq").write.parquet(f"{tmp_path}/edges.parquet")
    top = lineage.o03_top_2000_entry_points(spark, str(tmp_path)).collect()
    assert {r["id"] for r in top} == {f"p{i}" for i in range(1, 2001)} and all(r["truncated"] for r in top)


def test_diff_versions(spark):
    schema = "id string, v long"
    a, b = spark.createDataFrame([("a", 1), ("b", None), ("c", 3)], schema), spark.createDataFrame([("b", None), ("c", 4), ("d", 1)], schema)
    assert rows(diff_versions(a, b, "id", ["v"])) == [("a", "removed"), ("c", "changed"), ("d", "added")]


def test_graph(spark):
    points = spark.createDataFrame([("p", 5, "a.K", "m"), ("q", 5, "a.L", "n"), ("r", None, "a.M", "o")], "id string, edge_count long, class_fqn string, method_name string")
    top = top_entry_points(points, 2)
    assert rows(top, "id", "truncated") == [("p", True), ("q", True)]
    edges = spark.createDataFrame([("1", "p", "f", "g"), ("2", "p", "f", "g"), ("3", "r", "f", "h"), ("4", "q", None, "f")], "id string, entry_point_id string, source_field_id string, target_field_id string")
    links = graph_links(edges, top)
    assert rows(links) == [("f", "p", "reads"), ("p", "g", "writes"), ("q", "f", "writes")]
    fields = spark.createDataFrame([("f", "x.y", "s")], "id string, path string, schema_id string")
    assert rows(graph_nodes(links, top, fields)) == [("f", "field", "x.y", "s"), ("g", "field", "g", None), ("p", "entry_point", "K.m", None), ("q", "entry_point", "L.n", None)]
    keyed = spark.createDataFrame([("1", "A", "A"), ("2", "A", "B"), ("3", None, None)], "id string, source_bk string, target_bk string")
    assert rows(edges_by_key(keyed), "business_key", "id") == [("A", "1"), ("A", "2"), ("B", "2")]


def test_search_and_atoms(spark):
    df = spark.createDataFrame([(1, "The IBAN, iban; über 3."), (2, None), (3, "iban über"), (4, "a.b.FieldMapper reads `txn.ref.x`, see https://x.y/z, m/A.java, pay.p.e_0123456789ab and 0123abc")], "doc_id long, text string")
    index = inverted_index(df, "doc_id", "text")
    assert rows(search(index, ["IBAN", "über", "iban"])) == [(1, 3), (3, 2)]
    atoms = text_atoms(df, "doc_id", "text")
    expected = {("mapper_fqn", "a.b.FieldMapper"), ("field_path", "txn.ref.x"), ("url", "https://x.y/z"), ("file_path", "m/A.java"), ("edge_id", "pay.p.e_0123456789ab"), ("sha", "0123abc")}
    assert {(k, a) for key, k, a in rows(atoms) if key == 4} == expected and {key for key, _, _ in rows(atoms)} == {4}
    known = spark.createDataFrame([("mapper_fqn", "a.b.FieldMapper"), ("url", "m/A.java"), (None, None)], "kind string, atom string")
    assert {(k, a) for k, a in rows(unverifiable(atoms, known), "kind", "atom")} == expected - {("mapper_fqn", "a.b.FieldMapper")}


@pytest.mark.parametrize(
    ("glob", "path", "found"),
    [("**/mapper/**", "mapper/a", 1), ("**/mapper/**", "x/y/mapper/a", 1), ("a/*.java", "a/b.java", 1), ("a/*.java", "a/c/b.java", 0), ("{x}/b", "a/b", 1), ("{x}/b", "a/c/b", 0), ("a.b", "aXb", 0), ("**", "", 1), ("a(b)+/*", "a(b)+/c", 1), ("**/a", "ba", 1), ("a/**/b", "a/b", 1), ("a/**/b", "a/c/d/b", 1)],
)
def test_globs(spark, glob, path, found):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(matches_any(F.col("p"), [glob])).first()[0] == bool(found)
    assert glob_regex("**/a", swallow_slash=False)[0] == "^.*/a$"
    assert not df.limit(1).select(matches_any(F.lit("a"), ["**/a"], swallow_slash=False)).first()[0] and df.select(matches_any(F.lit("x/a"), ["**/a"], swallow_slash=False)).first()[0]


def test_generated_sources_and_index(spark):
    assert with_generated(["m/src/main/java/**", "x/**", "m/src/main/java/a/*.java"]) == ["m/src/main/java/**", "x/**", "m/src/main/java/a/*.java", "m/target/generated-sources/annotations/**/*.java"]
    paths = {"a/B.java": True, "target/classes/B.java": False, "target/x/B.java": False, "m/target/generated-sources/x/B.java": True, "build/B.java": False, "build.java": True, "a/b.json": False, "B.java": True, "target/B.java": True}
    df = spark.createDataFrame([(p,) for p in [*paths, None]], "p string")
    assert dict(map(tuple, df.select("p", indexed(F.col("p"))).collect())) == paths | {None: None}


def test_scope_rules(spark):
    rules = [ScopeRule("**/mapper/common/**", scope={"product": "X"}), ScopeRule("**/{country}/{clearing}/*.java"), ScopeRule("**", r"(?P<product>[a-z]+)-.*")]
    df = spark.createDataFrame([(p,) for p in ("a/mapper/common/b.java", "x/sg/sg-fast/M.java", "k/cards-1.txt", "nothing", None)], "p string")
    for captures_win, country in ((True, "SG"), (False, "G")):  # a slash that is taken in leaves the glob's begin free to take all but one character
        got = [tuple(r["s"]) if r["s"] else None for r in df.select(scope_of(F.col("p"), rules, captures_win).alias("s")).collect()]
        assert got == [(None, None, "X", None), (country, "SG_FAST", None, None), (None, None, "CARDS", None), (None,) * 4, (None,) * 4]
    both = [ScopeRule("{country}/*", scope={"country": "ZZ"})]
    pair = df.filter("p = 'k/cards-1.txt'").select(scope_of(F.col("p"), both).alias("a"), scope_of(F.col("p"), both, captures_win=True).alias("b")).first()
    assert (pair["a"]["country"], pair["b"]["country"]) == ("ZZ", "K")


JAVA = """package a.b;

import c.D; import c.other.D;
import static x.Y.*;
/* a comment
   with out.setNothing("x");
 */
public class M {
    // out.setNothing("y");
    public Target map(Source src, int n) {
        Target out = new Target(); /* one line */
        out.setIban(src.getAcct().getIban());
        out.setName("a // b"); out.setAmt(1);
        if (n > 1) {
            out.setCode(Util.trim(src.getCode(), 3));
        }
        out.setKind(src.isX() ? src.getA() : "b"); out.setText(src.getA() + "-");
        out.setBox(new Box(src.getB()));
        return out;
    }
    void none() {
    }
}
"""


def test_extraction(spark):
    df = spark.createDataFrame([(1, "p/M.java", JAVA), (2, "q/M.JAVA", JAVA.replace("\n", "\r\n")), (3, "x.json", "{}"), (4, "n.java", None), (5, "e.java", "")], "file_id long, file string, content string")
    lines = code_lines(df)
    expected = [
        (12, "map", 10, "iban", "rename", "acct.iban", "high"), (13, "map", 10, "amt", "constant", None, "high"), (13, "map", 10, "name", "constant", None, "high"), (15, "map", 10, "code", "static_call", "code", "medium"),
        (17, "map", 10, "kind", "expression", "a", "medium"), (17, "map", 10, "text", "concat", "a", "medium"), (18, "map", 10, "box", "construction", "b", "medium"),
    ]
    edges = setter_edges(lines)
    for i in (1, 2):
        got = rows(edges.filter(F.col("file_id") == i), "line", "method", "method_line", "target_path", "kind", "source_path", "confidence")
        assert sorted(got, key=lambda x: (x[0], x[3])) == expected
    assert rows(methods(lines).filter("file_id = 1"), "line", "return_type", "method", "parameters") == [(10, "Target", "map", "Source src, int n"), (21, "void", "none", "")]
    unit = {r["file_id"]: r for r in units(df).collect()}
    assert (unit[1]["package"], unit[1]["class_name"], unit[5]["package"]) == ("a.b", "M", None)
    assert rows(assembled_entry_points(edges).filter("file_id = 1"), "method", "n_edges", "n_resolved", "resolution_percent") == [("map", 7, 5, 71.43)]


XSD = """<xs:schema xmlns:xs="u" xmlns:b="v"><xs:element name="Top"><xs:complexType><xs:sequence>
<xs:element name="a" type="xs:string"/>
<xs:element name="b"><xs:annotation><xs:appinfo><b:business-key> K &amp; L </b:business-key></xs:appinfo></xs:annotation><xs:complexType><xs:sequence>
<xs:element name="c"/><xs:element name="a"><xs:annotation><xs:appinfo><b:business-key>M</b:business-key></xs:appinfo></xs:annotation></xs:element>
</xs:sequence></xs:complexType></xs:element>
<xs:element name="d"><xs:complexType><xs:sequence><xs:element name="e"/></xs:sequence></xs:complexType></xs:element>
</xs:sequence></xs:complexType></xs:element></xs:schema>"""


NAMED = """<xs:schema xmlns:xs="u" xmlns:b="v"><xs:element name="Top" type="t:TopType"/><xs:complexType name="TopType"><xs:sequence>
<xs:element name="f20" type="xs:string"><xs:annotation><xs:appinfo><b:business-key>Ref</b:business-key></xs:appinfo></xs:annotation></xs:element>
<xs:element name="f32" type="Amount"/><xs:element name="skip"><xs:annotation><xs:appinfo><b:ignore> true </b:ignore></xs:appinfo></xs:annotation></xs:element>
<xs:element name="again" type="TopType"/><xs:element ref="x"/></xs:sequence></xs:complexType>
<xs:complexType name="Amount"><xs:sequence><xs:element name="value"/></xs:sequence><xs:choice><xs:element name="no"/></xs:choice></xs:complexType></xs:schema>"""


def test_xsd_leaves(spark):
    deep = "<s>" + "<element name='e'><complexType><sequence>" * 60 + "<element name='end'/>" + "</sequence></complexType></element>" * 60 + "</s>"
    df = spark.createDataFrame([(1, "a.xsd", XSD), (2, "b.xsd", XSD[:-3]), (3, "c.xsd", None), (4, "d.json", XSD), (5, "e.xsd", NAMED), (6, "f.xsd", deep)], "file_id long, file string, content string")
    scratch = Scratch(spark)
    got = rows(xsd_leaves(scratch.cut(xsd_elements(df.filter("file_id < 6"))), scratch), "file_id", "path", "business_key", "ignored", "type")
    assert got == [
        (1, "a", None, False, "xs:string"), (1, "b", "K & L", False, None), (1, "b.a", "M", False, None), (1, "b.c", None, False, None), (1, "d.e", None, False, None),
        (5, "again.f20", "Ref", False, "xs:string"), (5, "again.f32.value", None, False, None), (5, "again.skip", None, True, None),
        (5, "f20", "Ref", False, "xs:string"), (5, "f32.value", None, False, None), (5, "skip", None, True, None),
    ]
    assert rows(xsd_leaves(scratch.cut(xsd_elements(df.filter("file_id = 6"))), scratch), "path") == [(".".join(["e"] * 59 + ["end"]),)]
    assert xsd_leaves(scratch.cut(xsd_elements(df.limit(0))), scratch).collect() == []


def test_java_leaves(spark):
    text = 'class A {\n  @Field(businessKey = "K")\n  @Other\n  private String a;\n  protected List<X> b = f();\n  // private int no;\n  @FieldIgnore public static final int[] C = {1};\n  int hidden;\n  public void m() {}\n}'
    df = spark.createDataFrame([(1, "A.java", text), (2, "B.java", None)], "file_id long, file string, content string")
    assert rows(java_leaves(df), "line", "path", "type", "business_key", "ignored") == [(4, "a", "String", "K", False), (5, "b", "List<X>", None, False)]
    # an annotation before the visibility, in the same line, hides it
    spaced = spark.createDataFrame([(1, "A.java", text.replace("@FieldIgnore public", "@FieldIgnore\n  public"))], "file_id long, file string, content string")
    assert ("C", "int[]", True) in rows(java_leaves(spaced), "path", "type", "ignored")


@pytest.mark.parametrize(
    ("value", "kind", "path"),
    [('"a"', "constant", None), ("-1L", "constant", None), ("new A()", "construction", None), ("a + b", "concat", None), ("a.getB() != null ? a.getB() : c", "expression", "b"), ("Util.of(a.getB())", "static_call", "b"), ("a.getB().toString()", "format", "b"), ("a.getB().getC()", "rename", "b.c"), ("a", "rename", None), ("f(a)", "expression", None), (None, "expression", None)],
)
def test_values(spark, value, kind, path):
    df = spark.createDataFrame([(value,)], "v string")
    assert tuple(df.select(classify_value(F.col("v")), source_path(F.col("v"))).first()) == (kind, path)


def test_snapshot_is_named_by_content(spark, tmp_path):
    data = [(i, f"x{i % 7}", None if i % 3 else float(i)) for i in range(200)]
    df = spark.createDataFrame(data, "a long, b string, c double")
    other = spark.createDataFrame(list(reversed(data)), "a long, b string, c double").repartition(7).select("c", "a", "b")
    assert table_digest(df).first() == table_digest(other).first()
    assert table_digest(df).first() != table_digest(df.unionByName(df.limit(1))).first()
    root = f"file://{tmp_path}/s"
    with pytest.raises(FileNotFoundError):
        current_snapshot(spark, root)
    first = write_snapshot({"t": df}, root)
    assert write_snapshot({"t": other}, root) == first and current_snapshot(spark, root).endswith(first)
    assert spark.read.parquet(current_snapshot(spark, root) + "/t.parquet").count() == 200
    assert write_snapshot({"t": df.limit(0)}, root) != first


def test_pages_keep_their_order(spark, tmp_path):
    df = spark.createDataFrame([(f"m{i % 2}", i, f"e{i}", f"| {i} |") for i in reversed(range(40))], "mapper_id string, line int, edge_id string, markdown string")
    write_pages(df, f"file://{tmp_path}/p")
    lines = [x for f in sorted((tmp_path / "p").glob("part*")) for x in f.read_text().splitlines()]
    assert lines == [f"m{m}\t| {i} |" for m in (0, 1) for i in range(m, 40, 2)]


def test_stream_of_arrivals(spark, tmp_path):
    schema = "id string, at timestamp, n int"
    source, target, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "out", "cp"))
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    for batch in ([("a", at(1), 1), ("a", at(1), 1), ("b", at(1, 30), 1)], [("c", at(2, 5), 1), ("b", at(2), 2)], [("d", at(1, 50), 1), ("e", at(5), 1)], [("late", at(1, 1), 1), ("f", at(9), 1), (None, None, 1)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        stream = arrivals_per_window(spark.readStream.schema(schema).parquet(source), "id", "at", "1 hour", "1 hour")
        write_stream(stream, target, checkpoint).awaitTermination(120)
    got = sorted((r["window_start"].hour, r["n_rows"], r["n_keys"]) for r in spark.read.parquet(target).collect())
    # a repeated delivery is one; what is later than the watermark is left out, so each window is written once
    assert got == [(1, 3, 3), (2, 2, 2), (5, 1, 1)]
