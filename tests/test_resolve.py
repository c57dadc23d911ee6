import random

from pyspark.sql import functions as F

from fieldloom.functions.javascan import java_nodes
from fieldloom.operators.resolve import BROADCAST_ROWS, field_types, java_index, java_tree, setter_facts
from fieldloom.plans.scratch import Scratch
from fieldloom.queries import lineage

IMPL = """package p.mapper;
import p.model.Local; import p.model.Src; import p.q.Qualifiers; import p.u.Texts;
public class Impl extends Base {
  private Qualifiers quals = new Qualifiers();
  @Override public Local map(Src src, Other o) {
    if (src == null) { return null; }
    Local local = new Local(); Strange x = new Strange();
    x.setIban(src.getNothing());
    local.setIban(src.getField50K().getValue());
    local.setTxnRef(quals.reference(src));
    local.setPurpose(Texts.extract(1, src));
    local.setAgent(inherited.agent(src.getTxInfo()));
    local.setChannel("SW;IFT)"); local.setAmount(new Amount(src.getA()));
    String name = (String) src.getHeader().getName();
    local.setName(name); local.setSame(this.own(o));
    local.setBoth(src.getX() != null ? src.getX() : o.getY()); local.setText(src.getA() + "-");
    local.setWrapped(Unknown.trim(
        src.getLong(), 3)); local.setLoop(loop(src)); local.setWhole(src); local.setIs(src.isOpen());
    fill(local.getInner().getPart(), src);
    return local;
  }
  String own(Other other) { return other.getDeep().getEnd(); }
  String loop(Src s) { return loop2(s); }
  String loop2(Src s) { return loop(s); }
  void none(Src src) { Local local = null; local.setIban(src.getA()); }
}
"""
FILES = {
    "Impl": IMPL,
    "Base": "package p.mapper; import p.q.Agents; public class Base { protected Agents inherited; }",
    "Qualifiers": "package p.q; public class Qualifiers {\n public String reference(Src s)\n {\n  return s.getField20(); } String reference(int i) { return null; } }",
    "Agents": "package p.q; import p.u.Texts; public class Agents { String agent(Tx tx) { String t = \"\"; return Texts.bic(tx.getInst()); } class In { } }",
    "Texts": "package p.u; public final class Texts { private Texts() {} public static String extract(int i, Src s) { return s.getField70(); } static String bic(Inst i) { return i.getBic(); } }",
}


def frame(spark, files):
    return spark.createDataFrame([(i, "r", f"{n}.java", t) for i, (n, t) in enumerate(files.items())] + [(90, "r", "x.json", "{}"), (91, None, "N.java", None), (92, "r", "E.java", "")], "file_id long, repo_id string, file string, content string")


def test_sources_through_helpers(spark):
    scratch = Scratch(spark)
    got = {r["target_path"]: r for r in setter_facts(scratch.cut(java_tree(frame(spark, FILES))), scratch).collect()}
    short = {t: (r["kind"], r["source_path"], [s["kind"] for s in r["trail"] or []]) for t, r in got.items()}
    assert short == {
        "iban": ("rename", "field50K.value", []),
        "txnRef": ("qualifier", "field20", ["qualifier"]),
        "purpose": ("static_call", "field70", ["static_call"]),
        "agent": ("qualifier", "txInfo.inst.bic", ["static_call", "qualifier"]),
        "channel": ("constant", None, []),
        "amount": ("construction", None, []),
        "name": ("rename", "header.name", []),
        "same": ("expression", "deep.end", ["intra_class"]),
        "both": ("expression", "x", []),
        "text": ("concat", None, []),
        "wrapped": ("static_call", "long", ["wrapper_arg"]),
        "loop": ("expression", None, ["wrapper_arg"]),
        "whole": ("rename", None, []),
        "is": ("expression", None, []),
        "inner.part": ("enrichment", None, []),
    }
    assert got["agent"]["helper_fqn"] == "p.q.Agents.agent" and got["agent"]["trail"][0]["fqn"] == "p.u.Texts.bic" and got["purpose"]["helper_fqn"] == "p.u.Texts.extract"
    assert (got["same"]["source_type"], got["iban"]["source_type"], got["iban"]["line"], got["iban"]["class_fqn"]) == ("Other", "Src", 9, "p.mapper.Impl")


def test_plans_stay_short_whatever_the_rounds(spark, monkeypatch):
    calls = "".join(f" String f{i}(Src s) {{ return f{i + 1}(s); }}\n" for i in range(6))
    deep = "public class Deep { Local map(Src src) { Local local = new Local(); local.setIban(f0(src)); return local; }\n" + calls + " String f6(Src s) { return s.getEnd(); } }"
    scratch, scans = Scratch(spark), []
    cut = Scratch.cut
    monkeypatch.setattr(Scratch, "cut", lambda self, df: (scans.append(df._jdf.queryExecution().optimizedPlan().collectLeaves().size()), cut(self, df))[1])
    tree = scratch.cut(java_tree(frame(spark, FILES | {"Deep": deep})))
    got = {r["class_fqn"]: r["source_path"] for r in setter_facts(tree, scratch).filter("target_path = 'iban'").collect()}
    assert (got["Deep"], got["p.mapper.Impl"], max(scans) <= 12) == ("end", "field50K.value", True), max(scans)


def test_large_tables_are_not_broadcast_however_well_they_compress(spark):
    def joins(scratch, n):
        table = scratch.cut(spark.range(n).select("id", F.lit("x" * 50).alias("name")))
        group = scratch.group()
        parts = scratch.whole(group, [scratch.add(group, spark.range(n * i // 4, n * (i + 1) // 4)) for i in range(4)][0])
        found = spark.range(10).join(table.filter("id > 1"), "id").join(parts.select(F.col("id").alias("other")), F.col("id") == F.col("other"))
        assert found.count() == 8
        return found._jdf.queryExecution().executedPlan().toString()

    small, large = (joins(Scratch(spark, BROADCAST_ROWS), n) for n in (100, 30_000))
    assert small.count("BroadcastHashJoin") and not large.count("BroadcastHashJoin")


def test_query_without_broadcasts_of_written_tables(spark, tmp_path, monkeypatch):
    frame(spark, FILES).write.parquet(str(tmp_path / "source_file.parquet"))
    plans, write = [], Scratch._write
    monkeypatch.setattr(Scratch, "_write", lambda self, df, path: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(self, df, path))[1])
    monkeypatch.setattr(lineage, "BROADCAST_ROWS", 0)
    got = {r["target_path"]: (r["kind"], r["source_path"]) for r in lineage.QUERIES["x09_resolved_edges"](spark, str(tmp_path)).collect()}
    assert len(got) == 15 and (got["agent"], got["both"], got["loop"]) == (("qualifier", "txInfo.inst.bic"), ("expression", "x"), ("expression", None))
    # only joins of joins, whose size isn't taken from files, are left to the optimizer
    assert sum(p.count("BroadcastHashJoin") for p in plans) <= 2 and sum(p.count("SortMergeJoin") for p in plans) > 20


def test_helpers_are_followed_as_told(spark):
    scratch = Scratch(spark)
    tree = scratch.cut(java_tree(frame(spark, FILES)))
    got = {r["target_path"]: (r["kind"], r["source_path"], [s["kind"] for s in r["trail"] or []]) for r in setter_facts(tree, scratch, ["p.q.Q*"], ["x.*"], intra_class=False, overrides_only=True).collect()}
    assert got["txnRef"][:2] == ("qualifier", "field20") and got["agent"][1:] == ("txInfo", ["wrapper_arg"]) and got["purpose"][1:] == (None, ["wrapper_arg"]) and got["same"][1:] == (None, ["wrapper_arg"])


def test_index_and_empty(spark):
    scratch = Scratch(spark)
    tree = scratch.cut(java_tree(frame(spark, FILES | {"Base2": "package p.mapper; class Base { int x; }", "C1": "package c; class A extends B { } ", "C2": "package c; class B extends A { }"})))
    index = java_index(tree)
    assert {r["fqn"] for r in index.classes.collect()} == {"p.mapper.Impl", "p.mapper.Base", "p.q.Qualifiers", "p.q.Agents", "p.q.Agents$In", "p.u.Texts", "c.A", "c.B"}
    ids = {r["fqn"]: (r["file_id"], r["class_node"]) for r in index.classes.collect()}
    wanted = spark.createDataFrame([("r", *ids["p.mapper.Impl"], "inherited"), ("r", *ids["p.mapper.Impl"], "nope"), ("r", *ids["c.A"], "x")], "repo_id string, file_id long, class_node int, field string")
    assert [(r["field"], r["type_fqn"]) for r in field_types(wanted, index, scratch).collect()] == [("inherited", "p.q.Agents")]
    assert setter_facts(scratch.cut(tree.limit(0)), scratch).collect() == []


def test_scan_takes_any_text():
    r = random.Random(2)
    tokens = IMPL.split(" ") + ["{", "}", "(", ")", "\"", "/*", "@", "?", ":", "<", ">", "new", "class", "->"]
    for i in range(300):
        text = " ".join(r.choice(tokens) for _ in range(r.randint(0, 80)))
        for t in (text, IMPL[: i * 7], IMPL[i * 7 :]):
            assert all(p is None or p < n for n, p, *_ in java_nodes(t))
    java_nodes("class A { int f() { return " + "(" * 5000 + "x" + ")" * 5000 + "; } }")
