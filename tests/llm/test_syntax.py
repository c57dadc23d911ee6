import itertools
import json
import random
import shutil
import subprocess
import xml.parsers.expat

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldloom.llm import chart, lexers
from fieldloom.llm.chart import _plain, parse
from fieldloom.llm.grammar import Grammar, grammar
from fieldloom.llm.syntax import check_syntax, examine, syntax_rates

GOOD = """package a.b; import static java.util.Map.*; import java.util.List;
@Component("x") @Mapping(target = "a", source = {"b", "c"}) public final class A<T extends Comparable<T> & Runnable> extends B<T, Map<K, List<V>>> implements C, D {
  private static final int[] X = { 1, 2, }, Y[] = {{0x1F, 0b1_0}, {07, 1e3f}};
  static { X[0] >>>= 2; Y[0][1] >>= 1; } { i++; --j; }
  enum E { P, Q(1) { void f() {} }, ; int z; } record R(int a, String... b) implements C { R { if (a > 0) throw new X(); } } sealed interface S permits U, V {} non-sealed class U implements S {}
  @interface N { int v() default 3; String[] w() default {}; }
  <X> A(final int a, T... b) throws E { this(a, () -> {}, (x, y) -> x + y, (int x, int y) -> { return y; }, String[]::new, Map.Entry<K, V>::getKey, int[]::new, super::f); }
  default <Q> List<? super Q>[] m(A this, int a[], @Nn String s) { 
    outer: for (int i = 0, j = 1; i < n; i++, j--) { if (a[i] < b && c > d) continue outer; else break; }
    for (final var x : xs) do { y = x instanceof String s && !s.isEmpty() ? (String) x : (int) -1 + (T) (a) ; } while (true);
    try (var r = open(); s) { } catch (IOException | Err e) { } finally { }
    synchronized (this) { assert a > 1 : "x"; } switch (a) { case 1, 2: case 3: f(); default: }
    int q = switch (k) { case "a" -> 1; case "b", "c" -> { yield 2; } default -> throw new E(); };
    new int[3][]; new A<>() { int z; }.go(); a.new Inner(); this.<T>f(); A.super.g(); x = y = z; (a).b(); ;
    List<String>[] l = (List<String>[]) new List[2]; char c = '\\'' ; String t = \"\"\"
      text "quoted" \\n
      \"\"\"; Runnable z = (Runnable & Serializable) () -> f(); boolean yes = a < b == c > d; var yield = 1; record rec = null; int.class.x(); return null;
  } abstract int f(); ; }
"""
BAD = [
    "class A {", "class A { int x = ; }", "class A { void f() { a + b; } }", "class A { void f() { if (x) int y = 1; } }", "class A { f( }", "import a.b", "class A { String s = \"a; }", "class A { char c = ''; }",
    "class A { /* }", "class A { int x = a > > b; }", "class { }", "class A { void f() { try { } } }", "class A { void f() { else { } } }", "class A { int x }", "class A { List<> x; }", "}", "class A { int 9x; }",
    "class A { void f() { x.; } }", "class A { void f() { foo bar baz; } }", "int x;;", "package a; package b;", "class A { #x }", "class A { String s = \"\\q\"; }", "class A { enum E { A B } }", "class A { void f() { return } }", "class A { int a = goto; }",
]


def cost(language, kinds):
    return parse(grammar(language), kinds).cost


def valid_java(text):
    kinds = [k for k, _ in lexers.java(text)]
    return _plain(grammar("java"), [*kinds, "$"], [None] * (len(kinds) + 1))[-1] is None


def test_java_texts():
    assert cost("java", [k for k, _ in lexers.java(GOOD)]) == 0
    for text in ("", ";", "// only\n", "@X package a;", "module a.b { requires transitive c; exports a to b, c; }", "class A { int \\u0061 = '\\u0062'; }"):
        assert cost("java", [k for k, _ in lexers.java(text)]) == 0, text
    for text in BAD:
        assert cost("java", [k for k, _ in lexers.java(text)]) > 0, text


@pytest.mark.skipif(not shutil.which("javac"), reason="no compiler here")
def test_java_against_the_compiler(tmp_path):
    """The compiler's parser agrees, on texts made by dropping, doubling or swapping tokens of a good one."""
    (tmp_path / "P.java").write_text(
        "import javax.tools.*; import com.sun.source.util.*; import java.util.*; import java.nio.file.*; import java.net.URI;\n"
        "public class P { public static void main(String[] a) throws Exception { JavaCompiler c = ToolProvider.getSystemJavaCompiler();\n"
        " for (String line : Files.readAllLines(Path.of(a[0]))) { final String s = new String(Base64.getDecoder().decode(line), \"UTF-8\"); DiagnosticCollector<JavaFileObject> d = new DiagnosticCollector<>();\n"
        "  JavaFileObject f = new SimpleJavaFileObject(URI.create(\"string:///X.java\"), JavaFileObject.Kind.SOURCE) { public CharSequence getCharContent(boolean i) { return s; } };\n"
        "  ((JavacTask) c.getTask(null, null, d, List.of(\"--release\", \"17\"), null, List.of(f))).parse(); System.out.println(d.getDiagnostics().stream().noneMatch(x -> x.getKind() == Diagnostic.Kind.ERROR)); } } }\n"
    )
    base = "package a; import b.C; class A<T> extends B<T, Map<K, V>> { @X(y = 1) int f(int a, T... b) { if (a > 1) { g.h(a, x -> x.y()).k(); } else return (T) c[i] >>> 2; for (var z : q) w = z ? 1 : \"s\"; } int x = 3; }"
    tokens = lexers.java(base)
    spans = [base[a:b] for (_, a), (_, b) in zip(tokens, [*tokens[1:], ("", len(base))], strict=True)]
    r = random.Random(3)
    texts = []
    for i in range(len(spans)):
        texts += ["".join(spans[:i] + spans[i + 1 :]), "".join(spans[: i + 1] + spans[i:]), "".join(spans[:i])]
        j = r.randrange(len(spans))
        texts.append("".join(spans[:i] + [" ", spans[j], " "] + spans[i:]))
    import base64

    (tmp_path / "in").write_text("\n".join(base64.b64encode((t or " ").encode()).decode() for t in texts))
    said = subprocess.run(["java", "P.java", "in"], cwd=tmp_path, capture_output=True, text=True, timeout=300).stdout.split()
    assert len(said) == len(texts)
    different = [t for t, x in zip(texts, said, strict=True) if valid_java(t or " ") != (x == "true")]
    # the compiler's parser also checks some rules beyond the grammar (a modifier given twice, a method without type)
    assert len(different) <= 0.02 * len(texts), different


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='{}[]",:0123e.-+ntrfalsu\\ \n', max_size=14) | st.recursive(st.none() | st.booleans() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=4), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=8).map(json.dumps))
def test_json_against_the_library(text):
    try:
        json.loads(text, parse_constant=lambda x: 1 / 0)
        valid = True
    except (ValueError, ZeroDivisionError):
        valid = False
    assert (examine("json", text)[1] == 0) == valid


XML = ["<a/>", "<a b='1' c=\"&lt;&#65;\"/>", "<?xml version='1.0' encoding='UTF-8'?>\n<a:b><![CDATA[<<]]>x &amp; y<c/><!-- - --></a:b>\n", "<a></b>", "<a", "<a b=1/>", "<a b='1' b='2'/>", "<a>&nope;</a>", "<a/><b/>", "x<a/>", "<a>]]></a>", "<a><!-- -- --></a>", " <?xml version='1.0'?><a/>", "<a><?xml x?></a>", "<!DOCTYPE a [<!ENTITY e 'x'>]><a>&e;</a>", "", "<a b='<'/>", "<a>\x01</a>", "<a >\n</a >", "<1a/>", "<a>&#0;</a>", "<a\n<<<<<<< HEAD\n/>", "\ufeff<a/>", "<é/>"]


@pytest.mark.parametrize("text", XML)
def test_xml_against_the_library(text):
    parser = xml.parsers.expat.ParserCreate("utf-8")
    try:
        parser.Parse(text.encode(), True)
        valid = True
    except xml.parsers.expat.ExpatError:
        valid = False
    assert (examine("xsd", text)[1] == 0) == valid


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last if x == y else min(row[j], row[j - 1]) + 1
    return row[-1]


SMALL = [
    "\nStart = List '$';\nList = '(' ( Item ( ',' Item )* )? ')';\nItem = 'x' | List '!'? | 'k' Item;\n",
    "\nStart = Sum '$';\nSum = Sum '+' 'x' | 'x' | '(' Sum ')' | Call;\nCall = 'k' '(' Sum? ')' | 'k' ',' Sum '!';\n",
    "\nStart = A* '$';\nA = '(' B '!';\nB = 'x' A? ')' | ',';\n",
]


@pytest.mark.parametrize("rules", SMALL)
def test_cost_is_the_least_number_of_edits(rules):
    """Against all sentences of a small grammar, up to a length, with edits anywhere."""
    small = Grammar(rules)
    alphabet = sorted(small.terminals - {"$"})
    longest = 7 if len(alphabet) < 6 else 6
    valid = lambda s: _plain(small, [*s, "$"], [None] * (len(s) + 1))[-1] is None
    sentences = [s for n in range(longest + 1) for s in itertools.product(alphabet, repeat=n) if valid(s)]
    assert len(sentences) >= 7
    r = random.Random(1)
    for _ in range(300):
        text = [r.choice([*alphabet, "?"]) for _ in range(r.randint(0, 4))]
        found = parse(small, text)
        least = min(distance(text, s) for s in sentences)
        assert found.exact
        if least > longest + 1 - len(text):  # a longer sentence might be nearer
            continue
        assert (found.cost, found.least, found.exact) == (least, least, True), (text, found, least)
        mended = list(text)
        for way, at, token in reversed(found.edits):
            if way == "delete":
                del mended[at : at + 1]
            elif token:
                mended.insert(at, token)
        if all(token for _, _, token in found.edits):
            assert valid(mended)


def test_a_search_that_is_given_up_gives_bounds():
    text = "class A {\n" + " int x = ;\n" * 6 + " int y = 1;\n" * 30 + "}"
    kinds = [k for k, _ in lexers.java(text)]
    full, short = parse(grammar("java"), kinds), parse(grammar("java"), kinds, budget=5)
    assert (full.cost, full.least, full.exact) == (6, 6, True)
    assert not short.exact and 1 <= short.least <= 6 <= short.cost


@pytest.mark.parametrize(
    ("language", "text"),
    [
        ("java", "class A {\n" + " void f() { if (a) { b(c(1)); } }\n" * 8 + " int x = ;\n void g() { h(; }\n" + " int y = 1;\n" * 20 + "}"),
        ("json", "[" + ", ".join(['{"a": [1, true]}'] * 20) + ' {"b" 1}, ' + ", ".join(['{"a": [1, true]}'] * 20) + "]"),
        ("xsd", "<a>" + "<b><c/></b>" * 10 + "<b><c></b>" + "<b><c/></b>" * 10 + "</d>"),
        ("java", "import os\n\ndef f(src):\n    out = {}\n    out['a'] = src.get('b')\n    return out\n"),
    ],
)
def test_a_table_of_bounds_kept_in_parts_gives_the_same(monkeypatch, language, text):
    whole = examine(language, text)
    monkeypatch.setattr(chart, "CELLS", 1)  # the least: two blocks at a time
    assert examine(language, text) == whole


def test_a_long_text_is_searched_as_a_short_one():
    items = [f'"k{i}": {{"a": [{i}, true]}}' for i in range(2_200)]
    text = "{" + ",\n".join(items[:1_100]) + "\n" + ",\n".join(items[1_100:]) + "}"
    assert examine("json", text) == (26_400, 1, True, 1_101, "error")


@pytest.mark.parametrize(
    ("language", "text", "line", "reason"),
    [
        ("java", "class A {\n int x;\n void f() { a.b(", 3, "truncation"),
        ("java", "class A {\n String s = \"abc", 2, "truncation"),
        ("java", "class A {\n int a;\n<<<<<<< HEAD\n int b;\n=======\n int c;\n>>>>>>> x\n}", 3, "conflict"),
        ("java", "# Title\n\nSome words about it. And more of them here.", 1, "mismatch"),
        ("java", '{"a": [1, 2, 3], "b": {"c": null}}', 1, "mismatch"),
        ("java", "class A {\n int x = 3\n int y;\n}", 3, "error"),
        ("json", '{"a": [1, 2', 1, "truncation"),
        ("json", '{"a": 1,\n"b" 2, "c": 3}', 2, "error"),
        ("xsd", "<a>\n<b>\n", 2, "truncation"),
        ("java", "class A {\n  String s = \"\"\"\n<<<<<<< HEAD\n\"\"\";\n}", None, None),
        ("json", "", 1, "mismatch"),
    ],
)
def test_reasons(language, text, line, reason):
    assert examine(language, text)[3:] == (line, reason)


@pytest.mark.parametrize("end", ["</xs:schema", "</", "<", "<xs:annotation><xs:a", "<a b", "<a b=", "<a b='x > ", "<a b='1' ", "<a/", "<!", "<!-- <b> and", "<!-- x --", "<![CDATA[ <x>", "<![CD", "<?x y ?", "text &am"])
def test_xml_cut_inside_a_token_is_truncation(end):
    head = "<xs:schema>\n<b/>\n"
    tokens = lexers.xml(head + end)
    assert tokens[-1][0] == "ERROR" and examine("xsd", head + end)[4] == "truncation"


@pytest.mark.parametrize(("language", "text"), [("xsd", "<a>\n<x/>\n<b c=d></b>\n<x/></a>"), ("xsd", "<a>\n<b><1/></b></a>"), ("xsd", "<a>\n<b/> x < y "), ("java", "class A {\n int x; }\n#"), ("json", '{"a": [1, 2,\n #')])
def test_what_no_cut_explains_is_an_error(language, text):
    assert examine(language, text)[4] == "error"


@pytest.mark.parametrize(
    ("language", "text", "cost", "reason"),
    [
        ("java", "class A {\n" + " int x = ;\n" * 6 + " int y = 1;\n" * 30 + "}", 6, "error"),
        ("java", "class A {\n" + " int x = 1\n int y = 2;\n int z = f(y);\n" * 6 + "}", 6, "error"),
        ("java", "class A {\n int a;\n>>>>>>> feature/x\n int b;\n}", 1, "conflict"),
        ("java", "class A {\n int a;\n=======\n int b;\n}", 1, "conflict"),
        ("json", '{"a": 1,\n>>>>>>> x\n"b": 2}', 1, "conflict"),
        ("java", "const x = require('y');\nclass A {\n  constructor(a) { this.a = a; }\n  async b() { const c = await f(`x`); return c }\n  d = (x) => x.y\n}\nmodule.exports = A\n", None, "mismatch"),
        ("java", "import os\n\ndef f(src):\n    out = {}\n    out['a'] = src.get('b')\n    return out\n", None, "mismatch"),
        ("java", "return x; }\n public X f(Y y) {\n X x = new X();\n x.a(y.b());\n x.c(y.d());\n return x;\n }\n}", None, "truncation"),
        ("json", "- a: 1\n  b: [x, y]\n- a: 2\n  b: []\n", None, "mismatch"),
        ("xsd", "just words", None, "mismatch"),
    ],
)
def test_costs_and_reasons(language, text, cost, reason):
    found = examine(language, text)
    assert found[4] == reason and (cost is None or found[1:3] == (cost, True)), found


def test_type_arguments_that_close_at_the_begin_of_a_line():
    text = "class A {\n L<L<L<L<L<L<L<B\n>>>>>>> x;\n}"
    assert examine("java", text)[1] == 0 and examine("java", text.replace("L<B", "B"))[4] == "conflict"


def test_end_tags_match_by_name():
    assert examine("xsd", "<a><b></b></a>")[1] == 0
    assert examine("xsd", "<a><b></a></b>")[1:3] == (2, True)
    assert examine("xsd", "<a><b><c></b></a>")[1:3] == (1, True)
    assert examine("xsd", "<a><b></c></b></a>")[1:3] == (1, True)


def test_many_tag_names_are_no_work():
    import time

    text = "<r>" + "".join(f"<n{i}><m{i}/></n{i}>" for i in range(800)) + "</r>"
    examine("xsd", "<a/>")
    begin = time.process_time()
    assert examine("xsd", text)[1] == 0
    assert time.process_time() - begin < 1
    assert examine("xsd", text.replace("</n400>", ""))[1:3] == (1, True)


def test_very_long_texts():
    """Too long for the table of bounds: flagged all the same, with bounds of the cost."""
    text = "class A {\n" + " int x = f(1);\n" * 4_000 + " int y = ; }\n"
    n, cost, exact, line, reason = examine("java", text)
    assert (cost >= 1, line, reason) == (True, 4_002, "error")
    assert examine("java", text.replace("= ;", "= 1;"))[1] == 0


def test_files(spark):
    rows = [(1, "a/B.java", "class B {}", "r"), (2, "a/B.java", "class B {", "r"), (3, "./c.json", "{}", "r"), (4, "c.json", None, None), (5, "d.txt", "x", "r"), (6, None, "x", "r"), (7, "e.XSD", "<a>", "q"), (8, "dots.java", "class B { int x; }\r\n" + "// long\n" * 20_000, "r")]
    files = spark.createDataFrame(rows, "file_id long, file string, content string, repo_id string")
    got = {r["file_id"]: (r["language"], r["edit_cost"], r["reason"]) for r in check_syntax(files).collect()}
    assert got == {1: ("java", 0, None), 2: ("java", 1, "truncation"), 3: ("json", 0, None), 4: ("json", None, "missing"), 7: ("xsd", 1, "truncation"), 8: ("java", 0, None)}
    coverage = spark.createDataFrame([("r", "p", 5, [("a/B.java", "x")]), ("r", "p", None, None), ("r", "q", 2, []), ("z", "p", 1, [(None, None), ("c.json", "x")])], "repo_id string, pair_id string, files_scanned long, unparseable array<struct<file string, reason string>>")
    rates = {(r["repo_id"], r["language"]): (r["n_files"], r["n_flagged"], r["n_reported"], r["n_flagged_unreported"], r["files_scanned_reported"]) for r in syntax_rates(files, check_syntax(files), coverage).collect()}
    assert rates == {("r", "java"): (3, 1, 2, 0, 7), ("r", "json"): (1, 0, 0, 0, 7), (None, "json"): (1, 1, 0, 1, None), ("q", "xsd"): (1, 1, 0, 1, None)}
    assert check_syntax(files.limit(0)).collect() == []
