"""Where the values come from that Java methods set: an index of classes, and source paths resolved through locals, getters and helpers.

A file's text becomes nodes with parents (``java_tree``); all else is joins on them. An expression has alternatives in a fixed order, each resting on
another expression or on what a called method returns; of each, the first one that resolves counts. Rounds evaluate what rests only on what is known,
so they are as many as the longest way through nested expressions and helpers, whatever the number of files.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.globs import matches_any
from fieldloom.functions.javascan import java_nodes
from fieldloom.functions.text import decapitalised
from fieldloom.plans.scratch import Scratch
from fieldloom.plans.spread import spread

TREE = "repo_id string, file_id long, node int, parent int, method int, role string, ordinal int, kind string, name string, text string, line int"
_ARROW = pa.schema([("repo_id", pa.string()), ("file_id", pa.int64()), *[(c, pa.int32()) for c in ("node", "parent", "method")], ("role", pa.string()), ("ordinal", pa.int32()), *[(c, pa.string()) for c in ("kind", "name", "text")], ("line", pa.int32())])
BATCH = 20_000
#: For the ``Scratch`` of trees and what is found in them: larger tables aren't broadcast.
BROADCAST_ROWS = 20_000


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list = []

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)
        rows.clear()
        return out

    for batch in batches:
        for repo, file_id, text in zip(*(batch.column(i) for i in range(3)), strict=True):
            rows.extend((repo.as_py(), file_id.as_py(), *x) for x in (java_nodes(text.as_py()) if text.is_valid else ()))
            if len(rows) >= BATCH:
                yield flush()
    if rows:
        yield flush()


def java_tree(files: DataFrame) -> DataFrame:
    """The nodes of the Java files, ``repo_id, file_id`` and those of ``java_nodes``; a null content has none, of an invalid one what is found."""
    java = files.filter(F.lower(F.substring_index("file", ".", -1)) == "java").select("repo_id", F.col("file_id").cast("long"), "content")
    return spread(java, "file_id").mapInArrow(_trees, TREE)


def _simple(type_: Column) -> Column:
    return F.trim(F.regexp_replace(type_, r"[<\[].*", ""))


def class_matches(fqn: Column, globs: list[str]) -> Column:
    """Whether a full class name matches a glob: ``*`` is one part of it, ``**`` any parts."""
    return matches_any(F.translate(fqn, ".", "/"), [g.replace(".", "/") for g in globs])


@dataclass
class JavaIndex:
    """Classes by name, with the methods, fields and imports of their files."""

    classes: DataFrame
    methods: DataFrame
    fields: DataFrame
    imports: DataFrame
    packages: DataFrame

    def written(self, scratch: Scratch) -> JavaIndex:
        """The same, written once: else the plan of each join on it begins with the tree again."""
        return JavaIndex(*(scratch.cut(t) for t in (self.classes, self.methods, self.fields, self.imports, self.packages)))


def java_index(tree: DataFrame) -> JavaIndex:
    """The index of a written tree.

    classes: ``repo_id, fqn, file_id, class_node, extends`` (of a class found in several files the one with the least id); methods: ``file_id, class_node, method, name, returns,
    is_override, line``; fields: ``file_id, class_node, field, type``; imports: ``file_id, simple, fqn`` (the first of a name wins); packages: ``file_id, package``.
    """
    packages = tree.filter("kind = 'package'").groupBy("file_id").agg(F.min_by("name", "node").alias("package"))
    imports = tree.filter("kind = 'import' AND role IS NULL").groupBy("file_id", F.substring_index("name", ".", -1).alias("simple")).agg(F.min_by("name", "node").alias("fqn"))
    named = tree.filter("kind = 'class'").join(packages, "file_id", "left").select("repo_id", F.concat_ws(".", "package", "name").alias("fqn"), "file_id", F.col("node").alias("class_node"), F.col("text").alias("extends"))
    classes = named.groupBy("repo_id", "fqn").agg(F.min(F.struct("file_id", "class_node", "extends")).alias("c")).select("repo_id", "fqn", "c.*")
    methods = tree.filter("kind = 'method'").select("file_id", F.col("parent").alias("class_node"), F.col("node").alias("method"), "name", F.col("text").alias("returns"), (F.col("role") == "override").alias("is_override"), "line")
    fields = tree.filter("kind = 'field'").groupBy("file_id", F.col("parent").alias("class_node"), F.col("name").alias("field")).agg(F.min_by(_simple(F.col("text")), "node").alias("type"))
    return JavaIndex(classes, methods.withColumn("is_override", F.coalesce("is_override", F.lit(False))), fields, imports, packages)


def resolve_simple(refs: DataFrame, index: JavaIndex, name: str, out: str) -> DataFrame:
    """refs (``repo_id, file_id`` and a simple name) with the full name: as imported, else of the same package if there is such a class, else as it is."""
    imports = index.imports.select(F.col("file_id").alias("_if"), F.col("simple").alias("_is"), F.col("fqn").alias("_imported"))
    packages = index.packages.select(F.col("file_id").alias("_pf"), "package")
    known = index.classes.select(F.col("repo_id").alias("_cr"), F.col("fqn").alias("_near"))
    joined = refs.join(imports, (F.col("file_id") == F.col("_if")) & (F.col(name) == F.col("_is")), "left").join(packages, F.col("file_id") == F.col("_pf"), "left")
    joined = joined.join(known, F.col("repo_id").eqNullSafe(F.col("_cr")) & (F.concat_ws(".", "package", name) == F.col("_near")), "left")
    return joined.withColumn(out, F.coalesce("_imported", "_near", name)).drop("_if", "_is", "_imported", "_pf", "package", "_cr", "_near")


def field_types(wanted: DataFrame, index: JavaIndex, scratch: Scratch) -> DataFrame:
    """The types of fields, inherited ones too: wanted ``repo_id, file_id, class_node, field`` with ``type_fqn``; those without are left out.

    The way goes up by what a class extends, each class once, so a cycle ends.
    """
    group = scratch.group()
    left = wanted.select("repo_id", "file_id", "class_node", "field").distinct()
    left = left.select("*", F.col("file_id").alias("at_file"), F.col("class_node").alias("at_node"), F.array().cast("array<string>").alias("seen"))
    while True:
        own = index.fields.select(F.col("file_id").alias("_f"), F.col("class_node").alias("_n"), F.col("field").alias("_x"), "type")
        step = scratch.cut(left.join(own, (F.col("at_file") == F.col("_f")) & (F.col("at_node") == F.col("_n")) & (F.col("field") == F.col("_x")), "left").drop("_f", "_n", "_x"))
        typed = step.filter("type IS NOT NULL").select("repo_id", F.col("file_id").alias("from_file"), "class_node", "field", F.col("at_file").alias("file_id"), "type")
        here = resolve_simple(typed, index, "type", "type_fqn").select("repo_id", F.col("from_file").alias("file_id"), "class_node", "field", "type_fqn")
        part = scratch.add(group, here)
        above = index.classes.select(F.col("file_id").alias("_f"), F.col("class_node").alias("_n"), F.col("extends").alias("above")).filter("above IS NOT NULL")
        up = step.filter("type IS NULL").drop("type").join(above, (F.col("at_file") == F.col("_f")) & (F.col("at_node") == F.col("_n"))).drop("_f", "_n")
        up = up.select("repo_id", F.col("file_id").alias("from_file"), "class_node", "field", "seen", F.col("at_file").alias("file_id"), "above")
        up = resolve_simple(up, index, "above", "above_fqn").filter(~F.array_contains("seen", F.col("above_fqn")))
        classes = index.classes.select(F.col("repo_id").alias("_r"), "fqn", F.col("file_id").alias("at_file"), F.col("class_node").alias("at_node"))
        up = up.join(classes, F.col("repo_id").eqNullSafe(F.col("_r")) & (F.col("above_fqn") == F.col("fqn")))
        left = scratch.cut(up.select("repo_id", F.col("from_file").alias("file_id"), "class_node", "field", "at_file", "at_node", F.array_append("seen", F.col("above_fqn")).alias("seen")))
        if left.isEmpty():
            return scratch.whole(group, part)


def called_methods(tree: DataFrame, index: JavaIndex, scratch: Scratch, qualifiers: list[str], static_helpers: list[str], intra_class: bool) -> DataFrame:
    """The methods that calls lead to: ``file_id, node, step, fqn, to_file, to_method``; fqn is that of class and method, to_* null where the class isn't known.

    step: qualifier (on a field of the class), static_call (on a class) or intra_class (without receiver). Globs limit the classes of the first two.
    """
    calls = tree.filter("kind = 'call' AND method IS NOT NULL").select("repo_id", "file_id", "node", "method", F.col("name").alias("called"))
    receivers = tree.filter("role = 'receiver'").select(F.col("file_id").alias("_f"), F.col("parent").alias("_p"), F.col("kind").alias("receiver_kind"), F.col("name").alias("receiver"))
    owners = index.methods.select(F.col("file_id").alias("_mf"), F.col("method").alias("_m"), "class_node")
    own = calls.join(receivers, (F.col("file_id") == F.col("_f")) & (F.col("node") == F.col("_p")), "left").join(owners, (F.col("file_id") == F.col("_mf")) & (F.col("method") == F.col("_m")))
    own = scratch.cut(own.filter("receiver_kind IS NULL OR receiver_kind = 'ident'").drop("_f", "_p", "_mf", "_m"))
    on_field = own.filter("receiver RLIKE '^[a-z]'").withColumnRenamed("receiver", "field")
    types = field_types(on_field, index, scratch).withColumnsRenamed({"repo_id": "_r", "file_id": "_f", "class_node": "_n", "field": "_x"})
    same = (F.col("file_id") == F.col("_f")) & (F.col("class_node") == F.col("_n")) & (F.col("field") == F.col("_x"))
    by_field = on_field.join(types, same).filter(class_matches(F.col("type_fqn"), qualifiers)).select("repo_id", "file_id", "node", "called", F.lit("qualifier").alias("step"), F.col("type_fqn").alias("class_fqn"))
    static = resolve_simple(own.filter("receiver RLIKE '^[A-Z]'"), index, "receiver", "class_fqn")
    static = static.filter(class_matches(F.col("class_fqn"), static_helpers)).select("repo_id", "file_id", "node", "called", F.lit("static_call").alias("step"), "class_fqn")
    names = index.classes.select(F.col("file_id").alias("_f"), F.col("class_node").alias("_n"), F.col("fqn").alias("class_fqn"))
    bare = own.filter(F.col("receiver").isNull() & F.lit(intra_class)).join(names, (F.col("file_id") == F.col("_f")) & (F.col("class_node") == F.col("_n"))).select("repo_id", "file_id", "node", "called", F.lit("intra_class").alias("step"), "class_fqn")
    every = by_field.unionByName(static).unionByName(bare)
    first = index.methods.groupBy("file_id", "class_node", "name").agg(F.min("method").alias("to_method"))
    targets = index.classes.join(first, ["file_id", "class_node"]).select(F.col("repo_id").alias("_r"), F.col("fqn").alias("_c"), F.col("name").alias("_called"), F.col("file_id").alias("to_file"), "to_method")
    led = every.join(targets, F.col("repo_id").eqNullSafe(F.col("_r")) & (F.col("class_fqn") == F.col("_c")) & (F.col("called") == F.col("_called")), "left")
    return led.select("file_id", "node", "step", F.concat_ws(".", "class_fqn", "called").alias("fqn"), "to_file", "to_method")


_STEP = "struct<kind:string,fqn:string>"


def _alternatives(tree: DataFrame, calls: DataFrame, scratch: Scratch) -> DataFrame:
    """What an expression or method may be, in order: ``file_id, node, alt, on_file, on_node, member, step, fqn, applied``; on_* is what it rests on."""
    expressions = tree.filter("method IS NOT NULL AND role IS NOT NULL")
    child = tree.filter("role IS NOT NULL AND parent IS NOT NULL").select(F.col("file_id").alias("_f"), F.col("parent").alias("_p"), F.col("node").alias("on_node"), F.col("role").alias("_role"), F.col("ordinal").alias("_o"))
    below = scratch.cut(expressions.select("file_id", "node", "kind", "name").join(child, (F.col("file_id") == F.col("_f")) & (F.col("node") == F.col("_p"))))
    none, text = F.lit(None), lambda c: c.cast("string")
    row = lambda alt, member, step, fqn, on_file, applied: [F.col("file_id"), F.col("node"), alt.cast("int").alias("alt"), on_file.alias("on_file"), F.col("on_node"), text(member).alias("member"), text(step).alias("step"), text(fqn).alias("fqn"), F.lit(applied).alias("applied")]
    plain = below.filter("kind IN ('paren', 'cast', 'ternary')").select(*row(F.col("_o"), none, none, none, F.col("file_id"), False))
    getter = (F.col("kind") == "call") & F.col("name").rlike("^get.") & (F.col("_role") == "receiver")
    member = F.when(F.col("kind") == "member", F.col("name")).otherwise(decapitalised(F.substring("name", 4, 1_000_000)))
    chains = below.filter(getter | ((F.col("kind") == "member") & (F.col("_role") == "receiver"))).select(*row(F.lit(0), member, none, none, F.col("file_id"), False))
    wrapped = below.filter("kind = 'call' AND _role = 'arg'").select(*row(F.col("_o") + 2, none, F.lit("wrapper_arg"), none, F.col("file_id"), False))
    known = calls.filter("to_method IS NOT NULL").withColumnRenamed("to_method", "on_node")
    applied = known.select(*row(F.lit(1), none, F.col("step"), F.col("fqn"), F.col("to_file"), True))
    locals_ = tree.filter("kind = 'local'").groupBy("file_id", F.col("parent").alias("_m"), F.col("name").alias("_x")).agg(F.min("node").alias("_local")).withColumnRenamed("file_id", "_lf")
    begun = child.filter("_role = 'init'")
    ident = expressions.filter("kind = 'ident'").select("file_id", "node", "method", "name").join(locals_, (F.col("file_id") == F.col("_lf")) & (F.col("method") == F.col("_m")) & (F.col("name") == F.col("_x")))
    ident = ident.join(begun, (F.col("file_id") == F.col("_f")) & (F.col("_local") == F.col("_p"))).select(*row(F.lit(0), none, none, none, F.col("file_id"), False))
    # a method is its first return that resolves, else the first value that is set in it
    returns = tree.filter("kind = 'return'").select("file_id", F.col("parent").alias("node"), F.col("node").alias("_of"), F.col("ordinal").alias("_at"))
    returns = returns.join(child.filter("_role = 'value'"), (F.col("file_id") == F.col("_f")) & (F.col("_of") == F.col("_p"))).select(*row(F.col("_at"), none, none, none, F.col("file_id"), False))
    sets = tree.filter("kind = 'call' AND role = 'value' AND name RLIKE '^set.'").select("file_id", F.col("method").alias("node"), F.col("node").alias("_of"))
    sets = sets.join(child.filter("_role = 'arg' AND _o = 0"), (F.col("file_id") == F.col("_f")) & (F.col("_of") == F.col("_p"))).select(*row(F.col("_of") + 1_000_000, none, none, none, F.col("file_id"), False))
    group = scratch.group()
    for part in (plain, chains, wrapped, applied, ident, returns, sets):
        last = scratch.add(group, part)
    scratch.drop(below)
    return scratch.whole(group, last)


def resolve_values(tree: DataFrame, calls: DataFrame, scratch: Scratch) -> DataFrame:
    """What the expressions and methods resolve to: ``file_id, node, param, path, trail``; those that don't have no row.

    param is the ordinal of a parameter of the method around (of the method itself), path the members taken of it, empty for the parameter as it is. trail has a step
    for each helper gone through, the innermost first. A call of helpers that call each other isn't followed.
    """
    expressions = tree.filter("(method IS NOT NULL AND role IS NOT NULL AND kind <> 'method') OR kind = 'method'")
    params = tree.filter("kind = 'param'").groupBy(F.col("file_id").alias("_f"), F.col("parent").alias("_m"), F.col("name").alias("_x")).agg(F.min("ordinal").alias("param"))
    bound = expressions.filter("kind = 'ident'").join(params, (F.col("file_id") == F.col("_f")) & (F.col("method") == F.col("_m")) & (F.col("name") == F.col("_x")))
    group = scratch.group()
    start = scratch.add(group, bound.select("file_id", "node", F.lit(True).alias("ok"), "param", F.lit("").alias("path"), F.array().cast(f"array<{_STEP}>").alias("trail")))
    keys = start.select("file_id", "node")
    pending = scratch.cut(_alternatives(tree, calls, scratch).join(keys, ["file_id", "node"], "left_anti"))
    never = expressions.select("file_id", "node").join(keys, ["file_id", "node"], "left_anti").join(pending.select("file_id", "node").distinct(), ["file_id", "node"], "left_anti")
    fail = lambda df: df.select("file_id", "node", F.lit(False).alias("ok"), F.lit(None).cast("int").alias("param"), F.lit(None).cast("string").alias("path"), F.lit(None).cast(f"array<{_STEP}>").alias("trail"))
    scratch.add(group, fail(never))
    args = scratch.cut(tree.filter("role = 'arg'").select(F.col("file_id").alias("_af"), F.col("parent").alias("_ap"), F.col("ordinal").alias("_ao"), F.col("node").alias("_arg")))
    while not pending.isEmpty():
        done = scratch.whole(group, start)
        first = done.select(F.col("file_id").alias("_f1"), F.col("node").alias("_n1"), *[F.col(c).alias(f"{c}1") for c in ("ok", "param", "path", "trail")])
        second = done.select(F.col("file_id").alias("_f2"), F.col("node").alias("_n2"), *[F.col(c).alias(f"{c}2") for c in ("ok", "param", "path", "trail")])
        on = pending.join(first, (F.col("on_file") == F.col("_f1")) & (F.col("on_node") == F.col("_n1")), "left")
        # what a method does with its parameter is applied to the argument in its place
        given = on.join(args, F.col("applied") & F.col("ok1") & (F.col("file_id") == F.col("_af")) & (F.col("node") == F.col("_ap")) & (F.col("param1") == F.col("_ao")), "left")
        given = given.join(second, (F.col("file_id") == F.col("_f2")) & (F.col("_arg") == F.col("_n2")), "left")
        ok = F.when(~F.col("applied") | ~F.col("ok1"), F.col("ok1")).when(F.col("ok1") & F.col("_arg").isNull(), F.lit(False)).otherwise(F.col("ok2"))
        whole = lambda a, b: F.concat_ws(".", F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))
        path = F.when(F.col("applied"), whole(F.col("path2"), F.col("path1"))).otherwise(whole(F.col("path1"), F.col("member")))
        empty = F.array().cast(f"array<{_STEP}>")
        own_step = F.when(F.col("step").isNotNull(), F.array(F.struct(F.col("step").alias("kind"), "fqn"))).otherwise(empty)
        trail = F.when(F.col("applied"), F.concat(F.coalesce("trail2", empty), F.coalesce("trail1", empty), own_step)).otherwise(F.concat(F.coalesce("trail1", empty), own_step))
        value = given.withColumns({"ok": ok, "param": F.when(F.col("applied"), F.col("param2")).otherwise(F.col("param1")), "path": path, "trail": trail})
        value = scratch.cut(value.select(*pending.columns, "ok", "param", "path", "trail"))
        best = value.groupBy("file_id", "node").agg(F.min_by(F.struct("ok", "param", "path", "trail"), F.when(F.col("ok").isNull() | F.col("ok"), F.col("alt"))).alias("b"), F.count_if(F.col("ok").isNull() | F.col("ok")).alias("open"))
        settled = best.filter("open = 0 OR b.ok")
        rows = settled.select("file_id", "node", (F.col("open") > 0).alias("ok"), *[F.when(F.col("open") > 0, F.col(f"b.{c}")).alias(c) for c in ("param", "path", "trail")])
        new = scratch.add(group, rows)
        if new.isEmpty():
            # helpers that call each other: such a call isn't followed, and what has no other way fails
            cut = scratch.cut(value.filter("ok IS NULL OR ok").filter("NOT applied").select(*pending.columns))
            lost = value.select("file_id", "node").distinct().join(cut.select("file_id", "node").distinct(), ["file_id", "node"], "left_anti")
            if value.filter("applied AND (ok IS NULL OR ok)").isEmpty():
                break
            scratch.add(group, fail(lost))
            pending = cut
            continue
        left = value.filter("ok IS NULL OR ok").join(new.select("file_id", "node"), ["file_id", "node"], "left_anti").select(*pending.columns)
        before, pending = pending, scratch.cut(left)
        scratch.drop(before, value)
    return scratch.whole(group, start).filter("ok").drop("ok")


def _target_variables(tree: DataFrame, index: JavaIndex) -> DataFrame:
    """The variable that a method fills: its first local of the type it returns, else its first parameter of that type: ``file_id, method, variable``."""
    typed = tree.filter("kind IN ('local', 'param')").select("file_id", F.col("parent").alias("method"), "kind", "ordinal", F.col("name").alias("variable"), _simple(F.col("text")).alias("type"))
    returns = index.methods.select("file_id", "method", _simple(F.col("returns")).alias("returns")).filter("returns <> 'void'")
    fits = typed.join(returns, ["file_id", "method"]).filter("type = returns OR (kind = 'local' AND endswith(type, concat('.', returns))) OR (kind = 'param' AND substring_index(type, '.', -1) = returns)")
    return fits.groupBy("file_id", "method").agg(F.min(F.struct(F.col("kind") != "local", "ordinal", "variable"))["variable"].alias("variable"))


def setter_facts(tree: DataFrame, scratch: Scratch, qualifiers: list[str] | None = None, static_helpers: list[str] | None = None, intra_class: bool = True, overrides_only: bool = False) -> DataFrame:
    """What methods set on their target: ``repo_id, file_id, class_fqn, method, line, target_path, kind, expression, source_type, source_path, helper_fqn, trail, confidence``.

    tree: a written ``java_tree``, by a ``Scratch`` with a bound on broadcasts if it may be large. One row per call that sets a member of the target variable, and one of kind ``enrichment``, without source, per other call that is
    given a getter chain of it. The source is the path from a parameter, null where none is found (constants, constructions) or where it is the parameter itself; source_type
    is the parameter's type. qualifiers, static_helpers: globs for the classes that helpers are followed into; null for all.
    """
    index = java_index(tree).written(scratch)
    calls = scratch.cut(called_methods(tree, index, scratch, qualifiers or ["**"], static_helpers or ["**"], intra_class))
    values = scratch.cut(resolve_values(tree, calls, scratch))
    child = tree.filter("parent IS NOT NULL AND role IN ('receiver', 'arg')").select(F.col("file_id").alias("_f"), F.col("parent").alias("_p"), F.col("node").alias("_c"), F.col("role").alias("_role"), F.col("ordinal").alias("_o"), F.col("kind").alias("_kind"), F.col("name").alias("_name"), F.col("text").alias("_text"))
    owners = index.methods.join(index.classes.select("file_id", "class_node", F.col("fqn").alias("class_fqn")), ["file_id", "class_node"]).select("file_id", "method", F.col("name").alias("method_name"), "class_fqn", "is_override")
    if overrides_only:
        owners = owners.filter("is_override")
    statements = tree.filter("kind = 'call' AND role = 'value'").select("repo_id", "file_id", "node", "method", "name", "line")
    statements = scratch.cut(statements.join(_target_variables(tree, index), ["file_id", "method"]).join(owners, ["file_id", "method"]))
    to = lambda df: (df["file_id"] == F.col("_f")) & (df["node"] == F.col("_p"))
    on_target = statements.filter("name RLIKE '^set.'").join(child.filter("_role = 'receiver' AND _kind = 'ident'"), to(statements)).filter("_name = variable").select(*statements.columns)
    sites = on_target.join(child.filter("_role = 'arg' AND _o = 0"), to(on_target))
    sites = scratch.cut(sites.select("repo_id", "file_id", "class_fqn", F.col("method_name"), "method", "line", decapitalised(F.substring("name", 4, 1_000_000)).alias("target_path"), F.col("_c").alias("value"), F.col("_kind").alias("shape"), F.col("_name").alias("called"), F.col("_text").alias("expression")))
    found = values.select(F.col("file_id").alias("_vf"), F.col("node").alias("_vn"), "param", "path", "trail")
    helpers = calls.filter("step = 'static_call'").select(F.col("file_id").alias("_hf"), F.col("node").alias("_hn"), F.col("fqn").alias("static_fqn"))
    types = tree.filter("kind = 'param'").select(F.col("file_id").alias("_tf"), F.col("parent").alias("_tm"), F.col("ordinal").alias("_to"), _simple(F.col("text")).alias("source_type"))
    full = sites.join(found, (F.col("file_id") == F.col("_vf")) & (F.col("value") == F.col("_vn")), "left").join(helpers, (F.col("file_id") == F.col("_hf")) & (F.col("value") == F.col("_hn")), "left")
    full = full.join(types, (F.col("file_id") == F.col("_tf")) & (F.col("method") == F.col("_tm")) & (F.col("param") == F.col("_to")), "left")
    through = lambda k: F.coalesce(F.exists("trail", lambda s: s["kind"] == k), F.lit(False))
    shape = (
        F.when(F.col("shape") == "literal", "constant").when(F.col("shape") == "new", "construction").when(F.col("shape") == "binary", "concat").when(F.col("shape").isin("ident", "member"), "rename")
        .when(F.col("static_fqn").isNotNull(), "static_call").when((F.col("shape") == "call") & F.col("called").startswith("get"), "rename").when(F.col("called").isin("substring", "toString"), "format").otherwise("expression")
    )
    kind = F.when(through("qualifier"), "qualifier").when(through("static_call"), "static_call").otherwise(shape)
    named = F.filter("trail", lambda s: s["fqn"].isNotNull())
    helper = F.coalesce("static_fqn", F.when(F.size(named) > 0, F.element_at(named, -1)["fqn"]))
    columns = ["repo_id", "file_id", "class_fqn", F.col("method_name").alias("method"), "line", "target_path"]
    set_ = full.select(*columns, kind.alias("kind"), "expression", F.when(F.col("path") != "", F.col("source_type")).alias("source_type"), F.nullif("path", F.lit("")).alias("source_path"), helper.alias("helper_fqn"), "trail")
    set_ = set_.withColumn("confidence", F.when(F.col("kind").isin("constant", "rename"), "high").otherwise("medium"))
    # a call that is given a chain of getters of the target fills what lies there
    given = statements.filter("NOT name RLIKE '^set.'").join(child.filter("_role = 'arg' AND _kind = 'call'"), to(statements))
    given = given.filter(F.expr(r"_text RLIKE '^\\w+([.]get\\w+[(][)])+$' AND substring_index(_text, '.', 1) = variable"))
    parts = F.transform(F.slice(F.split("_text", r"\."), 2, 1_000), lambda x: decapitalised(F.regexp_replace(x, r"^get|\(\)$", "")))
    enriched = given.select(*columns[:-1], F.array_join(parts, ".").alias("target_path"), F.lit("enrichment").alias("kind"), F.col("_text").alias("expression"), *[F.lit(None).cast("string").alias(c) for c in ("source_type", "source_path", "helper_fqn")], F.lit(None).cast(f"array<{_STEP}>").alias("trail"), F.lit("low").alias("confidence"))
    return set_.unionByName(enriched)
