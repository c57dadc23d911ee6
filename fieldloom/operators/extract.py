"""Facts from Java source texts, as column expressions over lines and methods.

Comments are taken out of a file's text, with their line ends kept, the rest is cut into numbered lines, and patterns find packages, imports,
methods and the calls that set a target's members. What the value is read from is taken apart by its shape, the first rule that applies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.text import decapitalised

#: Text blocks, strings, comments and what lies between, in one pattern, so that none is looked for inside another.
_PIECES = r"""(?s)\"{3}(?:[^\\"]++|\\.|"(?!""))*+\"{3}|"(?:[^"\\\n]++|\\.)*+"|'(?:[^'\\\n]++|\\.)++'|//[^\n]*|/\*.*?\*/|[^"'/]++|."""
METHOD = r"^\s*(?:(?:public|protected|private|static|final|default|abstract|synchronized)\s+)*([A-Za-z_][\w.]*(?:<[^()]*>)?(?:\[\])*)\s+([a-z]\w*)\s*\(([^()]*)\)\s*(?:throws\s+[\w., ]+)?\{\s*$"
SETTER = r"\b([a-z]\w*)\.set([A-Z]\w*)\((.*)\)\s*;"
_NOT_TYPES = ("return", "new", "else", "throw", "case", "package", "import")


def without_comments(text: Column) -> Column:
    """A Java text without carriage returns and comments; the line ends inside a comment stay."""
    pieces = F.regexp_extract_all(F.replace(text, F.lit("\r")), F.lit(_PIECES), F.lit(0))
    ends = lambda p: F.repeat(F.lit("\n"), F.length(p) - F.length(F.replace(p, F.lit("\n"))))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.startswith("//"), "").when(p.startswith("/*"), ends(p)).otherwise(p)), "")


def code_lines(files: DataFrame) -> DataFrame:
    """``file_id, file, line, code``: the lines of Java files without comments, each with its number. A null content has no lines."""
    java = files.filter(F.lower(F.substring_index("file", ".", -1)) == "java")
    lines = F.split(without_comments(F.col("content")), "\n")
    return java.select("file_id", "file", F.posexplode(lines).alias("_n", "code")).select("file_id", "file", (F.col("_n") + 1).alias("line"), "code")


def units(files: DataFrame) -> DataFrame:
    """``file_id, package, class_name, imports``: of each Java file, its package, first type and imports by simple name (the first of a name wins)."""
    java = files.filter(F.lower(F.substring_index("file", ".", -1)) == "java")
    imports = F.expr(r"regexp_extract_all(_text, r'(?m)^\s*import\s+(?:static\s+)?([\w.]+)\s*;', 1)")
    named = F.transform(imports, lambda x: F.struct(F.substring_index(x, ".", -1).alias("key"), x.alias("value")))
    first = F.aggregate(named, F.array().cast("array<struct<key string, value string>>"), lambda acc, x: F.when(F.exists(acc, lambda y: y["key"] == x["key"]), acc).otherwise(F.array_append(acc, x)))
    return java.select("file_id", without_comments(F.col("content")).alias("_text")).select(
        "file_id",
        F.nullif(F.regexp_extract("_text", r"(?m)^\s*package\s+([\w.]+)\s*;", 1), F.lit("")).alias("package"),
        F.nullif(F.regexp_extract("_text", r"(?m)^\s*(?:(?:public|abstract|final|sealed)\s+)*(?:class|interface|enum|record)\s+(\w+)", 1), F.lit("")).alias("class_name"),
        F.map_from_entries(first).alias("imports"),
    )


def classify_class(path: Column, content: Column) -> Column:
    """The kind of a mapper class: generated code, a mapping interface, else one with setters; null for no content."""
    generated = path.contains("/target/generated-sources/")
    return F.when(generated & content.rlike(r"@Generated\b"), "mapstruct-impl").when(content.rlike(r"@Mapper\b"), "mapstruct-interface").when(content.isNotNull(), "setter")


def classify_value(value: Column) -> Column:
    """The kind of an edge by the shape of its value: the first rule that holds."""
    v = F.trim(value)
    return (
        F.when(v.rlike(r"^(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)+'|-?[0-9][\w.]*|true|false|null)$"), "constant")
        .when(v.rlike(r"^new\b"), "construction")
        .when(v.rlike(r"^[^?\"]*\?[^:]*:"), "expression")
        .when(v.rlike(r"[^+]\+[^+]"), "concat")
        .when(v.rlike(r"^[A-Z][\w.]*\.[a-z]\w*\("), "static_call")
        .when(v.rlike(r"\.(?:substring|toString)\([^()]*\)$"), "format")
        .when(v.rlike(r"^[a-z]\w*(?:\.get[A-Z]\w*\(\))+$"), "rename")
        .when(v.rlike(r"^[a-z]\w*(?:\.[a-z]\w*)*$"), "rename")
        .otherwise("expression")
    )


def source_path(value: Column) -> Column:
    """The path of the first chain of getters in a value, members joined by dots; null without one."""
    chain = F.regexp_extract(value, r"\b[a-z]\w*((?:\.get[A-Z]\w*\(\))+)", 1)
    parts = F.regexp_extract_all(chain, F.lit(r"\.get([A-Z]\w*)\(\)"), F.lit(1))
    return F.nullif(F.array_join(F.transform(parts, decapitalised), "."), F.lit(""))


def methods(lines: DataFrame) -> DataFrame:
    """``file_id, line, return_type, method, parameters``: the methods with a body, by the line of their head."""
    head = [F.regexp_extract("code", METHOD, i) for i in (1, 2, 3)]
    found = lines.filter(F.col("code").rlike(METHOD)).select("file_id", "line", head[0].alias("return_type"), head[1].alias("method"), head[2].alias("parameters"))
    return found.filter(~F.col("return_type").isin(*_NOT_TYPES))


def setter_edges(lines: DataFrame) -> DataFrame:
    """One row per call that sets a member: ``file_id, file, line, method, method_line, target_path, expression, kind, source_path, confidence``.

    A call belongs to the last method head before it in its file; one before any method is left out. Several calls in a line are one each.
    """
    marked = lines.filter(F.col("code").rlike(METHOD) | F.col("code").contains(".set"))
    own = Window.partitionBy("file_id").orderBy("line")  # the lines of one file
    is_head = F.col("code").rlike(METHOD) & ~F.regexp_extract("code", METHOD, 1).isin(*_NOT_TYPES)
    at = marked.withColumn("_head", F.when(is_head, F.struct(F.regexp_extract("code", METHOD, 2).alias("name"), F.col("line").alias("at"))))
    at = at.withColumn("_head", F.last("_head", ignorenulls=True).over(own))
    calls = at.select("file_id", "file", "line", "_head", F.explode(F.split("code", r"(?<=;)")).alias("call")).filter(F.col("call").rlike(SETTER) & F.col("_head").isNotNull())
    value = F.regexp_extract("call", SETTER, 3)
    return calls.select(
        "file_id", "file", "line", F.col("_head.name").alias("method"), F.col("_head.at").alias("method_line"),
        decapitalised(F.regexp_extract("call", SETTER, 2)).alias("target_path"),
        F.trim(value).alias("expression"), classify_value(value).alias("kind"), source_path(value).alias("source_path"),
    ).withColumn("confidence", F.when(F.col("kind").isin("constant", "rename"), "high").otherwise("medium"))


def assembled_entry_points(edges: DataFrame) -> DataFrame:
    """The methods that set anything: ``file_id, method, method_line, n_edges, n_resolved, resolution_percent, source_paths`` (sorted, distinct)."""
    counts = edges.groupBy("file_id", "method", "method_line").agg(F.count(F.lit(1)).alias("n_edges"), F.count("source_path").alias("n_resolved"), F.array_sort(F.collect_set("source_path")).alias("source_paths"))
    return counts.withColumn("resolution_percent", F.bround(F.lit(100.0) * F.col("n_resolved") / F.col("n_edges"), 2))
