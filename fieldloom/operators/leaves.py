"""The leaves that schema files declare: paths with business keys, from XML schemas and Java classes."""

from __future__ import annotations

import xml.parsers.expat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators.extract import code_lines
from fieldloom.plans.scratch import Scratch
from fieldloom.plans.spread import spread

_ARROW = pa.schema([("file_id", pa.int64()), ("node", pa.int32()), ("owner", pa.int32()), ("tag", pa.string()), ("name", pa.string()), ("type", pa.string()), ("key", pa.string()), ("ignored", pa.bool_())])
ELEMENTS = "file_id long, node int, owner int, tag string, name string, type string, key string, ignored boolean"
_OUTSIDE = -1


def _declarations(text: str) -> list[list]:
    """(node, owner, tag, name, type, key, ignored) of the elements and the named complex types of an XML schema.

    Those are at the top, or in the sequence of a complex type; owner is the element, or the named type, that this belongs to.
    """
    found: list[list] = []
    stack: list[int | None] = [None]  # the declaration around, at each depth
    inside: list[str] = []
    parser = xml.parsers.expat.ParserCreate("utf-8")

    def begin(tag: str, attributes: dict[str, str]) -> None:
        inside.append(tag.rpartition(":")[2])
        around, name = stack[-1], attributes.get("name")
        if inside[-1] == "element":
            member = inside[-3:] == ["complexType", "sequence", "element"] and around is not None and name
            around = around if member or len(inside) == 2 else _OUTSIDE
        elif not (inside[-1] == "complexType" and len(inside) == 2 and name):
            stack.append(around)
            return
        if around == _OUTSIDE:
            stack.append(_OUTSIDE)
            return
        found.append([len(found), around, inside[-1], name, attributes.get("type"), "", ""])
        stack.append(len(found) - 1)

    def words(text: str) -> None:
        at = stack[-1]
        if at is not None and at != _OUTSIDE and inside[-1] in ("business-key", "ignore") and "appinfo" in inside:
            found[at][5 if inside[-1] == "business-key" else 6] += text

    def end(_: str) -> None:
        inside.pop()
        stack.pop()

    parser.StartElementHandler, parser.CharacterDataHandler, parser.EndElementHandler = begin, words, end
    try:
        parser.Parse(text.encode("utf-8", "replace"), True)
    except xml.parsers.expat.ExpatError:
        return []
    return [[*row[:5], row[5].strip() or None, row[6].strip() in ("true", "1")] for row in found]


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        rows = [(i, *row) for i, text in texts if text for row in _declarations(text)]
        columns = list(zip(*rows, strict=True)) or [()] * len(_ARROW)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW.types, strict=True)], schema=_ARROW)


def xsd_elements(files: DataFrame) -> DataFrame:
    """The declarations of the XML schemas among the files: ``file_id, node, owner, tag, name, type, key, ignored``; broken or null ones have none."""
    texts = files.filter(F.lower(F.substring_index("file", ".", -1)) == "xsd").select("file_id", "content")
    return spread(texts, "file_id").mapInArrow(_elements, ELEMENTS)


def xsd_leaves(elements: DataFrame, scratch: Scratch) -> DataFrame:
    """``file_id, path, business_key, ignored, type``: the elements below a top one, whose own name is left out, nested names joined by dots.

    elements: what ``xsd_elements`` gives, written, as each level joins it with the one above, until none is left. An element has those of its own complex type below it
    or, without one, those of the named type of its file that it refers to. One with a complex type is a leaf only if it has a business key or is ignored. A named type that
    leads back to itself is entered once on each way.
    """
    own = elements.filter("tag = 'element'").select("file_id", "node", "owner", "name", "type", "key", "ignored")
    kinds = elements.filter("tag = 'complexType'").groupBy("file_id", F.col("name").alias("_t")).agg(F.max("node").alias("_k")).withColumnRenamed("file_id", "_f")
    inline = own.filter("owner IS NOT NULL").select(F.col("file_id").alias("_of"), F.col("owner").alias("_o")).distinct()
    # where the members of an element stand: in itself or in the type it refers to
    referred = own.join(kinds, (F.col("file_id") == F.col("_f")) & (F.substring_index("type", ":", -1) == F.col("_t")), "left").drop("_f", "_t")
    holders = referred.join(inline, (F.col("file_id") == F.col("_of")) & (F.col("node") == F.col("_o")), "left")
    holders = scratch.cut(holders.select("file_id", "node", "owner", "name", "type", "key", "ignored", F.coalesce("_o", "_k").alias("holder")))
    level = scratch.cut(holders.filter("owner IS NULL").select("file_id", "holder", F.lit(None).cast("string").alias("path"), F.array("node").alias("seen")))
    found = []
    while not level.isEmpty():
        above = level.select(F.col("file_id").alias("_f"), F.col("holder").alias("_h"), F.col("path").alias("over"), "seen")
        below = holders.join(above, (F.col("file_id") == F.col("_f")) & (F.col("owner") == F.col("_h")) & ~F.array_contains("seen", F.col("node")))
        level = scratch.cut(below.select("file_id", "key", "ignored", "type", "holder", F.concat_ws(".", "over", "name").alias("path"), F.array_append("seen", F.col("node")).alias("seen")))
        found.append(level)
    if not found:
        return own.limit(0).select("file_id", F.col("name").alias("path"), F.col("key").alias("business_key"), "ignored", "type")
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows.filter("holder IS NULL OR key IS NOT NULL OR ignored").select("file_id", "path", F.col("key").alias("business_key"), "ignored", "type")


FIELD = r"^\s*(?:public|protected|private)\s+(?:(?:static|final|transient|volatile)\s+)*([A-Za-z_][\w.]*(?:<[^;=()]*>)?(?:\[\])*)\s+(\w+)\s*(?:=|;)"
_KEY = r"businessKey\s*=\s*\"([^\"]*)\""


def java_leaves(files: DataFrame) -> DataFrame:
    """``file_id, line, path, type, business_key, ignored``: the fields with a visibility that Java files declare, constants among them.

    A key or an ignore mark may stand on the same line or on those right before it that begin with ``@``.
    """
    lines = code_lines(files).filter(F.col("code").rlike(r"\S"))
    own = Window.partitionBy("file_id").orderBy("line")  # the lines of one file
    # annotations belong to the next line that doesn't begin with @
    groups = lines.withColumn("_g", F.sum(F.when(F.lag("code").over(own).rlike(r"^\s*@[\w.]+(?:\([^)]*\))?\s*$"), 0).otherwise(1)).over(own))
    per = groups.groupBy("file_id", "_g").agg(F.max_by("code", "line").alias("code"), F.max("line").alias("line"), F.array_join(F.array_sort(F.collect_list(F.struct("line", "code")))["code"], "\n").alias("whole"))
    hit = per.filter(F.col("code").rlike(FIELD))
    return hit.select(
        "file_id", "line", F.regexp_extract("code", FIELD, 2).alias("path"), F.regexp_extract("code", FIELD, 1).alias("type"),
        F.nullif(F.regexp_extract("whole", _KEY, 1), F.lit("")).alias("business_key"), F.col("whole").rlike(r"@\w*Ignore\b").alias("ignored"),
    )
