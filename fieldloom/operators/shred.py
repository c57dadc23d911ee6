"""Nested documents as flat, related tables: adjacency-table shredding.

``shred`` stores every value of a JSON text as a row with node, parent, label, ordinal and scalar. All else are joins on that table.
What a node is in a JSON schema depends on its parent, up to the root, so ``schema_properties`` gives each node a function from what an
ancestor may be to what the node then is, and composes the functions by pointer doubling: the rounds grow with the logarithm of the depth.
A property is then joined with its scalar members, which are pivoted into the columns of the entity table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.jsontokens import nodes
from fieldloom.plans.scratch import Scratch
from fieldloom.plans.spread import spread

NODE_SCHEMA = "doc long, doc_key string, node int, parent int, label string, ordinal int, kind string, scalar string"
_ARROW = pa.schema([("doc", pa.int64()), ("doc_key", pa.string()), ("node", pa.int32()), ("parent", pa.int32()), ("label", pa.string()), ("ordinal", pa.int32()), ("kind", pa.string()), ("scalar", pa.string())])
BATCH = 20_000


def _shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list = []

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)
        rows.clear()
        return out

    for batch in batches:
        for doc, key, body in zip(*(batch.column(i) for i in range(3)), strict=True):
            text = body.as_py()
            for x in (nodes(text) if text is not None else None) or ():
                rows.append((doc.as_py(), key.as_py(), *x))
                if len(rows) >= BATCH:
                    yield flush()
    if rows:
        yield flush()


def shred(df: DataFrame, key: str, body: str) -> DataFrame:
    """The adjacency table of the JSON texts in ``body``: ``doc, doc_key, node, parent, label, ordinal, kind, scalar``.

    ``doc`` tells rows of ``df`` apart that have the same key. A text that is null or not valid JSON has no nodes; one that is a mere scalar
    has one. Texts compress well, so a small file may hold many: they are spread over more tasks than the file has splits.
    """
    texts = df.select(F.monotonically_increasing_id().alias("doc"), F.col(f"`{key}`").cast("string").alias("doc_key"), F.col(f"`{body}`").alias("body"))
    return spread(texts, "doc").mapInArrow(_shred, NODE_SCHEMA)


#: What a node may be: a schema, the object with a schema's properties, or a list of schemas that are combined.
ROLES = ("schema", "members", "list")
COMBINERS = ("allOf", "anyOf", "oneOf")


def _step(frm: str) -> Column:
    """What a container is, as (role, suffix of the path, trailing list steps or -1 if a property lies between), if its parent is ``frm``; else null."""
    out = lambda role, suffix, lists: F.struct(F.lit(role).alias("role"), suffix.alias("suffix"), F.lit(lists).alias("lists"))
    is_object = F.col("kind") == "object"
    if frm == "members":
        return out("schema", F.concat(F.lit("."), "label"), -1)
    if frm == "list":
        return F.when(is_object, out("schema", F.lit(""), 0))
    return (
        F.when((F.col("label") == "properties") & is_object, out("members", F.lit(""), 0))
        .when((F.col("label") == "items") & is_object, out("schema", F.lit("[]"), 1))
        .when(F.col("label").isin(*COMBINERS) & (F.col("kind") == "array"), out("list", F.lit(""), 0))
    )


def _after(upper: str) -> Column:
    """The composition of this node's function with the one of its pointer, seen from role ``upper`` at the pointer's own pointer."""
    above = F.col(f"up_{upper}")
    mine = F.coalesce(*[F.when(above["role"] == r, F.col(r)) for r in ROLES])
    # lists >= 0: no property in between, add up; -1 - n: a property in between, then n list steps
    lists = F.when(mine["lists"] < 0, mine["lists"]).when(above["lists"] < 0, above["lists"] - mine["lists"]).otherwise(above["lists"] + mine["lists"])
    return F.when(
        mine.isNotNull(), F.struct(mine["role"].alias("role"), F.concat(above["suffix"], mine["suffix"]).alias("suffix"), lists.alias("lists"))
    )


def schema_roles(adjacency: DataFrame, scratch: Scratch) -> DataFrame:
    """The containers that have a role in their document, seen from its root: ``doc, doc_key, node, role, prefix, lists``.

    ``prefix`` is the path of the nearest enclosing property with a list mark for each step into ``items`` since, ``lists`` the number of those.
    """
    boxes = adjacency.filter("kind IN ('object', 'array')")
    roots = boxes.filter("parent IS NULL AND kind = 'object'")
    start = roots.select("doc", "doc_key", "node", F.lit("schema").alias("role"), F.lit("").alias("prefix"), F.lit(0).alias("lists"))
    current = scratch.cut(
        boxes.filter("parent IS NOT NULL").select("doc", "doc_key", "node", F.col("parent").alias("ptr"), *[_step(r).alias(r) for r in ROLES])
    )
    at_root = F.col("ptr") == 0  # a document's first node
    while True:
        open_nodes = current.filter(~at_root)
        if open_nodes.isEmpty():
            break
        up = current.select(F.col("doc").alias("up_doc"), F.col("node").alias("up_node"), F.col("ptr").alias("up_ptr"), *[F.col(r).alias(f"up_{r}") for r in ROLES])
        joined = open_nodes.join(up, (F.col("doc") == F.col("up_doc")) & (F.col("ptr") == F.col("up_node")))
        moved = joined.select("doc", "doc_key", "node", F.col("up_ptr").alias("ptr"), *[_after(r).alias(r) for r in ROLES])
        alive = moved.filter(" OR ".join(f"{r} IS NOT NULL" for r in ROLES))
        # rows that reached the root stay, as later pointers lead to them
        before, current = current, scratch.cut(current.filter(at_root & F.col("schema").isNotNull()).unionByName(alive))
        scratch.drop(before)
    seen = F.col("schema")
    lists = F.when(seen["lists"] < 0, -1 - seen["lists"]).otherwise(seen["lists"])
    done = current.filter(seen.isNotNull()).select("doc", "doc_key", "node", seen["role"].alias("role"), seen["suffix"].alias("prefix"), lists.alias("lists"))
    return start.unionByName(done)


def schema_properties(adjacency: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per property that a JSON schema names: ``doc, schema_id, node, label, kind, path, parent_path``.

    adjacency: what ``shred`` gives, written, as it is read several times.
    """
    members = schema_roles(adjacency, scratch).filter("role = 'members'").select(F.col("doc").alias("d"), F.col("node").alias("n"), "prefix", "lists")
    named = adjacency.filter("label IS NOT NULL").join(members, (F.col("doc") == F.col("d")) & (F.col("parent") == F.col("n")))
    path = F.concat("prefix", F.lit("."), "label")
    inner = lambda c: F.when(c.startswith("."), F.substring(c, 2, 2_147_483_647)).otherwise(c)
    parent = F.col("prefix").substr(F.lit(1), F.length("prefix") - 2 * F.col("lists"))
    return named.select("doc", F.col("doc_key").alias("schema_id"), "node", "label", "kind", inner(path).alias("path"), inner(parent).alias("parent_path"))


def property_entities(adjacency: DataFrame, properties: DataFrame, members: list[str]) -> DataFrame:
    """The entity table: a property with its scalar members of the given labels as columns.

    Columns ``schema_id, path, parent_path`` and one per label, null where the property has no such scalar (a null in the text is none either).
    """
    scalars = adjacency.filter(F.col("label").isin(members) & F.col("scalar").isNotNull() & (F.col("kind") != "null"))
    scalars = scalars.select(F.col("doc").alias("d"), F.col("parent").alias("p"), F.col("label").alias("member"), "scalar")
    joined = properties.join(scalars, (F.col("doc") == F.col("d")) & (F.col("node") == F.col("p")), "left")
    wide = joined.groupBy("doc", "schema_id", "node", "path", "parent_path").pivot("member", members).agg(F.first("scalar"))
    return wide.drop("doc", "node")


def property_members(adjacency: DataFrame, properties: DataFrame) -> DataFrame:
    """The child table of the properties: ``schema_id, path, member, ordinal, kind, scalar``, a row per scalar member, whatever its label, and per element of a list.

    ``ordinal`` counts a list's elements and is null for a scalar; an element that is itself a container has its kind and no scalar. Empty lists have no row.
    """
    nodes = adjacency.select(F.col("doc").alias("d"), F.col("parent").alias("p"), F.col("node").alias("n"), F.col("label").alias("member"), F.col("ordinal").alias("at"), F.col("kind").alias("k"), "scalar")
    own = properties.select("doc", "schema_id", "path", "node").join(nodes.filter("member IS NOT NULL"), (F.col("doc") == F.col("d")) & (F.col("node") == F.col("p")))
    scalars = own.filter("k NOT IN ('object', 'array')").select("schema_id", "path", "member", F.lit(None).cast("int").alias("ordinal"), F.col("k").alias("kind"), "scalar")
    lists = own.filter("k = 'array'").select("schema_id", "path", F.col("member").alias("of"), F.col("doc").alias("list_doc"), F.col("n").alias("list"))
    elements = lists.join(nodes.drop("member"), (F.col("list_doc") == F.col("d")) & (F.col("list") == F.col("p")))
    return scalars.unionByName(elements.select("schema_id", "path", F.col("of").alias("member"), F.col("at").alias("ordinal"), F.col("k").alias("kind"), "scalar"))
