"""The general data problems over the lineage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators.orphans import Child, Parent, find_orphans, orphan_report
from fieldloom.operators.selection import hot_keys, per_key_quantiles, per_key_summary
from fieldloom.operators.shred import property_entities, property_members, schema_properties, shred
from fieldloom.plans.scratch import Scratch
from fieldloom.sources import read_table

HOT_SHARE = 0.02
KEYS = ["entry_point_id", "mapper_id"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Entry points and mappers that hold at least 2 % of all edges."""
    return hot_keys(read_table(spark, d, "edges"), KEYS, HOT_SHARE).select("key_name", "key_value")


def p1_profile(spark: SparkSession, d: str) -> DataFrame:
    """Edges, target fields, last arrival and quartiles of the arrival per entry point and mapper."""
    edges = read_table(spark, d, "edges")
    summary = per_key_summary(edges, KEYS, "target_field_id", "ingested_at")
    quantiles = per_key_quantiles(edges, KEYS, "ingested_at", [0.25, 0.5, 0.75]).drop("n_values")
    return summary.join(quantiles, ["key_name", "key_value"], "left")


def _references(spark: SparkSession, d: str) -> tuple[list[Parent], list[Child]]:
    edges, field = read_table(spark, d, "edges"), read_table(spark, d, "field")
    parents = [
        Parent("field", field, "id", "seen_at", "deleted_at"),
        Parent("entry_point", read_table(spark, d, "entry_point"), "id", "seen_at", "deleted_at"),
        Parent("schema_def", read_table(spark, d, "schema_def"), "id", "seen_at", "deleted_at"),
    ]
    to = {"source_field_id": "field", "target_field_id": "field", "entry_point_id": "entry_point"}
    return parents, [Child("edges", edges, to, "ingest_seq", "ingested_at"), Child("field", field, {"schema_id": "schema_def"}, "ingest_seq", "seen_at")]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """References to fields, entry points and schemas that don't exist at their time."""
    return find_orphans(*_references(spark, d)).select("table_name", "column_name", "ingest_seq")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table, column and month."""
    parents, children = _references(spark, d)
    return orphan_report(find_orphans(parents, children), children)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The properties of the registered schemas, each with its parent."""
    scratch = Scratch(spark)
    adjacency = scratch.cut(shred(read_table(spark, d, "schema_doc"), "schema_id", "body"))
    return schema_properties(adjacency, scratch).select("schema_id", "path", "parent_path").distinct()


#: The scalar members that the schemas' properties carry, and those of the reference; lists, and any other member, are in p5_members.
MEMBERS = ["type", "format", "description", "maxLength", "minItems", "items", "additionalProperties", "$ref", "x-atlas-business-key", "x-atlas-ignore"]


def p5_entities(spark: SparkSession, d: str) -> DataFrame:
    """The properties with their scalar members, and whether the field is registered."""
    scratch = Scratch(spark)
    adjacency = scratch.cut(shred(read_table(spark, d, "schema_doc"), "schema_id", "body"))
    entities = property_entities(adjacency, schema_properties(adjacency, scratch), MEMBERS).distinct()
    fields = read_table(spark, d, "field").select(F.col("schema_id").alias("s"), F.col("path").alias("f")).distinct()
    joined = entities.join(fields, (F.col("schema_id") == F.col("s")) & (F.col("path") == F.col("f")), "left")
    return joined.withColumn("registered", F.col("f").isNotNull()).drop("s", "f")


def p5_members(spark: SparkSession, d: str) -> DataFrame:
    """All scalar members and list elements of the properties."""
    scratch = Scratch(spark)
    adjacency = scratch.cut(shred(read_table(spark, d, "schema_doc"), "schema_id", "body"))
    return property_members(adjacency, schema_properties(adjacency, scratch)).distinct()


QUERIES = {"p1_found": p1_found, "p1_profile": p1_profile, "p4_found": p4_found, "p4_report": p4_report, "p5_found": p5_found, "p5_entities": p5_entities, "p5_members": p5_members}

_LONG_KEYS = """SELECT 'entry_point_id' AS key_name, entry_point_id AS key_value, target_field_id, ingested_at FROM edges WHERE entry_point_id IS NOT NULL
  UNION ALL SELECT 'mapper_id', mapper_id, target_field_id, ingested_at FROM edges WHERE mapper_id IS NOT NULL"""

_REFS = """SELECT 'edges' AS table_name, 'source_field_id' AS column_name, ingest_seq, ingested_at AS at, source_field_id AS ref, 'field' AS parent FROM edges WHERE source_field_id IS NOT NULL
  UNION ALL SELECT 'edges', 'target_field_id', ingest_seq, ingested_at, target_field_id, 'field' FROM edges WHERE target_field_id IS NOT NULL
  UNION ALL SELECT 'edges', 'entry_point_id', ingest_seq, ingested_at, entry_point_id, 'entry_point' FROM edges WHERE entry_point_id IS NOT NULL
  UNION ALL SELECT 'field', 'schema_id', ingest_seq, seen_at, schema_id, 'schema_def' FROM field WHERE schema_id IS NOT NULL"""
_LIVES = """SELECT 'field' AS parent, id, seen_at, deleted_at FROM field UNION ALL SELECT 'entry_point', id, seen_at, deleted_at FROM entry_point
  UNION ALL SELECT 'schema_def', id, seen_at, deleted_at FROM schema_def"""
_ORPHANS = f"""refs AS ({_REFS}), lives AS ({_LIVES}),
  met AS (SELECT DISTINCT r.table_name, r.column_name, r.ingest_seq FROM refs r JOIN lives l ON r.parent = l.parent AND r.ref = l.id AND l.seen_at <= r.at AND (l.deleted_at IS NULL OR l.deleted_at > r.at)),
  orphans AS (SELECT r.* FROM refs r ANTI JOIN met m USING (table_name, column_name, ingest_seq))"""

_PROPERTIES = """WITH RECURSIVE s(schema_id, path, parent, base, node, named) AS (
  SELECT schema_id, '', '', '', body::JSON, FALSE FROM schema_doc WHERE body IS NOT NULL AND json_valid(body) AND json_type(body) = 'OBJECT'
  UNION ALL
  SELECT s.schema_id, c.path, CASE WHEN c.named THEN s.base ELSE s.parent END, CASE WHEN c.named THEN c.path ELSE s.base END, c.node, c.named FROM s, LATERAL (
    SELECT CASE WHEN s.path = '' THEN e.key ELSE s.path || '.' || e.key END AS path, e.value AS node, TRUE AS named FROM json_each(s.node, '$.properties') e WHERE json_type(s.node) = 'OBJECT' AND json_type(s.node, '$.properties') = 'OBJECT'
    UNION ALL SELECT s.path || '[]', json_extract(s.node, '$.items'), FALSE WHERE json_type(s.node) = 'OBJECT' AND json_type(s.node, '$.items') = 'OBJECT'
    UNION ALL SELECT s.path, e.value, FALSE FROM (VALUES ('$.allOf'), ('$.anyOf'), ('$.oneOf')) v(p), json_each(s.node, v.p) e WHERE json_type(s.node) = 'OBJECT' AND json_type(s.node, v.p) = 'ARRAY' AND json_type(e.value) = 'OBJECT') c),
  p AS (SELECT schema_id, path, parent AS parent_path, node FROM s WHERE named)"""
_KINDS = "CASE json_type({0}) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END"
_SCALAR = "CASE WHEN json_type({0}) NOT IN ('OBJECT', 'ARRAY') THEN coalesce({0} ->> '$', 'null') END"
_OWN = ", ".join(f"""CASE WHEN json_type(node, '$."{m}"') NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN json_extract_string(node, '$."{m}"') END AS "{m}\"""" for m in MEMBERS)

SQL = {
    "p5_found": f"{_PROPERTIES} SELECT DISTINCT schema_id, path, parent_path FROM p",
    "p5_entities": f"""{_PROPERTIES}, f AS (SELECT DISTINCT schema_id, path FROM field) SELECT DISTINCT p.schema_id, p.path, parent_path, {_OWN}, f.path IS NOT NULL AS registered FROM p LEFT JOIN f ON p.schema_id = f.schema_id AND p.path = f.path""",
    "p5_members": f"""{_PROPERTIES}, m AS (SELECT p.schema_id, p.path, e.key AS member, e.value AS v FROM p, json_each(p.node) e WHERE json_type(p.node) = 'OBJECT')
  SELECT DISTINCT schema_id, path, member, NULL::INT AS ordinal, {_KINDS.format("v")} AS kind, {_SCALAR.format("v")} AS scalar FROM m WHERE json_type(v) NOT IN ('OBJECT', 'ARRAY')
  UNION SELECT m.schema_id, m.path, m.member, a.key::INT, {_KINDS.format("a.value")}, {_SCALAR.format("a.value")} FROM m, json_each(m.v) a WHERE json_type(m.v) = 'ARRAY'""",
    "p1_found": f"""WITH long AS ({_LONG_KEYS}) SELECT key_name, key_value FROM long GROUP BY 1, 2 HAVING count(*) >= 0.02 * (SELECT count(*) FROM edges)""",
    "p1_profile": f"""WITH long AS ({_LONG_KEYS}),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY key_name, key_value ORDER BY ingested_at) AS rn, count(ingested_at) OVER (PARTITION BY key_name, key_value) AS n FROM long)
  SELECT key_name, key_value, count(*) AS n_rows, count(DISTINCT target_field_id) AS n_distinct, max(ingested_at) AS last_value,
    max(CASE WHEN rn = greatest(1, ceil(n / 4.0)) THEN ingested_at END) AS q_25, max(CASE WHEN rn = greatest(1, ceil(n / 2.0)) THEN ingested_at END) AS q_50,
    max(CASE WHEN rn = greatest(1, ceil(n * 3 / 4.0)) THEN ingested_at END) AS q_75
  FROM ranked GROUP BY 1, 2""",
    "p4_found": f"WITH {_ORPHANS} SELECT table_name, column_name, ingest_seq FROM orphans",
    "p4_report": f"""WITH {_ORPHANS} SELECT table_name, column_name, period, count(*) AS n_references, count(o) AS n_orphans FROM
  (SELECT r.table_name, r.column_name, strftime(r.at, '%Y-%m') AS period, o.ingest_seq AS o FROM refs r LEFT JOIN orphans o USING (table_name, column_name, ingest_seq)) GROUP BY 1, 2, 3""",
}
