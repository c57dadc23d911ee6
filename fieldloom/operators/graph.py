"""The lineage as a graph of entry points and fields, and searches over its texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.text import label
from fieldloom.plans.skew import Salts, salted_join


def top_entry_points(entry_points: DataFrame, limit: int = 2000) -> DataFrame:
    """The entry points with the most edges, ties by id, and whether there are more."""
    total = entry_points.agg(F.count(F.lit(1)).alias("_total"))
    top = entry_points.orderBy(F.col("edge_count").desc_nulls_last(), "id").limit(limit)
    return top.crossJoin(F.broadcast(total)).withColumn("truncated", F.col("_total") > limit).drop("_total")  # total is one row


def graph_links(edges: DataFrame, chosen: DataFrame, delivered: DataFrame | None = None) -> DataFrame:
    """``source, target, kind``: an entry point reads its edges' source fields and writes their targets; each link once.

    delivered: the table that the edges come from, to see which entry points are hot.
    """
    salts = Salts(delivered, "entry_point_id") if delivered is not None else None
    own = salted_join(edges, chosen.select(F.col("id").alias("_ep")), [("entry_point_id", "_ep")], ["id"], "left_semi", salts)
    read = F.struct(F.col("source_field_id").alias("source"), F.col("entry_point_id").alias("target"), F.lit("reads").alias("kind"))
    write = F.struct(F.col("entry_point_id").alias("source"), F.col("target_field_id").alias("target"), F.lit("writes").alias("kind"))
    return own.select(F.explode(F.array(read, write)).alias("l")).select("l.*").filter("source IS NOT NULL AND target IS NOT NULL").distinct()


def graph_nodes(links: DataFrame, chosen: DataFrame, fields: DataFrame) -> DataFrame:
    """``id, kind, label, schema_id``: the chosen entry points and every field that their links touch, known or not."""
    points = chosen.select("id", F.lit("entry_point").alias("kind"), label(F.col("class_fqn"), F.col("method_name")).alias("label"), F.lit(None).cast("string").alias("schema_id"))
    touched = links.select(F.when(F.col("kind") == "reads", F.col("source")).otherwise(F.col("target")).alias("id")).distinct()
    known = touched.join(fields.select(F.col("id").alias("_id"), "path", "schema_id"), F.col("id") == F.col("_id"), "left")
    return points.unionByName(known.select("id", F.lit("field").alias("kind"), F.coalesce("path", "id").alias("label"), "schema_id"))


def edges_by_key(edges: DataFrame) -> DataFrame:
    """Each edge under the business key of its target and, if that is another, of its source: ``business_key, id``."""
    keys = F.array_distinct(F.array("target_bk", "source_bk"))
    return edges.select("id", F.explode(keys).alias("business_key")).filter("business_key IS NOT NULL")


def inverted_index(df: DataFrame, key: str, text: str) -> DataFrame:
    """``token, key, n``: how often a token, a run of letters and digits in lower case, occurs in a text. Null has no tokens."""
    tokens = F.explode(F.split(F.lower(F.col(f"`{text}`")), r"[^\p{L}\p{N}]+"))
    return df.select(F.col(f"`{key}`").alias("key"), tokens.alias("token")).filter("token <> ''").groupBy("token", "key").agg(F.count(F.lit(1)).alias("n"))


def search(index: DataFrame, tokens: list[str]) -> DataFrame:
    """Keys with all of the tokens and how often they occur: ``key, n``."""
    wanted = list(dict.fromkeys(t.lower() for t in tokens))
    hits = index.filter(F.col("token").isin(wanted)).groupBy("key").agg(F.count(F.lit(1)).alias("_m"), F.sum("n").alias("n"))
    return hits.filter(F.col("_m") == len(wanted)).drop("_m")


#: Kinds of atoms in a text that can be checked against the facts, by pattern; fixed values, the edge's as functions.text.edge_id makes it.
ATOMS = {
    "edge_id": r"\b" + r"\.".join(["[a-z0-9-]+", "[a-z0-9_-]+", "e_[0-9a-f]{12}"]) + r"\b",
    "mapper_fqn": r"\b(?:[a-z][a-z0-9_]*\.)+[A-Z][A-Za-z0-9_]+\b",
    "file_path": r"\b(?:[\w-]+/)+[\w.-]+\.(?:java|json|xsd|yaml|md)\b",
    "url": r"\bhttps?://\S+\b",
    "sha": r"\b[0-9a-f]{7,40}\b",
    "field_path": r"`([a-zA-Z_][\w.]*)`",
}


def text_atoms(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, kind, atom``: the distinct atoms of each text; of a field path, what stands between the backquotes. Null has none."""
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(F.col(f"`{text}`"), F.lit(p), F.lit(int(k == "field_path"))).alias("atoms")) for k, p in ATOMS.items()])
    kinds = df.select(F.col(f"`{key}`").alias("key"), F.explode(found).alias("k"))
    return kinds.select("key", "k.kind", F.explode("k.atoms").alias("atom")).distinct()


def unverifiable(atoms: DataFrame, known: DataFrame) -> DataFrame:
    """The atoms that ``known`` (``kind, atom``) doesn't have."""
    return atoms.join(known.select("kind", "atom").distinct(), ["kind", "atom"], "left_anti")
