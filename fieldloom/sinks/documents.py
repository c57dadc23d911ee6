"""Linked-data nodes and Markdown pages, one row per node or page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.text import display_source


def linked_nodes(mappers: DataFrame, edges: DataFrame) -> DataFrame:
    """``repo_id, node_id, node``: a JSON object with members in a fixed order, null where there is nothing, for each mapper that has edges and each edge."""
    active = mappers.join(edges.select(F.col("mapper_id").alias("_m")).distinct(), F.col("id") == F.col("_m"), "left_semi")
    mapper = active.select("repo_id", F.concat(F.lit("mapper:"), "id").alias("node_id"), F.to_json(F.struct(F.concat(F.lit("mapper:"), "id").alias("@id"), F.lit("Mapper").alias("@type"), "kind"), {"ignoreNullFields": "false"}).alias("node"))
    edge = edges.select(
        "repo_id", F.concat(F.lit("edge:"), "id").alias("node_id"),
        F.to_json(F.struct(F.concat(F.lit("edge:"), "id").alias("@id"), F.lit("Edge").alias("@type"), "kind", F.col("mapper_id").alias("mapper"), F.col("source_field_id").alias("source"), F.col("target_field_id").alias("target")), {"ignoreNullFields": "false"}).alias("node"),
    )
    return mapper.unionByName(edge)


def _row(cells: list[Column]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c.cast("string"), F.lit("")) for c in cells]), F.lit(" |"))


def markdown_lines(edges: DataFrame) -> DataFrame:
    """The rows of the mappers' tables: ``mapper_id, line, edge_id, markdown``; a page is its mapper's rows in the order of line and edge.

    They are rows, not pages, as one mapper may hold a tenth of all edges; ``write_pages`` sorts them within files instead of gathering them.
    edges: with ``target_path, source_path, expression, kind, line``.
    """
    cells = [F.coalesce("target_path", "target_field_id"), display_source(F.col("source_path"), F.col("expression")), F.col("kind"), F.concat(F.lit("L"), F.col("line").cast("string"))]
    return edges.select("mapper_id", "line", F.col("id").alias("edge_id"), _row(cells).alias("markdown"))


def write_pages(rows: DataFrame, path: str) -> None:
    """Write the pages' rows as text, sorted; range partitioning splits a page that is larger than a file should be."""
    ordered = rows.repartitionByRange("mapper_id", "line", "edge_id").sortWithinPartitions("mapper_id", "line", "edge_id")
    ordered.select(F.concat_ws("\t", "mapper_id", "markdown").alias("value")).write.mode("overwrite").text(path)
