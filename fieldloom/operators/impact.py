"""What depends on a field: joins of edges with fields, schemas and entry points.

Subtrees are matched by equality: a source path is repeated once for each of its own prefixes (it has few), which are then joined with the
paths asked for. Edges to entry points are joined with salt, as a few entry points hold most edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.plans.skew import Salts, salted_join


def in_subtree(path: Column, root: str) -> Column:
    """Whether a path is ``root`` or lies below it; wildcards in either mean themselves."""
    return (path == root) | path.startswith(root + ".")


def prefixes(path: Column) -> Column:
    """The paths above a path and the path itself."""
    parts = F.split(path, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def with_fields(edges: DataFrame, fields: DataFrame, how: str = "left") -> DataFrame:
    """Edges with schema, path and business key of their source and target (``source_schema`` and so on).

    edges have a column ``id``: those without a field find none, but are spread by it, so that they don't meet in one task.
    """
    out = edges
    for side in ("source", "target"):
        ref = F.col(f"{side}_field_id")
        spread = F.coalesce(ref, F.concat(F.lit("\0"), F.pmod(F.xxhash64("id"), F.lit(4096))))
        own = fields.select(F.col("id").alias(f"_{side}"), F.col("schema_id").alias(f"{side}_schema"), F.col("path").alias(f"{side}_path"), F.col("business_key").alias(f"{side}_key"))
        found = ref == F.col(f"_{side}")
        out = out.join(own, found & (spread == F.col(f"_{side}")) if how == "left" else found, how).drop(f"_{side}")
    return out


def with_entry_points(edges: DataFrame, entry_points: DataFrame, *columns: str, delivered: DataFrame | None = None) -> DataFrame:
    """Edges with columns of their entry point, null where there is none; ``delivered``, the table they come from, tells which entry points are hot."""
    few = entry_points.select(F.col("id").alias("_ep"), *columns)
    salts = Salts(delivered, "entry_point_id") if delivered is not None else None
    return salted_join(edges, few, [("entry_point_id", "_ep")], ["id"], "left", salts).drop("_ep")


def impact(edges: DataFrame, fields: DataFrame, entry_points: DataFrame, seeds: DataFrame, delivered: DataFrame | None = None) -> DataFrame:
    """The edges that read a seed field or one below it: ``seed_schema, seed_path``, the edge, its target and its scope.

    seeds: ``schema_id, path``, any number. An absent scope is COMMON, an empty browse address null. Edges whose source or target field is unknown
    are left out, those without entry point are kept.
    """
    asked = seeds.select(F.col("schema_id").alias("seed_schema"), F.col("path").alias("seed_path")).distinct()
    known = with_fields(edges, fields, "inner")
    below = known.withColumn("_above", F.explode(prefixes(F.col("source_path"))))
    hit = below.join(asked, (F.col("source_schema") == F.col("seed_schema")) & (F.col("_above") == F.col("seed_path"))).drop("_above")
    full = with_entry_points(hit, entry_points, "country", "clearing", "product", "class_fqn", "method_name", delivered=delivered)
    scope = {c: F.coalesce(c, F.lit("COMMON")) for c in ("country", "clearing", "product")}
    return full.withColumns(scope).withColumn("browse_url", F.nullif("browse_url", F.lit("")))
