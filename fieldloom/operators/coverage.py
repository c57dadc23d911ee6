"""Which target fields are written, against those a schema declares; drift between two states of that."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.text import percent

PAIR = ["repo_id", "pair_id"]


def pair_targets(entry_points: DataFrame) -> DataFrame:
    """The target schemas of each repository and pair: ``repo_id, pair_id, schema_id``."""
    return entry_points.filter("target_schema_id IS NOT NULL").select(*PAIR, F.col("target_schema_id").alias("schema_id")).distinct()


def declared_paths(targets: DataFrame, fields: DataFrame) -> DataFrame:
    """The paths that the target schemas of a pair declare, over all of them: ``repo_id, pair_id, path``."""
    return targets.join(fields.select(F.col("schema_id").alias("_s"), "path"), F.col("schema_id") == F.col("_s")).select(*PAIR, "path").distinct()


def written_paths(edges: DataFrame, fields: DataFrame) -> DataFrame:
    """The paths that the edges of a pair write: ``repo_id, pair_id, path``."""
    keys = edges.select(*PAIR, "target_field_id").distinct()
    return keys.join(fields.select("id", "path"), F.col("target_field_id") == F.col("id")).select(*PAIR, "path").distinct()


def pair_coverage(declared: DataFrame, written: DataFrame) -> DataFrame:
    """``repo_id, pair_id, n_declared, n_written, coverage_percent`` of the declared paths; paths match whatever their schema."""
    marked = declared.join(written.withColumn("_w", F.lit(1)), [*PAIR, "path"], "left")
    counts = marked.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n_declared"), F.count("_w").alias("n_written"))
    return counts.withColumn("coverage_percent", percent(F.col("n_written"), F.col("n_declared")))


def unmatched(declared: DataFrame, written: DataFrame) -> DataFrame:
    """The declared paths of a pair that nothing writes."""
    return declared.join(written, [*PAIR, "path"], "left_anti")


def synthetic_edges(missing: DataFrame) -> DataFrame:
    """An edge of kind ``unmapped`` for each such path: ``id, repo_id, pair_id, target_path, kind, mapper_kind``."""
    digits = F.substring(F.sha1(F.concat(F.lit("unmapped\n"), F.col("path"))), 1, 8)
    return missing.select(
        F.concat_ws(".", "repo_id", "pair_id", F.concat(F.lit("e_"), digits)).alias("id"), *PAIR, F.col("path").alias("target_path"), F.lit("unmapped").alias("kind"), F.lit("schema").alias("mapper_kind")
    )


def drift(current: DataFrame, baseline: DataFrame, max_added: int = 0, max_drop: float = 0.0) -> DataFrame:
    """Pairs of both states: newly unmatched and newly matched paths, the drop of the coverage, and whether that is a regression.

    Both sides: ``repo_id, pair_id, coverage_percent, unmatched`` (array). A pair that one side lacks has no paths there and no coverage,
    which counts as 0. Null is an empty list.
    """
    cur = current.select(*PAIR, F.col("coverage_percent").alias("c"), F.coalesce("unmatched", F.array().cast("array<string>")).alias("u"))
    base = baseline.select(*PAIR, F.col("coverage_percent").alias("bc"), F.coalesce("unmatched", F.array().cast("array<string>")).alias("bu"))
    none = F.array().cast("array<string>")
    u, bu = F.coalesce("u", none), F.coalesce("bu", none)
    drop = F.bround(F.coalesce("bc", F.lit(0.0)) - F.coalesce("c", F.lit(0.0)), 2)
    both = cur.join(base, PAIR, "full").withColumns({"added": F.array_sort(F.array_except(u, bu)), "removed": F.array_sort(F.array_except(bu, u)), "coverage_drop": drop})
    return both.select(*PAIR, F.col("c").alias("coverage_percent"), F.col("bc").alias("baseline_percent"), "added", "removed", "coverage_drop", ((F.size("added") > max_added) | (F.col("coverage_drop") > max_drop)).alias("regression"))
