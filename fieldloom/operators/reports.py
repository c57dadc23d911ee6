"""What pages, reports and baselines list, as rows or as one JSON text per pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.text import display_source, label
from fieldloom.operators.coverage import PAIR


def pair_summary(declared: DataFrame, written: DataFrame) -> DataFrame:
    """``repo_id, pair_id, n_declared, n_ignored, n_written, n_unmatched, coverage_percent`` of the declared paths that aren't ignored; 100 if there are none.

    declared: ``repo_id, pair_id, path, ignored``, unique but for ``ignored``: a path that any row ignores is ignored. written: ``repo_id, pair_id, path``.
    """
    own = declared.groupBy(*PAIR, "path").agg(F.max(F.coalesce("ignored", F.lit(False))).alias("ignored"))
    marked = own.join(written.select(*PAIR, "path").distinct().withColumn("_w", F.lit(True)), [*PAIR, "path"], "left")
    asked, hit = ~F.col("ignored"), F.col("_w").isNotNull()
    counts = marked.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n_declared"), F.count_if("ignored").alias("n_ignored"), F.count_if(asked & hit).alias("n_written"), F.count_if(asked & ~hit).alias("n_unmatched"))
    whole = F.col("n_written") + F.col("n_unmatched")
    return counts.withColumn("coverage_percent", F.when(whole > 0, F.bround(F.lit(100.0) * F.col("n_written") / whole, 2)).otherwise(F.lit(100.0)))


def baseline_entries(states: DataFrame) -> DataFrame:
    """``pair, entry``: the JSON object that a baseline keeps of a pair, ``repo:pair``: members in the order of their names, unmatched paths sorted.

    states: ``repo_id, pair_id, target_field_count, coverage_percent, unmatched``, one row a pair; a null list is an empty one. The list is bounded by a pair's schemas.
    """
    entry = F.struct("coverage_percent", "target_field_count", F.array_sort(F.coalesce("unmatched", F.array().cast("array<string>"))).alias("unmatched"))
    return states.select(F.concat_ws(":", *PAIR).alias("pair"), F.to_json(entry, {"ignoreNullFields": "false"}).alias("entry"))


def browse_url(template: str, repo: Column, sha: Column, file: Column, line: Column) -> Column:
    """A template with {repo}, {sha}, {file} and {line} filled in; null if any of them is."""
    out = F.lit(template)
    for name, value in (("{repo}", repo), ("{sha}", sha), ("{file}", file), ("{line}", line.cast("string"))):
        out = F.replace(out, F.lit(name), value)
    return out


def index_lines(entry_points: DataFrame) -> DataFrame:
    """The lines of the index of entry points: ``country, clearing, product, class_fqn, method_name, id, markdown``; an absent scope is COMMON.

    They are rows, in the order of these columns on a page, as the entry points of one scope may be many.
    """
    scope = [F.coalesce(c, F.lit("COMMON")).alias(c) for c in ("country", "clearing", "product")]
    text = F.concat(F.lit("- "), label(F.col("class_fqn"), F.col("method_name")), F.lit(" ("), F.coalesce(F.col("edge_count").cast("string"), F.lit("?")), F.lit(" edges)"))
    return entry_points.select(*scope, "class_fqn", "method_name", "id", text.alias("markdown"))


def entry_point_lines(edges: DataFrame) -> DataFrame:
    """The rows of the entry points' pages: ``entry_point_id, part, line, key, markdown``: each edge (part 1), then each helper once with what it is used for (part 2).

    edges: with ``target_path, source_path, expression, kind, line, static_helper_fqn``. Edges without entry point are on no page.
    """
    own = edges.filter("entry_point_id IS NOT NULL")
    target = F.coalesce("target_path", "target_field_id")
    row = F.concat(F.lit("| "), F.concat_ws(" | ", target, F.coalesce(display_source(F.col("source_path"), F.col("expression")), F.lit("")), F.coalesce("kind", F.lit(""))), F.lit(" |"))
    first = own.select("entry_point_id", F.lit(1).alias("part"), "line", F.col("id").alias("key"), row.alias("markdown"))
    helpers = own.filter("static_helper_fqn IS NOT NULL").groupBy("entry_point_id", "static_helper_fqn").agg(F.min("line").alias("line"), F.count(F.lit(1)).alias("n"))
    second = helpers.select("entry_point_id", F.lit(2).alias("part"), "line", F.col("static_helper_fqn").alias("key"), F.concat(F.lit("- `"), "static_helper_fqn", F.lit("` used by "), F.col("n").cast("string")).alias("markdown"))
    return first.unionByName(second)
