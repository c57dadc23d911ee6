"""Queries of the lineage model: facts, joins, impact, coverage, drift, graph, search and documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.globs import ScopeRule, in_folder, indexed, matches_any, scope_of, with_generated
from fieldloom.functions.text import decapitalised, display_source, edge_id, entry_point_id, label, manifest_edge_id, percent, plain_id, scope_name, short_filename
from fieldloom.operators import facts
from fieldloom.operators.coverage import PAIR, declared_paths, drift, pair_coverage, pair_targets, synthetic_edges, unmatched, written_paths
from fieldloom.operators.facts import first_wins, insert_or_ignore
from fieldloom.operators.graph import ATOMS, edges_by_key, graph_links, graph_nodes, inverted_index, search, text_atoms, top_entry_points, unverifiable
from fieldloom.operators.impact import impact, with_entry_points, with_fields
from fieldloom.operators.lineage import compare_schemas, diff_versions, field_links, graph_of, key_links, reach, trace
from fieldloom.operators.extract import assembled_entry_points, classify_class, code_lines, methods, setter_edges, units
from fieldloom.operators.leaves import java_leaves, xsd_elements, xsd_leaves
from fieldloom.operators.resolve import BROADCAST_ROWS, java_index, java_tree, setter_facts
from fieldloom.plans.scratch import Scratch
from fieldloom.sinks.documents import linked_nodes, markdown_lines
from fieldloom.sinks.snapshot import table_digest
from fieldloom.sources import read_table

QUERIES: dict = {}
SQL: dict[str, str] = {}

# The current state of the tables, as in fieldloom.operators.facts.
E = "e AS (SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingest_seq DESC) = 1)"
FI = "f AS (SELECT * FROM field QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingest_seq DESC) = 1)"
EP = """ep AS (SELECT *, scope.country AS country, scope.clearing AS clearing, scope.product AS product FROM entry_point QUALIFY row_number() OVER (PARTITION BY id ORDER BY seen_at DESC NULLS LAST,
  line DESC NULLS LAST, coalesce(scope.country, ''), coalesce(scope.clearing, ''), coalesce(scope.product, ''), coalesce(edge_count, -1), coalesce(resolution_percent, -1), method_signature NULLS FIRST) = 1)"""
M = """m AS (SELECT *, scope.country AS country, scope.clearing AS clearing, scope.product AS product FROM mapper QUALIFY row_number() OVER (PARTITION BY id ORDER BY kind NULLS FIRST, file NULLS FIRST,
  coalesce(scope.country, ''), coalesce(scope.clearing, ''), coalesce(scope.product, '')) = 1)"""
SD = "sd AS (SELECT * FROM schema_def QUALIFY row_number() OVER (PARTITION BY id ORDER BY seen_at DESC NULLS LAST, kind NULLS FIRST, file NULLS FIRST) = 1)"
CO = """co AS (SELECT * FROM coverage QUALIFY row_number() OVER (PARTITION BY repo_id, pair_id ORDER BY coalesce(files_scanned, -1) DESC, coalesce(edges_emitted, -1) DESC, coalesce(target_field_count, -1) DESC,
  coalesce(mappers_detected, -1) DESC, coalesce(coverage_percent, -1) DESC, coalesce(len(unmatched), -1) DESC) = 1)"""
DEC = "dec AS (SELECT DISTINCT t.repo_id, t.pair_id, f.path FROM (SELECT DISTINCT repo_id, pair_id, target_schema_id FROM ep) t JOIN f ON f.schema_id = t.target_schema_id)"
DECLARED = f"{DEC}, wr AS (SELECT DISTINCT e.repo_id, e.pair_id, f.path FROM e JOIN f ON e.target_field_id = f.id)"


def query(sql: str | None = None):
    """Registers a function under its own name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def total() -> list:
    """The number of rows, as n."""
    return [F.count(F.lit(1)).alias("n")]


# ---- facts


@query(f"WITH {E} SELECT id, kind, line, ingest_seq FROM e")
def s7_upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """Edges delivered several times: the last delivery counts."""
    return facts.last_wins(read_table(spark, d, "edges").select("id", "kind", "line", "ingest_seq"), "id", "ingest_seq")


@query(f"WITH {E}, {FI}, k AS (SELECT DISTINCT target_field_id AS id FROM e UNION SELECT DISTINCT source_field_id FROM e WHERE source_field_id IS NOT NULL) SELECT id, business_key, 'schema' AS origin FROM f UNION ALL SELECT k.id, NULL, 'edge' FROM k ANTI JOIN f USING (id)")
def s8_insert_or_ignore(spark: SparkSession, d: str) -> DataFrame:
    """Fields, and those that only edges know; a schema's row wins."""
    ends = facts.edges(spark, d, "source_field_id", "target_field_id").select(F.explode(F.array("source_field_id", "target_field_id")).alias("id")).filter("id IS NOT NULL").distinct()
    own = facts.fields(spark, d, "business_key").withColumn("origin", F.lit("schema"))
    return insert_or_ignore(own, ends.select("id", F.lit(None).cast("string").alias("business_key"), F.lit("edge").alias("origin")), "id")


@query("SELECT static_helper_fqn, expression AS first_expression FROM edges WHERE static_helper_fqn IS NOT NULL AND expression IS NOT NULL QUALIFY row_number() OVER (PARTITION BY static_helper_fqn ORDER BY ingest_seq) = 1")
def s9_first_body(spark: SparkSession, d: str) -> DataFrame:
    """The first use of each helper."""
    rows = read_table(spark, d, "edges").filter("static_helper_fqn IS NOT NULL AND expression IS NOT NULL").select("static_helper_fqn", F.col("expression").alias("first_expression"), "ingest_seq")
    return first_wins(rows, "static_helper_fqn", "ingest_seq").drop("ingest_seq")


@query("SELECT (SELECT count(*) FROM edges) AS edge_count, (SELECT count(DISTINCT mapper_id) FROM edges) AS mapper_count, (SELECT count(DISTINCT x) FROM (SELECT source_field_id AS x FROM edges UNION ALL SELECT target_field_id FROM edges)) AS field_count")
def a04_snapshot_totals(spark: SparkSession, d: str) -> DataFrame:
    """Edges, mappers and referenced fields; edges as delivered."""
    df = read_table(spark, d, "edges").select("mapper_id", F.explode(F.array("source_field_id", "target_field_id")).alias("x"))
    keys = F.explode(F.array(F.struct(F.lit("m").alias("k"), F.col("mapper_id").alias("v")), F.struct(F.lit("f").alias("k"), F.col("x").alias("v"))))
    distinct = df.select(keys.alias("k")).select("k.*").filter("v IS NOT NULL").distinct().groupBy().agg(F.count_if(F.col("k") == "m").alias("mapper_count"), F.count_if(F.col("k") == "f").alias("field_count"))
    return read_table(spark, d, "edges").agg(F.count(F.lit(1)).alias("edge_count")).crossJoin(distinct)  # one row each


# ---- joins


@query(f"WITH {E}, {FI} SELECT e.id, s.schema_id AS source_schema, s.path AS source_path, s.business_key AS source_key, t.schema_id AS target_schema, t.path AS target_path, t.business_key AS target_key FROM e LEFT JOIN f s ON e.source_field_id = s.id LEFT JOIN f t ON e.target_field_id = t.id")
def j01_edge_fields_left(spark: SparkSession, d: str) -> DataFrame:
    """Edges with both fields, where known."""
    e = facts.edges(spark, d, "source_field_id", "target_field_id")
    return with_fields(e, facts.fields(spark, d, "schema_id", "path", "business_key")).drop("source_field_id", "target_field_id")


@query(f"WITH {E}, {FI}, {SD}, {EP} SELECT e.id, s.path AS source_path, t.path AS target_path, sd.kind AS schema_kind, ep.country FROM e JOIN f s ON e.source_field_id = s.id JOIN f t ON e.target_field_id = t.id JOIN sd ON t.schema_id = sd.id LEFT JOIN ep ON e.entry_point_id = ep.id")
def j02_edge_fields_schema(spark: SparkSession, d: str) -> DataFrame:
    """Edges with both fields, the target's schema and the entry point's country."""
    e = with_fields(facts.edges(spark, d, "source_field_id", "target_field_id", "entry_point_id"), facts.fields(spark, d, "schema_id", "path", "business_key"), "inner")
    known = e.join(facts.schemas(spark, d).select(F.col("id").alias("_s"), F.col("kind").alias("schema_kind")), F.col("target_schema") == F.col("_s"))
    return with_entry_points(known, facts.entry_points(spark, d), "country", delivered=read_table(spark, d, "edges")).select("id", "source_path", "target_path", "schema_kind", "country")


@query(f"WITH {E}, {FI}, {M} SELECT m.repo_id, m.pair_id, f.path, count(*) AS n FROM e JOIN f ON e.target_field_id = f.id JOIN m ON e.mapper_id = m.id GROUP BY 1, 2, 3")
def j05_covered_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths that the mappers of a pair write."""
    e = facts.edges(spark, d, "mapper_id", "target_field_id").groupBy("mapper_id", "target_field_id").agg(F.count(F.lit(1)).alias("c"))
    e = e.join(facts.fields(spark, d, "path").withColumnRenamed("id", "f"), F.col("target_field_id") == F.col("f"))
    return e.join(facts.mappers(spark, d).select(F.col("id").alias("m"), *PAIR), F.col("mapper_id") == F.col("m")).groupBy(*PAIR, "path").agg(F.sum("c").alias("n"))


@query(f"WITH {E}, {M} SELECT e.repo_id, count(*) AS n_edges, count(e.source_field_id) AS n_sourced, count(DISTINCT m.id) AS n_mappers FROM e JOIN m ON e.mapper_id = m.id GROUP BY 1")
def j06_edges_per_service(spark: SparkSession, d: str) -> DataFrame:
    """Edges of known mappers per repository."""
    per = facts.edges(spark, d, "repo_id", "mapper_id", "source_field_id").groupBy("repo_id", "mapper_id").agg(F.count(F.lit(1)).alias("n"), F.count("source_field_id").alias("s"))
    known = per.join(facts.mappers(spark, d).select(F.col("id").alias("m")), F.col("mapper_id") == F.col("m"))
    return known.groupBy("repo_id").agg(F.sum("n").alias("n_edges"), F.sum("s").alias("n_sourced"), F.count("m").alias("n_mappers"))


@query(f"WITH {E}, {FI} SELECT f.id, f.schema_id, f.path FROM f ANTI JOIN e ON e.target_field_id = f.id")
def j07_coverage_gap_anti(spark: SparkSession, d: str) -> DataFrame:
    """Fields that nothing writes."""
    f = facts.fields(spark, d, "schema_id", "path")
    return f.join(facts.edges(spark, d, "target_field_id").select(F.col("target_field_id").alias("t")).distinct(), F.col("id") == F.col("t"), "left_anti")


@query(f"WITH {FI} SELECT a.business_key, count(*) AS n_pairs, count(DISTINCT a.schema_id) AS n_schemas FROM f a JOIN f b ON a.business_key = b.business_key AND a.id <> b.id GROUP BY 1")
def j09_business_key_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of fields with one business key, counted from the sizes of the keys: no pair is formed."""
    f = facts.fields(spark, d, "business_key", "schema_id").filter("business_key IS NOT NULL").groupBy("business_key").agg(F.count(F.lit(1)).alias("c"), F.countDistinct("schema_id").alias("n_schemas"))
    return f.filter("c > 1").select("business_key", (F.col("c") * (F.col("c") - 1)).alias("n_pairs"), "n_schemas")


@query(f"WITH {M}, {E} SELECT m.id, m.kind FROM m SEMI JOIN e ON e.mapper_id = m.id")
def j12_mapper_has_edges_semi(spark: SparkSession, d: str) -> DataFrame:
    """Mappers with edges."""
    used = facts.edges(spark, d, "mapper_id").select(F.col("mapper_id").alias("e")).distinct()
    return facts.mappers(spark, d).select("id", "kind").join(used, F.col("id") == F.col("e"), "left_semi")


# ---- impact, lists and lookups


_SCOPES = "coalesce(ep.country, 'COMMON') AS country, coalesce(ep.clearing, 'COMMON') AS clearing, coalesce(ep.product, 'COMMON') AS product"
_IMPACT = f"""{E}, {FI}, {EP}, seeds AS (SELECT DISTINCT schema_id, split_part(path, '.', 1) AS path FROM f WHERE path IS NOT NULL AND schema_id IS NOT NULL),
  imp AS (SELECT seeds.schema_id AS seed_schema, seeds.path AS seed_path, e.id, s.path AS source_path, t.schema_id AS target_schema, t.path AS target_path, e.kind, e.line, nullif(e.browse_url, '') AS browse_url,
    {_SCOPES}, ep.class_fqn, ep.method_name
  FROM e JOIN f s ON e.source_field_id = s.id JOIN f t ON e.target_field_id = t.id JOIN seeds ON seeds.schema_id = s.schema_id AND (s.path = seeds.path OR starts_with(s.path, seeds.path || '.')) LEFT JOIN ep ON e.entry_point_id = ep.id)"""
_IMPACT_COLUMNS = ["seed_schema", "seed_path", "id", "source_path", "target_schema", "target_path", "kind", "line", "browse_url", "country", "clearing", "product", "class_fqn", "method_name"]


def _impact(spark: SparkSession, d: str) -> DataFrame:
    fields = facts.fields(spark, d, "schema_id", "path", "business_key")
    seeds = fields.filter("path IS NOT NULL AND schema_id IS NOT NULL").select("schema_id", F.substring_index("path", ".", 1).alias("path"))
    e = facts.edges(spark, d, "source_field_id", "target_field_id", "entry_point_id", "kind", "line", "browse_url")
    return impact(e, fields, facts.entry_points(spark, d), seeds, read_table(spark, d, "edges")).select(*_IMPACT_COLUMNS)


@query(f"WITH {_IMPACT} SELECT {', '.join(_IMPACT_COLUMNS)} FROM imp")
def q07_impact_subtree(spark: SparkSession, d: str) -> DataFrame:
    """What reads each schema's top-level fields or anything below them."""
    return _impact(spark, d)


@query(f"WITH {_IMPACT} SELECT {', '.join(_IMPACT_COLUMNS)} FROM imp WHERE source_path = seed_path")
def q07_impact_exact(spark: SparkSession, d: str) -> DataFrame:
    """What reads each schema's top-level fields themselves."""
    return _impact(spark, d).filter("source_path = seed_path")


@query(f"WITH {_IMPACT} SELECT {', '.join(_IMPACT_COLUMNS)} FROM imp ORDER BY country, clearing, product, class_fqn NULLS FIRST, method_name NULLS FIRST, line NULLS FIRST, id, seed_path LIMIT 100 OFFSET 100")
def q07_impact_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of that, by scope, class, method and line."""
    return _impact(spark, d).orderBy("country", "clearing", "product", "class_fqn", "method_name", "line", "id", "seed_path").offset(100).limit(100)


@query(f"WITH {_IMPACT} SELECT country, clearing, product, count(*) AS n, count(DISTINCT id) AS n_edges FROM imp GROUP BY 1, 2, 3")
def a20_impact_by_scope(spark: SparkSession, d: str) -> DataFrame:
    """Impact per scope."""
    by_edge = _impact(spark, d).groupBy("country", "clearing", "product", "id").agg(F.count(F.lit(1)).alias("c"))
    return by_edge.groupBy("country", "clearing", "product").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_edges"))


@query(f"WITH {CO} SELECT repo_id, pair_id, files_scanned, mappers_detected, edges_emitted, coverage_percent, len(unmatched) AS n_unmatched FROM co ORDER BY coverage_percent NULLS LAST, repo_id, pair_id LIMIT 50")
def q03_coverage_list(spark: SparkSession, d: str) -> DataFrame:
    """The 50 reports with the least coverage, unknown ones last."""
    df = facts.coverage(spark, d).orderBy(F.asc_nulls_last("coverage_percent"), "repo_id", "pair_id").limit(50)
    return df.select("repo_id", "pair_id", "files_scanned", "mappers_detected", "edges_emitted", "coverage_percent", F.when(F.col("unmatched").isNotNull(), F.size("unmatched")).cast("long").alias("n_unmatched"))


@query(f"WITH {EP} SELECT id, class_fqn, method_name, country, edge_count FROM ep WHERE country = 'DE' AND clearing IS NOT NULL ORDER BY class_fqn, method_name, id LIMIT 50 OFFSET 5")
def q04_entry_point_list(spark: SparkSession, d: str) -> DataFrame:
    """A page of entry points by scope."""
    df = facts.entry_points(spark, d).filter("country = 'DE' AND clearing IS NOT NULL").orderBy("class_fqn", "method_name", "id")
    return df.offset(5).limit(50).select("id", "class_fqn", "method_name", "country", "edge_count")


@query(f"WITH {E}, {EP} SELECT ep.id, ep.class_fqn, count(e.id) AS n_edges, count(DISTINCT e.static_helper_fqn) AS n_helpers, min(e.line) AS first_line, max(e.line) AS last_line FROM ep LEFT JOIN e ON e.entry_point_id = ep.id GROUP BY 1, 2")
def q05_entry_point_edges_helpers(spark: SparkSession, d: str) -> DataFrame:
    """Every entry point with its edges and helpers."""
    e = facts.edges(spark, d, "entry_point_id", "static_helper_fqn", "line").groupBy("entry_point_id", "static_helper_fqn").agg(F.count(F.lit(1)).alias("c"), F.min("line").alias("a"), F.max("line").alias("b"))
    per = e.groupBy("entry_point_id").agg(F.sum("c").alias("c"), F.count("static_helper_fqn").alias("h"), F.min("a").alias("first_line"), F.max("b").alias("last_line"))
    zero = F.lit(0).cast("long")
    joined = facts.entry_points(spark, d).select("id", "class_fqn").join(per, F.col("id") == F.col("entry_point_id"), "left")
    return joined.select("id", "class_fqn", F.coalesce("c", zero).alias("n_edges"), F.coalesce("h", zero).alias("n_helpers"), "first_line", "last_line")


@query(f"WITH {E} SELECT id, entry_point_id, line, rn FROM (SELECT id, entry_point_id, line, row_number() OVER (PARTITION BY entry_point_id ORDER BY line NULLS FIRST, id) AS rn FROM e WHERE entry_point_id IS NOT NULL) WHERE rn <= 100")
def q06_edges_page(spark: SparkSession, d: str) -> DataFrame:
    """The first page of every entry point's edges, by line and id; a first cut within salted parts keeps hot entry points from one task."""
    from pyspark.sql import Window

    e = facts.edges(spark, d, "entry_point_id", "line").filter("entry_point_id IS NOT NULL").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(32)))
    order = [F.asc_nulls_first("line"), F.asc("id")]
    first = e.withColumn("rn", F.row_number().over(Window.partitionBy("entry_point_id", "part").orderBy(*order))).filter("rn <= 100")
    return first.withColumn("rn", F.row_number().over(Window.partitionBy("entry_point_id").orderBy(*order))).filter("rn <= 100").select("id", "entry_point_id", "line", "rn")


@query(f"WITH {FI} SELECT id, schema_id, path, business_key FROM f WHERE path ILIKE '%iban%' ORDER BY schema_id, path, id LIMIT 100")
def f03_search_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields whose path contains a text, whatever the case; the first 100."""
    return facts.fields(spark, d, "schema_id", "path", "business_key").filter(F.lower("path").contains("iban")).orderBy("schema_id", "path", "id").limit(100)


@query(f"WITH {E}, x AS (SELECT source_field_id AS field_id, 'source' AS role FROM e UNION ALL SELECT target_field_id, 'target' FROM e) SELECT field_id, role, count(*) AS n FROM x WHERE field_id IS NOT NULL GROUP BY 1, 2")
def q08_field_edges(spark: SparkSession, d: str) -> DataFrame:
    """How often each field is read and written."""
    ends = F.array(*[F.struct(F.col(f"{r}_field_id").alias("field_id"), F.lit(r).alias("role")) for r in ("source", "target")])
    return facts.edges(spark, d, "source_field_id", "target_field_id").select(F.explode(ends).alias("x")).select("x.*").filter("field_id IS NOT NULL").groupBy("field_id", "role").agg(*total())


# ---- aggregates


@query(f"WITH {E}, {FI}, {EP}, {DECLARED} SELECT dec.repo_id, dec.pair_id, count(*) AS n_declared, count(wr.path) AS n_written, round_even(100.0::DOUBLE * count(wr.path) / count(*), 2) AS coverage_percent FROM dec LEFT JOIN wr ON dec.repo_id = wr.repo_id AND dec.pair_id = wr.pair_id AND dec.path = wr.path GROUP BY 1, 2")
def a01_pair_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of each pair's target schemas."""
    f = facts.fields(spark, d, "schema_id", "path")
    return pair_coverage(declared_paths(pair_targets(facts.entry_points(spark, d)), f), written_paths(facts.edges(spark, d, *PAIR, "target_field_id"), f))


@query(f"WITH {E} SELECT entry_point_id, count(*) AS n_edges, count(source_field_id) AS n_resolved, round_even(100.0::DOUBLE * count(source_field_id) / count(*), 2) AS resolution_percent FROM e WHERE entry_point_id IS NOT NULL GROUP BY 1")
def a02_resolution_percent(spark: SparkSession, d: str) -> DataFrame:
    """Share of an entry point's edges with a source."""
    e = facts.edges(spark, d, "entry_point_id", "source_field_id").filter("entry_point_id IS NOT NULL").groupBy("entry_point_id").agg(F.count(F.lit(1)).alias("n_edges"), F.count("source_field_id").alias("n_resolved"))
    return e.withColumn("resolution_percent", percent(F.col("n_resolved"), F.col("n_edges")))


@query(f"WITH {EP}, n AS (SELECT entry_point_id, count(*) AS delivered FROM edges GROUP BY 1) SELECT ep.id, ep.edge_count AS reported, coalesce(n.delivered, 0) AS delivered FROM ep LEFT JOIN n ON ep.id = n.entry_point_id WHERE ep.edge_count IS DISTINCT FROM coalesce(n.delivered, 0)")
def a03_edge_count_off(spark: SparkSession, d: str) -> DataFrame:
    """Entry points whose reported number of edges isn't the delivered one."""
    n = read_table(spark, d, "edges").groupBy("entry_point_id").agg(F.count(F.lit(1)).alias("c"))
    joined = facts.entry_points(spark, d).select("id", F.col("edge_count").alias("reported")).join(n, F.col("id") == F.col("entry_point_id"), "left")
    return joined.select("id", "reported", F.coalesce("c", F.lit(0).cast("long")).alias("delivered")).filter("NOT reported <=> delivered")


@query(f"WITH {E}, {FI}, {EP}, {DECLARED} SELECT dec.repo_id, dec.pair_id, dec.path FROM dec ANTI JOIN wr ON dec.repo_id = wr.repo_id AND dec.pair_id = wr.pair_id AND dec.path = wr.path")
def a06_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Declared paths that nothing writes."""
    f = facts.fields(spark, d, "schema_id", "path")
    return unmatched(declared_paths(pair_targets(facts.entry_points(spark, d)), f), written_paths(facts.edges(spark, d, *PAIR, "target_field_id"), f))


@query(f"WITH {E}, {FI}, {EP}, {DECLARED}, u AS (SELECT dec.repo_id, dec.pair_id, dec.path FROM dec ANTI JOIN wr ON dec.repo_id = wr.repo_id AND dec.pair_id = wr.pair_id AND dec.path = wr.path) SELECT repo_id || '.' || pair_id || '.e_' || sha1('unmapped' || chr(10) || path)[1:8] AS id, repo_id, pair_id, path AS target_path, 'unmapped' AS kind, 'schema' AS mapper_kind FROM u")
def q13_synthetic_unmapped(spark: SparkSession, d: str) -> DataFrame:
    """An edge of its own kind for each of those."""
    return synthetic_edges(a06_unmatched(spark, d))


@query(f"WITH {E}, {M} SELECT e.repo_id, e.pair_id, e.kind, m.kind AS mapper_kind, count(*) AS n FROM e LEFT JOIN m ON e.mapper_id = m.id GROUP BY 1, 2, 3, 4")
def a07_stats_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """Edges per pair, kind and kind of mapper."""
    e = facts.edges(spark, d, *PAIR, "kind", "mapper_id").groupBy(*PAIR, "kind", "mapper_id").agg(F.count(F.lit(1)).alias("c"))
    joined = e.join(facts.mappers(spark, d).select(F.col("id").alias("m"), F.col("kind").alias("mapper_kind")), F.col("mapper_id") == F.col("m"), "left")
    return joined.groupBy(*PAIR, "kind", "mapper_kind").agg(F.sum("c").alias("n"))


@query(f"WITH {M} SELECT kind, repo_id, count(*) AS n FROM m GROUP BY 1, 2")
def a09_mapper_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Mappers per kind and repository."""
    return facts.mappers(spark, d).groupBy("kind", "repo_id").agg(*total())


@query(f"WITH {M} SELECT country, clearing, product, grouping_id(country, clearing, product) AS level, count(*) AS n FROM m GROUP BY ROLLUP (country, clearing, product)")
def a10_mappers_per_scope(spark: SparkSession, d: str) -> DataFrame:
    """Mappers per scope, with subtotals."""
    return facts.mappers(spark, d).rollup("country", "clearing", "product").agg(F.grouping_id().cast("long").alias("level"), *total())


@query(f"WITH {E} SELECT kind, count(*) AS n, count(*) FILTER (static_helper_fqn IS NULL) AS missing, round_even(100.0::DOUBLE * count(source_field_id) / count(*), 2) AS resolved_percent FROM e GROUP BY 1")
def a11_fqn_completeness(spark: SparkSession, d: str) -> DataFrame:
    """Edges without helper, and resolved ones, per kind."""
    e = facts.edges(spark, d, "kind", "static_helper_fqn", "source_field_id").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("static_helper_fqn").isNull()).alias("missing"), F.count("source_field_id").alias("s"))
    return e.withColumn("resolved_percent", percent(F.col("s"), F.col("n"))).drop("s")


@query(f"WITH {E} SELECT static_helper_fqn, count(*) AS n FROM e WHERE static_helper_fqn IS NOT NULL GROUP BY 1 ORDER BY n DESC, static_helper_fqn LIMIT 30")
def a12_helper_topk(spark: SparkSession, d: str) -> DataFrame:
    """The most used helpers."""
    return facts.edges(spark, d, "static_helper_fqn").filter("static_helper_fqn IS NOT NULL").groupBy("static_helper_fqn").agg(*total()).orderBy(F.desc("n"), "static_helper_fqn").limit(30)


@query(f"WITH {E} SELECT entry_point_id, kind, count(*) AS n FROM e GROUP BY 1, 2")
def a15_entry_point_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Edges per entry point and kind."""
    return facts.edges(spark, d, "entry_point_id", "kind").groupBy("entry_point_id", "kind").agg(*total())


@query(f"WITH {E} SELECT kind, min(length(expression)) AS shortest, max(length(expression)) AS longest, round(avg(length(expression)), 6) AS mean FROM e GROUP BY 1")
def a16_expression_length(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of the expressions per kind."""
    n = F.length("expression")
    return facts.edges(spark, d, "kind", "expression").groupBy("kind").agg(F.min(n).cast("long").alias("shortest"), F.max(n).cast("long").alias("longest"), F.round(F.avg(n), 6).alias("mean"))


@query(f"WITH {E} SELECT target_bk AS business_key, id FROM e WHERE target_bk IS NOT NULL UNION SELECT source_bk, id FROM e WHERE source_bk IS NOT NULL")
def a17_edges_by_business_key(spark: SparkSession, d: str) -> DataFrame:
    """Edges under the business keys of both ends."""
    return edges_by_key(facts.edges(spark, d, "source_bk", "target_bk"))


@query(f"WITH {E} SELECT static_helper_fqn, count(DISTINCT entry_point_id) AS n_entry_points, count(DISTINCT target_field_id) AS n_targets, min(line) AS first_line FROM e WHERE static_helper_fqn IS NOT NULL GROUP BY 1")
def a18_helper_used_by(spark: SparkSession, d: str) -> DataFrame:
    """What uses each helper."""
    e = facts.edges(spark, d, "static_helper_fqn", "entry_point_id", "target_field_id", "line").filter("static_helper_fqn IS NOT NULL")
    ends = F.array(F.struct(F.lit("p").alias("k"), F.col("entry_point_id").alias("v")), F.struct(F.lit("t").alias("k"), F.col("target_field_id").alias("v")))
    per = e.select("static_helper_fqn", "line", F.explode(ends).alias("x")).groupBy("static_helper_fqn", "x.k", "x.v").agg(F.min("line").alias("line"))
    known = F.col("v").isNotNull()
    return per.groupBy("static_helper_fqn").agg(F.count_if((F.col("k") == "p") & known).alias("n_entry_points"), F.count_if((F.col("k") == "t") & known).alias("n_targets"), F.min("line").alias("first_line"))


@query(f"WITH {CO} SELECT repo_id, round(avg(coalesce(coverage_percent, 0)), 6) AS mean_coverage, sum(files_scanned) AS files_scanned, sum(coalesce(len(unparseable), 0)) AS n_unparseable FROM co GROUP BY 1")
def a19_avg_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Mean coverage per repository, unknown as 0."""
    listed = F.when(F.col("unparseable").isNotNull(), F.size("unparseable")).otherwise(0)
    return facts.coverage(spark, d).groupBy("repo_id").agg(F.round(F.avg(F.coalesce("coverage_percent", F.lit(0.0))), 6).alias("mean_coverage"), F.sum("files_scanned").alias("files_scanned"), F.sum(listed).alias("n_unparseable"))


@query(f"WITH {EP} SELECT id, list_sort(list_distinct(source_schema_ids)) AS source_schema_ids FROM ep")
def a21_source_schemas(spark: SparkSession, d: str) -> DataFrame:
    """Source schemas of each entry point, sorted."""
    return facts.entry_points(spark, d).select("id", F.array_sort(F.array_distinct("source_schema_ids")).alias("source_schema_ids"))


@query(r"WITH x AS (SELECT lower(regexp_replace(pair_id || '__' || regexp_replace(coalesce(source_field_id, 'none'), '\.[^.#]*#.*$', '') || '_to_' || regexp_replace(target_field_id, '\.[^.#]*#.*$', ''), '[^A-Za-z0-9_-]+', '_', 'g')) AS group_id FROM edges) SELECT group_id, count(*) AS n FROM x GROUP BY 1")
def a23_schema_groups(spark: SparkSession, d: str) -> DataFrame:
    """Edges per pair, source schema and target schema, under one identifier."""
    base = lambda c: F.regexp_replace(c, r"\.[^.#]*#.*$", "")
    group = plain_id(F.concat("pair_id", F.lit("__"), base(F.coalesce("source_field_id", F.lit("none"))), F.lit("_to_"), base(F.col("target_field_id"))))
    return read_table(spark, d, "edges").groupBy(group.alias("group_id")).agg(*total())


# ---- drift and versions

_CUT = "2024-07-01"
_STATES = f"""{FI}, {EP}, old AS (SELECT * FROM edges WHERE ingested_at < TIMESTAMP '{_CUT}'), {DEC},
  wr AS (SELECT DISTINCT e.repo_id, e.pair_id, f.path FROM edges e JOIN f ON e.target_field_id = f.id), wo AS (SELECT DISTINCT e.repo_id, e.pair_id, f.path FROM old e JOIN f ON e.target_field_id = f.id),
  st AS (SELECT dec.repo_id, dec.pair_id, round_even(100.0::DOUBLE * count(wr.path) / count(*), 2) AS c, round_even(100.0::DOUBLE * count(wo.path) / count(*), 2) AS bc,
    coalesce(list(dec.path ORDER BY dec.path) FILTER (wr.path IS NULL AND wo.path IS NOT NULL), []) AS added, coalesce(list(dec.path ORDER BY dec.path) FILTER (wr.path IS NOT NULL AND wo.path IS NULL), []) AS removed
    FROM dec LEFT JOIN wr ON (dec.repo_id, dec.pair_id, dec.path) = (wr.repo_id, wr.pair_id, wr.path) LEFT JOIN wo ON (dec.repo_id, dec.pair_id, dec.path) = (wo.repo_id, wo.pair_id, wo.path) GROUP BY 1, 2)"""


@query(f"WITH {_STATES} SELECT repo_id, pair_id, c AS coverage_percent, bc AS baseline_percent, added, removed, round_even(bc - c, 2) AS coverage_drop, len(added) > 0 OR round_even(bc - c, 2) > 0 AS regression FROM st")
def q10_drift_check(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of all edges against that of those before a day."""
    f = facts.fields(spark, d, "schema_id", "path")
    declared = declared_paths(pair_targets(facts.entry_points(spark, d)), f)
    every = read_table(spark, d, "edges")

    def state(e: DataFrame) -> DataFrame:
        written = written_paths(e, f)
        lists = unmatched(declared, written).groupBy(*PAIR).agg(F.array_sort(F.collect_set("path")).alias("unmatched"))  # paths of one pair's schemas
        return pair_coverage(declared, written).join(lists, PAIR, "left").select(*PAIR, "coverage_percent", "unmatched")

    return drift(state(every), state(every.filter(F.col("ingested_at") < F.expr(f"TIMESTAMP_NTZ'{_CUT} 00:00:00'"))))


_DIFF = f"""o AS (SELECT id, kind, line, confidence FROM edges WHERE ingested_at < TIMESTAMP '{_CUT}' QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingest_seq DESC) = 1)"""


@query(f"WITH {_DIFF}, {E} SELECT coalesce(e.id, o.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN e.id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM e FULL JOIN o ON e.id = o.id WHERE o.id IS NULL OR e.id IS NULL OR (e.kind, e.line, e.confidence) IS DISTINCT FROM (o.kind, o.line, o.confidence)")
def q17_diff_versions(spark: SparkSession, d: str) -> DataFrame:
    """Edges added or changed since a day."""
    rows = read_table(spark, d, "edges").select("id", "kind", "line", "confidence", "ingest_seq", "ingested_at")
    old = facts.last_wins(rows.filter(F.col("ingested_at") < F.expr(f"TIMESTAMP_NTZ'{_CUT} 00:00:00'")), "id", "ingest_seq")
    return diff_versions(old, facts.last_wins(rows, "id", "ingest_seq"), "id", ["kind", "line", "confidence"])


_SIDE = "(SELECT business_key, list_sort(list(DISTINCT path)) AS paths FROM f WHERE business_key IS NOT NULL AND regexp_extract(schema_id, '^([A-Za-z0-9]+)_', 1) = '{}' GROUP BY 1)"


@query(f"WITH {FI} SELECT business_key, l.paths AS left_paths, r.paths AS right_paths FROM {_SIDE.format('LocalDomain')} l FULL JOIN {_SIDE.format('Mt103')} r USING (business_key)")
def q16_compare_models(spark: SparkSession, d: str) -> DataFrame:
    """Two families of schemas by business key."""
    return compare_schemas(facts.fields(spark, d, "business_key", "path", "schema_id"), "LocalDomain", "Mt103")


# The reference goes on while the depth of an edge is under 6, the first being at 0: seven links.
LINKS_DEEP = 7


def _graph_of_fields(spark: SparkSession, d: str) -> tuple[DataFrame, Broadcast | bool]:
    scratch = Scratch(spark)
    links = scratch.cut(field_links(read_table(spark, d, "edges")))
    return links, graph_of(links, scratch)


def _both_ways(spark: SparkSession, d: str, operator: Callable[..., DataFrame]) -> DataFrame:
    links, graph = _graph_of_fields(spark, d)
    down = operator(links, None, LINKS_DEEP, graph=graph).select(F.lit("down").alias("direction"), "*")
    up = operator(links, None, LINKS_DEEP, upstream=True, graph=graph).select(F.lit("up").alias("direction"), "*")
    return down.unionByName(up)


_TRACE = """WITH RECURSIVE l AS (SELECT DISTINCT source_field_id AS a, target_field_id AS b FROM edges WHERE source_field_id IS NOT NULL AND target_field_id IS NOT NULL AND source_field_id <> target_field_id),
  t(seed, field, depth) AS (SELECT DISTINCT {a}, {a}, 0 FROM l WHERE {a} NOT IN (SELECT {b} FROM l) UNION SELECT t.seed, l.{b}, t.depth + 1 FROM t JOIN l ON l.{a} = t.field WHERE t.depth < 7)
  SELECT seed, field, min(depth) AS depth FROM t WHERE depth > 0 GROUP BY 1, 2"""


@query(_TRACE.format(a="a", b="b"))
def q14_trace_lineage_down(spark: SparkSession, d: str) -> DataFrame:
    """Fields that depend on each origin, over all seven links of the reference."""
    links, graph = _graph_of_fields(spark, d)
    return trace(links, None, LINKS_DEEP, graph=graph)


@query(_TRACE.format(a="b", b="a"))
def q14_trace_lineage_up(spark: SparkSession, d: str) -> DataFrame:
    """Fields on which each final field depends, over as many links."""
    links, graph = _graph_of_fields(spark, d)
    return trace(links, None, LINKS_DEEP, upstream=True, graph=graph)


@query(f"WITH x AS ({_TRACE.format(a='a', b='b')}) SELECT seed, count(*) AS n_fields, max(depth) AS longest, count(DISTINCT split_part(field, '#', 1)) AS n_schemas FROM x GROUP BY 1")
def q15_impact_of_change(spark: SparkSession, d: str) -> DataFrame:
    """How far a change of each origin reaches."""
    links, graph = _graph_of_fields(spark, d)
    return reach(links, None, LINKS_DEEP, graph=graph)


_ALL_LINKS = "l0 AS (SELECT DISTINCT source_field_id AS a, target_field_id AS b FROM edges WHERE source_field_id IS NOT NULL AND target_field_id IS NOT NULL), l AS (SELECT * FROM l0 WHERE a <> b)"
_WAY = """s{n} AS (SELECT DISTINCT {a} AS seed FROM l WHERE {a} NOT IN (SELECT {b} FROM l)),
  t{n}(seed, field, depth) AS (SELECT seed, seed, 0 FROM s{n} UNION SELECT t.seed, l.{b}, t.depth + 1 FROM t{n} t JOIN l ON l.{a} = t.field WHERE t.depth < 7)"""
_BOTH_WAYS = f"""WITH RECURSIVE {_ALL_LINKS}, {_WAY.format(n=1, a='a', b='b')}, {_WAY.format(n=2, a='b', b='a')},
  x AS (SELECT 'down' AS direction, seed, field, min(depth) AS depth FROM t1 WHERE depth > 0 GROUP BY ALL UNION ALL SELECT 'up', seed, field, min(depth) FROM t2 WHERE depth > 0 GROUP BY ALL)"""


@query(f"{_BOTH_WAYS} SELECT * FROM x")
def q14_lineage_both_ways(spark: SparkSession, d: str) -> DataFrame:
    """Fields that depend on each origin, and fields on which each final field depends, over all seven links of the reference."""
    return _both_ways(spark, d, trace)


@query(f"{_BOTH_WAYS} SELECT direction, seed, count(*) AS n_fields, max(depth) AS longest, count(DISTINCT split_part(field, '#', 1)) AS n_schemas FROM x GROUP BY 1, 2")
def q15_impact_both_ways(spark: SparkSession, d: str) -> DataFrame:
    """How far a change of each origin reaches, and how much each final field rests on."""
    return _both_ways(spark, d, reach)


_KEY_WAY = """t{n}(seed, field, depth) AS (SELECT DISTINCT l.{a}, l.{b}, 1 FROM l WHERE split_part(l.{a}, '#', 1) = (SELECT min(split_part({a}, '#', 1)) FROM l)
  UNION SELECT t.seed, h.b, t.depth + 1 FROM t{n} t JOIN h{n} h ON h.a = t.field WHERE t.depth < 7)"""
_HOPS = """h{n} AS (SELECT {a} AS a, {b} AS b FROM l UNION SELECT x.id, l0.{b} FROM f x JOIN f y ON x.business_key = y.business_key JOIN l0 ON l0.{a} = y.id)"""


@query(f"""WITH RECURSIVE {FI}, {_ALL_LINKS}, {_HOPS.format(n=1, a='a', b='b')}, {_HOPS.format(n=2, a='b', b='a')}, {_KEY_WAY.format(n=1, a='a', b='b')}, {_KEY_WAY.format(n=2, a='b', b='a')}
  SELECT 'down' AS direction, seed, field, min(depth) AS depth FROM t1 GROUP BY ALL UNION ALL SELECT 'up', seed, field, min(depth) FROM t2 GROUP BY ALL""")
def q14_lineage_by_key(spark: SparkSession, d: str) -> DataFrame:
    """As the reference traces one change: from the fields of one schema, the first by name in each direction, going on from all fields of an equal business key."""
    edges = read_table(spark, d, "edges")
    links, keys = field_links(edges), facts.fields(spark, d, "business_key")
    found = []
    for direction, side, upstream in (("down", "a", False), ("up", "b", True)):
        schema = F.substring_index(side, "#", 1)
        first = links.agg(F.min(schema).alias("first"))
        seeds = links.crossJoin(F.broadcast(first)).filter(schema == F.col("first")).select(F.col(side).alias("seed"))  # first is one row
        reached = trace(links, seeds, LINKS_DEEP, upstream, (keys, key_links(edges, keys, upstream)))
        found.append(reached.select(F.lit(direction).alias("direction"), "seed", "field", "depth"))
    return found[0].unionByName(found[1])


# ---- graph and search

_TOP = f"{EP}, top AS (SELECT *, (SELECT count(*) FROM ep) > 200 AS truncated FROM ep ORDER BY edge_count DESC NULLS LAST, id LIMIT 200)"
_LINKS = f"{_TOP}, {E}, own AS (SELECT e.* FROM e SEMI JOIN top ON e.entry_point_id = top.id), li AS (SELECT source_field_id AS source, entry_point_id AS target, 'reads' AS kind FROM own WHERE source_field_id IS NOT NULL UNION SELECT entry_point_id, target_field_id, 'writes' FROM own WHERE target_field_id IS NOT NULL)"


_NODES = """WITH {links}, {fields} SELECT id, 'entry_point' AS kind, string_split(class_fqn, '.')[-1] || '.' || method_name AS label, NULL AS schema_id FROM top
  UNION ALL SELECT x.id, 'field', coalesce(f.path, x.id), f.schema_id FROM (SELECT source AS id FROM li WHERE kind = 'reads' UNION SELECT target FROM li WHERE kind = 'writes') x LEFT JOIN f ON x.id = f.id"""
# the same over 2000, the reference's default
_TOP_2000, _LINKS_2000 = (x.replace("> 200 ", "> 2000 ").replace("LIMIT 200)", "LIMIT 2000)") for x in (_TOP, _LINKS))


def _graph(spark: SparkSession, d: str, limit: int = 2000) -> tuple[DataFrame, DataFrame]:
    top = top_entry_points(facts.entry_points(spark, d), limit)
    return top, graph_links(facts.edges(spark, d, "entry_point_id", "source_field_id", "target_field_id"), top, read_table(spark, d, "edges"))


@query(f"WITH {_TOP} SELECT id, edge_count, truncated FROM top")
def o03_top_entry_points(spark: SparkSession, d: str) -> DataFrame:
    """The 200 entry points with the most edges."""
    return _graph(spark, d, 200)[0].select("id", "edge_count", "truncated")


@query(f"WITH {_LINKS} SELECT * FROM li")
def q09_graph_links(spark: SparkSession, d: str) -> DataFrame:
    """What they read and write."""
    return _graph(spark, d, 200)[1]


@query(f"""WITH {_LINKS}, {FI} SELECT id, 'entry_point' AS kind, string_split(class_fqn, '.')[-1] || '.' || method_name AS label, NULL AS schema_id FROM top
  UNION ALL SELECT x.id, 'field', coalesce(f.path, x.id), f.schema_id FROM (SELECT source AS id FROM li WHERE kind = 'reads' UNION SELECT target FROM li WHERE kind = 'writes') x LEFT JOIN f ON x.id = f.id""")
def q09_graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The nodes of that graph."""
    top, links = _graph(spark, d, 200)
    return graph_nodes(links, top, facts.fields(spark, d, "path", "schema_id"))


@query(f"WITH {_TOP_2000} SELECT id, edge_count, truncated FROM top")
def o03_top_2000_entry_points(spark: SparkSession, d: str) -> DataFrame:
    """The 2000 entry points with the most edges."""
    return _graph(spark, d)[0].select("id", "edge_count", "truncated")


@query(f"WITH {_LINKS_2000} SELECT * FROM li")
def q09_graph_2000_links(spark: SparkSession, d: str) -> DataFrame:
    """What they read and write."""
    return _graph(spark, d)[1]


@query(_NODES.format(links=_LINKS_2000, fields=FI))
def q09_graph_2000_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The nodes of that graph."""
    top, links = _graph(spark, d)
    return graph_nodes(links, top, facts.fields(spark, d, "path", "schema_id"))


_TOKENS = r"tok AS (SELECT doc_id AS key, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS token FROM documents), ix AS (SELECT token, key, count(*) AS n FROM tok WHERE token <> '' GROUP BY 1, 2)"


@query(f"WITH {_TOKENS} SELECT token, count(*) AS n_documents, sum(n) AS n FROM ix GROUP BY 1")
def q19_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents and occurrences of every token."""
    index = inverted_index(read_table(spark, d, "documents"), "doc_id", "text")
    return index.groupBy("token").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n").alias("n"))


@query(f"WITH {_TOKENS} SELECT key, sum(n) AS n FROM ix WHERE token IN ('iban', 'mapper') GROUP BY 1 HAVING count(*) = 2")
def q19_fts_search(spark: SparkSession, d: str) -> DataFrame:
    """Documents with two words."""
    return search(inverted_index(read_table(spark, d, "documents"), "doc_id", "text"), ["iban", "mapper"])


_ATOMS = " UNION ALL ".join(f"SELECT doc_id AS key, '{kind}' AS kind, unnest(regexp_extract_all(text, '{pattern}', {1 if kind == 'field_path' else 0})) AS atom FROM documents" for kind, pattern in ATOMS.items())


@query(rf"""WITH a AS (SELECT DISTINCT * FROM ({_ATOMS})), k AS (SELECT 'edge_id' AS kind, id AS atom FROM edges UNION ALL SELECT 'url', browse_url FROM edges UNION ALL SELECT 'sha', sha FROM edges
  UNION ALL SELECT 'mapper_fqn', fqn FROM mapper UNION ALL SELECT 'file_path', regexp_replace(file, '^(\./)+', '') FROM source_file UNION ALL SELECT 'field_path', path FROM field)
  SELECT * FROM a ANTI JOIN k USING (kind, atom)""")
def q20_atom_unverifiable(spark: SparkSession, d: str) -> DataFrame:
    """What documents name of edges, classes, files, addresses, commits and fields that the facts don't have."""
    edges, atom = read_table(spark, d, "edges"), lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("atom"))
    own = edges.select(F.explode(F.array(atom("edge_id", F.col("id")), atom("url", F.col("browse_url")), atom("sha", F.col("sha")))).alias("a")).select("a.*")
    mappers = read_table(spark, d, "mapper").select(F.lit("mapper_fqn").alias("kind"), F.col("fqn").alias("atom"))
    files = read_table(spark, d, "source_file").select(F.lit("file_path").alias("kind"), F.regexp_replace("file", r"^(\./)+", "").alias("atom"))
    paths = read_table(spark, d, "field").select(F.lit("field_path").alias("kind"), F.col("path").alias("atom"))
    known = own.unionByName(mappers).unionByName(files).unionByName(paths)
    return unverifiable(text_atoms(read_table(spark, d, "documents"), "doc_id", "text"), known)


# ---- functions


@query("""SELECT id, repo_id || '.' || pair_id || '.e_' || sha1(concat_ws(':', file, line, target_field_id))[1:12] AS edge_id,
  regexp_replace(lower(repo_id), '[^a-z0-9_-]+', '_', 'g') || '.' || regexp_replace(lower(pair_id), '[^a-z0-9_-]+', '_', 'g') || '.e_' || sha1(concat_ws(chr(10), file, line, target_field_id, coalesce(source_field_id, '')))[1:8] AS manifest_id FROM edges""")
def id_edges(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers of edges by content."""
    c = [F.col(x) for x in ("repo_id", "pair_id", "file", "line", "target_field_id")]
    return read_table(spark, d, "edges").select("id", edge_id(*c).alias("edge_id"), manifest_edge_id(*c, F.col("source_field_id")).alias("manifest_id"))


@query("SELECT DISTINCT repo_id || '.' || pair_id || '.ep_' || sha1(concat_ws('|', repo_id, pair_id, class_fqn || '#' || method_signature || '->' || target_schema_id))[1:12] AS entry_point_id FROM entry_point WHERE method_signature IS NOT NULL AND target_schema_id IS NOT NULL AND class_fqn IS NOT NULL")
def id_entry_points(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers of entry points by content."""
    df = read_table(spark, d, "entry_point").filter("method_signature IS NOT NULL AND target_schema_id IS NOT NULL AND class_fqn IS NOT NULL")
    return df.select(entry_point_id(*[F.col(x) for x in ("repo_id", "pair_id", "class_fqn", "method_signature", "target_schema_id")]).alias("entry_point_id")).distinct()


_FLAT = r"replace(trim(regexp_replace(e.expression, '\s+', ' ', 'g')), '|', '\|')"


@query(f"WITH {E}, {FI} SELECT e.id, coalesce(f.path, CASE WHEN length({_FLAT}) > 60 THEN {_FLAT}[1:59] || '…' ELSE {_FLAT} END) AS shown FROM e LEFT JOIN f ON e.source_field_id = f.id")
def f08_display_source(spark: SparkSession, d: str) -> DataFrame:
    """How the source of each edge is shown."""
    e = facts.edges(spark, d, "source_field_id", "expression").join(facts.fields(spark, d, "path").withColumnRenamed("id", "f"), F.col("source_field_id") == F.col("f"), "left")
    return e.select("id", display_source(F.col("path"), F.col("expression")).alias("shown"))


@query(f"""WITH {EP}, x AS (SELECT id, string_split(class_fqn, '.')[-1] || '.' || method_name AS label, method_name FROM ep) SELECT id, label, CASE WHEN length(label) > 80 THEN label[1:79] || '~' ELSE label END || '-' || sha1(id)[1:12] AS file_name, lower(method_name[1:1]) || method_name[2:] AS lower_name FROM x""")
def f11_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels and file names of entry points."""
    c, m = F.col("class_fqn"), F.col("method_name")
    return facts.entry_points(spark, d).select("id", label(c, m).alias("label"), short_filename(c, m, F.col("id")).alias("file_name"), decapitalised(m).alias("lower_name"))


#: The layout of the repositories: a service and a rail are parts of the path.
SCOPE_RULES = [ScopeRule("**/mapper/common/**", scope={"product": "COMMON"}), ScopeRule("**/src/main/java/org/*/*/{clearing}/mapper/**"), ScopeRule("**", r"^(?P<country>[A-Z][a-z]+)[A-Z0-9].*\.(?:json|xsd)$")]


@query(r"""SELECT file_id, CASE WHEN regexp_matches(file, '^.*mapper/common/.*$') THEN NULL WHEN regexp_matches(file, '^.*src/main/java/org/[^/]*/[^/]*/([^/]+)/mapper/.*$') THEN NULL WHEN regexp_matches(string_split(file, '/')[-1], '^([A-Z][a-z]+)[A-Z0-9].*\.(?:json|xsd)$') THEN upper(regexp_extract(string_split(file, '/')[-1], '^([A-Z][a-z]+)[A-Z0-9].*\.(?:json|xsd)$', 1)) END AS country,
  CASE WHEN regexp_matches(file, '^.*mapper/common/.*$') THEN NULL WHEN regexp_matches(file, '^.*src/main/java/org/[^/]*/[^/]*/([^/]+)/mapper/.*$') THEN upper(regexp_extract(file, '^.*src/main/java/org/[^/]*/[^/]*/([^/]+)/mapper/.*$', 1)) END AS clearing, CASE WHEN regexp_matches(file, '^.*mapper/common/.*$') THEN 'COMMON' END AS product FROM source_file""")
def c01_scope_from_path(spark: SparkSession, d: str) -> DataFrame:
    """Scopes of files by their paths."""
    return read_table(spark, d, "source_file").select("file_id", scope_of(F.col("file"), SCOPE_RULES).alias("s")).select("file_id", "s.country", "s.clearing", "s.product")


@query(r"SELECT DISTINCT repo_id, upper(trim(regexp_replace(repo_id, '[^A-Za-z0-9]+', '_', 'g'), '_')) AS scope FROM documents")
def c03_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Names as scopes."""
    return read_table(spark, d, "documents").select("repo_id").distinct().withColumn("scope", scope_name(F.col("repo_id")))


# ---- scans and extraction

GLOBS = ["**/src/main/java/**", "**/target/generated-sources/**"]


@query(r"SELECT repo_id, regexp_replace(file, '^(\./)+', '') AS path FROM source_file WHERE regexp_matches(file, '^.*\.java$') AND (regexp_matches(file, '^.*src/main/java/.*$') OR regexp_matches(file, '^.*target/generated-sources/.*$')) AND NOT regexp_matches('/' || file, '/(?:\.git|node_modules|build)/')")
def s01_scan_java_files(spark: SparkSession, d: str) -> DataFrame:
    """Java files by globs, skipped folders left out; the content isn't read."""
    df = read_table(spark, d, "source_file").filter(F.col("file").endswith(".java") & matches_any(F.col("file"), GLOBS) & ~in_folder(F.col("file"), [".git", "node_modules", "build"]))
    return df.select("repo_id", F.regexp_replace("file", r"^(\./)+", "").alias("path"))


_IN_INDEX = r"""file LIKE '%.java' AND NOT list_has_any(string_split(file, '/')[:-2], string_split('.git .idea .vscode .gradle .settings node_modules build out bin dist .next .nuxt .cache classes test-classes dependency site surefire-reports failsafe-reports', ' '))
  AND NOT regexp_matches('/' || file, '/target/[^/]*/') OR file LIKE '%.java' AND regexp_matches('/' || file, '/target/(?:generated-sources|atlas)/')"""


@query(f"SELECT file_id, file FROM source_file WHERE {_IN_INDEX}")
def s03_index_scan(spark: SparkSession, d: str) -> DataFrame:
    """The Java files of an index of all sources; the content isn't read."""
    return read_table(spark, d, "source_file").select("file_id", "file").filter(indexed(F.col("file")))


@query(r"SELECT repo_id, file FROM source_file WHERE regexp_matches(file, '^[^/]*/src/main/java/.*mapper/.*[.]java$') OR regexp_matches(file, '^[^/]*/target/generated-sources/annotations/.*[^/]*[.]java$')")
def s05_generated_globs(spark: SparkSession, d: str) -> DataFrame:
    """Files of a glob below the main sources, which is extended to the generated ones."""
    df = read_table(spark, d, "source_file").select("repo_id", "file")
    return df.filter(matches_any(F.col("file"), with_generated(["*/src/main/java/**/mapper/**.java"])))


@query(r"SELECT repo_id, file FROM source_file WHERE regexp_matches(file, '^.*[.]java$') AND NOT (regexp_matches(file, '^.*target/.*$') OR regexp_matches(file, '^[^/]*/src/main/java/.*Mapper[0-9][^/]*[.]java$'))")
def s06_skip_globs(spark: SparkSession, d: str) -> DataFrame:
    """Java files, those of some globs left out."""
    df = read_table(spark, d, "source_file").select("repo_id", "file")
    return df.filter(matches_any(F.col("file"), ["**/*.java"]) & ~matches_any(F.col("file"), ["**/target/**", "*/src/main/java/**Mapper{n}.java"]))


@query()
def x01_units(spark: SparkSession, d: str) -> DataFrame:
    """Package, type and imports of every Java file."""
    u = units(read_table(spark, d, "source_file"))
    return u.select("file_id", "package", "class_name", F.size("imports").alias("n_imports"))


@query(r"""SELECT repo_id, CASE WHEN contains(file, '/target/generated-sources/') AND regexp_matches(content, '@Generated\b') THEN 'mapstruct-impl' WHEN regexp_matches(content, '@Mapper\b') THEN 'mapstruct-interface'
  WHEN content IS NOT NULL THEN 'setter' END AS kind, count(*) AS n FROM source_file WHERE file LIKE '%.java' GROUP BY 1, 2""")
def x06_classify_class(spark: SparkSession, d: str) -> DataFrame:
    """Mapper classes by kind."""
    return read_table(spark, d, "source_file").filter(F.col("file").endswith(".java")).groupBy("repo_id", classify_class(F.col("file"), F.col("content")).alias("kind")).agg(*total())


@query()
def x07_methods(spark: SparkSession, d: str) -> DataFrame:
    """Methods with their line."""
    return methods(code_lines(read_table(spark, d, "source_file")))


@query()
def x09_setter_edges(spark: SparkSession, d: str) -> DataFrame:
    """The edges that setters in Java files make."""
    return setter_edges(code_lines(read_table(spark, d, "source_file")))


@query()
def x17_entry_points(spark: SparkSession, d: str) -> DataFrame:
    """The methods with such edges."""
    return assembled_entry_points(x09_setter_edges(spark, d))


def _java(spark: SparkSession, d: str) -> tuple[DataFrame, Scratch]:
    scratch = Scratch(spark, BROADCAST_ROWS)
    return scratch.cut(java_tree(read_table(spark, d, "source_file"))), scratch


@query()
def x03_java_classes(spark: SparkSession, d: str) -> DataFrame:
    """The classes of the Java files with the number of their methods and fields."""
    tree, _ = _java(spark, d)
    index = java_index(tree)
    members = index.methods.select("file_id", "class_node", F.lit(1).alias("m"), F.lit(0).alias("f")).unionByName(index.fields.select("file_id", "class_node", F.lit(0).alias("m"), F.lit(1).alias("f")))
    counts = members.groupBy("file_id", "class_node").agg(F.sum("m").alias("n_methods"), F.sum("f").alias("n_fields"))
    zero = F.lit(0).cast("long")
    return index.classes.join(counts, ["file_id", "class_node"], "left").select("repo_id", "fqn", "file_id", "extends", F.coalesce("n_methods", zero).alias("n_methods"), F.coalesce("n_fields", zero).alias("n_fields"))


@query()
def x09_resolved_edges(spark: SparkSession, d: str) -> DataFrame:
    """What Java methods set on their target and where it comes from, through locals, getters and helpers."""
    return setter_facts(*_java(spark, d))


@query()
def r07_helper_usage(spark: SparkSession, d: str) -> DataFrame:
    """Per kind of edge and of the outermost helper gone through: edges, resolved ones and the longest trail."""
    found = setter_facts(*_java(spark, d))
    last = F.when(F.size("trail") > 0, F.element_at("trail", -1)["kind"])
    return found.groupBy("kind", last.alias("helper")).agg(F.count(F.lit(1)).alias("n_edges"), F.count("source_path").alias("n_resolved"), F.max(F.size("trail")).cast("long").alias("longest"))


@query()
def s09_xsd_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Leaves of the XML schemas with their business keys."""
    scratch = Scratch(spark)
    return xsd_leaves(scratch.cut(xsd_elements(read_table(spark, d, "source_file"))), scratch)


@query()
def s10_java_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Fields that Java classes declare."""
    return java_leaves(read_table(spark, d, "source_file"))


# ---- documents


@query(f"""WITH {E}, k AS (SELECT repo_id, pair_id, kind, count(*) AS n FROM e GROUP BY 1, 2, 3) SELECT repo_id, pair_id, sum(n)::BIGINT AS n_rows, list(struct_pack(kind := kind, n := n) ORDER BY kind) AS by_kind FROM k GROUP BY 1, 2""")
def k13_manifests(spark: SparkSession, d: str) -> DataFrame:
    """The manifest of each pair: edges and edges per kind."""
    n = facts.edges(spark, d, *PAIR, "kind").groupBy(*PAIR, "kind").agg(*total())
    return n.groupBy(*PAIR).agg(F.sum("n").alias("n_rows"), F.array_sort(F.collect_list(F.struct("kind", "n"))).alias("by_kind"))  # at most one entry per kind


_DIGEST = """SELECT {keys} count(*) AS n_rows, sha256(concat_ws(',', count(*), {sums})) AS digest FROM (SELECT *, sha256(to_json(struct_pack({columns}))::VARCHAR) AS h FROM {table}) {group}"""


def _digest_sql(table: str, columns: str, keys: str = "") -> str:
    parts = ", ".join(f"sum(('0x' || h[{1 + 15 * i}:{15 + 15 * i}])::BIGINT::HUGEINT)" for i in range(4))
    return _DIGEST.format(table=table, keys=keys and keys + ",", sums=parts, group=keys and "GROUP BY " + keys, columns=", ".join(f"{c} := {c}" for c in sorted(columns.split())))


@query(f"WITH {E} " + _digest_sql("e", "id repo_id pair_id kind file line source_field_id target_field_id", "repo_id, pair_id"))
def k03_manifest_checksums(spark: SparkSession, d: str) -> DataFrame:
    """The checksum of each pair's edges, whatever their order."""
    return table_digest(facts.edges(spark, d, *PAIR, "kind", "file", "line", "source_field_id", "target_field_id"), *PAIR)


@query(f"""WITH {E}, {M} SELECT m.repo_id, 'mapper:' || m.id AS node_id, to_json(struct_pack("@id" := 'mapper:' || m.id, "@type" := 'Mapper', kind := kind))::VARCHAR AS node FROM m SEMI JOIN e ON e.mapper_id = m.id
  UNION ALL SELECT repo_id, 'edge:' || id, to_json(struct_pack("@id" := 'edge:' || id, "@type" := 'Edge', kind := kind, mapper := mapper_id, source := source_field_id, target := target_field_id))::VARCHAR FROM e""")
def k07_linked_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The nodes of the linked-data documents."""
    return linked_nodes(facts.mappers(spark, d), facts.edges(spark, d, "repo_id", "mapper_id", "kind", "source_field_id", "target_field_id"))


@query(f"""WITH {E}, {FI} SELECT e.mapper_id, e.line, e.id AS edge_id, '| ' || concat_ws(' | ', coalesce(t.path, e.target_field_id), coalesce(coalesce(s.path, CASE WHEN length({_FLAT}) > 60 THEN {_FLAT}[1:59] || '…' ELSE {_FLAT} END), ''), coalesce(e.kind, ''), coalesce('L' || e.line, '')) || ' |' AS markdown
  FROM e LEFT JOIN f s ON e.source_field_id = s.id LEFT JOIN f t ON e.target_field_id = t.id""")
def k04_markdown_mapper(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the mappers' pages."""
    e = facts.edges(spark, d, "mapper_id", "source_field_id", "target_field_id", "expression", "kind", "line")
    return markdown_lines(with_fields(e, facts.fields(spark, d, "schema_id", "path", "business_key")))


@query(f"WITH {E}, {FI} SELECT 'edge' AS table_name, * FROM ({_digest_sql('e', 'id kind source_field_id target_field_id line')}) UNION ALL SELECT 'field', * FROM ({_digest_sql('f', 'id schema_id path business_key')})")
def k01_snapshot_digests(spark: SparkSession, d: str) -> DataFrame:
    """The digests that name a snapshot's content."""
    tables = {"edge": facts.edges(spark, d, "kind", "source_field_id", "target_field_id", "line"), "field": facts.fields(spark, d, "schema_id", "path", "business_key")}
    out = [table_digest(df).select(F.lit(name).alias("table_name"), "*") for name, df in tables.items()]
    return out[0].unionByName(out[1])
