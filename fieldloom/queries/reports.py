"""Queries of lists, reports, baselines and pages over the lineage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import facts
from fieldloom.operators.coverage import PAIR, declared_paths, pair_coverage, pair_targets, unmatched, written_paths
from fieldloom.operators.impact import with_fields
from fieldloom.operators.reports import baseline_entries, browse_url, entry_point_lines, index_lines, pair_summary
from fieldloom.queries.lineage import _CUT, _FLAT, CO, DECLARED, EP, FI, E, M, total
from fieldloom.queries.lineage import a06_unmatched, q13_synthetic_unmapped
from fieldloom.sources import read_table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a function under its own name."""

    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


@query(f"WITH {EP}, {CO}, {FI} SELECT 'entry_points' AS list, count(*) AS n FROM ep WHERE country = 'DE' AND clearing IS NOT NULL UNION ALL SELECT 'coverage', count(*) FROM co UNION ALL SELECT 'fields', count(*) FROM f WHERE path ILIKE '%iban%'")
def a08_list_totals(spark: SparkSession, d: str) -> DataFrame:
    """How many rows the lists have of which pages are shown."""
    lists = {"entry_points": facts.entry_points(spark, d).filter("country = 'DE' AND clearing IS NOT NULL"), "coverage": facts.coverage(spark, d), "fields": facts.fields(spark, d, "path").filter(F.lower("path").contains("iban"))}
    counts = [df.agg(*total()).select(F.lit(name).alias("list"), "n") for name, df in lists.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(f"WITH {CO} SELECT repo_id, pair_id, files_scanned, coverage_percent FROM co WHERE repo_id = 'svc-gateway-core' AND coverage_percent IS NOT NULL")
def f02_coverage_filter(spark: SparkSession, d: str) -> DataFrame:
    """The reports of one repository."""
    return facts.coverage(spark, d).filter("repo_id = 'svc-gateway-core' AND coverage_percent IS NOT NULL").select(*PAIR, "files_scanned", "coverage_percent")


@query(f"WITH {FI}, k AS (SELECT min(id) AS id FROM f WHERE business_key IS NOT NULL), w AS (SELECT schema_id, path FROM f JOIN k USING (id)) SELECT f.id, f.schema_id, f.path, f.business_key, f.type FROM f JOIN w ON f.schema_id = w.schema_id AND f.path = w.path")
def f04_find_field(spark: SparkSession, d: str) -> DataFrame:
    """One field by schema and path: those of the first field with a key."""
    f = facts.fields(spark, d, "schema_id", "path", "business_key", "type")
    first = f.filter("business_key IS NOT NULL").agg(F.min_by(F.struct("schema_id", "path"), "id").alias("w"))  # one row
    wanted = first.select(F.col("w.schema_id").alias("_s"), F.col("w.path").alias("_p"))
    return f.join(F.broadcast(wanted), (F.col("schema_id") == F.col("_s")) & (F.col("path") == F.col("_p")), "left_semi")


@query(f"WITH {E} SELECT id, kind, entry_point_id, static_helper_fqn FROM e WHERE kind IN ('qualifier', 'static_call', 'intra_class')")
def f06_kind_in(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the kinds that go through helpers."""
    return facts.edges(spark, d, "kind", "entry_point_id", "static_helper_fqn").filter(F.col("kind").isin("qualifier", "static_call", "intra_class"))


@query(f"WITH {E}, w AS (SELECT target_field_id FROM e WHERE kind = 'constant') SELECT id, target_field_id, kind FROM e SEMI JOIN w USING (target_field_id) WHERE kind <> 'constant'")
def f07_edges_in_list(spark: SparkSession, d: str) -> DataFrame:
    """Edges to fields of a list, those that constants are written to, too."""
    e = facts.edges(spark, d, "target_field_id", "kind")
    listed = e.filter("kind = 'constant'").select(F.col("target_field_id").alias("t")).distinct()
    return e.filter("kind <> 'constant'").join(listed, F.col("target_field_id") == F.col("t"), "left_semi")


@query(f"WITH {EP} SELECT coalesce(scope.common, FALSE) AS common, count(*) AS n, count(country) AS with_country FROM ep GROUP BY 1")
def f10_common_scope(spark: SparkSession, d: str) -> DataFrame:
    """Entry points of the common scope, unknown as not."""
    return facts.entry_points(spark, d).groupBy(F.coalesce("scope.common", F.lit(False)).alias("common")).agg(*total(), F.count("country").alias("with_country"))


@query(f"WITH {EP}, {CO} SELECT * FROM (SELECT 'top' AS side, id AS name, edge_count::DOUBLE AS value FROM ep ORDER BY edge_count DESC NULLS LAST, id LIMIT 8) UNION ALL SELECT * FROM (SELECT 'bottom', repo_id || ':' || pair_id, coverage_percent FROM co WHERE coverage_percent IS NOT NULL ORDER BY coverage_percent, repo_id, pair_id LIMIT 6)")
def o04_top_and_bottom(spark: SparkSession, d: str) -> DataFrame:
    """The eight entry points with the most edges and the six pairs with the least coverage."""
    top = facts.entry_points(spark, d).orderBy(F.desc_nulls_last("edge_count"), "id").limit(8).select(F.lit("top").alias("side"), F.col("id").alias("name"), F.col("edge_count").cast("double").alias("value"))
    low = facts.coverage(spark, d).filter("coverage_percent IS NOT NULL").orderBy("coverage_percent", *PAIR).limit(6)
    return top.unionByName(low.select(F.lit("bottom").alias("side"), F.concat_ws(":", *PAIR).alias("name"), F.col("coverage_percent").alias("value")))


@query(f"WITH {E} SELECT repo_id, pair_id, file, line, target_field_id, source_field_id, id FROM e")
def o05_manifest_order(spark: SparkSession, d: str) -> DataFrame:
    """The edges in the order of the manifests: by pair, then file, line, target, source and id."""
    e = facts.edges(spark, d, *PAIR, "file", "line", "target_field_id", "source_field_id").select(*PAIR, "file", "line", "target_field_id", "source_field_id", "id")
    return e.orderBy(*e.columns)


@query("SELECT file_id, file FROM source_file")
def o06_file_order(spark: SparkSession, d: str) -> DataFrame:
    """The files in the order of their paths in lower case."""
    return read_table(spark, d, "source_file").select("file_id", "file").orderBy(F.lower("file"), "file", "file_id")


_WRITTEN = f"""{FI}, wn AS (SELECT DISTINCT e.pair_id, f.path FROM edges e JOIN f ON e.target_field_id = f.id), wo AS (SELECT DISTINCT e.pair_id, f.path FROM edges e JOIN f ON e.target_field_id = f.id WHERE e.ingested_at < TIMESTAMP '{_CUT}')"""


@query(f"WITH {_WRITTEN} SELECT 'added' AS change, * FROM (SELECT * FROM wn EXCEPT SELECT * FROM wo) UNION ALL SELECT 'removed', * FROM (SELECT * FROM wo EXCEPT SELECT * FROM wn)")
def u05_gate_diff(spark: SparkSession, d: str) -> DataFrame:
    """Pairs and paths that are written now and weren't before a day, and the other way round."""
    every, f = read_table(spark, d, "edges"), facts.fields(spark, d, "path")
    now, before = [written_paths(e, f).select("pair_id", "path").distinct() for e in (every, every.filter(F.col("ingested_at") < F.expr(f"TIMESTAMP_NTZ'{_CUT} 00:00:00'")))]
    return now.subtract(before).select(F.lit("added").alias("change"), "*").unionByName(before.subtract(now).select(F.lit("removed").alias("change"), "*"))


@query(f"""WITH {E}, {FI}, {EP}, {DECLARED}, u AS (SELECT dec.repo_id, dec.pair_id, dec.path FROM dec ANTI JOIN wr ON dec.repo_id = wr.repo_id AND dec.pair_id = wr.pair_id AND dec.path = wr.path)
  SELECT repo_id, pair_id, kind, count(*) AS n FROM (SELECT repo_id, pair_id, kind FROM e UNION ALL SELECT repo_id, pair_id, 'unmapped' FROM u) GROUP BY 1, 2, 3""")
def u06_with_unmapped(spark: SparkSession, d: str) -> DataFrame:
    """Edges per pair and kind, those made for unmatched paths among them."""
    real = facts.edges(spark, d, *PAIR, "kind").select(*PAIR, "kind")
    return real.unionByName(q13_synthetic_unmapped(spark, d).select(*PAIR, "kind")).groupBy(*PAIR, "kind").agg(*total())


@query(f"""WITH {E}, {FI}, {EP}, x AS (SELECT t.repo_id, t.pair_id, f.path, bool_or(f.business_key IS NULL) AS ignored FROM (SELECT DISTINCT repo_id, pair_id, target_schema_id FROM ep) t JOIN f ON f.schema_id = t.target_schema_id GROUP BY 1, 2, 3),
  wr AS (SELECT DISTINCT e.repo_id, e.pair_id, f.path FROM e JOIN f ON e.target_field_id = f.id), c AS (SELECT x.repo_id, x.pair_id, count(*) AS n_declared, count(*) FILTER (ignored) AS n_ignored, count(*) FILTER (NOT ignored AND wr.path IS NOT NULL) AS n_written,
  count(*) FILTER (NOT ignored AND wr.path IS NULL) AS n_unmatched FROM x LEFT JOIN wr ON x.repo_id = wr.repo_id AND x.pair_id = wr.pair_id AND x.path = wr.path GROUP BY 1, 2)
  SELECT *, CASE WHEN n_written + n_unmatched > 0 THEN round_even(100.0::DOUBLE * n_written / (n_written + n_unmatched), 2) ELSE 100.0::DOUBLE END AS coverage_percent FROM c""")
def a05_pair_summary(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of a pair's paths that have a business key; those without are left aside as ignored."""
    f = facts.fields(spark, d, "schema_id", "path", "business_key")
    targets = pair_targets(facts.entry_points(spark, d))
    declared = targets.join(f.select(F.col("schema_id").alias("_s"), "path", F.col("business_key").isNull().alias("ignored")), F.col("schema_id") == F.col("_s")).select(*PAIR, "path", "ignored")
    return pair_summary(declared, written_paths(facts.edges(spark, d, *PAIR, "target_field_id"), f))


_STATE = f"""{E}, {FI}, {EP}, {DECLARED}, st AS (SELECT dec.repo_id, dec.pair_id, count(*) AS n, round_even(100.0::DOUBLE * count(wr.path) / count(*), 2) AS c,
  coalesce(list(dec.path ORDER BY dec.path) FILTER (wr.path IS NULL), []) AS u FROM dec LEFT JOIN wr ON dec.repo_id = wr.repo_id AND dec.pair_id = wr.pair_id AND dec.path = wr.path GROUP BY 1, 2)"""


@query(f"WITH {_STATE} SELECT repo_id || ':' || pair_id AS pair, to_json(struct_pack(coverage_percent := c, target_field_count := n, unmatched := u))::VARCHAR AS entry FROM st")
def k11_baseline(spark: SparkSession, d: str) -> DataFrame:
    """What a baseline keeps of each pair."""
    f = facts.fields(spark, d, "schema_id", "path")
    declared, written = declared_paths(pair_targets(facts.entry_points(spark, d)), f), written_paths(facts.edges(spark, d, *PAIR, "target_field_id"), f)
    lists = unmatched(declared, written).groupBy(*PAIR).agg(F.collect_set("path").alias("unmatched"))  # paths of one pair's schemas
    state = pair_coverage(declared, written).join(lists, PAIR, "left")
    return baseline_entries(state.select(*PAIR, F.col("n_declared").alias("target_field_count"), "coverage_percent", "unmatched"))


@query(f"WITH {_STATE} SELECT repo_id, count(*) AS n_pairs, sum(n) AS n_declared, sum(len(u)) AS n_unmatched, min(c) AS least_coverage, count(*) FILTER (len(u) > 0) AS n_with_gaps FROM st GROUP BY 1")
def q18_coverage_health(spark: SparkSession, d: str) -> DataFrame:
    """Per repository: pairs, declared and unmatched paths, the least coverage and the pairs with gaps."""
    f = facts.fields(spark, d, "schema_id", "path")
    state = pair_coverage(declared_paths(pair_targets(facts.entry_points(spark, d)), f), written_paths(facts.edges(spark, d, *PAIR, "target_field_id"), f))
    gaps = F.col("n_declared") - F.col("n_written")
    return state.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum("n_declared").alias("n_declared"), F.sum(gaps).alias("n_unmatched"), F.min("coverage_percent").alias("least_coverage"), F.count_if(gaps > 0).alias("n_with_gaps"))


@query(f"WITH {E}, {FI}, {EP}, {DECLARED}, u AS (SELECT DISTINCT dec.pair_id, dec.path FROM dec ANTI JOIN wr ON dec.repo_id = wr.repo_id AND dec.pair_id = wr.pair_id AND dec.path = wr.path) SELECT DISTINCT u.pair_id, u.path, f.business_key FROM u JOIN f ON u.path = f.path WHERE f.business_key IS NOT NULL")
def q18_gaps_by_key(spark: SparkSession, d: str) -> DataFrame:
    """Unmatched paths with the business keys that fields of this path have."""
    u = a06_unmatched(spark, d).select("pair_id", "path").distinct()
    keyed = facts.fields(spark, d, "path", "business_key").filter("business_key IS NOT NULL").select(F.col("path").alias("_p"), "business_key").distinct()
    return u.join(keyed, F.col("path") == F.col("_p")).select("pair_id", "path", "business_key").distinct()


@query(f"WITH {E}, {M}, k AS (SELECT DISTINCT target_bk AS business_key, mapper_id FROM e WHERE target_bk IS NOT NULL) SELECT k.business_key, m.id AS mapper_id, m.kind FROM k JOIN m ON k.mapper_id = m.id")
def q18_mappers_by_key(spark: SparkSession, d: str) -> DataFrame:
    """The mappers that write a business key."""
    k = facts.edges(spark, d, "target_bk", "mapper_id").filter("target_bk IS NOT NULL").select(F.col("target_bk").alias("business_key"), F.col("mapper_id").alias("m")).distinct()
    return k.join(facts.mappers(spark, d).select("id", "kind"), F.col("m") == F.col("id")).select("business_key", F.col("id").alias("mapper_id"), "kind")


@query(f"WITH {E}, {FI} SELECT e.id, t.id IS NOT NULL AS target_known, CASE WHEN e.source_field_id IS NOT NULL THEN s.id IS NOT NULL END AS source_known FROM e LEFT JOIN f s ON e.source_field_id = s.id LEFT JOIN f t ON e.target_field_id = t.id")
def q18_verify_edges(spark: SparkSession, d: str) -> DataFrame:
    """Whether the fields of each edge are known; null for a source that isn't named."""
    f = facts.fields(spark, d, "schema_id").withColumns({"path": F.lit(None).cast("string"), "business_key": F.lit(None).cast("string"), "schema_id": F.lit("known")})
    e = with_fields(facts.edges(spark, d, "source_field_id", "target_field_id"), f)
    return e.select("id", F.col("target_schema").isNotNull().alias("target_known"), F.when(F.col("source_field_id").isNotNull(), F.col("source_schema").isNotNull()).alias("source_known"))


@query(f"""WITH {EP} SELECT coalesce(country, 'COMMON') AS country, coalesce(clearing, 'COMMON') AS clearing, coalesce(product, 'COMMON') AS product, class_fqn, method_name, id,
  '- ' || string_split(class_fqn, '.')[-1] || '.' || method_name || ' (' || coalesce(edge_count::VARCHAR, '?') || ' edges)' AS markdown FROM ep""")
def k06_index_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the index of entry points by scope."""
    return index_lines(facts.entry_points(spark, d))


@query(f"""WITH {E}, {FI} SELECT e.entry_point_id, 1 AS part, e.line, e.id AS key, '| ' || concat_ws(' | ', coalesce(t.path, e.target_field_id), coalesce(coalesce(s.path, CASE WHEN length({_FLAT}) > 60 THEN {_FLAT}[1:59] || '…' ELSE {_FLAT} END), ''), coalesce(e.kind, '')) || ' |' AS markdown
  FROM e LEFT JOIN f s ON e.source_field_id = s.id LEFT JOIN f t ON e.target_field_id = t.id WHERE e.entry_point_id IS NOT NULL
  UNION ALL SELECT entry_point_id, 2, min(line), static_helper_fqn, '- `' || static_helper_fqn || '` used by ' || count(*) FROM e WHERE entry_point_id IS NOT NULL AND static_helper_fqn IS NOT NULL GROUP BY entry_point_id, static_helper_fqn""")
def k05_entry_point_lines(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the entry points' pages: edges, then helpers."""
    e = facts.edges(spark, d, "entry_point_id", "source_field_id", "target_field_id", "expression", "kind", "line", "static_helper_fqn")
    return entry_point_lines(with_fields(e, facts.fields(spark, d, "schema_id", "path", "business_key")))


@query(f"""WITH {E}, {FI}, {M} SELECT 'field:' || id AS node_id, 'Field' AS type FROM f UNION SELECT 'mapper:' || id, 'Mapper' FROM m UNION SELECT 'edge:' || id, 'Edge' FROM e""")
def k08_global_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The nodes of the global linked-data document, each once; a service's document refers to the fields instead of repeating them all."""
    node = lambda df, name: df.select(F.concat(F.lit(name.lower() + ":"), "id").alias("node_id"), F.lit(name).alias("type"))
    parts = node(facts.fields(spark, d), "Field").unionByName(node(facts.mappers(spark, d), "Mapper")).unionByName(node(facts.edges(spark, d), "Edge"))
    return parts.dropDuplicates(["node_id", "type"])


@query("SELECT ingest_seq, replace(replace(replace(replace('https://git.invalid/{repo}/blob/{sha}/{file}#L{line}', '{repo}', repo_id), '{sha}', sha), '{file}', file), '{line}', line::VARCHAR) AS url, strftime(extracted_at, '%Y-%m-%dT%H:%M:%SZ') AS extracted FROM edges")
def id_browse_urls(spark: SparkSession, d: str) -> DataFrame:
    """The address of each edge's line by a template, and when it was extracted, as text."""
    url = browse_url("https://git.invalid/{repo}/blob/{sha}/{file}#L{line}", *[F.col(c) for c in ("repo_id", "sha", "file", "line")])
    return read_table(spark, d, "edges").select("ingest_seq", url.alias("url"), F.date_format("extracted_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("extracted"))
