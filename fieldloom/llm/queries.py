"""The problems of texts and groups over the lineage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.components import group_keys, normal_key
from fieldloom.llm.leak import find_leaks, leak_report
from fieldloom.llm.mix import mix
from fieldloom.llm.quality import faults, text_class, text_statistics
from fieldloom.llm.syntax import check_syntax, syntax_rates
from fieldloom.plans.scratch import Scratch
from fieldloom.sources import read_table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The group of every business key."""
    edges = read_table(spark, d, "edges").select(normal_key(F.col("source_bk")).alias("a"), normal_key(F.col("target_bk")).alias("b"))
    fields = read_table(spark, d, "field").select(normal_key(F.col("business_key")).alias("k"))
    records = edges.select(F.explode(F.array("a", "b")).alias("k")).unionByName(fields)
    return group_keys(records, edges)


def p2_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many groups there are of each size."""
    sizes = p2_found(spark, d).groupBy("group_key").agg(F.count(F.lit(1)).alias("n_keys"))
    return sizes.groupBy("n_keys").agg(F.count(F.lit(1)).alias("n_groups"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Source files that are not valid in their language."""
    return check_syntax(read_table(spark, d, "source_file")).filter("reason IS NOT NULL").select("file_id")


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of such files per repository and language, against the extraction's report."""
    files = read_table(spark, d, "source_file")
    checked = Scratch(spark).cut(check_syntax(files))
    return syntax_rates(files, checked, read_table(spark, d, "coverage"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_item"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that share at least 12 consecutive words with an evaluation item, with the item; shorter items aren't asked for here."""
    return _leaks(spark, d).filter("run = 12").select("doc_id", "item_id")


def p6_containment(spark: SparkSession, d: str) -> DataFrame:
    """How much of the item each of these documents holds."""
    return _leaks(spark, d).filter("run = 12").select("doc_id", "item_id", "containment")


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """Every evaluation item with the number of documents it leaked into."""
    return leak_report(_leaks(spark, d), read_table(spark, d, "eval_item"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mix, a row per copy."""
    return mix(read_table(spark, d, "documents"), read_table(spark, d, "mix_target"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares of the tokens that the sources reach."""
    return mix(read_table(spark, d, "documents"), read_table(spark, d, "mix_target"))[1]


def _statistics(spark: SparkSession, d: str) -> DataFrame:
    return text_statistics(read_table(spark, d, "documents"), read_table(spark, d, "common_word"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are not natural prose."""
    return _statistics(spark, d).filter(faults() >= 2).select("doc_id")


def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of every document."""
    return _statistics(spark, d)


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    """Documents per class of text."""
    return _statistics(spark, d).groupBy(text_class().alias("text_class")).agg(F.count(F.lit(1)).alias("n_documents"))


QUERIES = {q.__name__: q for q in (p2_found, p2_group_sizes, p3_found, p3_rates, p6_found, p6_containment, p6_items, p7_mix, p7_shares, p8_found, p8_statistics, p8_classes)}

_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')"
_GRAMS = """SELECT DISTINCT {id}, array_to_string(w[i:i + 11], ' ') AS gram FROM (SELECT {id}, w, unnest(generate_series(1, len(w) - 11)) AS i FROM (SELECT {id}, {words} AS w FROM {table}))"""
_LEAKS = f"""d AS ({_GRAMS.format(id="doc_id", words=_WORDS, table="documents")}), t AS ({_GRAMS.format(id="item_id", words=_WORDS, table="eval_item")}),
  leaks AS (SELECT doc_id, item_id, count(*) / any_value(n) AS containment FROM d JOIN (SELECT *, count(*) OVER (PARTITION BY item_id) AS n FROM t) USING (gram) GROUP BY 1, 2)"""
_PARTS = r"""x AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
  y AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\r\n]+'), lambda w: w <> '') AS words, length(regexp_replace(text, '[ \t\r\n]+', '', 'g')) AS dense,
    length(regexp_replace(text, '[\p{L}\p{Nd} \t\r\n]', '', 'g')) AS symbols,
    list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(13) || chr(10))), lambda l: l <> '') AS lines FROM x),
  z AS (SELECT doc_id, len(words) AS n_words, CASE WHEN len(words) > 0 THEN dense / len(words) END AS mean_word_length, CASE WHEN dense > 0 THEN symbols / dense END AS symbol_ratio,
    CASE WHEN len(lines) > 0 THEN len(list_filter(lines, lambda l: l[-1] IN ('.', '!', '?'))) / len(lines) END AS line_end_share,
    CASE WHEN len(words) > 0 THEN len(list_filter(words, lambda w: list_contains(common, lower(regexp_replace(w, '[^\p{L}]', '', 'g'))))) / len(words) END AS common_word_share
  FROM y, (SELECT list(DISTINCT word) AS common FROM common_word))"""

_STATISTICS = _PARTS + r""",
  p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n[ \t\r]*\n'), lambda l: trim(l, ' ' || chr(9) || chr(13) || chr(10))), lambda l: l <> '') AS paragraphs FROM x),
  b AS (SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS gram, list_transform(words[i:i + n - 1], lambda w: length(w)) AS lens FROM (SELECT doc_id, words, n, unnest(generate_series(1, len(words) - n + 1)) AS i FROM y, (VALUES (2), (3), (4)) v(n))),
  fr AS (SELECT doc_id, n, gram, list_sum(lens[n + 1 - least(n, i - coalesce(lag(i) OVER (PARTITION BY doc_id, n, gram ORDER BY i), -9)):n]) AS fresh FROM b),
  bb AS (SELECT doc_id, max(covered) FILTER (n = 2) AS b2, max(covered) FILTER (n = 3) AS b3, max(covered) FILTER (n = 4) AS b4 FROM (SELECT doc_id, n, gram, sum(fresh) AS covered FROM fr GROUP BY 1, 2, 3 HAVING count(*) > 1) GROUP BY 1),
  s AS (SELECT z.*, CASE WHEN len(lines) > 0 THEN (len(lines) - len(list_distinct(lines))) / len(lines) END AS duplicate_line_share,
    CASE WHEN len(paragraphs) > 0 THEN (len(paragraphs) - len(list_distinct(paragraphs))) / len(paragraphs) END AS duplicate_paragraph_share,
    CASE WHEN len(words) >= 2 THEN (coalesce(b2, 0) / length(array_to_string(words, '')))::DOUBLE END AS top_bigram_share,
    CASE WHEN len(words) >= 2 THEN (coalesce(b3, 0) / length(array_to_string(words, '')))::DOUBLE END AS top_trigram_share,
    CASE WHEN len(words) >= 2 THEN (coalesce(b4, 0) / length(array_to_string(words, '')))::DOUBLE END AS top_fourgram_share,
    CASE WHEN len(lines) > 0 THEN len(list_filter(lines, lambda l: regexp_matches(l, '^([-*+•|]|\(?[0-9]{1,3}[.)])'))) / len(lines) END AS list_line_share
  FROM z JOIN y USING (doc_id) JOIN p USING (doc_id) LEFT JOIN bb USING (doc_id))"""
_FAULTS = """(CASE WHEN n_words = 0 THEN 5 ELSE (n_words < 30)::INT + (mean_word_length < 3 OR mean_word_length > 9)::INT + (symbol_ratio > 0.1::DOUBLE)::INT
  + (line_end_share < 0.4::DOUBLE)::INT + (common_word_share < 0.2::DOUBLE)::INT END)"""

_GROUPS = """WITH RECURSIVE k AS (SELECT lower(trim(source_bk, ' ' || chr(9) || chr(13) || chr(10))) AS a, lower(trim(target_bk, ' ' || chr(9) || chr(13) || chr(10))) AS b FROM edges),
  l AS (SELECT a, b FROM k WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM k WHERE a IS NOT NULL AND b IS NOT NULL),
  r AS (SELECT a AS x FROM k WHERE a IS NOT NULL UNION SELECT b FROM k WHERE b IS NOT NULL UNION SELECT lower(trim(business_key, ' ' || chr(9) || chr(13) || chr(10))) FROM field WHERE business_key IS NOT NULL),
  t(x, y) AS (SELECT x, x FROM r UNION SELECT t.x, l.b FROM t JOIN l ON t.y = l.a), g AS (SELECT min(y) AS group_key, x AS business_key FROM t GROUP BY x)"""

SQL = {
    "p2_found": f"{_GROUPS} SELECT group_key, business_key FROM g",
    "p2_group_sizes": f"{_GROUPS} SELECT n_keys, count(*) AS n_groups FROM (SELECT group_key, count(*) AS n_keys FROM g GROUP BY 1) GROUP BY 1",
    "p6_found": f"WITH {_LEAKS} SELECT doc_id, item_id FROM leaks",
    "p6_containment": f"WITH {_LEAKS} SELECT doc_id, item_id, containment FROM leaks",
    "p6_items": f"WITH {_LEAKS} SELECT e.item_id, e.suite, e.split, count(l.doc_id) AS n_documents, coalesce(max(l.containment), 0) AS largest_containment FROM eval_item e LEFT JOIN leaks l USING (item_id) GROUP BY 1, 2, 3",
    "p8_found": f"WITH {_PARTS} SELECT doc_id FROM z WHERE {_FAULTS} >= 2",
    "p8_statistics": f"WITH {_STATISTICS} SELECT * FROM s",
    "p8_classes": f"""WITH {_STATISTICS}, c AS (SELECT CASE WHEN n_words = 0 THEN 'junk' WHEN coalesce(list_line_share, 0) >= 0.5 OR {_FAULTS} >= 2 AND coalesce(list_line_share, 0) >= 1.0::DOUBLE / 3 THEN 'list'
    WHEN coalesce(duplicate_line_share > 0.3::DOUBLE, FALSE) OR coalesce(duplicate_paragraph_share > 0.3::DOUBLE, FALSE) OR coalesce(top_bigram_share > 0.2::DOUBLE, FALSE) OR coalesce(greatest(top_trigram_share, top_fourgram_share) > 0.3::DOUBLE, FALSE) THEN 'boilerplate'
    WHEN {_FAULTS} >= 2 THEN 'noise' ELSE 'prose' END AS text_class FROM s) SELECT text_class, count(*) AS n_documents FROM c GROUP BY 1""",
}
