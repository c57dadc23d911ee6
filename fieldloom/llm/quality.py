"""Statistics of a text that tell natural prose from lists, tables, boilerplate and junk; all of them JVM expressions over one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.arrays import let
from fieldloom.plans.spread import spread

BLANK = "[ \\t\\r\\n]+"
#: Up to so many common words become a set in the plan; more are joined.
SET_WORDS = 20_000
#: Lengths of the runs of words of which the one that covers most is sought.
NGRAMS = {2: "top_bigram_share", 3: "top_trigram_share", 4: "top_fourgram_share"}


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def _filled(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda x: F.btrim(x, F.lit(" \t\r\n"))), lambda x: x != "")


def _top_ngram_shares(words: Column) -> Column:
    """For each length in NGRAMS, the characters of the run of so many words that covers most of a text, by all characters of its words; null with fewer than two words.

    Characters that overlapping occurrences share count once; a run that occurs once covers nothing. Runs are told apart by hashes of their words' hashes.
    """
    pick = lambda array, i, k: F.element_at(array, i + k)

    def best(numbers: Column, lengths: Column, n: int) -> Column:
        starts = F.when(F.size(numbers) > n, F.sequence(F.lit(1), F.size(numbers) - (n - 1))).otherwise(F.array().cast("array<int>"))
        runs = F.transform(starts, lambda i: F.struct(F.xxhash64(*[pick(numbers, i, k) for k in range(n)]).alias("run"), i.alias("at")))
        none = F.struct(F.lit(0).cast("long").alias("run"), F.lit(0).alias("at"), F.lit(0).alias("covered"), F.lit(0).alias("best"))

        def step(acc: Column, x: Column) -> Column:
            again = (acc["run"] == x["run"]) & (acc["at"] > 0)
            # the words that the occurrence before doesn't cover: the last of them
            fresh = sum((F.when(x["at"] - acc["at"] >= n - k, pick(lengths, x["at"], k)).otherwise(0) for k in range(n)), F.lit(0))
            whole = sum((pick(lengths, x["at"], k) for k in range(1, n)), pick(lengths, x["at"], 0))
            covered = F.when(again, acc["covered"] + fresh).otherwise(whole)
            return F.struct(x["run"].alias("run"), x["at"].alias("at"), covered.alias("covered"), F.when(again, F.greatest(acc["best"], covered)).otherwise(acc["best"]).alias("best"))

        return F.aggregate(F.sort_array(runs), none, step, lambda acc: acc["best"])

    numbers, lengths = F.transform(words, lambda w: F.xxhash64(w)), F.transform(words, lambda w: F.length(w))
    whole = F.length(F.array_join(words, ""))
    shares = let(F.struct(numbers.alias("n"), lengths.alias("l"), whole.alias("w")), lambda x: F.struct(*[(best(x["n"], x["l"], n) / x["w"]).alias(name) for n, name in NGRAMS.items()]))
    return F.when(F.size(words) >= 2, shares)


def _line_shares(lines: Column) -> Column:
    """Of lines or paragraphs, the share of those that stood before."""
    return _share((F.size(lines) - F.size(F.array_distinct(lines))).cast("double"), F.size(lines))


def text_statistics(documents: DataFrame, common: DataFrame, doc_id: str = "doc_id", text: str = "text", word: str = "word") -> DataFrame:
    """One row per document: ``doc_id, n_words, mean_word_length, symbol_ratio, line_end_share, common_word_share, duplicate_line_share,
    duplicate_paragraph_share, list_line_share, top_bigram_share, top_trigram_share, top_fourgram_share``.

    Blanks are space, tab, CR and LF, words what lies between them; lines are split at LF, paragraphs at empty lines. Shares and means of nothing
    are null: all but n_words for a text that is null, empty or blank. common: lower-case words; nulls among them are left out.
    """
    spark = documents.sparkSession
    vocabulary = common.select(F.col(f"`{word}`").alias("w")).filter("w IS NOT NULL").distinct()
    known = [r["w"] for r in vocabulary.limit(SET_WORDS + 1).collect()]
    joined = len(known) > SET_WORDS
    known = [] if joined else known
    docs = spread(documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")), "doc_id")
    filled = lambda t: F.filter(F.split(t, BLANK), lambda w: w != "")
    # a word without letters can't be a common one, so letters are sought in the whole text at once
    letters = filled(F.lower(F.regexp_replace("text", "[^\\p{L} \\t\\r\\n]+", "")))
    arrays = docs.select(
        "doc_id",
        F.length(F.regexp_replace("text", BLANK, "")).alias("dense"),
        F.length(F.regexp_replace("text", "[\\p{L}\\p{Nd} \\t\\r\\n]+", "")).alias("symbols"),
        filled(F.col("text")).alias("words"),
        (F.size(F.filter(letters, lambda w: w.isin(known))) if known else F.lit(0)).alias("hits"),
        _filled(F.split("text", "\n")).alias("lines"),
        _filled(F.split("text", "\n[ \\t\\r]*\n")).alias("paragraphs"),
    )
    n_words, lines = F.size("words"), F.col("lines")
    ended = F.size(F.filter(lines, lambda x: F.right(x, F.lit(1)).isin(".", "!", "?")))
    listed = F.size(F.filter(lines, lambda x: x.rlike("^([-*+\\u2022|]|\\(?[0-9]{1,3}[.)])")))
    stats = arrays.select(
        "doc_id",
        n_words.cast("long").alias("n_words"),
        _share(F.col("dense").cast("double"), n_words).alias("mean_word_length"),
        _share(F.col("symbols").cast("double"), F.col("dense")).alias("symbol_ratio"),
        _share(ended.cast("double"), F.size(lines)).alias("line_end_share"),
        _share(F.col("hits").cast("double"), n_words).alias("common_word_share"),
        _line_shares(lines).alias("duplicate_line_share"),
        _line_shares(F.col("paragraphs")).alias("duplicate_paragraph_share"),
        _top_ngram_shares(F.col("words")).alias("top"),
        _share(listed.cast("double"), F.size(lines)).alias("list_line_share"),
    )
    # a generator, as a filter on the statistics would else be computed from the text, once for each place in its condition
    own = [F.col(c) for c in stats.columns if c not in ("doc_id", "top")] + [F.col(f"top.{c}").alias(c) for c in NGRAMS.values()]
    stats = stats.select("doc_id", F.inline(F.array(F.struct(*own))))
    if not joined:
        return stats
    # too many words for a set: count each document's common words by a join
    rows = docs.select("doc_id", F.explode(letters).alias("x")).groupBy("doc_id", "x").count()
    counts = rows.join(vocabulary, F.col("x") == F.col("w")).groupBy(F.col("doc_id").alias("d")).agg(F.sum("count").alias("n"))
    share = _share(F.coalesce("n", F.lit(0)).cast("double"), F.col("n_words")).alias("common_word_share")
    return stats.join(counts, F.col("doc_id") == F.col("d"), "left").select(*[share if c == "common_word_share" else c for c in stats.columns])


def faults() -> Column:
    """How many of the five rules against natural prose a document breaks; 5 if it has no word."""
    rules = ["n_words < 30", "mean_word_length < 3 OR mean_word_length > 9", "symbol_ratio > 0.10D", "line_end_share < 0.4D", "common_word_share < 0.2D"]
    count = sum((F.when(F.expr(r), 1).otherwise(0) for r in rules), F.lit(0))
    return F.when(F.col("n_words") == 0, F.lit(5)).otherwise(count)


def text_class() -> Column:
    """junk (no word), list, boilerplate, noise or prose, by combined rules; the first that holds.

    list: half of the lines are list items, or two faults with a third of them; boilerplate: three in ten lines or paragraphs repeat, one pair of
    words covers a fifth or a run of three or four words three tenths of the text; noise: two faults or more.
    """
    bad = faults() >= 2
    repeats = (F.col("duplicate_line_share") > 0.3) | (F.col("duplicate_paragraph_share") > 0.3) | (F.col("top_bigram_share") > 0.2) | (F.greatest("top_trigram_share", "top_fourgram_share") > 0.3)
    listed = F.coalesce("list_line_share", F.lit(0.0))
    return F.when(F.col("n_words") == 0, "junk").when((listed >= 0.5) | (bad & (listed >= 1 / 3)), "list").when(F.coalesce(repeats, F.lit(False)), "boilerplate").when(bad, "noise").otherwise("prose")
