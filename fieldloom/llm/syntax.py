"""Source files that do not parse: flagged per file, with the cheapest repair and what it tells of the cause."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import lexers
from fieldloom.llm.chart import Repair, parse
from fieldloom.llm.grammar import grammar
from fieldloom.plans.spread import spread

_ARROW = pa.schema([("file_id", pa.int64()), ("language", pa.string()), ("n_tokens", pa.int32()), ("edit_cost", pa.int32()), ("exact", pa.bool_()), ("error_line", pa.int32()), ("reason", pa.string())])
RESULT = "file_id long, language string, n_tokens int, edit_cost int, exact boolean, error_line int, reason string"
#: Of a text in another language, the shares of tokens and of lines that are edited.
MISMATCH_TOKENS, MISMATCH_LINES = 1 / 6, 1 / 3


def language_of(file: str | None) -> str | None:
    """java, json or xsd by what follows the last dot; None for all else."""
    ending = file.rpartition(".")[2].lower() if file else None
    return ending if ending in ("java", "json", "xsd") else None


def _tokens(language: str, text: str) -> list[tuple[str, int]]:
    return {"java": lexers.java, "json": lexers.json, "xsd": lexers.xml}[language](text)


def _last_cut(language: str, text: str, tokens: list[tuple[str, int]]) -> bool:
    return bool(tokens) and tokens[-1][0] == "ERROR" and lexers.cut_off(language, text[tokens[-1][1] :])


def _parsed(language: str, text: str, tokens: list[tuple[str, int]], budget: int | None) -> Repair:
    kinds, last_cut = [kind for kind, _ in tokens], _last_cut(language, text, tokens)
    if language != "xsd":
        return parse(grammar(language), kinds, None, last_cut, budget)
    names = [kind[1:] if kind[0] in "</" else None for kind in kinds]
    return parse(grammar(language), [{"<": "OPEN", "/": "CLOSE"}[k[0]] if k[0] in "</" else k for k in kinds], names, last_cut, budget)


def _reason(text: str, tokens: list[tuple[str, int]], repair: Repair, last_cut: bool) -> str:
    """The cause that the places of the edits tell."""
    n, cost = len(tokens), repair.cost
    if any(kind == "MARKER" for kind, _ in tokens):
        return "conflict"  # no repair leaves one of them as it is
    places = [p for way, i, token in repair.edits for p in (range(i, n) if way == "delete" and not token else [i])]
    if repair.reached >= max(1, n - last_cut) and (repair.at_end or min(places) >= max(1, n - cost)):
        return "truncation"
    ends = [i for i, c in enumerate(text) if c == "\n"]
    line = lambda i: bisect_left(ends, tokens[i][1]) if i < n else -1
    lines, edited = {line(i) for i in range(n)}, {line(i) for i in places}
    all_over = max(places) - min(places) >= n / 2 and (len(lines) < 4 or len(edited) >= len(lines) * MISMATCH_LINES)
    if repair.least >= n or repair.least > max(2, n * MISMATCH_TOKENS) and all_over:
        return "mismatch"
    return "truncation" if repair.exact and 1 < cost < n / 3 and max(places) <= cost else "error"


def examine(language: str, text: str, budget: int | None = None) -> tuple[int, int, bool, int | None, str | None]:
    """Tokens, edit cost, whether it is exact, line of the first error and reason of a text.

    The reason follows from where a cheapest repair edits: ``conflict`` (at markers of a merge conflict, be it a lone one that is left), ``truncation`` (only at
    the end, of a text that could go on, or only at the begin), ``mismatch`` (all over the text, as in another language: over half of it, on a third of its lines, if it has
    four, and more than one for every six tokens, three at least; or as many as there are tokens), ``error`` (anything else). Where the cost isn't exact, what it is at least counts.
    """
    tokens = _tokens(language, text)
    repair = _parsed(language, text, tokens, budget)
    if repair.cost and language == "java" and any(kind == "MARKER" for kind, _ in tokens) and lexers.only_closing(text):
        closing = lexers.java(text, markers=False)  # seven > at the begin of a line may close as many type arguments
        if not _parsed(language, text, closing, 0).cost:
            return len(closing), 0, True, None, None
    n = len(tokens)
    if not repair.cost:
        return n, 0, True, None, None
    first = repair.reached if repair.at_end else min([repair.reached, *[at for _, at, _ in repair.edits]])
    offset = tokens[first][1] if first < n else len(text.rstrip())
    return n, repair.cost, repair.exact, text.count("\n", 0, offset) + 1, _reason(text, tokens, repair, _last_cut(language, text, tokens))


def _examined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for file_id, file, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            language = language_of(file)
            if language is None:
                continue
            if text is None:
                rows.append((file_id, language, 0, None, None, None, "missing"))
            else:
                rows.append((file_id, language, *examine(language, text)))
        columns = list(zip(*rows, strict=True)) or [()] * len(_ARROW)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW.types, strict=True)], schema=_ARROW)


def check_syntax(files: DataFrame, file_id: str = "file_id", file: str = "file", content: str = "content") -> DataFrame:
    """One row per file of a known language: ``file_id, language, n_tokens, edit_cost, exact, error_line, reason``.

    A file is valid if its edit cost is 0; its reason is then null. A content that is null has no cost and the reason ``missing``, an empty one
    is a valid Java text and no valid JSON or XML. Files of other languages, or without a name, have no row. Rows are worked on where they are, a
    file at a time, so the result doesn't depend on how they are spread.
    """
    c = lambda x: F.col(f"`{x}`")
    texts = files.select(c(file_id).cast("long").alias("file_id"), c(file).cast("string").alias("file"), c(content).cast("string").alias("content"))
    return spread(texts, "file_id", factor=8).mapInArrow(_examined, RESULT)


def plain_path(column: str):
    """A path without the ``./`` it may begin with."""
    return F.regexp_replace(F.col(column), r"^(\./)+", "")


def syntax_rates(files: DataFrame, checked: DataFrame, coverage: DataFrame) -> DataFrame:
    """Files and flagged files per repository and language, against what the extraction reported.

    files: ``file_id, repo_id, file``; coverage: ``repo_id, pair_id, files_scanned, unparseable``. Returns ``repo_id, language, n_files, n_flagged,
    flagged_rate, n_truncated, n_conflicts, n_mismatches, n_reported`` (flagged or not, listed as unparseable by their own repository), ``n_flagged_unreported,
    files_scanned_reported`` (over the repository's pairs, the largest count of a pair listed twice; null if none is known). A file scanned under
    several ids counts for each; a null repository is one of its own.
    """
    known = coverage.select(F.col("repo_id").alias("of"), F.explode("unparseable").alias("u")).select("of", plain_path("u.file").alias("path")).filter("path IS NOT NULL").distinct()
    scanned = coverage.groupBy("repo_id", "pair_id").agg(F.max("files_scanned").alias("n")).groupBy("repo_id").agg(F.sum("n").alias("files_scanned_reported"))
    scanned = scanned.withColumnRenamed("repo_id", "r")
    own = files.select("file_id", "repo_id", plain_path("file").alias("file_path"))
    listed = F.col("repo_id").eqNullSafe(F.col("of")) & (F.col("file_path") == F.col("path"))
    rows = checked.join(own, "file_id").join(known.withColumn("listed", F.lit(True)), listed, "left")
    flagged = F.col("reason").isNotNull()
    count = lambda x: F.count(F.when(x, 1))
    rates = rows.groupBy("repo_id", "language").agg(
        F.count(F.lit(1)).alias("n_files"),
        count(flagged).alias("n_flagged"),
        (count(flagged) / F.count(F.lit(1))).alias("flagged_rate"),
        *[count(F.col("reason") == r).alias(n) for r, n in (("truncation", "n_truncated"), ("conflict", "n_conflicts"), ("mismatch", "n_mismatches"))],
        count(F.col("listed")).alias("n_reported"),
        count(flagged & F.col("listed").isNull()).alias("n_flagged_unreported"),
    )
    return rates.join(scanned, F.col("repo_id").eqNullSafe(F.col("r")), "left").drop("r")
