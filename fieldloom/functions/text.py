"""Names, labels and identifiers of the lineage model as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decapitalised(name: Column) -> Column:
    """``Iban`` as ``iban``."""
    return F.concat(F.lower(F.substring(name, 1, 1)), F.substring(name, 2, 2_147_483_647))


def last_part(name: Column) -> Column:
    """What follows the last dot."""
    return F.substring_index(name, ".", -1)


def label(class_fqn: Column, method: Column) -> Column:
    """``Class.method`` without the package."""
    return F.concat(last_part(class_fqn), F.lit("."), method)


def display_source(path: Column, expression: Column, width: int = 60) -> Column:
    """The path of a source or, without one, its expression in one line of at most ``width`` characters, bars escaped."""
    flat = F.replace(F.trim(F.regexp_replace(expression, r"\s+", " ")), F.lit("|"), F.lit("\\|"))
    return F.coalesce(path, F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width - 1), F.lit("…"))).otherwise(flat))


def scope_name(text: Column) -> Column:
    """A scope in capitals, other characters than letters and digits as one underscore, none at the ends."""
    return F.upper(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))


def plain_id(text: Column) -> Column:
    """An identifier in lower case with an underscore for all that isn't a letter, digit, underscore or hyphen."""
    return F.lower(F.regexp_replace(text, "[^A-Za-z0-9_-]+", "_"))


def short_filename(class_fqn: Column, method: Column, full_id: Column, width: int = 80) -> Column:
    """A file name for an entry point: its label, cut to ``width`` characters, and 12 digits of the id's hash."""
    name = label(class_fqn, method)
    return F.concat(F.when(F.length(name) > width, F.concat(F.substring(name, 1, width - 1), F.lit("~"))).otherwise(name), F.lit("-"), F.substring(F.sha1(full_id), 1, 12))


def edge_id(repo: Column, pair: Column, file: Column, line: Column, target: Column) -> Column:
    """repo.pair.e_ and 12 digits of the hash of file, line and target; the source is no part of it."""
    return F.concat_ws(".", repo, pair, F.concat(F.lit("e_"), F.substring(F.sha1(F.concat_ws(":", file, line.cast("string"), target)), 1, 12)))


def entry_point_id(repo: Column, pair: Column, class_fqn: Column, signature: Column, returned: Column) -> Column:
    """repo.pair.ep_ and 12 digits of the hash of repository, pair and signature."""
    whole = F.concat(class_fqn, F.lit("#"), signature, F.lit("->"), returned)
    return F.concat_ws(".", repo, pair, F.concat(F.lit("ep_"), F.substring(F.sha1(F.concat_ws("|", repo, pair, whole)), 1, 12)))


def manifest_edge_id(repo: Column, pair: Column, file: Column, line: Column, target: Column, source: Column) -> Column:
    """The manifests' id: lower-case, 8 digits of the hash of file, line, target and source, an absent source being empty."""
    digits = F.substring(F.sha1(F.concat_ws("\n", file, line.cast("string"), target, F.coalesce(source, F.lit("")))), 1, 8)
    return F.concat_ws(".", plain_id(repo), plain_id(pair), F.concat(F.lit("e_"), digits))


def percent(part: Column, whole: Column) -> Column:
    """100 part / whole with two decimals, ties to even; null for a whole of 0."""
    return F.when(whole > 0, F.bround(F.lit(100.0) * part / whole, 2))
