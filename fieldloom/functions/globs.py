"""Globs and scope rules as column expressions: compiled on the driver, evaluated in the scan's stage."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions.text import scope_name

_PART = re.compile(r"\{(\w+)\}|\*\*/?|\*|[^*{]+|\{")


def glob_regex(glob: str, swallow_slash: bool = True) -> tuple[str, list[str]]:
    """A regular expression for a whole path, and the names of its groups in order.

    ``{name}`` is one part of a path, ``*`` any characters of a part, ``**`` any characters at all. With ``swallow_slash`` the slash after ``**`` is taken
    in, so that ``**/a`` finds ``a`` at the top, and ``ba``, too.
    """
    out, names = [], []
    for m in _PART.finditer(glob):
        part = m[0]
        if m[1]:
            out.append("([^/]+)")
            names.append(m[1])
        elif part.startswith("**"):
            out.append(".*/" if part.endswith("/") and not swallow_slash else ".*")
        else:
            out.append("[^/]*" if part == "*" else re.sub(r"([\\.\[\]{}()+?^$|])", r"\\\1", part))
    return "^" + "".join(out) + "$", names


def matches_any(path: Column, globs: list[str], swallow_slash: bool = True) -> Column:
    """Whether a path matches one of the globs; false for no globs."""
    found = [path.rlike(glob_regex(g, swallow_slash)[0]) for g in globs]
    out = F.lit(False)
    for x in found:
        out = out | x
    return out


def with_generated(globs: list[str]) -> list[str]:
    """The globs and, for each that leads below ``/src/main/java/`` of a module, one for the module's generated sources; each once."""
    own = [g.partition("/src/main/java/")[0] for g in globs if "/src/main/java/" in g[1:]]
    return list(dict.fromkeys([*globs, *[f"{module}/target/generated-sources/annotations/**/*.java" for module in own]]))


#: Folders that hold no sources; fixed values.
SKIPPED = """.git .idea .vscode .gradle .settings node_modules build out bin dist .next .nuxt .cache classes test-classes dependency site
  surefire-reports failsafe-reports""".split()


def indexed(path: Column, skipped: list[str] = SKIPPED, kept_in_target: tuple[str, ...] = ("generated-sources", "atlas")) -> Column:
    """Whether an index of all sources takes a Java file: none of the skipped folders lies above it, and below ``target`` only the kept ones do."""
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    below = F.zip_with(F.slice(folders, 1, F.size(folders) - 1), F.slice(folders, 2, F.size(folders)), lambda a, b: (a == "target") & ~b.isin(*kept_in_target))
    inside = F.when(F.size(folders) > 1, F.exists(below, lambda x: x)).otherwise(F.lit(False))
    return path.endswith(".java") & ~F.arrays_overlap(folders, F.array(*[F.lit(n) for n in skipped])) & ~inside


def in_folder(path: Column, names: list[str]) -> Column:
    """Whether a folder of one of these names lies on the path."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(n) for n in names]))


@dataclass(frozen=True)
class ScopeRule:
    """A rule for the scope of a file: a glob over the path with named parts, or a pattern over the file's name, and values given as they are."""

    glob: str = "**"
    filename_pattern: str | None = None
    scope: dict[str, str] = field(default_factory=dict)


SCOPES = ("country", "clearing", "product", "field_group")


def scope_of(path: Column, rules: list[ScopeRule], captures_win: bool = False) -> Column:
    """The scope of a path by the first rule that matches, as a struct of SCOPES; all null if none does.

    A value that a rule gives wins over a part that it captures; with ``captures_win`` it doesn't, and ``**/`` keeps its slash, as the other of
    the reference's two engines has it.
    """
    none = F.struct(*[F.lit(None).cast("string").alias(s) for s in SCOPES])
    out = none
    for rule in reversed(rules):
        pattern, names = glob_regex(rule.glob, swallow_slash=not captures_win)
        subject = path
        if rule.filename_pattern:
            pattern = rule.filename_pattern
            names = list(re.compile(pattern).groupindex)
            pattern = "^(?:" + re.sub(r"\(\?P<", "(?<", pattern) + ")"  # matched from the begin of the name
            subject = F.substring_index(path, "/", -1)
        values = {}
        for s in SCOPES:
            captured = scope_name(F.nullif(F.regexp_extract(subject, pattern, names.index(s) + 1), F.lit(""))) if s in names else None
            given = F.lit(rule.scope[s]) if s in rule.scope else None
            first, second = (captured, given) if captures_win else (given, captured)
            values[s] = F.coalesce(*[x for x in (first, second) if x is not None]) if first is not None or second is not None else F.lit(None).cast("string")
        out = F.when(subject.rlike(pattern), F.struct(*[values[s].alias(s) for s in SCOPES])).otherwise(out)
    return out
