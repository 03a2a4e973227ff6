"""Path arithmetic as column expressions, and globs as regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(path: Column | str) -> Column:
    return F.col(path) if isinstance(path, str) else path


def dirname(path: Column | str) -> Column:
    """Everything before the last slash; empty at the top."""
    p = _col(path)
    return F.when(p.contains("/"), F.regexp_replace(p, r"/[^/]*\z", "")).when(p.isNotNull(), F.lit(""))


def basename(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def extension(path: Column | str) -> Column:
    """Lower-case, with its dot; empty for names without one and for names that only begin with one."""
    return F.lower(F.regexp_extract(basename(path), r"[^.](\.[^.]+)\z", 1))


def stem(path: Column | str) -> Column:
    """The path without its last extension."""
    return F.regexp_replace(_col(path), r"([^./])\.[^./]+\z", "$1")


def normalise(path: Column | str) -> Column:
    """Without empty and `.` parts, `..` resolved; null if that leads above the top. Paths without such parts, most of them, are only looked at."""
    above = F.lit("..")

    def step(acc: Column, x: Column) -> Column:
        up = F.when((F.size(acc) == 0) | (F.element_at(acc, -1) == above), F.concat(acc, F.array(above))).otherwise(F.slice(acc, 1, F.size(acc) - 1))
        return F.when(x == above, up).otherwise(F.concat(acc, F.array(x)))

    def resolved(p: Column) -> Column:
        done = F.aggregate(F.filter(F.split(p, "/", -1), lambda x: ~x.isin("", ".")), F.array().cast("array<string>"), step, lambda d: F.when(F.coalesce(F.get(d, F.lit(0)), F.lit("")) != above, F.array_join(d, "/")))
        return F.when(p.rlike(r"(?:^|/)\.{0,2}(?:/|\z)"), done).otherwise(p)

    # The path stands once in the expression, however often it is looked at.
    return F.get(F.transform(F.array(_col(path)), resolved), F.lit(0))


def ancestors(path: Column | str) -> Column:
    """All directories above a path, nearest first; the top is the empty string."""
    parts = F.split(_col(path), "/", -1)
    return F.transform(F.reverse(F.sequence(F.lit(0), F.size(parts) - 1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def suffixes(path: Column | str) -> Column:
    """The path from each of its parts on, longest first."""
    parts = F.split(_col(path), "/", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def prefixes(text: Column | str, separator: str) -> Column:
    """The text up to each of its separators and whole, shortest first."""
    parts = F.split(_col(text), re.escape(separator), -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), separator))


def glob_regex(glob: str) -> str:
    """An anchored regular expression, in a dialect that Java and RE2 share: `**` crosses directories, `*` and `?` don't, `{a,b}` alternates."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
        i += 1
    if depth:
        raise ValueError(f"unclosed brace in glob {glob!r}")
    return rf"\A{''.join(out)}\z"


def matches_any(path: Column | str, globs: list[str]) -> Column:
    """One alternation for all globs, so that a path is tested in one pass."""
    if not globs:
        return F.lit(False)
    return _col(path).rlike("|".join(f"(?:{glob_regex(g)})" for g in globs))


def glob_root(glob: Column) -> Column:
    """The folder before a glob's first wildcard; a glob without one stands for its own folder."""
    return F.regexp_replace(F.regexp_extract(glob, r"^[^*?{\[]*", 0), r"/?[^/]*\z", "")


def glob_pattern(glob: Column) -> Column:
    """An anchored pattern for a column of globs, as `glob_regex` makes it of one; unclosed braces stand for themselves."""
    out = F.regexp_replace(glob, r"([.+^$()|\[\]\\])", r"\\$1")
    # Signs that no path has stand for stars while single ones are replaced.
    out = F.regexp_replace(out, r"\*\*/", "\x01")
    out = F.regexp_replace(out, r"\*\*", "\x02")
    out = F.regexp_replace(F.regexp_replace(out, r"\*", "[^/]*"), r"\?", "[^/]")
    out = F.replace(F.replace(out, F.lit("\x01"), F.lit("(?:.*/)?")), F.lit("\x02"), F.lit(".*"))
    for _ in range(3):
        inner = F.regexp_extract(out, r"\{([^{}]*)\}", 1)
        out = F.when(out.rlike(r"\{[^{}]*\}"), F.replace(out, F.concat(F.lit("{"), inner, F.lit("}")), F.concat(F.lit("(?:"), F.replace(inner, F.lit(","), F.lit("|")), F.lit(")")))).otherwise(out)
    return F.concat(F.lit(r"\A"), F.regexp_replace(out, r"([{}])", r"\\$1"), F.lit(r"\z"))
