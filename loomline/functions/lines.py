"""Texts as numbered lines, without a shuffle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Line beginnings that mark comments in common languages.
COMMENT_MARKS = ("//", "/*", "*", "#", "<!--", "--")


def lines(text: Column) -> Column:
    """All lines, empty ones at the end included."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def numbered(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """`keys`, line_no (from 1), line, previous (empty before the first)."""
    every = F.transform("__lines", lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line"), F.when(i == 0, "").otherwise(F.get("__lines", i - 1)).alias("previous")))
    out = df.select(*keys, lines(F.col(text)).alias("__lines")).select(*keys, F.explode(every).alias("__l"))
    return out.select(*keys, F.col("__l.line_no").cast("long").alias("line_no"), F.col("__l.line").alias("line"), F.col("__l.previous").alias("previous"))


def is_comment(line: Column, marks: tuple[str, ...] = COMMENT_MARKS) -> Column:
    trimmed = F.ltrim(line)
    out = F.lit(False)
    for mark in marks:
        out = out | trimmed.startswith(mark)
    return out


def without(every: Column, pattern: str) -> Column:
    """An array of lines without those that match, and without blank lines after blank ones."""
    kept = F.filter(every, lambda x: ~x.rlike(pattern))
    let = F.array(kept)
    return F.transform(let, lambda k: F.filter(k, lambda x, i: (F.trim(x) != "") | (i == 0) | (F.trim(F.get(k, F.greatest(i - 1, F.lit(0)))) != "")))[0]


def open_before(every: Column, mark: str, skip: Callable[[Column], Column] | None = None) -> Column:
    """For each line, whether an odd number of `mark`, not behind a backslash, lies before it.

    Lines that `skip` is true of count for nothing. Linear in the text: what
    lies between an odd mark and the next gets a sign behind each of its breaks.
    """
    sign = "\x01"
    bare = F.transform(every, lambda x: F.replace(F.replace(x, F.lit(sign), F.lit("")), F.lit("\\" + mark), F.lit("")))
    if skip is not None:
        bare = F.transform(bare, lambda x: F.when(skip(x), F.replace(x, F.lit(mark), F.lit(""))).otherwise(x))
    parts = F.split(F.array_join(bare, "\n"), re.escape(mark), -1)
    signed = F.array_join(F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.replace(x, F.lit("\n"), F.lit("\n" + sign))).otherwise(x)), "")
    return F.transform(F.split(signed, "\n", -1), lambda x: x.startswith(sign))
