"""Facts: what one pass over a text finds, as named columns, so that plans read narrow tables and no text twice."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.languages import language

#: By name, from the options of a scan (or None) to a column over path, content, LANG and CODE.
FACTS: dict[str, Callable[[Any], Column]] = {}
#: The text without comments, and the language of the path, columns that are there while facts are taken: each is made once a row, however many patterns ask for it.
CODE, LANG = "__code", "__lang"


def fact(name: str):
    """Registers a fact."""

    def register(f: Callable[[Any], Column]) -> Callable[[Any], Column]:
        FACTS[name] = f
        return f

    return register


#: One token at a time: strings, which are the first group, and comments. A slash pair behind a colon or a backslash belongs to an address or a pattern.
_QUOTED = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|\'[^\'\\\n]*+(?:\\.[^\'\\\n]*+)*+\''
SLASHED = rf"({_QUOTED}|`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`)|(?<![:\\])//[^\n]*+|/\*[\s\S]*?\*/"
#: Texts between three quotes are comments, too: they are documentation, or data.
HASHED = rf'"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|({_QUOTED})|#[^\n]*+'


def without_comments() -> Column:
    """The text of a file in one of LANGUAGES, by LANG, without its comments; others as they are."""
    text, lang = F.coalesce(F.col("content"), F.lit("")), F.col(LANG)
    return F.when(lang == "python", F.regexp_replace(text, HASHED, "$1")).when(lang.isNotNull(), F.regexp_replace(text, SLASHED, "$1")).otherwise(text)


def has_facts(files: DataFrame) -> bool:
    return any(c.startswith("fact_") for c in files.columns)


def with_facts(files: DataFrame, names: Iterable[str], options: Any = None) -> DataFrame:
    """`files` with a column fact_NAME for each name that it hasn't yet; the text without comments is made once a row."""
    missing = [n for n in names if f"fact_{n}" not in files.columns]
    if not missing:
        return files
    return files.withColumn(LANG, language("path")).withColumn(CODE, without_comments()).select(*files.columns, *(FACTS[n](options).alias(f"fact_{n}") for n in missing))


def of(name: str) -> Column:
    return F.col(f"fact_{name}")


def told(files: DataFrame, *names: str) -> DataFrame:
    """`files` with these facts, taken here if they aren't there."""
    return with_facts(files, names)
