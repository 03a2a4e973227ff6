"""Rule tables over lines and paths: first match, boosted severity, roll-ups and gates."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.lines import is_comment, lines, open_before

LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


@dataclass(frozen=True)
class Rule:
    """A pattern that Java and RE2 read alike; `languages` empty: all. `gate`: strings of which what matches has one, if there are such."""

    id: str
    pattern: str
    severity: str = "MEDIUM"
    group: str = ""
    confidence: float = 1.0
    languages: tuple[str, ...] = ()
    gate: tuple[str, ...] = ()

    def hits(self, text: Column) -> Column:
        """Whether the text matches; a search for the gate's strings comes first, as it is much cheaper than a pattern."""
        out = text.rlike(self.pattern)
        if self.gate:
            out = reduce(or_, (text.contains(x) for x in self.gate)) & out
        return out


def rank(severity: Column) -> Column:
    """1 (LOW) to 4 (CRITICAL); 0 for anything else."""
    out = F.lit(0)
    for i, level in enumerate(LEVELS):
        out = F.when(severity == level, i + 1).otherwise(out)
    return out


def level(number: Column) -> Column:
    return F.get(F.array(*(F.lit(x) for x in LEVELS)), (number - 1).cast("int"))


def first_match(text: Column, rules: list[Rule], language: Column | None = None) -> Column:
    """The place in `rules` of the first rule that matches; null if none does."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(rules))):
        hit = rules[i].hits(text)
        if rules[i].languages and language is not None:
            hit = language.isin(*rules[i].languages) & hit
        out = F.when(hit, i).otherwise(out)
    return out


def attribute(place: Column, rules: list[Rule], name: str) -> Column:
    """An attribute of the rule at a place, as a lookup in a literal array."""
    return F.get(F.array(*(F.lit(getattr(r, name)) for r in rules)), place)


#: Lines of markup, and lines after which text of a page or structured data stands, which are shown and not run.
MARKUP, BEFORE_TEXT = r"\bclassName\s*=", r"^\s*<[A-Za-z][\w.]*\b(?:.*[^/])?>\s*$|application/ld\+json"


def scan_lines(df: DataFrame, rules: list[Rule], text: str, *keys: str, comments: bool = True, language: str | None = None, quiet: bool = False) -> DataFrame:
    """One row per line that a rule matches: keys, line_no, line (120 characters), rule, severity, group.

    Texts that no rule can match are dropped before their lines are made; the
    rest needs no shuffle either. Without `comments`, comment lines are left out;
    `quiet` leaves out lines that begin within a template literal, and markup:
    lines of it, and the text after an opening tag.
    """
    some = reduce(or_, (reduce(or_, (F.col(text).contains(x) for x in r.gate)) if r.gate else F.col(text).rlike(f"(?m){r.pattern}") for r in rules))
    every = lines(F.col(text))
    inside = open_before(every, "`", is_comment) if quiet else F.transform(every, lambda x: F.lit(False))
    rows = df.where(some).select(*keys, every.alias("__lines"), inside.alias("__inside"))
    cells = F.transform("__lines", lambda x, i: F.struct((i + 1).cast("long").alias("line_no"), x.alias("line"), F.when(i > 0, F.get("__lines", i - 1)).otherwise("").alias("previous"), F.get("__inside", i).alias("inside")))
    rows = rows.select(*keys, F.explode(cells).alias("__l")).select(*keys, "__l.*")
    if not comments:
        rows = rows.where(~is_comment(F.col("line")))
    if quiet:
        rows = rows.where(~(F.col("inside") | F.col("line").rlike(MARKUP) | F.col("previous").rlike(BEFORE_TEXT)))
    found = rows.withColumn("__rule", first_match(F.col("line"), rules, F.col(language) if language else None)).where("__rule is not null")
    return found.select(*keys, "line_no", F.substring(F.trim("line"), 1, 120).alias("line"), *(attribute(F.col("__rule"), rules, a).alias(b) for a, b in (("id", "rule"), ("severity", "severity"), ("group", "rule_group"))))


def found_lines(text: Column, rules: list[Rule], language: Column) -> Column:
    """Lines that a rule matches as an array of struct(line_no, line, rule, severity, rule_group), without comments, template literals and markup; null for texts that no rule can match."""
    some = reduce(or_, (reduce(or_, (text.contains(x) for x in r.gate)) if r.gate else text.rlike(f"(?m){r.pattern}") for r in rules))
    every = lines(text)
    numbered = F.transform(F.arrays_zip(every.alias("line"), open_before(every, "`", is_comment).alias("inside")), lambda s, i: F.struct((i + 1).cast("long").alias("line_no"), s["line"].alias("line"), s["inside"].alias("inside"), F.when(i > 0, F.get(every, i - 1)).otherwise("").alias("previous")))
    live = F.filter(numbered, lambda s: ~(is_comment(s["line"]) | s["inside"] | s["line"].rlike(MARKUP) | s["previous"].rlike(BEFORE_TEXT)))
    hits = F.filter(F.transform(live, lambda s: F.struct(s["line_no"].alias("line_no"), s["line"].alias("line"), first_match(s["line"], rules, language).alias("place"))), lambda s: s["place"].isNotNull())
    named = F.transform(hits, lambda s: F.struct(s["line_no"].alias("line_no"), F.trim(s["line"]).alias("line"), *(attribute(s["place"], rules, a).alias(b) for a, b in (("id", "rule"), ("severity", "severity"), ("group", "rule_group")))))
    return F.when(some, named)


def nearness(path: Column, rules: list[Rule]) -> Column:
    """The highest rank of the rules that match a path; 0 if none does."""
    return F.greatest(F.lit(0), *(F.when(path.rlike(r.pattern), LEVELS.index(r.severity) + 1).otherwise(0) for r in rules))


def boosted(severity_rank: Column, boost_rank: Column) -> Column:
    """One level up, at most to the highest, where the boost is at least as high as the severity."""
    return F.when((boost_rank > 0) & (boost_rank >= severity_rank), F.least(severity_rank + 1, F.lit(len(LEVELS)))).otherwise(severity_rank)


def gate(findings: DataFrame, least: str) -> DataFrame:
    """One row: the number of findings, the highest rank, and whether it reaches `least`."""
    top = F.coalesce(F.max(rank(F.col("severity"))), F.lit(0))
    return findings.agg(F.count("*").alias("n_findings"), top.alias("max_rank"), (top >= LEVELS.index(least) + 1).alias("failed"))
