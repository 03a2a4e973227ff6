"""Resolving references: ranked candidates, longest prefixes and path suffixes, all as equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def candidates(*keys: Column) -> Column:
    """An array of struct(rank, key) in order of preference; null keys drop out."""
    every = F.array(*(F.struct(F.lit(i + 1).alias("rank"), k.alias("key")) for i, k in enumerate(keys)))
    return F.filter(every, lambda s: s["key"].isNotNull())


def resolve(refs: DataFrame, targets: DataFrame, by: list[str], within: list[str] | None = None) -> DataFrame:
    """Joins exploded references (`by`, rank, key) with `targets` (key, target) and keeps, for each reference, all targets of its least rank.

    `within` names columns that must agree besides the key, as the container of both.
    """
    found = refs.join(targets, [*(within or []), "key"])
    least = Window.partitionBy(*by)
    return found.withColumn("__least", F.min("rank").over(least)).where("rank = __least").drop("__least")


def longest_prefix(refs: DataFrame, text: str, prefixes_of: Column, table: DataFrame, keys: list[str]) -> DataFrame:
    """For each row the longest entry of `table` (prefix, ...) among its own prefixes.

    All prefixes are exploded and joined on equality, so that no theta join is
    needed; max over struct(length, ...) aggregates before the shuffle.
    """
    every = refs.select(*keys, text, F.explode(prefixes_of).alias("prefix"))
    rest = [c for c in table.columns if c != "prefix"]
    best = F.max(F.struct(F.length("prefix").alias("n"), "prefix", *rest)).alias("best")
    return every.join(table, "prefix").groupBy(*keys, text).agg(best).select(*keys, text, "best.prefix", *(f"best.{c}" for c in rest))


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def last_wins(df: DataFrame, keys: list[str], ordinal: list[str], values: list[str]) -> DataFrame:
    """A map in which later entries overwrite earlier ones: values at the greatest ordinal, as a partial aggregate."""
    best = F.max(F.struct(*ordinal, *values)).alias("__last")
    return df.groupBy(*keys).agg(best).select(*keys, *(F.col(f"__last.{c}").alias(c) for c in [*ordinal, *values]))
