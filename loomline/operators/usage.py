"""Who uses what: usage counts and partly used containers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def export_usage(uses: DataFrame, keys: list[str], importer: str) -> DataFrame:
    """Uses and distinct importers of each export, in one shuffle after partial distinct."""
    return uses.groupBy(*keys).agg(F.count("*").alias("n_uses"), F.countDistinct(importer).alias("n_importers"))


def partly_used(items: DataFrame, container: str, live: Column) -> DataFrame:
    """Containers that have both live and dead items: container, n_live, n_dead, percent_dead (whole)."""
    counts = items.groupBy(container).agg(F.count_if(live).alias("n_live"), F.count_if(~live).alias("n_dead"))
    both = counts.where("n_live > 0 and n_dead > 0")
    return both.withColumn("percent_dead", F.floor(F.col("n_dead") * 100.0 / (F.col("n_live") + F.col("n_dead")) + 0.5).cast("long"))
