"""Numbers as people read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the traffic estimate: visits a month, pages a visit, share served from caches, price and kg of CO2 a GB.
VISITS, PAGES, CACHED, PRICE_PER_GB, KG_PER_GB = 10_000, 3, 0.8, 0.085, 0.5


def rounded(x: Column, digits: int) -> Column:
    """Half up, so that all engines print the same."""
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits


def size_text(n: Column) -> Column:
    """Bytes as B, KB or MB with one decimal."""
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).when(n < 1024 * 1024, F.format_string("%.1f KB", rounded(n / 1024.0, 1))).otherwise(F.format_string("%.1f MB", rounded(n / 1048576.0, 1)))


def rate_text(part: Column, whole: Column) -> Column:
    """A share in per cent with two decimals; 0 of nothing."""
    return F.format_string("%.2f%%", F.when(whole > 0, rounded(100.0 * part / whole, 2)).otherwise(0.0))


def monthly_gb(n: Column) -> Column:
    """Traffic that so many bytes cause in a month."""
    return n * (VISITS * PAGES * (1 - CACHED)) / 1073741824.0


def monthly_price(n: Column) -> Column:
    return monthly_gb(n) * PRICE_PER_GB


def monthly_kg(n: Column) -> Column:
    return monthly_gb(n) * KG_PER_GB
