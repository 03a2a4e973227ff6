"""Rule scans over a stream of files or documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators.rules import Rule, scan_lines


def new_versions(stream: DataFrame, key: str, text: str, time: str, delay: str) -> DataFrame:
    """Each version of a text once: repeats of key and text within the delay are dropped, and state older than it."""
    return stream.withColumn("version", F.xxhash64(text)).withWatermark(time, delay).dropDuplicatesWithinWatermark([key, "version"])


def stream_findings(stream: DataFrame, rules: list[Rule], key: str, text: str, time: str, delay: str = "1 hour") -> DataFrame:
    """Findings in new versions, as they come: key, time, line_no, line, rule, severity, rule_group. Without state of its own."""
    return scan_lines(new_versions(stream, key, text, time, delay), rules, text, key, time)


def finding_counts(findings: DataFrame, time: str, length: str, slide: str | None = None) -> DataFrame:
    """Findings and distinct lines by window, rule and severity; a window is emitted when the watermark passes its end (append mode)."""
    span = F.window(time, length, slide) if slide else F.window(time, length)
    counts = findings.groupBy(span.alias("span"), "rule", "severity").agg(F.count("*").alias("n_findings"), F.approx_count_distinct("line").alias("n_lines"))
    return counts.select(F.col("span.start").alias("start"), F.col("span.end").alias("stop"), "rule", "severity", "n_findings", "n_lines")
