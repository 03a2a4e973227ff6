"""The table of facts: one row per file, written in one pass over the contents, and kept up to date by content."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.facts import FACTS, has_facts, with_facts
from loomline.operators.lineage import written
from loomline.plans.configs import BUILDS, SCRAPES
from loomline.sources.tree import list_tree, read_files

#: Paths of files whose whole text plans read: manifests, configurations, pages.
CONFIGURATION = "|".join(
    [
        r"(?:^|/)(?:package|lerna|rush|nx|project|loomline)\.json\z|(?:^|/)deno\.jsonc?\z|(?:^|/)pnpm-workspace\.ya?ml\z|(?:^|/)[jt]sconfig[^/]*\.json\z",
        r"(?:^|/)go\.mod\z|\.csproj\z|^\.gitmodules\z|^\.loomlineignore\z|\.html?\z|(?:^|/)(?:vite|webpack|rspack|vitest)[^/]*\.[cm]?[jt]s\z",
        *(f"(?:{p})" for p in [*(r.name for r in SCRAPES), *(b[1] for b in BUILDS)]),
    ]
)
KEPT = ("path", "size", "modified", "error")


def extracted(files: DataFrame, names: Iterable[str] | None = None, options: Any = None) -> DataFrame:
    """The facts of `files` (path, content and whichever of size, modified, error): a projection, so each content is read once.

    `sha` tells contents apart. Only configurations keep their content. A file
    without content has null facts, or empty ones; other columns are dropped.
    """
    names = list(FACTS if names is None else names)
    kept = [c for c in KEPT if c in files.columns]
    rows = with_facts(files.select(*kept, "content"), names, options)
    return rows.select(*kept, F.sha2(F.col("content").cast("binary"), 256).alias("sha"), F.when(F.col("path").rlike(CONFIGURATION), F.col("content")).alias("content"), *(f"fact_{n}" for n in names))


def gathered(files: DataFrame, names: list[str], options: Any = None) -> DataFrame:
    """A written table with the named facts; `files` itself if it is one."""
    return files if has_facts(files) else written(extracted(files, names, options))


def refreshed(old: DataFrame, files: DataFrame, names: list[str] | None = None, options: Any = None) -> DataFrame:
    """The facts of `files`, those of unchanged ones taken from `old`: facts of files that went, or whose content is another, are dropped, and only new contents are searched.

    Digests of contents meet those of `old` as a narrow table; contents join only
    the paths that changed. A path that repeats is left as it is in both.
    """
    names = [c.removeprefix("fact_") for c in old.columns if c.startswith("fact_")] if names is None else names
    now = written(files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("sha")))
    same = old.select("path", "sha")
    changed = now.join(same, (now["path"] == same["path"]) & now["sha"].eqNullSafe(same["sha"]), "left_anti").select("path").distinct()
    kept = old.join(now.withColumnRenamed("sha", "now"), "path").where(F.col("sha").eqNullSafe(F.col("now"))).select(old.columns)
    fresh = extracted(files.join(changed, "path", "left_semi"), names, options)
    return kept.unionByName(fresh, allowMissingColumns=True)


def rescanned(spark: SparkSession, root: str, old: DataFrame, exclude: list[str] | None = None, options: Any = None) -> DataFrame:
    """The facts of the tree at `root`, where `old` has those of an earlier state of it: only files of another size or time are opened."""
    listed = written(list_tree(spark, root, exclude))
    same = ["path", "size", "modified"]
    names = [c.removeprefix("fact_") for c in old.columns if c.startswith("fact_")]
    kept = old.where("error is null").join(listed.select(*same), same, "left_semi").select(old.columns)
    changed = listed.join(old.where("error is null").select(*same), same, "left_anti")
    return kept.unionByName(extracted(read_files(changed, root), names, options), allowMissingColumns=True)
