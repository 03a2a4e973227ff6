"""Source trees as a table: a Python data source whose tasks list and read one part of the tree each."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition, Not, StringContains, StringEndsWith

from loomline.functions.paths import matches_any

SCHEMA = "path string, place string, size bigint, modified double, error string"
#: Bytes of text that a task hands on at a time.
BATCH_BYTES = 8_000_000
#: Folders that aren't source: fixed values, as what is found in a tree depends on them.
FOLDERS = {
    "dependencies": ["node_modules", "bower_components", "jspm_packages", "web_modules", "vendor", "_vendor", "_distutils", "third_party", "3rdparty", ".venv", "venv"],
    "version control": [".git"],
    "output": ["dist", "build", "target", "out", "obj", "bin/Debug", "bin/Release", "gen/proto", "static/assets", "coverage"],
    "caches and logs": [".cache", "cache", "__pycache__", ".pytest_cache", ".mypy_cache", "log", "logs", "tmp", "temp"],
    "test data": [
        "testdata", "testData", "TestData", "test-data", "test_data", "fixture", "fixtures", "test-fixture", "test-fixtures", "test_fixtures", "__fixtures__", "test-cases", "test_cases", "testcases", "test/cases",
        "test/baselines", "tests/baselines", "Scaffolding/Baselines", "conformance", "snapshots", "__snapshots__", "__mock__", "__mockdata__", "__for-testing__", "pkg-tests-fixtures", "pkg-tests-specs", "type-test", "type-tests",
        "system-tests/projects", "system-tests/project-fixtures", "extra_tests/snippets", "Lib/encodings",
    ],
    "inputs of compilers' tests": [
        "tests/ui", "tests/ui-fulldeps", "tests/derive_ui", "tests/compile-fail", "tests/run-pass", "tests/run-fail", "tests/pretty", "tests/mir-opt", "tests/assembly", "tests/assembly-llvm", "tests/codegen", "tests/codegen-llvm",
        "tests/codegen-units", "tests/coverage-run-rustdoc", "tests/crashes", "tests/debuginfo", "tests/incremental", "tests/rustdoc-html", "tests/rustdoc-js", "tests/rustdoc-json", "tests/rustdoc-ui",
    ],
}
#: Ends of names of files that aren't source: packed scripts, locks, logs, data, archives, media.
ENDS = [".min.js", ".min.css", ".map", ".lock", ".log", ".pyc", ".pyo", ".sql", ".sqlite", ".sqlite3", ".db", ".mp4", ".mov", ".avi", ".zip", ".tar", ".gz", ".rar"]
#: Left out unless other globs are given.
EXCLUDED = [*(f"**/{f}/**" for names in FOLDERS.values() for f in names), *(f"**/*{e}" for e in ENDS), "**/cases/**/*.ts"]
_FOLDER, _END = re.compile(r"\*\*/([^*?{}\[\]]+)/\*\*"), re.compile(r"\*\*/\*(\.[^*?{}\[\]/]+)")


def outside(globs: list[str]) -> Column:
    """Whether a path matches none of the globs, over the source's columns.

    Globs of a whole folder, or of an ending, become comparisons of strings, one
    each, which Spark hands to the source; others are tried as patterns behind it.
    """
    out, rest = F.lit(True), []
    for g in globs:
        folder, end = _FOLDER.fullmatch(g), _END.fullmatch(g)
        if folder:
            out = out & ~F.col("place").contains(f"/{folder[1]}/")
        elif end:
            out = out & ~F.col("place").endswith(end[1])
        else:
            rest.append(g)
    return out & ~matches_any("path", rest) if rest else out


class _Part(InputPartition):
    def __init__(self, folder: str, deep: bool) -> None:
        super().__init__(None)
        self.folder, self.deep = folder, deep


class TreeReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.root = options["path"]
        self.folders: list[str] = []
        self.ends: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes exclusions: folders are not walked into, and files not looked at. Other filters stay with Spark."""
        for f in filters:
            inner = f.child if isinstance(f, Not) else None
            if isinstance(inner, StringContains) and inner.attribute == ("place",) and inner.value[:1] + inner.value[-1:] == "//":
                self.folders.append(inner.value)
            elif isinstance(inner, StringEndsWith) and inner.attribute == ("place",):
                self.ends.append(inner.value)
            else:
                yield f

    def walked(self, folder: str) -> bool:
        """Whether a folder, as a path from the top, may hold files that are wanted."""
        place = f"/{folder}/"
        return not any(x in place for x in self.folders)

    def inside(self, folder: str) -> list[str]:
        """Folders in a folder that are walked."""
        found = sorted(e.name for e in os.scandir(os.path.join(self.root, folder)) if e.is_dir(follow_symlinks=False))
        return [x for x in (f"{folder}/{name}" if folder else name for name in found) if self.walked(x)]

    def partitions(self) -> list[_Part]:
        """One for each folder two levels down, and one for the files of each folder above."""
        parts = [_Part("", False)]
        for a in self.inside(""):
            parts.append(_Part(a, False))
            parts += [_Part(b, True) for b in self.inside(a)]
        return parts

    def read(self, partition: _Part) -> Iterator[tuple]:
        waiting = [partition.folder]
        while waiting:
            folder = waiting.pop()
            try:
                found = sorted(os.scandir(os.path.join(self.root, folder)), key=lambda e: e.name)
            except OSError as e:
                yield folder, f"/{folder}", None, None, str(e)
                continue
            below = []
            for entry in found:
                path = f"{folder}/{entry.name}" if folder else entry.name
                if entry.is_dir(follow_symlinks=False):
                    if partition.deep and self.walked(path):
                        below.append(path)
                    continue
                if any(path.endswith(x) for x in self.ends):
                    continue
                try:
                    stat = entry.stat()
                    yield path, f"/{path}", stat.st_size, stat.st_mtime, None
                except OSError as e:
                    yield path, f"/{path}", None, None, str(e)
            waiting += reversed(below)


class TreeSource(DataSource):
    """`format("tree")` with the option path, which all executors see: the names, sizes and times of all files.

    Names that begin with `_` or `.` are listed, which Spark's own file sources
    skip. Files and folders that can't be looked at are rows with an error.
    `place` is the path with a slash before it, so that comparisons with it tell
    whole names of folders; those that exclude are answered while listing, where
    spark.sql.python.filterPushdown.enabled is set.
    """

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def list_tree(spark: SparkSession, root: str, exclude: list[str] | None = None) -> DataFrame:
    """(path, size, modified, error) of the files below `root` that no glob of `exclude` matches; excluded folders aren't walked."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
    return spark.read.format("tree").option("path", root).load().where(outside(EXCLUDED if exclude is None else exclude)).select("path", "size", "modified", "error")


def read_tree(spark: SparkSession, root: str, exclude: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """(path, size, modified, content, error) of the files below `root` that no glob of `exclude` matches, whole, whatever their size.

    Folders are listed by one task each; the files that are left are then dealt
    out evenly, whatever folder they are in, and read. Files that can't be read are rows with an error and no content.
    """
    return read_files(list_tree(spark, root, exclude), root, partitions)


def read_files(files: DataFrame, root: str, partitions: int | None = None) -> DataFrame:
    """The rows of a listing with their files' contents."""
    names = ["path", "size", "modified", "content", "error"]

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.float64(), pa.string(), pa.string()))], names)

        for batch in batches:
            rows, held = [], 0
            for path, size, modified, error in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                text = None
                if error is None:
                    try:
                        with open(os.path.join(root, path), encoding="utf-8", errors="replace") as f:
                            text = f.read()
                    except OSError as e:
                        error = str(e)
                rows.append((path, size, modified, text, error))
                held += len(text or "")
                if held > BATCH_BYTES:
                    yield made(rows)
                    rows, held = [], 0
            if rows:
                yield made(rows)

    dealt = files.repartition(partitions, "path") if partitions else files.repartition("path")
    return dealt.mapInArrow(contents, "path string, size bigint, modified double, content string, error string")
