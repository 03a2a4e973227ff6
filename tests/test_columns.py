import posixpath
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomline.functions import formats, lines, paths

PATHS = ["a/b/c.test.ts", "c.py", ".hidden", "a/.env", "x", "a/b/", "dir.d/file", "__init__.py", "a/B/Cé.TSX", ""]


def test_parts_of_paths(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "p string")
    for r in df.select("p", paths.dirname("p").alias("d"), paths.basename("p").alias("b"), paths.extension("p").alias("e"), paths.stem("p").alias("s"), paths.ancestors("p").alias("up"), paths.suffixes("p").alias("ends"), paths.prefixes("p", "/").alias("starts")).collect():
        assert (r.d, r.b) == posixpath.split(r.p) and r.e == posixpath.splitext(r.p)[1].lower() and r.s == posixpath.splitext(r.p)[0]
        parts = r.p.split("/")
        assert r.ends == ["/".join(parts[i:]) for i in range(len(parts))] and r.starts == ["/".join(parts[: i + 1]) for i in range(len(parts))]
        assert r.up == ["/".join(parts[:i]) for i in range(len(parts) - 1, -1, -1)]


def test_normalise(spark):
    cases = {"a/./b//c": "a/b/c", "a/../b": "b", "a/b/../../c/./d": "c/d", "../a": None, "a/../../b": None, "./x": "x", "a/..": ""}
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    assert {r.p: r.n for r in df.select("p", paths.normalise("p").alias("n")).collect()} == cases


def test_globs(spark):
    cases = [("**/*.ts", "a/b.ts", True), ("**/*.ts", "b.ts", True), ("*.ts", "a/b.ts", False), ("src/**", "src/a/b", True), ("src/**", "xsrc/a", False), ("a?c", "abc", True), ("a?c", "a/c", False), ("{a,b}/*.js", "b/x.js", True), ("a.b", "axb", False), ("a+(b)", "a+(b)", True)]
    for glob, path, want in cases:
        assert bool(re.match(paths.glob_regex(glob).replace(r"\z", r"\Z"), path)) == want, (glob, path)
        assert spark.createDataFrame([(path,)], "p string").select(paths.matches_any("p", [glob]).alias("m")).first().m == want
    assert not spark.createDataFrame([("a",)], "p string").select(paths.matches_any("p", []).alias("m")).first().m


@settings(max_examples=25, deadline=None)
@given(text=st.text(alphabet="ab #\n`\r", max_size=40))
def test_lines(spark, text):
    df = spark.createDataFrame([(1, text)], "k int, t string")
    rows = sorted(lines.numbered(df, "t", "k").collect(), key=lambda r: r.line_no)
    want = text.split("\n")
    assert [r.line for r in rows] == want and [r.line_no for r in rows] == list(range(1, len(want) + 1)) and [r.previous for r in rows] == ["", *want[:-1]]
    before, n = [], 0
    for x in want:
        before.append(n % 2 == 1)
        n += x.count("`")
    assert df.select(lines.open_before(lines.lines(F.col("t")), "`").alias("o")).first().o == before


def test_formats(spark):
    df = spark.createDataFrame([(0,), (1023,), (1280,), (5 * 1024 * 1024,)], "n long")
    assert [r.s for r in df.select(formats.size_text(F.col("n")).alias("s")).collect()] == ["0 B", "1023 B", "1.3 KB", "5.0 MB"]
    assert df.limit(1).select(formats.rate_text(F.lit(1), F.lit(3)).alias("a"), formats.rate_text(F.lit(1), F.lit(0)).alias("b")).first() == ("33.33%", "0.00%")
