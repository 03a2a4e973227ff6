import os

import pytest
from pyspark.sql.datasource import EqualTo, Not, StringContains, StringEndsWith

from loomline.plans import tables
from loomline.plans.liveness import edges, options_of, scan
from loomline.sources.tree import EXCLUDED, TreeReader, list_tree, read_tree


def put(root, files):
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


TREE = {"index.ts": "import './a';\nimport './b';\n", "a.ts": "// import './c';\nexport const a = eval('1');\n", "b.ts": "export const b = 1;\n", "c.ts": "export const c = 1;\n", "package.json": '{"name": "x"}'}


def counted(spark, files):
    """The frame, and how often each of its rows was made."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    return files.mapInArrow(count, files.schema), made


def test_a_scan_reads_each_file_once(spark, tmp_path):
    put(tmp_path, TREE)
    files, made = counted(spark, read_tree(spark, str(tmp_path)))
    report = scan(files)
    assert {r.path for r in report.unreachable.collect()} == {"c.ts"}
    assert [(r.path, r.rule) for r in report.findings.collect()] == [("a.ts", "eval")]
    assert report.unused_exports.count() == 0 and report.summary.count() == 1
    assert made.value == len(TREE)


def test_excluded_folders_are_not_walked(tmp_path, monkeypatch):
    put(tmp_path, {**TREE, "node_modules/x/deep/y.js": "", "src/app/node_modules/z/w.js": "", "src/app/main.ts": "", "src/bin/Debug/o.cs": "", "src/bin/tool.ts": "", "src/a.min.js": ""})
    visited, scandir = [], os.scandir
    monkeypatch.setattr(os, "scandir", lambda p: (visited.append(os.path.relpath(p, tmp_path)), scandir(p))[1])
    reader = TreeReader({"path": str(tmp_path)})
    place = ("place",)
    rest = list(reader.pushFilters([Not(StringContains(place, "/node_modules/")), Not(StringContains(place, "/bin/Debug/")), Not(StringEndsWith(place, ".min.js")), EqualTo(place, "/a.ts"), Not(StringContains(place, "part"))]))
    assert rest == [EqualTo(place, "/a.ts"), Not(StringContains(place, "part"))]
    found = {r[0] for p in reader.partitions() for r in reader.read(p)}
    assert found == {*TREE, "src/app/main.ts", "src/bin/tool.ts"}
    assert not any("node_modules" in v or "Debug" in v for v in visited)


def test_exclusions_are_pushed_and_say_what_globs_say(spark, tmp_path):
    odd = ["vendor/v.go", "x/third_party/t.c", "y.zip", "logs/l.txt", "tests/ui/u.rs", "x/tests/ui/u.rs", "x/cases/deep/t.ts", "xnode_modules/k.ts", "vendored/v.go", "zip", "a/cases/t.js", "gen/proto/p.py", ".git/config", ".github/ci.yml"]
    put(tmp_path, {**TREE, **dict.fromkeys(odd, "")})
    listed = list_tree(spark, str(tmp_path))
    assert {r.path for r in listed.collect()} == {*TREE, "xnode_modules/k.ts", "vendored/v.go", "zip", "a/cases/t.js", ".github/ci.yml"}
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "/node_modules/" not in plan.split("BatchScan")[0]
    assert len(EXCLUDED) > 80


def test_only_changed_files_are_searched(spark, tmp_path):
    put(tmp_path, TREE)
    old = tables.written(tables.extracted(read_tree(spark, str(tmp_path))))
    put(tmp_path, {"b.ts": "import './c';\nexport const b = 22;\n", "d.ts": "import './a';\n"})
    os.remove(tmp_path / "package.json")
    os.utime(tmp_path / "b.ts", (1, 1))
    opened = tables.rescanned(spark, str(tmp_path), old)
    whole = tables.extracted(read_tree(spark, str(tmp_path)))
    assert sorted(map(str, opened.select(whole.columns).collect())) == sorted(map(str, whole.collect()))
    files, made = counted(spark, read_tree(spark, str(tmp_path)))
    fresh = tables.refreshed(old, files)
    assert sorted(map(str, fresh.drop("modified").select([c for c in whole.columns if c != "modified"]).collect())) == sorted(map(str, whole.drop("modified").collect()))
    assert {(r.src, r.dst) for r in edges(fresh).collect()} == {("index.ts", "a.ts"), ("index.ts", "b.ts"), ("b.ts", "c.ts"), ("d.ts", "a.ts")}


def test_configuration_of_the_tree(spark, tmp_path):
    put(tmp_path, {**TREE, "loomline.json": '{"live": ["c.ts"], "ignore": ["x/**"], "entries": {"hook": "hooks/"}}', ".loomlineignore": "# none\n\nold/**\n", "x/gone.ts": "", "old/o.ts": "let o = 1;", "hooks/h.ts": "let h = 1;", "x/p.ts": "let p = 1;", ".gitmodules": "[submodule]\n path = sub\n", "sub/s.ts": "let s = 1;", "y.ts": "let y = 1;"})
    files = read_tree(spark, str(tmp_path))
    options = options_of(files, report_generated=True)
    assert (options.live, options.ignore, options.entries, options.report_generated) == (["c.ts"], ["x/**", "old/**"], [("hook", "hooks/")], True)
    assert {r.path for r in scan(files).unreachable.collect()} == {"y.ts"}
    with pytest.raises(ValueError, match="lives"):
        options_of(files, lives=[])
