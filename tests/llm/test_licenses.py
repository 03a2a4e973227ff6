import re
from pathlib import Path

import duckdb
import pytest

from loomline.llm.licenses import MARKS, TEMPLATES, op6_license_scan, oracle, scan

SCHEMA = "path string, text string, license int, line string"
MIT = "Released under the MIT License."
GPL = "/* This work is licensed under the GNU\n * General Public License, version 3. */"


def test_inheritance_and_edges(spark):
    rows = [
        ("a/LICENSE", MIT, 1, ""), ("a/x.py", "print(1)", 1, ""), ("a/b/y.py", "no notice here", 1, ""), ("a/b/own.py", "code\n" + GPL + "\n" + "value = other * 3\n" * 40, 1, ""),
        ("a/b/c/COPYING.txt", "Licensed under the Apache License, Version 2.0", 0, None), ("a/b/c/d/z.py", None, 1, ""), ("q.py", "", 1, ""), (None, "w", 1, ""),
        ("a/x.py", "print(1)", 1, ""), ("e/long.py", "filler word " * 50000 + "\n" + MIT, 1, ""), ("e/f.py", "x", 1, ""), ("ab/x.py", "x", 0, ""),
    ]
    got = {(r.path, r.own_license, r.own_line, r.license, r.inherited_from) for r in scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {
        ("a/LICENSE", "MIT", 1, "MIT", None), ("a/x.py", None, None, "MIT", "a"), ("a/b/y.py", None, None, "MIT", "a"), ("a/b/own.py", "GPL-3.0", 2, "GPL-3.0", None),
        ("a/b/c/COPYING.txt", "Apache-2.0", 1, "Apache-2.0", None), ("a/b/c/d/z.py", None, None, "Apache-2.0", "a/b/c"), ("q.py", None, None, None, None), (None, None, None, None, None),
        ("e/long.py", "MIT", 2, "MIT", None), ("e/f.py", None, None, None, None), ("ab/x.py", None, None, None, None),
    }
    root = scan(spark.createDataFrame([("LICENSE", MIT, 1, ""), ("d/x", "x", 1, ""), ("y", "y", 1, "")], SCHEMA)).collect()
    assert {(r.path, r.license, r.inherited_from) for r in root} == {("LICENSE", "MIT", None), ("d/x", "MIT", ""), ("y", "MIT", "")}
    assert scan(spark.createDataFrame(rows, SCHEMA)).count() == len(rows) and scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_templates_have_marks():
    assert all(re.search(MARKS, t.lower()) for _, t in TEMPLATES)


def test_oracle(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet'")
    df = op6_license_scan(spark, d)
    assert df.columns == [c[0] for c in con.execute(oracle()).description]
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted((tuple(r) for r in df.collect()), key=key)
    assert got == sorted(con.execute(oracle()).fetchall(), key=key) and any(r[2] for r in got)
    assert not any(x in df._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Pandas", "Arrow"))


def test_versions_of_whole_licences(spark):
    """The licence texts that Debian installs, where there are any: none is taken for another version or licence."""
    folder = Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
    found = [(f"d{i}/LICENSE", (folder / n).read_text(errors="replace"), i, "") for i, n in enumerate(names) if (folder / n).exists()]
    if not found:
        pytest.skip("no licence texts here")
    got = {r.path: r.license for r in scan(spark.createDataFrame(found, SCHEMA)).collect()}
    want = {f"d{i}/LICENSE": v for i, (n, v) in enumerate(names.items()) if (folder / n).exists()}
    assert got == want
