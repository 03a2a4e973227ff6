import pytest

from loomline.plans.liveness import Options, edges, scan, without_references
from loomline.sources.tree import read_tree

TREE = {
    "package.json": '{"name": "p", "main": "dist/index.js", "bin": {"tool": "./bin/tool.js"}, "scripts": {"start": "node ops/start.js --port 1"}}',
    "src/index.ts": "import { a } from './lib/a';\nimport './side.js';\nexport * from './barrel';\n",
    "src/lib/a.ts": "import { b } from './b';\nexport function a() { return b; }\nexport const neverUsed = 1;\n",
    "src/lib/b.ts": "import { a } from './a';\nexport const b = () => eval('1');\n",
    "src/lib/orphan.ts": "import { a } from './a';\nexport const orphan = document.write('x');\n",
    "src/side.ts": "console.log('side');\n",
    "src/barrel/index.ts": "export { thing } from './thing';\n",
    "src/barrel/thing.ts": "export const thing = 1;\n",
    "src/view.vue": "<template/>\n<script>\nimport x from './lib/orphan2'\n</script>",
    "src/lib/orphan2.ts": "export default 1;\n",
    "src/generated/api.ts": "export const api = 1;\n",
    "src/keep.ts": "// DO NOT DELETE: loaded by hand\nexport const keep = 1;\n",
    "src/deprecated-main.ts": "import './lib/a';\n",
    "bin/tool.js": "require('../ops/helper');\n",
    "ops/start.js": "",
    "ops/helper.js": "module.exports = 1;\n",
    "web/index.html": '<script src="app.js"></script>',
    "web/app.js": "import('./lazy');\n",
    "web/lazy.js": "export default 1;\n",
    "pkg/__init__.py": "from .core import run\nfrom . import extra\n",
    "pkg/core.py": "import pkg.util, os\nfrom pkg.sub import (\n    deep as d,  # note\n    other,\n)\ndef run(): pass\n",
    "pkg/util.py": "x = 1\n",
    "pkg/extra.py": "x = 1\n",
    "pkg/sub/__init__.py": "",
    "pkg/sub/deep.py": "import pickle\npickle.loads(b'')\n",
    "pkg/sub/other.py": "y = 2\n",
    "pkg/unused.py": "z = 3\n",
    "run.py": "import pkg\nif __name__ == '__main__':\n    pkg.run()\n",
    "svc/src/main/java/com/x/App.java": "package com.x;\nimport com.x.dep.Dep;\nimport com.x.wild.*;\n@SpringBootApplication\nclass App {}\n",
    "svc/src/main/java/com/x/dep/Dep.java": "package com.x.dep;\npublic class Dep {}\n",
    "svc/src/main/java/com/x/wild/W.java": "package com.x.wild;\npublic class W {}\n",
    "svc/src/main/java/com/x/Near.java": "package com.x;\nclass Near {}\n",
    "svc/src/main/java/com/y/Far.java": "package com.y;\nclass Far {}\n",
    "go/cmd/tool/main.go": 'package main\nimport (\n\t"fmt"\n\tin "example.com/m/internal/y"\n)\nfunc main() {}\n',
    "go/internal/y/y.go": "package y\n",
    "go/internal/y/more.go": "package y\n",
    "go/internal/y/old_thing.go": "package y\n",
    "go/internal/z/z.go": "package z\n",
    "rs/src/main.rs": "mod one;\npub mod two;\nfn main() {}\n",
    "rs/src/one.rs": "mod inner;\n",
    "rs/src/one/inner.rs": "// x\n",
    "rs/src/two/mod.rs": "// x\n",
    "rs/src/three.rs": "// x\n",
    "src/auth/login.ts": "const password = 'hunter22';\nexport const weak = createHash('md5');\n",
    "node_modules/dep/index.js": "module.exports = 1;\n",
}
DEAD = {"src/lib/orphan.ts", "src/lib/orphan2.ts", "src/deprecated-main.ts", "src/view.vue", "pkg/unused.py", "svc/src/main/java/com/y/Far.java", "go/internal/z/z.go", "go/internal/y/old_thing.go", "rs/src/three.rs", "src/auth/login.ts"}


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in TREE.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return read_tree(spark, str(root)).cache()


def test_tree_has_names_that_spark_skips(files):
    got = {r.path: r.size for r in files.collect()}
    assert got == {k: len(v.encode()) for k, v in TREE.items() if not k.startswith("node_modules")}


def test_scan(files):
    report = scan(files)
    assert {r.path for r in report.unreachable.collect()} == DEAD
    reasons = {r.path: r.reason for r in report.entries.collect()}
    assert reasons["src/index.ts"] == "main" and reasons["bin/tool.js"] == "script" and reasons["ops/start.js"] == "script" and reasons["web/app.js"] == "html" and reasons["run.py"] == "python main"
    found = {(r.path, r.rule, r.severity, r.is_dead) for r in report.findings.collect()}
    assert found == {("src/lib/b.ts", "eval", "CRITICAL", False), ("src/lib/orphan.ts", "inner-html", "HIGH", True), ("pkg/sub/deep.py", "pickle", "HIGH", False), ("src/auth/login.ts", "secret-literal", "CRITICAL", True), ("src/auth/login.ts", "weak-hash", "HIGH", True)}
    assert ("src/lib/a.ts", "neverUsed") in {tuple(r) for r in report.unused_exports.collect()}
    one = report.summary.first()
    assert one.total == len(TREE) - 1 and one.unreachable == len(DEAD) and one.entry_points == len(reasons)


def test_options_and_empty_table(files):
    report = scan(files, Options(live=["pkg/unused.py"], ignore=["**/*.rs"], report_generated=True))
    assert {r.path for r in report.unreachable.collect()} == (DEAD - {"pkg/unused.py", "rs/src/three.rs"}) | {"src/generated/api.ts"}
    assert scan(files.limit(0)).summary.first() == (0, 0, 0, 0)


def test_lines_that_import_removed_files_go(spark, files):
    removed = spark.createDataFrame([("src/lib/b.ts",), ("src/barrel/thing.ts",)], "path string")
    got = {r.path: (r.content, r.n_dropped) for r in without_references(files.select("path", "content"), removed).collect()}
    assert got == {"src/lib/a.ts": ("export function a() { return b; }\nexport const neverUsed = 1;\n", 1), "src/barrel/index.ts": ("", 1)}


def test_aliases(spark):
    tree = {
        "tsconfig.json": '{"compilerOptions": {"baseUrl": ".", // not "a comment" in a string\n "paths": {"@/*": ["src/*"], "one": ["src/only.ts"],}, /* x */ }}',
        "packages/ui/package.json": '{"name": "@acme/ui"}',
        "packages/ui/tsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["./local/*"]}}}',
        "packages/ui/src/index.ts": "import '@/x';\n",
        "packages/ui/src/button.ts": "export const b = 1;\n",
        "packages/ui/local/x.ts": "export {};\n",
        "src/index.ts": "import { a } from '@/lib/a';\nimport '@acme/ui';\nimport '@acme/ui/button';\nimport 'shared/thing';\nimport 'one';\nimport 'react';\n",
        "src/lib/a.ts": "export const a = 1;\n",
        "src/x.ts": "export {};\n",
        "src/only.ts": "export {};\n",
        "shared/thing.ts": "export {};\n",
    }
    files = spark.createDataFrame([(k, v) for k, v in tree.items()], "path string, content string")
    assert {(r.src, r.dst) for r in edges(files).collect()} == {
        ("packages/ui/src/index.ts", "packages/ui/local/x.ts"),
        *(("src/index.ts", x) for x in ("src/lib/a.ts", "packages/ui/src/index.ts", "packages/ui/src/button.ts", "shared/thing.ts", "src/only.ts")),
    }


def test_types_and_frameworks(spark):
    tree = {
        "package.json": '{"dependencies": {"@nestjs/core": "10"}, "devDependencies": {"x": "1"}}',
        "api/user.controller.ts": "import './user';\n",
        "api/user.ts": "export {};\n",
        "api/store/x.ts": "export {};\n",
        "App/Program.cs": "namespace App;\nvar w = new Worker();\n",
        "Lib/Worker.cs": "namespace Lib.A;\npublic class Worker : Base {}\n",
        "Lib/Base.cs": "namespace Lib.B;\npublic class Base {}\n",
        "Lib/Near.cs": "namespace Lib.B;\nclass Near {}\n",
        "Lib/Unused.cs": "namespace Lib.C;\nclass Unused { Worker w; }\n",
    }
    files = spark.createDataFrame([(k, v, len(v)) for k, v in tree.items()], "path string, content string, size long")
    report = scan(files)
    assert {r.path for r in report.unreachable.collect()} == {"Lib/Unused.cs", "api/store/x.ts"}
    assert {r.path: r.reason for r in report.entries.collect()} == {"api/user.controller.ts": "framework nestjs", "App/Program.cs": "main"}
