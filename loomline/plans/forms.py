"""More trees written from the given tables: nested forms of each language, rules and frameworks, packages, roots and rescans, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.blocks import members, struct_tags
from loomline.functions.languages import category
from loomline.plans import liveness, manifests, review, tables
from loomline.plans.catalogue import table
from loomline.plans.entry_rules import FRAMEWORKS, TOOLS, braces, rule_entries, rules
from loomline.plans.trees import ORACLES, QUERIES, graph_edges, query, tree

__all__ = ["ORACLES", "QUERIES"]

# What encloses what: a text for each part, with decoys in comments and strings, and more of it for even ones.
# By language: file, text, more, and what is declared in each: (owner, name, kind, marks). A sign stands for the part's number.

PYTHON = '''"""class No:
    def no(self): pass
"""
import os  # def no(): pass

@dec.first
@second
class A~:
    \'\'\'def no(): pass\'\'\'
    @property
    def one(self):
        def inner(): pass
        return "def no(): {"

    class B(A):
        async def two(self): pass

def top~(): pass
'''
JAVASCRIPT = """// class No {
/* class No { */
@Injectable()
export class A~ extends Base {
  text = '}'; more = `class No { ${1} }`;
  @Get('/x') one(a: string): Promise<void> { if (a) { call(a); } for (const x of y) {} }
  static two() { return function inner() { return 1; } }
}
function top~() { while (true) {} }
"""
JAVA = """/* class No { */
@Service
public class A~ {
  // class No {
  String s = "}"; char c = '{';
  @Override public void one(int a) throws X { while (true) { synchronized (this) { } } }
  static class B { int two() { return 1; } }
}
"""
KOTLIN = """// class No {
class A~ {
  val s = "{"
  fun one() = 1
  object B {
    @JvmStatic fun two() { if (x) { } }
  }
}
fun top~() {}
"""
CSHARP = """namespace N.M {
  // class No {
  [Api]
  public class A~ {
    string s = "}";
    [HttpGet]
    public int One(int x) { using (var y = z) { } return 1; }
  }
}
"""
GO = """package a
// func No() {}
type A~ struct {
	X int
}
/*
func No() {}
*/
func (a *A~) One() { if x { } }
func Top~() {}
"""
RUST = """// mod no;
mod a~ { /* } */ pub mod one; mod two { mod three; const C: char = '{'; } }
mod four;
#[derive(Debug)] struct S<'a>;
impl<'a> Tr for S<'a> { fn m(&self) { let s = "}"; } }
"""
_DEEP = [("", "C", "type", ""), ("C", "D", "type", ""), ("C.D", "E", "type", "")]
NESTED = {
    "python": ("m.py", PYTHON, "class C:\n\tclass D:\n\t\tclass E:\n\t\t\tdef deep(self): pass\n", [("", "A~", "type", "dec.first,second"), ("A~", "one", "callable", "property"), ("A~.one", "inner", "callable", ""), ("A~", "B", "type", ""), ("A~.B", "two", "callable", ""), ("", "top~", "callable", "")], [*_DEEP, ("C.D.E", "deep", "callable", "")]),
    "javascript": ("m.ts", JAVASCRIPT, "class C { m() { class D { deep() {} } } }\n", [("", "A~", "type", "Injectable"), ("A~", "one", "callable", "Get"), ("A~", "two", "callable", ""), ("A~", "inner", "callable", ""), ("", "top~", "callable", "")], [("", "C", "type", ""), ("C", "m", "callable", ""), ("C", "D", "type", ""), ("C.D", "deep", "callable", "")]),
    "java": ("A.java", JAVA, "interface C { class D { enum E { X; void deep() { } } } }\n", [("", "A~", "type", "Service"), ("A~", "one", "callable", "Override"), ("A~", "B", "type", ""), ("A~.B", "two", "callable", "")], [*_DEEP, ("C.D.E", "deep", "callable", "")]),
    "kotlin": ("a.kt", KOTLIN, "class C { class D { class E { fun deep() {} } } }\n", [("", "A~", "type", ""), ("A~", "one", "callable", ""), ("A~", "B", "type", ""), ("A~.B", "two", "callable", "JvmStatic"), ("", "top~", "callable", "")], [*_DEEP, ("C.D.E", "deep", "callable", "")]),
    "csharp": ("A.cs", CSHARP, "class C { struct D { record E { void Deep() { } } } }\n", [("N.M", "A~", "type", "Api"), ("N.M.A~", "One", "callable", "HttpGet")], [*_DEEP, ("C.D.E", "Deep", "callable", "")]),
    "go": ("a.go", GO, "type C interface{}\nfunc (C) Deep() {}\n", [("", "A~", "type", ""), ("A~", "One", "callable", ""), ("", "Top~", "callable", "")], [("", "C", "type", ""), ("C", "Deep", "callable", "")]),
    "rust": ("a.rs", RUST, "mod x { mod y { mod z { mod deep; } } }\n", [("", "a~", "block", ""), ("a~", "one", "module", ""), ("a~", "two", "block", ""), ("a~.two", "three", "module", ""), ("", "four", "module", ""), ("", "S", "type", "derive"), ("S", "m", "callable", "")], [("", "x", "block", ""), ("x", "y", "block", ""), ("x.y", "z", "block", ""), ("x.y.z", "deep", "module", "")]),
}


def _numbered(text: str):
    return F.replace(F.lit(text), F.lit("~"), F.col("p_partkey").cast("string"))


def _nested(lang: str) -> None:
    name, text, more, always, even = NESTED[lang]

    def rows(found: list[tuple], where: str) -> str:
        values = ", ".join(f"('{o}', '{n}', '{k}', '{m}')" for o, n, k, m in found)
        number = "CAST(p_partkey AS varchar)"
        return f"SELECT 'p' || p_partkey || '/{name}' AS path, replace(o, '~', {number}) AS owner, replace(n, '~', {number}) AS name, k AS kind, m AS marks FROM part, (VALUES {values}) t(o, n, k, m) {where}"

    def run(spark: SparkSession, d: str) -> DataFrame:
        content = F.concat(_numbered(text), F.when(F.col("p_partkey") % 2 == 0, more).otherwise(""))
        files = table(spark, d, "part").select(F.expr(f"concat('p', p_partkey, '/{name}')").alias("path"), content.alias("content"))
        return members(tree(files)).withColumn("marks", F.array_join("marks", ","))

    run.__name__, run.__doc__ = f"t{62 + list(NESTED).index(lang)}_{lang}_members", "What a text declares and what encloses it; comments and strings hold decoys."
    query(f"{rows(always, '')} UNION ALL {rows(even, 'WHERE p_partkey % 2 = 0')}")(run)


for _lang in NESTED:
    _nested(_lang)


@query("SELECT 'src/p' || p_partkey || '.rs' AS src, 'src/p' || p_partkey || x AS dst FROM part, (VALUES ('/a/one.rs'), ('/a/b/two/mod.rs'), ('/three.rs')) t(x)")
def t69_inline_modules(spark, d):
    """Files of modules within inline ones lie in folders named like these."""
    part = table(spark, d, "part").selectExpr("concat('src/p', p_partkey) as home")
    text = "pub mod a {\n  mod one;\n  pub(crate) mod b { // mod no;\n    mod two;\n  }\n}\nmod three;\n"
    made = [part.select(F.concat("home", F.lit(".rs")).alias("path"), F.lit(text).alias("content"))]
    made += [part.select(F.concat("home", F.lit(x)).alias("path"), F.lit("// mod b;").alias("content")) for x in ("/a/one.rs", "/a/b/two/mod.rs", "/three.rs", "/one.rs", "/two.rs", "/no.rs", "/a/no.rs")]
    return graph_edges(tree(*made))


@query("SELECT 'p' || p_partkey || '.go' AS path, f AS field, k AS key, replace(v, '~', CAST(p_partkey AS varchar)) AS value FROM part, (VALUES ('Name', 'json', 'name~,omitempty'), ('Name', 'db', 'n'), ('Size', 'json', '-')) t(f, k, v)")
def t70_struct_tags(spark, d):
    """Tags of fields of structures in Go."""
    text = 'package p\n\ntype T struct {\n\tName string `json:"name~,omitempty" db:"n"`\n\t// Gone string `json:"gone"`\n\tSize int `json:"-"`\n\tBare int\n}\n'
    return struct_tags(tree(table(spark, d, "part").select(F.expr("concat('p', p_partkey, '.go')").alias("path"), _numbered(text).alias("content"))))


# Entry points by rules: paths made of the rules' own globs, which SQL tries one by one on every path.

def ruled(spark: SparkSession, d: str) -> DataFrame:
    """A path for each page and each of a rule's globs in turn, and one for each part that nearly matches."""
    globs = [(i, g.replace("**/", "w/").replace("**", "w/x.ts").replace("*", "x")) for i, g in enumerate(g for *_, gs in [(k, v) for k, v in TOOLS.items()] + [(k, v[1]) for k, v in FRAMEWORKS.items()] for x in gs for g in braces(x))]
    made = spark.createDataFrame(globs, "i long, name string")
    page = table(spark, d, "pages").select((F.col("page_id") * 7 % len(globs)).alias("i"), F.regexp_extract("url", r"^https?://[^/]*/?([^?#]*)", 1).alias("at"))
    # Broadcast: as many rows as the rules have globs.
    hit = page.join(F.broadcast(made), "i").select(F.concat(F.regexp_replace(F.col("at"), r"[^\w/]", ""), F.lit("/d"), "i", F.lit("/"), "name").alias("path"))
    near = table(spark, d, "part").select((F.col("p_partkey") % len(globs)).alias("i"), "p_partkey").join(F.broadcast(made), "i").select(F.concat(F.lit("p"), "p_partkey", F.lit("/"), F.regexp_replace("name", r"(\w)(\.\w+)\z", "$1q$2")).alias("path"))
    return tree(hit.union(near).distinct().withColumn("content", F.lit("x")))


def _sql_rules() -> str:
    rows = ", ".join(f"({rank}, '{reason}', '{pattern.replace(chr(39), chr(39) * 2)}', {'true' if packages else 'false'})" for rank, reason, _, pattern, packages in rules())
    names = " ".join(f"WHEN {i} THEN '{g}'" for i, g in enumerate(g.replace("**/", "w/").replace("**", "w/x.ts").replace("*", "x") for gs in [*TOOLS.values(), *(v[1] for v in FRAMEWORKS.values())] for x in gs for g in braces(x)))
    n = names.count("WHEN ")
    return rf"""
    WITH r(rank, reason, pattern, bound) AS (VALUES {rows}),
    p AS (SELECT DISTINCT regexp_replace(regexp_extract(url, '^https?://[^/]*/?([^?#]*)', 1), '[^A-Za-z0-9_/]', '', 'g') || '/d' || page_id * 7 % {n} || '/' || CASE page_id * 7 % {n} {names} END AS path FROM pages
      UNION SELECT 'p' || p_partkey || '/' || regexp_replace(CASE p_partkey % {n} {names} END, '(\w)(\.\w+)$', '\1q\2') FROM part)
    SELECT path, min_by(reason, rank) AS reason FROM p JOIN r ON NOT bound AND regexp_matches(path, pattern)
    WHERE regexp_matches(path, '\.(js|jsx|mjs|cjs|ts|tsx|mts|cts|vue|svelte|py|pyi|java|kt|kts|go|rs|cs)$') GROUP BY 1"""


@query(_sql_rules())
def t71_ruled_entries(spark, d):
    """Entry points by hundreds of globs, of which each path meets those only that share a literal with it; the first one gives the reason."""
    return rule_entries(ruled(spark, d))


@query("""
WITH s AS (SELECT s_suppkey AS k, s_suppkey % 4 AS kind, 'packages/s' || s_suppkey AS home FROM supplier),
t(kind, name, reason) AS (VALUES (0, 'pages/a.tsx', 'framework next'), (0, 'middleware.ts', 'framework next'), (1, 'pages/a.tsx', 'framework nuxt'), (1, 'middleware/m.ts', 'framework nuxt'), (2, 'u.guard.ts', 'framework nestjs'), (2, 'inner/src/pages/b.tsx', 'framework gatsby'))
SELECT home || '/' || name AS path, reason FROM s JOIN t USING (kind)""")
def t72_frameworks_by_package(spark, d):
    """Equal paths in packages of different frameworks, known by manifests and by a configuration; a package within one has its own."""
    supplier = table(spark, d, "supplier").selectExpr("s_suppkey % 4 as kind", "concat('packages/s', s_suppkey) as home")
    depends = """case kind when 0 then '{"dependencies": {"next": "1"}}' when 2 then '{"devDependencies": {"@nestjs/core": "1"}}' else '{}' end"""
    made = [supplier.selectExpr("concat(home, '/package.json') as path", f"{depends} as content")]
    made += [supplier.where("kind = 1").selectExpr("concat(home, '/nuxt.config.ts') as path", "'' as content"), supplier.where("kind = 2").selectExpr("concat(home, '/inner/package.json') as path", """'{"dependencies": {"gatsby": "1"}}' as content""")]
    names = {"pages/a.tsx": 4, "middleware.ts": 4, "middleware/m.ts": 4, "u.guard.ts": 4, "inner/pages/a.tsx": 2, "inner/src/pages/b.tsx": 2}
    made += [supplier.where(f"kind = {kind} or {kind} = 4").selectExpr(f"concat(home, '/{n}') as path", "'x' as content") for n, kind in names.items()]
    return rule_entries(tree(*made))


# Packages that only use each other, and classes that two roots offer.

@query("""
WITH RECURSIVE s AS (SELECT s_suppkey AS k, s_suppkey // 5 AS g FROM supplier), ring AS (SELECT g, min(k) AS first, max(k) AS last FROM s GROUP BY 1),
e AS (SELECT k AS a, CASE WHEN k < last THEN k + 1 ELSE first END AS b FROM s JOIN ring USING (g) WHERE g % 3 < 2),
pairs AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
live(k) AS (SELECT k FROM s WHERE g % 3 = 1 AND k % 5 = 0 OR g % 3 = 2 AND (k % 2 = 0 OR k % 7 = 0) UNION SELECT b FROM live JOIN pairs ON a = k)
SELECT 'packages/s' || k AS dir FROM s WHERE k NOT IN (SELECT k FROM live)""")
def t73_abandoned_packages(spark, d):
    """Packages that nobody uses and nobody publishes, alone or in rings; what code of the tree imports is used."""
    rows = table(spark, d, "supplier").selectExpr("s_suppkey as k", "floor(s_suppkey / 5) as g")
    ring = rows.join(rows.groupBy("g").agg(F.min("k").alias("first"), F.max("k").alias("last")), "g")
    depends = "case when g % 3 < 2 then concat(', \"dependencies\": {\"@r/s', case when k < last then k + 1 else first end, '\": \"1\"}') else '' end"
    main = "case when g % 3 = 1 and k % 5 = 0 then ', \"main\": \"x.js\"' else '' end"
    made = [ring.selectExpr("concat('packages/s', k, '/package.json') as path", f"concat('{{\"name\": \"@r/s', k, '\"', {depends}, {main}, '}}') as content")]
    made += [ring.where("g % 3 = 2 and k % 2 = 0").selectExpr("concat('apps/a', k, '.ts') as path", "concat(\"import '@r/s\", k, \"/deep/x';\") as content"), ring.where("g % 3 = 2 and k % 7 = 0").selectExpr("concat('packages/s', k, '/pyproject.toml') as path", "'' as content")]
    root = spark.createDataFrame([("package.json", '{"private": true}')], "path string, content string")
    return manifests.abandoned(tree(*made, root))


SQL_ROOTS = "s AS (SELECT s_suppkey AS k, s_suppkey % 4 AS kind FROM supplier)"


@query(f"""WITH {SQL_ROOTS}
SELECT 'use/U' || k || '.java' AS src, CASE kind WHEN 1 THEN 'lib/java/S' || k || '.java' WHEN 3 THEN 'core/src/main/java/org/m' || k || '/S' || k || '.java' ELSE 'core/src/main/java/org/n' || k || '/S' || k || '.java' END AS dst FROM s WHERE k % 8 <> 7""")
def t74_declared_classes(spark, d):
    """Imports meet declared packages before paths, then names of classes, unless several files have one."""
    s = table(spark, d, "supplier").selectExpr("s_suppkey as k", "s_suppkey % 4 as kind")
    made = [
        s.selectExpr("concat('use/U', k, '.java') as path", "concat('package u', k, ';\\nimport ', case when kind = 3 then 'gone.away' else concat('org.n', k) end, '.S', k, ';\\nimport java.util.List;\\nclass U', k, ' {}\\n') as content"),
        s.where("kind in (0, 2)").selectExpr("concat('core/src/main/java/org/n', k, '/S', k, '.java') as path", "concat('package org.n', k, ';\\npublic class S', k, ' {}\\n') as content"),
        s.where("kind = 1").selectExpr("concat('lib/java/S', k, '.java') as path", "concat('package org.n', k, ';\\npublic class S', k, ' {}\\n') as content"),
        s.where("kind = 2").selectExpr("concat('old/java/org/n', k, '/S', k, '.java') as path", "concat('package attic.n', k, ';\\npublic class S', k, ' {}\\n') as content"),
        s.where("kind = 3").selectExpr("concat('core/src/main/java/org/m', k, '/S', k, '.java') as path", "concat('package org.m', k, ';\\npublic class S', k, ' {}\\n') as content"),
        s.where("k % 8 = 7").selectExpr("concat('more/java/org/o', k, '/S', k, '.java') as path", "concat('package org.o', k, ';\\npublic class S', k, ' {}\\n') as content"),
    ]
    return graph_edges(tree(*made))


@query(f"""WITH {SQL_ROOTS}
SELECT 'core/src/main/java' AS root, count(*) AS votes FROM s WHERE kind <> 1 UNION ALL SELECT 'more/java', count(*) FROM s WHERE k % 8 = 7 UNION ALL SELECT 'lib/kt', count(*) FROM s WHERE kind = 1""")
def t75_source_roots(spark, d):
    """Folders below which paths are what packages say, by votes; files that say something else have none."""
    s = table(spark, d, "supplier").selectExpr("s_suppkey as k", "s_suppkey % 4 as kind")
    path = "case when k % 8 = 7 then concat('more/java/org/o', k, '/T', k, '.java') when kind = 1 then concat('lib/kt/org/p', k, '/S', k, '.kt') else concat('core/none/S', k, '.java') end"
    odd = s.where("kind = 1 or kind = 0 or k % 8 = 7").selectExpr(f"{path} as path", "concat('package org.', case when k % 8 = 7 then 'o' else 'p' end, k, '\\n') as content")
    usual = s.where("kind <> 1").selectExpr("concat('core/src/main/java/org/n', k, '/S', k, '.java') as path", "concat('package org.n', k, ';\\n') as content")
    return liveness.source_roots(tree(odd, usual))


@query("""
WITH e AS (SELECT user_id AS u, event_type AS t, min(ts) AS first FROM events GROUP BY ALL), half AS (SELECT min(ts) + (max(ts) - min(ts)) / 50 AS h FROM events),
v AS (SELECT u, string_agg(t, ',' ORDER BY t) FILTER (first <= h) AS old, string_agg(t, ',' ORDER BY t) AS new FROM e, half GROUP BY u)
SELECT 'u' || u || '.ts' AS path, './' || t AS module, coalesce(old = new, false) AS unchanged FROM e JOIN v USING (u) WHERE u % 10 <> 0""")
def t76_rescan(spark, d):
    """Two versions of a tree: files of the second that the first has as they are keep their facts, others are searched anew, and some went."""
    events = table(spark, d, "events")
    half = events.agg((F.min("ts") + (F.max("ts") - F.min("ts")) / 50).alias("h"))
    text = F.array_join(F.transform(F.sort_array(F.collect_set("event_type")), lambda t: F.concat(F.lit("import './"), t, F.lit("';"))), "\n")

    def version(rows: DataFrame) -> DataFrame:
        return tree(rows.groupBy("user_id").agg(text.alias("content")).select(F.expr("concat('u', user_id, '.ts')").alias("path"), "content"))

    # One row, broadcast.
    old = tables.written(tables.extracted(version(events.join(F.broadcast(half), F.col("ts") <= F.col("h"))), ["references"]))
    new = tables.written(tables.refreshed(old.withColumn("modified", F.lit(1.0)), version(events.where("user_id % 10 <> 0"))))
    return new.select("path", F.inline("fact_references"), F.col("modified").isNotNull().alias("unchanged")).drop("kind")


# A risky line for each rule, and one that only looks like it: file's end, line, near miss.

RISKS = {
    "private-key": ("py", 'k = "-----BEGIN RSA PRIVATE KEY-----"', 'k = "-----BEGIN RSA PUBLIC KEY-----"'),
    "provider-token": ("go", 't := "glpat-0123456789abcdefghij"', 't := "glpat-0123"'),
    "secret-literal": ("ts", 'const apiKey = "abcdef123";', "const apiKey = env.apiKey;"),
    "eval py": ("py", "x = eval(y)", "x = model.eval(y)"),
    "process py": ("py", "os.system(cmd)", "os.path(cmd)"),
    "pickle": ("py", "pickle.loads(b)", "json.loads(b)"),
    "yaml-load": ("py", "yaml.load(f)", "yaml.load(f, Loader=SafeLoader)"),
    "sql-text py": ("py", 'cur.execute("SELECT 1 WHERE a = " + x)', 'cur.execute("SELECT 1 WHERE a = ?", x)'),
    "unverified py": ("py", "get(u, verify=False)", "get(u, verify=True)"),
    "temporary-name": ("py", "tempfile.mktemp()", "tempfile.mkstemp()"),
    "eval js": ("js", "new Function(x)", "new Functional(x)"),
    "process js": ("js", "exec(`ls ${x}`)", "exec('ls')"),
    "inner-html": ("js", "a.innerHTML = b", "a.innerHTML == b"),
    "request-path": ("js", "readFile(req.query.f)", "readFile(name)"),
    "request-url": ("js", "fetch(req.query.u)", "fetch(url)"),
    "sql-text js": ("js", "db.query(`select ${x}`)", "db.query(`select 1`)"),
    "weak-random": ("js", "const token = Math.random()", "const place = Math.random()"),
    "told-error": ("js", "res.send(err.message)", "res.send(message)"),
    "logged-secret": ("js", "console.log(user.password)", "console.log(user.name)"),
    "process go": ("go", 'exec.Command("sh", "-c", x)', 'exec.Command("ls")'),
    "unverified go": ("go", "InsecureSkipVerify: true", "InsecureSkipVerify: false"),
    "process jvm": ("java", "rt.exec(a + b);", "rt.exec(a);"),
    "object-stream jvm": ("kt", "XMLDecoder(s)", "XMLEncoder(s)"),
    "sql-text jvm": ("java", 'st.executeQuery("select " + x);', 'st.executeQuery("select 1");'),
    "object-stream cs": ("cs", "var f = new BinaryFormatter();", "var f = new JsonFormatter();"),
    "unsafe": ("rs", "unsafe { go() }", "unsafely { go() }"),
    "weak-hash": ("ts", "createHash('md5')", "createHash('sha256')"),
    "weak-cipher": ("ts", "createCipher('des-ede3-cbc', k)", "createCipher('aes-256-gcm', k)"),
}
_RISKY = [(i, name.split()[0], end, line, near) for i, (name, (end, line, near)) in enumerate(RISKS.items())]


def _levels() -> str:
    """The level and weakness of each rule in RISKS, as the library's table has them."""
    rows = []
    for i, name, end, *_ in _RISKY:
        lang = {"py": "python", "js": "javascript", "ts": "javascript", "go": "go", "java": "java", "kt": "kotlin", "cs": "csharp", "rs": "rust"}[end]
        rule = next(r for r in liveness.CODE_RULES if r.id == name and (not r.languages or lang in r.languages))
        rows.append(f"({i}, '{name}', '{end}', '{rule.severity}', '{rule.group}')")
    return ", ".join(rows)


@query(f"""WITH t(i, rule, e, severity, rule_group) AS (VALUES {_levels()})
SELECT 'x/o' || o_orderkey || '.' || e AS path, 2::BIGINT AS line_no, rule, severity, rule_group FROM orders JOIN t ON o_orderkey % {len(RISKS)} = i""")
def t77_every_rule(spark, d):
    """A line that each rule finds, after one that only looks like it."""
    kinds = spark.createDataFrame([(i, end, f"{near}\n{line}\n") for i, _, end, line, near in _RISKY], "i int, e string, content string")
    # Broadcast: a row for each rule.
    made = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % len(RISKS)).cast("int").alias("i")).join(F.broadcast(kinds), "i")
    files = tree(made.selectExpr("concat('x/o', o_orderkey, '.', e) as path", "content"))
    return tables.extracted(files, ["findings"]).select("path", F.inline("fact_findings")).drop("line")


KEPT_TEXTS = [("// DO NOT DELETE", True), ("# do  not remove", True), ("/* Keep this file */", True), ("/** @preserve */", True), ("// do not", False), ("// keep these files", False), ("// @preserved", False)]
GENERATED_PATHS = [("generated/a.ts", True), ("x/__generated__/a.ts", True), ("codegen/a.py", True), ("a.g.cs", True), ("b/graphql.ts", True), ("m_pb2.py", True), ("m.pb.go", True), ("Item_.java", True), ("F.Designer.cs", True), ("Migrations/M.cs", True), ("mocks/m.go", True), ("kind_string.go", True), ("x/mock_a.go", True), (".next/a.js", True), ("a/degenerated/b.ts", False), ("Designer.cs", False), ("graphql2.ts", False), ("pb2.py", False), ("mocks/m.ts", False)]


@query(f"""WITH k(i, kept) AS (VALUES {", ".join(f"({i}, {x})" for i, (_, x) in enumerate(KEPT_TEXTS))}), g(j, path, made) AS (VALUES {", ".join(f"({i}, '{p}', {x})" for i, (p, x) in enumerate(GENERATED_PATHS))})
SELECT c_custkey, kept, made AS generated FROM customer JOIN k ON c_custkey % {len(KEPT_TEXTS)} = i JOIN g ON c_custkey % {len(GENERATED_PATHS)} = j""")
def t78_kept_and_generated(spark, d):
    """Files that ask to stay, and files that generators write, by text and path, with near misses."""
    texts, paths = (F.array(*(F.lit(x) for x, _ in some)) for some in (KEPT_TEXTS, GENERATED_PATHS))
    files = table(spark, d, "customer").select("c_custkey", F.get(paths, (F.col("c_custkey") % len(GENERATED_PATHS)).cast("int")).alias("path"), F.get(texts, (F.col("c_custkey") % len(KEPT_TEXTS)).cast("int")).alias("content"))
    return files.select("c_custkey", F.col("content").rlike(liveness.KEEP).alias("kept"), liveness.generated_path(F.col("path")).alias("generated"))


CATEGORIES = [("a.ts", "javascript"), ("b.pyi", "python"), ("C.java", "java"), ("d.kts", "kotlin"), ("e.cs", "csharp"), ("f.go", "go"), ("g.rs", "rust"), ("h.SCSS", "css"), ("i.woff2", "assets"), ("j", "other"), (".css", "other"), ("k.js.map", "other")]


@query(f"""WITH t(i, category) AS (VALUES {", ".join(f"({i}, '{c}')" for i, (_, c) in enumerate(CATEGORIES))})
SELECT category, count(*) AS n_files, sum(p_size)::BIGINT AS size FROM part JOIN t ON p_partkey % {len(CATEGORIES)} = i GROUP BY 1""")
def t79_categories(spark, d):
    """Files and their sizes by category."""
    name = F.get(F.array(*(F.lit(n) for n, _ in CATEGORIES)), (F.col("p_partkey") % len(CATEGORIES)).cast("int"))
    return table(spark, d, "part").groupBy(category(name).alias("category")).agg(F.count("*").alias("n_files"), F.sum("p_size").cast("long").alias("size"))


MARKED = [a for some in liveness.ANNOTATIONS.values() for a in some]


@query(f"""WITH n AS (SELECT c_custkey AS k, c_custkey % {2 * len(set(MARKED))} AS i FROM customer) SELECT 'c' || k || '/A.java' AS path, 'annotation' AS reason FROM n WHERE i < {len(set(MARKED))}""")
def t80_annotations(spark, d):
    """Classes that frameworks find by an annotation; longer names that begin like one aren't."""
    names = list(dict.fromkeys(MARKED))
    every = F.array(*(F.lit(f"@{n}\nclass A {{}}\n") for n in names), *(F.lit(f"// @{n}\n@{n}Extra\nclass A {{}}\n") for n in names))
    files = table(spark, d, "customer").select(F.expr("concat('c', c_custkey, '/A.java')").alias("path"), F.get(every, (F.col("c_custkey") % (2 * len(names))).cast("int")).alias("content"))
    return liveness.entries(tree(files))


@query("""
WITH u AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_linenumber <= 2), n AS (SELECT s, count(*) AS live FROM u GROUP BY 1)
SELECT count(*) AS n_files, sum(2)::BIGINT AS n_names FROM n JOIN supplier ON s = s_suppkey""")
def t81_dead_names(spark, d):
    """How many files have names that nothing takes, and how many such names there are."""
    line = table(spark, d, "lineitem").where("l_linenumber <= 2").select("l_partkey", "l_suppkey").distinct()
    users = line.groupBy("l_partkey").agg(F.array_join(F.collect_list(F.expr("concat('import { a', l_suppkey, \" } from './s\", l_suppkey, \"';\")")), "\n").alias("content")).select(F.expr("concat('p', l_partkey, '.ts')").alias("path"), "content")
    made = table(spark, d, "supplier").selectExpr("concat('s', s_suppkey, '.ts') as path", "concat('export const a', s_suppkey, ' = 1;\\nexport const b = 1;\\n// export const no = 1;\\nexport class C {}\\n') as content")
    files = tree(users, made)
    none = files.limit(0).select("path")
    return review.dead_names(review.partly_dead(files, files.select(F.col("path").alias("node")), none))
