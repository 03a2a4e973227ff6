"""From a table of source files to what is reachable from entry points, what is not, and what looks risky."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.facts import CODE, LANG, fact, of, told
from loomline.functions.paths import ancestors, basename, dirname, glob_regex, matches_any, normalise, prefixes
from loomline.functions.references import KEY_KINDS, exports, file_keys, language, references, with_keys
from loomline.operators import graph, rules
from loomline.operators.lineage import cut, written
from loomline.operators.rules import Rule
from loomline.plans import configs, manifests
from loomline.plans.entry_rules import nearest, rule_entries
from loomline.plans.tables import gathered

#: Why a path is an entry point; the first that matches is the reason.
ENTRY_PATHS = [
    ("test", r"(?:^|/)(?:tests?|__tests__|specs?|e2e|benches)/|[._-](?:test|spec)\.[a-z]+\z|(?:^|/)test_[^/]*\.py\z|_test\.go\z|(?:^|/)conftest\.py\z|Tests?\.(?:java|kt|cs)\z"),
    ("config", r"(?:^|/)[^/]*\.(?:config|conf|setup)\.[cm]?[jt]sx?\z|(?:^|/)(?:setup|settings|manage|wsgi|asgi)\.py\z|(?:^|/)build\.rs\z|\.gradle\.kts\z"),
    ("declaration", r"\.d\.[cm]?ts\z|\.pyi\z"),
    ("main", r"^(?:src/|app/|server/|client/)?(?:main|index|app|server|cli)\.[a-z]+\z|(?:^|/)src/(?:main|lib)\.rs\z|(?:^|/)src/bin/[^/]+\.rs\z|(?:^|/)__main__\.py\z|(?:^|/)Program\.cs\z|(?:^|/)Startup\.cs\z"),
    ("script", r"^(?:bin|scripts|tools|examples|benchmarks|docs)/"),
    ("route", r"(?:^|/)(?:pages|routes)/[^_][^/]*\.[jt]sx?\z|(?:^|/)app/(?:.*/)?(?:page|layout|route|loading|error)\.[jt]sx?\z"),
    ("migration", r"(?:^|/)migrations?/"),
    ("story", r"\.stories\.[jt]sx?\z"),
]
#: Annotations by which frameworks of Java and Kotlin find a class.
ANNOTATIONS = {
    "spring": ["SpringBootApplication", "RestController", "Controller", "Service", "Component", "Configuration", "Repository", "Bean", "Aspect", "ControllerAdvice", "RestControllerAdvice", "EnableAutoConfiguration", "Import", "ComponentScan"],
    "cdi": ["ApplicationScoped", "RequestScoped", "SessionScoped", "Dependent", "Singleton", "Named", "Startup", "Stateless", "Stateful", "MessageDriven"],
    "quarkus": ["QuarkusMain", "QuarkusTest", "QuarkusIntegrationTest", "BuildStep", "BuildSteps", "Recorder", "TargetClass", "Substitute"],
    "persistence": ["Entity", "MappedSuperclass", "Embeddable", "Converter"],
    "web": ["Path", "Provider", "ApplicationPath", "WebServlet", "WebFilter", "WebListener"],
    "tests": ["Test", "ParameterizedTest", "TestMethodOrder", "TestInstance", "ExtendWith", "SpringBootTest", "WebMvcTest", "DataJpaTest"],
}
ANNOTATED = rf"(?m)^\s*@(?:\w+\.)*(?:{'|'.join(dict.fromkeys(a for some in ANNOTATIONS.values() for a in some))})\b"
#: Why a text makes its file an entry point.
ENTRY_TEXTS = [
    ("python main", "python", r"""if\s+__name__\s*==\s*['"]__main__['"]"""),
    ("python task", "python", r"(?m)^\s*@(?:\w+\.)*(?:shared_task|task)\b"),
    ("go main", "go", r"(?m)^func\s+(?:main|init)\s*\(\s*\)"),
    ("rust main", "rust", r"(?m)^\s*(?:async\s+)?fn\s+main\s*\("),
    ("jvm main", "java", r"public\s+static\s+void\s+main\s*\("),
    ("jvm main", "kotlin", r"(?m)^\s*fun\s+main\s*\("),
    ("annotation", "java", ANNOTATED),
    ("annotation", "kotlin", ANNOTATED),
    ("injected", "javascript", r"(?m)^\s*@(?:Injectable|Controller|Module|Component|Resolver|Entity)\s*\("),
]
#: Words before a file's name by which people say that it is out of use; such files are no entry points, and a folder's name doesn't stand for them.
SET_ASIDE = ["abandoned", "dead", "deprecated", "legacy", "obsolete", "old", "retired", "superseded", "unused"]


def set_aside(path: Column, words: list[str]) -> Column:
    """Whether a file's name begins with one of the words and a dash or underscore, or is `dead`."""
    return path.rlike(rf"(?i)(?:^|/)(?:(?:{'|'.join(map(re.escape, words))})[-_][^/]*|dead\.[^/]*)\z") if words else F.lit(False)


#: Where and under what names generators put what they make, what their files say first, and by what people ask for a file to stay.
GENERATED_FOLDERS = {
    "generators": ["generated", "__generated__", "codegen", "__graphql__", "api-client", "swagger-client", "mocks/*.go"],
    "builds": ["target/generated-sources", "target/generated-test-sources", "build", "dist", "out", "output", "obj", ".next", ".nuxt", ".output", "bazel-bin", "bazel-out", "bazel-testlogs"],
    "dependencies": ["node_modules", "vendor"],
    "migrations": ["Migrations/*.cs"],
}
GENERATED_NAMES = ["*.generated.*", "*.gen.*", "*.g.ts", "*.g.js", "graphql.{ts,tsx,js}", "gql.{ts,tsx,js}", "*.graphql.{ts,tsx,js}", "*_pb.js", "*_pb.d.ts", "*_pb2.py", "*_pb2_grpc.py", "*.pb.*", "*_.java", "*.Designer.cs", "*.g.cs", "*.g.i.cs", "*.AssemblyAttributes.cs", "*GlobalSuppressions.cs", "*_gen.go", "mock_*.go", "*_mock.go", "*_string.go", "*.rs.bk"]
GENERATED_PATH = "|".join(glob_regex(g) for g in [*(f"**/{f}" if "*" in f else f"**/{f}/**" for some in GENERATED_FOLDERS.values() for f in some), *(f"**/{n}" for n in GENERATED_NAMES)])
GENERATED_TEXT = r"(?i)@generated\b|\bdo not edit\b|\bauto(?:matically)?[- ]?generated\b|\bcode generated by\b|^(?://|#) generated (?:code|by)\b|\bgenerated from |(?m:^)/\*\s*eslint-disable\s*\*/|(?m:^)// @ts-nocheck"
KEEP = r"(?i)\bdo\s+not\s+(?:delete|remove)\b|\bkeep\s+this\s+file\b|@preserve\b"
JS, PY, JVM = ("javascript",), ("python",), ("java", "kotlin")
#: Lines that deserve a look, by language; the first that matches a line counts. Chosen from the checks that public linters
#: document (Bandit, gosec, ESLint's security plugin, Find Security Bugs, the .NET analyzers), with the number of their
#: weakness (cwe.mitre.org). Levels: CRITICAL where input becomes code or a secret lies open, HIGH where input reaches a
#: parser, a query or a page, MEDIUM where protection is weak or off, LOW where the code tells more than it should.
CODE_RULES = [
    Rule("private-key", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----", "CRITICAL", "CWE-321", gate=("PRIVATE KEY",)),
    Rule("provider-token", r"\b(?:gh[pousr]_[A-Za-z0-9]{36}|glpat-[\w-]{20}|xox[abprs]-[\w-]{10,}|A(?:KI|SI)A[A-Z2-7]{16}|AIza[\w-]{35}|sk-[A-Za-z0-9]{20,})\b", "CRITICAL", "CWE-798"),
    Rule("secret-literal", r"""(?i)\b\w*(?:passw(?:or)?d|passphrase|secret|credential|api_?key)\w*['"]?\s*(?::=|=>|[:=])\s*['"][^'"\s]{6,}['"]""", "CRITICAL", "CWE-798"),
    Rule("eval", r"(?:^|[^\w.])(?:eval|exec)\(", "CRITICAL", "CWE-95", languages=PY, gate=("eval(", "exec(")),
    Rule("process", r"\bshell\s*=\s*True\b|\bos\.(?:system|popen|exec[lv]p?e?)\(|\bcommands\.getoutput\(", "CRITICAL", "CWE-78", languages=PY),
    Rule("pickle", r"\b(?:c?[Pp]ickle|dill|shelve|marshal|jsonpickle)\.(?:loads?|open|decode|Unpickler)\(", "HIGH", "CWE-502", languages=PY),
    Rule("yaml-load", r"\byaml\.(?:unsafe_load|full_load)\(|\byaml\.load\((?!.*Safe)", "HIGH", "CWE-502", languages=PY, gate=("yaml.",)),
    Rule("sql-text", r"""(?i)\bexecute(?:many)?\(\s*(?:f['"]|['"](?:select|insert|update|delete)\b[^'"]*['"]\s*(?:%|\+|\.format))""", "HIGH", "CWE-89", languages=PY),
    Rule("unverified", r"\bverify\s*=\s*False\b|\b_create_unverified_context\b|\bCERT_NONE\b", "MEDIUM", "CWE-295", languages=PY),
    Rule("temporary-name", r"\btempfile\.mktemp\(", "MEDIUM", "CWE-377", languages=PY),
    Rule("eval", r"(?:^|[^\w.])eval\(|\bnew\s+Function\(|\bset(?:Timeout|Interval)\(\s*['\"`]|\bvm\.(?:runIn\w+|compileFunction)\(", "CRITICAL", "CWE-95", languages=JS),
    Rule("process", r"\bexec(?:Sync)?\(\s*(?:`|[^'\"`)]*\+)|\bshell\s*:\s*true\b|\bchild_process\b.*\bexec(?:Sync)?\(", "CRITICAL", "CWE-78", languages=JS),
    Rule("inner-html", r"\.(?:inner|outer)HTML\s*\+?=[^=]|\binsertAdjacentHTML\(|\bdangerouslySetInnerHTML\b|\bdocument\.write(?:ln)?\(|\bv-html\b|\bbypassSecurityTrust\w+\(", "HIGH", "CWE-79", languages=JS),
    Rule("request-path", r"\b(?:readFile|createReadStream|sendFile|unlink|join|resolve)\w*\([^)]*\breq(?:uest)?\.(?:params|query|body|headers)", "HIGH", "CWE-22", languages=JS, gate=("req",)),
    Rule("request-url", r"\b(?:fetch|axios(?:\.\w+)?|got|request|https?\.get)\([^)]*\breq(?:uest)?\.(?:params|query|body)", "HIGH", "CWE-918", languages=JS, gate=("req",)),
    Rule("sql-text", r"""(?i)\.query\(\s*(?:`[^`]*\$\{|['"](?:select|insert|update|delete)\b[^'"]*['"]\s*\+)""", "HIGH", "CWE-89", languages=JS),
    Rule("weak-random", r"\b(?i:\w*(?:token|secret|password|session|nonce)\w*)\s*=.*\bMath\.random\(", "MEDIUM", "CWE-338", languages=JS, gate=("Math.random",)),
    Rule("told-error", r"\bres(?:ponse)?\.(?:send|json|end|write)\([^)]*\b(?:stack|err(?:or)?\.message)\b", "LOW", "CWE-209", languages=JS),
    Rule("logged-secret", r"\bconsole\.\w+\([^)]*(?i:passw|secret|token|credential)", "LOW", "CWE-532", languages=JS, gate=("console.",)),
    Rule("process", r"\bexec\.Command(?:Context)?\([^)]*(?:\+|Sprintf|\"(?:ba|z)?sh\")", "CRITICAL", "CWE-78", languages=("go",), gate=("exec.Command",)),
    Rule("unverified", r"\bInsecureSkipVerify\s*:\s*true\b", "MEDIUM", "CWE-295", languages=("go",)),
    Rule("process", r"\.exec\([^)]*\+|\bnew\s+ProcessBuilder\([^)]*\+", "CRITICAL", "CWE-78", languages=JVM),
    Rule("object-stream", r"\bnew\s+ObjectInputStream\(|\bXMLDecoder\(|\.readObject\(", "HIGH", "CWE-502", languages=JVM),
    Rule("sql-text", r"""(?i)\b(?:execute(?:Query|Update)?|prepareStatement)\(\s*"[^"]*"\s*\+""", "HIGH", "CWE-89", languages=JVM),
    Rule("object-stream", r"\b(?:BinaryFormatter|NetDataContractSerializer|LosFormatter|SoapFormatter)\b|\bTypeNameHandling\.(?:All|Auto|Objects)\b", "HIGH", "CWE-502", languages=("csharp",)),
    Rule("unsafe", r"^\s*(?:pub\s+)?unsafe\s+(?:fn|impl|trait)\b|\bunsafe\s*\{|\btransmute(?:::<[^>]*>)?\(", "MEDIUM", "CWE-119", languages=("rust",), gate=("unsafe", "transmute")),
    Rule("weak-hash", r"""(?i)\b(?:createHash|createHmac|getInstance|hashlib\.new)\(\s*['"](?:md[245]|sha-?1)['"]|\bhashlib\.(?:md5|sha1)\(|\b(?:md5|sha1)\.(?:New|Sum)\(|\b(?:MD5|SHA1)(?:CryptoServiceProvider|Managed)?\.Create\(""", "MEDIUM", "CWE-328"),
    Rule("weak-cipher", r"""(?i)['"](?:des|des-?ede3?|rc[24]|bf|blowfish|aes[\w-]*/?ecb)[/'"-]|\b(?:DES|RC4|RC2|Blowfish|ARC4)\.(?:new|Create)\(""", "MEDIUM", "CWE-327"),
]
#: Folders near which a finding weighs more, by the risks of the OWASP Top 10 of 2021 that what they hold is exposed to.
#: Who gets in, and what must stay secret (A02, A07): one slip opens everything. What moves money or grants rights (A01,
#: A04): a slip costs those it concerns. What takes input from outside (A03, A08, A10): where a slip is reached from.
NEAR = [
    Rule("identity", r"(?i)(?:^|/)(?:auth\w*|identity|login|signin|sessions?|passwords?|mfa|sso|saml|oidc)/", "CRITICAL"),
    Rule("keys", r"(?i)(?:^|/)(?:crypto\w*|keys|keystore|secrets?|vault|certs?|certificates)/", "CRITICAL"),
    Rule("rights", r"(?i)(?:^|/)(?:admin\w*|access|policies|policy|roles|grants|tenants?)/", "HIGH"),
    Rule("money", r"(?i)(?:^|/)(?:payments?|payouts?|invoices?|wallets?|ledger|orders)/", "HIGH"),
    Rule("input", r"(?i)(?:^|/)(?:api|rest|rpc|graphql|handlers|controllers|endpoints|gateway|upload\w*|parsers?|templates)/", "MEDIUM"),
]


@dataclass(frozen=True)
class Options:
    """Globs that are always live, globs left out of results, more paths of entry points, whether generated files are reported, and whether `all` or only `dead` files are searched for findings."""

    live: list[str] = field(default_factory=list)
    ignore: list[str] = field(default_factory=list)
    entries: list[tuple[str, str]] = field(default_factory=list)
    report_generated: bool = False
    #: Beside the usual ones: paths that are generated, decorators and container calls (with the type's name as first group) that make live, fields of manifests that name files.
    generated: list[str] = field(default_factory=list)
    decorators: list[str] = field(default_factory=list)
    containers: list[str] = field(default_factory=list)
    manifest_fields: list[str] = field(default_factory=list)
    set_aside: list[str] = field(default_factory=lambda: list(SET_ASIDE))
    scope: str = "all"


def field_entries(files: DataFrame, fields: list[str]) -> DataFrame:
    """(path, reason): files that further fields of manifests name, in strings up to three levels deep."""
    rows = manifests.manifests(files)
    values = F.array(*(F.get_json_object("json", f"$.{f}") for f in fields))
    paths = F.flatten(F.transform(F.filter(values, lambda x: x.isNotNull()), lambda x: F.when(x.rlike(r"^[\[{]"), F.regexp_extract_all(x, F.lit(r'"(\.?/?[\w@./-]+)"(?!\s*:)'), F.lit(1))).otherwise(F.array(x))))
    keys = rows.select(F.explode(paths).alias("file"), "dir").select(F.explode(manifests.sources_of(manifests.at("dir", "file"))).alias("key"))
    return keys.join(file_keys(files.select("path"), "p"), "key").select(F.col("target").alias("path"), F.lit("manifest field").alias("reason")).distinct()


def page_entries(files: DataFrame) -> DataFrame:
    """(path, reason): scripts of HTML pages."""
    pages = files.where(F.col("path").rlike(r"\.html?\z")).select(dirname("path").alias("dir"), F.explode(F.regexp_extract_all("content", F.lit(r"""<script[^>]*\ssrc=["']([^"':]+)["']"""), F.lit(1))).alias("src"))
    return pages.select(normalise(F.concat_ws("/", F.nullif("dir", F.lit("")), "src")).alias("path"), F.lit("html").alias("reason")).where("path is not null").distinct()


@fact("entry_texts")
def _entry_texts(options: Options | None) -> Column:
    """Places in ENTRY_TEXTS of what the code has; the place behind the last stands for the decorators of the options."""
    hits = [(F.col(LANG) == x) & F.col(CODE).rlike(p) for _, x, p in ENTRY_TEXTS]
    if options and options.decorators:
        hits.append(F.col(LANG).isNotNull() & F.col(CODE).rlike(r"(?m)^\s*[@\[](?:" + "|".join(re.escape(d) for d in options.decorators) + r")\b"))
    return F.filter(F.array(*(F.when(h, F.lit(i)) for i, h in enumerate(hits))), lambda x: x.isNotNull())


def used_packages(found: DataFrame, files: DataFrame) -> DataFrame:
    """Entries (path, reason) without those of abandoned packages; a package within one is judged by itself."""
    gone = manifests.abandoned(files)
    if gone.isEmpty():
        return found
    held = nearest(found.select("path").distinct(), manifests.manifests(files))
    return found.join(held.join(gone, "dir").select("path"), "path", "left_anti")


def entries(files: DataFrame, options: Options = Options()) -> DataFrame:
    """(path, reason), one row per entry point, with its first reason."""
    path = F.col("path")
    files = gathered(files, ["entry_texts", "references"], options)
    code = files.where(language("path").isNotNull())
    checks = [(r, path.rlike(p)) for r, p in [*ENTRY_PATHS, *options.entries]] + [(r, F.array_contains(of("entry_texts"), i)) for i, (r, _, _) in enumerate(ENTRY_TEXTS)]
    if options.decorators:
        checks.append(("decorator", F.array_contains(of("entry_texts"), len(ENTRY_TEXTS))))
    if options.live:
        checks.append(("dynamic", matches_any("path", options.live)))
    ranked = F.filter(F.array(*(F.when(hit, F.struct(F.lit(i).alias("rank"), F.lit(r).alias("reason"))) for i, (r, hit) in enumerate(checks))), lambda x: x.isNotNull())
    own = code.select("path", F.explode(ranked).alias("e")).select("path", "e.rank", "e.reason")
    have, named = manifests.kinds(files), []
    if have & {"package", "deno"}:
        named.append(used_packages(manifests.package_entries(files), files))
    if "package" in have and options.manifest_fields:
        named.append(field_entries(files, options.manifest_fields))
    ways = {"page": page_entries, "any": configs.configured_entries, "compiler": manifests.config_entries, "project": manifests.in_live_projects}
    named += [way(files) for kind, way in ways.items() if kind in have]
    # What the tree itself names comes before what tools and frameworks find by its path.
    named = reduce(DataFrame.union, (x.select("path", F.lit(rank).alias("rank"), "reason") for x, rank in [*((x, len(checks)) for x in named), (rule_entries(files), len(checks) + 1)]))
    every = own.union(named.join(code.select("path"), "path", "left_semi")).where(~set_aside(path, options.set_aside))
    return every.groupBy("path").agg(F.min(F.struct("rank", "reason"))["reason"].alias("reason"))


def aliases(files: DataFrame) -> DataFrame:
    """(dir, prefix, target, place): what module names that begin with `prefix` stand for in files below `dir`; of several targets the one of least place.

    From compiler configurations and what they extend (prefix empty: baseUrl),
    bundlers' tables, names of packages, and Go modules. A package with an
    exports map is known by that, others by what is main, their folder, and its src.
    """
    have = manifests.kinds(files)
    ways = [({"compiler"}, manifests.config_aliases), ({"bundler", "package"}, configs.bundler_aliases), ({"package"}, manifests.export_aliases), ({"go"}, manifests.go_modules)]
    every = [way(files).select("dir", "prefix", "target", F.lit(0).alias("place")) for kinds, way in ways if kinds & have]
    if "package" not in have:
        none = files.sparkSession.createDataFrame([], "dir string, prefix string, target string, place int")
        return cut(reduce(DataFrame.union, every, none).where("target is not null").distinct()) if every else none
    packages = manifests.manifests(files).select(F.col("dir").alias("home"), *(F.get_json_object("json", f"$.{k}").alias(k) for k in ("name", "main", "exports"))).where("name is not null and exports is null and home <> ''")
    main = F.regexp_replace(F.regexp_replace(manifests.at("home", "main"), r"(^|/)(?:dist|lib|build|out|esm|cjs)/", "$1src/"), r"\.[^./]+\z", "")
    named = packages.select(F.lit("").alias("dir"), F.col("name").alias("prefix"), F.posexplode(F.array(main, "home", F.concat("home", F.lit("/src")))).alias("place", "target"))
    return cut(reduce(DataFrame.union, [*every, named.select("dir", "prefix", "target", "place")]).where("target is not null").distinct())


def aliased_keys(refs: DataFrame, table: DataFrame) -> DataFrame:
    """(path, module, kind, rank, key): script and Go references that aliases rewrite; the nearest folder's longest alias ranks first.

    Folders above and prefixes are exploded, so that this is a join on equality.
    """
    bare = refs.where(F.col("language").isin("javascript", "go") & (F.col("kind") != "glob") & ~F.col("module").rlike(r"^[./]"))
    probes = bare.select("path", "language", "module", "kind", F.explode(ancestors("path")).alias("dir")).withColumn("prefix", F.explode(F.concat(prefixes("module", "/"), F.array(F.lit("")))))
    hits = probes.join(table, ["dir", "prefix"])
    rank = F.col("place") - 4 * (F.when(F.col("prefix") != "", 1_000_000).otherwise(0) + F.length("dir") * 500 + F.least(F.length("prefix"), F.lit(499)))
    rest = F.regexp_replace(F.expr("substring(module, length(prefix) + 1)"), "^/", "")
    where = normalise(F.concat_ws("/", F.nullif("target", F.lit("")), F.nullif(rest, F.lit(""))))
    return hits.select("path", "module", "kind", rank.cast("int").alias("rank"), F.concat(F.when(F.col("language") == "go", "f:").otherwise("p:"), where).alias("key"))


def _found(languages: tuple[str, ...], *patterns: str, group: int = 1) -> Column:
    """What the patterns find in the code of these languages, each once."""
    return F.when(F.col(LANG).isin(*languages), F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(F.col(CODE), F.lit(p), F.lit(group)) for p in patterns)))))


@fact("types")
def _types(_options) -> Column:
    return _found(("csharp",), r"\b(?:class|interface|record|struct|enum)\s+([A-Z]\w*)")


@fact("type_names")
def _type_names(_options) -> Column:
    return _found(("csharp",), r"\b[A-Z]\w*", group=0)


@fact("extensions")
def _extensions(_options) -> Column:
    return _found(("csharp",), r"\bstatic\s+[\w<>\[\],.?\s]+?\b(\w+)\s*(?:<[^>(]*>)?\s*\(\s*this\s")


@fact("methods")
def _methods(_options) -> Column:
    return _found(("csharp",), r"\.(\w+)\s*(?:<[^>(]*>)?\(")


@fact("beans")
def _beans(_options) -> Column:
    return _found(("java", "kotlin", "csharp", "javascript"), TYPES)


@fact("asked_beans")
def _asked_beans(options: Options | None) -> Column:
    return _found(("java", "kotlin", "csharp", "javascript"), *CONTAINERS, *(options.containers if options else []))


@fact("reads_folder")
def _reads_folder(_options) -> Column:
    return F.col("path").rlike(r"(?:^|/)index\.[cm]?[jt]s\z") & F.col(CODE).rlike(r"\breaddir(?:Sync)?\(\s*(?:path\.\w+\(\s*)?(?:__dirname|import\.meta\.dirname|\.)")


@fact("unit")
def _unit(_options) -> Column:
    """The Go folder, JVM package or C# namespace that a file belongs to."""
    lang, code = F.col(LANG), F.col(CODE)
    package, namespace = (F.nullif(F.regexp_extract(code, rf"(?m)^\s*{word}\s+([\w.]+)", 1), F.lit("")) for word in ("package", "namespace"))
    return F.when(lang == "go", F.concat(F.lit("go "), dirname("path"))).when(lang.isin("java", "kotlin"), F.concat(F.lit("jvm "), package)).when(lang == "csharp", F.concat(F.lit("cs "), namespace))


@fact("words")
def _words(_options) -> Column:
    return F.when(F.col(LANG).isNotNull(), F.array_distinct(F.regexp_extract_all("content", F.lit(r"[A-Za-z_$][\w$]*"), F.lit(0))))


@fact("findings")
def _findings(_options) -> Column:
    return F.when(F.col(LANG).isNotNull(), rules.found_lines(F.coalesce("content", F.lit("")), CODE_RULES, F.col(LANG)))


@fact("generated")
def _generated(_options) -> Column:
    return F.coalesce(is_generated(F.lit(""), F.col("content")), F.lit(False))


@fact("kept")
def _kept(_options) -> Column:
    return F.substring(F.coalesce("content", F.lit("")), 1, 2000).rlike(KEEP)


@fact("lines")
def _lines(_options) -> Column:
    """The number of lines; null if nothing is known of the file, and 0 if it has nothing but white space."""
    return F.when(F.col("content").isNotNull(), F.when(F.trim("content") == "", 0).otherwise(F.size(F.split("content", "\n", -1))))


def class_edges(files: DataFrame) -> DataFrame:
    """Edges from C# files to those that define a type whose name they use, through a hub for each type.

    A hub takes as many edges as there are uses and definitions, however many files share a name.
    """
    sharp = told(files.where(language("path") == "csharp"), "types", "type_names")
    defined = sharp.select("path", F.explode(of("types")).alias("name"))
    used = sharp.select("path", F.explode(of("type_names")).alias("name"))
    hub = F.concat(F.lit("hub:type "), "name")
    uses = used.join(defined, ["path", "name"], "left_anti").join(defined.select("name").distinct(), "name", "left_semi")
    return uses.select(F.col("path").alias("src"), hub.alias("dst")).union(defined.select(hub, "path"))


def method_edges(files: DataFrame) -> DataFrame:
    """Edges from C# files that call an extension method to those that define one of its name, through a hub for each name."""
    sharp = told(files.where(language("path") == "csharp"), "extensions", "methods")
    defined = sharp.select("path", F.explode(of("extensions")).alias("name"))
    used = sharp.select("path", F.explode(of("methods")).alias("name"))
    hub = F.concat(F.lit("hub:method "), "name")
    return used.join(defined.select("name").distinct(), "name", "left_semi").select(F.col("path").alias("src"), hub.alias("dst")).union(defined.select(hub, "path"))


#: Calls by which containers are given, or asked for, a type: after the manuals of ASP.NET Core, Spring, Guice, tsyringe and Inversify.
CONTAINERS = [
    r"\bAdd(?:Scoped|Singleton|Transient|HostedService)<(?:\w+\s*,\s*)?(\w+)>",
    r"\b(?:GetRequiredService|GetService|Resolve|ResolveNamed|CreateInstance)<(\w+)>",
    r"\bgetBean\(\s*(?:\"\w+\"\s*,\s*)?(\w+)\.class",
    r"\bgetInstance\(\s*(\w+)\.class",
    r"\bbind\(\s*(\w+)(?:\.class)?\s*\)",
    r"\.to(?:Self|Class)?\(\s*([A-Z]\w*)(?:\.class)?\s*\)",
    r"\b(?:container|injector|moduleRef)\.(?:get|resolve|register|registerSingleton)(?:<\w+>)?\(\s*([A-Z]\w*)",
]
TYPES = r"\b(?:class|interface|record|struct|object)\s+([A-Z]\w*)"


def container_edges(files: DataFrame) -> DataFrame:
    """Edges from files that ask a container for a type to those that define it, through a hub for each type."""
    code = told(files.where(language("path").isin("java", "kotlin", "csharp", "javascript")), "beans", "asked_beans")
    defined = code.select("path", F.explode(of("beans")).alias("name"))
    used = code.select("path", F.explode(of("asked_beans")).alias("name")).where("name <> ''")
    hub = F.concat(F.lit("hub:bean "), "name")
    return used.join(defined.select("name").distinct(), "name", "left_semi").select(F.col("path").alias("src"), hub.alias("dst")).union(defined.join(used.select("name").distinct(), "name", "left_semi").select(hub, "path"))


def folder_edges(files: DataFrame) -> DataFrame:
    """Edges from index files that read their own folder to the files in it, through a hub for each folder."""
    reads = told(files, "reads_folder").where(of("reads_folder")).select("path", dirname("path").alias("dir"))
    hub = F.concat(F.lit("hub:folder "), "dir")
    inside = files.where(language("path").isNotNull()).select("path", dirname("path").alias("dir")).join(reads.select("dir").distinct(), "dir", "left_semi")
    return reads.select(F.col("path").alias("src"), hub.alias("dst")).union(inside.select(hub, "path"))


def glob_edges(files: DataFrame) -> DataFrame:
    """Edges from files that import by a glob to what it matches, through a hub for each glob."""
    refs = references(files).where("kind = 'glob'").select("path", normalise(F.concat_ws("/", F.when(F.col("module").startswith("/"), F.lit(None)).otherwise(F.nullif(dirname("path"), F.lit(""))), "module")).alias("glob")).where("glob is not null")
    found = manifests.globbed(files.where(language("path").isNotNull()).select("path"), refs.select("glob"))
    hub = F.concat(F.lit("hub:glob "), "glob")
    return refs.select(F.col("path").alias("src"), hub.alias("dst")).union(found.select(hub, "path"))


def _package() -> Column:
    return F.regexp_extract(of("unit"), r"^jvm (.+)", 1)


def source_roots(files: DataFrame) -> DataFrame:
    """(root, votes): folders below which Java and Kotlin files lie as their packages say, by how many do."""
    rows = told(files.where(language("path").isin("java", "kotlin")), "unit").select(dirname("path").alias("folder"), F.translate(_package(), ".", "/").alias("inner")).where("inner <> ''")
    fits = F.concat(F.lit("/"), "folder").endswith(F.concat(F.lit("/"), F.col("inner")))
    root = F.expr("substring(folder, 1, greatest(length(folder) - length(inner) - 1, 0))")
    return rows.where(fits).groupBy(root.alias("root")).agg(F.count("*").alias("votes"))


def class_keys(files: DataFrame) -> DataFrame:
    """(key, target) of Java and Kotlin files: j: by package and name, c: by name. A file that declares no package has that of its place below the root with the most votes."""
    rows = told(files.where(language("path").isin("java", "kotlin")), "unit").select("path", F.nullif(_package(), F.lit("")).alias("package"))
    bare = rows.where("package is null").select("path", F.explode(ancestors("path")).alias("root")).join(source_roots(files), "root")
    placed = bare.groupBy("path").agg(F.max_by("root", "votes").alias("root")).select("path", F.translate(F.regexp_replace(F.expr("substring(path, length(root) + 1)"), r"^/|/?[^/]*\z", ""), "/", ".").alias("package"))
    every = rows.where("package is not null").union(placed)
    name = F.regexp_replace(basename("path"), r"\.[^.]*\z", "")
    whole = F.concat(F.lit("j:"), F.concat_ws(".", F.nullif("package", F.lit("")), name))
    named = rows.select(F.concat(F.lit("c:"), name).alias("key"), F.col("path").alias("target"))
    return every.select(whole.alias("key"), F.col("path").alias("target")).union(named)


def keys_of(files: DataFrame, options: Options, kinds: str) -> DataFrame:
    """(key, target): by what references may name a file, for these kinds of keys. A folder's name, or that of a class alone, doesn't stand for files that are set aside."""
    keys = file_keys(files.where(language("path").isNotNull()).select("path"), kinds)
    if "j" in kinds:
        keys = keys.union(class_keys(files))
    return keys.where(~(F.col("key").rlike("^[dfc]:") & set_aside(F.col("target"), options.set_aside)))


def resolved(files: DataFrame, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """(path, module, kind, key, n): the best keys of each reference that files have, and how many files each has; and (key, target): the files of keys.

    References meet distinct keys, not files, so that many importers of a name
    that many files have make no product. Keys are made of the kinds only that
    references of the tree's languages have, once, as a table.
    """
    raw = cut(references(files))
    languages = {r.language for r in raw.select("language").distinct().collect()}
    kinds = "".join(KEY_KINDS[x] for x in languages)
    if not kinds:
        new = files.sparkSession.createDataFrame
        return new([], "path string, module string, kind string, key string, n long"), new([], "key string, target string")
    keys = written(keys_of(files, options, kinds))
    # A class's name alone means a file only if it is the one with that name.
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n = 1 or key not like 'c:%'")
    refs = with_keys(raw, "path", "module", "kind")
    if languages & {"javascript", "go"}:
        refs = refs.unionByName(aliased_keys(raw, aliases(files)))
    found = cut(refs.join(sizes, "key"))
    # The least rank of each reference, aggregated with its keys: no window over hot references.
    best = found.groupBy("path", "module", "kind").agg(F.min("rank").alias("rank"))
    return found.join(best, ["path", "module", "kind", "rank"]).select("path", "module", "kind", "key", "n"), keys


#: Facts that edges are made of.
LINKS = ["references", "types", "type_names", "extensions", "methods", "beans", "asked_beans", "reads_folder", "unit"]


def edges(files: DataFrame, options: Options = Options()) -> DataFrame:
    """(src, dst): references resolved to files, through a hub where several files have a name; and hubs that link files of one Go folder, JVM package or C# namespace, users of C# types and methods, of containers, folders and globs."""
    files = gathered(files, LINKS, options)
    found, keys = resolved(files, options)
    best = cut(found.select("path", "key", "n").distinct())
    single = best.where("n = 1").join(keys, "key").select(F.col("path").alias("src"), F.col("target").alias("dst"))
    hub = F.concat(F.lit("hub:"), "key")
    shared = best.where("n > 1")
    several = shared.select(F.col("path").alias("src"), hub.alias("dst")).union(keys.join(shared.select("key").distinct(), "key").select(hub, "target"))
    every = single.union(several)
    members = files.select("path", of("unit").alias("unit")).where("unit is not null")
    # One row says which of the other kinds of links the tree has; nothing is planned for those that it hasn't.
    some = {"unit": of("unit").isNotNull(), "types": of("types").isNotNull(), "beans": F.size("fact_asked_beans") > 0, "folder": of("reads_folder"), "glob": F.exists(of("references"), lambda r: r["kind"] == "glob")}
    has = files.agg(*(F.coalesce(F.bool_or(hit), F.lit(False)).alias(k) for k, hit in some.items())).first()
    if has["unit"]:
        every = every.union(graph.hub_edges(members, "path", "unit", into=members.where(~set_aside(F.col("path"), options.set_aside))))
    if has["types"]:
        every = every.union(class_edges(files)).union(method_edges(files))
    for kind, way in {"beans": container_edges, "folder": folder_edges, "glob": glob_edges}.items():
        if has[kind]:
            every = every.union(way(files))
    return every.where("src <> dst").distinct()


def generated_path(path: Column, more: list[str] | None = None) -> Column:
    return path.rlike("|".join([GENERATED_PATH, *(f"(?:{p})" for p in more or [])]))


def is_generated(path: Column, content: Column, more: list[str] | None = None) -> Column:
    head = F.array_join(F.slice(F.split(F.coalesce(content, F.lit("")), "\n", -1), 1, 20), "\n")
    return generated_path(path, more) | head.rlike(GENERATED_TEXT)


@dataclass
class Report:
    """Tables of one scan: entry points, edges, unreachable files, unused exports, risky lines, and totals."""

    entries: DataFrame
    edges: DataFrame
    unreachable: DataFrame
    unused_exports: DataFrame
    findings: DataFrame
    languages: DataFrame
    summary: DataFrame


def options_of(files: DataFrame, **overrides) -> Options:
    """Options by the tree's own configuration (`loomline.json`, `.loomlineignore`), and overrides, which win; a name that isn't an option is an error.

    `entries` in a file is an object of reasons and patterns.
    """
    said = configs.load_options(files, overrides=overrides)
    if isinstance(said.get("entries"), dict):
        said["entries"] = list(said["entries"].items())
    unknown = set(said) - set(Options.__dataclass_fields__)
    if unknown:
        raise ValueError(f"no such options: {', '.join(sorted(unknown))}")
    return Options(**said)


#: All facts that a scan reads.
EVERY = [*LINKS, "entry_texts", "exports", "words", "findings", "generated", "kept", "lines"]


def scan(files: DataFrame, options: Options | None = None) -> Report:
    """Everything about `files` (path, size, content), or about the facts of such.

    Contents are read once, in one pass that takes all facts; what follows reads
    the columns that it needs of a written table, and no text is shuffled.
    Without `options` they are those of the tree's own configuration; texts are
    read again if that adds patterns to look for. Folders that version control
    keeps elsewhere are left out.
    """
    table = gathered(files, EVERY, options)
    if options is None:
        options = options_of(table)
        if options.decorators or options.containers:
            table = gathered(files, EVERY, options)
    files = manifests.without_submodules(table)
    seeds = cut(entries(files, options))
    links = cut(edges(files, options))
    live = cut(graph.no_hubs(graph.reachable(links, seeds.select(F.col("path").alias("node")))))
    code = files.withColumn("language", language("path")).where("language is not null")
    shown = ~matches_any("path", options.ignore)
    # Of a file that couldn't be read nothing is known: it is neither live nor dead.
    narrow = code.where((of("lines") > 0) & shown & ~of("kept"))
    if not options.report_generated:
        narrow = narrow.where(~of("generated") & ~generated_path(F.col("path"), options.generated))
    narrow = narrow.select("path", "language", "size", of("lines").alias("lines"))
    unreachable = cut(narrow.join(live.withColumnRenamed("node", "path"), "path", "left_anti"))
    searched = code.join(unreachable.select("path"), "path", "left_semi") if options.scope == "dead" else code
    near = rules.nearness(F.col("path"), NEAR)
    findings = searched.select("path", "language", F.inline(of("findings")))
    findings = findings.withColumn("severity", rules.level(rules.boosted(rules.rank(F.col("severity")), near))).join(unreachable.select("path", F.lit(True).alias("is_dead")), "path", "left").withColumn("is_dead", F.coalesce("is_dead", F.lit(False)))
    totals = files.agg(F.count("*").alias("total")).crossJoin(seeds.agg(F.count("*").alias("entry_points"))).crossJoin(unreachable.agg(F.count("*").alias("unreachable"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")))
    return Report(seeds, links, unreachable, unused_exports(files, live, seeds), findings, files.groupBy(language("path").alias("language")).agg(F.count("*").alias("n_files")).where("language is not null"), totals)


def unused_exports(files: DataFrame, live: DataFrame, seeds: DataFrame) -> DataFrame:
    """(path, name): exports of reachable files, no entry points, whose name no other reachable file's text has.

    Names are compared as words, which errs towards used.
    """
    files = told(files, "exports", "words").select("path", "fact_exports", "fact_words")
    reached = files.join(live.withColumnRenamed("node", "path"), "path", "left_semi")
    offered = exports(reached).where("is_direct").join(seeds, "path", "left_anti").where("name <> 'default'")
    words = reached.select("path", F.explode(of("words")).alias("name"))
    users = words.groupBy("name").agg(F.count("*").alias("n"))
    return offered.join(users.where("n > 1"), "name", "left_anti").select("path", "name")


def without_references(files: DataFrame, removed: DataFrame) -> DataFrame:
    """(path, content, n_dropped) of files that import a removed file (path), without those lines and without runs of blank lines."""
    single = F.filter(F.transform(F.split("content", "\n", -1), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("content"))), lambda s: s["content"].rlike(r"^\s*(?:import|export|from|const|let|var)\b.*"))
    rows = files.where(language("path").isNotNull()).select("path", F.inline(single))
    found = references(rows, "line_no")
    gone = with_keys(found, "path", "line_no").join(file_keys(removed.select("path"), "p"), "key").select("path", "line_no").distinct()
    drop = gone.groupBy("path").agg(F.collect_set("line_no").alias("drop"))
    kept = F.filter(F.split("content", "\n", -1), lambda x, i: ~F.array_contains("drop", (i + 1).cast("int")))
    tidy = F.transform(F.array(kept), lambda k: F.filter(k, lambda x, i: (F.trim(x) != "") | (i == 0) | (F.trim(F.get(k, F.greatest(i - 1, F.lit(0)))) != "")))[0]
    return files.join(removed.select("path"), "path", "left_anti").join(drop, "path").select("path", F.array_join(tidy, "\n").alias("content"), F.size("drop").alias("n_dropped"))
