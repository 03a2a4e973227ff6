"""What bundlers, test runners, CI, containers and build systems name: one table of extraction rules, and joins on what they give."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.paths import dirname
from loomline.functions.references import file_keys
from loomline.operators.lineage import cut
from loomline.plans.manifests import at, globbed, sources_of, workspaces

#: A quoted string; one that is a path or a glob; a script that a command runs.
QUOTED = r"""['"`]([^'"`\n]+)['"`]"""
PATHS = r"""['"`](!?(?:<rootDir>/|\.{1,2}/|/)?[\w@*?{},.-]+(?:/[\w@*?{},.-]+)*)['"`]"""
RUN = r"(?:^|[\s'\"\[,;&|(])(?:node|nodemon|tsx|ts-node|bun|deno|babel-node|python3?|uvicorn)(?:\s+run)?(?:[\s'\",]+-{1,2}[\w=-]+)*[\s'\",]+([\w./-]+\.(?:[cm]?[jt]sx?|py))"
#: A list, an object or one string behind a key.
VALUE = r"""(\[[^\]]*\]|\{[^{}]*\}|[^,'"`\n]*['"`][^'"`\n]+['"`])"""


@dataclass(frozen=True)
class Scrape:
    """In files named `name`, `item` finds paths within what `block` finds (all, if it is empty); `top`: they start at the top, not at the file's folder."""

    reason: str
    name: str
    item: str
    block: str = ""
    top: bool = False


#: After each tool's own reference manual, as far as paths stand in literals.
SCRAPES = [
    Scrape("angular", r"(?:^|/)(?:angular|workspace)\.json\z", r'"(?:main|browser|server|polyfills|entry|replace|with)"\s*:\s*"([^"]+)"'),
    Scrape("ci", r"(?:^|/)\.github/workflows/[^/]+\.ya?ml\z|(?:^|/)\.gitlab-ci\.ya?ml\z|(?:^|/)azure-pipelines\.ya?ml\z|(?:^|/)\.circleci/[^/]+\.ya?ml\z|(?:^|/)Jenkinsfile[^/]*\z", RUN, top=True),
    Scrape("container", r"(?:^|/)(?:[\w.-]+\.)?Dockerfile[^/]*\z", r"""[\s"'\[](?:\./)?([\w./-]+\.(?:[cm]?[jt]sx?|py))""", r"(?m)^(?:ENTRYPOINT|CMD)([^\n]*)$"),
    Scrape("container", r"(?:^|/)(?:docker-)?compose[^/]*\.ya?ml\z", r"""[\s"'\[](?:\./)?([\w./-]+\.(?:[cm]?[jt]sx?|py))""", r"(?m)^\s*(?:command|entrypoint)\s*:([^\n]*)$"),
    Scrape("cypress", r"(?:^|/)cypress\.(?:config\.[cm]?[jt]s|json)\z", PATHS, r"""\b(?:specPattern|supportFile|setupNodeEvents|testFiles|pluginsFile)['"]?\s*:\s*""" + VALUE),
    Scrape("esbuild", r"(?:^|/)(?:esbuild|build)[^/]*\.[cm]?[jt]s\z", PATHS, r"\bentryPoints\s*:\s*" + VALUE),
    Scrape("federation", r"(?:^|/)(?:webpack|vite|rspack|rsbuild|module-federation|federation)[^/]*\.[cm]?[jt]s\z", r""":\s*['"]([^'"]+)['"]""", r"\bexposes\s*:\s*(\{[^{}]*\})"),
    Scrape("grunt", r"(?:^|/)Gruntfile\.[cm]?[jt]s\z", PATHS, r"""\bsrc['"]?\s*:\s*""" + VALUE),
    Scrape("gulp", r"(?:^|/)gulpfile[^/]*\.[cm]?[jt]s\z", PATHS, r"\bsrc\(\s*" + VALUE),
    Scrape("jest", r"(?:^|/)(?:jest|vitest|vite)[^/]*\.(?:[cm]?[jt]s|json)\z|(?:^|/)package\.json\z", PATHS, r"""\b(?:setupFiles(?:AfterEnv)?|globalSetup|globalTeardown|testMatch|testEnvironment|snapshotSerializers|transform)['"]?\s*:\s*""" + VALUE),
    Scrape("nx", r"(?:^|/)project\.json\z", r'"(?:main|browser|server)"\s*:\s*"([^"]+)"', top=True),
    Scrape("parcel", r"(?:^|/)package\.json\z", QUOTED, r'"source"\s*:\s*(\[[^\]]*\]|"[^"]+")'),
    Scrape("rollup", r"(?:^|/)(?:rollup|vite|rolldown)[^/]*\.[cm]?[jt]s\z", PATHS, r"\binput\s*:\s*" + VALUE),
    Scrape("script", r"(?:^|/)package\.json\z", RUN, r'"scripts"\s*:\s*(\{[^{}]*\})'),
    Scrape("script", r"(?:^|/)package\.json\z", r"[\s\"'](\.?/?[\w.-]+(?:/[\w.-]+)+\.[cm]?[jt]sx?)(?=[\s\"';&|])", r'"scripts"\s*:\s*(\{[^{}]*\})'),
    Scrape("script glob", r"(?:^|/)package\.json\z", r"""[\s'"](\.?/?[\w./-]*\*[\w./*{},-]*)""", r"(\b(?:mocha|ava|tap|tape|jest|vitest|c8|nyc|jasmine|node\s+--test|uvu)\b[^\"]*(?:\\.[^\"]*)*)"),
    Scrape("serverless", r"(?:^|/)serverless[^/]*\.ya?ml\z", r"(?m)^\s*handler\s*:\s*['\"]?([\w./-]+)\.\w+['\"]?\s*$"),
    Scrape("vite alias", r"(?:^|/)vite[^/]*\.[cm]?[jt]s\z", r"""['"]((?:\.{0,2}/)?[\w./-]+)['"]""", r"\breplacement\s*:([^\n}]*)"),
    Scrape("webpack", r"(?:^|/)(?:webpack|rspack)[^/]*\.[cm]?[jt]s\z", PATHS, r"\bentry\s*:\s*" + VALUE),
]


def scraped(files: DataFrame, rules: list[Scrape] = SCRAPES) -> DataFrame:
    """(reason, item): paths and globs from the top that configuration files name. Only such files' texts are searched, each by its own rules."""
    some = "|".join(f"(?:{r.name})" for r in rules)
    none = F.array().cast("array<struct<reason: string, top: boolean, item: string>>")

    def found(r: Scrape) -> Column:
        text = F.array_join(F.regexp_extract_all("content", F.lit(r.block), F.lit(1)), "\n") if r.block else F.col("content")
        items = F.transform(F.regexp_extract_all(text, F.lit(r.item), F.lit(1)), lambda x: F.struct(F.lit(r.reason).alias("reason"), F.lit(r.top).alias("top"), x.alias("item")))
        return F.when(F.col("path").rlike(r.name), items).otherwise(none)

    rows = files.where(F.col("content").isNotNull() & F.col("path").rlike(some)).select(dirname("path").alias("dir"), F.inline(F.array_distinct(F.flatten(F.array(*(found(r) for r in rules))))))
    item = F.regexp_replace("item", r"^<rootDir>/", "")
    return rows.where(~F.col("item").startswith("!")).select("reason", at(F.when(F.col("top"), "").otherwise(F.col("dir")), item).alias("item")).where("item <> ''").distinct()


def configured_entries(files: DataFrame) -> DataFrame:
    """(path, reason): files that configurations name, by path, by path without extension, or by glob."""
    rows = cut(scraped(files))
    if rows.isEmpty():
        return files.sparkSession.createDataFrame([], "path string, reason string")
    exact = rows.where(~F.col("item").rlike("[*?{]")).select("reason", F.explode(sources_of(F.col("item"))).alias("key"))
    direct = exact.join(file_keys(files.select("path"), "p"), "key").select(F.col("target").alias("path"), "reason")
    globs = rows.where(F.col("item").rlike("[*?{]"))
    return direct.union(globs.join(globbed(files, globs.select(F.col("item").alias("glob"))).withColumnRenamed("glob", "item"), "item").select("path", "reason")).distinct()


def bundler_aliases(files: DataFrame) -> DataFrame:
    """(dir, prefix, target) of Vite's and webpack's alias tables, and `@` for src where nothing else gives it a meaning."""
    rows = files.where(F.col("path").rlike(r"(?:^|/)(?:vite|webpack|rspack|vitest)[^/]*\.[cm]?[jt]s\z")).select(dirname("path").alias("dir"), "content")
    pair = r"""['"]?([@~#][\w/-]*)['"]?\s*:\s*[^,\n]*?['"]((?:\.{0,2}/)?[\w.-]+(?:/[\w.-]+)*)['"]"""
    find = r"""\bfind\s*:\s*['"]([^'"\n]+)['"]\s*,\s*replacement\s*:[^,\n}]*?['"]([^'"\n]+)['"]"""
    both = [F.arrays_zip(F.regexp_extract_all("content", F.lit(p), F.lit(1)).alias("prefix"), F.regexp_extract_all("content", F.lit(p), F.lit(2)).alias("to")) for p in (pair, find)]
    told = rows.select("dir", F.inline(F.concat(*both))).select("dir", F.regexp_replace("prefix", r"/\z", "").alias("prefix"), at("dir", F.regexp_replace("to", r"^/|/\z", "")).alias("target")).where("target is not null").distinct()
    homes = files.where(F.col("path").rlike(r"(?:^|/)package\.json\z")).select(dirname("path").alias("dir"))
    usual = homes.select("dir", F.lit("@").alias("prefix"), F.explode(F.array(at("dir", F.lit("src")), at("dir", F.lit("client/src")))).alias("target"))
    return told.union(usual.join(told.select("dir", "prefix"), ["dir", "prefix"], "left_anti"))


#: Build systems: the files by which each is known, and what names their packages: nothing, if it is the file's own folder.
BUILDS = [
    ("bazel", r"(?:^|/)BUILD\.bazel\z", "", ""),
    ("buck", r"(?:^|/)BUCK\z", "", ""),
    ("pants", r"(?:^|/)BUILD(?:\.pants)?\z", "", ""),
    ("turborepo", r"(?:^|/)turbo\.json\z", "", ""),
    ("gradle", r"(?:^|/)settings\.gradle(?:\.kts)?\z", r"""['"]:?([\w:.-]+)['"]""", r"\binclude\s*\(?([^)\n]*(?:,\s*\n[^)\n]*)*)"),
    ("gradle flat", r"(?:^|/)settings\.gradle(?:\.kts)?\z", r"""['"]([\w.-]+)['"]""", r"\bincludeFlat\s*\(?([^)\n]*)"),
    ("maven", r"(?:^|/)pom\.xml\z", r"<module>\s*([^<\s]+)\s*</module>", ""),
    ("go", r"(?:^|/)go\.work\z", r"(?m)^\s*(?:use\s+)?(\.[\w./-]*)\s*$", ""),
    ("dotnet", r"\.sln\z", r'"([^"]+)[\\/][^"\\/]+\.csproj"', ""),
    ("cargo", r"(?:^|/)Cargo\.toml\z", QUOTED, r"(?m)^members\s*=\s*(\[[^\]]*\])"),
    ("cargo exclude", r"(?:^|/)Cargo\.toml\z", QUOTED, r"(?m)^exclude\s*=\s*(\[[^\]]*\])"),
    ("python", r"(?:^|/)(?:pyproject\.toml|setup\.py|setup\.cfg)\z", "", ""),
]


def packages(files: DataFrame) -> DataFrame:
    """(system, dir): folders of packages that build systems name, and members of workspaces. Cargo's globs need a Cargo.toml, and its exclusions are taken away."""
    none = F.array().cast("array<string>")

    def found(name: str, pattern: str, item: str, block: str) -> Column:
        text = F.array_join(F.regexp_extract_all("content", F.lit(block), F.lit(1)), "\n") if block else F.col("content")
        items = F.coalesce(F.regexp_extract_all(text, F.lit(item), F.lit(1)), none) if item else F.array(F.lit("."))
        return F.when(F.col("path").rlike(pattern), F.transform(items, lambda x: F.struct(F.lit(name).alias("system"), x.alias("item"))))

    cells = [found(*b) for b in BUILDS]
    rows = files.where(F.col("path").rlike("|".join(f"(?:{p})" for _, p, _, _ in BUILDS))).select(dirname("path").alias("dir"), F.explode(F.flatten(F.filter(F.array(*cells), lambda x: x.isNotNull()))).alias("x")).select("dir", "x.system", "x.item")
    rows = cut(rows)
    item = F.when(F.col("system") == "gradle", F.translate("item", ":", "/")).when(F.col("system") == "gradle flat", F.concat(F.lit("../"), "item")).otherwise(F.translate("item", "\\", "/"))
    rows = rows.select("system", at("dir", item).alias("dir")).where("dir is not null")
    crates = files.where(F.col("path").rlike(r"(?:^|/)Cargo\.toml\z")).select(F.col("path"))
    cargo = rows.where("system like 'cargo%'").select("system", F.concat(F.when(F.col("dir") == "", "").otherwise(F.concat("dir", F.lit("/"))), F.lit("Cargo.toml")).alias("glob"))
    cargo = cargo.join(globbed(crates, cargo.select("glob")), "glob").select("system", dirname("path").alias("dir"))
    members = cargo.where("system = 'cargo'").join(cargo.where("system = 'cargo exclude'"), "dir", "left_anti").select("system", "dir")
    # A Python project keeps its packages below src, if it has that folder.
    home = rows.where("system = 'python'").select("dir", at("dir", F.lit("src")).alias("src"))
    below = files.select(dirname("path").alias("sub")).distinct().select("sub", dirname("sub").alias("src"))
    python = home.join(below, "src").select(F.lit("python").alias("system"), F.col("sub").alias("dir"))
    other = rows.where("system not like 'cargo%' and system <> 'python'").select(F.regexp_replace("system", " flat", "").alias("system"), "dir")
    member = workspaces(files).select(F.lit("workspace").alias("system"), "dir")
    return other.union(members).union(python).union(member).distinct()


def load_options(files: DataFrame, defaults: dict | None = None, overrides: dict | None = None) -> dict[str, list[str]]:
    """Lists by name from defaults, then `loomline.json`, then `.loomlineignore` (added to `ignore`), then overrides; later ones replace earlier ones.

    At most the two files at the top of the tree come to the driver.
    """
    rows = {r.path: r.content or "" for r in files.where("path in ('loomline.json', '.loomlineignore')").select("path", "content").collect()}
    out = {**(defaults or {}), **json.loads(rows.get("loomline.json") or "{}")}
    ignored = [x.strip() for x in rows.get(".loomlineignore", "").splitlines()]
    ignored = [x for x in ignored if x and not x.startswith("#")]
    if ignored:
        out["ignore"] = [*out.get("ignore", []), *ignored]
    return {**out, **(overrides or {})}
