"""Packages, workspaces and compiler configurations of a source tree, as joins on exploded candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.paths import ancestors, dirname, glob_pattern, glob_root, normalise
from loomline.functions.references import file_keys, references
from loomline.operators import graph
from loomline.operators.lineage import cut

#: Conditions of an exports map, preferred first; others follow, and `types` is never run.
CONDITIONS = ("source", "import", "module", "require", "node", "browser", "default")
JSON_MAP, JSON_LIST = "map<string,string>", "array<string>"


def plain_json(text: Column) -> Column:
    """JSON with comments and last commas, without them; strings stay as they are."""
    return F.regexp_replace(F.regexp_replace(text, r'(?s)("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', "$1"), r",(\s*[}\]])", "$1")


def at(folder: Column | str, *parts: Column | str) -> Column:
    """A path below a folder, which is empty for the top; null if it leads above it."""
    return normalise(F.concat_ws("/", F.nullif(F.col(folder) if isinstance(folder, str) else folder, F.lit("")), *parts))


def named(files: DataFrame, pattern: str) -> DataFrame:
    """(path, dir, json) of files whose path matches."""
    return files.where(F.col("path").rlike(pattern)).select("path", dirname("path").alias("dir"), plain_json(F.coalesce("content", F.lit(""))).alias("json"))


def manifests(files: DataFrame) -> DataFrame:
    """(path, dir, json) of package manifests."""
    return named(files, r"(?:^|/)package\.json\z")


#: Kinds of files whose texts say what others are for.
KINDS = {"package": r"(?:^|/)package\.json\z", "deno": r"(?:^|/)deno\.jsonc?\z", "compiler": r"(?:^|/)[jt]sconfig[^/]*\.json\z", "bundler": r"(?:^|/)(?:vite|webpack|rspack|vitest)[^/]*\.[cm]?[jt]s\z", "go": r"(?:^|/)go\.mod\z", "project": r"\.csproj\z", "page": r"\.html?\z", "any": ""}


def kinds(files: DataFrame) -> set[str]:
    """Which of KINDS there are among files with a text; by one row, so that nothing is planned for kinds that a tree doesn't have."""
    row = files.where("content is not null").agg(*(F.coalesce(F.bool_or(F.col("path").rlike(p)), F.lit(False)).alias(k) for k, p in KINDS.items())).first()
    return {k for k in KINDS if row[k]}


def strings(value: Column) -> Column:
    """A JSON list of strings, or the one string that stands in its place; empty for anything else."""
    none = F.array().cast(JSON_LIST)
    return F.when(value.startswith("["), F.coalesce(F.from_json(value, JSON_LIST), none)).when(value.isNotNull() & ~value.startswith("{"), F.array(value)).otherwise(none)


def workspace_globs(files: DataFrame) -> DataFrame:
    """(dir, glob, negated): what package managers and monorepo tools name as members, wherever a workspace begins."""
    npm = manifests(files).select("dir", F.explode(F.concat(strings(F.get_json_object("json", "$.workspaces")), strings(F.get_json_object("json", "$.workspaces.packages")))).alias("glob"))
    lists = named(files, r"(?:^|/)lerna\.json\z").select("dir", F.explode(strings(F.get_json_object("json", "$.packages"))).alias("glob"))
    rush = named(files, r"(?:^|/)rush\.json\z").select("dir", F.explode(F.regexp_extract_all("json", F.lit(r'"projectFolder"\s*:\s*"([^"]+)"'), F.lit(1))).alias("glob"))
    nx = named(files, r"(?:^|/)nx\.json\z").select("dir", F.explode(F.array(F.lit("apps/*"), F.lit("libs/*"), F.lit("packages/*"))).alias("glob"))
    deno = named(files, r"(?:^|/)deno\.jsonc?\z").select("dir", F.explode(strings(F.get_json_object("json", "$.workspace"))).alias("glob"))
    yaml = files.where(F.col("path").rlike(r"(?:^|/)pnpm-workspace\.ya?ml\z")).select(dirname("path").alias("dir"), F.explode(F.regexp_extract_all("content", F.lit(r"""(?m)^\s*-\s*['"]?([^'"#\n]+?)['"]?\s*$"""), F.lit(1))).alias("glob"))
    every = cut(npm.union(lists).union(rush).union(nx).union(deno).union(yaml))
    bare = F.regexp_replace(F.regexp_replace("glob", r"^!", ""), r"^\./|/+\z", "")
    return every.select("dir", bare.alias("glob"), F.col("glob").startswith("!").alias("negated")).distinct()


def workspaces(files: DataFrame) -> DataFrame:
    """(root, dir): member folders with a manifest of their own, of workspaces at any depth.

    A glob meets the folders below its part without wildcards, by an equi-join
    on their ancestors; the pattern is tried on those only. Negated globs take members away.
    """
    homes = files.where(F.col("path").rlike(r"(?:^|/)(?:package\.json|deno\.jsonc?|project\.json)\z")).select(dirname("path").alias("dir")).distinct().where("dir <> ''")
    probes = homes.select("dir", F.explode(F.array_union(ancestors("dir"), F.array("dir"))).alias("base"))
    found = workspace_globs(files)
    if found.isEmpty():
        return homes.select(F.lit("").alias("root"), "dir").limit(0)
    globs = found.select(F.col("dir").alias("root"), at("dir", glob_root(F.col("glob"))).alias("base"), glob_pattern(at("dir", "glob")).alias("pattern"), "negated").where("base is not null")
    hits = probes.join(globs, "base").where(F.expr("dir rlike pattern")).groupBy("root", "dir").agg(F.max("negated").alias("negated"))
    return hits.where("not negated").select("root", "dir")


def exports_targets(files: DataFrame) -> DataFrame:
    """(dir, name, subpath, target, rank): what each subpath of a package's exports map may stand for; rank 0 is preferred.

    The map is walked level by level until nothing is open, however deep objects
    and lists nest. Values of `types` are left out. What is taken at each level
    (a condition's place in CONDITIONS, an item's in its list) makes an array,
    and arrays compare in order.
    """
    none = F.array().cast(JSON_LIST)
    top = cut(manifests(files).select("dir", F.get_json_object("json", "$.name").alias("name"), F.get_json_object("json", "$.exports").alias("value")).where("value is not null"))
    entries = F.from_json("value", JSON_MAP)
    subpaths = F.exists(F.coalesce(F.map_keys(entries), none), lambda k: k.startswith("."))
    split = top.where(F.col("value").startswith("{") & subpaths).select("dir", "name", F.explode(entries).alias("subpath", "value"))
    whole = top.where(~(F.col("value").startswith("{") & subpaths)).select("dir", "name", F.lit(".").alias("subpath"), "value")
    order = F.lit(len(CONDITIONS))
    for i, c in reversed(list(enumerate(CONDITIONS))):
        order = F.when(F.col("condition") == c, i).otherwise(order)
    keep = ["dir", "name", "subpath"]
    open_, done = split.union(whole).withColumn("taken", F.array().cast("array<int>")), None
    while True:
        open_ = cut(open_.where("value is not null"))
        nested = F.col("value").rlike(r"^[\[{]")
        done = open_.where(~nested) if done is None else done.union(open_.where(~nested))
        if open_.where(nested).isEmpty():
            break
        objects = open_.where(F.col("value").startswith("{")).select(*keep, F.explode(entries).alias("condition", "value"), "taken").where("condition not like 'types%'")
        lists = open_.where(F.col("value").startswith("[")).select(*keep, F.posexplode(F.from_json("value", JSON_LIST)).alias("at", "value"), "taken")
        open_ = objects.select(*keep, "value", F.array_append("taken", order).alias("taken")).union(lists.select(*keep, "value", F.array_append("taken", F.col("at")).alias("taken")))
    best = done.where(F.col("value").startswith(".")).groupBy(*keep, F.col("value").alias("target")).agg(F.min("taken").alias("taken"))
    ranked = best.groupBy(*keep).agg(F.sort_array(F.collect_list(F.struct("taken", "target"))).alias("t"))
    # Small, but read in several places: written once.
    return cut(ranked.select(*keep, F.posexplode("t").alias("place", "t")).select(*keep, F.col("t.target").alias("target"), F.col("place").cast("long").alias("rank")))


def sources_of(target: Column) -> Column:
    """A path and what build output at it may be made from, as keys of files: the path, its src twin, and both without extensions."""
    built = F.regexp_replace(target, r"(^|/)(?:dist|lib|build|out|esm|cjs)/", "$1src/")
    flat = F.regexp_replace(target, r"(^|/)(?:dist|lib|build|out|esm|cjs)/", "$1")
    every = F.flatten(F.transform(F.array(target, built, flat), lambda x: F.array(x, F.regexp_replace(x, r"(?:\.d)?\.[^./]+\z", ""))))
    return F.transform(F.array_distinct(every), lambda x: F.concat(F.lit("p:"), x))


def export_aliases(files: DataFrame) -> DataFrame:
    """(dir, prefix, target): names of packages with subpaths, and the sources they stand for; a wildcard is cut off on both sides."""
    rows = exports_targets(files).where("rank = 0 and name is not null")
    name = F.concat("name", F.regexp_replace(F.regexp_replace("subpath", r"^\.", ""), r"/?\*.*\z", ""))
    target = at("dir", F.regexp_replace("target", r"/?\*.*\z", ""))
    bare = F.regexp_replace(F.regexp_replace(target, r"(^|/)(?:dist|lib|build|out|esm|cjs)(/|\z)", "$1src$2"), r"(?:\.d)?\.[^./]+\z", "")
    return rows.select(F.lit("").alias("dir"), name.alias("prefix"), F.explode(F.array_distinct(F.array(target, bare))).alias("target")).where("target is not null").distinct()


def package_entries(files: DataFrame) -> DataFrame:
    """(path, reason): files that manifests at any depth name: main, module, source, types, browser, bin and exports; without any, the index of a package."""
    rows = manifests(files)
    fields = ("main", "module", "source", "types", "browser", "bin")
    one = rows.select("dir", F.explode(F.array(*(F.struct(F.get_json_object("json", f"$.{k}").alias("file"), F.lit(f"manifest {k}").alias("reason")) for k in fields))).alias("x")).select("dir", "x.file", "x.reason").where("file is not null and file not like '{%'")
    bins = rows.select("dir", F.explode(F.map_values(F.from_json(F.get_json_object("json", "$.bin"), JSON_MAP))).alias("file")).select("dir", "file", F.lit("manifest bin").alias("reason"))
    targets = exports_targets(files)
    out = targets.where("target not like '%*%'").select("dir", F.col("target").alias("file"), F.lit("manifest exports").alias("reason"))
    said = F.coalesce(*(F.get_json_object("json", f"$.{k}") for k in (*fields, "exports")))
    index = rows.where(said.isNull()).select("dir", F.explode(F.array(F.lit("index"), F.lit("src/index"))).alias("file")).select("dir", "file", F.lit("manifest index").alias("reason"))
    deno = named(files, r"(?:^|/)deno\.jsonc?\z").select("dir", F.get_json_object("json", "$.exports").alias("value"))
    deno = deno.select("dir", F.explode(F.concat(strings(F.col("value")), F.coalesce(F.map_values(F.from_json("value", JSON_MAP)), F.array().cast(JSON_LIST)))).alias("file")).select("dir", "file", F.lit("manifest exports").alias("reason"))
    where = one.union(bins).union(out).union(index).union(deno).select("reason", at("dir", "file").alias("target"))
    keys = where.select("reason", F.explode(sources_of(F.col("target"))).alias("key"))
    direct = keys.join(file_keys(files.select("path"), "p"), "key").select(F.col("target").alias("path"), "reason")
    # Wildcards of exports maps: all files below the part before the star, whose end is the part behind it.
    # Their star crosses folders.
    stars = targets.where("target like '%*%'").withColumn("target", F.replace("target", F.lit("*"), F.lit("**"))).select(F.explode(F.array_distinct(F.array(at("dir", "target"), F.regexp_replace(at("dir", "target"), r"(^|/)(?:dist|lib|build|out|esm|cjs)/", "$1src/")))).alias("glob"))
    return direct.union(globbed(files, stars).select("path", F.lit("manifest exports").alias("reason"))).distinct()


def globbed(files: DataFrame, globs: DataFrame) -> DataFrame:
    """(glob, path): files that globs (glob, from the top) match. They meet on the folder before the first wildcard, so that no pattern is tried on all files.

    The extension of a glob's last part may be that of a compiled file: .js stands for sources in TypeScript, too.
    """
    source = F.regexp_replace(F.col("glob"), r"\.[cm]?jsx?\z", ".{js,jsx,mjs,cjs,ts,tsx,mts,cts}")
    rows = globs.where("glob is not null").distinct().select("glob", F.explode(F.array_distinct(F.array(F.col("glob"), source))).alias("g")).select("glob", glob_root(F.col("g")).alias("base"), glob_pattern(F.col("g")).alias("pattern"))
    rows = cut(rows)
    if rows.isEmpty():
        return files.sparkSession.createDataFrame([], "glob string, path string")
    probes = files.select("path", F.explode(ancestors("path")).alias("base"))
    return probes.join(rows, "base").where(F.expr("path rlike pattern")).select("glob", "path").distinct()


def configurations(files: DataFrame) -> DataFrame:
    """(path, dir, json, base, level): compiler configurations and all that their `extends` leads to, itself first; of two bases that of the lesser level (an array) wins.

    Chains of any length, in as many rounds as the logarithm of it: each round
    joins what is known of a base to what is known of those that lead to it. Of a
    list the last one wins, with all that it leads to, before the one before it.
    A route doesn't pass a configuration twice, so rings end.
    """
    every = cut(named(files, r"(?:^|/)[jt]sconfig[^/]*\.json\z").select("path", "dir", "json"))
    up = every.select("path", "dir", F.posexplode(strings(F.get_json_object("json", "$.extends"))).alias("at", "to")).where(F.col("to").rlike(r"^\.{1,2}/|^/"))
    up = up.select("path", "at", at("dir", F.when(F.col("to").endswith(".json"), F.col("to")).otherwise(F.concat("to", F.lit(".json")))).alias("base"))
    steps = up.where("base <> path").groupBy("path", "base").agg(F.max("at").alias("at"))
    known = cut(steps.join(every.select(F.col("path").alias("base")), "base").select("path", "base", F.array(-F.col("at")).alias("level"), F.array("base").alias("route")))
    while not known.isEmpty():
        more = known.select(F.col("path").alias("base"), F.col("base").alias("further"), F.col("level").alias("on"), F.col("route").alias("rest"))
        longer = known.join(more, "base").where((F.col("further") != F.col("path")) & ~F.arrays_overlap("route", "rest") & ~F.array_contains("rest", F.col("path")))
        longer = longer.select("path", F.col("further").alias("base"), F.concat("level", "on").alias("level"), F.concat("route", "rest").alias("route"))
        best = cut(known.union(longer).groupBy("path", "base").agg(F.min(F.struct("level", "route")).alias("x")).select("path", "base", "x.level", "x.route"))
        new = best.join(known, ["path", "base", "level"], "left_anti")
        known, ended = best, new.isEmpty()
        if ended:
            break
    own = every.select("path", F.col("path").alias("base"), F.array().cast("array<int>").alias("level"))
    return cut(own.union(known.select("path", "base", "level")).join(every.select(F.col("path").alias("base"), "dir", "json"), "base"))


def _nearest(chain: DataFrame, field: str) -> DataFrame:
    """(path, dir, value): a field of each configuration, from the first of its chain that has it, with that one's folder."""
    rows = chain.select("path", "level", "dir", F.get_json_object("json", f"$.{field}").alias("value")).where("value is not null")
    return rows.groupBy("path").agg(F.min_by(F.struct("dir", "value"), F.col("level")).alias("x")).select("path", "x.dir", "x.value")


def config_aliases(files: DataFrame) -> DataFrame:
    """(dir, prefix, target): paths and baseUrl (prefix empty) of compiler configurations, a child's over its parents'."""
    chain = configurations(files)
    star = r"/?\*\z"
    based = _nearest(chain, "compilerOptions.baseUrl").select("path", at("dir", "value").alias("base"))
    mapped = _nearest(chain, "compilerOptions.paths").select("path", F.col("dir").alias("home"), F.explode(F.from_json("value", "map<string,array<string>>")).alias("alias", "targets"))
    mapped = mapped.join(based, "path", "left").select("path", F.coalesce("base", "home").alias("base"), F.regexp_replace("alias", star, "").alias("prefix"), F.explode("targets").alias("to"))
    rows = mapped.select("path", "prefix", at("base", F.regexp_replace("to", star, "")).alias("target")).union(based.select("path", F.lit("").alias("prefix"), F.col("base").alias("target")))
    return rows.select(dirname("path").alias("dir"), "prefix", "target").where("target is not null").distinct()


def config_entries(files: DataFrame) -> DataFrame:
    """(path, reason): files that `files` and `include` of compiler configurations name, by path or glob."""
    chain = configurations(files)
    rows = _nearest(chain, "files").withColumn("kind", F.lit("files")).union(_nearest(chain, "include").withColumn("kind", F.lit("include")))
    globs = rows.select("kind", "dir", F.explode(strings(F.col("value"))).alias("item")).select("kind", at("dir", "item").alias("glob"))
    # Folders and globs over the whole tree say what is compiled, not what is run.
    exact = globs.where(F.col("glob").rlike(r"\.[a-z]+\z") & ((F.col("kind") == "files") | (glob_root(F.col("glob")) != "") | ~F.col("glob").contains("*")))
    return globbed(files, exact.select("glob")).select("path", F.lit("compiler configuration").alias("reason")).distinct()


def go_modules(files: DataFrame) -> DataFrame:
    """(dir, prefix, target): module paths of go.mod files and the folders they stand for."""
    rows = files.where(F.col("path").rlike(r"(?:^|/)go\.mod\z")).select(dirname("path").alias("target"), F.regexp_extract("content", r"(?m)^module\s+(\S+)", 1).alias("prefix"))
    return rows.where("prefix <> ''").select(F.lit("").alias("dir"), "prefix", "target")


def project_edges(files: DataFrame) -> DataFrame:
    """(src, dst): references between C# projects, by their paths."""
    rows = files.where(F.col("path").rlike(r"\.csproj\z")).select(F.col("path").alias("src"), dirname("path").alias("dir"), F.explode(F.regexp_extract_all("content", F.lit(r'<ProjectReference\s[^>]*Include\s*=\s*"([^"]+)"'), F.lit(1))).alias("to"))
    return rows.select("src", at("dir", F.translate("to", "\\", "/")).alias("dst")).where("dst is not null")


def live_projects(files: DataFrame) -> DataFrame:
    """(dir): folders of projects that an application, a project whose folder has a Program or Startup, leads to; of all, if there is no application."""
    projects = files.where(F.col("path").rlike(r"\.csproj\z")).select(F.col("path").alias("node"), dirname("path").alias("dir"))
    starts = files.where(F.col("path").rlike(r"(?:^|/)(?:Program|Startup)\.cs\z")).select(dirname("path").alias("dir")).distinct()
    seeds = projects.join(starts, "dir", "left_semi")
    if seeds.isEmpty():
        return projects.select("dir").distinct()
    live = graph.reachable(project_edges(files), seeds.select("node"))
    return projects.join(live, "node", "left_semi").select("dir").distinct()


def in_live_projects(files: DataFrame) -> DataFrame:
    """(path, reason): C# files below a live project's folder, by a join on exploded ancestors."""
    probes = files.where(F.col("path").rlike(r"\.cs\z")).select("path", F.explode(ancestors("path")).alias("dir"))
    return probes.join(live_projects(files), "dir", "left_semi").select("path", F.lit("project").alias("reason")).distinct()


def submodules(files: DataFrame) -> DataFrame:
    """(dir): folders that version control keeps elsewhere."""
    return files.where("path = '.gitmodules'").select(F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^\s*path\s*=\s*(\S+)\s*$"), F.lit(1))).alias("dir"))


def without_submodules(files: DataFrame) -> DataFrame:
    """Files outside those folders. The folders, which one file at the top of the tree names, come to the driver, so that rows with contents meet no join."""
    outside = F.lit(True)
    for r in submodules(files.select("path", "content")).where("dir <> ''").collect():
        outside = outside & ~F.col("path").startswith(r.dir.rstrip("/") + "/")
    return files.where(outside)


def depended_on(files: DataFrame) -> DataFrame:
    """(package): names that any manifest depends on."""
    fields = F.array(*(F.map_keys(F.from_json(F.get_json_object("json", f"$.{f}"), JSON_MAP)) for f in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")))
    return manifests(files).select(F.explode(F.flatten(F.filter(fields, lambda x: x.isNotNull()))).alias("package")).distinct()


#: Fields by which a package is published, or run by itself.
PUBLISHED = ("main", "module", "source", "types", "browser", "bin", "exports", "ember", "ember-addon", "angular", "ng-package", "scripts.start", "scripts.dev", "scripts.build")
#: Files beside a manifest that make it one of another language's project.
OTHER_PROJECTS = r"(?:^|/)(?:pyproject\.toml|setup\.(?:py|cfg)|go\.mod|Cargo\.toml|build\.gradle|pom\.xml|Gemfile|mix\.exs|Package\.swift)\z"


def package_edges(files: DataFrame) -> DataFrame:
    """(src, dst): folders of packages, where the first depends on the second's name, or has code that imports it."""
    homes = manifests(files).select("dir", F.get_json_object("json", "$.name").alias("package"))
    fields = F.array(*(F.map_keys(F.from_json(F.get_json_object("json", f"$.{f}"), JSON_MAP)) for f in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")))
    told = manifests(files).select("dir", F.explode(F.flatten(F.filter(fields, lambda x: x.isNotNull()))).alias("package"))
    known = homes.where("package is not null")
    # Few names of all that are imported are packages of the tree, and few folders import each.
    used = references(files).where("language = 'javascript'").select(dirname("path").alias("folder"), F.regexp_extract("module", r"^(?:@[^/]+/)?[^/]+", 0).alias("package")).distinct().join(known.select("package").distinct(), "package", "left_semi")
    probes = used.select("folder", "package", F.explode(F.array_union(F.array("folder"), ancestors("folder"))).alias("dir")).join(homes.select("dir"), "dir")
    inside = probes.groupBy("folder", "package").agg(F.max_by("dir", F.length("dir")).alias("dir")).select("dir", "package")
    return told.union(inside).distinct().join(known.withColumnRenamed("dir", "dst"), "package").select(F.col("dir").alias("src"), "dst").where("src <> dst").distinct()


def abandoned(files: DataFrame) -> DataFrame:
    """(dir): packages that nothing published or run leads to or uses, over any number of packages in between; rings of them, too.

    The tree's own manifest, packages with one of PUBLISHED, and those that
    belong to another language's project stand by themselves.
    """
    rows = manifests(files).where("dir <> '' and get_json_object(json, '$.name') is not null")
    own = F.coalesce(*(F.get_json_object("json", "$['" + f.replace(".", "']['") + "']") for f in PUBLISHED))
    others = files.where(F.col("path").rlike(OTHER_PROJECTS)).select(dirname("path").alias("dir")).distinct()
    doubted = cut(rows.where(own.isNull()).join(others, "dir", "left_anti").select("dir"))
    if doubted.isEmpty():
        return doubted
    edges = cut(package_edges(files))
    every = manifests(files).select("dir").distinct()
    live = graph.reachable(edges.union(edges.select("dst", "src")), every.join(doubted, "dir", "left_anti").select(F.col("dir").alias("node")))
    return doubted.join(live.withColumnRenamed("node", "dir"), "dir", "left_anti")
