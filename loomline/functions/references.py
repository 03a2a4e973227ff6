"""What source files refer to and offer, as column expressions over their text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.blocks import rust_modules
from loomline.functions.facts import CODE, LANG, fact, of, told
from loomline.functions.languages import LANGUAGES, language
from loomline.functions.paths import ancestors, basename, dirname, extension, normalise, prefixes, stem, suffixes

#: Names that stand for their folder.
FOLDER_NAMES = ("index", "__init__", "mod")


def _all(text: Column, pattern: str, kind: str, group: int = 1) -> Column:
    return _kinds(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), kind)


def _kinds(modules: Column, kind: str) -> Column:
    return F.transform(modules, lambda m: F.struct(m.alias("module"), F.lit(kind).alias("kind")))


def _javascript(text: Column) -> Column:
    return F.concat(
        _all(text, r"""(?m)^\s*import\s+(?:type\s+)?(?:[\w$*{][^'"();]*?\sfrom\s*)?['"]([^'"\n]+)['"]""", "import"),
        _all(text, r"""(?m)^\s*export\s+(?:type\s+)?[*{][^'"();]*?\sfrom\s*['"]([^'"\n]+)['"]""", "reexport"),
        _all(text, r"""\bimport\(\s*['"]([^'"\n]+)['"]\s*\)""", "dynamic"),
        _all(text, r"""\brequire\(\s*['"]([^'"\n]+)['"]\s*\)""", "require"),
        _all(text, r"""\b(?:import\.meta\.glob|glob\.sync|globSync)\(\s*['"]([^'"\n]+)['"]""", "glob"),
        F.transform(F.regexp_extract_all(text, F.lit(r"""\brequire\.context\(\s*['"]([^'"\n]+)['"]"""), F.lit(1)), lambda m: F.struct(F.concat(F.regexp_replace(m, r"/+\z", ""), F.lit("/**")).alias("module"), F.lit("glob").alias("kind"))),
    )


def _python(text: Column) -> Column:
    pattern = r"(?m)^[ \t]*from[ \t]+([.\w]+)[ \t]+import[ \t]+(\([^)]*\)|[^\n#]*)"
    froms = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("b"))

    def names(s: Column) -> Column:
        bare = F.regexp_extract_all(F.regexp_replace(s["b"], r"#[^\n]*|\bas\s+\w+", ""), F.lit(r"\w+"), F.lit(0))
        return F.transform(bare, lambda n: F.concat(s["a"], F.when(s["a"].endswith("."), "").otherwise("."), n))

    plain = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*import[ \t]+([^\n#]*)"), F.lit(1)), lambda x: F.transform(F.split(x, ","), lambda y: F.regexp_extract(y, r"^\s*([\w.]+)", 1))))
    # Modules named in strings, where a package loads them by name, and its folder where it loads what it is asked for.
    named = F.when(text.rlike(r"\bimport_module\(|(?m)^def\s+__getattr__\("), F.regexp_extract_all(text, F.lit(r"""['"](\.?[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+)['"]"""), F.lit(1))).otherwise(F.array().cast("array<string>"))
    folder = F.when(text.rlike(r"(?m)^def\s+__getattr__\("), F.array(F.lit("."))).otherwise(F.array().cast("array<string>"))
    return F.concat(_kinds(plain, "import"), _kinds(F.transform(froms, lambda s: s["a"]), "from"), _kinds(F.flatten(F.transform(froms, names)), "submodule"), _kinds(named, "named"), _kinds(folder, "lazy"))


def _go(text: Column) -> Column:
    blocks = F.regexp_extract_all(text, F.lit(r'(?m)^import\s*(?:\w+\s*)?(\([^)]*\)|"[^"\n]*")'), F.lit(1))
    return _kinds(F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r'"([^"\n]+)"'), F.lit(1)))), "import")


def _rust(text: Column) -> Column:
    braces = r"\buse\s+((?:crate|super|self)(?:::\w+)*)::\{([^{}]*)\}"
    heads = F.arrays_zip(F.regexp_extract_all(text, F.lit(braces), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(braces), F.lit(2)).alias("b"))
    inner = F.flatten(F.transform(heads, lambda s: F.transform(F.regexp_extract_all(s["b"], F.lit(r"(?:^|,)\s*([\w:]+)"), F.lit(1)), lambda n: F.concat(s["a"], F.lit("::"), n))))
    return F.concat(
        _kinds(rust_modules(text), "mod"),
        _all(text, r"""#\[path\s*=\s*"([^"\n]+)"\]""", "path"),
        _all(text, r"""\binclude!\(\s*"([^"\n]+)"\s*\)""", "path"),
        _all(text, r"\buse\s+((?:crate|super|self)(?:::\w+)+)", "use"),
        _kinds(inner, "use"),
    )


def _csharp(text: Column) -> Column:
    return _all(text, r"(?m)^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([A-Z][\w.]*)\s*;", "using")


@fact("references")
def _references(_options) -> Column:
    text, lang = F.col(CODE), F.col(LANG)
    script = F.when(extension("path").isin(".vue", ".svelte"), F.regexp_extract(text, r"(?s)<script[^>]*>(.*?)</script>", 1)).otherwise(text)
    found = (
        F.when(lang == "javascript", _javascript(script))
        .when(lang == "python", _python(text))
        .when(lang.isin("java", "kotlin"), _all(text, r"(?m)^\s*import\s+(?:static\s+)?([\w.]+\*?)", "import"))
        .when(lang == "go", _go(text))
        .when(lang == "rust", _rust(text))
        .when(lang == "csharp", _csharp(text))
    )
    return F.array_distinct(found)


def references(files: DataFrame, *keys: str) -> DataFrame:
    """(path, `keys`, language, module, kind) of all imports in `files` (path, content), or in the facts of such; comments hold none."""
    rows = told(files.withColumn("language", language("path")).where("language is not null"), "references")
    return rows.select("path", *keys, "language", F.inline(of("references"))).where("module <> ''")


def is_upper_first(name: Column) -> Column:
    """Whether the first character is its own upper case."""
    return F.substring(name, 1, 1) == F.upper(F.substring(name, 1, 1))


def _listed(blocks: Column) -> Column:
    """Names that lists in braces offer: the last word of each item."""
    return F.flatten(F.transform(blocks, lambda x: F.transform(F.split(x, ","), lambda y: F.regexp_extract(y, r"([\w$]+)\s*$", 1))))


@fact("exports")
def _exports(_options) -> Column:
    text, lang = F.col(CODE), F.col(LANG)

    def every(pattern: str) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))

    script = F.concat(
        every(r"(?m)^\s*export\s+(?:declare\s+)?(?:default\s+)?(?:async\s+)?(?:abstract\s+)?(?:function\*?|class|const|let|var|interface|type|enum|namespace)\s+([\w$]+)"),
        _listed(every(r"(?m)^\s*export\s*(?:type\s*)?\{([^}]*)\}(?!\s*from)")),
        every(r"(?m)^\s*export\s+(default)\b"),
        # CommonJS: single names, and the keys of an object.
        every(r"(?m)^\s*(?:module\.)?exports\.([A-Za-z_$][\w$]*)\s*="),
        every(r"""\bdefineProperty\(\s*exports\s*,\s*['"]([\w$]+)['"]"""),
        F.flatten(F.transform(every(r"(?m)^\s*module\.exports\s*=\s*\{([^{}]*)\}"), lambda x: F.transform(F.split(x, ","), lambda y: F.regexp_extract(y, r"^\s*([A-Za-z_$][\w$]*)", 1)))),
    )
    listed = F.flatten(F.transform(every(r"(?m)^__all__\s*=\s*[\[(]([^\])]*)[\])]"), lambda x: F.regexp_extract_all(x, F.lit(r"""['"](\w+)['"]"""), F.lit(1))))
    python = F.when(F.size(listed) > 0, listed).otherwise(every(r"(?m)^(?:async\s+def|def|class)\s+([A-Za-z]\w*)"))
    java = every(r"(?m)^\s*public\s+(?:(?:static|final|abstract|sealed|strictfp)\s+)*(?:class|interface|enum|record|@interface)\s+(\w+)")
    kotlin = every(r"(?m)^(?!\s*(?:private|internal)\b)(?:(?:public|open|abstract|sealed|data|inline|suspend|const|enum|annotation|value|operator|infix)\s+)*(?:fun\s+interface|class|interface|object|typealias|fun(?:\s*<[^>]*>)?|val|var)\s+(?:[\w<>?]+\.)?(\w+)")
    go = F.filter(F.concat(every(r"(?m)^func\s+(?:\([^)]*\)\s*)?(\w+)"), every(r"(?m)^(?:type|var|const)\s+(\w+)")), is_upper_first)
    rust = every(r"(?m)^\s*pub(?:\([^)]*\))?\s+(?:(?:async|unsafe|const|extern\s+\"[^\"]*\")\s+)*(?:fn|struct|enum|union|trait|mod|type|static(?:\s+mut)?|const)\s+(?:r#)?(\w+)")
    sharp = every(r"(?m)^\s*(?:public|protected|internal)\s+(?:(?:static|sealed|abstract|partial|readonly|ref|unsafe|internal)\s+)*(?:class|interface|struct|enum|record(?:\s+struct|\s+class)?|delegate\s+[\w<>\[\]?]+)\s+(\w+)")
    names = F.when(lang == "javascript", script)
    for name, found in (("python", python), ("java", java), ("kotlin", kotlin), ("go", go), ("rust", rust), ("csharp", sharp)):
        names = names.when(lang == name, found)
    handed = F.when(lang == "javascript", F.concat(_listed(every(r"(?m)^\s*export\s*(?:type\s*)?\{([^}]*)\}\s*from")), every(r"(?m)^\s*export\s*\*\s*as\s+([\w$]+)\s+from"))).otherwise(F.array().cast("array<string>"))

    def flagged(found: Column, direct: bool) -> Column:
        return F.transform(F.array_distinct(F.coalesce(found, F.array().cast("array<string>"))), lambda n: F.struct(n.alias("name"), F.lit(direct).alias("is_direct")))

    return F.concat(flagged(names, True), flagged(F.array_except(handed, F.coalesce(names, handed)), False))


def exports(files: DataFrame) -> DataFrame:
    """(path, name, is_direct) of symbols that files offer; not direct: handed on from another file."""
    return told(files, "exports").select("path", F.inline(of("exports"))).where("name <> ''")


@fact("imports")
def _imports(_options) -> Column:
    text, lang = F.col(CODE), F.col(LANG)

    def pairs(pattern: str, name: Callable[[Column], Column], module: int = 2, what: int = 1) -> Column:
        both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(what)).alias("a"), F.regexp_extract_all(text, F.lit(pattern), F.lit(module)).alias("m"))
        return F.flatten(F.transform(both, lambda s: F.transform(name(s["a"]), lambda n: F.struct(s["m"].alias("module"), n.alias("name")))))

    def first_words(x: Column) -> Column:
        return F.filter(F.transform(F.split(x, ","), lambda y: F.regexp_extract(y, r"^\s*(?:type\s+)?([\w$]+)", 1)), lambda n: n != "")

    def one(value: str) -> Callable[[Column], Column]:
        return lambda x: F.array(F.lit(value))

    source = r"""\sfrom\s*['"]([^'"\n]+)['"]"""
    script = F.concat(
        pairs(r"(?m)^\s*import\s+(?:type\s+)?(?:[\w$]+\s*,\s*)?\{([^}]*)\}" + source, first_words),
        pairs(r"(?m)^\s*export\s+(?:type\s+)?\{([^}]*)\}" + source, first_words),
        pairs(r"(?m)^\s*(import)\s+[\w$]+\s*(?:,[^'\";]*?)?" + source, one("default")),
        pairs(r"(?m)^\s*(import|export)\s+(?:[\w$]+\s*,\s*)?\*(?:\s+as\s+[\w$]+)?" + source, one("*")),
        pairs(r"""(?m)^\s*(import)\s*['"]([^'"\n]+)['"]""", one("")),
        pairs(r"""\b(import|require)\(\s*['"]([^'"\n]+)['"]\s*\)""", one("*")),
    )
    froms = r"(?m)^[ \t]*from[ \t]+([.\w]+)[ \t]+import[ \t]+(\([^)]*\)|[^\n#]*)"
    python = pairs(froms, lambda x: F.regexp_extract_all(F.regexp_replace(x, r"#[^\n]*|\bas\s+\w+", ""), F.lit(r"\w+|\*"), F.lit(0)), module=1, what=2)
    found = F.when(lang == "javascript", script).when(lang == "python", python)
    return F.array_distinct(found)


def imported_names(files: DataFrame) -> DataFrame:
    """(path, module, name): what JavaScript and Python files take from a module: names as it offers them, `default`, `*` for all, and '' where it only runs."""
    return told(files, "imports").select("path", F.inline(of("imports")))


#: Beginnings of definitions: functions, classes and the like, whose name is the first group.
DEFINITIONS = {
    "javascript": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:abstract\s+)?(?:function\*?|class)\s+([\w$]+)|^\s*(?:export\s+)?(?:const|let|var)\s+([\w$]+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>",
    "python": r"^\s*(?:async\s+def|def|class)\s+(\w+)",
    "java": r"^\s*(?:(?:public|protected|private|static|final|abstract)\s+)*(?:class|interface|enum|record)\s+(\w+)",
    "kotlin": r"^\s*(?:\w+\s+)*?(?:class|interface|object|fun)\s+(\w+)",
    "go": r"^(?:func\s+(?:\([^)]*\)\s*)?|type\s+)(\w+)",
    "rust": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+)*(?:fn|struct|enum|trait)\s+(\w+)",
    "csharp": r"^\s*(?:\w+\s+)*?(?:class|interface|struct|record|enum)\s+(\w+)",
}


def definitions(files: DataFrame) -> DataFrame:
    """(path, definitions): the definitions of each file by line: struct(line_no, name, size), where size is the characters up to the next one."""
    every = F.split(F.coalesce("content", F.lit("")), "\n", -1)
    lang, name = language("path"), lambda x, p: F.coalesce(*(F.nullif(F.regexp_extract(x, p, g + 1), F.lit("")) for g in range(re.compile(p).groups)))

    # The language chooses the pattern once a row, outside the lines.
    def own(p: str) -> Column:
        return F.filter(F.transform("__lines", lambda x, i: F.struct((i + 1).alias("line_no"), name(x, p).alias("name"))), lambda s: s["name"].isNotNull())

    found = F.coalesce(*(F.when(F.col(LANG) == k, own(p)) for k, p in DEFINITIONS.items()))
    rows = files.where(lang.isNotNull()).select("path", lang.alias(LANG), every.alias("__lines")).select("path", "__lines", found.alias("__found"))
    stop = lambda i: F.coalesce(F.get("__found", i + 1)["line_no"], F.size("__lines") + 1)
    sized = F.transform("__found", lambda s, i: F.struct(s["line_no"].alias("line_no"), s["name"].alias("name"), F.length(F.array_join(F.slice("__lines", s["line_no"], stop(i) - s["line_no"]), "\n")).alias("size")))
    return rows.select("path", F.array_sort(sized).alias("definitions")).where(F.size("definitions") > 0)


#: Parts before the extension that name a platform.
PLATFORMS = r"\.(?:ios|android|web|native|macos|windows)\z"


#: By language, the kinds of keys that its references have: those of files (file_keys), and of classes: j and c.
KEY_KINDS = {"javascript": "p", "python": "psfi", "java": "dsjc", "kotlin": "dsjc", "go": "df", "rust": "ps", "csharp": "sd"}


def file_keys(paths: DataFrame, kinds: str = "psfdi") -> DataFrame:
    """(key, target): by what references may name a file, for these kinds of keys. p: path, s: end of a path, f: folder, d: end of its folder's path, i: the folder above that of a package's initial file."""
    bare = stem("path")
    name = F.regexp_replace(basename("path"), r"\..*\z", "")
    folder = dirname("path")
    own = {
        "p": F.array(F.concat(F.lit("p:"), F.col("path")), F.concat(F.lit("p:"), bare), F.concat(F.lit("p:"), F.regexp_replace(bare, PLATFORMS, "")), F.when(name.isin(*FOLDER_NAMES), F.concat(F.lit("p:"), folder))),
        "s": F.transform(suffixes(bare), lambda x: F.concat(F.lit("s:"), x)),
        "f": F.array(F.concat(F.lit("f:"), folder)),
        "d": F.transform(suffixes(folder), lambda x: F.concat(F.lit("d:"), x)),
        "i": F.array(F.when(name == "__init__", F.concat(F.lit("i:"), dirname(folder)))),
    }
    every = F.array_distinct(F.concat(*(keys for kind, keys in own.items() if kind in kinds), F.array().cast("array<string>")))
    return paths.select(F.explode(every).alias("key"), F.col("path").alias("target")).where("key is not null")


#: Packages of the languages themselves, which no tree holds.
PLATFORM_PACKAGES = r"^(?:java|javax|jdk|sun|kotlin|kotlinx|android|androidx)\."


def with_keys(refs: DataFrame, *keep: str) -> DataFrame:
    """`keep`, rank and key for each row of `references`: what file it may mean, the least rank first; external modules have keys that no file has.

    Paths are normalised once, when the keys are rows.
    """
    rows = refs.select(*keep, F.inline(_candidates())).where("key is not null")
    return rows.select(*keep, "rank", F.concat(F.substring("key", 1, 2), normalise(F.expr("substring(key, 3)"))).alias("key")).where("key is not null")


def _candidates() -> Column:
    """An array of struct(rank, key), where a key's path may have dots."""
    lang, kind, module, folder = F.col("language"), F.col("kind"), F.col("module"), dirname("path")

    def key(prefix: str, x: Column) -> Column:
        return F.concat(F.lit(prefix), x)

    def numbered(keys: Column) -> Column:
        return F.transform(keys, lambda k, i: F.struct((i + 1).alias("rank"), k.alias("key")))

    def ranked(*keys: Column) -> Column:
        return numbered(F.filter(F.array(*keys), lambda k: k.isNotNull()))

    near = F.concat_ws("/", folder, module)
    script = F.when(module.rlike(r"^\.\.?(?:/|\z)"), ranked(key("p:", near), F.when(extension(module).isin(*LANGUAGES["javascript"]), key("p:", stem(near)))))
    script = script.when(module.startswith("/"), ranked(key("p:", module))).otherwise(ranked(key("p:", module), key("p:", F.concat(F.lit("src/"), module))))
    script = F.when(kind != "glob", script)
    dots = F.length(F.regexp_extract(module, r"^\.*", 0))
    rest = F.translate(F.regexp_replace(module, r"^\.+", ""), ".", "/")
    relative = F.concat_ws("/", folder, F.repeat(F.lit("../"), dots - 1), rest)
    # The whole name, below the folders above the importer, nearest first; then without its last parts.
    shorter = F.reverse(prefixes(rest, "/"))
    below = F.flatten(F.transform(shorter, lambda r: F.transform(ancestors("path"), lambda d: F.concat(F.lit("p:"), d, F.when(d == "", "").otherwise("/"), r))))
    ends = F.when(rest.contains("/"), F.array(key("s:", rest))).otherwise(F.array().cast("array<string>"))
    python = F.when(dots > 0, ranked(key("p:", relative))).otherwise(numbered(F.concat(F.slice(below, 1, F.size(ancestors("path"))), ends, F.slice(below, F.size(ancestors("path")) + 1, F.size(below)))))
    both = F.array(F.struct(F.lit(1).alias("rank"), key("f:", folder).alias("key")), F.struct(F.lit(1).alias("rank"), key("i:", folder).alias("key")))
    python = F.when(kind == "lazy", both).otherwise(python)
    dotted = F.translate(module, ".", "/")
    jvm = F.when(module.rlike(PLATFORM_PACKAGES), F.array().cast("array<struct<rank: int, key: string>>"))
    parent = F.regexp_replace(module, r"\.[^.]*\z", "")
    # Declared packages come first, then ends of paths, then the name of a class alone.
    last = F.substring_index(module, ".", -1)
    alone = F.when(is_upper_first(last) & last.rlike("^[A-Za-z]"), key("c:", last))
    jvm = jvm.when(module.endswith(".*"), ranked(key("d:", F.regexp_replace(dotted, r"/\*\z", "")), key("s:", F.regexp_replace(dotted, r"/\*\z", "")))).otherwise(ranked(key("j:", module), key("j:", parent), key("s:", dotted), key("s:", dirname(dotted)), alone))
    ends_of = suffixes("module")
    go = F.transform(ends_of, lambda x, i: F.struct((i + 1).alias("rank"), key("d:", x).alias("key")))
    parts = F.split(module, "::")
    used = F.array_join(F.slice(parts, 2, F.size(parts)), "/")
    # The module's own folder: that of main, lib and mod is where they lie, that of others is named like them.
    own = F.when(F.regexp_replace(basename("path"), r"\..*\z", "").isin("main", "lib", "mod"), folder).otherwise(stem("path"))
    base = F.when(parts[0] == "self", own).when(parts[0] == "super", dirname(own))
    crate = ranked(key("s:", F.concat(F.lit("src/"), used)), key("s:", F.concat(F.lit("src/"), dirname(used))))
    at = F.concat_ws("/", base, used)
    rust = F.when(kind == "mod", ranked(key("p:", F.concat_ws("/", own, module)))).when(kind == "path", ranked(key("p:", near))).when(parts[0] == "crate", crate).otherwise(ranked(key("p:", at), key("p:", dirname(at))))
    sharp = ranked(key("s:", dotted), key("d:", dotted))
    return F.when(lang == "javascript", script).when(lang == "python", python).when(lang.isin("java", "kotlin"), jvm).when(lang == "go", go).when(lang == "rust", rust).when(lang == "csharp", sharp)
