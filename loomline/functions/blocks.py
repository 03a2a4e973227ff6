"""What encloses what in a text: a stack over its brackets, or its indentation, without a grammar."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.facts import CODE, LANG, fact, of, told

MEMBERS = "array<struct<owner: string, name: string, kind: string, marks: array<string>>>"
#: Strings and characters, whose brackets count for nothing; one character of Rust between quotes isn't a lifetime.
STRINGS = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|\'[^\'\\\n]*+(?:\\.[^\'\\\n]*+)*+\'|`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`'
RUST_STRINGS = r'r#*"[\s\S]*?"#*|"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"|\'(?:\\[^\']{1,8}|[^\'\\])\''


@dataclass(frozen=True)
class Syntax:
    """How a language writes what has a name.

    `tokens` are all that is looked at, brackets besides; `name` takes from one
    the name that it declares, `block` that of the block that it opens, `mark` a
    decorator, an annotation or an attribute, which belongs to what is declared next.
    """

    tokens: str
    name: str
    block: str
    mark: str = r"^@([\w.]+)"
    strings: str = STRINGS
    not_names: tuple[str, ...] = ()
    #: Takes the owner from the token itself, where the language says it there.
    owner: str = ""


#: Words before a bracket that declare nothing.
CONTROL = ("if", "for", "while", "switch", "catch", "with", "function", "return", "synchronized", "using", "lock", "foreach", "when", "fixed", "super", "this", "new")
_CALLABLE = r"(?<![\w$.])[\w$]++\s*(?:<[^<>(){};]*>\s*)?\([^(){};]*\)\s*(?::\s*[\w$<>\[\]., |]+|throws\s+[\w.,\s]+)?\{"
SYNTAX = {
    "javascript": Syntax(rf"\bclass\s+[\w$]+[^{{}};]*\{{|\bfunction\s*\*?\s*[\w$]+|{_CALLABLE}|@[A-Za-z][\w.]*", r"^(?:class\s+|function\s*\*?\s*)?([\w$]+)", r"^class\s+([\w$]+)", not_names=CONTROL),
    "java": Syntax(rf"\b(?:class|interface|enum|record)\s+\w+[^{{}};]*\{{|{_CALLABLE}|@[A-Za-z][\w.]*", r"^(?:(?:class|interface|enum|record)\s+)?(\w+)", r"^(?:class|interface|enum|record)\s+(\w+)", not_names=CONTROL),
    "kotlin": Syntax(r"\b(?:class|interface|object)\s+\w+[^{};]*?\{|\bfun\s+(?:<[^>]*>\s*)?(?:[\w<>?]+\.)?\w+|@[A-Za-z][\w.]*", r"^(?:(?:class|interface|object)\s+|fun\s+(?:<[^>]*>\s*)?(?:[\w<>?]+\.)?)(\w+)", r"^(?:class|interface|object)\s+(\w+)"),
    "csharp": Syntax(rf"\bnamespace\s+[\w.]+\s*\{{|\b(?:class|interface|enum|record|struct)\s+\w+[^{{}};]*\{{|{_CALLABLE}|(?m:^)[ \t]*\[\s*[A-Z]\w*", r"^(?:(?:class|interface|enum|record|struct)\s+)?(\w+)", r"^(?:namespace|class|interface|enum|record|struct)\s+([\w.]+)", r"^\s*\[\s*(\w+)", not_names=(*CONTROL, "namespace")),
    "rust": Syntax(r"\bmod\s+(?:r#)?\w+\s*[{;]|\bimpl\b[^{};]*\{|\b(?:fn|struct|enum|trait|union)\s+\w+|#\[\s*[\w:]+", r"^(?:mod\s+(?:r#)?|(?:fn|struct|enum|trait|union)\s+)(\w+)", r"^(?:mod\s+(?:r#)?|impl\b(?:\s*<[^>]*>)?(?:[^{};]*\bfor\s+)?\s*(?:\w+::)*)(\w+)", r"^#\[\s*([\w:]+)", RUST_STRINGS),
    "go": Syntax(r"(?m:^)func\s+(?:\([^)]*\)\s*)?\w+|(?m:^)type\s+\w+", r"^(?:func\s+(?:\([^)]*\)\s*)?|type\s+)(\w+)", r"^\z", owner=r"^func\s+\(\s*(?:\w+\s+)?\*?(\w+)"),
}


def _stacked(code: Column, syntax: Syntax) -> Column:
    """Members of a text with brackets: each with the names of the blocks around it, outermost first, joined by dots."""
    tokens = F.regexp_extract_all(F.regexp_replace(code, syntax.strings, '""'), F.lit(f"{syntax.tokens}|[{{}}]"), F.lit(0))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("stack"), none.alias("marks"), F.array().cast(MEMBERS).alias("out"))

    def step(acc: Column, token: Column) -> Column:
        found, mark = F.regexp_extract(token, syntax.name, 1), F.regexp_extract(token, syntax.mark, 1)
        declares = (found != "") & ~found.isin(*syntax.not_names) if syntax.not_names else found != ""
        owner = F.array_join(F.filter(acc["stack"], lambda x: x != ""), ".")
        if syntax.owner:
            owner = F.regexp_extract(token, syntax.owner, 1)
        kind = F.when(token.rlike(r"^(?:class|interface|enum|record|struct|object|trait|union|type)\b"), "type").when(token.startswith("mod"), F.when(token.endswith(";"), "module").otherwise("block")).otherwise("callable")
        member = F.struct(owner.alias("owner"), found.alias("name"), kind.alias("kind"), acc["marks"].alias("marks"))
        stack = F.when(token == "}", F.slice(acc["stack"], 1, F.greatest(F.size(acc["stack"]) - 1, F.lit(0)))).when(token.endswith("{"), F.array_append(acc["stack"], F.regexp_extract(token, syntax.block, 1))).otherwise(acc["stack"])
        marks = F.when(mark != "", F.array_append(acc["marks"], mark)).when(declares | token.isin("{", "}"), none).otherwise(acc["marks"])
        return F.struct(stack.alias("stack"), marks.alias("marks"), F.when(declares, F.array_append(acc["out"], member)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(tokens, start, step, lambda acc: acc["out"])


def _indented(code: Column) -> Column:
    """Members of a Python text: what is indented less, and came last, encloses."""
    tokens = F.regexp_extract_all(F.regexp_replace(code, STRINGS, '""'), F.lit(r"(?m:^)[ \t]*(?:@[\w.]+|(?:async[ \t]+def|def|class)[ \t]+\w+)"), F.lit(0))
    none = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<struct<indent: int, name: string>>").alias("stack"), none.alias("marks"), F.array().cast(MEMBERS).alias("out"))

    def step(acc: Column, token: Column) -> Column:
        bare = F.ltrim(F.regexp_replace(token, r"^[ \t]+", ""))
        indent, mark = (F.length(token) - F.length(bare)).cast("int"), F.regexp_extract(bare, r"^@([\w.]+)", 1)
        name = F.regexp_extract(bare, r"^(?:async[ \t]+def|def|class)[ \t]+(\w+)", 1)
        around = F.filter(acc["stack"], lambda x: x["indent"] < indent)
        member = F.struct(F.array_join(F.transform(around, lambda x: x["name"]), ".").alias("owner"), name.alias("name"), F.when(bare.startswith("class"), "type").otherwise("callable").alias("kind"), acc["marks"].alias("marks"))
        deeper = F.array_append(around, F.struct(indent.alias("indent"), name.alias("name")))
        declared = F.struct(deeper.alias("stack"), none.alias("marks"), F.array_append(acc["out"], member).alias("out"))
        return F.when(mark != "", F.struct(acc["stack"].alias("stack"), F.array_append(acc["marks"], mark).alias("marks"), acc["out"].alias("out"))).otherwise(declared)

    return F.aggregate(tokens, start, step, lambda acc: acc["out"])


@fact("members")
def _members(_options) -> Column:
    code, lang = F.col(CODE), F.col(LANG)
    out = F.when(lang == "python", _indented(code))
    for name, syntax in SYNTAX.items():
        out = out.when(lang == name, _stacked(code, syntax))
    return out


def rust_modules(code: Column) -> Column:
    """Files that `mod` asks for, by path below the text's own folder: those within inline modules lie in folders named like them."""
    syntax = Syntax(r"\bmod\s+(?:r#)?\w+\s*[{;]", r"^mod\s+(?:r#)?(\w+)", r"^mod\s+(?:r#)?(\w+)", r"^\z", RUST_STRINGS)
    asked = F.filter(_stacked(code, syntax), lambda m: m["kind"] == "module")
    return F.transform(asked, lambda m: F.concat(F.translate(m["owner"], ".", "/"), F.when(m["owner"] == "", "").otherwise("/"), m["name"]))


@fact("tags")
def _tags(_options) -> Column:
    """Tags of fields of Go's structures: struct(field, key, value)."""
    pattern = r"(?m)^[ \t]*(\w+)[ \t]+[^\n`{}]*`([^`\n]*)`"
    both = F.arrays_zip(F.regexp_extract_all(CODE, F.lit(pattern), F.lit(1)).alias("field"), F.regexp_extract_all(CODE, F.lit(pattern), F.lit(2)).alias("text"))
    pair = r'(\w+):"((?:[^"\\]|\\.)*)"'

    def pairs(s: Column) -> Column:
        zipped = F.arrays_zip(F.regexp_extract_all(s["text"], F.lit(pair), F.lit(1)).alias("key"), F.regexp_extract_all(s["text"], F.lit(pair), F.lit(2)).alias("value"))
        return F.transform(zipped, lambda z: F.struct(s["field"].alias("field"), z["key"].alias("key"), z["value"].alias("value")))

    return F.when(F.col(LANG) == "go", F.flatten(F.transform(both, pairs)))


def members(files: DataFrame) -> DataFrame:
    """(path, owner, name, kind, marks) of what files declare: types, callables, modules, and inline ones as blocks.

    `owner` has the names around it, joined by dots; of a Go method it is its
    receiver. `marks` are decorators, annotations or attributes before it.
    Brackets in strings, characters, templates and comments count for nothing.
    """
    return told(files, "members").select("path", F.inline(of("members")))


def struct_tags(files: DataFrame) -> DataFrame:
    """(path, field, key, value) of the tags of Go's structures."""
    return told(files, "tags").select("path", F.inline(of("tags")))
