"""Languages by the ends of paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.functions.paths import extension

LANGUAGES = {
    "javascript": (".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".mts", ".cts", ".vue", ".svelte"),
    "python": (".py", ".pyi"),
    "java": (".java",),
    "kotlin": (".kt", ".kts"),
    "go": (".go",),
    "rust": (".rs",),
    "csharp": (".cs",),
}


def language(path: Column | str) -> Column:
    """Null for files that aren't parsed. The path's end is taken once, and looked up."""
    known = F.create_map(*(F.lit(x) for name, ends in LANGUAGES.items() for end in ends for x in (end, name)))
    return F.try_element_at(known, extension(path))


#: Ends of files that aren't code but belong to it.
STYLES, ASSETS = (".css", ".scss", ".sass", ".less"), (".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".ico", ".woff", ".woff2", ".ttf", ".eot")


def category(path: Column | str) -> Column:
    """The language, or css, assets, or other."""
    ext = extension(path)
    return F.coalesce(language(path), F.when(ext.isin(*STYLES), "css").when(ext.isin(*ASSETS), "assets").otherwise("other"))
