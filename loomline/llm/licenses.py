"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory, in DataFrame operations only."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import cut, read

#: Notices as their licences ask for them, and titles of licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    # Titles with their versions and dates, by which whole licences begin.
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Artistic-1.0", "The Artistic License"),
    ("Artistic-2.0", "The Artistic License 2.0"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("CC0-1.0", "exclusive Copyright and Related Rights (defined below) upon the creator and subsequent owner(s) (each and all, an owner) of an original work of authorship and/or a database (each, a Work)"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("GFDL-1.2", "GNU Free Documentation License Version 1.2, November 2002"),
    ("GFDL-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    ("GPL-1.0", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MPL-1.1", "MOZILLA PUBLIC LICENSE Version 1.1"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
]
#: A header's first line has one of these; each template has one.
MARKS = "licen[cs]|copyright|public domain|permission is hereby|permission to use|redistribution"
TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Least cosine of a header (a line, or three lines from it on), and of a whole text that is a licence file by what it says.
HEADER, WHOLE = 0.6, 0.3
LICENSE_NAME = r"(?i)(?:^|/)(?:licen[cs]e|copying|unlicense|notice)[^/]*$"


def vectors(templates: list[tuple[str, str]]) -> tuple[dict[str, float], float, list[dict[str, float]]]:
    """Inverse document frequencies over the templates, that of any other word, and each template's unit vector."""
    counts = [Counter(re.findall(TOKEN, text.lower())) for _, text in templates]
    n = len(templates)
    idf = {w: math.log((1 + n) / (1 + sum(w in c for c in counts))) + 1 for w in sorted({w for c in counts for w in c})}
    out = []
    for c in counts:
        norm = math.sqrt(sum((k * idf[w]) ** 2 for w, k in c.items()))
        out.append({w: k * idf[w] / norm for w, k in c.items()})
    return idf, math.log(1 + n) + 1, out


def cosines(text: Column, idf: dict[str, float], other: float, unit: list[dict[str, float]]) -> Column:
    """The cosine of a lower-case text to each template, in one pass over its sorted words."""
    known = F.create_map(*[x for w in idf for x in (F.lit(w), F.array(F.lit(idf[w]), *(F.lit(float(v.get(w, 0.0))) for v in unit)))])
    none = F.array(F.lit(other), *[F.lit(0.0)] * len(unit))
    words = F.concat(F.array_sort(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))), F.array(F.lit("")))
    start = F.struct(F.lit("").alias("word"), F.lit(0).alias("n"), F.lit(0.0).alias("norm"), F.array(*[F.lit(0.0)] * len(unit)).alias("dots"))

    def merge(s: Column, word: Column) -> Column:
        same = F.struct(s["word"].alias("word"), (s["n"] + 1).alias("n"), s["norm"].alias("norm"), s["dots"].alias("dots"))

        def ended(v: Column) -> Column:
            dots = F.transform(s["dots"], lambda d, i: d + s["n"] * v[0] * F.get(v, i + 1))
            return F.struct(word.alias("word"), F.lit(1).alias("n"), (s["norm"] + F.pow(s["n"] * v[0], F.lit(2.0))).alias("norm"), dots.alias("dots"))

        return F.when(s["word"] == word, same).otherwise(F.transform(F.array(F.coalesce(F.try_element_at(known, s["word"]), none)), ended)[0])

    return F.aggregate(words, start, merge, lambda s: F.transform(s["dots"], lambda d: F.round(F.when(s["norm"] > 0, d / F.sqrt(s["norm"])).otherwise(0.0), 6)))


def own_licenses(files: DataFrame, keys: tuple[str, ...], templates=TEMPLATES, header: float = HEADER, whole: float = WHOLE) -> DataFrame:
    """`keys`, own_license, own_cosine, own_line and is_license_file for each row of `files` (with path and text).

    The whole text is searched: every line with one of the MARKS, alone and with
    the two lines after it. The highest cosine counts, then the earliest line
    and template. A licence file has a header and is named so, or its whole text has a
    cosine of `whole` or more.
    """
    idf, other, unit = vectors(templates)
    names = F.array(*[F.lit(name) for name, _ in templates])
    docs = files.select(*keys, F.col("path").cast("string").alias("__path"), F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("__text"))
    docs = docs.withColumn("__lines", F.when(F.col("__text").rlike(MARKS), F.split("__text", "\n", -1)))
    at = F.filter(F.transform("__lines", lambda x, i: F.struct((i + 1).alias("line"), x.alias("text"))), lambda s: s["text"].rlike(MARKS))
    at = F.flatten(F.transform(at, lambda s: F.array(s, F.struct(s["line"].alias("line"), F.concat_ws(" ", F.slice("__lines", s["line"], F.lit(3))).alias("text")))))
    docs = docs.withColumn("__found", F.transform(at, lambda s: F.struct(s["line"].alias("line"), cosines(s["text"], idf, other, unit).alias("c"))))
    best = F.array_max(F.transform("__found", lambda s: F.struct(F.array_max(s["c"]).alias("cosine"), (-s["line"]).alias("line"), (-F.array_position(s["c"], F.array_max(s["c"]))).alias("template"))))
    docs = docs.withColumn("__best", best).withColumn("__whole", F.when(F.size("__found") > 0, F.array_max(cosines(F.col("__text"), idf, other, unit))))
    good = F.coalesce(F.col("__best.cosine") >= header, F.lit(False))
    return docs.select(
        *keys,
        F.when(good, F.get(names, (-F.col("__best.template") - 1).cast("int"))).alias("own_license"),
        F.when(good, F.col("__best.cosine")).alias("own_cosine"),
        F.when(good, (-F.col("__best.line")).cast("long")).alias("own_line"),
        (good & F.coalesce(F.col("__path").rlike(LICENSE_NAME) | (F.col("__whole") >= whole), F.lit(False))).alias("is_license_file"),
        F.when(F.col("__path").contains("/"), F.regexp_replace("__path", r"/[^/]*$", "")).when(F.col("__path").isNotNull(), F.lit("")).alias("__dir"),
        F.col("__path"),
    )


def scan(files: DataFrame, keys: tuple[str, ...] = ("path",), templates=TEMPLATES, header: float = HEADER, whole: float = WHOLE) -> DataFrame:
    """Licences of all files: their own, else that of the nearest directory above with a licence file.

    Adds license and inherited_from (the directory; null where the licence is
    the file's own or there is none) to what `own_licenses` gives. Of several
    licence files in a directory the one with the highest cosine counts, then the least path.
    Null and empty texts have no licence of their own, a null path has no
    directory; a text of any length is searched whole; repeated rows are each
    returned; an empty table gives no rows; other columns are ignored, whatever
    their names.
    """
    own = cut(own_licenses(files, keys, templates, header, whole))
    # One row per directory: few rows meet in a join, whatever the size of a directory.
    licensed = own.where("is_license_file").groupBy("__dir").agg(F.min(F.struct((-F.col("own_cosine")).alias("c"), F.col("__path").alias("p"), F.col("own_license").alias("license")))["license"].alias("license"))
    dirs = own.select("__dir").where("own_license is null and __dir is not null").distinct()
    # All directories above, and the directory itself, deepest last.
    above = "transform(sequence(0, size(split(__dir, '/'))), i -> struct(i as depth, array_join(slice(split(__dir, '/'), 1, i), '/') as dir))"
    up = dirs.select("__dir", F.explode(F.expr(f"if(__dir = '', array(struct(0 as depth, '' as dir)), {above})")).alias("a")).select("__dir", "a.depth", F.col("a.dir").alias("up"))
    near = up.join(licensed.withColumnRenamed("__dir", "up"), "up").groupBy("__dir").agg(F.max(F.struct("depth", F.col("up").alias("dir"), "license")).alias("near"))
    out = own.join(near, "__dir", "left")
    inherited = F.col("own_license").isNull()
    return out.select(*keys, "own_license", "own_cosine", "own_line", "is_license_file", F.coalesce("own_license", F.when(inherited, F.col("near.license"))).alias("license"), F.when(inherited, F.col("near.dir")).alias("inherited_from"))


#: Path of a document: its source, language and a folder of a hundred ids.
PATH_SQL = "concat_ws('/', source, lang, cast(doc_id // 100 as varchar), cast(doc_id as varchar))"


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.expr("cast(floor(doc_id / 100) as bigint)").cast("string"), F.col("doc_id").cast("string"))
    return scan(read(spark, sf_dir, "documents").select("doc_id", "text", path.alias("path")), ("doc_id", "path"))


def oracle() -> str:
    """The same in SQL, for documents with distinct ids."""
    idf, other, unit = vectors(TEMPLATES)
    weights = ", ".join(f"('{w}', {idf[w]!r}::double)" for w in idf)
    terms = ", ".join(f"('{w}', {i}, {x!r}::double)" for i, v in enumerate(unit) for w, x in v.items())
    names = ", ".join(f"({i}, '{name}')" for i, (name, _) in enumerate(TEMPLATES))
    return f"""
WITH idf(word, w) AS (VALUES {weights}), term(word, t, x) AS (VALUES {terms}), names(t, name) AS (VALUES {names}),
docs AS (SELECT doc_id, {PATH_SQL} AS path, lower(coalesce(text, '')) AS text FROM documents),
split AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM docs WHERE regexp_matches(text, '{MARKS}')),
lines AS (SELECT doc_id, l, unnest(l) AS one, unnest(range(1, len(l) + 1)) AS line FROM split),
units AS (
  SELECT doc_id, line, 1 AS kind, one AS text FROM lines WHERE regexp_matches(one, '{MARKS}')
  UNION ALL SELECT doc_id, line, 3, array_to_string(l[line:line + 2], ' ') FROM lines WHERE regexp_matches(one, '{MARKS}')
  UNION ALL SELECT doc_id, 0, 0, text FROM split),
words AS (SELECT doc_id, line, kind, unnest(regexp_extract_all(text, '{TOKEN}')) AS word FROM units),
tf AS (SELECT doc_id, line, kind, word, count(*) AS n FROM words GROUP BY ALL),
tfidf AS (SELECT tf.*, n * coalesce(w, {other!r}::double) AS v FROM tf LEFT JOIN idf USING (word)),
norms AS (SELECT doc_id, line, kind, sqrt(sum(v * v)) AS norm FROM tfidf GROUP BY ALL),
cos AS (SELECT doc_id, line, kind, t, round(sum(v * x) / any_value(norm), 6) AS c FROM tfidf JOIN term USING (word) JOIN norms USING (doc_id, line, kind) GROUP BY ALL),
best AS (SELECT doc_id, c, line, t FROM cos WHERE kind > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, line, t) = 1),
own AS (
  SELECT d.doc_id, d.path, regexp_replace(d.path, '/[^/]*$', '') AS dir, n.name AS own_license, b.c AS own_cosine, CASE WHEN b.c IS NOT NULL THEN b.line END AS own_line,
    b.c IS NOT NULL AND coalesce((SELECT max(c) FROM cos WHERE cos.doc_id = d.doc_id AND kind = 0) >= {WHOLE}, false) AS is_license_file
  FROM docs d LEFT JOIN (SELECT * FROM best WHERE c >= {HEADER}) b USING (doc_id) LEFT JOIN names n USING (t)),
licensed AS (SELECT dir, arg_min(own_license, (-own_cosine, path)) AS license FROM own WHERE is_license_file GROUP BY dir),
near AS (
  SELECT o.doc_id, l.license, l.dir FROM own o JOIN licensed l ON o.dir = l.dir OR starts_with(o.dir, l.dir || '/')
  WHERE o.own_license IS NULL QUALIFY row_number() OVER (PARTITION BY o.doc_id ORDER BY length(l.dir) DESC) = 1)
SELECT doc_id, path, own_license, own_cosine, own_line, is_license_file, coalesce(own_license, near.license) AS license, near.dir AS inherited_from
FROM own LEFT JOIN near USING (doc_id)"""
