"""Table-shaped queries, one for each operator of the core library, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions import formats, lines, paths
from loomline.operators import graph, resolve, rules, usage
from loomline.operators.rules import Rule

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: What documents are searched for; first match wins.
TEXT_RULES = [
    Rule("token", 'token = "[0-9a-f]{40}"', "CRITICAL", "CWE-798", 0.85, gate=('token = "',)),
    Rule("email", r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z.]+", "HIGH", "CWE-359", 0.9, gate=("@",)),
    Rule("ipv4", r"(?:^|[^0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?:[^0-9.]|$)", "MEDIUM", "CWE-200", 0.9),
    Rule("phone", r"\([0-9]{3}\)|\+[0-9]{1,3}[ -][0-9]", "LOW", "CWE-359", 0.7, gate=("(", "+")),
    Rule("licence", "(?i)licen[cs]e", "LOW", "notice", 0.95),
]
#: How near to what matters a page lies.
SITE_RULES = [Rule("fr", "^fr$", "CRITICAL"), Rule("de", "^de$", "HIGH"), Rule("es", "^es$", "MEDIUM")]
IGNORED = ["**/*.html", "blog.*/**", "**/de/**"]
MARKS = ("#", "*", ">", "-", "//")
HREF = 'href="/([^"]*)"'


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str):
    """Registers a query and its SQL under the function's name."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql.strip()
        return f

    return register


def _case(text: str, value: Callable[[Rule], str], default: str = "NULL", order=TEXT_RULES) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{r.pattern}') THEN {value(r)}" for r in order) + f" ELSE {default} END"


SQL_LINES = "lines AS (SELECT doc_id, lang, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS line_no, len(l) AS n FROM (SELECT doc_id, lang, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))"
SQL_FINDINGS = SQL_LINES + ", findings AS (SELECT * FROM (SELECT doc_id, lang, line_no, " + _case("line", lambda r: f"'{r.id}'") + " AS rule, " + _case("line", lambda r: f"'{r.severity}'") + " AS severity FROM lines) WHERE rule IS NOT NULL)"
SQL_RANK = "CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 ELSE 4 END"


@query("""
WITH RECURSIVE top AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 1),
edges AS (SELECT l_orderkey * 4 AS src, l_partkey * 4 + 1 AS dst FROM lineitem
  UNION SELECT l_partkey * 4 + 1, l_suppkey * 4 + 2 FROM lineitem WHERE l_quantity >= 50
  UNION SELECT l_suppkey * 4 + 2, l_partkey * 4 + 1 FROM lineitem WHERE l_quantity >= 50),
reach(node) AS (SELECT o_orderkey * 4 FROM orders JOIN top ON o_custkey = c_custkey UNION SELECT dst FROM reach JOIN edges ON src = node)
SELECT p_partkey, p_name, p_brand FROM part WHERE NOT EXISTS (SELECT 1 FROM reach WHERE node = p_partkey * 4 + 1)""")
def q01_dead_parts(spark, d):
    """Parts that no order of the richest BUILDING customer leads to, directly or by suppliers of large lines."""
    line = table(spark, d, "lineitem")
    order, part, supplier = F.col("l_orderkey") * 4, F.col("l_partkey") * 4 + 1, F.col("l_suppkey") * 4 + 2
    large = line.where("l_quantity >= 50")
    edges = line.select(order.alias("src"), part.alias("dst")).union(large.select(part, supplier)).union(large.select(supplier, part))
    top = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").orderBy(F.desc("c_acctbal"), "c_custkey").limit(1)
    # Broadcast: one row.
    seeds = table(spark, d, "orders").join(F.broadcast(top), F.col("o_custkey") == F.col("c_custkey")).select((F.col("o_orderkey") * 4).alias("node"))
    live = graph.reachable(edges, seeds)
    return table(spark, d, "part").join(live, F.col("p_partkey") * 4 + 1 == F.col("node"), "left_anti").select("p_partkey", "p_name", "p_brand")


@query("""
WITH RECURSIVE e AS (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS dst FROM events WHERE event_type = 'error'),
edges AS (SELECT DISTINCT src, dst FROM e WHERE dst IS NOT NULL),
r(node, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT dst, depth + 1 FROM r JOIN edges ON node = src WHERE depth < 6)
SELECT node AS user_id, min(depth)::BIGINT AS depth FROM r GROUP BY 1""")
def q02_reachable_depth(spark, d):
    """Users within six hops of user 1, where a hop leads to the next error of the day.

    Errors are ordered within each hour; only the first of each is brought together by day.
    """
    errors = table(spark, d, "events").where("event_type = 'error'").select("user_id", "ts", "event_id", F.to_date("ts").alias("day"), F.hour("ts").alias("hour"))
    over = Window.partitionBy("day", "hour").orderBy("ts", "event_id")
    heads = errors.groupBy("day", "hour").agg(F.min(F.struct("ts", "event_id", "user_id"))["user_id"].alias("head"))
    heads = heads.select("day", "hour", F.lead("head").over(Window.partitionBy("day").orderBy("hour")).alias("after"))
    edges = errors.withColumn("last", F.lead(F.lit(False), 1, True).over(over)).withColumn("dst", F.lead("user_id").over(over)).join(heads, ["day", "hour"])
    edges = edges.select(F.col("user_id").alias("src"), F.when(F.col("last"), F.col("after")).otherwise(F.col("dst")).alias("dst")).where("dst is not null")
    return graph.depths(edges, spark.range(1, 2).withColumnRenamed("id", "node"), 6).select(F.col("node").alias("user_id"), F.col("depth").cast("long").alias("depth"))


@query("SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def q03_reach_hub(spark, d):
    """Suppliers that rich suppliers of their nation lead to, through one hub per nation."""
    supplier = table(spark, d, "supplier")
    seeds = supplier.where("s_acctbal > 5000").select(F.col("s_suppkey").cast("string").alias("node"))
    live = graph.no_hubs(graph.reachable(graph.hub_edges(supplier, "s_suppkey", "s_nationkey"), seeds)).select(F.col("node").cast("long").alias("s_suppkey"))
    return supplier.join(live, "s_suppkey", "left_semi").select("s_suppkey", "s_nationkey")


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n, (count(*) * (count(*) - 1) // 2)::BIGINT AS pairs FROM customer GROUP BY ALL HAVING count(*) BETWEEN 2 AND 200")
def q04_clique_bounded(spark, d):
    """Groups of 2 to 200 customers and the pairs they would make."""
    return graph.bounded_groups(table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"], 2, 200)


def _forms(x: Column) -> Column:
    return resolve.candidates(x, F.lower(x), F.regexp_replace(F.lower(x), "[.,;:!?]", ""))


@query(f"""
WITH words AS (SELECT DISTINCT unnest(string_split(regexp_extract(html, '<title>([^<]*)</title>', 1), ' ')) AS word FROM pages),
refs AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '{HREF}', 1)) AS ref FROM pages),
w AS (SELECT word, 1 AS rank, word AS key FROM words UNION ALL SELECT word, 2, lower(word) FROM words UNION ALL SELECT word, 3, regexp_replace(lower(word), '[.,;:!?]', '', 'g') FROM words),
r AS (SELECT page_id, ref, 1 AS rank, ref AS key FROM refs UNION ALL SELECT page_id, ref, 2, lower(ref) FROM refs UNION ALL SELECT page_id, ref, 3, regexp_replace(lower(ref), '[.,;:!?]', '', 'g') FROM refs),
m AS (SELECT page_id, ref, rank, count(DISTINCT word) AS n_words FROM r JOIN w USING (rank, key) GROUP BY ALL)
SELECT page_id, ref, rank::BIGINT AS rank, n_words FROM m QUALIFY rank = min(rank) OVER (PARTITION BY page_id, ref)""")
def q05_import_resolve_ranked(spark, d):
    """Links resolved to words of titles: exact, else without case, else without punctuation."""
    pages = table(spark, d, "pages")
    refs = pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(HREF), F.lit(1)))).alias("ref")).select("page_id", "ref", F.inline(_forms(F.col("ref"))))
    words = pages.select(F.explode(F.split(F.regexp_extract("html", "<title>([^<]*)</title>", 1), " ", -1)).alias("word")).distinct()
    # Counted by key first, so that a common word meets each reference once.
    keys = words.select("word", F.inline(_forms(F.col("word")))).groupBy("rank", "key").agg(F.countDistinct("word").alias("n_words"))
    return resolve.resolve(refs, keys, ["page_id", "ref"], ["rank"]).select("page_id", "ref", F.col("rank").cast("long").alias("rank"), "n_words")


@query(f"""
WITH refs AS (SELECT page_id, unnest(regexp_extract_all(html, '{HREF}', 1)) AS ref FROM pages)
SELECT regexp_extract(ref, '^(?:@[^/?#]*/)?[^/?#]*', 0) AS package, count(*) AS n_refs, count(DISTINCT page_id) AS n_pages FROM refs WHERE regexp_extract(ref, '^(?:@[^/?#]*/)?[^/?#]*', 0) <> '' GROUP BY 1""")
def q06_used_packages(spark, d):
    """First path segments that pages link to; with their scope, if they have one, two."""
    refs = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("ref"))
    return usage.export_usage(refs.select("page_id", F.regexp_extract("ref", "^(?:@[^/?#]*/)?[^/?#]*", 0).alias("package")).where("package <> ''"), ["package"], "page_id").withColumnsRenamed({"n_uses": "n_refs", "n_importers": "n_pages"})


@query("""
WITH entries AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS prefix, 'general' AS kind FROM part UNION SELECT DISTINCT p_name, 'specific' FROM part WHERE p_size >= 45)
SELECT p_partkey, p_name, prefix, kind FROM part JOIN entries ON p_name = prefix OR starts_with(p_name, prefix || ' ')
QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY length(prefix) DESC, kind DESC) = 1""")
def q07_longest_prefix(spark, d):
    """The longest entry of a prefix table for each part's name."""
    part = table(spark, d, "part")
    entries = part.select(F.split("p_name", " ")[0].alias("prefix"), F.lit("general").alias("kind")).union(part.where("p_size >= 45").select("p_name", F.lit("specific"))).distinct()
    return resolve.longest_prefix(part, "p_name", paths.prefixes("p_name", " "), entries, ["p_partkey"])


@query(r"""
WITH p AS (SELECT page_id, string_split(regexp_replace(regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1), '/\z', ''), '/') AS parts FROM pages),
k AS (SELECT DISTINCT page_id, unnest(list_transform(range(1, len(parts) + 1), lambda i: array_to_string(parts[i:], '/'))) AS key FROM p),
n AS (SELECT parts[-1] AS key, count(*) AS n FROM p GROUP BY 1)
SELECT page_id, (sum(n) - 1)::BIGINT AS n_matches FROM k JOIN n USING (key) GROUP BY 1 HAVING sum(n) > 1""")
def q08_suffix_match(spark, d):
    """Pages whose path ends, at a slash, in another page's last segment."""
    path = F.regexp_replace(F.regexp_extract("url", "^https?://[^/]+/([^?#]*)", 1), r"/\z", "")
    pages = table(spark, d, "pages").select("page_id", path.alias("path"))
    keys = pages.select("page_id", F.explode(F.array_distinct(paths.suffixes("path"))).alias("key"))
    # Counted by key first: no pairs are made.
    ends = pages.groupBy(paths.basename("path").alias("key")).agg(F.count("*").alias("n"))
    return keys.join(ends, "key").groupBy("page_id").agg((F.sum("n") - 1).alias("n_matches")).where("n_matches > 0")


@query("SELECT doc_id, source, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) ORDER BY n_chars DESC, doc_id LIMIT 20")
def q09_dead_files_topk(spark, d):
    """The largest documents without a label (a top-k report)."""
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").orderBy(F.desc("n_chars"), "doc_id").limit(20).select("doc_id", "source", "n_chars")


@query("SELECT doc_id, lang, toxic = 1 AS is_dead, quality::BIGINT AS quality FROM documents JOIN labels USING (doc_id)")
def q10_live_semi(spark, d):
    """Labelled documents with a flag."""
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id").select("doc_id", "lang", (F.col("toxic") == 1).alias("is_dead"), F.col("quality").cast("long").alias("quality"))


@query("SELECT lang, source, count(*) AS n_files, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY ALL")
def q11_language_counts(spark, d):
    """Files and characters by language and source."""
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n_files"), F.sum("n_chars").alias("n_chars"))


@query("""
SELECT count(*) AS total, count(toxic) AS labelled, count(*) FILTER (toxic = 1) AS dead, count(*) - count(*) FILTER (toxic = 1) AS rest,
printf('%.2f%%', floor(100.0 * count(*) FILTER (toxic = 1) / count(*) * 100.0 + 0.5) / 100.0) AS dead_rate
FROM documents LEFT JOIN labels USING (doc_id)""")
def q12_summary(spark, d):
    """One row of totals and a rate."""
    every = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    sums = every.agg(F.count("*").alias("total"), F.count("toxic").alias("labelled"), F.count_if(F.col("toxic") == 1).alias("dead"))
    return sums.select("total", "labelled", "dead", (F.col("total") - F.col("dead")).alias("rest"), formats.rate_text(F.col("dead"), F.col("total")).alias("dead_rate"))


@query(r"""
SELECT CASE WHEN regexp_matches(url, '\.html\z') THEN 'document' WHEN regexp_matches(url, '/\z') THEN 'directory' WHEN contains(url, '?') THEN 'query' WHEN contains(url, '#') THEN 'fragment' ELSE 'other' END AS category, count(*) AS n FROM pages GROUP BY 1""")
def q13_category_case(spark, d):
    """Pages by the shape of their address."""
    url = F.col("url")
    kind = F.when(url.rlike(r"\.html\z"), "document").when(url.rlike(r"/\z"), "directory").when(url.contains("?"), "query").when(url.contains("#"), "fragment").otherwise("other")
    return table(spark, d, "pages").groupBy(kind.alias("category")).agg(F.count("*").alias("n"))


@query(f"WITH {SQL_LINES} SELECT doc_id, line_no, length(trim(line)) AS n_chars FROM lines")
def q14_lines(spark, d):
    """All lines, empty ones included, with their trimmed lengths."""
    return lines.numbered(table(spark, d, "documents"), "text", "doc_id").select("doc_id", "line_no", F.length(F.trim("line")).cast("long").alias("n_chars"))


@query(f"WITH {SQL_LINES} SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT ({' OR '.join(f"starts_with(ltrim(line), '{m}')" for m in MARKS)})) AS n_kept FROM lines GROUP BY 1")
def q15_comment_filter(spark, d):
    """Lines that don't begin with a comment mark, counted within each row."""
    every = lines.lines(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(every).cast("long").alias("n_lines"), F.size(F.filter(every, lambda x: ~lines.is_comment(x, MARKS))).cast("long").alias("n_kept"))


@query(f"WITH {SQL_FINDINGS} SELECT doc_id, line_no, rule, severity FROM findings")
def q16_rule_scan(spark, d):
    """The first rule that matches each line."""
    return rules.scan_lines(table(spark, d, "documents"), TEXT_RULES, "text", "doc_id").select("doc_id", "line_no", "rule", "severity")


def _turns():
    return Window.partitionBy("conv_id").orderBy("turn", "role", "text")


@query("SELECT conv_id, turn, role FROM conversations QUALIFY regexp_matches(lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text), '^[^.]*,')")
def q17_prev_line(spark, d):
    """Turns after a turn with a comma in its first sentence."""
    return table(spark, d, "conversations").withColumn("before", F.lag("text").over(_turns())).where(F.col("before").rlike("^[^.]*,")).select("conv_id", "turn", "role")


@query("SELECT conv_id, turn, role, sum(CASE WHEN ends_with(text, '.') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) % 2 = 1 AS is_open FROM conversations")
def q18_parity(spark, d):
    """Whether an odd number of turns ended with a full stop so far."""
    ended = F.sum(F.when(F.col("text").endswith("."), 1).otherwise(0)).over(_turns().rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, d, "conversations").select("conv_id", "turn", "role", (ended % 2 == 1).alias("is_open"))


@query("""
WITH p AS (SELECT page_id, CASE regexp_extract(url, '^https?://[^/]+/([^/?#]*)', 1) WHEN 'fr' THEN 4 WHEN 'de' THEN 3 WHEN 'es' THEN 2 ELSE 0 END AS near, CASE WHEN length(html) < 1500 THEN 1 WHEN length(html) < 4000 THEN 2 ELSE 3 END AS own FROM pages)
SELECT page_id, ['LOW', 'MEDIUM', 'HIGH'][own] AS severity, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][CASE WHEN near > 0 AND near >= own THEN least(own + 1, 4) ELSE own END] AS boosted, near = 4 AS is_critical FROM p""")
def q19_severity_boost(spark, d):
    """Severities by size, one level higher near to what matters."""
    near = rules.nearness(F.regexp_extract("url", "^https?://[^/]+/([^/?#]*)", 1), SITE_RULES)
    own = F.when(F.length("html") < 1500, 1).when(F.length("html") < 4000, 2).otherwise(3)
    return table(spark, d, "pages").select("page_id", near.alias("near"), own.alias("own")).select("page_id", rules.level(F.col("own")).alias("severity"), rules.level(rules.boosted(F.col("own"), F.col("near"))).alias("boosted"), (F.col("near") == 4).alias("is_critical"))


LANGS = ("en", "de", "fr", "es")


@query(f"WITH {SQL_FINDINGS} SELECT rule, severity, count(*) AS n_findings, count(DISTINCT doc_id) AS n_docs, {', '.join(f"count(*) FILTER (lang = '{x}') AS n_{x}" for x in LANGS)} FROM findings GROUP BY 1, 2")
def q20_findings_rollup(spark, d):
    """Findings by rule, with distinct documents and a column per language."""
    found = rules.scan_lines(table(spark, d, "documents"), TEXT_RULES, "text", "doc_id", "lang")
    return found.groupBy("rule", "severity").agg(F.count("*").alias("n_findings"), F.countDistinct("doc_id").alias("n_docs"), *(F.count_if(F.col("lang") == x).alias(f"n_{x}") for x in LANGS))


@query(f"WITH {SQL_FINDINGS} SELECT count(*) AS n_findings, coalesce(max({SQL_RANK}), 0)::BIGINT AS max_rank, coalesce(max({SQL_RANK}), 0) >= 3 AS failed FROM findings")
def q21_ci_gate(spark, d):
    """Whether a finding is of HIGH severity at least."""
    return rules.gate(rules.scan_lines(table(spark, d, "documents"), TEXT_RULES, "text", "doc_id"), "HIGH").withColumn("max_rank", F.col("max_rank").cast("long"))


@query(f"""
WITH p AS (SELECT regexp_extract(url, '^https?://([^?#]*)', 1) AS path FROM pages),
q AS (SELECT regexp_extract(path, '^[^/]*/([^/]*)', 1) AS section, {' OR '.join(f"regexp_matches(path, '{paths.glob_regex(g)}')" for g in IGNORED)} AS ignored FROM p)
SELECT section, count(*) AS n_total, count(*) FILTER (ignored) AS n_ignored, count(*) FILTER (NOT ignored) AS n_kept FROM q GROUP BY 1""")
def q22_ignore_glob(spark, d):
    """Totals by section, recomputed without paths that globs ignore."""
    pages = table(spark, d, "pages").select(F.regexp_extract("url", "^https?://([^?#]*)", 1).alias("path"))
    flagged = pages.select(F.regexp_extract("path", "^[^/]*/([^/]*)", 1).alias("section"), paths.matches_any("path", IGNORED).alias("ignored"))
    return flagged.groupBy("section").agg(F.count("*").alias("n_total"), F.count_if("ignored").alias("n_ignored"), F.count_if(~F.col("ignored")).alias("n_kept"))


@query(f"WITH {SQL_LINES} SELECT doc_id, min(line_no) AS marker_line FROM lines WHERE line_no <= 5 AND regexp_matches(line, '(?i)licen[cs]e') GROUP BY 1")
def q23_generated_header(spark, d):
    """Documents with a marker in their first five lines."""
    head = F.transform(F.slice(lines.lines(F.col("text")), 1, 5), lambda x, i: F.when(x.rlike("(?i)licen[cs]e"), i + 1))
    return table(spark, d, "documents").select("doc_id", F.array_min(head).cast("long").alias("marker_line")).where("marker_line is not null")


@query("SELECT doc_id FROM documents WHERE regexp_matches(substring(text, 1, 2000), '(?i)licen[cs]e|token = |@')")
def q24_keep_comment(spark, d):
    """Documents with a marker in their first 2,000 characters."""
    return table(spark, d, "documents").where(F.substring("text", 1, 2000).rlike("(?i)licen[cs]e|token = |@")).select("doc_id")


@query("SELECT l_partkey, l_suppkey, count(*) AS n_uses, count(DISTINCT l_orderkey) AS n_importers FROM lineitem GROUP BY ALL")
def q25_export_usage(spark, d):
    """Uses of each part from each supplier, and the orders that use it."""
    return usage.export_usage(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"], "l_orderkey")


@query("""
WITH live AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity >= 50),
c AS (SELECT p_brand, count(l_partkey) AS n_live, count(*) - count(l_partkey) AS n_dead FROM part LEFT JOIN live ON p_partkey = l_partkey GROUP BY 1)
SELECT p_brand, n_live, n_dead, floor(n_dead * 100.0 / (n_live + n_dead) + 0.5)::BIGINT AS percent_dead FROM c WHERE n_live > 0 AND n_dead > 0""")
def q26_partial_dead(spark, d):
    """Brands of which some parts are in a large line and some are not."""
    live = table(spark, d, "lineitem").where("l_quantity >= 50").select("l_partkey").distinct()
    part = table(spark, d, "part").join(live, F.col("p_partkey") == F.col("l_partkey"), "left")
    return usage.partly_used(part, "p_brand", F.col("l_partkey").isNotNull())


@query("""
WITH RECURSIVE edges AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
used(node, name, depth) AS (SELECT 'r' || r_regionkey, r_name, 0 FROM region WHERE r_name LIKE 'A%' UNION SELECT dst, name, depth + 1 FROM used JOIN edges ON node = src WHERE depth < 5)
SELECT DISTINCT node, name FROM used""")
def q27_propagation(spark, d):
    """Uses of regions, handed on to their nations and suppliers."""
    nation, supplier = table(spark, d, "nation"), table(spark, d, "supplier")
    edges = nation.select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst")).union(supplier.select(F.concat(F.lit("n"), "s_nationkey"), F.concat(F.lit("s"), "s_suppkey")))
    start = table(spark, d, "region").where("r_name like 'A%'").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.col("r_name").alias("name"))
    return graph.propagate(start, edges, 5)


@query("""
(SELECT o_custkey AS node FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT user_id FROM events WHERE event_type = 'purchase' UNION SELECT c_custkey FROM customer WHERE c_acctbal > 9000)
EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'""")
def q28_seed_union(spark, d):
    """Three sources of seeds, without those that are excluded."""
    seeds = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("node"))
    seeds = seeds.union(table(spark, d, "events").where("event_type = 'purchase'").select("user_id")).union(table(spark, d, "customer").where("c_acctbal > 9000").select("c_custkey"))
    out = table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("node"))
    return seeds.distinct().join(out, "node", "left_anti")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)")
def q29_intersect(spark, d):
    """Nations with customers and suppliers."""
    both = table(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey")).intersect(table(spark, d, "supplier").select("s_nationkey"))
    return table(spark, d, "nation").join(both, "n_nationkey", "left_semi").select("n_nationkey", "n_name")


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) // 10 AS bucket, count(*) AS n, min(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS least FROM events GROUP BY ALL")
def q30_json_field(spark, d):
    """A field of a JSON column, in buckets."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select("event_type", k.alias("k")).groupBy("event_type", F.floor(F.col("k") / 10).alias("bucket")).agg(F.count("*").alias("n"), F.min("k").alias("least"))


@query("""
WITH r AS (SELECT user_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run_id FROM events)
SELECT user_id, run_id, count(*) AS n_events FROM r GROUP BY ALL""")
def q31_session_pending(spark, d):
    """Runs of a user's events, begun anew by each error: counted within each day, and added to the days before."""
    events = table(spark, d, "events").select("user_id", "ts", "event_id", F.to_date("ts").alias("day"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("error"))
    over = Window.partitionBy("user_id", "day").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    days = events.groupBy("user_id", "day").agg(F.sum("error").alias("errors"))
    before = days.select("user_id", "day", F.coalesce(F.sum("errors").over(Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    runs = events.withColumn("run", F.sum("error").over(over)).join(before, ["user_id", "day"]).select("user_id", (F.col("run") + F.col("before")).alias("run_id"))
    return runs.groupBy("user_id", "run_id").agg(F.count("*").alias("n_events"))


@query("""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
k AS (SELECT doc_id, a, list_filter(a, lambda x: NOT regexp_matches(x, '(?i)licen[cs]e')) AS b FROM l),
c AS (SELECT doc_id, a, list_filter(b, lambda x, i: trim(x) <> '' OR i = 1 OR trim(b[i - 1]) <> '') AS b FROM k)
SELECT doc_id, len(a)::BIGINT AS n_before, len(b)::BIGINT AS n_after, md5(array_to_string(b, chr(10))) AS digest FROM c""")
def q32_collapse_blank(spark, d):
    """Texts without lines that match and without runs of blank lines."""
    before = lines.lines(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(before).cast("long").alias("n_before"), lines.without(before, "(?i)licen[cs]e").alias("after")).select("doc_id", "n_before", F.size("after").cast("long").alias("n_after"), F.md5(F.array_join("after", "\n")).alias("digest"))


@query("SELECT l_partkey, l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC) = 1")
def q33_last_wins_map(spark, d):
    """The last line of each part."""
    return resolve.last_wins(table(spark, d, "lineitem"), ["l_partkey"], ["l_orderkey", "l_linenumber", "l_suppkey"], []).withColumn("l_linenumber", F.col("l_linenumber").cast("long"))


@query("""
WITH f AS (SELECT o_orderkey, o_custkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) <= 200)
SELECT o_orderkey, o_orderpriority, c_name FROM f JOIN customer ON o_custkey = c_custkey""")
def q34_first_n_lookup(spark, d):
    """A lookup for the first 200 orders of each priority only; the limit is applied before the shuffle, too."""
    first = table(spark, d, "orders").withColumn("n", F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderkey"))).where("n <= 200")
    return first.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderpriority", "c_name")


_BY_CONFIDENCE = sorted(TEXT_RULES, key=lambda r: -r.confidence)


@query(f"SELECT doc_id, {_case('text', lambda r: f"'{r.id}'", order=_BY_CONFIDENCE)} AS rule, {_case('text', lambda r: f'{r.confidence}::double', order=_BY_CONFIDENCE)} AS confidence FROM documents WHERE {_case('text', lambda r: 'true', 'false')}")
def q35_max_confidence(spark, d):
    """The most confident rule that a document matches anywhere; ties go to the earlier rule."""
    hits = F.filter(F.array(*(F.when(r.hits(F.col("text")), F.struct(F.lit(r.confidence).alias("confidence"), F.lit(-i).alias("ordinal"))) for i, r in enumerate(TEXT_RULES))), lambda x: x.isNotNull())
    best = table(spark, d, "documents").select("doc_id", F.array_max(hits).alias("best")).where("best is not null")
    return best.select("doc_id", rules.attribute(-F.col("best.ordinal"), TEXT_RULES, "id").alias("rule"), F.col("best.confidence").alias("confidence"))


@query(f"""
SELECT source, round(sum(n_chars) * {formats.VISITS * formats.PAGES * (1 - formats.CACHED)!r} / 1073741824.0, 4) AS gb, round(sum(n_chars) * {formats.VISITS * formats.PAGES * (1 - formats.CACHED)!r} / 1073741824.0 * {formats.PRICE_PER_GB}, 4) AS price,
round(sum(n_chars) * {formats.VISITS * formats.PAGES * (1 - formats.CACHED)!r} / 1073741824.0 * {formats.KG_PER_GB}, 4) AS kg FROM documents GROUP BY 1""")
def q36_cost(spark, d):
    """Estimated monthly traffic of each source."""
    n = F.sum("n_chars")
    return table(spark, d, "documents").groupBy("source").agg(*(F.round(f(n), 4).alias(a) for a, f in (("gb", formats.monthly_gb), ("price", formats.monthly_price), ("kg", formats.monthly_kg))))


@query("""
SELECT doc_id, CASE WHEN n_chars < 1024 THEN printf('%d B', n_chars) WHEN n_chars < 1048576 THEN printf('%.1f KB', floor(n_chars / 1024.0 * 10.0 + 0.5) / 10.0) ELSE printf('%.1f MB', floor(n_chars / 1048576.0 * 10.0 + 0.5) / 10.0) END AS size FROM documents""")
def q37_bytes_fmt(spark, d):
    """Sizes as people read them."""
    return table(spark, d, "documents").select("doc_id", formats.size_text(F.col("n_chars")).alias("size"))


@query("SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '2001-01-01') AS days FROM orders")
def q38_days_since(spark, d):
    """Days from each order to a fixed date."""
    return table(spark, d, "orders").select("o_orderkey", F.datediff(F.lit("2001-01-01").cast("date"), F.to_date("o_orderdate")).cast("long").alias("days"))


@query(f"SELECT page_id, contains(html, '<script>') AS has_inline, len(regexp_extract_all(html, '{HREF}', 1))::BIGINT AS n_links, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '{HREF}', 1))), ',') AS links FROM pages")
def q39_html_refs(spark, d):
    """Inline scripts and links of each page."""
    links = F.regexp_extract_all("html", F.lit(HREF), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.col("html").contains("<script>").alias("has_inline"), F.size(links).cast("long").alias("n_links"), F.array_join(F.array_sort(F.array_distinct(links)), ",").alias("links"))


@query("""
WITH b AS (SELECT word, count(DISTINCT item_id) AS n FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS word FROM benchmark) GROUP BY 1),
t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS word FROM documents)
SELECT doc_id, count(*) AS n_words, sum(n)::BIGINT AS n_refs FROM t JOIN b USING (word) GROUP BY 1""")
def q40_class_ref(spark, d):
    """Capitalised words of a document that benchmark items use, and how many items do."""

    def words(name: str, key: str) -> DataFrame:
        return table(spark, d, name).select(key, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{3,}"), F.lit(0)))).alias("word"))

    items = words("benchmark", "item_id").groupBy("word").agg(F.countDistinct("item_id").alias("n"))
    return words("documents", "doc_id").join(items, "word").groupBy("doc_id").agg(F.count("*").alias("n_words"), F.sum("n").alias("n_refs"))


@query("""
WITH x AS (SELECT o_custkey, l_orderkey, l_shipdate, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
g AS (SELECT o_custkey, l_orderkey, l_shipdate, count(*) AS n FROM x GROUP BY ALL),
spans AS (SELECT o_custkey, l_orderkey AS span, o_orderdate AS a, max(l_shipdate) AS b FROM x GROUP BY ALL),
i AS (SELECT g.*, span FROM g JOIN spans USING (o_custkey) WHERE l_shipdate BETWEEN a AND b QUALIFY row_number() OVER (PARTITION BY g.o_custkey, g.l_orderkey, g.l_shipdate ORDER BY a DESC, span DESC) = 1)
SELECT l_orderkey, sum(n)::BIGINT AS n_inside, coalesce(sum(n) FILTER (span = l_orderkey), 0)::BIGINT AS n_own FROM i GROUP BY 1""")
def q41_range_innermost(spark, d):
    """For each line the innermost span, from order to last shipment, of the same customer around its shipment."""
    every = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate"), "l_orderkey")
    ships = every.groupBy("o_custkey", "l_orderkey", "l_shipdate").agg(F.count("*").alias("n"))
    spans = every.groupBy("o_custkey", F.col("l_orderkey").alias("span"), F.col("o_orderdate").alias("a")).agg(F.max("l_shipdate").alias("b"))
    # Spans meet shipments by month, so that a customer of very many doesn't make all pairs.
    months = spans.where("b >= a").withColumn("month", F.explode(F.expr("sequence(trunc(cast(a as date), 'MM'), trunc(cast(b as date), 'MM'), interval 1 month)")))
    inside = ships.withColumn("month", F.expr("trunc(cast(l_shipdate as date), 'MM')")).join(months, ["o_custkey", "month"]).where("l_shipdate between a and b")
    inner = inside.groupBy("o_custkey", "l_orderkey", "l_shipdate", "n").agg(F.max(F.struct("a", "span"))["span"].alias("span"))
    return inner.groupBy("l_orderkey").agg(F.sum("n").alias("n_inside"), F.sum(F.expr("if(span = l_orderkey, n, 0)")).alias("n_own"))


@query("SELECT n_nationkey, count(*) AS n_pages FROM nation JOIN pages ON regexp_matches(url, '/[a-z]{2}/[0-9]*' || n_nationkey || '([^0-9]|\\z)') GROUP BY 1".replace("\\\\", "\\"))
def q42_theta_regex(spark, d):
    """Pages whose number ends in a nation's key: a join on patterns, with the 25 patterns broadcast."""
    pattern = F.concat(F.lit("/[a-z]{2}/[0-9]*"), F.col("n_nationkey").cast("string"), F.lit(r"([^0-9]|\z)"))
    nation = table(spark, d, "nation").select("n_nationkey", pattern.alias("pattern"))
    # Broadcast: nations, a table of fixed size.
    return table(spark, d, "pages").select("url").join(F.broadcast(nation), F.expr("url rlike pattern")).groupBy("n_nationkey").agg(F.count("*").alias("n_pages"))
