import random

from loomline.operators import graph, resolve, rules
from loomline.operators.rules import Rule
from pyspark.sql import functions as F


def walk(edges, seeds):
    depth, front, d = {s: 0 for s in seeds}, set(seeds), 0
    while front:
        d += 1
        front = {b for a, b in edges if a in front} - set(depth)
        depth.update(dict.fromkeys(front, d))
    return depth


def test_depths_equal_a_walk(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(90)] + [(100 + i, 101 + i) for i in range(12)] + [(112, 100)]
    df, seeds = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(0,), (7,), (100,), (999,), (None,)], "node long")
    want = walk(edges, [0, 7, 100, 999])
    assert {r.node: r.depth for r in graph.depths(df, seeds).collect()} == want
    assert {r.node for r in graph.depths(df.repartition(7), seeds, 3).collect()} == {n for n, d in want.items() if d <= 3}
    assert graph.reachable(df.limit(0), seeds).count() == 4


def test_hubs_equal_cliques(spark):
    members = [(f"f{i}", f"g{i % 4}") for i in range(20)] + [("lone", None)]
    df, seeds = spark.createDataFrame(members, "node string, unit string"), spark.createDataFrame([("f1",), ("lone",)], "node string")
    by_hub = {r.node for r in graph.no_hubs(graph.reachable(graph.hub_edges(df, "node", "unit"), seeds)).collect()}
    pairs = df.select(F.col("node").alias("src"), "unit").join(df.select(F.col("node").alias("dst"), "unit"), "unit").select("src", "dst")
    assert by_hub == {r.node for r in graph.reachable(pairs, seeds).collect()} == {f"f{i}" for i in range(1, 20, 4)} | {"lone"}
    sizes = graph.bounded_groups(df.where("unit is not null"), ["unit"], 2, 4)
    assert sizes.count() == 0 and {r.pairs for r in graph.bounded_groups(df.where("unit is not null"), ["unit"], 2, 5).collect()} == {10}


def test_propagation_stops(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(3, 0)], "src long, dst long")
    start = spark.createDataFrame([(0, "x"), (5, "y")], "node long, name string")
    got = {(r.node, r.name) for r in graph.propagate(start, edges, 5).collect()}
    assert got == {(i, "x") for i in range(6)} | {(i, "y") for i in range(5, 10)}


def test_resolution(spark):
    table = spark.createDataFrame([("@", "root"), ("@/lib", "lib"), ("@/lib/deep", "deep")], "prefix string, target string")
    from loomline.functions.paths import prefixes

    refs = spark.createDataFrame([(1, "@/lib/deep/x"), (2, "@/lib/x"), (3, "@/y"), (4, "react")], "id int, module string")
    assert {r.id: r.target for r in resolve.longest_prefix(refs, "module", prefixes("module", "/"), table, ["id"]).collect()} == {1: "deep", 2: "lib", 3: "root"}
    found = resolve.resolve(spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 2, "b")], "id int, rank int, key string"), spark.createDataFrame([("a", "A"), ("b", "B1"), ("b", "B2")], "key string, target string"), ["id"])
    assert {(r.id, r.target) for r in found.collect()} == {(1, "A"), (2, "B1"), (2, "B2")}


def test_rules(spark):
    own = [Rule("a", "aa+", "LOW"), Rule("b", "a", "HIGH", languages=("x",))]
    df = spark.createDataFrame([(1, "zz\naaa\n# a\n\na", "x"), (2, "a", "y"), (3, None, "x")], "k int, t string, lang string")
    got = {(r.k, r.line_no, r.rule, r.severity) for r in rules.scan_lines(df, own, "t", "k", "lang", comments=False, language="lang").collect()}
    assert got == {(1, 2, "a", "LOW"), (1, 5, "b", "HIGH")}
    ranks = spark.createDataFrame([(s, b) for s in range(1, 5) for b in range(5)], "s int, b int").select("s", "b", rules.boosted(F.col("s"), F.col("b")).alias("r"))
    assert all(r.r == (min(4, r.s + 1) if r.b and r.b >= r.s else r.s) for r in ranks.collect())
    assert rules.gate(rules.scan_lines(df, own, "t", "k"), "HIGH").first().failed and not rules.gate(df.limit(0).withColumn("severity", F.lit("LOW")), "LOW").first().failed


def test_heavy_sources_are_dealt_over_tasks(spark, monkeypatch):
    from loomline.operators import graph

    rows = [("hub", f"n{i}") for i in range(3000)] + [(f"n{i}", f"m{i % 40}") for i in range(3000)] + [(f"n{i}", f"n{i + 1}") for i in range(3000)] + [("m3", "hub")]
    edges = spark.createDataFrame(rows, "src string, dst string")
    seeds = spark.createDataFrame([("m3",), (None,)], "node string")
    whole = {tuple(r) for r in graph.depths(edges, seeds).collect()}
    monkeypatch.setattr(graph, "SPLIT", 100)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        held, heavy = graph.dealt(edges)
        sizes = sorted(r["count"] for r in held.groupBy(F.spark_partition_id()).count().collect())
        assert [(r.src, r.parts) for r in heavy.collect()] == [("hub", 30)]
        assert len(sizes) == 16 and sizes[-1] < 10 * sizes[8] and sum(sizes) == len(rows)
        assert {tuple(r) for r in graph.depths(edges, seeds).collect()} == whole and ("m7", 3) in whole
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
