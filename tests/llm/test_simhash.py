from itertools import combinations

import xxhash
from pyspark.sql import functions as F

from loomline.llm.simhash import keep_one, links, near_duplicates, simhash
from loomline.llm.components import components

SCHEMA = "text string, doc_id long, fp int, label string"


def slow(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in parts]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute(values, distance=4):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in combinations(values, 2):
        if bin((a ^ b) & (2**64 - 1)).count("1") <= distance:
            root[find(a)] = find(b)
    groups = {}
    for v in values:
        groups.setdefault(find(v), set()).add(v)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def test_fingerprint_matches_definition(spark):
    texts = ["a", "", " \n ", "one two three", "A b C d", "w " * 1000, " ".join(f"x{i % 37}y{i % 11}" for i in range(900)), "É é\tE\x0be\x0cf g"]
    for t in texts:
        assert simhash(t.encode()) % 2**64 == slow(t)
    row = spark.sql("select xxhash64('A b') h").first()
    assert row.h % 2**64 == xxhash.xxh64_intdigest(b"A b", 42)


def test_links_equal_brute_force(spark):
    import random

    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(12)]
    values = set(base)
    for v in base[:6]:
        for _ in range(25):
            x = v
            for _ in range(rng.randint(1, 7)):
                x ^= 1 << rng.randrange(63)
            values.add(x)
    values = sorted(values)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    want = brute(values)
    for star_from in (2, 64):
        got = {}
        for r in components(links(df, 4, star_from)).collect():
            got.setdefault(r.label, set()).add(r.node)
        assert {frozenset(g) for g in got.values()} == want


def test_component_shapes(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (7001, 7000)]
    got = components(spark.createDataFrame(chain, "u long, v long")).groupBy("label").agg(F.count("*").alias("n")).collect()
    assert sorted(r.n for r in got) == [2, 201, 300]


def test_edge_rows(spark):
    rows = [("same text here again ok", 5, 1, "x"), ("Same text HERE again ok", 3, 1, None), (None, 9, None, None), ("", 8, 0, ""), ("same text here again ok", 5, 1, "x"), ("other words entirely in this one", None, 0, "")]
    out = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 6
    got = {(r.doc_id, r.component_id) for r in out}
    assert got == {(5, 3), (3, 3), (9, 8), (8, 8), (None, None)}
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_of_each_group_is_kept_whatever_the_ids(spark):
    a, b, c, d = ("alpha beta gamma delta eps", "one two three four five six", "red green blue black white", "left right up down in out")
    rows = [(a, 1, 1, ""), (b, 1, 2, ""), (c, None, 3, ""), (d, None, 4, ""), (a, 7, 5, ""), (b, 0, 6, ""), (c, 9, 7, ""), (c, 9, 7, ""), (d, None, 4, ""), (None, 5, 0, None), ("", 6, 0, "")]
    got = sorted(map(str, keep_one(spark.createDataFrame(rows, SCHEMA)).collect()))
    want = [(a, 1, 1, ""), (b, 0, 6, ""), (c, 9, 7, ""), (d, None, 4, ""), (None, 5, 0, None)]
    assert got == sorted(map(str, spark.createDataFrame(want, SCHEMA).collect()))
    assert keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_long_text(spark):
    text = " ".join(f"w{i % 9973}" for i in range(400_000))
    got = near_duplicates(spark.createDataFrame([(text, 4, 0, ""), (text + " x", 2, 0, "")], SCHEMA)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(4, 2), (2, 2)}
    assert {r.doc_id: int(r.fingerprint, 16) for r in got}[4] == slow(text)


def test_clashing_names(spark):
    names = ["kept_id", "kept_digest", "place", "__rank", "row", "fp", "label", "digest", "unnamed", "count", "places", "octets", "KEPT_ID_"]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names)
    rows = [(i, t, *names) for i, t in [(1, "one two three four five six"), (2, "one two three four five six"), (3, "something else that is longer than it"), (3, "something else that is longer than it"), (None, None)]]
    got = keep_one(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 1, 3] and all(r[n] == n for r in got for n in names)
