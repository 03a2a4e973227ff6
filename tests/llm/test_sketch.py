import hashlib
import random

from pyspark.sql import functions as F

from loomline.llm.sketch import CHECK, cells, compare_edited, differences, digests, peel

SCHEMA = "text string, doc_id long, n int, fingerprint string"


def sets(spark, texts):
    """The paragraph digests of each text, as Python sets."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", digests(F.col("t")).alias("d"))
    return {texts[r.i]: set(r.d) for r in df.collect()}


def edits(rows):
    """(doc_id, text, edited text, next text) by the definition; rows have distinct ids."""
    rows = sorted(((d, t or "") for t, d, *_ in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    for i, (d, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        q = len(t) // 4
        yield d, t, t[: len(t) - q] + after[:q], after


def check(spark, rows, got):
    want = list(edits(rows))
    of = sets(spark, sorted({x for w in want for x in w[1:]}))
    by = {r.doc_id: r for r in got}
    assert len(got) == len(want) == len(by)
    for d, text, edited, after in want:
        r = by[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for other, near in ((edited, r.near_edited), (after, r.near_next)):
            a, b = of[text], of[other]
            assert abs(near - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-12
        assert (r.fingerprint == r.edited_fingerprint) == (of[text] == of[edited])


def test_equals_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeé日") for _ in range(rng.randint(1, 9)))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(3, 25))) + rng.choice([". ", "! ", ".\n", "\n", "\n\n"])
    rows = [("".join(sentence() for _ in range(rng.choice([0, 1, 3, 8, 40, 300]))), 5 * d - 60, 0, "") for d in range(90)]
    rows += [(None, 900, 0, None), ("", 901, 0, ""), (" \n\t\n ", 902, 0, ""), ("x", None, 0, ""), (rows[7][0], 903, 0, ""), ("no end " * 4000, 904, 0, ""), ("😀😀😀😀😀", 905, 0, "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = compare_edited(df)
    check(spark, rows, out.collect())
    equal = {r.fingerprint for r in out.where(F.col("doc_id").isin(rows[7][1], 903)).collect()}
    assert len(equal) == 1
    names = ("Python", "Pandas", "Arrow", "ExistingRDD[")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in names[:3])


def test_peeling_recovers_digests(spark):
    lines = [f"line number {i} of this text" for i in range(8)]
    df = spark.createDataFrame([("\n".join(lines),)], "t string").select(digests(F.col("t")).alias("d"))
    r = df.select("d", cells(F.col("d")).alias("c")).select("d", peel("c").alias("p")).first()
    assert set(r.p.found) == set(r.d) and len(r.d) == 8 and not any(r.p.cells)


def test_larger_sketches(spark):
    a = spark.range(3000).select(F.array_sort(digests(F.concat(F.lit("p "), F.col("id").cast("string"))))[0].alias("k")).agg(F.collect_list("k").alias("keys"))
    pairs = a.select(F.lit(1).cast("long").alias("row"), F.lit(0).alias("pair"), F.concat("keys", F.slice("keys", 1, 400)).alias("keys"))
    # Two digests with all their bits for segments and cells in common: only fresh hashes tell them apart.
    k = (5 << 40) | (77 << 24)
    heads = spark.createDataFrame([(2, x) for x in (k, k | (1 << 37), 9 << 24)], "row long, head long")
    same = heads.select("row", F.expr(f"head | (xxhash64(head) & {CHECK}L)").alias("key")).groupBy("row").agg(F.collect_list("key").alias("keys")).select("row", F.lit(0).alias("pair"), "keys")
    got = {r.row: r.found for r in differences(pairs.union(same)).collect()}
    assert got == {1: 2600, 2: 3}


def test_edited_texts_are_like_their_own(spark):
    """Also without sentence marks of ASCII, without any, and with short sentences."""
    rng = random.Random(4)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 8)))
    texts = ["。".join("".join(rng.choice("日本語文章試験") for _ in range(50)) for _ in range(40)), " ".join(word("abcdefg") for _ in range(2000)), ". ".join(" ".join(word("hijklm") for _ in range(7)) for _ in range(12)) + "."]
    rows = [(t, i, 0, "") for i, t in enumerate(texts)]
    for r in compare_edited(spark.createDataFrame(rows, SCHEMA)).collect():
        assert r.near_edited > 0.3 and r.near_next < 0.1


def test_short_texts_are_like_what_is_made_of_three_quarters_of_them(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    rows = []
    for i, n in enumerate([100, 101, 130, 180, 250, 400, 700, 790, 810, 1000, 1190, 1210, 1500, 3000] * 6):
        text = " ".join(word() for _ in range(n)) if i % 3 else "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n))
        rows.append((text[:n] + (". " if i % 2 else ""), i, 0, ""))
    got = compare_edited(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and min(r.near_edited for r in got if r.n_chars < 1200) > 0.3 and min(r.near_edited for r in got) > 0.05
