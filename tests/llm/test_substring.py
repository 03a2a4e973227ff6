import hashlib
import random

from loomline.llm.substring import dedup_substrings

SCHEMA = "text string, doc_id long, start int, phrase string"


def brute(rows, window):
    """rows: (doc_id, text), in order."""
    first = {}
    for k, (_, text) in enumerate(rows):
        words = (text or "").encode().split()
        for i in range(len(words) - window + 1):
            first.setdefault(tuple(words[i : i + window]), (k, i))
    out = []
    for k, (d, text) in enumerate(rows):
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] != (k, i):
                gone.update(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((d, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(500)] + ["é", "日本", "."]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(15, 60))] for _ in range(12)]
    rows = []
    for d in range(120):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocab) for _ in range(rng.randint(1, 50))]
        rows.append((d * 3 - 50, rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(900, "a " * 19), (901, "a " * 60), (902, "b " * 21), (903, None), (904, ""), (905, "x y " * 40), (906, rows[5][1]), (907, rows[5][1]), (908, "long " * 3000 + "tail")]
    df = spark.createDataFrame([(t, d, 1, "p") for d, t in rows], SCHEMA).repartition(5)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in dedup_substrings(df).collect())
    assert got == sorted(brute(rows, 20))


def test_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(long, 1, 0, ""), (long, 1, 0, ""), (long, None, 0, None), ("other " + long, 1, 1, "")]
    got = {(r.doc_id, r.n_words, r.n_removed) for r in dedup_substrings(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(None, 30, 0), (1, 30, 30), (1, 31, 30)}
    assert dedup_substrings(spark.createDataFrame([], SCHEMA)).count() == 0


def thue_morse(n, zero, one):
    return "".join(one if bin(i).count("1") % 2 else zero for i in range(n))


def test_words_made_to_collide_are_told_apart(spark):
    """Polynomials modulo a power of two don't tell these words apart, whatever their base."""
    same = [f"w{i}" for i in range(25)]
    rows = [(1, " ".join([*same[:10], thue_morse(2048, "a", "b"), *same[10:19]])), (2, " ".join([*same[:10], thue_morse(2048, "b", "a"), *same[10:19]]))]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in dedup_substrings(spark.createDataFrame([(t, d, 1, "p") for d, t in rows], SCHEMA)).collect())
    assert got == brute(rows, 20) and sum(r[2] for r in got) == 0


def test_join_of_phrases_can_be_split(spark):
    """No aggregate between the join of recurring phrases and its exchanges, so that a very common phrase isn't one task's."""
    words = [f"w{i}" for i in range(40)]
    df = spark.createDataFrame([(" ".join(words), 1, 0, ""), (" ".join(["x", *words]), 2, 0, "")], SCHEMA)
    plan = dedup_substrings(df)._jdf.queryExecution().executedPlan().toString()
    joins = [i for i, line in enumerate(plan.split("\n")) if "Join [phrase" in line]
    assert joins
    for i in joins:
        for line in plan.split("\n")[i + 1 : i + 4]:
            if "Exchange" in line:
                break
            assert "Aggregate" not in line
