import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from loomline.llm import brown
from loomline.llm.brown import exchange, language_model_scores, train

SCHEMA = "text string, doc_id long, n int, word string, class string"


def docs(spark):
    rng = random.Random(8)
    a, b = [f"a{i}er" for i in range(40)], [f"b{i}é" for i in range(40)]
    rows = []
    for d in range(200):
        words = [rng.choice(a if i % 2 else b) for i in range(rng.randint(0, 60))]
        rows.append((" \n".join(words).title() + (f" rare{d} Only{d % 90}" if d % 3 else ""), d, 1, "w", "c"))
    rows += [(None, 500, 0, None, None), ("", 501, 0, "", ""), ("A b", None, 0, "", ""), ("same row", 502, 0, "", ""), ("same row", 502, 0, "", "")]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def low(t):
    return [*(t or "").encode().lower().split(), b" "]


def test_base_equals_brute_force(spark, monkeypatch):
    rows, df = docs(spark)
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for _, d, *_ in rows}
    c = Counter(w for t, d, *_ in rows if not held[d] for w in low(t))
    total = sum(c.values())
    want = sorted((str(d), held[d], len(low(t)), sum(c[w] > 0 for w in low(t)), total, round(sum(math.log10((c[w] + 1) / (total + len(c) + 1)) for w in low(t)), 6)) for t, d, *_ in rows)
    for carried in (5, 100_000):
        monkeypatch.setattr(brown, "CARRIED", carried)
        out = language_model_scores(df).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
        scores = {carried: sorted((str(r.doc_id), round(r.score, 6)) for r in out)}
        assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert language_model_scores(spark.createDataFrame([], SCHEMA)).count() == 0
    assert scores


def test_score_does_not_depend_on_what_is_carried(spark, monkeypatch):
    _, df = docs(spark)
    out = []
    for carried in (1000, 100_000):
        monkeypatch.setattr(brown, "CARRIED", carried)
        out.append(sorted((str(r.doc_id), round(r.score, 6)) for r in language_model_scores(df).collect()))
    assert out[0] == out[1]


def test_model_is_a_distribution(spark):
    rows, df = docs(spark)
    model, counts = train(df)
    assert np.allclose((10**model.moves).sum(axis=1), 1)
    mass = np.zeros(len(model.tokens))
    for r in counts.collect():
        k = model.classes.of(r.word.encode())
        mass[k] += 10 ** model.emission(np.array([r.n]), np.array([k]))[0]
    for k, n in enumerate(model.words):
        if n:
            assert abs(mass[k] + 10 ** model.emission(np.array([0]), np.array([k]))[0] - 1) < 1e-9


def test_exchange_finds_classes():
    rng = np.random.default_rng(1)
    n = np.zeros((21, 21))
    for i in range(1, 21):
        for j in range(1, 21):
            n[i, j] = rng.integers(50, 90) if i % 2 != j % 2 else rng.integers(0, 3)
    n[0, 1:], n[1:, 0] = 2, 2
    of = exchange(n, 3)
    assert of[0] == 0 and len(set(of[1::2])) == 1 and len(set(of[2::2])) == 1 and of[1] != of[2]


def test_end_is_rarer_than_carried_words(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{i}x{i % 3}" for i in range(20) for _ in range(int(10 * 1.3**i))]
    rng.shuffle(words)
    rows = [(" ".join(words[k::2]), d, 1, "w", "c") for k, d in enumerate(d for d in range(2, 99) if zlib.crc32(str(d).encode()) % 7 != 2) if k < 2]
    c = Counter(w for t, *_ in rows for w in low(t))
    total = sum(c.values())
    want = sorted((d, len(low(t)), len(low(t)), round(sum(math.log10((c[w] + 1) / (total + len(c) + 1)) for w in low(t)), 6)) for t, d, *_ in rows)
    assert c[b" "] == 2 < min(n for w, n in c.items() if w != b" ")
    scores = []
    for carried in (0, 5, 100_000):
        monkeypatch.setattr(brown, "CARRIED", carried)
        out = language_model_scores(spark.createDataFrame(rows, SCHEMA)).collect()
        assert sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in out) == want
        scores.append(len(out))
    assert scores == [2, 2, 2]


def test_score_equals_brute_force(spark, monkeypatch):
    """Class transitions and emissions counted word by word from the model's classes."""
    rows, df = docs(spark)
    for frequent, carried in ((800, 100_000), (10, 40)):
        monkeypatch.setattr(brown, "FREQUENT", frequent)
        monkeypatch.setattr(brown, "CARRIED", carried)
        train_rows = [r for r in rows if r[1] is None or zlib.crc32(str(r[1]).encode()) % 7 != 2]
        ids = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)), F.lit(3)) != 2
        model, _ = train(df.where(ids).select("doc_id", "text"))
        of = model.classes.of
        assert len(model.classes.top) <= carried + 1
        kinds = brown.CLASSES + 1
        between, word_n, mass, distinct = np.zeros((kinds, kinds)), Counter(), np.zeros(kinds), np.zeros(kinds)
        for t, *_ in train_rows:
            row = [b" ", *low(t)]
            word_n.update(row[1:])
            for a, b in zip(row, row[1:]):
                between[of(a), of(b)] += 1
        for w, n in word_n.items():
            mass[of(w)] += n
            distinct[of(w)] += 1
        share = (between.sum(0) + 1) / (between.sum() + kinds)
        moves = (between + 5 * share) / (between.sum(1, keepdims=True) + 5)
        want = []
        for t, d, *_ in rows:
            row, out = [b" ", *low(t)], 0.0
            for a, b in zip(row, row[1:]):
                k = of(b)
                known = word_n[b] - brown.DISCOUNT if word_n[b] else max(brown.DISCOUNT * distinct[k], brown.DISCOUNT)
                out += math.log10(moves[of(a), k]) + math.log10(known / max(mass[k], 1))
            want.append((str(d), round(out, 6)))
        got = sorted((str(r.doc_id), round(r.score, 6)) for r in language_model_scores(df).collect())
        assert [d for d, _ in got] == [d for d, _ in sorted(want)] and np.allclose([x for _, x in got], [x for _, x in sorted(want)], atol=1e-5)


def test_words_beyond_the_frequent_are_clustered_by_their_neighbours(spark, monkeypatch):
    rng = random.Random(10)
    a, b = [f"{i}{rng.choice('pqrst')}a" for i in range(60)], [f"{i}{rng.choice('pqrst')}a" for i in range(100, 160)]
    rows = [(" ".join(rng.choice(a if i % 2 else b) for i in range(80)), d) for d in range(120)]
    monkeypatch.setattr(brown, "FREQUENT", 20)
    monkeypatch.setattr(brown, "CLASSES", 6)
    model, _ = train(spark.createDataFrame(rows, "text string, doc_id long"))
    kinds = [Counter(model.classes.of(w.encode()) for w in x) for x in (a, b)]
    assert sum(max(x[k] for x in kinds) for k in {*kinds[0], *kinds[1]}) >= 0.95 * len(a + b)


def test_texts_are_taken_apart_twice_only(spark, monkeypatch):
    """Once to count words and once to number them; clustering and scoring read the numbers."""
    rows, df = docs(spark)
    steps, step = [], type(df).mapInArrow

    def noted(self, *args, **kwargs):
        steps.append("text" in self.columns)
        return step(self, *args, **kwargs)

    monkeypatch.setattr(type(df), "mapInArrow", noted)
    assert language_model_scores(df).count() == len(rows)
    assert sum(steps) == 2 < len(steps)


def test_no_training_rows(spark):
    held = [d for d in range(60) if zlib.crc32(str(d).encode()) % 7 == 2]
    out = language_model_scores(spark.createDataFrame([(f"a b{d}", d) for d in held], "text string, doc_id long")).collect()
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in out) == [(d, True, 3, 0, 0, 0.0) for d in held]
    assert all(r.score < 0 for r in out)


def test_very_long_text(spark):
    text = " ".join(f"w{i % 5003}" for i in range(300_000))
    got = {r.doc_id: r for r in language_model_scores(spark.createDataFrame([(text, 4, 0, "", ""), ("w1 w2", 3, 0, "", "")], SCHEMA)).collect()}
    assert got[4].n_tokens == got[4].n_known == 300_001 and got[3].n_known == 3 and got[4].score > got[4].base_score
