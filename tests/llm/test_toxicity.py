import random
import zlib
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from loomline.llm import toxicity
from loomline.llm.toxicity import THRESHOLD, Tagger, fit, marginals, op3_toxicity, pieces, tag, train

SCHEMA = "text string, doc_id long, score string, spans int"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    for bias in (-1.0, 0.4):
        tagger = Tagger({}, bias, np.array([[0.0, 0.3], [-0.7, 1.1]]))
        lengths = np.array([7, 3, 9, 1])
        at = [(0, 0), (0, 3), (0, 6), (1, 1), (2, 4), (2, 5), (3, 0)]
        weight = rng.normal(size=len(at)) * 2
        got = marginals(tagger, np.array([a for a, _ in at]), np.array([b for _, b in at]), weight, lengths)
        for i, (doc, place) in enumerate(at):
            own = {b: w for (a, b), w in zip(at, weight) if a == doc}
            mass = [0.0, 0.0]
            for y in product((0, 1), repeat=int(lengths[doc])):
                s = sum(v * (bias + own.get(k, 0.0)) for k, v in enumerate(y)) + sum(tagger.moves[p] for p in zip(y, y[1:]))
                mass[y[place]] += np.exp(s)
            assert abs(got[i] - mass[1] / sum(mass)) < 1e-9


def test_training_learns_features_and_transitions():
    rng = random.Random(1)
    sizes, tokens, features, labels = [], [], [], []
    for _ in range(300):
        n, bad = rng.randint(3, 9), rng.random() < 0.5
        sizes.append(n)
        at = rng.randrange(n)
        for i in range(n):
            labels.append(int(bad and i == at))
            if i == at:
                tokens.append(len(labels) - 1)
                features.append(0 if bad else 1)
    sizes = np.array(sizes)
    w, bias, moves = train(np.cumsum(sizes) - sizes, np.array(features), np.array(tokens), np.array(labels, float), sizes, 2)
    assert w[0] > 3 and w[0] > w[1] and bias < 0 and moves.shape == (2, 2)


def corpus(n=600, seed=5):
    rng = random.Random(seed)
    vocab = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("ren", "lo", "mi", "sta", "n")]
    rows, labels = [], []
    for d in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(5, 120))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(["Vilebad!", "vilegon", "awfulo.", "vilexu"]))
        rows.append((" ".join(words), d, "", 0))
        labels.append((d, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_spans(spark):
    rows, labels = corpus()
    docs, marks = spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in tag(docs, fit(docs, marks)).collect()}
    for d, _, toxic in labels:
        if zlib.crc32(str(d).encode()) % 3 == 1:
            assert (out[d].score >= 0.7) == bool(toxic)
        text = rows[d][0]
        for s in out[d].spans:
            assert text[s.start : s.stop].lower().startswith(("vile", "awful"))
        assert bool(out[d].spans) == bool(toxic)


def test_edge_rows(spark):
    rows, labels = corpus()
    rows = rows[:400]
    odd = [(None, 9001, None, None), ("", 9002, "", 0), (" \n ", None, "", 0), ("long " * 60000 + "vilebad", 9003, "", 0), ("vilegon", 9004, "", 0), ("vilegon", 9004, "", 0)]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    marks = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None), (77777, 0, 1)], "doc_id long, quality int, toxic int")
    out = tag(docs, fit(docs, marks)).collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r.score for r in out}
    assert by[9001] == by[9002] == by[None] == min(by.values()) and by[9003] >= 0.7 and by[9004] >= 0.7
    empty = spark.createDataFrame([], SCHEMA)
    assert tag(empty, fit(empty, marks)).count() == 0
    flat = tag(docs, fit(docs, marks.where("toxic = 0")))
    assert flat.select("score").distinct().count() == 1 and flat.first().score < 0.7


def test_given_documents(spark):
    out = op3_toxicity(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = out.join(labels, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")).alias("right"), F.count("*").alias("n")).first()
    assert got.n > 100 and got.right > 0.93
    assert out.columns == ["doc_id", "held_out", "score", "predicted", "spans"] and out.count() == 1000


def slow_score(text, tagger):
    """Forward and backward, word by word; score and words above one half."""
    words = text.lower().split()
    on = [any(p in tagger.weights for p in pieces(w)) for w in words]
    emit = [np.array([1.0, np.exp(tagger.bias + sum(tagger.weights.get(p, 0.0) for p in pieces(w)))]) for w in words]
    across = np.exp(tagger.moves)
    f, b = [], [np.ones(2)]
    for i, e in enumerate(emit):
        v = (f[-1] @ across if i else np.ones(2)) * e
        f.append(v / v.sum())
    for e in emit[:0:-1]:
        v = across @ (e * b[-1])
        b.append(v / v.sum())
    p = [float((x * y)[1] / (x * y).sum()) for x, y in zip(f, b[::-1])]
    best = max((min(np.log(x) - np.log1p(-x), 20.0) for x, k in zip(p, on) if k), default=-8.0)
    return 1 / (1 + np.exp(-(tagger.shift + tagger.slope * max(best, -8.0)))), sum(x >= 0.5 for x, k in zip(p, on) if k)


def test_scores_of_given_documents_equal_brute_force(spark):
    """Also where several labels of a document disagree: one toxic label is enough."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    more = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tagger = fit(more, labels.union(labels.selectExpr("doc_id", "quality", "0 as toxic")))
    assert tagger.weights == fit(more, labels).weights and tagger.weights
    hits = 0
    for r in tag(docs, tagger, carry_text=True).collect():
        score, n = slow_score(r.text, tagger)
        assert abs(r.score - score) < 1e-6 and bool(r.spans) == bool(n)
        hits += score >= THRESHOLD
    assert hits


def test_blocks_of_the_fit_change_nothing(monkeypatch):
    rng = random.Random(6)
    sizes = np.array([rng.randint(1, 9) for _ in range(101)])
    n = int(sizes.sum())
    tokens = np.arange(0, n, 2)
    features, labels = np.array([rng.randrange(3) for _ in tokens]), np.array([float(rng.random() < 0.3) for _ in range(n)])
    out = []
    for block in (7, 20_000):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        w, bias, moves = train(np.cumsum(sizes) - sizes, features, tokens, labels, sizes, 3, steps=40)
        out.append([*w, bias, *moves.ravel()])
    assert np.allclose(*out)
