"""Toxicity: a linear-chain conditional random field over words, scores from its marginals."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import crc_mod, cut, read, slices, texts

#: Most labelled documents that the model is fitted on; all else follows from them.
LABELLED = 12_000
#: Stretches of text that a step of the fit holds at a time.
BLOCK = 20_000
#: Lengths of the prefixes that are features of a word, beside the word itself (kind 0).
PREFIXES = (3, 4, 5, 6)
#: Words on either side of a word with features, in training.
CONTEXT = 5
#: Least toxic documents with a feature, and the share of toxic ones from which it labels tokens.
LEAST_DOCS, DECISIVE = 3, 0.9
THRESHOLD = 0.7
STEPS, RATE, RIDGE = 150, 0.3, 1e-4
#: Words a worker remembers between batches.
REMEMBERED = 400_000
SLICE_BYTES = 4_000_000
_EDGES = ".,;:!?\"'`()[]{}<>«»“”‘’…–—*_~-"
_WORD = re.compile(r"\S+")
_FEWEST, _MOST = -8.0, 20.0


def words_of(text: str) -> list[str]:
    return text.lower().split()


def pieces(word: str) -> list[tuple[int, str]]:
    """The features a word may have."""
    word = word.strip(_EDGES)
    return [(0, word), *((k, word[:k]) for k in PREFIXES if len(word) >= k)]


@dataclass
class Tagger:
    """Weights of features, of the label itself and of transitions, for label 1 against 0; and the calibration of document scores."""

    weights: dict[tuple[int, str], float]
    bias: float
    moves: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def weight(self, word: str) -> float:
        """Evidence of one word; 0 if it has no features."""
        get = self.weights.get
        return sum(get(p, 0.0) for p in pieces(word))

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.shift + self.slope * evidence, -500, 500)))


def _step(moves: np.ndarray, bias: float):
    """Powers of the transfer matrix of a word without features, up to scale: a function of arrays of exponents."""
    values, right = np.linalg.eig(np.exp(moves) * np.array([1.0, np.exp(bias)]))
    values, right = values.real, right.real
    order = np.argsort(-np.abs(values))
    values, right = values[order], right[:, order]
    left = np.linalg.inv(right)
    first, second, ratio = np.outer(right[:, 0], left[0]), np.outer(right[:, 1], left[1]), values[1] / values[0]
    return lambda k: first + np.power(ratio, np.asarray(k, float))[:, None, None] * second


def marginals(tagger: Tagger, owner: np.ndarray, place: np.ndarray, weight: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each word with features, given its whole text.

    `owner` ascends and `place` ascends within it. Forward and backward messages
    pass over the words in between by powers of their common transfer matrix, so
    that this is exact for texts of any length.
    """
    if not len(owner):
        return np.zeros(0)
    power, across = _step(tagger.moves, tagger.bias), np.exp(tagger.moves)
    emit = np.stack([np.ones(len(weight)), np.exp(np.clip(weight + tagger.bias, -30, 30))], axis=1)
    docs, starts, counts = np.unique(owner, return_index=True, return_counts=True)
    forward, backward = np.empty_like(emit), np.empty_like(emit)
    v = np.empty((len(docs), 2))
    for s in range(int(counts.max())):
        on = np.flatnonzero(counts > s)
        at = starts[on] + s
        if s == 0:
            p = place[at]
            lead = np.einsum("j,njk,kl->nl", np.array([1.0, np.exp(tagger.bias)]), power(np.maximum(p - 1, 0)), across)
            v[on] = np.where((p == 0)[:, None], 1.0, lead)
        else:
            v[on] = np.einsum("nj,njk,kl->nl", v[on], power(place[at] - place[at - 1] - 1), across)
        v[on] *= emit[at]
        v[on] /= v[on].sum(axis=1, keepdims=True)
        forward[at] = v[on]
    ends = starts + counts - 1
    for s in range(int(counts.max())):
        on = np.flatnonzero(counts > s)
        at = ends[on] - s
        if s == 0:
            v[on] = power(lengths[docs[on]] - 1 - place[at]).sum(axis=2)
        else:
            v[on] = np.einsum("njk,kl,nl->nj", power(place[at + 1] - place[at] - 1), across, emit[at + 1] * v[on])
        v[on] /= v[on].sum(axis=1, keepdims=True)
        backward[at] = v[on]
    both = forward * backward
    return both[:, 1] / both.sum(axis=1)


def train(offsets: np.ndarray, features: np.ndarray, tokens: np.ndarray, labels: np.ndarray, sizes: np.ndarray, n_features: int, steps: int = STEPS) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and transitions of highest penalised likelihood, by gradient ascent (Adam).

    Stretch i has sizes[i] words; `features` belong to the flat words `tokens`,
    `labels` are of flat words, and stretch i begins at offsets[i].
    """
    x = np.zeros(n_features + 4)  # features, bias, transitions 0-1, 1-0, 1-1
    m, v = np.zeros_like(x), np.zeros_like(x)
    blocks, seen, total = [], np.zeros(n_features + 4), float(sizes.sum())
    np.add.at(seen, features, labels[tokens])
    for at in range(0, len(sizes), BLOCK):
        own = sizes[at : at + BLOCK]
        inside = np.arange(int(own.max())) < own[:, None]
        grid = np.where(inside, offsets[at : at + BLOCK, None] + np.arange(inside.shape[1]), 0)
        y, pair_in = labels[grid] * inside, inside[:, 1:]
        seen[n_features] += y.sum()
        for k, (a, b) in enumerate(((0, 1), (1, 0), (1, 1))):
            seen[n_features + 1 + k] += ((y[:, :-1] == a) & (y[:, 1:] == b) & pair_in).sum()
        blocks.append((grid, inside))
    for t in range(1, steps + 1):
        flat = np.bincount(tokens, x[features], len(labels))
        flat_p, expected = np.zeros(len(labels)), np.zeros(n_features + 4)
        for grid, inside in blocks:
            p, ends = _expected(flat[grid] + x[n_features], x[n_features + 1 :], inside)
            flat_p[grid[inside]] = p[inside]
            expected[n_features] += p.sum()
            expected[n_features + 1 :] += ends
        np.add.at(expected, features, flat_p[tokens])
        g = (seen - expected) / total - RIDGE * x
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x += RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8) * (1 - (t - 1) / steps)
    return x[:n_features], float(x[n_features]), np.array([[0.0, x[n_features + 1]], [x[n_features + 2], x[n_features + 3]]])


def _expected(weight: np.ndarray, moves: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, tuple[float, float, float]]:
    """Forward and backward over stretches (rows): probabilities of label 1, and expected transitions 0-1, 1-0, 1-1."""
    e1 = np.exp(np.clip(weight, -30, 30))
    across = np.exp(np.array([[0.0, moves[0]], [moves[1], moves[2]]]))
    longest = inside.shape[1]
    f, b = np.empty((*inside.shape, 2)), np.ones((*inside.shape, 2))
    f[:, 0] = np.stack([np.ones(len(inside)), e1[:, 0]], axis=1)
    for i in range(1, longest):
        f[:, i] = f[:, i - 1] @ across
        f[:, i, 1] *= e1[:, i]
        f[:, i] /= f[:, i].sum(axis=1, keepdims=True)
    for i in range(longest - 2, -1, -1):
        behind = b[:, i + 1].copy()
        behind[:, 1] *= e1[:, i + 1]
        behind = behind @ across.T
        behind /= behind.sum(axis=1, keepdims=True)
        b[:, i] = np.where(inside[:, i + 1, None], behind, 1.0)
    node = f * b
    p = node[..., 1] / node.sum(axis=2) * inside
    after = b[:, 1:].copy()
    after[..., 1] *= e1[:, 1:]
    pair = f[:, :-1, :, None] * across * after[:, :, None, :]
    pair *= (inside[:, 1:] / np.maximum(pair.sum(axis=(2, 3)), 1e-300))[..., None, None]
    return p, (pair[..., 0, 1].sum(), pair[..., 1, 0].sum(), pair[..., 1, 1].sum())


def calibrate(evidence: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope (above 0) and shift of a logistic curve, by Newton steps towards slope 1 and shift 0 where data are few."""
    x, w = np.stack([evidence, np.ones(len(evidence))], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (toxic - p) - (w - np.array([1.0, 0.0]))
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2)
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return max(0.05, float(w[0])), float(w[1])


def labelled_sample(docs: DataFrame, labels: DataFrame, mod: int, remainder: int, most: int = LABELLED) -> DataFrame:
    """(doc_id, toxic, text) of at most `most` labelled documents outside the held-out part, chosen by a hash of the id.

    A document with several label rows is toxic if one of them says so; null
    labels and ids are no labels. Of rows that share an id the least text counts.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    rows = rows.where(crc_mod("doc_id", mod) != remainder).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # Broadcast: at most `most` ids.
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return cut(found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each feature: toxic ones, and all."""
    for batch in slices(batches, "text", SLICE_BYTES):
        every, bad = Counter(), Counter()
        for text, toxic in zip(texts(batch), batch.column("toxic").to_pylist(), strict=True):
            found = {p for w in set(words_of(text)) for p in pieces(w)}
            every.update(found)
            if toxic:
                bad.update(found)
        # A feature of no toxic document is none, but its tally may still be needed elsewhere.
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in every], pa.int32()), pa.array([p for _, p in every], pa.string()), pa.array([bad[x] for x in every], pa.int64()), pa.array(list(every.values()), pa.int64())], ["kind", "piece", "toxic", "docs"])


def choose_features(sample: DataFrame, toxic: int, every: int) -> list[tuple[int, str, bool]]:
    """Features whose documents are toxic more often than chance allows, and whether they label tokens.

    The likelihood ratio must beat what the best of all features would reach by
    chance. Only those come to the driver: words of the bounded sample that do.
    """
    counts = sample.mapInArrow(_tally, "kind int, piece string, toxic long, docs long").groupBy("kind", "piece").agg(F.sum("toxic").alias("a"), F.sum("docs").alias("n"))
    counts = cut(counts.where((F.col("a") >= LEAST_DOCS) & (F.col("piece") != "")))
    tested = counts.count()

    def x_log_x(x):
        return F.when(x > 0, x * F.log(x)).otherwise(0.0)

    a, n, t, s = F.col("a").cast("double"), F.col("n").cast("double"), F.lit(float(toxic)), F.lit(float(every))
    ratio = 2 * (x_log_x(a) + x_log_x(n - a) + x_log_x(t - a) + x_log_x(s - t - n + a) - x_log_x(n) - x_log_x(s - n) - x_log_x(t) - x_log_x(s - t) + x_log_x(s))
    best = counts.withColumn("ratio", ratio).where((a * s > n * t) & (F.col("ratio") > 2 * np.log(20.0 * max(1, tested))))
    return [(r.kind, r.piece, r.a >= DECISIVE * r.n) for r in best.orderBy(F.desc("ratio"), "kind", "piece").collect()]


def stretches(sample: DataFrame, chosen: list[tuple[int, str, bool]]) -> pa.Table:
    """Words with features and those around them, with labels: 1 for words with a decisive feature in toxic documents.

    Toxic documents without such a word are left out, as their toxic words aren't known.
    """
    number = {(k, p): i for i, (k, p, _) in enumerate(chosen)}
    decisive = {i for i, x in enumerate(chosen) if x[2]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            rows = []
            for doc, text, toxic in zip(batch.column("doc_id").to_pylist(), texts(batch), batch.column("toxic").to_pylist(), strict=True):
                words = words_of(text)
                known = {w: own for w in set(words) if (own := [number[p] for p in pieces(w) if p in number])}
                active = [i for i, w in enumerate(words) if w in known]
                if toxic and not any(decisive & set(known[words[i]]) for i in active):
                    continue
                end = -1
                for i in active:
                    if i > end:
                        start, end = max(0, i - CONTEXT), min(len(words) - 1, i + CONTEXT)
                        own = [(j - start, f) for j in range(start, end + 1) for f in known.get(words[j], ())]
                        ones = [j - start for j in range(start, end + 1) if toxic and not decisive.isdisjoint(known.get(words[j], ()))]
                        rows.append((doc, i, end - start + 1, [j for j, _ in own], [f for _, f in own], ones))
            kinds = (pa.int64(), pa.int64(), pa.int32(), *(pa.list_(pa.int32()),) * 3)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc", "at", "size", "place", "feature", "ones"])

    found = sample.mapInArrow(run, "doc long, at long, size int, place array<int>, feature array<int>, ones array<int>")
    return found.orderBy("doc", "at").toArrow()


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and the row of each."""
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))


def fit(docs: DataFrame, labels: DataFrame, mod: int = 3, remainder: int = 1) -> Tagger:
    """A tagger and its calibration, from labelled documents outside the held-out part.

    Without toxic (or without clean) documents among them, all texts score alike.
    """
    sample = labelled_sample(docs, labels, mod, remainder)
    size = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"), F.count("*").alias("n")).first()
    flat = Tagger({}, -8.0, np.zeros((2, 2)), 0.05, float(np.log((size.toxic + 0.5) / (size.n - size.toxic + 1.5))))
    if not 0 < size.toxic < size.n:
        return flat
    chosen = choose_features(sample, size.toxic, size.n)
    rows = stretches(sample, chosen) if chosen else None
    if not rows:
        return flat
    sizes = rows["size"].to_numpy().astype(np.int64)
    offsets = np.cumsum(sizes) - sizes
    place, of = _flat(rows["place"])
    feature, _ = _flat(rows["feature"])
    ones, of_ones = _flat(rows["ones"])
    marks = np.zeros(int(sizes.sum()))
    marks[offsets[of_ones] + ones] = 1
    weights, bias, moves = train(offsets, feature.astype(np.int64), offsets[of] + place, marks, sizes, len(chosen))
    tagger = Tagger({(k, p): float(w) for (k, p, _), w in zip(chosen, weights, strict=True)}, bias, moves)
    seen = tag(sample, tagger, ("toxic",)).select("toxic", "evidence").toArrow()
    tagger.slope, tagger.shift = calibrate(seen["evidence"].to_numpy(), seen["toxic"].to_numpy().astype(float))
    return tagger


def tag(docs: DataFrame, tagger: Tagger, keys: tuple[str, ...] = ("doc_id",), carry_text: bool = False) -> DataFrame:
    """`keys`, evidence, score and spans of every row of `docs`.

    spans: character offsets (from, to) of neighbouring words that are likelier
    toxic than not, with their highest probability. evidence: the log odds of the
    likeliest toxic word with features; a sum over words would grow with a clean
    text's length. A null text counts as empty; texts
    without words with features share the lowest score. Repeated rows are each
    scored; an empty table gives no rows; other columns are ignored.
    """
    docs = docs.select(*keys, F.col("text").cast("string").alias("text"))
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keys] + ["text string"] * carry_text
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("probability", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, float] = {}
        for batch in slices(batches, "text", SLICE_BYTES):
            rows = texts(batch)
            split = [words_of(t) for t in rows]
            lengths = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
            flat = [w for ws in split for w in ws]
            found = list(map(memory.get, flat))
            if None in found:
                new = {w: tagger.weight(w) for w in {w for w, f in zip(flat, found, strict=True) if f is None}}
                if len(memory) < REMEMBERED:
                    memory.update((w, x) for w, x in new.items() if len(w) < 64)
                found = [new[w] if f is None else f for w, f in zip(flat, found, strict=True)]
            weight = np.array(found, dtype=np.float64)
            at = np.flatnonzero(weight)
            firsts = np.cumsum(lengths) - lengths
            owner = np.searchsorted(np.cumsum(lengths), at, side="right")
            place = at - firsts[owner]
            p = marginals(tagger, owner, place, weight[at], lengths)
            evidence = np.full(len(rows), _FEWEST)
            with np.errstate(divide="ignore"):
                np.maximum.at(evidence, owner, np.minimum(np.log(p) - np.log1p(-p), _MOST))
            spans: list[list[dict]] = [[] for _ in rows]
            hits = np.flatnonzero(p >= 0.5).tolist()
            before = (-1, -1)
            for i in hits:
                d, k = int(owner[i]), int(place[i])
                if before[0] != d:
                    ends = [m.span() for m in _WORD.finditer(rows[d])]
                if before == (d, k - 1):
                    spans[d][-1]["stop"] = ends[k][1]
                    spans[d][-1]["probability"] = max(spans[d][-1]["probability"], float(p[i]))
                else:
                    spans[d].append({"start": ends[k][0], "stop": ends[k][1], "probability": float(p[i])})
                before = (d, k)
            carried = [batch.column("text")] * carry_text
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), *carried, pa.array(evidence), pa.array(tagger.probability(evidence)), pa.array(spans, pa.list_(span))], [*keys, *["text"] * carry_text, "evidence", "score", "spans"])

    return docs.mapInArrow(run, ", ".join([*kinds, "evidence double, score double, spans array<struct<start: bigint, stop: bigint, probability: double>>"]))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = tag(docs.select("doc_id", "text"), fit(docs, read(spark, sf_dir, "labels")))
    held = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")
