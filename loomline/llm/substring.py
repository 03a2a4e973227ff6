"""Substring dedup: recurring phrases, automata over them, first occurrences."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import cut, read, slices, text_bytes

WINDOW = 20
#: Words of a phrase. Every window holds WINDOW - PHRASE + 1 phrases, and its least hashed one stands for it.
PHRASE = 6
#: Bytes of text whose recurring phrases make one automaton.
SHARD_BYTES = 1_000_000
_MIX = [np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)]
_BASE = 0x9E3779B97F4A7C15
_OCTET = np.random.default_rng(20).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n, modulo 2 ** 64."""
    if base not in _powers or len(_powers[base]) <= n:
        out = np.full(max(n + 1, 4096), base, dtype=np.uint64)
        out[0] = 1
        _powers[base] = np.cumprod(out, dtype=np.uint64)
    return _powers[base]


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of values[start:end], for many ranges at once.

    They only choose phrases: a collision adds an occurrence to look at, and removes nothing.
    """
    n = len(values)
    up, down = _power(_BASE, n), _power(pow(_BASE, -1, 2**64), n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * up[:n], dtype=np.uint64, out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(words: list[bytes]) -> np.ndarray:
    joined = np.frombuffer(b" ".join(words), dtype=np.uint8)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return _ranges(_OCTET[joined], starts, ends)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    starts = np.arange(max(0, len(hashes) - n + 1))
    return _ranges(hashes, starts, starts + n)


def _phrases(batch: pa.RecordBatch, window: int, phrase: int) -> pa.RecordBatch:
    """The phrases that stand for the windows of each document, once a document: hash, first start, occurrences."""
    docs = [x.split() for x in text_bytes(batch)]
    counts = np.array([len(x) for x in docs])
    hashes = word_hashes([w for x in docs for w in x]) if counts.sum() else np.zeros(0, np.uint64)
    of = np.repeat(np.arange(len(docs)), counts)
    first = np.repeat(np.cumsum(counts) - counts, counts)
    if len(hashes) >= window:
        grams = gram_hashes(hashes, phrase)
        span = window - phrase + 1
        at = np.flatnonzero(of[: len(of) - window + 1] == of[window - 1 :])
        least = np.lib.stride_tricks.sliding_window_view(grams, span)
        # Leftmost of equal phrases, so that equal windows choose alike.
        chosen = np.unique(np.concatenate([p + least[p].argmin(axis=1) for p in np.array_split(at, 1 + len(at) // 200_000)]))
        keys, order = grams[chosen], np.lexsort((chosen, grams[chosen], of[chosen]))
        keys, places, owner = keys[order], chosen[order], of[chosen][order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
        heads = np.flatnonzero(new)
        times = np.diff(np.append(heads, len(keys)))
        owner, keys, starts = owner[heads], keys[heads], (places - first[places])[heads]
    else:
        owner = keys = starts = times = np.zeros(0, np.int64)
    rows = pa.array(owner, pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(keys.view(np.int64) if keys.dtype == np.uint64 else keys, pa.int64()), batch.column("doc").take(rows), batch.column("tie").take(rows), pa.array(starts, pa.int32()), pa.array(times, pa.int32())],
        ["phrase", "doc", "tie", "start", "n"],
    )


def _occurrences(batch: pa.RecordBatch, window: int, phrase: int) -> pa.RecordBatch:
    """Compile the shard's recurring phrases and stream its documents through them.

    Rows with a tag from 0 on are windows with a recurring phrase, each at its
    first start in the document, keyed by 95 bits of its BLAKE2b digest. Rows with a tag below
    are runs of starts of such windows, keyed by where they lie, so that no two
    are merged. A place is a start times 2 ** 32 plus a run's end, 0 for a window.
    """
    docs = [x.decode("utf-8").split(" ") if x else [] for x in (b" ".join(t.split()) for t in text_bytes(batch))]
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for words, starts in zip(docs, batch.column("starts").to_pylist(), strict=True):
        for s in starts:
            automaton.add_word(f" {' '.join(words[s : s + phrase])} ")
    automaton.make_automaton()
    out: list[list[np.ndarray]] = [[] for _ in range(4)]
    ids = [x or 0 for x in batch.column("doc").to_pylist()]
    for i, words in enumerate(docs):
        n = len(words) - window + 1
        if n < 1:
            continue
        line = f" {' '.join(words)} "
        ends = np.fromiter((end for end, _ in automaton.iter(line)), dtype=np.int64)
        if not len(ends):
            continue
        # The space that ends each word, as an offset in the line.
        spaces = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        at = np.searchsorted(spaces, ends) - phrase + 1
        delta = np.zeros(n + 1, dtype=np.int64)
        np.add.at(delta, np.clip(at - (window - phrase), 0, n), 1)
        np.add.at(delta, np.clip(at + 1, 0, n), -1)
        inside = np.cumsum(delta[:n]) > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
        lo, hi = edges[::2], edges[1::2]
        starts = np.flatnonzero(inside)
        raw = " ".join(words).encode()
        stops = np.cumsum(np.fromiter((len(w) if w.isascii() else len(w.encode()) for w in words), dtype=np.int64, count=len(words)) + 1) - 1
        begins = np.concatenate([[0], stops[:-1] + 1])
        first: dict[bytes, int] = {}
        for s, a, b in zip(starts.tolist(), begins[starts].tolist(), stops[starts + window - 1].tolist(), strict=True):
            first.setdefault(hashlib.blake2b(raw[a:b], digest_size=12).digest(), s)
        keys = np.frombuffer(b"".join(first), dtype=[("one", "<i8"), ("two", "<u4")])
        own = np.fromiter(first.values(), dtype=np.int64, count=len(first))
        runs = np.full(len(lo), ids[i], np.int64)
        for column, x in zip(out, (np.concatenate([keys["one"], runs]), np.concatenate([(keys["two"] >> np.uint32(1)).astype(np.int64), -1 - lo]), np.full(len(own) + len(lo), i), np.concatenate([own << 32, lo << 32 | hi])), strict=True):
            column.append(x)
    one, tag, owner, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
    rows = pa.array(owner, pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(one, pa.int64()), pa.array(tag, pa.int32()), batch.column("doc").take(rows), batch.column("tie").take(rows), pa.array(place, pa.int64())],
        ["one", "tag", "doc", "tie", "place"],
    )


def _kept(batch: pa.RecordBatch, window: int) -> pa.RecordBatch:
    total, removed, kept, digests = [], [], [], []
    for text, spans in zip(text_bytes(batch), batch.column("spans").to_pylist(), strict=True):
        words = text.split()
        left = words
        if spans:
            covers = np.zeros(len(words), dtype=bool)
            at = np.array(spans, dtype=np.int64)
            starts, stops = at >> 32, at & 0xFFFFFFFF
            for start, stop in zip(starts[stops > 0].tolist(), stops[stops > 0].tolist(), strict=True):
                covers[start : min(stop, max(0, len(words) - window + 1))] = True
            covers[starts[stops == 0]] = False
            delta = np.zeros(len(words) + window + 1, dtype=np.int64)
            starts = np.flatnonzero(covers)
            np.add.at(delta, starts, 1)
            np.add.at(delta, starts + window, -1)
            gone = np.cumsum(delta)[: len(words)] > 0
            left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
        joined = b" ".join(left)
        total.append(len(words))
        removed.append(len(words) - len(left))
        kept.append(text.decode("utf-8") if len(left) == len(words) else joined.decode("utf-8"))
        digests.append(hashlib.sha256(joined).hexdigest())
    head = [batch.column(c) for c in batch.schema.names if c != "spans"]
    return pa.RecordBatch.from_arrays(
        [*head, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.string())],
        [*(c for c in batch.schema.names if c != "spans"), "n_words", "n_removed", "kept_sha256", "kept_text"],
    )


def _over(step, limit: int, *args):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", limit):
            yield step(part, *args)

    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove words in windows of `window` words that start earlier as well.

    Returns doc_id, the columns in `carry`, text, n_words, n_removed, kept_sha256, kept_text (the text
    as it is if nothing goes, else the kept words joined by a space).

    0. Of rows with equal texts, only the first takes part; in the others all windows start earlier.
    1. Each window is stood for by its least hashed phrase, so equal windows
       share one; phrases found at two places in all documents recur.
    2. For each shard of documents, the phrases that recur and lie in it are
       compiled to an Aho-Corasick automaton, which streams the shard's
       documents and locates every occurrence. Each distinct window around an
       occurrence is known by 95 bits of its BLAKE2b digest; the first document
       of each is kept. Documents that share no phrase with another place hold no
       occurrence, and aren't streamed.
    3. A document's words go if covered by a window that isn't first.

    A null text has no words. A null doc_id counts as the smallest. Rows that
    share a doc_id are ordered by the hash of their text; equal rows get equal
    results. A text of any length is one row of a batch of its own; an empty
    table gives no rows; other columns are ignored, whatever their names.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(F.lit(0), *carry).alias("carry"))
    # Rows that repeat an id are told apart by a second key.
    ties = not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    keys = ["doc", "tie"] if ties else ["doc"]
    no_tie, none = F.lit(0).cast("long").alias("tie"), F.lit(-(2**63))
    keyed = docs.select(F.coalesce("doc_id", none).alias("doc"), *([F.coalesce(F.xxhash64("text"), F.lit(0)).alias("tie")] if ties else []), "text", *(["carry"] if carry else []))
    full = keyed.select("doc", "tie", "text") if ties else keyed.select("doc", no_tie, "text")
    # Of equal texts only the first goes further: the others' windows all start earlier there.
    equal = keyed.select(*keys, F.xxhash64("text", F.lit(1)).alias("h"), F.xxhash64(F.lit(2), "text").alias("g"))
    lead = equal.groupBy("h", "g").agg(F.min(F.struct(*keys)).alias("lead") if ties else F.min("doc").alias("lead"), F.count("*").alias("n")).where("n > 1")
    # Written first, so that the join has no aggregate beside it and a large group of copies can be split.
    copies = equal.join(cut(lead), ["h", "g"]).where((F.struct(*keys) if ties else F.col("doc")) != F.col("lead")).select(*keys)
    copies = cut(copies.distinct() if ties else copies)
    spots = full.mapInArrow(_over(_phrases, SHARD_BYTES, window, phrase), "phrase long, doc long, tie long, start int, n int")
    # Written first, so that the join has no aggregate beside it and a phrase of very many documents can be split.
    recurs = cut(spots.groupBy("phrase").agg(F.sum("n").alias("times")).where("times > 1").select("phrase"))
    starts = spots.select("phrase", *keys, "start").join(recurs, "phrase").groupBy(*keys).agg(F.collect_list("start").alias("starts")).join(copies, keys, "left_anti")
    near = keyed.join(starts, keys).select("doc", F.col("tie") if ties else no_tie, "text", "starts")
    found = near.mapInArrow(_over(_occurrences, SHARD_BYTES, window, phrase), "one long, tag int, doc long, tie long, place long")
    if ties:
        run = [F.expr(f"if(tag < 0, {c}, 0)").alias(f"run_{c}") for c in keys]
        head = found.groupBy("one", "tag", *run).agg(F.min(F.struct("doc", "tie", "place")).alias("f")).select("f.*")
    else:
        head = found.groupBy("one", "tag").agg(F.min("doc").alias("doc"), F.min_by("place", "doc").alias("place"))
    # A copy is covered from its first window to its last.
    head = head.select(*keys, "place").union(copies.select(*keys, F.lit(2**31 - 1).cast("long")))
    spans = head.groupBy(*keys).agg(F.collect_list("place").alias("spans"))
    out = keyed.join(spans, keys, "left").select(F.nullif("doc", none).alias("doc_id"), *(F.col(f"carry.{c}").alias(c) for c in carry), "text", "spans")
    kinds = "".join(f"`{c}` {out.schema[c].dataType.simpleString()}, " for c in carry)
    return out.mapInArrow(_over(_kept, 8 * SHARD_BYTES, window), f"doc_id long, {kinds}text string, n_words long, n_removed long, kept_sha256 string, kept_text string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
