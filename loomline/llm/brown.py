"""Language-model scores by a class-based bigram model with exchange clustering."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import cut, read, slices, stored, text_bytes

#: Not a word, as it holds a space.
END = b" "
#: Most words whose counts go along with the tasks; the others' counts are joined.
CARRIED = 65_536
#: Items that are exchanged one by one: frequent words, and endings (two characters) of all other words.
FREQUENT, ENDINGS, CLASSES, SWEEPS = 800, 223, 64, 8
#: Rounds in which all other carried words are exchanged at once, on Spark; a second one gains 0.002 a token.
ROUNDS = 1
#: Added to counts of neighbouring classes that are compared, so that empty classes attract nothing.
FEW = 5.0
#: Taken from each known word's count for the unknown word of its class.
DISCOUNT = 0.7
SLICE_BYTES = 2_000_000
#: Octets of token ids, of four each, that a step over them handles at a time.
SLICE_IDS = 4_000_000


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all tokens of `docs`, ends included; exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 * SLICE_BYTES):
            tally: Counter = Counter()
            for text in text_bytes(batch):
                tally.update(tokens(text))
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8") for w in tally], pa.string()), pa.array(list(tally.values()), pa.int64())], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def carried_words(counts: DataFrame, most: int) -> tuple[list[tuple[bytes, int]], int | None]:
    """The words from the least count on that leaves at most `most` of them, and always the end; that count, None if no word but the end."""
    bins = counts.groupBy(F.floor(F.log2("n") * 16).cast("int").alias("b")).agg(F.count("*").alias("k"), F.min("n").alias("n")).collect()
    room, least = most, None
    for b in sorted(bins, key=lambda b: -b.b):
        if b.k > room:
            break
        room, least = room - b.k, b.n
    rows = counts.where((F.col("n") >= least) if least is not None else F.lit(False)).union(counts.where(F.col("word") == END.decode())).distinct().collect()
    return sorted(((r.word.encode(), r.n) for r in rows), key=lambda x: (-x[1], x[0])), least


def _x_log_x(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """A class for each item, moving items one by one to where the class bigram likelihood is highest.

    Item 0, the end of a text, keeps a class of its own, 0.
    """
    items = len(bigrams)
    of = np.zeros(items, dtype=np.int64)
    if items == 1:
        return of
    rank = np.empty(items, dtype=np.int64)
    rank[np.argsort(-(bigrams.sum(0) + bigrams.sum(1)), kind="stable")] = np.arange(items)
    of[1:] = 1 + rank[1:] % max(1, classes - 1)
    member = np.zeros((items, classes))
    member[np.arange(items), of] = 1
    between = member.T @ bigrams @ member
    for _ in range(sweeps):
        moved = 0
        for w in np.argsort(rank):
            if w == 0:
                continue
            right, left = bigrams[w] @ member, bigrams[:, w] @ member
            own, old = bigrams[w, w], of[w]
            right[old] -= own
            left[old] -= own
            between[old] -= right
            between[:, old] -= left
            between[old, old] -= own
            rows, columns = between.sum(1), between.sum(0)
            total_r, total_l = right.sum() + own, left.sum() + own
            gain = (_x_log_x(between + right) - _x_log_x(between)).sum(1) + (_x_log_x(between.T + left) - _x_log_x(between.T)).sum(1)
            d = np.arange(classes)
            inner = between[d, d]
            gain += _x_log_x(inner + right + left + own) - _x_log_x(inner + right) - _x_log_x(inner + left) + _x_log_x(inner)
            gain -= _x_log_x(rows + total_r) - _x_log_x(rows) + _x_log_x(columns + total_l) - _x_log_x(columns)
            gain[0] = -np.inf
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-6:
                new = old
            between[new] += right
            between[:, new] += left
            between[new, new] += own
            member[w, old], member[w, new], of[w] = 0, 1, new
            moved += new != old
        if moved <= items // 1000:
            break
    return of


@dataclass
class Items:
    """Maps any word to its item: itself if frequent, else its ending of two characters, else the rest (the last item)."""

    words: dict[bytes, int]
    endings: dict[bytes, int]

    def of(self, word: bytes) -> int:
        item = self.words.get(word)
        if item is not None:
            return item
        return self.endings.get(word[-2:] if word.isascii() else word.decode("utf-8")[-2:].encode(), len(self.words) + len(self.endings))

    @property
    def size(self) -> int:
        return len(self.words) + len(self.endings) + 1


def choose_items(counts: DataFrame, top: list[tuple[bytes, int]]) -> Items:
    words = {END: 0}
    for w, _ in top[:FREQUENT]:
        words.setdefault(w, len(words))
    # The end may be rarer than all of them.
    least = min((n for w, n in top[:FREQUENT] if w != END), default=None)
    # Only the most frequent endings reach the driver.
    rare = counts if least is None else counts.where(F.col("n") <= least)
    rows = rare.groupBy(F.expr("right(word, 2)").alias("ending")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "ending").limit(ENDINGS).collect()
    return Items(words, {r.ending.encode(): len(words) + i for i, r in enumerate(rows)})


@dataclass
class Vocabulary:
    """Counts of all words of the training rows, and what stands for a word in `coded` texts: its place in `top` if it is carried, else a number after these for its item."""

    counts: DataFrame
    total: int
    distinct: int
    top: list[tuple[bytes, int]]
    #: Count from which words are carried, besides the end.
    least: int | None
    items: Items

    @property
    def item_of(self) -> np.ndarray:
        """The item of each number in `coded` texts."""
        return np.append(np.array([self.items.of(w) for w, _ in self.top], dtype=np.int64), np.arange(self.items.size))

    @property
    def end(self) -> int:
        """The number of the end; without training rows it isn't carried, and is item 0."""
        return next((i for i, (w, _) in enumerate(self.top) if w == END), len(self.top))


def vocabulary(docs: DataFrame) -> Vocabulary:
    counts = stored(word_counts(docs))
    size = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    top, least = carried_words(counts, CARRIED)
    return Vocabulary(counts, size.n or 0, size.v, top, least, choose_items(counts, top))


def coded(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """(row, doc_id, held, ids, rare) for each row of `docs` (doc_id, text, held), as a table: texts are taken apart once, and all that follows reads numbers.

    ids: the numbers of a text's tokens, 32 bits each; rare: its words that aren't carried, how often it has each, and their items.
    """
    shared = docs.sparkSession.sparkContext.broadcast(({w: i for i, (w, _) in enumerate(words.top)}, words.items))  # bounded by CARRIED words
    kind = pa.struct([("word", pa.string()), ("tf", pa.int64()), ("item", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, items = shared.value
        size = len(top)
        for batch in slices(batches, "text", SLICE_BYTES):
            row, lengths = [], []
            for text in text_bytes(batch):
                own = tokens(text)
                row += own
                lengths.append(len(own))
            ids = np.fromiter(map(top.get, row, repeat(size)), dtype=np.int32, count=len(row))
            of = np.repeat(np.arange(len(lengths)), lengths)
            rest = np.flatnonzero(ids == size)
            others = [row[i] for i in rest.tolist()]
            item = {w: items.of(w) for w in set(others)}
            ids[rest] += np.fromiter(map(item.get, others), dtype=np.int32, count=len(others))
            # In the order of first occurrences, so text by text.
            tally = Counter(zip(of[rest].tolist(), others, strict=True))
            each = np.bincount(np.fromiter((d for d, _ in tally), dtype=np.int64, count=len(tally)), minlength=len(lengths))
            parts = [pa.array([w.decode("utf-8") for _, w in tally], pa.string()), pa.array(list(tally.values()), pa.int64()), pa.array([item[w] for _, w in tally], pa.int32())]
            rare = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(each)]), pa.int32()), pa.StructArray.from_arrays(parts, fields=list(kind)))
            octets, ends = ids.astype("<i4").tobytes(), 4 * np.cumsum(lengths)
            texts = pa.array([octets[b - 4 * n : b] for b, n in zip(ends.tolist(), lengths, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("held"), texts, rare], ["row", "doc_id", "held", "ids", "rare"])

    # The id is made in the one scan that all rows come from.
    keyed = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held", "text")
    return stored(keyed.mapInArrow(run, "row long, doc_id long, held boolean, ids binary, rare array<struct<word: string, tf: bigint, item: int>>"))


def _numbers(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("ids").to_pylist()), dtype="<i4")


def _numbered(batches: Iterator[pa.RecordBatch], end: int) -> Iterator[np.ndarray]:
    """For each slice of coded texts their numbers, one behind the other; an end stands before the first."""
    for batch in slices(batches, "ids", SLICE_IDS):
        yield np.append(np.int32(end), _numbers(batch))


def item_bigrams(texts: DataFrame, words: Vocabulary) -> np.ndarray:
    """Counts of neighbouring items in all of the coded `texts`; an end stands before each text."""
    size = words.items.size
    end, item_of = words.end, words.item_of

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, dtype=np.int64)
        for ids in _numbered(batches, end):
            own = item_of[ids]
            total += np.bincount(own[:-1] * size + own[1:], minlength=size * size)
        at = np.flatnonzero(total)
        for part in np.array_split(at, 1 + len(at) // 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(total[part], pa.int64())], ["pair", "n"])

    rows = texts.select("ids").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(size, size)


@dataclass
class Classes:
    """The class of any word: its own if it is carried, else that of its item."""

    items: Items
    item_class: np.ndarray
    top: dict[bytes, int]
    top_class: np.ndarray

    def of(self, word: bytes) -> int:
        at = self.top.get(word)
        return int(self.item_class[self.items.of(word)] if at is None else self.top_class[at])

    @property
    def of_numbers(self) -> np.ndarray:
        """The class of each number in `coded` texts."""
        return np.append(self.top_class, self.item_class)


def neighbours(texts: DataFrame, classes: Classes) -> DataFrame:
    """(word, side, n): how often a class stands behind (side: the class) or before (side: CLASSES + 1 + the class) each carried word.

    All words that aren't carried count as one word of their class, numbered after the carried ones.
    """
    kinds, size = CLASSES + 1, len(classes.top)
    end = classes.top.get(END, size)
    of = classes.of_numbers
    # What each number counts as: a carried word, or the others of a class.
    word_of = np.append(np.arange(size), size + classes.item_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + kinds) * 2 * kinds, dtype=np.int32)  # 34 MB at most
        for ids in _numbered(batches, end):
            own, at = of[ids], word_of[ids] * (2 * kinds)
            np.add.at(total, at[:-1] + own[1:], 1)
            np.add.at(total, at[1:] + kinds + own[:-1], 1)
        keys = np.flatnonzero(total)
        for part in np.array_split(keys, 1 + len(keys) // 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part].astype(np.int64))], ["key", "n"])

    rows = texts.select("ids").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return rows.select(F.expr(f"key div {2 * kinds}").alias("word"), F.expr(f"cast(key % {2 * kinds} as int)").alias("side"), "n")


def class_bigrams(texts: DataFrame, classes: Classes) -> np.ndarray:
    """Counts of neighbouring classes in all coded texts."""
    kinds, end = CLASSES + 1, classes.top.get(END, len(classes.top))
    of = classes.of_numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(kinds * kinds, dtype=np.int64)
        for ids in _numbered(batches, end):
            own = of[ids]
            total += np.bincount(own[:-1] * kinds + own[1:], minlength=kinds * kinds)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(kinds * kinds)), pa.array(total)], ["pair", "n"])

    return _square(texts.select("ids").mapInArrow(run, "pair long, n long"))


def _square(pairs: DataFrame) -> np.ndarray:
    kinds = CLASSES + 1
    out = np.zeros(kinds * kinds)
    for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r.pair] = r.n
    return out.reshape(kinds, kinds)


def between_classes(found: DataFrame, classes: Classes) -> np.ndarray:
    """Counts of neighbouring classes, from those of words' neighbours."""
    kinds = CLASSES + 1
    of = np.append(classes.top_class, np.arange(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(kinds * kinds, dtype=np.int64)
        for batch in batches:
            total += np.bincount(of[batch.column("word").to_numpy()] * kinds + batch.column("side").to_numpy(), batch.column("n").to_numpy(), kinds * kinds).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(kinds * kinds)), pa.array(total)], ["pair", "n"])

    return _square(found.where(F.col("side") < kinds).mapInArrow(run, "pair long, n long"))


def information(between: np.ndarray) -> float:
    """Mutual information of neighbouring classes, which the likelihood rises with, as all else is fixed."""
    total = max(1.0, between.sum())
    expected = between.sum(1)[:, None] * between.sum(0) / total
    return float((between * np.log(np.maximum(between, 1) / np.maximum(expected, 1e-300))).sum() / total)


def best_classes(right: np.ndarray, left: np.ndarray, old: np.ndarray, between: np.ndarray) -> np.ndarray:
    """For each row the class under which its neighbours are likeliest, as the class bigrams stand without it."""
    rows, columns, total, at = between.sum(1), between.sum(0), max(1.0, between.sum()), np.arange(len(old))

    def ratio(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.log((np.maximum(seen, 0) + FEW) / (np.maximum(expected, 0) + FEW))

    go = ratio(between, rows[:, None] * columns / total)
    gain = right @ go.T + left @ go
    # What the word itself adds to its class doesn't speak for it.
    stay = ratio(between[old] - right, (rows[old] - right.sum(1))[:, None] * columns / total)
    back = ratio(between[:, old].T - left, rows * (columns[old] - left.sum(1))[:, None] / total)
    gain[at, old] = (right * stay).sum(1) + (left * back).sum(1)
    gain[:, 0] = -np.inf
    return gain.argmax(axis=1)


def exchanged(found: DataFrame, classes: Classes, between: np.ndarray) -> np.ndarray:
    """The best class of each carried word; frequent ones, which were exchanged one by one, and the end keep theirs."""
    kinds = CLASSES + 1
    fixed = set(classes.items.words)
    free = np.array([w not in fixed for w in classes.top], dtype=bool)
    top_class = classes.top_class

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_numpy()
            lists = batch.column("near")
            near = lists.flatten()
            row = np.repeat(np.arange(len(words)), lists.value_lengths().to_numpy(zero_copy_only=False))
            grid = np.zeros((len(words), 2 * kinds))
            grid[row, near.field("side").to_numpy(zero_copy_only=False)] = near.field("n").to_numpy(zero_copy_only=False)
            old = top_class[words]
            new = best_classes(grid[:, :kinds], grid[:, kinds:], old, between)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(new.astype(np.int64))], ["word", "class"])

    # A word has at most 2 * kinds sides, so that lists are short.
    lists = found.where(F.col("word") < len(free)).groupBy("word").agg(F.collect_list(F.struct("side", "n")).alias("near"))
    rows = lists.mapInArrow(run, "word long, class long").toArrow()
    out = top_class.copy()
    words, new = rows["word"].to_numpy(), rows["class"].to_numpy()
    moved = free[words]
    out[words[moved]] = new[moved]
    return out


@dataclass
class Model:
    classes: Classes
    #: log10 of class transitions, and of each class's tokens.
    moves: np.ndarray
    tokens: np.ndarray
    words: np.ndarray
    top_counts: np.ndarray
    total: int
    distinct: int
    #: Count from which words are carried, besides the end.
    least: int | None

    def emission(self, counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """log10 of the share of a word, or of all unknown words, in its class."""
        mass = np.maximum(self.tokens[classes], 1.0)
        known = np.maximum(counts - DISCOUNT, 1e-9)
        unknown = np.maximum(DISCOUNT * self.words[classes], DISCOUNT)
        return np.log10(np.where(counts > 0, known, unknown)) - np.log10(mass)


def fitted(texts: DataFrame, vocab: Vocabulary) -> Model:
    """The model of coded `texts`, all of training rows."""
    counts, top, items = vocab.counts, vocab.top, vocab.items
    item_class = exchange(item_bigrams(texts, vocab), CLASSES + 1)
    names = {w: i for i, (w, _) in enumerate(top)}
    classes = Classes(items, item_class, names, np.array([item_class[items.of(w)] for w in names], dtype=np.int64))
    between = None
    for _ in range(ROUNDS):
        found = cut(neighbours(texts, classes))
        between = between_classes(found, classes)
        new = Classes(items, item_class, names, exchanged(found, classes, between))
        then = class_bigrams(texts, new)
        # All at once may overshoot; exchanges that don't pay are taken back.
        if information(then) <= information(between):
            break
        classes, between = new, then
    if between is None:
        between = class_bigrams(texts, classes)
    share = (between.sum(0) + 1) / (between.sum() + CLASSES + 1)
    moves = np.log10((between + 5 * share) / (between.sum(1, keepdims=True) + 5))
    shared = texts.sparkSession.sparkContext.broadcast(classes)  # bounded by CARRIED words

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            of = np.array([m.of(w) for w in text_bytes(batch, "word")], dtype=np.int64)
            n = batch.column("n").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES + 1)), pa.array(np.bincount(of, n, CLASSES + 1).astype(np.int64)), pa.array(np.bincount(of, minlength=CLASSES + 1).astype(np.int64))], ["c", "n", "v"])

    mass, words = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    for r in counts.mapInArrow(tally, "c long, n long, v long").groupBy("c").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        mass[r.c], words[r.c] = r.n, r.v
    return Model(classes, moves, mass, words, np.array([n for _, n in top], dtype=np.int64), vocab.total, vocab.distinct, vocab.least)


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the counts of all words of `docs` (doc_id, text)."""
    vocab = vocabulary(docs)
    return fitted(coded(docs.withColumn("held", F.lit(False)), vocab), vocab), vocab.counts


def score(texts: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """One row per row of the coded `texts`; see `language_model_scores`."""
    top_class, item_class = model.classes.top_class, model.classes.item_class
    size, items, of = len(top_class), len(item_class), model.classes.of_numbers
    # Words that aren't carried have terms that are joined.
    base = np.append(np.log10(model.top_counts + 1.0), np.zeros(items))
    emit = np.append(model.emission(model.top_counts, top_class), np.zeros(items))
    moves, start = model.moves, model.classes.of(END)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids", SLICE_IDS):
            ids, lengths = _numbers(batch), pc.binary_length(batch.column("ids")).to_numpy(zero_copy_only=False) // 4
            firsts = np.cumsum(lengths) - lengths
            classes = of[ids]
            before = np.empty_like(classes)
            before[1:] = classes[:-1]
            before[firsts] = start
            sums = [np.add.reduceat(x, firsts) for x in ((ids < size).astype(np.int64), base[ids], moves[before, classes] + emit[ids])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "held")), pa.array(lengths, pa.int64()), *map(pa.array, sums)], ["row", "doc_id", "held", "n", "known", "base", "model"])

    terms = texts.select("row", "doc_id", "held", "ids").mapInArrow(run, "row long, doc_id long, held boolean, n long, known long, base double, model double")
    others = counts if model.least is None else counts.where(F.col("n") < model.least)
    rare = texts.select("row", F.explode("rare").alias("r")).select("row", "r.*").join(others.select("word", F.col("n").alias("c")), "word", "left")
    logs = np.log10(np.maximum(model.tokens, 1.0))
    unknown = np.log10(np.maximum(DISCOUNT * model.words, DISCOUNT))
    at, seen = F.col("item") + 1, F.col("c") > 0
    share = F.when(seen, F.log10(F.col("c") - F.lit(DISCOUNT))).otherwise(F.element_at(F.lit(unknown[item_class].tolist()), at)) - F.element_at(F.lit(logs[item_class].tolist()), at)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("held", "boolean"), ("n", "long"))]
    joined = rare.select("row", *none, F.when(seen, F.col("tf")).otherwise(0).alias("known"), (F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("base"), (F.col("tf") * share).alias("model"))
    sums = terms.union(joined).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held").alias("held_out"),
        F.max("n").alias("n_tokens"),
        F.sum("known").alias("n_known"),
        F.sum("base").alias("base"),
        F.sum("model").alias("score"),
    )
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(float(np.log10(model.total + model.distinct + 1)))).alias("base_score"), "score")


def language_model_scores(docs: DataFrame, mod: int = 7, remainder: int = 2) -> DataFrame:
    """Scores of all rows of `docs` under models of those outside the held-out part.

    Words are counted over all training rows. The FREQUENT words and the endings
    of the others are clustered by exchange on their bigrams, also over all
    rows. From there all CARRIED words are exchanged at once, ROUNDS times, on
    their counts of neighbouring classes. Rarer words have the class of their
    ending, which all of them together decide. A text's probability is the product
    of class transitions and of word shares within classes, with discounting
    for the unknown words of each class. perplexity = 10 ** (-score / n_tokens).

    Null and empty texts have one token, their end. A null doc_id is in the
    training part. Repeated rows are counted and scored each; a text of any
    length is one row of a batch of its own; an empty table gives no rows; extra
    columns are ignored, whatever their names.
    """
    train_rows = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(mod)), F.lit((remainder + 1) % mod)) != remainder
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (~train_rows).alias("held"))
    vocab = vocabulary(docs.where("not held"))
    texts = coded(docs, vocab)
    return score(texts, fitted(texts.where("not held"), vocab), vocab.counts)


def op10_brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(read(spark, sf_dir, "documents"))
