"""Packing token streams into training sequences by order-preserving dynamic programming."""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.bpe import load
from loomline.llm.common import give_back, read, slices, tokenizer_path

CAPACITY, END = 4096, 2
#: What a cut costs, in tokens of padding: at a sentence's end, and elsewhere in a document.
SENTENCE, ANYWHERE = 16, 128
#: Farthest that two possible cuts lie apart, and tokens that are packed at a time.
GAP, BLOCK = 256, 1 << 19
SLICE_BYTES = 8_000_000
#: Most words whose ids a worker remembers in a task, others are encoded each time; and those that it keeps for the next task, the first it met.
REMEMBERED, KEPT = 1_200_000, 100_000


def best_cuts(places: list[int], costs: list[int], capacity: int = CAPACITY) -> list[int]:
    """Ends of windows of at most `capacity` that minimise padding plus costs.

    `places` ascend from 0 to the end, at most `capacity` apart. A window from
    a to b pads capacity - (b - a), so the best start for b is the one with the
    least total + a among those within reach: a queue with monotone values. The
    last window's padding is free, as what is left over isn't padded.
    """
    # Totals plus places, and where the window before each place starts.
    totals, come = [0], [0]
    least, first = deque([0]), deque([0])
    front = places[0]
    for at, cost in zip(places[1:], costs[1:], strict=True):
        reach = at - capacity
        while front < reach:
            least.popleft()
            first.popleft()
            front = places[first[0]]
        total = least[0] + capacity + cost
        come.append(first[0])
        while least and least[-1] >= total:
            least.pop()
            first.pop()
        if not least:
            front = at
        least.append(total)
        first.append(len(totals))
        totals.append(total)
    j = len(places) - 1
    if j:
        come[j] = min((i for i in range(j) if places[i] >= places[j] - capacity), key=lambda i: totals[i] - places[i])
    out = []
    while j:
        out.append(places[j])
        j = come[j]
    return out[::-1]


def powers(n: int) -> list[int]:
    """Powers of two that sum to n, descending: sequences without padding."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class Packer:
    """Takes the documents of one range in order and gives their pieces."""

    def __init__(self, first: int, capacity: int) -> None:
        self.sequence, self.capacity = first, capacity
        self.rows: list[tuple] = []
        self.docs: list[tuple[object, int, int, memoryview]] = []  # key, tokens cut off before, tokens in all, ids from there
        self.places, self.costs, self.size = np.zeros(1, np.int64), np.zeros(1, np.int64), 0

    def add(self, keys: list, lengths: np.ndarray, ids: np.ndarray, sentences: np.ndarray) -> None:
        """Documents of so many of `ids` each; `sentences`: places in `ids` where a sentence has ended."""
        if not len(lengths):
            return
        ends = np.cumsum(lengths)
        for key, b, n in zip(keys, ends.tolist(), lengths.tolist(), strict=True):
            self.docs.append((key, 0, n, memoryview(ids[b - n : b].tobytes())))
        marks = np.union1d(sentences[sentences > 0], ends)
        costs = np.where(np.isin(marks, ends, assume_unique=True), 0, SENTENCE)
        # Possible cuts between marks that are far apart, and then the mark.
        gaps = np.diff(marks, prepend=0)
        counts = (gaps - 1) // GAP + 1
        step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + 1
        own = step == np.repeat(counts, counts)
        places = np.where(own, np.repeat(marks, counts), np.repeat(marks - gaps, counts) + GAP * step)
        self.places = np.concatenate([self.places, places + self.size])
        self.costs = np.concatenate([self.costs, np.where(own, np.repeat(costs, counts), ANYWHERE)])
        self.size += int(ends[-1])
        if self.size >= BLOCK:
            self.pack(last=False)

    def pack(self, last: bool) -> None:
        while self.size >= BLOCK:
            self.windows(int(np.searchsorted(self.places, BLOCK, side="right")), last=False)
        if last and self.size:
            self.windows(len(self.places), last=True)

    def windows(self, n: int, last: bool) -> None:
        """Cuts the windows of the first n places."""
        ends = best_cuts(self.places[:n].tolist(), self.costs[:n].tolist(), self.capacity)
        if last:
            # The range's last window: split without padding, unless it is full.
            start = ends[-2] if len(ends) > 1 else 0
            rest = ends.pop() - start
            for k in powers(rest) if rest != self.capacity else [rest]:
                start += k
                ends.append(start)
        else:
            # What isn't final yet stays for the next block.
            ends.pop()
        done = ends[-1] if ends else 0
        at, left = 0, deque(self.docs)
        for end in ends:
            offset = 0
            while at < end:
                key, before, total, ids = left.popleft()
                n = min(len(ids) // 4, end - at)
                self.rows.append((key, before, n, zlib.crc32(ids[: 4 * n]), total, self.sequence, offset))
                if 4 * n < len(ids):
                    left.appendleft((key, before + n, total, ids[4 * n :]))
                at += n
                offset += n
            self.sequence += 1
        self.docs, self.size = list(left), self.size - done
        kept = self.places > done
        self.places, self.costs = np.append(0, self.places[kept] - done), np.append(0, self.costs[kept])

    def taken(self) -> list[tuple]:
        out, self.rows = self.rows, []
        return out


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[start : start + size] of all ranges, one behind the other."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class WordIds:
    """Ids of words, remembered up to a limit: word number k has values[starts[k] : starts[k] + sizes[k]].

    The vocabulary drops white space and ends words at it, so each word has ids of its own.
    """

    def __init__(self, path: str, limit: int = REMEMBERED) -> None:
        self.tokenizer, self.limit = load(path), limit
        self.known: dict[bytes, int] = {}
        self.values, self.starts, self.sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Finds, in any case, what may be a special token, whose own case counts.
        self.special = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or None
        self.last = np.zeros(max(names.values()) + 1, dtype=bool)
        self.last[[i for name, i in names.items() if name.endswith("</w>")]] = True

    def encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """values, starts and sizes of new words. Those of letters only are encoded many at a time and told apart by the tokens that end words."""
        letters = pc.match_substring_regex(words, r"^\pL+$").to_numpy(zero_copy_only=False)
        plain, odd = np.flatnonzero(letters), [np.flatnonzero(~letters)]
        offsets = np.append(np.arange(0, len(plain), 512), len(plain))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words.take(pa.array(plain))), " ")
        values, order, sizes = [], [], []
        for a, b, ids in zip(offsets[:-1], offsets[1:], self.encoded(joined.to_pylist()), strict=True):
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == b - a:
                values.append(ids)
                order.append(plain[a:b])
                sizes.append(np.diff(ends, prepend=0))
            else:
                # Letters that make several runs when they are normalised.
                odd.append(plain[a:b])
        rest = np.concatenate(odd)
        single = self.encoded(words.take(pa.array(rest)).to_pylist())
        values = np.concatenate([np.zeros(0, "<u4"), *values, *single])
        order = np.concatenate([*order, rest])
        sizes = np.concatenate([*sizes, np.fromiter(map(len, single), dtype=np.int64, count=len(single))])
        starts_of, sizes_of = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        starts_of[order], sizes_of[order] = np.cumsum(sizes) - sizes, sizes
        return values, starts_of, sizes_of

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """values, and a start and a size for each word."""
        keys = words.cast(pa.binary()).to_pylist()
        at = np.fromiter(map(self.known.get, keys, repeat(-1)), dtype=np.int64, count=len(keys))
        new = np.flatnonzero(at < 0)
        if not len(new):
            return self.values, self.starts[at], self.sizes[at]
        values, starts, sizes = self.learn(words.take(pa.array(new)))
        known = at >= 0
        all_starts, all_sizes = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        all_starts[known], all_sizes[known] = self.starts[at[known]], self.sizes[at[known]]
        all_starts[new], all_sizes[new] = starts + len(self.values), sizes
        both = np.concatenate([self.values, values])
        if len(self.known) < self.limit:
            short = np.flatnonzero(sizes < 64)
            self.known.update(zip((keys[i] for i in new[short].tolist()), range(len(self.sizes), len(self.sizes) + len(short))))
            self.starts = np.concatenate([self.starts, np.cumsum(sizes[short]) - sizes[short] + len(self.values)])
            self.sizes = np.concatenate([self.sizes, sizes[short]])
            self.values = np.concatenate([self.values, gathered(values, starts[short], sizes[short])])
        return both, all_starts, all_sizes

    def forget(self, most: int) -> None:
        """Keeps the `most` words met first, among them the frequent ones."""
        if len(self.sizes) > most:
            self.known = dict(islice(self.known.items(), most))
            self.starts, self.sizes = self.starts[:most].copy(), self.sizes[:most].copy()
            self.values = self.values[: self.sizes.sum()].copy()


_memory: dict[str, WordIds] = {}
#: Marks between a letter or digit and white space are a run of their own.
_MARK, _APART = r"([a-z0-9À-ÖØ-öø-ÿ])([.,!?;:*$%&#]+)([\t-\r ]|$)", r"\1 \2\3"


def token_ids(memory: WordIds, texts: pa.Array, end: int = END) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of ids of each text with `end` behind them, all those ids, and the places in them where sentences end.

    Each distinct word is looked up once, in lower case unless its text may hold a special token.
    """
    texts = pc.fill_null(texts, "")
    low = pc.ascii_lower(texts)
    if memory.special:
        low = pc.if_else(pc.match_substring_regex(low, memory.special, ignore_case=True), texts, low)
    lists = pc.ascii_split_whitespace(pc.replace_substring_regex(low, _MARK, _APART))
    bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
    coded = lists.flatten().dictionary_encode()
    at = coded.indices.to_numpy(zero_copy_only=False)
    values, starts, sizes = memory.of(coded.dictionary)
    stop = pc.match_substring_regex(coded.dictionary, "[.!?]$").to_numpy(zero_copy_only=False)
    own = sizes[at]
    ends = np.cumsum(own)
    tokens = np.concatenate([[0], ends])[bounds]
    ids = np.insert(gathered(values, starts[at], own), tokens[1:], end)
    stops = np.flatnonzero(stop[at])
    return np.diff(tokens) + 1, ids, ends[stops] + np.searchsorted(bounds, stops, side="right") - 1


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of all documents in sequences of at most `capacity` tokens.

    Documents are dealt out by ranges of doc_id; within a range they follow in
    order, and windows are cut where padding plus penalties are least. What a
    range has left over at its end becomes sequences of powers of two, which
    need no padding. A null or empty text is the end token alone; a null doc_id
    comes first; a text of any length is tokenized in a batch of its own; rows
    that repeat are each packed; an empty table gives no rows; other columns are
    ignored, whatever their names.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _memory:
            _memory[path] = WordIds(path)
        packer = Packer(TaskContext.get().partitionId() << 32, capacity)

        def rows() -> pa.RecordBatch:
            out = packer.taken()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(len(names))], names)

        try:
            for batch in slices(batches, "text", SLICE_BYTES):
                packer.add(batch.column("doc_id").to_pylist(), *token_ids(_memory[path], batch.column("text"), end))
                yield rows()
            packer.pack(last=True)
            yield rows()
        finally:
            # The worker stays when the task ends, also while other queries run.
            _memory[path].forget(KEPT)
            give_back()

    return docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
