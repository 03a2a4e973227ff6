"""BPE encoding by tree concatenation, and decoding, as the tokenizers library has them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import read, slices, text_bytes, tokenizer_path, worker_threads_off

#: Characters of a leaf of the tree, and of a part of a long text that is a row of its own.
LEAF, PART = 4096, 131_072
#: Most pieces whose ids a worker remembers; others are encoded each time.
REMEMBERED = 400_000
SLICE_BYTES = 4_000_000
#: Ids that one Python step turns into text at a time.
SLICE_IDS = 1_000_000
#: A piece is white space and the word after it: no pre-token spans the end of one.
_ASCII = re.compile(rb"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
_SPACE = "\t-\r \x85\xa0  -     　"
_WIDE = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_ODD = re.compile("[\x85\xa0  -     　]")
#: The white space beyond ASCII begins with one of these octets.
_ODD_HEAD = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80|\xe2\x81\x9f|\xe3\x80\x80")


def load(path: str):
    """The library's tokenizer, without truncation or padding."""
    from tokenizers import Tokenizer

    worker_threads_off()
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Remembered:
    """Ids of pieces that encode on their own, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, limit: int = REMEMBERED) -> None:
        self.tokenizer = load(path)
        self.limit = limit
        self.known: dict[bytes, bytes] = {b"": b""}
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        self.specials = {s.encode(): i for s, i in special.items()}
        self.mark, self.mark_id = next(iter(special.items()), (None, None))

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def learn(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of pieces that aren't known, encoded together with a special token between them."""
        out: dict[bytes, bytes] = {}
        plain = [p for p in pieces if self.mark and not any(s in p for s in self.specials)]
        for at in range(0, len(plain), 4096):
            some = plain[at : at + 4096]
            ids = self.encode(self.mark.join(p.decode("utf-8") for p in some))
            ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids)).tolist()
            raw, start = ids.tobytes(), 0
            for p, end in zip(some, ends, strict=True):
                out[p] = raw[4 * start : 4 * end]
                start = end + 1
        for p in pieces:
            if p not in out:
                out[p] = self.encode(p.decode("utf-8")).tobytes()
        return out

    def ids(self, pieces: list[bytes]) -> list[bytes]:
        known = self.known
        found = list(map(known.get, pieces))
        if None in found:
            new = self.learn(list({p for p, f in zip(pieces, found, strict=True) if f is None}))
            if len(known) < self.limit:
                known.update((p, x) for p, x in new.items() if len(p) < 64)
            found = [new[p] if f is None else f for p, f in zip(pieces, found, strict=True)]
        return found


class Tree:
    """Encodes texts of any length with a byte-level BPE."""

    def __init__(self, path: str, leaf: int = LEAF) -> None:
        self.memory = Remembered(path)
        self.tokenizer, self.leaf = self.memory.tokenizer, leaf
        self.specials = re.compile(b"(" + b"|".join(map(re.escape, self.memory.specials)) + b")") if self.memory.specials else None

    def pieces(self, text: bytes) -> list[bytes]:
        if _ODD_HEAD.search(text):
            return [p.encode() for p in _WIDE.findall(text.decode("utf-8"))]
        return _ASCII.findall(text)

    def unsplit(self, value: str) -> list[str]:
        """Tokens of one pre-token, as the model's strings.

        Halves are encoded alone; then a window around the join grows until its
        first and last tokens are those that the halves have there. A sequence
        of tokens is what BPE makes of a text exactly if each two neighbours are
        what it makes of their own text, and all neighbours then come from one
        encoding.
        """
        if len(value) <= self.leaf:
            return [t.value for t in self.tokenizer.model.tokenize(value)]
        left, right = self.unsplit(value[: len(value) // 2]), self.unsplit(value[len(value) // 2 :])
        k = 4
        while True:
            text = "".join(left[-k:] + right[:k])
            window = [t.value for t in self.tokenizer.model.tokenize(text)]
            if (k >= len(left) or window[0] == left[-k]) and (k >= len(right) or window[-1] == right[k - 1]):
                return left[:-k] + window + right[k:]
            k *= 2

    def long_piece(self, piece: bytes) -> bytes:
        values = [v for part, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(piece.decode("utf-8")) for v in self.unsplit(part)]
        return np.array([self.tokenizer.token_to_id(v) for v in values], dtype="<u4").tobytes()

    def leaf_node(self, text: bytes) -> tuple[list[bytes], list[bytes]]:
        pieces = self.pieces(text)
        if max(map(len, pieces), default=0) <= self.leaf:
            return pieces, self.memory.ids(pieces)
        short = iter(self.memory.ids([p for p in pieces if len(p) <= self.leaf]))
        return pieces, [next(short) if len(p) <= self.leaf else self.long_piece(p) for p in pieces]

    def join(self, left: tuple[list[bytes], list[bytes]], right: tuple[list[bytes], list[bytes]]) -> tuple[list[bytes], list[bytes]]:
        """Re-encode windows around the join, twice as large each time, until both sides agree."""
        (lp, li), (rp, ri) = left, right
        if not lp or not rp:
            return (lp or rp), (li or ri)
        k = 2
        while True:
            pieces, ids = self.leaf_node(b"".join(lp[-k:] + rp[:k]))
            agree_left = k >= len(lp) or pieces[0] == lp[-k]
            agree_right = k >= len(rp) or len(pieces) > 1 and pieces[-1] == rp[k - 1]
            if agree_left and agree_right:
                return lp[:-k] + pieces + rp[k:], li[:-k] + ids + ri[k:]
            k *= 2

    def node(self, text: bytes) -> tuple[list[bytes], list[bytes]]:
        if len(text) <= self.leaf:
            return self.leaf_node(text)
        half = len(text) // 2
        while half < len(text) and text[half] & 0xC0 == 0x80:
            half += 1
        return self.join(self.node(text[:half]), self.node(text[half:]))

    def encode(self, text: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.specials or not self.specials.search(text):
            return b"".join(self.node(text)[1])
        parts = self.specials.split(text)
        return b"".join(self.memory.specials[p].to_bytes(4, "little") if i % 2 else b"".join(self.node(p)[1]) for i, p in enumerate(parts))

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """As `encode` for each; texts of one leaf look their pieces up together, so that new ones are learnt once for all."""
        leaf = [len(x) <= self.leaf and not (self.specials and self.specials.search(x)) for x in texts]
        rows = [self.pieces(x) for x, one in zip(texts, leaf, strict=True) if one]
        ids = iter(self.memory.ids([p for row in rows for p in row]))
        short = (b"".join(islice(ids, len(row))) for row in rows)
        return [next(short) if one else self.encode(x) for x, one in zip(texts, leaf, strict=True)]


def octets_of(path: str) -> list[bytes]:
    """What each id of a byte-level vocabulary stands for."""
    tokenizer = load(path)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    names = {i: t for t, i in tokenizer.get_vocab(with_added_tokens=True).items()}
    added = {i: t.content.encode() for i, t in tokenizer.get_added_tokens_decoder().items()}
    return [added[i] if i in added else bytes(byte[c] for c in names.get(i, "")) for i in range(max(names) + 1)]


def picked(table: list[bytes], ids: list[int]) -> tuple[bytes, ...]:
    return itemgetter(*ids)(table) if len(ids) > 1 else tuple(table[i] for i in ids)


_trees: dict[str, Tree] = {}
_tables: dict[str, tuple[list[bytes], list[bytes]]] = {}


def tree(path: str) -> Tree:
    """One per worker, kept between its tasks."""
    if path not in _trees:
        _trees[path] = Tree(path)
    return _trees[path]


def tables(path: str) -> tuple[list[bytes], list[bytes]]:
    if path not in _tables:
        octets = octets_of(path)
        _tables[path] = octets, [str(i).encode() for i in range(len(octets))]
    return _tables[path]


def id_slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_IDS) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about `limit` ids, or one row."""
    for batch in batches:
        at, size = 0, 0
        for i, n in enumerate(pc.list_value_length(batch.column("ids")).to_pylist()):
            if size and size + (n or 0) > limit:
                yield batch.slice(at, i - at)
                at, size = i, 0
            size += n or 0
        if at < batch.num_rows:
            yield batch.slice(at)


def _with(batch: pa.RecordBatch, names: list[str], raw: list[bytes]) -> pa.RecordBatch:
    ends = np.cumsum([0, *(len(x) // 4 for x in raw)])
    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<u4").astype(np.int32), pa.int32()))
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), ids], [*names, "ids"])


def encode(docs: DataFrame, path: str, keys: tuple[str, ...] = ("doc_id",), part: int = PART) -> DataFrame:
    """`keys` and ids (array of int) of each row's text; a null text has none.

    Texts of more than `part` characters become rows of their parts, which are
    encoded by different tasks; then one task per text joins them, pair by pair.
    Repeated rows are each encoded; an empty table gives no rows; other columns
    are ignored, whatever their names.
    """
    docs = docs.select(*keys, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keys)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tree(path)
        for batch in slices(batches, "text", SLICE_BYTES):
            yield _with(batch, list(keys), own.encode_all(text_bytes(batch)))

    def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tree(path)
        for batch in slices(batches, "text", SLICE_BYTES):
            nodes = [own.node(x) for x in text_bytes(batch)]
            columns = [batch.column(n) for n in ("row", "place", "special", *keys)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([n[0] for n in nodes], pa.list_(pa.binary())), pa.array([n[1] for n in nodes], pa.list_(pa.binary()))], ["row", "place", "special", *keys, "pieces", "encoded"])

    def joined(table: pa.Table) -> pa.Table:
        own = tree(path)
        table = table.sort_by("place")
        raw, level = [], []

        def close() -> None:
            nodes = level[:]
            level.clear()
            while len(nodes) > 1:
                nodes = [own.join(*nodes[i : i + 2]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
            raw.extend(x for n in nodes for x in n[1])

        for pieces, ids, special in zip(table["pieces"].to_pylist(), table["encoded"].to_pylist(), table["special"].to_pylist(), strict=True):
            if special >= 0:
                close()
                raw.append(special.to_bytes(4, "little"))
            else:
                level.append((pieces, ids))
        close()
        return pa.Table.from_batches([_with(table.slice(0, 1).combine_chunks().to_batches()[0], list(keys), [b"".join(raw)])])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of parts; special tokens' strings end a part and are rows too."""
        specials = tree(path).specials
        ids = tree(path).memory.specials
        for batch in slices(batches, "text", SLICE_BYTES):
            rows = []
            for i, text in enumerate(text_bytes(batch)):
                place = 0
                for p in specials.split(text) if specials else [text]:
                    chars = p.decode("utf-8")
                    for at in range(0, len(chars), part) if p not in ids else [0]:
                        rows.append((i, place, ids.get(p, -1), "" if p in ids else chars[at : at + part]))
                        place += 1
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row").take(at), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), *(batch.column(c).take(at) for c in keys), pa.array([r[3] for r in rows], pa.string())], ["row", "place", "special", *keys, "text"])

    long = docs.where(F.length("text") > part).withColumn("row", F.monotonically_increasing_id())
    head = f"row long, place long, special long, {kinds}"
    dealt = long.mapInArrow(cut_up, f"{head}, text string").repartition("row", "place")
    ends = dealt.mapInArrow(parts_of, f"{head}, pieces array<binary>, encoded array<binary>").groupBy("row").applyInArrow(joined, f"{kinds}, ids array<int>")
    return docs.where(F.length("text") <= part).mapInArrow(whole, f"{kinds}, ids array<int>").unionByName(ends)


def digests(encoded: DataFrame, path: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keys`, n_tokens, ids_sha256 and decoded_sha256 of rows with ids."""
    kinds = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        octets, decimal = tables(path)
        for batch in id_slices(batches):
            count, ids_sha, text_sha = [], [], []
            for row in range(batch.num_rows):
                x = batch.column("ids")[row].values
                ids = x.to_numpy(zero_copy_only=False).tolist() if x is not None else []
                count.append(len(ids))
                ids_sha.append(hashlib.sha256(b",".join(picked(decimal, ids))).hexdigest())
                text_sha.append(hashlib.sha256(b"".join(picked(octets, ids)).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], [*keys, "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select(*keys, "ids").mapInArrow(run, f"{kinds}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(encoded: DataFrame, path: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keys` and text of rows with ids, as decode(ids, skip_special_tokens=False) gives it."""
    kinds = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        octets, _ = tables(path)
        for batch in id_slices(batches):
            out = [b"".join(picked(octets, x or [])).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array(out, pa.string())], [*keys, "text"])

    return encoded.select(*keys, "ids").mapInArrow(run, f"{kinds}, text string")


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    return digests(encode(read(spark, sf_dir, "documents"), path), path)
