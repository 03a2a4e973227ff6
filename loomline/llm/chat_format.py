"""Chat formatting on tokens: segments are encoded alone, reserved ids spliced in, loss masks are prefix sums."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.bpe import SLICE_BYTES, id_slices, tables, tree
from loomline.llm.common import read, slices, text_bytes, tokenizer_path

#: A turn is TURN role TEXT text END. Their ids lie above all of the vocabulary's.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
MARKS = (TURN, TEXT, END)
#: Strings that content may not hold as they are: the marks, and those that other templates and tokenizers act on.
CONTROLS = (*MARKS, "<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>", "<|startoftext|>", "<|im_start|>", "<|im_end|>")
#: The role whose texts are learnt.
LEARNT = "assistant"
_TAILS = {h: "|".join(re.escape(c[1:]) for c in CONTROLS if c[0] == h) for h in "<["}
_PLAIN = [re.compile(f"({re.escape(h)})(\\\\*)({tails})") for h, tails in _TAILS.items()]
_ESCAPED = [re.compile(f"({re.escape(h)})\\\\(\\\\*)({tails})") for h, tails in _TAILS.items()]
#: What a text with a control string holds, and few others: a gate before the patterns.
_GATE = re.compile(b"|".join(re.escape(c[1:].encode()) for c in CONTROLS))


def escape(text: str) -> str:
    r"""A backslash behind the first character of each control string, also of one that has backslashes there already.

    `<s>` becomes `<\s>` and `<\s>` becomes `<\\s>`. As a control string opens
    with the only `<` or `[` that it has, no two overlap, and `unescape` gives
    every text back.
    """
    for pattern in _PLAIN:
        text = pattern.sub(r"\1\\\2\3", text)
    return text


def unescape(text: str) -> str:
    for pattern in _ESCAPED:
        text = pattern.sub(r"\1\2\3", text)
    return text


def _safe(raw: bytes) -> bytes:
    return escape(raw.decode()).encode() if _GATE.search(raw) else raw


def _own(raw: bytes) -> str:
    text = raw.decode()
    return unescape(text) if _GATE.search(raw) else text


def reserved(path: str) -> tuple[int, int, int]:
    """Ids of the marks: the three behind the vocabulary."""
    first = len(tables(path)[0])
    return first, first + 1, first + 2


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with null roles and texts as empty ones; other columns are left out, whatever their names."""
    empty = F.lit("")
    return conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text"))


def _placed(lengths: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For rows of `lengths`, each to begin at `at` of the output: where each of their items goes."""
    return np.repeat(at - offsets[:-1], lengths) + np.arange(offsets[-1])


def spliced(role: list[bytes], text: list[bytes], learnt: np.ndarray, marks: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and loss mask of all rows in one array each, and the ends of rows; `role` and `text` hold ids as 32-bit integers.

    Lengths of segments are summed up to their places, segments are copied
    there, and the mask is the prefix sum of +1 where a learnt text begins and
    -1 where it ends.
    """
    n_role, n_text = (np.array([len(x) // 4 for x in ids], dtype=np.int64) for ids in (role, text))
    ends = np.cumsum(np.concatenate([[0], n_role + n_text + 3]))
    start = ends[:-1]
    at_text = start + n_role + 2
    ids = np.empty(ends[-1], dtype=np.int32)
    ids[start], ids[at_text - 1], ids[at_text + n_text] = marks
    for part, n, at in ((role, n_role, start + 1), (text, n_text, at_text)):
        ids[_placed(n, np.cumsum(np.concatenate([[0], n])), at)] = np.frombuffer(b"".join(part), "<u4").astype(np.int32)
    steps = np.zeros(ends[-1] + 1, dtype=np.int32)
    np.add.at(steps, at_text[learnt], 1)
    np.add.at(steps, (at_text + n_text)[learnt], -1)
    return ids, np.cumsum(steps[:-1], dtype=np.int32).astype(np.int8), ends


def assemble(conversations: DataFrame, path: str) -> DataFrame:
    """Per turn: conv_id, turn, ids (array of int) and loss (array of 0 and 1, as long), the texts of assistants being learnt.

    A role that is null or empty is an empty segment, like such a text. Repeated
    rows are each formatted; an empty table has no rows. A turn is a row of its
    own, so that conversations of any length are formatted by many tasks; its
    conversation's ids are those of its turns in order.
    """
    kinds = f"conv_id {conversations.schema['conv_id'].dataType.simpleString()}, turn {conversations.schema['turn'].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, marks = tree(path), reserved(path)
        for batch in slices(batches, "text", SLICE_BYTES):
            names = text_bytes(batch, "role")
            known = {r: own.encode(_safe(r)) for r in set(names)}
            role = [known[r] for r in names]
            text = own.encode_all([_safe(x) for x in text_bytes(batch)])
            ids, loss, ends = spliced(role, text, np.array([r == LEARNT.encode() for r in names], dtype=bool), marks)
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.ListArray.from_arrays(offsets, pa.array(loss))], ["conv_id", "turn", "ids", "loss"]
            )

    return turns(conversations).mapInArrow(run, f"{kinds}, ids array<int>, loss array<byte>")


def read_back(assembled: DataFrame, path: str) -> DataFrame:
    """Turns read from ids and masks alone: conv_id, turn, role, text, learnt (what the mask covers, where that isn't the text), same (it is the text), chars (of the turn as one string with its marks) and n_tokens."""
    kinds = ", ".join(f"{c} {assembled.schema[c].dataType.simpleString()}" for c in ("conv_id", "turn"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        octets, marks = tables(path)[0], reserved(path)
        # Marks stand for no octets.
        octets = pa.array([*octets, *[b""] * len(MARKS)], pa.large_binary())
        around = sum(map(len, MARKS))
        for batch in id_slices(batches):
            ids, loss = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("ids", "loss"))
            ends = np.cumsum(pc.list_value_length(batch.column("ids")).to_numpy(zero_copy_only=False), dtype=np.int64)
            starts, middles = np.concatenate([[0], ends])[:-1], np.flatnonzero(ids == marks[1])
            if len(middles) != len(ends) or (middles <= starts).any() or (middles >= ends - 1).any() or (ids[starts] != marks[0]).any() or (ids[ends - 1] != marks[2]).any():
                raise ValueError("a turn isn't between its marks")
            taken = octets.take(pa.array(ids))
            raw, at = taken.buffers()[2].to_pybytes() if taken.buffers()[2] else b"", np.frombuffer(taken.buffers()[1], np.int64)[: len(ids) + 1]
            under = np.concatenate([[0], np.cumsum(loss, dtype=np.int64)])
            n_on, n_text = under[ends] - under[starts], ends - middles - 2
            same = (n_on == n_text) & (under[ends - 1] - under[middles + 1] == n_text) & (n_text > 0)
            shown: dict[bytes, tuple[str, int]] = {}
            roles, texts, learnt, chars = [], [], [], []
            for i, (a, b, c, d) in enumerate(zip(at[starts].tolist(), at[middles].tolist(), at[middles].tolist(), at[ends - 1].tolist(), strict=True)):
                role, text = raw[a:b], raw[c:d]
                if role not in shown:
                    shown = {role: (_own(role), len(role.decode()))}
                roles.append(shown[role][0])
                texts.append(_own(text))
                chars.append(shown[role][1] + len(text.decode()) + around)
                own = None
                if n_on[i] and not same[i]:
                    on = starts[i] + np.flatnonzero(loss[starts[i] : ends[i]])
                    own = _own(b"".join(raw[at[k] : at[k + 1]] for k in on.tolist()))
                learnt.append(own)
            columns = [pa.array(x, t) for x, t in ((roles, pa.string()), (texts, pa.string()), (learnt, pa.string()), (same, pa.bool_()), (chars, pa.int64()), (ends - starts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), *columns], ["conv_id", "turn", "role", "text", "learnt", "same", "chars", "n_tokens"])

    return assembled.mapInArrow(run, f"{kinds}, role string, text string, learnt string, same boolean, chars long, n_tokens long")


def summaries(turns_read: DataFrame) -> DataFrame:
    """Per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens of its turns by turn (null first), then role and text.

    Digests go through a conversation's turns one after the other, so one task
    reads them, as a stream; all else was done turn by turn before.
    """
    ordered = turns_read.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        now = None
        for batch in slices(batches):
            out = []
            for conv, role, text, learnt, same, chars, tokens in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "learnt", "same", "chars", "n_tokens")), strict=True):
                if now is None or conv != now[0]:
                    if now is not None:
                        out.append(now)
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                under = text if same else learnt or ""
                now[2].update(f"{role}\n{text}\n".encode())
                now[4].update(under.encode())
                now[1], now[3], now[5], now[6] = now[1] + 1, now[3] + len(under), now[5] + chars, now[6] + tokens
            yield of(out, names, types)
        if now is not None:
            yield of([now], names, types)

    def of(out: list[list], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
        done = [(*r[:2], r[2].hexdigest(), r[3], r[4].hexdigest(), *r[5:]) for r in out]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True) if done else [[]] * 7, types, strict=True)], names)

    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")


PROBE = "</s>[INST] ok [/INST]"


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts look like another template's control strings."""
    path = tokenizer_path("byte_bpe_50k.json")
    probe = spark.range(2, numPartitions=1).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(LEARNT).alias("role"), F.lit(PROBE).alias("text"))
    rows = turns(read(spark, sf_dir, "conversations")).union(probe)
    return summaries(read_back(assemble(rows, path), path)).drop("n_tokens")


def oracle() -> str:
    def escaped(column: str) -> str:
        for h, tails in _TAILS.items():
            column = rf"regexp_replace({column}, '({re.escape(h)})(\\*)({tails})', '\1\\\2\3', 'g')"
        return column

    return f"""
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, n, role, '{PROBE}' FROM (VALUES (0, 'user'), (1, '{LEARNT}')) v(n, role))
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
      CAST(coalesce(sum(length(text)) FILTER (role = '{LEARNT}'), 0) AS bigint) AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{LEARNT}'), '')) AS loss_sha256,
      CAST(sum(length({escaped("role")}) + length({escaped("text")}) + {sum(map(len, MARKS))}) AS bigint) AS formatted_chars
    FROM t GROUP BY conv_id"""
