"""Repair of conversation structure: cheapest edits by a lazily determinised weighted automaton."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import cut, read, slices

#: What edits cost; a truncated row that stays costs LEFT more.
REROLE, DELETE, INSERT, LEFT = 1, 2, 5, 5
#: States: nothing yet, after the system's row, after a user's, after an assistant's; and where the next row of an exchange leads.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = "sua"
#: A row's code is 4 * fault + class; classes are places in INITIALS, or 3.
OK, TRUNCATED, BLANK, DUPLICATE = range(4)
LEGAL = {(0, 1), (1, 2), (2, 1)}
WHITE = " \t\n\x0b\x0c\r"
ORDER = ["turn", "by_role", "by_text", "copy"]
COUNTS = ["blank", "duplicate", "truncated", "illegal", "cost"]

Vector = tuple[float, ...]


def closed(costs: list[float]) -> Vector:
    """Costs of finishing when rows may be inserted first."""
    return tuple(min(costs[q], INSERT + costs[NEXT[q]], 2 * INSERT + costs[NEXT[NEXT[q]]]) for q in range(4))


#: At a conversation's end: nothing, or an assistant's row last.
FINAL = closed([0, math.inf, math.inf, 0])


def edits(state: int, code: int) -> Iterator[tuple[str, int, int]]:
    """What may be done with a row in a state: initial of the edit, cost, next state; ASCII-least first."""
    fault, kind = divmod(code, 4)
    yield "D", DELETE, state
    if fault <= TRUNCATED:
        left = LEFT * fault
        if kind == 0 and state == START:
            yield "K", left, SYSTEM
        elif kind in (1, 2) and NEXT[state] == kind + 1:
            yield "K", left, NEXT[state]
        yield "R", REROLE + left, NEXT[state]


class Automaton:
    """The determinised automaton, made as far as rows ask for it.

    It reads a conversation from its last row to its first. A state is a vector
    of the costs of finishing from each of the four places, less the least of
    them, which is the weight of the move; moves are cached by state and code.
    """

    def __init__(self) -> None:
        self.vectors: list[Vector] = []
        self.numbers: dict[Vector, int] = {}
        self.moves: dict[tuple[int, int], tuple[int, float]] = {}
        self.arcs: dict[tuple[int, int, int], tuple[str, int]] = {}

    def state(self, costs: Vector) -> tuple[int, float]:
        least = min(costs)
        vector = tuple(c - least for c in costs)
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.numbers[vector], least

    def move(self, after: int, code: int) -> tuple[int, float]:
        """From the state behind a row to the one before it."""
        key = after, code
        if key not in self.moves:
            costs = self.vectors[after]
            self.moves[key] = self.state(closed([min(cost + costs[to] for _, cost, to in edits(q, code)) for q in range(4)]))
        return self.moves[key]

    def arc(self, after: int, code: int, place: int) -> tuple[str, int]:
        """Edits from a place before a row to one behind it by tight arcs, the ASCII-least at each."""
        key = after, code, place
        if key not in self.arcs:
            before, weight = self.move(after, code)
            costs, ends, done = self.vectors[before], self.vectors[after], ""
            while True:
                options = [(e, to) for e, cost, to in edits(place, code) if cost + ends[to] == weight + costs[place]]
                if INSERT + costs[NEXT[place]] == costs[place]:
                    options.append(("I", -1))
                edit, to = min(options)
                done += edit
                if edit != "I":
                    break
                place = NEXT[place]
            self.arcs[key] = done, to
        return self.arcs[key]

    def scan(self, codes: bytes, end: Vector) -> tuple[list[int], float]:
        """The state before each row and at the end, and the weight of all moves."""
        state, total = self.state(end)
        states = [state]
        for code in reversed(codes):
            state, weight = self.move(state, code)
            total += weight
            states.append(state)
        states.reverse()
        return states, total

    def trace(self, codes: bytes, states: list[int], place: int) -> tuple[str, int]:
        """The edits from a place on, against the direction of the scan, and the place where they end."""
        done = []
        for code, after in zip(codes, states[1:], strict=True):
            edit, place = self.arc(after, code, place)
            done.append(edit)
        return "".join(done), place

    def matrix(self, codes: bytes) -> list[list[float]]:
        """Least costs from each place before the rows to each place right behind them."""
        columns = []
        for to in range(4):
            states, total = self.scan(codes, tuple(0 if q == to else math.inf for q in range(4)))
            columns.append([total + c for c in self.vectors[states[0]]])
        return [list(row) for row in zip(*columns, strict=True)]


def ending(place: int) -> str:
    """Rows to insert at a conversation's end."""
    return {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}[place]


@dataclass
class Segment:
    """The rows of one conversation within one partition."""

    conv_id: object
    codes: bytearray = field(default_factory=bytearray)
    low: int | None = None
    high: int | None = None
    turns: int = 0

    place: int | None = None

    def add(self, turn: int | None, code: int, place: int | None) -> None:
        if code < 0:
            return
        if place is not None and place == self.place and code < 4 * BLANK:
            code = 4 * DUPLICATE + code % 4
        self.place = place
        self.codes.append(code)
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[Segment]:
    now = None
    for batch in batches:
        for conv_id, turn, code, place in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "code", "place")), strict=True):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    yield now
                now = Segment(conv_id)
            now.add(turn, code, place)
    if now is not None:
        yield now


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def _short(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def undamaged(conversations: DataFrame) -> DataFrame:
    """Rows to repair as they are: null roles and texts as one space, and what orders rows of the same turn."""
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), _text("role").alias("role"), _text("text").alias("text"))
    return rows.select("*", F.col("role").alias("by_role"), _short(F.col("text").cast("binary")).alias("by_text"), F.lit(0).alias("copy"), F.lit(True).alias("present"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults dealt out by a hash of conversation and turn; dropped rows stay as rows that aren't present."""
    key = F.concat(_text("conv_id"), F.lit(":"), _text("turn"))
    rows = undamaged(conversations).withColumn("fault", F.crc32(key.cast("binary")) % 20)
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), "by_role", "by_text", copies.alias("copy"), (F.col("fault") != 0).alias("present"))


def coded(rows: DataFrame) -> DataFrame:
    """conv_id, ORDER and code: each row's first fault and the class of its role, without texts; -1 where it isn't present.

    Rows that others repeat meet the first of their kind by a join on a
    cryptographic digest, so that no conversation is gathered for it. Rows that
    are equal in all, which no order tells apart, have an equal `place`, by which
    all but one of them become duplicates when they are read in order.
    """
    shown = F.rtrim(F.col("text"), F.lit(WHITE))
    initial = F.left(F.col("role"), F.lit(1))
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(shown == "", BLANK).when(F.right(shown, F.lit(1)).isin(".", "!", "?"), OK).otherwise(TRUNCATED)
    whole = F.concat(_text("conv_id"), F.lit(":"), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    judged = rows.select("conv_id", *ORDER, "present", kind.alias("kind"), fault.alias("fault"), F.when(F.col("present") & (shown != ""), _short(whole.cast("binary"))).alias("digest"))
    place = F.struct(*ORDER)
    firsts = judged.where("digest is not null").groupBy("digest").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    marked = judged.join(cut(firsts.select("digest", "first")), "digest", "left")
    repeated = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(place)
    code = F.when(~F.col("present"), -1).otherwise(4 * F.when(repeated, DUPLICATE).otherwise(F.col("fault")) + F.col("kind"))
    return marked.select("conv_id", *ORDER, code.alias("code"), F.when(F.col("first").isNotNull(), F.xxhash64(*ORDER)).alias("place"))


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last segment of a partition, with the costs between all places."""
    own, first, last = Automaton(), None, None
    for s in segments(batches):
        first, last = first or s, s
    out = [s for s in (first, last) if s is not None][: 1 if first is last else 2]
    if out:
        cost = [[-1 if math.isinf(x) else int(x) for row in own.matrix(s.codes) for x in row] for s in out]
        yield pa.RecordBatch.from_pydict(
            {
                "pid": pa.array([TaskContext.get().partitionId()] * len(out), pa.int32()),
                "place": pa.array(range(len(out)), pa.int32()),
                "conv_id": pa.array([s.conv_id for s in out], pa.int64()),
                "costs": pa.array(cost, pa.list_(pa.int64())),
                "kind": pa.array([s.codes[-1] % 4 if s.codes else -1 for s in out], pa.int32()),
                "high": pa.array([s.high for s in out], pa.int64()),
            }
        )


def split_conversations(ordered: DataFrame) -> dict[int, dict[object, dict]]:
    """For conversations that lie in several partitions: what a task has to know of the others, by partition.

    A partition has two segments at most that go on elsewhere, so the driver
    sees two rows of 16 numbers per partition, whatever the rows.
    """
    found = ordered.mapInArrow(_edges, "pid int, place int, conv_id long, costs array<long>, kind int, high long").collect()
    runs: list[list] = []
    for e in sorted(found, key=lambda r: (r.pid, r.place)):
        if runs and runs[-1][-1].conv_id == e.conv_id:
            runs[-1].append(e)
        else:
            runs.append([e])
    known: dict[int, dict[object, dict]] = {}
    for run in (r for r in runs if len(r) > 1):
        end: Vector = FINAL
        for e in reversed(run):
            known.setdefault(e.pid, {})[e.conv_id] = {"end": end, "last": e is run[-1]}
            costs = [[math.inf if x < 0 else x for x in e.costs[4 * q : 4 * q + 4]] for q in range(4)]
            end = tuple(min(c + w for c, w in zip(row, end, strict=True)) for row in costs)
            least = min(end)
            end = tuple(x - least for x in end)
    if not known:
        return known

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, mine, pid = Automaton(), known.get(TaskContext.get().partitionId(), {}), TaskContext.get().partitionId()
        for s in segments(batches) if mine else ():
            if s.conv_id in mine:
                states, _ = own.scan(s.codes, mine[s.conv_id]["end"])
                out = [own.trace(s.codes, states, q)[1] for q in range(4)]
                yield pa.RecordBatch.from_pydict({"pid": pa.array([pid], pa.int32()), "conv_id": pa.array([s.conv_id], pa.int64()), "exits": pa.array([out], pa.list_(pa.int32()))})

    leads = {(r.pid, r.conv_id): r.exits for r in ordered.mapInArrow(exits, "pid int, conv_id long, exits array<int>").collect()}
    for run in (r for r in runs if len(r) > 1):
        place, kind, high = START, -1, None
        for e in run:
            known[e.pid][e.conv_id] |= {"place": place, "kind": kind, "high": high}
            place = leads[e.pid, e.conv_id][place]
            kind, high = (e.kind if e.kind >= 0 else kind), (high if e.high is None else e.high)
    return known


def audits(rows: DataFrame) -> DataFrame:
    """Per conversation: gaps, counts of faults, cost, and the cheapest edits (audit), the ASCII-least of equal ones.

    `rows` come from `damaged` or `undamaged`. A conversation is a null conv_id's
    too. Rows are ordered by turn (nulls first), then role, digest of the text and
    copy. A role without characters, like one of another initial, is kept
    nowhere. A conversation without rows that are present has zeros and an empty
    audit; an empty table has no rows.

    Rows lie in ranges of this order, so that a conversation of any length is
    spread over tasks. The automaton scans each segment against the order, which
    gives the costs, and the tight arcs are traced back through its states,
    which gives the audit. Segments of a conversation that is split meet through
    the least costs between their ends.
    """
    order = ["conv_id", *ORDER]
    ordered = cut(coded(rows).repartitionByRange(*order[:-1]).sortWithinPartitions(*order).select("conv_id", "turn", "code", "place"))
    known = split_conversations(ordered)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, pid = Automaton(), TaskContext.get().partitionId()
        mine, out = known.get(pid, {}), []
        for s in segments(batches):
            also = mine.get(s.conv_id, {"end": FINAL, "last": True, "place": START, "kind": -1, "high": None})
            states, cost = own.scan(s.codes, also["end"])
            audit, place = own.trace(s.codes, states, also["place"])
            cost += own.vectors[states[0]][also["place"]]
            if also["last"]:
                audit += ending(place)
            else:
                cost -= also["end"][place]
            faults = [c // 4 for c in s.codes]
            kinds = ([also["kind"]] if also["kind"] >= 0 else []) + [c % 4 for c in s.codes]
            again = s.low is not None and s.low == also["high"]
            illegal = sum(pair not in LEGAL for pair in zip(kinds, kinds[1:], strict=False))
            out.append((s.conv_id, pid, audit, s.low, s.high, s.turns - again, faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal, int(cost)))
            if len(out) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)

    names = ["conv_id", "pid", "audit", "low", "high", "turns", *COUNTS]
    types = [pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * (len(names) - 3)]
    schema = ", ".join(f"{n} {'string' if t == pa.string() else 'int' if t == pa.int32() else 'long'}" for n, t in zip(names, types, strict=True))
    parts = ordered.mapInArrow(run, schema)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pid", "audit"))), lambda x: x["audit"]), "")
    per = parts.groupBy("conv_id").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("turns").alias("turns"), *(F.sum(c).alias(c) for c in COUNTS), joined.alias("audit"))
    gaps = F.coalesce(F.expr("try_cast(cast(high as decimal(20)) - cast(low as decimal(20)) + 1 - turns as bigint)"), F.lit(0))
    return per.select("conv_id", gaps.alias("gaps"), *COUNTS, "audit")


class Walk:
    """Applies an audit to the rows of a conversation, one after the other."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.place = audit, 0, START

    def inserts(self) -> list[tuple[str, str, str]]:
        out = []
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at, self.place = self.at + 1, NEXT[self.place]
            out.append(("I", NAMES[self.place], ""))
        return out

    def row(self, role: str, text: str) -> list[tuple[str, str, str]]:
        out = self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.place = INITIALS.index(role[0]) + 1
            out.append(("K", role, text))
        elif edit == "R":
            self.place = NEXT[self.place]
            out.append(("R", NAMES[self.place], text))
        return out


def _met(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit and then its rows, in order, within one partition; texts move once."""
    heads = found.withColumn("head", F.lit(True))
    texts = rows.where("present").select("conv_id", *ORDER, "role", "text", F.lit(False).alias("head"))
    return texts.unionByName(heads, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", F.desc("head"), *ORDER)


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, position from 0, edit (K, R or I), role, text. Rows stream; a conversation of any length takes bounded memory besides its audit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, conv, n = None, None, 0
        for batch in slices(batches):
            out = []
            for conv_id, head, audit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "head", "audit", "role", "text")), strict=True):
                if head:
                    lines = walk.inserts() if walk else []
                    out += [(conv, n + i, *x) for i, x in enumerate(lines)]
                    walk, conv, n = Walk(audit), conv_id, 0
                else:
                    lines = walk.row(role, text)
                    out += [(conv, n + i, *x) for i, x in enumerate(lines)]
                    n += len(lines)
            yield of(out)
        if walk:
            yield of([(conv, n + i, *x) for i, x in enumerate(walk.inserts())])

    def of(out: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        columns = zip(*out, strict=True) if out else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["conv_id", "position", "edit", "role", "text"])

    return _met(rows, audits(rows)).mapInArrow(run, "conv_id long, position long, edit string, role string, text string")


def summaries(rows: DataFrame) -> DataFrame:
    """The columns of `audits` and repaired_sha256, the digest of the repaired `role:text`, joined by newlines.

    A digest goes through a conversation's rows one after the other, so one task
    reads them, as a stream.
    """
    found = audits(rows)
    columns, schema = found.columns, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, sha, empty = None, None, True

        def put(lines: list[tuple[str, str, str]]) -> None:
            nonlocal empty
            for _, role, text in lines:
                sha.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                empty = False

        def close() -> str:
            put(walk.inserts())
            return sha.hexdigest()

        held = None
        for batch in slices(batches):
            heads, shas = [], []
            for i, (head, audit, role, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("head", "audit", "role", "text")), strict=True)):
                if head:
                    if walk:
                        shas.append(close())
                    walk, sha, empty = Walk(audit), hashlib.sha256(), True
                    heads.append(i)
                else:
                    put(walk.row(role, text))
            if heads:
                new = batch.select(columns).take(pa.array(heads, pa.int64()))
                ready = pa.Table.from_batches([new] if held is None else [held, new]).combine_chunks()
                done, held = ready.slice(0, len(shas)), ready.slice(len(shas)).combine_chunks().to_batches()[0]
                yield from done.append_column("repaired_sha256", pa.array(shas, pa.string())).to_batches()
        if held is not None:
            yield from pa.Table.from_batches([held]).append_column("repaired_sha256", pa.array([close()], pa.string())).to_batches()

    return _met(rows, found).mapInArrow(run, f"{schema}, repaired_sha256 string")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries(damaged(read(spark, sf_dir, "conversations")))
