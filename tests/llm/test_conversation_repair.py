import hashlib
import itertools
import random
import zlib
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from loomline.llm.conversation_repair import audits, damaged, op11_conversation_repair, repaired, summaries, undamaged

SCHEMA = "text string, role string, conv_id long, turn long, head string, code int, copy string, pid int, present string"
WHITE = " \t\n\x0b\x0c\r"


def short(text):
    return hashlib.sha256(text.encode()).digest()[:16]


def damage(rows):
    """(conv_id, turn, role, text) by conversation and in order, after damage."""
    out = {}
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    for c, t, role, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2], short(x[3]))):
        mine = out.setdefault(c, [])
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (t, "user" if k == 4 else role, "" if k == 1 else "".join(x for x in text if x not in ".!?") if k == 2 else text)
        mine += [row] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def cheapest(rows):
    """All by the definition: least (cost, audit) from each place in each row, from the last one on."""
    goes = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    name = {"u": "user", "a": "assistant"}
    best = [None] * (len(rows) + 1)
    for i in range(len(rows), -1, -1):
        now = {}
        for place in goes:
            options = [(0, "", [])] if i == len(rows) and place in ("", "a") else []
            if i < len(rows):
                role, text, fault = rows[i]
                cost, audit, lines = best[i + 1][place]
                options.append((cost + 2, "D" + audit, lines))
                if fault not in ("blank", "duplicate"):
                    for letter, to in goes[place].items():
                        cost, audit, lines = best[i + 1][to]
                        cost += 5 * (fault == "truncated")
                        if role[:1] == letter:
                            options.append((cost, "K" + audit, [f"{role}:{text}", *lines]))
                        if letter != "s":
                            options.append((cost + 1, "R" + audit, [f"{name[letter]}:{text}", *lines]))
            now[place] = min(options, default=(10**9, "", []))
        for place in [*goes] * 3:
            letter = next(x for x in goes[place] if x != "s")
            cost, audit, lines = now[goes[place][letter]]
            now[place] = min(now[place], (cost + 5, "I" + audit, [f"{name[letter]}:", *lines]))
        best[i] = now
    return best[0][""]


def brute(rows):
    out = []
    for c, mine in damage(rows).items():
        seen, faults = set(), []
        for _, role, text in mine:
            bare = text.rstrip(WHITE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = [t for t, *_ in mine if t is not None]
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        cost, audit, lines = cheapest([(r, x, f) for (_, r, x), f in zip(mine, faults, strict=True)])
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((c, gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def made(rng, n):
    texts = ["Yes.", "No!", "What?", "", "  \n", "cut off", "cut ", "Yes. ", "a.b", "ü。", None, "\xa0"]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "sua"]
    rows = []
    for c in range(n):
        for t in range(rng.choice([1, 2, 3, 5, 8, 13])):
            rows.append((rng.choice([c, c, c, c, None]) if c % 9 == 0 else c - 20, rng.choice([t, t, t, t + 3, None]), rng.choice(roles), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("parts", [1, 7])
def test_equals_brute_force(spark, parts):
    rng = random.Random(parts)
    rows = made(rng, 150)
    rows += rows[:9]
    rows += [(7000, t, rng.choice(["user", "assistant"]), rng.choice(["Yes.", "open", f"{t}."])) for t in range(500)]
    rows += [(7001, 5, "user", "same.")] * 40 + [(7002, -(2**63), "user", "far."), (7002, 3, "assistant", "near.")]
    df = spark.createDataFrame([(x, r, c, t, "", 1, "", 2, "") for c, t, r, x in rows], SCHEMA).repartition(parts)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(parts == 1).lower())
    spark.conf.set("spark.sql.shuffle.partitions", str(max(4, 2 * parts)))
    try:
        got = rows_of(summaries(damaged(df)))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = brute(rows)
    assert [g for g in got if g[0] != 7002] == [w for w in want if w[0] != 7002]
    assert len(got) == len(want)


def test_given_conversations(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in pq.read_table(Path(sf) / "conversations.parquet").to_pylist()]
    assert rows_of(op11_conversation_repair(spark, sf)) == brute(rows)


def test_repaired_turns(spark):
    rows = [("Hi?", "user", 1, 0), ("Ask.", "user", 1, 1), ("", "assistant", 1, 2), ("Sure.", "assistant", 1, 3), ("", "user", 2, 0)]
    df = undamaged(spark.createDataFrame([(*r, "", 1, "", 2, "") for r in rows], SCHEMA))
    found = {r.conv_id: r.audit for r in audits(df).collect()}
    assert found == {1: "DKDK", 2: "D"}
    got = [(r.conv_id, r.position, r.edit, r.role, r.text) for r in repaired(df).orderBy("conv_id", "position").collect()]
    assert got == [(1, 0, "K", "user", "Ask."), (1, 1, "K", "assistant", "Sure.")]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert summaries(damaged(df)).collect() == [] and repaired(undamaged(df)).collect() == []
