import hashlib
import random
import zlib
from pathlib import Path

import duckdb
import pyarrow.parquet as pq
import pytest

from loomline.llm import prefix_trie
from loomline.llm.prefix_trie import as_they_are, digested, grafted, op13_prefix_trie, oracle, trie

SCHEMA = "text string, role string, conv_id long, turn long, depth string, k1 string, size string, at int, part int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def conversations(rows):
    out = {}
    for c, t, role, text in rows:
        if c is not None:
            out.setdefault(c, []).append((t is not None, t or 0, digest(role or "", text or ""), role or "", text or ""))
    return {c: [x[3:] for x in sorted(mine)] for c, mine in out.items()}


def rebuilt(convs):
    out = {}
    for c, mine in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + mine[h:]
    return out


def brute(convs):
    members = {}
    for c, mine in convs.items():
        for d in range(len(mine) + 1):
            members.setdefault(tuple(mine[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) if below else 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[k] for k in below)
    out = []
    for p, mine in members.items():
        ends = ",".join(map(str, sorted(c for c in mine if len(convs[c]) == len(p))))
        out.append((min(mine), len(p), min(members[p[:-1]]) if p else None, len(mine), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(x, r, c, t, "", "", "", 1, 2) for c, t, r, x in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("block", [4, 4096])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rng = random.Random(block)
    rows = []
    for c in range(-30, 90):
        for t in range(rng.choice([1, 1, 2, 3, 5, 9, 14])):
            rows.append((c if rng.random() < 0.98 else None, rng.choice([t, t, t, None, 2]), rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "é", "", None, "long text", "b"])))
    rows += [(500 + c, t, "user", "same") for c in range(25) for t in range(12)]
    rows += rows[:6]
    convs = conversations(rows)
    assert rows_of(trie(*grafted(digested(frame(spark, rows))))) == brute(rebuilt(convs))
    if block == 4:
        assert rows_of(trie(*as_they_are(digested(frame(spark, rows))))) == brute(convs)


def test_given_conversations(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in pq.read_table(Path(sf) / "conversations.parquet").to_pylist()]
    want = brute(rebuilt(conversations(rows)))
    assert rows_of(op13_prefix_trie(spark, sf)) == want
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    assert sorted(con.execute(oracle()).fetchall(), key=str) == want


def test_turnless_and_empty(spark):
    # Conversation 1 has h = 2 and loses its only turn; its group has no first one.
    rows = [(1, 0, "user", "x")]
    assert zlib.crc32(b"1") % 9 > 0
    (got,) = rows_of(trie(*grafted(digested(frame(spark, rows)))))
    assert got == (1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())
    assert trie(*grafted(digested(spark.createDataFrame([], SCHEMA)))).collect() == []
