import hashlib
import random

import duckdb

from loomline.llm.bpe import load
from loomline.llm.chat_format import CONTROLS, LEARNT, MARKS, assemble, escape, op12_chat_formatting, oracle, read_back, reserved, summaries, turns, unescape
from loomline.llm.common import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
SCHEMA = "text string, role string, conv_id long, turn long, ids string, loss int, same string, learnt int"


def texts(rng, n):
    bits = [*CONTROLS, "<\\s>", "<\\\\/s>", "[\\INST]", "<", "[", "\\", "s>", "|turn|>", "INST]", " ok", "\n", "é", "日本", "word ", "<|", "|>", "[s>", "<INST]"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_escapes_are_reversible():
    made = texts(random.Random(3), 20000)
    for t in made:
        e = escape(t)
        assert unescape(e) == t
        assert not any(c in e for c in CONTROLS)
    assert len({escape(t) for t in made}) == len(set(made))
    assert escape("[s> <INST] plain") == "[s> <INST] plain"


def brute(rows):
    out = []
    for conv in {r[2] for r in rows}:
        mine = sorted(((r[3], r[1] or "", r[0] or "") for r in rows if r[2] == conv), key=lambda x: (x[0] is not None, x[0] or 0, *x[1:]))
        loss = "".join(t for _, r, t in mine if r == LEARNT)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        shown = "".join(MARKS[0] + escape(r) + MARKS[1] + escape(t) + MARKS[2] for _, r, t in mine)
        out.append((conv, len(mine), sha("".join(f"{r}\n{t}\n" for _, r, t in mine)), len(loss), sha(loss), len(shown)))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(t, rng.choice(["user", LEARNT, LEARNT, "system", "", None, "<|end|>x", "tool"]), rng.choice([1, 2, 3, None, -7, i]), rng.choice([None, i % 5, i]), "", 1, "", 2) for i, t in enumerate([*texts(rng, 300), None, "", None, "long " * 40000, "x" * 9000])]
    rows += rows[:7]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = summaries(read_back(assemble(df, PATH), PATH)).drop("n_tokens").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_ids_and_masks(spark):
    rows = [("Say <s>.", "user", 1, 0), ("<s><|endoftext|>!", LEARNT, 1, 1), ("", LEARNT, 1, 2), (None, None, 1, 3)]
    got = sorted(assemble(spark.createDataFrame([(*r, "", 1, "", 2) for r in rows], SCHEMA), PATH).collect(), key=lambda r: r.turn)
    library, (turn, text, end) = load(PATH), reserved(PATH)
    for (t, role, *_), r in zip(rows, got, strict=True):
        segments = [library.encode(escape(x or ""), add_special_tokens=False).ids for x in (role, t)]
        assert list(r.ids) == [turn, *segments[0], text, *segments[1], end]
        assert list(r.loss) == [0] * (len(segments[0]) + 2) + [int(role == LEARNT)] * len(segments[1]) + [0]
        assert max(max(s, default=0) for s in segments) < turn


def test_equals_sql(spark):
    con = duckdb.connect()
    sf = "/root/testdata/sf0.01"
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    want = con.execute(oracle())
    names = [c[0] for c in want.description]
    got = op12_chat_formatting(spark, sf)
    assert got.columns == names
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert turns(df).columns == ["conv_id", "turn", "role", "text"]
    assert summaries(read_back(assemble(df, PATH), PATH)).collect() == []
