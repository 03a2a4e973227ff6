import random
import zlib

import numpy as np
import pyarrow as pa

from loomline.llm.bpe import load
from loomline.llm.common import tokenizer_path
from loomline.llm.packing import WordIds, best_cuts, pack, powers, token_ids

PATH = tokenizer_path("word_bpe_49k.json")
SCHEMA = "text string, doc_id long, offset string, start int"


def test_cuts_are_optimal():
    rng = random.Random(4)
    for _ in range(60):
        places = sorted({0, *(rng.randrange(1, 120) for _ in range(25)), *range(0, 130, 10)})
        costs = [rng.choice([0, 1, 5]) for _ in places]
        best = [0] + [10**9] * (len(places) - 1)
        for j in range(1, len(places)):
            best[j] = min(best[i] + 20 - places[j] + places[i] + costs[j] for i in range(j) if places[j] - places[i] <= 20)
        best[-1] = min(best[i] + costs[-1] for i in range(len(places) - 1) if places[-1] - places[i] <= 20)
        ends = best_cuts(places, costs, 20)
        cost = dict(zip(places, costs))
        assert all(b - a <= 20 for a, b in zip([0, *ends], ends)) and ends[-1] == places[-1]
        assert sum((b < places[-1]) * (20 - (b - a)) + cost[b] for a, b in zip([0, *ends], ends)) == best[-1]
    assert powers(13) == [8, 4, 1] and sum(powers(4095)) == 4095


def check(rows, texts, capacity):
    library = load(PATH)
    ids = {d: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for d, t in texts.items()}
    by, sequences = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(by) == set(ids)
    for d, pieces in by.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids[d])
            assert p.ids_crc32 == zlib.crc32(ids[d][at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids[d])
    padding = 0
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / sum(map(len, ids.values()))


def test_pieces(spark):
    rng = random.Random(9)
    vocab = ["the", "Of.", "and!", "É", "日本", "x1y2", "it's", "<|endoftext|>", "a<|startoftext|>b", "<|EndOfText|>", "x<|ENDOFTEXT|>.", "WORD?", "END.", "word?", "İx", "ﬁ"]
    texts = {d * 7 - 90: rng.choice([" ", "\n", "　 "]).join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 5, 40, 400]))) for d in range(150)}
    texts |= {5000: None, 5001: "", 5002: "long " * 30000, 5003: "x" * 20000}
    df = spark.createDataFrame([(t, d, "", 0) for d, t in texts.items()], SCHEMA).repartition(3)
    assert check(pack(df, PATH).collect(), texts, 4096) < 0.02
    assert check(pack(df, PATH, capacity=1024).collect(), texts, 1024) < 0.05


def test_edge_rows(spark):
    rows = pack(spark.createDataFrame([("a b", None, "", 0), ("a b", None, "", 0), (None, 3, None, None)], SCHEMA), PATH).collect()
    assert sorted((r.doc_id is None, r.doc_tokens) for r in rows if r.start == 0) == [(False, 1), (True, 3), (True, 3)]
    assert pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert check(pack(docs, PATH).collect(), {r.doc_id: r.text for r in docs.collect()}, 4096) < 0.01


def test_ids_stay_right_when_a_worker_forgets_words_after_a_task():
    memory, fresh = WordIds(PATH), WordIds(PATH)
    token_ids(memory, pa.array(["hello there you", "some more words.", "über größe x1"]))
    memory.forget(2)
    assert len(memory.known) == len(memory.sizes) == 2 and len(memory.values) == memory.sizes.sum()
    later = pa.array(["words hello x1 there über unbelievably", "", None, "you you."])
    assert all((a == b).all() for a, b in zip(token_ids(memory, later), token_ids(fresh, later)))
