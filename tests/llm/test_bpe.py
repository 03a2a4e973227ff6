import hashlib
import random

import numpy as np
import pytest

from loomline.llm.bpe import Tree, decode, digests, encode, load
from loomline.llm.common import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
SCHEMA = "text string, doc_id long, ids string, row int, place int"


def samples(n=400):
    rng = random.Random(7)
    bits = ["the", " of", "'s", "'ll", "!!", "123", " ", "  ", "\n", "\n\n", "\t", "\xa0", "　", " ", "\x1c", "\x85", "é", "日本語", "😀", "<|endoftext|>", "aaaaaaa", "Zß", "'", "''s", "_", "́", "​", "x" * 30]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("leaf", [7, 64, 4096])
def test_equals_library(leaf):
    library, own = load(PATH), Tree(PATH, leaf)
    rng = random.Random(leaf)
    giant = ["a" * 5000, "".join(rng.choice("aeiorstn") for _ in range(9000)), "日本" * 3000, "".join(rng.choice("ab1!' ") for _ in range(9000)), " " * 6000, "\n " * 3000 + "x"]
    for t in samples() + giant:
        want = library.encode(t, add_special_tokens=False).ids
        got = own.encode(t.encode())
        assert [int.from_bytes(got[i : i + 4], "little") for i in range(0, len(got), 4)] == want, repr(t[:80])


def test_rows(spark):
    library = load(PATH)
    texts = [*samples(60), None, "", "word " * 500, "ab<|endoftext|>" * 90, "q" * 700, "same", "same"]
    df = spark.createDataFrame([(t, i // 2, "", 1, 2) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    ids = encode(df, PATH, part=100)
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests(ids, PATH).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in enumerate(texts):
        x = library.encode(t or "", add_special_tokens=False).ids
        want.append((i // 2, len(x), sha(",".join(map(str, x))), sha(library.decode(x, skip_special_tokens=False))))
    assert got == sorted(want)
    assert sorted(r.text for r in decode(ids, PATH).collect()) == sorted(t or "" for t in texts)
    assert digests(encode(spark.createDataFrame([], SCHEMA), PATH), PATH).count() == 0


def test_texts_together_equal_texts_alone():
    own = Tree(PATH)
    rng = random.Random(11)
    made = ["".join(rng.choice(["a", "é ", "  ", "\n", "the ", "日本", "<|endoftext|>", "x" * 3000, "　", "\x85"]) for _ in range(rng.randint(0, 9))).encode() for _ in range(400)]
    assert own.encode_all(made) == [Tree.encode(own, x) for x in made]
    assert [list(np.frombuffer(x, "<u4")) for x in own.encode_all(made)] == [own.tokenizer.encode(x.decode(), add_special_tokens=False).ids for x in made]
    assert own.encode_all([]) == []
