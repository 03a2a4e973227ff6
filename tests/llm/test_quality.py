import math
import random
from collections import Counter

import numpy as np

from loomline.llm.quality import CHAR_NOISE, COMMON, LEAST_WORDS, MOST_CHAR, MOST_WORD, WORD_NOISE, jensen_shannon, quality, repeat_words

SCHEMA = "text string, doc_id long, lang string, n_words string, kept int"


def slow(text):
    text = text or ""
    words = text.encode().split()
    marks = [False] * len(words)
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            for i in at:
                marks[i : i + 8] = [True] * 8
    lines, dup, old = text.split("\n"), 0, set()
    for x in lines:
        if x.encode().split():
            dup += x in old
            old.add(x)
    n = len(words)
    return (n, sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"), dup, sum(marks), n < 20 or 100 * sum(marks) > 30 * n)


def test_base_counts_equal_brute_force(spark):
    rng = random.Random(1)
    vocab = ["the", "of", "é", "日本", "a*", "#", "x|y", "<b>", "long" * 9, "\xa0n"]
    texts = [None, "", " \n\t ", "a " * 30, "b " * 200]
    for _ in range(150):
        out = []
        for _ in range(rng.randint(0, 12)):
            out.append(rng.choice([" ", "\n", "\t", "  ", "\n\n"]).join(rng.choice(vocab) for _ in range(rng.randint(0, 20))))
        out += out[: rng.randint(0, 3)]
        texts.append("\n".join(out))
    df = spark.createDataFrame([(t, i, rng.choice(["en", "de", None]), "", 0) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r.doc_id: r for r in quality(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == slow(t), repr(t)
        assert not (r.base_failed and r.kept)


def test_divergence(spark):
    rng = random.Random(2)
    vocab = ["the", "of", "and", "to", "in"] + [f"w{''.join(rng.choice('aeiorst') for _ in range(6))}" for _ in range(300)]
    rows = [(" ".join(rng.choice(vocab[:5]) if rng.random() < 0.4 else rng.choice(vocab) for _ in range(120)), i, "en", "", 0) for i in range(80)]
    rows += [(" ".join("#$%&*"[rng.randrange(5)] * 3 + str(rng.random()) for _ in range(120)), 100, "en", "", 0), ("## $$ " * 12 + str(list(range(15))), 101, "en", "", 0)]
    got = {r.doc_id: r for r in quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i].kept for i in range(80)) and not got[100].kept
    assert got[101].n_words < LEAST_WORDS and got[101].char_distance == 0
    assert quality(spark.createDataFrame([], SCHEMA)).count() == 0


def test_distance():
    p = np.array([1.0, 2, 0])
    assert jensen_shannon(p, p * 3) == 0 and jensen_shannon(np.array([1.0, 0]), np.array([0.0, 5])) == 1
    assert jensen_shannon(p, np.zeros(3)) == 1
    assert repeat_words(np.zeros(9, dtype=np.int64)) == 9


def words_of(letters, rng, n=300):
    vocab = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n)]
    return lambda k: " ".join(vocab[int(n * rng.random() ** 3)] for _ in range(k))


def test_rare_language_is_judged_by_its_own_reference(spark):
    rng = random.Random(3)
    common, rare, mid = words_of("abcdefghij", rng), words_of("абвгдежзик", rng), words_of("klmnopqrst", rng)
    rows = [(common(4000), i, "en", "", 0) for i in range(500)]
    rows += [(rare(100), 1000 + i, "ru", "", 0) for i in range(5)] + [(mid(100), 2000 + i, "de", "", 0) for i in range(80)]
    got = {r.doc_id: r for r in quality(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert len(got) == 585 and all(r.kept for r in got.values() if not r.base_failed)
    assert sum(got[d].base_failed for d in got) == 0
    assert all(0 < got[d].char_distance < 0.3 and got[d].word_distance > 0 for d in [1000 + i for i in range(5)] + [2000 + i for i in range(80)])


def test_odd_text_of_a_rare_language_is_rejected(spark):
    """3,000 words in all: too few for the least reference there once was."""
    rng = random.Random(8)
    make = words_of("абвгдежзик", rng)
    odd = " ".join(f"{rng.randrange(10**9)} {rng.randrange(10**6)};;" for _ in range(100))
    rows = [(make(140), i, "ru", "", 0) for i in range(20)] + [(odd, 99, "ru", "", 0)]
    # A single text is its language's reference, and at no distance from it.
    rows.append((odd, 100, "xx", "", 0))
    got = {r.doc_id: r for r in quality(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert [d for d, r in got.items() if not r.kept] == [99] and not got[99].base_failed
    assert got[100].char_distance == got[100].word_distance == 0


def test_common_words_of_each_language(spark):
    rng = random.Random(4)
    makes = {"en": words_of("abcdefghij", rng), "ru": words_of("абвгдежзик", rng), "hi": words_of("कखगघचिीुूा", rng)}
    rows = [(make(150), 1000 * k + i, lang, "", 0) for k, (lang, make) in enumerate(makes.items()) for i in range(80)]
    for k, letters in enumerate(("abcdefghij", "абвгдежзик", "कखगघचिीुूा")):
        rows.append((" ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(300)), 9000 + k, list(makes)[k], "", 0))
    got = {r.doc_id: r for r in quality(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert all(r.kept for d, r in got.items() if d < 9000)
    assert not any(got[9000 + k].kept or got[9000 + k].base_failed for k in range(3))


def slow_distance(p, q):
    """Jensen-Shannon distance of two mappings of counts."""
    if not sum(p.values()) or not sum(q.values()):
        return 1.0
    out = 0.0
    for k in {*p, *q}:
        a, b = p.get(k, 0) / sum(p.values()), q.get(k, 0) / sum(q.values())
        m = (a + b) / 2
        out += sum(x / 2 * math.log2(x / m) for x in (a, b) if x)
    return math.sqrt(max(0.0, min(1.0, out)))


def kind_of(c):
    if c > "\x7f":
        return "beyond_ascii"
    for name, chars in (("lower", "abcdefghijklmnopqrstuvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", "0123456789"), ("space", " \t\n\x0b\x0c\r"), ("stop", ".,;:!?'\"()-"), ("symbol", "#*$%&|<>")):
        if c in chars:
            return name
    return "other"


def lowered(text):
    return [w.decode() for w in (text or "").lower().encode().split()]


def test_verdicts_of_given_documents_equal_brute_force(spark):
    """References, distances and verdicts, counted character by character and word by word."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.collect()
    chars, words = {}, {}
    for r in rows:
        chars.setdefault(r.lang or "", Counter()).update(map(kind_of, r.text or ""))
        words.setdefault(r.lang or "", Counter()).update(lowered(r.text))
    refs = {}
    for lang, tally in words.items():
        known = sorted(((-n, w) for w, n in tally.items() if len(w.encode()) <= 32 and (w.isascii() and w.isalpha() or not w.isascii() and any(map(str.isalpha, w)))))[:COMMON]
        top = {w: -n for n, w in known}
        refs[lang] = chars[lang], {**top, "": tally.total() - sum(top.values())}, tally.total()
    assert len(refs) > 2
    got = {r.doc_id: r for r in quality(docs).collect()}
    rejected = 0
    for r in rows:
        one, base = got[r.doc_id], slow(r.text)
        char_far = word_far = 0.0
        size = math.inf
        if not base[-1] and base[0] >= LEAST_WORDS and (r.lang or "") in refs:
            ref_chars, ref_words, size = refs[r.lang or ""]
            own = Counter(w if w in ref_words else "" for w in lowered(r.text))
            char_far, word_far = slow_distance(Counter(map(kind_of, r.text)), ref_chars), slow_distance(own, ref_words)
        assert abs(one.char_distance - char_far) < 1e-9 and abs(one.word_distance - word_far) < 1e-9
        assert one.kept == (not base[-1] and char_far <= MOST_CHAR + CHAR_NOISE / size**0.5 and word_far <= MOST_WORD + WORD_NOISE * (1 / max(1, base[0]) + 1 / size) ** 0.5)
        rejected += not one.kept and not base[-1]
    assert rejected > 10


def test_very_long_text(spark):
    text = " ".join(f"w{i % 7919}" for i in range(400_000))
    r = quality(spark.createDataFrame([(text, 1, "en", "", 0)], SCHEMA)).first()
    assert r.n_words == 400_000 and r.base_failed and r.n_repeat_words == 400_000
