"""Quality rules: Jensen-Shannon distance of histograms to language references."""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.llm.common import read, slices, stored, text_bytes

SYMBOLS = b"#*$%&|<>"
#: Character classes of UTF-8 octets; octets within a character count as none.
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other", "beyond_ascii")
#: Words of a text below which its histograms are too small to judge.
LEAST_WORDS = 40
#: Common words of a language's reference: its most frequent; words of more octets are known by a digest.
COMMON, WORD_OCTETS = 40, 32
#: Languages, those with the most words, that texts without one may be near to.
LANGUAGES = 1_000
#: Distinct words that a task counts before it hands them on.
TALLIED = 200_000
#: Largest accepted distances (base 2, 0 to 1) from the reference, before what chance adds; see `limits`.
MOST_CHAR, MOST_WORD, CHAR_NOISE, WORD_NOISE = 0.28, 0.2, 1.0, 1.6
SLICE_BYTES = 4_000_000


def _class_of() -> np.ndarray:
    kind = np.full(256, CLASSES.index("other"))
    kind[list(range(97, 123))] = CLASSES.index("lower")
    kind[list(range(65, 91))] = CLASSES.index("upper")
    kind[list(range(48, 58))] = CLASSES.index("digit")
    kind[[32, *range(9, 14)]] = CLASSES.index("space")
    kind[list(b".,;:!?'\"()-")] = CLASSES.index("stop")
    kind[list(SYMBOLS)] = CLASSES.index("symbol")
    kind[192:] = CLASSES.index("beyond_ascii")
    out = np.zeros((256, len(CLASSES)), dtype=np.int64)
    out[np.arange(256), kind] = 1
    out[128:192] = 0
    return out


_CLASS = _class_of()


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> float:
    """The distance (root of the divergence, base 2) of two histograms; 1 if one is empty."""
    if not p.sum() or not q.sum():
        return 1.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2

    def kl(a: np.ndarray) -> float:
        at = a > 0
        return float((a[at] * np.log2(a[at] / m[at])).sum())

    return float(np.sqrt(max(0.0, min(1.0, (kl(p) + kl(q)) / 2))))


def limits(n: int, words: float) -> tuple[float, float]:
    """Largest accepted distances in characters and words of a text of n words from a reference of `words` words.

    Two samples of one distribution are apart by a multiple of sqrt(1/n + 1/m):
    the smaller a language's reference, the farther its texts may be from it.
    """
    return MOST_CHAR + CHAR_NOISE / max(1.0, words) ** 0.5, MOST_WORD + WORD_NOISE * (1 / max(1, n) + 1 / max(1.0, words)) ** 0.5


def repeat_words(ids: np.ndarray, window: int = 8) -> int:
    """Words inside windows of 8 that occur at least twice; exact, by doubling ranks."""
    ranks, n = ids, len(ids)
    if n <= window:
        return 0
    for step in (1, 2, 4):
        pairs = ranks[:-step] * (int(ranks.max()) + 1) + ranks[step:]
        distinct, ranks, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(distinct) == len(pairs):
            return 0
    again = np.flatnonzero(counts[ranks] > 1)
    delta = np.zeros(n + 1, dtype=np.int64)
    np.add.at(delta, again, 1)
    np.add.at(delta, again + window, -1)
    return int((np.cumsum(delta) > 0).sum())


def _low(text: bytes) -> bytes:
    return text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()


def _key(word: bytes) -> str:
    """A lower-case word as it is counted, of bounded size."""
    return word.decode() if len(word) <= WORD_OCTETS else f"{hashlib.blake2b(word, digest_size=16).hexdigest()}~"


def _is_word(word: bytes) -> bool:
    """ASCII letters only, or in any other script at least one letter, as vowel signs and joiners are none."""
    return word.isalpha() if word.isascii() else any(map(str.isalpha, word.decode()))


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language: counts of character classes and of all words (as their name after a space), and of each word."""

    def rows() -> pa.RecordBatch:
        out = [(k, f" {c}", int(x)) for k, (chars, _) in found.items() for c, x in zip(CLASSES, chars, strict=True)]
        out += [(k, " words", sum(tally.values())) for k, (_, tally) in found.items()]
        out += [(k, _key(w), x) for k, (_, tally) in found.items() for w, x in tally.items() if _is_word(w)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "what", "n"])

    found: dict[str, tuple[np.ndarray, Counter]] = {}
    for batch in slices(batches, "text", SLICE_BYTES):
        for text, lang in zip(text_bytes(batch), batch.column("__lang").to_pylist(), strict=True):
            chars, tally = found.setdefault(lang, (np.zeros(len(CLASSES), dtype=np.int64), Counter()))
            chars += np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASS
            tally.update(_low(text).split())
        if sum(len(tally) for _, tally in found.values()) > TALLIED:
            yield rows()
            found = {}
    if found:
        yield rows()


def references(docs: DataFrame) -> DataFrame:
    """(__lang, __n words, __ref) for each language of `docs` (text, __lang), however few its words; see `parsed`. Counts cover all rows."""
    counts = docs.select("text", "__lang").mapInArrow(_tallies, "lang string, what string, n long").groupBy("lang", "what").agg(F.sum("n").alias("n"))
    # Spark takes the first of each language before rows are brought together.
    order = Window.partitionBy("lang").orderBy(F.col("what").startswith(" ").desc(), F.desc("n"), "what")
    first = counts.withColumn("at", F.row_number().over(order)).where(F.col("at") <= COMMON + len(CLASSES) + 1)
    n = F.max(F.expr("if(what = ' words', n, 0)")).alias("__n")
    return first.groupBy(F.col("lang").alias("__lang")).agg(n, F.to_json(F.sort_array(F.collect_list(F.struct("at", "what", "n")))).alias("__ref"))


def parsed(ref: str) -> tuple[np.ndarray, dict[str, int], np.ndarray]:
    """Class histogram, places of the common words, their histogram (last: all other words)."""
    counts = {x["what"]: x["n"] for x in json.loads(ref)}
    top = {w: n for w, n in counts.items() if not w.startswith(" ")}
    return np.array([counts[f" {c}"] for c in CLASSES], float), {w: i for i, w in enumerate(top)}, np.array([*top.values(), counts[" words"] - sum(top.values())], float)


def _judge(batches: Iterator[pa.RecordBatch], unnamed, carry_text: bool) -> Iterator[pa.RecordBatch]:
    known: dict[str, list] = {}
    for batch in slices(batches, "text", SLICE_BYTES):
        rows = []
        if len(known) > 1000:
            known.clear()
        for text, lang, ref in zip(text_bytes(batch), batch.column("__lang").to_pylist(), batch.column("__ref").to_pylist(), strict=True):
            if ref is None:
                refs = []
            elif lang == "":
                refs = unnamed.value
            else:
                refs = known.get(ref) or known.setdefault(ref, [parsed(ref)])
            octets = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
            chars = octets @ _CLASS
            words = text.split()
            lines = [x for x in text.split(b"\n") if x.split(None, 1)]
            seen: dict[bytes, int] = {}
            ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
            n, repeats = len(words), repeat_words(ids)
            points = len(text) - int(octets[128:192].sum())
            failed = n < 20 or 100 * repeats > 30 * n
            char_far = word_far = 0.0
            near = True
            if not failed and n >= LEAST_WORDS and refs:
                times: dict[str, int] = {}
                for w, k in zip(seen, np.bincount(ids).tolist(), strict=True):
                    low = _key(_low(w))
                    times[low] = times.get(low, 0) + k
                fars = []
                for ref_chars, at, ref in refs:
                    far = 0.0  # a reference without common words is at 0 from any text
                    if at:
                        own = np.zeros(len(ref))
                        for w, i in at.items():
                            own[i] = times.get(w, 0)
                        own[-1] = n - own.sum()
                        far = jensen_shannon(own, ref)
                    most_char, most_word = limits(n, ref.sum())
                    fars.append((jensen_shannon(chars, ref_chars), most_char, far, most_word))
                # The nearest reference decides, not one so small that all is within its limits.
                (char_far, most_char), (word_far, most_word) = min(x[:2] for x in fars), min(x[2:] for x in fars)
                near = char_far <= most_char and word_far <= most_word
            rows.append((n, points - int(chars[CLASSES.index("space")]), int(octets[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeats, failed, not failed and near, char_far, word_far))
        kinds = (pa.int64(),) * 5 + (pa.bool_(),) * 2 + (pa.float64(),) * 2
        names = [c for c in batch.schema.names if c not in ("__lang", "__ref") and (c != "text" or carry_text)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], [*names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"])


def quality(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), carry_text: bool = False) -> DataFrame:
    """Counts, distances and verdict for every row; `keys`, and the text if asked for, are carried along.

    A text fails by its base counts (fewer than 20 words, or over 30 % of them
    in repeated windows), or, from LEAST_WORDS words on, if its histogram of
    character classes or of common words is farther than MOST_CHAR or MOST_WORD
    (and a margin for its length and that of the reference, see `limits`) from its
    language's reference. References are sums over all rows of a
    language, rare ones included. A null language counts as
    one named "", whose texts may be near any reference of the LANGUAGES largest. Null and empty texts have
    no words and fail. A text of any length is judged whole. Repeated rows are each
    judged; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    docs = docs.select(*keys, F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("__lang"))
    refs = stored(references(docs))
    # References, of about 1 KB each, go along only if texts without a language need them.
    every = [] if refs.where("__lang = ''").isEmpty() else [parsed(r["__ref"]) for r in refs.orderBy(F.desc("__n"), "__lang").limit(LANGUAGES).collect()]
    unnamed = docs.sparkSession.sparkContext.broadcast(every)
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keys), *["text string"] * carry_text, "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"])
    # Few languages, so that Spark broadcasts them; the texts stay where they are.
    return docs.join(refs, "__lang", "left").select(*keys, "text", "__lang", "__ref").mapInArrow(lambda batches: _judge(batches, unnamed, carry_text), schema)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"))
