"""Document fingerprints: invertible Bloom lookup sketches of paragraphs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.llm.common import cut, read, stored

#: A paragraph is a line; of longer lines, stretches of 60 to 160 characters up to a sentence's end, in any script; without one, of 160.
PARAGRAPH = r"[^\n]{60,160}?(?:[.!?]+(?=\s|$)|[。！？।؟]+)|[^\n]{160}|[^\n]+"
#: Of texts under SHORT characters a piece is a line, or of one of more than 32 characters 16 to 24 up to a word's end, or 24: such a text has few sentences. From BOTH on texts have
#: paragraphs, too, so that versions on either side of the bound have something in common.
PIECE = r"[^\n]{1,32}(?![^\n])|[^\n]{16,24}?(?=\s|$)|[^\n]{24}"
SHORT, BOTH = 480, 360
#: A sketch has four tables of eight cells; a larger one has 2 ** k such sketches, its segments.
TABLES, PLACES = 4, 8
#: Low bits of a digest that check the others, so that a cell with one digest is known by itself.
CHECK = (1 << 24) - 1
#: Digests that a segment is meant for when a sketch is made larger, and rounds of peeling.
LOAD, ROUNDS = 12, 12
#: Times that size up to which a sketch is made larger; from there it is made anew, with other cells.
LARGEST = 256
#: Digests of two texts from which the first sketch isn't peeled, as so many differences don't come out of it.
HOPELESS = 40
#: Bits of a digest that deal it out to segments in one step, and in all.
STEP_BITS, SEGMENT_BITS = 4, 24
_NO_ID = -(2**63)


def digests(text: Column) -> Column:
    """The set of a text's paragraphs, or of a short text's pieces, each as 40 bits of its hash and a 24-bit check on them."""
    none, long = F.array().cast("array<string>"), F.length(text)
    fine = F.when(long < SHORT, F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))).otherwise(none)
    coarse = F.when(long >= BOTH, F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0))).otherwise(none)
    pieces = F.filter(F.transform(F.concat(fine, coarse), lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c"))), lambda x: x != "")
    heads = F.transform(pieces, lambda x: F.xxhash64(x).bitwiseAND(F.lit(~CHECK)))
    return F.array_distinct(F.transform(heads, lambda x: x.bitwiseOR(F.xxhash64(x).bitwiseAND(F.lit(CHECK)))))


def bits_of(key: str, seed: int) -> str:
    """What deals a digest to segments and cells: itself, and at later attempts a fresh hash of it."""
    return f"xxhash64({key}, {seed})" if seed else key


def cells(keys: Column, seed: int = 0) -> Column:
    """A sketch: each cell holds all digests dealt to it, combined by XOR."""

    def cell(table: int, place: int) -> Column:
        mask, want = F.lit(7 << (24 + 3 * table)), F.lit(place << (24 + 3 * table))
        dealt = (lambda k: F.xxhash64(k, F.lit(seed))) if seed else (lambda k: k)
        return F.aggregate(keys, F.lit(0).cast("long"), lambda acc, k: F.when(dealt(k).bitwiseAND(mask) == want, acc.bitwiseXOR(k)).otherwise(acc))

    return F.array(*(cell(t, p) for t in range(TABLES) for p in range(PLACES)))


def subtract(a: str, b: str) -> Column:
    """The sketch of all digests that only one of the two has."""
    return F.expr(f"zip_with({a}, {b}, (x, y) -> x ^ y)")


def peel(difference: str, seed: int = 0) -> Column:
    """Recovers digests from the cells in column `difference`: struct(cells, found).

    Each round takes the digests that are alone in a cell out of all their
    cells. Everything was found if the cells that are left are zero.
    """
    pure = f"array_distinct(filter(s.cells, x -> x <> 0 and (xxhash64(x & {~CHECK}L) & {CHECK}L) = (x & {CHECK}L)))"
    left = f"transform(s.cells, (x, i) -> aggregate(p, x, (y, k) -> if((shiftright({bits_of("k", seed)}, 24 + 3 * cast(i div {PLACES} as int)) & 7) = i % {PLACES}, y ^ k, y)))"
    step = f"transform(array({pure}), p -> if(size(p) = 0, s, named_struct('cells', {left}, 'found', concat(s.found, p))))[0]"
    return F.expr(f"aggregate(sequence(1, {ROUNDS}), named_struct('cells', {difference}, 'found', cast(array() as array<bigint>)), (s, r) -> {step})")


def _left_over(peeled: str) -> str:
    return f"exists({peeled}.cells, x -> x <> 0)"


def fingerprint(sketch: str) -> Column:
    return F.expr(f"array_join(transform({sketch}, x -> lpad(lower(hex(x)), 16, '0')), '')")


def differences(pairs: DataFrame) -> DataFrame:
    """(row, pair, found) for `pairs` (row, pair, keys): the number of digests that are once in `keys`.

    `keys` holds the digests of both versions; those of both cancel in the cells, which is
    what subtracting sketches of that size does. Sizes follow the number of
    digests; where peeling fails, the sketch is made four times as large, and its
    cells are dealt by a fresh hash, so that digests that shared all of them part.
    """
    out, times, seed = None, 1, 0
    while (most := pairs.agg(F.max(F.size("keys"))).first()[0]) is not None:
        bits = F.expr(f"cast(least({SEGMENT_BITS}, ceil(log2({times} * ceil(greatest(1, size(keys)) / {LOAD})))) as int)")
        part = pairs.select("row", "pair", "keys", bits.alias("bits"))
        levels = min(SEGMENT_BITS, (max(1, -(-most // LOAD)) * times - 1).bit_length())
        for done in range(0, levels, STEP_BITS):
            own = f"shiftleft(1L, greatest(0, least({STEP_BITS}, bits - {done})))"
            dealt = f"transform(sequence(0L, {own} - 1L), i -> filter(keys, k -> (shiftright({bits_of("k", seed)}, {40 + done}) & ({own} - 1L)) = i))"
            part = part.select("row", "pair", "bits", F.explode(F.expr(dealt)).alias("keys"))
        peeled = part.select("row", "pair", cells(F.col("keys"), seed).alias("cells")).select("row", "pair", peel("cells", seed).alias("p"))
        sums = cut(peeled.groupBy("row", "pair").agg(F.sum(F.size("p.found")).alias("found"), F.max(F.expr(_left_over("p"))).alias("failed")))
        good = sums.where("not failed").select("row", "pair", "found")
        out = good if out is None else out.union(good)
        failed = sums.where("failed")
        if failed.isEmpty():
            break
        pairs = cut(pairs.join(failed, ["row", "pair"], "left_semi"))
        times, seed = min(LARGEST, times * 4), seed + 1
        if seed > 30:
            raise ValueError("these aren't digests with their own check: no sketch of them can be peeled")
    return out


def neighbours(keys: DataFrame) -> DataFrame:
    """For each (k, h, n), all distinct, the next (k, h) in their order; after the last comes the first.

    Rows are dealt out by ranges and ordered within each; only the first row of
    each range, one per partition, is brought together.
    """
    ranged = cut(keys.repartitionByRange("k", "h").withColumn("part", F.spark_partition_id()))
    over = Window.orderBy("part")
    heads = ranged.groupBy("part").agg(F.min(F.struct("k", "h")).alias("head"))
    heads = heads.select("part", F.coalesce(F.lead("head").over(over), F.first("head").over(over)).alias("after"))
    within = Window.partitionBy("part").orderBy("k", "h")
    # Broadcast: one row per partition.
    nxt = ranged.withColumn("next", F.lead(F.struct("k", "h")).over(within)).join(F.broadcast(heads), "part")
    return nxt.select("k", "h", "n", F.coalesce("next", "after").alias("next")).select(F.col("k").alias("own_k"), F.col("h").alias("own_h"), F.expr("n div 4").alias("quarter"), F.col("next.k").alias("k"), F.col("next.h").alias("h"))


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of all rows and of their edited texts, and likenesses.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, n_paragraphs, edited_differs, next_differs. A
    likeness is the Jaccard index of the two sets of paragraphs, from what
    peeling recovers; two texts without paragraphs are alike (1).

    A null text counts as empty, a null doc_id as the smallest; rows of one
    doc_id are ordered by a hash of their text, and equal rows count as one in
    the order and are each returned. A single document is its own next one. A
    text of any length is cut whole. An empty table gives no rows; extra columns
    are ignored, whatever their names.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("k"), text.alias("text")).withColumn("h", F.xxhash64("text"))
    keys = cut(docs.groupBy("k", "h").agg(F.max(F.char_length("text")).alias("n"), F.count("*").alias("rows")))
    repeats = not keys.where("rows > 1").isEmpty()
    full = docs.select("k", "h", "text", digests(F.col("text")).alias("own"))
    ahead = full.join(neighbours(keys.select("k", "h", "n")), ["k", "h"]).select("own_k", "own_h", F.substr("text", F.lit(1), F.col("quarter").cast("int")).alias("head"), F.col("own").alias("after"))
    if repeats:
        ahead = ahead.dropDuplicates(["own_k", "own_h"])
    both = full.join(ahead, (F.col("k") == F.col("own_k")) & (F.col("h") == F.col("own_h")))
    both = both.withColumn("n", F.char_length("text")).withColumn("edited_text", F.expr("concat(substr(text, 1, n - n div 4), head)"))
    both = both.select("k", "n", F.sha2("edited_text", 256).alias("sha"), "own", "after", digests(F.col("edited_text")).alias("edited"))
    both = both.select("*", *(cells(F.col(c)).alias(f"{c}_cells") for c in ("own", "edited", "after")))
    both = both.select("*", subtract("own_cells", "edited_cells").alias("d0"), subtract("own_cells", "after_cells").alias("d1"))
    # Texts of many paragraphs go on to larger sketches at once: that of the next text differs in nearly all, the edited one in a quarter or more.
    few = [F.size("own") + F.size("edited") <= 2 * HOPELESS, F.size("own") + F.size("after") <= HOPELESS]
    both = both.select("*", F.when(few[0], peel("d0")).alias("p0"), F.when(few[1], peel("d1")).alias("p1"))
    found = [F.expr(f"if({p} is null or {_left_over(p)}, null, cast(size({p}.found) as long))").alias(f"found{p[1]}") for p in ("p0", "p1")]
    left = [F.expr(f"if({p} is null or {_left_over(p)}, concat(own, {c}), null)").alias(f"keys{p[1]}") for p, c in (("p0", "edited"), ("p1", "after"))]
    sizes = [F.size(c).cast("long").alias(f"{c}_size") for c in ("own", "edited", "after")]
    base = stored(both.select(F.monotonically_increasing_id().alias("row"), F.nullif("k", F.lit(_NO_ID)).alias("doc_id"), F.col("n").cast("long").alias("n_chars"), F.col("sha").alias("edited_sha256"), fingerprint("own_cells").alias("fingerprint"), fingerprint("edited_cells").alias("edited_fingerprint"), *sizes, *found, *left))
    again = base.where("keys0 is not null").select("row", F.lit(0).alias("pair"), F.col("keys0").alias("keys")).union(base.where("keys1 is not null").select("row", F.lit(1), "keys1"))
    more = differences(again)
    rows = base.drop("keys0", "keys1")
    if more is not None:
        more = more.groupBy("row").agg(F.max(F.expr("if(pair = 0, found, null)")).alias("more0"), F.max(F.expr("if(pair = 1, found, null)")).alias("more1"))
        rows = rows.join(more, "row", "left").withColumn("found0", F.coalesce("found0", "more0")).withColumn("found1", F.coalesce("found1", "more1"))

    def likeness(other: str, found: str) -> Column:
        return F.expr(f"if(own_size + {other} = 0, 1.0D, cast(own_size + {other} - {found} as double) / (own_size + {other} + {found}))")

    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("edited_size", "found0").alias("near_edited"), likeness("after_size", "found1").alias("near_next"), F.col("own_size").alias("n_paragraphs"), F.col("found0").alias("edited_differs"), F.col("found1").alias("next_differs"))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(read(spark, sf_dir, "documents"))
