"""SimHash near-duplicates: positional byte index, count filter, verification."""

from __future__ import annotations

from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.llm.common import cut, map_texts, read, text_bytes
from loomline.llm.components import components

#: Index keys shared by more fingerprints than this are linked by stars, not pairs.
STAR_FROM = 64
_VALUE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def simhash(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """The 64-bit majority of the XXH64 of all word shingles, as a signed long."""
    words = text.lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], dtype="<u8")
    else:
        ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
        starts = [0, *(e + 1 for e in ends[: n - shingle])]
        parts = [joined[s:e] for s, e in zip(starts, ends[shingle - 1 :], strict=True)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), dtype="<u8", count=len(parts))
    octets = hashes.view(np.uint8).reshape(-1, 8)
    if len(hashes) < 400:
        ones = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _VALUE_BITS for i in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, digest, fp) for every row; digest is a 64-bit hash of the text. A null, empty or blank text has fingerprint zero."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = pa.array([simhash(x, shingle) for x in text_bytes(batch)], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), fps], ["doc_id", "digest", "fp"])

    text = F.col("text").cast("string")
    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text")), step, "doc_id long, digest long, fp long")


def _byte_masks(k: int) -> list[tuple[int, int]]:
    """For each choice of k of the 8 byte positions: its bit set, and the mask over a fingerprint."""
    out = []
    for places in combinations(range(8), k):
        mask = sum(0xFF << (8 * p) for p in places)
        out.append((sum(1 << p for p in places), mask - (1 << 64) if mask >> 63 else mask))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, distance: int = 4, star_from: int = STAR_FROM) -> DataFrame:
    """Edges (u, v) that connect exactly what pairs within `distance` bits connect.

    `fps` has distinct values `fp`. Within `distance` differing bits at least
    8 - distance of the 8 bytes agree in place. An index by single bytes would
    have 2,048 postings, whose pairs grow with the square of the input. Here the
    minimum count is part of the key: one posting per choice of 8 - distance
    positions with their bytes, so that two fingerprints meet exactly if their
    tally of shared positional bytes reaches that minimum. In a posting of
    moderate length a pair's tally, taken anew, names the first posting that the
    two share; the pair counts there only, and is verified, all within the join
    condition. Fingerprints in longer postings
    emit no pairs: each is listed under all values within distance/2 bits of
    it; members of one such list are within `distance` of each other, and any
    two that are so share a list, so a star per list keeps every link.
    """
    if distance % 2 or not 0 < distance < 8:
        raise ValueError("distance is an even number of bits below 8")
    least = 8 - distance
    masks = F.array(*[F.struct(F.lit(bits).alias("places"), F.lit(mask).cast("long").alias("mask")) for bits, mask in _byte_masks(least)])
    index = fps.select("fp", F.explode(masks).alias("m")).select(F.col("m.places").alias("places"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("octets"), "fp")
    # Written first, so that the join has no aggregate beside it and a long posting can be split.
    sizes = cut(index.groupBy("places", "octets").agg(F.count("*").alias("n")).where("n > 1"))
    postings = cut(index.join(sizes, ["places", "octets"]))

    few = postings.where(F.col("n") <= star_from)
    a = few.select("places", "octets", F.col("fp").alias("u"))
    b = few.select("places", "octets", F.col("fp").alias("v"))
    differ = "(u ^ v)"
    shared = " | ".join(f"if(({differ} & {_signed(0xFF << (8 * p))}L) = 0, {1 << p}, 0)" for p in range(8))
    smear = "(places | shiftright(places, 1) | shiftright(places, 2) | shiftright(places, 3) | shiftright(places, 4) | shiftright(places, 5) | shiftright(places, 6) | shiftright(places, 7))"
    a = a.withColumn("upto", F.expr(smear))
    rule = F.expr(f"u < v and bit_count({shared}) >= {least} and (({shared}) & upto) = a.places and bit_count({differ}) <= {distance}")
    pairs = a.alias("a").join(b.alias("b"), (F.col("a.places") == F.col("b.places")) & (F.col("a.octets") == F.col("b.octets")) & rule).select("u", "v")

    balls = [0]
    for k in range(1, distance // 2 + 1):
        balls += [_signed(sum(1 << p for p in places)) for places in combinations(range(64), k)]
    many = postings.where(F.col("n") > star_from).select("fp").distinct()
    near = many.select("fp", F.explode(F.lit(balls).cast("array<bigint>")).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("spot"))
    hubs = near.groupBy("spot").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1").select("spot", "hub")
    # By a merge: Spark takes a list's length for one row, and would broadcast all lists once their fingerprints alone are few.
    stars = near.hint("merge").join(hubs, "spot").where("fp <> hub").select(F.col("fp").alias("u"), F.col("hub").alias("v"))
    return pairs.union(stars)


def _members(docs: DataFrame, shingle: int, distance: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, fp) of each row, and (fp, label), where fingerprints of one component have one label."""
    fps = cut(fingerprints(docs, shingle))
    first = cut(fps.select("fp").distinct())
    labels = components(links(first, distance)).withColumnRenamed("node", "fp")
    return fps, first.join(labels, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"))


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) for each row of `docs`.

    Nulls, empty and blank texts have fingerprint zero and link like others.
    Repeated rows are each returned. A null doc_id is never a component's id
    unless nothing else is in it. A text of any length is hashed whole, in a
    batch of its own; an empty table gives no rows; further columns of `docs`
    are ignored, whatever their names.
    """
    fps, of = _members(docs, shingle, distance)
    least = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")).join(of, "fp").groupBy("label").agg(F.min("least").alias("component_id")))
    ids = cut(of.join(least, "label").select("fp", "component_id"))
    return fps.join(ids, "fp").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def unused(df: DataFrame, name: str) -> str:
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def keep_one(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """One row of `docs` of each component, whole: that with the least doc_id (null: the greatest), then the least hash of its text.

    Rows that share an id are told apart by their texts: each is kept or goes
    with its own component. Of rows that agree in both, one stays.
    """
    fps, of = _members(docs, shingle, distance)
    # Names that no column of the table has, whatever its columns are called.
    kept_id, kept_digest, place = (unused(docs, n) for n in ("kept_id", "kept_digest", "place"))
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias(kept_id), F.col("digest").alias(kept_digest))
    least = fps.groupBy("fp").agg(F.min(order).alias("row"))
    kept = cut(least.join(of, "fp").groupBy("label").agg(F.min("row").alias("row")).select(f"row.{kept_id}", f"row.{kept_digest}"))
    own = F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)) & (F.xxhash64(F.col("text").cast("string")) == F.col(kept_digest))
    out = docs.join(kept, own, "left_semi")
    # Only where rows repeat are they ranked, which moves them once more.
    if fps.join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col("digest") == F.col(kept_digest))).groupBy(kept_id, kept_digest).count().where("count > 1").isEmpty():
        return out
    text = F.xxhash64(F.col("text").cast("string"))
    first = Window.partitionBy(F.col("doc_id").cast("long"), text).orderBy(F.xxhash64(*(F.col(f"`{c}`") for c, t in out.dtypes if not t.startswith("map"))))
    return out.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).drop(place)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
