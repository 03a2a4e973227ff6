"""The trie of conversations' common beginnings, with subtree sums over heavy paths."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.llm.common import cut, read, slices

#: Conversations in one group begin with turns of its first one: at most one less than GRAFTS.
GROUP, GRAFTS = 5, 9
#: Turns, depths or places that are summed in one task; longer rows of them meet through the sums of their blocks.
BLOCK = 4096
NODE = ["k1", "k2", "depth"]


def block(place: str) -> Column:
    return F.floor(F.col(place) / BLOCK)


def digested(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, a 128-bit digest of role and text, and the text's bytes; a null role or text is empty. A row without a conv_id belongs to no conversation and is left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id is not null")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.unhex(F.substring(F.sha2(whole.cast("binary"), 256), 1, 32)).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))


def numbered(rows: DataFrame) -> DataFrame:
    """`at`: the place of a turn in its conversation, from 1, by turn (null first) and digest. Turns are numbered in blocks of them, and blocks by their counts."""
    blocked = rows.withColumn("part", block("turn"))
    counts = blocked.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    later = cut(counts.withColumn("before", before).where("before > 0").select("conv_id", "part", "before"))
    within = blocked.withColumn("at", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("turn", "digest")).cast("long"))
    return within.join(later, ["conv_id", "part"], "left").withColumn("at", F.col("at") + F.coalesce("before", F.lit(0))).drop("part", "before", "turn")


def grafted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: (conv_id, depth, size, digest, bytes) of turns, and (conv_id, size) of all.

    The first h turns of a conversation give way to those of the first one of
    its group of five, h being a hash of its id.
    """
    placed = cut(numbered(rows))
    sizes = placed.groupBy("conv_id").agg(F.count("*").alias("n"))
    keys = sizes.select("*", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % GRAFTS).alias("h"))
    firsts = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = cut(keys.join(firsts, "base", "left").select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")))
    own = placed.join(convs, "conv_id").where("at > h").select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("depth"), "size", "digest", "bytes")
    heads = placed.where((F.col("at") < GRAFTS) & (F.col("conv_id") % GROUP == 0)).withColumnRenamed("conv_id", "base")
    given = heads.join(convs, "base").where("at <= h").select("conv_id", F.col("at").alias("depth"), "size", "digest", "bytes")
    return own.union(given), convs.select("conv_id", "size")


def as_they_are(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations themselves, in the form of `grafted`."""
    placed = cut(numbered(rows))
    convs = cut(placed.groupBy("conv_id").agg(F.count("*").alias("size")))
    return placed.join(convs, "conv_id").select("conv_id", F.col("at").alias("depth"), "size", "digest", "bytes"), convs


def along(rows: DataFrame, sums: dict[str, tuple[Column, Callable[[str], Column], Callable[[Column, Column], Column]]]) -> DataFrame:
    """Running aggregates down each conversation, by blocks of depths.

    `sums` has by name: an aggregate of rows, that of the aggregates of blocks,
    and what a row's and the earlier blocks' make together. Only conversations of
    a block's length or more have earlier blocks.
    """
    cells = rows.withColumn("part", block("depth"))
    down = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = cells.select("*", *(own.over(down).alias(n) for n, (own, _, _) in sums.items()))
    blocks = cells.where(F.col("size") >= BLOCK).groupBy("conv_id", "part").agg(*(own.alias(n) for n, (own, _, _) in sums.items()))
    above = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = cut(blocks.select("conv_id", "part", *(over(n).over(above).alias(f"earlier_{n}") for n, (_, over, _) in sums.items())).where("part > 0"))
    met = out.join(earlier, ["conv_id", "part"], "left")
    return met.select(*rows.columns, *(add(F.col(n), F.col(f"earlier_{n}")).alias(n) for n, (_, _, add) in sums.items()))


def keyed(turns: DataFrame) -> DataFrame:
    """k1, k2 of the sequence up to each turn, and a1, a2 of that before it: 128 bits, an XOR of hashes of (depth, digest) over it, so that any part of it can be taken by itself."""
    hashed = cut(turns.select("*", F.xxhash64("depth", "digest").alias("x1"), F.xxhash64("digest", F.lit(7), "depth").alias("x2")))
    both = lambda own, earlier: own.bitwiseXOR(F.coalesce(earlier, F.lit(0).cast("long")))
    rows = along(hashed, {"k1": (F.bit_xor("x1"), F.bit_xor, both), "k2": (F.bit_xor("x2"), F.bit_xor, both)})
    return rows.select("conv_id", "depth", "size", "bytes", "k1", "k2", F.col("k1").bitwiseXOR(F.col("x1")).alias("a1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("a2"))


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is told apart by its smallest member and its depth. An empty table
    has no nodes; turns that repeat in a conversation are each a turn; equal
    conversations share all their nodes.

    The heavy child of a node is the one with the most members (of equal ones
    that with the smallest member), so a path to the root has at most log2 of
    the number of conversations as light edges. Nodes learn their path's top and
    the number of light edges above from running aggregates down the
    conversation that they are named by. Then paths are summed up from their
    ends, those with the most light edges above first; each round gives the sums
    of its paths to the nodes that they hang on.
    """
    rows = cut(keyed(turns))
    found = rows.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"), F.min("a1").alias("a1"), F.min("a2").alias("a2"))
    none = F.lit(None).cast("long")
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    top = top.select(zero.alias("k1"), zero.alias("k2"), zero.alias("depth"), "conv_id", "n_convs", zero.alias("bytes"), none.alias("a1"), none.alias("a2"))
    nodes = cut(found.unionByName(top))
    first = nodes.where("depth = 0").first()
    root = F.lit(first.conv_id if first else 0).cast("long")

    children = nodes.where("depth > 0").groupBy(F.col("a1").alias("k1"), F.col("a2").alias("k2"), (F.col("depth") - 1).alias("depth"))
    heaviest = F.max_by("conv_id", F.struct("n_convs", -F.col("conv_id").cast("decimal(20)")))
    kids = cut(children.agg(F.count("*").alias("n_children"), heaviest.alias("heavy")))
    parents = cut(nodes.join(kids, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    above = parents.where("n_children > 0").select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"), "heavy")
    linked = parents.drop("heavy").join(cut(above), ["a1", "a2", "depth"])
    linked = cut(linked.select(*NODE, F.col("conv_id").alias("owner"), "n_convs", F.col("bytes").alias("own_bytes"), "n_children", "parent_conv_id", (F.col("conv_id") != F.col("heavy")).alias("light")))

    chains = cut(rows.select("conv_id", "depth", "size", "k1", "k2").join(linked, NODE).drop("k1", "k2"))
    # The deepest light node so far is the top of a row's path.
    start = F.when(F.col("light"), F.struct("depth", F.col("owner").alias("conv_id")))
    light = F.col("light").cast("long")
    paths = along(chains, {"top": (F.max(start), F.max, F.coalesce), "level": (F.sum(light), F.sum, lambda own, earlier: own + F.coalesce(earlier, F.lit(0)))})
    whole = F.struct(zero.alias("depth"), root.alias("conv_id"))
    placed = paths.where("conv_id = owner").select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("own_bytes").alias("bytes"), "n_children", F.coalesce("top", whole).alias("top"), "level")
    bare = parents.where("depth = 0").select("conv_id", "depth", none.alias("parent_conv_id"), "n_convs", "bytes", "n_children", whole.alias("top"), zero.alias("level"))
    summed = _path_sums(cut(placed.unionByName(bare)))

    ends = chains.where("depth = size").select("owner", "depth", "conv_id").union(convs.where("size = 0").select(root, zero, "conv_id"))
    out = summed.join(_members(ends), ["conv_id", "depth"], "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))


def _path_sums(nodes: DataFrame) -> DataFrame:
    """n_leaves and saved_tokens of each node's subtree."""
    most = nodes.agg(F.max("level")).first()[0]
    parts, hung = [], None
    for level in range(-1 if most is None else most, -1, -1):
        mine = nodes.where(F.col("level") == level)
        own = {"saved_tokens": (F.col("n_convs") - 1) * F.col("bytes"), "n_leaves": (F.col("n_children") == 0).cast("long")}
        if hung is not None:
            mine = mine.join(hung, ["conv_id", "depth"], "left")
            own = {n: c + F.coalesce(f"hung_{n}", F.lit(0)) for n, c in own.items()}
        mine = mine.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "top", block("depth").alias("part"), *(c.alias(f"own_{n}") for n, c in own.items()))
        up = Window.partitionBy("top", "part").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        within = mine.select("*", *(F.sum(f"own_{n}").over(up).alias(n) for n in own))
        blocks = mine.where(F.col("depth") >= BLOCK).groupBy("top", "part").agg(*(F.sum(f"own_{n}").alias(f"below_{n}") for n in own))
        below = Window.partitionBy("top").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        later = cut(blocks.select("top", (F.col("part") - 1).alias("part"), *(F.sum(f"below_{n}").over(below).alias(f"below_{n}") for n in own)))
        met = within.join(later, ["top", "part"], "left")
        done = cut(met.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "top", *((F.col(n) + F.coalesce(f"below_{n}", F.lit(0))).alias(n) for n in own)))
        parts.append(done.drop("top"))
        tops = done.where((F.col("depth") == F.col("top.depth")) & (F.col("depth") > 0))
        hung = cut(tops.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(*(F.sum(n).alias(f"hung_{n}") for n in own)))
    if not parts:
        return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("bytes").alias("saved_tokens"), F.col("bytes").alias("n_leaves"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _members(ends: DataFrame) -> DataFrame:
    """The digest of the ids that end at each node, ascending.

    Ids lie in ranges of (node, id), so those of one node are joined to texts of
    bounded size by many tasks; only these texts, one after the other, go
    through a node's digest.
    """
    node = ["owner", "depth"]
    ordered = ends.toDF(*node, "first").repartitionByRange(*node, "first").sortWithinPartitions(*node, "first")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, list[str]]] = []
            for owner, depth, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not out or out[-1][:2] != (owner, depth):
                    out.append((owner, depth, conv, []))
                out[-1][3].append(str(conv))
            yield of([(*r[:3], ",".join(r[3])) for r in out], ["owner", "depth", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in slices(batches, "ids"):
            out = []
            for owner, depth, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (owner, depth) == now:
                    sha.update(f",{ids}".encode())
                else:
                    if now:
                        out.append((*now, sha.hexdigest()))
                    now, sha = (owner, depth), hashlib.sha256(ids.encode())
            yield of(out, names)
        if now:
            yield of([(*now, sha.hexdigest())], names)

    def of(out: list[tuple], names: list[str]) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [[]] * len(names)
        types = [*[pa.int64()] * (len(names) - 1), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names)

    names = ["conv_id", "depth", "ends_sha256"]
    texts = ordered.mapInArrow(joined, "owner long, depth long, first long, ids string")
    return texts.repartition(*node).sortWithinPartitions(*node, "first").mapInArrow(digest, "conv_id long, depth long, ends_sha256 string")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*grafted(digested(read(spark, sf_dir, "conversations"))))


def oracle() -> str:
    """The same by sequences as text: every turn of a node's first member leads to one of its ancestors. CRC-32 is taken bit by bit."""
    bits = "flatten(list_transform(string_split(CAST(c AS varchar), ''), lambda x: list_transform(range(8), lambda k: (ascii(x) >> k) & 1)))"
    crc = f"xor(list_reduce({bits}, lambda s, b: xor(s >> 1, 3988292384 * (xor(s, b) & 1)), 4294967295), 4294967295)"
    return f"""
    WITH t AS (
      SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
      FROM conversations WHERE conv_id IS NOT NULL),
    ids AS (SELECT c, n, c - c % {GROUP} AS base, {crc} % {GRAFTS} AS h FROM (SELECT conv_id AS c, count(*) AS n FROM t GROUP BY 1)),
    convs AS (SELECT ids.*, least(ids.h, coalesce(b.n, 0)) AS taken FROM ids LEFT JOIN ids b ON b.c = ids.base),
    turns AS (
      SELECT c, place - h + taken AS depth, role, text FROM t JOIN convs ON conv_id = c WHERE place > h
      UNION ALL SELECT c, place, role, text FROM t JOIN convs ON conv_id = base WHERE place <= h),
    keyed AS (
      SELECT c, depth, octet_length(encode(text)) AS bytes, sha256(string_agg(sha256(length(role) || ':' || role || text), '' ORDER BY depth) OVER (PARTITION BY c ORDER BY depth)) AS k FROM turns
      UNION ALL SELECT c, 0, 0, '' FROM convs),
    sized AS (SELECT *, lead(k) OVER w AS below, lag(k) OVER w AS above FROM keyed WINDOW w AS (PARTITION BY c ORDER BY depth)),
    nodes AS (
      SELECT k, depth, min(c) AS conv_id, count(*) AS n_convs, count(DISTINCT below) AS n_children, min(bytes) AS bytes, min(above) AS above,
        sha256(coalesce(string_agg(CAST(c AS varchar), ',' ORDER BY c) FILTER (below IS NULL), '')) AS ends_sha256
      FROM sized GROUP BY k, depth),
    sums AS (
      SELECT a.k, a.depth, sum(CAST(n.n_children = 0 AS bigint)) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved_tokens
      FROM nodes n JOIN keyed a ON a.c = n.conv_id AND a.depth <= n.depth GROUP BY 1, 2)
    SELECT n.conv_id, CAST(n.depth AS bigint) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(s.n_leaves AS bigint) AS n_leaves,
      CAST(s.saved_tokens AS bigint) AS saved_tokens, n.ends_sha256
    FROM nodes n JOIN sums s ON s.k = n.k AND s.depth = n.depth LEFT JOIN nodes p ON p.k = n.above AND p.depth = n.depth - 1"""
