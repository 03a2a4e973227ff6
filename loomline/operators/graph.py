"""Reachability over edge tables: fixpoints of joins, driven by the frontier only."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators.lineage import cut


#: Edges of one source that a task holds at most; the edges of sources with more are dealt out over as many tasks as that takes.
SPLIT = 1_000_000


def dealt(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with a `part`, dealt out by source and part; and the number of parts of each source that has several (src, parts).

    A source's edges go to parts by their ends, so none has much more than SPLIT of one source.
    """
    heavy = cut(edges.groupBy("src").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("parts")).where("parts > 1"))
    if heavy.isEmpty():
        return edges.withColumn("part", F.lit(0)).repartition("src"), heavy
    part = F.pmod(F.hash("dst"), F.coalesce("parts", F.lit(1)))
    return edges.join(heavy, "src", "left").select("src", "dst", part.alias("part")).repartition("src", "part"), heavy


def depths(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """(node, depth): the fewest edges from a seed to each node that is within `most` of one.

    `edges` has src and dst, `seeds` has node. Each round joins the nodes found
    last with the edges and drops nodes known before, so cycles end. A round's rows
    are written to the shared folder. Edges are written there too, and held in
    memory, dealt out once, so that a round moves its frontier only; what is held
    on an executor that is lost is read again. A node with very many edges meets
    each part of them by a row of its own. Distinct aggregates before it shuffles.
    """
    held, heavy = dealt(cut(edges.select("src", "dst").where("src <> dst").distinct()))
    held = held.persist(StorageLevel.MEMORY_AND_DISK)
    split = not heavy.isEmpty()
    frontier = cut(seeds.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0)))
    known, depth = frontier, 0
    while most is None or depth < most:
        depth += 1
        asked = frontier.select(F.col("node").alias("src"))
        if split:
            asked = asked.join(heavy, "src", "left").select("src", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        found = held.join(asked, asked.columns).select(F.col("dst").alias("node")).distinct()
        frontier = cut(found.join(known.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        known = known.union(frontier)
        if depth % 8 == 0:
            known = cut(known)
    held.unpersist()
    return known


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node): all seeds and all nodes on a path from one."""
    return depths(edges, seeds).select("node")


def hub_edges(members: DataFrame, node: str, group: str, into: DataFrame | None = None) -> DataFrame:
    """Edges that link all members of a group to each other through one hub per group.

    As many edges as members, where linking all pairs takes the square. `into`
    (same columns) restricts which members a hub leads to. Hubs are named
    `hub:` and the group; drop them from what is reached with `no_hubs`.
    """
    hub = F.concat(F.lit("hub:"), F.col(group).cast("string"))
    to = members.where(F.col(group).isNotNull()).select(F.col(node).cast("string").alias("src"), hub.alias("dst"))
    back = (members if into is None else into).where(F.col(group).isNotNull()).select(hub.alias("src"), F.col(node).cast("string").alias("dst"))
    return to.union(back)


def no_hubs(nodes: DataFrame) -> DataFrame:
    return nodes.where(~F.col("node").startswith("hub:"))


def bounded_groups(members: DataFrame, keys: list[str], least: int, most: int) -> DataFrame:
    """Groups of `least` to `most` members: keys, n and the number of pairs, without making pairs."""
    sizes = members.groupBy(*keys).agg(F.count("*").alias("n"))
    return sizes.where(F.col("n").between(least, most)).withColumn("pairs", (F.col("n") * (F.col("n") - 1) / 2).cast("long"))


def propagate(start: DataFrame, edges: DataFrame, passes: int) -> DataFrame:
    """(node, name) pairs of `start`, pushed along edges (src, dst) up to so many times; stops when nothing is new."""
    known = frontier = cut(start.select("node", "name").distinct())
    edges = cut(edges.select("src", "dst").distinct())
    for _ in range(passes):
        moved = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "name").distinct()
        frontier = cut(moved.join(known, ["node", "name"], "left_anti"))
        if frontier.isEmpty():
            break
        known = known.union(frontier)
    return known
