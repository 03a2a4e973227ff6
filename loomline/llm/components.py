"""Connected components by randomised contraction, as joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """Label every endpoint of `edges` (u, v: long) with a node of its component.

    Each round every node joins the neighbour (or itself) of least hashed
    priority, edges are rewritten to the chosen nodes and loops and repeats
    dropped; a fresh hash per round makes a constant share of the nodes vanish,
    whatever the shape of the graph (chains and stars included). Partial
    aggregation keeps a node of any degree out of a single task, and the joins
    have no aggregate above them in their stage, so that AQE may split a hub.
    Returns (node, label).
    """
    edges = cut(edges.select("u", "v").where("u <> v").distinct())
    nodes = cut(edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct().withColumn("label", F.col("node")))
    turn = 0
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))
        near = both.groupBy("u").agg(F.min(F.struct(F.xxhash64("v", F.lit(turn)).alias("p"), F.col("v").alias("x"))).alias("best"))
        own = F.struct(F.xxhash64("u", F.lit(turn)).alias("p"), F.col("u").alias("x"))
        chosen = cut(near.select("u", F.least(F.col("best"), own)["x"].alias("to")))
        edges = edges.join(chosen, "u").select(F.col("to").alias("a"), F.col("v").alias("u"))
        edges = edges.join(chosen, "u").select(F.col("a").alias("u"), F.col("to").alias("v"))
        edges = cut(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        moved = chosen.where("u <> to").select(F.col("u").alias("label"), "to")
        nodes = cut(nodes.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")))
        turn += 1
    return nodes
