"""Connected components by contraction, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querygrove.llm.scratch import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the nodes of ``edges`` (a, b) with the smallest node each can reach.

    Each round maps every node to the smallest of itself and its neighbours
    and contracts the edges by that map; the maps are then composed. Every
    component shrinks to its smallest node: a node maps to itself only while no
    neighbour is smaller. Links that are null or loops are ignored, repeated
    links count once, and no links give no rows. Edges and maps are written
    between rounds. Nodes should be hashes: in random order about a third of
    the nodes of a chain remain after a round, whereas a chain in sorted order
    would shrink by one.
    """
    edges = edges.select("a", "b").filter("a is not null and b is not null and a <> b")
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "edges")
    maps: list[DataFrame] = []
    while not both.isEmpty():
        step = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("to"))
        step = written(step, "step")
        maps.append(step)
        left = both.join(step, "a").select(F.col("to").alias("x"), "b")
        right = step.select(F.col("a").alias("b"), F.col("to").alias("y"))
        both = left.join(right, "b").filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        both = written(both, "edges")
    if not maps:
        return both.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = maps[-1].select("a", F.col("to").alias("root"))
    for step in maps[-2::-1]:
        roots = step.join(roots.withColumnRenamed("a", "to"), "to", "left").select("a", F.coalesce("root", "to").alias("root"))
    return roots.withColumnRenamed("a", "node")
