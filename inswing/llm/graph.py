"""Connected components over a table of edges, by joins and sums."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from inswing.llm.common import empty, stage


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of `edges` (u, v): root is the smallest node of its component.

    Large-star and small-star rounds in turn (Kiveris and others, 2014). The smallest neighbour of each node is a sum
    made before the shuffle; it is written before it is joined back, so that Spark sees its size and can split the edges
    of a node that very many others lean on. Rounds grow with the logarithm of the longest path, not with a group's size."""
    now = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-edges")
    while not empty(now):
        # large star: every greater neighbour of a node leans on the node's smallest neighbour
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stage(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m")), f"{name}-low")
        # an edge (u, v) has u > v: u leans on the least around v, and v on itself
        large = now.join(low, now["v"] == low["n"]).select("u", F.col("m").alias("v")).distinct()
        large = stage(large, f"{name}-large")
        # small star: all smaller neighbours of a node, and the node, lean on the smallest
        least = stage(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k")), f"{name}-least")
        if empty(least.where("k > 1")):
            stars = least.select(F.col("u").alias("node"), F.col("m").alias("root"))
            if empty(stars.join(stars.select(F.col("node").alias("root")), "root", "left_semi")):
                return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
        l = least.select(F.col("u").alias("n"), "m")
        small = large.join(l, large["u"] == l["n"]).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stage(small.unionByName(l.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct(), f"{name}-edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
