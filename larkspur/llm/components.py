"""Connected components of a graph in a table, by alternating large and small stars.

Each round hangs every neighbour of a node on the least node that the node sees,
first the larger neighbours, then the smaller ones; the graph ends as stars around
the least node of each component, after a number of rounds that grows with the
logarithm of its size. Links never leave the executors; each round is a written
table, so lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import shared


#: Links beyond which each node's least neighbour is written before it is joined, so that both sides are shuffled and hot nodes split.
SPLIT = 5_000_000


def _star(edges: DataFrame, large: bool, split: bool) -> DataFrame:
    """edges: (u, v) in one direction, u > v."""
    hold = (lambda df: shared.saved(df, "least")) if split else (lambda df: df)
    if large:  # every node looks at all neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = hold(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # every node looks at its smaller neighbours
        least = hold(edges.groupBy("u").agg(F.min("v").alias("m")))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link; root is the least node it reaches. edges: two columns of one orderable type, any direction, loops and repeats allowed."""
    a, b = edges.columns
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    now = shared.saved(now, "links")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if tuple(seen) == mark:
            break
        mark, before = tuple(seen), now
        split = seen[0] > SPLIT
        large = _star(now, True, split)
        large = shared.saved(large, "links") if split else large
        now = shared.saved(_star(large, False, split), "links")
        shared.drop(before)
    root = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return root.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
