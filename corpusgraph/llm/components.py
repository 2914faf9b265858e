"""Connected components by smallest-label propagation with pointer jumping, all on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm._common import cut


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a long, b long); component is the smallest node it reaches.

    Every round takes the smallest label of a node's neighbours, then the label of its label; each ends in a reliable
    checkpoint.  Labels only fall, and a round without change ends it, so the result is exact for any shape.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).where("node != other")
    edges = cut(both.union(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct())
    label = cut(edges.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")))
    while True:
        seen = edges.join(label.select(F.col("node").alias("other"), F.col("component").alias("c")), "other").groupBy("node").agg(F.min("c").alias("c"))
        least = label.join(seen, "node").select("node", F.col("component").alias("was"), F.least("component", "c").alias("component"))
        up = label.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = cut(least.join(up, "component", "left").select("node", "was", F.least("component", F.coalesce("up", "component")).alias("component")))
        label = new.select("node", "component")
        if new.where("was != component").isEmpty():
            return label


def joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` of the links that ``label`` (node, component) came from and of further ``links`` (a, b).

    The components are the nodes of a smaller graph, in which only the further links count.
    """
    part = label.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    ends = links.join(part, "a", "left").select(F.coalesce("ca", "a").alias("a"), "b")
    ends = ends.join(part.select(F.col("a").alias("b"), F.col("ca").alias("cb")), "b", "left").select("a", F.coalesce("cb", "b").alias("b"))
    up = components(ends.where("a <> b").distinct())
    moved = label.join(up.select(F.col("node").alias("component"), F.col("component").alias("up")), "component", "left").select("node", F.coalesce("up", "component").alias("component"))
    return cut(moved.union(up.join(label, "node", "left_anti").select("node", "component")))
