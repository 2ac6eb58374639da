"""Connected components of a link table, by contraction; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import drop_stage, stage


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """id, component (the smallest id reachable) for every id in ``links`` (a, b: long).

    Nodes are ranked by a hash of their ids.  Each round every node takes the node of the lowest rank among itself and
    its neighbours, then what that one took, and links are drawn anew between what their ends took.  A node stays only
    if it ranks below all its neighbours, which at most half of the nodes do, expectedly, in whatever order ids lie: rounds
    grow with the logarithm of the nodes, on chains as on stars.  The smallest id of a component is found at the end.
    """
    edges = stage(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-links")
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).withColumn("rank", F.xxhash64("v"))
        took = both.groupBy("u").agg(F.min_by("v", "rank").alias("v"), F.min("rank").alias("rank"))
        own = F.xxhash64("u")
        lower = (F.col("rank") < own) | ((F.col("rank") == own) & (F.col("v") < F.col("u")))
        took = stage(took.select("u", F.when(lower, F.col("v")).otherwise(F.col("u")).alias("p")), f"{name}-took")
        parent = stage(took.join(took.select(F.col("u").alias("p"), F.col("p").alias("top")), "p").select("u", F.col("top").alias("p")), f"{name}-parents")
        if labels is None:
            new = parent.select(F.col("u").alias("id"), F.col("p").alias("root"))
        else:
            new = labels.join(parent, labels.root == parent.u, "left").select("id", F.coalesce("p", "root").alias("root"))
        new = stage(new, f"{name}-labels")
        at = parent.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        left = edges.join(parent, edges.a == parent.u).select("p", "b").join(at, "b").where("p <> pb").select(F.least("p", "pb").alias("a"), F.greatest("p", "pb").alias("b")).distinct()
        left = stage(left, f"{name}-links")
        drop_stage(edges, took, parent, *([labels] if labels is not None else []))
        edges, labels = left, new
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    drop_stage(edges)
    smallest = stage(labels.groupBy("root").agg(F.min("id").alias("component")), f"{name}-smallest")
    return labels.join(smallest, "root").select("id", "component")
