"""Graph queries by iterated joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.sources.shared import forget, stored


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least node of the component. Labels spread to neighbours, then jump to their label's label."""
    both = stored(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(b, a)).where("u is not null and v is not null").distinct(), "edges")
    labels = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("m"))
        lower = stored(labels.join(near, F.col("node") == F.col("u")).select("node", F.least("label", "m").alias("to"), "label"), "labels")
        jump = lower.join(lower.select(F.col("node").alias("n2"), F.col("to").alias("further")), F.col("to") == F.col("n2"))
        after = stored(jump.select("node", F.least("to", "further").alias("label"), (F.least("to", "further") != F.col("label")).alias("changed")), "labels")
        forget(labels, lower)
        labels = after
        if not labels.where("changed").limit(1).count():
            forget(both)
            return labels.select("node", F.col("label").alias("component"))


def reach(edges: DataFrame, a: str, b: str, start: DataFrame, node: str, goals: DataFrame | None = None) -> DataFrame:
    """(node, hops) of all nodes that undirected edges connect to the start nodes, with the fewest hops.

    With ``goals`` (nodes that have an attribute) the walk ends at the first
    front that holds one; ``nearest`` takes it from the result.
    """
    both = stored(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(b, a)).where("u is not null and v is not null").distinct(), "edges")
    seen = front = stored(start.select(F.col(node).alias("node"), F.lit(0).alias("hops")).distinct(), "seen")
    hop = 0
    while front.limit(1).count():
        if goals is not None and front.join(goals.select(F.col(node).alias("node")), "node", "left_semi").limit(1).count():
            break
        hop += 1
        fresh = front.join(both, F.col("node") == F.col("u")).select(F.col("v").alias("node")).distinct().join(seen, "node", "left_anti")
        last, before = front, seen
        front = stored(fresh.withColumn("hops", F.lit(hop)), "front")
        seen = stored(before.unionByName(front), "seen")
        forget(*{id(t): t for t in (last, before)}.values())
    forget(both, *([front] if front is not seen else []))
    return seen


def nearest(edges: DataFrame, a: str, b: str, start: DataFrame, node: str, goals: DataFrame) -> DataFrame:
    """(node, hops): the goal with the fewest hops from a start node, the least one of several; no row if none is connected."""
    found = reach(edges, a, b, start, node, goals).join(goals.select(F.col(node).alias("node")).distinct(), "node", "left_semi")
    return found.orderBy("hops", "node").limit(1)
