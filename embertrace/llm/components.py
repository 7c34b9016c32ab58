"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from embertrace.staging import discard, stage


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (a, b): the smallest node that can be reached.

    Each round gives every node its smallest neighbour (or itself) as parent and replaces both ends of all edges by
    their parents. Numbers should be hashes, so that long paths shrink by a constant share per round. Nodes with many
    neighbours are minima over edges, combined before the shuffle. Every round is written, so a lost executor costs
    one round at most.
    """
    ordered = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = stage(ordered.filter("a <> b").distinct(), "edges")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
        parents = stage(parents.select("node", F.least("node", "near").alias("parent")), "parents")
        rounds.append(parents)
        left = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        right = parents.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        moved = edges.join(left, "a").join(right, "b").filter("pa <> pb")
        used = edges
        edges = stage(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        discard(used)
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = rounds[0].select("node", F.col("parent").alias("component"))
    for parents in rounds[1:]:
        onward = parents.select(F.col("node").alias("component"), "parent")
        labels = labels.join(onward, "component", "left").select("node", F.coalesce("parent", "component").alias("component"))
    labels = stage(labels, "components")
    discard(edges, *rounds)
    return labels
