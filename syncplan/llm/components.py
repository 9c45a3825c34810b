"""Connected components with joins, without collecting links.

Nodes take the smallest node among themselves and their neighbours as parent, chains of parents are shortened by joining
the parents with themselves, and links are then redrawn between roots.  Each turn at least halves the nodes that still
have links, so turns grow with the logarithm of a component's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _roots(parents: DataFrame) -> DataFrame:
    """``node, parent`` with chains followed to their end; a node that is no key is its own parent."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        longer = stored(parents.join(up, "parent", "left").select("node", F.coalesce("next", "parent").alias("new"), "parent"))
        moved = longer.filter("new <> parent").isEmpty()
        parents = longer.select("node", F.col("new").alias("parent"))
        if moved:
            return parents


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for each node of the links ``(a, b)``: the smallest node of its component."""
    edges = links.filter("a <> b").select("a", "b").distinct()
    edges = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    found: DataFrame | None = None
    while not edges.isEmpty():
        parents = edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("parent"))
        turn = _roots(stored(parents))
        if found is None:
            found = turn
        else:
            up = turn.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
            found = stored(found.join(up, "parent", "left").select("node", F.coalesce("next", "parent").alias("parent")))
        left = turn.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        right = turn.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        drawn = edges.join(left, "a").join(right, "b").filter("pa <> pb")
        edges = stored(drawn.select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct())
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return found.select("node", F.col("parent").alias("label"))


def merge_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) after groups that the links (of nodes) connect have become one."""
    a = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    b = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    between = links.join(a, "a").join(b, "b").filter("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    to = components(between).select(F.col("node").alias("label"), F.col("label").alias("new"))
    return stored(labels.join(to, "label", "left").select("node", F.coalesce("new", "label").alias("label")))
