"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import written


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One star step over links (u, v), u > v.

    Large: every larger neighbour of a node is linked to the node's smallest neighbour.
    Small: every smaller neighbour of a node, and the node, are linked to the smallest of them.
    The smallest neighbour is an aggregate and comes back by a join, so a node with very many
    neighbours never meets in one group.
    """
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def component_labels(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, label) for every node of links (a, b) but the labels themselves; label: the smallest node reachable.

    Nodes are integers.  Links may repeat, point either way and join a node to itself; null
    ends are no links.  Rounds grow with the logarithm of the longest chain; each writes its
    links, which never outnumber the first, to the shared folder.
    """
    edges = links.where("a is not null and b is not null and a <> b")
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    for _ in range(most_rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        state = now
        edges = written(_stars(_stars(edges, large=True), large=False), "links")
    raise RuntimeError(f"links had not settled after {most_rounds} rounds")
