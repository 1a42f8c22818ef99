"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import linked
from .common import cut, snug


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (of one orderable type). Returns node, root: the smallest node of its component, for every node with an edge.

    Nulls are left out, loops and repeated edges do no harm.
    """
    return linked(edges, cut, snug)


def closer(roots: DataFrame | None, links: DataFrame, rows: int, steps: int = 3) -> DataFrame:
    """node, root for every node with a link: nodes of one root are of one component, though not the other way round.

    A cheap stand-in for components() where that is all that is asked: in each step a node takes the smallest root
    among its neighbours, then its root's root. links: a, b, with about so many rows; roots: an earlier result over some
    of the links."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = both.select(F.col("a").alias("node")).distinct()
    now = now.withColumn("root", F.col("node")) if roots is None else now.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    for _ in range(steps):
        near = both.join(now.select(F.col("node").alias("b"), F.col("root").alias("_r")), "b").groupBy(F.col("a").alias("node")).agg(F.min("_r").alias("_r"))
        now = cut(snug(now.join(near, "node").select("node", F.least("root", "_r").alias("root")), rows))
        over = now.select(F.col("node").alias("root"), F.col("root").alias("_r"))
        now = now.join(over, "root").select("node", F.col("_r").alias("root"))
    return now
