"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.common import discard, staged

JUMPS = 3


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (a, b); the component is its least node.

    A round lets every node point at its least neighbour, follows the pointers ``JUMPS`` times and
    contracts the edges; the least node of a component never points away, so it names it.  Stars
    end in two rounds and long chains shrink by a constant factor.  Everything is a minimum per
    node (summed map-side, so a node with very many edges is no hot key) or an equi-join.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e = staged(e, "edges")
    label = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("up")).select(F.col("a").alias("node"), "up")
        least = staged(least, "parents")
        if least.isEmpty():
            break
        up = least
        for _ in range(JUMPS):
            far = up.select(F.col("node").alias("up"), F.col("up").alias("far"))
            up = up.join(far, "up").select("node", F.col("far").alias("up"))
        up = staged(up, "parents")
        rest = (e.join(up.select(F.col("node").alias("a"), F.col("up").alias("a2")), "a").join(up.select(F.col("node").alias("b"), F.col("up").alias("b2")), "b")
                .where(F.col("a2") != F.col("b2")).select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
        rest = staged(rest, "edges")
        if label is None:
            later = staged(up.select("node", F.col("up").alias("component")), "labels")
        else:
            nxt = up.select(F.col("node").alias("component"), F.col("up").alias("later"))
            later = staged(label.join(nxt, "component", "left").select("node", F.coalesce("later", "component").alias("component")), "labels")
            discard(label)
        discard(e, least, up)
        e, label = rest, later
    discard(e)
    return label if label is not None else least.select("node", F.col("up").alias("component"))
