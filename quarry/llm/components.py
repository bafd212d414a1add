"""Connected components of a distributed edge list, by alternating large and small stars.

Each round is written and replaces the one before. The least neighbours are dealt anew after grouping, so that the joins with them are
plain ones, of which Spark splits the side of a hub that has a third of all edges.

Defined cases: repeated edges count once, an edge of a node to itself is ignored, edges with a null end are dropped, no edges give no rows. Of equal
ways to name a component there is one: its least node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize


def _stars(edges: DataFrame) -> DataFrame:
    """One large star and one small star; edges are (a, b) with a > b. Joins only with each node's least neighbour."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).hint("rebalance")
    large = materialize(both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "star")
    down = large.groupBy("a").agg(F.min("b").alias("m")).hint("rebalance")
    met = large.join(down, "a")
    small = met.select("a", F.col("m").alias("b")).union(met.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")))
    out = materialize(small.distinct(), "star")
    discard(large, edges)
    return out


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """``edges`` (a, b): node and component, the least node it is linked to. Nodes without an edge are not returned."""
    own = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")
    before = None
    for _ in range(most):
        state = own.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before, own = state, _stars(own)
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    nodes = own.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(nodes.select("component", "component").distinct())
