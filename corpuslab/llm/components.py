"""Connected components of an edge table, as alternating star contractions.

An edge (child, parent) points from the larger id to the smaller. Each round links all
parents of a child to its smallest parent, then moves every edge to its parent's own
smallest parent, until no edge changes: every node then points at the smallest id of its
component. The number of rounds grows with the logarithm of the component's diameter.

Skew: minima are pre-aggregated before the shuffle; the joins have plain materialised
tables on both sides, so adaptive execution can split the rows of a hub. Nothing is
collected: a round returns two numbers to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _oriented(edges: DataFrame) -> DataFrame:
    return (edges.where("a <> b")
            .select(F.greatest("a", "b").alias("c"), F.least("a", "b").alias("p")).distinct())


def _min_parent(e: DataFrame) -> DataFrame:
    return cut(e.groupBy("c").agg(F.min("p").alias("m")))


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("c", "p").cast("decimal(38,0)"))).first()
    return tuple(r)


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of any one orderable type -> ``(node, root)``, one row per node that
    has an edge to another; ``root`` is the smallest node it reaches. Self-loops and
    repeated edges are ignored; an empty table gives an empty table."""
    e = cut(_oriented(edges.where("a is not null and b is not null")))
    before = _state(e)
    while before[0]:
        m = _min_parent(e)
        # every other parent of a child becomes a child of its smallest parent
        j = e.join(m, "c")
        e = cut(j.where("p <> m").select(F.col("p").alias("c"), F.col("m").alias("p"))
                .unionByName(m.withColumnRenamed("m", "p")).distinct())
        # every edge moves to its parent's smallest parent
        up = _min_parent(e).select(F.col("c").alias("p"), F.col("m").alias("up"))
        e = cut(e.join(up, "p", "left").select("c", F.coalesce("up", "p").alias("p")).distinct())
        after = _state(e)
        if after == before:
            break
        before = after
    return (e.select(F.col("c").alias("node"), F.col("p").alias("root"))
            .unionByName(e.select(F.col("p").alias("node"), F.col("p").alias("root")).distinct()))
