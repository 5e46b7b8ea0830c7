"""Links among the members of many buckets, without all pairs of a bucket.

A bucket (one key) may hold thousands of near copies. First every bucket elects one leader,
and each member is paired with it: a star, so there are at most as many candidate pairs as
members. Pairs are verified exactly and the verified links merged into components. In each
later round a bucket that still holds several components elects up to ``LEADERS`` members of
random components, and members of other components are paired with them. The pairs of a bucket
whose members are in different components are counted before each round. As soon as they are
not more than a round of stars would test, or a round finds no link, all of them are tested, in
blocks of ``BLOCK`` members, and the search ends: no link between components is left out. A
caller with a cheaper exact way for what the first round leaves gives it as ``finish``.

The first leader is the most central member: the one whose buckets hold the most members.
In a group of edited copies that is the text the copies have in common with most others
(an edit moves a copy out of some full buckets), so copies that are linked only through
the original are still joined to it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import connected_components

#: Leaders of a bucket in the rounds after the first.
LEADERS = 8
#: Members of a bucket that one task pairs with so many others.
BLOCK = 256


def shared_buckets(keys: DataFrame) -> DataFrame:
    """``(key, node, ...)`` -> the rows of keys with two members or more, plus ``members``.
    Counts are pre-aggregated and materialised, so the join has two plain sides and a hot
    key is split by adaptive execution."""
    n = cut(keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    return keys.join(n, "key")


def star_links(members: DataFrame, verify: Callable[[DataFrame], DataFrame],
               finish: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """``members``: materialised ``(key, node, members)``; ``verify``: ``(a, b)`` with a < b ->
    the rows that are links. Returns the links and ``(node, root)`` of the linked nodes.

    With ``finish`` the search ends after the first round: it gets ``(key, node)`` of the buckets that
    still hold several components and returns ``(a, b)`` that connect what their links connect,
    without a row for every pair."""
    rank = members.groupBy("node").agg(F.sum("members").alias("rank"))
    m = cut(members.select("key", "node").join(rank, "node"))
    links = tested = roots = None
    turn = 0
    while True:
        labelled, orders, last = m.withColumn("label", F.col("node")), [F.lit(0)], False
        if turn:
            if roots is not None:
                labelled = m.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
            # pairs in different components: (members ** 2 - sum of (members of a component) ** 2) / 2
            n = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
            active = cut(n.groupBy("key").agg(F.sum("n").alias("size"), F.sum(F.col("n") * F.col("n")).alias("within"))
                         .where("size * size > within"))
            size, left = active.agg(F.sum("size"), F.sum((F.col("size").cast("double") ** 2 - F.col("within")) / 2)).first()
            if size is None:
                break
            last = finish is not None or left <= LEADERS * size or not found
            labelled = labelled.join(active.select("key", "size"), "key")
            labelled = cut(labelled)
            if finish is not None:
                new = finish(labelled.select("key", "node"))
                links = links.unionByName(new)
                roots = cut(connected_components(links))
                break
            orders = [F.xxhash64(F.lit(turn * LEADERS + i), "label") for i in range(LEADERS)]
        pairs = all_pairs(labelled) if last else star_pairs(labelled, orders)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = cut(pairs)
        new = cut(verify(pairs).select("a", "b").distinct())
        found = new.limit(1).count() > 0
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = new if links is None else links.unionByName(new)
        if found:
            roots = cut(connected_components(links))
        if last:
            break
        turn += 1
    if roots is None:
        roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return links, roots


def star_pairs(labelled: DataFrame, orders: list) -> DataFrame:
    """Pairs of a leader (the first of its bucket in an order) and a member of another component."""
    chosen = labelled.groupBy("key").agg(F.array_distinct(F.array(*[F.min(F.struct(
        o.alias("o"), (-F.col("rank")).alias("r"), "node", "label")) for o in orders])).alias("l"))
    leaders = cut(chosen.select("key", F.explode("l").alias("l"))
                  .select("key", F.col("l.node").alias("leader"), F.col("l.label").alias("leader_label")).distinct())
    return (labelled.join(leaders, "key").where("label <> leader_label")
            .select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct())


def all_pairs(labelled: DataFrame) -> DataFrame:
    """All pairs of members of a bucket in different components. A bucket is dealt into blocks,
    and each two blocks (or one with itself) are joined by a key of their own."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    d = labelled.select("key", "node", "label", blocks.alias("blocks"),
                        F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"))
    one = d.select("key", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"),
                   F.col("node").alias("x"), F.col("label").alias("lx"))
    two = d.select("key", F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"),
                   F.col("node").alias("y"), F.col("label").alias("ly"))
    return (one.join(two, ["key", "i", "j"]).where("lx <> ly and (i < j or x < y)")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
