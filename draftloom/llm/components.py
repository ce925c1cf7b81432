"""Connected components of an edge table, as DataFrame joins only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100, loops: bool = False) -> DataFrame:
    """(node, component) for every node that has an edge (with loops: also one to itself); component is its smallest node.

    The graph is contracted: each round every node goes to the first node around
    it, and edges are drawn between what their ends went to; edges within one
    node are gone.  In the first round the order is that of the ids, so stars
    around a smallest node end at once; later it is a random one of the round's
    own, so that long chains shrink by a constant share.  Where a node went is then
    followed through all rounds.  The joins are plain equi-joins whose hot keys
    AQE splits, and the minimum is combined map-side.
    """
    both = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    left = scratch.table(both.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    alone = both.where("a = b").select(F.col("a").alias("node")).distinct() if loops else None
    went: list[DataFrame] = []
    while left.limit(1).count():
        if len(went) == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        turn = len(went)

        def place(c: str, turn: int = turn) -> Column:
            return F.struct((F.xxhash64(F.col(c), F.lit(turn)) if turn else F.col(c)).alias("key"), F.col(c).alias("node"))

        ends = left.select(F.col("a").alias("node"), place("b").alias("near")).unionByName(left.select(F.col("b").alias("node"), place("a").alias("near")))
        to = scratch.table(ends.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("near", place("node"))["node"].alias("to")), f"cc-{turn}")
        drawn = left.join(to.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").join(to.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b").where("ta <> tb")
        less = scratch.table(drawn.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "cc-edges")
        scratch.drop(left)
        went.append(to)
        left = less
    if not went:
        found = left.select(F.col("a").alias("node"), F.col("a").alias("component"))
    else:
        at = went[0].select("node", F.col("to").alias("root"))
        for to in went[1:]:
            at = at.join(to.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        at = scratch.table(at, "cc-roots")
        least = at.groupBy("root").agg(F.min("node").alias("component"))
        found = scratch.table(at.join(least, "root").select("node", "component"), "cc-found")
        scratch.drop(at, *went)
    if loops:
        found = found.unionByName(alone.join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))
    return found
