"""Directed graphs as DataFrames of edges (source, target): reachability in bitmaps, strongly connected components.

Rounds are joins of a frontier with the edges, so each costs what is new in it; a round's result is cut, so plans stay short.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Cut = Callable[[DataFrame], DataFrame]


def trimmed(links: DataFrame, cut: Cut, least: float = 0.05) -> DataFrame:
    """Edges without those of nodes that lack a way in or a way out, again and again, as long as that takes away ``least`` of them."""
    count = links.count()
    while count:
        ends = lambda c: links.select(F.col(c).alias("n")).distinct()
        kept = cut(links.join(ends("target"), F.col("source") == F.col("n"), "left_semi").join(ends("source"), F.col("target") == F.col("n"), "left_semi"))
        left = kept.count()
        links, before, count = kept, count, left
        if before - left <= least * before:
            break
    return links


def _spread(front: DataFrame, links: DataFrame, state: DataFrame, better, cut: Cut) -> DataFrame:
    """state (n, value): carries values from front along links to a fixpoint; ``better`` is the aggregate that picks one."""
    while True:
        came = links.join(front, F.col("source") == F.col("n")).groupBy(F.col("target").alias("n")).agg(better("value").alias("came"))
        both = cut(state.join(came, "n", "left").select("n", "value", "came", (F.col("came").isNotNull() & (F.coalesce(F.greatest("came", "value"), F.col("came")) != F.coalesce("value", F.lit(-1)))).alias("moved")))
        front = both.filter("moved").select("n", F.col("came").alias("value"))
        state = both.select("n", F.when(F.col("moved"), F.col("came")).otherwise(F.col("value")).alias("value"))
        if front.isEmpty():
            return state


def components(links: DataFrame, cut: Cut) -> DataFrame:
    """node, component: the nodes of strongly connected components of two nodes or more.

    Nodes on no cycle are mostly trimmed away. Then every node takes the greatest number from which it is
    reached, its colour; a component has one colour, and the nodes of a colour that lead back to the node which gave it are one.
    The rest, without edges between colours, goes through the same again.
    """
    links = trimmed(cut(links.select("source", "target").filter("source <> target").distinct()), cut)
    names = cut(links.select(F.col("source").alias("node")).union(links.select("target")).distinct().withColumn("n", F.monotonically_increasing_id()))
    by = lambda c: names.select(F.col("n").alias(f"{c}_n"), F.col("node").alias(c))
    edges = cut(links.join(by("source"), "source").join(by("target"), "target").select(F.col("source_n").alias("source"), F.col("target_n").alias("target")))
    done = None
    while not edges.isEmpty():
        nodes = edges.select(F.col("source").alias("n")).union(edges.select("target")).distinct()
        start = cut(nodes.withColumn("value", F.col("n")))
        colour = _spread(start, edges, start, F.max, cut).withColumnRenamed("value", "colour")
        ends = edges.join(colour.select(F.col("n").alias("source"), F.col("colour").alias("a")), "source").join(colour.select(F.col("n").alias("target"), F.col("colour").alias("b")), "target")
        inside = cut(ends.filter("a = b").select("source", "target"))
        roots = colour.filter("n = colour").select("n", F.lit(1).cast("long").alias("value"))
        empty = colour.select("n", F.when(F.col("n") == F.col("colour"), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("value"))
        back = inside.select(F.col("target").alias("source"), F.col("source").alias("target"))
        reached = _spread(roots, back, empty, F.max, cut).filter("value = 1").select("n")
        found = colour.join(reached, "n").select("n", F.col("colour").alias("component"))
        done = found if done is None else done.unionByName(found)
        gone = reached.select(F.col("n").alias("gone"))
        edges = trimmed(cut(inside.join(gone, F.col("source") == F.col("gone"), "left_anti").join(gone, F.col("target") == F.col("gone"), "left_anti")), cut)
    if done is None:
        return names.select("node", F.col("n").alias("component")).limit(0)
    many = Window.partitionBy("component")
    done = done.withColumn("size", F.count("*").over(many)).filter("size > 1")
    return done.join(names, "n").select("node", "component")


def reach(links: DataFrame, ends: DataFrame, cut: Cut) -> DataFrame:
    """node, block, bits: which of the ends (node) each node reaches, 64 of them a row; ends reach themselves.

    Only bits that are new at a node go on from it, so cycles end by themselves and no path is followed twice.
    """
    numbered = cut(ends.select("node").distinct().withColumn("n", F.monotonically_increasing_id()))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("n") % 64).cast("int"))
    known = front = cut(numbered.select("node", F.floor(F.col("n") / 64).alias("block"), bit.alias("bits")))
    while True:
        came = links.join(front.withColumnRenamed("node", "target"), "target").groupBy(F.col("source").alias("node"), "block").agg(F.bit_or("bits").alias("came"))
        both = cut(known.join(came, ["node", "block"], "full").select("node", "block", F.coalesce("bits", F.lit(0).cast("long")).alias("old"), F.coalesce("came", F.lit(0).cast("long")).alias("came")))
        fresh = F.col("came").bitwiseAND(F.bitwise_not("old"))
        front = both.select("node", "block", fresh.alias("bits")).filter("bits <> 0")
        known = both.select("node", "block", F.col("old").bitwiseOR(F.col("came")).alias("bits"))
        if front.isEmpty():
            return known
