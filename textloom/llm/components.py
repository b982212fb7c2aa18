"""Distributed connected components over an edge table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import common
from textloom.llm.common import cut, looked_up
from textloom.operators.numbering import stored


def flat(pointers: DataFrame) -> DataFrame:
    """``pointers`` (``node`` to a smaller ``to``) followed to the end, by doubling.

    Only nodes that are pointed to, and point on, are doubled, and they alone are the table of the lookup: most nodes are
    leaves, whose pointers the driver would have to broadcast again in every step.
    """
    pointers = cut(pointers)
    inner = cut(pointers.join(pointers.select(F.col("to").alias("node")).distinct(), "node", "left_semi"))
    n = inner.limit(common.FEW + 1).count()
    if n == 0:
        return pointers

    def followed(some: DataFrame) -> DataFrame:
        # The members of a star point to one node.
        return stored(looked_up(some, inner.select(F.col("node").alias("to"), F.col("to").alias("up")), ["to"], "left", n=n), "pointers")

    while not (looked := followed(inner)).filter("up IS NOT NULL").isEmpty():
        inner = looked.select("node", F.coalesce("up", "to").alias("to"))
    return followed(pointers).select("node", F.coalesce("up", "to").alias("to"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``root`` for every node of ``edges``: root is the smallest node that links reach from it.

    Each round hooks every node onto its smallest neighbour (a minimum, so a hub is combined before the shuffle),
    makes the pointers flat by doubling, and replaces the edges by the distinct edges between what remains. A node goes
    as soon as it has a smaller neighbour. What a round joins is stored as a table: a checkpoint keeps its plan's estimated
    size, the product of the joined sizes, whose digits double with each doubling until the driver has room for nothing else.
    Loops, repeated edges and nulls add nothing. No edges give no rows.
    """
    left = stored(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b").distinct(), "edges")
    nodes = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
    rounds = []
    while not left.isEmpty():
        parents = flat(left.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to")))
        rounds.append(parents)
        moved = left
        for end in ("a", "b"):
            ends = parents.select(F.col("node").alias(end), F.col("to").alias("to"))
            moved = moved.join(ends, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        left = stored(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")

    def step(found: DataFrame, parents: DataFrame) -> DataFrame:
        up = parents.select(F.col("node").alias("root"), "to")
        return found.join(up, "root", "left").select("node", F.coalesce("to", "root").alias("root"))

    return cut(reduce(step, rounds, nodes.select("node", F.col("node").alias("root"))))
