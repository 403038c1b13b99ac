"""Connected components by contraction, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideworks.llm.shared import stored


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): for each node with an edge to another, the least node of its component.

    edges: (a, b), undirected.  In a round each node takes its least neighbour if that is less than itself, and then
    what that one took; edges are renamed by it, and those within one name go.  So a round's joins have a row for each
    edge that is left, and stars are done in two rounds.  State is written to the shared folder; the driver sees
    whether edges are left.
    """
    left = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct(), "edges")
    state = None
    for _ in range(rounds):
        both = left.select(F.col("a").alias("node"), "b").union(left.select(F.col("b").alias("node"), "a"))
        taken = stored(both.groupBy("node").agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("via")), "taken")
        renamed = stored(taken.join(taken.select(F.col("node").alias("via"), F.col("via").alias("label")), "via").select("node", "label"), "renamed")
        if state is None:
            state = renamed
        else:
            further = renamed.select(F.col("node").alias("label"), F.col("label").alias("further"))
            state = stored(state.join(further, "label", "left").select("node", F.coalesce("further", "label").alias("label")), "labels")
        for end in ("a", "b"):
            left = left.join(renamed.select(F.col("node").alias(end), F.col("label").alias(f"to_{end}")), end)
        left = stored(left.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).where("a != b").distinct(), "edges")
        if left.isEmpty():
            return state
    raise RuntimeError(f"edges are left after {rounds} rounds")


def narrowed(stars: DataFrame) -> DataFrame:
    """(a, b) that connect what stars (node, leader) connect: each node to its least leader, and its other leaders to that.

    A node has as many leaders as there are places where it can meet one; most nodes of a large group have the same.
    """
    per = stars.groupBy("node").agg(F.min("leader").alias("least"), F.collect_set("leader").alias("leaders"))
    return per.select(F.col("least").alias("b"), F.explode(F.array_union(F.array("node"), F.array_remove("leaders", F.col("least")))).alias("a")).select("a", "b").distinct()
