"""Connected components by contraction, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import durable


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """For each node of `edges` (a long, b long) one node of its component, the same for all of them: node, label.

    In each round every node points to its least neighbour (or itself), and then to what that one points to. The edges
    are rewritten to these targets; loops and doubles go. Edges and nodes shrink from round to round, and their number
    of rounds grows with the logarithm of a component's width. The rounds' pointers are then followed from the last to
    the first. Each round's tables are written to the checkpoint folder, so that the joins' sides are plain tables
    whose skewed keys Spark can split.
    """
    def clean(e: DataFrame) -> DataFrame:
        return durable(e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    edges, steps = clean(edges), []
    for _ in range(rounds):
        if edges.isEmpty():
            break
        ends = edges.select(F.col("b").alias("node"), F.col("a").alias("to")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("to")))
        point = durable(ends.groupBy("node").agg(F.min("to").alias("to")))
        next_ = point.select(F.col("node").alias("n"), F.col("to").alias("t"))
        point = durable(point.join(next_, F.col("to") == F.col("n")).select("node", F.col("t").alias("to")))
        steps.append(point)
        left = point.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = point.select(F.col("node").alias("b"), F.col("to").alias("y"))
        edges = clean(edges.join(left, "a").join(right, "b").select(F.col("x").alias("a"), F.col("y").alias("b")))
    else:
        raise RuntimeError(f"edges were left after {rounds} rounds")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = steps[-1].select("node", F.col("to").alias("label"))
    for step in steps[-2::-1]:
        after = labels.select(F.col("node").alias("n"), "label")
        labels = durable(step.join(after, F.col("to") == F.col("n"), "left").select("node", F.coalesce("label", "to").alias("label")))
    return labels
