"""Connected components of an edge table, distributed and restartable."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewheel.llm import shared


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a long, b long); the label is the least node of its component.

    Each round a node goes to the least of itself and its neighbours, by a hash of node and round, and
    the edges are drawn anew between where their ends went: nodes and edges shrink by a constant
    share a round, chains and stars alike, so all rounds together join a few times the edges.  Going back, the rounds' steps
    are put together.  Every round is a written table, so lost executors cost one round at most.  Only a count reaches the driver.
    """
    left = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = shared.materialise(left, "edges")
    steps = []
    while not steps or left.limit(1).count():
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(steps))).alias("h"), F.col(c).alias("v"))
        both = left.select("a", rank("b").alias("r")).union(left.select("b", rank("a").alias("r"))).groupBy("a").agg(F.min("r").alias("r"))
        step = shared.materialise(both.select(F.col("a").alias("node"), F.least("r", rank("a"))["v"].alias("to")), "steps")
        drawn = left.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
        drawn = drawn.join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b").filter("x <> y")
        drawn = shared.materialise(drawn.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        shared.drop_table(left)
        left = drawn
        steps.append(step)
    shared.drop_table(left)
    ends = steps[-1]
    for step in reversed(steps[:-1]):
        ends = step.join(ends.select(F.col("node").alias("to"), F.col("to").alias("end")), "to", "left").select("node", F.coalesce("end", "to").alias("to"))
    ends = shared.materialise(ends, "ends")
    for step in steps:
        shared.drop_table(step)
    named = ends.groupBy("to").agg(F.min("node").alias("label"))
    labels = shared.materialise(ends.join(named, "to").select("node", "label"), "labels")
    shared.drop_table(ends)
    return labels
