"""What links reach: connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import drop_table, table


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges (a, b), by contraction: each node joins its least neighbour in an order that
    changes from step to step, until no edge is left. The result is a table; what steps leave is deleted."""
    label, turn = None, 0
    edges = table(edges.filter("a <> b"), "edges")
    while not edges.isEmpty():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("o"), F.col(c).alias("v"))  # noqa: B023, E731
        step = table(both.groupBy("a").agg(F.least(F.min(order("b")), F.first(order("a")))["v"].alias("to")), "step")
        # a chain of least neighbours is followed twice more
        hop = step.select(F.col("a").alias("to"), F.col("to").alias("next"))
        twice = step.join(hop, "to").select("a", F.col("next").alias("to"))
        far = table(twice.join(hop, "to").select(F.col("a").alias("node"), F.col("next").alias("comp")), "step")
        side = edges.join(far.select(F.col("node").alias("a"), F.col("comp").alias("x")), "a").select("b", "x")
        side = side.join(far.select(F.col("node").alias("b"), F.col("comp").alias("y")), "b")
        left = table(side.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        old = [edges, step]
        if label is None:
            label = far
        else:
            old += [label, far]
            label = table(label.join(far.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "labels")
        for done in old:
            drop_table(done)
        edges, turn = left, turn + 1
    if label is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    drop_table(edges)
    return label
