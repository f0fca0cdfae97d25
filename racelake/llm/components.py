"""Connected components of a graph given by its edges, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from racelake.sources.scratch import stable


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """`node, component` for every end of an edge `a, b`; a component is named by its smallest node.

    In every round each node hands its smallest neighbour to its larger neighbours, then to its smaller ones;
    when nothing changes, every node points at the smallest of its component. A long chain shrinks by a factor
    in every round. Edges are stored between rounds. Loops and nulls are left out.
    """
    now = stable(_downward(edges.select("a", "b")))
    state = _state(now)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least"))
        up = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.least("a", "least").alias("b"))
        least = up.groupBy("a").agg(F.min("b").alias("least"))
        down = up.join(least, "a").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        now = stable(_downward(down.unionByName(least.withColumnRenamed("least", "b"))))
        before, state = state, _state(now)
        if state == before:
            tops = now.select(F.col("b").alias("node")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                tops.select("node", F.col("node").alias("component"))
            )
    raise RuntimeError("components did not settle")


def _downward(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    hashed = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), hashed).first())
