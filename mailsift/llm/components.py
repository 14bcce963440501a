"""Connected components of a graph that is too large for one machine.

Each round maps every node to the least node (by a hash that differs from
round to round) of itself and its neighbours and contracts the graph along
that map, so a star vanishes in one round and a path loses a constant share of
its nodes. Every round is an aggregate with a map-side part and two equi-joins
whose other side has one row per node; the links stay in tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``edges`` (a long, b long) -> (node long, component long).

    component is the smallest node id reachable. Nodes without a link to
    another node don't appear. Nulls, loops and repeated links are ignored; an
    empty table gives an empty table.
    """
    spark = edges.sparkSession
    live = written(_tidy(edges), "cc-edges")
    nodes = spark.createDataFrame([], "node long, root long")
    first = True
    for turn in range(max_rounds):
        if live.isEmpty():
            break
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), c.alias("v"))
        step = (both.groupBy("a").agg(F.min(order(F.col("b"))).alias("m"))
                .select("a", F.least(F.col("m"), order(F.col("a")))["v"].alias("to")))
        step = written(step, "cc-step")
        if first:
            nodes, first = step.select(F.col("a").alias("node"), F.col("to").alias("root")), False
        else:
            moved = step.select(F.col("a").alias("root"), "to")
            nodes = nodes.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        nodes = written(nodes, "cc-nodes")
        live = (live.join(step.withColumnRenamed("to", "x"), "a")
                .join(step.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
                .select(F.col("x").alias("a"), F.col("y").alias("b")))
        live = written(_tidy(live), "cc-edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    least = nodes.groupBy("root").agg(F.min("node").alias("component"))
    return nodes.join(least, "root").select("node", "component")


def _tidy(edges: DataFrame) -> DataFrame:
    return (edges.filter(F.col("a") != F.col("b"))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
