"""Connected components of an edge table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise


def _settled(edges: DataFrame) -> bool:
    """Whether each node with an edge to a smaller one has no other edge: all components are stars."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("v", F.lit(0), F.lit(1)))
    tied = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).filter("up > 0 AND up + down > 1")
    return not tied.limit(1).count()


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component) for every node of `edges` (u, v); component is the smallest node.

    Large-star and small-star steps in turn: every node hands its smallest neighbour to its
    larger neighbours, then to the smaller ones, until every edge points to the smallest node
    of its component. The number of rounds grows with the logarithm of the longest path. A
    hub only meets partial minima and a join that Spark may split. Nulls and loops are ignored.
    """
    edges = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                        .filter("u > v").distinct(), "edges")
    for _ in range(max_rounds):
        if _settled(edges):
            break
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        large = materialise(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = materialise(small.filter("u > v").distinct(), "small-star")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .union(edges.select("v", "v")).distinct())
