"""Connected components of a large, sparse graph by repeated contraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.lineage import saved


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a long, b long); nodes are joined if they share a root.

    In the first round, every node moves to the smallest of itself and its neighbours, so that
    stars around their smallest node end at once. In later rounds "smallest" follows a random
    order of the round's own, by which a constant share of the nodes goes in each round, however
    long the paths. The edges are then contracted. Only the rounds' edges are kept; the roots
    follow from them backwards. A node with very many edges is aggregated map-side.
    """
    # the round stands in a column rather than in the plan, so that Spark compiles a plan once
    edges = saved(edges.select("a", "b", F.lit(0).alias("round")).where("a <> b").distinct())
    parents: list[DataFrame] = []
    while not edges.isEmpty():
        order = lambda c: F.struct(F.when(F.col("round") > 0, F.xxhash64("round", c)).otherwise(0).alias("h"), c.alias("n"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "round"))
        best = both.groupBy("a", "round").agg(F.min(order(F.col("b"))).alias("m"))
        parent = best.select(F.col("a").alias("node"), F.least("m", order(F.col("a")))["n"].alias("parent"))
        parents.append(parent)
        to = lambda end: parent.select(F.col("node").alias(end), F.col("parent").alias(f"p{end}"))  # noqa: E731, B023
        moved = edges.join(to("a"), "a").join(to("b"), "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"), (F.col("round") + 1).alias("round"))
        edges = saved(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "round").distinct())
    if not parents:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))

    def back(later: DataFrame, earlier: DataFrame) -> DataFrame:
        onward = later.select(F.col("node").alias("parent"), "root")
        return earlier.join(onward, "parent", "left").select("node", F.coalesce("root", "parent").alias("root"))

    last = parents[-1].withColumnRenamed("parent", "root")
    return saved(reduce(back, parents[-2::-1], last))
