"""Iterative algorithms over a frame of edges: a few joins and aggregations a round.

Every round is cut from the lineage of those before it. Only a round's scalars (error sums,
whether anything changed) come to the driver.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.operators.components import connected_components as contracted
from skein.operators.lineage import saved


def page_rank(vertices: DataFrame, edges: DataFrame, alpha: float = 0.85, epsilon: float = 1e-5, iterations: int = 20, initial: Column | None = None) -> DataFrame:
    """id and rank. vertices: id; edges: src, dst, parallel ones count each.

    The first iteration only counts the vertices, so ranks are passed iterations - 1 times. Each
    pass gives a vertex what its in-neighbours send and an equal share of the teleported energy:
    1 - alpha of all ranks, and alpha of those of vertices without out-edges. It ends early once
    the ranks' changes sum to less than epsilon.
    """
    n = vertices.count()
    if not n:
        return vertices.select("id", F.lit(0.0).alias("rank"))
    known = vertices.select("id")
    e = edges.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    # parallel edges as one with a weight: fewer rows in each round
    e = saved(e.groupBy("src", "dst").agg(F.count("*").alias("w")))
    degree = e.groupBy("src").agg(F.sum("w").alias("degree"))
    state = vertices.select("id", (initial if initial is not None else F.lit(0.0)).cast("double").alias("rank"), F.lit(0.0).alias("sent"))
    state = saved(state.join(degree.withColumnRenamed("src", "id"), "id", "left").fillna(0, ["degree"]))
    energy = 0.0 if initial is not None else 1.0
    for k in range(iterations - 1):
        if k or initial is None:
            got = e.join(state.select(F.col("id").alias("src"), "sent"), "src").groupBy("dst").agg(F.sum(F.col("w") * F.col("sent")).alias("got"))
            own = state.join(got.withColumnRenamed("dst", "id"), "id", "left").fillna(0.0, ["got"])
            new = F.col("got") + energy / n
        else:
            own, new = state, F.col("rank") + energy / n
        own = own.select("id", "degree", F.col("rank").alias("before"), new.alias("rank"))
        state = saved(own.withColumn("sent", F.when(F.col("degree") > 0, alpha * F.col("rank") / F.col("degree")).otherwise(0.0)))
        total, sinks, error = state.agg(F.sum("rank"), F.sum(F.when(F.col("degree") == 0, F.col("rank")).otherwise(0.0)), F.sum(F.abs(F.col("rank") - F.col("before")))).first()
        energy = (1 - alpha) * total + alpha * sinks
        if error < epsilon:
            break
    return state.select("id", "rank")


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id and component: the smallest id, as text, of all vertices reached along edges in either direction.

    The edges are contracted in a random order until none is left, so the rounds grow with the
    logarithm of the vertices, however long the paths; no number of rounds is set.
    """
    known = vertices.select("id").distinct()
    e = edges.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    roots = contracted(e.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    own = saved(known.join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("root")))
    least = own.groupBy("root").agg(F.min(F.col("id").cast("string")).alias("component"))
    return own.join(least, "root").select("id", "component")


def peer_pressure(vertices: DataFrame, edges: DataFrame, iterations: int = 30, distribute: bool = False) -> DataFrame:
    """id and cluster (text): each vertex takes the cluster with the most votes, its own included.

    Votes go along out-edges with a strength of 1, or 1 over the number of in-edges if they are
    distributed. Ties go to the cluster whose text is smaller. Ends when nobody changes.
    """
    known = vertices.select("id").distinct()
    e = edges.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    e = saved(e.groupBy("src", "dst").agg(F.count("*").alias("w")))
    strength = e.groupBy("dst").agg((1 / F.sum("w")).alias("strength")).withColumnRenamed("dst", "id") if distribute else None
    state = known.withColumn("cluster", F.col("id").cast("string"))
    state = saved(state.join(strength, "id", "left").fillna(1.0, ["strength"]) if distribute else state.withColumn("strength", F.lit(1.0)))
    best = Window.partitionBy("id").orderBy(F.desc("votes"), "cluster")
    for _ in range(iterations - 1):
        sent = e.join(state.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "cluster", (F.col("w") * F.col("strength")).alias("vote"))
        votes = sent.union(state.select("id", "cluster", F.col("strength").alias("vote"))).groupBy("id", "cluster").agg(F.sum("vote").alias("votes"))
        won = votes.withColumn("r", F.row_number().over(best)).where("r = 1").select("id", F.col("cluster").alias("new"))
        state = saved(state.join(won, "id").select("id", F.col("new").alias("cluster"), "strength", (F.col("new") != F.col("cluster")).alias("changed")))
        if state.where("changed").isEmpty():
            break
        state = state.drop("changed")
    return state.select("id", "cluster")


def bfs(vertices: DataFrame, edges: DataFrame, sources: DataFrame, directed: bool = True, depth: int | None = None) -> DataFrame:
    """id and distance (hops) of all vertices reached from the sources, a frame with a column id;
    with a depth, of those at most so far away."""
    e = edges.select("src", "dst").distinct()
    e = saved(e if directed else e.union(e.select("dst", "src")).distinct())
    seen = front = saved(vertices.select("id").join(sources.select("id").distinct(), "id", "left_semi").withColumn("distance", F.lit(0)))
    for k in count(1) if depth is None else range(1, depth + 1):
        step = e.join(front.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        front = saved(step.join(seen.select("id"), "id", "left_anti").withColumn("distance", F.lit(k)))
        if front.isEmpty():
            break
        seen = saved(seen.union(front))
    return seen


def shortest_weights(edges: DataFrame, sources: DataFrame, weight: str, rounds: int | None = None) -> DataFrame:
    """id and total: the least sum of weights from the sources, by repeated relaxation; with a
    number of rounds, over at most so many edges. Edges
    without a weight take no part. A cycle whose weights sum to less than nothing is an error.
    """
    e = saved(edges.groupBy("src", "dst").agg(F.min(weight).cast("double").alias("w")).where("w is not null"))
    best = saved(sources.select("id").distinct().withColumn("total", F.lit(0.0)))
    for k in count(1) if rounds is None else range(1, rounds + 1):
        step = e.join(best.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.col("total") + F.col("w")).alias("other"))
        new = saved(best.join(step, "id", "full").select("id", F.least("total", "other").alias("total"), (F.col("total").isNull() | (F.col("other") < F.col("total"))).alias("better")))
        reached, better = new.agg(F.count("*"), F.count_if("better")).first()
        if not better:
            break
        # a way of as many edges as vertices meets one twice, and is lighter for it
        if rounds is None and k >= reached:
            raise ValueError("a cycle of negative weight can be reached")
        best = new.drop("better")
    return best.select("id", "total")
