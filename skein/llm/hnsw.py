"""Approximate nearest neighbours: a navigable small-world graph per shard, in flat arrays.

Vectors are dealt to shards by a hash: as many as there are tasks, but of no more than SHARD
vectors, and of SMALL at least. Each shard builds a hierarchy of graphs and stores it as a row: the
vectors, the level of each, and the neighbours of all levels in one flat array with offsets. For a
search, queries travel to the shards, in blocks; a task reads one graph and streams its blocks past
it. If there are fewer shards than tasks, several tasks share out the blocks of a shard. The
shards' nearest are merged to the nearest of all by exact distance.

Equal vectors are one entry with the smallest ids that a result can need, so that large groups
of copies neither crowd a graph nor a task.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take
no part, nor do rows without vec_id; nor vectors whose length differs from the most common one
(the smaller, if tied). Ties in distance go to the smaller vec_id. Rows that repeat an id with
the same vector count once. With fewer candidates than asked for, all reachable ones come back.
Columns other than the id and the vector aren't read; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.llm.common import saved, sorted_groups, table

SHARD, SMALL = 100_000, 4096
QUERY_BLOCK = 1024
#: Links of an entry on a level (twice that on the lowest), and candidates kept while building and searching.
LINKS, BUILD, SEARCH = 16, 64, 96
SEED = 5
INDEX = "shard int, n int, dim int, ids array<array<bigint>>, vectors binary, levels binary, offsets binary, neighbours binary"


class Graph:
    """A hierarchy of graphs over the rows of a matrix."""

    def __init__(self, vectors: np.ndarray, links: int = LINKS, build: int = BUILD) -> None:
        self.x = np.ascontiguousarray(vectors, np.float32)
        self.square = np.einsum("ij,ij->i", self.x, self.x)
        self.links, self.build = links, build
        rng = np.random.Generator(np.random.PCG64(SEED))
        n = len(self.x)
        self.level = np.minimum((-np.log(1 - rng.random(n)) / np.log(links)).astype(np.int32), 12) if n else np.zeros(0, np.int32)
        self.near: list[list[np.ndarray]] = [[np.zeros(0, np.int32)] * (int(v) + 1) for v in self.level]
        self.entry, self.top = -1, -1
        self.seen, self.round = np.zeros(n, np.int64), 0
        for i in range(n):
            self.insert(i)

    def gaps(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Squared distances, up to the query's own square."""
        return self.square[at] - 2 * (self.x[at] @ q)

    def descend(self, q: np.ndarray, level: int) -> int:
        """The nearest entry found greedily from the top to just above a level."""
        at = self.entry
        gap = float(self.square[at] - 2 * (self.x[at] @ q))
        for v in range(self.top, level, -1):
            while len(near := self.near[at][v]):
                g = self.gaps(q, near)
                k = int(g.argmin())
                if g[k] >= gap:
                    break
                at, gap = int(near[k]), float(g[k])
        return at

    def search(self, q: np.ndarray, start: int, level: int, width: int) -> list[tuple[float, int]]:
        """The nearest entries of a level by best-first search, at most `width`, nearest first."""
        self.round += 1
        seen, tag = self.seen, self.round
        gap = float(self.square[start] - 2 * (self.x[start] @ q))
        seen[start] = tag
        todo, best = [(gap, start)], [(-gap, start)]
        while todo:
            gap, at = heapq.heappop(todo)
            if gap > -best[0][0] and len(best) >= width:
                break
            near = self.near[at][level]
            near = near[seen[near] != tag]
            if not len(near):
                continue
            seen[near] = tag
            g = self.gaps(q, near)
            if len(best) >= width:
                close = g < -best[0][0]
                near, g = near[close], g[close]
            for d, k in zip(g.tolist(), near.tolist()):
                if len(best) < width:
                    heapq.heappush(best, (-d, k))
                elif d < -best[0][0]:
                    heapq.heapreplace(best, (-d, k))
                else:
                    continue
                heapq.heappush(todo, (d, k))
        return sorted((-d, k) for d, k in best)

    def chosen(self, found: list[tuple[float, int]], most: int) -> np.ndarray:
        """Of the entries found, those nearer to the new one than to any chosen before; then the nearest others."""
        at = np.array([k for _, k in found], np.int32)
        if len(at) <= most:
            return at
        between = self.square[at][:, None] + self.square[at][None, :] - 2 * (self.x[at] @ self.x[at].T)
        own = np.array([d for d, _ in found])  # up to the new entry's square, added below
        own = own + self.own_square
        keep: list[int] = []
        least = np.full(len(at), np.inf, np.float32)
        for i in range(len(at)):
            if own[i] < least[i]:
                keep.append(i)
                if len(keep) == most:
                    break
                least = np.minimum(least, between[i])
        if len(keep) < most:
            rest = [i for i in range(len(at)) if i not in set(keep)]
            keep += rest[: most - len(keep)]
        return at[keep]

    def insert(self, i: int) -> None:
        level = int(self.level[i])
        if self.entry < 0:
            self.entry, self.top = i, level
            return
        q = self.x[i]
        self.own_square = self.square[i]
        at = self.descend(q, level)
        for v in range(min(level, self.top), -1, -1):
            found = self.search(q, at, v, self.build)
            at = found[0][1]
            most = self.links * (2 if v == 0 else 1)
            self.near[i][v] = chosen = self.chosen(found, self.links)
            for k in chosen.tolist():
                near = np.append(self.near[k][v], np.int32(i))
                if len(near) > most:
                    g = self.gaps(self.x[k], near)
                    order = np.argsort(g, kind="stable")
                    self.own_square = self.square[k]
                    near = self.chosen(list(zip(g[order].tolist(), near[order].tolist())), most)
                    self.own_square = self.square[i]
                self.near[k][v] = near
        if level > self.top:
            self.entry, self.top = i, level

    def nearest(self, q: np.ndarray, width: int) -> list[int]:
        if self.entry < 0:
            return []
        return [k for _, k in self.search(q, self.descend(q, 0), 0, width)]

    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Levels, offsets of each entry's lists, from level 0 up, and all lists one after another."""
        lists = [a for near in self.near for a in near]
        return self.level, np.concatenate([[0], np.cumsum([len(a) for a in lists])]).astype(np.int64), np.concatenate([*lists, np.zeros(0, np.int32)]).astype(np.int32)

    @classmethod
    def from_flat(cls, vectors: np.ndarray, level: np.ndarray, offsets: np.ndarray, neighbours: np.ndarray) -> Graph:
        self = cls(vectors[:0])
        self.x = vectors
        self.square = np.einsum("ij,ij->i", vectors, vectors)
        self.level = level
        self.seen = np.zeros(len(level), np.int64)
        lists = [neighbours[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        start = np.concatenate([[0], np.cumsum(level + 1)]).tolist()
        self.near = [lists[a:b] for a, b in zip(start[:-1], start[1:])]
        if len(level):
            self.top = int(level.max())
            self.entry = int(np.flatnonzero(level == self.top)[0])
        return self


def usable(v: Column) -> Column:
    """Neither null, empty nor zero, and all components finite numbers."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def clean(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id and v (array of double) of the vectors that take part."""
    v = F.col(vector_column).cast("array<double>")
    own = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    size = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").select("n").first()
    return own.where(F.size("v") == (size["n"] if size else 0))


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def build_index(own: DataFrame, keep: int, shard: int | None = None) -> DataFrame:
    """A row for each shard (INDEX). own: id, v; keep: ids that are kept of equal vectors; shard:
    vectors of a shard, if they aren't to follow from the number of tasks."""
    rank = Window.partitionBy("v").orderBy("id")
    single = own.select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v")).distinct()  # repeats must not use up places
    few = single.withColumn("k", F.row_number().over(rank)).where(F.col("k") <= keep)
    entries = few.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    entries = saved(entries)
    n = entries.count()
    shards = max(1, -(-n // (shard or min(SHARD, max(SMALL, -(-n // tasks(own.sparkSession)))))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["shard"]):
            number = group.column("shard").to_numpy()
            for s in np.unique(number):
                part = group.filter(pa.array(number == s))
                ids = part.column("ids").to_pylist()
                x = np.array(part.column("v").to_pylist(), np.float64)
                order = np.argsort([i[0] for i in ids], kind="stable")  # whatever order the rows come in
                x, ids = x[order], [ids[i] for i in order]
                level, offsets, neighbours = Graph(x).flat()
                cells = [[int(s)], [len(x)], [x.shape[1]], [ids], [x.tobytes()], [level.tobytes()], [offsets.tobytes()], [neighbours.tobytes()]]
                types = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.list_(pa.int64())), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types)], names=["shard", "n", "dim", "ids", "vectors", "levels", "offsets", "neighbours"])

    dealt = entries.select(F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), "ids", "v")
    return saved(dealt.repartitionById(shards, "shard").sortWithinPartitions("shard").mapInArrow(run, INDEX))


def search(index: DataFrame, queries: DataFrame, k: int = 10, width: int = SEARCH) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the nearest found. queries: id, v."""
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = None
        for row in (r for batch in batches for r in batch.to_pylist()):
            if row["queries"] is not None and graph is None:
                continue  # an empty index
            if row["queries"] is None:  # a shard stands before its queries
                x = np.frombuffer(row["vectors"], np.float64).reshape(row["n"], row["dim"])
                graph = Graph.from_flat(x.astype(np.float32), np.frombuffer(row["levels"], np.int32), np.frombuffer(row["offsets"], np.int64), np.frombuffer(row["neighbours"], np.int32))
                ids = row["ids"]
                continue
            q, v, d = [], [], []
            for query in row["queries"]:
                own = np.array(query["v"], np.float64)
                if len(own) != x.shape[1]:
                    continue
                found = graph.nearest(own.astype(np.float32), width)
                gap = np.sqrt(((x[found] - own) ** 2).sum(axis=1))
                pairs = sorted((g, i) for g, at in zip(gap.tolist(), found) for i in ids[at] if i != query["id"])[:k]
                q += [query["id"]] * len(pairs)
                d += [g for g, _ in pairs]
                v += [i for _, i in pairs]
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(d, pa.float64())], schema=out)

    blocks_n = max(1, -(-queries.count() // QUERY_BLOCK))
    shards = max(1, index.select("shard").count())
    parts = min(blocks_n, max(1, tasks(index.sparkSession) // shards))  # tasks that share a shard
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    graphs = index.withColumns({"part": numbers(parts), "block": F.lit(-1), "queries": F.lit(None).cast("array<struct<id: bigint, v: array<double>>>")})
    blocks = queries.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks_n)).cast("int").alias("block")).agg(F.collect_list(F.struct("id", "v")).alias("queries"))
    sent = blocks.withColumn("shard", numbers(shards)).withColumn("part", F.pmod("block", F.lit(parts)))
    both = graphs.unionByName(sent, allowMissingColumns=True).withColumn("slot", F.col("shard") * parts + F.col("part"))
    found = both.repartitionById(shards * parts, "slot").sortWithinPartitions("slot", "block").mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = clean(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    index = build_index(own, keep=11)
    return search(index, own.where("id % 100 = 0").distinct(), 10)
