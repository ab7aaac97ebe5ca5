"""A property graph over DataFrames: one frame of typed columns for each vertex and edge label.

Vertex frames have a column id, edge frames id, src and dst; all other columns are properties. A
property of list or set cardinality is an array column. Frames stay lazy: what a traversal
doesn't read is never scanned, since Spark prunes columns and pushes filters into the sources.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EDGE_KEYS = ("id", "src", "dst", "label")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def numeric_id(text: Column) -> Column:
    """The long that a text stands for as an id: optional sign, ASCII digits, within 64 bits; else null."""
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))


def id_key(text: Column) -> Column:
    """The long under which an id given as text is kept: its number, or a hash of any other text."""
    return F.when(text.isNotNull(), F.coalesce(numeric_id(text), F.xxhash64(text)))


def key_of(i) -> int | Column:
    """The same for an id given to a step."""
    if isinstance(i, int) and -(1 << 63) <= i < 1 << 63:
        return i
    return id_key(F.lit(str(i)))


@dataclass(frozen=True)
class PropertyGraph:
    """Frames by label. ends: for an edge label, the labels of its sources and its targets."""

    spark: SparkSession
    vertices: dict[str, DataFrame]
    edges: dict[str, DataFrame] = field(default_factory=dict)
    ends: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = field(default_factory=dict)

    # --- frames ---

    def vertex_frame(self, labels: Iterable[str] | None = None) -> DataFrame:
        """id, label and the properties of the vertices of some labels (all: None)."""
        names = [x for x in self.vertices if labels is None or x in set(labels)]
        if not names:
            return self.spark.createDataFrame([], "id long, label string")
        return union_all([_common(self.vertices[x].withColumn("label", F.lit(x)), self._widened(self.vertices, names)) for x in names])

    def edge_frame(self, labels: Iterable[str] | None = None) -> DataFrame:
        """id, src, dst, label and the properties of the edges of some labels (all: None)."""
        names = [x for x in self.edges if not labels or x in set(labels)]
        if not names:
            return self.spark.createDataFrame([], "id long, src long, dst long, label string")
        return union_all([_common(self.edges[x].withColumn("label", F.lit(x)), self._widened(self.edges, names)) for x in names])

    @staticmethod
    def _widened(frames: dict[str, DataFrame], names: list[str]) -> dict[str, str]:
        """Columns whose types differ between labels: numbers become double, all else string."""
        kinds: dict[str, set[str]] = {}
        for x in names:
            for c, t in frames[x].dtypes:
                kinds.setdefault(c, set()).add(t)
        number = {"tinyint", "smallint", "int", "bigint", "float", "double"}
        whole = number - {"float", "double"}
        return {c: "bigint" if t <= whole else "double" if t <= number else "string" for c, t in kinds.items() if len(t) > 1}

    def end_labels(self, labels: Iterable[str], out: bool) -> tuple[str, ...] | None:
        """Labels that vertices at an end of such edges can have; None if they aren't known."""
        names = [x for x in self.edges if not labels or x in set(labels)]
        if any(x not in self.ends for x in names):
            return None
        return tuple(dict.fromkeys(v for x in names for v in self.ends[x][0 if out else 1]))

    # --- starts ---

    def V(self, *ids, labels: Iterable[str] | None = None):
        """All vertices, or those of the given ids, numbers or texts. V(None) has no result."""
        from skein.operators.traversal import Traversal

        frame = self.vertex_frame(labels)
        if ids:
            frame = frame.where(F.col("id").isin([key_of(i) for i in ids if i is not None]))
        return Traversal(self, frame, "vertex", labels=tuple(labels) if labels else None, loaded=True)

    def E(self, *ids, labels: Iterable[str] | None = None):
        """All edges, or those of the given ids."""
        from skein.operators.traversal import Traversal

        frame = self.edge_frame(labels)
        if ids:
            frame = frame.where(F.col("id").isin([key_of(i) for i in ids if i is not None]))
        return Traversal(self, frame, "edge", labels=tuple(labels) if labels else None, loaded=True)

    def inject(self, *values):
        """A stream of given values."""
        from skein.operators.traversal import Traversal

        return Traversal(self, self.spark.createDataFrame([(v,) for v in values], ["value"]), "value", loaded=True)

    # --- views and changes; a graph isn't altered, each gives a new one ---

    def filtered(self, vertices: Callable[[DataFrame, str], DataFrame] | None = None, edges: Callable[[DataFrame, str], DataFrame] | None = None) -> PropertyGraph:
        """The graph of the vertices and edges that filters keep; edges that lose an end go too."""
        v = {k: vertices(f, k) for k, f in self.vertices.items()} if vertices else dict(self.vertices)
        e = {k: edges(f, k) for k, f in self.edges.items()} if edges else dict(self.edges)
        if vertices:
            ids = union_all([f.select("id") for f in v.values()]).distinct()
            for end in ("src", "dst"):
                e = {k: f.join(ids.withColumnRenamed("id", end), end, "left_semi") for k, f in e.items()}
        return replace(self, vertices=v, edges={k: f.select("id", "src", "dst", *(c for c in f.columns if c not in EDGE_KEYS)) for k, f in e.items()})

    def live(self, now: Column, ttl: str = "ttl") -> PropertyGraph:
        """Without what has expired: an element counts if its ttl is later than now, or missing."""
        keep = lambda f, _: f.where(F.col(ttl).isNull() | (F.col(ttl) > now)) if ttl in f.columns else f
        return self.filtered(keep, keep)

    def drop_vertices(self, ids: DataFrame) -> PropertyGraph:
        """Without the vertices of a frame with a column id, and without their edges."""
        ids = ids.select("id").distinct()
        e = self.edges
        for end in ("src", "dst"):
            e = {k: f.join(ids.withColumnRenamed("id", end), end, "left_anti") for k, f in e.items()}
        return replace(self, vertices={k: f.join(ids, "id", "left_anti") for k, f in self.vertices.items()}, edges=e)

    def drop_edges(self, ids: DataFrame) -> PropertyGraph:
        ids = ids.select("id").distinct()
        return replace(self, edges={k: f.join(ids, "id", "left_anti") for k, f in self.edges.items()})

    def add_vertices(self, label: str, frame: DataFrame) -> PropertyGraph:
        old = self.vertices.get(label)
        return replace(self, vertices=self.vertices | {label: frame if old is None else old.unionByName(frame, allowMissingColumns=True)})

    def add_edges(self, label: str, frame: DataFrame, ends=None) -> PropertyGraph:
        old = self.edges.get(label)
        return replace(self, edges=self.edges | {label: frame if old is None else old.unionByName(frame, allowMissingColumns=True)}, ends=self.ends | ({label: ends} if ends else {}))

    def merge_vertices(self, label: str, rows: DataFrame, keys: list[str], on_create: dict[str, Column] | None = None, on_match: dict[str, Column] | None = None) -> PropertyGraph:
        """Upsert: vertices equal in the keys are updated by on_match, all of them; rows without
        such a vertex are created, with the values of on_create besides. rows: id and keys."""
        old, wanted = self.vertices[label], rows.dropDuplicates(keys)
        hit = old.join(wanted.select(*keys).withColumn("_hit", F.lit(True)), keys, "left")
        changed = hit.select("id", *(F.when(F.col("_hit"), (on_match or {})[c]).otherwise(F.col(c)).alias(c) if c in (on_match or {}) else F.col(c) for c in old.columns if c != "id"))
        new = wanted.join(old.select(*keys), keys, "left_anti")
        for c, value in (on_create or {}).items():
            new = new.withColumn(c, value)
        return replace(self, vertices=self.vertices | {label: changed.unionByName(new, allowMissingColumns=True)})

    def merge_edges(self, label: str, rows: DataFrame, on_create: dict[str, Column] | None = None, on_match: dict[str, Column] | None = None) -> PropertyGraph:
        """Upsert of edges by their two ends. rows: src and dst."""
        old, keys = self.edges[label], ["src", "dst"]
        wanted = rows.select(*keys).distinct()
        hit = old.join(wanted.withColumn("_hit", F.lit(True)), keys, "left")
        changed = hit.select("id", "src", "dst", *(F.when(F.col("_hit"), (on_match or {})[c]).otherwise(F.col(c)).alias(c) if c in (on_match or {}) else F.col(c) for c in old.columns if c not in EDGE_KEYS))
        new = wanted.join(old.select(*keys), keys, "left_anti").withColumn("id", F.xxhash64(F.lit(label), "src", "dst"))
        for c, value in (on_create or {}).items():
            new = new.withColumn(c, value)
        return replace(self, edges=self.edges | {label: changed.unionByName(new, allowMissingColumns=True)})

    # --- facts about the graph ---

    def summary(self) -> DataFrame:
        """kind, label, number of elements and property keys, by label."""
        parts = []
        for kind, frames in (("vertex", self.vertices), ("edge", self.edges)):
            for label, f in frames.items():
                keys = sorted(c for c in f.columns if c not in EDGE_KEYS)
                parts.append(f.agg(F.count("*").alias("elements")).select(F.lit(kind).alias("kind"), F.lit(label).alias("label"), "elements", F.lit(",".join(keys)).alias("keys")))
        return union_all(parts)

    def degrees(self, direction: str = "both", labels: Iterable[str] = ()) -> DataFrame:
        """id and degree of the vertices that have such edges."""
        e = self.edge_frame(labels or None)
        ends = {"out": ["src"], "in": ["dst"], "both": ["src", "dst"]}[direction]
        return union_all([e.select(F.col(c).alias("id")) for c in ends]).groupBy("id").agg(F.count("*").alias("degree"))

    def supernodes(self, limit: int, direction: str = "both") -> DataFrame:
        """Vertices with at least so many edges: keys that a join should expect to be skewed."""
        return self.degrees(direction).where(F.col("degree") >= limit)


def _common(frame: DataFrame, types: dict[str, str]) -> DataFrame:
    return frame.withColumns({c: F.col(c).cast(t) for c, t in types.items() if c in frame.columns})
