"""CSV files of vertices and edges with typed headers, read as DataFrames and validated.

A header is `name[:type[:cardinality]]`, or one of ~id, ~label, ~from, ~to. Lists are parted by
`;`. An empty cell is absent, and so is the null token. A value that its type can't hold makes
the row a bad entry: it is reported and left out.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.graph import PropertyGraph, id_key, union_all

#: Fixed values of the header grammar.
TYPES = {"long": "bigint", "int": "int", "integer": "int", "double": "double", "bool": "boolean", "boolean": "boolean", "string": "string", "date": "timestamp", "offsetdatetime": "timestamp"}
CARDINALITIES = ("single", "list", "set")
SYSTEM = ("~id", "~label", "~from", "~to")
DATE_PATTERNS = ("yyyy-MM-dd'T'HH:mm:ss[.SSS][XXX]", "yyyy-MM-dd HH:mm:ss[.SSS]", "yyyy-MM-dd", "yyyy-MM")


@dataclass(frozen=True)
class Header:
    column: str
    name: str
    type: str = "string"
    cardinality: str = "single"


def parse_header(column: str) -> Header:
    """The last two colons part name, type and cardinality."""
    parts = column.rsplit(":", 2)
    lower = [p.strip().lower() for p in parts]
    if len(parts) == 1:
        return Header(column, column)
    if len(parts) == 3 and lower[1] in TYPES:
        if lower[2] not in CARDINALITIES:
            raise ValueError(f"unknown cardinality in header {column}")
        return Header(column, parts[0], TYPES[lower[1]], lower[2])
    name, kind = column.rsplit(":", 1)
    if kind.strip().lower() not in TYPES:
        raise ValueError(f"unknown type in header {column}")
    return Header(column, name, TYPES[kind.strip().lower()])


def _cast(c: Column, kind: str) -> Column:
    """Null for a text that the type can't hold."""
    if kind == "string":
        return c
    c = F.trim(c)
    if kind == "boolean":
        return F.when(F.lower(c) == "true", True).when(F.lower(c) == "false", False)
    if kind == "timestamp":
        return F.coalesce(*(F.try_to_timestamp(c, F.lit(p)) for p in DATE_PATTERNS))
    return F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast(kind)) if kind in ("int", "bigint") else c.try_cast(kind)


def _value(h: Header, null_token: str) -> tuple[Column, Column]:
    """The typed value, and whether the cell is bad."""
    raw = F.col(f"`{h.column}`")
    raw = F.when((raw != "") & (raw != null_token), raw)
    if h.cardinality == "single":
        value = _cast(raw, h.type)
        return value, raw.isNotNull() & value.isNull()
    items = F.filter(F.split(raw, ";"), lambda x: (x != "") & (x != null_token))
    values = F.transform(items, lambda x: _cast(x, h.type))
    bad = F.coalesce(F.exists(values, lambda x: x.isNull()), F.lit(False))
    return F.array_distinct(values) if h.cardinality == "set" else values, bad


@dataclass(frozen=True)
class Loaded:
    """good: typed rows with id, label and, for edges, src and dst. bad: the rows left out, as read."""

    good: DataFrame
    bad: DataFrame


def _read(spark: SparkSession, paths: list[str], edges: bool, null_token: str) -> Loaded:
    good, bad = [], []
    for path in paths:
        raw = spark.read.option("header", True).option("recursiveFileLookup", True).option("escape", '"').csv(path)
        raw = raw.select(*(F.col(f"`{c}`").alias(c.strip()) for c in raw.columns))
        headers = [parse_header(c) for c in raw.columns if c not in SYSTEM]
        if edges and any(h.cardinality == "set" for h in headers):
            raise ValueError("edges have no set cardinality")
        named = lambda c, default: F.coalesce(F.when(F.trim(f"`{c}`") != "", F.col(f"`{c}`")), default) if c in raw.columns else default  # noqa: E731, B023
        values = {h: _value(h, null_token) for h in headers}
        ends = ["~from", "~to"] if edges else ["~id"]
        missing = reduce(lambda a, b: a | b, [named(c, F.lit(None).cast("string")).isNull() for c in ends])
        wrong = reduce(lambda a, b: a | b, [b for _, b in values.values()], missing)
        key = lambda c: id_key(F.col(f"`{c}`"))
        label = named("~label", F.lit("edge" if edges else "vertex")).alias("label")
        columns = [v.alias(h.name) for h, (v, _) in values.items()]
        flagged = raw.withColumn("~bad", wrong)
        if edges:
            own = key("~id") if "~id" in raw.columns else F.lit(None).cast("long")
            made = F.xxhash64(label, "`~from`", "`~to`", *(f"`{h.column}`" for h in headers))
            rows = flagged.where("not `~bad`").select(F.coalesce(own, made).alias("id"), label, key("~from").alias("src"), key("~to").alias("dst"), *columns)
        else:
            rows = flagged.where("not `~bad`").select(key("~id").alias("id"), label, F.col("`~id`").alias("id_text"), *columns)
        good.append(rows)
        bad.append(flagged.where("`~bad`").select(F.lit(path).alias("path"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in raw.columns))).alias("row")))
    return Loaded(union_all(good), union_all(bad))


def read_vertices(spark: SparkSession, paths: list[str], null_token: str = "null") -> Loaded:
    """One path for each header; a path may be a folder of files with the same header."""
    return _read(spark, paths, False, null_token)


def read_edges(spark: SparkSession, paths: list[str], null_token: str = "null") -> Loaded:
    return _read(spark, paths, True, null_token)


def duplicate_ids(vertices: DataFrame) -> DataFrame:
    """id and surplus: how many rows an id has beyond its first."""
    return vertices.groupBy("id").agg((F.count("*") - 1).alias("surplus")).where("surplus > 0")


def dangling_edges(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """The edges of which an end is no vertex."""
    ids = vertices.select("id").distinct()
    no_src = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti")
    no_dst = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return no_src.unionByName(no_dst)


def load(spark: SparkSession, vertex_paths: list[str], edge_paths: list[str], bad_entries: int = 0, bad_edges: int = 0, duplicates: int = 0) -> PropertyGraph:
    """The graph of the files; an error if there are more faults than allowed. Of repeated ids one
    stays. An id as it was written is the property id_text; V("text") finds it."""
    v, e = read_vertices(spark, vertex_paths), read_edges(spark, edge_paths)
    faults = {"bad entries": (v.bad.count() + e.bad.count(), bad_entries), "duplicate ids": (duplicate_ids(v.good).agg(F.coalesce(F.sum("surplus"), F.lit(0))).first()[0], duplicates), "edges without an end": (dangling_edges(e.good, v.good).count(), bad_edges)}
    if over := {k: n for k, (n, most) in faults.items() if n > most}:
        raise ValueError(f"more faults than allowed: {over}")
    unique = v.good.dropDuplicates(["id"])
    ids = unique.select("id")
    kept = e.good.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    by_label = lambda f: {r["label"]: f.where(F.col("label") == r["label"]).drop("label") for r in f.select("label").distinct().collect()}
    return PropertyGraph(spark, by_label(unique), by_label(kept))


def adjacency(edges: DataFrame) -> DataFrame:
    """id and a map from edge label to its neighbours and edges."""
    lists = edges.groupBy("src", "label").agg(F.array_sort(F.collect_list(F.struct("dst", F.col("id").alias("edge")))).alias("to"))
    return lists.groupBy(F.col("src").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("label", "to"))).alias("neighbours"))


def verify_sample(written: DataFrame, source: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """Sampled source rows that aren't among the written ones, by id."""
    return source.sample(fraction, seed).join(written.select("id"), "id", "left_anti")
