"""Graphs in GraphML, in lines of GraphSON, and in Parquet folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.graph import EDGE_KEYS, PropertyGraph, id_key

NUMBERS = {"int": "int", "long": "bigint", "float": "double", "double": "double", "boolean": "boolean"}


def read_graphml(spark: SparkSession, path: str, vertex_label: str = "labelV", edge_label: str = "labelE") -> PropertyGraph:
    """Nodes and edges by Spark's XML reader, typed by the file's key elements.

    The labels stand in the data of the named keys; without one it is `vertex` or `edge`.
    """
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    data = "data array<struct<_key: string, _VALUE: string>>"
    keys = read("key", "_id string, _for string, `_attr.name` string, `_attr.type` string").collect()
    kinds = {r["_id"]: (r["_attr.name"], NUMBERS.get(r["_attr.type"], "string")) for r in keys}
    pick = lambda k: F.get(F.transform(F.filter("data", lambda d: d["_key"] == k), lambda d: d["_VALUE"]), 0)

    def frames(f: DataFrame, label: str, default: str, kind: str) -> dict[str, DataFrame]:
        own = [(r["_id"], *kinds[r["_id"]]) for r in keys if r["_for"] in (kind, "all") and r["_id"] != label]
        f = f.withColumn("label", F.coalesce(pick(label), F.lit(default)))
        head = [c for c in ("id", "src", "dst") if c in f.columns]
        typed = f.select(*head, "label", *(pick(k).try_cast(t).alias(name) for k, name, t in own))
        out = {}
        for r in typed.select("label").distinct().collect():
            part = typed.where(F.col("label") == r["label"]).drop("label")
            held = part.agg(*(F.count(c).alias(c) for c in part.columns)).first()
            out[r["label"]] = part.select(*(c for c in part.columns if c in head or held[c]))
        return out

    nodes = read("node", f"_id string, {data}").select(id_key(F.col("_id")).alias("id"), "data")
    edges = read("edge", f"_id string, _source string, _target string, {data}").select(id_key(F.col("_id")).alias("id"), id_key(F.col("_source")).alias("src"), id_key(F.col("_target")).alias("dst"), "data")
    return PropertyGraph(spark, frames(nodes, vertex_label, "vertex", "node"), frames(edges, edge_label, "edge", "edge"))


def write_graphson(graph: PropertyGraph, path: str) -> None:
    """A line of JSON for each vertex: id, label, properties as texts, and its out-edges."""
    v = graph.vertex_frame()
    text = lambda cols: F.map_filter(F.map_from_arrays(F.array(*(F.lit(c) for c in cols)), F.array(*(F.col(c).cast("string") for c in cols))), lambda _, x: x.isNotNull()) if cols else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    e = graph.edge_frame()
    out = e.select("src", F.struct("id", "label", F.col("dst").alias("inV"), text([c for c in e.columns if c not in EDGE_KEYS]).alias("properties")).alias("e"))
    out = out.groupBy(F.col("src").alias("id")).agg(F.collect_list("e").alias("outE"))
    v.select("id", "label", text([c for c in v.columns if c not in ("id", "label")]).alias("properties")).join(out, "id", "left").write.mode("overwrite").json(path)


def read_graphson(spark: SparkSession, path: str) -> PropertyGraph:
    """What write_graphson writes; properties come back as texts."""
    props = "properties map<string, string>"
    rows = spark.read.schema(f"id long, label string, {props}, outE array<struct<id: long, label: string, inV: long, {props.replace(' ', ': ', 1)}>>").json(path)

    def frames(f: DataFrame, head: list[str]) -> dict[str, DataFrame]:
        names = {r["label"]: sorted(r["k"]) for r in f.groupBy("label").agg(F.array_distinct(F.flatten(F.collect_list(F.coalesce(F.map_keys("properties"), F.array().cast("array<string>"))))).alias("k")).collect()}
        return {k: f.where(F.col("label") == k).select(*head, *(F.col("properties")[n].alias(n) for n in ns)) for k, ns in names.items()}

    edges = rows.select(F.col("id").alias("src"), F.explode("outE").alias("e")).select("e.id", "src", F.col("e.inV").alias("dst"), "e.label", "e.properties")
    return PropertyGraph(spark, frames(rows, ["id"]), frames(edges, ["id", "src", "dst"]))


def write_parquet(graph: PropertyGraph, path: str) -> None:
    """A folder for each label."""
    for kind, frames in (("vertices", graph.vertices), ("edges", graph.edges)):
        for label, f in frames.items():
            f.write.mode("overwrite").parquet(f"{path}/{kind}/{label}")


def read_parquet(spark: SparkSession, path: str, vertices: list[str], edges: list[str]) -> PropertyGraph:
    return PropertyGraph(spark, {k: spark.read.parquet(f"{path}/vertices/{k}") for k in vertices}, {k: spark.read.parquet(f"{path}/edges/{k}") for k in edges})
