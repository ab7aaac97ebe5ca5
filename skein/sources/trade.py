"""The trade tables as a property graph. A vertex's id is tag * 10 ** 10 + key."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.graph import PropertyGraph

TAG = 10_000_000_000
TAGS = {"region": 1, "nation": 2, "customer": 3, "supplier": 4, "part": 5, "order": 6, "user": 7, "document": 8}
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "order": "o_orderkey"}


def vid(label: str, key: str) -> Column:
    return F.lit(TAGS[label] * TAG) + F.col(key).cast("long")


def trade_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Vertices and edges of all tables; every edge id is made from its row."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tables = {label: read("orders" if label == "order" else label) for label in KEYS}
    vertices = {label: t.select(vid(label, KEYS[label]).alias("id"), *(c for c in t.columns if c != KEYS[label])) for label, t in tables.items()}
    vertices["document"] = read("documents").select(vid("document", "doc_id").alias("id"), "lang", "source", "n_chars")
    events = read("events")
    vertices["user"] = events.select(vid("user", "user_id").alias("id")).distinct()

    def by_key(t, label_a, a, label_b, b, tag, *props):
        return t.select((F.lit(tag * TAG) + F.col(a).cast("long")).alias("id"), vid(label_a, a).alias("src"), vid(label_b, b).alias("dst"), *props)

    line = read("lineitem")
    line_id = lambda tag: F.xxhash64(F.lit(tag), *line.columns).alias("id")
    pair = line.select("l_suppkey", "l_partkey").distinct()
    # the next event of the whole table: a window over all rows has one task, so only of a day
    day = Window.partitionBy(F.to_date("ts")).orderBy("ts", "event_id")
    step = events.select("event_id", vid("user", "user_id").alias("src"), F.lead(vid("user", "user_id")).over(day).alias("dst")).where("dst is not null")
    edges = {
        "in_region": by_key(tables["nation"], "nation", "n_nationkey", "region", "n_regionkey", 11),
        "c_in": by_key(tables["customer"], "customer", "c_custkey", "nation", "c_nationkey", 12),
        "s_in": by_key(tables["supplier"], "supplier", "s_suppkey", "nation", "s_nationkey", 13),
        "placed": tables["order"].select((F.lit(14 * TAG) + F.col("o_orderkey")).alias("id"), vid("customer", "o_custkey").alias("src"), vid("order", "o_orderkey").alias("dst"), F.col("o_orderdate").alias("orderdate")),
        "contains": line.select(line_id(15), vid("order", "l_orderkey").alias("src"), vid("part", "l_partkey").alias("dst"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_returnflag").alias("returnflag")),
        "ships": line.select(line_id(16), vid("supplier", "l_suppkey").alias("src"), vid("order", "l_orderkey").alias("dst"), F.col("l_quantity").alias("quantity")),
        "supplies": pair.select(F.xxhash64(F.lit(17), "l_suppkey", "l_partkey").alias("id"), vid("supplier", "l_suppkey").alias("src"), vid("part", "l_partkey").alias("dst")),
        "follows": step.select((F.lit(18 * TAG) + F.col("event_id")).alias("id"), "src", "dst"),
    }
    ends = {"in_region": ("nation", "region"), "c_in": ("customer", "nation"), "s_in": ("supplier", "nation"), "placed": ("customer", "order"), "contains": ("order", "part"), "ships": ("supplier", "order"), "supplies": ("supplier", "part"), "follows": ("user", "user")}
    return PropertyGraph(spark, vertices, edges, {k: ((a,), (b,)) for k, (a, b) in ends.items()})
