"""The graph queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import dates, lists, strings
from skein.graph import PropertyGraph
from skein.operators import algorithms
from skein.operators.predicates import P, TextP
from skein.operators.traversal import T, Traversal, __
from skein.sources import gremlin_csv
from skein.sources.trade import TAG, TAGS, trade_graph, vid

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *names: str):
    """Registers a function of the graph that gives a traversal or a DataFrame; names rename its columns."""

    def register(f: Callable[[PropertyGraph], Traversal | DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(trade_graph(spark, sf_dir))
            df = out.to_df() if isinstance(out, Traversal) else out
            return df.toDF(*names) if names else df

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def v(label: str, key: str) -> str:
    """The SQL of a vertex id."""
    return f"({TAGS[label] * TAG} + {key})"


LINES = "orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey"


@query(f"SELECT p_brand AS brand, count(*) AS lines FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1", "brand", "lines")
def flagship_brand_count(g):
    return g.V(labels=["customer"]).out("placed").out("contains").barrier().group_count("p_brand")


# --- scans and filters ---


@query(f"SELECT {v('nation', 'n_nationkey')} AS id, n_name AS name FROM nation", "id", "name")
def scan_label(g):
    return g.V().has_label("nation").project("id", "name", by=[T.id, "n_name"])


@query(f"SELECT {v('customer', 'c_custkey')} AS id FROM customer WHERE c_custkey IN (1, 7, 30)", "id")
def scan_ids(g):
    return g.V(*(TAGS["customer"] * TAG + k for k in (1, 7, 30)), labels=["customer"]).id()


@query(f"SELECT {v('customer', 'c_custkey')} AS src, {v('nation', 'c_nationkey')} AS dst FROM customer")
def scan_edges(g):
    return g.E().has_label("c_in").element_map().to_df().select("src", "dst")


@query(f"SELECT {v('customer', 'c_custkey')} AS id FROM customer WHERE c_mktsegment = 'BUILDING'", "id")
def has_eq(g):
    return g.V(labels=["customer"]).has("c_mktsegment", "BUILDING").id()


@query(f"SELECT {v('part', 'p_partkey')} AS id FROM part WHERE p_size >= 10 AND p_size < 20 AND p_retailprice > 905", "id")
def has_range(g):
    return g.V(labels=["part"]).has("p_size", P.between(10, 20)).has("p_retailprice", P.gt(905.0)).id()


@query(f"SELECT {v('part', 'p_partkey')} AS id FROM part WHERE p_size IN (1, 5, 9)", "id")
def has_within(g):
    return g.V(labels=["part"]).has("p_size", P.within(1, 5, 9)).id()


@query(f"SELECT {v('part', 'p_partkey')} AS id FROM part WHERE p_size NOT IN (1, 5, 9)", "id")
def has_without(g):
    return g.V(labels=["part"]).has("p_size", P.without(1, 5, 9)).id()


@query(f"SELECT {v('part', 'p_partkey')} AS id FROM part WHERE p_type LIKE 'S%' OR p_name LIKE '%1' OR p_name LIKE '%22%'", "id")
def has_text(g):
    return g.V(labels=["part"]).or_(__.has("p_type", TextP.starting_with("S")), __.has("p_name", TextP.ending_with("1")), __.has("p_name", TextP.containing("22"))).id()


@query(f"SELECT {v('part', 'p_partkey')} AS id FROM part WHERE regexp_matches(p_brand, '#[1-2][0-9]$')", "id")
def has_regex(g):
    return g.V(labels=["part"]).has("p_brand", TextP.regex("#[1-2][0-9]$")).id()


@query("SELECT 'supplier' AS label, count(*) AS n FROM supplier UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'region', count(*) FROM region", "label", "n")
def has_not(g):
    return g.V(labels=["supplier", "nation", "region", "customer"]).has_not("c_name").group_count(T.label)


@query(f"SELECT {v('supplier', 's_suppkey')} AS id FROM supplier WHERE (s_acctbal > 0 AND s_acctbal < 3000) OR s_acctbal < -500 OR s_acctbal > 9000", "id")
def p_inside_outside(g):
    return g.V(labels=["supplier"]).has("s_acctbal", P.inside(0.0, 3000.0) | P.outside(-500.0, 9000.0)).id()


@query(f"SELECT {v('customer', 'c_custkey')} AS id FROM customer WHERE NOT (c_acctbal >= 100 AND c_acctbal <= 5000) AND c_mktsegment <> 'MACHINERY'", "id")
def p_negate(g):
    return g.V(labels=["customer"]).has("c_acctbal", ~(P.gte(100.0) & P.lte(5000.0))).has("c_mktsegment", P.neq("MACHINERY")).id()


# --- hops ---


@query("SELECT n_name AS nation, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1", "nation", "customers")
def hop_out(g):
    return g.V(labels=["customer"]).out("c_in").barrier().group_count("n_name")


@query("SELECT c_mktsegment AS segment, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = 1 GROUP BY 1", "segment", "n")
def hop_in(g):
    return g.V(labels=["region"]).has_id(TAGS["region"] * TAG + 1).in_("in_region").in_("c_in").group_count("c_mktsegment")


@query("SELECT count(*) AS n FROM (SELECT c_nationkey FROM customer WHERE c_nationkey = 3 UNION ALL SELECT s_nationkey FROM supplier WHERE s_nationkey = 3 UNION ALL SELECT n_regionkey FROM nation WHERE n_nationkey = 3)", "n")
def hop_both(g):
    return g.V(TAGS["nation"] * TAG + 3, labels=["nation"]).both().count()


@query("SELECT l_returnflag AS flag, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1")
def hop_edge_props(g):
    return g.V(labels=["order"]).has("o_orderpriority", "1-URGENT").out_e("contains").to_df().groupBy(F.col("returnflag").alias("flag")).agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))


@query(f"SELECT {v('supplier', 's_suppkey')} AS id FROM supplier WHERE s_nationkey = 5 UNION ALL SELECT {v('customer', 'c_custkey')} FROM customer WHERE c_nationkey = 5 UNION ALL SELECT {v('region', 'n_regionkey')} FROM nation WHERE n_nationkey = 5", "id")
def hop_other_v(g):
    return g.V(TAGS["nation"] * TAG + 5, labels=["nation"]).both_e().other_v().id()


@query(f"SELECT {v('order', 'o_orderkey')} AS id FROM orders JOIN customer ON o_custkey = c_custkey", "id")
def hop_out_ids(g):
    return g.V(labels=["customer"]).out("placed").id()


@query(f"SELECT {v('order', 'o_orderkey')} AS id FROM orders JOIN customer ON o_custkey = c_custkey", "id")
def hop_out_ids_all(g):
    return g.V(labels=["customer"]).out("placed").id()


@query("SELECT r_name AS region, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1", "region", "customers")
def two_hop(g):
    return g.V(labels=["customer"]).out("c_in").barrier().out("in_region").barrier().group_count("r_name")


@query(f"SELECT p_type AS type, count(*) AS lines FROM customer JOIN {LINES.replace('orders JOIN', 'orders ON c_custkey = o_custkey JOIN', 1)} WHERE c_mktsegment = 'AUTOMOBILE' AND o_totalprice > 100000 AND p_size < 15 GROUP BY 1", "type", "lines")
def three_hop_filter(g):
    return g.V(labels=["customer"]).has("c_mktsegment", "AUTOMOBILE").out("placed").has("o_totalprice", P.gt(100000.0)).out("contains").has("p_size", P.lt(15)).group_count("p_type")


@query(f"SELECT {v('supplier', 'l_suppkey')} AS id, count(*) AS degree FROM lineitem GROUP BY 1 HAVING count(*) >= 600")
def supernodes(g):
    return replace(g, edges={"ships": g.edges["ships"]}).supernodes(600, "out")


@query("SELECT o_orderpriority AS priority, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(*) >= 600) AND l_quantity > 40 GROUP BY 1", "priority", "n")
def supernode_hop(g):
    big = g.degrees("out", ["ships"]).where("degree >= 600")
    start = g.V(labels=["supplier"])
    return start._on(start.df.join(big.select("id"), "id", "left_semi")).out_e("ships").has("quantity", P.gt(40)).in_v().barrier().group_count("o_orderpriority")


# --- inner traversals as filters ---


@query(f"SELECT {v('customer', 'c_custkey')} AS id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", "id")
def where_semi(g):
    return g.V(labels=["customer"]).where(__.out("placed").has("o_totalprice", P.gt(300000.0))).id()


@query(f"SELECT {v('order', 'o_orderkey')} AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)", "id")
def not_anti(g):
    return g.V(labels=["order"]).not_(__.out("contains")).id()


@query(f"SELECT {v('order', 'o_orderkey')} AS id FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(l_orderkey) < 2", "id")
def where_count(g):
    return g.V(labels=["order"]).where(__.out("contains").count().is_(P.lt(2))).id()


@query(f"SELECT {v('part', 'p_partkey')} AS id FROM part WHERE (EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49) OR p_size = 7) AND EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R')", "id")
def and_or_filters(g):
    return g.V(labels=["part"]).and_(__.or_(__.in_e("contains").has("quantity", P.gt(49)), __.has("p_size", 7)), __.in_e("contains").has("returnflag", "R")).id()


@query(f"SELECT DISTINCT {v('supplier', 'l_suppkey')} AS id FROM lineitem WHERE l_partkey = 10", "id")
def where_has_id(g):
    return g.V(labels=["supplier"]).where(__.out("supplies").has_id(TAGS["part"] * TAG + 10)).id()


@query("SELECT count(*) AS n FROM (SELECT a.c_custkey FROM customer a JOIN nation ON a.c_nationkey = n_nationkey JOIN supplier b ON b.s_nationkey = n_nationkey WHERE b.s_acctbal > a.c_acctbal)", "n")
def where_marked(g):
    own = replace(g, vertices=g.vertices | {"customer": g.vertices["customer"].withColumnRenamed("c_acctbal", "balance"), "supplier": g.vertices["supplier"].withColumnRenamed("s_acctbal", "balance")})
    return own.V(labels=["customer"]).as_("a").out("c_in").in_("s_in").as_("b").where_marked("a", lambda a, b: a < b, "b", by="balance").count()


@query("SELECT count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey JOIN orders x ON x.o_orderkey = a.l_orderkey JOIN orders y ON y.o_orderkey = b.l_orderkey WHERE x.o_totalprice < y.o_totalprice AND a.l_quantity > 45", "n")
def where_by(g):
    first = g.V(labels=["order"]).as_("a").out_e("contains").has("quantity", P.gt(45)).in_v().in_("contains").as_("b")
    return first.where("a", P.lt("b"), by="o_totalprice").count()


# --- reducing steps ---


@query("SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n", "n")
def count_v(g):
    return g.V().has_label("customer", "supplier").count()


@query("SELECT count(*) AS n FROM lineitem", "n")
def count_e_label(g):
    return g.E(labels=["contains"]).count()


@query(f"SELECT {v('order', 'o_orderkey')} AS id, count(l_orderkey) AS degree FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1", "id", "degree")
def degree(g):
    return g.V(labels=["order"]).project("id", "degree", by=[T.id, __.out_e("contains").count()])


@query("SELECT round(sum(o_totalprice), 2) AS total, min(o_totalprice) AS least, max(o_totalprice) AS most, round(avg(o_totalprice), 4) AS mean FROM orders")
def sum_min_max_mean(g):
    price = g.V(labels=["order"]).values("o_totalprice")
    parts = {"total": price.sum_().apply(lambda c: F.round(c, 2)), "least": price.min_(), "most": price.max_(), "mean": price.mean().apply(lambda c: F.round(c, 4))}
    out = None
    for name, t in parts.items():
        own = t.df.select(F.col("value").alias(name), F.lit(1).alias("one"))
        out = own if out is None else out.join(own, "one")
    return out.drop("one")


@query("SELECT c_mktsegment AS segment, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1", "segment", "balance")
def group_reduce(g):
    return g.V(labels=["customer"]).group("c_mktsegment", "c_acctbal", lambda c: F.round(F.sum(c), 2))


@query("SELECT n, count(*) AS parts FROM (SELECT p_partkey, count(l_partkey) AS n FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1) GROUP BY 1", "n", "parts")
def group_count_by_degree(g):
    return g.V(labels=["part"]).group_count(__.in_e("contains").count())


@query("SELECT count(DISTINCT p_brand) AS n FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity > 49", "n")
def dedup_count(g):
    return g.E(labels=["contains"]).has("quantity", P.gt(49)).in_v().dedup().values("p_brand").dedup().count()


@query(f"SELECT p_brand AS brand, {v('part', 'min(p_partkey)')} AS id FROM part GROUP BY 1")
def dedup_by(g):
    return g.V(labels=["part"]).dedup(by="p_brand").to_df().select(F.col("p_brand").alias("brand"), "id")


@query("SELECT n_name AS name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000 GROUP BY 1", "name", "n")
def store_cap(g):
    return g.V(labels=["customer"]).has("c_acctbal", P.gt(9000.0)).out("c_in").store("seen", "n_name").out("in_region").cap("seen").group_count()


# --- order and slices ---


@query(f"SELECT p_brand AS brand, p_size AS size, {v('part', 'p_partkey')} AS id FROM part ORDER BY p_size DESC, p_brand, p_partkey LIMIT 50")
def order_multi(g):
    return g.V(labels=["part"]).order(("p_size", "desc"), "p_brand", T.id).limit(50).to_df().select(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), "id")


@query(f"SELECT {v('customer', 'c_custkey')} AS id, count(*) AS orders FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "id", "orders")
def top_k(g):
    return g.V(labels=["customer"]).project("id", "orders", by=[T.id, __.out("placed").count()]).order(("orders", "desc"), "id").limit(10)


@query(f"SELECT {v('supplier', 's_suppkey')} AS id FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 20 OFFSET 10", "id")
def skip_range(g):
    return g.V(labels=["supplier"]).order("s_acctbal", T.id).range_(10, 30).id()


@query(f"SELECT {v('supplier', 's_suppkey')} AS id FROM supplier ORDER BY s_acctbal DESC, s_suppkey DESC LIMIT 7", "id")
def tail(g):
    return g.V(labels=["supplier"]).order("s_acctbal", T.id).tail(7).id()


@query(f"SELECT {v('customer', 'o_custkey')} AS customer, o_totalprice AS price FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2")
def per_source_limit(g):
    best = g.V(labels=["customer"]).as_("c").local(__.out("placed").order(("o_totalprice", "desc"), T.id).limit(2))
    return best.load().df.select(F.col("_as_c").alias("customer"), F.col("o_totalprice").alias("price"))


# --- projections ---


@query("SELECT n_name AS value FROM nation UNION ALL SELECT r_name FROM region", "value")
def values_of_keys(g):
    return g.V(labels=["nation", "region"]).values("n_name", "r_name")


@query(f"SELECT {v('nation', 'n_nationkey')} AS id, 'nation' AS label, n_name AS n_name, 'R' || r_name AS tagged, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers FROM nation JOIN region ON n_regionkey = r_regionkey")
def project_by(g):
    return g.V(labels=["nation"]).project("id", "label", "n_name", "tagged", "customers", by=[T.id, T.label, "n_name", __.out("in_region").values("r_name").apply(lambda c: F.concat(F.lit("R"), c)), __.in_("c_in").count()])


@query("SELECT c_name AS customer, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
def select_as(g):
    return g.V(labels=["customer"]).as_("customer").out("c_in").as_("nation").select("customer", "nation", by=["c_name", "n_name"])


@query(f"SELECT {v('region', 'r_regionkey')} AS id, 'region' AS label, r_name FROM region")
def element_map(g):
    return g.V(labels=["region"]).element_map("r_name")


@query(f"SELECT {v('region', 'r_regionkey')} AS owner, 'r_name' AS key, r_name AS value FROM region")
def properties(g):
    return g.V(labels=["region"]).properties("r_name")


@query("SELECT s_name || '>' || n_name || '>' || r_name AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", "path")
def path_by(g):
    return g.V(labels=["supplier"]).track("s_name", "n_name", "r_name").out("s_in").out("in_region").path().apply(lambda c: lists.conjoin(c, ">"))


@query("SELECT o_orderpriority || '>' || l_returnflag || '>' || p_brand AS path FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE o_totalprice > 300000", "path")
def path_with_edges(g):
    return g.V(labels=["order"]).has("o_totalprice", P.gt(300000.0)).track("o_orderpriority", "returnflag", "p_brand").out_e("contains").in_v().path().apply(lambda c: lists.conjoin(c, ">"))


@query("SELECT i AS index, p AS item FROM (SELECT unnest(string_split(p_type, ' ')) AS p, generate_subscripts(string_split(p_type, ' '), 1) - 1 AS i FROM part)")
def index_items(g):
    return g.V(labels=["part"]).values("p_type").apply(lambda c: strings.split(c, " ")).index().to_df().select("index", "item")


@query("SELECT string_agg(r_name, ',' ORDER BY r_name) AS names FROM region", "names")
def fold_sorted(g):
    return g.V(labels=["region"]).values("r_name").fold().apply(lambda c: lists.conjoin(c, ","))


# --- branches ---


@query(f"SELECT {v('supplier', 's_suppkey')} AS id FROM supplier WHERE s_nationkey = 4 UNION ALL SELECT {v('customer', 'c_custkey')} FROM customer WHERE c_nationkey = 4", "id")
def union_branches(g):
    return g.V(TAGS["nation"] * TAG + 4, labels=["nation"]).union(__.in_("s_in"), __.in_("c_in")).id()


@query(f"SELECT {v('order', 'o_orderkey')} AS id, count(*) AS n, max(l_partkey IS NULL) AS own FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def coalesce_branch(g):
    out = g.V(labels=["order"]).as_("o").coalesce(__.out("contains"), __.identity())
    return out.df.groupBy(F.col("_as_o").alias("id")).agg(F.count("*").alias("n"), F.max(F.col("id") == F.col("_as_o")).alias("own"))


@query(f"SELECT count(*) AS n FROM (SELECT 1 FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 45) ON o_orderkey = l_orderkey)", "n")
def optional_branch(g):
    return g.V(labels=["order"]).optional(lambda t: t.out_e("contains").has("quantity", P.gt(45)).in_v()).count()


@query("SELECT CASE WHEN c_acctbal > 5000 THEN n_name ELSE c_mktsegment END AS value, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1", "value", "n")
def choose_branch(g):
    return g.V(labels=["customer"]).choose(__.has("c_acctbal", P.gt(5000.0)), __.out("c_in").values("n_name"), __.values("c_mktsegment")).group_count()


# --- loops ---

FOLLOWS = f"f AS (SELECT a AS src, b AS dst FROM (SELECT {v('user', 'user_id')} AS a, lead({v('user', 'user_id')}) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL)"


@query(f"WITH {FOLLOWS} SELECT z.dst AS id, count(*) AS n FROM f x JOIN f y ON x.dst = y.src JOIN f z ON y.dst = z.src WHERE x.src = {TAGS['user'] * TAG + 5} GROUP BY 1")
def repeat_times(g):
    return g.V(TAGS["user"] * TAG + 5, labels=["user"]).repeat(__.out("follows"), times=3).df.groupBy("id").agg(F.sum("_n").alias("n"))


@query(f"WITH {FOLLOWS} SELECT id, count(*) AS n FROM (SELECT x.dst AS id FROM f x WHERE x.src = {TAGS['user'] * TAG + 5} UNION ALL SELECT y.dst FROM f x JOIN f y ON x.dst = y.src WHERE x.src = {TAGS['user'] * TAG + 5}) GROUP BY 1")
def repeat_emit(g):
    return g.V(TAGS["user"] * TAG + 5, labels=["user"]).repeat(__.out("follows"), times=2, emit=True).df.groupBy("id").agg(F.sum("_n").alias("n"))


@query("SELECT r_name AS region, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1", "region", "n")
def repeat_until(g):
    return g.V(labels=["supplier"]).repeat(__.out("s_in", "in_region"), until=__.not_(__.out("in_region"))).group_count("r_name")


@query(f"WITH {FOLLOWS} SELECT count(*) AS n FROM (SELECT DISTINCT src, dst FROM f) x JOIN (SELECT DISTINCT src, dst FROM f) y ON x.dst = y.src WHERE x.src <> x.dst AND y.dst <> y.src AND y.dst <> x.src AND x.src = {TAGS['user'] * TAG + 9}", "n")
def simple_path(g):
    own = g.filtered(edges=lambda f, label: f.dropDuplicates(["src", "dst"]) if label == "follows" else f)
    return own.V(TAGS["user"] * TAG + 9, labels=["user"]).track().out("follows").simple_path().out("follows").simple_path().count()


@query(f"SELECT {v('order', 'l_orderkey')} AS id, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_suppkey = 3 GROUP BY 1")
def sack_sum(g):
    out = g.V(TAGS["supplier"] * TAG + 3, labels=["supplier"]).with_sack(0.0).out_e("ships").sack("sum", "quantity").in_v()
    return out.df.groupBy("id").agg(F.round(F.sum("_sack"), 2).alias("quantity"))


@query("SELECT count(*) AS n FROM (SELECT DISTINCT c_custkey, s_suppkey, n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey = 2)", "n")
def match_pattern(g):
    europe = g.V(TAGS["region"] * TAG + 2, labels=["region"]).in_("in_region")
    return europe.match(("n", __.in_("c_in"), "c"), ("n", __.in_("s_in"), "s")).count()


@query("SELECT count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE r_regionkey = 2", "n")
def match_chain(g):
    return g.V(TAGS["region"] * TAG + 2, labels=["region"]).match(("r", __.in_("in_region"), "n"), ("n", __.in_("c_in"), "c"), ("c", __.out("placed"), "o")).count()


@query("SELECT string_agg(n_name, ',' ORDER BY n_name DESC) AS names FROM nation", "names")
def fold_ordered(g):
    return g.V(labels=["nation"]).order(("n_name", "desc")).values("n_name").fold().apply(lambda c: lists.conjoin(c, ","))


@query(f"SELECT {v('customer', 'o_custkey')} AS id, arg_max(o_orderstatus, (o_totalprice, o_orderkey)) AS dearest FROM orders GROUP BY 1", "id", "dearest")
def project_ordered(g):
    best = __.out("placed").order(("o_totalprice", "desc"), (T.id, "desc")).values("o_orderstatus")
    return g.V(labels=["customer"]).where(__.out("placed")).project("id", "dearest", by=[T.id, best])


@query("SELECT c_mktsegment AS key, count(o_orderkey) AS value FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1", "key", "value")
def group_within(g):
    return g.V(labels=["customer"]).group("c_mktsegment", within=__.out("placed").count())


@query(f"WITH {FOLLOWS}, b AS (SELECT src, dst FROM f UNION ALL SELECT dst, src FROM f), h1 AS (SELECT dst, count(*) AS n FROM b GROUP BY 1), h2 AS (SELECT b.dst, sum(n) AS n FROM h1 JOIN b ON h1.dst = b.src GROUP BY 1), h3 AS (SELECT b.dst, sum(n) AS n FROM h2 JOIN b ON h2.dst = b.src GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n FROM h3", "n")
def bulk_fanout(g):
    return g.V(labels=["user"]).repeat(__.both("follows"), times=3).count()


@query(None)
def sample_n(g):
    return g.V(labels=["customer"]).sample(25, seed=3).id()


@query(None)
def coin_p(g):
    return g.V(labels=["customer"]).coin(0.3, seed=3).id()


# --- algorithms ---

EDGES = "e AS (SELECT src, dst, count(*) AS w FROM f GROUP BY 1, 2), u AS (SELECT DISTINCT " + v("user", "user_id") + " AS id FROM events), d AS (SELECT id, coalesce(sum(w), 0) AS degree FROM u LEFT JOIN e ON e.src = u.id GROUP BY 1), k AS (SELECT count(*) AS n FROM u)"


def _page_rank_sql(passes: int, alpha: float = 0.85) -> str:
    """The recurrence pass by pass; t is the energy to teleport."""
    steps = ["r0 AS (SELECT id, CAST(0 AS DOUBLE) AS pr, CAST(0 AS DOUBLE) AS sent FROM u), t0 AS (SELECT CAST(1 AS DOUBLE) AS t)"]
    for i in range(1, passes + 1):
        p = i - 1
        steps.append(f"p{i} AS (SELECT u.id, coalesce(g.got, 0) + (SELECT t FROM t{p}) / (SELECT n FROM k) AS pr FROM u LEFT JOIN (SELECT dst, sum(w * sent) AS got FROM e JOIN r{p} ON r{p}.id = e.src GROUP BY 1) g ON g.dst = u.id)")
        steps.append(f"r{i} AS (SELECT p{i}.id, pr, CASE WHEN degree > 0 THEN {alpha} * pr / degree ELSE 0 END AS sent FROM p{i} JOIN d ON d.id = p{i}.id)")
        steps.append(f"t{i} AS (SELECT (1 - {alpha}) * sum(pr) + {alpha} * coalesce(sum(pr) FILTER (WHERE degree = 0), 0) AS t FROM p{i} JOIN d ON d.id = p{i}.id)")
    return f"WITH {FOLLOWS}, {EDGES}, {', '.join(steps)} SELECT id, round(pr, 6) AS rank FROM r{passes}"


def _users(g):
    return g.vertex_frame(["user"]), g.edge_frame(["follows"])


@query(_page_rank_sql(4))
def pagerank(g):
    return algorithms.page_rank(*_users(g), epsilon=0.0, iterations=5).select("id", F.round("rank", 6).alias("rank"))


@query(
    f"WITH RECURSIVE {FOLLOWS}, e AS (SELECT DISTINCT src, dst FROM f), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), "
    f"u AS (SELECT DISTINCT {v('user', 'user_id')} AS id FROM events), r AS (SELECT id, id AS other FROM u UNION SELECT r.id, b.dst FROM r JOIN b ON r.other = b.src) "
    "SELECT id, min(CAST(other AS VARCHAR)) AS component FROM r GROUP BY 1"
)
def connected_components(g):
    return algorithms.connected_components(*_users(g))


@query()
def connected_components_all(g):
    """On all edges; recursive SQL is too slow there, the tests hold it against a union-find."""
    return algorithms.connected_components(*_users(g))


@query(f"WITH RECURSIVE {FOLLOWS}, s AS (SELECT DISTINCT src, dst FROM f), r AS (SELECT {TAGS['user'] * TAG + 3} AS id, 0 AS distance UNION SELECT s.dst, r.distance + 1 FROM r JOIN s ON r.id = s.src WHERE r.distance < 60) SELECT id, min(distance) AS distance FROM r GROUP BY 1")
def bfs_distance(g):
    users, follows = _users(g)
    start = users.where(F.col("id") == TAGS["user"] * TAG + 3)
    return algorithms.bfs(users, follows, start)


@query()
def bfs_distance_all(g):
    """On all edges and to any depth; held against a search in the tests."""
    users, follows = _users(g)
    return algorithms.bfs(users, follows, users.where(F.col("id") == TAGS["user"] * TAG + 3))


def _peer_sql(rounds: int) -> str:
    steps = ["c0 AS (SELECT id, CAST(id AS VARCHAR) AS cluster FROM u)"]
    for i in range(1, rounds + 1):
        p = i - 1
        steps.append(f"v{i} AS (SELECT id, cluster, sum(w) AS votes FROM (SELECT e.dst AS id, cluster, w FROM e JOIN c{p} ON c{p}.id = e.src UNION ALL SELECT id, cluster, 1 FROM c{p}) GROUP BY 1, 2)")
        steps.append(f"c{i} AS (SELECT id, cluster FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY votes DESC, cluster) AS r FROM v{i}) WHERE r = 1)")
    return f"WITH {FOLLOWS}, {EDGES}, {', '.join(steps)} SELECT id, cluster FROM c{rounds}"


@query(_peer_sql(3))
def peer_pressure(g):
    return algorithms.peer_pressure(*_users(g), iterations=4)


# --- scalar functions ---


@query("SELECT c_name AS name, upper(c_mktsegment) AS up, length(c_name) AS size, substring(c_name, 3, 4) AS part, replace(c_name, '#', '-') AS dashed, reverse(c_name) AS back, c_name || '/' || c_mktsegment AS both FROM customer")
def fn_string(g):
    c, m = F.col("c_name"), F.col("c_mktsegment")
    return g.V(labels=["customer"]).project("name", "up", "size", "part", "dashed", "back", "both", by=["c_name", strings.to_upper(m), strings.length(c), strings.substring(c, 2, 6), strings.replace(c, "#", "-"), strings.reverse(c), strings.format_("%{a}/%{b}", a=c, b=m)])


@query(f"SELECT {v('order', 'o_orderkey')} AS id, CAST(date_diff('second', TIMESTAMP '1992-01-01', o_orderdate) AS BIGINT) AS seconds, strftime(o_orderdate + INTERVAL 3 DAY, '%Y-%m-%d') AS later FROM orders", "id", "seconds", "later")
def fn_date(g):
    d = F.col("o_orderdate")
    return g.V(labels=["order"]).project("id", "seconds", "later", by=[T.id, dates.date_diff(d, F.lit("1992-01-01").cast("timestamp")), F.date_format(dates.date_add(d, "day", 3), "yyyy-MM-dd")])


@query("SELECT p_name AS name, array_to_string(list_sort(list_distinct(list_concat(string_split(p_type, ' '), string_split(p_name, ' ')))), ',') AS merged, len(string_split(p_type, ' ')) AS n FROM part")
def fn_list(g):
    a, b = strings.split(F.col("p_type"), " "), strings.split(F.col("p_name"), " ")
    return g.V(labels=["part"]).project("name", "merged", "n", by=["p_name", lists.conjoin(F.array_sort(lists.merge(a, b)), ","), F.size(a).cast("long")])


@query("SELECT round((p_size % 7 + 1) * p_size / 2.0 - 3, 6) AS x, count(*) AS n FROM part GROUP BY 1", "x", "n")
def fn_math(g):
    return g.V(labels=["part"]).math("(_ % 7 + 1) * _ / 2 - 3", by="p_size").apply(lambda c: F.round(c, 6)).group_count()


# --- changes and facts ---


@query(f"SELECT id, r_name, note FROM (SELECT {v('region', 'r_regionkey')} AS id, r_name, CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN 'seen' END AS note FROM region UNION ALL SELECT {TAGS['region'] * TAG + 77}, 'MOON', 'new')")
def merge_v(g):
    regions = g.vertices["region"].withColumn("note", F.lit(None).cast("string"))
    own = g.drop_vertices(g.vertices["region"]).add_vertices("region", regions)
    names = F.explode(F.array(*(F.lit(x) for x in ("ASIA", "EUROPE", "MOON"))))
    rows = g.vertices["region"].limit(1).select(F.lit(TAGS["region"] * TAG + 77).alias("id"), names.alias("r_name"))
    return own.merge_vertices("region", rows, ["r_name"], {"note": F.lit("new")}, {"note": F.lit("seen")}).vertices["region"].select("id", "r_name", "note")


@query(
    f"SELECT src, dst, note FROM (SELECT {v('nation', 'n_nationkey')} AS src, {v('region', 'n_regionkey')} AS dst, CASE WHEN n_regionkey = 1 THEN 'seen' END AS note FROM nation UNION ALL SELECT {v('nation', 'n_nationkey')}, {v('region', '1')}, 'new' FROM nation WHERE n_regionkey = 0)"
)
def merge_e(g):
    edges = g.edges["in_region"].withColumn("note", F.lit(None).cast("string"))
    own = g.drop_edges(g.edges["in_region"]).add_edges("in_region", edges)
    rows = g.vertices["nation"].where("n_regionkey in (0, 1)").select(F.col("id").alias("src"), vid("region", "n_regionkey").alias("r")).select("src", F.lit(TAGS["region"] * TAG + 1).alias("dst"))
    return own.merge_edges("in_region", rows, {"note": F.lit("new")}, {"note": F.lit("seen")}).edges["in_region"].select("src", "dst", "note")


@query("SELECT 'nation' AS element, count(*) AS n FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 'c_in', count(*) FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT 's_in', count(*) FROM supplier WHERE s_nationkey <> 3 UNION ALL SELECT 'in_region', count(*) FROM nation WHERE n_nationkey <> 3")
def drop_vertex_cascade(g):
    own = g.drop_vertices(g.vertices["nation"].where(F.col("id") == TAGS["nation"] * TAG + 3))
    kept = {"nation": own.vertices["nation"], **{k: own.edges[k] for k in ("c_in", "s_in", "in_region")}}
    return PropertyGraph(g.spark, kept).summary().select(F.col("label").alias("element"), F.col("elements").alias("n"))


@query("SELECT 'vertex' AS kind, 'nation' AS label, count(*) AS elements, 'n_name,n_regionkey' AS keys FROM nation UNION ALL SELECT 'vertex', 'region', count(*), 'r_name' FROM region UNION ALL SELECT 'edge', 'placed', count(*), 'orderdate' FROM orders UNION ALL SELECT 'edge', 'ships', count(*), 'quantity' FROM lineitem")
def summary_counts(g):
    return PropertyGraph(g.spark, {k: g.vertices[k] for k in ("nation", "region")}, {k: g.edges[k] for k in ("placed", "ships")}).summary()


@query("SELECT l_orderkey * 10 + l_linenumber AS id, count(*) - 1 AS surplus FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def csv_duplicates(g):
    rows = g.edge_frame(["contains"]).select(((F.col("src") - TAGS["order"] * TAG) * 10 + F.col("line")).alias("id"))
    return gremlin_csv.duplicate_ids(rows)


@query(f"SELECT {v('order', 'o_orderkey')} AS id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'", "id")
def dangling_edges(g):
    some = g.vertex_frame(["customer"]).where("c_mktsegment <> 'BUILDING'").select("id").unionByName(g.vertex_frame(["order"]).select("id"))
    return gremlin_csv.dangling_edges(g.edges["placed"], some).select("dst")


@query("SELECT count(*) AS n FROM orders WHERE o_orderdate > TIMESTAMP '1995-06-17'", "n")
def ttl_filter(g):
    own = PropertyGraph(g.spark, {"order": g.vertices["order"].withColumn("ttl", F.col("o_orderdate"))})
    return own.live(F.lit("1995-06-17").cast("timestamp")).V().count()


@query("SELECT n_name AS name, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1", "name", "segments")
def list_cardinality(g):
    """A property with several values for each vertex."""
    many = g.vertices["customer"].groupBy("c_nationkey").agg(F.collect_set("c_mktsegment").alias("segments"))
    nation = g.vertices["nation"].withColumn("k", F.col("id") - TAGS["nation"] * TAG).join(many, F.col("k") == F.col("c_nationkey")).select("id", "n_name", "segments")
    return PropertyGraph(g.spark, {"nation": nation}).V().has("segments").group("n_name", "segments", lambda c: F.array_join(F.array_sort(F.first(c)), ","))


@query(f"SELECT {v('customer', 'o_custkey')} AS id, string_agg(CAST({v('order', 'o_orderkey')} AS VARCHAR), ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1")
def adjacency(g):
    lists_ = gremlin_csv.adjacency(g.edge_frame(["placed"]))
    return lists_.select("id", F.array_join(F.transform(F.element_at("neighbours", "placed"), lambda x: x["dst"].cast("string")), ",").alias("orders"))


# --- further combinations ---


@query(
    "SELECT p_name AS name, array_to_string(list_sort(list_intersect(a, b)), ',') AS common, len(list_distinct(a)) - len(list_intersect(a, b)) AS only_a, len(a) + len(b) AS combined, len(a) * len(b) AS pairs FROM (SELECT p_name, string_split(p_type, ' ') AS a, string_split(p_name || ' ' || p_type, ' ')[1:4] AS b FROM part)"
)
def fn_list_sets(g):
    a, b = strings.split(F.col("p_type"), " "), F.slice(strings.split(strings.concat(F.col("p_name"), " ", F.col("p_type")), " "), 1, 4)
    text = lambda c: lists.conjoin(F.array_sort(c), ",")
    return g.V(labels=["part"]).project("name", "common", "only_a", "combined", "pairs", by=["p_name", text(lists.intersect(a, b)), F.size(lists.difference(a, b)).cast("long"), F.size(lists.combine(a, b)).cast("long"), F.size(lists.product(a, b)).cast("long")])


@query("SELECT DISTINCT n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", "nation", "region")
def dedup_marked(g):
    ways = g.V(labels=["customer"]).out("c_in").as_("nation").out("in_region").as_("region")
    return ways.dedup("nation", "region").select("nation", "region", by=["n_name", "r_name"])


@query(f"SELECT l_quantity AS quantity, p_brand AS brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity < 5 GROUP BY 1, 2")
def select_edge_and_vertex(g):
    out = g.V(labels=["order"]).out_e("contains").has("quantity", P.lt(5)).as_("line").in_v().as_("part").select("line", "part", by=["quantity", "p_brand"])
    return out.to_df().groupBy(F.col("line").alias("quantity"), F.col("part").alias("brand")).agg(F.count("*").alias("n"))


@query("SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'b' WHEN 'MACHINERY' THEN 'm' END AS value, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1", "value", "n")
def choose_options(g):
    return g.V(labels=["customer"]).choose("c_mktsegment", options={"BUILDING": __.constant("b"), "MACHINERY": __.constant("m")}).group_count()


@query(f"SELECT {v('order', 'l_orderkey')} AS id, min(l_quantity) AS least FROM lineitem WHERE l_suppkey IN (1, 2) GROUP BY 1")
def sack_min(g):
    start = g.V(TAGS["supplier"] * TAG + 1, TAGS["supplier"] * TAG + 2, labels=["supplier"])
    out = start.with_sack(1e9).out_e("ships").sack("min", "quantity").in_v()
    return out.df.groupBy("id").agg(F.min("_sack").alias("least"))


#: Rounds of the SQL, more than the edges of any lightest way in the given tables.
WAYS = 30


@query(
    f"WITH {FOLLOWS}, e AS (SELECT src, dst, CAST(min(abs(src - dst)) AS DOUBLE) AS w FROM f GROUP BY 1, 2), b0 AS (SELECT {TAGS['user'] * TAG + 3} AS id, CAST(0 AS DOUBLE) AS total), "
    + ", ".join(f"b{i} AS (SELECT id, min(total) AS total FROM (SELECT * FROM b{i - 1} UNION ALL SELECT e.dst, total + w FROM b{i - 1} JOIN e ON e.src = b{i - 1}.id) GROUP BY 1)" for i in range(1, WAYS + 1))
    + f" SELECT id, total FROM b{WAYS}"
)
def weighted_distance(g):
    users, follows = _users(g)
    start = users.where(F.col("id") == TAGS["user"] * TAG + 3)
    return algorithms.shortest_weights(follows.withColumn("weight", F.abs(F.col("src") - F.col("dst"))), start, "weight")


@query()
def weighted_distance_all(g):
    """Over any number of edges; held against Dijkstra's method in the tests."""
    users, follows = _users(g)
    start = users.where(F.col("id") == TAGS["user"] * TAG + 3)
    return algorithms.shortest_weights(follows.withColumn("weight", F.abs(F.col("src") - F.col("dst"))), start, "weight")


@query("SELECT n_name AS nation, count(*) FILTER (WHERE n > 12) AS busy FROM (SELECT c_custkey, c_nationkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) JOIN nation ON n_nationkey = c_nationkey GROUP BY 1", "nation", "busy")
def nested_inner_counts(g):
    busy = __.in_("c_in").where(__.out("placed").count().is_(P.gt(12))).count()
    return g.V(labels=["nation"]).where(__.in_("c_in")).project("nation", "busy", by=["n_name", busy])


@query("SELECT o_orderstatus AS status, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1", "status", "mean")
def group_mean(g):
    return g.V(labels=["order"]).group("o_orderstatus", "o_totalprice", lambda c: F.round(F.avg(c), 4))


@query(f"SELECT {v('order', 'o_orderkey')} AS id, round(coalesce((SELECT max(l_extendedprice) FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45), -1), 2) AS most FROM orders", "id", "most")
def project_coalesce(g):
    dearest = __.coalesce(__.out_e("contains").has("quantity", P.gt(45)).values("price").max_(), __.constant(-1.0))
    return g.V(labels=["order"]).project("id", "most", by=[T.id, lambda t: dearest(t).apply(lambda c: F.round(c, 2))])
