import random

import pytest
from pyspark.sql import functions as F

from skein.functions import dates, lists, maths, strings
from skein.graph import PropertyGraph, numeric_id
from skein.operators import algorithms, traversal
from skein.operators.predicates import P
from skein.operators.traversal import __
from skein.sources import graph_files, gremlin_csv
from tests.modern import modern


@pytest.fixture(scope="module")
def g(spark):
    return modern(spark)


def ranks(g, vertices=None, edges=(), **options):
    rows = algorithms.page_rank(g.vertex_frame(vertices), g.edge_frame(edges), **options).collect()
    return {r["id"]: r["rank"] for r in rows}


def test_page_rank(g):
    own = ranks(g)
    assert own[1] == pytest.approx(0.113755, abs=1e-5) and own[3] == pytest.approx(0.30472, abs=1e-5)
    assert sorted(own, key=own.get)[-2:] == [5, 3] and {i for i, r in own.items() if r < 0.12} == {1, 6}
    back = g.edge_frame().select("id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    back = {r["id"]: r["rank"] for r in algorithms.page_rank(g.vertex_frame(), back).collect()}
    assert back[1] == pytest.approx(0.380829, abs=1e-5)
    assert ranks(g, edges=("knows",))[1] == pytest.approx(0.145985, abs=1e-5)
    assert all(r == pytest.approx(1 / 6, abs=1e-5) for r in ranks(g, edges=("no such",)).values())
    assert ranks(g, ["person"], ("knows",))[1] == pytest.approx(0.206185, abs=1e-5)
    assert ranks(g, alpha=0.86)[3] == pytest.approx(0.30589, abs=1e-5)


def test_components(g):
    of = lambda v, e: {r["id"]: r["component"] for r in algorithms.connected_components(v, e).collect()}
    assert set(of(g.vertex_frame(), g.edge_frame()).values()) == {"1"}
    cut = of(g.vertex_frame(), g.edge_frame().where("src <> 6"))
    assert cut == {1: "1", 2: "1", 3: "1", 4: "1", 5: "1", 6: "6"}
    assert of(g.vertex_frame(["person"]), g.edge_frame()) == {1: "1", 2: "1", 4: "1", 6: "6"}


def path_of_random_ids(spark, n):
    """Vertices and edges of a path whose ids are in random order."""
    ids = random.Random(7).sample(range(10 * n), n)
    return ids, spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(list(zip(ids, ids[1:])), "src long, dst long")


def test_components_of_long_paths(spark):
    ids, v, e = path_of_random_ids(spark, 1000)
    lone = spark.createDataFrame([(-5,), (-5,)], "id long")
    got = {r["id"]: r["component"] for r in algorithms.connected_components(v.union(lone), e).collect()}
    assert got == {i: min(map(str, ids)) for i in ids} | {-5: "-5"}


def test_peer_pressure(g):
    own = {r["id"]: r["cluster"] for r in algorithms.peer_pressure(g.vertex_frame(), g.edge_frame()).collect()}
    assert own == {1: "1", 2: "1", 3: "1", 4: "1", 5: "1", 6: "6"}


def test_distances(g):
    start = g.vertex_frame().where("id = 1")
    assert {r["id"]: r["distance"] for r in algorithms.bfs(g.vertex_frame(), g.edge_frame(), start).collect()} == {1: 0, 2: 1, 3: 1, 4: 1, 5: 2}
    total = {r["id"]: r["total"] for r in algorithms.shortest_weights(g.edge_frame(), start, "weight").collect()}
    assert total == {1: 0.0, 2: 0.5, 3: 0.4, 4: 1.0, 5: 2.0}


def test_long_ways_have_no_limit(spark, monkeypatch):
    n = 104
    v, e = spark.range(n).coalesce(1), spark.range(n - 1).coalesce(1).select("id", F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(0.5).alias("w"))
    start = v.where("id = 0")
    assert {r["id"]: r["distance"] for r in algorithms.bfs(v, e, start).collect()} == {i: i for i in range(n)}
    assert {r["id"]: r["total"] for r in algorithms.shortest_weights(e, start, "w").collect()} == {i: i / 2 for i in range(n)}
    own = PropertyGraph(spark, {"v": v}, {"e": e})
    assert own.V(0).repeat(__.out("e"), until=__.not_(__.out("e"))).to_list() == [n - 1]
    round_ = PropertyGraph(spark, {"v": v}, {"e": spark.createDataFrame([(1, 0, 1), (2, 1, 0)], "id long, src long, dst long")})
    monkeypatch.setattr(traversal, "MOST_ROUNDS", 4)
    with pytest.raises(RuntimeError, match="still on their way"):
        round_.V(0).repeat(__.out("e"), until=__.not_(__.out("e")))
    with pytest.raises(ValueError, match="negative"):
        algorithms.shortest_weights(round_.edge_frame().withColumn("w", F.lit(-1)), start, "w")


def test_changes(spark, g):
    dropped = g.drop_vertices(spark.createDataFrame([(4,)], "id long"))
    assert sorted(dropped.V().to_list()) == [1, 2, 3, 5, 6] and sorted(dropped.E().to_list()) == [7, 9, 12]
    more = g.add_vertices("person", spark.createDataFrame([(7, "new", 1)], "id long, name string, age int")).add_edges("knows", spark.createDataFrame([(20, 7, 1, 0.1)], "id long, src long, dst long, weight double"))
    assert sorted(more.V(1).in_().to_list()) == [7] and g.V(1).in_().to_list() == []
    rows = spark.createDataFrame([(100, "marko"), (101, "ann")], "id long, name string")
    twice = g
    for _ in range(2):
        twice = twice.merge_vertices("person", rows, ["name"], {"age": F.lit(1)}, {"age": F.lit(50)})
    assert sorted((r["name"], r["age"]) for r in twice.vertices["person"].collect() if r["name"] in ("marko", "ann")) == [("ann", 50), ("marko", 50)]
    merged = g.merge_edges("knows", spark.createDataFrame([(1, 2), (2, 4)], "src long, dst long"), {"weight": F.lit(9.0)}, {"weight": F.lit(7.0)})
    assert sorted((r["src"], r["dst"], r["weight"]) for r in merged.edges["knows"].collect()) == [(1, 2, 7.0), (1, 4, 1.0), (2, 4, 9.0)]
    own = PropertyGraph(spark, {"v": spark.createDataFrame([(1, 5), (2, None), (3, 20)], "id long, ttl int")})
    assert sorted(own.live(F.lit(10)).V().to_list()) == [2, 3]


def test_facts(g):
    assert {(r["label"], r["elements"], r["keys"]) for r in g.summary().collect()} == {("person", 4, "age,name"), ("software", 2, "lang,name"), ("knows", 2, "weight"), ("created", 4, "weight")}
    assert {r["id"] for r in g.supernodes(3).collect()} == {1, 3, 4}


def test_numeric_ids(spark):
    texts = ["42", "+42", "-7", "9223372036854775807", "9223372036854775808", "4a", "", "٤"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], ["t"]).select(numeric_id(F.col("t"))).collect()]
    assert got == [42, 42, -7, 9223372036854775807, None, None, None, None]


def test_values_of_several_types(spark):
    own = PropertyGraph(spark, {"a": spark.createDataFrame([(1, 5, ["x", "y"])], "id long, k int, tags array<string>"), "b": spark.createDataFrame([(2, "t")], "id long, k string")})
    assert sorted(own.V().values("k").to_list()) == ["5", "t"]
    assert own.V().has("tags", "y").to_list() == [1] and sorted(own.V().values("tags").to_list()) == ["x", "y"]
    assert own.V().has("tags", P.eq("z")).to_list() == []


def write(path, **files):
    for name, lines in files.items():
        (path / name).mkdir(parents=True)
        (path / name / "part.csv").write_text("\n".join(lines) + "\n")


def test_csv(spark, tmp_path):
    write(
        tmp_path,
        people=["~id,~label,name:string,age:int,companies:string:list,glasses:boolean,since:date,tags:string:set", "1,person,ann,30,a;b;null,TRUE,2020-01-02,x;x;y", "2,person,bob,null,,false,,", "3,person,cy,old,,,,", "4,,dee,4,,maybe,,", ",person,none,1,,,,"],
        things=["~id,defaultText", "9223372036854775808,big", "7,seven", "7,again"],
        drives=["~id,~label,~from,~to,w:double", "10,drives,1,7,0.5", "11,drives,1,99,1", "12,,2,,1", ",drives,2,7,x"],
    )
    v = gremlin_csv.read_vertices(spark, [str(tmp_path / "people"), str(tmp_path / "things")])
    rows = {r["id"]: r for r in v.good.where("name is not null").collect()}
    assert rows.keys() == {1, 2} and v.bad.count() == 3
    assert (rows[1]["age"], rows[1]["companies"], rows[1]["glasses"], rows[1]["tags"]) == (30, ["a", "b"], True, ["x", "y"])
    assert str(rows[1]["since"]) == "2020-01-02 00:00:00" and rows[2]["age"] is None
    assert v.good.where("label = 'vertex'").count() == 3
    assert [(r["id"], r["surplus"]) for r in gremlin_csv.duplicate_ids(v.good).collect()] == [(7, 1)]
    e = gremlin_csv.read_edges(spark, [str(tmp_path / "drives")])
    assert sorted(r["id"] for r in e.good.collect()) == [10, 11] and e.bad.count() == 2
    assert [r["id"] for r in gremlin_csv.dangling_edges(e.good, v.good).collect()] == [11]
    with pytest.raises(ValueError, match="more faults"):
        gremlin_csv.load(spark, [str(tmp_path / "people"), str(tmp_path / "things")], [str(tmp_path / "drives")])
    own = gremlin_csv.load(spark, [str(tmp_path / "people"), str(tmp_path / "things")], [str(tmp_path / "drives")], bad_entries=9, bad_edges=9, duplicates=9)
    assert own.V(1).out("drives").to_list() == [7]
    assert gremlin_csv.verify_sample(v.good.where("id <> 1"), v.good, 1.0).count() == 1
    for bad in ("a:int:cockroach", "a:word"):
        with pytest.raises(ValueError):
            gremlin_csv.parse_header(bad)
    assert gremlin_csv.parse_header("ratio:long:list") == gremlin_csv.Header("ratio:long:list", "ratio", "bigint", "list")


def test_graphml(spark, tmp_path):
    (tmp_path / "g.xml").write_text(
        """<?xml version='1.0'?><graphml><key id='labelV' for='node' attr.name='labelV' attr.type='string'/><key id='code' for='node' attr.name='code' attr.type='string'/>
        <key id='runways' for='node' attr.name='runways' attr.type='int'/><key id='labelE' for='edge' attr.name='labelE' attr.type='string'/><key id='dist' for='edge' attr.name='dist' attr.type='int'/>
        <graph id='G' edgedefault='directed'><node id='1'><data key='labelV'>airport</data><data key='code'>ATL</data><data key='runways'>5</data></node>
        <node id='2'><data key='labelV'>airport</data><data key='code'>ANC</data><data key='runways'>3</data></node><node id='3'><data key='labelV'>country</data><data key='code'>US</data></node>
        <edge id='9' source='1' target='2'><data key='labelE'>route</data><data key='dist'>3400</data></edge></graph></graphml>"""
    )
    own = graph_files.read_graphml(spark, str(tmp_path / "g.xml"))
    assert own.V().has("code", "ATL").out("route").values("code").to_list() == ["ANC"]
    assert own.E().values("dist").to_list() == [3400] and "runways" not in own.vertices["country"].columns


def test_files_round_trip(spark, g, tmp_path):
    graph_files.write_graphson(g, f"{tmp_path}/json")
    back = graph_files.read_graphson(spark, f"{tmp_path}/json")
    assert sorted(back.V(1).out("knows").values("name").to_list()) == ["josh", "vadas"]
    assert sorted(back.E().has("weight", "0.4").to_list()) == [9, 11]
    graph_files.write_parquet(g, f"{tmp_path}/parquet")
    back = graph_files.read_parquet(spark, f"{tmp_path}/parquet", ["person", "software"], ["knows", "created"])
    assert sorted(back.V(4).both().to_list()) == [1, 3, 5]
    near = gremlin_csv.adjacency(g.edge_frame()).where("id = 1").first()["neighbours"]
    assert {k: [x["dst"] for x in v] for k, v in near.items()} == {"knows": [2, 4], "created": [3]}


def test_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    s = F.lit(" Hello ")
    assert [one(f(s)) for f in (strings.trim, strings.l_trim, strings.r_trim, strings.to_upper, strings.to_lower, strings.length)] == ["Hello", "Hello ", " Hello", " HELLO ", " hello ", 7]
    assert [one(strings.substring(F.lit("marko"), *a)) for a in ((1,), (1, 3), (-3,), (-3, -1), (2, 99), (4, 2))] == ["arko", "ar", "rko", "rk", "rko", ""]
    assert one(strings.concat(F.lit("a"), "b", F.lit(None).cast("string"))) == "ab" and one(strings.split(F.lit("a.b"), ".")) == ["a", "b"]
    assert one(strings.format_("%{x} is %{y}", x=F.lit("a"), y=F.lit(3))) == "a is 3" and one(strings.reverse(F.lit("abc"))) == "cba"
    a, b = F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3))
    assert [one(f(a, b)) for f in (lists.combine, lists.merge, lists.intersect, lists.difference, lists.disjunct, lists.product)] == [[1, 2, 2, 3], [1, 2, 3], [2], [1], [1, 3], [[1, 2], [1, 3], [2, 2], [2, 3]]]
    day = dates.as_date(F.lit("2023-08-02T00:00:00Z"))
    assert one(dates.date_diff(dates.date_add(day, "day", 7), day)) == 7 * 86400 and one(dates.as_date(F.lit("no date"))) is None
    assert one(maths.arithmetic("abs(_ - 3) ^ 2 / 2", {"_": F.lit(7)})) == 8.0 and one(maths.arithmetic("1 / _", {"_": F.lit(0)})) is None
    for bad in ("__import__('os')", "x + 1", "'a'"):
        with pytest.raises(ValueError):
            maths.arithmetic(bad, {"_": F.lit(1)})


def test_lists_in_streams(g):
    folded = g.V().values("age").fold()
    assert folded.count_local().to_list() == [4] and folded.sum_local().to_list() == [123.0] and folded.max_local().to_list() == [35]
    assert folded.order_local(desc=True).to_list() == [[35, 32, 29, 27]] and folded.limit_local(2).to_list() == [[27, 29]]
    assert folded.any_(P.gt(34)).count().to_list() == [1] and folded.all_(P.gt(30)).count().to_list() == [0] and folded.none(P.gt(40)).count().to_list() == [1]
    assert [r["index"] for r in folded.index().to_list()] == [0, 1, 2, 3]
    assert sorted(folded.unfold().to_list()) == [27, 29, 32, 35]
    with pytest.raises(Exception, match="stop"):
        g.V().fail("stop").to_list()
    assert g.V().group_count_as("n", "name").out().cap("n").count().to_list() == [6]
    assert sorted(g.V().properties("name").has_value("lop").element().to_list()) == [3]
    assert sorted(g.V(1).map_(__.out().values("name").order()).to_list()) == ["josh"]
