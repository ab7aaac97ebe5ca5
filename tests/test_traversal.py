import pytest
from pyspark.sql import functions as F

from skein.functions import strings
from skein.operators.predicates import P, TextP
from skein.operators.traversal import T, __
from tests.modern import modern


@pytest.fixture(scope="module")
def g(spark):
    return modern(spark)


def ids(t):
    return sorted(t.to_list())


def test_starts(g):
    assert ids(g.V()) == [1, 2, 3, 4, 5, 6]
    assert ids(g.V(1, "2")) == [1, 2]
    assert ids(g.V(None)) == []
    assert ids(g.E()) == [7, 8, 9, 10, 11, 12]
    assert ids(g.E(7)) == [7]
    assert sorted(g.inject(1, 2).to_list()) == [1, 2]


def test_has(g):
    assert ids(g.V().has("name", "marko")) == [1]
    assert ids(g.V().has("person", "age", P.gt(30))) == [4, 6]
    assert ids(g.V().has("age")) == [1, 2, 4, 6]
    assert ids(g.V().has_not("age")) == [3, 5]
    assert ids(g.V().hasLabel("software")) == [3, 5]
    assert ids(g.V().has_id(P.neq(1))) == [2, 3, 4, 5, 6]
    assert ids(g.V().has_id()) == []
    assert ids(g.V().has("age", P.between(27, 32))) == [1, 2]
    assert ids(g.V().has("age", P.inside(27, 32))) == [1]
    assert ids(g.V().has("age", P.outside(28, 33))) == [2, 6]
    assert ids(g.V().has("age", P.within(27, 35))) == [2, 6]
    assert ids(g.V().has("age", P.without(27, 35))) == [1, 4]
    assert ids(g.V().has("age", P.gt(28) & P.lt(33))) == [1, 4]
    assert ids(g.V().has("age", P.lt(28) | P.gt(33))) == [2, 6]
    assert ids(g.V().has("name", TextP.starting_with("m"))) == [1]
    assert ids(g.V().has("name", TextP.not_containing("o"))) == [2, 5, 6]
    assert ids(g.V().has("name", TextP.regex("^(jo|pe)"))) == [4, 6]


def test_hops(g):
    assert ids(g.V(1).out()) == [2, 3, 4]
    assert ids(g.V(1).out("knows")) == [2, 4]
    assert ids(g.V(3).in_()) == [1, 4, 6]
    assert ids(g.V(4).both()) == [1, 3, 5]
    assert ids(g.V(4).both_e().other_v()) == [1, 3, 5]
    assert ids(g.V(4).both_e().has("weight", P.lt(1.0)).other_v()) == [3]
    assert ids(g.V().has_label("person").out().out_e()) == [10, 11]
    assert ids(g.E(8).both_v()) == [1, 4]
    assert len(ids(g.V().out_e().not_(__.has_label("knows")).other_v())) == 4
    assert ids(g.V().out_e().not_(__.has_label("knows")).other_v().has("name", "ripple")) == [5]
    assert ids(g.V().out_e().not_(__.has_label("knows")).other_v().has_label("test")) == []
    assert len(g.V().local(__.both_e("created").limit(1)).other_v().values("name").to_list()) == 5


def test_view_of_persons(g):
    own = g.filtered(lambda f, label: f if label == "person" else f.limit(0))
    assert ids(own.V().out()) == [2, 4]


def test_inner_filters(g):
    assert ids(g.V().where(__.out("created"))) == [1, 4, 6]
    assert ids(g.V().not_(__.out())) == [2, 3, 5]
    assert ids(g.V().where(__.out("created").count().is_(P.gte(2)))) == [4]
    assert ids(g.V().where(__.out().count().is_(0))) == [2, 3, 5]
    assert ids(g.V().and_(__.out("knows"), __.out("created"))) == [1]
    assert ids(g.V().or_(__.out("knows"), __.in_("created"))) == [1, 3, 5]
    assert ids(g.V().where(__.out().has_id(3))) == [1, 4, 6]


def test_reducing(g):
    assert g.V().count().to_list() == [6]
    assert g.V().has("name", "x").count().to_list() == [0]
    assert g.V().values("age").sum_().to_list() == [123]
    assert g.V().values("age").mean().to_list() == [30.75]
    assert g.V().values("age").max_().to_list() == [35]
    assert g.V().has("name", "x").values("age").min_().to_list() == []
    assert {r["key"]: r["value"] for r in g.V().group_count(T.label).to_list()} == {"person": 4, "software": 2}
    assert {r["key"]: r["value"] for r in g.V().group(T.label, "age", F.sum).to_list()} == {"person": 123, "software": None}
    assert {r["key"]: r["value"] for r in g.V().group_count(__.out().count()).to_list()} == {0: 3, 1: 1, 2: 1, 3: 1}
    assert sorted(g.V().local(__.out_e().count()).to_list()) == [0, 0, 0, 1, 2, 3]
    assert g.V().values("age").fold().to_list() == [[27, 29, 32, 35]]
    assert g.V().values("age").fold(0, lambda a, x: a + x).to_list() == [123]
    assert sorted(g.V().store("a", "name").out().cap("a").to_list()) == ["josh", "lop", "marko", "peter", "ripple", "vadas"]


def test_projections(g):
    out = g.V().project("id", "ageSum", by=[T.id, __.coalesce(__.both().dedup().values("age").sum_(), __.constant(0))]).order(("ageSum", "desc")).to_list()
    assert len(out) == 6 and [r["ageSum"] for r in out][:2] == [96, 59]
    assert g.V(1).element_map("name").to_list() == [{"id": 1, "label": "person", "name": "marko"}]
    assert g.V(1).value_map("name", "age").to_list() == [{"name": ["marko"], "age": [29]}]
    assert len(g.E().properties().to_list()) == 6
    assert sorted(g.V().as_("a").label().select("a").to_list()) == [1, 2, 3, 4, 5, 6]
    assert g.V().out_e().as_("e").in_v().as_("v").select("e").order("weight").select("v").values("name").dedup().count().to_list() == [4]
    assert g.V(1).out("knows").as_("b").in_("knows").as_("a").select("a", "b", by="name").to_list()[0]["a"] == "marko"
    assert g.V(1).values("name").apply(lambda c: strings.substring(c, 1, -1)).to_list() == ["ark"]
    assert g.V(1).values("age").math("_ % 2 + 1").to_list() == [2.0]


def test_order_and_slices(g):
    assert g.V().has_label("person").order("age").values("name").to_list() == ["vadas", "marko", "josh", "peter"]
    assert g.V().has_label("person").order(("age", "desc")).limit(2).values("name").to_list() == ["peter", "josh"]
    assert g.V().has_label("person").order("age").tail(2).values("name").to_list() == ["josh", "peter"]
    assert g.V().has_label("person").order("age").range_(1, 3).values("name").to_list() == ["marko", "josh"]
    assert g.V().has_label("person").order("age").skip(3).values("name").to_list() == ["peter"]
    assert len(g.V(1).out().limit(2).to_list()) == 2
    assert len(g.V().out_e().order(("weight", "desc")).values("weight").to_list()) == 6
    assert len(g.V().sample(2).to_list()) == 2


def test_branches(g):
    assert sorted(g.V(1).union(__.out("knows"), __.out("created")).to_list()) == [2, 3, 4]
    assert g.V().union().to_list() == []
    assert sorted(g.V().coalesce(__.out("knows"), __.in_("created")).to_list()) == [1, 2, 4, 4, 4, 6]
    assert sorted(g.V().optional(__.out("knows")).to_list()) == [2, 2, 3, 4, 4, 5, 6]
    assert sorted(g.V().choose(__.has("age", P.gt(30)), __.out("created"), __.identity()).to_list()) == [1, 2, 3, 3, 3, 5, 5]
    assert sorted(g.V().choose(T.label, options={"person": __.constant("p"), "software": __.constant("s")}).to_list()) == ["p"] * 4 + ["s"] * 2


def test_loops(g):
    assert sorted(g.V(1).repeat(__.out(), times=2).values("name").to_list()) == ["lop", "ripple"]
    assert sorted(g.V(1).repeat(__.out(), times=2, emit=True).to_list()) == [2, 3, 3, 4, 5]
    assert sorted(g.V(1).repeat(__.out(), until=__.not_(__.out())).to_list()) == [2, 3, 3, 5]
    plain = g.V(1)
    for _ in range(4):
        plain = plain.both()
    merged = g.V(1).repeat(__.both(), times=4)
    assert merged.count().to_list() == plain.count().to_list()
    assert merged.df.count() <= 6
    assert sorted(g.V(1).track("name").out().out().path().to_list()) == [["marko", "josh", "lop"], ["marko", "josh", "ripple"]]
    assert sorted(g.V(1).track().both().both().simple_path().to_list()) == [3, 4, 5, 6]
    assert sorted(g.V(1).with_sack(0.0).out_e().sack("sum", "weight").in_v().sack().to_list()) == [0.4, 0.5, 1.0]
    assert len(g.V().match(("a", __.out(), "b")).to_list()) == 6
    found = g.V().match(("a", __.out("knows"), "b"), ("b", __.out("created"), "c")).to_list()
    assert sorted(r["c"] for r in found) == [3, 5] and {(r["a"], r["b"]) for r in found} == {(1, 4)}


def test_subgraph_and_plans(g):
    assert ids(g.E().has_label("knows").subgraph().V()) == [1, 2, 4]
    # neighbours' ids are read from the edges alone; their names need the vertices
    joins = lambda t: t.df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(g.V(1).out("knows").id()) == 1
    assert joins(g.V(1).out("knows").values("name")) == 2


def test_match_binds_in_turn(g):
    rows = g.V(1).match(("a", __.out("knows"), "b"), ("b", __.out("created"), "c")).to_list()
    assert sorted((r["a"], r["b"], r["c"]) for r in rows) == [(1, 4, 3), (1, 4, 5)]
    back = g.V().match(("a", __.out("created"), "b"), ("c", __.out("created"), "b"), ("c", __.values("name"), "n")).to_list()
    assert len(back) == 10 and {r["n"] for r in back if r["a"] == 1} == {"marko", "josh", "peter"}


def test_lists_keep_the_order(g):
    assert g.V().order(("age", "desc")).values("age").fold().to_list() == [[35, 32, 29, 27]]
    assert g.V().order("age").values("name").fold().to_list() == [["vadas", "marko", "josh", "peter"]]
    rows = g.V().has_label("person").order(("age", "desc")).group(by=__.label(), value="name").to_list()
    assert rows == [{"key": "person", "value": ["peter", "josh", "marko", "vadas"]}]


def test_ordered_inner_values(g):
    rows = g.V(1).project("n", by=[__.out("knows").order(("name", "desc")).values("name")]).to_list()
    assert rows == [{"n": "vadas"}]
    assert g.V(1).map_(__.out().order(("name", "desc")).values("name")).to_list() == ["vadas"]


def test_group_with_an_inner_traversal(g):
    rows = g.V().group(by=T.label, within=__.out("created").count()).to_list()
    assert sorted((r["key"], r["value"]) for r in rows) == [("person", 4), ("software", 0)]
    rows = g.V().has_label("person").group(by=T.label, within=__.both_e().values("weight").order(("value", "desc")).limit(2).fold()).to_list()
    assert rows == [{"key": "person", "value": [1.0, 1.0]}]


def test_paths_with_edges(g):
    paths = g.V(1).track("name", "weight").out_e("created").in_v().path().to_list()
    assert paths == [["marko", "0.4", "lop"]]
    assert sorted(g.V(4).track().out("created").path().to_list()) == [["4", "3"], ["4", "5"]]
    assert g.V(4).track(T.label).out("created").limit(1).path().to_list() == [["person", "software"]]


def test_comparison_of_marks(g):
    pairs = g.V().has_label("person").as_("a").out("created").in_("created").as_("b")
    assert pairs.where("a", P.lt("b"), by="age").select("a", "b", by=["name", "name"]).count().to_list() == [3]
    assert len(pairs.where(P.neq("a")).to_list()) == 6 and len(pairs.where("a", "b").to_list()) == 4


def test_text_ids(spark):
    from skein.graph import PropertyGraph, id_key

    rows = spark.createDataFrame([("x-1", 1), ("9223372036854775809", 2), ("7", 3), (None, 4)], "t string, k int")
    own = PropertyGraph(spark, {"a": rows.select(id_key(F.col("t")).alias("id"), F.col("t").alias("id_text"), "k")})
    assert own.V("x-1").values("k").to_list() == [1] and own.V(9223372036854775809).values("k").to_list() == [2]
    assert own.V("7").values("id_text").to_list() == ["7"] == own.V(7).values("id_text").to_list()
    assert own.V().has_id("x-1", "7").count().to_list() == [2] and own.V("none").to_list() == []


@pytest.fixture(scope="module")
def meeting(spark):
    """Two kinds of vertices that meet at hubs, with ties, nulls, not-a-numbers, missing ends and double edges."""
    from skein.graph import PropertyGraph

    nan = float("nan")
    x = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0), (4, None), (5, nan), (6, -0.0), (7, 3.0)], "id long, v double")
    y = spark.createDataFrame([(11, 2.0), (12, 2.0), (13, nan), (14, None), (15, 0.0), (16, -1.0)], "id long, v double")
    z = spark.createDataFrame([(21, 2), (22, 0), (23, None), (24, 9)], "id long, v int")
    hub = spark.createDataFrame([(31,), (32,), (33,)], "id long")
    at = lambda first, ends: spark.createDataFrame([(first + i, a, b) for i, (a, b) in enumerate(ends)], "id long, src long, dst long")
    x_in = at(100, [(i, 31) for i in range(1, 8)] + [(1, 32), (3, 32), (3, 32), (99, 31), (7, 33), (2, None)])
    y_in = at(200, [(i, 31) for i in range(11, 17)] + [(11, 32), (15, 32), (15, 32), (98, 31), (16, None)])
    z_in = at(300, [(i, 31) for i in range(21, 25)] + [(24, 33)])
    ends = {k + "_in": ((k,), ("hub",)) for k in "xyz"}
    return PropertyGraph(spark, {"x": x, "y": y, "z": z, "hub": hub}, {"x_in": x_in, "y_in": y_in, "z_in": z_in}, ends)


COMPARED = [lambda a, b: a < b, lambda a, b: a <= b, lambda a, b: b < a, lambda a, b: a >= b, lambda a, b: a == b, lambda a, b: a != b]


def test_counts_of_compared_marks(meeting):
    with_ = lambda other: meeting.V(labels=["x"]).as_("a").out("x_in").in_(other + "_in").as_("b")
    cases = [("y", f, "a", "b", "v") for f in COMPARED] + [("x", f, "a", "b", None) for f in COMPARED] + [(k, COMPARED[0], "b", "a", "v") for k in "yz"] + [("z", COMPARED[3], "a", "b", "v")]
    for other, f, a, b, by in cases:
        t = with_(other).where_marked(a, f, b, by=by)
        assert t._counted() is not t and t.count().to_list() == [t.df.count()]
    pairs = with_("y")
    # at 31 three for 1.0, one for each 2.0, three for -0.0 and one for 3.0; at 32 one for 1.0
    assert pairs.where("a", P.lt("b"), by="v").count().to_list() == [3 + 2 + 3 + 1 + 1]
    # other functions, and steps in between, are left to the pairs
    for t in (pairs.where_marked("a", lambda a, b: a + 1 < b, "b", by="v"), pairs.has("v", P.gt(0)).where("a", P.lt("b"), by="v"), pairs.as_("a").where("a", P.lt("b"), by="v")):
        assert t._counted() is t and t.count().to_list() == [t.df.count()]


def test_counts_of_compared_marks_elsewhere(meeting):
    x = meeting.V(labels=["x"]).as_("a")
    t = x.both("x_in").both("x_in").where(P.neq("a"))
    assert t._counted() is not t and t.count().to_list() == [t.df.count()] and t.df.count() > 0
    merged = x.out("x_in").barrier().in_("y_in").as_("b").where("a", P.lte("b"), by="v")
    assert merged._counted() is not merged and merged.count().to_list() == [len(merged.to_list())]
    assert x.out("x_in").in_("y_in").as_("b").where("a", P.lt("b"), by="v").has("v", 2.0).count().to_list() == [5]
    # in an inner traversal, for each object; id() leads back to the pairs
    found = lambda t: t.in_("x_in").as_("a").out("x_in").in_("y_in").as_("b").where("a", P.lt("b"), by="v")
    rows = meeting.V(labels=["hub"]).project("n", "pairs", by=[lambda t: found(t).count(), lambda t: found(t).id().count()]).to_list()
    assert [r["n"] for r in rows] == [r["pairs"] for r in rows] and sorted(r["n"] for r in rows) == [1, 6, 10]


def test_counts_of_compared_marks_at_a_supernode(spark):
    """10 ** 12 pairs, which would take hours."""
    from threading import Timer

    from skein.graph import PropertyGraph

    n = 1_000_000
    a, b = spark.range(n).selectExpr("id", "id * 7 % 1000000 as v"), spark.range(n, 2 * n).selectExpr("id", "id * 11 % 1000000 as v")
    edges = {k: f.selectExpr("id", "id as src", "-1L as dst") for k, f in (("a_in", a), ("b_in", b))}
    own = PropertyGraph(spark, {"a": a, "b": b, "hub": spark.range(-1, 0).toDF("id")}, edges, {"a_in": (("a",), ("hub",)), "b_in": (("b",), ("hub",))})
    stop = Timer(90, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        pairs = own.V(labels=["a"]).as_("a").out("a_in").in_("b_in").as_("b")
        assert pairs.where_marked("a", lambda x, y: x < y, "b", by="v").count().to_list() == [n * (n - 1) // 2]
    finally:
        stop.cancel()


def stages(spark) -> dict[int, int]:
    """The records that each stage has written into a shuffle."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return {s.stageId(): s.shuffleWriteRecords() for s in (found.apply(i) for i in range(found.size()))}


def test_comparison_over_edges_shuffles_no_pairs(spark):
    """100 of 1,000 lines of one part make 10 ** 5 pairs with all of them."""
    from skein.graph import PropertyGraph

    n = 1000
    orders = spark.range(n).selectExpr("id", "id * 7 % 1000 as price")
    lines = spark.range(n).selectExpr("id", "id as src", "-1L as dst", "id % 50 as quantity")
    own = PropertyGraph(spark, {"order": orders, "part": spark.range(-1, 0).toDF("id")}, {"contains": lines}, {"contains": (("order",), ("part",))})
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = stages(spark)
        pairs = own.V(labels=["order"]).as_("a").out_e("contains").has("quantity", P.gt(44)).in_v().in_("contains").as_("b")
        assert pairs.where("a", P.lt("b"), by="price").count().to_list() == [sum(n - 1 - i * 7 % n for i in range(n) if i % 50 > 44)]
        assert 0 < sum(n for i, n in stages(spark).items() if i not in before) < 10 * n
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
