import heapq

import pytest

from skein.plans import registry
from skein.sources.trade import TAG, TAGS, trade_graph
from tests.compare import differences

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(registry.ORACLE))
def test_against_sql(spark, name):
    _, only_ours, only_theirs = differences(spark, registry.QUERIES[name], registry.ORACLE[name], SMALL)
    assert not only_ours and not only_theirs


def test_samples(spark):
    assert registry.QUERIES["sample_n"](spark, SMALL).count() == 25
    assert 0 < registry.QUERIES["coin_p"](spark, SMALL).count() < 150


START = TAGS["user"] * TAG + 3


@pytest.fixture(scope="module")
def follows(spark):
    g = trade_graph(spark, SMALL)
    users = {r["id"] for r in g.vertex_frame(["user"]).select("id").collect()}
    return users, {(r["src"], r["dst"]) for r in g.edge_frame(["follows"]).select("src", "dst").collect()}


def least_sums(users, edges, weight):
    """Dijkstra's method."""
    out: dict = {}
    for a, b in edges:
        out.setdefault(a, []).append((b, weight(a, b)))
    best, todo = {}, [(0, START)]
    while todo:
        d, a = heapq.heappop(todo)
        if a not in best:
            best[a] = d
            for b, w in out.get(a, []):
                heapq.heappush(todo, (d + w, b))
    return best


def test_components_of_all_edges(spark, follows):
    users, edges = follows
    root = {i: i for i in users}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a in users and b in users:
            root[find(a)] = find(b)
    least: dict = {}
    for i in users:
        least[find(i)] = min(str(i), least.get(find(i), str(i)))
    got = registry.QUERIES["connected_components_all"](spark, SMALL).collect()
    assert {r["id"]: r["component"] for r in got} == {i: least[find(i)] for i in users} and len(got) == len(users)


def test_distances_over_all_edges(spark, follows):
    got = registry.QUERIES["bfs_distance_all"](spark, SMALL).collect()
    assert {r["id"]: r["distance"] for r in got} == least_sums(*follows, lambda a, b: 1) and len({r["id"] for r in got}) == len(got)
    got = registry.QUERIES["weighted_distance_all"](spark, SMALL).collect()
    assert {r["id"]: r["total"] for r in got} == least_sums(*follows, lambda a, b: abs(a - b)) and len({r["id"] for r in got}) == len(got)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_files(spark):
    plan = registry.QUERIES["has_eq"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_mktsegment,BUILDING)" in plan and "c_name" not in plan.split("ReadSchema")[1].split("\n")[0]
