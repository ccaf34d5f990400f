"""Greedy and spectral measures by joins against their forms on the driver."""

import random

from graphloom import views
from graphloom.operators import analytics, order, traverse


def graph(spark, edges, n):
    return spark.createDataFrame([(i,) for i in range(n)], "id long"), spark.createDataFrame(edges, "source_id long, target_id long")


def blobs(seed, groups=3, size=7, between=3):
    """Dense groups with a few edges between them."""
    rng, edges = random.Random(seed), []
    for g in range(groups):
        for i in range(size):
            edges += [(g * size + i, g * size + rng.randrange(size)) for _ in range(4)]
    edges += [(rng.randrange(groups * size), rng.randrange(groups * size)) for _ in range(between)]
    edges += [(g * size, (g + 1) * size) for g in range(groups - 1)]
    return [e for e in edges if e[0] != e[1]], groups * size


def test_fiedler_cut_by_joins(spark):
    edges, n = blobs(1, 2, 8, 1)
    nodes, e = graph(spark, edges, n)
    small, large = (analytics.fiedler_cut(nodes, e, 2000, 1e-13, driver_edges=k).first() for k in (1000, 0))
    assert abs(small["lambda2"] - large["lambda2"]) < 2e-5 and abs(small["conductance"] - large["conductance"]) < 1e-6
    assert list(small["side"]) == list(large["side"])
    sides = {r["id"]: r["side"] for r in analytics.fiedler_sides(nodes, e).collect()}
    assert sorted(i for i, s in sides.items() if s) == list(large["side"]) and len(sides) == n
    alone = analytics.fiedler_cut(*graph(spark, [], 3), driver_edges=0).first()
    assert alone["lambda2"] == 0 and alone["conductance"] == 0


def test_communities_by_joins(spark):
    nodes, e = graph(spark, *blobs(3))
    pairs = views.simple_undirected(e)
    quality = {}
    for k in (1000, 0):
        found = analytics.greedy_communities(nodes, e, driver_edges=k)
        assert sorted(r["id"] for r in found.collect()) == list(range(21))
        quality[k] = analytics.modularity(pairs, found).first()["q"]
    assert quality[0] > 0 and quality[0] >= 0.9 * quality[1000]
    star = graph(spark, [(0, i) for i in range(1, 30)], 31)
    assert {r["community"] for r in analytics.greedy_communities(*star, driver_edges=0).filter("id < 30").collect()} == {0}
    assert analytics.greedy_communities(*graph(spark, [(0, 1)], 3), driver_edges=0).count() == 0


def test_communities_by_joins_broadcast_no_table(spark, monkeypatch):
    plans, cut = [], analytics.cut
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def seen(df, name="step"):
        plans.append(plan(df))
        return cut(df, name)

    monkeypatch.setattr(analytics, "cut", seen)
    monkeypatch.setattr(order, "cut", seen)
    nodes, e = graph(spark, *blobs(3))
    found = analytics.greedy_communities(nodes, e, driver_edges=0)
    plans += [plan(found), plan(analytics.modularity(views.simple_undirected(e), found))]
    assert len(plans) > 9 and not [p for p in plans if "BroadcastHashJoin" in p]


def test_feedback_arcs_by_joins(spark):
    for seed in (1, 4):
        rng = random.Random(seed)
        edges = list({(rng.randrange(14), rng.randrange(14)) for _ in range(45)})
        _, e = graph(spark, edges, 14)
        small, large = ({(r[0], r[1]) for r in analytics.feedback_arcs(e, driver_edges=k).collect()} for k in (1000, 0))
        assert len(large) <= len(small) + 2
        kept = [p for p in edges if p not in large and p[0] != p[1]]
        assert traverse.levels(spark.createDataFrame(kept, "a long, b long"))[1].isEmpty()
    assert analytics.feedback_arcs(graph(spark, [(1, 2), (2, 3)], 4)[1], driver_edges=0).count() == 0


def test_feedback_arcs_join_a_round_once(spark, monkeypatch):
    """A round joins its arcs by each end once, and nothing places them after."""
    plans, cut = [], analytics.cut
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def seen(df, name="step"):
        plans.append(plan(df))
        return cut(df, name)

    monkeypatch.setattr(analytics, "cut", seen)
    back = {(p, p % 4) for p in range(10, 30)}
    _, e = graph(spark, [(s, p) for s in range(4) for p in range(10, 30)] + sorted(back), 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = analytics.feedback_arcs(e, driver_edges=0)
        plans.append(plan(found))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {tuple(r) for r in found.collect()} == back
    assert sum(p.count("SortMergeJoin") for p in plans) == 2


def test_peeled_arcs_are_all_edges_once(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(14), rng.randrange(14)) for _ in range(60)] + [(5, 5), (20, 21), (20, 21), (21, 22)]
    _, e = graph(spark, edges, 0)
    rows = [tuple(r) for r in analytics.peeled_arcs(e).collect()]
    assert sorted(r[:2] for r in rows) == sorted(set(edges))
    kept = [r[:2] for r in rows if not r[2] and r[0] != r[1]]
    assert traverse.levels(spark.createDataFrame(kept, "a long, b long"))[1].isEmpty()
    assert not [r for r in rows if r[2] and r[0] == r[1]]
