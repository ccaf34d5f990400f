"""Graph operators on tiny graphs with known answers."""

import hashlib
import itertools
import math

import pytest
from pyspark.sql import functions as F

from graphloom import views
from graphloom.operators import analytics, governance, lineage, rank, telemetry, traverse
from graphloom.resolve import resolve

BARBELL = "AB BC CA CD DE EF FD".split()


def graph(spark, arcs, kind="calls", extra=()):
    ids = sorted({c for a in arcs for c in a} | set(extra))
    nodes = spark.createDataFrame([(i, i, "function", f"src/{i}.py", 1, 10) for i in ids], "id string, name string, node_type string, path string, start_line int, end_line int")
    return nodes, spark.createDataFrame([(a[0], a[1], kind) for a in arcs], "source_id string, target_id string, edge_type string")


def ids(spark, *v):
    return spark.createDataFrame([(x,) for x in v], "id string")


def test_impact_depths_and_ring(spark):
    nodes, edges = graph(spark, "ab bc cd".split(), extra="i")
    got = lambda d: {r["id"] for r in traverse.impact(nodes, edges, ids(spark, "c"), d).collect()}
    assert got(1) == {"b"} and got(2) == {"a", "b"}
    nodes, edges = graph(spark, "xy yz zx".split())
    assert {r["id"] for r in traverse.impact(nodes, edges, ids(spark, "y"), 5).collect()} == {"x", "z"}


def test_dangling_is_traversed_but_not_returned(spark):
    nodes, edges = graph(spark, "ab bc".split())
    found = traverse.impact(nodes.filter("id <> 'b'"), edges, ids(spark, "c"), 3).collect()
    assert [(r["id"], r["depth"]) for r in found] == [("a", 2)]


def test_neighbours_keep_parallels_and_show_loops_twice(spark):
    nodes, edges = graph(spark, "ab ab aa".split())
    found = traverse.neighbours(nodes, edges, ids(spark, "a")).collect()
    assert sorted((r["id"], r["direction"]) for r in found) == [("a", "in"), ("a", "out"), ("b", "out"), ("b", "out")]


def test_shortest_path(spark):
    nodes, edges = graph(spark, "ab bc cd ac".split())
    found = {r["id"]: r["path"] for r in traverse.shortest_paths(nodes, edges, ids(spark, "a")).collect()}
    assert found["d"] == ["a", "c", "d"] and found["a"] == ["a"]


def test_cycles_and_decoupling(spark):
    _, edges = graph(spark, "ab bc ca ba".split(), "imports")
    assert [r["cycle"] for r in traverse.simple_cycles(edges).collect()] == [["a", "b"], ["a", "b", "c"]]
    c = spark.createDataFrame([(["OrderService", "PaymentService"],), (["UserController", "UserModel"],)], "cycle array<string>")
    assert [r["strategy"] for r in governance.decoupling(c).collect()] == ["DEPENDENCY_INVERSION", "SHARED_KERNEL"]


def test_transitive_reduction_and_feedback(spark):
    _, edges = graph(spark, "AB BC AC".split())
    assert [(r[0], r[1]) for r in traverse.transitive_reduction(edges).filter("redundant").collect()] == [("A", "C")]
    assert analytics.feedback_arcs(graph(spark, "AB BC CA".split())[1]).count() == 1
    assert analytics.feedback_arcs(edges).count() == 0


@pytest.mark.parametrize("driver_edges", [500_000, 0])
def test_ranks_agree_on_both_ways(spark, driver_edges):
    nodes, edges = graph(spark, "ab bc cd da ac ac".split(), extra="x")
    got = {r["id"]: r["score"] for r in rank.pagerank(nodes, edges, 5, tolerance=None, driver_edges=driver_edges).collect()}
    assert sum(got.values()) == pytest.approx(1)
    want = dict.fromkeys("abcdx", 0.2)
    out = {"a": "bcc", "b": "c", "c": "d", "d": "a", "x": ""}
    for _ in range(5):
        sink = want["x"] / 5
        want = {k: 0.03 + 0.85 * (sink + sum(want[s] * out[s].count(k) / len(out[s]) for s in out if out[s])) for k in want}
    assert got == pytest.approx(want)
    plain = {r["id"]: r["score"] for r in rank.pagerank_plain(nodes, edges, 3, driver_edges=driver_edges).collect()}
    assert plain["x"] == pytest.approx(0.03)


@pytest.mark.parametrize("driver_edges", [500_000, 0])
def test_spectra(spark, driver_edges):
    nodes, edges = graph(spark, "AB BC CD DA".split())
    r = rank.spectral_radius(nodes, edges, 30, driver_edges=driver_edges).first()
    assert r["radius"] == pytest.approx(1, abs=1e-3) and r["threshold"] == pytest.approx(1, abs=1e-3)
    nodes, edges = graph(spark, "AB BC CD".split())
    assert rank.spectral_radius(nodes, edges, 10, driver_edges=driver_edges).first()["threshold"] == math.inf
    x = {r["id"]: r["impact"] for r in rank.resolvent(nodes, edges, "D", 0.5, 10, driver_edges=driver_edges).collect()}
    assert x["C"] > x["B"] > x["A"] > 0


def test_fiedler_cut(spark):
    r = analytics.fiedler_cut(*graph(spark, BARBELL)).first()
    assert set(r["side"]) in ({"A", "B", "C"}, {"D", "E", "F"}) and r["connected"]
    assert r["lower"] <= r["conductance"] <= r["upper"]


def test_curvature_and_delta(spark):
    pairs = views.simple_undirected(graph(spark, ["".join(p) for p in itertools.combinations("ABCD", 2)])[1])
    assert {r["curvature"] for r in analytics.forman_ricci(pairs).collect()} == {4}
    worst = analytics.forman_ricci(views.simple_undirected(graph(spark, BARBELL)[1])).orderBy("curvature").first()
    assert (worst["u"], worst["v"], worst["curvature"]) == ("C", "D", -2)
    d = analytics.gromov_delta(*graph(spark, "RA RB AX AY".split())).first()
    assert d["delta"] == 0 and d["tree_like"]


def test_communities_and_modularity(spark):
    nodes, edges = graph(spark, "ab bc ca de ef fd cd".split())
    got = {r["id"]: r["community"] for r in analytics.greedy_communities(nodes, edges).collect()}
    assert got == dict(zip("abcdef", "aaaddd"))
    m = spark.createDataFrame(list(got.items()), "id string, community string")
    assert analytics.modularity(views.simple_undirected(edges), m).first()["q"] > 0.1
    assert analytics.greedy_communities(*graph(spark, [], extra="a")).count() == 0


def test_entropy_grows(spark):
    e = lambda arcs: analytics.degree_entropy(graph(spark, arcs)[1]).first()["entropy"]
    assert e("AB AC AD BE".split()) > e(["AB"])


def test_reach_has_no_depth_bound(spark):
    name = [f"v{i:02}" for i in range(25)]
    arcs = [*zip(name, name[1:]), (name[0], name[12]), (name[0], name[24])]
    edges = spark.createDataFrame([(a, b, "calls") for a, b in arcs], "source_id string, target_id string, edge_type string")
    assert traverse.descendants(edges, ids(spark, "v00")).count() == 24
    assert traverse.descendants(edges.filter("source_id <> 'v00' OR target_id = 'v01'"), ids(spark, "v00")).count() == 24
    assert traverse.descendants(edges, ids(spark, "v24"), max_depth=3, reverse=True).count() == 4
    short = traverse.transitive_reduction(edges).filter("redundant").collect()
    assert sorted((r[0], r[1]) for r in short) == [("v00", "v12"), ("v00", "v24")]


def test_causal(spark):
    rows = [r for r, n in (((1, 1, 1), 64), ((1, 1, 0), 16), ((1, 0, 1), 16), ((1, 0, 0), 4), ((0, 1, 1), 1), ((0, 1, 0), 9), ((0, 0, 1), 9), ((0, 0, 0), 81)) for _ in range(n)]
    r = analytics.causal_effect(spark.createDataFrame(rows, "z int, x int, y int"), "x", "y", ["z"]).first()
    assert abs(r["average_causal_effect"]) < 1e-4 and r["naive_difference"] > 0.4 and r["confounded"]
    empty = analytics.causal_effect(spark.createDataFrame([], "z int, x int, y int"), "x", "y", ["z"]).first()
    assert empty["n"] == 0 and empty["average_causal_effect"] == 0
    _, edges = graph(spark, "ZX ZY XY".split())
    assert analytics.backdoor_admissible(edges, "X", "Y", ["Z"]) and not analytics.backdoor_admissible(edges, "X", "Y", [])
    assert analytics.adjustment_set(edges, "X", "Y") == ["Z"]
    assert analytics.backdoor_paths(graph(spark, "XW YW".split())[1], "X", "Y").count() == 0


def test_dead_code(spark):
    nodes = spark.createDataFrame([("f:main", "main", "function", "src/a.py", 1, 5), ("f:h", "_orphan_helper", "function", "src/a.py", 10, 25)], "id string, name string, node_type string, path string, start_line int, end_line int")
    edges = spark.createDataFrame([], "source_id string, target_id string, edge_type string")
    assert [(r["name"], r["confidence"], r["lines"]) for r in governance.dead_code(nodes, edges, "high").collect()] == [("_orphan_helper", "high", 16)]


def test_scorecard_ends_are_dealt_before_they_are_distinct(spark):
    nodes = spark.createDataFrame([("a", "a", "function", "x.py"), ("b", "b", "function", "x.py")], "id string, name string, node_type string, path string")
    edges = spark.createDataFrame([("a", "b", "verifies")] * 3, "source_id string, target_id string, edge_type string")
    r = governance.scorecard(nodes, edges, spark.createDataFrame([], "cycle array<string>"))
    assert r._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= 3
    assert (r.first()["isolated"], r.first()["code_units"], r.first()["verified_ratio"]) == (0, 2, 0.5)


def test_scorecard_verified_share(spark):
    nodes, _ = graph(spark, [], extra="abcdef")
    edges = spark.createDataFrame([("t", c, "verifies") for c in "abcde"], "source_id string, target_id string, edge_type string")
    r = governance.scorecard(nodes, edges, spark.createDataFrame([], "cycle array<string>")).first()
    assert r["verified_ratio"] == 0.83 and r["score"] == 98 and r["grade"] == "A+"


def test_merkle(spark):
    leaves = [c * 64 for c in "abcd"]
    df = lambda v: spark.createDataFrame([(x,) for x in v], "leaf string")
    h = lambda a, b: hashlib.sha256(f"{a}:{b}".encode()).hexdigest()
    want = h(h(leaves[0], leaves[1]), h(leaves[2], leaves[3]))
    assert governance.merkle_root(df(leaves)) == governance.merkle_root(df(leaves[::-1])) == want
    assert governance.merkle_root(df(leaves[:3])) == h(h(leaves[0], leaves[1]), h(leaves[2], leaves[2]))
    assert len(governance.merkle_root(df([]))) == 64
    edges = spark.createDataFrame([("a", "b", "calls")], "source_id string, target_id string, edge_type string")
    signed = governance.attest(edges, 0, "key", "salt")
    assert governance.verify_attestation(signed, "key") and not governance.verify_attestation(signed | {"edges": 9}, "key")


def test_heat_levels(spark):
    t = spark.createDataFrame([("charge", 1000, 50.0, 0.25), ("query", 10000, 2.0, 0.0)], "node_id string, call_count long, avg_duration_ms double, error_rate double")
    got = {r["node_id"]: (r["heat"], r["level"]) for r in telemetry.heat(t).collect()}
    assert got == {"charge": (0.4, "CRITICAL"), "query": (0.512, "HIGH")}


def test_traffic_tiers(spark):
    hit = spark.createDataFrame([("t", "a", 1), ("t", "b", 1), ("t", "c", 2), ("u", "z", 1)], "target string, id string, depth int")
    tel = spark.createDataFrame([("a", 45000, 0.0), ("b", 5000, 0.16)], "node_id string, call_count long, error_rate double")
    got = {r["target"]: (r["tier"], r["active"], r["dormant"]) for r in telemetry.traffic_risk(hit, tel).collect()}
    assert got == {"t": ("P0_CRITICAL", 2, 1), "u": ("P4_DORMANT", 0, 1)}


def test_regression(spark):
    p = lambda v: spark.createDataFrame(v, "node_id string, p95_duration_ms double")
    got = {r["node_id"]: (r["delta_pct"], r["verdict"]) for r in telemetry.regression(p([("a", 15.0), ("b", 1.0), ("c", 5.0)]), p([("a", 10.0), ("c", 10.0)])).collect()}
    assert got == {"a": (50.0, "REGRESSION"), "b": (0.0, "PASSED"), "c": (-50.0, "IMPROVED")}


def test_resolution_is_honest(spark):
    nodes = spark.createDataFrame([("f1", "validate", "a.py"), ("f2", "validate", "b.py"), ("story:S-1", "s", "c.md")], "id string, name string, path string")
    got = {r["query"]: (r["status"], r["selected"]) for r in resolve(nodes, spark.createDataFrame([("validate",), ("S-1",), ("a.py",), ("no",)], "query string")).collect()}
    assert got == {"validate": ("ambiguous", None), "S-1": ("resolved", "story:S-1"), "a.py": ("resolved", "f1"), "no": ("unresolved", None)}


def test_lineage(spark):
    spans = spark.createDataFrame([(1, "GET", "/u/{id}"), (2, "POST", "/u/{id}")], "span_id int, http_method string, http_route string")
    points = spark.createDataFrame([("endpoint:GET:/u/:x", "GET", "/u/:x")], "id string, method string, path string")
    assert [(r["span_id"], r["endpoint"]) for r in lineage.match_routes(spans, points).collect()] == [(1, "endpoint:GET:/u/:x")]
    calls = spark.createDataFrame([("http://svc/api/v1/orders?x=1",)], "url string")
    routes = spark.createDataFrame([("/orders",), ("/v1/orders",)], "route string")
    assert lineage.cross_repository(calls, routes).first()["route"] == "/v1/orders"


def test_longest_prefix_and_boundaries(spark):
    files = spark.createDataFrame([("pkg/a/x.py", "pkg/b/y.py")], "source string, target string")
    packages = spark.createDataFrame([("a", "pkg/a"), ("b", "pkg/b"), ("all", "pkg")], "name string, path string")
    none = spark.createDataFrame([], "source string, target string")
    assert [(r["source"], r["target"]) for r in governance.undeclared_packages(files, packages, none).collect()] == [("a", "b")]
    assert governance.undeclared_packages(files, packages, spark.createDataFrame([("a", "b")], "source string, target string")).count() == 0


def test_percentile_by_place(spark):
    rows = [(n, float(i)) for n in range(1, 30) for i in range(n)]
    spans = spark.createDataFrame(rows, "service_name int, duration_ms double").withColumn("is_error", F.lit(False))
    got = {r["node_id"]: r["p95_duration_ms"] for r in telemetry.by_target(spans).collect()}
    assert got == {n: float(int(0.95 * n)) for n in range(1, 30)}
