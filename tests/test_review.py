"""Change review, boundaries, resolution, packs: small graphs by hand."""

import random

from graphloom.operators import boundaries, change, context, governance, order, retrieval, summary, telemetry, traverse
from graphloom.resolve import resolve_first, resolve_symbols, resolve_targets
from pyspark.sql import functions as F

NODES = "id string, name string, node_type string, path string, start_line int, end_line int, docstring string"
EDGES = "source_id string, target_id string, edge_type string"


def nodes(spark, *rows):
    return spark.createDataFrame([(*r, *[None] * (7 - len(r))) for r in rows], NODES)


def edges(spark, *rows):
    return spark.createDataFrame(list(rows), EDGES)


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()), key=str)


def test_change_review(spark):
    n = nodes(spark, ("f", "run", "function", "a.py", 10, 20), ("g", "go", "function", "a.py", None, None), ("v", "x", "variable", "b.py", 1, 1), ("e", "GET /", "endpoint", "a.py"), ("e2", "GET /b", "endpoint", "a.py"), ("st", "Login", "story", "s.md"), ("file:a.py", "a.py", "file", "a.py"))
    e = edges(spark, ("e", "f", "routes_to"), ("e2", "h", "routes_to"), ("h", "f", "injects"), ("g", "f", "calls"), ("g", "f", "calls"), ("st", "file:a.py", "references"), ("f", "t", "publishes"), ("z", "t", "subscribes"))
    hunks = spark.createDataFrame([("a.py", 20, 25), ("a.py", 12, 12), ("b.py", 2, 9)], "path string, start int, end int")
    assert values(change.changed_symbols(n, e, hunks), "id", "callers", "impacted", "risk") == [("f", 2, 3, "MODERATE")]
    changed = spark.createDataFrame([("f",)], "id string")
    assert values(change.touched_routes(n, e, changed), "endpoint", "reason") == [("e", "Handler modified"), ("e2", "Dependency touched (1)")]
    assert values(change.touched_topics(e, changed), "topic", "publishers", "subscribers") == [("t", 1, 0)]
    files = spark.createDataFrame([("a.py",), ("new.py",), (".x/y.py",)], "path string")
    assert values(change.affected_stories(n, e, files), "story") == ["Login"] and values(change.unlinked_files(n, files), "path") == ["new.py"]
    found = lambda *s: spark.createDataFrame([(x,) for x in s], "severity string")
    assert [change.findings_verdict(found(*s), strict).first()["verdict"] for s, strict in ((("WARNING", "ERROR"), False), (("WARNING",), False), (("WARNING",), True), ((), True))] == ["BLOCKED", "WARNING", "BLOCKED", "APPROVED"]
    t = spark.createDataFrame([("f", 200, 0.2)], "node_id string, call_count long, error_rate double")
    symbols = spark.createDataFrame([("f", "MODERATE")], "id string, risk string")
    worst = change.change_verdict(symbols, t, found()).first()
    assert (worst["tier"], worst["verdict"]) == ("P0_CRITICAL", "BLOCKED")
    assert change.change_verdict(symbols.limit(0), t, found()).first()["verdict"] == "APPROVED"
    proofs = spark.createDataFrame([("a", True), ("b", True)], "story string, can_ship boolean")
    assert change.release_gate(proofs).first()["verdict"] == "APPROVED" and change.release_gate(proofs.limit(0)).first()["verdict"] == "BLOCKED"


def test_dead_code_by_text(spark):
    n = nodes(spark, ("a", "_used", "function", "a.py", 1, 2), ("b", "_own", "function", "a.py", 3, 4), ("c", "_other", "function", "a.py", 5, 6), ("d", "_dead", "function", "a.py", 7, 8), ("s", "_heard", "function", "b.py", 1, 1))
    e = edges(spark, ("x", "a", "calls"), ("s", "topic:t", "subscribes"))
    texts = spark.createDataFrame([("a.py", "def _used():\n  pass\ndef _own():\n  _own\ndef _other(): _x\n pass\ndef _dead():\n  pass\n_own()\n"), ("b.py", "import _other\n_deadly")], "path string, text string")
    assert values(governance.dead_code(n, e, texts=texts), "id", "confidence", "safe") == [("c", "low", False), ("d", "high", True)]
    assert values(change.prune_plan(governance.dead_code(n, e, texts=texts)), "id") == ["d"]


def test_boundaries(spark):
    p = spark.createDataFrame([("@a/ui", "packages/ui", "a", ["./src/Index.ts"]), ("core", "packages/core", None, []), ("deep", "packages/ui/deep", None, [])], "name string, path string, scope string, exports array<string>")
    links = spark.createDataFrame([("packages/core/x.ts", t) for t in ("packages/ui/src/index.ts", "packages/ui/src/hidden.ts", "packages/ui/deep/internal/y.ts", "packages/core/z.ts")], "source string, target string")
    e = boundaries.package_edges(links, p)
    assert values(e, "target", "to") == [("packages/ui/deep/internal/y.ts", "deep"), ("packages/ui/src/hidden.ts", "@a/ui"), ("packages/ui/src/index.ts", "@a/ui")]
    assert values(boundaries.internal_imports(e, p), "target") == ["packages/ui/deep/internal/y.ts", "packages/ui/src/hidden.ts"]
    g = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "from string, to string")
    assert [r["cycle"] for r in boundaries.package_cycles(g).collect()] == [["a", "b", "c", "a"]]
    aliases = spark.createDataFrame([("@", "src"), ("@/lib/", "vendor/lib/"), ("x", ".")], "prefix string, target string")
    names = spark.createDataFrame([(x,) for x in ("@/a/b", "@/lib", "@/lib/c", "@other", "x/y")], "name string")
    assert dict(values(boundaries.resolve_alias(names, aliases), "name", "resolved")) == {"@/a/b": "src/a/b", "@/lib": "vendor/lib", "@/lib/c": "vendor/lib/c", "@other": "@other", "x/y": "./y"}


def test_resolution(spark):
    n = nodes(spark, ("f1", "run", "function", "a.py"), ("f2", "run", "class", "b.py"), ("m", "run", "file", "c.py"), ("story:S-1", "S", "story", "s.md"), ("q", "big order book", "function", "z/q.py"))
    w = spark.createDataFrame([("run",), ("S-1",), ("nope",), (" ",)], "query string")
    assert {r["query"]: r["selected"] for r in resolve_first(n, w).collect() if r["query"]} == {"run": "f1", "S-1": "story:S-1", "nope": None}
    t = spark.createDataFrame([(x,) for x in ("f2", "RUN", "call(a, b) run(1)", "x/y.py:run", "order book", "unknown thing", None)], "target string")
    assert values(resolve_targets(n, t), "target", "id", "tier") == [("RUN", "f1", 2), ("call(a, b) run(1)", "f1", 3), ("f2", "f2", 1), ("order book", "q", 5), ("x/y.py:run", "f1", 4)]
    prog = nodes(
        spark, ("s1", "load", "function", "src/db.py"), ("s2", "load", "function", "src/io.py"), ("s3", "once", "function", "src/one.py"), ("i1", "src.db.load", "import", "app.py"), ("i2", "once", "import", "tests/test_a.py"),
        ("func:app.py:main", "main", "method", "app.py"), ("func:tests/test_a.py:t", "t", "method", "tests/test_a.py"),
    )
    calls = edges(spark, ("func:app.py:main", "func_call:load", "calls"), ("func:tests/test_a.py:t", "func_call:load", "calls"), ("func:tests/test_a.py:t", "func_call:once", "calls"), ("func:app.py:main", "func_call:gone", "calls"))
    got, links = resolve_symbols(prog, calls, spark.createDataFrame([], "prefix string, target string"))
    assert values(got, "source_id", "callee", "target_id", "status") == [
        ("func:app.py:main", "gone", None, "unresolved"), ("func:app.py:main", "load", "s1", "resolved"),
        ("func:tests/test_a.py:t", "load", None, "ambiguous"), ("func:tests/test_a.py:t", "once", "s3", "resolved"),
    ]
    assert ("i2", "s3", "references", "resolved") in values(links, *links.columns) and ("i2", "s3", "verifies", "test_import_proof") in values(links, *links.columns)
    assert ("func:tests/test_a.py:t", "s3", "verifies", "test_execution_proof") in values(links, *links.columns)


def test_packs(spark):
    n = nodes(spark, ("st", "Login story", "story", "s.md", None, None, "Users enter passwords quickly"), ("criterion:1", "Check password strength", "criterion", "s.md"), ("task:1", "Write validator", "task", "s.md"), ("f", "validator", "function", "a.py", 1, 2, "Checks strength of a password"), ("g", "other", "function", "b.py", 1, 2, "nothing"))
    e = edges(spark, ("st", "criterion:1", "contains"), ("st", "task:1", "contains"), ("g", "f", "calls"))
    assert values(context.context_pack(n, e, "st"), "section", "id") == [("criterion", "criterion:1"), ("story", "st"), ("symbol", "f"), ("task", "task:1")]
    assert values(context.context_pack(n, e, "task:1"), "section", "id") == [("criterion", "criterion:1"), ("story", "st"), ("symbol", "f"), ("task", "task:1")]
    assert values(context.context_pack(n, e, "f"), "section", "id") == [("impacted", "g"), ("symbol", "f")] and context.context_pack(n, e, "none").count() == 0
    hits = context.hybrid_search(n, "password validator", 3).collect()
    assert hits[0]["id"] == "f" and hits[0]["source"] == "hybrid" and context.hybrid_search(n, "  ").count() == 0
    assert context.topology_pack(n, e, "f", 60).orderBy("used").first()["id"] == "f"


def test_order_and_percentiles(spark):
    rng = random.Random(1)
    rows = [(k, float(rng.randrange(n))) for k, n in (("a", 5), ("b", 400), (None, 3)) for _ in range(n)] + [("a", None), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    wanted = {f"{kind}{p}": (kind, p / 100) for kind in ("linear", "index", "nearest") for p in (0, 50, 95, 100)}
    got = {r["k"]: r for r in order.percentiles(df, ["k"], "v", wanted).collect()}
    assert set(got) == {"a", "b", None}
    for k in got:
        v = sorted(x for j, x in rows if j == k and x is not None)
        for name, (kind, p) in wanted.items():
            at = (len(v) - 1) * p
            lo, hi = int(at), -int(-at // 1)
            want = v[lo] + (v[hi] - v[lo]) * (at - lo) if kind == "linear" else v[min(len(v) - 1, int(p * len(v)))] if kind == "index" else v[min(len(v) - 1, max(0, -int(-(p * len(v)) // 1) - 1))]
            assert abs(got[k][name] - want) < 1e-9, (k, name)
    placed = [r["id"] for r in order.placed(spark.range(100).repartition(7), [F.desc("id")]).orderBy("place").collect()]
    assert placed == list(range(99, -1, -1)) and order.chunks(spark.range(25), ["id"], 10).filter("chunk = 2").count() == 5


def test_free_rows_fit_the_budget(spark):
    rows = spark.createDataFrame([(i, 1.0, 0) for i in range(8)] + [(8, 0.5, 2), (9, 0.4, 2), (10, 0.3, 0)], "id int, score double, cost int")
    assert values(retrieval.budget_prefix(rows, 3), "id") == sorted(range(9), key=str)


def test_deep_graphs(spark):
    chain = edges(spark, *[(f"n{i:02}", f"n{i + 1:02}", "calls") for i in range(30)], ("n00", "n30", "calls"))
    start = spark.createDataFrame([("n00",)], "id string")
    assert traverse.descendants(chain, start).count() == 30
    assert values(traverse.transitive_reduction(chain).filter("redundant"), "source_id", "target_id") == [("n00", "n30")]
    goal = spark.createDataFrame([("n00", "n02")], "source string, id string")
    ids = spark.createDataFrame([(f"n{i:02}",) for i in range(31)], "id string")
    assert values(traverse.shortest_paths(ids, chain, start, None, targets=goal), "hops") == [2]


def test_strong_components_of_random_graphs(spark):
    rng = random.Random(2)
    for n, m in ((8, 12), (12, 20)):
        links = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        reach = {(a, b) for a, b in links}
        while True:
            more = {(a, d) for a, b in reach for c, d in reach if b == c} - reach
            if not more:
                break
            reach |= more
        ends = {x for e in links if e[0] != e[1] for x in e}
        want = {str(x): min(str(y) for y in ends if y == x or (x, y) in reach and (y, x) in reach) for x in ends}
        df = spark.createDataFrame([(str(a), str(b), "calls") for a, b in links], EDGES)
        assert dict(values(traverse.strong_components(df), "id", "component")) == want


def test_summaries(spark):
    n = nodes(spark, ("a", "Logger", "class", "x.py"), ("b", "Order", "class", "y.py"), ("c", "c", "story", "s.md"))
    scored = n.select("id", "name", F.lit(1.0).alias("score"))
    assert values(summary.top_by_kind(scored), "kind", "id") == [("domain", "b"), ("domain", "c"), ("infrastructure", "a")]
    assert summary.workspace(n).first()["genesis"] and summary.workspace(n).first()["doc_files"] == 1
    cards = summary.story_cards(n, edges(spark, ("c", "criterion:1", "contains")))
    assert cards.first()["criteria"] == 1 and summary.traceability(cards).first()["status"] == "AST Verified" and summary.traceability(cards.limit(0)).first()["status"] == "Awaiting Specs"
    kept = spark.createDataFrame([("baseline_health_score", "x")], "key string, value string")
    assert summary.score_delta(spark.createDataFrame([(5,)], "score int"), kept).first()["delta"] is None
    imp = spark.createDataFrame([("t", "repo:a:1"), ("t", "repo:a:2"), ("t", "local")], "target string, id string")
    assert summary.impacted_repositories(imp).first()["repositories"] == 1


def test_attestation_and_baselines(spark):
    e = edges(spark, ("a", "b", "calls"), ("b", "c", "calls"), ("c", "d", "calls"))
    signed = governance.attest(e, 0, "key", "salt")
    assert governance.verify_attestation(signed, "key", e, "salt") and not governance.verify_attestation(signed, "key", e.limit(2), "salt") and not governance.verify_attestation(signed, "other")
    t = spark.createDataFrame([("a", 10, 5000.0, 500.0, 900.0)], "node_id string, call_count long, total_duration_ms double, avg_duration_ms double, p95_duration_ms double")
    b = telemetry.seed_baseline(t).first()
    assert (b["p50_duration_ms"], b["throughput"]) == (500.0, 2.0) and abs(b["p99_duration_ms"] - 1080) < 1e-9
    cycles = spark.createDataFrame([(["a", "b"],)], "cycle array<string>")
    n = nodes(spark, ("a", "EventBus", "class", "x.py"), ("b", "B", "class", "entity/y.py"))
    assert governance.decoupling(cycles, n).first()["strategy"] == "SHARED_KERNEL" and governance.decoupling(cycles, n.withColumn("path", F.lit("z"))).first()["strategy"] == "EVENT_DRIVEN"


def test_nearest_names_match_brute_force(spark):
    rng = random.Random(4)
    known = ["".join(rng.choice("abcdef") for _ in range(rng.randrange(0, 22))) for _ in range(60)]

    def edited(x):
        x = list(x)
        for _ in range(rng.randrange(0, 5)):
            at, how = rng.randrange(len(x) + 1), rng.randrange(3)
            x[at : at + (how > 0)] = [rng.choice("abcxyz")] if how < 2 else []
        return "".join(x)

    wanted = [edited(rng.choice(known)) for _ in range(80)] + ["z" * 40, ""]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = set()
    for n in set(wanted):
        d, k = min((distance(n, k), k) for k in set(known))
        if d <= max(10, int(len(n) * 0.8)):
            want.add((n, k, d))
    one = lambda xs: spark.createDataFrame([(x,) for x in xs], "name string")
    assert set(values(retrieval.nearest_names(one(wanted), one(known)), "name", "nearest", "distance")) == want


def test_small_things(spark):
    n = nodes(spark, ("a", "Alpha", "function", "a.py"), ("b", "-", "function", None))
    w = spark.createDataFrame([("ALPHA",), ("Alpha",)], "query string")
    assert {r["selected"] for r in resolve_first(n, w).collect()} == {"a"}
    v = retrieval.hashed_vectors(n, F.col("name"))
    d = {r["id"]: r["vector"] for r in retrieval.dense(v, ids=n.select("id")).collect()}
    assert len(d["b"]) == 128 and not any(d["b"]) and any(d["a"])
    from graphloom.operators import rank

    e = spark.createDataFrame([("a", "b"), ("b", "a")], "source_id string, target_id string")
    assert [r["id"] for r in rank.resolvent(n.select("id"), e, "a", None).collect()] == ["b"]
    spans = spark.createDataFrame([("t", 1, None, "web", "GET", None, None), ("t", 2, 1, "api", "GET", None, None), ("t", 3, 1, "api", None, "S", None), ("t", 4, 2, "db", None, None, "pg")], "trace_id string, span_id int, parent_span_id int, service_name string, http_method string, rpc_service string, db_system string")
    spans = spans.withColumns({"name": F.lit("op"), "duration_ms": F.lit(1.0), "is_error": F.lit(False)})
    assert {(r["source"], r["target"]): r["protocols"] for r in telemetry.topology(spans).collect()} == {("web", "api"): ["grpc", "http"], ("api", "db"): ["pg"]}


def test_stories_without_orders_are_as_in_sql(spark, tmp_path):
    import duckdb

    from graphloom.plans import ORACLES, QUERIES

    spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "c_custkey long, c_name string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(3, 1), (4, 1), (6, 3)], "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("story_cards", "traceability"):
        got = QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)), name
