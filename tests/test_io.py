"""Sources, sinks and streaming."""

import json

from graphloom import sinks
from graphloom.operators.telemetry import topology
from graphloom.sources import code, docs, traces
from graphloom.streaming import telemetry as streaming

OTLP = {"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "gateway"}}]}, "scopeSpans": [{"spans": [
    {"traceId": "t", "spanId": "1", "name": "GET /", "kind": 2, "startTimeUnixNano": "1000000", "endTimeUnixNano": "151000000", "status": {"code": 2}, "attributes": [{"key": "http.route", "value": {"stringValue": "/x"}}]},
    {"traceId": "t", "spanId": "2", "parentSpanId": "1", "name": "call", "kind": 3, "startTimeUnixNano": 0, "endTimeUnixNano": 5000000, "attributes": [{"key": "peer.service", "value": {"stringValue": "pay"}}]}]}]}]}
JAEGER = {"data": [{"traceID": "j", "processes": {"p1": {"serviceName": "front"}, "p2": {"serviceName": "stock"}}, "spans": [
    {"traceID": "j", "spanID": "a", "processID": "p1", "operationName": "o", "duration": 2000, "tags": [{"key": "span.kind", "value": "client"}]},
    {"traceID": "j", "spanID": "b", "processID": "p2", "operationName": "p", "duration": 1000, "tags": [], "references": [{"refType": "CHILD_OF", "spanID": "a"}]}]}]}
ZIPKIN = [{"traceId": "z", "id": "9", "kind": "CLIENT", "name": "s", "duration": 1500, "localEndpoint": {"serviceName": "search"}, "remoteEndpoint": {"serviceName": "es"}, "tags": {"error": ""}}]


def test_traces(spark):
    df = spark.createDataFrame([(json.dumps(x),) for x in (OTLP, JAEGER, ZIPKIN)] + [("not json",)], "value string")
    rows = {r["trace_id"] + r["span_id"]: r for r in traces.spans(df).collect()}
    assert len(rows) == 5 and rows["t1"]["duration_ms"] == 150 and rows["t1"]["is_error"] and rows["t1"]["kind"] == "SERVER" and rows["t1"]["http_route"] == "/x"
    assert rows["jb"]["parent_span_id"] == "a" and rows["jb"]["service_name"] == "stock" and rows["z9"]["is_error"] and rows["z9"]["duration_ms"] == 1.5
    links = {(r["source"], r["target"]): r["calls"] for r in topology(traces.spans(df)).collect()}
    assert links == {("gateway", "pay"): 1, ("front", "stock"): 1, ("search", "es"): 1}
    m = spark.createDataFrame([(json.dumps({"metrics": [{"target": "login", "calls": 1500, "duration_ms": 7500, "errors": 15}]}),), (json.dumps({"version": 1, "frames": [{"name": "login", "hits": 340, "selfTime": 1700}]}),)], "value string")
    assert sorted((r["call_count"], r["error_count"]) for r in traces.metrics(m).collect()) == [(340, 0), (1500, 15)]


def test_code(spark, tmp_path):
    (tmp_path / "a.py").write_text('import os\nclass A(Base):\n    """doc"""\n    def run(self):\n        self.go()\n        helper()\n    def go(self): pass\n')
    (tmp_path / "b.ts").write_text("import { x } from './x'\nimport type { Y } from './y'\nexport class AuthService {}\nconst f = async (a) => 1\n")
    (tmp_path / "s.go").write_text("type Order struct {\nfunc processBatch(x int) {\n")
    (tmp_path / "bad.py").write_text("def (")
    (tmp_path / ".env").write_text("SECRET=1")
    nodes, edges = code.extract(code.scan(spark, str(tmp_path)))
    ids = {r["id"] for r in nodes.collect()}
    assert {"file:a.py", "class:a.py:A", "func:a.py:A.run", "import:a.py:os", "class:b.ts:AuthService", "func:b.ts:f", "class:s.go:Order", "func:s.go:processBatch", "file:bad.py"} <= ids and not any(".env" in i for i in ids)
    e = {(r["source_id"], r["target_id"], r["edge_type"]) for r in edges.collect()}
    assert {("func:a.py:A.run", "func:a.py:A.go", "calls"), ("func:a.py:A.run", "func_call:helper", "calls"), ("class:a.py:A", "type:Base", "inherits"), ("file:b.ts", "import:b.ts:./y", "type_depends_on")} <= e
    d = spark.createDataFrame([(1, "--- a/x.py\n+++ b/x.py\n@@ -1,2 +3,4 @@\n+a\n@@ -9 +12 @@\n")], "id int, diff string")
    assert [(r["path"], r["start"], r["end"]) for r in code.diff_ranges(d).orderBy("start").collect()] == [("x.py", 3, 6), ("x.py", 12, 12)]


def test_documents(spark):
    md = "# STORY-7: Login\n- AC-1: works\n- [x] T-1: build\n- [ ] T-2: test\nSee [x](../a.md) and `A.run`\n# WHY: fast ADR-3\n"
    f = spark.createDataFrame([("s.md", md)], "path string, text string")
    got = {r["id"]: r["completed"] for r in docs.specifications(f).collect()}
    assert got == {"story:STORY-7": None, "criterion:STORY-7:AC-1": None, "task:STORY-7:T-1": True, "task:STORY-7:T-2": False}
    assert docs.links(f).first()["target"] == "../a.md" and docs.references(f).first()["name"] == "A.run"
    assert docs.rationale(f).first()["citations"] == ["ADR-3"]
    d = spark.createDataFrame([("m.mmd", "graph TD\nA[User] --> B[Gate]\nB --> C[Auth]\nC --> D[(DB)]\n"), ("p.puml", "component Web as W\ncomponent Auth as U\nW --> U : checks\n")], "path string, text string")
    nodes, edges = docs.diagrams(d)
    assert nodes.filter("path = 'm.mmd'").count() == 4 and edges.filter("source_id LIKE 'visual:m.mmd%'").count() == 3
    assert nodes.filter("path = 'p.puml'").count() == 2 and edges.filter("label = 'checks'").count() == 1
    api = spark.createDataFrame([("o.json", json.dumps({"paths": {"/a": {"get": {}, "parameters": []}}}))], "path string, text string")
    assert docs.openapi_endpoints(api, "r").first()["id"] == "repo:r:endpoint:GET:/a"
    assert docs.openapi_endpoints(api, "local").first()["id"] == "endpoint:GET:/a"
    texts = [json.dumps({"components": {"schemas": {"A": {"description": "An a"}, "B": True}}, "definitions": {"C": {}}}), json.dumps({"definitions": {"C": {}}}), json.dumps({"definitions": [1]}), "{", "", None]
    contracts = spark.createDataFrame([(f"{i}.json", t) for i, t in enumerate(texts)], "path string, text string")
    found = {(r["path"], r["id"], r["docstring"]) for r in docs.openapi_schemas(contracts, "r").collect()}
    assert found == {("0.json", "repo:r:schema:A", "An a"), ("0.json", "repo:r:schema:B", "Data model schema for B"), ("1.json", "repo:r:schema:C", "Data model schema for C")}


def test_sinks(spark, tmp_path):
    schema = "id string, name string, node_type string, path string, docstring string"
    old = spark.createDataFrame([("a", "A", "function", "x.py", "d"), ("s", "S", "story", "s.md", "d")], schema)
    new = spark.createDataFrame([("a", "A2", "function", "x.py", "AKIA" + "A" * 16)], schema)
    edges = spark.createDataFrame([("a", "s", "calls"), ("s", "a", "verifies"), ("s", "s", "calls")], "source_id string, target_id string, edge_type string")
    got = {r["id"]: (r["name"], r["docstring"]) for r in sinks.upsert_nodes(old, new).collect()}
    assert got == {"a": ("A2", "[REDACTED_AWS_KEY]"), "s": ("S", "d")}
    n, e = sinks.without_files(old, edges, spark.createDataFrame([("x.py",)], "path string"))
    assert n.count() == 1 and [(r["source_id"], r["target_id"]) for r in e.collect()] == [("s", "s")]
    n, e = sinks.cleared(old, edges)
    assert [r["id"] for r in n.collect()] == ["s"] and e.count() == 1
    sinks.publish_snapshot(old, edges, str(tmp_path), "s1")
    n, e = sinks.latest_snapshot(spark, str(tmp_path))
    assert n.count() == 2 and e.count() == 3
    text = "\n".join(r["value"] for f in (sinks.to_json, sinks.to_dot, sinks.to_cypher, sinks.to_graphml) for r in f(old, edges).collect())
    assert '"a" -> "s"' in text and "MERGE (a)-[:CALLS]->(b)" in text and '<edge source="a"' in text and '"kind":"edge"' in text
    assert "[[s]]" in {r["id"]: r["text"] for r in sinks.notes(old, edges).collect()}["a"]


def test_streaming_totals(spark, tmp_path):
    schema = "node_id string, call_count long, total_duration_ms double, p95_duration_ms double, error_count long"
    for i, rows in enumerate(([("a", 2, 10.0, 7.0, 1)], [("a", 3, 5.0, 4.0, 0), ("b", 1, 1.0, 1.0, 0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    q = streaming.running_telemetry(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("totals").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {r["node_id"]: (r["call_count"], r["total_duration_ms"], r["p95_duration_ms"], r["error_rate"]) for r in spark.table("totals").collect()}
    assert got == {"a": (5, 15.0, 7.0, 0.2), "b": (1, 1.0, 1.0, 0.0)}


def test_changes(spark):
    f = lambda v: spark.createDataFrame(v, "path string, content_hash string")
    got = {r["path"]: r["change"] for r in streaming.changes(f([("a", "1"), ("b", "1"), ("c", "1")]), f([("a", "1"), ("b", "2"), ("d", "1")])).collect()}
    assert got == {"b": "modified", "c": "deleted", "d": "added"}
