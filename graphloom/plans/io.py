"""Registered queries of sources, sinks and text functions with their oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import sinks, stores, views
from ..functions import text
from ..operators import analytics, lineage, retrieval, review, telemetry
from ..resolve import resolve_targets
from ..sources import code, docs, packages, traces
from ..storage import shared_dir
from ..streaming import telemetry as streaming
from . import sql
from .change import ref
from .graph import G, supply, trade
from .registry import query


def nation(spark, d):
    return views.table(spark, d, "nation").withColumn("k", F.col("n_nationkey").cast("string"))


def text_of(*parts):
    return F.concat(*(F.lit(p) if not p.startswith("$") else F.col(p[1:]).cast("string") for p in parts)).alias("text")


# --- sources -------------------------------------------------------------

_PY = ("import os\nclass C", "$k", "(Base):\n    def run(self):\n        self.go()\n        helper", "$n_regionkey", "()\n")


@query("WITH n AS (SELECT n_nationkey AS k, n_regionkey AS r, 'p' || n_nationkey || '.py' AS p FROM nation) SELECT 'file:' || p AS id, 'file' AS node_type FROM n UNION ALL SELECT 'import:' || p || ':os', 'import' FROM n UNION ALL SELECT 'class:' || p || ':C' || k, 'class' FROM n UNION ALL SELECT 'func:' || p || ':C' || k || '.run', 'function' FROM n")
def python_nodes(spark, d):
    return code.extract(_python(spark, d))[0].select("id", "node_type")


@query("WITH n AS (SELECT n_nationkey AS k, n_regionkey AS r, 'p' || n_nationkey || '.py' AS p FROM nation) SELECT 'file:' || p AS source_id, 'import:' || p || ':os' AS target_id, 'imports' AS edge_type FROM n UNION ALL SELECT 'file:' || p, 'class:' || p || ':C' || k, 'contains' FROM n UNION ALL SELECT 'class:' || p || ':C' || k, 'type:Base', 'inherits' FROM n UNION ALL SELECT 'class:' || p || ':C' || k, 'func:' || p || ':C' || k || '.run', 'contains' FROM n WHERE FALSE UNION ALL SELECT 'file:' || p, 'func:' || p || ':C' || k || '.run', 'contains' FROM n WHERE FALSE UNION ALL SELECT 'func:' || p || ':C' || k || '.run', 'func:' || p || ':C' || k || '.go', 'calls' FROM n UNION ALL SELECT 'func:' || p || ':C' || k || '.run', 'func_call:helper' || r, 'calls' FROM n")
def python_edges(spark, d):
    return code.extract(_python(spark, d))[1].select("source_id", "target_id", "edge_type").filter(~((F.col("edge_type") == "contains") & F.col("target_id").startswith("func:")))


def _python(spark, d):
    return nation(spark, d).select(F.concat(F.lit("p"), "k", F.lit(".py")).alias("path"), text_of(*_PY).cast("binary").alias("content"))


@query("WITH n AS (SELECT n_nationkey AS k FROM nation) SELECT 'class:t' || k || '.ts:A' || k AS source_id, 'type:Base' || k AS target_id, 'inherits' AS edge_type FROM n UNION ALL SELECT 'class:t' || k || '.ts:A' || k, 'type:I' || k, 'implements' FROM n UNION ALL SELECT 'class:t' || k || '.ts:A' || k, 'type:J', 'implements' FROM n UNION ALL SELECT 'class:r' || k || '.rs:S' || k, 'type:Show', 'implements' FROM n UNION ALL SELECT 'table:Post' || k, 'table:User', 'references' FROM n")
def supertypes(spark, d):
    n = nation(spark, d)
    f = lambda pre, ext, *parts: n.select(F.concat(F.lit(pre), "k", F.lit(ext)).alias("path"), text_of(*parts).cast("binary").alias("content"))
    files = f("t", ".ts", "export class A", "$k", " extends Base", "$k", " implements I", "$k", ", J {\n}\n").union(f("r", ".rs", "impl Show for S", "$k", " {\n")).union(f("s", ".prisma", "model Post", "$k", " {\n  author User @relation(fields: [a])\n}\n"))
    return code.extract(files)[1].filter("edge_type IN ('inherits', 'implements', 'references')").select("source_id", "target_id", "edge_type")


@query("WITH n AS (SELECT n_nationkey AS k FROM nation) SELECT 'func:s' || k || '.sh:job_' || k AS id, 'function' AS node_type FROM n UNION ALL SELECT 'import:s' || k || '.sh:./lib.sh', 'import' FROM n UNION ALL SELECT 'func:g' || k || '.go:Run', 'function' FROM n UNION ALL SELECT 'import:g' || k || '.go:net/http', 'import' FROM n UNION ALL SELECT 'table:t' || k, 'table' FROM n")
def line_extractors(spark, d):
    n = nation(spark, d)
    f = lambda pre, ext, *parts: n.select(F.concat(F.lit(pre), "k", F.lit(ext)).alias("path"), text_of(*parts).cast("binary").alias("content"))
    files = f("s", ".sh", "source ./lib.sh\njob_", "$k", "() {\n}\n").union(f("g", ".go", "package main\nimport (\n\t\"net/http\"\n)\nfunc Run() {\n\t\"not/one\"\n}\n")).union(f("d", ".sql", "CREATE TABLE t", "$k", " (id int);\n"))
    return code.extract(files)[0].filter("node_type <> 'file'").select("id", "node_type")


@query("SELECT 'f' || n_nationkey || '.py' AS path, n_nationkey + 1 AS start, n_nationkey + 3 AS \"end\" FROM nation UNION ALL SELECT 'f' || n_nationkey || '.py', 90, 90 FROM nation")
def diff_hunks(spark, d):
    n = nation(spark, d).withColumn("at", F.col("n_nationkey") + 1)
    return code.diff_ranges(n.select("k", text_of("--- a/f", "$k", ".py\n+++ b/f", "$k", ".py\n@@ -1,2 +", "$at", ",3 @@\n+x\n@@ -80 +90 @@ def f\n+y\n").alias("diff")).withColumnRenamed("k", "id"))


@query("SELECT CASE WHEN n_nationkey % 3 = 1 THEN 'old' ELSE 'new' END || n_nationkey AS path, CASE n_nationkey % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'deleted' ELSE 'modified' END AS change FROM nation")
def diff_paths(spark, d):
    n, m = nation(spark, d), F.col("n_nationkey") % 3
    was = F.when(m == 0, "/dev/null").when(m == 1, F.concat(F.lit("a/old"), "k")).otherwise(F.concat(F.lit("a/new"), "k"))
    now = F.when(m == 1, "/dev/null").otherwise(F.concat(F.lit("b/new"), "k"))
    return code.changed_paths(n.select("k", F.concat(F.lit("diff --git\n--- "), was, F.lit("\n+++ "), now, F.lit("\n@@ -1 +1 @@\n+x\n")).alias("diff")))


_MD = ("# STORY-", "$k", ": Serve ", "$n_name", "\n- AC-1: fast\n- [x] T-1: build\n- [ ] T-2: test\n# WHY: see ADR-", "$k", "\n[more](docs/", "$k", ".md)\n")


@query("WITH n AS (SELECT n_nationkey::VARCHAR AS k, n_name AS m FROM nation) SELECT 'story' AS kind, 'story:STORY-' || k AS id, 'Serve ' || m AS name, NULL::VARCHAR AS completed, 1 AS line FROM n UNION ALL SELECT 'criterion', 'criterion:STORY-' || k || ':AC-1', 'fast', NULL, 2 FROM n UNION ALL SELECT 'task', 'task:STORY-' || k || ':T-1', 'build', 'true', 3 FROM n UNION ALL SELECT 'task', 'task:STORY-' || k || ':T-2', 'test', 'false', 4 FROM n")
def specifications(spark, d):
    return docs.specifications(_markdown(spark, d)).select("kind", "id", "name", F.col("completed").cast("string").alias("completed"), "line")


@query("SELECT 'story:STORY-' || n_nationkey AS source_id, t || n_nationkey || u AS target_id FROM nation, (VALUES ('criterion:STORY-', ':AC-1'), ('task:STORY-', ':T-1'), ('task:STORY-', ':T-2')) v(t, u)")
def specification_edges(spark, d):
    return docs.specification_edges(docs.specifications(_markdown(spark, d))).select("source_id", "target_id")


@query("SELECT n_nationkey || '.md' AS path, 5 AS line, 'WHY' AS tag, 'ADR-' || n_nationkey AS citations, 'docs/' || n_nationkey || '.md' AS link FROM nation")
def rationale_comments(spark, d):
    f = _markdown(spark, d)
    return docs.rationale(f).select("path", "line", "tag", F.array_join("citations", ",").alias("citations")).join(docs.links(f).withColumnRenamed("target", "link"), "path")


def _markdown(spark, d):
    return nation(spark, d).select(F.concat("k", F.lit(".md")).alias("path"), text_of(*_MD))


@query("WITH n AS (SELECT n_nationkey::VARCHAR AS k, n_name AS m FROM nation) SELECT 'visual:' || k || '.mmd:A' AS source_id, 'visual:' || k || '.mmd:B' AS target_id, 'calls' AS label, m AS name FROM n")
def diagram_edges(spark, d):
    n = nation(spark, d)
    nodes, edges = docs.diagrams(n.select(F.concat("k", F.lit(".mmd")).alias("path"), text_of("graph TD\nA[", "$n_name", "] -->|calls| B[Store]\n")))
    return edges.join(nodes.select(F.col("id").alias("source_id"), "name"), "source_id").select("source_id", "target_id", "label", "name")


@query("SELECT 'repo:shop:endpoint:' || m || ':/n/' || n_nationkey AS id, m AS method, '/n/' || n_nationkey AS route FROM nation, (VALUES ('GET'), ('POST')) v(m)")
def openapi_endpoints(spark, d):
    n = nation(spark, d)
    files = n.select(F.concat("k", F.lit(".json")).alias("path"), text_of('{"openapi": "3.0.0", "paths": {"/n/', "$k", '": {"get": {}, "post": {"x": 1}, "parameters": []}}}'))
    return docs.openapi_endpoints(files, "shop").select("id", "method", "route")


@query(
    "WITH s AS (SELECT s_suppkey::VARCHAR AS k, s_name AS m FROM supplier) SELECT 'schema:Supplier' || k AS id, 'Supplier' || k AS name, k || '.json' AS path, m AS docstring FROM s "
    "UNION ALL SELECT 'schema:Note', 'Note', k || '.json', 'Data model schema for Note' FROM s UNION ALL SELECT 'schema:Old' || k, 'Old' || k, k || '-old.json', 'Data model schema for Old' || k FROM s"
)
def openapi_schemas(spark, d):
    s = views.table(spark, d, "supplier").withColumn("k", F.col("s_suppkey").cast("string"))
    new = s.select(F.concat("k", F.lit(".json")).alias("path"), text_of('{"components": {"schemas": {"Supplier', "$k", '": {"description": "', "$s_name", '"}, "Note": {}}}, "definitions": {"Unread": {}}}'))
    old = s.select(F.concat("k", F.lit("-old.json")).alias("path"), text_of('{"components": {"schemas": {}}, "definitions": {"Old', "$k", '": {"description": ""}}}'))
    return docs.openapi_schemas(new.union(old), "local")


@query("SELECT 'repo:shop:endpoint:' || m || ':/n/' || n_nationkey || '/{id}' AS id, m AS method FROM nation, (VALUES ('GET'), ('DELETE')) v(m)")
def openapi_yaml(spark, d):
    n = nation(spark, d)
    doc = ("openapi: 3.0.0\nget: no\npaths:\n  /n/", "$k", "/{id}:\n    get:\n      parameters:\n        - name: post\n      post: deep\n    delete:\n      x: 1\ncomponents:\n  put: {}\n")
    return docs.openapi_yaml_endpoints(n.select(F.concat("k", F.lit(".yaml")).alias("path"), text_of(*doc)), "shop").select("id", "method")


@query("SELECT 't' || event_id AS trace_id, event_type AS service_name, CASE WHEN event_id % 2 = 0 THEN 'SERVER' ELSE 'CLIENT' END AS kind, round((event_id % 900) / 1000, 3) AS duration_ms, event_id % 5 = 0 AS is_error, '/u/' || user_id AS http_route FROM events WHERE event_id % 3 = 0 UNION ALL SELECT 'z' || event_id, event_type, 'CONSUMER', (event_id % 700)::DOUBLE, event_id % 5 = 0, NULL FROM events WHERE event_id % 3 = 1 UNION ALL SELECT 'j' || event_id, event_type, 'CLIENT', (event_id % 800)::DOUBLE, event_id % 5 = 0, NULL FROM events WHERE event_id % 3 = 2")
def trace_documents(spark, d):
    e = views.table(spark, d, "events").withColumn("e", F.col("event_id").cast("string")).withColumn("u", F.col("user_id").cast("string"))
    s = lambda *parts: F.concat(*(F.lit(p) if not p.startswith("$") else F.col(p[1:]) for p in parts))
    nanos, kind = ((F.col("event_id") % 900) * 1000).cast("string"), F.when(F.col("event_id") % 2 == 0, "2").otherwise("3")
    e = e.withColumn("ns", nanos).withColumn("kd", kind).withColumn("bad", F.when(F.col("event_id") % 5 == 0, "2").otherwise("1"))
    e = e.withColumn("zd", ((F.col("event_id") % 700) * 1000).cast("string")).withColumn("zt", F.when(F.col("event_id") % 5 == 0, '{"error": ""}').otherwise("{}"))
    e = e.withColumn("jd", ((F.col("event_id") % 800) * 1000).cast("string")).withColumn("jt", F.when(F.col("event_id") % 5 == 0, ', {"key": "error", "value": true}').otherwise(""))
    otlp = s('{"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "', "$event_type", '"}}]}, "scopeSpans": [{"spans": [{"traceId": "t', "$e", '", "spanId": "1", "name": "n", "kind": ', "$kd", ', "startTimeUnixNano": "0", "endTimeUnixNano": "', "$ns", '", "status": {"code": ', "$bad", '}, "attributes": [{"key": "http.route", "value": {"stringValue": "/u/', "$u", '"}}]}]}]}]}')
    zipkin = s('[{"traceId": "z', "$e", '", "id": "9", "kind": "CONSUMER", "name": "s", "duration": ', "$zd", ', "localEndpoint": {"serviceName": "', "$event_type", '"}, "tags": ', "$zt", "}]")
    jaeger = s('{"data": [{"traceID": "j', "$e", '", "processes": {"p1": {"serviceName": "', "$event_type", '"}}, "spans": [{"traceID": "j', "$e", '", "spanID": "a", "processID": "p1", "operationName": "o", "duration": ', "$jd", ', "tags": [{"key": "span.kind", "value": "client"}', "$jt", "]}]}]}")
    m = F.col("event_id") % 3
    docs_ = e.select(F.when(m == 0, otlp).when(m == 1, zipkin).otherwise(jaeger).alias("value"))
    return traces.spans(docs_).select("trace_id", "service_name", "kind", F.round("duration_ms", 3).alias("duration_ms"), "is_error", "http_route")


@query("SELECT 'n' || n_nationkey AS target, (n_nationkey * 10)::BIGINT AS call_count, n_nationkey * 2.5 AS total_duration_ms, n_nationkey::BIGINT AS error_count FROM nation WHERE n_nationkey > 0")
def metric_documents(spark, d):
    n = nation(spark, d).filter("n_nationkey > 0").withColumn("ms", (F.col("n_nationkey") * 2.5).cast("string"))
    return traces.metrics(n.select(text_of('{"metrics": [{"target": "n', "$k", '", "calls": ', "$k", '0, "duration_ms": ', "$ms", ', "errors": ', "$k", "}]}").alias("value"))).select("target", "call_count", "total_duration_ms", "error_count")


@query("SELECT '@n/' || n_nationkey AS name, 'packages/' || n_nationkey AS path, 'n' AS scope, 'dep' || n_regionkey AS depends FROM nation")
def workspace_packages(spark, d):
    n = nation(spark, d)
    files = n.select(F.concat(F.lit("packages/"), "k", F.lit("/package.json")).alias("path"), text_of('{"name": "@n/', "$k", '", "dependencies": {"dep', "$n_regionkey", '": "1"}}'))
    return packages.packages(packages.manifests(files)).select("name", "path", "scope", F.array_join("depends", ",").alias("depends"))


# --- sinks ---------------------------------------------------------------


@query(f"WITH {sql.NODES}, f AS (SELECT id, name || ' v2' AS name FROM nodes WHERE id IN (SELECT 'c:' || c_custkey FROM customer WHERE c_custkey % 2 = 0) UNION ALL SELECT 'new:' || n_nationkey, n_name FROM nation) SELECT id, coalesce(f.name, n.name) AS name FROM nodes n FULL JOIN f USING (id)")
def upserted_nodes(spark, d):
    stored = views.supply_nodes(spark, d)
    again = stored.filter("id LIKE 'c:%' AND CAST(substring(id, 3) AS INT) % 2 = 0").withColumn("name", F.concat("name", F.lit(" v2")))
    n = nation(spark, d).select(ref("new:", "n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return sinks.upsert_nodes(stored, again.unionByName(n, allowMissingColumns=True)).select("id", "name")


@query(f"WITH {sql.NODES} SELECT id FROM nodes WHERE node_type = 'endpoint'")
def kept_manual_rows(spark, d):
    nodes, edges = supply(spark, d)
    manual = nodes.withColumn("node_type", F.when(F.col("node_type") == "endpoint", "story").otherwise(F.col("node_type")))
    return sinks.cleared(manual, edges)[0].select("id")


@query(f"WITH {G}, k AS (SELECT id FROM nodes WHERE path = 'cli/nation_3.py') SELECT source_id, target_id, edge_type FROM edges WHERE source_id NOT IN (SELECT id FROM k) AND target_id NOT IN (SELECT id FROM k)")
def edges_without_file(spark, d):
    return sinks.without_files(*supply(spark, d), spark.createDataFrame([("cli/nation_3.py",)], "path string"))[1].select("source_id", "target_id", "edge_type")


@query(f"WITH {G}, k AS (SELECT CASE WHEN id LIKE 's:%' THEN 'repo:shop:' || id ELSE id END AS id FROM nodes) SELECT id FROM k WHERE id NOT LIKE 'repo:shop:%'")
def nodes_without_repository(spark, d):
    nodes, edges = supply(spark, d)
    shop = F.when(F.col("id").startswith("s:"), F.concat(F.lit("repo:shop:"), "id")).otherwise(F.col("id"))
    return sinks.without_repository(nodes.withColumn("id", shop), edges, "shop")[0].select("id")


@query(f"WITH {G} SELECT '  \"' || id || '\" [label=\"' || name || '\"];' AS value FROM nodes UNION ALL SELECT '  \"' || source_id || '\" -> \"' || target_id || '\" [label=\"' || edge_type || '\"];' FROM edges")
def dot_export(spark, d):
    return sinks.to_dot(*supply(spark, d))


@query(f"WITH {sql.NODES}, l AS (SELECT node_type, 0 AS k, '' AS name, '' AS id, '## ' || node_type AS text FROM nodes GROUP BY node_type UNION ALL SELECT node_type, 1, name, id, '- [[' || id || ']] ' || name FROM nodes) SELECT row_number() OVER (ORDER BY node_type, k, name, id) - 1 AS place, text FROM l")
def vault_index(spark, d):
    return sinks.index_note(views.supply_nodes(spark, d))


@query("SELECT o_custkey AS k, max_by(o_orderkey, o_totalprice * 1000000 + o_orderkey % 1000000) AS o_orderkey FROM orders GROUP BY 1")
def last_row_wins(spark, d):
    o = views.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", (F.col("o_totalprice") * 1000000 + F.col("o_orderkey") % 1000000).alias("o"))
    return sinks.last_wins(o, "k", "o").select("k", "o_orderkey")


@query("WITH s AS (SELECT p_partkey::VARCHAR AS path, p_size AS h FROM part WHERE p_partkey % 3 <> 0), f AS (SELECT p_partkey::VARCHAR AS path, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS h FROM part WHERE p_partkey % 4 <> 0) SELECT coalesce(s.path, f.path) AS path, CASE WHEN s.h IS NULL THEN 'added' WHEN f.h IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM s FULL JOIN f ON s.path = f.path WHERE s.h IS DISTINCT FROM f.h")
def change_listing(spark, d):
    p = views.table(spark, d, "part")
    path, size = F.col("p_partkey").cast("string").alias("path"), F.col("p_size")
    stored = p.filter("p_partkey % 3 <> 0").select(path, size.alias("content_hash"))
    return streaming.changes(stored, p.filter("p_partkey % 4 <> 0").select(path, F.when(F.col("p_partkey") % 5 == 0, size + 1).otherwise(size).alias("content_hash")))


@query("SELECT doc_id::VARCHAR AS path, sha256(text) AS content_hash FROM documents WHERE text IS NOT NULL")
def file_fingerprints(spark, d):
    t = views.table(spark, d, "documents").filter("text IS NOT NULL")
    return streaming.fingerprints(t.select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content")))


def _store(spark):
    return f"{shared_dir(spark)}/graphloom/store-{uuid.uuid4().hex}"


@query("SELECT vec_id::VARCHAR AS node_id, len(embedding) AS dimension, CASE WHEN vec_id % 10 = 1 THEN 0.0 ELSE round(embedding[1]::DOUBLE, 4) END AS first FROM embeddings WHERE vec_id % 10 <> 0")
def stored_embeddings(spark, d):
    """Vectors saved packed and unpacked again, some replaced, some removed."""
    e, folder = views.table(spark, d, "embeddings"), _store(spark)
    rows = e.select(F.col("vec_id").cast("string").alias("node_id"), F.size("embedding").alias("dimension"), F.col("embedding").cast("array<float>").alias("vector"), (F.col("vec_id") % 10).alias("m"))
    stores.save(stores.unpack_vectors(stores.pack_vectors(rows.drop("m"))), folder, "embeddings", buckets=8)
    stores.save(rows.filter("m = 1").withColumn("vector", F.transform("vector", lambda _: F.lit(0.0))), folder, "embeddings")
    stores.remove(spark, folder, "embeddings", rows.filter("m = 0"))
    return stores.load(spark, folder, "embeddings").select("node_id", "dimension", F.round(F.col("vector")[0].cast("double"), 4).alias("first"))


@query("SELECT o_orderkey::VARCHAR AS path, CASE WHEN o_orderkey % 7 = 3 THEN 'new' ELSE sha256(o_orderkey::VARCHAR) END AS content_hash FROM orders WHERE o_orderkey % 20 = 3 AND o_orderkey % 11 <> 2")
def stored_fingerprints(spark, d):
    """Fingerprints looked up in the buckets of their paths, after changes."""
    o, folder = views.table(spark, d, "orders"), _store(spark)
    rows = o.select(F.col("o_orderkey").cast("string").alias("path"), F.sha2(F.col("o_orderkey").cast("string").cast("binary"), 256).alias("content_hash"), "o_orderkey")
    stores.save(rows, folder, "fingerprints", buckets=8)
    stores.save(rows.filter("o_orderkey % 7 = 3").withColumn("content_hash", F.lit("new")), folder, "fingerprints")
    stores.remove(spark, folder, "fingerprints", rows.filter("o_orderkey % 11 = 2"))
    return stores.lookup(spark, folder, "fingerprints", rows.filter("o_orderkey % 20 = 3")).select("path", "content_hash")


@query(f"WITH {sql.SPANS} SELECT trace_id AS node_id, count(*) AS call_count, round(sum(duration_ms), 2) AS total_duration_ms, max(duration_ms) AS p95_duration_ms, count_if(is_error)::BIGINT AS error_count, count_if(is_error) / count(*) AS error_rate FROM spans GROUP BY 1")
def stored_telemetry(spark, d):
    """Telemetry added in two batches of a stream, the second one twice."""
    s, folder = views.spans(spark, d), _store(spark)
    rows = s.groupBy(F.col("trace_id").alias("node_id"), (F.col("span_id") % 2).alias("half")).agg(F.count(F.lit(1)).alias("call_count"), F.sum("duration_ms").alias("total_duration_ms"), F.max("duration_ms").alias("p95_duration_ms"), F.sum(F.col("is_error").cast("long")).alias("error_count"))
    for batch in (0, 1, 1):
        stores.add(rows.filter(F.col("half") == batch), folder, "spans", batch, buckets=8)
    return stores.load(spark, folder, "telemetry").select("node_id", "call_count", F.round("total_duration_ms", 2).alias("total_duration_ms"), "p95_duration_ms", "error_count", "error_rate")


# --- review, lineage, retrieval ------------------------------------------


@query("SELECT DISTINCT CASE n_regionkey WHEN 0 THEN 'tests/africa' WHEN 3 THEN 'tests/europe' END AS suite FROM nation WHERE n_regionkey IN (0, 3)")
def recommended_tests(spark, d):
    changed = nation(spark, d).select(F.concat(F.lit("src/r"), F.col("n_regionkey").cast("string"), F.lit("/x.py")).alias("path"))
    return review.recommended_tests(changed, spark.createDataFrame([("r0/", "tests/africa"), ("r3/", "tests/europe"), ("zz", "none")], "part string, suite string"), "tests")


@query("SELECT n_nationkey AS id, n_name AS rule FROM nation WHERE n_regionkey = 2 OR n_regionkey = 0")
def domain_rules(spark, d):
    rules = nation(spark, d).select(F.col("n_nationkey").alias("id"), F.when(F.col("n_regionkey") == 0, "global").otherwise(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))).alias("domain"), F.col("n_name").alias("rule"))
    return review.rules_of_domain(rules, "r2").select("id", "rule")


@query("SELECT count(*) AS files, sum(n_nationkey % 3 + 1)::BIGINT AS added, sum(n_nationkey % 2)::BIGINT AS deleted FROM nation")
def diff_totals(spark, d):
    n = nation(spark, d)
    plus, minus = F.repeat(F.lit("\n+x"), (F.col("n_nationkey") % 3 + 1).cast("int")), F.repeat(F.lit("\n-x"), (F.col("n_nationkey") % 2).cast("int"))
    return review.diff_totals(n.select(F.col("k").alias("path"), F.concat(F.lit("--- a\n+++ b"), plus, minus).alias("diff")))


@query("SELECT DISTINCT 't:' || s_nationkey AS topic, 'publishes' AS side, 's:' || s_suppkey AS id FROM supplier UNION ALL SELECT DISTINCT 't:' || c_nationkey, 'subscribes', 'c:' || c_custkey FROM customer")
def topic_members(spark, d):
    s, c, n = views.table(spark, d, "supplier"), views.table(spark, d, "customer"), nation(spark, d)
    e = s.select(ref("s:", "s_suppkey").alias("source_id"), ref("t:", "s_nationkey").alias("target_id"), F.lit("publishes").alias("edge_type")).union(c.select(ref("c:", "c_custkey"), ref("t:", "c_nationkey"), F.lit("subscribes")))
    return lineage.topic_members(n.select(ref("t:", "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("topic").alias("node_type")), e)


@query("SELECT 'n:' || n_nationkey AS source_id, 'rpc:' || (n_nationkey % 5) AS target_id FROM nation WHERE n_nationkey % 5 < 3")
def rpc_links(spark, d):
    n = nation(spark, d).withColumn("m", (F.col("n_nationkey") % 5).cast("string"))
    calls = n.select(ref("n:", "n_nationkey").alias("id"), text_of("client.get", "$m", "(x)\nclient.get", "$m", "(y)\nother(1)"))
    return lineage.rpc_links(calls, spark.range(3).select(ref("rpc:", "id").alias("id"), ref("get", "id").alias("method")))


@query("SELECT event_id AS span_id, 'e' || user_id % 50 AS endpoint FROM events WHERE event_id % 4 <> 3")
def matched_routes(spark, d):
    e = views.table(spark, d, "events")
    m, u = F.col("event_id") % 4, (F.col("user_id") % 50).cast("string")
    spans = e.select(F.col("event_id").alias("span_id"), F.when(m == 0, "GET").when(m == 1, F.lit(None)).when(m == 2, "get").otherwise("POST").alias("http_method"), F.concat(F.lit("/u"), u, F.lit("/{id}")).alias("http_route"))
    ends = spark.range(50).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("id"), F.lit("GET").alias("method"), F.concat(F.lit("/u"), F.col("id").cast("string"), F.lit("/:key")).alias("path"))
    return lineage.match_routes(spans, ends)


@query(None)
def adjustment_set(spark, d):
    found = analytics.adjustment_set(trade(spark, d)[1], 7, 3)
    return spark.createDataFrame([(i,) for i in found], "id int")


@query("SELECT n_nationkey || '.md' AS path, CASE n_nationkey % 3 WHEN 0 THEN n_name WHEN 1 THEN 'n:' || n_nationkey ELSE n_name || 'x' END AS name, CASE n_nationkey % 3 WHEN 2 THEN 'suggested' ELSE 'verified' END AS status, CASE n_nationkey % 3 WHEN 2 THEN n_name ELSE 'n:' || n_nationkey END AS match FROM nation")
def grounded_references(spark, d):
    n = nation(spark, d)
    m = F.col("n_nationkey") % 3
    name = F.when(m == 0, F.col("n_name")).when(m == 1, F.concat(F.lit("n:"), "k")).otherwise(F.concat("n_name", F.lit("x")))
    refs = n.select(F.concat("k", F.lit(".md")).alias("path"), name.alias("name"))
    return retrieval.ground(refs, n.select(ref("n:", "n_nationkey").alias("id"), F.col("n_name").alias("name")))


@query(f"WITH {sql.SPANS}, n AS (SELECT n_nationkey AS k FROM nation), s AS (SELECT * FROM spans WHERE span_id % 25 < 20) SELECT 'n:' || (span_id % 25) AS node_id, count(*) AS call_count, round(sum(duration_ms), 2) AS total_duration_ms, count_if(is_error) AS error_count FROM s GROUP BY 1")
def telemetry_by_node(spark, d):
    s = views.spans(spark, d).withColumn("k", F.col("span_id") % 25)
    s = s.withColumn("name", F.when(F.col("k") < 20, F.concat(F.lit("NATION_"), F.col("k").cast("string"), F.lit("(x)"))).otherwise(F.concat(F.lit("gone"), F.col("k").cast("string"))))
    nodes = nation(spark, d).select(ref("n:", "n_nationkey").alias("id"), ref("nation_", "n_nationkey").alias("name"), F.lit("function").alias("node_type"), F.lit("x.py").alias("path"))
    t = telemetry.by_target(s.join(resolve_targets(nodes, s.select(F.col("name").alias("target"))).withColumnRenamed("target", "name"), "name"), "id")
    return t.select("node_id", "call_count", F.round("total_duration_ms", 2).alias("total_duration_ms"), "error_count")


# --- text ----------------------------------------------------------------


@query("SELECT n_nationkey, lower(regexp_replace(regexp_replace(x, '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug, regexp_replace(x, '[\\\\/:*?\"<>|#^\\[\\]]', '_', 'g') AS file, CASE WHEN regexp_matches(x, '^[0-9]') THEN '_' ELSE '' END || regexp_replace(x, '[^A-Za-z0-9_]', '_', 'g') AS ident FROM (SELECT n_nationkey, n_nationkey || ' ' || n_name || ': a/b [c]?' AS x FROM nation)")
def sanitised_names(spark, d):
    n = nation(spark, d).select("n_nationkey", F.concat("k", F.lit(" "), "n_name", F.lit(": a/b [c]?")).alias("x"))
    return n.select("n_nationkey", text.slug(F.col("x")).alias("slug"), text.file_name(F.col("x")).alias("file"), text.identifier(F.col("x")).alias("ident"))
