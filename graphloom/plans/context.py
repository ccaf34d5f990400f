"""Registered search, pack, resolution and extraction queries with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..operators import context
from ..resolve import resolve_symbols
from ..sources import capabilities, docs, semantics
from .change import ref
from .graph import G, supply
from .registry import query


@query(None)
def hybrid_search(spark, d):
    return context.hybrid_search(views.supply_nodes(spark, d), "automobile nation FRANCE OR germany", 10)


_HEADER = "# Context for ''AMERICA''\n# Strategy: plain, budget: 60 tokens\n\n"


@query(
    f"WITH {G}, c AS (SELECT 'r:1' AS id UNION SELECT source_id FROM edges JOIN nodes ON id = source_id WHERE target_id = 'r:1' UNION SELECT target_id FROM edges WHERE source_id = 'r:1'), "
    "s AS (SELECT id, CASE WHEN id = 'r:1' THEN 5.0 WHEN node_type IN ('class', 'function') THEN 2.0 ELSE 0.0 END AS score, "
    "CASE node_type WHEN 'class' THEN '# ' || path || chr(10) || 'class ' || name || ':' || chr(10) || '    \"\"\"' || coalesce(docstring, '') || '\"\"\"' || chr(10) || '    ...' || chr(10) "
    "WHEN 'function' THEN '# ' || path || chr(10) || 'def ' || name || '(...):' || chr(10) || '    \"\"\"' || coalesce(docstring, '') || '\"\"\"' || chr(10) || '    ...' || chr(10) "
    "ELSE '# ' || path || ' (' || node_type || ': ' || name || ')' || chr(10) END AS text FROM c JOIN nodes USING (id)), "
    f"k AS (SELECT *, greatest(1, ceil(length(text) / 4))::BIGINT AS cost FROM s), r AS (SELECT id, score, cost, (ceil(length('{_HEADER}') / 4) + sum(cost) OVER (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING))::BIGINT AS used, text FROM k) SELECT * FROM r WHERE used <= 60"
)
def topology_pack(spark, d):
    return context.topology_pack(*supply(spark, d), "AMERICA", 60, "plain")


@query(
    f"WITH RECURSIVE {G}, reach AS (SELECT source_id AS id, 1 AS depth FROM edges WHERE target_id = 'c:5' UNION SELECT e.source_id, r.depth + 1 FROM edges e JOIN reach r ON e.target_id = r.id WHERE r.depth < 2) "
    "SELECT 'symbol' AS section, id, name FROM nodes WHERE id = 'c:5' UNION ALL SELECT DISTINCT 'impacted', id, name FROM reach JOIN nodes USING (id) WHERE id <> 'c:5'"
)
def context_pack(spark, d):
    return context.context_pack(*supply(spark, d), "Customer#000000005", 2)


_SYMBOLS = (
    "WITH s AS (SELECT 'f:' || s_suppkey AS id, 'f' || (s_suppkey % 20) AS name, 'src/m' || (s_suppkey % 7) AS mod FROM supplier), "
    "c AS (SELECT DISTINCT 'func:app/' || c_nationkey || '.py:' || (c_custkey % 25) AS source_id, 'f' || (c_custkey % 25) AS callee, 'src/m' || (c_nationkey % 7) AS mod FROM customer), "
    "p AS (SELECT mod, name, max(id) AS id FROM s GROUP BY 1, 2), n AS (SELECT name, count(*) AS n, min(id) AS id FROM s GROUP BY 1), "
    "r AS (SELECT c.source_id, c.callee, p.id AS near, n.n, n.id AS far FROM c LEFT JOIN p ON p.mod = c.mod AND p.name = c.callee LEFT JOIN n ON n.name = c.callee) "
)


@query(_SYMBOLS + "SELECT source_id, callee, CASE WHEN near IS NOT NULL THEN near WHEN n = 1 THEN far END AS target_id, CASE WHEN near IS NOT NULL OR n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status FROM r")
def symbol_resolution(spark, d):
    return resolve_symbols(*_program(spark, d))[0]


@query("SELECT 'i:' || n_nationkey AS source_id, 'g:' || (n_nationkey % 7) AS target_id, 'references' AS edge_type, 'resolved' AS provenance FROM nation UNION ALL SELECT 'i:' || n_nationkey, 'g:' || (n_nationkey % 7), 'verifies', 'test_import_proof' FROM nation WHERE n_nationkey % 5 = 0")
def import_links(spark, d):
    nodes, edges, aliases = _program(spark, d)
    # one function goes by each module's name
    extra = spark.range(7).select(ref("g:", "id").alias("id"), ref("m", "id").alias("name"), F.lit("function").alias("node_type"), F.concat(ref("src/m", "id"), F.lit(".py")).alias("path"))
    tests = F.when((F.col("node_type") == "import") & (F.substring("id", 3, 9).cast("int") % 5 == 0), F.concat(F.lit("tests/"), "path")).otherwise(F.col("path"))
    return resolve_symbols(nodes.unionByName(extra).withColumn("path", tests), edges.limit(0), aliases)[1]


def _program(spark, d):
    """Functions of modules, files that import one module each, and their calls."""
    s, n, c = (views.table(spark, d, t) for t in ("supplier", "nation", "customer"))
    mod = lambda k: F.concat(F.lit("src/m"), (F.col(k) % 7).cast("string"))
    app = lambda k: F.concat(ref("app/", k), F.lit(".py"))
    who = F.concat(F.lit("func:"), app("c_nationkey"), F.lit(":"), (F.col("c_custkey") % 25).cast("string"))
    nodes = s.select(ref("f:", "s_suppkey").alias("id"), F.concat(F.lit("f"), (F.col("s_suppkey") % 20).cast("string")).alias("name"), F.lit("function").alias("node_type"), F.concat(mod("s_suppkey"), F.lit(".py")).alias("path"))
    nodes = nodes.union(n.select(ref("i:", "n_nationkey"), F.concat(F.lit("@lib/m"), (F.col("n_nationkey") % 7).cast("string")), F.lit("import"), app("n_nationkey")))
    nodes = nodes.union(c.select(who, who, F.lit("method"), app("c_nationkey")).distinct())
    edges = c.select(who.alias("source_id"), F.concat(F.lit("func_call:f"), (F.col("c_custkey") % 25).cast("string")).alias("target_id"), F.lit("calls").alias("edge_type"))
    return nodes, edges, spark.createDataFrame([("@lib", "src")], "prefix string, target string")


# --- extraction ----------------------------------------------------------


def _sources(spark, d):
    n, key = views.table(spark, d, "nation"), F.col("n_nationkey").cast("string")
    code = F.concat(
        F.lit("router = APIRouter()\n\n@router.get('/nations/{key}/"), key, F.lit("')\ndef read_"), key, F.lit("(db=Depends(get_db)):\n    producer.send('region."), F.col("n_regionkey").cast("string"),
        F.lit("', db)\n\n@app.task(name='job."), key, F.lit("')\ndef work():\n    consumer = KafkaConsumer('region."), F.col("n_regionkey").cast("string"), F.lit("')\n"),
    )
    return n.select(F.concat(F.lit("api/n"), key, F.lit(".py")).alias("path"), code.cast("binary").alias("content"))


@query(
    "WITH n AS (SELECT n_nationkey::VARCHAR AS k, n_regionkey::VARCHAR AS r, 'api/n' || n_nationkey || '.py' AS p FROM nation) "
    "SELECT 'endpoint:GET:/nations/{key}/' || k AS id, 'endpoint' AS node_type, p AS path, 'fastapi' AS detail FROM n UNION ALL SELECT 'topic:job.' || k, 'topic', p, 'celery' FROM n UNION ALL SELECT 'topic:region.' || r, 'topic', min(p), 'kafka' FROM n GROUP BY r"
)
def framework_nodes(spark, d):
    return semantics.semantics(_sources(spark, d))[0].select("id", "node_type", "path", "detail")


@query(
    "WITH n AS (SELECT n_nationkey::VARCHAR AS k, n_regionkey::VARCHAR AS r, 'func:api/n' || n_nationkey || '.py:' AS f FROM nation) "
    "SELECT 'endpoint:GET:/nations/{key}/' || k AS source_id, f || 'read_' || k AS target_id, 'routes_to' AS edge_type FROM n UNION ALL SELECT f || 'read_' || k, 'symbol:get_db', 'injects' FROM n "
    "UNION ALL SELECT f || 'read_' || k, 'topic:region.' || r, 'publishes' FROM n UNION ALL SELECT f || 'work', 'topic:region.' || r, 'subscribes' FROM n UNION ALL SELECT f || 'work', 'topic:job.' || k, 'subscribes' FROM n"
)
def event_lineage(spark, d):
    return semantics.semantics(_sources(spark, d))[1].select("source_id", "target_id", "edge_type")


@query("SELECT 'doc:' || n_nationkey || '.md' AS id, n_name AS name, 1 AS start_line FROM nation UNION ALL SELECT 'section:' || n_nationkey || '.md:the_' || lower(replace(n_name, ' ', '_')), 'The ' || n_name, 3 FROM nation")
def markdown_sections(spark, d):
    n = views.table(spark, d, "nation")
    files = n.select(F.concat(F.col("n_nationkey").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("# "), "n_name", F.lit("\n\n## The "), "n_name", F.lit("\ntext")).alias("text"))
    return docs.sections(files)[0].select("id", "name", "start_line")


@query("SELECT 'full_ast' AS coverage_tier, 1::BIGINT AS families, 1::BIGINT AS extensions UNION ALL SELECT 'specialized', 2, 6 UNION ALL SELECT 'limited_fallback', 13, 25")
def capability_summary(spark, d):
    return capabilities.coverage(capabilities.capabilities(spark))
