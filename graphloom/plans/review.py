"""Registered review, lineage and boundary queries with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..functions import text
from ..operators import governance, lineage, review, telemetry
from ..resolve import link_references
from . import sql
from .graph import G, supply
from .registry import query


@query(f"WITH {G}, h AS (SELECT source_id AS id, min(target_id) AS handler FROM edges WHERE edge_type = 'routes_to' GROUP BY 1) SELECT n.id AS endpoint, n.name, handler FROM nodes n LEFT JOIN h USING (id) WHERE node_type = 'endpoint'")
def route_handlers(spark, d):
    return lineage.routes(*supply(spark, d)).select("endpoint", "name", "handler")


_INJECT = """inj AS (SELECT 's:' || s_suppkey AS source_id, CASE WHEN s_suppkey % 2 = 0 THEN 'n:' || s_nationkey ELSE 'symbol:' || n_name END AS target_id FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


@query(f"WITH {_INJECT}, k AS (SELECT 'n:' || n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey = 1) SELECT DISTINCT id, 'in' AS direction, source_id AS other FROM k JOIN inj ON target_id = id OR target_id = 'symbol:' || name")
def di_graph(spark, d):
    n = views.table(spark, d, "nation")
    s = views.table(spark, d, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
    ref = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = s.select(ref("s:", "s_suppkey").alias("source_id"), F.when(F.col("s_suppkey") % 2 == 0, ref("n:", "s_nationkey")).otherwise(ref("symbol:", "n_name")).alias("target_id"), F.lit("injects").alias("edge_type"))
    return lineage.injection(None, edges, n.filter("n_regionkey = 1").select(ref("n:", "n_nationkey").alias("id"), F.col("n_name").alias("name")))


@query(f"WITH {G}, e AS (SELECT split_part(a.path, '/', 1) AS source, split_part(b.path, '/', 1) AS target FROM edges JOIN nodes a ON a.id = source_id JOIN nodes b ON b.id = target_id) SELECT source, target, count(*) AS edges FROM e WHERE source <> target AND NOT (source = 'tests' AND target = 'cli') GROUP BY 1, 2")
def undeclared_packages(spark, d):
    nodes, edges = supply(spark, d)
    p = lambda end, name: nodes.select(F.col("id").alias(end), F.col("path").alias(name))
    e = edges.join(p("source_id", "source"), "source_id").join(p("target_id", "target"), "target_id").select("source", "target")
    names = "core graph parser cli tests".split()
    return governance.undeclared_packages(e, spark.createDataFrame([(x, x) for x in names], "name string, path string"), spark.createDataFrame([("tests", "cli")], "source string, target string"))


@query("WITH u AS (SELECT DISTINCT url, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+', ''), '[?#].*$', '') AS p FROM pages), r AS (SELECT DISTINCT '/' || page_id AS route FROM pages UNION SELECT '/en/' || page_id FROM pages WHERE page_id % 2 = 0), m AS (SELECT url, route, row_number() OVER (PARTITION BY url ORDER BY length(route) DESC, route DESC) AS k FROM u JOIN r ON p = route OR ends_with(p, route)) SELECT url, route FROM m WHERE k = 1")
def cross_repo_links(spark, d):
    pages = views.table(spark, d, "pages")
    i = F.col("page_id").cast("string")
    routes = pages.select(F.concat(F.lit("/"), i).alias("route")).union(pages.filter("page_id % 2 = 0").select(F.concat(F.lit("/en/"), i)))
    return lineage.cross_repository(pages.select("url"), routes)


@query("WITH r AS (SELECT 'o:' || o_orderkey AS source_id, CASE WHEN o_orderkey % 3 = 0 THEN 'p' || (o_orderkey % 7) ELSE 'x' || o_custkey END AS name FROM orders), s AS (SELECT 'x' || c_custkey AS name, 'c:' || c_custkey AS id FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'p' || (p_partkey % 5), 'p:' || p_partkey FROM part), k AS (SELECT name, count(*) AS n, min(id) AS id FROM s GROUP BY 1) SELECT source_id, r.name, CASE WHEN n = 1 THEN id END AS target_id, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status FROM r LEFT JOIN k ON k.name = r.name")
def link_references_by_name(spark, d):
    o, c, p = (views.table(spark, d, t) for t in ("orders", "customer", "part"))
    t = lambda a, b: F.concat(F.lit(a), b.cast("string"))
    refs = o.select(t("o:", F.col("o_orderkey")).alias("source_id"), F.when(F.col("o_orderkey") % 3 == 0, t("p", F.col("o_orderkey") % 7)).otherwise(t("x", F.col("o_custkey"))).alias("name"))
    symbols = c.filter("c_custkey % 2 = 0").select(t("x", F.col("c_custkey")).alias("name"), t("c:", F.col("c_custkey")).alias("id")).union(p.select(t("p", F.col("p_partkey") % 5), t("p:", F.col("p_partkey"))))
    return link_references(refs, symbols)


@query(f"WITH {G}, p AS (SELECT DISTINCT target_id FROM edges WHERE edge_type = 'verifies') SELECT DISTINCT e.source_id, e.target_id, p.target_id IS NOT NULL AS verified FROM edges e LEFT JOIN p ON p.target_id = e.target_id WHERE e.source_id LIKE 'o:%' AND e.target_id LIKE 'c:%'")
def cross_coupling(spark, d):
    nodes, edges = supply(spark, d)
    return review.couplings(edges, nodes.filter("node_type = 'endpoint'"), nodes.filter("node_type = 'function'"))


@query("SELECT round(count_if(e AND f) / count_if(f), 4) AS precision, round(count_if(e AND f) / count_if(e), 4) AS recall, round(2 * count_if(e AND f) / (count_if(f) + count_if(e)), 4) AS f1, count_if(f AND NOT e) AS ghosts FROM (SELECT p_partkey % 3 <> 0 AS e, p_partkey % 4 <> 0 AS f FROM part)")
def retrieval_quality(spark, d):
    p = views.table(spark, d, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("name"))
    return review.retrieval_quality(p.filter("p_partkey % 3 <> 0"), p.filter("p_partkey % 4 <> 0"))


@query("SELECT doc_id::VARCHAR AS path, len(list_filter(string_split(text, chr(10)), lambda l: starts_with(l, '+') AND NOT starts_with(l, '+++'))) AS added, len(list_filter(string_split(text, chr(10)), lambda l: starts_with(l, '-') AND NOT starts_with(l, '---'))) AS deleted FROM (SELECT doc_id, '+' || replace(text, '. ', chr(10) || CASE WHEN doc_id % 2 = 0 THEN '+' ELSE '-' END) AS text FROM documents) ORDER BY added + deleted DESC, path LIMIT 15")
def diffstat(spark, d):
    sign = F.when(F.col("doc_id") % 2 == 0, "+").otherwise("-")
    docs = views.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("+"), F.replace("text", F.lit(". "), F.concat(F.lit("\n"), sign))).alias("diff"))
    return review.diffstat(docs)


@query(f"WITH {G} SELECT id, name, path FROM nodes WHERE node_type IN ('function', 'endpoint', 'class') AND NOT contains(lower(path), 'test') ORDER BY id LIMIT 15")
def benchmark_targets(spark, d):
    return review.discover_targets(views.supply_nodes(spark, d))


@query(f"WITH {sql.SPANS}, {sql.LINKS}, t AS (SELECT source, target, round(quantile_cont(duration_ms, 0.95), 4) AS p95_ms, round(avg(duration_ms), 4) AS a, count_if(is_error) AS e, round(count_if(is_error) / count(*), 4) AS error_rate FROM links GROUP BY 1, 2) SELECT source, target, p95_ms >= 300 OR a >= 200 AS slow, error_rate >= 0.05 OR e > 0 AS failing, p95_ms, error_rate FROM t WHERE p95_ms >= 300 OR a >= 200 OR e > 0")
def service_bottlenecks(spark, d):
    return telemetry.bottlenecks(telemetry.topology(views.spans(spark, d)))


@query("SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, ceil(length(text) / 3.7)) END::INT AS cost FROM documents")
def token_costs(spark, d):
    return views.table(spark, d, "documents").select("doc_id", text.token_cost(F.col("text")).alias("cost"))


@query("SELECT item_id, name, count(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all('`' || replace(text, ' ', '` `') || '`', '`([A-Za-z0-9_.:]+)`', 1)) AS name FROM benchmark) GROUP BY 1, 2")
def backtick_refs(spark, d):
    quoted = F.concat(F.lit("`"), F.replace("text", F.lit(" "), F.lit("` `")), F.lit("`"))
    b = views.table(spark, d, "benchmark").select("item_id", F.explode(F.regexp_extract_all(quoted, F.lit("`([A-Za-z0-9_.:]+)`"), F.lit(1))).alias("name"))
    return b.groupBy("item_id", "name").agg(F.count(F.lit(1)).alias("n"))
