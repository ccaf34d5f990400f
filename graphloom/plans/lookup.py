"""Registered lookup, telemetry, retrieval and text queries with their oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import views
from ..functions import text
from ..operators import choice, governance, retrieval, telemetry
from ..operators.textindex import TextIndex
from ..storage import shared_dir
from . import sql
from .graph import G, ids, supply
from .registry import query


@query(f"WITH {sql.NODES} SELECT id, name, path FROM nodes WHERE node_type = 'class'")
def nodes_by_type(spark, d):
    return views.of_type(views.supply_nodes(spark, d), "class").select("id", "name", "path")


@query("SELECT 'r' || (p_partkey % 4) AS repo, count(*) AS n, sum(p_size)::BIGINT AS size FROM part WHERE p_partkey % 5 > 0 GROUP BY 1")
def metadata_scan(spark, d):
    p = views.table(spark, d, "part")
    text_ = F.concat(F.lit('{"repo": "r'), (F.col("p_partkey") % 4).cast("string"), F.lit('", "size": '), F.col("p_size").cast("string"), F.lit("}"))
    rows = views.with_metadata(p.select(F.when(F.col("p_partkey") % 5 > 0, text_).otherwise("no json").alias("metadata_json"))).filter("metadata IS NOT NULL")
    get = lambda path, kind: F.try_variant_get("metadata", path, kind)
    return rows.groupBy(get("$.repo", "string").alias("repo")).agg(F.count(F.lit(1)).alias("n"), F.sum(get("$.size", "long")).alias("size"))


@query(f"WITH {sql.NODES} SELECT id, name FROM nodes WHERE lower(name) = 'customer#000000007' OR lower(name) = 'france' ORDER BY id LIMIT 10")
def find_by_name(spark, d):
    low = F.lower("name")
    return views.supply_nodes(spark, d).filter((low == "customer#000000007") | (low == "france")).select("id", "name").orderBy("id").limit(10)


@query(f"WITH {sql.NODES} SELECT id, name, path FROM nodes WHERE name ILIKE '%asia%' OR docstring ILIKE '%auto%' OR path ILIKE '%asia%'")
def like_search(spark, d):
    hit = F.col("name").ilike("%asia%") | F.col("docstring").ilike("%auto%") | F.col("path").ilike("%asia%")
    return views.supply_nodes(spark, d).filter(hit).select("id", "name", "path")


@query(
    f"WITH {G}, c AS (SELECT target_id AS id, count(*) AS callers FROM edges GROUP BY 1) SELECT id, start_line, coalesce(callers, 0) AS callers, "
    "CASE WHEN coalesce(callers, 0) >= 10 THEN 'CRITICAL' WHEN coalesce(callers, 0) >= 5 THEN 'HIGH' WHEN coalesce(callers, 0) >= 1 THEN 'MODERATE' ELSE 'LOW' END AS risk FROM nodes LEFT JOIN c USING (id) WHERE path = 'cli/nation_3.py'"
)
def symbols_of_file(spark, d):
    nodes, edges = supply(spark, d)
    own = nodes.filter("path = 'cli/nation_3.py'")
    calls = edges.join(own.select(F.col("id").alias("target_id")), "target_id", "left_semi").groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("callers"))
    c = F.col("callers")
    out = own.join(calls, "id", "left").select("id", "start_line", F.coalesce("callers", F.lit(0)).alias("callers"))
    return out.withColumn("risk", F.when(c >= 10, "CRITICAL").when(c >= 5, "HIGH").when(c >= 1, "MODERATE").otherwise("LOW"))


@query(f"WITH {G}, k AS (SELECT id FROM nodes WHERE node_type IN ('module', 'service')) SELECT source_id, target_id, edge_type FROM edges WHERE source_id IN (SELECT id FROM k) AND target_id IN (SELECT id FROM k)")
def subgraph_by_type(spark, d):
    nodes, edges = supply(spark, d)
    return views.closed(nodes.filter("node_type IN ('module', 'service')"), edges).select("source_id", "target_id", "edge_type")


@query(
    f"WITH {sql.NODES}, q(q) AS (VALUES ('n:3'), ('core/asia'), ('Customer#000000005'), ('cli/nation_4.py'), ('nothing'), ('order 7')), "
    "c AS (SELECT q, id, 1 AS tier FROM q JOIN nodes ON id = q UNION ALL SELECT q, id, 3 FROM (SELECT *, count(*) OVER (PARTITION BY q) AS n FROM q JOIN nodes ON path = q) WHERE n = 1 UNION ALL SELECT q, id, 4 FROM q JOIN nodes ON name = q), "
    "b AS (SELECT *, min(tier) OVER (PARTITION BY q) AS best FROM c) SELECT q.q AS query, CASE count(id) WHEN 0 THEN 'unresolved' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN count(id) = 1 THEN min(id) END AS selected, count(id) AS candidates "
    "FROM q LEFT JOIN (SELECT * FROM b WHERE tier = best) b USING (q) GROUP BY 1"
)
def resolve_candidates(spark, d):
    from ..resolve import resolve

    wanted = spark.createDataFrame([(q,) for q in ("n:3", "core/asia", "Customer#000000005", "cli/nation_4.py", "nothing", "order 7")], "query string")
    return resolve(views.supply_nodes(spark, d), wanted)


@query(f"WITH {sql.NODES} SELECT id, {sql.TIER} AS tier FROM nodes WHERE node_type <> 'endpoint'")
def path_tiers(spark, d):
    return views.supply_nodes(spark, d).filter("node_type <> 'endpoint'").select("id", governance.path_tier(F.col("path")).alias("tier"))


@query(f"WITH {sql.NODES} SELECT {sql.DOMAIN} AS domain, node_type, count(*) AS n, count(DISTINCT path) AS files FROM nodes GROUP BY 1, 2")
def domain_types(spark, d):
    n = views.supply_nodes(spark, d)
    return n.groupBy(governance.domain(F.col("node_type"), F.col("path")).alias("domain"), "node_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("files"))


@query("SELECT path, package FROM (SELECT 'graph/nation_' || n_nationkey || '.py' AS path, 'graph' AS package FROM nation UNION ALL SELECT 'core/' || lower(r_name), CASE WHEN r_name = 'ASIA' THEN 'asia' ELSE 'core' END FROM region)")
def longest_prefix_match(spark, d):
    files = views.supply_nodes(spark, d).filter("node_type IN ('module', 'service')").select("path")
    packages = spark.createDataFrame([("graph", "graph"), ("core", "core"), ("asia", "core/asia")], "name string, path string")
    return governance.longest_prefix(files, packages)


@query(f"WITH {sql.NODES}, h AS (SELECT DISTINCT path, s, s + 25 AS e FROM (SELECT path FROM nodes WHERE node_type = 'function'), (VALUES (100), (2000), (7000)) v(s)) SELECT DISTINCT id, path, start_line, end_line FROM nodes JOIN h USING (path) WHERE node_type = 'function' AND NOT (end_line < s OR start_line > e)")
def interval_overlap(spark, d):
    code = views.supply_nodes(spark, d).filter("node_type = 'function'")
    starts = spark.createDataFrame([(100,), (2000,), (7000,)], "start int")
    hunks = code.select("path").distinct().join(F.broadcast(starts)).withColumn("end", F.col("start") + 25)
    return governance.overlapping_symbols(hunks, code)


@query(f"WITH {sql.NODES}, p AS (SELECT DISTINCT path, l FROM nodes, (VALUES (15), (433), (5001)) v(l) WHERE node_type = 'function'), m AS (SELECT p.path, l, id, row_number() OVER (PARTITION BY p.path, l ORDER BY start_line, id) AS r FROM p JOIN nodes n ON n.path = p.path AND l BETWEEN start_line AND end_line) SELECT path, l::INT AS line, id FROM m WHERE r = 1")
def point_in_interval(spark, d):
    code = views.supply_nodes(spark, d).filter("node_type = 'function'")
    lines = spark.createDataFrame([(15,), (433,), (5001,)], "line int")
    return governance.enclosing_symbol(code.select("path").distinct().join(F.broadcast(lines)), code)


@query("WITH s AS (SELECT p_partkey::VARCHAR AS path, p_size AS h FROM part WHERE p_partkey % 3 <> 0), f AS (SELECT p_partkey::VARCHAR AS path, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS h FROM part WHERE p_partkey % 4 <> 0) SELECT coalesce(s.path, f.path) AS path, CASE WHEN s.h IS NULL THEN 'unindexed' WHEN f.h IS NULL THEN 'missing' WHEN s.h = f.h THEN 'verified' ELSE 'stale' END AS state FROM s FULL JOIN f ON s.path = f.path")
def freshness_full_outer(spark, d):
    p = views.table(spark, d, "part")
    path, size = F.col("p_partkey").cast("string").alias("path"), F.col("p_size")
    stored = p.filter("p_partkey % 3 <> 0").select(path, size.alias("content_hash"))
    found = p.filter("p_partkey % 4 <> 0").select(path, F.when(F.col("p_partkey") % 5 == 0, size + 1).otherwise(size).alias("content_hash"))
    return governance.freshness(stored, found)


@query("WITH c AS (SELECT o_custkey AS story, count(*) AS criteria, count_if(o_orderstatus <> 'F') AS open_tasks FROM orders GROUP BY 1) SELECT c_custkey AS story, coalesce(criteria, 0) AS criteria, coalesce(open_tasks, 0) AS open_tasks, coalesce(criteria, 0) > 0 AND coalesce(open_tasks, 0) = 0 AS can_ship FROM customer LEFT JOIN c ON c_custkey = story")
def can_ship(spark, d):
    orders = views.table(spark, d, "orders").select(F.col("o_custkey").alias("story"), (F.col("o_orderstatus") == "F").alias("completed"))
    return governance.ship_proof(views.table(spark, d, "customer").select(F.col("c_custkey").alias("story")), orders, orders)


# --- telemetry -----------------------------------------------------------


@query(f"WITH {sql.SPANS}, {sql.LINKS} SELECT source, target, count(*) AS calls, round(sum(duration_ms), 2) AS total_ms, round(avg(duration_ms), 4) AS avg_ms, round(quantile_cont(duration_ms, 0.5), 4) AS p50_ms, round(quantile_cont(duration_ms, 0.95), 4) AS p95_ms, round(quantile_cont(duration_ms, 0.99), 4) AS p99_ms, count_if(is_error) AS errors, round(count_if(is_error) / count(*), 4) AS error_rate, array_to_string(list_sort(list(DISTINCT name))[1:10], ',') AS operations FROM links GROUP BY 1, 2")
def topology_edges(spark, d):
    return telemetry.topology(views.spans(spark, d)).withColumn("operations", F.array_join("operations", ","))


_T = "t AS (SELECT service_name AS node_id, count(*) AS call_count, sum(duration_ms) AS total_duration_ms, list_sort(list(duration_ms))[least(floor(0.95 * count(*))::INT + 1, count(*))] AS p95_duration_ms, count_if(is_error) AS error_count FROM spans {0} GROUP BY 1)"


@query(f"WITH {sql.SPANS}, {_T.format('')} SELECT node_id, call_count, round(total_duration_ms, 2) AS total_duration_ms, p95_duration_ms, error_count, round(total_duration_ms / call_count, 4) AS avg_duration_ms, round(error_count / call_count, 4) AS error_rate FROM t")
def p95_index(spark, d):
    t = telemetry.by_target(views.spans(spark, d))
    return t.select("node_id", "call_count", F.round("total_duration_ms", 2).alias("total_duration_ms"), "p95_duration_ms", "error_count", F.round("avg_duration_ms", 4).alias("avg_duration_ms"), F.round("error_rate", 4).alias("error_rate"))


@query("SELECT event_type AS target, count(value) AS runs, min(value) AS min_ms, max(value) AS max_ms, round(avg(value), 4) AS avg_ms, quantile_disc(value, 0.5) AS p50_ms, quantile_disc(value, 0.95) AS p95_ms, quantile_disc(value, 0.99) AS p99_ms, round(count(value) * 1000 / sum(value), 2) AS per_second FROM events GROUP BY 1")
def p95_disc(spark, d):
    e = views.table(spark, d, "events")
    return telemetry.timing_stats(e.select(F.col("event_type").alias("target"), F.col("value").alias("ms")))


_DAYS = "b AS (SELECT service_name AS node_id, trace_id, count(*) AS call_count, sum(duration_ms) AS total_duration_ms, max(duration_ms) AS p95_duration_ms, count_if(is_error) AS error_count FROM spans GROUP BY 1, 2)"


@query(f"WITH {sql.SPANS}, {_DAYS} SELECT node_id, sum(call_count)::BIGINT AS call_count, round(sum(total_duration_ms), 2) AS total_duration_ms, max(p95_duration_ms) AS p95_duration_ms, sum(error_count)::BIGINT AS error_count, round(sum(total_duration_ms) / sum(call_count), 4) AS avg_duration_ms, round(sum(error_count) / sum(call_count), 4) AS error_rate FROM b GROUP BY 1")
def telemetry_merge(spark, d):
    s = views.spans(spark, d)
    batches = s.groupBy(F.col("service_name").alias("node_id"), "trace_id").agg(F.count(F.lit(1)).alias("call_count"), F.sum("duration_ms").alias("total_duration_ms"), F.max("duration_ms").alias("p95_duration_ms"), F.sum(F.col("is_error").cast("long")).alias("error_count"))
    m = telemetry.merge_telemetry(batches)
    return m.select("node_id", "call_count", F.round("total_duration_ms", 2).alias("total_duration_ms"), "p95_duration_ms", "error_count", F.round("avg_duration_ms", 4).alias("avg_duration_ms"), F.round("error_rate", 4).alias("error_rate"))


_USERS = "t AS (SELECT trace_id AS node_id, count(*) AS c, avg(duration_ms) AS l, count_if(is_error) / count(*) AS r FROM spans GROUP BY 1)"


@query(f"WITH {sql.SPANS}, {_USERS}, h AS (SELECT node_id, c AS call_count, r, round(0.5 * c / (SELECT max(c) FROM t) + 0.3 * l / (SELECT max(l) FROM t) + 0.2 * least(1, r), 4) AS heat FROM t) SELECT node_id, call_count, heat, CASE WHEN heat >= 0.75 OR r >= 0.2 THEN 'CRITICAL' WHEN heat >= 0.45 THEN 'HIGH' WHEN heat >= 0.2 THEN 'MEDIUM' WHEN heat > 0 THEN 'LOW' ELSE 'COLD' END AS level FROM h ORDER BY heat DESC, node_id LIMIT 50")
def heatmap(spark, d):
    t = views.spans(spark, d).groupBy(F.col("trace_id").alias("node_id")).agg(F.count(F.lit(1)).alias("call_count"), F.avg("duration_ms").alias("avg_duration_ms"), F.avg(F.col("is_error").cast("int")).alias("error_rate"))
    return telemetry.heat(t)


@query(
    f"""WITH RECURSIVE {G}, reach AS (SELECT source_id AS id, 1 AS depth, target_id AS target FROM edges WHERE target_id IN ('n:1', 'n:2') UNION SELECT e.source_id, r.depth + 1, r.target FROM edges e JOIN reach r ON e.target_id = r.id WHERE r.depth < 2),
m AS (SELECT target, id, min(depth) AS depth FROM reach WHERE id <> target GROUP BY 1, 2), t AS (SELECT 'o:' || o_orderkey AS id, (o_orderkey % 50)::BIGINT AS calls, (o_orderkey % 4) / 20.0::DOUBLE AS rate FROM orders WHERE o_orderkey % 3 = 0),
j AS (SELECT target, depth, coalesce(calls, 0) AS calls, coalesce(rate, 0) AS rate FROM m LEFT JOIN t USING (id))
SELECT target, sum(calls)::BIGINT AS calls, round(sum(calls * (1 + 2 * rate) / power(depth, 1.5)), 2) AS traffic, count_if(calls > 0) AS active, count_if(calls = 0) AS dormant,
CASE WHEN sum(calls) >= 10000 OR bool_or(rate >= 0.15 AND calls >= 100) THEN 'P0_CRITICAL' WHEN sum(calls) >= 1000 THEN 'P1_HIGH' WHEN sum(calls) >= 100 THEN 'P2_MEDIUM' WHEN sum(calls) > 0 THEN 'P3_LOW' ELSE 'P4_DORMANT' END AS tier FROM j GROUP BY 1"""
)
def risk_tier(spark, d):
    from ..operators.traverse import impact

    found = impact(*supply(spark, d), ids(spark, "n:1", "n:2"), 2)
    o = views.table(spark, d, "orders").filter("o_orderkey % 3 = 0")
    t = o.select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("node_id"), (F.col("o_orderkey") % 50).alias("call_count"), ((F.col("o_orderkey") % 4) / 20.0).alias("error_rate"))
    return telemetry.traffic_risk(found, t)


@query(f"WITH {sql.SPANS}, half AS (SELECT quantile_disc(ts, 0.5) AS m FROM spans), a AS (SELECT service_name || name AS node_id, quantile_cont(duration_ms, 0.95) AS p FROM spans, half WHERE ts <= m GROUP BY 1), b AS (SELECT service_name || name AS node_id, quantile_cont(duration_ms, 0.95) AS p FROM spans, half WHERE ts > m GROUP BY 1), j AS (SELECT b.node_id, CASE WHEN a.p > 1e-4 THEN round((b.p - a.p) / a.p * 100, 2) ELSE 0 END AS delta_pct, a.p AS was FROM b LEFT JOIN a USING (node_id)) SELECT node_id, delta_pct, CASE WHEN was IS NULL THEN 'PASSED' WHEN delta_pct > 10 THEN 'REGRESSION' WHEN delta_pct > 5 THEN 'WARNING' WHEN delta_pct < -10 THEN 'IMPROVED' ELSE 'PASSED' END AS verdict FROM j")
def regression_verdict(spark, d):
    s = views.spans(spark, d)
    m = s.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY unix_micros(cast(ts AS timestamp)))").alias("m")).first()["m"]
    late = F.unix_micros(F.col("ts").cast("timestamp")) > F.lit(int(m))
    p = lambda rows: rows.groupBy(F.concat("service_name", "name").alias("node_id")).agg(F.percentile("duration_ms", F.lit(0.95)).alias("p95_duration_ms"))
    return telemetry.regression(p(s.filter(late)), p(s.filter(~late)))


# --- text and retrieval --------------------------------------------------


_BM25 = r"""WITH t AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents), l AS (SELECT id, len(t) AS dl FROM t), p AS (SELECT id, unnest(t) AS term FROM t),
h AS (SELECT id, w, count(*) AS tf FROM p JOIN (VALUES ('idiot'), ('clown')) v(w) ON starts_with(term, w) GROUP BY 1, 2), s AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS a FROM l), df AS (SELECT w, count(*) AS df FROM h GROUP BY 1),
b AS (SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / a))), 6) AS score FROM h JOIN df USING (w) JOIN l USING (id), s GROUP BY 1 HAVING count(*) = 2 ORDER BY score DESC, id LIMIT 20)
SELECT id, score, row_number() OVER (ORDER BY score DESC, id)::INT AS rank FROM b"""


@query(_BM25)
def bm25_topk(spark, d):
    return retrieval.search(views.table(spark, d, "documents"), ["text"], "idiot clown", 20, "doc_id")


@query(_BM25)
def bm25_of_index(spark, d):
    """The same search in an index that was written in two batches."""
    index = TextIndex(spark, f"{shared_dir(spark)}/graphloom/index-{uuid.uuid4().hex}")
    docs = views.table(spark, d, "documents")
    for part in (docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 <> 0")):
        index.add(part, ["text"], "doc_id")
    return index.search("idiot clown", 20)



@query(
    """WITH a AS (SELECT vec_id AS id, embedding FROM embeddings), q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)
SELECT id, round(least(1, greatest(0, list_sum(list_transform(range(1, len(embedding) + 1), lambda i: embedding[i]::DOUBLE * q[i]::DOUBLE)))), 4) AS score FROM a, q ORDER BY score DESC, id LIMIT 10"""
)
def cosine_topk(spark, d):
    e = views.table(spark, d, "embeddings")
    q = e.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(q)).select(F.col("vec_id").alias("id"), F.round(retrieval.cosine(F.col("embedding"), F.col("q")), 4).alias("score")).orderBy(F.desc("score"), "id").limit(10)


@query("SELECT p_partkey AS id, greatest(0.05, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))) AS similarity FROM (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type), ' ')) AS b FROM part)")
def jaccard_pairs(spark, d):
    return views.table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.jaccard(text.word_set(F.col("p_name")), text.word_set(F.col("p_type"))).alias("similarity"))


@query("WITH w AS (SELECT DISTINCT upper(left(c_mktsegment, 4)) || 'X' AS name FROM customer), k AS (SELECT DISTINCT n_name AS known FROM nation), m AS (SELECT name, known, levenshtein(name, known) AS distance, row_number() OVER (PARTITION BY name ORDER BY levenshtein(name, known), known) AS r FROM w, k WHERE levenshtein(name, known) <= greatest(10, floor(length(name) * 0.8))) SELECT name, known AS nearest, distance::INT AS distance FROM m WHERE r = 1")
def levenshtein_nearest(spark, d):
    wanted = views.table(spark, d, "customer").select(F.concat(F.upper(F.substring("c_mktsegment", 1, 4)), F.lit("X")).alias("name"))
    return retrieval.nearest_names(wanted, views.table(spark, d, "nation").select(F.col("n_name").alias("name")))


@query("WITH k AS (SELECT DISTINCT p_name || ' ' || p_type || ' ' || p_partkey AS known FROM part), w AS (SELECT DISTINCT substr(known, 1, 3) || 'x' || substr(known, 5, length(known) - 5) AS name FROM k), m AS (SELECT name, min(struct_pack(d := levenshtein(name, known), k := known)) AS m, greatest(10, floor(length(name) * 0.8)) AS most FROM w, k GROUP BY name) SELECT name, m.k AS nearest, m.d::INT AS distance FROM m WHERE m.d <= most")
def nearest_part_names(spark, d):
    """For every part's name, type and key with a letter changed and the last
    one lost, the nearest of all."""
    known = views.table(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_type", F.col("p_partkey").cast("string")).alias("name"))
    damaged = F.concat(F.substring("name", 1, 3), F.lit("x"), F.substring("name", F.lit(5), F.length("name") - 5))
    return retrieval.nearest_names(known.select(damaged.alias("name")), known)


@query("WITH c AS (SELECT doc_id AS id, n_chars::DOUBLE AS score, greatest(1, ceil(length(text) / 4.0))::INT AS cost FROM documents), r AS (SELECT *, (sum(cost) OVER (ORDER BY score DESC, id) + 100)::BIGINT AS used FROM c) SELECT id, score, cost, used FROM r WHERE used <= 40000")
def token_budget_prefix(spark, d):
    docs = views.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"), text.token_cost(F.col("text"), 4.0).alias("cost"))
    return retrieval.budget_prefix(docs, 40000, 100)


_REDACT = "coalesce(text, '')"
for _p, _r in text.SECRET_PATTERNS:
    _REDACT = f"regexp_replace({_REDACT}, '{_p.replace(chr(39), chr(39) * 2)}', '{_r.replace('$1', chr(92) + '1').replace(chr(39), chr(39) * 2)}', 'g')"


@query(f"SELECT doc_id, md5({_REDACT}) AS digest, {_REDACT} <> text AS changed FROM documents")
def redact_secrets(spark, d):
    out = text.redact_secrets(F.col("text"))
    return views.table(spark, d, "documents").select("doc_id", F.md5(out.cast("binary")).alias("digest"), (out != F.col("text")).alias("changed"))


@query("""SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages) GROUP BY 1, 2""")
def page_links(spark, d):
    links = views.table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("href"))
    return links.groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


_TERMS = """w AS (SELECT p_partkey AS id, unnest(list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(p_name || ' ' || p_type, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^a-zA-Z0-9_.-]', ' ', 'g'), '\\s+'), lambda x: trim(lower(x), '._-')), lambda x: length(x) >= 2 AND x NOT IN ('a','an','the','and','or','in','on','at','to','for','with','by','of','from','as','is','are','was','were','it','this','that'))) AS w FROM part),
g AS (SELECT id, '^' || w || '$' AS term, 2.0 AS k FROM w UNION ALL SELECT id, substr(w, i::INT, 3), 0.8 FROM w, range(1, 60) r(i) WHERE i <= length(w) - 2 UNION ALL SELECT id, substr(w, i::INT, 4), 1.0 FROM w, range(1, 60) r(i) WHERE i <= length(w) - 3),
c AS (SELECT id, term, 1 + ln(sum(k::DOUBLE)) AS w, md5(term) AS h FROM g GROUP BY 1, 2),
v AS (SELECT id, (('0x' || substr(h, 1, 2))::INT % 128) AS bucket, sum(CASE WHEN ('0x' || substr(h, 9, 2))::INT % 2 = 0 THEN w ELSE -w END) AS x FROM c GROUP BY 1, 2),
u AS (SELECT id, bucket, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM v)"""


@query(f"WITH {_TERMS} SELECT a.id AS id, round(least(1, greatest(0, sum(a.x * b.x))), 5) AS score FROM u a JOIN u b ON a.bucket = b.bucket AND b.id = 1 GROUP BY 1")
def hash_vector_dot(spark, d):
    p = views.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("t"))
    q = retrieval.hashed_vectors(p.filter("id = 1"), F.col("t"))
    found = retrieval.products(retrieval.hashed_entries(p, F.col("t")), q)
    return found.select("id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), "s")), 5).alias("score"))


@query(
    "WITH l AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20), s AS (SELECT p_partkey AS id, p_size::DOUBLE AS score, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS r FROM part ORDER BY p_size DESC, p_partkey LIMIT 20) "
    "SELECT coalesce(l.id, s.id) AS id, round(coalesce(1.0::DOUBLE / (60 + l.r), 0) + coalesce(1.0::DOUBLE / (60 + s.r), 0), 6) AS rrf, CASE WHEN l.r IS NOT NULL AND s.r IS NOT NULL THEN 'hybrid' WHEN l.r IS NOT NULL THEN 'lexical' ELSE 'semantic' END AS source, coalesce(s.score, 0) AS vec FROM l FULL JOIN s USING (id) ORDER BY rrf DESC, vec DESC, id LIMIT 10"
)
def rrf_fusion(spark, d):
    from pyspark.sql import Window

    p = views.table(spark, d, "part")

    def ranked(column):
        best = p.select(F.col("p_partkey").alias("id"), F.col(column).cast("double").alias("score")).orderBy(F.desc("score"), "id").limit(20)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))

    return retrieval.fuse(ranked("p_retailprice"), ranked("p_size"))


@query(None)
def submodular_pack(spark, d):
    b = views.table(spark, d, "benchmark")
    c = b.filter("item_id >= 5").select(F.col("item_id").cast("string").alias("id"), "text")
    seeds = b.filter("item_id < 5").select(F.col("item_id").cast("string").alias("id"), "text", F.lit(1.0).alias("weight"))
    return choice.select_submodular(c, seeds, 300)


@query(None)
def submodular_documents(spark, d):
    """Documents that cover the benchmark's items, chosen by rounds in Spark."""
    seeds = views.table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text", F.lit(1.0).alias("weight"))
    c = views.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    return choice.select_submodular(c, seeds, 400, driver_pairs=0)


@query("WITH t AS (SELECT event_type AS topic, count_if(user_id % 3 = 0) AS pubs, count_if(user_id % 3 = 1 AND event_type <> 'error') AS subs FROM events GROUP BY 1) SELECT topic, pubs AS publishers, subs AS subscribers, CASE WHEN pubs = 0 AND subs = 0 THEN 'isolated' WHEN pubs = 0 THEN 'no_publishers' WHEN subs = 0 THEN 'no_subscribers' ELSE 'connected' END AS state FROM t")
def event_orphans(spark, d):
    from ..operators.lineage import topics

    e = views.table(spark, d, "events")
    ref = F.concat(F.lit("topic:"), F.col("event_type"))
    pubs = e.filter("user_id % 3 = 0").select(F.col("user_id").cast("string").alias("source_id"), ref.alias("target_id"), F.lit("publishes").alias("edge_type"))
    subs = e.filter("user_id % 3 = 1 AND event_type <> 'error'").select(F.col("user_id").cast("string").alias("source_id"), ref.alias("target_id"), F.lit("subscribes").alias("edge_type"))
    nodes = e.select(ref.alias("id"), F.col("event_type").alias("name")).distinct().withColumn("node_type", F.lit("topic"))
    return topics(nodes, pubs.union(subs)).select(F.col("name").alias("topic"), "publishers", "subscribers", "state")
