"""Registered graph queries with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views
from ..functions.text import normalise_name
from ..operators import analytics, governance, rank, traverse
from ..storage import cut
from . import sql
from .registry import query


def ids(spark: SparkSession, *values: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], "id string")


def supply(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return views.supply_nodes(spark, d), views.supply_edges(spark, d)


def trade(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = views.trade_edges(spark, d)
    return views.trade_nodes(spark, d), e.select(F.col("src").alias("source_id"), F.col("tgt").alias("target_id"), "weight")


def trade_pairs(spark: SparkSession, d: str) -> DataFrame:
    return views.simple_undirected(trade(spark, d)[1])


def joined(df: DataFrame, *columns: str) -> DataFrame:
    """Arrays as text, which compares alike everywhere."""
    return df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ">") for c in columns})


G = f"{sql.NODES}, {sql.EDGES}"
IMPACT = """
, reach AS (SELECT source_id AS id, 1 AS depth, edge_type, target_id AS via FROM edges WHERE target_id = '{0}'
  UNION SELECT e.source_id, r.depth + 1, e.edge_type, e.target_id FROM edges e JOIN reach r ON e.target_id = r.id WHERE r.depth < {1}),
best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY depth, edge_type, via) AS k FROM reach WHERE id <> '{0}')
"""


@query(f"WITH RECURSIVE {G} {IMPACT.format('r:1', 3)} SELECT '{'r:1'}' AS target, b.id, b.depth, b.edge_type AS rel_type, b.via AS via_id FROM best b JOIN nodes USING (id) WHERE k = 1")
def impact_bfs(spark, d):
    return traverse.impact(*supply(spark, d), ids(spark, "r:1"), 3)


@query(f"WITH RECURSIVE {G} {IMPACT.format('r:1', 3)} SELECT node_type, depth, count(*) AS n FROM best JOIN nodes USING (id) WHERE k = 1 GROUP BY 1, 2")
def impact_summary(spark, d):
    nodes, edges = supply(spark, d)
    found = traverse.impact(nodes, edges, ids(spark, "r:1"), 3)
    return found.join(nodes.select("id", "node_type"), "id").groupBy("node_type", "depth").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {G}, near AS (SELECT target_id AS center, source_id AS id, 'in' AS direction, edge_type FROM edges UNION ALL SELECT source_id, target_id, 'out', edge_type FROM edges) "
    "SELECT center, id, direction, edge_type, name, node_type FROM near JOIN nodes USING (id) WHERE center IN ('n:0', 'c:1')"
)
def neighbors(spark, d):
    return traverse.neighbours(*supply(spark, d), ids(spark, "n:0", "c:1"))


@query(
    f"WITH {G} SELECT n.id, n.name, coalesce((SELECT array_to_string(list_sort(list(e.edge_type || ':' || e.source_id)), '>') FROM edges e WHERE e.target_id = n.id), '') AS incoming, "
    "coalesce((SELECT array_to_string(list_sort(list(e.edge_type || ':' || e.target_id)), '>') FROM edges e WHERE e.source_id = n.id), '') AS outgoing FROM nodes n WHERE n.id IN ('c:1', 'c:7', 's:3')"
)
def explain_node(spark, d):
    return joined(traverse.explain(*supply(spark, d), ids(spark, "c:1", "c:7", "s:3")), "incoming", "outgoing")


@query(
    f"WITH RECURSIVE {sql.TRADE}, l AS (SELECT DISTINCT src, tgt FROM trade WHERE src <> tgt), walk AS (SELECT 0 AS source, 0 AS id, 0 AS hops, [0] AS path UNION ALL "
    "SELECT 0, tgt, hops + 1, list_append(path, tgt) FROM walk JOIN l ON id = src WHERE hops < 5 AND NOT list_contains(path, tgt)), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY hops, path) AS r FROM walk) SELECT source, id, hops, array_to_string(path, '>') AS path FROM k WHERE r = 1"
)
def shortest_path(spark, d):
    nodes, edges = trade(spark, d)
    return joined(traverse.shortest_paths(nodes, edges, nodes.filter("id = 0").select("id"), 5), "path")


@query(f"WITH {G} SELECT 'nodes' AS kind, node_type AS name, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edges', edge_type, count(*) FROM edges GROUP BY 2 UNION ALL SELECT 'paths', 'distinct', count(DISTINCT path) FROM nodes")
def graph_stats(spark, d):
    nodes, edges = supply(spark, d)
    n = nodes.groupBy(F.col("node_type").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("nodes").alias("kind"), "name", "n")
    e = edges.groupBy(F.col("edge_type").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges").alias("kind"), "name", "n")
    p = nodes.agg(F.countDistinct("path").alias("n")).select(F.lit("paths").alias("kind"), F.lit("distinct").alias("name"), "n")
    return n.unionByName(e).unionByName(p)


@query(f"WITH {G} SELECT n AS nodes, e AS edges, round(e / (n::DOUBLE * (n - 1) + 1e-9), 4) AS density FROM (SELECT count(*) AS n FROM nodes), (SELECT count(*) AS e FROM edges)")
def density(spark, d):
    return analytics.density(*supply(spark, d))


@query(
    f"WITH {G}, x AS (SELECT source_id AS id, 0 AS i, 1 AS o FROM edges WHERE source_id <> target_id UNION ALL SELECT target_id, 1, 0 FROM edges WHERE source_id <> target_id), "
    "s AS (SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM x GROUP BY 1) SELECT id, in_degree, out_degree, in_degree + out_degree AS total, "
    "CASE WHEN in_degree >= 2 * out_degree AND in_degree >= 4 THEN 'AFFERENT' WHEN out_degree >= 2 * in_degree AND out_degree >= 4 THEN 'EFFERENT' ELSE 'BALANCED' END AS kind FROM s WHERE in_degree + out_degree >= 5"
)
def hub_degree(spark, d):
    return analytics.hubs(supply(spark, d)[1])


@query(f"WITH {G}, l AS (SELECT DISTINCT source_id, target_id FROM edges) SELECT a.source_id AS a, a.target_id AS b FROM l a JOIN l b ON a.source_id = b.target_id AND a.target_id = b.source_id WHERE a.source_id < a.target_id")
def bidirectional_pairs(spark, d):
    return traverse.bidirectional_pairs(supply(spark, d)[1])


@query(
    f"WITH RECURSIVE {sql.TRADE}, l AS (SELECT src, tgt FROM trade WHERE src <> tgt), w AS (SELECT src AS s, tgt AS pos, [src, tgt] AS p FROM l WHERE tgt > src UNION ALL "
    "SELECT s, tgt, list_append(p, tgt) FROM w JOIN l ON pos = src WHERE len(p) < 4 AND tgt > s AND NOT list_contains(p, tgt)) "
    "SELECT array_to_string(p, '>') AS cycle, len(p)::INT AS length FROM w JOIN l ON pos = src AND s = tgt"
)
def cycles_len4(spark, d):
    return joined(traverse.simple_cycles(trade(spark, d)[1], 4, None), "cycle")


@query(f"WITH RECURSIVE {sql.TRADE}, {sql.rank_chain(20)} SELECT id, round(score, 6) AS score FROM r20")
def pagerank_20(spark, d):
    nodes, edges = trade(spark, d)
    return rank.pagerank(nodes, edges, 20, tolerance=None).select("id", F.round("score", 6).alias("score"))


_PLAIN = ", ".join(
    ["ids AS (SELECT n_nationkey AS id FROM nation)", "od AS (SELECT src, count(*) AS d FROM trade GROUP BY 1)", "r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM ids) AS score FROM ids)"]
    + [f"r{i + 1} AS MATERIALIZED (SELECT ids.id, 0.15::DOUBLE / (SELECT count(*) FROM ids) + 0.85::DOUBLE * coalesce(f.flow, 0) AS score FROM ids LEFT JOIN (SELECT tgt AS id, sum(score / d) AS flow FROM trade JOIN od USING (src) JOIN r{i} ON r{i}.id = src GROUP BY 1) f ON f.id = ids.id)" for i in range(20)]
)


@query(f"WITH {sql.TRADE}, {_PLAIN} SELECT id, round(score, 6) AS score FROM r20")
def pagerank_b(spark, d):
    nodes, edges = trade(spark, d)
    return rank.pagerank_plain(nodes, edges, 20).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {sql.TRADE}, {sql.rank_chain(20)}, k AS (SELECT id, n_name AS name, round(score, 4) AS score FROM r20 JOIN nation ON id = n_nationkey) SELECT id, name, score, row_number() OVER (ORDER BY score DESC, id)::INT AS place FROM k ORDER BY score DESC, id LIMIT 10")
def top_hubs(spark, d):
    nodes, edges = trade(spark, d)
    scored = rank.pagerank(nodes, edges, 20, tolerance=None).join(nodes, "id").select("id", "name", F.round("score", 4).alias("score"))
    from pyspark.sql import Window

    return scored.orderBy(F.desc("score"), "id").limit(10).withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


@query(f"WITH {sql.TRADE}, {sql.power_chain(15)} SELECT round(sqrt(sum(y * y)), 3) AS radius FROM q14")
def spectral_radius_15(spark, d):
    return rank.spectral_radius(*trade(spark, d), 15, None).select(F.round("radius", 3).alias("radius"))


@query(f"WITH {sql.TRADE}, {sql.resolvent_chain(10, 0.0001, 3)} SELECT id, round(x, 6) AS impact FROM x10 WHERE id <> 3 AND x > 1e-4")
def resolvent_10(spark, d):
    return rank.resolvent(*trade(spark, d), target=3, alpha=0.0001, rounds=10, tolerance=None)


@query(
    f"WITH {sql.TRADE}, {sql.PAIRS}, t AS (SELECT p.u, p.v, count(*) AS t FROM pairs p JOIN both_ways x ON x.a = p.u JOIN both_ways y ON y.a = p.v AND y.b = x.b GROUP BY 1, 2) "
    "SELECT p.u, p.v, (4 - a.d - b.d + 3 * coalesce(t.t, 0))::BIGINT AS curvature FROM pairs p JOIN deg a ON a.id = p.u JOIN deg b ON b.id = p.v LEFT JOIN t ON t.u = p.u AND t.v = p.v"
)
def forman_ricci(spark, d):
    return analytics.forman_ricci(trade_pairs(spark, d))


@query(f"WITH {sql.TRADE}, {sql.PAIRS} SELECT a.u, a.v, b.v AS w FROM pairs a JOIN pairs b ON a.v = b.u JOIN pairs c ON c.u = a.u AND c.v = b.v")
def triangle_list(spark, d):
    return analytics.triangles(trade_pairs(spark, d))


@query(f"WITH {sql.TRADE}, {sql.PAIRS}, s AS (SELECT sum(d) AS t FROM deg) SELECT round(-sum(d / t::DOUBLE * log2(d / t::DOUBLE)), 4) AS entropy FROM deg, s")
def degree_entropy(spark, d):
    return analytics.degree_entropy(trade(spark, d)[1])


@query(
    f"WITH {sql.TRADE}, {sql.PAIRS}, c AS (SELECT n_nationkey AS id, n_regionkey AS c FROM nation), m AS (SELECT count(*)::DOUBLE AS m FROM pairs), "
    "e AS (SELECT x.c AS c, count(*) AS e FROM pairs JOIN c x ON x.id = u JOIN c y ON y.id = v WHERE x.c = y.c GROUP BY 1), a AS (SELECT c, sum(d) AS a FROM deg JOIN c USING (id) GROUP BY 1) "
    "SELECT round(sum(coalesce(e.e, 0) / m - power(a.a / (2 * m), 2)), 6) AS q FROM a LEFT JOIN e USING (c), m"
)
def modularity_regions(spark, d):
    nodes, _ = trade(spark, d)
    return analytics.modularity(trade_pairs(spark, d), nodes.select("id", F.col("region").alias("community")))


@query(
    f"WITH RECURSIVE {G}, l AS (SELECT DISTINCT source_id AS a, target_id AS b FROM edges WHERE source_id <> target_id AND NOT (source_id LIKE 'n:%' AND target_id LIKE 'c:%')), "
    "extra AS (SELECT * FROM l UNION SELECT 'c:' || c_custkey, 'r:' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey), "
    "reach AS (SELECT a, b FROM extra UNION SELECT r.a, e.b FROM reach r JOIN extra e ON r.b = e.a) "
    "SELECT count(*) AS edges, count_if(EXISTS (SELECT 1 FROM extra w JOIN reach q ON w.b = q.a AND q.b = x.b WHERE w.a = x.a)) AS redundant FROM extra x"
)
def transitive_reduction(spark, d):
    _, edges = supply(spark, d)
    tree = edges.filter(~(F.col("source_id").startswith("n:") & F.col("target_id").startswith("c:"))).select("source_id", "target_id")
    c = views.table(spark, d, "customer").join(F.broadcast(views.table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    short = c.select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("source_id"), F.concat(F.lit("r:"), F.col("n_regionkey").cast("string")).alias("target_id"))
    found = traverse.transitive_reduction(tree.union(short).distinct())
    return found.agg(F.count(F.lit(1)).alias("edges"), F.sum(F.col("redundant").cast("long")).alias("redundant"))


_LAYERS = """WITH l AS (SELECT * FROM lineitem), op AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM l), os AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM l),
ps AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM l WHERE l_returnflag = 'R'), g AS (SELECT DISTINCT o_orderkey AS o, n_regionkey AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
sr AS (SELECT s_suppkey AS s, n_regionkey AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey), ways AS (SELECT o, s FROM os UNION SELECT o, s FROM op JOIN ps USING (p))
SELECT 'o:' || o AS source_id, 's:' || s AS target_id FROM os WHERE EXISTS (SELECT 1 FROM op JOIN ps ON op.p = ps.p WHERE op.o = os.o AND ps.s = os.s)
UNION ALL SELECT 'o:' || o, 'r:' || r FROM g WHERE EXISTS (SELECT 1 FROM ways w JOIN sr USING (s) WHERE w.o = g.o AND sr.r = g.r)"""


@query(_LAYERS)
def redundant_line_edges(spark, d):
    return traverse.redundant_edges(views.order_layers(spark, d))


_RINGS = "r AS (SELECT b, any_value(6 + b % 7) AS n, list(k ORDER BY k) AS c FROM (SELECT c_custkey AS k, c_custkey // 12 AS b FROM customer) WHERE k % 12 < 6 + b % 7 GROUP BY b HAVING count(*) = any_value(6 + b % 7))"


@query(f"WITH {_RINGS} SELECT array_to_string(c, '>') AS cycle, n::INT AS length FROM r ORDER BY n, c LIMIT 15")
def cycles_any_length(spark, d):
    return joined(traverse.simple_cycles(views.customer_rings(spark, d)), "cycle")


@query(f"WITH {_RINGS}, f AS (SELECT c FROM r ORDER BY n, c LIMIT 15) SELECT array_to_string(c, '>') AS cycle, c[-1]::VARCHAR AS cut_source, c[1]::VARCHAR AS cut_target, 'DEPENDENCY_INVERSION' AS strategy FROM f")
def decoupled_rings(spark, d):
    cycles = traverse.simple_cycles(views.customer_rings(spark, d))
    return joined(governance.decoupling(cycles.select(F.col("cycle").cast("array<string>").alias("cycle"))), "cycle")


@query(
    f"WITH {_RINGS}, k AS (SELECT least(15, count(*)) AS cycles FROM r), z AS (SELECT unnest(c) AS id FROM r UNION SELECT (c_custkey) FROM customer WHERE c_custkey % 12 < 6 + (c_custkey // 12) % 7), "
    "u AS (SELECT count(*) AS n, count_if(c_custkey NOT IN (SELECT id FROM z)) AS isolated FROM customer), "
    "s AS (SELECT greatest(0, 100 - least(15, isolated * 2) - least(35, cycles * 10) - CASE WHEN n <= 5 THEN 0 ELSE 30 END)::INT AS score, isolated, cycles, n FROM u, k) "
    "SELECT score, CASE WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade, isolated, cycles, n AS code_units, 0::DOUBLE AS verified_ratio FROM s"
)
def scorecard_of_rings(spark, d):
    nodes = views.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("function").alias("node_type"), F.lit("core/x.py").alias("path"))
    edges = views.customer_rings(spark, d).withColumn("edge_type", F.lit("imports"))
    return governance.scorecard(nodes, edges, traverse.simple_cycles(edges))


@query(f"WITH {sql.LINES}, {sql.rank_chain(10, nodes=sql.LINE_NODES)} SELECT id, round(score, 8) AS score FROM r10")
def pagerank_lines(spark, d):
    found = rank.pagerank(views.line_nodes(spark, d), views.line_edges(spark, d), 10, tolerance=None, driver_edges=0)
    return found.select("id", F.round("score", 8).alias("score"))


@query(f"WITH {sql.LINES}, {sql.power_chain(8, sql.LINE_NODES)} SELECT round(sqrt(sum(y * y)), 3) AS radius FROM q7")
def spectral_radius_lines(spark, d):
    return rank.spectral_radius(views.line_nodes(spark, d), views.line_edges(spark, d), 8, None, driver_edges=0).select(F.round("radius", 3).alias("radius"))


_S1 = "'s:1'"


@query(f"WITH {sql.LINES}, {sql.resolvent_chain(6, 0.001, _S1, sql.LINE_NODES)} SELECT id, round(x, 6) AS impact FROM x6 WHERE id <> 's:1' AND x > 1e-4")
def resolvent_lines(spark, d):
    return rank.resolvent(views.line_nodes(spark, d), views.line_edges(spark, d), "s:1", 0.001, 6, None, driver_edges=0)


@query(f"WITH RECURSIVE {sql.TRADE}, r AS (SELECT src AS start, tgt AS id FROM trade WHERE src IN (0, 7) AND src <> tgt UNION SELECT r.start, tgt FROM r JOIN trade ON r.id = src WHERE src <> tgt) SELECT start, count(*) AS n FROM r WHERE start <> id GROUP BY 1")
def descendants(spark, d):
    nodes, edges = trade(spark, d)
    return traverse.descendants(edges, nodes.filter("id IN (0, 7)").select("id")).groupBy("start").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH s AS (SELECT l.toxic AS x, l.quality AS y, d.lang AS z FROM labels l JOIN documents d USING (doc_id)),
g AS (SELECT z, count(*) AS n, count_if(x = 0) AS n0, count_if(x = 1) AS n1, count_if(x = 0 AND y = 1) AS y0, count_if(x = 1 AND y = 1) AS y1 FROM s GROUP BY 1),
t AS (SELECT sum(n)::BIGINT AS n, sum(n * (CASE WHEN n1 > 0 THEN y1 / n1 ELSE 0 END - CASE WHEN n0 > 0 THEN y0 / n0 ELSE 0 END)) / sum(n) AS ace, sum(y1) / sum(n1) - sum(y0) / sum(n0) AS naive FROM g)
SELECT n, round(ace, 4) AS average_causal_effect, round(naive, 4) AS naive_difference, abs(ace - naive) > 0.05 AS confounded FROM t"""
)
def ace_backdoor(spark, d):
    rows = views.table(spark, d, "labels").join(views.table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return analytics.causal_effect(rows, "toxic", "quality", ["lang"])


@query(None)
def greedy_communities(spark, d):
    return analytics.greedy_communities(*trade(spark, d))


_FIEDLER = f"""WITH RECURSIVE {sql.TRADE}, p AS (SELECT least(src, tgt) AS u, greatest(src, tgt) AS v, count(*) AS w FROM trade WHERE src <> tgt GROUP BY 1, 2),
z AS (SELECT u AS a, v AS b, w FROM p UNION ALL SELECT v, u, w FROM p), d AS (SELECT a AS id, sum(w)::DOUBLE AS d FROM z GROUP BY 1),
m AS MATERIALIZED (SELECT list(r ORDER BY i) AS m FROM (SELECT x.id AS i, list(CASE WHEN x.id = y.id THEN 1.0 ELSE 0.0 END::DOUBLE + coalesce(z.w, 0) / sqrt(x.d * y.d) ORDER BY y.id) AS r FROM d x CROSS JOIN d y LEFT JOIN z ON z.a = x.id AND z.b = y.id GROUP BY x.id)),
t AS MATERIALIZED (SELECT list(sqrt(d) / (SELECT sqrt(sum(d)) FROM d) ORDER BY id) AS t, list((CASE WHEN id % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE ORDER BY id) AS x, list(id ORDER BY id) AS ids FROM d),
s AS (SELECT 0 AS k, x FROM t UNION ALL SELECT k + 1, list_transform(y, lambda e: e / sqrt(list_dot_product(y, y))) FROM (SELECT k, list_transform(g, lambda e, i: e - c * t[i]) AS y FROM (
  SELECT k, t, g, list_dot_product(g, t) AS c FROM (SELECT k, t.t, list_transform(m, lambda r: list_dot_product(r, s.x)) AS g FROM s, m, t WHERE k < 3000)))),
f AS (SELECT x, 2 - list_dot_product(x, list_transform(m, lambda r: list_dot_product(r, x))) AS lam FROM s, m WHERE k = 3000),
q AS (SELECT unnest(t.ids) AS id, unnest(f.x) AS x FROM f, t), o AS (SELECT id, d, row_number() OVER (ORDER BY x / sqrt(d), id) AS k, sum(d) OVER (ORDER BY x / sqrt(d), id ROWS UNBOUNDED PRECEDING) AS vol FROM q JOIN d USING (id)),
c AS (SELECT o.k, round((SELECT sum(w) FROM p JOIN o a ON a.id = u JOIN o b ON b.id = v WHERE least(a.k, b.k) <= o.k AND greatest(a.k, b.k) > o.k) / least(vol, (SELECT sum(d) FROM d) - vol), 12) AS c FROM o WHERE k < (SELECT count(*) FROM o)),
best AS (SELECT c, k FROM c ORDER BY c, k LIMIT 1), l AS (SELECT list_sort(list(id) FILTER (o.k <= best.k)) AS a, list_sort(list(id) FILTER (o.k > best.k)) AS b FROM o, best)
SELECT round(lam, 5) AS lambda2, round(c, 6) AS conductance, lam > 1e-5 AS connected, array_to_string(CASE WHEN len(a) < len(b) OR len(a) = len(b) AND a < b THEN a ELSE b END, '>') AS side FROM f, best, l"""


@query(_FIEDLER)
def fiedler_cut(spark, d):
    """The cut by joins and running sums, as on a graph of any size, of the
    nations that trade: those without a link are on no side of it."""
    nodes, edges = trade(spark, d)
    linked = edges.filter("source_id <> target_id").select(F.explode(F.array("source_id", "target_id")).alias("id"))
    found = analytics.fiedler_cut(nodes.join(linked, "id", "left_semi"), edges, driver_edges=0)
    return joined(found.select(F.round("lambda2", 5).alias("lambda2"), "conductance", "connected", "side"), "side")


@query(f"WITH {_RINGS} SELECT coalesce(sum(n), 0)::BIGINT AS edges, coalesce(sum(n), 0)::BIGINT AS nodes, TRUE AS all_named, TRUE AS within, TRUE AS gains FROM r")
def communities_of_rings(spark, d):
    """Communities of rings of customers by joins: every node has one, named by
    its smallest member and within one ring, and they gain over single nodes."""
    edges = views.customer_rings(spark, d)
    c = views.table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    # neither customers nor their rings are broadcast: they would go through the driver
    edges = views.closed(c.hint("merge"), edges)
    whole = edges.groupBy(F.expr("source_id div 12").alias("block")).agg(F.count(F.lit(1)).alias("n")).filter("n = 6 + block % 7").select("block")
    edges = cut(edges.withColumn("block", F.expr("source_id div 12")).join(whole.hint("merge"), "block", "left_semi").select("source_id", "target_id"), "rings")
    found = cut(analytics.greedy_communities(edges.select(F.col("source_id").alias("id")), edges, driver_edges=0), "communities")
    pairs = views.simple_undirected(edges)
    block = F.expr("id div 12")
    per = found.groupBy("community").agg(F.min("id").alias("least"), F.min(block).alias("a"), F.max(block).alias("b"))
    named = per.agg(F.bool_and(F.col("community") == F.col("least")).alias("all_named"), F.bool_and(F.col("a") == F.col("b")).alias("within"))
    gains = analytics.modularity(pairs, found).select((F.col("q") > 0).alias("gains"))
    counts = pairs.agg(F.count(F.lit(1)).alias("edges")).crossJoin(found.agg(F.count_distinct("id").alias("nodes")))
    return counts.crossJoin(named).crossJoin(gains)


@query("WITH e AS (SELECT DISTINCT 's:' || l_suppkey AS a, 'p:' || l_partkey AS b FROM lineitem UNION SELECT DISTINCT 'p:' || l_partkey, 's:' || l_suppkey FROM lineitem WHERE l_returnflag = 'R') SELECT count(*) AS arcs, 0::BIGINT AS on_cycles, TRUE AS few FROM e")
def arcs_without_feedback(spark, d):
    """Line item arcs without their feedback arcs, which joins found: no node
    is on a cycle any more, and at most half of the arcs went."""
    arcs = analytics.peeled_arcs(views.line_edges(spark, d))
    kept = arcs.filter("NOT back").select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    left = traverse.levels(kept)[1].agg(F.count(F.lit(1)).alias("on_cycles"))
    counts = arcs.agg(F.count(F.lit(1)).alias("arcs"), F.count_if("back").alias("n"))
    return counts.crossJoin(left).select("arcs", "on_cycles", (F.col("n") * 2 <= F.col("arcs")).alias("few"))


@query(None)
def feedback_arc_set(spark, d):
    return analytics.feedback_arcs(trade(spark, d)[1])


@query(
    f"WITH RECURSIVE {sql.TRADE}, {sql.PAIRS}, r AS (SELECT n_nationkey AS a, n_nationkey AS b, 0 AS d FROM nation UNION SELECT r.a, x.b, r.d + 1 FROM r JOIN both_ways x ON x.a = r.b WHERE r.d < 25), "
    "t AS (SELECT a, b, min(d) AS d FROM r GROUP BY 1, 2), f AS (SELECT n_nationkey AS i FROM nation ORDER BY 1 LIMIT 50), "
    "q AS (SELECT a.i AS a, b.i AS b, c.i AS c, e.i AS e FROM f a JOIN f b ON b.i > a.i JOIN f c ON c.i > b.i JOIN f e ON e.i > c.i ORDER BY 1, 2, 3, 4 LIMIT 200), "
    "s AS (SELECT list_sort([x.d + y.d, u.d + v.d, w.d + z.d]) AS s FROM q JOIN t x ON x.a = q.a AND x.b = q.b JOIN t y ON y.a = q.c AND y.b = q.e JOIN t u ON u.a = q.a AND u.b = q.c JOIN t v ON v.a = q.b AND v.b = q.e JOIN t w ON w.a = q.a AND w.b = q.e JOIN t z ON z.a = q.b AND z.b = q.c) "
    "SELECT coalesce(max((s[3] - s[2]) / 2), 0)::DOUBLE AS delta, coalesce(max((s[3] - s[2]) / 2), 0) <= 1.5 AS tree_like, count(*)::INT AS quadruples FROM s"
)
def gromov_delta(spark, d):
    return analytics.gromov_delta(*trade(spark, d))


@query(
    f"WITH {sql.TRADE}, l AS (SELECT DISTINCT src, tgt FROM trade WHERE src <> tgt), both_ways AS (SELECT src AS a, tgt AS b FROM l UNION SELECT tgt, src FROM l), "
    "p2 AS (SELECT [7, src] AS p FROM l WHERE tgt = 7), p3 AS (SELECT list_append(p, b) AS p FROM p2 JOIN both_ways ON p[-1] = a WHERE p[-1] <> 3 AND NOT list_contains(p, b)), "
    "p4 AS (SELECT list_append(p, b) AS p FROM p3 JOIN both_ways ON p[-1] = a WHERE p[-1] <> 3 AND NOT list_contains(p, b)), u AS (SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4) "
    "SELECT array_to_string(p, '>') AS path FROM u WHERE p[-1] = 3 ORDER BY len(p), p LIMIT 100"
)
def backdoor_paths(spark, d):
    return joined(analytics.backdoor_paths(trade(spark, d)[1], 7, 3), "path")


# --- governance over the supply graph ------------------------------------


@query(
    f"WITH {G}, t AS (SELECT id, {sql.TIER} AS tier FROM nodes) SELECT source_id, target_id, edge_type, a.tier AS source_tier, b.tier AS target_tier FROM edges JOIN t a ON a.id = source_id JOIN t b ON b.id = target_id "
    "WHERE edge_type IN ('imports', 'calls') AND a.tier > b.tier"
)
def layer_violations(spark, d):
    return governance.layer_violations(*supply(spark, d))


@query(f"WITH {G}, t AS (SELECT id, {sql.DOMAIN} AS domain FROM nodes) SELECT a.domain AS source_domain, b.domain AS target_domain, count(*) AS edges FROM edges JOIN t a ON a.id = source_id JOIN t b ON b.id = target_id WHERE a.domain <> b.domain GROUP BY 1, 2")
def conduits(spark, d):
    return governance.conduits(*supply(spark, d))


@query(
    f"WITH {G}, m AS (SELECT id, split_part(path, '/', 1) AS c, node_type, name FROM nodes), e AS (SELECT a.c AS s, b.c AS t FROM edges JOIN m a ON a.id = source_id JOIN m b ON b.id = target_id WHERE a.c <> b.c), "
    "k AS (SELECT c AS community, (SELECT count(*) FROM e WHERE t = m.c) AS ca, (SELECT count(*) FROM e WHERE s = m.c) AS ce, count_if(node_type = 'class') AS n, count_if(node_type = 'class' AND regexp_matches(lower(name), 'base|abstract|protocol|interface')) AS a FROM m GROUP BY c), "
    "j AS (SELECT community, ca, ce, CASE WHEN ca + ce > 0 THEN round(ce / (ca + ce), 4) ELSE 0 END AS instability, CASE WHEN n > 0 THEN round(a / n, 4) ELSE 0 END AS abstractness FROM k) SELECT *, round(abs(abstractness + instability - 1), 4) AS distance FROM j"
)
def martin_metrics(spark, d):
    nodes, edges = supply(spark, d)
    return governance.martin_metrics(nodes, edges, nodes.select("id", F.element_at(F.split("path", "/"), 1).alias("community")))


_SCORE = f"""WITH {G}, linked AS (SELECT source_id AS id FROM edges UNION SELECT target_id FROM edges),
i AS (SELECT count(*) AS isolated FROM nodes WHERE node_type IN ('function', 'class', 'service', 'endpoint', 'module') AND id NOT IN (SELECT id FROM linked)),
c AS (SELECT count(*) AS cycles FROM (SELECT 1 FROM (SELECT DISTINCT source_id, target_id FROM edges) a JOIN (SELECT DISTINCT source_id, target_id FROM edges) b ON a.source_id = b.target_id AND a.target_id = b.source_id WHERE a.source_id < a.target_id LIMIT 15)),
u AS (SELECT count(*) AS code_units, count_if(id IN (SELECT target_id FROM edges WHERE edge_type = 'verifies')) AS tested FROM nodes WHERE node_type IN ('function', 'class')),
r AS (SELECT *, CASE WHEN code_units > 0 THEN round(tested / code_units, 2) ELSE 1 END AS verified_ratio FROM i, c, u),
s AS (SELECT *, greatest(0, 100 - least(15, isolated * 2) - least(35, cycles * 10) - CASE WHEN code_units <= 5 OR verified_ratio >= 0.8 THEN 0 WHEN verified_ratio >= 0.6 THEN 5 WHEN verified_ratio >= 0.4 THEN 12 WHEN verified_ratio >= 0.2 THEN 20 ELSE 30 END)::INT AS score FROM r)
SELECT score, CASE WHEN score >= 95 THEN 'A+' WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade, isolated, cycles, code_units, verified_ratio FROM s"""


@query(_SCORE)
def scorecard(spark, d):
    nodes, edges = supply(spark, d)
    return governance.scorecard(nodes, edges, traverse.simple_cycles(views.dependency(edges)))


@query(
    f"WITH {G}, used AS (SELECT target_id AS id FROM edges WHERE edge_type IN ('calls', 'imports', 'verifies', 'routes_to') AND source_id <> target_id) "
    "SELECT id, name, path, CASE WHEN node_type = 'function' AND NOT regexp_matches(substr(name, 1, 1), '[A-Z]') THEN 'medium' ELSE 'low' END AS confidence, coalesce(end_line - start_line + 1, 1) AS lines, node_type = 'function' AND NOT regexp_matches(substr(name, 1, 1), '[A-Z]') AS safe "
    "FROM nodes WHERE node_type IN ('function', 'class') AND id NOT IN (SELECT id FROM used) AND NOT contains(path, 'cli/') AND NOT contains(path, 'tests/')"
)
def dead_code(spark, d):
    return governance.dead_code(*supply(spark, d))


@query(
    f"WITH {G}, used AS (SELECT target_id AS id FROM edges WHERE edge_type IN ('calls', 'imports', 'verifies', 'routes_to') AND source_id <> target_id) SELECT 'low' AS confidence, count(*) AS n, count(*)::BIGINT AS lines "
    "FROM nodes WHERE node_type IN ('function', 'class') AND id NOT IN (SELECT id FROM used) AND NOT contains(path, 'cli/')"
)
def dead_code_report(spark, d):
    return governance.dead_code(*supply(spark, d)).groupBy("confidence").agg(F.count(F.lit(1)).alias("n"), F.sum("lines").alias("lines"))


@query(f"WITH {G} SELECT sha256(sha256('pepper:' || source_id) || ':' || sha256('pepper:' || target_id) || ':' || edge_type) AS leaf FROM (SELECT DISTINCT source_id, target_id, edge_type FROM edges)")
def merkle_leaf_hashes(spark, d):
    return governance.leaf_hashes(supply(spark, d)[1], "pepper")


def _merkle_chain(levels: int) -> str:
    """Levels l0, l1, ... of the tree; a root stays as it is."""
    return ", ".join(f"l{i + 1} AS MATERIALIZED (SELECT i // 2 AS i, CASE WHEN (SELECT count(*) FROM l{i}) = 1 THEN min(leaf) ELSE sha256(min_by(leaf, i) || ':' || max_by(leaf, i)) END AS leaf FROM l{i} GROUP BY 1)" for i in range(levels))


@query(
    f"WITH {G}, l AS (SELECT sha256(sha256('pepper:' || source_id) || ':' || sha256('pepper:' || target_id) || ':' || edge_type) AS leaf FROM (SELECT DISTINCT source_id, target_id, edge_type FROM edges)), "
    f"l0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY leaf) - 1 AS i, leaf FROM l), {_merkle_chain(24)} SELECT leaf AS root FROM l24"
)
def merkle_root(spark, d):
    root = governance.merkle_root(governance.leaf_hashes(supply(spark, d)[1], "pepper"))
    return spark.createDataFrame([(root,)], "root string")


@query(
    f"WITH {sql.TRADE}, p AS (SELECT DISTINCT a.src AS a, a.tgt AS b, x.n_name || ' ' || y.n_name AS t FROM trade a JOIN trade b ON a.src = b.tgt AND a.tgt = b.src JOIN nation x ON x.n_nationkey = a.src JOIN nation y ON y.n_nationkey = a.tgt WHERE a.src < a.tgt) "
    "SELECT x.n_name || '>' || y.n_name AS cycle, y.n_name AS cut_source, x.n_name AS cut_target, CASE WHEN regexp_matches(lower(t), 'model|entity|schema') THEN 'SHARED_KERNEL' WHEN regexp_matches(lower(t), 'listener|event|notify') THEN 'EVENT_DRIVEN' ELSE 'DEPENDENCY_INVERSION' END AS strategy "
    "FROM p JOIN nation x ON x.n_nationkey = a JOIN nation y ON y.n_nationkey = b"
)
def decoupling(spark, d):
    nodes, edges = trade(spark, d)
    n = lambda k: nodes.select(F.col("id").alias(k), F.col("name").alias(f"n{k}"))
    pairs = traverse.bidirectional_pairs(edges).join(n("a"), "a").join(n("b"), "b")
    return joined(governance.decoupling(pairs.select(F.array("na", "nb").alias("cycle"))), "cycle")


@query(
    "WITH drawn AS (SELECT page_id AS id, regexp_extract(url, '://([^/?#]*)', 1) AS name FROM pages), k AS (SELECT DISTINCT regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS k FROM (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS name FROM pages WHERE page_id % 2 = 0)) "
    "SELECT id, name FROM drawn WHERE regexp_replace(lower(name), '[^a-z0-9]', '', 'g') NOT IN (SELECT k FROM k)"
)
def ghost_antijoin(spark, d):
    drawn = views.table(spark, d, "pages").select(F.col("page_id").alias("id"), F.regexp_extract("url", "://([^/?#]*)", 1).alias("name"))
    return governance.ghosts(drawn, drawn.filter("id % 2 = 0"), normalise_name)
