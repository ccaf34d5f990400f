"""The derived inputs of ``graphloom.views`` as SQL, for the oracles."""

from __future__ import annotations

NODES = """nodes AS (
  SELECT 'r:' || r_regionkey AS id, r_name AS name, 'service' AS node_type, 'core/' || lower(r_name) AS path, NULL::INT AS start_line, NULL::INT AS end_line, NULL::VARCHAR AS docstring FROM region
  UNION ALL SELECT 'n:' || n_nationkey, n_name, 'module', 'graph/nation_' || n_nationkey || '.py', NULL, NULL, NULL FROM nation
  UNION ALL SELECT 's:' || s_suppkey, s_name, 'class', 'parser/nation_' || s_nationkey || '.py', NULL, NULL, NULL FROM supplier
  UNION ALL SELECT 'c:' || c_custkey, c_name, 'function', 'cli/nation_' || c_nationkey || '.py', (c_custkey % 1000 * 10 + 1)::INT, (c_custkey % 1000 * 10 + 4 + c_custkey % 7)::INT, c_mktsegment FROM customer
  UNION ALL SELECT 'o:' || o_orderkey, 'order ' || o_orderkey, 'endpoint', 'tests/priority_' || substr(o_orderpriority, 1, 1) || '.py', NULL, NULL, NULL FROM orders)"""

EDGES = """edges AS (
  SELECT 'n:' || n_nationkey AS source_id, 'r:' || n_regionkey AS target_id, 'imports' AS edge_type FROM nation
  UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'inherits' FROM supplier
  UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'calls' FROM customer
  UNION ALL SELECT 'o:' || o_orderkey, 'c:' || o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'verifies' ELSE 'routes_to' END FROM orders
  UNION ALL SELECT 'n:' || c_nationkey, 'c:' || c_custkey, 'calls' FROM (
    SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey DESC) AS r FROM customer) WHERE r = 1)"""

TRADE = """trade AS (
  SELECT src, tgt, weight FROM (
    SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, tgt) AS r FROM (
      SELECT s_nationkey AS src, c_nationkey AS tgt, count(*) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)) WHERE r <= 4)"""

PAIRS = """pairs AS (SELECT DISTINCT least(src, tgt) AS u, greatest(src, tgt) AS v FROM trade WHERE src <> tgt),
both_ways AS (SELECT u AS a, v AS b FROM pairs UNION ALL SELECT v, u FROM pairs),
deg AS (SELECT a AS id, count(*) AS d FROM both_ways GROUP BY 1)"""

SPANS = """spans AS (
  SELECT user_id::VARCHAR AS trace_id, event_id AS span_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent_span_id,
    event_type AS service_name, 'op_' || (event_id % 13) AS name, value AS duration_ms, event_type = 'error' AS is_error, ts FROM events)"""

TIER = """CASE split_part(path, '/', 1) WHEN 'cli' THEN 1 WHEN 'parser' THEN 2 WHEN 'graph' THEN 2 WHEN 'core' THEN 3 END"""

DOMAIN = """CASE WHEN node_type = 'service' THEN 'Distributed Services & Runtimes' WHEN contains(path, 'test') THEN 'Verification & Quality'
  WHEN starts_with(path, 'cli/') THEN 'CLI Layer' WHEN starts_with(path, 'parser/') THEN 'AST Parser Subsystem' WHEN starts_with(path, 'graph/') THEN 'Knowledge Graph & Storage' ELSE 'Core Engine' END"""

LINKS = """links AS (
  SELECT p.service_name AS source, c.service_name AS target, c.duration_ms, c.is_error, c.name FROM spans c JOIN spans p ON c.parent_span_id = p.span_id WHERE p.service_name <> c.service_name)"""


NATIONS = "SELECT n_nationkey AS id FROM nation"

#: The graph of views.line_edges as trade(src, tgt, weight), and its nodes.
LINES = """trade AS MATERIALIZED (SELECT src, tgt, 1 AS weight FROM (SELECT 's:' || l_suppkey AS src, 'p:' || l_partkey AS tgt FROM lineitem
  UNION ALL SELECT 'p:' || l_partkey, 's:' || l_suppkey FROM lineitem WHERE l_returnflag = 'R'))"""
LINE_NODES = "SELECT 's:' || s_suppkey AS id FROM supplier UNION ALL SELECT 'p:' || p_partkey FROM part"


def rank_chain(rounds: int, damping: float = 0.85, nodes: str = NATIONS) -> str:
    """PageRank over the trade graph as a chain of CTEs r0, r1, ..."""
    parts = [f"ids AS ({nodes})", "n AS (SELECT count(*) AS n FROM ids)", "od AS (SELECT src, count(*) AS d FROM trade GROUP BY 1)", "r0 AS (SELECT id, 1.0::DOUBLE / n AS score FROM ids, n)"]
    for i in range(rounds):
        parts.append(
            f"r{i + 1} AS MATERIALIZED (SELECT ids.id, {1 - damping}::DOUBLE / n + {damping}::DOUBLE * (coalesce(f.flow, 0) + m.mass / n) AS score FROM ids CROSS JOIN n "
            f"LEFT JOIN (SELECT tgt AS id, sum(score / d) AS flow FROM trade JOIN od USING (src) JOIN r{i} ON r{i}.id = src GROUP BY 1) f ON f.id = ids.id "
            f"CROSS JOIN (SELECT coalesce(sum(score), 0) AS mass FROM r{i} WHERE id NOT IN (SELECT src FROM od)) m)"
        )
    return ", ".join(parts)


def power_chain(rounds: int, nodes: str = NATIONS) -> str:
    """Norms of the power iteration on the transposed trade matrix."""
    parts = [f"p0 AS (SELECT id, 1.0 / sqrt((SELECT count(*) FROM ({nodes}))) AS x FROM ({nodes}))"]
    for i in range(rounds):
        parts.append(f"q{i} AS MATERIALIZED (SELECT tgt AS id, sum(weight * x) AS y FROM trade JOIN p{i} ON src = id GROUP BY 1)")
        parts.append(f"p{i + 1} AS MATERIALIZED (SELECT id, y / (SELECT sqrt(sum(y * y)) FROM q{i}) AS x FROM q{i})")
    return ", ".join(parts)


def resolvent_chain(rounds: int, alpha: float, target: str, nodes: str = NATIONS) -> str:
    parts = [f"e AS (SELECT id, CASE WHEN id = {target} THEN 1.0 ELSE 0.0 END::DOUBLE AS e FROM ({nodes}))", "x0 AS (SELECT id, e AS x FROM e)"]
    for i in range(rounds):
        parts.append(f"x{i + 1} AS MATERIALIZED (SELECT e.id, e.e + {alpha}::DOUBLE * coalesce(f.f, 0) AS x FROM e LEFT JOIN (SELECT src AS id, sum(weight * x) AS f FROM trade JOIN x{i} ON tgt = id GROUP BY 1) f ON f.id = e.id)")
    return ", ".join(parts)
