"""Routes, injection, events and services as the graph knows them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def routes(nodes: DataFrame, edges: DataFrame, method: str | None = None) -> DataFrame:
    """endpoint, name, handler, injected: the first handler of each endpoint by
    id, and what it injects in order."""
    points = nodes.filter("node_type = 'endpoint'")
    if method:
        points = points.filter(F.col("id").startswith(f"endpoint:{method.upper()}:"))
    handlers = edges.filter("edge_type = 'routes_to'").groupBy(F.col("source_id").alias("id")).agg(F.min("target_id").alias("handler"))
    injected = edges.filter("edge_type = 'injects'").groupBy(F.col("source_id").alias("handler")).agg(F.sort_array(F.collect_set("target_id")).alias("injected"))
    return points.select("id", "name").join(handlers, "id", "left").join(injected, "handler", "left").select(F.col("id").alias("endpoint"), "name", "handler", F.coalesce("injected", F.array().cast("array<string>")).alias("injected"))


def injection(nodes: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """id, direction, other for the injections in and out of the given symbols
    (id, name); a target may be the node or 'symbol:<name>'.  Two equi-joins,
    as one with OR would compare all with all."""
    e = edges.filter("edge_type = 'injects'").select("source_id", "target_id")
    by_id = e.join(symbols, F.col("target_id") == F.col("id")).select("id", F.lit("in").alias("direction"), F.col("source_id").alias("other"))
    by_name = e.join(symbols.withColumn("k", F.concat(F.lit("symbol:"), "name")), F.col("target_id") == F.col("k")).select("id", F.lit("in"), "source_id")
    out = e.join(symbols, F.col("source_id") == F.col("id")).select("id", F.lit("out"), "target_id")
    return by_id.union(by_name).union(out).distinct()


def topics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, name, publishers, subscribers, state of each topic."""
    count = lambda kind, name: edges.filter(F.col("edge_type") == kind).groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias(name))
    j = nodes.filter("node_type = 'topic'").select("id", "name").join(count("publishes", "publishers"), "id", "left").join(count("subscribes", "subscribers"), "id", "left")
    p, s = F.coalesce("publishers", F.lit(0)), F.coalesce("subscribers", F.lit(0))
    state = F.when((p == 0) & (s == 0), "isolated").when(p == 0, "no_publishers").when(s == 0, "no_subscribers").otherwise("connected")
    return j.select("id", "name", p.alias("publishers"), s.alias("subscribers"), state.alias("state"))


def topic_members(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """topic, side, id: who publishes to and who subscribes to each topic, once."""
    known = nodes.filter("node_type = 'topic'").select(F.col("id").alias("topic"))
    e = edges.filter(F.col("edge_type").isin("publishes", "subscribes")).select(F.col("target_id").alias("topic"), F.col("edge_type").alias("side"), F.col("source_id").alias("id"))
    return e.join(known, "topic", "left_semi").distinct()


def match_routes(spans: DataFrame, endpoints: DataFrame) -> DataFrame:
    """span_id, endpoint: server spans and the first endpoint by id whose path
    fits; parameters count as equal, a method counts if both sides have one.

    spans: (span_id, http_method, http_route), endpoints: (id, method, path)."""
    wild = lambda c: F.regexp_replace(F.col(c), r"\{.*?\}|:\w+", "*")
    a = spans.filter("http_route IS NOT NULL").withColumn("k", wild("http_route"))
    b = endpoints.withColumn("k", wild("path"))
    fits = F.col("http_method").isNull() | F.col("method").isNull() | (F.upper("http_method") == F.upper("method"))
    return a.join(b, "k").filter(fits).groupBy("span_id").agg(F.min("id").alias("endpoint"))


def cross_repository(calls: DataFrame, routes_: DataFrame) -> DataFrame:
    """url, route: the longest known route that a client's URL ends with.

    A URL's own suffixes meet routes by equality, so the work grows with the
    URLs alone."""
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://[^/]+", ""), r"[?#].*$", "")
    parts = F.split(path, "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, i, F.size(parts)), "/")))
    met = calls.select("url").distinct().withColumn("route", F.explode(F.array_distinct(tails))).join(routes_.select("route").distinct(), "route")
    return met.groupBy("url").agg(F.max_by("route", F.struct(F.length("route"), "route")).alias("route"))


def rpc_links(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """source_id, target_id: code (id, text) that calls a remote method (id,
    method) as .method(, each pair once; of several of one name the first by id."""
    found = calls.select(F.col("id").alias("source_id"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\.(\w+)\("), F.lit(1)))).alias("method"))
    known = methods.groupBy("method").agg(F.min("id").alias("target_id"))
    return found.join(known, "method").select("source_id", "target_id").distinct()
