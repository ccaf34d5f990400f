"""Spans, topology, heat, traffic risk and regression verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .order import percentiles


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with the columns of right of the same keys, null ones among them."""
    right = right.select(*(F.col(k).alias(f"__{k}") for k in keys), *(c for c in right.columns if c not in keys))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(right, on).drop(*(f"__{k}" for k in keys))


def link_stats(links: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: calls, total, average and interpolated percentiles of the
    duration, errors and their rate."""
    agg = links.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), F.sum("duration_ms").alias("total_ms"), F.sum(F.col("is_error").cast("long")).alias("errors"))
    agg = _same(agg, percentiles(links, keys, "duration_ms", {f"p{p}_ms": ("linear", p / 100) for p in (50, 95, 99)}), keys)
    return agg.select(*keys, "calls", F.round("total_ms", 2).alias("total_ms"), F.round(F.col("total_ms") / F.col("calls"), 4).alias("avg_ms"), *(F.round(n, 4).alias(n) for n in ("p50_ms", "p95_ms", "p99_ms")), "errors", F.round(F.col("errors") / F.col("calls"), 4).alias("error_rate"))


def _protocol(spans: DataFrame) -> list[str]:
    return ["protocol"] if "protocol" in spans.columns else []


def parent_links(spans: DataFrame) -> DataFrame:
    """source, target, duration_ms, is_error, name for child spans whose parent
    belongs to another service.  Of spans with one id the last in trace order counts."""
    parents = spans.groupBy("span_id").agg(F.max(F.struct("trace_id", "service_name")).alias("p")).select(F.col("span_id").alias("parent_span_id"), F.col("p.service_name").alias("source"))
    return spans.join(parents, "parent_span_id").filter("source <> service_name").select("source", F.col("service_name").alias("target"), "duration_ms", "is_error", "name", *_protocol(spans))


def peer_links(spans: DataFrame) -> DataFrame:
    """Links from client spans to the peer service they name."""
    return spans.filter("kind IN ('CLIENT', 'PRODUCER') AND peer_service IS NOT NULL AND peer_service <> service_name").select(F.col("service_name").alias("source"), F.col("peer_service").alias("target"), "duration_ms", "is_error", "name", *_protocol(spans))


def topology(spans: DataFrame) -> DataFrame:
    """Service links with statistics and the first ten operations in order; with
    what spans say of HTTP, RPC and databases also the protocols in order."""
    if {"http_method", "rpc_service", "db_system"} <= set(spans.columns):
        protocol = F.when(F.col("rpc_service").isNotNull(), "grpc").when(F.col("db_system").isNotNull(), F.col("db_system")).when(F.col("http_method").isNotNull(), "http")
        spans = spans.withColumn("protocol", protocol)
    links = parent_links(spans)
    if "peer_service" in spans.columns:
        links = links.unionByName(peer_links(spans))
    # statistics, percentiles and operations read the links, not the join of spans
    links = cut(links, "links")
    protocols = [F.sort_array(F.collect_set("protocol")).alias("protocols")] if "protocol" in links.columns else []
    operations = links.groupBy("source", "target").agg(F.slice(F.sort_array(F.collect_set("name")), 1, 10).alias("operations"), *protocols)
    return link_stats(links, ["source", "target"]).join(operations, ["source", "target"])


def by_target(spans: DataFrame, target: str = "service_name") -> DataFrame:
    """Telemetry rows per target; the 95th percentile by place."""
    rows = spans.select(F.col(target).alias("node_id"), "duration_ms", "is_error")
    agg = rows.groupBy("node_id").agg(F.count(F.lit(1)).alias("call_count"), F.sum("duration_ms").alias("total_duration_ms"), F.sum(F.col("is_error").cast("long")).alias("error_count"))
    agg = _same(agg, percentiles(rows, ["node_id"], "duration_ms", {"p95_duration_ms": ("index", 0.95)}), ["node_id"])
    agg = agg.withColumn("avg_duration_ms", F.col("total_duration_ms") / F.col("call_count")).withColumn("error_rate", F.col("error_count") / F.col("call_count"))
    return agg.select("node_id", "call_count", "total_duration_ms", "p95_duration_ms", "error_count", "avg_duration_ms", "error_rate")


def merge_telemetry(batches: DataFrame) -> DataFrame:
    """Telemetry rows of several batches as one row per node: counts and
    totals add up, the average and the error rate follow, p95 is the largest;
    last_seen and metadata_json, where there, are those of the latest batch.

    Order does not matter, so the same expression serves batch and stream."""
    last = [F.max("last_seen").alias("last_seen")] if "last_seen" in batches.columns else []
    last += [F.max_by("metadata_json", F.struct("last_seen", "metadata_json")).alias("metadata_json")] if last and "metadata_json" in batches.columns else []
    agg = batches.groupBy("node_id").agg(*last, F.sum("call_count").alias("call_count"), F.sum("total_duration_ms").alias("total_duration_ms"), F.max("p95_duration_ms").alias("p95_duration_ms"), F.sum("error_count").alias("error_count"))
    rate = lambda a: F.when(F.col("call_count") > 0, F.col(a) / F.col("call_count")).otherwise(0.0)
    return agg.withColumn("avg_duration_ms", rate("total_duration_ms")).withColumn("error_rate", rate("error_count"))


def heat(telemetry: DataFrame, top_k: int | None = 50) -> DataFrame:
    """node_id, heat (0 to 1) and level: half from calls, 0.3 from latency - both
    against the largest - and 0.2 from errors."""
    most = telemetry.agg(F.max("call_count").alias("mc"), F.max("avg_duration_ms").alias("ml"))
    part = lambda a, m: F.when(F.col(m) > 0, F.col(a) / F.col(m)).otherwise(0.0)
    rate = F.col("error_rate")
    h = F.round(0.5 * part("call_count", "mc") + 0.3 * part("avg_duration_ms", "ml") + 0.2 * F.least(F.lit(1.0), rate), 4)
    out = telemetry.crossJoin(F.broadcast(most)).withColumn("heat", h)
    level = F.when((F.col("heat") >= 0.75) | (rate >= 0.20), "CRITICAL").when(F.col("heat") >= 0.45, "HIGH").when(F.col("heat") >= 0.20, "MEDIUM").when(F.col("heat") > 0, "LOW").otherwise("COLD")
    out = out.select("node_id", "call_count", "heat", level.alias("level"))
    return out.orderBy(F.desc("heat"), "node_id").limit(top_k) if top_k else out


def traffic_risk(impacted: DataFrame, telemetry: DataFrame) -> DataFrame:
    """One row per target: calls, weighed traffic, active and dormant nodes, tier.

    Calls weigh 1 + 2 * error rate and fade with depth^1.5; the tier goes by
    traffic, or is the first for a node with 100 calls and an error rate of 0.15.
    """
    j = impacted.join(telemetry.select(F.col("node_id").alias("id"), "call_count", "error_rate"), "id", "left").withColumn("calls", F.coalesce("call_count", F.lit(0)).cast("long")).withColumn("rate", F.coalesce("error_rate", F.lit(0.0)))
    agg = j.groupBy("target").agg(F.sum("calls").alias("calls"), F.sum(F.col("calls") * (1 + 2 * F.col("rate")) / F.pow("depth", F.lit(1.5))).alias("traffic"), F.sum((F.col("calls") > 0).cast("long")).alias("active"), F.sum((F.col("calls") == 0).cast("long")).alias("dormant"), F.max(((F.col("rate") >= 0.15) & (F.col("calls") >= 100)).cast("int")).alias("hot"))
    tier = risk_tier_name(F.col("calls"), F.col("hot") == 1, "P2_MEDIUM")
    return agg.select("target", "calls", F.round("traffic", 2).alias("traffic"), "active", "dormant", tier.alias("tier"))


def risk_tier_name(calls: Column, hot: Column, medium: str) -> Column:
    """Tier of so many calls; a hot node makes it the first."""
    return F.when((calls >= 10000) | hot, "P0_CRITICAL").when(calls >= 1000, "P1_HIGH").when(calls >= 100, medium).when(calls > 0, "P3_LOW").otherwise("P4_DORMANT")


def regression(current: DataFrame, baseline: DataFrame, threshold: float = 10.0) -> DataFrame:
    """node_id, delta_pct, verdict of p95 against the baseline's; a missing or
    vanishing baseline passes."""
    j = current.select("node_id", F.col("p95_duration_ms").alias("now")).join(baseline.select("node_id", F.col("p95_duration_ms").alias("was")), "node_id", "left")
    delta = F.when(F.col("was") > 1e-4, F.round((F.col("now") - F.col("was")) / F.col("was") * 100, 2)).otherwise(0.0)
    j = j.withColumn("delta_pct", delta)
    d = F.col("delta_pct")
    return j.select("node_id", "delta_pct", F.when(F.col("was").isNull(), "PASSED").when(d > threshold, "REGRESSION").when(d > threshold / 2, "WARNING").when(d < -threshold, "IMPROVED").otherwise("PASSED").alias("verdict"))


def neighbourhood(links: DataFrame, service: str) -> DataFrame:
    """Links (source, target, ...) at a service, either way."""
    return links.filter((F.col("source") == service) | (F.col("target") == service))


def service_pairs(links: DataFrame) -> DataFrame:
    """(a, b) with a < b for services that call each other."""
    e = links.select("source", "target").distinct()
    back = e.select(F.col("source").alias("target"), F.col("target").alias("source"))
    return e.filter("source < target").join(back, ["source", "target"], "left_semi").select(F.col("source").alias("a"), F.col("target").alias("b"))


def bottlenecks(links: DataFrame) -> DataFrame:
    """Links that are slow or fail: p95 of 300 ms, average of 200 ms, or errors."""
    slow = (F.col("p95_ms") >= 300) | (F.col("avg_ms") >= 200)
    return links.filter(slow | (F.col("errors") > 0)).select("source", "target", slow.alias("slow"), ((F.col("error_rate") >= 0.05) | (F.col("errors") > 0)).alias("failing"), "p95_ms", "error_rate")


def timing_stats(timings: DataFrame, key: str = "target", value: str = "ms") -> DataFrame:
    """Micro-benchmark statistics with nearest-rank percentiles."""
    v = F.col(value)
    agg = timings.groupBy(key).agg(F.count(v).alias("runs"), F.min(v).alias("min_ms"), F.max(v).alias("max_ms"), F.round(F.avg(v), 4).alias("avg_ms"), F.round(F.count(v) * 1000 / F.sum(v), 2).alias("per_second"))
    agg = _same(agg, percentiles(timings, [key], value, {f"p{p}_ms": ("nearest", p / 100) for p in (50, 95, 99)}), [key])
    return agg.select(key, "runs", "min_ms", "max_ms", "avg_ms", "p50_ms", "p95_ms", "p99_ms", "per_second")


def worst_links(links: DataFrame, by: str = "p95_ms", most: int = 10) -> DataFrame:
    """The links of the greatest value (p95_ms, or error_rate for hotspots), in
    order; ties by source and target."""
    return links.orderBy(F.desc(by), "source", "target").limit(most)


def seed_baseline(telemetry: DataFrame) -> DataFrame:
    """Baseline rows from telemetry: p50 is the average, p99 1.2 times p95."""
    seconds = F.greatest(F.lit(1.0), F.col("total_duration_ms") / 1000)
    return telemetry.select("node_id", F.col("avg_duration_ms").alias("p50_duration_ms"), "p95_duration_ms", (F.col("p95_duration_ms") * 1.2).alias("p99_duration_ms"), (F.col("call_count") / seconds).alias("throughput"))
