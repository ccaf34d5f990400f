"""Change review: what a change touches, how risky it is, and the verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .governance import overlapping_symbols
from .lineage import routes
from .telemetry import risk_tier_name
from .traverse import impact

# What a change to such a file never needs the graph for.
IGNORED_PARTS = ".git .hg .svn .venv venv env node_modules __pycache__ .pytest_cache .mypy_cache .ruff_cache dist build target out coverage .next .nuxt .idea .vscode".split()
IGNORED_SUFFIXES = ".pyc .pyo .so .dll .dylib .exe .bin .png .jpg .jpeg .gif .svg .ico .pdf .zip .tar .gz .lock .log .db .sqlite".split()
#: How sure a finding about unused code is, as a number.
RANKS = {"low": 1, "medium": 2, "high": 3}


def changed_symbols(nodes: DataFrame, edges: DataFrame, hunks: DataFrame, depth: int = 3) -> DataFrame:
    """id, name, callers, impacted, risk of the symbols that changed lines touch.

    callers are the nodes one step away, impacted all within depth steps; 15
    of those make a change critical, 5 high.  A symbol without lines is on line 1."""
    code = nodes.filter(F.col("node_type").isin("function", "class", "variable"))
    start = F.when(F.coalesce("start_line", F.lit(0)) == 0, 1).otherwise(F.col("start_line"))
    code = code.withColumn("start_line", start).withColumn("end_line", F.when(F.coalesce("end_line", F.lit(0)) == 0, F.col("start_line")).otherwise(F.col("end_line")))
    touched = overlapping_symbols(hunks, code).select("id")
    reached = impact(nodes, edges, touched, depth).groupBy(F.col("target").alias("id")).agg(F.sum((F.col("depth") == 1).cast("long")).alias("callers"), F.count(F.lit(1)).alias("impacted"))
    n = F.coalesce("impacted", F.lit(0))
    out = touched.join(nodes.select("id", "name"), "id").join(reached, "id", "left")
    return out.select("id", "name", F.coalesce("callers", F.lit(0)).alias("callers"), n.alias("impacted"), F.when(n >= 15, "CRITICAL").when(n >= 5, "HIGH").otherwise("MODERATE").alias("risk"))


def touched_routes(nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """endpoint, handler, reason of the routes whose handler, or something it
    injects, is among the changed ids."""
    found = routes(nodes, edges).select("endpoint", "handler", "injected")
    ids = changed.select(F.col("id").alias("handler")).distinct().withColumn("own", F.lit(True))
    deps = found.select("endpoint", F.explode("injected").alias("id")).join(changed.select("id").distinct(), "id").groupBy("endpoint").agg(F.count(F.lit(1)).alias("deps"))
    j = found.drop("injected").join(ids, "handler", "left").join(deps, "endpoint", "left").filter("own OR deps > 0")
    return j.select("endpoint", "handler", F.when(F.col("own"), "Handler modified").otherwise(F.concat(F.lit("Dependency touched ("), F.col("deps").cast("string"), F.lit(")"))).alias("reason"))


def touched_topics(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """topic, publishers, subscribers: how many changed ids are at either side
    of the topics that have some."""
    e = edges.filter(F.col("edge_type").isin("publishes", "subscribes")).select(F.col("source_id").alias("id"), F.col("target_id").alias("topic"), "edge_type").distinct()
    side = lambda kind: F.sum((F.col("edge_type") == kind).cast("long"))
    return e.join(changed.select("id").distinct(), "id", "left_semi").groupBy("topic").agg(side("publishes").alias("publishers"), side("subscribes").alias("subscribers"))


def affected_stories(nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """story: the names of stories that point at the changed files (path)."""
    files = nodes.filter("node_type = 'file'").join(changed.select("path"), "path", "left_semi").select(F.col("id").alias("target_id"))
    stories = nodes.filter("node_type = 'story'").select(F.col("id").alias("source_id"), F.col("name").alias("story"))
    return edges.join(files, "target_id", "left_semi").select("source_id").distinct().join(stories, "source_id").select("story").distinct()


def unlinked_files(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """path of changed files that the graph does not know; hidden ones, those
    in ignored folders and those of ignored kinds do not count."""
    parts = F.split("path", "/")
    ignored = F.col("path").startswith(".") | F.col("path").contains("/.") | F.arrays_overlap(parts, F.array(*(F.lit(x) for x in IGNORED_PARTS)))
    for x in IGNORED_SUFFIXES:
        ignored = ignored | F.lower("path").endswith(x)
    known = nodes.filter(F.col("id").startswith("file:")).select(F.substring("id", 6, 1 << 20).alias("path"))
    return changed.select("path").distinct().filter(~ignored).join(known, "path", "left_anti")


def findings_verdict(findings: DataFrame, strict: bool = False, passed: str = "APPROVED") -> DataFrame:
    """One row (errors, warnings, verdict) over findings (severity): errors
    block, and so do warnings where strict."""
    one = findings.agg(F.count(F.when(F.col("severity") == "ERROR", 1)).alias("errors"), F.count(F.when(F.col("severity") == "WARNING", 1)).alias("warnings"))
    warned = "BLOCKED" if strict else "WARNING"
    return one.withColumn("verdict", F.when(F.col("errors") > 0, "BLOCKED").when(F.col("warnings") > 0, warned).otherwise(passed))


def change_verdict(symbols: DataFrame, telemetry: DataFrame, findings: DataFrame) -> DataFrame:
    """One row (symbols, traffic, max_error_rate, p0_symbols, tier, verdict).

    symbols: (id, risk) of a change, telemetry: (node_id, call_count,
    error_rate), findings: (severity)."""
    t = telemetry.select(F.col("node_id").alias("id"), "call_count", "error_rate")
    j = symbols.select("id", "risk").join(t, "id", "left").select("risk", F.coalesce("call_count", F.lit(0)).alias("calls"), F.coalesce("error_rate", F.lit(0.0)).alias("rate"))
    hot = (F.col("calls") >= 10000) | ((F.col("calls") >= 100) & (F.col("rate") >= 0.15))
    one = j.agg(
        F.count(F.lit(1)).alias("symbols"), F.coalesce(F.sum("calls"), F.lit(0)).cast("long").alias("traffic"), F.coalesce(F.max("rate"), F.lit(0.0)).alias("max_error_rate"),
        F.count(F.when(hot, 1)).alias("p0_symbols"), F.count(F.when(F.col("risk") == "CRITICAL", 1)).alias("critical"),
    )
    one = one.withColumn("tier", risk_tier_name(F.col("traffic"), F.col("p0_symbols") > 0, "P2_MODERATE")).crossJoin(findings_verdict(findings).select("errors", "warnings"))
    blocked = (F.col("errors") > 0) | ((F.col("tier") == "P0_CRITICAL") & (F.col("max_error_rate") >= 0.10))
    warned = (F.col("warnings") > 0) | F.col("tier").isin("P0_CRITICAL", "P1_HIGH") | (F.col("critical") > 0)
    return one.select("symbols", "traffic", F.round("max_error_rate", 4).alias("max_error_rate"), "p0_symbols", "tier", F.when(blocked, "BLOCKED").when(warned, "WARNING").otherwise("APPROVED").alias("verdict"))


def release_gate(proofs: DataFrame) -> DataFrame:
    """One row (approved, blocked, verdict) over ship proofs (story, can_ship):
    every story must be able to ship, and there must be one."""
    one = proofs.agg(F.count(F.when(F.col("can_ship"), 1)).alias("approved"), F.count(F.when(~F.col("can_ship"), 1)).alias("blocked"))
    return one.withColumn("verdict", F.when((F.col("blocked") == 0) & (F.col("approved") > 0), "APPROVED").otherwise("BLOCKED"))


def diagnose(cycles: DataFrame, violations: DataFrame, dead: DataFrame, most_dead: int = 5) -> DataFrame:
    """issue_type, severity, symbols, action: what to repair.

    cycles: (cycle), violations: (source_id, target_id), dead: rows of
    dead_code(), of which the surest and longest count."""
    def rows(df: DataFrame, kind: str, severity: str, symbols: Column, action: str) -> DataFrame:
        return df.select(F.lit(kind).alias("issue_type"), F.lit(severity).alias("severity"), symbols.alias("symbols"), F.lit(action).alias("action"))

    worst = by_certainty(dead, most_dead)
    out = rows(cycles, "circular_dependency", "ERROR", F.col("cycle").cast("array<string>"), "decouple_interface")
    out = out.unionByName(rows(violations, "layer_violation", "ERROR", F.array("source_id", "target_id"), "isolate_layer"))
    return out.unionByName(rows(worst, "dead_code", "WARNING", F.array("id"), "prune_symbol"))


def by_certainty(dead: DataFrame, most: int = 10) -> DataFrame:
    """Unused symbols, the surest first, then the longest, then by id."""
    rank = F.create_map(*(F.lit(x) for kv in RANKS.items() for x in kv))[F.col("confidence")]
    return dead.orderBy(F.desc(rank), F.desc("lines"), "id").limit(most)


def prune_plan(dead: DataFrame, min_confidence: str = "high") -> DataFrame:
    """id, name, path, confidence, lines of unused symbols that are safe to
    delete and sure enough."""
    rank = F.create_map(*(F.lit(x) for kv in RANKS.items() for x in kv))[F.col("confidence")]
    return dead.filter(F.col("safe") & (rank >= RANKS[min_confidence])).select("id", "name", "path", "confidence", "lines")


def link_lesson(nodes: DataFrame, lesson_id: str, domain: str, most: int = 5) -> DataFrame:
    """Edges of a lesson to the first nodes by id whose path or name has its domain."""
    like = f"%{domain}%"
    hit = nodes.filter(F.col("path").ilike(like) | F.col("name").ilike(like)).select("id").orderBy("id").limit(most)
    return hit.select(F.lit(lesson_id).alias("source_id"), F.col("id").alias("target_id"), F.lit("references").alias("edge_type"), F.lit("architectural_memory").alias("provenance"))


def service_endpoints(nodes: DataFrame, service: str | None = None) -> DataFrame:
    """id, name, role: endpoints (of a service, if given) and data schemas by
    what their metadata says."""
    meta = lambda k: F.get_json_object("metadata_json", f"$.{k}")
    said = F.coalesce(meta("kind").isin("rest_endpoint", "grpc_method", "endpoint"), F.lit(False)) | F.coalesce(meta("protocol").isin("rest", "grpc"), F.lit(False)) | meta("method").isNotNull()
    endpoint = said | F.col("id").startswith("endpoint:")
    if service and service != "all":
        endpoint = endpoint & (F.coalesce(meta("repo"), F.lit("local")) == service)
    kind = F.coalesce(meta("kind").isin("schema_model", "orm_model"), F.lit(False)) | F.lower("id").contains("schema")
    schema = F.col("node_type").isin("class", "table", "schema") & kind
    pick = lambda when, role: nodes.filter(when).select("id", "name", F.lit(role).alias("role"))
    return pick(endpoint, "endpoint").unionByName(pick(schema, "schema"))
