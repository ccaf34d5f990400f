"""Layers, boundaries, drift, coupling, proof, freshness and health."""

from __future__ import annotations

import hashlib
import hmac
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .order import placed

# The tier of a path's first known part; larger is deeper.
TIERS = {"cli": 1, "mcp": 1, "review": 2, "watcher": 2, "parser": 2, "graph": 2, "federation": 2, "refactor": 2, "repair": 2, "observability": 2, "c4": 2, "benchmark": 2, "semantic": 2, "security": 2, "core": 3}
# Names, beginnings and path parts of symbols that are called from outside.
ENTRY_NAMES = (
    "main __main__ __init__ __new__ __del__ __enter__ __exit__ __call__ __repr__ __str__ __eq__ __hash__ __lt__ __gt__ __le__ __ge__ __len__ __iter__ __next__ __getitem__ __setitem__ __contains__ __add__ __sub__ __mul__ "
    "setUp tearDown setUpClass tearDownClass setUpModule tearDownModule on_ready on_start on_stop on_event handle handler callback middleware configure setup teardown cleanup dispose "
    "to_dict from_dict to_json from_json dict json as_dict can_parse parse extract validate status_file_path activate deactivate escapeHtml".split()
)
ENTRY_PREFIXES = "test_ Test cmd_ handle_ on_ visit_ render format show resize reset update switch is_connected".split()
ENTRY_PATHS = "test_ tests/ conftest __main__ cli/ migrations/ extension/ web/js/".split()
#: Edge types that show a symbol is used.
USES = "calls imports uses verifies evidenced_by routes_to injects".split()


def path_tier(path: Column) -> Column:
    """Architectural tier of a path, null if no part is known."""
    # fixed values: paths whose tier is not that of their first known part
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    known = F.create_map(*(F.lit(x) for kv in TIERS.items() for x in kv))
    first = F.get(F.filter(F.split(p, "/"), lambda x: F.map_contains_key(known, x)), F.lit(0))
    services = p.contains("core/context_compiler") | p.contains("core/lifecycle") | p.contains("core/topology_compiler")
    return F.when(p.contains("core/model") | p.contains("core/security"), 3).when(services, 2).otherwise(F.try_element_at(known, first))


def layer_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """source_id, target_id, source_tier, target_tier of imports and calls from
    a deeper layer to one above it."""
    t = nodes.select("id", path_tier(F.col("path")).alias("tier")).filter("tier IS NOT NULL")
    e = edges.filter(F.col("edge_type").isin("imports", "calls")).select("source_id", "target_id", "edge_type")
    return e.join(t.select(F.col("id").alias("source_id"), F.col("tier").alias("source_tier")), "source_id").join(t.select(F.col("id").alias("target_id"), F.col("tier").alias("target_tier")), "target_id").filter("source_tier > target_tier").select("source_id", "target_id", "edge_type", "source_tier", "target_tier")


def domain(node_type: Column, path: Column) -> Column:
    """Named domain of a node by its type and path."""
    p, t = F.lower(F.coalesce(path, F.lit(""))), F.lower(node_type)
    # fixed values: the domains' names and what belongs to them, first rule first
    rules = [
        (t.isin("story", "epic", "criterion", "task"), "Specifications & Delivery"),
        (t.isin("service") | p.startswith("runtime://"), "Distributed Services & Runtimes"),
        (t.isin("test", "evidence") | p.contains("test"), "Verification & Quality"),
        (t.isin("adr", "doc", "concept") | p.startswith("docs"), "Decisions & Architecture"),
        (p.contains("/cli") | p.startswith("cli/") | p.contains("bin/"), "CLI Layer"),
        (p.contains("/parser") | p.startswith("parser/"), "AST Parser Subsystem"),
        (p.contains("/graph") | p.startswith("graph/") | p.contains("storage"), "Knowledge Graph & Storage"),
        (p.contains("/mcp") | p.startswith("mcp/"), "Native MCP Protocol"),
    ]
    out = F.lit("Core Engine")
    for when, name in reversed(rules):
        out = F.when(when, name).otherwise(out)
    return out


def conduits(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """source_domain, target_domain, edges: connections between different domains."""
    d = nodes.select("id", domain(F.col("node_type"), F.col("path")).alias("domain"))
    e = edges.join(d.select(F.col("id").alias("source_id"), F.col("domain").alias("source_domain")), "source_id").join(d.select(F.col("id").alias("target_id"), F.col("domain").alias("target_domain")), "target_id")
    return e.filter("source_domain <> target_domain").groupBy("source_domain", "target_domain").agg(F.count(F.lit(1)).alias("edges"))


def is_entrypoint(name: Column, path: Column, node_type: Column) -> Column:
    """Whether something outside may call a symbol."""
    hit = name.isin(ENTRY_NAMES)
    for p in ENTRY_PREFIXES:
        hit = hit | name.startswith(p)
    low = F.lower(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")))
    for p in ENTRY_PATHS:
        hit = hit | low.contains(p)
    public = (node_type == "class") & F.substring(name, 1, 1).rlike(r"\p{Lu}") & F.lower(name).rlike("mixin|base|abstract|interface|protocol")
    return hit | (name.startswith("__") & name.endswith("__")) | public


def confidence(name: Column, path: Column, node_type: Column) -> Column:
    """How sure an unused symbol is dead: high, medium or low."""
    inner = F.coalesce(path, F.lit("")).rlike("_internal|_private|_helpers")
    private = name.startswith("_") & ~name.startswith("__")
    return F.when(private | inner, "high").when((node_type == "function") & ~F.substring(name, 1, 1).rlike(r"\p{Lu}") | (node_type == "method"), "medium").otherwise("low")


def dead_code(nodes: DataFrame, edges: DataFrame, min_confidence: str = "low", texts: DataFrame | None = None) -> DataFrame:
    """id, name, path, confidence, lines, safe of code nodes that nothing uses.

    Uses are incoming edges of the known types, tables' mappings, injections by
    name, and any topic that is subscribed to.  With the files' texts (path,
    text), a symbol whose name occurs in its own file outside its lines is in
    use, and one that occurs in another file is of low confidence and not safe
    to delete.  Names are compared as whole words.
    """
    code = nodes.filter(F.col("node_type").isin("function", "method", "class"))
    used = edges.filter(F.col("edge_type").isin(USES) & (F.col("source_id") != F.col("target_id"))).select(F.col("target_id").alias("id"))
    used = used.union(edges.filter(F.col("edge_type").isin("maps_to", "subscribes")).select("source_id"))
    names = edges.filter(F.col("target_id").startswith("symbol:")).select(F.substring("target_id", 8, 1 << 20).alias("name")).distinct()
    idle = code.join(used.distinct(), "id", "left_anti").join(names, "name", "left_anti")
    idle = idle.filter(~is_entrypoint(F.col("name"), F.col("path"), F.col("node_type")))
    c = confidence(F.col("name"), F.col("path"), F.col("node_type"))
    lines = F.greatest(F.lit(1), F.coalesce(F.col("end_line") - F.col("start_line") + 1, F.lit(1)))
    out = idle.withColumn("confidence", c).withColumn("lines", lines).withColumn("elsewhere", F.lit(False))
    if texts is not None:
        words = texts.select(F.col("path").alias("at"), F.posexplode(F.split("text", "\n")).alias("line", "l")).select("at", (F.col("line") + 1).alias("line"), F.explode(F.array_distinct(F.regexp_extract_all("l", F.lit(r"\w+"), F.lit(0)))).alias("name"))
        met = out.select("id", "name", "path", "start_line", "end_line").join(words, "name")
        inside = F.coalesce(F.col("line").between(F.col("start_line"), F.col("end_line")), F.lit(False))
        seen = met.groupBy("id").agg(F.max((F.col("at") == F.col("path")) & ~inside).alias("own"), F.max(F.col("at") != F.col("path")).alias("other"))
        out = out.join(seen, "id", "left").filter(~F.coalesce("own", F.lit(False))).withColumn("elsewhere", F.coalesce("other", F.lit(False)))
    level = F.create_map(*(F.lit(x) for kv in (("low", 0), ("medium", 1), ("high", 2)) for x in kv))
    out = out.withColumn("confidence", F.when(F.col("elsewhere"), "low").otherwise(F.col("confidence")))
    out = out.select("id", "name", "path", "confidence", "lines", (~F.col("elsewhere") & F.col("confidence").isin("medium", "high")).alias("safe"))
    return out.filter(level[F.col("confidence")] >= {"low": 0, "medium": 1, "high": 2}[min_confidence])


def longest_prefix(files: DataFrame, packages: DataFrame) -> DataFrame:
    """path, package: the package whose folder is the longest one above a file.

    A file's own ancestors are exploded and meet packages by equality, so the
    work grows with the files alone."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    met = files.select("path").distinct().withColumn("folder", F.explode(above)).join(packages.select(F.col("path").alias("folder"), F.col("name").alias("package")), "folder")
    return met.groupBy("path").agg(F.max_by("package", F.struct(F.length("folder"), "package")).alias("package"))


def undeclared_packages(file_edges: DataFrame, packages: DataFrame, declared: DataFrame) -> DataFrame:
    """source, target, edges: dependencies between packages that none declares."""
    ends = file_edges.select(F.col("source").alias("path")).union(file_edges.select("target"))
    owner = longest_prefix(ends, packages)
    e = file_edges.join(owner.select(F.col("path").alias("source"), F.col("package").alias("from")), "source").join(owner.select(F.col("path").alias("target"), F.col("package").alias("to")), "target")
    return e.filter("from <> to").groupBy(F.col("from").alias("source"), F.col("to").alias("target")).agg(F.count(F.lit(1)).alias("edges")).join(declared, ["source", "target"], "left_anti")


def overlapping_symbols(hunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols that a changed line range of their file touches, each once."""
    h = hunks.select("path", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return symbols.join(h, "path").filter("start_line <= r_end AND end_line >= r_start").select("id", "path", "start_line", "end_line").dropDuplicates(["id"])


def enclosing_symbol(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """path, line, id: the symbol around each line, of several the first to start."""
    met = points.join(symbols.select("path", "id", "start_line", "end_line"), "path").filter("line BETWEEN start_line AND end_line")
    return met.groupBy("path", "line").agg(F.min(F.struct("start_line", "id")).alias("m")).select("path", "line", F.col("m.id").alias("id"))


def freshness(stored: DataFrame, found: DataFrame) -> DataFrame:
    """path, state: verified, stale, missing on disk or not indexed."""
    j = stored.select("path", F.col("content_hash").alias("was")).join(found.select("path", F.col("content_hash").alias("now")), "path", "full_outer")
    state = F.when(F.col("was").isNull(), "unindexed").when(F.col("now").isNull(), "missing").when(F.col("was") == F.col("now"), "verified").otherwise("stale")
    return j.select("path", state.alias("state"))


def ship_proof(stories: DataFrame, criteria: DataFrame, tasks: DataFrame) -> DataFrame:
    """story, criteria, open_tasks, can_ship: at least one criterion, no open task."""
    c = criteria.groupBy("story").agg(F.count(F.lit(1)).alias("criteria"))
    t = tasks.groupBy("story").agg(F.sum((~F.col("completed")).cast("long")).alias("open_tasks"))
    out = stories.select("story").join(c, "story", "left").join(t, "story", "left").select("story", F.coalesce("criteria", F.lit(0)).alias("criteria"), F.coalesce("open_tasks", F.lit(0)).alias("open_tasks"))
    return out.withColumn("can_ship", (F.col("criteria") > 0) & (F.col("open_tasks") == 0))


def martin_metrics(nodes: DataFrame, edges: DataFrame, membership: DataFrame) -> DataFrame:
    """community, ca, ce, instability, abstractness, distance of a partition (id, community)."""
    c = lambda end: membership.select(F.col("id").alias(end), F.col("community").alias(f"c_{end}"))
    e = edges.select("source_id", "target_id").join(c("source_id"), "source_id").join(c("target_id"), "target_id").filter("c_source_id <> c_target_id")
    ends = e.select(F.explode(F.array(F.struct(F.col("c_source_id").alias("c"), F.lit(0).alias("a"), F.lit(1).alias("e")), F.struct(F.col("c_target_id").alias("c"), F.lit(1).alias("a"), F.lit(0).alias("e")))).alias("x")).select("x.*").groupBy("c").agg(F.sum("a").alias("ca"), F.sum("e").alias("ce"))
    kinds = nodes.join(membership, "id").groupBy(F.col("community").alias("c")).agg(F.sum((F.col("node_type") == "class").cast("long")).alias("classes"), F.sum(((F.col("node_type") == "class") & F.lower("name").rlike("base|abstract|protocol|interface")).cast("long")).alias("abstract"))
    j = kinds.join(ends, "c", "left").select(F.col("c").alias("community"), F.coalesce("ca", F.lit(0)).alias("ca"), F.coalesce("ce", F.lit(0)).alias("ce"), "classes", "abstract")
    j = j.withColumn("instability", F.when(F.col("ca") + F.col("ce") > 0, F.round(F.col("ce") / (F.col("ca") + F.col("ce")), 4)).otherwise(0.0)).withColumn("abstractness", F.when(F.col("classes") > 0, F.round(F.col("abstract") / F.col("classes"), 4)).otherwise(0.0))
    return j.select("community", "ca", "ce", "instability", "abstractness", F.round(F.abs(F.col("abstractness") + F.col("instability") - 1), 4).alias("distance"))


def scorecard(nodes: DataFrame, edges: DataFrame, cycles: DataFrame) -> DataFrame:
    """One row (score, grade, isolated, cycles, code_units, verified_ratio).

    Ends are dealt by id before they are made distinct: nearly all of them are,
    and made so where they are read they would fill that task's memory."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    linked = edges.select(F.col("source_id").alias("id")).union(edges.select("target_id")).repartition(parts, "id").distinct()
    kinds = ("function", "class", "service", "endpoint", "module")
    source = (F.col("node_type") == "file") & F.col("path").rlike(r"\.(py|js|ts|sh)$") & ~F.col("path").endswith("__init__.py")
    isolated = nodes.filter(F.col("node_type").isin(*kinds) | source).select("id").repartition(parts, "id").join(linked, "id", "left_anti").agg(F.count(F.lit(1)).alias("isolated"))
    code = nodes.filter(F.col("node_type").isin("function", "class") & ~F.coalesce("path", F.lit("")).rlike("^tests?/|/tests/|test_"))
    proof = edges.filter(F.col("edge_type").isin("verifies", "evidenced_by") | ((F.col("edge_type") == "calls") & F.col("source_id").contains("tests/"))).select(F.col("target_id").alias("id")).repartition(parts, "id").distinct()
    units = code.select("id").repartition(parts, "id").join(proof.withColumn("ok", F.lit(1)), "id", "left").agg(F.count(F.lit(1)).alias("code_units"), F.coalesce(F.sum("ok"), F.lit(0)).alias("tested"))
    one = isolated.crossJoin(cycles.agg(F.count(F.lit(1)).alias("cycles"))).crossJoin(units)
    ratio = F.when(F.col("code_units") > 0, F.round(F.col("tested") / F.col("code_units"), 2)).otherwise(1.0)
    one = one.withColumn("verified_ratio", ratio)
    r = F.col("verified_ratio")
    gap = F.when(F.col("code_units") <= 5, 0).otherwise(F.when(r >= 0.8, 0).when(r >= 0.6, 5).when(r >= 0.4, 12).when(r >= 0.2, 20).otherwise(30))
    one = one.withColumn("score", F.greatest(F.lit(0), 100 - F.least(F.lit(15), F.col("isolated") * 2) - F.least(F.lit(35), F.col("cycles") * 10) - gap).cast("int"))
    s = F.col("score")
    grade = F.when(s >= 95, "A+").when(s >= 90, "A").when(s >= 80, "B").when(s >= 70, "C").when(s >= 60, "D").otherwise("F")
    return one.select("score", grade.alias("grade"), "isolated", "cycles", "code_units", "verified_ratio")


def ghosts(drawn: DataFrame, code: DataFrame, normalise) -> DataFrame:
    """Drawn nodes (id, name) without a code node of the same normalised name."""
    return drawn.withColumn("k", normalise(F.col("name"))).join(code.select(normalise(F.col("name")).alias("k")).distinct(), "k", "left_anti").drop("k")


def visual_drift(drawn: DataFrame, links: DataFrame, code: DataFrame, edges: DataFrame, normalise) -> DataFrame:
    """source, target, code_source, code_target of drawn links whose two ends
    have code nodes of their names, the first by id, without an edge between."""
    named = lambda df: df.select("id", normalise(F.col("name")).alias("k"))
    first = named(code).groupBy("k").agg(F.min("id").alias("code"))
    match = named(drawn).join(first, "k").select("id", "code")
    end = lambda side: match.select(F.col("id").alias(side), F.col("code").alias(f"code_{side}"))
    met = links.select("source", "target").distinct().join(end("source"), "source").join(end("target"), "target")
    known = edges.select(F.col("source_id").alias("code_source"), F.col("target_id").alias("code_target")).distinct()
    return met.join(known, ["code_source", "code_target"], "left_anti").select("source", "target", "code_source", "code_target")


def decoupling(cycles: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """cycle, cut_source, cut_target, strategy: where and how to break a cycle.

    With nodes (id, name, path) a model is told by a path and an event by a
    name; without, by the ids themselves.  The edge that closes a cycle is cut."""
    if nodes is None:
        rows = cycles.select("cycle", F.lower(F.array_join("cycle", " ")).alias("paths"), F.lower(F.array_join("cycle", " ")).alias("names"))
    else:
        ends = cycles.select("cycle", F.explode("cycle").alias("id")).join(nodes.select("id", "name", "path"), "id", "left")
        said = lambda c: F.max(F.lower(F.coalesce(c, F.lit(""))).rlike("model|entity|schema")) if c == "path" else F.max(F.lower(F.coalesce(c, F.lit(""))).rlike("listener|event|notify"))
        rows = ends.groupBy("cycle").agg(said("path").alias("m"), said("name").alias("e")).select("cycle", F.when(F.col("m"), "model").otherwise("").alias("paths"), F.when(F.col("e"), "event").otherwise("").alias("names"))
    strategy = F.when(F.col("paths").rlike("model|entity|schema"), "SHARED_KERNEL").when(F.col("names").rlike("listener|event|notify"), "EVENT_DRIVEN").otherwise("DEPENDENCY_INVERSION")
    return rows.select("cycle", F.element_at("cycle", -1).alias("cut_source"), F.element_at("cycle", 1).alias("cut_target"), strategy.alias("strategy"))


# --- attestation ---------------------------------------------------------


def leaf_hashes(edges: DataFrame, salt: str) -> DataFrame:
    """leaf: sha256 of blinded ends and type of each distinct edge."""
    blind = lambda c: F.sha2(F.concat_ws(":", F.lit(salt), F.col(c)), 256)
    return edges.select("source_id", "target_id", "edge_type").distinct().select(F.sha2(F.concat_ws(":", blind("source_id"), blind("target_id"), "edge_type"), 256).alias("leaf"))


def merkle_root(leaves: DataFrame) -> str:
    """Root over the sorted leaves; pairs hash as 'left:right', an odd last one
    with itself, no leaf gives the hash of nothing.

    Leaves are range-partitioned, so their places need no single task; each
    round halves them."""
    n = leaves.count()
    if not n:
        return hashlib.sha256(b"").hexdigest()
    level = cut(placed(leaves, ["leaf"], "i").select("i", "leaf"), "level")
    while n > 1:
        pair = level.groupBy(F.floor(F.col("i") / 2).cast("long").alias("i")).agg(F.min_by("leaf", "i").alias("l"), F.max_by("leaf", "i").alias("r"))
        level, n = cut(pair.select("i", F.sha2(F.concat_ws(":", "l", "r"), 256).alias("leaf")), "level"), (n + 1) // 2
    return level.first()["leaf"]


def attest(edges: DataFrame, violations: int, key: str, salt: str) -> dict:
    """Signed payload: the edges' Merkle root, their number and the violations."""
    payload = {"merkle_root": merkle_root(leaf_hashes(edges, salt)), "edges": edges.distinct().count(), "violations": violations}
    text = json.dumps(payload, sort_keys=True)
    return payload | {"signature": hmac.new(key.encode(), text.encode(), hashlib.sha256).hexdigest()}


def verify_attestation(attested: dict, key: str, edges: DataFrame | None = None, salt: str = "") -> bool:
    """Whether the signature fits the payload and, if the edges are given, the
    root is theirs."""
    payload = {k: v for k, v in attested.items() if k != "signature"}
    want = hmac.new(key.encode(), json.dumps(payload, sort_keys=True).encode(), hashlib.sha256).hexdigest()
    signed = hmac.compare_digest(want, attested.get("signature", ""))
    return signed and (edges is None or merkle_root(leaf_hashes(edges, salt)) == attested["merkle_root"])
