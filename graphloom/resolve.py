"""Honest resolution of names to nodes: tiers, and ambiguity instead of guesses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Prefixes that a plain id may lack.
PREFIXES = ("story:", "task:", "criterion:", "adr:", "file:")


def candidates(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """query, id, tier: matches by exact id (1), prefixed id (2), unique path (3),
    exact name (4) and name without case (5).  wanted: (query), trimmed; empty
    ones match nothing."""
    w = wanted.select(F.trim("query").alias("query")).filter("query <> ''").distinct()
    n = nodes.select("id", "name", "path")
    exact = w.join(n, w["query"] == n["id"]).select("query", "id", F.lit(1).alias("tier"))
    prefixed = w.select("query", F.posexplode(F.array(*(F.concat(F.lit(p), F.col("query")) for p in PREFIXES))).alias("place", "id")).join(n.select("id"), "id").groupBy("query").agg(F.min_by("id", "place").alias("id")).select("query", "id", F.lit(2).alias("tier"))
    by_path = w.join(n, w["query"] == n["path"]).groupBy("query").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).filter("n = 1").select("query", "id", F.lit(3).alias("tier"))
    by_name = w.join(n, w["query"] == n["name"]).select("query", "id", F.lit(4).alias("tier"))
    by_case = w.withColumn("low", F.lower("query")).join(n.withColumn("low", F.lower("name")), "low").select("query", "id", F.lit(5).alias("tier"))
    return exact.union(prefixed).union(by_path).union(by_name).union(by_case)


def resolve(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """query, status, selected, candidates: the best tier's only match, else
    ambiguous with the number of matches, else unresolved."""
    best = candidates(nodes, wanted).withColumn("best", F.min("tier").over(Window.partitionBy("query"))).filter("tier = best")
    found = best.groupBy("query").agg(F.count(F.lit(1)).alias("candidates"), F.min("id").alias("first"))
    out = wanted.select(F.trim("query").alias("query")).distinct().join(found, "query", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    n = F.col("candidates")
    return out.select("query", F.when(n == 0, "unresolved").when(n == 1, "resolved").otherwise("ambiguous").alias("status"), F.when(n == 1, F.col("first")).alias("selected"), "candidates")


def resolve_first(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """query, selected: the best tier's match, of several the first by id; null
    if there is none."""
    best = candidates(nodes, wanted).groupBy("query").agg(F.min(F.struct("tier", "id")).alias("m"))
    return wanted.select(F.trim("query").alias("query")).distinct().join(best, "query", "left").select("query", F.col("m.id").alias("selected"))


def resolve_targets(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """target, id, tier of what telemetry names (target).

    Tiers: the id; the name, functions, classes and endpoints first; the name
    without arguments and method ('GET /a (x)' is '/a'); what follows the last
    ':' of a path's last part; a node that has all words of the target, the
    one with the least words beside.  Names are compared without case; of
    several matches the first by id counts.  Targets without match are left out.
    """
    t = targets.select("target").filter("target <> ''").distinct()
    n = nodes.select("id", F.lower("name").alias("low"), (~F.col("node_type").isin("function", "class", "endpoint")).cast("int").alias("other"))
    plain = F.trim(F.regexp_replace("target", r"\(.*?\)", ""))
    clean = F.when(plain.contains(" "), F.element_at(F.split(plain, " +"), -1)).otherwise(plain)
    leaf = F.element_at(F.split(F.replace(clean, F.lit("\\"), F.lit("/")), "/"), -1)
    symbol = F.when((clean.contains("/") | clean.contains(".")) & leaf.contains(":"), F.element_at(F.split(leaf, ":"), -1))
    by_id = t.join(nodes.select("id"), t["target"] == F.col("id")).select("target", "id", F.lit(1).alias("tier"), F.lit(0).alias("other"))
    named = lambda key, tier, other: t.withColumn("low", F.lower(key)).join(n, "low").select("target", "id", F.lit(tier).alias("tier"), other.alias("other"))
    found = by_id.union(named(F.col("target"), 2, F.col("other"))).union(named(clean, 3, F.lit(0))).union(named(symbol, 4, F.lit(0)))
    best = found.groupBy("target").agg(F.min(F.struct("tier", "other", "id")).alias("m")).select("target", "m.id", "m.tier")
    left = t.join(best, "target", "left_anti")
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    asked = left.withColumn("w", words(clean)).filter(F.size("w") > 0)
    known = nodes.select("id", words(F.concat_ws(" ", "name", "path")).alias("all"))
    flat = known.select("id", F.size("all").alias("n"), F.explode("all").alias("word"))
    met = asked.select("target", F.size("w").alias("k"), F.explode("w").alias("word")).join(flat, "word").groupBy("target", "id").agg(F.count(F.lit(1)).alias("hit"), F.first("k").alias("k"), F.first("n").alias("n"))
    near = met.filter("hit = k").groupBy("target").agg(F.min(F.struct("n", "id")).alias("m")).select("target", "m.id", F.lit(5).alias("tier"))
    return best.union(near)


def resolve_symbols(nodes: DataFrame, edges: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, links): calls resolved by scope, and what imports and tests prove.

    calls: source_id, callee, target_id, status for the edges to
    'func_call:<callee>'.  A callee is looked for among the symbols of the
    module that its file imports it from, then of the packages the file
    imports, then anywhere; the first of those with a match decides, one match
    resolves, several are ambiguous.  links: source_id, target_id, edge_type,
    provenance - references of imports to symbols, verifies of tests.
    aliases: (prefix, target) of import names.
    """
    from .operators.boundaries import resolve_alias

    kinds = ("class", "function", "endpoint", "service")
    mod = F.regexp_replace(F.replace("path", F.lit("\\"), F.lit("/")), r"\.[^.]*$", "")
    symbols = nodes.filter(F.col("node_type").isin(*kinds)).select("id", "name", "path", mod.alias("mod"))
    imports = nodes.filter("node_type = 'import'").select(F.col("id").alias("import_id"), "name", F.col("path").alias("file"))
    imports = imports.join(resolve_alias(imports, aliases), "name").select("import_id", "file", "resolved")
    short = F.element_at(F.split("resolved", r"\."), -1)
    base = F.element_at(F.split(F.rtrim("resolved", F.lit("/")), "/"), -1)
    bare = F.regexp_replace(base, r"\.[^.]*$", "")
    pathlike = F.col("resolved").contains("/")

    # imports to symbols: by short name, else by the file's name along its path
    count = symbols.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    i = imports.withColumn("name", short).join(count, "name", "left")
    by_name = i.filter("n IS NOT NULL").join(symbols.select("name", "id"), "name").select("import_id", "file", "id", F.when(F.col("n") == 1, "resolved").otherwise("ambiguous").alias("provenance"))
    along = i.filter(F.col("n").isNull() & pathlike).withColumn("name", bare).drop("n").join(symbols, "name").filter(F.col("path").startswith(F.col("resolved")) | F.col("resolved").startswith(F.col("mod")))
    one = along.groupBy("import_id", "file").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).filter("n = 1").select("import_id", "file", "id", F.lit("resolved").alias("provenance"))
    found = by_name.union(one).filter(F.col("id") != F.col("import_id"))
    links = found.select(F.col("import_id").alias("source_id"), F.col("id").alias("target_id"), F.lit("references").alias("edge_type"), "provenance")
    tested = found.filter((F.col("provenance") == "resolved") & F.col("file").rlike("^(tests/|test_)"))
    links = links.union(tested.select("import_id", "id", F.lit("verifies"), F.lit("test_import_proof")))

    # calls: what a file imports under the callee's name, the last one
    names = F.when(pathlike, F.array(short, base, bare)).otherwise(F.array(short))
    scope = imports.withColumn("callee", F.explode(F.array_distinct(names))).groupBy("file", "callee").agg(F.max_by("resolved", "import_id").alias("resolved"))
    files = nodes.select(F.col("id").alias("source_id"), F.col("path").alias("file"))
    calls = edges.filter(F.col("target_id").startswith("func_call:")).select("source_id", F.substring("target_id", 11, 1 << 20).alias("callee")).distinct().join(files, "source_id", "left")
    scoped = symbols.groupBy("mod", "name").agg(F.max("id").alias("id")).withColumnRenamed("name", "callee")
    m, t = F.col("mod"), F.col("t")
    fits = t.endswith(m) | m.endswith(t) | m.startswith(F.concat(t, F.lit("/"))) | t.startswith(F.concat(m, F.lit("/")))
    by_module = calls.join(scope, ["file", "callee"]).withColumn("t", F.replace("resolved", F.lit("."), F.lit("/"))).join(scoped, "callee").filter(fits).select("source_id", "callee", "id", F.lit(1).alias("tier"))
    packages = imports.filter(pathlike).select("file", F.rtrim("resolved", F.lit("/")).alias("t")).distinct()
    by_package = calls.join(packages, "file").join(scoped, "callee").filter((m == t) | m.startswith(F.concat(t, F.lit("/")))).select("source_id", "callee", "id", F.lit(2).alias("tier")).distinct()
    anywhere = symbols.groupBy(F.col("name").alias("callee")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    tiers = by_module.union(by_package).groupBy("source_id", "callee", "tier").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    tiers = tiers.union(calls.join(anywhere, "callee").select("source_id", "callee", F.lit(3), "id", "n"))
    best = tiers.groupBy("source_id", "callee").agg(F.min(F.struct("tier", "id", "n")).alias("m"))
    resolved = calls.join(best, ["source_id", "callee"], "left")
    n = F.col("m.n")
    out = resolved.select("source_id", "file", "callee", F.when(n == 1, F.col("m.id")).alias("target_id"), F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("unresolved").alias("status"))
    test = F.col("file").rlike("^(tests/|test_)|_test\\.py") | F.col("source_id").rlike("^(func|class):tests/")
    proof = out.filter((F.col("status") == "resolved") & test).select("source_id", "target_id").distinct()
    proof = proof.join(edges.filter("edge_type = 'verifies'").select("source_id", "target_id"), ["source_id", "target_id"], "left_anti")
    links = links.union(proof.select("source_id", "target_id", F.lit("verifies"), F.lit("test_execution_proof")))
    return out.drop("file"), links


def link_references(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """source_id, name, target_id, status for references (source_id, name) by
    short name: one symbol resolves, several are ambiguous, none is unresolved."""
    s = symbols.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    j = references.join(s, "name", "left")
    return j.select("source_id", "name", F.when(F.col("n") == 1, F.col("first")).alias("target_id"), F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("unresolved").alias("status"))
