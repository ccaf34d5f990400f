"""Package boundaries of a workspace: internal modules, rules, cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .governance import longest_prefix
from .traverse import simple_cycles

# Folders of a package that others must not import.
INTERNAL = "internal/ private/ _private/ impl/".split()


def _norm(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def is_internal(package_path: Column, exports: Column, file_path: Column) -> Column:
    """Whether a file is internal to its package: it lies in an internal folder,
    or the package declares exports and the file is none of them."""
    norm, root = _norm(file_path), F.concat(_norm(package_path), F.lit("/"))
    sub = F.when(norm.startswith(root), F.substr(norm, F.length(root) + 1)).otherwise(norm)
    hidden = F.lit(False)
    for part in INTERNAL:
        hidden = hidden | sub.contains(part)
    base = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    clean = lambda e: F.regexp_replace(_norm(e), r"^[./]+", "")
    public = F.exists(exports, lambda e: (sub == clean(e)) | (base(sub) == base(clean(e))) | sub.endswith(clean(e)))
    return hidden | (F.coalesce(F.size(exports), F.lit(0)) > 0) & ~F.coalesce(public, F.lit(False))


def package_edges(file_edges: DataFrame, packages: DataFrame) -> DataFrame:
    """source, target (files), from, to (packages) of edges between packages."""
    ends = file_edges.select(F.col("source").alias("path")).union(file_edges.select("target"))
    owner = longest_prefix(ends, packages)
    e = file_edges.select("source", "target").join(owner.select(F.col("path").alias("source"), F.col("package").alias("from")), "source")
    return e.join(owner.select(F.col("path").alias("target"), F.col("package").alias("to")), "target").filter("from <> to").select("source", "target", "from", "to")


def internal_imports(links: DataFrame, packages: DataFrame) -> DataFrame:
    """Package edges whose target is internal to its package.

    packages: (name, path, exports)."""
    p = packages.select(F.col("name").alias("to"), F.col("path").alias("p"), "exports")
    return links.join(p, "to").filter(is_internal(F.col("p"), F.col("exports"), F.col("target"))).select("source", "target", "from", "to")


def scope_violations(links: DataFrame, packages: DataFrame, rules: DataFrame) -> DataFrame:
    """Package edges that a custom rule forbids: source, target, from, to, severity.

    rules: (source_scope, disallow_scopes, source_package, disallow_packages,
    severity).  A rule's forbidden scopes and packages are exploded and meet
    the edges by equality; '*' stands for every source package."""
    p = packages.select("name", "scope")
    e = links.join(p.select(F.col("name").alias("from"), F.col("scope").alias("from_scope")), "from").join(p.select(F.col("name").alias("to"), F.col("scope").alias("to_scope")), "to")
    severity = F.coalesce("severity", F.lit("ERROR")).alias("severity")
    scopes = rules.filter("source_scope IS NOT NULL").select(F.col("source_scope").alias("from_scope"), F.explode("disallow_scopes").alias("to_scope"), severity)
    names = rules.filter("source_package IS NOT NULL").select("source_package", F.explode("disallow_packages").alias("to"), severity)
    out = ("source", "target", "from", "to", "severity")
    by_scope = e.join(scopes, ["from_scope", "to_scope"]).select(*out)
    any_source = e.join(names.filter("source_package = '*'").drop("source_package"), "to").select(*out)
    by_name = e.join(names.filter("source_package <> '*'").withColumnRenamed("source_package", "from"), ["from", "to"]).select(*out)
    return by_scope.union(any_source).union(by_name)


def package_cycles(links: DataFrame, max_length: int | None = None, limit: int | None = None) -> DataFrame:
    """cycle: the cycles of the package graph, each closed by its first package.

    All cycles, or the first limit of up to max_length packages if asked."""
    e = links.select(F.col("from").alias("source_id"), F.col("to").alias("target_id")).distinct()
    return simple_cycles(e, max_length, limit).select(F.concat("cycle", F.slice("cycle", 1, 1)).alias("cycle"))


def violations(links: DataFrame, packages: DataFrame, declared: DataFrame, rules: DataFrame, cycle_length: int | None = None) -> DataFrame:
    """rule, severity, from, to, source, target: all violations, of several with
    one rule, packages and target file the one with the first source file.

    declared: (from, to) dependencies that manifests name."""
    file = lambda df, rule, severity=F.lit("ERROR"): df.select(F.lit(rule).alias("rule"), severity.alias("severity"), "from", "to", "source", "target")
    paths = packages.select("name", "path")
    closed = package_cycles(links, cycle_length).select(F.element_at("cycle", 1).alias("from"), F.element_at("cycle", -1).alias("to"), F.element_at("cycle", 2).alias("second"))
    closed = closed.join(paths.select(F.col("name").alias("from"), F.col("path").alias("source")), "from").join(paths.select(F.col("name").alias("second"), F.col("path").alias("target")), "second")
    found = file(internal_imports(links, packages), "ENCAPSULATION_LEAK")
    found = found.unionByName(file(links.join(declared.select("from", "to"), ["from", "to"], "left_anti"), "UNDECLARED_DEPENDENCY"))
    found = found.unionByName(file(scope_violations(links, packages, rules), "SCOPE_VIOLATION", F.col("severity")))
    found = found.unionByName(file(closed, "CIRCULAR_PACKAGE_DEPENDENCY"))
    return found.groupBy("rule", "from", "to", "target").agg(F.min(F.struct("source", "severity")).alias("m")).select("rule", F.col("m.severity").alias("severity"), "from", "to", F.col("m.source").alias("source"), "target")


def resolve_alias(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """name, resolved: import names with their longest alias prefix replaced.

    aliases: (prefix, target).  A name's own beginnings meet the aliases by
    equality, so the work grows with the names alone."""
    norm = F.replace("name", F.lit("\\"), F.lit("/"))
    parts = F.split(norm, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    known = aliases.select(F.rtrim("prefix", F.lit("/")).alias("head"), F.rtrim("target", F.lit("/")).alias("target"))
    names = imports.select("name").distinct()
    met = names.withColumn("head", F.explode(above)).join(known, "head").groupBy("name").agg(F.max_by(F.struct("head", "target"), F.struct(F.length("head"), "target")).alias("m"))
    rest = F.regexp_replace(F.substr(norm, F.length("m.head") + 1), "^/+", "")
    return names.join(met, "name", "left").select("name", F.when(F.col("m").isNull(), F.col("name")).when(rest == "", F.col("m.target")).otherwise(F.concat_ws("/", "m.target", rest)).alias("resolved"))
