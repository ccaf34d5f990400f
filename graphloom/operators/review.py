"""Change review: diff statistics, recommended tests, lessons, retrieval quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diffstat(diffs: DataFrame, max_files: int = 15) -> DataFrame:
    """path, added, deleted of the files with most changed lines; ties by path.

    diffs: (path, diff) of unified diffs; the files' headers do not count."""
    line = diffs.select("path", F.explode(F.split("diff", "\n")).alias("l"))
    plus = F.col("l").startswith("+") & ~F.col("l").startswith("+++")
    minus = F.col("l").startswith("-") & ~F.col("l").startswith("---")
    s = line.groupBy("path").agg(F.sum(plus.cast("long")).alias("added"), F.sum(minus.cast("long")).alias("deleted"))
    return s.orderBy(F.desc(F.col("added") + F.col("deleted")), "path").limit(max_files)


def recommended_tests(changed: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """suite: test suites of the rules (part, suite) whose part occurs in a
    changed path, each once; the default if none does.  rules is a short list."""
    hit = changed.join(rules, F.col("path").contains(F.col("part"))).select("suite").distinct()
    return changed.sparkSession.createDataFrame([(default,)], "suite string").join(hit.agg(F.count(F.lit(1)).alias("n")), F.col("n") == 0).select("suite").union(hit)


def relevant_rules(rules: DataFrame, text: str, fallback: int = 3) -> DataFrame:
    """Lessons (id, domain, rule) for a text: the domain occurs in it or it has
    a word of over four letters that the rule has; else the first ones by id."""
    words = [w for w in text.lower().split() if len(w) > 4]
    hit = F.lit(text.lower()).contains(F.lower("domain"))
    for w in words:
        hit = hit | F.lower("rule").contains(w)
    found = rules.filter(hit)
    return found if not found.isEmpty() else rules.orderBy("id").limit(fallback)


def retrieval_quality(expected: DataFrame, found: DataFrame) -> DataFrame:
    """One row (precision, recall, f1, ghosts) of found names against expected ones."""
    e, f = expected.select("name").distinct(), found.select("name").distinct()
    j = e.withColumn("e", F.lit(1)).join(f.withColumn("f", F.lit(1)), "name", "full_outer").agg(F.count("e").alias("e"), F.count("f").alias("f"), F.sum(F.coalesce(F.col("e") * F.col("f"), F.lit(0))).alias("hit"))
    p, r = F.when(F.col("f") > 0, F.col("hit") / F.col("f")).otherwise(1.0), F.when(F.col("e") > 0, F.col("hit") / F.col("e")).otherwise(1.0)
    return j.select(F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 4).alias("f1"), (F.col("f") - F.col("hit")).alias("ghosts"))


def couplings(edges: DataFrame, documents: DataFrame, code: DataFrame) -> DataFrame:
    """source_id, target_id, verified: links from documents to code, and whether
    anything verifies the code."""
    e = edges.select("source_id", "target_id").distinct().join(documents.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(code.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    proof = edges.filter(F.col("edge_type").isin("verifies", "evidenced_by")).select("target_id").distinct().withColumn("ok", F.lit(True))
    return e.join(proof, "target_id", "left").select("source_id", "target_id", F.coalesce("ok", F.lit(False)).alias("verified"))


def discover_targets(nodes: DataFrame, query: str | None = None, changed: DataFrame | None = None, default: int = 15) -> DataFrame:
    """Callables to measure: those a query names, else those of changed files,
    else the first ones by id outside of tests."""
    code = nodes.filter(F.col("node_type").isin("function", "method", "endpoint", "class")).select("id", "name", "path")
    if query:
        return code.filter(F.col("id").contains(query) | F.col("name").contains(query) | F.col("path").contains(query))
    if changed is not None:
        return code.join(changed.select("path"), "path", "left_semi").select("id", "name", "path")
    return code.filter(~F.lower("path").contains("test")).orderBy("id").limit(default)


def diff_totals(diffs: DataFrame) -> DataFrame:
    """One row (files, added, deleted) over all diffs (path, diff)."""
    line = diffs.select("path", F.explode(F.split("diff", "\n")).alias("l"))
    plus = F.col("l").startswith("+") & ~F.col("l").startswith("+++")
    minus = F.col("l").startswith("-") & ~F.col("l").startswith("---")
    return line.agg(F.countDistinct("path").alias("files"), F.coalesce(F.sum(plus.cast("long")), F.lit(0)).alias("added"), F.coalesce(F.sum(minus.cast("long")), F.lit(0)).alias("deleted"))


def rules_of_domain(rules: DataFrame, domain: str | None = None) -> DataFrame:
    """Lessons (id, domain, rule) of a domain and those that hold everywhere; all without one."""
    return rules if domain is None else rules.filter((F.col("domain") == domain) | (F.coalesce("domain", F.lit("global")) == "global"))
