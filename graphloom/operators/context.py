"""Hybrid search and context packs: what to read for a question, a task or a symbol."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..resolve import resolve_first
from .rank import pagerank_plain
from .retrieval import budget_prefix, fuse, hashed_entries, hashed_vectors, search, vector_search
from .traverse import impact, neighbours

#: What a node is searched by.
TEXT = ["name", "node_type", "path", "docstring"]


def _embedded(nodes: DataFrame) -> Column:
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.concat_ws(" ", part("name"), part("name"), part("node_type"), part("path"), part("docstring"))


def hybrid_search(nodes: DataFrame, query: str, top_k: int = 10, rrf_k: int = 60) -> DataFrame:
    """id, rrf, source, vec: lexical and vector ranks of the nodes, fused.

    Each list has the first max(3 top_k, 20) hits.  A blank query has none."""
    most = max(3 * top_k, 20)
    spark = nodes.sparkSession
    asked = spark.createDataFrame([("query", query.strip())], "id string, text string")
    lexical = search(nodes, TEXT, query, most)
    semantic = vector_search(hashed_entries(nodes, _embedded(nodes)), hashed_vectors(asked, F.col("text")), most)
    return fuse(lexical, semantic, top_k, rrf_k)


def skeleton(node_type: Column, name: Column, path: Column, docstring: Column) -> Column:
    """A symbol in a few lines: its path, head and the first line of its text."""
    first = F.element_at(F.split(F.trim(F.coalesce(docstring, F.lit("")), F.lit(" \t\r\n")), "\n"), 1)
    where, name = F.coalesce(path, F.lit("")), F.coalesce(name, F.lit(""))
    body = F.concat(F.lit(':\n    """'), first, F.lit('"""\n    ...\n'))
    return (
        F.when(node_type == "class", F.concat(F.lit("# "), where, F.lit("\nclass "), name, body))
        .when(node_type.isin("function", "method"), F.concat(F.lit("# "), where, F.lit("\ndef "), name, F.lit("(...)"), body))
        .otherwise(F.concat(F.lit("# "), where, F.lit(" ("), F.coalesce(node_type, F.lit("")), F.lit(": "), name, F.lit(")\n")))
    )


def topology_pack(nodes: DataFrame, edges: DataFrame, query: str, budget: int = 1500, strategy: str = "hybrid", fallback: int = 15) -> DataFrame:
    """id, score, cost, used, text: skeletons of what a query is about, best
    first, while they fit the budget of tokens (4 characters each).

    Candidates are the node that the query names with its neighbours and the
    first 15 lexical hits, or else the first nodes by id.  A hundred times the
    rank, 5 for a hit and 2 for a class or function make the score."""
    spark = nodes.sparkSession
    direct = resolve_first(nodes, spark.createDataFrame([(query,)], "query string")).filter("selected IS NOT NULL").select(F.col("selected").alias("id"))
    hits = search(nodes, TEXT, query, 15).select("id").withColumn("hit", F.lit(5.0))
    found = direct.union(neighbours(nodes, edges, direct).select("id")).union(hits.select("id")).distinct()
    if found.isEmpty():
        found = nodes.select("id").orderBy("id").limit(fallback)
    rows = found.join(nodes.select("id", *TEXT), "id").join(hits, "id", "left")
    rank = F.lit(0.0)
    if strategy in ("pagerank", "hybrid"):
        rows = rows.join(pagerank_plain(nodes, edges, 20).withColumnRenamed("score", "rank"), "id", "left")
        rank = F.coalesce("rank", F.lit(0.0)) * 100
    kind = F.when(F.col("node_type").isin("class", "function"), 2.0).otherwise(0.0)
    text = skeleton(*(F.col(c) for c in ("node_type", "name", "path", "docstring")))
    rows = rows.select("id", F.round(rank + F.coalesce("hit", F.lit(0.0)) + kind, 6).alias("score"), text.alias("text"))
    rows = rows.withColumn("cost", F.greatest(F.lit(1), F.ceil(F.length("text") / 4)).cast("long"))
    header = f"# Context for '{query}'\n# Strategy: {strategy}, budget: {budget} tokens\n\n"
    return budget_prefix(rows, budget, max(1, -(-len(header) // 4))).select("id", "score", "cost", "used", "text")


def significant_words(text: str, most: int = 20) -> list[str]:
    """The first distinct words of more than four letters or digits only."""
    found = [w for w in text.split() if len(w) > 4 and w.isalnum()]
    return list(dict.fromkeys(found))[:most]


def context_pack(nodes: DataFrame, edges: DataFrame, target: str, radius: int = 2, hybrid: bool = False) -> DataFrame:
    """section, id, name: what belongs to a story, task or symbol.

    A story or task has its story, criteria, tasks and related symbols (up to
    ten functions and classes that its words lead to); a function, class or
    file has itself, what depends on it within radius steps and, if hybrid,
    what reads alike.  An unknown target has nothing."""
    spark = nodes.sparkSession
    n = nodes.select("id", "name", "node_type", "docstring")
    row = resolve_first(nodes, spark.createDataFrame([(target,)], "query string")).filter("selected IS NOT NULL").select(F.col("selected").alias("id")).join(n, "id").first()
    empty = spark.createDataFrame([], "section string, id string, name string")
    if row is None:
        return empty
    one = spark.createDataFrame([(row["id"],)], "id string")
    section = lambda df, name: df.select(F.lit(name).alias("section"), "id", "name")
    about = lambda r: f"{r['name']} {r['docstring'] or ''} "
    if row["node_type"] in ("function", "class", "file"):
        out = section(one.join(n, "id"), "symbol").unionByName(section(impact(nodes, edges, one, radius).select("id").join(n, "id"), "impacted"))
        if hybrid:
            alike = hybrid_search(nodes, about(row), 6).filter(F.col("id") != row["id"]).select("id")
            out = out.unionByName(section(alike.join(n, "id"), "related"))
        return out
    story = row if row["node_type"] == "story" else None
    if row["node_type"] == "task":
        story = neighbours(nodes, edges, one, "in").filter("node_type = 'story'").select("id").join(n, "id").orderBy("id").first()
    out, text = empty, about(story) if story else ""
    if story:
        top = spark.createDataFrame([(story["id"],)], "id string")
        out = section(top.join(n, "id"), "story")
        below = neighbours(nodes, edges, top, "out").select("id").distinct().join(n, "id")
        kinds = {"criterion": "criterion"} if row["node_type"] == "task" else {"criterion": "criterion", "task": "task"}
        parts = below.filter(F.col("node_type").isin(*kinds)).orderBy("id")
        out = out.unionByName(parts.select(F.col("node_type").alias("section"), "id", "name"))
        # a story's own lines: what its words are taken from
        text += "".join(about(r) for r in parts.toLocalIterator())
    if row["node_type"] == "task":
        out, text = out.unionByName(section(one.join(n, "id"), "task")), text + about(row)
    words = significant_words(text)
    if hybrid and text.strip():
        hits = hybrid_search(nodes, re.sub(r"[^\w\s]", " ", text), 15).join(n, "id").filter(F.col("node_type").isin("function", "class", "file")).orderBy(F.desc("rrf"), F.desc("vec"), "id").limit(10)
        return out.unionByName(section(hits, "symbol"))
    if not words:
        return out
    hits = search(nodes, TEXT, " OR ".join(words), 20).join(n, "id").filter(F.col("node_type").isin("function", "class")).orderBy("rank").limit(10)
    return out.unionByName(section(hits, "symbol"))
