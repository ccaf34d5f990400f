"""Writing graphs: keyed upserts, snapshots, removals and text exports.

Tables are versioned folders; a snapshot is complete before its pointer row is
written, so readers see the old or the new graph, never a mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions.text import redact_secrets
from .model import MANUAL_EDGE_TYPES, MANUAL_NODE_TYPES, SCHEMA_VERSION
from .operators.order import placed


def last_wins(rows: DataFrame, key: str | list[str], order: str) -> DataFrame:
    """The row of the highest order per key; ties are settled by the row's hash."""
    keys = [key] if isinstance(key, str) else key
    others = [c for c in rows.columns if c not in keys]
    # the hash orders, the row is only carried: maps cannot be compared
    first = F.struct(F.col(order).alias("o"), F.xxhash64(*(F.col(c).cast("string") for c in others)).alias("h"))
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*(F.col(c).alias(f"v_{c}") for c in others)), first).alias("__m"))
    return best.select(*keys, *(F.col(f"__m.v_{c}").alias(c) for c in others if c != order))


def upsert_nodes(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Nodes after an insert that replaces by id; secrets leave the docstrings,
    and last_indexed_at, where the stored nodes have it, is now."""
    fresh = fresh.withColumn("docstring", redact_secrets(F.col("docstring")))
    if "last_indexed_at" in stored.columns:
        fresh = fresh.withColumn("last_indexed_at", F.current_timestamp())
    both = stored.withColumn("__seq", F.lit(0)).unionByName(fresh.withColumn("__seq", F.lit(1)))
    return last_wins(both, "id", "__seq").select(*stored.columns)


def append_edges(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Edges after an insert: a multigraph keeps duplicates."""
    return stored.unionByName(fresh)


def cleared(nodes: DataFrame, edges: DataFrame, preserve_manual: bool = True) -> tuple[DataFrame, DataFrame]:
    """What stays when derived rows go."""
    if not preserve_manual:
        return nodes.limit(0), edges.limit(0)
    return nodes.filter(F.col("node_type").isin(MANUAL_NODE_TYPES)), edges.filter(F.col("edge_type").isin(MANUAL_EDGE_TYPES))


def without_files(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the given files' nodes and all edges at them."""
    gone = nodes.join(paths.select("path"), "path", "left_semi").select("id")
    kept = nodes.join(paths.select("path"), "path", "left_anti")
    e = edges.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return kept.select(*nodes.columns), e.select(*edges.columns)


def without_repository(nodes: DataFrame, edges: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without those of a federated repository."""
    mine = F.col("id").startswith(f"repo:{repo}:")
    if "metadata_json" in nodes.columns:
        mine = mine | F.coalesce(F.get_json_object("metadata_json", "$.repo") == repo, F.lit(False))
    gone = nodes.filter(mine).select("id")
    e = edges.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return nodes.filter(~mine), e.select(*edges.columns)


def without_embeddings(embeddings: DataFrame, nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Embeddings without those of the given files' nodes."""
    gone = nodes.join(paths.select("path"), "path", "left_semi").select(F.col("id").alias("node_id"))
    return embeddings.join(gone, "node_id", "left_anti").select(*embeddings.columns)


def publish_snapshot(nodes: DataFrame, edges: DataFrame, folder: str, snapshot: str, fingerprints: DataFrame | None = None, keep_manual: bool = False) -> None:
    """Write the tables of a snapshot, then its pointer row.

    With keep_manual the manual rows of the latest snapshot stay, unless the
    new nodes have their id.  A snapshot id is used once only."""
    spark = nodes.sparkSession
    if keep_manual:
        was = latest_snapshot(spark, folder)
        manual, links = cleared(*was)
        nodes = nodes.unionByName(manual.join(nodes.select("id"), "id", "left_anti"), allowMissingColumns=True)
        edges = edges.unionByName(links, allowMissingColumns=True).distinct()
    tables = {"nodes": nodes, "edges": edges} | ({"fingerprints": fingerprints} if fingerprints is not None else {})
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{snapshot}/{name}")
    n, e = (spark.read.parquet(f"{folder}/{snapshot}/{t}").count() for t in ("nodes", "edges"))
    row = spark.createDataFrame([(snapshot, "published", n, e)], "id string, status string, node_count long, edge_count long").withColumn("created_at", F.current_timestamp())
    row.coalesce(1).write.mode("append").parquet(f"{folder}/snapshots")


def latest_snapshot(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the snapshot published last."""
    at = spark.read.parquet(f"{folder}/snapshots").filter("status = 'published'").orderBy(F.desc("created_at"), F.desc("id")).first()["id"]
    return spark.read.parquet(f"{folder}/{at}/nodes"), spark.read.parquet(f"{folder}/{at}/edges")


def _xml(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _quote(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def to_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON line per node and edge, after one with the schema's version, the
    time and the numbers of both."""
    stats = nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = stats.select(F.to_json(F.struct(F.lit("graph").alias("kind"), F.lit(SCHEMA_VERSION).alias("schema_version"), stamp.alias("exported_at"), "nodes", "edges")).alias("value"))
    line = lambda df, kind: df.select(F.to_json(F.struct(F.lit(kind).alias("kind"), *df.columns)).alias("value"))
    return head.union(line(nodes, "node")).union(line(edges, "edge"))


def framed(body: DataFrame, head: str, foot: str, folder: str) -> None:
    """Write the lines of a text export to a folder, with what comes before and
    after them in files of their own that sort first and last."""
    spark = body.sparkSession
    for name, text in (("0-head", head), ("2-foot", foot)):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{folder}/{name}")
    body.write.text(f"{folder}/1-body")


def write_dot(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    framed(to_dot(nodes, edges), "digraph G {", "}", folder)


def write_graphml(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n<key id="name" for="node" attr.name="name" attr.type="string"/>\n<key id="type" for="all" attr.name="type" attr.type="string"/>\n<graph edgedefault="directed">'
    framed(to_graphml(nodes, edges), head, "</graph>\n</graphml>", folder)


def to_dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a DOT graph's body."""
    n = nodes.select(F.concat(F.lit("  "), _quote(F.col("id")), F.lit(" [label="), _quote(F.col("name")), F.lit("];")).alias("value"))
    return n.union(edges.select(F.concat(F.lit("  "), _quote(F.col("source_id")), F.lit(" -> "), _quote(F.col("target_id")), F.lit(" [label="), _quote(F.col("edge_type")), F.lit("];"))))


def to_cypher(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Cypher statements."""
    n = nodes.select(F.concat(F.lit("MERGE (n:"), F.initcap("node_type"), F.lit(" {id: "), _quote(F.col("id")), F.lit("}) SET n.name = "), _quote(F.col("name")), F.lit(";")).alias("value"))
    return n.union(edges.select(F.concat(F.lit("MATCH (a {id: "), _quote(F.col("source_id")), F.lit("}), (b {id: "), _quote(F.col("target_id")), F.lit("}) MERGE (a)-[:"), F.upper("edge_type"), F.lit("]->(b);"))))


def to_graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GraphML elements; edges are named by their ends and type, so no global
    numbering is needed."""
    n = nodes.select(F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('"><data key="name">'), _xml(F.col("name")), F.lit('</data><data key="type">'), _xml(F.col("node_type")), F.lit("</data></node>")).alias("value"))
    return n.union(edges.select(F.concat(F.lit('<edge source="'), _xml(F.col("source_id")), F.lit('" target="'), _xml(F.col("target_id")), F.lit('"><data key="type">'), _xml(F.col("edge_type")), F.lit("</data></edge>"))))


def notes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, text: a Markdown note per node with its links both ways in order."""
    link = lambda key, other: edges.groupBy(F.col(key).alias("id")).agg(F.sort_array(F.collect_list(F.concat(F.lit("- "), "edge_type", F.lit(" [["), other, F.lit("]]")))).alias(key))
    j = nodes.join(link("source_id", "target_id"), "id", "left").join(link("target_id", "source_id"), "id", "left")
    part = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(f"\n## {title}\n"), F.array_join(c, "\n"))).otherwise("")
    return j.select("id", F.concat(F.lit("# "), "name", F.lit("\n"), part("Outgoing", "source_id"), part("Incoming", "target_id")).alias("text"))


def index_note(nodes: DataFrame) -> DataFrame:
    """place, text: lines of the index of all notes, by type and name."""
    kinds = nodes.select("node_type").distinct().select("node_type", F.lit(0).alias("k"), F.lit("").alias("name"), F.lit("").alias("id"), F.concat(F.lit("## "), "node_type").alias("text"))
    lines = nodes.select("node_type", F.lit(1).alias("k"), "name", "id", F.concat(F.lit("- [["), "id", F.lit("]] "), "name").alias("text"))
    return placed(kinds.union(lines), ["node_type", "k", "name", "id"]).select("place", "text")


def rank_rows(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with their 1-based place, for bounded results."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))
