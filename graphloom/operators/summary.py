"""Summaries of a graph: hubs, exports, communities, stories, capabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .governance import domain
from .order import placed

# Parts of the names of infrastructure.
INFRASTRUCTURE = "_get_connection logger log to_dict from_dict to_json from_json format render get_node insert_batch uuid config dict json as_dict Node Edge NodeType EdgeType format_text".split()
# Node types that count as code and as documents.
CODE = "function class module variable interface method enum type".split()
DOCUMENTS = "doc adr concept story epic criterion task".split()


def is_infrastructure(name: Column) -> Column:
    """Whether a name has a part that infrastructure goes by."""
    return F.lower(name).rlike("|".join(x.lower() for x in INFRASTRUCTURE))


def top_by_kind(scored: DataFrame, most: int = 5) -> DataFrame:
    """kind (domain or infrastructure), id, name, score, place: the best hubs
    of each kind by (score descending, id).  scored: (id, name, score)."""
    kind = F.when(is_infrastructure(F.col("name")), "infrastructure").otherwise("domain")
    rows = scored.withColumn("kind", kind)
    best = [rows.filter(F.col("kind") == k).orderBy(F.desc("score"), "id").limit(most) for k in ("domain", "infrastructure")]
    w = Window.partitionBy("kind").orderBy(F.desc("score"), "id")
    return best[0].union(best[1]).withColumn("place", F.row_number().over(w)).select("kind", "id", "name", "score", "place")


def extremes(rows: DataFrame, value: str, ties: list[str], most: int = 10) -> DataFrame:
    """The rows of the least and of the greatest values, with side: least or most."""
    low = rows.orderBy(value, *ties).limit(most).withColumn("side", F.lit("least"))
    return low.unionByName(rows.orderBy(F.desc(value), *ties).limit(most).withColumn("side", F.lit("most")))


def key_exports(nodes: DataFrame, scores: DataFrame, most: int = 8) -> DataFrame:
    """domain, id, place: classes and functions of each domain with the best
    scores (id, score), 0 where there is none; ties by id.

    The best of each domain are picked within hashed parts first, so no task
    sorts a whole domain."""
    d = nodes.filter(F.col("node_type").isin("class", "function")).select("id", domain(F.col("node_type"), F.col("path")).alias("domain"))
    rows = d.join(scores, "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    few = rows.withColumn("k", first("domain", "part")).filter(F.col("k") <= most)
    return few.withColumn("place", first("domain")).filter(F.col("place") <= most).select("domain", "id", "place")


def domain_flows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """domain, entities, files, inbound, outbound: sizes and edges to and from
    other domains."""
    d = nodes.select("id", "path", domain(F.col("node_type"), F.col("path")).alias("domain"))
    size = d.groupBy("domain").agg(F.count(F.lit(1)).alias("entities"), F.countDistinct("path").alias("files"))
    end = lambda name: d.select(F.col("id").alias(f"{name}_id"), F.col("domain").alias(name))
    e = edges.join(end("source"), "source_id").join(end("target"), "target_id").filter("source <> target")
    flows = e.select(F.explode(F.array(F.struct(F.col("source").alias("domain"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target").alias("domain"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x")).select("x.*")
    flows = flows.groupBy("domain").agg(F.sum("i").alias("inbound"), F.sum("o").alias("outbound"))
    return size.join(flows, "domain", "left").select("domain", "entities", "files", F.coalesce("inbound", F.lit(0)).alias("inbound"), F.coalesce("outbound", F.lit(0)).alias("outbound"))


def context_cut(nodes: DataFrame, edges: DataFrame, starts: int = 30) -> DataFrame:
    """One row (code_nodes, context_cut_pct): how much of the code the two-step
    surroundings of the first code nodes by id leave out, 0 to 95 percent."""
    code = nodes.filter(F.col("node_type").isin("function", "class", "module", "service")).select("id")
    first = code.orderBy("id").limit(starts)
    e = edges.select(F.explode(F.array(F.struct(F.col("source_id").alias("a"), F.col("target_id").alias("b")), F.struct(F.col("target_id").alias("a"), F.col("source_id").alias("b")))).alias("x")).select("x.*").distinct()
    one = first.select(F.col("id").alias("start"), F.col("id").alias("at"))
    hop = lambda df: df.join(e, F.col("at") == F.col("a")).select("start", F.col("b").alias("at")).distinct()
    near = hop(one)
    seen = one.union(near).union(hop(near)).distinct().join(code.select(F.col("id").alias("at")), "at", "left_semi")
    sizes = seen.groupBy("start").agg(F.count(F.lit(1)).alias("n")).agg(F.avg("n").alias("mean"))
    one_row = code.agg(F.count(F.lit(1)).alias("code_nodes")).crossJoin(sizes)
    cut = F.greatest(F.lit(0.0), F.least(F.lit(0.95), 1 - F.col("mean") / F.col("code_nodes")))
    return one_row.select("code_nodes", F.when(F.col("code_nodes") > 5, F.rint(cut * 100)).otherwise(0.0).cast("int").alias("context_cut_pct"))


def community_profile(membership: DataFrame, nodes: DataFrame, sample: int = 5) -> DataFrame:
    """place, community, size, types, sample: communities by (size descending,
    least id), their node types as 'type:count' in order, the names of the
    first members by id.  membership: (id, community)."""
    m = membership.join(nodes.select("id", "name", "node_type"), "id", "left")
    size = m.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("least"))
    kinds = m.groupBy("community", F.coalesce("node_type", F.lit("unknown")).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    kinds = kinds.groupBy("community").agg(F.sort_array(F.collect_list(F.concat_ws(":", "t", F.col("n").cast("string")))).alias("types"))
    part = m.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
    k = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("id"))
    few = part.withColumn("k", k("community", "part")).filter(F.col("k") <= sample).withColumn("k", k("community")).filter(F.col("k") <= sample)
    names = few.groupBy("community").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", F.coalesce("name", F.col("id").cast("string")).alias("v")))), lambda x: x["v"]).alias("sample"))
    out = placed(size, [F.desc("size"), "least"], "place").join(kinds, "community").join(names, "community")
    return out.select((F.col("place") + 1).alias("place"), "community", "size", "types", "sample")


def story_cards(nodes: DataFrame, edges: DataFrame, without: int | None = 0) -> DataFrame:
    """story, name, criteria, tasks: edges of each story to criteria and tasks,
    told by their ids; a story without any edge has ``without`` of both."""
    s = nodes.filter("node_type = 'story'").select(F.col("id").alias("source_id"), "name")
    has = lambda part: F.sum(F.col("target_id").contains(part).cast("long"))
    n = edges.join(s.select("source_id"), "source_id", "left_semi").groupBy("source_id").agg(has("criterion").alias("criteria"), has("task").alias("tasks"))
    none = F.lit(without).cast("long")
    return s.join(n, "source_id", "left").select(F.col("source_id").alias("story"), "name", F.coalesce("criteria", none).alias("criteria"), F.coalesce("tasks", none).alias("tasks"))


def traceability(cards: DataFrame) -> DataFrame:
    """One row (stories, status): whether every story has a criterion."""
    one = cards.agg(F.count(F.lit(1)).alias("stories"), F.count(F.when(F.col("criteria") == 0, 1)).alias("bare"))
    return one.select("stories", F.when(F.col("stories") == 0, "Awaiting Specs").when(F.col("bare") == 0, "AST Verified").otherwise("Partial Proof").alias("status"))


def workspace(nodes: DataFrame) -> DataFrame:
    """One row (nodes, code_files, doc_files, genesis): files with code and with
    documents; a workspace of few nodes or without code is at its beginning."""
    kind = F.lower(F.coalesce("node_type", F.lit("")))
    code, doc = kind.isin(CODE), kind.isin(DOCUMENTS)
    one = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count(F.when(code, 1)).alias("code"), F.countDistinct(F.when(code, F.col("path"))).alias("code_files"), F.countDistinct(F.when(doc, F.col("path"))).alias("doc_files"))
    return one.select("nodes", "code_files", "doc_files", ((F.col("nodes") < 15) | (F.col("code") == 0)).alias("genesis"))


def score_delta(score: DataFrame, kept: DataFrame, key: str = "baseline_health_score") -> DataFrame:
    """One row (score, delta): against the score kept under key (key, value),
    null where there is none or it is no number."""
    was = kept.filter(F.col("key") == key).select(F.expr("try_cast(value AS INT)").alias("was")).limit(1)
    return score.select("score").join(was, F.lit(True), "left").select("score", (F.col("score") - F.col("was")).alias("delta"))


def diagram_rows(nodes: DataFrame, caps: dict[str, int]) -> DataFrame:
    """node_type, id, name: the first rows by id of each type, as many as a
    diagram shows of it."""
    out = None
    for kind, most in caps.items():
        part = nodes.filter(F.col("node_type") == kind).select("node_type", "id", "name").orderBy("id").limit(most)
        out = part if out is None else out.unionByName(part)
    return out


def impacted_repositories(impacted: DataFrame) -> DataFrame:
    """target, repositories: how many federated repositories the impacted ids
    (target, id) are of."""
    repo = F.when(F.col("id").startswith("repo:"), F.split("id", ":")[1])
    return impacted.groupBy("target").agg(F.countDistinct(repo).alias("repositories"))
