"""Specifications, diagrams, contracts and comments as nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split(F.col("text"), r"\r?\n")).alias("no", "line")).withColumn("no", F.col("no") + 1)


def specifications(files: DataFrame) -> DataFrame:
    """kind, id, name, completed, path, line of Markdown specs (path, text):
    stories (# STORY-1: ...), criteria (AC-1), tasks with their check mark, decisions."""
    x = _lines(files)
    story = r"^#+\s*((?:STORY|DEV|EPIC|SPEC)-[\w-]+)[:\s-]*(.*)$"
    w = F.max(F.when(F.col("line").rlike(story), F.struct("no", F.regexp_extract("line", story, 1).alias("s"))))
    from pyspark.sql import Window

    x = x.withColumn("story", w.over(Window.partitionBy("path").orderBy("no").rowsBetween(Window.unboundedPreceding, 0))["s"])

    def part(kind, pattern, i, name, done=None):
        return x.filter(F.col("line").rlike(pattern)).select(F.lit(kind).alias("kind"), i(pattern).alias("id"), F.trim(F.regexp_extract("line", pattern, name)).alias("name"), (done(pattern) if done else F.lit(None).cast("boolean")).alias("completed"), "path", F.col("no").alias("line"))

    get = lambda n: lambda p: F.regexp_extract("line", p, n)
    criterion = r"^\s*(?:[-*]\s*|\|\s*)\**(AC-?\d+)\**[:|\s]+([^|]*)"
    task = r"^\s*[-*]\s*\[([ xX])\]\s*\**(T-?\d+|TASK-?\d+)?\**[:\s]*(.*)$"
    parts = [
        part("story", story, lambda p: F.concat(F.lit("story:"), get(1)(p)), 2),
        part("criterion", criterion, lambda p: F.concat(F.lit("criterion:"), F.coalesce("story", F.lit("")), F.lit(":"), get(1)(p)), 2),
        part("task", task, lambda p: F.concat(F.lit("task:"), F.coalesce("story", F.lit("")), F.lit(":"), F.when(get(2)(p) != "", get(2)(p)).otherwise(F.col("no").cast("string"))), 3, lambda p: F.lower(get(1)(p)) == "x"),
        part("adr", r"^#\s*(ADR-\d+)[:\s-]*(.*)$", lambda p: F.concat(F.lit("adr:"), get(1)(p)), 2),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["id", "path"])


def links(files: DataFrame) -> DataFrame:
    """path, target of relative links in Markdown."""
    found = F.regexp_extract_all("text", F.lit(r"\]\((?!https?:|#|mailto:)([^)#\s]+)"), F.lit(1))
    return files.select("path", F.explode(found).alias("target")).distinct()


def rationale(files: DataFrame) -> DataFrame:
    """path, line, tag, text, citations of WHY, NOTE, HACK and ASSUMPTION comments."""
    p = r"(?:#|//|/\*|--)\s*(WHY|NOTE|HACK|ASSUMPTION)\s*:\s*(.*?)(?:\*/)?\s*$"
    return _lines(files).filter(F.col("line").rlike(p)).select("path", F.col("no").alias("line"), F.regexp_extract("line", p, 1).alias("tag"), F.regexp_extract("line", p, 2).alias("text"), F.regexp_extract_all("line", F.lit(r"\b((?:ADR|DEV|RFC)-?\d+)\b"), F.lit(1)).alias("citations"))


def references(files: DataFrame) -> DataFrame:
    """path, name: symbols in backticks, each once per document."""
    return files.select("path", F.explode(F.regexp_extract_all("text", F.lit("`([A-Za-z0-9_.:]+)`"), F.lit(1))).alias("name")).distinct()


def diagrams(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of Mermaid and PlantUML text and Excalidraw JSON (path, text)."""
    x = _lines(files)
    box = r"([A-Za-z]\w*)\s*(?:\[+\(?|\(+|\{+)\"?([^\]\)\}\"]+)\"?(?:\)?\]+|\)+|\}+)"
    m = x.filter(~F.col("line").rlike(r"^\s*(?:@|component|\[)")).select("path", F.explode(F.arrays_zip(F.regexp_extract_all("line", F.lit(box), F.lit(1)).alias("i"), F.regexp_extract_all("line", F.lit(box), F.lit(2)).alias("n"))).alias("b")).select("path", F.col("b.i").alias("key"), F.trim("b.n").alias("name"))
    comp = r"^\s*(?:component|database|actor|node|queue)?\s*\[?\"?([\w ]+?)\"?\]?\s+as\s+(\w+)"
    u = x.filter(F.col("line").rlike(comp)).select("path", F.regexp_extract("line", comp, 2).alias("key"), F.trim(F.regexp_extract("line", comp, 1)).alias("name"))
    elements = F.explode(F.try_variant_get(F.try_parse_json(F.col("text")), "$.elements", "array<variant>")).alias("e")
    e = files.select("path", elements)
    g = lambda p: F.try_variant_get("e", p, "string")
    d = e.filter(g("$.type") == "text").select("path", F.coalesce(g("$.containerId"), g("$.id")).alias("key"), g("$.text").alias("name"))
    nodes = m.union(u).union(d).groupBy("path", "key").agg(F.min("name").alias("name")).select(F.concat(F.lit("visual:"), "path", F.lit(":"), "key").alias("id"), "name", F.lit("concept").alias("node_type"), "path")
    arrow = r"^\s*\[?([A-Za-z]\w*)\]?(?:[\[\(\{].*?[\]\)\}])?\s*(?:-->|--?>|==>|-\.->|\.\.>)\s*(?:\|([^|]*)\|)?\s*\[?([A-Za-z]\w*)\]?.*?(?::\s*(.*))?$"
    a = x.filter(F.col("line").rlike(arrow)).select("path", F.regexp_extract("line", arrow, 1).alias("s"), F.regexp_extract("line", arrow, 3).alias("t"), F.coalesce(F.nullif(F.regexp_extract("line", arrow, 2), F.lit("")), F.nullif(F.regexp_extract("line", arrow, 4), F.lit(""))).alias("label"))
    b = e.filter(g("$.type") == "arrow").select("path", g("$.startBinding.elementId").alias("s"), g("$.endBinding.elementId").alias("t"), F.lit(None).cast("string").alias("label")).filter("s IS NOT NULL AND t IS NOT NULL")
    v = lambda c: F.concat(F.lit("visual:"), "path", F.lit(":"), c)
    return nodes, a.union(b).select(v("s").alias("source_id"), v("t").alias("target_id"), F.lit("references").alias("edge_type"), "label")


def _owner(repo: str) -> str:
    """What ids of a repository begin with: nothing for the local one."""
    return "" if repo == "local" else f"repo:{repo}:"


def openapi_endpoints(files: DataFrame, repo: str) -> DataFrame:
    """id, name, method, route of OpenAPI documents in JSON (path, text)."""
    paths = F.try_variant_get(F.try_parse_json(F.col("text")), "$.paths", "map<string,variant>")
    r = files.select(F.explode(paths).alias("route", "ops")).select("route", F.explode(F.try_variant_get("ops", "$", "map<string,variant>")).alias("method", "op"))
    r = r.filter(F.lower("method").isin("get", "put", "post", "delete", "patch", "head", "options"))
    m = F.upper("method")
    return r.select(F.concat(F.lit(_owner(repo) + "endpoint:"), m, F.lit(":"), "route").alias("id"), F.concat_ws(" ", m, "route").alias("name"), m.alias("method"), "route")


def openapi_schemas(files: DataFrame, repo: str) -> DataFrame:
    """id, name, path, docstring of the data schemas of OpenAPI documents in
    JSON (path, text): those of components or, where it has none, of the older
    block definitions; a schema's description, or a text with its name.  Other
    documents, null and broken ones have none."""
    kind = "map<string,variant>"
    block = lambda at: F.try_variant_get("v", at, kind)
    new = block("$.components.schemas")
    parsed = files.select("path", F.try_parse_json(F.col("text")).alias("v"))
    found = parsed.select("path", F.explode(F.when(F.size(new) > 0, new).otherwise(block("$.definitions"))).alias("name", "schema"))
    said = F.nullif(F.try_variant_get("schema", "$.description", "string"), F.lit(""))
    doc = F.coalesce(said, F.concat(F.lit("Data model schema for "), "name"))
    return found.select(F.concat(F.lit(_owner(repo) + "schema:"), "name").alias("id"), "name", "path", doc.alias("docstring"))


def sections(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of Markdown (path, text): a document by its first title,
    or its file's name, with its lines and words, and its sections of the
    second and third level, which it contains."""
    x = _lines(files)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    title = x.filter(F.col("line").startswith("# ")).groupBy("path").agg(F.min_by("line", "no").alias("t"))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    doc = files.select("path", words.alias("words"), F.size(F.split("text", r"\r?\n")).alias("lines")).join(title, "path", "left")
    name = lambda c: F.trim(F.regexp_replace(c, r"^[# ]+", ""))
    doc_id = F.concat(F.lit("doc:"), F.col("path"))
    docs = doc.select(doc_id.alias("id"), F.coalesce(name(F.col("t")), stem).alias("name"), F.lit("doc").alias("node_type"), "path", F.lit(1).alias("start_line"), F.col("lines").alias("end_line"), "words")
    part = x.filter(F.col("line").rlike("^###? ")).withColumn("name", name(F.col("line")))
    part = part.withColumn("id", F.concat(F.lit("section:"), "path", F.lit(":"), F.replace(F.lower("name"), F.lit(" "), F.lit("_"))))
    none = F.lit(None).cast("int")
    nodes = part.groupBy("id").agg(F.min(F.struct("no", "name", "path")).alias("m")).select("id", "m.name", F.lit("concept").alias("node_type"), "m.path", F.col("m.no").alias("start_line"), none.alias("end_line"), none.alias("words"))
    edges = part.select(doc_id.alias("source_id"), F.col("id").alias("target_id"), F.lit("contains").alias("edge_type"), F.lit("extracted").alias("provenance")).distinct()
    return docs.unionByName(nodes), edges


def specification_edges(specs: DataFrame) -> DataFrame:
    """Edges of stories to their criteria and tasks, told by their ids."""
    owner = F.concat(F.lit("story:"), F.split("id", ":")[1])
    kinds = specs.filter("kind IN ('criterion', 'task')")
    return kinds.select(owner.alias("source_id"), F.col("id").alias("target_id"), F.lit("contains").alias("edge_type")).filter("source_id <> 'story:'").distinct()


def headers(files: DataFrame) -> DataFrame:
    """path, status, milestone of Markdown specs: the first line of each."""
    x = _lines(files)
    pattern = r"(?i)^\s*[-*>]*\s*\**(status|milestone)\**\s*:\s*\**\s*(.+?)\s*$"
    found = x.filter(F.col("line").rlike(pattern)).select("path", "no", F.lower(F.regexp_extract("line", pattern, 1)).alias("k"), F.regexp_replace(F.regexp_extract("line", pattern, 2), r"^\*+|\*+$", "").alias("v"))
    first = lambda k: F.min_by(F.when(F.col("k") == k, F.trim("v")), F.when(F.col("k") == k, F.col("no"))).alias(k)
    return files.select("path").join(found.groupBy("path").agg(first("status"), first("milestone")), "path", "left").select("path", "status", "milestone")


def openapi_yaml_endpoints(files: DataFrame, repo: str) -> DataFrame:
    """id, name, method, route of OpenAPI documents in YAML (path, text): the
    methods below each route of the block ``paths``."""
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    key = r"^(\s*)['\"]?([^\s'\":#][^'\":#]*)['\"]?\s*:"
    x = _lines(files).filter(F.col("line").rlike(key)).withColumn("indent", F.length(F.regexp_extract("line", key, 1))).withColumn("key", F.trim(F.regexp_extract("line", key, 2)))
    x = x.withColumn("top", F.last(F.when(F.col("indent") == 0, F.col("key")), ignorenulls=True).over(w))
    route = F.struct("indent", F.col("key").alias("route"))
    x = x.filter("top = 'paths'").withColumn("at", F.last(F.when(F.col("key").startswith("/"), route), ignorenulls=True).over(w))
    verbs = F.lower("key").isin("get", "put", "post", "delete", "patch", "head", "options")
    # a method stands one step below its route: nothing between them in depth
    below = x.filter(verbs & (F.col("indent") > F.col("at.indent")))
    step = F.min("indent").over(Window.partitionBy("path", "at"))
    below = below.withColumn("step", step).filter("indent = step")
    m = F.upper("key")
    return below.select(F.concat(F.lit(_owner(repo) + "endpoint:"), m, F.lit(":"), F.col("at.route")).alias("id"), F.concat_ws(" ", m, F.col("at.route")).alias("name"), m.alias("method"), F.col("at.route").alias("route")).distinct()
