"""Graphs, spans and corpora over the star-schema tables, and graph views.

Every derived input exists once here; ``graphloom.plans.sql`` states the same
definitions as SQL for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .model import DEPENDENCY_TYPES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _null(kind: str, name: str):
    return F.lit(None).cast(kind).alias(name)


def supply_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, suppliers, customers and orders as nodes."""
    t = lambda n: table(spark, sf_dir, n)
    text = lambda c: F.col(c).cast("string")
    none = [_null("int", "start_line"), _null("int", "end_line"), _null("string", "docstring")]
    parts = [
        t("region").select(F.concat(F.lit("r:"), text("r_regionkey")).alias("id"), F.col("r_name").alias("name"), F.lit("service").alias("node_type"), F.concat(F.lit("core/"), F.lower("r_name")).alias("path"), *none),
        t("nation").select(F.concat(F.lit("n:"), text("n_nationkey")), "n_name", F.lit("module"), F.concat(F.lit("graph/nation_"), text("n_nationkey"), F.lit(".py")), *none),
        t("supplier").select(F.concat(F.lit("s:"), text("s_suppkey")), "s_name", F.lit("class"), F.concat(F.lit("parser/nation_"), text("s_nationkey"), F.lit(".py")), *none),
        t("customer").select(
            F.concat(F.lit("c:"), text("c_custkey")), "c_name", F.lit("function"), F.concat(F.lit("cli/nation_"), text("c_nationkey"), F.lit(".py")),
            (F.col("c_custkey") % 1000 * 10 + 1).cast("int"), (F.col("c_custkey") % 1000 * 10 + 4 + F.col("c_custkey") % 7).cast("int"), "c_mktsegment",
        ),
        t("orders").select(F.concat(F.lit("o:"), text("o_orderkey")), F.concat(F.lit("order "), text("o_orderkey")), F.lit("endpoint"), F.concat(F.lit("tests/priority_"), F.substring("o_orderpriority", 1, 1), F.lit(".py")), *none),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n imports r, s inherits n, c calls n, o verifies or routes_to c, and each
    nation calls its customer with the highest balance."""
    t = lambda n: table(spark, sf_dir, n)
    ref = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    key = t("customer").groupBy("c_nationkey").agg(F.max(F.struct("c_acctbal", "c_custkey")).alias("k"))
    parts = [
        t("nation").select(ref("n:", "n_nationkey").alias("source_id"), ref("r:", "n_regionkey").alias("target_id"), F.lit("imports").alias("edge_type")),
        t("supplier").select(ref("s:", "s_suppkey"), ref("n:", "s_nationkey"), F.lit("inherits")),
        t("customer").select(ref("c:", "c_custkey"), ref("n:", "c_nationkey"), F.lit("calls")),
        t("orders").select(ref("o:", "o_orderkey"), ref("c:", "o_custkey"), F.when(F.col("o_orderstatus") == "F", "verifies").otherwise("routes_to")),
        key.select(ref("n:", "c_nationkey"), ref("c:", "k.c_custkey"), F.lit("calls")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.withColumn("provenance", F.lit("extracted"))


def trade_edges(spark: SparkSession, sf_dir: str, top: int = 4) -> DataFrame:
    """Supplier nation -> customer nation with the number of line items; the
    top targets of each source, ties by key.

    The fact table is counted by (order, supplier) side keys before nations
    are joined on, so only counts travel."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("tgt"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("src"))
    pairs = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    counts = pairs.groupBy("src", "tgt").agg(F.count(F.lit(1)).alias("weight"))
    w = Window.partitionBy("src").orderBy(F.desc("weight"), "tgt")
    return counts.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top).select("src", "tgt", "weight")


def trade_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))


def line_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and parts as nodes: id."""
    ref = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("id")
    return table(spark, sf_dir, "supplier").select(ref("s:", "s_suppkey")).union(table(spark, sf_dir, "part").select(ref("p:", "p_partkey")))


def line_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier -> part for every line item, and part -> supplier for those
    that came back: source_id, target_id, parallel edges included."""
    line = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s:"), F.col("l_suppkey").cast("string")).alias("s"), F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("p"), "l_returnflag")
    there = line.select(F.col("s").alias("source_id"), F.col("p").alias("target_id"))
    return there.union(line.filter("l_returnflag = 'R'").select("p", "s"))


def order_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An acyclic graph of orders, parts, suppliers, nations and regions:
    source_id, target_id, parallel edges included.  Orders lead to the parts and suppliers of their
    lines and to their customer's region, parts to the suppliers they came
    back to, suppliers to nations, nations to regions."""
    t = lambda n: table(spark, sf_dir, n)
    ref = lambda p, c, name: F.concat(F.lit(p), F.col(c).cast("string")).alias(name)
    edge = lambda df, a, b: df.select(ref(f"{a[0]}:", a[1], "source_id"), ref(f"{b[0]}:", b[1], "target_id"))
    line, nation = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag"), t("nation")
    buyer = t("orders").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(nation.select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    parts = [
        edge(line, ("o", "l_orderkey"), ("p", "l_partkey")),
        edge(line, ("o", "l_orderkey"), ("s", "l_suppkey")),
        edge(line.filter("l_returnflag = 'R'"), ("p", "l_partkey"), ("s", "l_suppkey")),
        edge(t("supplier"), ("s", "s_suppkey"), ("n", "s_nationkey")),
        edge(nation, ("n", "n_nationkey"), ("r", "n_regionkey")),
        edge(buyer, ("o", "o_orderkey"), ("r", "n_regionkey")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def customer_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of 6 to 12 customers: source_id, target_id.  Of each 12 customers
    in a row the first 6 + block % 7 call each other in turn."""
    c = table(spark, sf_dir, "customer").select(F.expr("c_custkey div 12").alias("block"), (F.col("c_custkey") % 12).alias("i")).withColumn("size", 6 + F.col("block") % 7)
    key = lambda i: (F.col("block") * 12 + i).cast("long")
    return c.filter("i < size").select(key(F.col("i")).alias("source_id"), key((F.col("i") + 1) % F.col("size")).alias("target_id"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as spans: the service is the event type, the parent is the user's
    previous event, the trace is the user."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").cast("string").alias("trace_id"), F.col("event_id").alias("span_id"), F.lag("event_id").over(w).alias("parent_span_id"),
        F.col("event_type").alias("service_name"), F.concat(F.lit("op_"), (F.col("event_id") % 13).cast("string")).alias("name"), F.col("value").alias("duration_ms"), (F.col("event_type") == "error").alias("is_error"), "ts",
    )


# --- graph views ---------------------------------------------------------


def closed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends are both nodes; duplicates and loops stay."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def with_metadata(rows: DataFrame) -> DataFrame:
    """rows with metadata_json parsed, as ``metadata``; null for no JSON."""
    return rows.withColumn("metadata", F.try_parse_json("metadata_json"))


def of_type(nodes: DataFrame, *kinds: str) -> DataFrame:
    """Nodes of the given types."""
    return nodes.filter(F.col("node_type").isin(*kinds))


def dependency(edges: DataFrame) -> DataFrame:
    """Edges of the types that make the dependency graph."""
    return edges.filter(F.col("edge_type").isin(DEPENDENCY_TYPES))


def simple_undirected(edges: DataFrame, source: str = "source_id", target: str = "target_id") -> DataFrame:
    """(u, v) with u < v, each connected pair once, no loops."""
    return edges.filter(F.col(source) != F.col(target)).select(F.least(source, target).alias("u"), F.greatest(source, target).alias("v")).distinct()


def both_directions(pairs: DataFrame) -> DataFrame:
    """(a, b) and (b, a) of each undirected pair (u, v)."""
    return pairs.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))).alias("p")).select("p.a", "p.b")
