"""What each language's extraction covers, taken from the extractors themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .code import PATTERNS

#: Families that are not read by line patterns: extensions, tier, kinds.
OTHERS = (
    ("python", "py", "full_ast", "class function import endpoint table topic"),
    ("markdown", "md", "specialized", "story criterion task adr doc concept"),
    ("diagram", "mmd mermaid puml plantuml excalidraw", "specialized", "concept"),
)


def capabilities(spark: SparkSession) -> DataFrame:
    """family, extensions, coverage_tier, kinds of every language family."""
    by: dict[str, tuple[set[str], set[str]]] = {}
    for family, extensions, kind, _ in PATTERNS:
        e, k = by.setdefault(family, (set(), set()))
        e.update(extensions.split())
        k.add(kind)
    rows = [(f, sorted(e), "limited_fallback", sorted(k)) for f, (e, k) in by.items()]
    rows += [(f, sorted(e.split()), tier, sorted(k.split())) for f, e, tier, k in OTHERS]
    return spark.createDataFrame(sorted(rows), "family string, extensions array<string>, coverage_tier string, kinds array<string>")


def coverage(registry: DataFrame) -> DataFrame:
    """coverage_tier, families, extensions: how many each tier has."""
    return registry.groupBy("coverage_tier").agg(F.count(F.lit(1)).alias("families"), F.sum(F.size("extensions")).alias("extensions"))


def family_of(paths: DataFrame, registry: DataFrame) -> DataFrame:
    """path, family, coverage_tier by the file's extension; null for unknown ones."""
    known = registry.select(F.explode("extensions").alias("ext"), "family", "coverage_tier").groupBy("ext").agg(F.min(F.struct("family", "coverage_tier")).alias("m"))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return paths.withColumn("ext", ext).join(known, "ext", "left").select("path", F.col("m.family").alias("family"), F.col("m.coverage_tier").alias("coverage_tier"))
