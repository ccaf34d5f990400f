"""Structured Streaming: additive telemetry and incremental indexing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import stores
from ..operators.governance import freshness
from ..operators.telemetry import merge_telemetry


def running_telemetry(batches: DataFrame) -> DataFrame:
    """A streaming DataFrame of telemetry rows as running totals per node; for
    output mode update or complete.  All merges are order-insensitive."""
    return merge_telemetry(batches)


def span_totals(spans: DataFrame) -> DataFrame:
    """A streaming DataFrame of spans as running telemetry per service.

    The 95th percentile of a stream is the largest of its batches, so a span's
    own duration stands in for its batch."""
    rows = spans.select(F.col("service_name").alias("node_id"), F.lit(1).cast("long").alias("call_count"), F.col("duration_ms").alias("total_duration_ms"), F.col("duration_ms").alias("p95_duration_ms"), F.col("is_error").cast("long").alias("error_count"))
    return merge_telemetry(rows)


def start_merging(batches: DataFrame, publish: Callable[[DataFrame, int], None], checkpoint: str, trigger: str = "1 second"):
    """Run the merge and hand each update to publish(rows, batch)."""
    return running_telemetry(batches).writeStream.outputMode("update").foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()


def start_storing(batches: DataFrame, folder: str, name: str, checkpoint: str, trigger: dict | None = None):
    """Add each batch of telemetry rows to the stored table of the folder; only
    the buckets of its nodes are written.  The table knows the last batch of a
    stream by its name, so one that runs again adds nothing."""

    def run(batch: DataFrame, number: int) -> None:
        stores.add(batch, folder, name, number)

    return batches.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def changes(stored: DataFrame, found: DataFrame) -> DataFrame:
    """path, change between two listings: added, modified or deleted."""
    name = F.create_map(F.lit("unindexed"), F.lit("added"), F.lit("stale"), F.lit("modified"), F.lit("missing"), F.lit("deleted"))
    return freshness(stored, found).filter("state <> 'verified'").select("path", name[F.col("state")].alias("change"))


def fingerprints(files: DataFrame) -> DataFrame:
    """path, content_hash of files (path, content)."""
    return files.select("path", F.sha2("content", 256).alias("content_hash"))
