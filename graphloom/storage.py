"""Cutting lineage of iterative operators through shared storage."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Whether shuffle files go at the end of the execution that made them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that Python gets at once, where the session leaves it at Spark's own
#: 10,000: rows may hold whole texts or sets.
BATCH, SPARKS_OWN, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset, a session on one machine gets a temporary folder; on
    a cluster, whose executors would not see it, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.gettempdir() + "/graphloom-shared"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """df written to the session's shared folder and read back.

    What the step shuffled is deleted once the table is there; nothing reads
    it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._graphloom_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete the folders of tables that cut() made and nothing will read again.

    Then the driver gives back what their plans and broadcasts held, which on
    a long run of steps is most of its memory."""
    for df in tables:
        if path := getattr(df, "_graphloom_path", None):
            jvm, context = df.sparkSession._jvm, df.sparkSession._jsc
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context.hadoopConfiguration()).delete(place, True)
    if tables:
        gc.collect()
        tables[0].sparkSession._jvm.System.gc()


def send_package(spark: SparkSession) -> None:
    """Send this package to the executors once a session, as they need not
    have it installed; and let Python's batches be small."""
    context = spark.sparkContext
    if spark.conf.get(BATCH, SPARKS_OWN) == SPARKS_OWN:
        spark.conf.set(BATCH, ROWS)
    if getattr(context, "_graphloom_sent", None) is None:
        root = Path(__file__).resolve().parent
        packed = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
        with zipfile.ZipFile(packed, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent).as_posix())
        context.addPyFile(str(packed))
        context._graphloom_sent = str(packed)


def map_arrow(df: DataFrame, body, schema) -> DataFrame:
    """df.mapInArrow with this package on the executors."""
    send_package(df.sparkSession)
    return df.mapInArrow(body, schema)
