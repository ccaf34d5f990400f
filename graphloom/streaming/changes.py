"""Changes of a folder as a stream: incremental indexing, debouncing, a guard."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.text import redact_secrets
from ..operators.order import running
from ..storage import cut, send_package
from .telemetry import fingerprints


def file_stream(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """A streaming DataFrame of the files below a folder, each path once, when it
    is new: path, modified, length, content.  What is written to a known path
    or deleted does not come; start_watching() lists the folder for that."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return rows.select("path", F.col("modificationTime").alias("modified"), "length", "content")


def changed_files(files: DataFrame, stored: DataFrame) -> DataFrame:
    """files (path, content, ...) with content_hash and change - added or
    modified - without those whose stored fingerprint is the same."""
    found = files.join(fingerprints(files), "path")
    was = stored.select("path", F.col("content_hash").alias("was"))
    return found.join(was, "path", "left").filter(~F.col("was").eqNullSafe(F.col("content_hash"))).withColumn("change", F.when(F.col("was").isNull(), "added").otherwise("modified")).drop("was")


def start_indexing(files: DataFrame, stored: Callable[[], DataFrame], index: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None):
    """Hand the changed files of each batch to index(files, batch), which also
    stores their fingerprints; unchanged ones are left out.

    A batch that runs again finds its fingerprints stored and changes nothing."""

    def run(batch: DataFrame, number: int) -> None:
        fresh = cut(changed_files(batch, stored()), "changed")
        if not fresh.isEmpty():
            index(fresh, number)

    return files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def listed_changes(spark: SparkSession, folder: str, stored: DataFrame, pattern: str = "*") -> DataFrame:
    """path, change (added, modified or deleted), content, content_hash of a
    folder's files against stored fingerprints; a deleted one has no content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", "content")
    found = files.join(fingerprints(files), "path")
    was = stored.select("path", F.col("content_hash").alias("was"))
    both = found.join(was, "path", "full_outer").filter(~F.col("was").eqNullSafe(F.col("content_hash")))
    change = F.when(F.col("content_hash").isNull(), "deleted").when(F.col("was").isNull(), "added").otherwise("modified")
    return both.select("path", change.alias("change"), "content", "content_hash")


def start_watching(spark: SparkSession, folder: str, stored: Callable[[], DataFrame], index: Callable[[DataFrame, int], None], checkpoint: str, pattern: str = "*", every: str = "1 second"):
    """List the folder at every tick and hand what changed to index(rows, tick),
    which also stores the new fingerprints and removes those of deleted files.

    The stream carries ticks only, so a restart lists the folder anew and misses
    nothing."""

    def tick(_: DataFrame, number: int) -> None:
        fresh = cut(listed_changes(spark, folder, stored(), pattern), "changed")
        if not fresh.isEmpty():
            index(fresh, number)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def _merged(bursts: list[list], quiet: int) -> list[list]:
    """Bursts [began, last, paths] in order, those joined that follow within quiet."""
    out: list[list] = []
    for began, last, paths in sorted(bursts, key=lambda b: b[:2]):
        if out and began - out[-1][1] <= quiet:
            out[-1][1] = max(out[-1][1], last)
            out[-1][2] |= paths
        else:
            out.append([began, last, set(paths)])
    return out


def debounced(changes: DataFrame, quiet: str = "500 milliseconds", late: str = "1 second", time: str = "modified", folder: Column | None = None) -> DataFrame:
    """A streaming DataFrame of bursts (folder, began, ended, paths) for output
    mode append: changes of a folder that follow each other within ``quiet``.

    Every folder has its own state and its own timer, which its changes set
    anew, so bursts of many folders run in many tasks; a folder's task holds
    the paths of its open bursts.  A burst comes out when the watermark has
    passed its end, ``quiet`` after its last change; what is open when the
    stream stops waits in the checkpoint, with its timer.  ``folder`` is what
    bursts go by: by default the path up to its last slash ('' if it has none).
    Changes later than ``late``, and those without a time or a path, are left
    to the next listing."""
    send_package(changes.sparkSession)
    wait = pd.Timedelta(quiet) // pd.Timedelta(microseconds=1)
    by = F.regexp_extract("path", r"^(.*)/[^/]*$", 1) if folder is None else folder
    rows = changes.withWatermark(time, late).filter(F.col("path").isNotNull() & F.col(time).isNotNull())
    rows = rows.select(F.coalesce(by, F.lit("")).alias("folder"), "path", F.col(time).alias("at"), F.unix_micros(time).alias("micros"))

    def settle(key, batches, state):
        bursts = [[began, last, set(paths)] for began, last, paths in json.loads(state.get[0])] if state.exists else []
        if not state.hasTimedOut:
            for batch in batches:
                bursts = _merged(bursts + [[int(m), int(m), {p}] for m, p in zip(batch["micros"], batch["path"])], wait)
        passed = state.getCurrentWatermarkMs() * 1000
        still = [b for b in bursts if b[1] + wait >= passed]
        if still:
            state.update((json.dumps([[began, last, sorted(paths)] for began, last, paths in still]),))
            state.setTimeoutTimestamp(min(b[1] + wait for b in still) // 1000 + 1)
        elif state.exists:
            state.remove()
        done = [b for b in bursts if b[1] + wait < passed]
        yield pd.DataFrame({"folder": [key[0]] * len(done), "began": [b[0] for b in done], "ended": [b[1] + wait for b in done], "paths": [sorted(b[2]) for b in done]})

    out = rows.groupBy("folder").applyInPandasWithState(settle, "folder string, began long, ended long, paths array<string>", "open string", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("folder", F.timestamp_micros("began").alias("began"), F.timestamp_micros("ended").alias("ended"), "paths")


def start_guard(changes: DataFrame, audit: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, trigger: dict | None = None):
    """Audit again for every batch of changes and keep the verdict: audit gets
    the batch and gives one row; status() reads the latest."""

    def run(batch: DataFrame, number: int) -> None:
        audit(batch).limit(1).withColumn("batch", F.lit(number)).withColumn("audited_at", F.current_timestamp()).coalesce(1).write.mode("overwrite").parquet(f"{folder}/batch={number:012d}/verdict")

    return changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def status(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict of the latest batch; no row where there was none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    done = sorted(p.getPath().toString() for p in fs.listStatus(place) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p.getPath().toString() + "/verdict/_SUCCESS"))) if fs.exists(place) else []
    return spark.read.parquet(f"{done[-1]}/verdict") if done else spark.createDataFrame([], "verdict string, batch int, audited_at timestamp")


def through_cache(requests: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame], most: int | None = None, most_tokens: int | None = None, used: int = 0) -> tuple[DataFrame, DataFrame]:
    """(answers, fresh): answers (key, content, cached) of requests (text), and
    the fresh ones to add to the cache (key, content, tokens).

    Requests go by the hash of their text without secrets, so equal ones are
    computed once; compute gets (key, text), secrets redacted, and gives (key,
    content).  ``most`` is a budget of requests to compute and ``most_tokens``
    one of tokens, of which ``used`` are spent: in order of their keys, those
    are computed whose texts fit together; others have no answer.  A text
    counts a token for four characters, and one at least; tokens, what a fresh
    answer adds to ``used``, counts text and content.  Cached ones are free."""
    tokens = lambda c: F.greatest(F.lit(1), F.expr(f"length(coalesce({c}, '')) div 4"))
    text = redact_secrets(F.coalesce("text", F.lit("")))
    asked = requests.select(text.alias("text")).select(F.sha2(F.col("text").cast("binary"), 256).alias("key"), "text").dropDuplicates(["key"])
    new = asked.join(cache.select("key"), "key", "left_anti")
    if most_tokens is not None:
        new = running(new, ["key"], tokens("text"), "__sum").filter(F.col("__sum") <= most_tokens - used).drop("__sum")
    new = new if most is None else new.orderBy("key").limit(most)
    new = cut(new, "requests")
    fresh = cut(compute(new).select("key", "content").join(new, "key").select("key", "content", (tokens("text") + tokens("content")).alias("tokens")), "answers")
    known = asked.select("key").join(cache.select("key", "content"), "key").withColumn("cached", F.lit(True))
    return known.unionByName(fresh.select("key", "content").withColumn("cached", F.lit(False))), fresh
