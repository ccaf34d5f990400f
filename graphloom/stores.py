"""Keyed tables in a folder: embeddings, fingerprints, settings, repositories, baselines.

A table is a log of changes in buckets by the hash of the key.  A write adds a
segment to the buckets of its keys and touches no other; a manifest then names
the segments of every bucket, in order, so a write is seen whole or not at all,
and what a crashed one left is named by none.  Reading settles each key by its
last change; buckets of one segment are read as they are.  A bucket of more
than SEGMENTS segments is folded into one.

A write takes its number by a claim that only one writer can make; the other
one gets an error, has changed nothing and may write again.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .model import EMBEDDINGS, FINGERPRINTS, REPOSITORIES, TELEMETRY
from .operators.telemetry import merge_telemetry
from .sinks import last_wins
from .storage import map_arrow

#: Tables, their schemas and keys.
TABLES = {
    "embeddings": (EMBEDDINGS.simpleString()[7:-1], "node_id"),
    "fingerprints": (FINGERPRINTS.simpleString()[7:-1], "path"),
    "settings": ("key:string,value:string", "key"),
    "repositories": (REPOSITORIES.simpleString()[7:-1], "name"),
    "telemetry": (TELEMETRY.simpleString()[7:-1], "node_id"),
    "baselines": ("node_id:string,p50_duration_ms:double,p95_duration_ms:double,p99_duration_ms:double,throughput:double,tag:string", "node_id"),
}
#: Buckets of a new table, unless the first write says otherwise: one task
#: settles a bucket, so take about one per GB.
BUCKETS = 64
#: Segments of a bucket before it is folded.
SEGMENTS = 8
#: What a row of the log does.
PUT, DELETE, ADD = 0, 1, 2


class Taken(RuntimeError):
    """Another writer has the number of this write."""


@dataclass
class Manifest:
    """A version of a table: segments by bucket, oldest first, and the last
    batch that each stream added."""

    number: int = 0
    buckets: int = BUCKETS
    segments: dict[str, list[str]] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


def _schema(table: str) -> str:
    return ", ".join(f"`{n}` {k}" for n, k in (x.split(":", 1) for x in _split(TABLES[table][0])))


def _split(spec: str) -> list[str]:
    """Fields of a struct's simple string; commas within types stay."""
    out, depth = [""], 0
    for c in spec:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder; none where there is no folder."""
    fs, place = _place(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def _numbers(spark: SparkSession, root: str) -> list[int]:
    return [int(n[:-5]) for n in _names(spark, f"{root}/manifests") if n.endswith(".json")]


def manifest(spark: SparkSession, folder: str, table: str, number: int | None = None) -> Manifest:
    """The newest version of a table, or the one of that number."""
    root = f"{folder}/{table}"
    if number is None:
        number = max(_numbers(spark, root), default=None)
    if number is None:
        return Manifest()
    fs, place = _place(spark, f"{root}/manifests/{number:012d}.json")
    stream = fs.open(place)
    try:
        return Manifest(**json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


def _commit(spark: SparkSession, folder: str, table: str, new: Manifest) -> None:
    """Publish a version; an error where another writer took its number."""
    root = f"{folder}/{table}/manifests"
    fs, claim = _place(spark, f"{root}/{new.number:012d}.claim")
    if not fs.createNewFile(claim):
        raise Taken(f"another writer has taken version {new.number} of {table}: write again, or vacuum() after a crash")
    _, draft = _place(spark, f"{root}/{new.number:012d}.draft")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(json.dumps(new.__dict__).encode()))
    finally:
        out.close()
    if not fs.rename(draft, _place(spark, f"{root}/{new.number:012d}.json")[1]):
        raise RuntimeError(f"version {new.number} of {table} could not be published")


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def _write_segment(rows: DataFrame, folder: str, table: str, number: int, buckets: int) -> tuple[str, list[str]]:
    """(name, buckets) of a new segment of rows (the table's columns and __op)."""
    name = f"{number:012d}-{uuid.uuid4().hex}"
    dealt = rows.withColumn("__seq", F.lit(number).cast("long")).withColumn("bucket", _bucket(TABLES[table][1], buckets))
    path = f"{folder}/{table}/data/{name}"
    # a bucket that is large for a task is written by several
    dealt.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
    return name, [n[7:] for n in _names(rows.sparkSession, path) if n.startswith("bucket=")]


def _read(spark: SparkSession, folder: str, table: str, now: Manifest, wanted: list[str]) -> DataFrame:
    """The settled rows of some buckets."""
    key, columns = TABLES[table][1], [x.split(":", 1)[0] for x in _split(TABLES[table][0])]
    logged = f"{_schema(table)}, `__op` int, `__seq` long"
    paths = lambda buckets: [f"{folder}/{table}/data/{s}/bucket={b}" for b in buckets for s in now.segments[b]]
    single = [b for b in wanted if len(now.segments.get(b, [])) == 1]
    several = [b for b in wanted if len(now.segments.get(b, [])) > 1]
    parts = []
    if single:
        parts.append(spark.read.schema(logged).parquet(*paths(single)).filter(f"__op <> {DELETE}").select(*columns))
    if several:
        rows = spark.read.schema(logged).parquet(*paths(several))
        if table == "telemetry":
            parts.extend(_settled_sums(rows, key, columns))
        else:
            parts.append(last_wins(rows, key, "__seq").filter(f"__op <> {DELETE}").select(*columns))
    if not parts:
        return spark.createDataFrame([], _schema(table))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _settled_sums(rows: DataFrame, key: str, columns: list[str]) -> list[DataFrame]:
    """Of each key the last row put and what was added since, as parts of the
    table.  A key has at most one row a segment, so its window is short."""
    w = Window.partitionBy(key)
    last = F.coalesce(F.max(F.when(F.col("__op") != ADD, F.col("__seq"))).over(w), F.lit(-1))
    live = rows.withColumn("__last", last).filter(f"__seq >= __last AND __op <> {DELETE}").withColumn("__adds", F.max((F.col("__op") == ADD).cast("int")).over(w))
    return [live.filter("__adds = 0").select(*columns), merge_telemetry(live.filter("__adds = 1")).select(*columns)]


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """The rows of a table; none where it was never written."""
    now = manifest(spark, folder, table)
    return _read(spark, folder, table, now, list(now.segments))


def lookup(spark: SparkSession, folder: str, table: str, keys: DataFrame) -> DataFrame:
    """The rows of the keys (a column of the key's name), from their buckets only."""
    now, key = manifest(spark, folder, table), TABLES[table][1]
    hit = [str(r["b"]) for r in keys.select(_bucket(key, now.buckets).alias("b")).distinct().collect()]
    return _read(spark, folder, table, now, hit).join(keys.select(key), key, "left_semi")


def _append(rows: DataFrame, folder: str, table: str, now: Manifest) -> None:
    """Add a segment, then fold the buckets that have too many."""
    spark, number = rows.sparkSession, now.number + 1
    name, hit = _write_segment(rows, folder, table, number, now.buckets)
    new = Manifest(number, now.buckets, {**now.segments, **{b: [*now.segments.get(b, []), name] for b in hit}}, now.batches)
    _commit(spark, folder, table, new)
    if full := [b for b in hit if len(new.segments[b]) > SEGMENTS]:
        # where another writer is at work, the next one folds
        with contextlib.suppress(Taken):
            fold(spark, folder, table, full)


def fold(spark: SparkSession, folder: str, table: str, buckets: list[str] | None = None) -> None:
    """Make one segment of each of the buckets, or of all that have several."""
    now = manifest(spark, folder, table)
    buckets = [b for b, s in now.segments.items() if len(s) > 1] if buckets is None else buckets
    if not buckets:
        return
    rows = _read(spark, folder, table, now, buckets).withColumn("__op", F.lit(PUT))
    name, kept = _write_segment(rows, folder, table, now.number + 1, now.buckets)
    segments = {b: s for b, s in now.segments.items() if b not in buckets} | {b: [name] for b in kept}
    _commit(spark, folder, table, Manifest(now.number + 1, now.buckets, segments, now.batches))


def _fresh(rows: DataFrame, table: str) -> DataFrame:
    """rows with the table's columns; what they lack is null."""
    wanted = [x.split(":", 1) for x in _split(TABLES[table][0])]
    return rows.select(*((F.col(n) if n in rows.columns else F.lit(None)).cast(k).alias(n) for n, k in wanted))


def _version(spark: SparkSession, folder: str, table: str, buckets: int | None) -> Manifest:
    """The newest version; a table that is not there yet gets so many buckets."""
    now = manifest(spark, folder, table)
    if buckets and not now.number:
        now.buckets = buckets
    return now


def save(rows: DataFrame, folder: str, table: str, buckets: int | None = None) -> None:
    """Add rows to a table; a row replaces the stored one of its key, columns
    that are missing are null.  Repeated keys among the rows: the last by hash."""
    fresh = _fresh(rows, table)
    once = last_wins(fresh.withColumn("__same", F.lit(0)), TABLES[table][1], "__same").select(*fresh.columns)
    _append(once.withColumn("__op", F.lit(PUT)), folder, table, _version(rows.sparkSession, folder, table, buckets))


def add(rows: DataFrame, folder: str, stream: str | None = None, batch: int = 0, buckets: int | None = None) -> bool:
    """Add telemetry rows to what is stored: counts and totals add up, as in
    merge_telemetry.  Only the sums of these rows are written.

    A batch of a stream that was added before, or one before it, changes
    nothing; whether the rows were added is returned."""
    now = _version(rows.sparkSession, folder, "telemetry", buckets)
    if stream is not None:
        if batch <= now.batches.get(stream, -1):
            return False
        now.batches = {**now.batches, stream: batch}
    sums = _fresh(merge_telemetry(_fresh(rows, "telemetry")), "telemetry")
    _append(sums.withColumn("__op", F.lit(ADD)), folder, "telemetry", now)
    return True


def remove(spark: SparkSession, folder: str, table: str, keys: DataFrame | None = None) -> None:
    """Remove the rows of the keys (a column of the key's name), or all."""
    now = manifest(spark, folder, table)
    if keys is None:
        _commit(spark, folder, table, Manifest(now.number + 1, now.buckets, {}, now.batches))
    elif now.segments:
        key = TABLES[table][1]
        _append(_fresh(keys.select(key).distinct(), table).withColumn("__op", F.lit(DELETE)), folder, table, now)


def vacuum(spark: SparkSession, folder: str, table: str, keep: int = 2) -> int:
    """Delete what none of the newest versions names - old versions, folded
    segments, what crashed writers left - and return the number of segments
    deleted.  No writer may be at work, nor a reader of an older version."""
    root = f"{folder}/{table}"
    numbers = sorted(_numbers(spark, root))[-max(keep, 1):]
    named = {s for n in numbers for held in manifest(spark, folder, table, n).segments.values() for s in held}
    stale = [f"data/{n}" for n in _names(spark, f"{root}/data") if n not in named]
    for name in stale + [f"manifests/{n}" for n in _names(spark, f"{root}/manifests") if n.split(".")[-1] != "json" or int(n[:-5]) not in numbers]:
        fs, place = _place(spark, f"{root}/{name}")
        fs.delete(place, True)
    return len(stale)


def pack_vectors(rows: DataFrame, vector: str = "vector") -> DataFrame:
    """rows with the vector as little-endian 32-bit floats; null stays null, a
    null within a vector is not a number.  A batch's floats stay one buffer."""
    at = rows.columns.index(vector)

    def run(batches):
        for batch in batches:
            lists = batch.column(at).cast(pa.list_(pa.float32()))
            data = lists.values.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype("<f4", copy=False)
            yield batch.set_column(at, vector, _laid(lists, data, lists.offsets.to_numpy() * 4, lambda ends, body, gone: pa.Array.from_buffers(pa.binary(), len(lists), [gone, ends, body])))

    return map_arrow(rows, run, _with(rows, vector, "binary"))


def unpack_vectors(rows: DataFrame, vector: str = "vector") -> DataFrame:
    """rows with packed vectors as arrays of floats again; bytes that are no
    whole number of floats are an error."""
    at = rows.columns.index(vector)

    def run(batches):
        for batch in batches:
            packed = batch.column(at).cast(pa.large_binary())
            _, ends, body = packed.buffers()
            ends = np.frombuffer(ends, "<i8")[packed.offset : packed.offset + len(packed) + 1]
            if (np.diff(ends) % 4).any():
                raise ValueError("a packed vector is no whole number of 32-bit floats")
            data = np.frombuffer(body or b"", np.uint8)[ends[0] : ends[-1]].view("<f4")
            yield batch.set_column(at, vector, _laid(packed, data, (ends - ends[0]) // 4, lambda ends, body, gone: pa.Array.from_buffers(pa.list_(pa.float32()), len(packed), [gone, ends], children=[pa.array(data)])))

    return map_arrow(rows, run, _with(rows, vector, "array<float>"))


def _laid(old: pa.Array, data: np.ndarray, ends: np.ndarray, build) -> pa.Array:
    """What build makes of old's ends as 32-bit numbers, data and null bits."""
    if ends[-1] >= 1 << 31:
        raise ValueError("a batch of vectors has more than 2 GiB: lower spark.sql.execution.arrow.maxRecordsPerBatch")
    valid = np.packbits(old.is_valid().to_numpy(zero_copy_only=False), bitorder="little")
    return build(pa.py_buffer(ends.astype("<i4")), pa.py_buffer(data), pa.py_buffer(valid))


def _with(rows: DataFrame, column: str, kind: str) -> str:
    return ", ".join(f"`{f.name}` {kind if f.name == column else f.dataType.simpleString()}" for f in rows.schema.fields)
