"""Keyed tables: logs in buckets, folding, crashes, additive telemetry, packed vectors."""

import os

import pytest
from pyspark.sql import functions as F

from graphloom import stores
from graphloom.streaming import telemetry as streaming

TELEMETRY = "node_id string, call_count long, total_duration_ms double, p95_duration_ms double, error_count long"


def kv(spark, *rows):
    return spark.createDataFrame(list(rows), "key string, value string")


def rows_of(df):
    return {r["key"]: r["value"] for r in df.collect()}


def test_a_write_touches_the_buckets_of_its_keys(spark, tmp_path):
    folder = f"file://{tmp_path}"
    stores.save(spark.range(200).select(F.col("id").cast("string").alias("key"), F.lit("a").alias("value")), folder, "settings", buckets=8)
    before = stores.manifest(spark, folder, "settings")
    assert before.buckets == 8 and len(before.segments) == 8
    stores.save(kv(spark, ("7", "b")), folder, "settings", buckets=3)
    after = stores.manifest(spark, folder, "settings")
    assert after.buckets == 8 and [b for b in after.segments if after.segments[b] != before.segments[b]] == [b for b in after.segments if len(after.segments[b]) == 2]
    assert sum(len(s) for s in after.segments.values()) == 9
    got = rows_of(stores.load(spark, folder, "settings"))
    assert len(got) == 200 and {k for k, v in got.items() if v == "b"} == {"7"}
    found = stores.lookup(spark, folder, "settings", kv(spark, ("7", ""), ("none", "")))
    assert rows_of(found) == {"7": "b"}
    read = {f.split("/data/")[1].split("/")[1] for f in stores._read(spark, folder, "settings", after, ["3"]).inputFiles()}
    assert read == {"bucket=3"}


def test_any_order_of_changes_matches_a_dictionary(spark, tmp_path):
    folder, want = f"file://{tmp_path}", {}
    for turn in range(12):
        rows = [(str(k), f"{turn}:{k}") for k in range(turn, 30, 4)]
        if turn % 3 == 2:
            stores.remove(spark, folder, "settings", kv(spark, *rows).select("key"))
            for k, _ in rows:
                want.pop(k, None)
        else:
            stores.save(kv(spark, *rows), folder, "settings", buckets=2)
            want.update(rows)
    now = stores.manifest(spark, folder, "settings")
    assert rows_of(stores.load(spark, folder, "settings")) == want
    assert all(len(s) <= stores.SEGMENTS for s in now.segments.values()) and now.number > 12
    stores.fold(spark, folder, "settings")
    assert rows_of(stores.load(spark, folder, "settings")) == want
    assert stores.vacuum(spark, folder, "settings", keep=1) > 0 and rows_of(stores.load(spark, folder, "settings")) == want
    assert all(len(s) == 1 for s in stores.manifest(spark, folder, "settings").segments.values())


def test_a_crash_leaves_the_old_version(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}"
    stores.save(kv(spark, ("a", "1")), folder, "settings")
    now = stores.manifest(spark, folder, "settings")
    with monkeypatch.context() as m:
        m.setattr(stores, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            stores.save(kv(spark, ("a", "2")), folder, "settings")
    assert rows_of(stores.load(spark, folder, "settings")) == {"a": "1"}
    # another writer was faster: this one's version is taken
    stores.save(kv(spark, ("b", "3")), folder, "settings")
    with pytest.raises(RuntimeError, match="another writer"):
        stores._append(kv(spark, ("a", "4")).withColumn("__op", F.lit(stores.PUT)), folder, "settings", now)
    assert rows_of(stores.load(spark, folder, "settings")) == {"a": "1", "b": "3"}
    assert stores.vacuum(spark, folder, "settings") == 2
    assert len(os.listdir(f"{tmp_path}/settings/data")) == 2
    stores.save(kv(spark, ("a", "5")), folder, "settings")
    assert rows_of(stores.load(spark, folder, "settings")) == {"a": "5", "b": "3"}


def test_telemetry_adds_up_once_a_batch(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    for i, rows in enumerate(([("a", 2, 10.0, 7.0, 1)], [("a", 3, 5.0, 4.0, 0), ("b", 1, 1.0, 1.0, 0)], [("a", 1, 1.0, 9.0, 1), ("a", 1, 2.0, 1.0, 0)])):
        spark.createDataFrame(rows, TELEMETRY).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        q = streaming.start_storing(spark.readStream.schema(TELEMETRY).json(f"{tmp_path}/in"), folder, "spans", f"{tmp_path}/ck", {"availableNow": True})
        q.awaitTermination(120)
    load = lambda: {r["node_id"]: (r["call_count"], r["total_duration_ms"], r["p95_duration_ms"], r["error_count"], r["avg_duration_ms"]) for r in stores.load(spark, folder, "telemetry").collect()}
    want = {"a": (7, 18.0, 9.0, 2, 18 / 7), "b": (1, 1.0, 1.0, 0, 1.0)}
    assert load() == want
    assert not stores.add(spark.createDataFrame([("a", 9, 9.0, 9.0, 9)], TELEMETRY), folder, "spans", 2) and load() == want
    stores.fold(spark, folder, "telemetry")
    assert load() == want
    stores.save(spark.createDataFrame([("a", 1, 4.0, 4.0, 0)], TELEMETRY), folder, "telemetry")
    stores.add(spark.createDataFrame([("a", 1, 2.0, 2.0, 0), ("c", 0, 0.0, 0.0, 0)], TELEMETRY), folder)
    assert load() == {"a": (2, 6.0, 4.0, 0, 3.0), "b": want["b"], "c": (0, 0.0, 0.0, 0, 0.0)}
    stores.remove(spark, folder, "telemetry", spark.createDataFrame([("a",)], "node_id string"))
    assert set(load()) == {"b", "c"}


def test_vectors_pack_as_flat_buffers(spark):
    rows = [("n", [0.5, -1.25]), ("m", None), ("e", []), ("o", [1.0])] * 7
    v = spark.createDataFrame(rows, "node_id string, vector array<float>").coalesce(1)
    packed = stores.pack_vectors(v)
    assert [None if r["vector"] is None else len(r["vector"]) for r in packed.collect()] == [8, None, 0, 4] * 7
    assert [(r["node_id"], r["vector"]) for r in stores.unpack_vectors(packed).collect()] == rows
    assert stores.pack_vectors(v.limit(0)).count() == 0
    assert stores.unpack_vectors(stores.pack_vectors(v.filter("vector IS NULL"))).filter("vector IS NULL").count() == 7


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(60_000).select(F.col("id").cast("string").alias("path"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("content_hash"))
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "300k")
    try:
        stores.save(rows, f"file://{tmp_path}", "fingerprints", buckets=2)
    finally:
        spark.conf.unset(size)
    for bucket in (0, 1):
        assert len(list(tmp_path.glob(f"fingerprints/data/*/bucket={bucket}/*.parquet"))) > 1
    assert stores.load(spark, f"file://{tmp_path}", "fingerprints").count() == 60_000
    found = stores.lookup(spark, f"file://{tmp_path}", "fingerprints", rows.filter("path IN ('7', '59999')"))
    assert sorted(r["path"] for r in found.collect()) == ["59999", "7"]
