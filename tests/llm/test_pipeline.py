"""The pipeline on a small fixture with planted cases."""

import random

import corpus_pipeline

from graphloom.llm.queries import ORACLE_SQL, QUERIES


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def test_stages(spark, tmp_path):
    rows = [(i, words(i, 80), "en", f"s{i % 3}") for i in range(240)]
    for i in range(0, 240, 8):
        rows[i] = (i, rows[i][1] + " vilest", "en", "s0")
    base = words(7000, 120)
    rows += [(300 + i, base + f" tail{i}", "en", "s1") for i in range(5)]
    item = words(8000, 25)
    rows += [(400, words(1, 9) + "x " + item + " " + words(2, 40), "en", "s2"), (401, "123 456", "en", "s2"), (402, None, None, None)]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = d
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == d.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    want = {i for i in range(240) if i % 8} | {300}
    assert ids == want and set(got) <= want and len(got) > 100


def test_undetermined_documents(spark):
    schema = "doc_id long, text string, lang string"
    mixed = lambda i, a: "".join(random.Random(i).choice(a) if k % 6 else " " for k in range(200))
    rows = [(i, mixed(i, "abcdefg" if i % 2 else "mnopqrs"), "xx" if i % 2 else "yy") for i in range(200)]
    odd = [(900, "日本語の文章です", None), (901, "12 34", None), (902, None, None)]
    got = corpus_pipeline.drop_undetermined(spark, spark.createDataFrame(rows + odd, schema), "")
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(200))
    unknown = spark.createDataFrame([(i, t, None) for i, t, _ in rows[:20] + odd], schema)
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_undetermined(spark, unknown, "").collect()) == [*range(20), 900]


def test_near_copies_are_rows_not_ids(spark):
    schema = "doc_id long, text string, key long, sig string, __key string, __again int"
    a, b, c, d = (words(i, 40) for i in range(4))
    rows = [(1, a), (2, a), (2, b), (3, b), (3, c), (4, d), (4, d), (4, d), (5, None), (5, None), (6, ""), (None, d), (None, words(9, 40)), (7, "x y"), (8, "X  y")]
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame([(*r, 1, "s", "keep", 2) for r in rows], schema), "")
    assert got.columns == ["doc_id", "text", "key", "sig", "__key", "__again"]
    assert {(r["__key"], r["__again"]) for r in got.collect()} == {("keep", 2)}
    want = [(1, a), (2, b), (3, c), (4, d), (5, None), (5, None), (6, ""), (None, words(9, 40)), (7, "x y")]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(want, key=str)


def test_stages_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, size int, target string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registry():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)] and set(ORACLE_SQL) <= set(QUERIES)
