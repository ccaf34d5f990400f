"""The stored inverted index against the full scan."""

import random

import pytest

from graphloom.operators import retrieval, textindex
from graphloom.operators.textindex import TextIndex

QUERIES = ["alpha beta", "alpha NOT beta", '"alpha" OR gam', "absent", "", "NOT alpha", '"gamma" delta OR "beta" NOT al', "Ünï"]


def texts(seed, n, first=0):
    rng = random.Random(seed)
    pool = "alpha alphabet beta gamma game delta Ünïcode x y z".split()
    rows = [(first + i, " ".join(rng.choice(pool) for _ in range(rng.choice([0, 1, 3, 9, 40]))), rng.choice(pool)) for i in range(n)]
    return [*rows, (first + n, None, None), (first + n + 1, "", "beta, beta!")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, body string, head string")


def listed(df):
    return [tuple(r) for r in df.orderBy("rank").collect()]


@pytest.fixture
def small(monkeypatch):
    for name, value in {"BLOCK_DOCS": 5, "BUCKET_ROWS": 20, "FIRST_BLOCKS": 2}.items():
        monkeypatch.setattr(textindex, name, value)


def test_search_equals_the_full_scan(spark, tmp_path, small):
    index, rows = TextIndex(spark, str(tmp_path / "index")), texts(1, 90)
    assert index.search("alpha").count() == 0
    index.add(frame(spark, rows), ["body", "head"])
    for q, limit in zip(QUERIES, (3, 50, 4, 5, 5, 5, 5, 3)):
        want = listed(retrieval.search(frame(spark, rows), ["body", "head"], q, limit))
        assert listed(index.search(q, limit)) == want, (q, limit)


def test_batches_replace_and_compact(spark, tmp_path, small):
    index = TextIndex(spark, str(tmp_path / "index"))
    live = {}
    for seed, n, first in ((1, 40, 0), (2, 30, 25), (3, 5, 60)):
        rows = texts(seed, n, first)
        index.add(frame(spark, rows), ["body", "head"])
        live |= {r[0]: r for r in rows}
    rows = frame(spark, list(live.values()))
    want = {q: listed(retrieval.search(rows, ["body", "head"], q, 10)) for q in QUERIES[:2]}
    assert {q: listed(index.search(q, 10)) for q in QUERIES[:2]} == want
    index.compact()
    assert len(index.batches()) == 1 and {q: listed(index.search(q, 10)) for q in QUERIES[:2]} == want
    with pytest.raises(ValueError):
        index.add(frame(spark, [(1, "a", "b"), (1, "c", "d")]), ["body"])
    assert len(index.batches()) == 1


def test_only_the_words_buckets_are_read(spark, tmp_path, small):
    index = TextIndex(spark, str(tmp_path / "index"))
    index.add(frame(spark, [(i, f"word{i:03d} common", None) for i in range(300)]), ["body"])
    batch = index.batches()[0]
    every = index._read(batch, "postings").inputFiles()
    rows = index.postings("word007", False)
    assert len(every) > 5 and rows.count() == 1
    opened = {f for r in rows.selectExpr("input_file_name() AS f").collect() for f in [r["f"]]}
    assert len(opened) == 1
    # blocks that cannot reach a place are not scored
    assert [r["id"] for r in index.search("word001 common", 1).collect()] == [1]


def test_a_batch_is_laid_out_once(spark, small, tmp_path, monkeypatch):
    """Postings go straight to their buckets: one step is written beside the
    index, where the postings were written twice; buckets are ranges of terms."""
    steps, real = [], textindex.cut
    monkeypatch.setattr(textindex, "cut", lambda df, name: steps.append(name) or real(df, name))
    index = TextIndex(spark, f"file://{tmp_path}/index")
    batch = index.add(frame(spark, texts(4, 60)), ["body", "head"])
    assert steps == ["counted"]
    rows = sorted((r["bucket"], r["term"], r["block"]) for r in index._read(batch, "postings").collect())
    assert len({b for b, _, _ in rows}) > 1 and [r[1:] for r in rows] == sorted({r[1:] for r in rows})
