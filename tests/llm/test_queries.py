"""The registered queries on whole odd tables: columns, rows, reruns."""

import hashlib

import pytest
from graphloom.llm import token_counts
from graphloom.llm.queries import QUERIES

#: Columns that each query's contract asks for.
CONTRACT = {
    "op1": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op2": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "n_links": "bigint"},
    "op3": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op4": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op5": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op6": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op7": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op9": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op10": {"doc_id": "bigint"},
    "op11": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"},
    "op12": {"doc_id": "bigint", "n_features": "bigint", "weight": "bigint", "score": "bigint", "rank": "bigint"},
    "op13": {"doc_id": "bigint", "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "n_best": "bigint", "count_sum": "bigint", "groups_sha256": "string"},
}
TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long, size long, sig long, target string, html string, item_id int",
    "pages": "page_id long, url string, html string, host double, rule int, digest string, first long, text string",
    "benchmark": "item_id long, text string, doc_id long, words int",
    "labels": "doc_id long, quality int, toxic int, text string, positive boolean",
}
LONG = "word " * 40_000 + "x" * 20_000
TEXTS = [None, "", " \n\t", "one", "same text of five words", "same text of five words", LONG, LONG + " more", "\u0130stanbul \ud55c\uad6d\uc5b4 \U0001f642", "12 34", "\u2581 x", "<s> </s>"]
HTML = [None, "", "<", "<p>a</p>", "<p>a</p>", "<article>" + "<p>long text</p>" * 20_000 + "</article>", "plain", "<div class=ad>x</div>"]


def write(spark, folder, rows):
    for name, schema in TABLES.items():
        width = len(schema.split(", "))
        spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows.get(name, [])], schema).write.parquet(f"{folder}/{name}.parquet")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tmp_path, name):
    write(spark, tmp_path, {})
    got = QUERIES[name](spark, str(tmp_path))
    assert got.count() == 0
    kinds = dict(got.dtypes)
    assert {c: kinds.get(c) for c in CONTRACT[name.split("_")[0]]} == CONTRACT[name.split("_")[0]]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_tables(spark, tmp_path, name):
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    docs = [(i if i != 3 else None, t, [None, "en", "de"][i % 3], [None, "a", "\U0001f642"][i % 3]) for i, t in enumerate(TEXTS)]
    docs += [docs[5], docs[5], (5, "another text under one id", None, None), (None, None, None, None), (-(2**63), "far", "en", "a"), (2**63 - 1, "off", "en", "a")]
    pages = [(i if i != 4 else None, [None, "", "http://h.org/es/1", "http://h.net/de/2", "nope"][i % 5], h) for i, h in enumerate(HTML)]
    pages += [pages[3], (None, None, None)]
    write(spark, tmp_path, {"documents": docs, "pages": pages, "benchmark": [(1, "same text of five words"), (1, None), (None, "x"), (2, "")], "labels": [(i, None if i % 4 == 3 else 1, [0, 1, None][i % 3]) for i in range(12)] + [(None, 1, 1), (5, 1, 1), (5, 0, 0)]})
    got = [tuple(r[c] for c in CONTRACT[name.split("_")[0]]) for r in QUERIES[name](spark, str(tmp_path)).collect()]
    whole = pages if name.split("_")[0] in ("op3", "op6", "op8") else docs
    if name.startswith("op10"):
        assert sorted(d for (d,) in got) == [4, 5, 5, 5]
    else:
        assert sorted(str(r[0]) for r in got) == sorted(str(r[0]) for r in whole)
    again = [tuple(r[c] for c in CONTRACT[name.split("_")[0]]) for r in QUERIES[name](spark, str(tmp_path)).collect()]
    assert sorted(map(str, again)) == sorted(map(str, got))
    if name.startswith("op9"):
        same = [r for r in got if r[1] == len("same text of five words")]
        assert len({r[3] for r in same}) == 1 and all(len(r[2]) == 64 for r in got)
    if name.startswith("op6"):
        empty = "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[int(b, 2)] for b in __import__("re").findall(".{5}", bin(int.from_bytes(hashlib.sha1(b"").digest(), "big"))[2:].zfill(160)))
        assert {r[2] for r in got if r[1] == 0} == {empty}


def test_a_full_dictionary_changes_no_count(spark, tmp_path, monkeypatch):
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("piece_bpe_32k.model")
    texts = [" ".join(f"w{i * k}" for i in range(60)).encode() for k in range(1, 20)]
    want = token_counts.PieceCounter(path).count(texts)
    monkeypatch.setattr(token_counts, "DICTIONARY", 10)
    counter = token_counts.PieceCounter(path)
    assert [n for t in texts for n in counter.count([t])] == want and len(counter.counts) < 200
