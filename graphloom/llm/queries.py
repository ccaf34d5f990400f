"""The corpus operators over their whole tables, as the driver runs them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontamination, html_text, importance, jaccard_join, language_id, licences, mixing, syncmers, token_counts, toxicity, url_filter, warc
from ._common import held_out

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; fold 2 of 4 is held out of the training."""
    docs = _table(spark, sf_dir, "documents")
    out = held_out("doc_id", 4, 2)
    model = language_id.fit(docs, "text", "lang", ~out)
    found = language_id.identify(docs, model, "text", ("doc_id",))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components and links of documents with a 5-word Jaccard similarity of 0.8 or more."""
    return jaccard_join.similarity_components(_table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL by rules, else by the language models."""
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes from every document."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document in the piece_bpe_32k.model vocabulary."""
    import public_tokenizers

    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from WARC bundles that were written from it."""
    return warc.archive_round_trip(spark, _table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of fold 1 of 3 are held out."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    out = held_out("doc_id", 3, 1)
    model = toxicity.fit(docs, labels, "doc_id", "text", "toxic", ~out)
    scored = toxicity.score(docs, model, "text", ("doc_id",))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = _table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.fit(pages))


def op9_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return syncmers.fingerprints(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of benchmark items, with the items' ids."""
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of base phrases and labels of licences of every document."""
    return licences.scan(_table(spark, sf_dir, "documents"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn for their likeness to the benchmark's texts."""
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), max_n=1, buckets=10_000, percent=10, min_words=20, seed=2024)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of byte_bpe_50k.json and piece_bpe_32k.model on every document."""
    import public_tokenizers

    return alignment.align_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_language_id, op2_jaccard_join, op3_url_filter, op4_mixing, op5_token_counts, op6_warc, op7_toxicity, op8_html_text, op9_syncmers, op10_decontamination, op11_licences, op12_importance, op13_alignment)
}

ORACLE_SQL: dict[str, str] = {
    "op2_jaccard_join": r"""
WITH RECURSIVE
w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM w WHERE len(w) >= 5),
f AS (SELECT doc_id, x || ' ' || lead(x, 1) OVER k || ' ' || lead(x, 2) OVER k || ' ' || lead(x, 3) OVER k || ' ' || lead(x, 4) OVER k AS g FROM t WINDOW k AS (PARTITION BY doc_id ORDER BY i)),
u AS (SELECT DISTINCT doc_id, g FROM f WHERE g IS NOT NULL UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4),
g AS (SELECT doc_id, u.g FROM u JOIN (SELECT g FROM u GROUP BY g HAVING count(*) > 1) m ON u.g = m.g),
n AS (SELECT d.doc_id, coalesce(k.n, 0) AS n FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM u GROUP BY 1) k ON k.doc_id = d.doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
q AS (SELECT x, count(*) AS k FROM l GROUP BY x)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.y) AS component_id, coalesce(any_value(q.k), 0)::BIGINT AS n_links
FROM n JOIN r ON r.x = n.doc_id LEFT JOIN q ON q.x = n.doc_id GROUP BY n.doc_id, n.n
""",
    "op6_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS h FROM p),
v AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(h, 5 * i::INT + 1, 5))::BIGINT) AS v FROM d),
b AS (SELECT page_id, payload_bytes, array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> s) & 31)::INT + 1, 1)), '')), '') AS payload_digest FROM v),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM f
""",
    "op11_licences": licences.oracle(),
    "op12_importance": importance.ORACLE,
}
