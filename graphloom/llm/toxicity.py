"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all other texts are unlabelled, as
nobody has vouched for them.  A linear classifier is trained in numpy on the
non-negative risk estimator

    pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)),

which subtracts the share pi of positives hidden among the unlabelled from
their loss and never lets that corrected loss fall below zero.

Training uses bounded samples (parameters ``positives`` and ``unlabelled``,
expected rows); copies of a text count once.  Scoring reads whole texts.

Features are the distinct words of a text and their first 4, 5 and 6 letters,
hashed; a text's logit is the bias plus the weights of its distinct features.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import map_arrow, materialise, sample_below, utf8

BUCKET_BITS = 20
_WORD = re.compile(r"[^\W\d_]+")
#: Distinct words whose weight a worker keeps between texts.
CACHE = 400_000


def distinct_words(text: bytes) -> set[str]:
    """Lower-case runs of letters, each once."""
    return set(_WORD.findall(text.decode("utf-8", "replace").lower()))


def word_features(word: str) -> list[int]:
    """Buckets of a word and of its beginnings."""
    parts = {f"={word}", *(f"{n}{word[:n]}" for n in (4, 5, 6) if len(word) >= n)}
    return [xxhash.xxh32_intdigest(p) >> (32 - BUCKET_BITS) for p in parts]


def features(text: bytes) -> np.ndarray:
    """Distinct buckets of a text."""
    return np.unique(np.array([b for w in distinct_words(text) for b in word_features(w)], dtype=np.int64))


@dataclass
class Model:
    """bias, and weights of the buckets that proved telling; prior: share of
    toxic texts that training assumed."""

    bias: float = -4.0
    weights: dict[int, float] = field(default_factory=dict)
    prior: float = 0.0

    def __post_init__(self):
        self._cache: dict[str, tuple[int, ...]] = {}

    def _telling(self, word: str) -> tuple[int, ...]:
        if len(self._cache) > CACHE:
            self._cache.clear()
        found = self._cache[word] = tuple(b for b in word_features(word) if b in self.weights)
        return found

    def score(self, text: bytes) -> float:
        """Probability of toxicity, 0 to 1; without words that of the bias."""
        found: set[int] = set()
        if self.weights:
            cache = self._cache
            for word in distinct_words(text):
                if (t := cache.get(word)) is None:
                    t = self._telling(word)
                if t:
                    found.update(t)
        total = self.bias + sum(self.weights[b] for b in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 800, rate: float = 0.05, decay: float = 1e-5, least: float = 0.02, telling: float = 1.5) -> Model:
    """Weights from the buckets of positive and unlabelled texts.

    Only buckets in 5 positives and in the share ``least`` of them or more, whose rate among positives is
    e**telling times that among the unlabelled or more, get a weight.  Full-batch Adam on the non-negative risk with the
    logistic loss; where the corrected risk turns negative, its gradient is
    reversed, as the method asks.
    """
    if not positive or not unlabelled:
        return Model(prior=prior)
    size = 1 << BUCKET_BITS
    p = np.bincount(np.concatenate(positive), minlength=size)
    u = np.bincount(np.concatenate(unlabelled), minlength=size)
    ratio = np.log((p + 0.5) / (len(positive) + 1)) - np.log((u + 0.5) / (len(unlabelled) + 1))
    chosen = np.flatnonzero((p >= max(5, least * len(positive))) & (ratio >= min(telling, 0.6 * np.log(1 / max(prior, 1e-6)))))
    place = np.full(size, -1, dtype=np.int64)
    place[chosen] = np.arange(chosen.size)

    def matrix(texts):
        rows = [place[t][place[t] >= 0] for t in texts]
        return np.concatenate(rows) if rows else np.empty(0, np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows])

    (pc, pr), (uc, ur) = matrix(positive), matrix(unlabelled)
    w, b = np.zeros(chosen.size), np.log(prior / (1 - prior))
    m, v = np.zeros(chosen.size + 1), np.zeros(chosen.size + 1)
    np_, nu = len(positive), len(unlabelled)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        zp = b + np.bincount(pr, weights=w[pc], minlength=np_)
        zu = b + np.bincount(ur, weights=w[uc], minlength=nu)
        corrected = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        # gradients by logit of -log(sigmoid(z)) for positives, log(1 + e^z) else
        gp, gu = prior * (sigmoid(zp) - 1) / np_, np.zeros(nu)
        if corrected >= 0:
            gp, gu = gp - prior * sigmoid(zp) / np_, sigmoid(zu) / nu
        else:
            gp, gu = prior * sigmoid(zp) / np_, -sigmoid(zu) / nu
        g = np.bincount(pc, weights=gp[pr], minlength=chosen.size) + np.bincount(uc, weights=gu[ur], minlength=chosen.size) + decay * w
        g = np.append(g, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(float(b), dict(zip(chosen.tolist(), w.tolist())), prior)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, learnable: Column, positives: int = 4000, unlabelled: int = 12000, default_prior: float = 0.1) -> Model:
    """Train from the label table's toxic rows among the learnable documents.

    learnable: condition on doc_id, for both tables.  The class prior is the
    share of toxic among the labelled learnable rows (default_prior if there
    is none), kept within 0.001 and 0.5.  A document with several labels is
    toxic if one says so.  Without a positive the model gives one low score.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull())
    known = known.withColumnRenamed("doc_id", doc_id).filter(learnable).withColumnRenamed(doc_id, "doc_id")
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    n, toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("y") == 1).cast("long")), F.lit(0))).first()
    prior = min(max(toxic / n, 0.001), 0.5) if n else default_prior
    if not toxic:
        return Model(prior=prior)
    # a bounded list of ids: in expectation `positives`, so safe to broadcast
    chosen = known.filter((F.col("y") == 1) & sample_below(F.col("doc_id"), positives / toxic)).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * positives)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    total = rows.count()
    marked = rows.join(F.broadcast(chosen.withColumn("positive", F.lit(True))), "doc_id", "left").withColumnRenamed("doc_id", doc_id)
    # the unlabelled are drawn from all texts, positives too, as the estimator assumes
    drawn = learnable & sample_below(F.coalesce(F.col("text"), F.lit("")), unlabelled / max(total, 1))
    sample = marked.select(F.coalesce("text", F.lit("")).alias("text"), F.col("positive").isNotNull().alias("positive"), drawn.alias("drawn")).filter("positive OR drawn")
    sample = materialise(sample.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("positive").alias("positive"), F.max("drawn").alias("drawn")).drop("h"), "toxic-sample")

    def run(batches):
        for batch in batches:
            found = [features(t).astype("<i4").tobytes() for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_pydict({"positive": batch.column("positive"), "drawn": batch.column("drawn"), "f": pa.array(found, pa.binary())})

    rows = sorted(map_arrow(sample, run, "positive boolean, drawn boolean, f binary").toLocalIterator(), key=lambda r: r["f"])
    side = lambda name: [np.frombuffer(r["f"], "<i4") for r in rows if r[name]]
    return fit_nnpu(side("positive"), side("drawn"), prior)


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, then score (0 to 1) for every row.

    A null or empty text gets the score of a text without any telling word.
    Rows repeat as they come; other columns are left behind.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2^20 weights
    rows = docs.select(*keep, F.col(text).cast("string").alias("__text"))

    def run(batches):
        for batch in batches:
            scores = [shared.value.score(t) for t in utf8(batch.column("__text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(scores, pa.float64())], names=[*keep, "score"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return map_arrow(rows, run, kinds + "score double")
