"""Language identification with error-correcting output codes.

Every language gets a codeword of bits.  One binary classifier per bit - a
linear one over hashed character n-grams, trained on the bit's own labels -
says how likely that bit is set in a text.  Loss-weighted decoding compares the classifiers' answers with every
codeword, each bit weighing as much as its classifier proved right for that
language, and takes the nearest codeword.  A small gap to the second nearest
flags the text as ambiguous.

Training uses a bounded sample: the expected number of rows per language is
the parameter ``per_language``; a language with fewer rows gives all of them.
Copies of a text count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import map_arrow, materialise, sample_below, utf8

UNDETERMINED = "und"
#: Hash space of the n-grams, their lengths, and code points handled at once.
BUCKET_BITS, ORDERS, SLICE = 16, (1, 2, 3), 400_000
#: Tasks that train the classifiers, each on its part of the sample; passes over it, and steps.
TRAINERS, PASSES, STEP = 4, 3, 0.3


# --- codewords -----------------------------------------------------------


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of -1/+1, pairwise far apart.

    Up to 7 languages get the exhaustive code: every split of the languages
    into two sides, 2^(n-1) - 1 bits, any two words differing in half of
    them.  More get the best of some random dense codes of 10 log2(n) bits.
    """
    if n <= 1:
        return np.ones((n, 1), dtype=np.int8)
    if n <= 7:
        splits = np.arange(1, 1 << (n - 1))
        bits = (splits[None, :] >> np.arange(n)[:, None]) & 1
        return np.where(bits == 1, 1, -1).astype(np.int8)
    width = int(np.ceil(10 * np.log2(n)))
    rng, best, most = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], dtype=np.int8), size=(n, width))
        apart = (width - code.astype(int) @ code.T.astype(int)) // 2
        least = int((apart + np.eye(n, dtype=int) * width).min())
        if least > most:
            best, most = code, least
    return best


# --- n-grams -------------------------------------------------------------

_table: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it is no letter."""
    global _table
    if _table is None:
        table = np.zeros(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            if (s := chr(c)).isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _table = table
    return _table


def _grams(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slices of a batch: the n-grams' buckets and the index of their text.

    N-grams run inside words, whose start and end count as a character.
    Texts of any length go through in slices, so memory stays bounded; an
    n-gram belongs to the slice in which it starts.
    """
    table, start = _letters(), 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size + len(texts[stop]) <= SLICE):
            size += len(texts[stop])
            stop += 1
        points = [np.frombuffer(t.decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for t in texts[start:stop]]
        sizes = np.array([p.size + 2 for p in points])
        chars = np.zeros(int(sizes.sum()), dtype=np.uint32)
        owner = np.repeat(np.arange(start, stop), sizes)
        for p, at in zip(points, (np.cumsum(sizes) - sizes + 1).tolist()):
            chars[at : at + p.size] = table[p]
        for a in range(0, chars.size, SLICE):
            c = chars[a : a + SLICE + 2].astype(np.uint64)
            own, letter = min(SLICE, chars.size - a), c != 0
            for n in ORDERS:
                m = min(own, c.size - n + 1)
                if m < 1:
                    continue
                keep = letter[:m] if n == 1 else letter[:m] | letter[1 : m + 1] if n == 2 else letter[1 : m + 1]
                h = np.full(m, np.uint64(n * 0x9E3779B1))
                for i in range(n):
                    h = (h ^ c[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
                    h ^= h >> np.uint64(29)
                yield (h[keep] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), owner[a : a + m][keep]
        start = stop


def gram_counts(texts: list[bytes]) -> np.ndarray:
    """Sum over the texts of each text's relative n-gram frequencies."""
    total = np.zeros(1 << BUCKET_BITS)
    for t in texts:
        counts = np.zeros(1 << BUCKET_BITS)
        for h, _ in _grams([t]):
            counts += np.bincount(h, minlength=counts.size)
        if s := counts.sum():
            total += counts / s
    return total


def frequencies(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams and their relative frequencies."""
    counts = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
    for h, _ in _grams([text]):
        counts += np.bincount(h, minlength=counts.size)
    found = np.flatnonzero(counts)
    return found.astype(np.int32), (counts[found] / max(counts.sum(), 1)).astype(np.float32)


def train_bits(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], weights: np.ndarray) -> np.ndarray:
    """Weights by bucket and bit after logistic steps over the rows (buckets,
    frequencies, bits as -1 / +1), from the given weights on.

    Every bit's classifier goes by its own errors: a step moves the text's
    answer towards the bit by STEP times what the logistic loss asks for,
    smaller in later passes.  The result is the mean over the last pass.
    """
    w = weights.astype(np.float64).copy()
    scale = np.maximum(np.mean([np.abs(f @ w[b]) for b, f, _ in rows], axis=0), 1e-3) if rows else np.ones(w.shape[1])
    total, n = np.zeros_like(w), 0
    for k in range(PASSES):
        for i, (b, f, bits) in enumerate(rows):
            margin = bits * (f @ w[b]) / scale
            pull = STEP / (k + 1) * scale * bits / (1 + np.exp(2 * np.clip(margin, -15, 15)))
            w[b] += np.outer(f / (f @ f), pull)
            if k == PASSES - 1 and i % 16 == 0:
                total, n = total + w, n + 1
    return total / n if n else w


def mean_weights(texts: list[bytes], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text the mean weight of its n-grams for each bit, and their number."""
    sums, n = np.zeros((len(texts), weights.shape[1])), np.zeros(len(texts))
    for h, owner in _grams(texts):
        if not h.size:
            continue
        low = int(owner[0])
        high = int(owner[-1]) + 1
        n[low:high] += np.bincount(owner - low, minlength=high - low)
        for j in range(weights.shape[1]):
            sums[low:high, j] += np.bincount(owner - low, weights=weights[h, j], minlength=high - low)
    return sums / np.maximum(n, 1)[:, None], n


# --- model ---------------------------------------------------------------


@dataclass
class Model:
    """languages; code (-1/+1) and trust (0-1) by language and bit; weights by
    bucket and bit; scale: a mean weight of scale[j] is a sure answer for bit j."""

    languages: list[str]
    code: np.ndarray
    trust: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    ambiguous_gap: float = 0.15
    #: Beyond this distance to the nearest codeword an ambiguous text is rejected.
    farthest: float = np.inf

    def answers(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        mean, n = mean_weights(texts, self.weights)
        return np.clip(mean / self.scale, -4, 4), n

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (0-1) and ambiguity of each text."""
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        answers, n = self.answers(texts)
        loss = self.losses(answers)
        near = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)))
        near /= near.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        order = np.sort(loss, axis=1)
        gap = order[:, 1] - order[:, 0] if order.shape[1] > 1 else np.full(len(texts), np.inf)
        found = n > 0
        return (
            [self.languages[i] if ok else UNDETERMINED for i, ok in zip(best.tolist(), found.tolist())],
            np.where(found, near[np.arange(len(texts)), best], 0.0),
            found & (gap < self.ambiguous_gap),
        )

    def decided(self, texts: list[bytes]) -> list[bool]:
        """Whether each text has letters and is not both ambiguous and farther
        from all codewords than known texts are.  Where no language could be
        learned, letters are enough."""
        answers, n = self.answers(texts)
        if not self.languages:
            return (n > 0).tolist()
        loss = np.sort(self.losses(answers), axis=1)
        ambiguous = loss[:, 1] - loss[:, 0] < self.ambiguous_gap if loss.shape[1] > 1 else np.zeros(len(texts), bool)
        return ((n > 0) & ~(ambiguous & (loss[:, 0] > self.farthest))).tolist()

    def losses(self, answers: np.ndarray) -> np.ndarray:
        """Loss-weighted distance of each row of answers to each codeword."""
        margin = answers[:, None, :] * self.code[None, :, :]
        weight = self.trust / self.trust.sum(axis=1, keepdims=True)
        return (np.log1p(np.exp(-2 * margin)) * weight[None, :, :]).sum(axis=2)


def _texts_by_language(batch: pa.RecordBatch) -> dict[str, list[bytes]]:
    by: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), utf8(batch.column("text"))):
        by.setdefault(lang, []).append(text)
    return by


def fit(docs: DataFrame, text: str, lang: str, trainable: Column, per_language: int = 3000, known_share: float | None = None) -> Model:
    """Learn codes and classifiers from rows with a language where trainable.

    Three passes over the sample: n-gram frequencies by language give each
    bit's first weights, TRAINERS tasks train the bits' classifiers on from
    there, each on its part, and their weights are averaged; then every
    classifier's answers give its scale and its trust.  With known_share a
    further one sets ``farthest``: that share of the sample is as near to a
    codeword.  Ties of languages go by code point.  No such row: a model that
    answers ``und`` always.
    """
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.coalesce(trainable, F.lit(False)).alias("ok"))
    rows = rows.filter(F.col("ok") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.ones((0, 1)), np.ones((0, 1)), np.zeros((1 << BUCKET_BITS, 1)), np.ones(1))
    chosen = F.lit(False)
    for name in languages:
        # by the text's hash: copies are taken together and then count once
        chosen = chosen | ((F.col("lang") == name) & sample_below(F.col("text"), per_language / sizes[name]))
    sample = materialise(rows.filter(chosen).select("lang", "text").groupBy("lang", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text")).select("lang", "text"), "lang-sample")

    def by_language(batches):
        total: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            for name, texts in _texts_by_language(batch).items():
                total[name] = total.get(name, 0) + gram_counts(texts)
                rows[name] = rows.get(name, 0) + len(texts)
        for name, v in total.items():
            yield pa.RecordBatch.from_pydict({"lang": [name], "rows": [rows[name]], "v": [v.astype("<f8").tobytes()]})

    freq = {name: np.zeros(1 << BUCKET_BITS) for name in languages}
    for r in map_arrow(sample, by_language, "lang string, rows long, v binary").toLocalIterator():
        freq[r["lang"]] = freq[r["lang"]] + np.frombuffer(r["v"], "<f8")
    smooth = 0.5 / (1 << BUCKET_BITS)
    share = np.stack([(f / max(f.sum(), 1e-12)) * (1 - 1e-3) + 1e-3 * 2 * smooth for f in freq.values()])
    code = codewords(len(languages))
    weights = np.zeros((1 << BUCKET_BITS, code.shape[1]), dtype=np.float32)
    for j in range(code.shape[1]):
        one, zero = share[code[:, j] > 0], share[code[:, j] < 0]
        if len(one) and len(zero):
            weights[:, j] = np.log(one.mean(axis=0)) - np.log(zero.mean(axis=0))
    known = {name: i for i, name in enumerate(languages)}

    def train(batches):
        rows = []
        for batch in batches:
            for name, text in zip(batch.column("lang").to_pylist(), utf8(batch.column("text"))):
                buckets, share = frequencies(text)
                if buckets.size:
                    rows.append((buckets, share, code[known[name]].astype(float)))
        if rows:
            yield pa.RecordBatch.from_pydict({"rows": [len(rows)], "v": [train_bits(rows, weights).astype("<f4").tobytes()]})

    # by the text's hash, in its order: reruns train alike
    dealt = sample.withColumn("h", F.xxhash64("text")).repartition(TRAINERS, "h").sortWithinPartitions("h", "lang").select("lang", "text")
    learnt, trained = np.zeros_like(weights, dtype=np.float64), 0
    for r in map_arrow(dealt, train, "rows long, v binary").toLocalIterator(prefetchPartitions=True):
        learnt, trained = learnt + r["rows"] * np.frombuffer(r["v"], "<f4").reshape(weights.shape), trained + r["rows"]
    weights = (learnt / trained).astype(np.float32) if trained else weights
    draft = Model(languages, code, np.ones_like(code, dtype=float), weights, np.ones(code.shape[1]))

    def replies(batches):
        bits = code.shape[1]
        seen = np.zeros((len(languages), 2 * bits + 1))
        for batch in batches:
            for name, texts in _texts_by_language(batch).items():
                mean, n = mean_weights(texts, draft.weights)
                mean, i = mean[n > 0], known[name]
                seen[i, :bits] += (mean * code[i] > 0).sum(axis=0)
                seen[i, bits : 2 * bits] += np.abs(mean).sum(axis=0)
                seen[i, -1] += len(mean)
        yield pa.RecordBatch.from_pydict({"v": [seen.astype("<f8").tobytes()]})

    seen = np.zeros((len(languages), 2 * code.shape[1] + 1))
    for r in map_arrow(sample, replies, "v binary").toLocalIterator():
        seen = seen + np.frombuffer(r["v"], "<f8").reshape(seen.shape)
    bits = code.shape[1]
    right = (seen[:, :bits] + 1) / (seen[:, -1:] + 2)
    scale = seen[:, bits : 2 * bits].sum(axis=0) / max(seen[:, -1].sum(), 1)
    model = Model(languages, code, np.maximum(right - 0.5, 0.01), weights, np.maximum(scale, 1e-3))
    if known_share is None:
        return model

    def distances(batches):
        for batch in batches:
            answers, n = model.answers(utf8(batch.column("text")))
            near = model.losses(answers).min(axis=1)[n > 0]
            yield pa.RecordBatch.from_pydict({"v": [near.astype("<f8").tobytes()]})

    near = [np.frombuffer(r["v"], "<f8") for r in map_arrow(sample.select("text"), distances, "v binary").toLocalIterator()]
    near = np.concatenate([*near, np.empty(0)])
    model.farthest = float(np.quantile(near, known_share)) if near.size else np.inf
    return model


def identify(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, then lang_pred, score, ambiguous for every row.

    Whole texts are read; ``und`` with score 0 where the text is null or has
    no letter.  Rows repeat as they come; other columns are left behind; an
    empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x bits and 2^16 x bits
    rows = docs.select(*keep, F.col(text).cast("string").alias("__text"))

    def run(batches):
        for batch in batches:
            lang, score, ambiguous = shared.value.predict(utf8(batch.column("__text")))
            columns = [batch.column(k) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ambiguous, pa.bool_())], names=[*keep, "lang_pred", "score", "ambiguous"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return map_arrow(rows, run, (kinds + ", " if kinds else "") + "lang_pred string, score double, ambiguous boolean")
