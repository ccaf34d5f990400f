"""Importance resampling towards a target set, over hashed n-grams.

A feature is a run of up to max_n words joined by one space, and counts in the
bucket of its CRC-32.  CRCs combine: the CRC of A followed by B is that of A,
moved on by B's length, XOR that of B, and moving on by n bytes is a linear map
over GF(2), the n-th power of the map of one zero byte.  So each word's CRC is
computed once, from its bytes in the Arrow buffer, and a run's is that of the
run without its last word, moved on, XOR that of a space and the last word; no
n-gram is ever a string.

Bucket counts of a task are added up where it reads, the gains of the buckets
are a table of the number of buckets, and documents are drawn by Gumbel keys:
their ranks come from ranges of the order and sums of the ranges before.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.order import running
from ._common import map_arrow, materialise

#: The polynomial of CRC-32, lowest bit first.
POLYNOMIAL = 0xEDB88320
#: Bytes of text that are cut into words at once; longer words go one by one;
#: rows that one row of equal documents is laid out as at once.
GROUP_BYTES, LONG_WORD, COPIES = 4_000_000, 48, 4_096

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Bytes of words once A-Z are lower case: digits, a-z, and all of other characters.
_IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def _byte_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(POLYNOMIAL), x >> 1).astype(np.uint32)
    return x


TABLE = _byte_table()


class Shift:
    """The linear maps that move a CRC on by a number of zero bytes.

    A map is 32 columns, the images of the single bits; products of maps of
    powers of two give that of any length.  A map is used through four tables
    of 256, one for each byte of a CRC, so moving an array on takes four looks."""

    def __init__(self):
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        self.powers = [(bits >> np.uint32(8)) ^ TABLE[bits & np.uint32(255)]]
        self.tables: dict[int, np.ndarray] = {}

    @staticmethod
    def _columns_to_tables(columns: np.ndarray) -> np.ndarray:
        tables = np.zeros((4, 256), np.uint32)
        byte = np.arange(256)
        for i in range(32):
            tables[i // 8] ^= np.where(byte >> (i % 8) & 1, columns[i], 0).astype(np.uint32)
        return tables

    @staticmethod
    def _look(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
        return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]

    def of(self, n: int) -> np.ndarray:
        """The tables of n bytes."""
        if n not in self.tables:
            columns = np.uint32(1) << np.arange(32, dtype=np.uint32)
            for k in range(n.bit_length()):
                if len(self.powers) <= k:
                    self.powers.append(self._look(self._columns_to_tables(self.powers[-1]), self.powers[-1]))
                if n >> k & 1:
                    columns = self._look(self._columns_to_tables(self.powers[k]), columns)
            self.tables[n] = self._columns_to_tables(columns)
        return self.tables[n]

    def __call__(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Each crc moved on by its n bytes."""
        out = np.empty_like(crc)
        for size in np.unique(n):
            here = n == size
            out[here] = self._look(self.of(int(size)), crc[here])
        return out


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, text) of the words in texts that lie end to end."""
    inside = _IN_WORD[data]
    before = np.concatenate([[False], inside[:-1]])
    before[ends[:-1][ends[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.concatenate([inside[1:], [False]])
    after[(ends - 1)[ends > 0]] = False
    lengths = np.flatnonzero(inside & ~after) + 1 - starts
    return starts, lengths, np.searchsorted(ends, starts, "right")


def word_crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of each word, byte by byte over all words that are long enough."""
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-lengths, kind="stable")
    for i in order[: int((lengths > LONG_WORD).sum())]:
        crc[i] = zlib.crc32(data[starts[i] : starts[i] + lengths[i]]) ^ 0xFFFFFFFF
    order = order[int((lengths > LONG_WORD).sum()) :]
    at, left, state = starts[order], lengths[order], crc[order]
    more = np.searchsorted(-left, -np.arange(1, LONG_WORD + 1), "right")
    for j, n in enumerate(more):
        if not n:
            break
        state[:n] = TABLE[(state[:n] ^ data[at[:n] + j]) & 255] ^ (state[:n] >> np.uint32(8))
    crc[order] = state
    return crc ^ np.uint32(0xFFFFFFFF)


def run_crcs(crc: np.ndarray, lengths: np.ndarray, text: np.ndarray, max_n: int, shift: Shift):
    """(CRC, text) of all runs of 1, then 2, ... up to max_n words of a text."""
    yield crc, text
    if max_n > 1:
        space = np.full(len(crc), zlib.crc32(b" "), np.uint32)
        tail = shift(space, lengths) ^ crc
    run, at = crc, np.arange(len(crc))
    for _ in range(max_n - 1):
        # at: the run's last word; the next one must be of the same text
        keep = at + 1 < len(crc)
        keep[keep] = text[at[keep] + 1] == text[at[keep]]
        run, at = run[keep], at[keep] + 1
        if not len(at):
            return
        run = shift(run, lengths[at] + 1) ^ tail[at]
        yield run, text[at]


def _groups(column: pa.Array):
    """(first row, bytes end to end in lower case, ends) of rows up to GROUP_BYTES."""
    texts = column.cast(pa.large_binary()) if pa.types.is_large_string(column.type) else column.cast(pa.binary())
    sizes = np.array([len(t) if t is not None else 0 for t in texts.to_pylist()], np.int64)
    at = 0
    while at < len(sizes):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), GROUP_BYTES, "right")))
        data = np.frombuffer(b"".join(t or b"" for t in texts.slice(at, n).to_pylist()), np.uint8)
        yield at, _LOWER[data], np.cumsum(sizes[at : at + n])
        at += n


def bucket_counts(rows: DataFrame, text: str, max_n: int, buckets: int) -> DataFrame:
    """bucket, n of all features of all rows; each task adds up its own first."""

    def run(batches):
        shift, total = Shift(), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, ends in _groups(batch.column(0)):
                starts, lengths, of = words(data, ends)
                for crc, _ in run_crcs(word_crcs(data, starts, lengths), lengths, of, max_n, shift):
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])

    return map_arrow(rows.select(F.col(text).cast("string").alias("text")), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) by bucket."""
    all_s, all_t = sum(source.values()), sum(target.values())
    ratio = lambda k: (target.get(k, 0) + 1.0) * (all_s + buckets) / ((source.get(k, 0) + 1.0) * (all_t + buckets))
    return np.array([math.floor(1000 * math.log(ratio(k))) for k in range(buckets)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, text: str, keep: tuple[str, ...], max_n: int) -> DataFrame:
    """keep columns, n_words, n_features and weight, the sum of the gains of
    all features of a row; null and empty texts have none and 0."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    rows = docs.select(*keep, F.col(text).cast("string").alias("__text"))

    def run(batches):
        shift, gain = Shift(), shared.value
        for batch in batches:
            n_words, n_features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for first, data, ends in _groups(batch.column(len(keep))):
                starts, lengths, of = words(data, ends)
                here = slice(first, first + len(ends))
                n_words[here] = np.bincount(of, minlength=len(ends))
                for crc, text_of in run_crcs(word_crcs(data, starts, lengths), lengths, of, max_n, shift):
                    # runs are in the order of texts: sums are differences of prefix sums
                    to = np.searchsorted(text_of, np.arange(len(ends) + 1))
                    n_features[here] += np.diff(to)
                    weight[here] += np.diff(np.concatenate([[0], np.cumsum(gain[crc % np.uint32(len(gain))])])[to])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), *map(pa.array, (n_words, n_features, weight))], names=[*keep, "n_words", "n_features", "weight"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return map_arrow(rows, run, kinds + "n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", max_n: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024
) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of docs.

    Of the N rows with min_words words or more, the floor(percent N / 100) of
    the highest score are drawn: rank counts them from 1, ties go to the
    smaller id, null ids last, and is null for all others.  A score is the
    weight and Gumbel noise from a hash of the seed and the id (a null one
    counts as ''), so reruns agree.  Repeated rows are drawn one by one.
    Other columns are left behind; empty tables, of either kind, are no error.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    counted = lambda df, c: {r["bucket"]: r["n"] for r in bucket_counts(df, c, max_n, buckets).collect()}
    gain = gains(counted(rows, "text"), counted(target, target_text), buckets)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    noise = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log(noise)))
    scored = weights(rows, gain, "text", ("doc_id",), max_n).withColumn("score", score.cast("long"))
    scored = materialise(scored, "scored")
    n = scored.filter(F.col("n_words") >= min_words).count() * percent // 100
    # equal rows are laid out as one, so no range holds a hot one
    equal = scored.filter(F.col("n_words") >= min_words).groupBy("doc_id", "n_features", "weight", "score").agg(F.count(F.lit(1)).alias("copies"))
    laid = running(equal, [F.desc("score"), F.asc_nulls_last("doc_id"), "weight", "n_features"], F.col("copies"), "end")
    lots = laid.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {COPIES}"))))
    each = lots.withColumn("k", F.explode(F.sequence(F.col("lot") * COPIES + 1, F.least("copies", (F.col("lot") + 1) * COPIES))))
    rank = F.col("end") - F.col("copies") + F.col("k")
    drawn = each.select("doc_id", "n_features", "weight", "score", F.when(rank <= n, rank).cast("long").alias("rank"))
    short = scored.filter(F.col("n_words") < min_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return drawn.unionByName(short)


#: The same rows in DuckDB's SQL, for runs of one word: CRCs by table over the
#: bytes of each distinct word.
ORACLE = r"""
WITH g AS MATERIALIZED (SELECT list(list_reduce(range(0, 8), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, b) ORDER BY b) AS t FROM range(0, 256) r(b)),
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS row FROM documents),
d AS (SELECT row, unnest(w) AS x FROM w),
y AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS x FROM benchmark),
u AS (SELECT DISTINCT x FROM (SELECT x FROM d UNION ALL SELECT x FROM y)),
h AS (SELECT x, hex(encode(x)) AS h FROM u),
c AS (SELECT x, xor(list_reduce(list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i::INT + 1, 2))::BIGINT), lambda s, b: xor(g.t[xor(s, b) % 256 + 1], s >> 8), 4294967295), 4294967295) % 10000 AS b FROM h, g),
s AS (SELECT b, count(*) AS n FROM d JOIN c USING (x) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM y JOIN c USING (x) GROUP BY b),
z AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t),
a AS (SELECT k.b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (z.s + 10000) / ((coalesce(s.n, 0) + 1)::DOUBLE * (z.t + 10000))))::BIGINT AS gain FROM range(0, 10000) k(b) LEFT JOIN s ON s.b = k.b LEFT JOIN t ON t.b = k.b, z),
f AS (SELECT row, sum(gain)::BIGINT AS weight FROM d JOIN c USING (x) JOIN a USING (b) GROUP BY row),
o AS (SELECT row, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM w LEFT JOIN f USING (row)),
q AS (SELECT row, doc_id, n_features, weight, (weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296))))::BIGINT AS score FROM o),
r AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () * 10 // 100 AS n FROM q WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n THEN rank END::BIGINT AS rank FROM q LEFT JOIN r USING (row)
"""
