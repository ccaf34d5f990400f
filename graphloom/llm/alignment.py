"""Token alignment of two tokenizers over the bytes of whole texts.

A's tokens and B's tokens of a text spell the same bytes.  The strings of a
batch are laid end to end; the running sums of the tokens' lengths are their
ends, the ends of both sides are counted once by place, and where both have
one a group closes.  As both sides end with each string, no group crosses into
the next one, and what belongs to a string lies between two places.

Both tokenizers cut before a run of spaces that follows a character which is
no white space.  So a text's groups are those of its segments between such
cuts: the strings that are laid end to end are the distinct segments which a
batch of texts brings anew, and a text's results are differences of prefix
sums over its segments.

What a document links is written once, as its distinct pairs of ids.  How many
documents hold a pair is counted by pair.  The HOT_PAIRS most frequent ones,
which are most of what documents link, go to every task; the rest are joined.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_arrow, materialise

#: Segments and pairs of theirs that a worker keeps at most; bytes of text that
#: are aligned at once; pairs that are counted at once.
DICTIONARY, KEPT_PAIRS, GROUP_BYTES, PAIR_BLOCK = 500_000, 8_000_000, 4_000_000, 2_000_000
#: Pairs whose counts every task gets, the most frequent ones.
HOT_PAIRS = 400_000
#: Links of one group that are listed one by one; larger groups by distinct ids.
LISTED = 1 << 16

_CUT = re.compile(r"(?<=\S)(?= )")
_UNEVEN = re.compile(r"\s ")
_SPACE = "▁"


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for:
    printable ones for themselves, the others in order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in plain}
    return table | {chr(0x100 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


class Side:
    """The bytes of a vocabulary's tokens, by id."""

    def __init__(self, spelled: list[bytes]):
        self.length = np.array([len(x) for x in spelled], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(spelled), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """What the tokens spell."""
        n = self.length[ids]
        return self.flat[np.repeat(self.start[ids] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers end to end, and how many each list has."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes


class Aligner:
    """A byte-level BPE of the tokenizers library (A) and a SentencePiece BPE
    with byte fallback that adds a space before a text (B), with what is known
    of the segments met so far."""

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        byte = byte_alphabet()
        spell = lambda t: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
        piece, pieces = self.b.id_to_piece, range(self.b.get_piece_size())
        self.a_side = Side([spell(self.a.id_to_token(i) or "") for i in range(self.a.get_vocab_size(with_added_tokens=True))])
        self.b_side = Side([bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace(_SPACE, " ").encode() for i in pieces])
        self.lone = [self.b.piece_to_id(_SPACE)]
        if any(_SPACE in piece(i).lstrip(_SPACE) for i in pieces):
            raise ValueError("a piece with a space behind another character would cross the cuts")
        self.width = len(pieces)
        self.ids = np.array([str(i) for i in range(max(len(self.a_side.length), self.width))], object)
        self.forget(0)

    def forget(self, keep: int) -> None:
        """Keep the segments that were met first, among them the frequent ones."""
        if keep:
            self.index = {s: i for s, i in self.index.items() if i < keep}
            self.spelled, self.numbers, self.pair_to = self.spelled[:keep], self.numbers[:keep], self.pair_to[: keep + 1]
            self.pairs, self.times = self.pairs[: self.pair_to[-1]], self.times[: self.pair_to[-1]]
            return
        self.index: dict[str, int] = {}
        #: by segment: its groups as text; n_a, n_b, n_groups, n_links, spells; where its pairs begin
        self.spelled: list[str] = []
        self.numbers = np.empty((0, 5), np.int64)
        self.pair_to = np.zeros(1, np.int64)
        self.pairs, self.times = np.empty(0, np.int64), np.empty(0, np.int64)

    def segments(self, text: str) -> list[str]:
        """The segments of the text behind a space, each without its first space."""
        if not _UNEVEN.search(text) and not text.startswith(" "):
            return text.split(" ")
        return [s[1:] for s in _CUT.split(" " + text)]

    def learn(self, segments: list[str]) -> None:
        """Tokenize and align segments, each behind a space, end to end."""
        a, a_n = _flat([e.ids for e in self.a.encode_batch_fast([" " + s for s in segments], add_special_tokens=False)])
        # the processor adds nothing to an empty text
        b, b_n = _flat([x or self.lone for x in self.b.encode(segments, num_threads=1)])
        want = np.frombuffer((" " + " ".join(segments)).encode(), np.uint8)
        ends = np.cumsum(np.fromiter((len(s.encode()) + 1 for s in segments), np.int64, len(segments)))
        spells = np.ones(len(segments), bool)
        for side, ids, n in ((self.a_side, a, a_n), (self.b_side, b, b_n)):
            got = np.cumsum(side.length[ids])[np.cumsum(n) - 1]
            if not np.array_equal(got, ends) or not np.array_equal(side.bytes_of(ids), want):
                spells &= [side.bytes_of(ids[t - k : t]).tobytes() == (" " + s).encode() for s, k, t in zip(segments, n.tolist(), np.cumsum(n).tolist())]
        if not spells.all():
            a, b = a[np.repeat(spells, a_n)], b[np.repeat(spells, b_n)]
            a_n, b_n = np.where(spells, a_n, 0), np.where(spells, b_n, 0)
        spelled, groups, links, pair_n, pairs, times = align(a, b, a_n, b_n, self.a_side.length, self.b_side.length, self.ids)
        self.index.update(zip(segments, range(len(self.spelled), len(self.spelled) + len(segments))))
        self.spelled += spelled
        self.numbers = np.concatenate([self.numbers, np.stack([a_n, b_n, groups, links, spells], 1)])
        self.pair_to = np.concatenate([self.pair_to, self.pair_to[-1] + np.cumsum(pair_n)])
        self.pairs, self.times = np.concatenate([self.pairs, pairs]), np.concatenate([self.times, times])

    def texts(self, texts: list[str]) -> list[tuple[int, int, int, int, str, bytes, bytes]]:
        """For each text: n_a, n_b, n_groups, n_links, SHA-256 of its groups,
        and its distinct pairs of linked ids with how often each is linked, as
        packed 32-bit numbers; zeros where it has no tokens."""
        if len(self.index) > DICTIONARY or len(self.pairs) > KEPT_PAIRS:
            self.forget(DICTIONARY // 2 if len(self.index) > DICTIONARY // 2 and self.pair_to[DICTIONARY // 2] < KEPT_PAIRS // 2 else 0)
        split = [self.segments(t) if t and _SPACE not in t else [] for t in texts]
        if new := set().union(*split) - self.index.keys():
            self.learn(list(new))
        at, n = _flat([list(map(self.index.__getitem__, parts)) for parts in split])
        to = np.concatenate([[0], np.cumsum(n)])
        sums = np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(self.numbers[at], 0)])
        sums = sums[to[1:]] - sums[to[:-1]]
        whole = (sums[:, 4] == n) & (n > 0)
        # the pairs of all segments, by text
        size = np.where(np.repeat(whole, n), self.pair_to[at + 1] - self.pair_to[at], 0)
        place = np.repeat(self.pair_to[at] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        key = (np.repeat(np.repeat(np.arange(len(texts)), n), size) << 32) + self.pairs[place]
        key, times = _summed(key, self.times[place])
        pair_to = np.searchsorted(key, np.arange(len(texts) + 1) << 32)
        pairs, times = key.astype(np.uint32).view(np.int32), times.astype(np.int32)
        out, spelled, names = [], self.spelled, at.tolist()
        for i, ok in enumerate(whole.tolist()):
            if not ok:
                out.append((0, 0, 0, 0, "", b"", b""))
                continue
            text = ";".join([spelled[k] for k in names[to[i] : to[i + 1]]])
            here = slice(pair_to[i], pair_to[i + 1])
            out.append((*sums[i, :4].tolist(), hashlib.sha256(text.encode()).hexdigest(), pairs[here].tobytes(), times[here].tobytes()))
        return out


def _summed(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their times."""
    plain = int(times.sum()) <= 2 * len(times)
    if plain:
        key = np.sort(np.repeat(key, times))
    else:
        order = np.argsort(key, kind="stable")
        key, times = key[order], times[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return key[starts], np.diff(np.append(starts, len(key))) if plain else np.add.reduceat(times, starts)


def group_ends(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """For every place from 0 to the last end: how many groups have closed up
    to it.  A group closes where a token of A and one of B end."""
    size = int(a_ends[-1]) + 1 if len(a_ends) else 1
    return np.cumsum((np.bincount(a_ends, minlength=size) > 0) & (np.bincount(b_ends, minlength=size) > 0))


def _links(a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, a_count: np.ndarray, b_count: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair, times) of all links; a pair is id of A * width + id of B."""
    size = a_count * b_count
    b_start = np.cumsum(b_count) - b_count
    small = size <= LISTED
    pick = np.flatnonzero(small[a_group])
    fan = b_count[a_group[pick]]
    left = np.repeat(pick, fan)
    offset = np.arange(len(left)) - np.repeat(np.cumsum(fan) - fan, fan)
    groups = [a_group[left]]
    pairs = [a[left].astype(np.int64) * width + b[b_start[a_group[left]] + offset]]
    times = [np.ones(len(left), np.int64)]
    a_start = np.cumsum(a_count) - a_count
    for g in np.flatnonzero(~small):
        x, n = np.unique(a[a_start[g] : a_start[g] + a_count[g]], return_counts=True)
        y, m = np.unique(b[b_start[g] : b_start[g] + b_count[g]], return_counts=True)
        groups.append(np.full(len(x) * len(y), g))
        pairs.append((x.astype(np.int64)[:, None] * width + y[None, :]).ravel())
        times.append((n[:, None] * m[None, :]).ravel())
    return np.concatenate(groups), np.concatenate(pairs), np.concatenate(times)


def align(a: np.ndarray, b: np.ndarray, a_n: np.ndarray, b_n: np.ndarray, a_length: np.ndarray, b_length: np.ndarray, ids: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Strings that lie end to end: a and b are their tokens' ids, a_n and b_n
    how many each has.  Gives, by string, its groups as text, their number,
    that of its links and of its distinct pairs; then those pairs, each id of
    A * number of B's ids + id of B, and how often each is linked."""
    a_end, b_end = np.cumsum(a_length[a]), np.cumsum(b_length[b])
    closed = group_ends(a_end, b_end)
    a_group, b_group = closed[a_end - 1], closed[b_end - 1]
    n = int(closed[-1])
    a_count, b_count = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
    a_to, b_to = (np.concatenate([[0], np.cumsum(x)]) for x in (a_n, b_n))
    g_to = np.concatenate([[0], a_group + 1])[a_to]
    links = np.diff(np.concatenate([[0], np.cumsum(a_count * b_count)])[g_to])
    # each id with what follows it, in the order of the groups
    words = np.empty(2 * (len(a) + len(b)), object)
    a_at = 2 * (np.arange(len(a)) + np.concatenate([[0], np.cumsum(b_count)])[a_group])
    b_at = 2 * (np.arange(len(b)) + np.concatenate([[0], np.cumsum(a_count)])[b_group + 1])
    words[a_at], words[b_at] = ids[a], ids[b]
    signs = np.array([",", "|", ";"], object)
    last = lambda group: np.append(group[1:] != group[:-1], True)[: len(group)].astype(int)
    words[a_at + 1], words[b_at + 1] = signs[last(a_group)], signs[2 * last(b_group)]
    words = words.tolist()
    ends = (2 * (a_to + b_to)).tolist()
    spelled = ["".join(words[x : y - 1]) if y > x else "" for x, y in zip(ends, ends[1:])]
    group, pair, times = _links(a, b, a_group, b_group, a_count, b_count, len(b_length))
    key, times = _summed(((np.searchsorted(g_to, group, "right") - 1) << 32) + pair, times)
    return spelled, np.diff(g_to), links, np.bincount(key >> 32, minlength=len(a_n)), key & 0xFFFFFFFF, times


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_file: str, b_file: str) -> Aligner:
    """The worker's aligner of two files; later tasks go on with its segments."""
    if (a_file, b_file) not in _ALIGNERS:
        _ALIGNERS[a_file, b_file] = Aligner(a_file, b_file)
    return _ALIGNERS[a_file, b_file]


def aligned(docs: DataFrame, a_file: str, b_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times for
    every row; row numbers the rows within this run."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        both, number = aligner(a_file, b_file), TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end] or "") <= GROUP_BYTES):
                    size += len(texts[end] or "")
                    end += 1
                found = both.texts([t or "" for t in texts[at:end]])
                columns = [pa.array(range(number, number + len(found)), pa.int64()), ids.slice(at, end - at)]
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
                columns += [pa.array(c, k) for c, k in zip(zip(*found), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
                number, at = number + len(found), end

    return map_arrow(rows, run, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary")


def _packed(column: pa.Array) -> np.ndarray:
    """The 32-bit numbers of a binary column, end to end."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).astype(np.int64)


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n: in how many rows each pair is linked.  Tasks add up what they
    read, a block of pairs at a time, before anything is moved."""

    def run(batches):
        held, size = [], 0

        def merged():
            pairs, counts = (np.concatenate(c) for c in zip(*held))
            pairs, where = np.unique(pairs, return_inverse=True)
            return pairs, np.bincount(where, counts, len(pairs)).astype(np.int64)

        for batch in batches:
            held.append(np.unique(_packed(batch.column(0)), return_counts=True))
            size += len(held[-1][0])
            if size > PAIR_BLOCK:
                held = [merged()]
                size = len(held[0][0])
                if size > PAIR_BLOCK // 2:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, held[0])), names=["pair", "n"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, merged())), names=["pair", "n"])

    return map_arrow(rows.select("pairs"), run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align_documents(docs: DataFrame, a_file: str, b_file: str, doc_id: str = "doc_id", text: str = "text", hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row.

    Texts that are null or empty, or that either side's tokens do not spell,
    have no tokens: zeros and an empty digest.  Repeated rows count as
    documents of their own.  Both files must exist on executors; other columns
    are left behind; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    width = aligner(a_file, b_file).width
    rows = materialise(aligned(docs, a_file, b_file, doc_id, text), "aligned")
    counts = materialise(pair_counts(rows), "pair-counts")
    # one row for each id of A at most
    best = counts.groupBy(F.expr(f"pair div {width}").alias("a")).agg(F.max("n").alias("most"))
    counts = counts.withColumn("a", F.expr(f"pair div {width}")).join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    hot = counts.orderBy(F.desc("n"), "pair").limit(hot_pairs).toArrow().sort_by("pair")
    shared = spark.sparkContext.broadcast(tuple(hot.column(c).to_numpy() for c in ("pair", "n", "best")))

    def sides(batch):
        """Row's place, pair, times, place among the hot ones, whether it is one."""
        pairs, times = _packed(batch.column("pairs")), _packed(batch.column("times"))
        place = np.repeat(np.arange(batch.num_rows), np.array([len(p) // 4 for p in batch.column("pairs").to_pylist()], np.int64))
        keys = shared.value[0]
        at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
        return place, pairs, times, at, keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)

    kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def summed(batches):
        _, n, best = shared.value
        for batch in batches:
            place, _, times, at, hit = sides(batch)
            place, times, at = place[hit], times[hit], at[hit]
            add = lambda x, place=place, batch=batch: pa.array(_sums(place, x, batch.num_rows))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), add(times * best[at]), add(times * n[at])], names=[*kept, "hot_best", "hot_sum"])

    def others(batches):
        for batch in batches:
            place, pairs, times, _, hit = sides(batch)
            row = batch.column("row").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(row[place[~hit]]), pa.array(pairs[~hit]), pa.array(times[~hit])], names=["row", "pair", "times"])

    start = map_arrow(rows, summed, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, hot_best long, hot_sum long")
    rest = map_arrow(rows.select("row", "pairs", "times"), others, "row long, pair long, times long")
    if hot.num_rows == hot_pairs:
        cold = rest.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("cold_best"), F.sum(F.col("times") * F.col("n")).alias("cold_sum"))
        start = start.join(cold, "row", "left")
    else:
        # all pairs are hot
        start = start.withColumns({"cold_best": F.lit(None).cast("long"), "cold_sum": F.lit(None).cast("long")})
    total = lambda name: (F.col(f"hot_{name}") + F.coalesce(F.col(f"cold_{name}"), F.lit(0))).cast("long")
    return start.select("doc_id", "n_a", "n_b", "n_groups", "n_links", total("best").alias("n_best"), total("sum").alias("count_sum"), "groups_sha256")


def _sums(place: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by ascending place, exact."""
    to = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    ends = np.searchsorted(place, np.arange(n + 1))
    return np.diff(to[ends])
