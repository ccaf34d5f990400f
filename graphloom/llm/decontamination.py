"""Benchmark decontamination by spaced-seed hashing.

A seed is a mask over a run of words: it hashes the words under its ones and
ignores those under its zeros, so a passage with some words replaced still
shares seeds with its source.  Test items and training texts are joined on
mask and hash; each hit fixes an alignment of the item with the text (a
diagonal), and around it the overlap is verified word by word: a text is
contaminated by an item if some aligned stretch reaches ``least_words`` words
(or the whole item, if that is shorter) with a share ``identity`` of them equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, keep_rows, map_arrow, materialise, utf8
from .shingles import mix, word_hashes

#: Masks over word positions.  Any two words replaced in a run of 12 leave one whole.
MASKS = ("11101", "1100101", "10110001", "110010001")
#: For items of fewer words than the masks need.
SHORT_MASKS = ("111", "11", "1")
LEAST_WORDS, IDENTITY = 12, 0.8
#: Item seeds up to this number travel to the tasks at once (16 bytes each).
BROADCAST_SEEDS = 4_000_000
_STEP = np.uint64(0xD6E8FEB86659FD93)


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the words under the mask's ones at every place it fits."""
    m = words.size - len(mask) + 1
    if m < 1:
        return np.empty(0, dtype=np.uint64)
    h = np.full(m, np.uint64(int(mask, 2) * 64 + len(mask)))
    for i, bit in enumerate(mask):
        if bit == "1":
            h = h * _STEP + words[i : i + m]
    return mix(h)


def masks_for(n: int) -> tuple[str, ...]:
    """Masks for an item of n words.

    Short items must be there as a whole with a fifth of their words replaced
    at most; by counting, a run of three equal words is left then, or of two
    in items of five.
    """
    if n >= LEAST_WORDS:
        return MASKS
    return ("1" * {1: 1, 2: 2, 5: 2}.get(n, 3),)


def best_stretch(item: np.ndarray, text: np.ndarray, shift: int, least: int = LEAST_WORDS, identity: float = IDENTITY) -> tuple[int, int, int] | None:
    """(start in the text, words, equal words) of the longest stretch of the
    diagonal text = item + shift with enough equal words; None if there is none.

    A stretch starts and ends with an equal word; a short item must be there
    as a whole.
    """
    a, b = max(0, -shift), min(item.size, text.size - shift)
    need = min(least, item.size)
    if b - a < need:
        return None
    same = item[a:b] == text[a + shift : b + shift]
    if int(same.sum()) < identity * need:
        return None
    # score of a stretch: equal words less identity times words, kept >= 0
    total = np.concatenate(([0.0], np.cumsum(same - identity)))
    ends = np.flatnonzero(same)
    best = None
    # leftmost start with a prefix sum not above that of the end
    lowest = np.minimum.accumulate(total[ends])
    for e in ends[::-1].tolist():
        i = int(np.searchsorted(-lowest, -(total[e + 1] + 1e-9), side="left"))
        if i < ends.size and ends[i] <= e:
            s = int(ends[i])
            n = e - s + 1
            if n >= need and (best is None or n > best[1]):
                best = (s + a + shift, n, int(same[s : e + 1].sum()))
    return best


def _item_seeds(items: list[tuple[int, np.ndarray]]) -> list[tuple[int, int, int, int]]:
    """(mask number, hash, item index, place) of all seeds of the items."""
    masks = MASKS + SHORT_MASKS
    return [(masks.index(m), int(h), i, p) for i, (_, w) in enumerate(items) for m in masks_for(w.size) for p, h in enumerate(seed_hashes(w, m).tolist())]


def hits(words: np.ndarray, index: dict[int, tuple[np.ndarray, ...]]) -> set[tuple[int, int]]:
    """(item index, shift) of every seed that a text shares with an item."""
    found: set[tuple[int, int]] = set()
    masks = MASKS + SHORT_MASKS
    for m, (keys, first, slots, maybe) in index.items():
        h = seed_hashes(words, masks[m])
        # a bitmap on the top bits settles nearly all places
        place = np.flatnonzero(maybe[(h >> np.uint64(64 - int(maybe.size).bit_length() + 1)).astype(np.int64)])
        h = h[place]
        at = np.searchsorted(keys, h)
        at[at == keys.size] = 0
        for j in np.flatnonzero(keys[at] == h).tolist():
            k = at[j]
            for i, p in slots[first[k] : first[k + 1]].tolist():
                found.add((i, int(place[j]) - p))
    return found


def build_index(items: list[tuple[int, np.ndarray]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By mask: sorted distinct hashes, where each one's slots start, the slots
    (item index, place), and a bitmap of the hashes' top bits."""
    rows = _item_seeds(items)
    out = {}
    for m in sorted({r[0] for r in rows}):
        own = sorted(r[1:] for r in rows if r[0] == m)
        keys, first = np.unique(np.array([r[0] for r in own], dtype=np.uint64), return_index=True)
        maybe = np.zeros(1 << min(28, max(16, int(keys.size).bit_length() + 5)), dtype=bool)
        maybe[(keys >> np.uint64(64 - int(maybe.size).bit_length() + 1)).astype(np.int64)] = True
        out[m] = (keys, np.append(first, len(own)), np.array([r[1:] for r in own], dtype=np.int64), maybe)
    return out


def verified(words: np.ndarray, items: list[tuple[int, np.ndarray]], index: dict, least: int = LEAST_WORDS, identity: float = IDENTITY) -> list[tuple[int, int, int, int]]:
    """(item id, start, words, equal words) of the best overlap with each item."""
    best: dict[int, tuple[int, int, int]] = {}
    for i, shift in hits(words, index):
        if (s := best_stretch(items[i][1], words, shift, least, identity)) and (i not in best or (s[1], s[2], -s[0]) > (best[i][1], best[i][2], -best[i][0])):
            best[i] = s
    return sorted((items[i][0], *s) for i, s in best.items())


def _blocks(tests: DataFrame, item_id: str, item_text: str) -> Iterator[tuple[list[tuple[int, np.ndarray]], bool]]:
    """(item id, word hashes) of the distinct items, in blocks of BROADCAST_SEEDS
    seeds, and whether a block is the last; the driver holds two at most."""
    tests = tests.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    block, size = [], 0
    for r in tests.orderBy("item_id", "text").toLocalIterator():
        w = word_hashes(r["text"].encode())
        if not w.size:
            continue
        if block and size + 4 * w.size > BROADCAST_SEEDS:
            yield block, False
            block, size = [], 0
        block.append((r["item_id"], w))
        size += 4 * w.size
    yield block, True


def contaminated(docs: DataFrame, tests: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least_words: int = LEAST_WORDS, identity: float = IDENTITY, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per contaminated document: doc_id, keep columns, item_ids, starts, words, equal.

    item_ids are the distinct items found, in order; starts (place of the
    first word in the document), words and equal describe the best overlap
    with each.  Whole texts are read.  Null or wordless texts and items match
    nothing; items without an id are left out; repeated items count once.
    Repeated documents give a row each.  Other columns are left behind; empty
    tables give an empty one.

    Test sets are small beside the training data: while their seeds number
    BROADCAST_SEEDS or less the join is done in the tasks that read the
    training texts, without moving them.  Larger test sets are handled in
    blocks of that size, one after another; the rows are written in between
    with what they have found, so no size changes results.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *keep, F.col(text).cast("string").alias("__text"))
    names = ["doc_id", *keep]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1]) + "item_ids array<long>, starts array<int>, words array<int>, equal array<int>"
    lists = ("item_ids", "starts", "words", "equal")

    def against(rows, items, later: bool, last: bool):
        shared = spark.sparkContext.broadcast((items, build_index(items)))

        def run(batches):
            items, index = shared.value
            for batch in batches:
                found = [verified(word_hashes(t), items, index, least_words, identity) if index else [] for t in utf8(batch.column("__text"))]
                if later:
                    for f, *known in zip(found, *(batch.column(c).to_pylist() for c in lists)):
                        f.extend(zip(*known))
                        f.sort()
                best = []
                for f in found:
                    by: dict[int, tuple[int, int, int]] = {}
                    for i, *s in f:
                        if i not in by or s[1] > by[i][1]:
                            by[i] = tuple(s)
                    best.append(sorted(by.items()))
                at = pa.array([i for i, b in enumerate(best) if b or not last], pa.int64())
                best = [b for b in best if b or not last]
                kept = [batch.column(k).take(at) for k in range(len(names) + (not last))]
                values = [pa.array([[i for i, _ in b] for b in best], pa.list_(pa.int64()))] + [pa.array([[s[j] for _, s in b] for b in best], pa.list_(pa.int32())) for j in range(3)]
                yield pa.RecordBatch.from_arrays([*kept, *values], names=[*names, *([] if last else ["__text"]), *lists])

        return map_arrow(rows, run, schema if last else schema.replace("item_ids array<long>", "`__text` string, item_ids array<long>"))

    # each row carries what it has found from block to block
    for k, (items, last) in enumerate(_blocks(tests, item_id, item_text)):
        found = against(rows, items, k > 0, last)
        if last:
            return found
        before, rows = rows, materialise(found, "contamination")
        discard(before)


def clean(docs: DataFrame, tests: DataFrame, text: str = "text", **how) -> DataFrame:
    """The rows of docs, all columns, that no item of tests contaminates.

    Rows without id, text or words stay.  The same test as in contaminated().
    """
    spark, least, identity = docs.sparkSession, how.get("least_words", LEAST_WORDS), how.get("identity", IDENTITY)
    for items, _ in _blocks(tests, how.get("item_id", "item_id"), how.get("item_text", "text")):
        shared = spark.sparkContext.broadcast((items, build_index(items)))
        docs = keep_rows(docs, text, lambda texts, shared=shared: [not verified(word_hashes(t), *shared.value, least, identity) for t in texts])
    return docs
