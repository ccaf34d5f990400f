"""Exact similarity join of documents on word 5-grams (Jaccard 0.8 or more).

Documents with equal shingle sets form one node.  Nodes meet on the n-grams of
their prefixes only:

* rare-first order: n-grams are ordered by document frequency, then by hash.
  The frequency is counted, over all documents, for the n-grams in a fixed
  part of the hash space (``region``); the rest follow by hash alone.  That
  is one order for all documents, as prefix filtering needs, at a third of
  the data a count of all n-grams would move;
* prefix filter: two sets of similarity s share one of the first
  n - ceil(s n) + 1 n-grams of that order;
* length filter: neither set is smaller than s times the other;
* positional filter: shared n-grams of the prefixes plus what follows behind
  them in both sets must reach the overlap that the pair needs;
* suffix filter: the parts of both sets between fixed pivots of the hash space
  bound the overlap before it is counted.

Each remaining pair is verified once on its whole sets.

Of a large group of near copies not all pairs are made.  The nodes of an
n-gram are first compared with the group's hub, the node with the least
n-grams of its own, and what is left then with further hubs, HUBS in all.
What linked to a hub is one component; afterwards only nodes outside the first
hub's component are compared with those of other components, so none loses a
link that connects it to another.  Those comparisons are dealt by blocks of the
group, and no pair leaves them that its sketches rule out: 512 parity bits of
a set, of which two sets differ in no more bits than n-grams.

Links lie within components, so they are counted there: the nodes of a
component are dealt by pairs of blocks, and every pair of nodes is counted in
one of them by its overlap.  No list of links is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import discard, map_arrow, materialise, send_package, utf8
from .components import connected
from .shingles import shingle_set

#: Similarity as a fraction; part of the hash space whose n-grams are counted.
NUM, DEN, REGION = 4, 5, 0.25
#: Rows of n-grams per Arrow batch; n-grams carry 48 bits of their hash.
ROWS, TOKEN_BITS = 200_000, 48
#: Longs of a sketch; its columns.
WIDE = 8
SKETCH = [f"s{i}" for i in range(WIDE)]
#: Nodes and bytes of sets in a block at most, in expectation; pairs verified
#: beside one copy of a node's set; columns of a block's incidence matrix.
BLOCK, BLOCK_BYTES, STAR, COLUMNS = 512, 4_000_000, 8, 4096
#: Hubs that a group's nodes are compared with one by one.
HUBS = 3
#: Bits for each key in a map of keys; bits in a page of one.
KEY_BITS, PAGE = 16, 32_768


def prefix_length(n: int) -> int:
    """n - ceil(s n) + 1 for a set of n n-grams; 0 for none."""
    return n - -(-NUM * n // DEN) + 1 if n else 0


def least_overlap(n: Column, m: Column) -> Column:
    """Smallest overlap of sets of n and m with Jaccard s: s (n + m) / (1 + s)."""
    return F.ceil(F.lit(NUM) * (n + m) / F.lit(NUM + DEN)).cast("long")


def similar(x: np.ndarray, y: np.ndarray, pivots: int = 16) -> bool:
    """Whether two sorted sets have a Jaccard similarity of s or more.

    First the suffix filter: the smaller of the two counts between each two
    neighbouring pivots, summed, bounds the overlap.
    """
    need = -(-NUM * (x.size + y.size) // (NUM + DEN))
    if min(x.size, y.size) < need:
        return False
    cuts = (np.arange(1, pivots, dtype=np.uint64)) << np.uint64(60)
    a = np.diff(np.searchsorted(x, cuts), prepend=0, append=x.size)
    b = np.diff(np.searchsorted(y, cuts), prepend=0, append=y.size)
    if np.minimum(a, b).sum() < need:
        return False
    return np.intersect1d(x, y, assume_unique=True).size >= need


def _signature(grams: np.ndarray) -> int:
    """63 bits that stand for a set; equal sets have equal ones."""
    return xxhash.xxh3_64_intdigest(grams.astype("<u8").tobytes()) >> 1


def _sets(region: float, k: int):
    """Per document: set size, signature, and once per task and set its
    n-grams of the region (6 bytes each), then further ones for the prefix."""
    cut = np.uint64(int(region * 2.0**64))
    mask = np.uint64((1 << TOKEN_BITS) - 1)

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            n, sig, packed, more = [], [], [], []
            for raw in utf8(batch.column("text")):
                grams = shingle_set(raw, k)
                s = _signature(grams) if grams.size else None
                n.append(grams.size)
                sig.append(s)
                if s is None or s in seen:
                    packed.append(None)
                    more.append(None)
                    continue
                seen.add(s)
                at = int(np.searchsorted(grams, cut))
                extra = max(0, prefix_length(grams.size) - at)
                packed.append(_pack(grams[:at]))
                more.append((grams[at : at + extra] & mask).astype(np.int64).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(n, pa.int64()), pa.array(sig, pa.int64()), pa.array(packed, pa.binary()), pa.array(more, pa.list_(pa.int64()))],
                names=["doc_id", "key", "n", "sig", "packed", "more"],
            )

    return run


def _sketch(grams: np.ndarray) -> np.ndarray:
    """Parities of the numbers of n-grams by 9 bits of their hash, as longs."""
    odd = np.bincount((grams & np.uint64(64 * WIDE - 1)).astype(np.int64), minlength=64 * WIDE) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _whole(k: int):
    """The whole set of a node and its sketch."""

    def run(batches):
        for batch in batches:
            rows = []
            for s, raw in zip(batch.column("sig").to_pylist(), utf8(batch.column("text"))):
                grams = shingle_set(raw, k)
                if grams.size and _signature(grams) == s:
                    rows.append((s, grams.size, grams.astype("<u8").tobytes(), *_sketch(grams).tolist()))
            kinds = (pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * WIDE)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["sig", "n", "grams", *SKETCH])

    return run


def _pack(grams: np.ndarray) -> bytes:
    return grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : TOKEN_BITS // 8].tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // 6, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view("<u8").astype(np.int64)


def _short(batch: pa.RecordBatch) -> Iterator[tuple[list[np.ndarray], int, int]]:
    """N-grams of rows a to b of a batch, about ROWS at a time: packed ones, or
    whole sets cut to 48 bits."""
    packed = "packed" in batch.schema.names
    column, mask = batch.column("packed" if packed else "grams"), np.uint64((1 << TOKEN_BITS) - 1)
    parts, first, size = [], 0, 0
    for i, raw in enumerate(column):
        parts.append(_unpack(raw.as_py()) if packed else (np.frombuffer(raw.as_py(), "<u8") & mask).astype(np.int64))
        size += parts[-1].size
        if size >= ROWS:
            yield parts, first, i + 1
            parts, first, size = [], i + 1, 0
    if parts:
        yield parts, first, len(column)


def _postings(batches):
    """(t, sig) for each n-gram."""
    for batch in batches:
        sigs = batch.column("sig").to_numpy(zero_copy_only=False)
        for parts, a, b in _short(batch):
            s = np.repeat(sigs[a:b], [p.size for p in parts])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts)), pa.array(s)], names=["t", "sig"])


def _grams(batches):
    """(t) for each n-gram."""
    for batch in batches:
        for parts, _, _ in _short(batch):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts))], names=["t"])


def _prefixes(once: DataFrame, packed: str) -> DataFrame:
    """(t, sig, n, rank, own): the n-grams of each node's prefix that may occur
    elsewhere, their place in the node's order, and the share of n-grams that
    no other node has.

    once: (sig, n, <packed>, counted, more), a row or some equal ones a node."""
    shared = map_arrow(once.select(packed), _grams, "t long").groupBy("t").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    postings = map_arrow(once.select("sig", packed), _postings, "t long, sig long")
    by_node = postings.join(shared, "t").groupBy("sig").agg(F.sort_array(F.collect_set(F.struct("df", "t"))).alias("s"))
    meta = once.groupBy("sig").agg(F.first("n").alias("n"), F.first("counted").alias("in_region"), F.first("more").alias("more"))
    p = F.expr(f"n - ceil({NUM} * n / {DEN}) + 1").cast("long")
    node = meta.join(by_node, "sig", "left").withColumn("s", F.coalesce("s", F.expr("filter(array(named_struct('df', 0L, 't', 0L)), x -> false)")))
    node = node.withColumn("alone", F.col("in_region") - F.size("s")).withColumn("room", F.greatest(F.lit(0), p - F.col("alone")).cast("int"))
    node = node.withColumn("grams", F.slice(F.concat(F.transform("s", lambda x: x["t"]), F.col("more")), F.lit(1), F.col("room"))).filter("room > 0")
    return node.select("sig", "n", "alone", (F.col("alone") / F.greatest(F.lit(1), "in_region")).alias("own"), F.posexplode("grams").alias("pos", "t")).select("t", "sig", "n", (F.col("alone") + F.col("pos")).alias("rank"), "own")


def _possible(n: Column, rank: Column, m: Column, other: Column) -> Column:
    """Length and positional filter for a shared n-gram at these places."""
    long_enough = F.lit(DEN) * F.least(n, m) >= F.lit(NUM) * F.greatest(n, m)
    return long_enough & (F.lit(1) + F.least(n - rank, m - other) - 1 >= least_overlap(n, m))


def _pairs(matches: DataFrame) -> DataFrame:
    """Distinct pairs (x < y) of matches (x, n, rank, y, m, other) whose shared
    prefix n-grams leave room for the overlap."""
    low, high = F.col("x") < F.col("y"), F.col("x") > F.col("y")
    turned = matches.filter(low | high).select(
        F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"),
        *(F.when(low, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("n", "m"), ("rank", "other"), ("m", "n"), ("other", "rank"))),
    )
    return turned.groupBy("x", "y").agg(F.first("n").alias("n"), F.first("m").alias("m")).select("x", "y")


def _may_match(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """The rows whose name, a hash, may be among keys, and few others: what a
    join with keys would drop after a shuffle is dropped where it is read.

    A bit of a map stands for each key, KEY_BITS bits a key: about one in
    KEY_BITS of the other rows stays, so the join must follow."""
    size = PAGE * -(-max(1, KEY_BITS * keys.count()) // PAGE)
    at = F.pmod(F.col(name), F.lit(size))
    pages = keys.groupBy((at / PAGE).cast("int").alias("page")).agg(F.bitmap_construct_agg(at % PAGE).alias("bits")).collect()
    bits = np.zeros(size // 8, dtype=np.uint8)
    for page, found in pages:
        bits[page * PAGE // 8 : (page + 1) * PAGE // 8] = np.frombuffer(found, np.uint8)
    shared, place = rows.sparkSession.sparkContext.broadcast(bits), rows.columns.index(name)

    def run(batches):
        for batch in batches:
            h = np.mod(batch.column(place).to_numpy(zero_copy_only=False), size)
            yield batch.filter(pa.array((shared.value[h >> 3] >> (h & 7) & 1).astype(bool)))

    return map_arrow(rows, run, rows.schema)


def _side(sets: DataFrame, name: str, *columns: str) -> DataFrame:
    """(name, name_<column>...) of each node of sets."""
    return sets.select(F.col("sig").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in columns))


def _close(x: str, y: str) -> Column:
    """Whether two sketches allow the overlap that the sets' sizes ask for."""
    apart = sum((F.bit_count(F.col(f"{x}_{s}").bitwiseXOR(F.col(f"{y}_{s}"))) for s in SKETCH), F.lit(0))
    n, m = F.col(f"{x}_n"), F.col(f"{y}_n")
    return apart <= n + m - 2 * least_overlap(n, m)


def _sketched(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that their sketches leave open."""
    both = pairs.join(_side(sets, "x", "n", *SKETCH), "x").join(_side(sets, "y", "n", *SKETCH), "y")
    return both.filter(_close("x", "y")).select("x", "y")


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose whole sets are similar.

    A node's partners are dealt in rows of about STAR, each with one copy of
    its own set.  Sets of nodes without a partner are not moved."""
    sets = _may_match(sets.select("sig", "grams"), pairs.select(F.explode(F.array("x", "y")).alias("sig")).distinct(), "sig")
    counts = pairs.groupBy("y").agg(F.count(F.lit(1)).alias("partners"))
    dealt = pairs.join(counts, "y").withColumn("part", F.pmod(F.xxhash64("x"), F.ceil(F.col("partners") / STAR)))
    star = dealt.join(_side(sets, "x", "grams"), "x").groupBy("y", "part").agg(F.collect_list(F.struct("x", "x_grams")).alias("others"))
    rows = star.join(_side(sets, "y", "grams"), "y").select("y", "y_grams", "others")

    def run(batches):
        for batch in batches:
            for y, own, others in zip(*(batch.column(c) for c in ("y", "y_grams", "others"))):
                mine = np.frombuffer(own.as_py(), "<u8")
                found = [o["x"].as_py() for o in others if similar(np.frombuffer(o["x_grams"].as_py(), "<u8"), mine)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([y.as_py()] * len(found), pa.int64())], names=["x", "y"])

    return map_arrow(rows, run, "x long, y long")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set on the left with each on the right."""
    sizes = [g.size for g in (*left, *right)]
    grams, column, seen = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    row, often = np.repeat(np.arange(len(sizes)), sizes), seen[column] > 1
    column, row = (np.cumsum(seen > 1) - 1)[column[often]], row[often]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((len(left), len(right)), dtype=np.float64)
    for a in range(0, int(column[-1]) + 1 if column.size else 0, COLUMNS):
        i, j = np.searchsorted(column, (a, a + COLUMNS))
        m = np.zeros((len(sizes), COLUMNS), dtype=np.float32)
        m[row[i:j], column[i:j] - a] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out


def _block_links(table: pa.Table) -> pa.Table:
    """(sig, links) in one pair of a component's blocks, or within one block."""
    side = np.array(table.column("side").to_pylist())
    sigs, n, copies = (np.array(table.column(c).to_pylist(), dtype=np.int64) for c in ("sig", "n", "copies"))
    grams = [np.frombuffer(g, "<u8") for g in table.column("grams").to_pylist()]
    x, y = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)
    if not x.size or not y.size:
        return pa.table({"sig": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
    shared = overlaps([grams[i] for i in x], [grams[i] for i in y])
    linked = (shared >= -(-NUM * (n[x][:, None] + n[y][None, :]) // (NUM + DEN))) & (sigs[x][:, None] != sigs[y][None, :])
    if x.size == side.size:  # one block: its own transpose
        return pa.table({"sig": sigs[x], "links": linked @ copies[y]})
    return pa.table({"sig": np.concatenate([sigs[x], sigs[y]]), "links": np.concatenate([linked @ copies[y], copies[x] @ linked])})


def _count_links(roots: DataFrame, sets: DataFrame, copies: DataFrame) -> DataFrame:
    """(sig, links): for each node of a component the documents, of other
    nodes, that are similar to it.

    Blocks are pairs of at most about BLOCK nodes each; a block meets itself
    (side 0) and every other one of its component (sides -1 and 1)."""
    members = sets.select("sig", "n", "grams").join(roots.withColumnRenamed("node", "sig"), "sig").join(copies, "sig")
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.octet_length("grams")) / BLOCK_BYTES)).cast("int").alias("blocks"))
    dealt = members.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("root", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), F.signum(F.col("own") - F.col("other")).cast("int").alias("side"), "sig", "n", "copies", "grams")
    send_package(dealt.sparkSession)
    found = dealt.groupBy("root", "a", "b").applyInArrow(_block_links, "sig long, links long")
    return found.groupBy("sig").agg(F.sum("links").alias("links"))


def _classes(docs: DataFrame, doc_id: str, text: str, k: int, region: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n, sig) of every row, and of every signature with a copy
    or a link (sig, component, links, keeper): keeper is the key of the row
    with the smallest id, nulls last, then the smallest key of the component."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    raw = materialise(map_arrow(rows, _sets(region, k), "doc_id long, key long, n long, sig long, packed binary, more array<long>"), "sets")
    table = materialise(raw.select("doc_id", "key", "n", "sig"), "signatures")
    once = raw.filter("packed IS NOT NULL").select("sig", "n", "packed", (F.octet_length("packed") / 6).cast("long").alias("counted"), "more")
    prefixes = materialise(_prefixes(once, "packed"), "prefixes")

    # nodes that may meet another go on with whole sets, and the order is made
    # anew from exact frequencies of all n-grams among them
    meeting = prefixes.groupBy("t").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("t")
    wanted = prefixes.join(meeting, "t").select("sig").distinct()
    keeper = materialise(raw.filter("packed IS NOT NULL").select("key", "sig").join(wanted, "sig").groupBy("sig").agg(F.min("key").alias("key")), "kept")
    discard(raw, prefixes)
    # repeated rows have one key, and are where the join has put them
    texts = _may_match(rows.select("key", "text"), keeper, "key").join(keeper, "key").dropDuplicates(["key", "sig"]).select("sig", "text")
    sets = materialise(map_arrow(texts, _whole(k), "sig long, n long, grams binary, " + ", ".join(f"{s} long" for s in SKETCH)), "grams")
    discard(keeper)
    none = F.array().cast("array<long>")
    prefixes = materialise(_prefixes(sets.select("sig", "n", "grams", F.col("n").alias("counted"), none.alias("more")), "grams"), "prefixes")
    # n-grams of one node only link nothing; the hub has the least of its own
    hubs = prefixes.groupBy("t").agg(F.min(F.struct("own", "sig", "n", "rank")).alias("hub"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    groups = materialise(prefixes.join(hubs, "t"), "groups")
    discard(prefixes)
    hub = F.col("hub")
    near_hub = groups.filter((F.col("sig") != hub["sig"]) & _possible(F.col("n"), F.col("rank"), hub["n"], hub["rank"]))
    first = materialise(_pairs(near_hub.select(F.col("sig").alias("x"), "n", "rank", hub["sig"].alias("y"), hub["n"].alias("m"), hub["rank"].alias("other"))), "pairs")
    links = materialise(_verify(materialise(_sketched(first, sets), "sketched"), sets), "links")
    roots = connected(links)

    # further hubs: of the nodes outside the first one's component, by hash
    def place(rows: DataFrame) -> DataFrame:
        """The rows of groups that are not within one component yet.  Components
        only grow, so later rounds look at what an earlier one has left."""
        found = rows.select("t", "sig", "n", "rank", "size", "hub_sig").join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
        found = materialise(found, "rooted")
        per = found.groupBy("t").agg(F.max(F.when(F.col("sig") == F.col("hub_sig"), F.col("root"))).alias("hub_root"), F.min("root").alias("low"), F.max("root").alias("high"))
        placed = materialise(found.join(per.filter("low <> high").select("t", "hub_root"), "t").withColumn("blocks", F.ceil(F.col("size") / BLOCK)), "placed")
        discard(found)
        return placed

    # two nodes of one group have met already: one of them is the hub
    placed, compared = place(groups.filter("size > 2").withColumn("hub_sig", hub["sig"])), first
    for k in range(1, HUBS):
        left = placed.filter("root <> hub_root")
        again = left.groupBy("t").agg(F.min(F.struct(F.xxhash64(F.lit(k), "sig").alias("h"), "sig", "n", "rank", "root")).alias("hub"))
        met = left.join(again, "t").filter((F.col("root") != hub["root"]) & _possible(F.col("n"), F.col("rank"), hub["n"], hub["rank"]))
        pairs = _pairs(met.select(F.col("sig").alias("x"), "n", "rank", hub["sig"].alias("y"), hub["n"].alias("m"), hub["rank"].alias("other"))).join(compared, ["x", "y"], "left_anti")
        pairs = materialise(pairs, "pairs")
        if pairs.isEmpty():
            break
        more = materialise(_verify(materialise(_sketched(pairs, sets), "sketched"), sets), "links")
        links, compared = materialise(links.union(more), "links"), materialise(compared.union(pairs), "pairs")
        roots = connected(links)
        before, placed = placed, place(placed)
        discard(before, more, pairs)
    discard(groups)

    # what did not join its hub's component meets the others of the group
    outside = placed.filter("root <> hub_root").select("t", F.col("sig").alias("x"), "rank", F.col("root").alias("root_x"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    others = placed.select("t", F.col("sig").alias("y"), F.col("rank").alias("other"), F.col("root").alias("root_y"), "hub_root", F.pmod(F.xxhash64("sig"), F.col("blocks")).alias("block"))
    outside, others = outside.join(_side(sets, "x", "n", *SKETCH), "x"), others.join(_side(sets, "y", "n", *SKETCH), "y")
    # two outsiders meet once, an outsider and an insider always
    meet = outside.join(others, ["t", "block"]).filter(
        (F.col("root_x") != F.col("root_y")) & ((F.col("root_y") == F.col("hub_root")) | (F.col("x") < F.col("y"))) & _possible(F.col("x_n"), F.col("rank"), F.col("y_n"), F.col("other")) & _close("x", "y")
    )
    second = materialise(_pairs(meet.select("x", F.col("x_n").alias("n"), "rank", "y", F.col("y_n").alias("m"), "other")).join(compared, ["x", "y"], "left_anti"), "pairs")
    more = materialise(_verify(second, sets), "links")
    roots = connected(links.union(more))

    least = F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "key")).alias("least")
    classes = materialise(table.filter("sig IS NOT NULL").groupBy("sig").agg(least, F.count(F.lit(1)).alias("copies")), "nodes")
    counted = materialise(_count_links(roots, sets, classes.select("sig", "copies")), "counted")
    discard(sets, placed, first, compared, second, links, more)
    joined = classes.join(roots.withColumnRenamed("node", "sig"), "sig", "left")
    heads = joined.filter("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("head"))
    known = joined.filter("root IS NOT NULL OR copies > 1").join(heads, "root", "left").join(counted, "sig", "left").withColumn("head", F.coalesce("head", "least"))
    known = known.select("sig", F.col("head.doc_id").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.col("head.key").alias("keeper"))
    return table, materialise(known, "classes")


def similarity_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, region: float = REGION) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for every row.

    component_id is the smallest doc_id reachable over links; n_links the
    number of other rows that the row is linked with.  Null or empty texts and
    texts without words have an empty set and are linked with nothing: their
    component is their own id.  Rows repeat as they come; equal texts are
    linked (a null id takes part, but never names a component while another id
    is there).  Very long texts are handled whole, in the task that reads
    them.  Other columns are left behind; an empty table gives an empty one.
    """
    table, known = _classes(docs, doc_id, text, k, region)
    return table.join(known, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).alias("n_links"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, region: float = REGION) -> DataFrame:
    """The rows of docs, all columns, but of each component one row only: that
    with the smallest id, null ids last; of different texts under that id the
    one with the smaller hash of id and text.

    Decisions are about rows, not ids: a text that is similar to no other
    stays whatever else has its id.  Null and empty texts and texts without
    words are similar to nothing and all stay, repeated or not.
    """
    table, known = _classes(docs, doc_id, text, k, region)
    found = table.join(known, "sig").select("key", "keeper")
    gone = found.filter("key <> keeper").select("key").distinct()
    again = found.filter("key = keeper").groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("key")
    marks = materialise(gone.withColumn("__again", F.lit(False)).union(again.withColumn("__again", F.lit(True))), "copies")
    # a name that no column of docs has
    name = "__key" + "_" * max((len(c) for c in docs.columns), default=0)
    keyed = docs.withColumn(name, F.xxhash64(F.col(doc_id).cast("long"), F.col(text).cast("string")))
    left = keyed.join(marks.select(F.col("key").alias(name)), name, "left_anti").select(*docs.columns)
    if marks.filter("__again").isEmpty():
        return left
    # equal rows: one of them, taken before anything is moved
    once = keyed.join(marks.filter("__again").select(F.col("key").alias(name)), name).dropDuplicates([name])
    return left.unionByName(once.select(*docs.columns))
