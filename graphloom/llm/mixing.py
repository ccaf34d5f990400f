"""Mixing sources to target weights by Sainte-Lague apportionment.

The mix is made of blocks of equal size in words.  Blocks go to sources one by
one, always to the highest quotient target / (2 k + 1) of a source that has k
blocks already; the same rule deals a source's blocks to its shards by their
size.  So every shard gets an integer quota.  A shard lays its documents in a
seeded order end to end and takes whole rounds of all its blocks, then, for
the rest of its quota, a run of blocks from a seeded place on.

A shard holds about ``shard_rows`` documents of one source, so a source with
a third of all rows spreads over as many tasks as its size asks for.  A
source's blocks go to groups of up to GROUP shards first, and then to the
shards of each group, so no task sees more than a group.  Equal rows are
counted, then numbered, and each goes its own way.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise, send_package

BLOCK_WORDS, SHARD_ROWS, MOST_REPEATS = 16, 1_000, 3
#: Shards in a group, and groups in a source's list, are dealt in one task;
#: equal rows numbered in one task; sources whose list is broadcast.
GROUP, COPIES, SOURCES = 4_096, 1_000_000, 100_000


def sainte_lague(weights: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by highest quotients weight / (2 k + 1), at most most[i] for i.

    The quotient that just fits is found by bisection, the last seats follow
    one by one; ties go to the earlier place.  Fewer seats than asked for if
    all are at their most.
    """
    weights, most = np.asarray(weights, dtype=float), np.where(np.asarray(weights) > 0, most, 0).astype(np.int64)
    seats = int(min(seats, most.sum()))
    if seats <= 0:
        return np.zeros(len(weights), dtype=np.int64)

    def at(quotient: float) -> np.ndarray:
        return np.minimum(most, np.floor(np.minimum((weights / quotient + 1) / 2, 9e15)).astype(np.int64))

    low, high = weights[weights > 0].min() / (2.0 * seats + 2) / 1e3, weights.max() * 2
    while at(low).sum() < seats:
        low /= 2
    for _ in range(200):
        middle = (low + high) / 2
        if at(middle).sum() > seats:
            low = middle
        else:
            high = middle
    given = at(high)
    heap = [(-weights[i] / (2 * given[i] + 1), i) for i in np.flatnonzero(given < most).tolist()]
    heapq.heapify(heap)
    for _ in range(seats - int(given.sum())):
        _, i = heapq.heappop(heap)
        given[i] += 1
        if given[i] < most[i]:
            heapq.heappush(heap, (-weights[i] / (2 * given[i] + 1), i))
    return given


def capped_targets(sizes: list[int], weights: list[float], most_repeats: int = MOST_REPEATS) -> list[float]:
    """Shares of sum(sizes) by weight, none above most_repeats times its size;
    the excess goes to the others by weight until none is above."""
    total, target, capped = float(sum(sizes)), [0.0] * len(sizes), [False] * len(sizes)
    while True:
        rest = total - sum(t for t, c in zip(target, capped) if c)
        free = sum(w for w, c in zip(weights, capped) if not c)
        above = False
        for i, size in enumerate(sizes):
            if not capped[i]:
                target[i] = rest * weights[i] / free
        for i, size in enumerate(sizes):
            if not capped[i] and target[i] > most_repeats * size:
                target[i], capped[i], above = float(most_repeats * size), True, True
        if not above or all(capped):
            return target


def word_count(text):
    """Number of runs of [^\\x20\\x09-\\x0D] in a text; 0 for null."""
    gaps = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return F.coalesce(gaps.cast("long"), F.lit(0).cast("long"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Each row as often as it came, with its number among its equals (__copy)."""
    counted = materialise(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("__copies")), "rows")
    copies, least = F.col("__copies"), F.lit(COPIES).cast("long")
    one = F.lit(1).cast("long")
    few = counted.filter(copies <= least).withColumn("__copy", F.explode(F.sequence(one, copies)))
    # of very many the numbers are made by many tasks
    runs = counted.filter(copies > least).withColumn("__first", F.explode(F.sequence(one, copies, least)))
    many = runs.repartition("__h", "__first").withColumn("__copy", F.explode(F.sequence(F.col("__first"), F.least(copies, F.col("__first") + least - 1)))).drop("__first")
    return few.unionByName(many).drop("__copies")


def _deal(name: str):
    """Blocks of one list of shards or groups by Sainte-Lague: adds ``seats``."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(name)
        weights, most = (np.array(table.column(c).to_pylist(), dtype=np.int64) for c in ("words", "most"))
        return table.append_column("seats", pa.array(sainte_lague(weights, int(table.column("quota")[0].as_py()), most)))

    return run


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (1.0, 2.0, 3.0), keep: tuple[str, ...] = (), block_words: int = BLOCK_WORDS, shard_rows: int = SHARD_ROWS, seed: int = 17) -> DataFrame:
    """doc_id, keep columns, size, source_size, target, taken for every row.

    Sources by code point, null last, have the weights in turn.  taken is the
    number of words the mix takes from the row, repeats counted, at most 3
    times its size.  Texts that are null or have no word give nothing; very
    long ones are a stretch of words like others.  Equal rows may be taken
    differently often; which one is which does not matter.  Other columns are
    left behind; an empty table gives an empty one.  The list of sources is
    all that reaches the driver.  Reruns agree.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), *keep, F.col(source).cast("string").alias("__source"), word_count(F.col(text)).alias("size"), F.xxhash64(F.col(text).cast("string")).alias("__h"))
    rows = materialise(_numbered(rows), "sizes")
    sources = rows.groupBy("__source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).collect()
    sources.sort(key=lambda r: (r[0] is None, (r[0] or "").encode("utf-32-be")))
    sizes = [int(r["size"]) for r in sources]
    targets = capped_targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))])
    blocks = np.array([-(-s // block_words) for s in sizes], dtype=np.int64)
    quota = sainte_lague(np.array(targets), round(sum(sizes) / block_words), MOST_REPEATS * blocks)
    plan = [(r["__source"], i, sizes[i], targets[i], -(-int(r["rows"]) // shard_rows), int(quota[i])) for i, r in enumerate(sources)]
    plan_df = spark.createDataFrame(plan, "__s string, __k long, source_size long, target double, __shards long, quota long")
    listed = F.broadcast(plan_df) if len(plan) <= SOURCES else plan_df
    place = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), "__h", "__copy")
    dealt = rows.join(listed, F.col("__source").eqNullSafe(F.col("__s"))).withColumn("__place", place).withColumn("__shard", F.pmod(F.xxhash64("__place"), F.col("__shards")))

    # quotas: of a source's groups of shards, then of each group's shards
    full = F.ceil(F.col("words") / F.lit(block_words)).cast("long")
    shards = dealt.groupBy("__k", "__shard").agg(F.sum("size").alias("words"), F.first("quota").alias("quota"))
    shards = shards.select("__k", F.floor(F.col("__shard") / GROUP).cast("long").alias("__group"), "__shard", "words", (MOST_REPEATS * full).alias("most"), "quota")
    shards = materialise(shards, "shards")
    send_package(spark)
    groups = shards.groupBy("__k", "__group").agg(F.sum("words").alias("words"), F.sum("most").alias("most"), F.first("quota").alias("quota"))
    groups = groups.groupBy("__k").applyInArrow(_deal("__group"), "__k long, __group long, words long, most long, quota long, seats long")
    own = shards.drop("quota").join(groups.select("__k", "__group", F.col("seats").alias("quota")), ["__k", "__group"])
    takes = own.groupBy("__k", "__group").applyInArrow(_deal("__shard"), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields) + ", seats long")
    have = F.col("most") / F.lit(MOST_REPEATS)
    seats = lambda c: F.when(F.col("most") > 0, c).otherwise(F.lit(0)).cast("long")
    takes = takes.withColumn("__have", have.cast("long")).select(
        "__k", "__shard", F.col("words").alias("__words"),
        seats(F.floor(F.col("seats") / F.col("__have"))).alias("__rounds"),
        seats(F.pmod(F.xxhash64(F.lit(seed), "__k", "__shard"), F.col("__have")) * F.lit(block_words)).alias("__from"),
        seats((F.col("seats") % F.col("__have")) * F.lit(block_words)).alias("__run"),
    )
    taken = dealt.drop("quota").join(materialise(takes, "takes"), ["__k", "__shard"])
    # each document is a stretch of its shard's words; the run may wrap around the end
    w = Window.partitionBy("__k", "__shard").orderBy("__place", "doc_id", "__h", "__copy")
    taken = taken.withColumn("__end", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__start", F.col("__end") - F.col("size"))
    # a wrapped run starts within the last block, which may be short
    over = lambda a, b: F.greatest(F.lit(0).cast("long"), F.least(F.col("__end"), b) - F.greatest(F.col("__start"), a))
    stop = F.col("__from") + F.col("__run")
    length = F.ceil(F.col("__words") / F.lit(block_words)).cast("long") * F.lit(block_words)
    extra = over(F.col("__from"), F.least(stop, F.col("__words"))) + over(F.lit(0).cast("long"), stop - length)
    return taken.select("doc_id", *keep, "size", "source_size", "target", (F.col("__rounds") * F.col("size") + F.when(F.col("__run") > 0, extra).otherwise(F.lit(0))).cast("long").alias("taken"))
