"""Products of a large sparse matrix with vectors that are packed by blocks.

Nodes are dealt to blocks by hash and have a place in theirs.  Links are dealt
by the blocks of both ends and packed once, so a round moves some bytes a
link, and of the vectors one copy for each block, not a row for each link.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut, send_package

#: Links of a pair of blocks and nodes of a block, about; links of a packed row.
BLOCK_LINKS, BLOCK_NODES, CHUNK = 2_000_000, 500_000, 250_000

STATE = "block int, x binary, extra binary, p double, q double"


def _vector(table: pa.Table, column: str) -> np.ndarray:
    return np.frombuffer(table.column(column)[0].as_py(), "<f8")


def _state(block: int, x: np.ndarray, extra: np.ndarray, p: float = 0.0, q: float = 0.0) -> pa.Table:
    packed = [pa.array([v.astype("<f8").tobytes()], pa.binary()) for v in (x, extra)]
    return pa.table([pa.array([block], pa.int32()), *packed, pa.array([float(p)]), pa.array([float(q)])], names=["block", "x", "extra", "p", "q"])


def _packed(table: pa.Table) -> pa.Table:
    """A pair of blocks' links in rows of CHUNK, by the place they lead from."""
    a, b, w = (table.column(c).to_numpy() for c in ("a", "b", "w"))
    order = np.lexsort((b, a))
    rows = []
    for i in range(0, order.size, CHUNK):
        o = order[i : i + CHUNK]
        rows.append((np.diff(a[o], prepend=0).astype("<i4").tobytes(), b[o].astype("<i4").tobytes(), w[o].astype("<f8").tobytes()))
    ends = [pa.array([table.column(c)[0].as_py()] * len(rows), pa.int32()) for c in ("from", "to")]
    return pa.table([*ends, *(pa.array([r[i] for r in rows], pa.binary()) for i in range(3))], names=["from", "to", "a", "b", "w"])


class Grid:
    """Links (a, b, w) between ids, as a matrix that leads from a to b.

    nodes: (id, x, extra), distinct ids; extra is a number that a node keeps.
    A state holds x and extra by blocks, and two sums that a round made."""

    def __init__(self, nodes: DataFrame, links: DataFrame, n: int, size: int, block_links: int | None = None):
        send_package(nodes.sparkSession)
        # a hash deals nodes to blocks unevenly by little
        self.blocks = blocks = max(1, math.ceil(math.sqrt(size / (block_links or BLOCK_LINKS))), math.ceil(n / BLOCK_NODES))
        block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
        place = (F.row_number().over(Window.partitionBy("block").orderBy("id")) - 1).cast("int")
        self.places = cut(nodes.withColumn("block", block).withColumn("place", place), "places")
        end = lambda name, to, at: self.places.select(F.col("id").alias(name), F.col("block").alias(to), F.col("place").alias(at))
        laid = links.join(end("a", "from", "pa"), "a").join(end("b", "to", "pb"), "b").select("from", "to", F.col("pa").alias("a"), F.col("pb").alias("b"), F.col("w").cast("double").alias("w"))
        self.links = cut(laid.groupBy("from", "to").applyInArrow(_packed, "from int, to int, a binary, b binary, w binary"), "grid")

    def start(self) -> DataFrame:
        def run(table):
            order = np.argsort(table.column("place").to_numpy())
            x, extra = (table.column(c).to_numpy()[order] for c in ("x", "extra"))
            return _state(table.column("block")[0].as_py(), x, extra)

        rows = self.places.select("block", "place", F.col("x").cast("double").alias("x"), F.col("extra").cast("double").alias("extra"))
        return cut(rows.groupBy("block").applyInArrow(run, STATE), "state")

    def step(self, state: DataFrame, change) -> DataFrame:
        """The next state: change(flow, x, extra) gives x and the two sums, where
        flow is what links bring to a node, the sum of w x[a]."""

        def product(links, xs):
            if not links.num_rows or not xs.num_rows:
                return pa.table([pa.array([], pa.int32()), pa.array([], pa.binary())], names=["block", "flow"])
            x, out = _vector(xs, "x"), np.zeros(xs.column("size")[0].as_py())
            for a, b, w in zip(*(links.column(c) for c in ("a", "b", "w"))):
                at = np.cumsum(np.frombuffer(a.as_py(), "<i4"))
                out += np.bincount(np.frombuffer(b.as_py(), "<i4"), np.frombuffer(w.as_py(), "<f8") * x[at], out.size)
            return pa.table([pa.array([xs.column("to")[0].as_py()], pa.int32()), pa.array([out.astype("<f8").tobytes()], pa.binary())], names=["block", "flow"])

        def update(flows, old):
            x, extra = _vector(old, "x"), _vector(old, "extra")
            flow = np.zeros(x.size)
            for part in flows.column("flow"):
                flow += np.frombuffer(part.as_py(), "<f8")
            return _state(old.column("block")[0].as_py(), *(lambda r: (r[0], extra, r[1], r[2]))(change(flow, x, extra)))

        sizes = state.select(F.col("block").alias("to"), (F.octet_length("x") / 8).cast("int").alias("size"))
        xs = state.select(F.col("block").alias("from"), "x").join(sizes.hint("broadcast"), F.lit(True))
        parts = self.links.groupBy("from", "to").cogroup(xs.groupBy("from", "to")).applyInArrow(product, "block int, flow binary")
        return cut(parts.groupBy("block").cogroup(state.groupBy("block")).applyInArrow(update, STATE), "state")

    def rows(self, state: DataFrame) -> DataFrame:
        """(id, x)."""
        kind = self.places.schema["id"].dataType.simpleString()

        def run(places, states):
            x = _vector(states, "x")[places.column("place").to_numpy()]
            return pa.table([places.column("id"), pa.array(x)], names=["id", "x"])

        return self.places.select("block", "id", "place").groupBy("block").cogroup(state.select("block", "x").groupBy("block")).applyInArrow(run, f"id {kind}, x double")
