"""Connected components of a distributed edge table by contraction."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (x, y); root is one node of its component.

    In each round every node joins the one of itself and its neighbours that
    comes first in an order by hash; edges are drawn between the joined nodes
    and loops vanish.  An order serves two rounds: the first draws the leaves
    of a star to their centre's first neighbour, the second ends it.  Then a
    new one follows: as no shape fits all orders, a constant share of a
    component's nodes is expected to go with each, whatever its shape and
    numbering, so rounds grow with the logarithm of its size.  Nothing but a
    flag reaches the driver.
    """
    edges = materialise(edges.filter("x <> y").select("x", "y").distinct(), "edges")
    roots = materialise(edges.select(F.col("x").alias("node")).union(edges.select("y")).distinct().withColumn("root", F.col("node")), "roots")
    for turn in itertools.count():
        if edges.isEmpty():
            return roots
        order = lambda c, turn=turn: F.struct(F.xxhash64(F.lit(turn // 2), c).alias("first"), c.alias("node"))
        both = edges.union(edges.select("y", "x"))
        move = materialise(both.groupBy(F.col("x").alias("from")).agg(F.least(F.min(order(F.col("y"))), order(F.first("x")))["node"].alias("to")), "move")
        # a chain of moves ends in the next rounds: to's own move is an edge still
        to = lambda name: move.select(F.col("from").alias(name), F.col("to").alias(f"{name}2"))
        roots = materialise(roots.join(to("root"), "root", "left").select("node", F.coalesce("root2", "root").alias("root")), "roots")
        moved = edges.join(to("x"), "x", "left").join(to("y"), "y", "left").select(F.coalesce("x2", "x").alias("x"), F.coalesce("y2", "y").alias("y"))
        edges = materialise(moved.filter("x <> y").distinct(), "edges")
