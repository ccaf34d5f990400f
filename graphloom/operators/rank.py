"""Iterative linear algebra on graphs: ranks, spectral radius, resolvent.

A graph of up to DRIVER_EDGES distinct weighted edges - the size is checked -
is iterated in numpy on the driver, as a Spark job per round would take longer
than all the rounds.  Beyond that links and vectors are packed by blocks
(``grid.py``), a product is one cogroup of both, and each round is written to
shared storage.  Both ways give the same numbers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .grid import Grid

DRIVER_EDGES = 500_000


def weighted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, w): closed edges with parallel weights (1 each if there is none) summed."""
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    ids = nodes.select("id")
    summed = edges.groupBy(F.col("source_id").alias("a"), F.col("target_id").alias("b")).agg(F.sum(weight).alias("w"))
    return summed.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")


def _ranks(nodes: DataFrame, links: DataFrame, rounds: int, damping: float, tolerance: float | None, spread: bool, driver_edges: int) -> DataFrame:
    """(id, score) over links (a, b, w) whose weights share out a node's score."""
    links = cut(links, "shares")
    ids = nodes.select("id").distinct()
    n = ids.count()
    if not n:
        return ids.withColumn("score", F.lit(0.0))
    if local := _local(nodes, links, driver_edges):
        names, a, b, w = local
        sink = np.bincount(a, minlength=n) == 0
        x = np.full(n, 1.0 / n)
        for _ in range(rounds):
            mass = x[sink].sum() / n if spread else 0.0
            old, x = x, (1 - damping) / n + damping * (np.bincount(b, w * x[a], n) + mass)
            if tolerance is not None and np.abs(x - old).sum() < tolerance:
                break
        kind = nodes.schema["id"].dataType.simpleString()
        return nodes.sparkSession.createDataFrame([(i, float(v)) for i, v in zip(names, x)], f"id {kind}, score double")
    leads = links.select(F.col("a").alias("id")).distinct().withColumn("leads", F.lit(True))
    start = ids.join(leads, "id", "left").select("id", F.lit(1.0 / n).alias("x"), F.col("leads").isNull().cast("double").alias("extra"))
    grid = Grid(start, links, n, links.count())
    ranks = grid.start()
    mass = grid.places.agg(F.sum("extra")).first()[0] / n / n if spread else 0.0
    for _ in range(rounds):
        def change(flow, x, sink, mass=mass):
            fresh = (1 - damping) / n + damping * (flow + mass)
            return fresh, fresh[sink > 0].sum(), np.abs(fresh - x).sum()

        ranks = grid.step(ranks, change)
        lost, moved = ranks.agg(F.sum("p"), F.sum("q")).first()
        mass = lost / n if spread else 0.0
        if tolerance is not None and moved < tolerance:
            break
    return grid.rows(ranks).select("id", F.col("x").alias("score"))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 100, damping: float = 0.85, tolerance: float | None = 1e-6, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(id, score): parallel edges weigh, the mass of nodes without successor
    is spread evenly.  Stops when the scores move less than tolerance in sum;
    tolerance None runs all rounds.  Edges must be closed."""
    one = edges.select("source_id", "target_id")
    degree = one.groupBy(F.col("source_id").alias("a")).agg(F.count(F.lit(1)).alias("degree"))
    links = one.groupBy(F.col("source_id").alias("a"), F.col("target_id").alias("b")).agg(F.count(F.lit(1)).alias("k")).join(degree, "a").select("a", "b", (F.col("k") / F.col("degree")).alias("w"))
    return _ranks(nodes, links, rounds, damping, tolerance, True, driver_edges)


def pagerank_plain(nodes: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(id, score): each distinct predecessor gives its score divided by all its
    edges, dangling ones included; nodes without successor give nothing."""
    degree = edges.groupBy(F.col("source_id").alias("a")).agg(F.count(F.lit(1)).alias("degree"))
    ids = nodes.select("id")
    links = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).distinct().join(degree, "a").select("a", "b", (1 / F.col("degree")).alias("w"))
    links = links.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi")
    return _ranks(nodes, links, rounds, damping, None, False, driver_edges)


def _local(nodes: DataFrame, links: DataFrame, driver_edges: int):
    """(ids, a, b, w) of a graph that fits the driver, else None."""
    if links.count() > driver_edges or nodes.count() > driver_edges:
        return None
    names = sorted(r["id"] for r in nodes.select("id").distinct().collect())
    at = {x: i for i, x in enumerate(names)}
    rows = [(at[r["a"]], at[r["b"]], r["w"]) for r in links.collect()]
    return (names, *(np.array(c) for c in zip(*rows))) if rows else (names, np.empty(0, int), np.empty(0, int), np.empty(0))


def spectral_radius(nodes: DataFrame, edges: DataFrame, rounds: int = 150, tolerance: float | None = 1e-7, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """One row (radius, threshold): power iteration on the transposed adjacency.

    A vector that vanishes - no cycle - gives radius 0 and an infinite
    epidemic threshold."""
    links = cut(weighted(nodes, edges), "weights")
    local, radius, last = _local(nodes, links, driver_edges), 0.0, None
    n = nodes.count()
    x = np.full(n, max(n, 1) ** -0.5)
    if not local:
        grid = Grid(nodes.select("id", F.lit(max(n, 1) ** -0.5).alias("x"), F.lit(1.0).alias("extra")).dropDuplicates(["id"]), links, n, links.count())
        y = grid.start()
    for _ in range(rounds):
        if local:
            _, a, b, w = local
            y = np.bincount(b, w * x[a], n)
            radius = float(np.linalg.norm(y))
        else:
            scale = last if last is not None else 1.0
            y = grid.step(y, lambda flow, x, extra, scale=scale: (flow / scale, (flow / scale) @ (flow / scale), 0.0))
            radius = (y.agg(F.sum("p")).first()[0] or 0.0) ** 0.5
        if radius < 1e-12:
            radius = 0.0
            break
        if tolerance is not None and last is not None and abs(radius - last) < tolerance:
            break
        last = radius
        if local:
            x = y / radius
    return nodes.sparkSession.createDataFrame([(float(radius), float("inf") if radius <= 0 else 1.0 / radius)], "radius double, threshold double")


def resolvent(nodes: DataFrame, edges: DataFrame, target, alpha: float | None, rounds: int = 50, tolerance: float | None = 1e-6, least: float = 1e-4, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(id, impact): x = e + alpha A x, the damped sum over all paths that end
    at the target; impacts above least, rounded to 6 places, without the target.
    Without alpha the spectral radius decides on it."""
    if alpha is None:
        alpha = resolvent_alpha(spectral_radius(nodes, edges, driver_edges=driver_edges).first()["radius"])
    links = cut(weighted(nodes, edges), "weights")
    if local := _local(nodes, links, driver_edges):
        names, a, b, w = local
        e = np.array([1.0 if i == target else 0.0 for i in names])
        x = e
        for _ in range(rounds):
            old, x = x, e + alpha * np.bincount(a, w * x[b], len(names))
            if tolerance is not None and np.abs(x - old).max(initial=0) < tolerance:
                break
        kind = nodes.schema["id"].dataType.simpleString()
        found = nodes.sparkSession.createDataFrame([(i, float(v)) for i, v in zip(names, x)], f"id {kind}, x double")
    else:
        e = F.when(F.col("id") == target, 1.0).otherwise(0.0)
        start = nodes.select("id", e.alias("x"), e.alias("extra")).dropDuplicates(["id"])
        grid = Grid(start, links.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"), nodes.count(), links.count())
        state = grid.start()
        for _ in range(rounds):
            def change(flow, x, e):
                fresh = e + alpha * flow
                return fresh, 0.0, np.abs(fresh - x).max(initial=0)

            state = grid.step(state, change)
            if tolerance is not None and (state.agg(F.max("q")).first()[0] or 0) < tolerance:
                break
        found = grid.rows(state)
    return found.filter((F.col("id") != target) & (F.col("x") > least)).select("id", F.round("x", 6).alias("impact"))


def resolvent_alpha(radius: float) -> float:
    """Damping that keeps the resolvent's sum finite."""
    return min(0.85, 0.9 / radius) if radius > 0 else 0.5
