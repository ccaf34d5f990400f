"""Ranks over packed blocks against numpy on the driver."""

import random

import pytest

from graphloom.operators import grid, rank


def test_ranks_of_packed_blocks(spark, monkeypatch):
    """Several blocks and chunks, hubs, sinks, parallel links and nodes without
    any; a round keeps no row for a link."""
    monkeypatch.setattr(grid, "BLOCK_NODES", 20)
    monkeypatch.setattr(grid, "CHUNK", 7)
    draw = random.Random(2)
    links = [(f"n{draw.randrange(50)}", f"n{min(draw.randrange(50), draw.randrange(50))}") for _ in range(220)] + [("n0", f"n{i}") for i in range(40)]
    nodes, edges = spark.createDataFrame([(f"n{i}",) for i in range(55)], "id string"), spark.createDataFrame(links, "source_id string, target_id string")
    made, real = [], grid.Grid
    monkeypatch.setattr(rank, "Grid", lambda *a: made.append(real(*a)) or made[-1])
    for measure in (lambda k: rank.pagerank(nodes, edges, 4, driver_edges=k), lambda k: rank.resolvent(nodes, edges, "n3", 0.1, 3, driver_edges=k)):
        here, there = ({r[0]: r[1] for r in measure(k).collect()} for k in (1000, 0))
        assert len(here) > 40 and there == pytest.approx(here, abs=1e-9)
    here, there = (rank.spectral_radius(nodes, edges, 6, None, driver_edges=k).first()["radius"] for k in (1000, 0))
    assert there == pytest.approx(here, abs=1e-9)
    assert [g.blocks for g in made] == [3, 3, 3]
