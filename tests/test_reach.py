"""Cycles of any length and transitive reduction against brute force."""

import random

from graphloom.operators import traverse


def graph(spark, edges):
    return spark.createDataFrame(edges, "source_id long, target_id long")


def successors(edges):
    adj = {}
    for a, b in edges:
        if a != b:
            adj.setdefault(a, set()).add(b)
    return adj


def all_cycles(edges):
    adj, out = successors(edges), []

    def go(start, path):
        for y in adj.get(path[-1], ()):
            if y == start and len(path) > 1:
                out.append(path)
            elif y > start and y not in path:
                go(start, [*path, y])

    for s in adj:
        go(s, [s])
    return sorted(out, key=lambda c: (len(c), c))


def redundant(edges):
    adj = successors(edges)

    def reach(x):
        seen, todo = set(), [x]
        while todo:
            for y in adj.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    return sorted((a, b) for a in adj for b in adj[a] if any(w != b and b in reach(w) for w in adj[a]))


def test_cycles_and_reduction_of_random_graphs(spark):
    for seed in (0, 2):
        rng = random.Random(seed)
        edges = list({(rng.randrange(9), rng.randrange(9)) for _ in range(16)})
        got = traverse.simple_cycles(graph(spark, edges), limit=None).orderBy("length", "cycle").collect()
        assert [list(r["cycle"]) for r in got] == all_cycles(edges)
        assert sorted((r[0], r[1]) for r in traverse.transitive_reduction(graph(spark, edges)).filter("redundant").collect()) == redundant(edges)


def test_reduction_of_an_acyclic_graph(spark):
    rng = random.Random(5)
    edges = list({(min(p), max(p)) for p in ((rng.randrange(16), rng.randrange(16)) for _ in range(50)) if p[0] != p[1]})
    rows = traverse.transitive_reduction(graph(spark, edges)).collect()
    assert len(rows) == len(edges) and sorted((r[0], r[1]) for r in rows if r["redundant"]) == redundant(edges)


def test_rings_longer_than_any_bound(spark):
    ring = [(i, (i + 1) % 14) for i in range(14)] + [(14, 0), (3, 15)]
    got = traverse.simple_cycles(graph(spark, ring)).collect()
    assert [(list(r["cycle"]), r["length"]) for r in got] == [(list(range(14)), 14)]
    assert traverse.simple_cycles(graph(spark, ring), 13).count() == 0
    assert traverse.simple_cycles(graph(spark, []), None).count() == 0


def test_the_limit_ends_the_search(spark):
    full = [(a, b) for a in range(12) for b in range(12) if a != b]
    got = traverse.simple_cycles(graph(spark, full), limit=5).collect()
    assert [list(r["cycle"]) for r in got] == [[0, b] for b in range(1, 6)]


def test_reduction_makes_no_row_for_starts_and_ends_without_a_link(spark, monkeypatch):
    """40 starts lead over one node to 40 ends; each has one open link, one start
    has them all.  Tables stay as small as the links, and both ways of meeting
    find what the definition finds."""
    from graphloom.operators import traverse

    links = [(f"a{i:02d}", "m") for i in range(40)] + [("m", f"z{i:02d}") for i in range(40)] + [(f"a{i:02d}", f"z{i:02d}") for i in range(40)]
    links += [("a00", f"z{i:02d}") for i in range(1, 40)] + [("a01", "x"), ("x", "m"), ("y", "z01"), ("y", "q"), ("q", "w")]
    rows, cut = [], traverse.cut

    def counted(df, name="step"):
        table = cut(df, name)
        rows.append(table.count())
        return table

    monkeypatch.setattr(traverse, "cut", counted)
    df = spark.createDataFrame(links, "source_id string, target_id string")
    got = {(r["source_id"], r["target_id"]) for r in traverse.transitive_reduction(df).filter("redundant").collect()}
    out = {}
    for a, b in links:
        out.setdefault(a, set()).add(b)

    def reach(a):
        return set().union(*({b} | reach(b) for b in out.get(a, ())))

    assert got == {(a, b) for a, b in links if any(b in reach(c) for c in out[a])}
    assert len(got) == 80 and max(rows) <= len(links)


def test_reduction_writes_few_rows_for_a_link(spark, monkeypatch):
    """Orders lead to parts and suppliers, parts to suppliers, those to three
    regions, and orders to a region; one order has more links than a row may
    hold.  All tables written have at most five rows a link."""
    rng = random.Random(3)
    links = {(f"p{p}", f"s{rng.randrange(30)}") for p in range(60) for _ in range(3)} | {(f"s{s}", f"r{s % 3}") for s in range(30)}
    for o in range(400):
        links |= {(f"o{o}", f"p{rng.randrange(60)}") for _ in range(4)} | {(f"o{o}", f"s{rng.randrange(30)}") for _ in range(3)} | {(f"o{o}", f"r{rng.randrange(3)}")}
    links |= {("o0", f"p{p}") for p in range(60)}
    rows, cut = [], traverse.cut

    def counted(df, name="step"):
        table = cut(df, name)
        rows.append(table.count())
        return table

    monkeypatch.setattr(traverse, "cut", counted)
    monkeypatch.setattr(traverse, "WHOLE", 50, raising=False)
    got = traverse.transitive_reduction(spark.createDataFrame(sorted(links), "source_id string, target_id string")).filter("redundant").collect()
    assert sorted((r[0], r[1]) for r in got) == redundant(links)
    assert sum(rows) <= 5 * len(links), (sum(rows), len(links))
