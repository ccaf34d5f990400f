"""Whole-graph measures: modularity, curvature, spectra, orders, causality."""

from __future__ import annotations

import heapq
import itertools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from ..views import both_directions, closed, simple_undirected
from .order import placed, running
from .traverse import descendants, shortest_paths

#: Edges up to which the greedy and spectral measures take a graph to the
#: driver, where a step costs less than a job; beyond it they run as joins.
DRIVER_EDGES = 200_000


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (nodes, edges, density); 0 for fewer than two nodes."""
    n, e = nodes.agg(F.count(F.lit(1)).alias("nodes")), edges.agg(F.count(F.lit(1)).alias("edges"))
    d = F.when(F.col("nodes") <= 1, 0.0).otherwise(F.round(F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1) + 1e-9), 4))
    return n.crossJoin(F.broadcast(e)).select("nodes", "edges", d.alias("density"))


def degrees(edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree over all edges, duplicates counted; one shuffle."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def hubs(edges: DataFrame, threshold: int = 5) -> DataFrame:
    """id, in_degree, out_degree, total, kind of nodes with threshold edges or more."""
    d = degrees(edges.filter(F.col("source_id") != F.col("target_id"))).withColumn("total", F.col("in_degree") + F.col("out_degree")).filter(F.col("total") >= threshold)
    kind = F.when((F.col("in_degree") >= 2 * F.col("out_degree")) & (F.col("in_degree") >= 4), "AFFERENT").when((F.col("out_degree") >= 2 * F.col("in_degree")) & (F.col("out_degree") >= 4), "EFFERENT").otherwise("BALANCED")
    return d.withColumn("kind", kind)


def degree_entropy(edges: DataFrame) -> DataFrame:
    """One row: Shannon entropy (bits) of the degree distribution, 4 places."""
    both = both_directions(simple_undirected(edges))
    deg = both.groupBy("a").agg(F.count(F.lit(1)).alias("d"))
    # log2(T) - sum(d log2 d) / T needs one pass
    return deg.agg(F.round(F.log2(F.sum("d")) - F.sum(F.col("d") * F.log2("d")) / F.sum("d"), 4).alias("entropy"))


def _apart(rows: DataFrame) -> DataFrame:
    """rows for joins that meet them by a shuffle: they grow with the graph,
    and what is broadcast goes through the driver."""
    return rows.hint("merge")


def modularity(pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """One row: modularity of a partition (id, community) of undirected pairs."""
    c = lambda end: _apart(membership).select(F.col("id").alias(end), F.col("community").alias(f"c{end}"))
    e = pairs.join(c("u"), "u").join(c("v"), "v")
    inside = e.filter("cu = cv").groupBy(F.col("cu").alias("c")).agg(F.count(F.lit(1)).alias("e"))
    ends = e.select(F.explode(F.array("cu", "cv")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("a"))
    m = e.agg(F.count(F.lit(1)).alias("m"))
    return ends.join(_apart(inside), "c", "left").crossJoin(F.broadcast(m)).agg(F.round(F.sum(F.coalesce("e", F.lit(0)) / F.col("m") - F.pow(F.col("a") / (2 * F.col("m")), F.lit(2.0))), 6).alias("q"))


def triangles(pairs: DataFrame) -> DataFrame:
    """(u, v, w) with u < v < w, each triangle once.

    Pairs are oriented from the end of lower degree, so a hub never fans out
    into all pairs of its neighbours."""
    deg = both_directions(pairs).groupBy("a").agg(F.count(F.lit(1)).alias("d"))
    d = lambda end: deg.select(F.col("a").alias(end), F.col("d").alias(f"d{end}"))
    e = pairs.join(d("u"), "u").join(d("v"), "v")
    low = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    o = e.select(F.when(low, F.col("u")).otherwise(F.col("v")).alias("x"), F.when(low, F.col("v")).otherwise(F.col("u")).alias("y"))
    wedge = o.join(o.select("x", F.col("y").alias("z")), "x").filter("y < z").select("x", "y", "z")
    found = wedge.join(pairs.select(F.col("u").alias("y"), F.col("v").alias("z")), ["y", "z"], "left_semi")
    s = F.sort_array(F.array("x", "y", "z"))
    return found.select(s[0].alias("u"), s[1].alias("v"), s[2].alias("w"))


def forman_ricci(pairs: DataFrame) -> DataFrame:
    """u, v, curvature = 4 - d(u) - d(v) + 3 * triangles of each undirected edge."""
    deg = both_directions(pairs).groupBy("a").agg(F.count(F.lit(1)).alias("d"))
    d = lambda end: deg.select(F.col("a").alias(end), F.col("d").alias(f"d{end}"))
    t = triangles(pairs)
    sides = t.select(F.explode(F.array(*(F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in (("u", "v"), ("u", "w"), ("v", "w"))))).alias("e")).groupBy("e.u", "e.v").agg(F.count(F.lit(1)).alias("t"))
    return pairs.join(d("u"), "u").join(d("v"), "v").join(sides, ["u", "v"], "left").select("u", "v", (4 - F.col("du") - F.col("dv") + 3 * F.coalesce("t", F.lit(0))).cast("long").alias("curvature"))


def gromov_delta(nodes: DataFrame, edges: DataFrame, sample: int = 50, quadruples: int = 200, max_depth: int | None = None) -> DataFrame:
    """One row (delta, tree_like, quadruples): four-point condition over the first
    sets of four of the first nodes in id order; pairs without path are skipped.

    The sample is the feature: it bounds the work on any graph."""
    first = nodes.select("id").orderBy("id").limit(sample)
    both = both_directions(simple_undirected(edges)).select(F.col("a").alias("source_id"), F.col("b").alias("target_id"))
    dist = {(r["source"], r["id"]): r["hops"] for r in shortest_paths(nodes, both, first, max_depth).join(F.broadcast(first), "id", "left_semi").select("source", "id", "hops").collect()}
    ids = sorted({a for a, _ in dist})
    delta, n = 0.0, 0
    for a, b, c, d in itertools.islice(itertools.combinations(ids, 4), quadruples):
        pairs = [(a, b, c, d), (a, c, b, d), (a, d, b, c)]
        if all((p, q) in dist and (r, s) in dist for p, q, r, s in pairs):
            s = sorted(dist[p, q] + dist[r, t] for p, q, r, t in pairs)
            delta, n = max(delta, (s[2] - s[1]) / 2), n + 1
    return nodes.sparkSession.createDataFrame([(float(delta), delta <= 1.5, n)], "delta double, tree_like boolean, quadruples int")


def _driver_rows(edges: DataFrame, most: int) -> list | None:
    """The rows, if there are no more than most."""
    rows = edges.limit(most + 1).collect() if most else []
    return rows if most and len(rows) <= most else None


def merged_communities(pairs: DataFrame) -> DataFrame:
    """id, community of the ends of undirected pairs (u, v), by rounds of joins.

    In a round each community names the neighbour with the highest positive
    modularity gain, ties to the smaller names.  Two that name each other
    merge, and others that could gain with one of the two only follow, the
    highest gains first, as long as they still gain by what has joined before.  The
    pair of the highest gain of all always merges, and no merge loses
    modularity.  Communities are named by their smallest member.

    No table of a round is broadcast: rounds are many, and so all of them
    would send the driver many times what the graph holds."""
    links = cut(pairs.select(F.col("u").alias("a"), F.col("v").alias("b"), F.lit(1.0).alias("w")), "links")
    m = links.count()
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).cast("double").alias("d"))
    degree = cut(ends.select(F.col("id").alias("c"), "d"), "degree")
    member = degree.select(F.col("c").alias("id"), F.col("c").alias("community"))
    if not m:
        return member
    d = lambda end: _apart(degree).select(F.col("c").alias(end), F.col("d").alias(f"d{end}"))
    while True:
        gain = F.col("w") / m - F.col("da") * F.col("db") / (2.0 * m * m)
        gains = links.join(d("a"), "a").join(d("b"), "b").withColumn("gain", gain).filter("gain > 0")
        sides = F.array(F.struct(F.col("a").alias("c"), F.col("b").alias("p"), F.col("da").alias("dc")), F.struct(F.col("b").alias("c"), F.col("a").alias("p"), F.col("db").alias("dc")))
        rows = gains.select("a", "b", "w", "gain", F.explode(sides).alias("s")).select("a", "b", "w", "gain", "s.*")
        best = rows.groupBy("c").agg(F.min(F.struct((-F.col("gain")).alias("g"), "a", "b", "p", "w", F.col("dc").alias("d"))).alias("m"), F.count(F.lit(1)).alias("options"))
        best = cut(best.select("c", "options", "m.p", "m.w", "m.d", (-F.col("m.g")).alias("gain")), "best")
        if best.isEmpty():
            return member
        back = best.select(F.col("c").alias("p"), F.col("p").alias("c"), F.col("d").alias("dp"))
        core = cut(best.join(_apart(back), ["c", "p"]).filter("c < p").select(F.col("c").alias("lead"), F.col("p").alias("mate"), (F.col("d") + F.col("dp")).alias("have")), "core")
        of = core.select("lead", "have", F.explode(F.array("lead", "mate")).alias("p"))
        rest = best.filter("options = 1").join(_apart(of).select(F.col("p").alias("c")), "c", "left_anti").join(_apart(of), "p")
        follow = running(rest, [F.desc("gain"), "c"], F.col("d"), "so_far", ["lead"], many=True)
        joins = follow.filter(F.col("w") / m - F.col("d") * (F.col("have") + F.col("so_far") - F.col("d")) / (2.0 * m * m) > 0)
        moves = cut(core.select(F.col("mate").alias("c"), "lead").union(joins.select("c", "lead")), "moves")
        # the smallest name leads
        names = core.select(F.col("lead").alias("c"), "lead").union(moves)
        least = names.groupBy("lead").agg(F.min("c").alias("to"))
        moves = cut(names.join(_apart(least), "lead").select("c", "to"), "moves")
        to = lambda end: _apart(moves).select(F.col("c").alias(end), F.col("to").alias(f"to_{end}"))
        member = cut(member.join(to("community"), "community", "left").select("id", F.coalesce("to_community", "community").alias("community")), "member")
        degree = cut(degree.join(to("c"), "c", "left").groupBy(F.coalesce("to_c", "c").alias("c")).agg(F.sum("d").alias("d")), "degree")
        moved = links.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"), "w").filter("a <> b")
        links = cut(moved.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w")), "links")


def greedy_communities(nodes: DataFrame, edges: DataFrame, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """id, community (its smallest member): merges the adjacent pair of the
    highest modularity gain until none is positive; ties by smallest names.

    Empty for fewer than three nodes or two undirected edges.  That order is
    sequential: up to driver_edges distinct pairs are merged on the driver,
    larger graphs by merged_communities().  Nodes without a pair are
    communities of their own and stay in Spark."""
    closed_pairs = simple_undirected(closed(_apart(nodes), edges))
    rows = _driver_rows(closed_pairs, driver_edges)
    if rows is None:
        closed_pairs = cut(closed_pairs, "pairs")
        merged = merged_communities(closed_pairs)
        alone = nodes.select("id").distinct().join(_apart(merged).select("id"), "id", "left_anti")
        found = merged.union(alone.select("id", F.col("id").alias("community")))
        few = closed_pairs.limit(2).count() < 2 or nodes.select("id").limit(3).count() < 3
        return found.limit(0) if few else found
    pairs = sorted((r["u"], r["v"]) for r in rows)
    ids = sorted({x for pair in pairs for x in pair})
    spark = nodes.sparkSession
    schema = f"id {nodes.schema['id'].dataType.simpleString()}, community {nodes.schema['id'].dataType.simpleString()}"
    if len(pairs) < 2 or nodes.select("id").limit(3).count() < 3:
        return spark.createDataFrame([], schema)
    m = len(pairs)
    link: dict = {i: {} for i in ids}
    for u, v in pairs:
        link[u][v] = link[v][u] = 1
    degree = {i: len(link[i]) for i in ids}
    member = {i: [i] for i in ids}
    gain = lambda a, b: link[a][b] / m - degree[a] * degree[b] / (2 * m * m)
    heap = [(-gain(u, v), u, v) for u, v in pairs]
    heapq.heapify(heap)
    while heap:
        g, a, b = heapq.heappop(heap)
        if a not in member or b not in member or b not in link[a] or abs(-g - gain(a, b)) > 1e-15:
            continue
        if -g <= 0:
            break
        member[a] += member.pop(b)
        for c, w in link.pop(b).items():
            del link[c][b]
            if c != a:
                link[a][c] = link[c][a] = link[a].get(c, 0) + w
        degree[a] += degree.pop(b)
        for c in link[a]:
            x, y = min(a, c), max(a, c)
            heapq.heappush(heap, (-gain(x, y), x, y))
    merged = spark.createDataFrame([(i, min(group)) for group in member.values() for i in group], schema)
    alone = nodes.select("id").distinct().join(merged.select("id"), "id", "left_anti")
    return merged.union(alone.select("id", F.col("id").alias("community")))


def fiedler_vector(nodes: DataFrame, edges: DataFrame, steps: int = 80, tolerance: float = 1e-9) -> tuple[float, DataFrame, DataFrame]:
    """(lambda2, (id, x, degree), (u, v, w)) of a graph with edges between its nodes.

    Lanczos on I + D^-1/2 A D^-1/2 without its first vector, D^1/2: a step is a
    join of the edges with the last vector and a sum; each new vector is made
    orthogonal to all before it, which lie beside it in its row.  Only sums,
    one for each vector, reach the driver.  x is the second vector by D^-1/2.
    """
    pairs = edges.filter("source_id <> target_id").select(F.least("source_id", "target_id").alias("u"), F.greatest("source_id", "target_id").alias("v")).groupBy("u", "v").agg(F.count(F.lit(1)).alias("w"))
    ids = nodes.select("id").distinct()
    pairs = cut(pairs.join(ids.withColumnRenamed("id", "u"), "u", "left_semi").join(ids.withColumnRenamed("id", "v"), "v", "left_semi"), "pairs")
    both = pairs.select(F.col("u").alias("a"), F.col("v").alias("b"), "w").union(pairs.select("v", "u", "w"))
    degree = cut(ids.join(both.groupBy(F.col("a").alias("id")).agg(F.sum("w").cast("double").alias("degree")), "id", "left").fillna(0.0, ["degree"]), "degree")
    half = lambda end: degree.filter("degree > 0").select(F.col("id").alias(end), (1 / F.sqrt("degree")).alias(f"h{end}"))
    scaled = cut(both.join(half("a"), "a").join(half("b"), "b").select("a", "b", (F.col("w") * F.col("ha") * F.col("hb")).alias("w")), "scaled")
    whole = degree.agg(F.sum("degree")).first()[0] or 0.0
    if not whole:
        return 0.0, degree.select("id", F.lit(0.0).alias("x"), "degree"), pairs
    # v holds the first vector and all that were found; y is the next one before it is made orthogonal
    sign = F.when(F.pmod(F.xxhash64("id"), F.lit(2)) == 0, 1.0).otherwise(-1.0) + F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(1000)) / 1000.0
    now = cut(degree.select("id", F.array(F.sqrt(F.col("degree") / whole)).alias("v"), sign.alias("y")), "lanczos")
    dots = lambda df, n: list(df.agg(*(F.sum(F.col("v")[i] * F.col("y")) for i in range(n))).first())
    alpha, beta = [], []
    for k in range(1, steps + 2):
        for turn in range(2):  # a second time, for what rounding left
            c = dots(now, k)
            if turn == 0 and k > 1:
                alpha.append(c[-1])
            minus = F.col("y")
            for i, x in enumerate(c):
                minus = minus - F.lit(x) * F.col("v")[i]
            now = cut(now.select("id", "v", minus.alias("y")), "lanczos")
        size = math.sqrt(now.agg(F.sum(F.col("y") * F.col("y"))).first()[0] or 0.0)
        if k > 1:
            values, vectors = np.linalg.eigh(np.diag(alpha) + np.diag(beta, 1) + np.diag(beta, -1))
            if size * abs(vectors[-1, -1]) < tolerance or size < 1e-10 or k > steps:
                break
            beta.append(size)
        elif size < 1e-10:
            return 0.0, degree.select("id", F.lit(0.0).alias("x"), "degree"), pairs
        unit = now.select("id", F.concat("v", F.array(F.col("y") / size)).alias("v"))
        flow = scaled.join(unit.select(F.col("id").alias("b"), F.element_at("v", -1).alias("q")), "b").groupBy(F.col("a").alias("id")).agg(F.sum(F.col("w") * F.col("q")).alias("flow"))
        now = cut(unit.join(flow, "id", "left").select("id", "v", (F.element_at("v", -1) + F.coalesce("flow", F.lit(0.0))).alias("y")), "lanczos")
    x = F.lit(0.0)
    for i, part in enumerate(vectors[:, -1]):
        x = x + F.lit(float(part)) * F.col("v")[i + 1]
    found = now.select("id", x.alias("x")).join(degree, "id").select("id", F.when(F.col("degree") > 0, F.col("x") / F.sqrt("degree")).otherwise(0.0).alias("x"), "degree")
    return min(2.0, max(0.0, 2 - float(values[-1]))), cut(found, "fiedler"), pairs


def sweep(vector: DataFrame, pairs: DataFrame) -> tuple[float, DataFrame]:
    """(conductance, (id, side)) of the best cut of the nodes (id, x, degree) in
    the order of x: side is true for the smaller part.

    Places come from ranges of the order.  A pair (u, v, w) is cut between its
    ends' places, so a cut's weight and volume are running sums by place."""
    laid = cut(placed(vector, ["x", "id"]), "placed")
    at = lambda end: laid.select(F.col("id").alias(end), F.col("place").alias(f"p{end}"))
    ends = pairs.join(at("u"), "u").join(at("v"), "v").select("w", F.least("pu", "pv").alias("lo"), F.greatest("pu", "pv").alias("hi"))
    change = ends.select(F.explode(F.array(F.struct(F.col("lo").alias("place"), F.col("w").alias("w")), F.struct(F.col("hi").alias("place"), (-F.col("w")).alias("w")))).alias("e")).groupBy("e.place").agg(F.sum("e.w").alias("w"))
    steps = laid.join(change, "place", "left").select("place", "degree", F.coalesce("w", F.lit(0)).cast("double").alias("w"))
    sums = running(running(steps, ["place"], F.col("w"), "cut"), ["place"], F.col("degree"), "volume")
    n, whole = laid.agg(F.count(F.lit(1)), F.sum("degree")).first()
    small = F.least("volume", F.lit(whole) - F.col("volume"))
    best = sums.filter(F.col("place") < n - 1).filter(small > 0).agg(F.min(F.struct(F.round(F.col("cut") / small, 12).alias("c"), "place")).alias("b")).first()["b"]
    if best is None:
        return 0.0, laid.select("id", F.lit(False).alias("side"))
    first = best["place"] + 1
    below = F.col("place") < first
    # of equal halves that with the smallest name
    front = laid.agg(F.min_by("place", "id")).first()[0] < first if first * 2 == n else first * 2 < n
    return best["c"], laid.select("id", (below if front else ~below).alias("side"))


def fiedler_sides(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, side of every node: the two parts of the cut, in Spark throughout."""
    _, vector, pairs = fiedler_vector(nodes, edges)
    return sweep(vector, pairs)[1]


def fiedler_cut(nodes: DataFrame, edges: DataFrame, rounds: int = 250, tolerance: float = 1e-8, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """One row (lambda2, conductance, lower, upper, connected, side): the second
    vector of I + D^-1/2 A D^-1/2, then the sweep over it for the cut of least
    conductance.  Up to driver_edges pairs and nodes a deflated power iteration
    on the driver, beyond that fiedler_vector(); side, the smaller part, is
    null above driver_edges members or DRIVER_EDGES: see fiedler_sides()."""
    weights = edges.filter("source_id <> target_id").select(F.least("source_id", "target_id").alias("u"), F.greatest("source_id", "target_id").alias("v")).groupBy("u", "v").agg(F.count(F.lit(1)).alias("w"))
    rows, found = _driver_rows(weights, driver_edges), _driver_rows(nodes.select("id"), driver_edges)
    if rows is None or found is None:
        lam, vector, pairs = fiedler_vector(nodes, edges)
        conductance, sides = sweep(vector, pairs)
        side = _driver_rows(sides.filter("side").select("id"), DRIVER_EDGES)
        kind = nodes.schema["id"].dataType.simpleString()
        row = (round(lam, 6), round(conductance, 6), round(lam / 2, 6), round(math.sqrt(2 * lam), 6), lam > 1e-5, sorted(r["id"] for r in side) if side is not None else None)
        return nodes.sparkSession.createDataFrame([row], f"lambda2 double, conductance double, lower double, upper double, connected boolean, side array<{kind}>")
    ids = sorted(r["id"] for r in found)
    at = {x: i for i, x in enumerate(ids)}
    n = len(ids)
    spark = nodes.sparkSession
    schema = f"lambda2 double, conductance double, lower double, upper double, connected boolean, side array<{nodes.schema['id'].dataType.simpleString()}>"
    keep = [(at[r["u"]], at[r["v"]], float(r["w"])) for r in rows if r["u"] in at and r["v"] in at]
    if n < 2 or not keep:
        return spark.createDataFrame([(0.0, 0.0, 0.0, 0.0, False, [])], schema)
    u, v, w = (np.array(c) for c in zip(*keep))
    deg = np.bincount(u, w, n) + np.bincount(v, w, n)
    half = np.where(deg > 0, 1 / np.sqrt(np.where(deg > 0, deg, 1)), 0)
    top = np.sqrt(deg) / np.linalg.norm(np.sqrt(deg))
    x = np.where(np.arange(n) % 2 == 0, 1.0, -1.0)
    x -= top * (top @ x)
    x /= np.linalg.norm(x) or 1
    mu = 0.0
    for _ in range(rounds):
        s = x * half
        y = x + half * (np.bincount(u, w * s[v], n) + np.bincount(v, w * s[u], n))
        y -= top * (top @ y)
        size = np.linalg.norm(y)
        if size < 1e-12:
            break
        x, old, mu = y / size, mu, size
        if abs(mu - old) < tolerance:
            break
    lam = min(2.0, max(0.0, 2 - mu))
    order = np.argsort(x * half, kind="stable")
    place = np.empty(n, int)
    place[order] = np.arange(n)
    lo, hi = np.minimum(place[u], place[v]), np.maximum(place[u], place[v])
    crossing = np.cumsum(np.bincount(lo, w, n) - np.bincount(hi, w, n))[:-1]
    volume = np.cumsum(deg[order])[:-1]
    small = np.minimum(volume, deg.sum() - volume)
    cond = np.where(small > 0, crossing / np.where(small > 0, small, 1), np.inf)
    k = int(cond.argmin())
    side = sorted(ids[i] for i in order[: k + 1])
    other = sorted(ids[i] for i in order[k + 1 :])
    best = min(side, other, key=lambda s: (len(s), s))
    return spark.createDataFrame([(round(float(lam), 6), round(float(cond[k]), 6), round(float(lam) / 2, 6), round(math.sqrt(2 * lam), 6), bool(lam > 1e-5), best)], schema)


def peeled_arcs(edges: DataFrame) -> DataFrame:
    """source_id, target_id, back of the distinct edges: whether an arc goes
    backward in an order made by rounds of joins: all sinks go to the end, else
    all sources to the front, else nodes of a high out - in degree to the front.

    Those are the ones whose degree exceeds that of all their neighbours, ties
    to the smaller name, and half of the highest.  No two of a round are
    neighbours, so they could as well go one after the other.  A neighbour that
    exceeds a high node is high itself, so only arcs among them tell who stays.

    An arc is settled in the round that takes its first end: it goes backward if
    that is its target and goes to the front.  A round writes the arcs that were
    left with what becomes of them; no order of all nodes is joined to the arcs.
    Loops, and edges without one of their ends, are no arcs and never go back."""
    spark = edges.sparkSession
    every = cut(edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).distinct(), "arcs")
    arc = F.coalesce(F.col("a") != F.col("b"), F.lit(False))
    left, settled = every.filter(arc), []
    while not left.isEmpty():
        ends = left.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("b").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
        degree = cut(ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i")), "degree")
        sinks, sources, top = degree.agg(F.count(F.when(F.col("o") == 0, 1)), F.count(F.when(F.col("i") == 0, 1)), F.max(F.col("o") - F.col("i"))).first()
        if sinks or sources:
            # no arc leaves a sink, and none leads to a source
            end = "b" if sinks else "a"
            gone = cut(degree.filter("o = 0" if sinks else "i = 0").select(F.col("id").alias(end), F.lit(True).alias("gone")), "gone")
            met = cut(left.join(gone, end, "left").select("a", "b", F.coalesce("gone", F.lit(False)).alias("gone"), F.lit(False).alias("back")), "met")
        else:
            # written first: where they are few, their size spares a shuffle of the arcs
            high = degree.filter(F.col("o") - F.col("i") >= max(top - top // 2, 0) if top > 0 else F.col("o") - F.col("i") == top)
            high = cut(high.select("id", (F.col("i") - F.col("o")).alias("r")), "high")
            rank = lambda end: high.select(F.col("id").alias(end), F.col("r").alias(f"r{end}"))
            of, to = F.col("ra").isNotNull(), F.col("rb").isNotNull()
            behind = F.when(of & to, F.when(F.struct("ra", "a") < F.struct("rb", "b"), F.col("b")).otherwise(F.col("a")))
            met = cut(left.join(rank("a"), "a", "left").join(rank("b"), "b", "left").select("a", "b", (of | to).alias("gone"), to.alias("back"), behind.alias("behind")), "met")
            stay = cut(met.filter("behind IS NOT NULL").select(F.col("behind").alias("id")).distinct(), "stay")
            if not stay.isEmpty():
                stays = lambda end: stay.select(F.col("id").alias(end), F.lit(True).alias(f"s{end}"))
                of = F.col("gone") & (~F.col("back") | F.col("behind").isNotNull()) & F.col("sa").isNull()
                to = F.col("back") & F.col("sb").isNull()
                met = cut(met.join(stays("a"), "a", "left").join(stays("b"), "b", "left").select("a", "b", (of | to).alias("gone"), to.alias("back")), "met")
        settled.append(met)
        left = met.filter("NOT gone").select("a", "b")
    found = every.filter(~arc).select("a", "b", F.lit(False).alias("back"))
    if settled:
        rounds = spark.read.schema(settled[0].select("a", "b", "gone", "back").schema).parquet(*(t._graphloom_path for t in settled))
        found = rounds.filter("gone").select("a", "b", "back").union(found)
    return found.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), "back")


def feedback_arcs(edges: DataFrame, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """source_id, target_id of the arcs that go backward in an order made by
    peeling sinks and sources, else the node of the largest out - in degree;
    above driver_edges distinct arcs by peeled_arcs()."""
    rows = _driver_rows(edges.filter("source_id <> target_id").select("source_id", "target_id").distinct(), driver_edges)
    if rows is None:
        return peeled_arcs(edges).filter("back").select("source_id", "target_id")
    arcs = sorted((r[0], r[1]) for r in rows)
    succ, pred = {}, {}
    for a, b in arcs:
        for x in (a, b):
            succ.setdefault(x, set())
            pred.setdefault(x, set())
        succ[a].add(b)
        pred[b].add(a)
    left, right, rest = [], [], set(succ)

    def drop(x):
        rest.discard(x)
        for y in succ[x]:
            pred[y].discard(x)
        for y in pred[x]:
            succ[y].discard(x)

    while rest:
        if sinks := sorted(x for x in rest if not succ[x]):
            for x in sinks:
                drop(x)
            right = sinks + right
        elif sources := sorted(x for x in rest if not pred[x]):
            for x in sources:
                drop(x)
            left += sources
        else:
            x = min(rest, key=lambda x: (len(pred[x]) - len(succ[x]), x))
            drop(x)
            left.append(x)
    place = {x: i for i, x in enumerate(left + right)}
    kind = edges.schema["source_id"].dataType.simpleString()
    return edges.sparkSession.createDataFrame([(a, b) for a, b in arcs if place[a] > place[b]], f"source_id {kind}, target_id {kind}")


# --- causality -----------------------------------------------------------


def causal_effect(rows: DataFrame, x: str, y: str, z: list[str]) -> DataFrame:
    """One row (n, average_causal_effect, naive_difference, confounded): the
    effect of x on y adjusted for z, sum over z of P(z) (P(y|1,z) - P(y|0,z));
    empty strata give 0, x and y are 0 or 1."""
    one = lambda c: F.col(c) == 1
    agg = rows.groupBy(*z).agg(F.count(F.lit(1)).alias("n"), *(F.sum((one(x) == (v == 1)).cast("long")).alias(f"n{v}") for v in (0, 1)), *(F.sum(((one(x) == (v == 1)) & one(y)).cast("long")).alias(f"y{v}") for v in (0, 1)))
    p = lambda v: F.when(F.col(f"n{v}") > 0, F.col(f"y{v}") / F.col(f"n{v}")).otherwise(0.0)
    total = agg.agg(F.sum("n").alias("n"), F.sum(F.col("n") * (p(1) - p(0))).alias("s"), *(F.sum(c).alias(c) for c in ("n0", "n1", "y0", "y1")))
    ace, naive = F.coalesce(F.col("s") / F.col("n"), F.lit(0.0)), F.coalesce(p(1) - p(0), F.lit(0.0))
    return total.select(F.coalesce("n", F.lit(0)).alias("n"), F.round(ace, 4).alias("average_causal_effect"), F.round(naive, 4).alias("naive_difference"), (F.abs(ace - naive) > 0.05).alias("confounded"))


def backdoor_paths(edges: DataFrame, x, y, limit: int = 100) -> DataFrame:
    """path (array of ids): simple undirected paths of up to four nodes from x
    to y that start against an arrow into x; the first limit by length and ids."""
    arcs = edges.filter("source_id <> target_id").select("source_id", "target_id").distinct()
    both = arcs.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).union(arcs.select("target_id", "source_id")).distinct()
    paths = arcs.filter(F.col("target_id") == x).select(F.array("target_id", "source_id").alias("path"))
    found = paths
    for _ in range(2):
        paths = paths.filter(F.element_at("path", -1) != y).withColumn("a", F.element_at("path", -1)).join(both, "a").filter(~F.array_contains("path", F.col("b"))).select(F.concat("path", F.array("b")).alias("path"))
        found = found.union(paths)
    return found.filter(F.element_at("path", -1) == y).orderBy(F.size("path"), "path").limit(limit)


def backdoor_admissible(edges: DataFrame, x, y, z: list) -> bool:
    """Whether adjusting for z identifies the effect of x on y: no member of z
    descends from x and z blocks every back-door path."""
    spark = edges.sparkSession
    kind = edges.schema["source_id"].dataType.simpleString()
    if descendants(edges, spark.createDataFrame([(x,)], f"id {kind}")).filter(F.col("id").isin(list(z) or [None])).count():
        return False
    paths = [r["path"] for r in backdoor_paths(edges, x, y).collect()]
    inner = sorted({n for p in paths for n in p[1:-1]})
    arcs = {(r[0], r[1]) for r in edges.filter(F.col("source_id").isin(sorted({n for p in paths for n in p}) or [None])).select("source_id", "target_id").distinct().collect()}
    below: dict = {}
    if inner:
        for r in descendants(edges, spark.createDataFrame([(i,) for i in inner], f"id {kind}")).filter(F.col("id").isin(list(z) or [None])).collect():
            below.setdefault(r["start"], set()).add(r["id"])

    def blocked(p) -> bool:
        for a, b, c in zip(p, p[1:], p[2:]):
            collider = (a, b) in arcs and (c, b) in arcs
            if collider and b not in z and not below.get(b):
                return True
            if not collider and b in z:
                return True
        return False

    return all(blocked(p) for p in paths)


def adjustment_set(edges: DataFrame, x, y) -> list:
    """A set to adjust for: the parents of x, else common ancestors; empty if none works."""
    spark = edges.sparkSession
    kind = edges.schema["source_id"].dataType.simpleString()
    parents = sorted(r[0] for r in edges.filter((F.col("target_id") == x) & (F.col("source_id") != x)).select("source_id").distinct().collect())
    if parents and y not in parents and backdoor_admissible(edges, x, y, parents):
        return parents
    up = descendants(edges, spark.createDataFrame([(x,), (y,)], f"id {kind}"), reverse=True)
    common = sorted(r["id"] for r in up.groupBy("id").agg(F.countDistinct("start").alias("n")).filter("n = 2").collect())
    return common if common and backdoor_admissible(edges, x, y, common) else []
