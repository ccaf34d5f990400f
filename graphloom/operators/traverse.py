"""Reachability and paths by set-based breadth-first search.

Each round joins the frontier, never the visited set, with the edges and
writes the new frontier to shared storage: the next round's plan reads small
tables instead of repeating all rounds before it.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut

#: Open ends that a link carries at most in a search for redundant links.
CARRIED = 16
#: Links that a start has at most in one row of such a search.
WHOLE = 1000


def impact(nodes: DataFrame, edges: DataFrame, targets: DataFrame, max_depth: int = 3) -> DataFrame:
    """Blast radius: everything that reaches a target over reversed edges.

    targets: (id).  Result: target, id, depth, rel_type, via_id with the least
    depth; of several last steps of that depth the smallest (rel_type, via_id)
    counts.  Depth is clamped to 1..10.  Dangling ends are traversed but not
    returned, nor is the target itself.
    """
    depth = max(1, min(max_depth, 10))
    # read once, dealt by target: every round joins it with a small frontier
    back = cut(edges.select("source_id", "target_id", "edge_type").distinct().repartition("target_id"), "edges")
    frontier = targets.select(F.col("id").alias("target"), F.col("id").alias("at"))
    seen = frontier.select("target", F.col("at").alias("id"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("rel_type"), F.lit(None).cast("string").alias("via_id"))
    for d in range(1, depth + 1):
        step = frontier.join(back, F.col("at") == F.col("target_id")).groupBy("target", F.col("source_id").alias("id")).agg(F.min(F.struct("edge_type", "target_id")).alias("m"))
        fresh = step.join(seen.select("target", "id"), ["target", "id"], "left_anti").select("target", "id", F.lit(d).alias("depth"), F.col("m.edge_type").alias("rel_type"), F.col("m.target_id").alias("via_id"))
        fresh = cut(fresh, "frontier")
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh)
        frontier = fresh.select("target", F.col("id").alias("at"))
    return seen.filter("depth > 0").join(nodes.select("id"), "id", "left_semi").select("target", "id", "depth", "rel_type", "via_id")


def neighbours(nodes: DataFrame, edges: DataFrame, ids: DataFrame, direction: str = "both") -> DataFrame:
    """center, id, direction, edge_type of the nodes next to the given ids.

    Parallel edges repeat, a loop shows up once for each direction, ends that
    are no nodes are left out.
    """
    center = ids.select(F.col("id").alias("center"))
    parts = []
    if direction in ("in", "both"):
        parts.append(edges.join(center, F.col("target_id") == F.col("center")).select("center", F.col("source_id").alias("id"), F.lit("in").alias("direction"), "edge_type"))
    if direction in ("out", "both"):
        parts.append(edges.join(center, F.col("source_id") == F.col("center")).select("center", F.col("target_id").alias("id"), F.lit("out").alias("direction"), "edge_type"))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return found.join(nodes.select("id", "name", "node_type"), "id").select("center", "id", "direction", "edge_type", "name", "node_type")


def explain(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """id, name, incoming and outgoing (sorted lists of 'type:id') per given id."""
    near = neighbours(nodes, edges, ids)
    lists = near.groupBy(F.col("center").alias("id")).agg(*(F.sort_array(F.collect_list(F.when(F.col("direction") == d, F.concat_ws(":", "edge_type", "id")))).alias(n) for d, n in (("in", "incoming"), ("out", "outgoing"))))
    empty = F.array().cast("array<string>")
    return nodes.join(ids.select("id"), "id", "left_semi").select("id", "name").join(lists, "id", "left").select("id", "name", F.coalesce("incoming", empty).alias("incoming"), F.coalesce("outgoing", empty).alias("outgoing"))


def shortest_paths(nodes: DataFrame, edges: DataFrame, sources: DataFrame, max_depth: int | None = 5, source: str = "source_id", target: str = "target_id", targets: DataFrame | None = None) -> DataFrame:
    """source, id, hops, path: shortest directed paths of up to max_depth edges
    (of any number, if None).

    With targets (source, id), one for each source, only the paths to them, and
    no search goes on beyond.

    path is an array of ids; of equally short ones the smallest in order.
    The source itself has the path of its id only.
    """
    ids = nodes.select(F.col("id"))
    links = cut(edges.filter(F.col(source) != F.col(target)).select(F.col(source).alias("a"), F.col(target).alias("b")).distinct().join(ids.withColumnRenamed("id", "b"), "b", "left_semi"), "links")
    front = sources.select(F.col("id").alias("source"), F.col("id").alias("at"), F.array("id").alias("path"))
    seen = front.select("source", F.col("at").alias("id"), F.lit(0).alias("hops"), "path")
    for d in _depths(1, max_depth):
        step = front.join(links, F.col("at") == F.col("a")).groupBy("source", F.col("b").alias("id")).agg(F.min(F.concat("path", F.array("b"))).alias("path"))
        fresh = step.join(seen.select("source", "id"), ["source", "id"], "left_anti").select("source", "id", F.lit(d).alias("hops"), "path")
        fresh = cut(fresh, "frontier")
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh)
        # sources whose target is found go no further
        front = fresh.select("source", F.col("id").alias("at"), "path")
        if targets is not None:
            done = seen.join(targets, ["source", "id"], "left_semi").select("source").distinct()
            front = front.join(done, "source", "left_anti")
    return seen if targets is None else seen.join(targets, ["source", "id"], "left_semi").select(*seen.columns)


def _depths(first: int, last: int | None):
    """first to last, or without end."""
    return itertools.count(first) if last is None else range(first, last + 1)


def descendants(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, reverse: bool = False) -> DataFrame:
    """start, id of everything reachable (ancestors if reverse), without the
    start; within max_depth edges if given."""
    a, b = ("target_id", "source_id") if reverse else ("source_id", "target_id")
    links = cut(edges.filter(F.col(a) != F.col(b)).select(F.col(a).alias("a"), F.col(b).alias("b")).distinct(), "links")
    front = starts.select(F.col("id").alias("start"), F.col("id").alias("at"))
    seen = front.select("start", F.col("at").alias("id"))
    for d in _depths(1, max_depth):
        fresh = front.join(links, F.col("at") == F.col("a")).select("start", F.col("b").alias("id")).distinct().join(seen, ["start", "id"], "left_anti")
        fresh = cut(fresh, "frontier")
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh)
        if d % 10 == 0:
            seen = cut(seen, "seen")
        front = fresh.select("start", F.col("id").alias("at"))
    return seen.filter("start <> id")


def levels(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, level) of the nodes that no cycle leads to, level being the number
    of edges of the longest way to one, and what is left: the edges among the
    others.  edges: (a, b).  Each round peels the nodes without a way in."""
    left, found = edges, None
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(False).alias("led")), F.struct(F.col("b").alias("id"), F.lit(True).alias("led")))).alias("e")).select("e.*")
    nodes = cut(ends.groupBy("id").agg(F.max("led").alias("led")), "nodes")
    first, inner = nodes.filter("NOT led"), nodes.filter("led").select("id")
    for n in itertools.count():
        peeled = cut(first.select("id", F.lit(n).alias("level")), "level")
        if peeled.isEmpty():
            return (peeled if found is None else found), left
        found = peeled if found is None else found.union(peeled)
        ids = inner
        left = cut(left.join(peeled.select(F.col("id").alias("a")), "a", "left_anti"), "edges")
        inner = cut(left.select(F.col("b").alias("id")).distinct(), "inner")
        first = ids.join(inner, "id", "left_anti")


def _reach_labels(links: DataFrame, place: DataFrame, seeds: int = 3) -> DataFrame:
    """id, labels: for each seed the least hash among a node and all that lead
    to it.  If x leads to y, no label of y is above that of x; so a label that
    is above rules a way out.  links (a, b) are acyclic."""
    own = lambda c: F.array(*(F.xxhash64(F.lit(k), c) for k in range(seeds)))
    now = cut(place.select("id", own(F.col("id")).alias("labels")), "labels")
    front = now
    least = lambda x, y: F.zip_with(x, y, lambda p, q: F.least(p, q))
    while True:
        sent = links.join(front.select(F.col("id").alias("a"), "labels"), "a")
        got = sent.groupBy(F.col("b").alias("id")).agg(F.array(*(F.min(F.col("labels")[k]) for k in range(seeds))).alias("sent"))
        new = now.join(got, "id", "left").select("id", F.when(F.col("sent").isNull(), F.col("labels")).otherwise(least(F.col("labels"), F.col("sent"))).alias("labels"), F.col("labels").alias("old"))
        new = cut(new.select("id", "labels", (F.col("labels") != F.col("old")).alias("moved")), "labels")
        front = new.filter("moved").select("id", "labels")
        now = new.select("id", "labels")
        if front.isEmpty():
            return now


def layers(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, level) of the nodes that have a way in and that no cycle leads to,
    the level being the edges of the longest way to one; the distinct links
    (a, b, la) out of nodes that no cycle leads to, with the level of a; and
    the links (a, b) that are left.  edges: (a, b), read twice.

    A round tells by one join which links start at a node without a way in,
    so no level is joined to the links afterwards."""
    left, ids, place, laid = edges, None, None, None
    for n in itertools.count():
        inner = cut(left.select(F.col("b").alias("id")).distinct(), "inner")
        if ids is not None:
            level = cut(ids.join(inner, "id", "left_anti").select("id", F.lit(n).alias("level")), "level")
            if level.isEmpty():
                return (level if place is None else place), laid, left
            place = level if place is None else place.union(level)
        split = left.join(inner.select(F.col("id").alias("a"), F.lit(True).alias("inside")), "a", "left").select("a", "b", F.col("inside").isNotNull().alias("inside"))
        split = cut(split if laid is not None else split.distinct(), "split")
        out = split.filter("NOT inside").select("a", "b", F.lit(n).alias("la"))
        laid = out if laid is None else laid.union(out)
        left, ids = split.filter("inside").select("a", "b"), inner
        if place is None and out.isEmpty():
            return inner.select("id", F.lit(n).alias("level")).limit(0), laid, left


def _redundant_of_dag(place: DataFrame, laid: DataFrame) -> DataFrame:
    """(a, b) of the acyclic links, as layers() gives them, whose end another
    way leads to.

    An edge to the next level has no other way.  For the rest, searches go
    back from their ends, but only over nodes above the level of the lowest
    start that is still open.  A search's state is (end, node).  Searches that
    have come to more than half as many states as there are links get labels,
    and go on only where no label of the node rules out that each open start
    leads to it.

    Whether a start is next to a node of a search is told where the node is:
    links carry the open ends of a start that has up to CARRIED, and meet the
    node's ends as a list, so no row is made for a start and an end that have no
    open link.  A start with more, or with more than WHOLE links, takes the ends
    of its nodes to it.  A round asks at the levels that its searches are at, and
    where few ends are searched, links carry no others."""
    deep = place.filter("level > 1")
    lv = lambda c: deep.select(F.col("id").alias(c), F.col("level").alias(f"l{c}"))
    still = cut(laid.join(lv("b"), "b").filter("lb > la + 1").select("a", "b", "la"), "open")
    done = laid.select("a", "b").limit(0)
    if still.isEmpty():
        return done
    kind = laid.schema["b"].dataType
    # the links of open starts, a row a start, that another node could follow;
    # starts with many links or open ends have a row a link
    heavy = cut(laid.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > WHOLE).select("a"), "heavy")
    seen_at = laid.join(lv("b"), "b", "left").withColumn("lb", F.coalesce("lb", F.lit(1)))
    whole = seen_at.join(heavy, "a", "left_anti").groupBy("a", "la").agg(F.collect_list(F.struct(F.col("b").alias("at"), F.col("lb").alias("lat"))).alias("ats"))
    opened = F.transform(F.filter("ats", lambda e: e["lat"] > F.col("la") + 1), lambda e: e["at"])
    near = cut(whole.select("a", "ats", opened.alias("open")).filter(F.size("open") > 0), "near")
    few = near.filter(F.size("open") <= CARRIED)
    rows = near.filter(F.size("open") > CARRIED).select("a", F.explode("ats.at").alias("at"))
    many = cut(rows.union(laid.join(heavy, "a", "left_semi").select("a", F.col("b").alias("at"))), "many")
    some = not many.isEmpty()
    # all other steps of a search are over nodes above the lowest open start
    lowest = still.agg(F.min("la")).first()[0]
    back = laid.filter(F.col("la") > lowest).select("a", F.col("b").alias("at"), "la")
    least = lambda: cut(still.groupBy("b").agg(F.min("la").alias("low")), "bounds")
    bounds = least()
    front = back.withColumnRenamed("at", "b").join(bounds.select("b"), "b", "left_semi").select("b", F.col("a").alias("at"), F.col("la").alias("lat"))
    front = cut(front, "front")
    seen = front.select("b", "at")
    links, searched, labels, hits = laid.count(), 0, None, []
    while True:
        searched += front.count()
        if labels is None and 2 * searched > links:
            nodes = laid.select(F.col("a").alias("id")).union(place.select("id")).distinct()
            labels = _reach_labels(laid.select("a", "b"), nodes)
        live = front.join(bounds, "b").filter(F.col("lat") > F.col("low"))
        if labels is not None:
            seeds = range(len(labels.first()["labels"]))
            marks = still.join(labels.select(F.col("id").alias("a"), "labels"), "a")
            tops = marks.groupBy("b").agg(*(F.max(F.col("labels")[k]).alias(f"top{k}") for k in seeds))
            live = live.join(tops, "b").join(labels.select(F.col("id").alias("at"), "labels"), "at")
            for k in seeds:
                live = live.filter(F.col("labels")[k] <= F.col(f"top{k}"))
        live = cut(live.select("b", "at", "low", "lat"), "live")
        # lists of about a thousand ends at most
        sizes = live.groupBy("at").agg(F.count(F.lit(1)).alias("n"))
        lists = live.join(sizes, "at").groupBy("at", F.expr("pmod(xxhash64(b), n div 1000 + 1)").alias("part")).agg(F.collect_list("b").alias("ends"))
        lists = cut(lists.select("at", "ends"), "lists")
        found = [r[0] for r in live.select("b").distinct().limit(CARRIED + 1).collect()]
        asked = few
        if len(found) <= CARRIED:
            only = F.array(*(F.lit(x).cast(kind) for x in found)).cast(few.schema["open"].dataType)
            asked = few.withColumn("open", F.array_intersect("open", only)).filter(F.size("open") > 0)
        at_levels = [r[0] for r in live.select("lat").distinct().collect()]
        asked = asked.select("a", "open", F.inline("ats")).filter(F.col("lat").isin(at_levels)).drop("lat")
        hit = asked.join(lists, "at").select("a", F.explode(F.array_intersect("open", "ends")).alias("b"))
        if some:
            hit = hit.union(many.join(live, "at").select("a", "b").join(still.select("a", "b"), ["a", "b"], "left_semi"))
        hit = cut(hit.distinct(), "hit")
        hits.append(hit)
        step = live.join(back, "at").filter(F.col("la") > F.col("low")).select("b", F.col("a").alias("at"), F.col("la").alias("lat"))
        front = cut(step.dropDuplicates(["b", "at"]).join(seen, ["b", "at"], "left_anti"), "front")
        if not front.isEmpty():
            # of the open links, those whose ends are searched on
            on = cut(front.select("b").distinct(), "ends")
            still = still.join(on, "b", "left_semi").join(hit.join(on, "b", "left_semi"), ["a", "b"], "left_anti")
            still = cut(still.select("a", "b", "la"), "open")
            bounds = least()
        if front.isEmpty() or bounds.isEmpty():
            for h in hits:
                done = done.union(h)
            return done.distinct() if len(hits) > 1 else done
        seen = cut(seen.union(front.select("b", "at")), "seen")


def redundant_edges(edges: DataFrame) -> DataFrame:
    """source_id, target_id of the edges that transitive_reduction marks."""
    links, place, laid, left = _laid_links(edges)
    if left.isEmpty():
        return _redundant_of_dag(place, laid).select(F.col("a").alias("source_id"), F.col("b").alias("target_id"))
    return _reduction_with_cycles(links, left, edges.schema["source_id"].dataType).filter("redundant").select("source_id", "target_id")


def transitive_reduction(edges: DataFrame) -> DataFrame:
    """source_id, target_id, redundant for the distinct edges, loops left out.

    u -> v is redundant if another successor of u reaches v.  The closure is
    never written: levels settle most edges, and only what they leave open is
    searched.  Nodes that reach each other are taken as one:
    within such a component an edge is redundant if its start has another
    successor there, and an edge out of it always is.
    """
    links, place, laid, left = _laid_links(edges)
    if left.isEmpty():
        marked = links.join(_redundant_of_dag(place, laid).withColumn("redundant", F.lit(True)), ["a", "b"], "left")
        return marked.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.coalesce("redundant", F.lit(False)).alias("redundant"))
    return _reduction_with_cycles(links, left, edges.schema["source_id"].dataType)


def _laid_links(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The distinct links (a, b) of edges without loops, and their layers()."""
    place, laid, left = layers(edges.filter("source_id <> target_id").select(F.col("source_id").alias("a"), F.col("target_id").alias("b")))
    return laid.select("a", "b").union(left), place, laid, left


def _reduction_with_cycles(links: DataFrame, left: DataFrame, kind) -> DataFrame:
    """transitive_reduction of links of which those in left are behind cycles."""
    comp = cut(strong_components(left.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"))).select(F.col("id").cast(kind).alias("id"), F.col("component").cast(kind).alias("c")), "components")
    c = lambda end: comp.select(F.col("id").alias(end), F.col("c").alias(f"c{end}"))
    both = links.join(c("a"), "a", "left").join(c("b"), "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
    both = cut(both, "both")
    # successors of a node by component: more than one in a component reach each other
    per = both.groupBy("a", "cb").agg(F.count(F.lit(1)).alias("there"))
    inside = both.filter("ca = cb").select("a").distinct().withColumn("inside", F.lit(True))
    whole = both.filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    over = _redundant_of_dag(*layers(cut(whole, "whole"))[:2]).select(F.col("a").alias("ca"), F.col("b").alias("cb"), F.lit(True).alias("over"))
    all_ = both.join(per, ["a", "cb"]).join(inside, "a", "left").join(over, ["ca", "cb"], "left")
    yes = lambda x: F.coalesce(F.col(x), F.lit(False))
    redundant = F.when(F.col("ca") == F.col("cb"), F.col("there") > 1).otherwise(yes("inside") | (F.col("there") > 1) | yes("over"))
    return all_.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), redundant.alias("redundant"))


def simple_cycles(edges: DataFrame, max_length: int | None = None, limit: int | None = 15) -> DataFrame:
    """cycle (array of ids, starting at its smallest) and length of the simple
    cycles of two nodes or more, of max_length at most if given; the first
    limit by length and ids.

    Only edges within strong components are followed (where every node has one
    way on, rings are all there is), and a cycle's two halves
    meet: ways of n / 2 edges from its smallest node on and of the rest back
    to it, over nodes above it.  So each cycle is found once, and the search
    ends with the length at which the limit is reached, or where no way goes
    on.  A component with fewer cycles than the limit has few ways; without a
    limit, ask for a length.
    """
    raw = cut(edges.filter("source_id <> target_id").select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).distinct(), "links")
    # without what no cycle leads to, and what leads to none
    inner = levels(levels(raw)[1].select(F.col("b").alias("a"), F.col("a").alias("b")))[1].select(F.col("b").alias("a"), F.col("a").alias("b"))
    links = cut(inner, "links")
    if not links.groupBy("a").count().filter("count > 1").isEmpty():
        comp = cut(strong_components(links.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"))), "components")
        c = lambda end: comp.select(F.col("id").alias(f"t{end}"), F.col("component").alias(f"c{end}"))
        inner = links.withColumns({"ta": F.col("a").cast("string"), "tb": F.col("b").cast("string")}).join(c("a"), "ta").join(c("b"), "tb").filter("ca = cb")
        links = cut(inner.select("a", "b"), "links")
    # halves: (start, at, nodes) with nodes from start to at, or from at to start
    out = links.filter("b > a").select(F.col("a").alias("start"), F.col("b").alias("at"), F.array("b").alias("way"))
    back = links.filter("a > b").select(F.col("b").alias("start"), F.col("a").alias("at"), F.array().cast(out.schema["way"].dataType).alias("way"))
    found, count, n = None, 0, 2
    while max_length is None or n <= max_length:
        met = out.join(back.withColumnRenamed("way", "rest"), ["start", "at"]).filter(~F.arrays_overlap("way", "rest"))
        new = cut(met.select(F.concat(F.array("start"), "way", "rest").alias("cycle"), F.lit(n).alias("length")), "cycles")
        found = new if found is None else found.unionByName(new)
        count += new.count()
        if limit is not None and count >= limit:
            break
        # the halves grow in turn
        if n % 2 == 0:
            step = out.join(links, F.col("at") == F.col("a")).filter((F.col("b") > F.col("start")) & ~F.array_contains("way", F.col("b")))
            out = cut(step.select("start", F.col("b").alias("at"), F.concat("way", F.array("b")).alias("way")), "out")
            grown = out
        else:
            step = back.join(links, F.col("at") == F.col("b")).filter((F.col("a") > F.col("start")) & ~F.array_contains("way", F.col("a")) & (F.col("a") != F.col("at")))
            back = cut(step.select("start", F.col("a").alias("at"), F.concat(F.array("b"), "way").alias("way")), "back")
            grown = back
        if grown.isEmpty():
            break
        n += 1
    return found if limit is None else found.orderBy("length", "cycle").limit(limit)


def strong_components(edges: DataFrame) -> DataFrame:
    """id, component: nodes that reach each other, by the smallest id among
    them, as text; of components of one node only those with others around.

    Colouring: the largest name spreads along the edges; what reaches back to
    a name's own node within its colour is that node's component.  Nodes
    without a way in or out are components of their own and go first."""
    links = cut(edges.filter("source_id <> target_id").select(F.col("source_id").cast("string").alias("a"), F.col("target_id").cast("string").alias("b")).distinct(), "links")
    nodes = cut(links.select(F.col("a").alias("id")).union(links.select("b")).distinct(), "nodes")
    found = None
    while not nodes.isEmpty():
        trimmed = True
        while trimmed:
            inner = cut(links.select(F.col("a").alias("id")).distinct().join(links.select(F.col("b").alias("id")).distinct(), "id", "left_semi"), "inner")
            alone = cut(nodes.join(inner, "id", "left_anti").select("id", F.col("id").alias("component")), "alone")
            trimmed = not alone.isEmpty()
            if trimmed:
                found = alone if found is None else found.union(alone)
                nodes = inner
                links = cut(links.join(inner.withColumnRenamed("id", "a"), "a", "left_semi").join(inner.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b"), "links")
        if nodes.isEmpty():
            break
        colour = cut(nodes.withColumn("c", F.col("id")), "colour")
        while True:
            pushed = links.join(colour.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.max("c").alias("p"))
            moved = cut(colour.join(pushed, "id", "left").select("id", F.greatest("c", F.coalesce("p", "c")).alias("c"), (F.coalesce("p", "c") > F.col("c")).alias("new")), "colour")
            colour = moved.select("id", "c")
            if moved.filter("new").isEmpty():
                break
        own = links.join(colour.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(colour.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b").filter("ca = cb").select("a", "b", F.col("ca").alias("c"))
        own = cut(own, "own")
        back = cut(colour.filter("id = c"), "back")
        front = back
        while True:
            front = cut(front.withColumnRenamed("id", "b").join(own, ["b", "c"]).select(F.col("a").alias("id"), "c").distinct().join(back, ["id", "c"], "left_anti"), "front")
            if front.isEmpty():
                break
            back = cut(back.union(front), "back")
        least = back.groupBy("c").agg(F.min("id").alias("component"))
        found = (lambda new: new if found is None else found.union(new))(cut(back.join(least, "c").select("id", "component"), "components"))
        nodes = cut(nodes.join(back, "id", "left_anti"), "nodes")
        links = cut(links.join(nodes.withColumnRenamed("id", "a"), "a", "left_semi").join(nodes.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b"), "links")
    return found if found is not None else edges.sparkSession.createDataFrame([], "id string, component string")


def bidirectional_pairs(edges: DataFrame) -> DataFrame:
    """(a, b) with a < b for nodes that have edges both ways."""
    links = edges.select("source_id", "target_id").distinct()
    back = links.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))
    return links.filter("source_id < target_id").join(back, ["source_id", "target_id"], "left_semi").select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
