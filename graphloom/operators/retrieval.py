"""Lexical, vector and fused retrieval, names that are near, budgets by prefix."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hash_place, terms
from ..storage import cut, map_arrow
from .order import running

#: Usual BM25 constants.
K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, with repetition."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def postings(docs: DataFrame, columns: list[str], id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(term, id, tf) and (id, dl): the inverted index over the columns and
    the documents' lengths.  Counts are combined before the shuffle."""
    bag = docs.select(F.col(id_col).alias("id"), F.flatten(F.array(*(tokens(F.col(c)) for c in columns))).alias("t"))
    return bag.select("id", F.explode("t").alias("term")).groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf")), bag.select("id", F.size("t").alias("dl"))


def parse_query(query: str) -> list[list[tuple[str, bool]]]:
    """A query as a disjunction of conjunctions of (word, prefix?) with NOT as
    a leading '-': words are prefixes joined by AND, quoted ones are exact,
    OR, AND and NOT are operators."""
    groups: list[list[tuple[str, bool]]] = [[]]
    negate = False
    for m in re.finditer(r'"([^"]*)"|(\S+)', query):
        quoted, word = m[1], m[2]
        if word == "OR":
            groups.append([])
        elif word == "NOT":
            negate = True
        elif word != "AND":
            for part in re.findall(r"[^\W_]+", (quoted if quoted is not None else word).lower()):
                groups[-1].append((("-" if negate else "") + part, quoted is None))
            negate = False
    return [g for g in groups if g]


def _matches(word: str, prefix: bool):
    """A test of a token; of one argument, as lambdas of columns are counted."""
    return (lambda x: x.startswith(word)) if prefix else (lambda x: x == F.lit(word))


def search(docs: DataFrame, columns: list[str], query: str, limit: int = 20, id_col: str = "id") -> DataFrame:
    """id, score (BM25, higher is better) and rank of the best matches; ties by id.

    The words of the query are counted in each document's tokens, so texts are
    read once and never moved; the counts are written, summed up, and scored."""
    groups = parse_query(query)
    words = sorted({w for g in groups for w in g})
    if not words:
        return docs.select(F.col(id_col).alias("id")).limit(0).withColumn("score", F.lit(0.0)).withColumn("rank", F.lit(0))
    bag = docs.select(F.col(id_col).alias("id"), F.flatten(F.array(*(tokens(F.col(c)) for c in columns))).alias("t"))
    plain = [(w.removeprefix("-"), prefix) for w, prefix in words]
    hits = [F.size(F.filter("t", _matches(w, p))).alias(f"tf{i}") for i, (w, p) in enumerate(plain)]
    counted = cut(bag.select("id", F.size("t").alias("dl"), *hits), "search")
    n, average, *df = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("dl"), *(F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(words)))).first()
    score, has = F.lit(0.0), {}
    for i, (word, prefix) in enumerate(words):
        tf = F.col(f"tf{i}")
        has[word, prefix] = tf > 0
        if not word.startswith("-") and n:
            idf = math.log(1 + (n - df[i] + 0.5) / (df[i] + 0.5))
            score = score + F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(max(average, 1e-9))))
    wanted = F.lit(False)
    for g in groups:
        ok, some = F.lit(True), F.lit(False)
        for w in g:
            ok = ok & (~has[w] if w[0].startswith("-") else has[w])
            some = some if w[0].startswith("-") else some | has[w]
        wanted = wanted | (ok & some)
    best = counted.filter(wanted).select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def _hashed(dimension: int):
    """Per id: the buckets that its terms fall into, and a unit vector's places there."""

    def run(batches):
        for batch in batches:
            lists = batch.column("terms")
            flat, ends = lists.flatten(), np.asarray(lists.value_lengths().fill_null(0))
            coded = flat.field("term").dictionary_encode()
            names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(ends), dtype=np.int64), ends)
            digests = [hashlib.md5(n.encode()).digest() for n in names]
            bucket = np.array([h[0] % dimension for h in digests], dtype=np.int64)
            sign = np.array([1.0 if h[4] % 2 == 0 else -1.0 for h in digests])
            # a row's distinct terms, by name: sums have one order whatever the batch
            place = np.empty(len(names), dtype=np.int64)
            place[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
            term = np.argsort(place)
            key, which = np.unique(row * max(1, len(names)) + place[code], return_inverse=True)
            weight = 1 + np.log(np.bincount(which, flat.field("w").to_numpy(zero_copy_only=False), key.size)) if key.size else np.zeros(0)
            at, code = key // max(1, len(names)), term[key % max(1, len(names))]
            cell, which = np.unique(at * dimension + bucket[code], return_inverse=True)
            x = np.bincount(which, sign[code] * weight, cell.size)
            norm = np.sqrt(np.bincount(cell // dimension, x * x, len(ends)))
            kept = norm[cell // dimension] > 1e-9
            cell, x = cell[kept], x[kept]
            counts = np.bincount(cell // dimension, minlength=len(ends))
            entries = pa.StructArray.from_arrays([pa.array((cell % dimension).astype(np.int32)), pa.array(x / norm[cell // dimension])], names=["bucket", "x"])
            entries = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), entries)
            out = pa.RecordBatch.from_arrays([batch.column("id"), entries], names=["id", "entries"])
            yield out.filter(pa.array(counts > 0))

    return run


def hashed_entries(docs: DataFrame, text: Column, id_col: str = "id", dimension: int = 128) -> DataFrame:
    """(id, entries array<struct<bucket, x>>): unit vectors of hashed identifier
    terms, sparse, a row an id that has any.

    Only texts are shuffled, so that those of one id are together; their terms
    are counted where they are made and never leave the task one by one."""
    whole = docs.select(F.col(id_col).alias("id"), text.alias("t")).groupBy("id").agg(F.collect_list("t").alias("t"))
    rows = whole.select("id", F.flatten(F.transform("t", terms)).alias("terms"))
    kind = rows.schema["id"].dataType.simpleString()
    return map_arrow(rows, _hashed(dimension), f"id {kind}, entries array<struct<bucket:int,x:double>>")


def hashed_vectors(docs: DataFrame, text: Column, id_col: str = "id", dimension: int = 128) -> DataFrame:
    """(id, bucket, x): unit vectors of hashed identifier terms, sparse."""
    return hashed_entries(docs, text, id_col, dimension).select("id", F.inline("entries"))


def products(entries: DataFrame, query: DataFrame) -> DataFrame:
    """(id, s): the dot product of each row's entries with one sparse vector
    (bucket, x), for ids that share a bucket with it."""
    places = query.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("bucket", "x"))).alias("m"), F.max("bucket").alias("top")).filter("top IS NOT NULL")
    q = places.select(F.transform(F.sequence(F.lit(0), "top"), lambda i: F.try_element_at("m", i)).alias("q"), "top")
    both = entries.crossJoin(F.broadcast(q)).withColumn("met", F.filter("entries", lambda e: (e["bucket"] <= F.col("top")) & F.get("q", e["bucket"]).isNotNull()))
    return both.filter(F.size("met") > 0).select("id", F.aggregate("met", F.lit(0.0), lambda s, e: s + e["x"] * F.get("q", e["bucket"])).alias("s"))


def dense(vectors: DataFrame, dimension: int = 128, ids: DataFrame | None = None) -> DataFrame:
    """(id, vector array<float>) of sparse vectors; with ids (id) those without
    any term have a vector of zeros."""
    pairs = vectors.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "x"))).alias("m"))
    if ids is not None:
        pairs = ids.select("id").join(pairs, "id", "left").withColumn("m", F.coalesce("m", F.expr("map_filter(map(0, 0.0D), (k, v) -> false)")))
    return pairs.select("id", F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)).cast("float")).alias("vector"))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of two unit vectors, within 0 and 1."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot))


def vector_search(vectors: DataFrame, query: DataFrame, top_k: int = 10, min_score: float = 0.02) -> DataFrame:
    """id, score, rank of the vectors (id, entries) or (id, bucket, x) nearest
    to one sparse query vector (bucket, x)."""
    if "entries" in vectors.columns:
        scored = products(vectors, query)
    else:
        q = query.select("bucket", F.col("x").alias("q"))
        scored = vectors.join(F.broadcast(q), "bucket").groupBy("id").agg(F.sum(F.col("x") * F.col("q")).alias("s"))
    best = scored.select("id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), "s")), 6).alias("score")).filter(F.col("score") >= min_score)
    best = best.orderBy(F.desc("score"), "id").limit(top_k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def fuse(lexical: DataFrame, semantic: DataFrame, top_k: int = 10, rrf_k: int = 60) -> DataFrame:
    """id, rrf, source: reciprocal rank fusion of two ranked lists."""
    both = lexical.select("id", F.col("rank").alias("rl")).join(semantic.select("id", F.col("rank").alias("rs"), F.col("score").alias("vec")), "id", "full_outer")
    rrf = F.coalesce(1.0 / (rrf_k + F.col("rl")), F.lit(0.0)) + F.coalesce(1.0 / (rrf_k + F.col("rs")), F.lit(0.0))
    source = F.when(F.col("rl").isNotNull() & F.col("rs").isNotNull(), "hybrid").when(F.col("rl").isNotNull(), "lexical").otherwise("semantic")
    return both.select("id", F.round(rrf, 6).alias("rrf"), source.alias("source"), F.coalesce("vec", F.lit(0.0)).alias("vec")).orderBy(F.desc("rrf"), F.desc("vec"), "id").limit(top_k)


def budget_prefix(scored: DataFrame, budget: int, header: int = 0) -> DataFrame:
    """Rows in order of (score desc, id) while header and their cost fit the budget.

    scored: (id, score, cost).  Costs are not negative, so what fits is a
    prefix of the order, rows without cost at its end included.
    """
    laid = running(scored, [F.desc("score"), "id"], F.col("cost").cast("long"), "used")
    return laid.withColumn("used", (F.col("used") + F.lit(header)).cast("long")).filter(F.col("used") <= budget)


def _pairs_of_letters(names: DataFrame, column: str) -> DataFrame:
    """column, size, gram: the distinct pairs of neighbouring letters of names."""
    c = F.col(column)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2))))
    return names.filter(F.length(c) > 1).select(column, grams.alias("g")).select(column, F.size("g").alias("size"), F.explode("g").alias("gram"))


#: Letters of a name up to which names within two edits meet by what is left of
#: them without two letters: 820 forms at most; longer ones meet by pairs of letters.
SHORT = 40
#: Letters of a tail, of which the one is taken that promises the fewest forms.
TAILS = (4, 6, 8, 10, 12, 16)


def _shortened(names: DataFrame, column: str, r: int) -> DataFrame:
    """<column>_id, h: a hash of each name and of what is left of it without up
    to r letters, 1 or 2.  Names within r edits have such a form in common."""
    c, last = f"`{column}`", SHORT + 2
    places = f"slice(sequence(1, {last}), 1, length({c}))"
    forms = f"transform({places}, i -> xxhash64(concat(substr({c}, 1, i - 1), substr({c}, i + 1))))"
    if r == 2:
        rest = f"transform(slice(sequence(1, {last}), i + 1, length({c}) - i), j -> xxhash64(concat(substr({c}, 1, i - 1), substr({c}, i + 1, j - i - 1), substr({c}, j + 1))))"
        forms = f"concat({forms}, flatten(transform({places}, i -> {rest})))"
    # a name of few bytes has hundreds of forms, so tasks are dealt by names
    names = names.select(column).repartition(1 + names.count() // 2000, column)
    return names.select(F.xxhash64(column).alias(f"{column}_id"), F.explode(F.expr(f"array_distinct(concat(array(xxhash64({c})), {forms}))")).alias("h"))


def _without(c: str, n: int) -> str:
    """SQL for what is left of the text c without n of its letters, 0 to 2."""
    places = f"slice(sequence(1, {SHORT + 2}), 1, length({c}))"
    if n == 0:
        return f"array({c})"
    if n == 1:
        return f"transform({places}, i -> concat(substr({c}, 1, i - 1), substr({c}, i + 1)))"
    rest = f"transform(slice(sequence(1, {SHORT + 2}), i + 1, length({c}) - i), j -> concat(substr({c}, 1, i - 1), substr({c}, i + 1, j - i - 1), substr({c}, j + 1)))"
    return f"flatten(transform({places}, i -> {rest}))"


def _by_forms(grown: DataFrame, near: DataFrame, r: int) -> DataFrame:
    """(name_id, known_id) of names with equal forms of r letters less or fewer."""
    return _shortened(grown, "name", r).hint("merge").join(_shortened(near, "known", r), "h").select("name_id", "known_id").distinct()


def _keyed(halves: DataFrame, column: str, forms: str) -> DataFrame:
    """<column>_id, h: a hash of each name and of its head with what is left of its tail."""
    return halves.select(F.xxhash64(column).alias(f"{column}_id"), "head", F.explode(F.expr(f"array_distinct({forms})")).alias("form")).select(f"{column}_id", F.xxhash64("head", "form").alias("h"))


def _by_halves(grown: DataFrame, near: DataFrame, r: int) -> DataFrame | None:
    """As _by_forms, by heads and tails, or None where that makes as many rows.

    A known name is cut before its last letters.  A name within r edits can be
    cut so that the heads are i and the tails r - i edits apart at most.  Where
    many names have the same words there are few heads: these meet first, each
    once, and names make forms of the short tails only, and only as many as the
    edits of the heads leave."""
    sides = {"name": grown, "known": near}
    head = lambda c, t, d=0: F.substring(c, F.lit(1), F.greatest(F.lit(0), F.length(c) - t - d))
    some = {c: df.agg(F.count(F.lit(1)).alias("n"), F.avg(F.length(c)).alias("l"), *(F.approx_count_distinct(head(c, t)).alias(f"t{t}") for t in TAILS)).first() for c, df in sides.items()}
    whole = lambda l: 1 + l if r == 1 else 1 + l + l * (l - 1) / 2
    plain = sum(x["n"] * whole(x["l"] or 0) for x in some.values())
    # a name has up to 2 r + 1 heads
    cost = {t: sum(x["n"] * t * r + m * x[f"t{t}"] * whole(max(0, (x["l"] or 0) - t)) for x, m in ((some["known"], 1), (some["name"], 2 * r + 1))) for t in TAILS}
    t = min(TAILS, key=lambda t: cost[t])
    if cost[t] > plain / 2:
        return None
    tail = F.expr("substr(known, length(head) + 1)")
    spread = lambda df, c: df.select(c).repartition(1 + int(some[c]["n"]) // 20000, c)
    theirs = spread(near, "known").select("known", head("known", t).alias("head")).withColumn("tail", tail)
    at = F.array_distinct(F.filter(F.array(*(F.length("name") - t - d for d in range(-r, r + 1)), F.when(F.length("name") <= t + r, F.lit(0))), lambda p: p >= 0))
    ours = spread(grown, "name").select("name", F.explode(at).alias("p")).select("name", "p", F.expr("substr(name, 1, p)").alias("mine"), F.expr("substr(name, p + 1)").alias("tail"))
    # distinct heads within r edits
    counted = cut(ours.groupBy("mine").agg(F.count(F.lit(1)).alias("n")), "heads")
    known = cut(theirs.groupBy("head").agg(F.count(F.lit(1)).alias("m")), "heads")
    a, b = counted.select(F.col("mine").alias("name")), known.select(F.col("head").alias("known"))
    met = _named(_by_forms(a, b, r), a, b).withColumn("left", r - F.levenshtein("name", "known")).filter("left >= 0")
    heads = cut(met.select(F.col("name").alias("mine"), F.col("known").alias("head"), "left"), "heads")
    most = cut(heads.groupBy("head").agg(F.max("left").alias("left")), "heads")
    forms = {0: 1.0, 1: 1.0 + t, 2: 1 + t + t * (t - 1) / 2}
    rows = lambda df, n: sum((x["rows"] or 0) * forms[x["left"]] for x in df.groupBy("left").agg(F.sum(n).alias("rows")).collect())
    if rows(heads.join(counted, "mine"), "n") + rows(most.join(known, "head"), "m") > plain:
        return None
    upto = lambda c, j: f"concat({', '.join(_without(c, n) for n in range(j + 1))})"
    case = lambda of: "CASE left " + " ".join(f"WHEN {j} THEN {of(j)}" for j in range(r + 1)) + " END"

    def just(j: int) -> str:
        """Forms of a tail d letters longer than t: of the longer one without j letters."""
        drops = " ".join(f"WHEN {d} THEN {_without('tail', j + min(0, d))}" for d in range(-j, j + 1))
        return f"CASE WHEN p = 0 THEN {upto('tail', j)} ELSE CASE length(tail) - {t} {drops} END END"

    theirs = _keyed(theirs.join(most, "head"), "known", case(lambda j: upto("tail", j)))
    ours = _keyed(ours.join(heads, "mine").filter(f"p = 0 OR abs(length(tail) - {t}) <= left"), "name", case(just))
    return ours.hint("merge").join(theirs, "h").select("name_id", "known_id").distinct()


def _named(met: DataFrame, grown: DataFrame, near: DataFrame) -> DataFrame:
    """(name, known) of pairs of hashes."""
    named = lambda df, c: df.select(F.xxhash64(c).alias(f"{c}_id"), c)
    return met.join(named(grown, "name"), "name_id").join(named(near, "known"), "known_id").select("name", "known")


def nearest_names(wanted: DataFrame, names: DataFrame, share: float = 0.8, least: int = 10, rounds: tuple[int, ...] = (1, 2, 4, 8, 16)) -> DataFrame:
    """name, nearest, distance: the closest known name within
    max(least, floor(share * length)) edits; ties by name.

    names: (name).  Known names themselves come first.  Then names of up to
    SHORT letters meet those within one edit, and what is left those within
    two, by equal forms: names within r edits are equal once r letters or less
    are left out of each.  Few others have such a form, however many names
    have the same words; where few heads of names do, only tails have forms
    (_by_halves).  Then rounds of growing radius r: an edit takes two pairs of letters away at most, so a name of
    2 r + 1 distinct pairs or more shares one of its 2 r + 1 rarest pairs with
    any name within r edits, and one of the other's.  Only those that do meet,
    and the least distance met so far bounds the radius of the next round: once
    all names within that distance have met, the name is settled.  What is
    farther from all names than half its pairs meets the names whose length is
    within its bound.
    """
    limit = F.greatest(F.lit(least), F.floor(F.length("name") * share).cast("int"))
    known = cut(names.select(F.col("name").alias("known")).filter("known IS NOT NULL").distinct(), "known")
    # the shortest known name is no farther than the longer of both is long
    shortest = known.agg(F.min(F.length("known"))).first()[0]
    w = wanted.select("name").filter("name IS NOT NULL").distinct().withColumn("limit", limit)
    w = cut(w.withColumn("bound", F.least("limit", F.greatest(F.length("name"), F.lit(shortest)))), "wanted")
    best = lambda met: met.groupBy("name").agg(F.min(F.struct("distance", "known")).alias("m")).select("name", F.col("m.known").alias("nearest"), F.col("m.distance").alias("distance"))
    done = cut(w.join(known, F.col("name") == F.col("known")).select("name", F.col("known").alias("nearest"), F.lit(0).alias("distance")), "nearest")
    # a name's radius of the last round, and the least distance met
    state = cut(w.join(done, "name", "left_anti").withColumn("radius", F.lit(0)), "state")

    def further(done: DataFrame, state: DataFrame, grown: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """done and state once the pairs (name, known) within grown's reach have met."""
        met = cut(best(pairs.withColumn("distance", F.levenshtein("name", "known"))), "met")
        j = cut(state.join(grown.select("name", "reach"), "name", "left").join(met, "name", "left").withColumn("radius", F.coalesce("reach", "radius")), "state")
        settled = F.coalesce((F.col("distance") <= F.col("radius")) & (F.col("distance") <= F.col("limit")), F.lit(False))
        done = cut(done.unionByName(j.filter(settled).select("name", "nearest", "distance")), "nearest")
        return done, cut(j.filter(~settled).select("name", "limit", F.least("bound", "distance").alias("bound"), "radius"), "state")

    for r in (1, 2):
        grown = state.filter(F.length("name") <= SHORT).withColumn("reach", F.least(F.lit(r), "bound")).filter("reach > radius")
        if grown.isEmpty():
            continue
        near = known.filter(F.length("known") <= SHORT + r)
        met = _by_halves(grown, near, r)
        pairs = _named(_by_forms(grown, near, r) if met is None else met, grown, near)
        done, state = further(done, state, grown, pairs)
    if state.isEmpty():
        return done
    theirs = _pairs_of_letters(known, "known")
    often = theirs.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    place = lambda c: F.row_number().over(Window.partitionBy(c).orderBy("df", "gram"))
    theirs = cut(theirs.join(often, "gram").withColumn("k", place("known")), "grams")
    ours = cut(_pairs_of_letters(state, "name").join(often, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("k", place("name")), "grams")
    for r in rounds:
        grown = state.join(ours.filter("k = 1").select("name", "size"), "name").withColumn("reach", F.least(F.lit(r), F.col("bound"), F.expr("(size - 1) div 2").cast("int"))).filter("reach > radius")
        mine = ours.select("name", "gram", "k").join(grown.select("name", "reach"), "name").filter("k <= 2 * reach + 1")
        pairs = mine.join(theirs.filter(F.col("k") <= 2 * r + 1).select("known", "gram"), "gram").filter(F.abs(F.length("name") - F.length("known")) <= F.col("reach"))
        done, state = further(done, state, grown, pairs.select("name", "known").distinct())
    rest = state.withColumn("len", F.explode(F.sequence(F.greatest(F.lit(0), F.length("name") - F.col("bound")), F.length("name") + F.col("bound"))))
    met = rest.join(known.withColumn("len", F.length("known")), "len").withColumn("distance", F.levenshtein("name", "known")).filter("distance <= bound")
    return done.unionByName(best(met))


def ground(references: DataFrame, nodes: DataFrame) -> DataFrame:
    """path, name, status, match: references (path, name) that are a node's id
    or name are verified; others get the nearest name, if there is one near."""
    ids = nodes.select(F.col("id").alias("name"), F.col("id").alias("match"))
    names = nodes.groupBy("name").agg(F.min("id").alias("match"))
    known = ids.union(names.select("name", "match")).groupBy("name").agg(F.min("match").alias("match"))
    j = references.select("path", "name").distinct().join(known, "name", "left")
    lost = j.filter("match IS NULL").select("name").distinct()
    near = nearest_names(lost, nodes.select("name")).select("name", "nearest")
    j = j.join(near, "name", "left")
    status = F.when(F.col("match").isNotNull(), "verified").when(F.col("nearest").isNotNull(), "suggested").otherwise("unknown")
    return j.select("path", "name", status.alias("status"), F.coalesce("match", "nearest").alias("match"))
