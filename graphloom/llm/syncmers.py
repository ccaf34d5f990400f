"""Document fingerprints of closed syncmers over code points, in DataFrame code only.

Of each run of K code points the hashes of its inner runs of S are compared;
the run is an anchor - a closed syncmer - if its smallest inner hash lies at
its first or last place.  That depends on the K code points alone, so equal
passages have equal anchors wherever they stand, and about 2 / (K - S + 1) of
all places are anchors, whatever the script and with or without spaces.

A fingerprint is the row of a text's anchors in order, each with its place.
Two fingerprints are matched by position: a match is a
pair of neighbouring anchors at one distance in both texts, and likeness is
the share of such pairs that both have.

As anchors need no context, those of an edited text are put together from
those of the texts it was made of; only the runs across the joint are new.

Texts are taken as they are.  One without anchor, as any of fewer than K code
points, has one for the whole text; an empty text has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, S = 8, 2
#: Rows per bucket of the id order, about, and most buckets; bits of an anchor's hash.
BUCKET_ROWS, BUCKETS, HASH_BITS = 50_000, 10_000, 31
_MASK = (1 << HASH_BITS) - 1


def _bound(value: Column, body) -> Column:
    """body(value) with value computed once, however often and deep body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def place(anchor: Column) -> Column:
    """Where an anchor's run starts."""
    return F.shiftright(anchor, HASH_BITS)


def closed_syncmers(text: Column, k: int = K, s: int = S) -> Column:
    """array<bigint> of a text's anchors in order: place and 31 bits of hash."""
    last = k - s

    def pick(g: Column) -> Column:
        def chosen(x: Column, i: Column) -> Column:
            # comparisons end at the first that fails; near the end they are null
            end, left, right = F.get(g, i + last), F.lit(True), F.lit(True)
            for j in range(1, last):
                left, right = left & (x <= F.get(g, i + j)), right & (end <= F.get(g, i + (last - j)))
            # inner hashes that lie side by side tell all of the run
            parts = sorted({*range(0, last, s), last})
            value = F.xxhash64(*(F.get(g, i + j) for j in parts)).bitwiseAND(F.lit(_MASK))
            return F.when(F.when(x <= end, left).otherwise(right), F.shiftleft(i.cast("bigint"), HASH_BITS) + value).otherwise(F.lit(-1).cast("bigint"))

        return F.array_remove(F.transform(g, chosen), F.lit(-1).cast("bigint"))

    def hashes(c: Column) -> Column:
        runs = F.transform(c, lambda x, i: F.xxhash64(x, *(F.get(c, i + j) for j in range(1, s))))
        return F.slice(runs, F.lit(1), F.greatest(F.lit(0), F.size(c) - (s - 1)))

    return _bound(_bound(F.split(text, ""), hashes), pick)


def or_whole(found: Column, text: Column) -> Column:
    """The anchors, or one for a text that is not empty but has none."""
    whole = F.when(text == "", F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(text).bitwiseAND(F.lit(_MASK))))
    return _bound(found, lambda a: F.when(F.size(a) > 0, a).otherwise(whole))


def anchors(text: Column) -> Column:
    """array<bigint> of a text's anchors; empty for null and empty texts."""
    return _bound(F.coalesce(text.cast("string"), F.lit("")), lambda t: or_whole(closed_syncmers(t), t))


def fingerprint(found: Column) -> Column:
    """Anchors as text: hexadecimal numbers in order, joined by dots; each is
    its hash with its place in front."""
    return F.array_join(F.transform(found, lambda x: F.hex(x)), ".")


def links(found: Column) -> Column:
    """array<bigint>: each pair of neighbouring anchors with their distance; a
    lone anchor by itself."""
    def paired(a: Column) -> Column:
        # the first one's hash on top of the differences of places and hashes
        link = lambda x, i: F.shiftleft(x, 64 - HASH_BITS).bitwiseXOR(F.get(a, i + 1) - x)
        both = F.transform(F.slice(a, F.lit(1), F.greatest(F.lit(0), F.size(a) - 1)), link)
        return F.when(F.size(a) == 1, F.array(F.shiftleft(F.element_at(a, 1), 64 - HASH_BITS))).otherwise(both)

    return _bound(found, paired)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two rows of links; 1 for two empty ones."""
    shared, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(shared / union)


def match_positions(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id_l, id_r, at_l, at_r) of equal anchors that occur once on either side.

    left and right: (id, anchors).  The places align passages that two
    documents share.  Anchors that occur more often fix no place.
    """
    def once(df: DataFrame, side: str) -> DataFrame:
        flat = df.select(F.col("id").alias(f"id_{side}"), F.explode("anchors").alias("a"))
        flat = flat.select(f"id_{side}", place(F.col("a")).cast("int").alias(f"at_{side}"), F.col("a").bitwiseAND(F.lit(_MASK)).alias("anchor"))
        return flat.groupBy(f"id_{side}", "anchor").agg(F.min(f"at_{side}").alias(f"at_{side}"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")

    return once(left, "l").join(once(right, "r"), "anchor").select("id_l", "id_r", "at_l", "at_r")


def _below(cuts: list[int], value: Column) -> Column:
    """How many of the sorted cuts are less than value, found in two steps."""
    width = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)] or [[]]
    list_of = lambda xs: F.array(*(F.lit(x) for x in xs)).cast("array<bigint>")
    first = F.size(F.filter(list_of([g[-1] for g in groups if g]), lambda c: c < value))
    within = F.get(F.array(*(list_of(g) for g in groups)), first)
    return first * F.lit(width) + F.coalesce(F.size(F.filter(within, lambda c: c < value)), F.lit(0))


def _buckets(rows: DataFrame, id_col: str, tie: str, bucket_rows: int) -> Column:
    """A number for each row that ascends in (id descending, nulls last, tie).

    Cuts are quantiles of the ids, at most BUCKETS of them.  An id that holds
    several cuts, and the null ids, are cut by the tie, which is a hash of 63 bits.
    """
    n, void = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col(id_col).isNull(), 1))).first()
    wanted = int(min(BUCKETS, max(2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // bucket_rows))))
    shares = [i / wanted for i in range(1, wanted)]
    found = rows.agg(F.percentile_approx(id_col, shares, 20 * wanted).alias("q")).first()["q"] if n > void and shares else []
    cuts = sorted(set(found or []))
    often = {c: m for c in cuts if (m := found.count(c)) > 1} if len(cuts) < len(found or []) else {}
    sliced = lambda parts: F.floor(F.col(tie) / F.lit(2.0**63) * parts).cast("bigint")
    hot = F.lit(0).cast("bigint")
    if often:
        parts = F.get(F.array(*(F.lit(often[c]) for c in sorted(often))), F.array_position(F.array(*(F.lit(c) for c in sorted(often))).cast("array<bigint>"), F.col(id_col)).cast("int") - 1)
        # the largest ids of their interval, so before the rest of it
        hot = F.coalesce(sliced(parts), F.lit(BUCKETS).cast("bigint"))
    interval = F.lit(len(cuts)) - _below(cuts, F.col(id_col))
    nulls = F.shiftleft(F.lit(len(cuts) + 1).cast("bigint"), 20) + sliced(F.lit(max(1, -(-void * wanted // max(n, 1)))))
    return F.when(F.col(id_col).isNull(), nulls).otherwise(F.shiftleft(interval.cast("bigint"), 20) + hot)


def with_next(rows: DataFrame, id_col: str, columns: list[str], text: str, derived: dict[str, Column] | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """rows with next_<column> of the next row in descending id order, after
    the last row that of the first; null ids come last, equal ids by their text.

    The order is cut into buckets at quantiles of the ids.  Each bucket also
    gets its successor's first rows, so no bucket has to look into another.
    Derived columns are made where the buckets are, so they are not moved;
    columns may name them.
    """
    hashed = F.shiftrightunsigned(F.xxhash64(text), 1)
    own = rows.withColumn("__h", hashed)
    own = own.withColumn("__b", _buckets(own.select(id_col, "__h"), id_col, "__h", bucket_rows))
    # at most BUCKETS cuts and as many slices: a table of bounded size
    heads = own.groupBy("__b").agg(F.max(F.struct(F.col(id_col).alias("id"), (-F.col("__h")).alias("h"))).alias("head"))
    order = Window.orderBy("__b")
    heads = heads.select("__b", "head", F.lag("__b").over(order).alias("before"), F.max("__b").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("end"))
    heads = heads.select(F.col("__b").alias("__at"), "head", F.coalesce("before", "end").alias("before"))
    found = own.join(F.broadcast(heads), F.col("__b") == F.col("__at")).drop("__at")
    leads = F.col(id_col).eqNullSafe(F.col("head.id")) & (F.col("__h") == -F.col("head.h"))
    both = F.array(F.struct(F.col("__b").alias("b"), F.lit(False).alias("ghost")), F.struct(F.col("before").alias("b"), F.lit(True).alias("ghost")))
    spread = found.withColumn("__p", F.explode(F.when(leads, both).otherwise(F.slice(both, 1, 1)))).drop("head", "before", "__b")
    spread = spread.select("*", F.col("__p.b").alias("__at"), F.col("__p.ghost").alias("__ghost")).drop("__p").repartition("__at").withColumns(derived or {})
    w = Window.partitionBy("__at").orderBy("__ghost", F.col(id_col).desc_nulls_last(), "__h", text)
    placed = spread.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in columns))
    return placed.filter(~F.col("__ghost")).drop("__at", "__ghost", "__h")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next for every row.

    The edited text has its last floor(n_chars / 2) code points replaced by
    the first as many (or all) of the next document's.  Null texts are empty
    ones; two empty fingerprints are alike (1.0).  Repeated rows follow each
    other in the order.  Whole texts of any length are read, a row at a time.
    Other columns are left behind; an empty table gives an empty one.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    own = F.struct(closed_syncmers(F.col("text")).alias("found"), F.xxhash64("text").bitwiseAND(F.lit(_MASK)).alias("whole"), (F.col("text") == "").alias("none"))
    placed = with_next(rows, "doc_id", ["text", "own"], "text", {"own": own}, bucket_rows)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    front, back = F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)
    out = placed.withColumn("n_chars", n.cast("long")).withColumn("front", front).withColumn("back", back).drop("text", "next_text")
    # runs within one part are known; those across the joint are looked for
    left, right = F.char_length("front"), F.char_length("back")
    joint = F.concat(F.expr(f"right(front, {K - 1})"), F.expr(f"left(back, {K - 1})"))
    # what does not depend on the anchor is computed once, not by anchor
    bits = lambda n: F.shiftleft(n.cast("bigint"), HASH_BITS).alias("n")
    shift = lambda a, by: _bound(F.struct(a.alias("a"), bits(by)), lambda z: F.transform(z["a"], lambda x: x + z["n"]))
    within = lambda a, size: _bound(F.struct(a.alias("a"), bits(size - K + 1)), lambda z: F.filter(z["a"], lambda x: x < z["n"]))
    edited = F.concat(within(F.col("own.found"), left), shift(closed_syncmers(joint), F.greatest(F.lit(0), left - (K - 1))), shift(within(F.col("next_own.found"), right), left))
    lone = lambda c: F.when(F.size(f"{c}.found") > 0, F.col(f"{c}.found")).when(F.col(f"{c}.none"), F.array().cast("array<bigint>")).otherwise(F.array(f"{c}.whole"))
    whole = F.concat("front", "back")
    out = out.select("doc_id", "n_chars", F.sha2(whole.cast("binary"), 256).alias("edited_sha256"), lone("own").alias("own"), lone("next_own").alias("next_own"), or_whole(edited, whole).alias("edited"))
    out = out.withColumns({"own_links": links(F.col("own")), "edited_links": links(F.col("edited")), "next_links": links(F.col("next_own"))}).drop("next_own")
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own_links"), F.col("edited_links")).alias("near_edited"),
        likeness(F.col("own_links"), F.col("next_links")).alias("near_next"),
    )
