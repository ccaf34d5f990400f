"""URL filter: host and path rules, then a character language-model ratio.

Two smoothed variable-order Markov models, one of accepted and one of rejected
URLs, give every character a likelihood after the up to five characters
before it.  A URL's score is the mean over its characters of the difference of
their log-likelihoods; a cut calibrated on the labelled URLs decides.

URLs that a rule settles are the labelled ones; a hashed fifth of them is held
out of the models and calibrates the cut.  Everything is DataFrame code.
Characters stay as they are, so the n-gram table grows with the URLs; it is
joined by shuffles, once per distinct n-gram, and then with the places.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialise

#: Longest n-gram: a character and five before it; what stands before the first.
ORDER, START = 6, "\x02"
#: N-grams in more places than this, and in more than one of HOT_SHARE, are not
#: dealt by a shuffle: at most HOT_SHARE of them.
HOT, HOT_SHARE = 20_000, 10_000
#: Characters of a task; of HOLD labelled URLs one is held out.
TASK_CHARS, HOLD = 500_000, 5

#: (host, path, action): a rule holds for its host and all subdomains, where the path starts with its own.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path of a URL; both empty without ``://``."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(text, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(text, pattern, 2)


def match_rules(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, nulls if none does.

    For lists of up to some hundred rules; of equally long ones the first wins.
    """
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, a in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, action = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(a)).otherwise(action)
    return name, action


def symbols(url: Column) -> Column:
    """The URL led by ORDER - 1 start symbols."""
    return F.concat(F.lit(START * (ORDER - 1)), F.coalesce(url.cast("string"), F.lit("")))


def _positions(rows: DataFrame) -> DataFrame:
    """One row per character of s with the longest n-gram that ends there.

    A row without characters gives one row with a null n-gram."""
    count = F.length("s") - (ORDER - 1)
    starts = F.when(count > 0, F.sequence(F.lit(1), count))
    exploded = rows.withColumn("at", F.explode_outer(starts))
    return exploded.withColumn("g", F.substring(F.col("s"), F.col("at"), F.lit(ORDER))).drop("s", "at")


def fit(labelled: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """What the two models differ by: (g, llr), log-likelihood differences of
    all n-grams of 1 to ORDER symbols seen; (c, back), those of the weights
    that contexts leave to the context one shorter; the difference for
    characters never seen.

    labelled: (s, accepted).  Witten-Bell smoothing: a context that was seen N
    times with T different next characters trusts its own counts by N / (N + T)
    and the context one shorter for the rest; single characters, one unseen
    among them, get half a count more than seen.
    """
    seen = _positions(labelled.select("s", "accepted")).filter("g IS NOT NULL")
    # counted once at full length; shorter n-grams are sums of those
    full = materialise(seen.groupBy("g").agg(*(F.sum((F.col("accepted") == side).cast("long")).alias(c) for c, side in (("a", True), ("r", False)))), "url-grams")
    total = full.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("r"), F.lit(0)).alias("r"), F.count_distinct(F.substring("g", ORDER, 1)).alias("size")).first()
    whole = {c: total[c] + 0.5 * (total["size"] + 1) for c in "ar"}
    lower, model, backs = None, None, None
    for k in range(1, ORDER + 1):
        grams = full.groupBy(F.substring("g", ORDER - k + 1, k).alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        if k == 1:
            level = grams.select("g", *(((F.col(c) + 0.5) / F.lit(whole[c])).alias(f"p{c}") for c in "ar"))
        else:
            ctx = F.substring("g", 1, k - 1)
            contexts = grams.groupBy(ctx.alias("c")).agg(*(f for c in "ar" for f in (F.sum(c).alias(f"n{c}"), F.sum((F.col(c) > 0).cast("long")).alias(f"t{c}"))))
            left = lambda c: F.when(F.col(f"n{c}") > 0, F.col(f"t{c}") / (F.col(f"n{c}") + F.col(f"t{c}"))).otherwise(1.0)
            contexts = materialise(contexts.select("c", "na", "nr", left("a").alias("la"), left("r").alias("lr")), f"url-contexts{k}")
            joined = grams.withColumn("c", ctx).join(contexts, "c").withColumn("low", F.substring("g", 2, k - 1)).join(lower.withColumnRenamed("g", "low"), "low")
            own = lambda c: F.when(F.col(f"n{c}") > 0, F.col(c) / F.col(f"n{c}")).otherwise(0.0)
            level = joined.select("g", *(((1 - F.col(f"l{c}")) * own(c) + F.col(f"l{c}") * F.col(f"p{c}")).alias(f"p{c}") for c in "ar"))
            back = contexts.select("c", (F.log("la") - F.log("lr")).alias("back"))
            backs = back if backs is None else backs.union(back)
        lower = materialise(level, f"url-level{k}")
        llr = lower.select("g", (F.log("pa") - F.log("pr")).alias("llr"))
        model = llr if model is None else model.union(llr)
    return model, backs, math.log(whole["r"] / whole["a"])


def score(rows: DataFrame, model: tuple[DataFrame, DataFrame, float], key: str) -> DataFrame:
    """key and the mean log-likelihood difference of s, once per key.

    Each character uses the longest n-gram ending there that training saw, and
    for each longer context that it did see the weight left to shorter ones.
    Without characters the score is 0.
    """
    values, backs, unseen = model
    places = rows.agg(F.coalesce(F.sum(F.length("s") - (ORDER - 1)), F.lit(0))).first()[0]
    # urls are short but have many places: they are dealt before those are made
    at = _positions(rows.select(key, "s").repartition(-(-max(places, 1) // TASK_CHARS))).filter("g IS NOT NULL")
    seen = materialise(at.groupBy("g").agg(F.count(F.lit(1)).alias("places")), "url-seen")
    levels = [seen.select("g")]
    for k in range(ORDER - 1, 0, -1):
        levels.append(levels[-1].select(F.substring("g", 2, k).alias("g")).distinct())
    # an n-gram without value of its own has that of the one shorter, led by its context's weight
    known = None
    for k, grams in enumerate(reversed(levels), 1):
        own = grams.join(values.filter(F.length("g") == k), "g", "left")
        if known is None:
            own = own.select("g", F.coalesce("llr", F.lit(unseen)).alias("llr"))
        else:
            low = known.select(F.col("g").alias("low"), F.col("llr").alias("l"))
            weights = backs.filter(F.length("c") == k - 1)
            own = own.withColumn("low", F.substring("g", 2, k - 1)).join(low, "low").withColumn("c", F.substring("g", 1, k - 1)).join(weights, "c", "left")
            own = own.select("g", F.coalesce("llr", F.col("l") + F.coalesce("back", F.lit(0.0))).alias("llr"))
        known = materialise(own, f"url-known{k}")
    # at most HOT_SHARE hot n-grams travel to the tasks
    hot = F.broadcast(seen.filter(F.col("places") > max(HOT, places // HOT_SHARE)).join(known, "g").select("g", "llr"))
    few = at.join(hot, "g", "left_anti").join(known, "g")
    both = at.join(hot, "g").select(key, "llr").union(few.select(key, "llr"))
    means = both.groupBy(key).agg(F.avg("llr").alias("score"))
    return rows.select(key).join(means, key, "left").select(key, F.coalesce("score", F.lit(0.0)).alias("score"))


def filter_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row.

    verdict is the rule's where one fits (rule names it), else that of the
    language models: ``allow`` if the score reaches the cut.  The cut is the
    point between the two classes' mean scores as many standard deviations
    from either, over the labelled URLs that were held out of the models (all
    of a class that has none).  While one class has no example the models
    don't tell, and ``allow`` is the verdict.  A null URL is an empty one; very
    long URLs are read whole.  Repeated rows repeat; other columns are left
    behind; an empty table gives an empty one.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url")).groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("copies"))
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumn("host", host).withColumn("path", path)
    name, action = match_rules(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", name).withColumn("action", action).withColumn("s", symbols(F.col("url"))).withColumn("row", F.monotonically_increasing_id())
    rows = materialise(rows, "urls")
    kept_out = F.pmod(F.xxhash64(F.lit("held out"), "url"), F.lit(HOLD)) == 0
    model = fit(rows.filter(F.col("action").isNotNull() & ~kept_out).select("s", (F.col("action") == "allow").alias("accepted")))
    scored = materialise(rows.withColumn("kept_out", kept_out).drop("s", "url").join(score(rows, model, "row"), "row"), "url-scores")
    spread = (F.avg("score").alias("m"), F.coalesce(F.stddev_pop("score"), F.lit(0.0)).alias("s"))
    found = scored.filter(F.col("action").isNotNull()).groupBy("action", "kept_out").agg(*spread).orderBy("kept_out").collect()
    known = {r["action"]: r for r in found}  # the held-out ones, where there are any
    verdict = F.lit("allow")
    if len(known) == 2:
        a, b = known["allow"], known["block"]
        wide = a["s"] + b["s"]
        cut = (a["m"] * b["s"] + b["m"] * a["s"]) / wide if wide > 0 else (a["m"] + b["m"]) / 2
        verdict = F.when(F.col("score") >= F.lit(cut), "allow").otherwise("block")
    out = scored.withColumn("verdict", F.coalesce("action", verdict))
    return out.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("page_id", "host", "path", "rule", "verdict", "score")
