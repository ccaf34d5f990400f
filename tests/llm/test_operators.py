"""Corpus operators against brute force, round trips and odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import components, decontamination, html_text, jaccard_join, language_id, mixing, syncmers, token_counts, toxicity, url_filter, warc
from graphloom.llm.components import connected
from graphloom.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, sig long, score double"


def docs(spark, rows):
    """Documents with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r, *[None] * (4 - len(r)), None, 1, 2, 0.5) if len(r) < 4 else (*r, None, 1, 2, 0.5) for r in rows], DOCS)


def words(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}x" for _ in range(n)]


ODD = [(90, None, "en", None), (91, "", "en", "s"), (92, " \n\t ", None, "s"), (None, "alpha beta", "en", "s"), (93, "one two", "en", "s"), (93, "one two", "en", "s"), (94, "x" * 100_000, "en", "s"), (95, "12 34 !!", "en", "s")]


# --- near duplicates -----------------------------------------------------


def shingles(text):
    w = (text or "").lower().split() if text else []
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
                links[i], links[j] = links[i] + 1, links[j] + 1
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)), links[i]) for i, (d, _) in enumerate(rows)), key=str)


def test_components_match_brute_force(spark, monkeypatch):
    rng, rows = random.Random(3), []
    for g in range(12):
        base = words(g, rng.choice([4, 7, 30, 80]))
        for c in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = f"e{g}{c}"
            rows.append((len(rows), " ".join(w)))
    common = " ".join(words(99, 60))
    rows += [(len(rows) + i, common + " " + " ".join(words(500 + i, rng.choice([3, 30, 90])))) for i in range(15)]
    rows += [(d, t) for d, t, *_ in ODD]
    listed = lambda: sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_join.similarity_components(docs(spark, rows)).collect()), key=str)
    assert listed() == brute_components(rows)
    # many small blocks of a component or a group, and rows of one partner
    for name in ("BLOCK", "STAR", "COLUMNS"):
        monkeypatch.setattr(jaccard_join, name, 2)
    assert listed() == brute_components(rows)


def test_shared_paragraphs_make_few_candidates(spark, monkeypatch):
    """Of documents mixed from paragraphs, no two similar, next to no pair is verified."""
    paragraphs = [" ".join(words(3000 + i, 50, 100_000)) for i in range(60)]
    verified = []
    real = jaccard_join._verify
    monkeypatch.setattr(jaccard_join, "_verify", lambda pairs, sets: (verified.append(pairs.count()), real(pairs, sets))[1])
    for n in (300, 1200):
        mixed = [(i, " ".join(random.Random(i).sample(paragraphs, 5))) for i in range(n)]
        got = jaccard_join.similarity_components(docs(spark, mixed)).collect()
        want = brute_components(mixed) if n == 300 else None
        assert want is None or sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in got), key=str) == want
    assert sum(verified) <= 1500


def test_groups_of_two_are_placed_no_more(spark, monkeypatch):
    """Each text shares half its words with the one before and the one after."""
    rng = random.Random(3)
    blocks = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(50)) for _ in range(12)]
    counts, real = {}, jaccard_join.materialise

    def counted(df, name):
        out = real(df, name)
        counts.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "materialise", counted)
    got = jaccard_join.similarity_components(docs(spark, [(i, f"{blocks[i - 1]} {blocks[i]}") for i in range(12)])).collect()
    assert counts["groups"][0] > 2 and sum(counts["placed"]) == 0
    assert all(r["component_id"] == r["doc_id"] and r["n_links"] == 0 for r in got)


def test_map_of_keys_drops_most_others(spark):
    rows = spark.range(20000).select(F.xxhash64("id").alias("key"), F.col("id").cast("string").alias("text"))
    keys = rows.filter("text % 10 = 3").select("key")
    left = jaccard_join._may_match(rows, keys, "key")
    assert left.columns == rows.columns and left.join(keys, "key", "left_semi").count() == 2000
    assert left.count() < 2000 + 18000 / 8
    assert jaccard_join._may_match(rows, keys.limit(0), "key").count() == 0


def test_components_of_empty_table(spark):
    assert jaccard_join.similarity_components(docs(spark, [])).count() == 0


def test_prefix_and_overlap_bounds():
    for n in range(1, 60):
        for m in range(1, 60):
            for k in range(min(n, m) + 1):
                ok = 100 * k >= 80 * (n + m - k)
                assert ok == (k >= -(-4 * (n + m) // 9))
        assert jaccard_join.prefix_length(n) == n - -(-4 * n // 5) + 1
    x = np.arange(10, dtype=np.uint64) << np.uint64(59)
    assert jaccard_join.similar(x, x) and not jaccard_join.similar(x, x[:7]) and jaccard_join.similar(x, x[:8])


def test_connected(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (7, 7)]
    roots = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert len({roots[i] for i in range(31)}) == 1 and roots[100] == roots[102] != roots[0]


def test_rounds_of_an_ordered_path(spark, monkeypatch):
    made = []
    real = components.materialise
    monkeypatch.setattr(components, "materialise", lambda df, name: (made.append(name), real(df, name))[1])
    roots = components.connected(spark.createDataFrame([(i, i + 1) for i in range(1000)], "x long, y long"))
    assert roots.select("root").distinct().count() == 1 and roots.count() == 1001
    assert made.count("move") <= 16
    # a star ends with the second round, whatever its size and its centre's place
    del made[:]
    spokes = spark.range(3000).selectExpr("5L AS x", "id AS y").union(spark.range(3000, 6000).selectExpr("id AS x", "4500L AS y"))
    roots = components.connected(spokes)
    assert roots.select("root").distinct().count() == 2 and roots.count() == 6000
    assert made.count("move") <= 2


# --- language, toxicity --------------------------------------------------

ALPHABETS = {"aa": "abcde", "bb": "fghij", "cc": "klmno", "dd": "pqrst", "ee": "uvwxy"}


def prose(lang, seed, n=30):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(ALPHABETS[lang]) for _ in range(rng.randrange(2, 7))) for _ in range(n))


def test_language_of_held_out_texts(spark):
    rows = [(i, prose(lang, i), lang, None) for i, lang in enumerate(list(ALPHABETS) * 12)] + ODD[:3] + ODD[7:]
    d = docs(spark, rows)
    model = language_id.fit(d, "text", "lang", F.col("lang").isin(list(ALPHABETS)))
    fresh = docs(spark, [(i, prose(lang, 1000 + i, 8), lang, None) for i, lang in enumerate(list(ALPHABETS) * 6)] + ODD)
    got = language_id.identify(fresh, model, keep=("doc_id", "lang")).collect()
    assert len(got) == 30 + len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["lang_pred"] == r["lang"] for r in got if r["lang"] in ALPHABETS)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (90, 91, 92, 95)} == {"und"}


def plain_language(model, text):
    """Nearest codeword of a text, one n-gram and one bit at a time."""
    mask, sums, n = 2**64 - 1, [0.0] * model.code.shape[1], 0
    low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else "\0" for c in f" {text} ")
    for k in language_id.ORDERS:
        for i in range(len(low) - k + 1):
            g = low[i : i + k]
            if {1: g[0] != "\0", 2: g != "\0\0"}.get(k, g[1:2] != "\0"):
                h = k * 0x9E3779B1
                for c in g:
                    h = ((h ^ (ord(c) if c != "\0" else 0)) * 0x9E3779B97F4A7C15) & mask
                    h ^= h >> 29
                n += 1
                for j in range(len(sums)):
                    sums[j] += float(model.weights[h >> (64 - language_id.BUCKET_BITS), j])
    if not n:
        return "und"
    answers = [max(-4, min(4, s / n / float(c))) for s, c in zip(sums, model.scale)]
    loss = [sum(t * np.log1p(np.exp(-2 * a * b)) for t, a, b in zip(trust, answers, word)) / sum(trust) for trust, word in zip(model.trust, model.code)]
    return model.languages[int(np.argmin(loss))]


def test_registered_language_query(spark, tmp_path):
    """Columns, fold and predictions of op1 against a plain decoder; every bit has a classifier of its own."""
    rows = [(i, prose(lang, i, 12), lang) for i, lang in enumerate(list(ALPHABETS) * 30)] + [(900, None, "aa"), (901, "", None), (902, "12 !", "bb"), (903, prose("cc", 5, 3) + " É\u0130", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in QUERIES["op1_language_id"](spark, str(tmp_path)).collect()}
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = language_id.fit(d, "text", "lang", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    for i, text, lang in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i]["score"] <= 1
        assert got[i]["lang_pred"] == plain_language(model, text or "")
        assert got[i]["lang_pred"] == ("und" if i in (900, 901, 902) else lang or "cc")
    answers, _ = model.answers([prose(lang, 7000 + i, 12).encode() for i, lang in enumerate(ALPHABETS)])
    assert (answers * model.code > 0).all() and np.linalg.matrix_rank(model.weights.astype(float)) == model.code.shape[1]


def test_language_without_training_rows(spark):
    model = language_id.fit(docs(spark, []), "text", "lang", F.lit(True))
    assert [r["lang_pred"] for r in language_id.identify(docs(spark, ODD[3:5]), model).collect()] == ["und", "und"]


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 7, 12):
        code = language_id.codewords(n).astype(int)
        apart = (code.shape[1] - code @ code.T) // 2
        assert (apart + np.eye(n, dtype=int) * 99).min() >= max(1, code.shape[1] // 4)


def test_toxicity_of_held_out_texts(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        w, bad = words(i, 60, 3000), i % 6 == 0
        if bad:
            w[rng.randrange(60)] = rng.choice(["vile", "rotten"]) + rng.choice(["", "ly", "er"])
        rows.append((i, " ".join(w), "en", None))
        if i % 2 == 0:
            labels.append((i, 0, int(bad)))
    d = docs(spark, rows + ODD)
    lab = spark.createDataFrame(labels + [(None, 0, 1), (3, None, None), (0, 0, 0)], "doc_id long, quality int, toxic int")
    keep = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 != 1
    model = toxicity.fit(d, lab, "doc_id", "text", "toxic", keep)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(d, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    wrong = sum((got[i] >= 0.7) != (i % 6 == 0) for i in held)
    assert wrong <= len(held) // 20 and all(0 <= s <= 1 for s in got.values())


def test_toxicity_without_positives(spark):
    model = toxicity.fit(docs(spark, ODD), spark.createDataFrame([], "doc_id long, toxic int"), "doc_id", "text", "toxic", F.lit(True))
    assert {r["score"] < 0.7 for r in toxicity.score(docs(spark, ODD), model).collect()} == {True}


# --- URLs ----------------------------------------------------------------


def brute_rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    best = max((r for r in url_filter.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])), key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best[0] + best[1] if best else None, best[2] if best else None


def test_urls(spark):
    urls = ["http://A.Example.com/en/7?x", "https://example.net/de/81", "https://example.net/de/9#a", "http://b.org/es/", "http://com/en/1", "x", None, "", "http://a\nb.com/en/2", "ftp://notexample.org/fr/", "://host", "http://ä.de/de/"]
    urls += [f"http://good{i}.example.net/de/{i}" for i in range(40)] + [f"http://bad{i}.example.org/es/{i}" for i in range(40)] + ["http://good99.example.info/x", "http://bad99.example.info/x", "x"]
    pages = spark.createDataFrame([(i if u else None, u, "h", "s") for i, u in enumerate(urls)], "page_id long, url string, host string, g string")
    got = url_filter.filter_urls(pages).collect()
    assert len(got) == len(urls)
    by = {r["page_id"]: r for r in got if r["page_id"] is not None}
    for i, u in enumerate(urls):
        if u:
            host, path, rule, verdict = brute_rule(u)
            assert (by[i]["host"], by[i]["path"], by[i]["rule"]) == (host, path, rule)
            assert by[i]["verdict"] == verdict or verdict is None
    assert by[urls.index("http://good99.example.info/x")]["verdict"] == "allow" and by[urls.index("http://bad99.example.info/x")]["verdict"] == "block"


def test_urls_keep_their_characters(spark, monkeypatch):
    urls = [f"http://a.example.com/en/{h}{i}" for h in (7, 8) for i in range(40)]
    urls += ["http://x.info/en/71", "http://x.info/en/81"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages).collect()}
    assert got[80]["verdict"] == "allow" and got[81]["verdict"] == "block" and got[80]["rule"] is None
    monkeypatch.setattr(url_filter, "HOT", 3)
    again = {r["page_id"]: r["score"] for r in url_filter.filter_urls(pages).collect()}
    assert all(again[i] == pytest.approx(r["score"]) for i, r in got.items())


def brute_model(urls):
    """Witten-Bell probability of the last character of (context, c) among urls."""
    from functools import cache

    follow, n = {}, url_filter.ORDER
    for u in urls:
        s = url_filter.START * (n - 1) + u
        for i in range(n - 1, len(s)):
            for k in range(n):
                follow.setdefault(s[i - k : i], Counter())[s[i]] += 1

    def at(size):
        @cache
        def p(ctx, c):
            if not ctx:
                own = follow.get("", Counter())
                return (own[c] + 0.5) / (own.total() + 0.5 * (size + 1))
            own, rest = follow.get(ctx, Counter()), p(ctx[1:], c)
            return (own[c] + len(own) * rest) / (own.total() + len(own)) if own else rest
        return p
    return at


def test_url_scores_match_brute_force(spark, tmp_path):
    """The registered query's scores and verdicts against models counted one by one."""
    rng, urls = random.Random(6), []
    for i in range(500):
        host = rng.choice(["example.com", "a.example.net", "x.org", "y.info", "münchen.info"])
        urls.append(f"http://{host}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.randrange(100)}{rng.choice(['', '?q=ä', '#🙂', '%7Euser'])}")
    urls += [None, "", "nothing", "zzzzzz", "q" * 5000, urls[0], urls[0]]
    spark.createDataFrame([(i, u, 1.0) for i, u in enumerate(urls)], "page_id long, url string, score double").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r for r in QUERIES["op3_url_filter"](spark, str(tmp_path)).collect()}
    out = {r["u"] for r in spark.createDataFrame([(u,) for u in urls], "u string").filter(F.pmod(F.xxhash64(F.lit("held out"), "u"), F.lit(url_filter.HOLD)) == 0).collect()}
    rules = {u: brute_rule(u)[3] for u in set(urls)}
    train = {a: [u for i, u in enumerate(urls) if u is not None and rules[u] == a and u not in out] for a in ("allow", "block")}
    size = len(set("".join(train["allow"] + train["block"])))
    good, bad = (brute_model(train[a])(size) for a in ("allow", "block"))
    scores = {}
    for u in set(urls):
        s, n = url_filter.START * (url_filter.ORDER - 1) + (u or ""), url_filter.ORDER - 1
        each = [np.log(good(s[i - n : i], s[i])) - np.log(bad(s[i - n : i], s[i])) for i in range(n, len(s))]
        scores[u] = float(np.mean(each)) if each else 0.0
    known = {a: [scores[u] for u in urls if u is not None and rules[u] == a and u in out] for a in ("allow", "block")}
    (ma, sa), (mb, sb) = ((np.mean(known[a]), np.std(known[a])) for a in ("allow", "block"))
    cut = (ma * sb + mb * sa) / (sa + sb)
    for i, u in enumerate(urls):
        assert got[i]["score"] == pytest.approx(scores[u], abs=1e-9), u
        assert got[i]["verdict"] == (rules[u] or ("allow" if scores[u] >= cut else "block"))


def test_of_equally_long_rules_the_first_wins(spark):
    rules = (("a.b", "/c", "block"), (".b", "/c/", "allow"), ("b", "/c/d", "allow"), ("b", "/c/e", "block"))
    pages = spark.createDataFrame([(0, "s://a.b/c"), (1, "s://a.b/c/d"), (2, "s://b/c/e/f"), (3, "s://b/x")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, rules=rules).collect()}
    assert got[0] == ("a.b/c", "block") and got[1] == ("b/c/d", "allow") and got[2] == ("b/c/e", "block") and got[3][0] is None


def test_urls_of_empty_table(spark):
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


# --- mixing --------------------------------------------------------------


def test_sainte_lague_matches_one_by_one():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n = int(rng.integers(1, 7))
        w, most, seats = rng.integers(0, 50, n).astype(float), rng.integers(0, 30, n), int(rng.integers(0, 60))
        got, want = mixing.sainte_lague(w, seats, most), np.zeros(n, int)
        for _ in range(seats):
            q = [(-w[i] / (2 * want[i] + 1), i) for i in range(n) if want[i] < most[i] and w[i] > 0]
            if q:
                want[min(q)[1]] += 1
        assert got.tolist() == want.tolist()


def test_mix(spark, monkeypatch):
    """The registered query: targets, caps and reruns; few rows a shard, many groups."""
    rows = [(1000 + i, " ".join(words(i, 5 + i % 40)), "en", f"s{i % 5}" if i % 7 else None) for i in range(300)] + ODD
    d = docs(spark, rows)
    size = {s: sum(len((r[1] or "").split()) for r in rows if r[3] == s) for s in {r[3] for r in rows}}
    order = sorted((s for s in size if s is not None)) + [None]
    want = mixing.capped_targets([size[s] for s in order], [1 + i % 3 for i in range(len(order))])
    assert sum(want) == pytest.approx(sum(size.values())) and all(t <= 3 * size[s] + 1e-9 for t, s in zip(want, order))
    source = dict((r[0], r[3]) for r in rows)
    for shard_rows, group in ((1000, 4096), (40, 3)):
        monkeypatch.setattr(mixing, "GROUP", group)
        got = mixing.mix(d, shard_rows=shard_rows).collect()
        assert len(got) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
        taken = Counter()
        for r in got:
            taken[source[r["doc_id"]]] += r["taken"]
            assert r["source_size"] == size[source[r["doc_id"]]] and r["target"] == pytest.approx(want[order.index(source[r["doc_id"]])])
        assert all(abs(taken[s] - t) <= 16 * 12 for s, t in zip(order, want))
        assert sorted((r["doc_id"] or -1, r["taken"]) for r in mixing.mix(d, shard_rows=shard_rows).collect()) == sorted((r["doc_id"] or -1, r["taken"]) for r in got)
    assert mixing.mix(docs(spark, [])).count() == 0


def test_words_taken_one_by_one(spark):
    """taken against a walk over the words of one shard, block by block."""
    rows = [(i, " ".join(words(i, 3 + i % 9)), "en", "a" if i < 60 else "b") for i in range(90)]
    got = {r["doc_id"]: r["taken"] for r in mixing.mix(docs(spark, rows), block_words=4).collect()}
    size = {i: len(t.split()) for i, t, *_ in rows}
    hashed = spark.createDataFrame([(i, t) for i, t, *_ in rows], "i long, t string").select("i", F.xxhash64(F.lit(17), F.col("i").cast("string"), F.xxhash64("t"), F.lit(1).cast("long")).alias("p")).collect()
    starts = [r[0] for r in spark.range(2).orderBy("id").select(F.xxhash64(F.lit(17), "id", F.lit(0).cast("long"))).collect()]
    own = {k: sum(size[i] for i, _, _, s in rows if s == k) for k in "ab"}
    target = mixing.capped_targets([own["a"], own["b"]], [1.0, 2.0])
    quota = mixing.sainte_lague(np.array(target), round(sum(own.values()) / 4), np.array([3 * -(-own[k] // 4) for k in "ab"]))
    place = {r["i"]: r["p"] for r in hashed}
    for n, (k, start) in enumerate(zip("ab", starts)):
        line = [i for _, i in sorted((place[i], i) for i, _, _, s in rows if s == k) for _ in range(size[i])]
        blocks = [line[j : j + 4] for j in range(0, len(line), 4)]
        want = Counter()
        for b in range(int(quota[n])):
            # whole rounds first, then the run from the seeded block on
            done = int(quota[n]) // len(blocks) * len(blocks)
            want.update(blocks[b % len(blocks)] if b < done else blocks[(start % len(blocks) + b - done) % len(blocks)])
        assert {i: got[i] for i, _, _, s in rows if s == k} == {i: want[i] for i, _, _, s in rows if s == k}


def test_repeated_rows_spread_over_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 50)
    same = spark.range(400).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a b c d e").alias("text"), F.lit("s").alias("source"))
    rest = spark.createDataFrame([(2, "x " * 50, "t")], "doc_id long, text string, source string")
    got = mixing.mix(same.union(rest), shard_rows=20).collect()
    assert len(got) == 401 and len({r["taken"] for r in got if r["doc_id"] == 1}) > 1
    assert abs(sum(r["taken"] for r in got if r["doc_id"] == 1) - next(r["target"] for r in got if r["doc_id"] == 1)) <= 16 * 20


# --- tokens, archives, pages --------------------------------------------


def test_token_counts(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = ODD + [(i, t, "en", "s") for i, t in enumerate(["  two  spaces ", "<s> </s> <unk>", "tab\tnew\nline  ", "▁ ▁▁x", "日本語 текст ñandú 🙂", "a b c", "   "])]
    got = token_counts.count_tokens(docs(spark, rows), path, keep=("doc_id", "lang")).collect()
    want = sorted((len((t or "").encode()), len(sp.encode(t or ""))) for _, t, *_ in rows)
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in got) == want and any(r["over_limit"] for r in got)


def test_archive_round_trip(spark, tmp_path):
    html = ["<p>a</p>", "", None, "<p>a</p>", "é" * 3000, "é" * 3000, "<p>a</p>", "x\r\n\r\ny"]
    pages = spark.createDataFrame([(i if i != 6 else None, f"http://h/{i} x\r\n" if i else None, h, 1) for i, h in enumerate(html)] + [(7, "u", "x\r\n\r\ny", 1)], "page_id long, url string, html string, bytes int")
    folder = f"file://{tmp_path}/a"
    index = warc.write_archive(pages, folder)
    got = {(r["page_id"], r["record_type"]): r for r in warc.read_archive(index, folder).collect()}
    assert index.count() == 9 and len(got) == 8
    assert got[0, "response"]["payload"] == b"<p>a</p>" and got[3, "revisit"]["refers_to"] == 0 and got[None, "revisit"]["refers_to"] == 0
    assert got[1, "response"]["payload_bytes"] == 0 and got[2, "revisit"]["refers_to"] == 1 and got[5, "revisit"]["payload_bytes"] == 6000
    assert got[7, "response"]["payload"] == b"x\r\n\r\ny"
    import zstandard

    for f in (tmp_path / "a").glob("*.zst"):
        with f.open("rb") as s:
            frames = warc.read_seek_table(s, f.stat().st_size)
            s.seek(0)
            whole = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(s.read(frames[-1][0] + frames[-1][1]))
        assert whole.startswith(b"WARC/1.1\r\n") and sum(d for _, _, d in frames) == len(whole)
    assert warc.archive_round_trip(spark, pages.limit(0)).count() == 0


def test_archive_of_many_frames_and_hot_payloads(spark, tmp_path, monkeypatch):
    """The registered query with small frames, a hot payload and one above a frame."""
    monkeypatch.setattr(warc, "HOT", 3)
    monkeypatch.setattr(warc, "HOT_SHARE", 10)
    big = "".join(random.Random(1).choice("abcdef<>é") for _ in range(1 << 20)) * 2
    html = ["same"] * 30 + [None, "", "same 2", "same 2", big, big] + [f"page {i} " * 20_000 for i in range(20)]
    pages = [(i * 7 % 101 if i != 4 else None, f"http://h/{i}", h) for i, h in enumerate(html)]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in QUERIES["op6_warc"](spark, str(tmp_path)).collect())
    first = {}
    for p, _, h in pages:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    import base64

    want = []
    for p, _, h in pages:
        raw = (h or "").encode()
        response = p == first[h or ""]
        want.append((str(p), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if response else "revisit", None if response else first[h or ""]))
    assert got == sorted(want)
    folder = f"file://{tmp_path}/b"
    index = warc.write_archive(spark.read.parquet(f"{tmp_path}/pages.parquet"), folder)
    assert index.select("bundle", "frame").distinct().count() > index.select("bundle").distinct().count()


def test_html(spark):
    page = """<html><head><title>T</title><script>var a="</p>"</script></head><body><nav><a href=x>Home</a> <a>News</a></nav><div class="cookie-notice">We use cookies</div>
    <article><h1>Head &amp; line</h1><p>First <b>bold</b>text  here.<br>Next<p>Second &eacute;&#233;<form>mail <input></form></p><aside>Related</aside><section class="comments"><p>nice post</p></section><p>Last one</article>
    <footer>&copy; us</footer></body>"""
    plain = "<body><ul><li><a>x</a><li><a>y</a></ul><div id=content><p>Long text of many words that says a lot.</p><p>More of it, too.</p></div><div class='ads'>buy</div>"
    pages = spark.createDataFrame([(1, "u", page, "t"), (2, "u", plain, "t"), (3, None, None, "t"), (4, "u", "", "t"), (5, "u", "<<a< b <!-- x", "t"), (1, "u", page, "t"), (6, "u", "<p>" * 20000 + "deep", "t"), (7, "u", "<article>one two</article><article>one two</article>", "t")], "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract(pages, html_text.fit(pages)).collect()]
    by = {p: t for p, t, _ in got}
    assert len(got) == 8 and by[7] == "one two one two" and all(len(t) == n for _, t, n in got)
    assert by[1] == "Head & line First boldtext here. Next Second éé Last one"
    assert by[2] == "Long text of many words that says a lot. More of it, too." and by[3] == by[4] == ""


def test_html_wrappers_do_not_shut_the_article():
    body = "<p>Long text of many words that says a lot.</p><p>More of it, too.</p>"
    text, model = "Long text of many words that says a lot. More of it, too.", html_text.Model()
    wraps = ['<div style="overflow:hidden">%s</div>', '<div data-x="/p?id=comment">%s</div>', '<div class="layout has-sidebar"><article>%s</article></div>', '<div class="post tags-open comments">%s</div>', "<form>%s</form>", '<form><main>%s<div class="comments"><p>nice post</p></div></main></form>']
    for wrap in wraps:
        assert model.extract("<body><div class=ads>buy</div>" + wrap % body + "<nav><a>Home</a></nav></body>") == text, wrap
    assert model.extract(f"<article>{body}<p hidden>gone</p><p data-hidden=1><a href='/hidden-valley'>kept</a></p></article>") == text + " kept"


def test_names_are_learned():
    """A name that stands only outside articles leaves its element out; a known one that the pages prove wrong does not."""
    page = '<div class="teaser">' + "buy this now " * 9 + '</div><article class=x><p>Text of it.</p><div class="tags">%s</div></article>'
    counts = html_text.learn([page % "kept"] * 9)
    assert counts["name:teaser"] == (0, 243) and html_text.weigh(counts).words["name:teaser"] <= html_text.SHUT_WEIGHT
    model = html_text.weigh(counts | {"name:tags": (500, 0)})
    assert model.extract('<article><p>A few words more.</p><div class="teaser">no</div><div class=tags>yes</div></article>') == "A few words more. yes"
    assert html_text.Model().extract('<article><p>A few words more.</p><div class="teaser">no</div><div class=tags>yes</div></article>') == "A few words more. no"


def test_long_pages_take_linear_time():
    import time

    model, took = html_text.Model(), []
    for n in (10_000, 40_000):
        page = "".join(f'<div class="c{i} ad"><b>w</i>' for i in range(n)) + "".join("</p></section></li>" for _ in range(n)) + "<article>deep words"
        began = time.process_time()
        assert model.extract(page).endswith("deep words")
        took.append(time.process_time() - began)
    assert took[1] < 10 * max(took[0], 0.1)


def test_best_region_is_maximal():
    rng = random.Random(2)
    model = html_text.Model()
    for _ in range(50):
        runs = [html_text.Run("w", rng.randrange(0, 6), rng.choice([1.5, -0.5, 2.5, -9.0]), rng.random() < 0.3, 0, rng.choices(["p", "a", "div"], k=rng.randrange(3)), False) for _ in range(12)]
        value = lambda a, b: sum(r.words * model.word(r) for r in runs[a:b]) + sum(model.tag(t) for r in runs[a + 1 : b] for t in r.tags)  # noqa: B023,E731
        best = max([(value(a, b), a, b) for a in range(12) for b in range(a + 1, 13)])
        a, b = model.region(runs)
        assert (value(a, b) if b else 0) == pytest.approx(max(best[0], 0))


# --- fingerprints, decontamination ---------------------------------------


def test_fingerprints(spark):
    rows = [(i, " ".join(words(i, 20 + i)), "en", "s") for i in range(40)] + [(50, " ".join(words(3, 23)), "en", "s"), (51, "🙂é x", "en", "s")] + ODD
    got = syncmers.fingerprints(docs(spark, rows)).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = Counter()
    for i, r in enumerate(order):
        t, nxt = r[1] or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        want[r[0], len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    by = {r["doc_id"]: r for r in got}
    assert by[50]["fingerprint"] == by[3]["fingerprint"] and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert by[39]["near_edited"] > by[39]["near_next"] and by[93]["fingerprint"] and by[91]["fingerprint"] == ""
    assert syncmers.fingerprints(docs(spark, [])).count() == 0
    assert [r["near_next"] for r in syncmers.fingerprints(docs(spark, rows[:1])).collect()] == [1.0]


def brute_anchors(text):
    """Anchors of a text as (place, run), with the operator's order of inner runs."""
    t, k, s = text, syncmers.K, syncmers.S
    out = []
    for i in range(len(t) - k + 1):
        inner = [RANK[t[i + j : i + j + s]] for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, t[i : i + k]))
    return out or ([(0, t)] if t else [])


RANK: dict[str, int] = {}


def brute_links(found):
    return {(found[0][1],)} if len(found) == 1 else {(a[1], b[1], b[0] - a[0]) for a, b in zip(found, found[1:])}


def test_fingerprints_match_brute_force(spark):
    """The registered contract's columns, anchor by anchor, ties and long ids included."""
    rng = random.Random(4)
    texts = [" ".join(words(i, rng.randrange(1, 40))).upper() if i % 3 else rng.choice(["", " ", "a", "ab \n", "日本語の文章です。" * 3, "x" * 50, "\u0085 q \u2028", " lead and trail\t\t", "🙂🙂 b"]) for i in range(60)]
    ids = [-(2**63), 2**63 - 1, *range(5, 40), *[7] * 12, *[None] * 11]
    rows = list(zip(ids, texts))
    runs = set()
    for t in [t or "" for t in texts] + [" "]:
        runs |= {t[i : i + syncmers.S] for i in range(len(t))}
    every = sorted({a + b for r in runs for a in r for q in runs for b in q} | runs)
    hashed = spark.createDataFrame([(r,) for r in every if len(r) == syncmers.S], "r string").select("r", F.xxhash64(F.substring("r", 1, 1), F.substring("r", 2, 1)).alias("h")).collect()
    RANK.update((x["r"], x["h"]) for x in hashed)
    tie = {x["text"]: x["h"] for x in spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.shiftrightunsigned(F.xxhash64("text"), 1).alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), tie[r[1]], r[1]))
    near = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    want, edits = [], set()
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        edits.add((edited,))
        a, e, n = (brute_anchors(x) for x in (t, edited, nxt))
        own, ed, nx = (brute_links(x) if x else set() for x in (a, e, n))
        want.append((str(d), len(t), hashlib.sha256(edited.encode()).hexdigest(), len(a), len(e), round(near(own, ed), 9), round(near(own, nx), 9)))
    count = lambda f: f.count(".") + 1 if f else 0
    for bucket_rows in (3, 50_000):
        got = syncmers.fingerprints(docs(spark, rows), bucket_rows=bucket_rows).collect()
        have = [(str(r["doc_id"]), r["n_chars"], r["edited_sha256"], count(r["fingerprint"]), count(r["edited_fingerprint"]), round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got]
        assert sorted(have) == sorted(want)
    # the fingerprint of an edited text is that of the same text as a document
    whole = spark.createDataFrame(sorted(edits), "text string").select(F.sha2(F.col("text").cast("binary"), 256).alias("h"), syncmers.fingerprint(syncmers.anchors(F.col("text"))).alias("f"))
    alone = {r["h"]: r["f"] for r in whole.collect()}
    assert all(alone[r["edited_sha256"]] == r["edited_fingerprint"] for r in got)


def test_syncmers_are_context_free(spark):
    inner = " ".join(words(1, 40))
    df = spark.createDataFrame([(0, inner), (1, " ".join(words(2, 15)) + " " + inner + " " + " ".join(words(4, 15)))], "id int, text string").withColumn("anchors", syncmers.anchors(F.col("text")))
    a, b = (r["anchors"] for r in df.orderBy("id").collect())
    runs = [{x & (2**syncmers.HASH_BITS - 1) for x in y} for y in (a, b)]
    assert len(a) >= 4 and runs[0] <= runs[1]
    places = syncmers.match_positions(df.filter("id = 0").select("id", "anchors"), df.filter("id = 1").select("id", "anchors")).orderBy("at_l").collect()
    assert len({r["at_r"] - r["at_l"] for r in places}) == 1


def test_short_and_unspaced_texts_share_anchors(spark):
    unspaced = "".join(chr(0x4E00 + random.Random(1).randrange(2000) + i * 7) for i in range(60))
    rows = [(0, "seven quite short words stand right here"), (1, "x" * 3 + "".join(random.Random(2).choice("abcdefgh") for _ in range(60))), (2, unspaced), (3, "Other  things\tare said in this last line")]
    got = {r["doc_id"]: r for r in syncmers.fingerprints(docs(spark, rows)).collect()}
    assert all(got[i]["near_edited"] > 0 and got[i]["fingerprint"].count(".") >= 3 for i in range(4))


def brute_hit(item, text):
    need = min(12, len(item))
    for shift in range(-len(item), len(text)):
        same = [0 <= i + shift < len(text) and item[i] == text[i + shift] for i in range(len(item))]
        for a in range(len(item)):
            for b in range(a + need, len(item) + 1):
                if same[a] and same[b - 1] and sum(same[a:b]) >= 0.8 * (b - a) - 1e-9:
                    return True
    return False


def test_contamination_matches_brute_force(spark):
    rng = random.Random(8)
    items = [words(1000 + i, rng.choice([2, 6, 14, 30]), 5000) for i in range(8)]
    rows = []
    for i in range(60):
        w, item = words(i, rng.choice([0, 5, 40]), 5000), list(rng.choice(items))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            item[rng.randrange(len(item))] = "zz"
        if i % 3:
            at = rng.randrange(len(w) + 1)
            w[at:at] = item[: rng.choice([len(item), 13, 9])]
        rows.append((i, " ".join(w), "en", "s"))
    tests = spark.createDataFrame([(i, " ".join(w), 1) for i, w in enumerate(items)] + [(None, "x", 1), (98, None, 1), (99, " ", 1), (0, " ".join(items[0]), 1)], "item_id long, text string, words int")
    d = docs(spark, rows + ODD)
    got = {r["doc_id"]: set(r["item_ids"]) for r in decontamination.contaminated(d, tests).collect()}
    want = {}
    for i, t, *_ in rows:
        if hit := {k for k, item in enumerate(items) if brute_hit(item, t.split())}:
            want[i] = hit
    assert got == want
    kept = [r["doc_id"] for r in decontamination.clean(d, tests).collect()]
    assert Counter(kept) == Counter(r[0] for r in rows + ODD if r[0] not in want)
    assert decontamination.contaminated(d, tests.limit(0)).count() == 0


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    items = [words(1000 + i, 20, 5000) for i in range(4)]
    tests = spark.createDataFrame([(i % 3, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    both = " ".join([*items[0], *words(1, 9), *items[3], *items[1]])
    d = docs(spark, [(1, both, "en", "s"), (1, both, "en", "s"), (None, " ".join(items[2]), "en", "s"), (None, both, "en", "s"), *ODD])
    whole = sorted(map(str, decontamination.contaminated(d, tests, keep=("source",)).collect()))
    monkeypatch.setattr(decontamination, "BROADCAST_SEEDS", 1)
    assert sorted(map(str, decontamination.contaminated(d, tests, keep=("source",)).collect())) == whole and len(whole) == 4
