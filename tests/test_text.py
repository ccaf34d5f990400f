"""Text functions and retrieval."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import choice, retrieval


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("r")).first()["r"]


def test_redaction(spark):
    r = lambda v: one(spark, text.redact_secrets(F.col("t")), v)
    assert r(None) == "" and r("plain") == "plain"
    assert r("AKIA" + "A" * 16) == "[REDACTED_AWS_KEY]"
    assert r("password = 'longsecret1'") == "password='[REDACTED_SECRET]'"
    assert r("postgres://u:p@host/db") == "postgres://[USER]:[REDACTED_PASSWORD]@[HOST]/db"


def test_names(spark):
    assert one(spark, text.normalise_name(F.col("t")), "Order-Manager Service") == "order"
    assert one(spark, text.normalise_name(F.col("t")), "Service") == "service"
    assert one(spark, text.slug(F.col("t")), " Hello, World! ") == "hello-world"
    assert one(spark, text.identifier(F.col("t")), "9-a") == "_9_a"
    assert one(spark, text.token_cost(F.col("t")), "") == 0 and one(spark, text.token_cost(F.col("t")), "abcd") == 2


def test_hashed_vectors(spark):
    rows = [("a", "user authentication login session"), ("b", "user credentials login token authorize"), ("c", "rasterize shader mesh polygons"), ("e", "")]
    v = retrieval.hashed_vectors(spark.createDataFrame(rows, "id string, t string"), F.col("t"))
    d = {r["id"]: r["vector"] for r in retrieval.dense(v).collect()}
    assert "e" not in d and all(len(x) == 128 and math.isclose(sum(y * y for y in x), 1, abs_tol=1e-5) for x in d.values())
    dot = lambda a, b: sum(x * y for x, y in zip(d[a], d[b]))
    assert dot("a", "b") > 0.2 and dot("a", "c") < 0.1 and dot("a", "b") - dot("a", "c") > 0.15


def test_search_operators_and_fusion(spark):
    docs = spark.createDataFrame([("1", "login session token"), ("2", "render the shader"), ("3", "logging setup")], "id string, t string")
    found = lambda q: [r["id"] for r in retrieval.search(docs, ["t"], q).collect()]
    assert found("login") == ["1"] and sorted(found("log")) == ["1", "3"] and found('"log"') == []
    assert sorted(found("login OR shader")) == ["1", "2"] and found("log NOT setup") == ["1"] and found("login shader") == []
    assert found("") == []
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, rank int")
    b = spark.createDataFrame([("y", 1, 0.9)], "id string, rank int, score double")
    assert [(r["id"], r["source"]) for r in retrieval.fuse(a, b).collect()] == [("y", "hybrid"), ("x", "lexical")]


def test_submodular_pack_weighs_all_items(spark, tmp_path):
    from graphloom.plans import lookup

    rows = [(i, f"seed words number {i} stand here") for i in range(5)] + [(i, f"other{i} thing{i}") for i in range(5, 100)]
    rows[99] = (99, rows[0][1])
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert lookup.submodular_pack(spark, str(tmp_path)).first()["id"] == "99"


def test_submodular_is_near_the_optimum(spark):
    texts = ["alpha beta", "beta gamma delta", "gamma", "alpha delta epsilon"]
    c = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")
    s = spark.createDataFrame([("s", "alpha beta gamma", 1.0), ("t", "delta epsilon", 1.0)], "id string, text string, weight double")
    got = [r["id"] for r in choice.select_submodular(c, s, 8).collect()]
    words = lambda t: set(t.split())
    sim = lambda a, b: max(0.05, len(words(a) & words(b)) / len(words(a) | words(b))) * math.exp(-1.5)
    value = lambda pick: sum(math.log1p(sum(sim(texts[int(i)], q) for i in pick)) for q in ("alpha beta gamma", "delta epsilon"))
    cost = lambda pick: sum(max(1, math.ceil(len(texts[int(i)]) / 3.7)) for i in pick)
    best = max(value(p) for n in range(5) for p in itertools.combinations("0123", n) if cost(p) <= 8)
    assert cost(got) <= 8 and value(got) >= 0.632 * best


def plain_choice(candidates, seeds, budget):
    """The greedy cover, every gain from the whole value, step by step."""
    words = lambda t: set(t.lower().split())
    pull = {i: [max(0.05, len(words(t) & words(b)) / max(1, len(words(t) | words(b)))) * math.exp(-0.5 * d) for _, b, _ in seeds] for i, t, d in candidates}
    cost = {i: math.ceil(len(t) / 3.7) for i, t, _ in candidates}
    value = lambda pick: sum(w * math.log1p(sum(pull[i][j] for i in pick)) for j, (_, _, w) in enumerate(seeds))
    chosen, gains = [], []
    while fit := [i for i in pull if i not in chosen and sum(cost[c] for c in chosen) + cost[i] <= budget]:
        gain = {i: round(value([*chosen, i]) - value(chosen), 12) for i in fit}
        best = min(fit, key=lambda i: (-gain[i] / max(1, cost[i]), -gain[i], i))
        if gain[best] <= 1e-6:
            break
        chosen.append(best)
        gains.append(gain[best])
    alone = max((value([i]), i) for i in pull if cost[i] <= budget)
    return ([alone[1]], [alone[0]]) if alone[0] > sum(gains) + 1e-9 else (chosen, gains)


@pytest.mark.parametrize("budget,batch", [(60, 3), (25, 64)])
def test_submodular_both_ways_are_the_plain_greedy(spark, budget, batch):
    draw = random.Random(budget)
    say = lambda n: " ".join(f"w{min(draw.randrange(30), draw.randrange(30))}" for _ in range(n))
    c = [(f"c{i:02}", say(draw.randrange(1, 12)), float(draw.randrange(4))) for i in range(40)]
    c.append(("c99", c[7][1], c[7][2]))  # a tie
    s = [(f"s{i}", say(draw.randrange(2, 15)), draw.choice([0.5, 1.0, 3.0])) for i in range(12)]
    odd = [(None, "w1", 0.0), ("void", None, 0.0)]
    cs = spark.createDataFrame(c + odd, "id string, text string, distance double")
    ss = spark.createDataFrame(s, "id string, text string, weight double")
    ids, gains = plain_choice(c, s, budget)
    for pairs in (10**6, 0):
        got = choice.select_submodular(cs, ss, budget, driver_pairs=pairs, batch=batch).orderBy("place").collect()
        assert [r["id"] for r in got] == ids
        assert [r["gain"] for r in got] == pytest.approx(gains, abs=1e-9)


def test_submodular_of_nothing(spark):
    cs = spark.createDataFrame([], "id string, text string")
    ss = spark.createDataFrame([("s", "w", None)], "id string, text string, weight double")
    for pairs in (10, -1):
        assert choice.select_submodular(cs, ss, 9, driver_pairs=pairs).count() == 0
        assert choice.select_submodular(ss.select("id", "text"), ss.limit(0), 9, driver_pairs=pairs).count() == 0
        assert [r["id"] for r in choice.select_submodular(ss.select("id", "text"), ss, 9, driver_pairs=pairs).collect()] == ["s"]


def test_nearest_and_budget(spark):
    names = spark.createDataFrame([("process_batch",), ("User",)], "name string")
    got = retrieval.nearest_names(spark.createDataFrame([("proces_batch",)], "name string"), names).first()
    assert (got["nearest"], got["distance"]) == ("process_batch", 1)
    rows = spark.createDataFrame([("a", 3.0, 5), ("b", 2.0, 50), ("c", 1.0, 1)], "id string, score double, cost int")
    assert [r["id"] for r in retrieval.budget_prefix(rows, 20).collect()] == ["a"]
    assert one(spark, text.jaccard(text.word_set(F.col("t")), F.array(F.lit("a"))), "A b") == pytest.approx(0.5)


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left = [i]
        for j, y in enumerate(b, 1):
            left.append(min(left[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = left
    return row[-1]


def test_nearest_names_against_all_pairs(spark):
    """Short and long names, near and far ones, ties, empty and null ones."""
    rand = random.Random(5)
    word = lambda n: "".join(rand.choice("abcdefghij_") for _ in range(n))
    known = [word(rand.randint(1, 24)) for _ in range(150)] + [None, "same", "samf", "q" * 200]
    wanted = [word(rand.randint(0, 24)) for _ in range(60)] + [None, "same", "samg", "", "z" * 60, "q" * 150]
    for name in known[:60]:
        letters = list(name)
        for _ in range(rand.randint(1, 8)):
            at = rand.randrange(len(letters) + 1)
            letters[at : at + rand.randint(0, 1)] = rand.choice(("x", "y", "", "a"))
        wanted.append("".join(letters))
    frame = lambda names: spark.createDataFrame([(n,) for n in names], "name string")
    got = {r["name"]: (r["nearest"], r["distance"]) for r in retrieval.nearest_names(frame(wanted), frame(known)).collect()}
    best = {q: min((_edits(q, k), k) for k in known if k is not None) for q in wanted if q is not None}
    assert got == {q: (k, n) for q, (n, k) in best.items() if n <= max(10, int(len(q) * 0.8))}
    assert retrieval.nearest_names(frame(wanted), frame([])).count() == 0 and retrieval.nearest_names(frame([]), frame(known)).count() == 0


def test_choice_by_windows(spark, monkeypatch):
    """Many steps need few tables, and windows of any size choose what the
    plain greedy and the rounds over tables choose."""
    rand = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rand.choices(words, k=n))
    c = spark.createDataFrame([(f"c{i:02d}", text(rand.randint(1, 6)), float(rand.randint(0, 2))) for i in range(40)], "id string, text string, distance double")
    s = spark.createDataFrame([(f"s{i}", text(5), 1.0 + i) for i in range(4)], "id string, text string, weight double")
    tables, real = [], choice.cut
    monkeypatch.setattr(choice, "cut", lambda df, name: tables.append(name) or real(df, name))
    chosen = lambda **k: [tuple(r)[:3] + (round(r["gain"], 9),) for r in choice.select_submodular(c, s, 40, **k).orderBy("place").collect()]
    whole = chosen(driver_pairs=0)
    assert len(whole) >= 5 and len(tables) == 4
    assert whole == chosen() == chosen(driver_pairs=0, batch=2, window=12) == chosen(driver_pairs=0, window=0)


def test_near_names_of_common_words_meet_by_forms(spark, monkeypatch):
    """Names within two edits are found without their pairs of letters, which
    all names of the same words share."""

    def pairs(*_):
        raise AssertionError("pairs of letters")

    monkeypatch.setattr(retrieval, "_pairs_of_letters", pairs)
    known = [f"hot gear MEDIUM {i}" for i in range(0, 600, 3)]
    wanted = [k[:3] + "x" + k[4:-1] for k in known] + ["hot gear MEDIUM 1x", "q" * 2, "hot gea MEDIUM 300"]
    known.append("q")
    frame = lambda names: spark.createDataFrame([(n,) for n in names], "name string")
    got = {r["name"]: (r["nearest"], r["distance"]) for r in retrieval.nearest_names(frame(wanted), frame(known)).collect()}
    best = {q: min((_edits(q, k), k) for k in known) for q in wanted}
    assert got == {q: (k, n) for q, (n, k) in best.items()}


def test_hashed_entries_move_texts_only(spark):
    """Terms are counted where they are made: one exchange, of texts, where
    three moved terms; repeated ids, nulls and stop words as before."""
    import hashlib
    import math

    from graphloom.operators import retrieval
    from graphloom.functions.text import terms

    rows = [("a", "graph node"), ("a", "graph"), ("b", "the of"), ("c", None), (None, "node"), ("d", "x" * 300 + " nodeGraph é")]
    df = spark.createDataFrame(rows, "id string, t string")
    found = retrieval.hashed_entries(df, F.col("t"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    bags = {}
    for r in df.select("id", terms(F.col("t")).alias("t")).collect():
        for x in r["t"]:
            bags.setdefault(r["id"], {}).setdefault(x["term"], []).append(x["w"])
    want = {}
    for i, bag in bags.items():
        raw = {}
        for term, w in bag.items():
            h = hashlib.md5(term.encode()).digest()
            raw[h[0] % 128] = raw.get(h[0] % 128, 0.0) + (1 if h[4] % 2 == 0 else -1) * (1 + math.log(sum(w)))
        norm = math.sqrt(sum(x * x for x in raw.values()))
        want[i] = {b: round(x / norm, 9) for b, x in raw.items()}
    assert {r["id"]: {e["bucket"]: round(e["x"], 9) for e in r["entries"]} for r in found.collect()} == want
    q = retrieval.hashed_vectors(df.filter("id = 'a'"), F.col("t"))
    assert {r["id"]: round(r["s"], 6) for r in retrieval.products(found, q).collect()}["a"] == 1.0
    assert retrieval.products(found, q.limit(0)).count() == 0


def test_nearest_names_of_the_same_words_make_few_forms(spark, monkeypatch):
    """Of names that share their words, only short tails have forms: less than a
    quarter of those of whole names.  Edits are at both ends and anywhere."""
    rng = random.Random(11)
    known = sorted({f"{a} {b} {rng.randrange(10 ** rng.randrange(4, 7))}" for a in ("large ring", "hot bolt", "old bolt", "cold plate") for b in ("STANDARD", "ECONOMY") for _ in range(25)} | {"a", "ab", "12345", "hot 12"})
    wanted = {k[:3] + "x" + k[4:-1] for k in known}
    for k in known[::40]:
        i, j = rng.randrange(len(k)), rng.randrange(len(k))
        wanted |= {k[:i] + "1" + k[i + 1 :], k[:j] + k[j + 1 :], k[:i] + " " + k[i:]}
    wanted = sorted(wanted | {"abc", "b", "12", "1234567", "hot 1"})
    rows = []
    for maker in ("_shortened", "_keyed"):
        if made := getattr(retrieval, maker, None):
            monkeypatch.setattr(retrieval, maker, lambda *a, made=made: (lambda df: (rows.append(df.count()), df)[1])(made(*a)))
    frame = lambda names: spark.createDataFrame([(n,) for n in names], "name string")
    got = {r["name"]: (r["nearest"], r["distance"]) for r in retrieval.nearest_names(frame(wanted), frame(known)).collect()}
    best = {n: min((_edits(n, k), k) for k in known) for n in wanted}
    assert got == {n: (k, d) for n, (d, k) in best.items() if d <= max(10, int(len(n) * 0.8))}
    assert sum(rows) <= 75 * (len(known) + len(wanted)), (rows, len(known) + len(wanted))
