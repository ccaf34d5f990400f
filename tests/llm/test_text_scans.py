"""Licence scan, importance resampling and token alignment against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from graphloom.llm import alignment, importance, licences

SCHEMA = "doc_id long, text string, lang string, source string, w string, found long, row long, score long"
ODD = [
    None, "", " \n\t", "one", "CC BY", "cc-by cc by 4.0", "MIT License", "(the) MIT\n# License, mit license", "gnu general public license version 3",
    "Licensed under the Apache License, Version 2.0 (the license)", "under the terms of the GNU GPL v2", "gnu general public licenseé", "日本語 mit license テスト 🙂",
    "SPDX-License-Identifier: GPL-3.0-or-later", "permission is hereby granted free of charge to any person obtaining a copy", "apache license " * 300,
    "this is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published, either version 3",
    "word " * 3000 + "x" * 5000 + " CC BY-SA 4.0. All rights reserved", "apache license mit license cc by", "İ A\u0000b", "mit-0 public domain no",
]


def docs(spark, texts):
    return spark.createDataFrame([(i if i % 7 != 5 else None, t, None, None, "w", 1, 2, 3) for i, t in enumerate(texts)], SCHEMA)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


# --- licences ------------------------------------------------------------


def plain_scan(text):
    w = words(text)
    found = []
    for i in range(len(w)):
        window = " ".join(w[i : i + licences.SPAN])
        for k, r in enumerate(licences.rules()):
            if m := re.match(r.pattern, window):
                found.append((i, i + len(m[0].split()) - 1, r.priority, k, r.label))
    covers = lambda e, d: e != d and e[0] <= d[0] and e[1] >= d[1] and e[2] >= d[2] and (e[:3] != d[:3] or e[3] < d[3])
    stand = [d for d in found if not any(covers(e, d) for e in found)]
    base = [(i, label) for p, label in licences.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts, own = [i for i, _ in base], {label for _, label in base}
    return len(w), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)), ",".join(sorted(own | {d[4] for d in stand})), max((licences.CONFIDENCE[d[2]] for d in stand), default=0.0)


def test_licences_match_plain_rules(spark):
    rng = random.Random(5)
    pool = [w for t in ODD if t for w in t.split()[:20]] + "the gnu gpl version 2 0 creative commons attribution share alike bsd 3 clause license under".split()
    texts = ODD + [" ".join(rng.choice(pool) for _ in range(60)) for _ in range(25)]
    got = licences.scan(docs(spark, texts)).collect()
    assert len(got) == len(texts)
    for r, t in zip(got, texts):
        want = plain_scan(t)
        assert tuple(r)[1:] == want, t


def test_rules_start_with_their_keyword():
    rules = licences.rules()
    assert len(rules) > 300
    for r in rules:
        literal = re.sub(r"\(\?: \|\$\)$", "", r.pattern)
        assert re.match(r"[a-z0-9]+$", r.keyword) and r.keyword in literal
    # every licence is found by its plain name
    for label, name, _ in licences.NAMES:
        sample = re.sub(r" \?", " ", re.sub(r"\(\?:[^()]*\)\?|\[cs\]", lambda m: "s" if m[0] == "[cs]" else "", name))
        while "(?:" in sample:
            sample = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)", r"\1", sample)
        assert label in plain_scan(sample)[5].split(","), (label, sample)


def test_more_specific_rules_suppress(spark):
    got = [r["labels"] for r in licences.scan(docs(spark, ["Licensed under the Apache License, Version 2.0.", "under GNU LGPL 2.1", "cc by sa 4.0"])).collect()]
    assert got == ["apache,apache-2.0", "lgpl-2.1", "cc-by,cc-by-sa-4.0"]


# --- importance ----------------------------------------------------------


def plain_resample(rows, target, max_n, buckets, percent, least, seed):
    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(f for _, x in rows for f in features(x)), Counter(f for x in target for f in features(x))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in range(buckets)]
    out = []
    for d, x in rows:
        f = features(x)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x))))
    ok = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    n = len(ok) * percent // 100
    ranked = [(*r[:4], k if k <= n else None) for k, r in enumerate(ok, 1)]
    return sorted(ranked + [(*r[:4], None) for r in out if r[4] < least], key=str)


@pytest.mark.parametrize("max_n", [1, 3])
def test_resampling_matches_plain_python(spark, max_n, monkeypatch):
    monkeypatch.setattr(importance, "COPIES", 4)
    rng = random.Random(7)
    pool = [f"w{i}" for i in range(40)] + ["É", "日本", "x" * 60, "Q9"]
    texts = ODD + [" ".join(rng.choice(pool) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    df = docs(spark, texts)
    same = [(3, "w1 w2 " * 20)] * 23
    df = df.union(spark.createDataFrame([(d, t, None, None, None, None, None, None) for d, t in same], SCHEMA))
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    target = [None, "", "w1 w2 w3 É", "w1 W1 w5"]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    got = importance.resample(df, t, max_n=max_n, buckets=97, percent=30, min_words=20, seed=2024).collect()
    assert sorted(map(tuple, got), key=str) == plain_resample(rows, target, max_n, 97, 30, 20, 2024)


def test_crc_of_long_and_many_texts():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab1, é🙂") for _ in range(rng.randrange(0, 200))) for _ in range(200)] + ["y" * 1000 + " z"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t.encode()) for t in texts])
    starts, lengths, of = importance.words(data, ends)
    crc = importance.word_crcs(data, starts, lengths)
    split = [words(t) for t in texts]
    for n, (c, where) in enumerate(importance.run_crcs(crc, lengths, of, 5, importance.Shift()), 1):
        assert list(zip(c.tolist(), where.tolist())) == [(zlib.crc32(" ".join(w[i : i + n]).encode()), k) for k, w in enumerate(split) for i in range(len(w) - n + 1)]


# --- alignment -----------------------------------------------------------

TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\n b  c", "Hello world, again", "tabs\t\tand  spaces   end  ", "▁ x", "<s> </s> <|endoftext|> <unk>", "日本語テスト 한국어", "🙂🙃 é̀ \u0000 ​",
    "x" * 3000, "word " * 2000, "don't we'll I'M 12345 1,000.50", "same text", "same text", "﻿bom   line", "a" * 17 + " " * 9 + "b",
]


def plain_alignment(texts, a, b):
    byte = alignment.byte_alphabet()
    spell = {i: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, i in a.get_vocab(with_added_tokens=True).items()}
    out, held = [], []
    for t in texts:
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        bx = [spell[i] for i in x]
        by = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not t or b"".join(bx) != (" " + t).encode() or b"".join(by) != (" " + t).encode():
            out.append((0, 0, 0, 0, ""))
            held.append(Counter())
            continue
        ends = lambda parts: np.cumsum([len(p) for p in parts]).tolist()
        ex, ey = ends(bx), ends(by)
        groups, i, j = [], 0, 0
        for e in sorted(set(ex) & set(ey)):
            k, m = i, j
            while i < len(ex) and ex[i] <= e:
                i += 1
            while j < len(ey) and ey[j] <= e:
                j += 1
            groups.append((x[k:i], y[m:j]))
        links = Counter((p, q) for g, h in groups for p in g for q in h)
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((len(x), len(y), len(groups), sum(links.values()), hashlib.sha256(text.encode()).hexdigest()))
        held.append(links)
    counts = Counter(p for links in held for p in links)
    most = {}
    for (p, _), n in counts.items():
        most[p] = max(n, most.get(p, 0))
    return [(*o[:4], sum(k for p, k in h.items() if counts[p] == most[p[0]]), sum(k * counts[p] for p, k in h.items()), o[4]) for o, h in zip(out, held)]


@pytest.fixture(scope="module")
def files():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")


def odd_texts():
    rng = random.Random(11)
    alphabet = "aab eth  \n\t.,;'9é日🙂 ▁<>|"
    return TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 120))) for _ in range(150)]


def test_tokens_of_segments_are_those_of_texts(files):
    both = alignment.Aligner(*files)
    texts = odd_texts()
    want = [(*w[:4], w[6]) for w in plain_alignment(texts, both.a, both.b)]
    assert [r[:5] for r in both.texts([t or "" for t in texts])] == want
    # segments that are known already, and large groups
    assert [r[:5] for r in both.texts([t or "" for t in texts])] == want


def test_alignment_matches_plain_python(spark, files, monkeypatch):
    both, texts = alignment.Aligner(*files), odd_texts()
    want = sorted(plain_alignment(texts, both.a, both.b))
    for hot in (1_000_000, 25, 1):
        got = alignment.align_documents(docs(spark, texts), *files, hot_pairs=hot).collect()
        assert sorted(tuple(r)[1:] for r in got) == want


def test_forgotten_segments_and_large_groups_change_nothing(files, monkeypatch):
    both, texts = alignment.Aligner(*files), [t or "" for t in odd_texts()]
    want = both.texts(texts)
    for limits in ({"DICTIONARY": 20}, {"KEPT_PAIRS": 30}, {"LISTED": 1}):
        other = alignment.Aligner(*files)
        for name, value in limits.items():
            monkeypatch.setattr(alignment, name, value)
        assert [r for t in texts for r in other.texts([t])] == want
        monkeypatch.undo()
