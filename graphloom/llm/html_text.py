"""Main text of HTML pages by the maximum-scoring subsequence.

A page is a sequence of words and tags.  A word scores positive or negative by
the elements it stands in, a tag scores negative; the weights are log-odds
learned from labelled pages - those that mark their main text with exactly one
``article`` or ``main`` element - on top of priors for elements and class
names of known meaning.  One linear scan finds the contiguous region of the
highest sum: the main text.

Inside it what HTML itself sets apart (scripts, forms, navigation) is left out,
and every element whose names weigh SHUT_WEIGHT or less: names that the prior
calls adverts, comments and the like while the pages don't prove it wrong, and
any other name that stands for nothing but text outside the article.  Elements
that hold the article or the page's best-scoring text are never left out.

A page is read once, in time proportional to its length: open elements are
counted by name, and the score of what is around is kept up as a sum.
"""

from __future__ import annotations

import html as htmllib
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_arrow, materialise, sample_below, utf8

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s\"'>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

# Fixed values of HTML: elements by what they mean to a text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe title textarea svg math xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Never main text, wherever they stand.
OUTSIDE = frozenset("head nav footer aside form button select option input label object dialog menu canvas audio video map".split())
#: Parts of class, id and role names of what is not main text.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login sidebar widget widgets related recommended recommendations share sharing social breadcrumb breadcrumbs pagination pager menu menus nav navbar navigation navigational footer masthead comment comments commentlist reply replies respond disqus discussion copyright disclaimer toolbar search searchbox form complementary contentinfo hidden tags".split()
)
#: Elements that say something about the words in them.
TELLING = frozenset("article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th a header footer nav aside form blockquote pre figure figcaption center address".split())
#: Prior log-odds of being main text, before any page is seen.
PRIOR = {"in:article": 2.0, "in:main": 2.0, "in:p": 1.0, "in:h1": 1.5, "in:h2": 1.0, "in:h3": 1.0, "in:blockquote": 0.5, "in:pre": 0.5, "in:header": -1.0, "in:a": -1.0, "in:li": -0.3, "in:address": -1.0}
PRIOR |= {f"name:{x}": -4.0 for x in NOISE}
BASE, MOST, STRENGTH = 0.5, 4.0, 20.0
#: Names of this weight or less leave their element out; what an element left
#: out takes from the score of its text when the best one is looked for.
SHUT_WEIGHT, SHUT = -3.0, 0.1
#: Weights are sums of this part of one, so they add up exactly in any order.
UNIT = 1 / 1024


@dataclass
class Run:
    """Text between two tags: raw text, its words and their score, whether an
    element that is left out holds it, its block, the tags before it, whether
    it is in an article or main, the innermost such element (0 for none), and
    how many there are, less those around the article."""

    text: str
    words: int
    score: float
    outside: bool
    block: int
    tags: list[str]
    labelled: bool
    shut: int = 0
    inner: int = 0


class _Reader:
    """Runs of a page, number of its article and main elements, and per feature
    the words inside and outside the main text.

    Broken markup is taken as browsers would, roughly: an end tag closes what
    is open up to its start tag and is nothing without one; block elements end
    an open paragraph; comments, raw elements and tags that never end reach to
    the end of the page.  The elements numbered in ``opened`` leave nothing out.
    """

    def __init__(self, page: str, weights: dict[str, float], opened: frozenset[int] = frozenset()):
        self.weights, self.opened = weights, opened
        self.runs: list[Run] = []
        self.stack: list[tuple[str, list[str], bool, bool, bool]] = []
        self.names: dict[str, int] = {}
        #: Numbers of the elements around that are left out, and of each the one around it.
        self.shut: list[int] = []
        self.around: dict[int, int] = {}
        self.number = self.block = self.marks = self.above = 0
        self.tags: list[str] = []
        #: Outside of an article and in it: open features, sum of their weights, words so far.
        self.worlds = [[{}, 0, [0, 0]], [{}, 0, [0, 0]]]
        self.world = 0
        self.counts: dict[str, list[int]] = {}
        self._read(page)
        while self.stack:
            self._pop()

    def _gain(self, feature: str) -> int:
        """A feature's weight in units; names that leave out do nothing else."""
        weight = self.weights.get(feature, 0.0)
        return 0 if weight <= SHUT_WEIGHT and feature.startswith("name:") else round(weight / UNIT)

    def _enter(self, features: list[str]) -> None:
        open_, total, words = self.worlds[self.world]
        for f in features:
            at = open_.get(f)
            if at is None:
                open_[f] = [1, *words]
                total += self._gain(f)
            else:
                at[0] += 1
        self.worlds[self.world][1] = total

    def _leave(self, features: list[str]) -> None:
        open_, total, words = self.worlds[self.world]
        for f in features:
            at = open_[f]
            at[0] -= 1
            if not at[0]:
                del open_[f]
                total -= self._gain(f)
                count = self.counts.setdefault(f, [0, 0])
                count[0], count[1] = count[0] + words[0] - at[1], count[1] + words[1] - at[2]
        self.worlds[self.world][1] = total

    def _pop(self) -> str:
        name, features, shut, first, _ = self.stack.pop()
        self.names[name] -= 1
        self._leave(features)
        if shut:
            self.shut.pop()
        if first:
            self.world = self.above = 0
        return name

    def _text(self, raw: str) -> None:
        if raw:
            plain = htmllib.unescape(raw)
            words, labelled, outside = len(plain.split()), self.world == 1, bool(self.shut)
            self.runs.append(Run(plain, words, BASE + self.worlds[self.world][1] * UNIT, outside, self.block, self.tags, labelled, self.shut[-1] if self.shut else 0, len(self.shut) - self.above))
            side = 0 if labelled and not outside else 1
            self.worlds[self.world][2][side] += words
            for t in self.tags:
                self.counts.setdefault(f"tag:{t}", [0, 0])[side] += 1
            self.tags = []

    def _read(self, page: str) -> None:
        at, end = 0, len(page)
        while at < end:
            m = _TAG.search(page, at)
            if not m:
                self._text(page[at:])
                break
            self._text(page[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            # tags of what is left out do not count against the text around it
            was = bool(self.shut)
            if name not in INLINE:
                self.block += 1
            if m[1]:
                if not self.names.get(name):
                    continue
                while self._pop() != name:
                    pass
            elif name in RAW:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = close.end() if close else end
                continue
            elif name in VOID or m[3].endswith("/") and name not in TELLING and name not in INLINE:
                if not was:
                    self.tags.append(name)
                continue
            else:
                self._start(name, m[3])
            if not (was or self.shut):
                self.tags.append(name)

    def _start(self, name: str, attributes: str) -> None:
        if name not in INLINE and name in TELLING and self.names.get("p"):
            while self._pop() != "p":
                pass
        if name == "li" and self.stack and self.stack[-1][0] == "li":
            self._pop()
        features, shut = ([f"in:{name}"] if name in TELLING else []), name in OUTSIDE
        given: dict[str, str] = {}
        for a in _ATTRIBUTE.finditer(attributes):
            given.setdefault(a[1].lower(), a[2] or a[3] or a[4] or "")
        shut = shut or given.get("hidden", "false").lower() != "false"
        if name not in ("html", "body", "article", "main"):
            own = sorted({f"name:{x.lower()}" for key in ("class", "id", "role") for x in _PART.findall(given.get(key, ""))})
            features += own
            shut = shut or any(self.weights.get(f, 0.0) <= SHUT_WEIGHT for f in own)
        mark = name in ("article", "main")
        self.marks += mark
        first = mark and self.world == 0
        self.number += 1
        # headers of the page; an article's own belong to it
        if not self.world and not mark and (name == "header" or "name:header" in features):
            shut = True
        if name in ("html", "body"):
            return
        shut = shut and self.number not in self.opened
        if shut:
            self.around[self.number] = self.shut[-1] if self.shut else 0
            self.shut.append(self.number)
        if first:
            # what is around the article says nothing of the words in it, nor
            # does its own name count as one inside it
            self.world, self.above = 1, len(self.shut)
        self._enter(features)
        self.names[name] = self.names.get(name, 0) + 1
        self.stack.append((name, features, shut, first, mark))


def parse(page: str, weights: dict[str, float] = PRIOR, opened: frozenset[int] = frozenset()) -> tuple[list[Run], int]:
    """Runs of a page in order, and its number of article and main elements."""
    reader = _Reader(page, weights, opened)
    return reader.runs, reader.marks


@dataclass
class Model:
    """Weights of a word's surroundings and of tags."""

    words: dict[str, float] = field(default_factory=lambda: dict(PRIOR))
    tags: dict[str, float] = field(default_factory=dict)

    def word(self, run: Run) -> float:
        return 0.0 if run.outside else max(-MOST, min(MOST, run.score))

    def read(self, page: str) -> _Reader:
        """The page with those elements opened that hold the article or, where
        none is marked, the best-scoring text.

        The texts under the same element that is left out score together; every
        such element inside the article, or on a page without any, lowers the score.
        """
        reader = _Reader(page, self.words)
        if not any(r.outside for r in reader.runs):
            return reader
        pool = [r for r in reader.runs if r.labelled and r.words] or reader.runs
        scores: dict[int, float] = {}
        for r in pool:
            scores[r.shut] = scores.get(r.shut, 0.0) + r.words * max(0.0, min(MOST, r.score)) * SHUT**r.inner
        best = max(scores, key=scores.__getitem__)
        opened, at = set(), best
        while at:
            opened.add(at)
            at = reader.around[at]
        return _Reader(page, self.words, frozenset(opened)) if best and scores[best] > 0 else reader

    def tag(self, name: str) -> float:
        return -self.tags.get(name, 0.1 if name in INLINE else 0.3)

    def region(self, runs: list[Run]) -> tuple[int, int]:
        """First and last + 1 run of the contiguous region of the highest sum.

        One scan: a region starts anew where the sum so far is not positive.
        Of equal sums the first region counts; (0, 0) if none is positive.
        """
        best, total, start, found = 0.0, 0.0, 0, (0, 0)
        for i, run in enumerate(runs):
            lead = sum(map(self.tag, run.tags)) if i else 0.0
            total += lead
            if total <= 0:
                total, start = 0.0, i
            total += run.words * self.word(run)
            if total > best:
                best, found = total, (start, i + 1)
        return found

    def extract(self, page: str) -> str:
        """Main text: blocks in order, white space inside and between them one space."""
        runs = self.read(page).runs
        a, b = self.region(runs)
        out: list[str] = []
        block = None
        for run in runs[a:b]:
            if run.outside:
                continue
            if run.block != block:
                out.append("\n")
                block = run.block
            out.append(run.text)
        return " ".join("".join(out).split())


def learn(pages: list[str]) -> dict[str, tuple[int, int]]:
    """Per feature the number of words (``in:``, ``name:``) or tags (``tag:``)
    inside and outside the main text of labelled pages."""
    counts: dict[str, list[int]] = {}
    for page in pages:
        reader = Model().read(page)
        if reader.marks == 1:
            for f, (inside, outside) in reader.counts.items():
                count = counts.setdefault(f, [0, 0])
                count[0], count[1] = count[0] + inside, count[1] + outside
    return {k: (v[0], v[1]) for k, v in counts.items()}


def weigh(counts: dict[str, tuple[int, int]]) -> Model:
    """Weights from counts; priors count as much as STRENGTH words."""
    model = Model()
    inside = sum(v[0] for k, v in counts.items() if k.startswith("tag:")) or 1
    outside = sum(v[1] for k, v in counts.items() if k.startswith("tag:")) or 1
    for name, (a, b) in counts.items():
        if name.startswith("tag:"):
            odds = math.log((b + 1) / (outside + 2)) - math.log((a + 1) / (inside + 2))
            model.tags[name[4:]] = min(MOST, max(0.1, odds))
        else:
            prior = 1 / (1 + math.exp(-PRIOR.get(name, 0.0)))
            odds = math.log((a + STRENGTH * prior) / (b + STRENGTH * (1 - prior)))
            model.words[name] = max(-MOST, min(MOST, odds))
    return model


def fit(pages: DataFrame, html: str = "html", sample: int = 2000) -> Model:
    """Weights from a bounded sample: about ``sample`` pages in expectation
    (all, where there are fewer), chosen by their hash.  Without a labelled
    page the priors stand alone."""
    rows = pages.select(F.col(html).cast("string").alias("html")).filter("html IS NOT NULL")
    total = rows.count()
    chosen = rows.filter(sample_below(F.col("html"), sample / max(total, 1)))

    def run(batches):
        for batch in batches:
            found = sorted(learn([t.decode("utf-8", "replace") for t in utf8(batch.column("html"))]).items())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([v[0] for _, v in found], pa.int64()), pa.array([v[1] for _, v in found], pa.int64())], names=["f", "inside", "outside"])

    summed = map_arrow(chosen, run, "f string, inside long, outside long").groupBy("f").agg(F.sum("inside").alias("a"), F.sum("outside").alias("b"))
    return weigh({r["f"]: (r["a"], r["b"]) for r in materialise(summed, "html-weights").collect()})


def extract(pages: DataFrame, model: Model, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep columns, then text and n_chars (code points) for every row.

    Whole pages are read.  Null and empty pages, and pages without a region
    of positive score, have an empty text.  Rows repeat as they come; other
    columns are left behind.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)  # features of a bounded sample
    rows = pages.select(*keep, F.col(html).cast("string").alias("__html"))

    def run(batches):
        for batch in batches:
            texts = [shared.value.extract(t.decode("utf-8", "replace")) for t in utf8(batch.column("__html"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keep, "text", "n_chars"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return map_arrow(rows, run, kinds + "text string, n_chars long")
