"""Operator 13: main text of web pages by gradient-boosted trees over DOM nodes, decoded top down.

A page becomes a tree of block elements and runs of inline text (``dom``). Boosted trees
give each node the probability that it holds main text, from its subtree's density, its
depth, its siblings and what tags and attributes say of it and of its ancestors. A
dynamic programme then takes the most probable choice in which what lies under a node
without main text has none, and a node with main text has a descendant run with it.

Learning needs no labels: of a sample of ``SAMPLE`` pages (``PAGE_BYTES`` at most each, the
first by a hash) those that mark their article are examples as they are, and blocks of
all of them are set anew in ``LAYOUTS`` layouts a page, whose menus, notices, side bars,
forms and comments are known because they were put there. Every page of the table, whole,
is then extracted.

A block's references are decoded, white space (no-break spaces too) becomes one blank, and
blocks are joined by one newline; ``<br>`` is white space of its block.

Cases: null and empty pages and pages without text give an empty text; unclosed elements,
stray end tags, broken comments and tags are read as browsers do, in short; equal pages
give equal texts; repeated rows count each; a table in which no page has a paragraph
leaves only what tags say (no menus, headers, footers, side bars, forms); an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import zlib
from collections.abc import Iterator
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blobs, hashed_sample, ship, slices, table, task, with_columns
from .dom import BITS, GROUPS, MAIN, NUMBERS, OFF, TAGS, Tree, features

SAMPLE, PAGE_BYTES, LAYOUTS = 160, 100_000, 3
ROUNDS, DEPTH, RATE, PENALTY, LEAST, EDGES = 40, 4, 0.3, 2.0, 4.0, 16
#: Bytes of pages that one vectorised step takes.
STEP_BYTES = 1_000_000


class Boosted:
    """Trees of logistic gradient boosting; each is complete, a node's children at 2i + 1 and 2i + 2."""

    def __init__(self) -> None:
        self.first, self.trees = 0.0, []

    @staticmethod
    def _edges(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Candidate splits: features and the values that go left."""
        feature, edge = [], []
        for f in range(x.shape[1]):
            values = np.unique(np.quantile(x[:, f], np.linspace(0, 1, EDGES + 1)[:-1], method="lower"))
            values = values[values < x[:, f].max()]
            feature += [f] * len(values)
            edge += values.tolist()
        return np.array(feature), np.array(edge, np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.first = float(np.log(share / (1 - share)))
        feature, edge = self._edges(x)
        right = (x[:, feature] > edge).astype(np.float32)
        score = np.full(len(y), self.first)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node, leaves = np.zeros(len(y), int), 1
            splits: list[tuple[int, float]] = []
            for _ in range(DEPTH):
                where = np.zeros((len(y), leaves), np.float32)
                where[np.arange(len(y)), node] = 1
                total_g, total_h = (where * g[:, None]).sum(0), (where * h[:, None]).sum(0)
                g_right, h_right = right.T @ (where * g[:, None].astype(np.float32)), right.T @ (where * h[:, None].astype(np.float32))
                g_left, h_left = total_g - g_right, total_h - h_right
                gain = g_left**2 / (h_left + PENALTY) + g_right**2 / (h_right + PENALTY)
                gain[(h_left < LEAST) | (h_right < LEAST)] = -1
                best = gain.argmax(0)
                useful = gain[best, np.arange(leaves)] > total_g**2 / (total_h + PENALTY) + 1e-6
                splits += [(int(feature[b]), float(edge[b])) if u else (0, float("inf")) for b, u in zip(best, useful, strict=True)]
                goes = np.where(useful[node], right[np.arange(len(y)), best[node]], 0).astype(int)
                node, leaves = 2 * node + goes, 2 * leaves
            value = RATE * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + PENALTY)
            score += value[node]
            self.trees.append((np.array([f for f, _ in splits]), np.array([e for _, e in splits], np.float32), value))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        score, rows, x = np.full(len(x), self.first), np.arange(len(x)) * x.shape[1], x.ravel()
        for feature, edge, value in self.trees:
            node = np.zeros(len(rows), int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows + feature[node]] > edge[node])
            score += value[node - len(feature)]
        return score


def decode(tree: Tree, odds: np.ndarray) -> list[bool]:
    """Which nodes hold main text: the most probable choice without contradictions between ancestors and descendants."""
    n = len(tree.parent)
    yes, no = (-np.logaddexp(0, -odds)).tolist(), (-np.logaddexp(0, odds)).tolist()
    parent, text = tree.parent, tree.text
    none, some, gain, least = [0.0] * n, [0.0] * n, [-np.inf] * n, [-1] * n  # of the children: all without; the better of both; the best gain and whose
    better = [False] * n
    for i in range(n - 1, -1, -1):
        without = no[i] + none[i]
        if text[i] is not None:
            held = yes[i]
        elif least[i] < 0:
            held = -np.inf  # no run below
        else:
            held = yes[i] + some[i] + min(0.0, gain[i])
        better[i] = held > without
        p = parent[i]
        if p >= 0 and (text[i] is not None or least[i] >= 0):
            none[p] += without
            some[p] += max(held, without)
            if held - without > gain[p] or least[p] < 0:
                gain[p], least[p] = held - without, i
    out = [False] * n
    for i in range(n):
        p = parent[i]
        out[i] = better[i] if p < 0 else out[p] and (better[i] or least[p] == i)
    return out


# What training pages are made of; names that say nothing of a part are among them.
_MAIN = ["article", "main", "div class=content", "div class=post", "div id=main-content", "div class='entry-content'", "section class=story", "div itemprop=articleBody", "div role=main", "div class=text", "div", "section", "td"]
_PARTS = {
    "header": ["header", "div class=header", "div id=masthead", "div class='site-header'", "div class=topbar", "div role=banner", "div"],
    "menu": ["nav", "div class=menu", "div id=navigation", "div class=navbar", "ul class=menu", "div class=breadcrumb", "div role=navigation", "div"],
    "notice": ["div class=cookie-notice", "div id=cookies", "div class=consent", "div class=newsletter", "div class='alert notice'", "div class=popup", "aside class=subscribe", "section class=notice", "dialog", "div role=alert", "p class=notice"],
    "ad": ["div class=ad", "div class=ads", "div class='advert'", "div class=sponsored", "div id=ad-top", "aside class=promo", "div class='ad-banner'", "section class=advertisement", "p class=ad"],
    "side": ["aside", "div class=sidebar", "div id=side", "div class='widget related'", "section class=related", "div class=recommended", "td class=sidebar", "div"],
    "form": ["form", "div class=search", "form class=login", "form class=contact-form", "div id=signup"],
    "comment": ["section class=comments", "div id=comments", "div class='comment-list'", "section class=responses", "ol class=commentlist", "div class=discussion", "ul class=comments"],
    "share": ["div class=share", "ul class=social", "div class='share-buttons'"],
    "footer": ["footer", "div class=footer", "div id=colophon", "div class='copyright'", "div id=bottom", "div"],
}


class _Layouts:
    """Pages for training: blocks of real pages in made-up places."""

    def __init__(self, seed: int, blocks: list[str], short: list[str]):
        self.random, self.blocks, self.short = Random(seed), blocks, short

    def _in(self, opening: str, inner: str, truth: str = "") -> str:
        name, _, attributes = opening.partition(" ")
        if truth and "class=" in attributes:
            before, _, value = attributes.partition("class=")
            attributes = f"{before}class='{value.strip(chr(39))} {truth}'"
        elif truth:
            attributes += f" class={truth}"
        return f"<{name} {attributes}>{inner}</{name}>"

    def _some(self, least: int, most: int, of: list[str]) -> list[str]:
        return [html.escape(self.random.choice(of), quote=False) for _ in range(self.random.randint(least, most))]

    def _sentence(self) -> str:
        words = self.random.choice(self.blocks).split()
        at = self.random.randrange(len(words))
        return html.escape(" ".join(words[at : at + self.random.randint(3, 30)]), quote=False)

    def _links(self) -> str:
        links = [f"<a href=/{i}>{x}</a>" for i, x in enumerate(self._some(2, 9, self.short))]
        kind = self.random.choice(["ul", "bare", "p"])
        return "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>" if kind == "ul" else " | ".join(links) if kind == "bare" else "".join(f"<p>{x}</p>" for x in links)

    def _part(self, kind: str) -> str:
        r = self.random
        if kind == "menu":
            inner = self._links()
        elif kind == "header":
            inner = r.choice(["", f"<h1>{self._sentence()[:30]}</h1>", f"<p>{self._sentence()}</p>"]) + self._links()
        elif kind in ("notice", "ad"):
            inner = r.choice([f"<p>{self._sentence()}</p>", self._sentence(), f"{self._sentence()} <a href=#>{self._sentence()[:12]}</a>", f"<h3>{self._sentence()[:25]}</h3><p>{self._sentence()}</p><button>OK</button>"])
        elif kind == "side":
            inner = f"<h3>{self._sentence()[:25]}</h3>" + r.choice([self._links(), "".join(f"<p>{self._sentence()}</p>" for _ in range(r.randint(1, 4)))])
        elif kind == "form":
            inner = "".join(f"<label>{x}<input name=x></label>" + r.choice(["<br>", ""]) for x in self._some(1, 4, self.short)) + r.choice(["", f"<p>{self._sentence()}</p>"])
        elif kind == "comment":
            name = r.choice(["div", "li", "p", "article"])
            each = [f"<{name} {r.choice(['', 'class=comment', 'class=reply'])}>{r.choice(['', f'<h4>{self._sentence()[:20]}</h4>'])}<p>{x}</p></{name}>" for x in [self._sentence() for _ in range(r.randint(0, 3))] + self._some(1, 2, self.blocks)]
            inner = r.choice(["", "<h2>Comments</h2>", f"<h3>{self._sentence()[:20]}</h3>"]) + "".join(each)
        elif kind == "share":
            inner = self._links()
        else:
            inner = r.choice([f"&copy; {self._sentence()}", f"<p>&copy; {self._sentence()}</p>{self._links()}", self._links() + self._sentence()])
        return self._in(r.choice(_PARTS[kind]), inner, OFF)

    def page(self) -> str:
        r = self.random
        kinds = ["p"] * 8 + ["div"] * r.choice([0, 0, 4]) + ["ul", "blockquote", "h2", "h3", "td", "pre"]
        body = []
        for text in self._some(1, r.choice([2, 4, 12]), self.blocks):
            kind = r.choice(kinds)
            if r.random() < 0.2:
                words = text.split()
                k = r.randrange(len(words))
                text = " ".join([*words[:k], f"<a href=/x>{words[k]}</a>", *words[k + 1 :]])
            if kind == "ul":
                body.append(f"<ul><li>{text}</li><li>{self._sentence()}</li></ul>")
            elif kind == "td":
                body.append(f"<table><tr><td>{self._sentence()}</td><td>{text}</td></tr></table>")
            elif kind in ("h2", "h3"):
                body.append(f"<{kind}>{text[:40]}</{kind}><p>{self._sentence()}</p>")
            else:
                body.append(f"<{kind}>{text}" + r.choice(["", f"</{kind}>"]) if kind == "p" else f"<{kind}>{text}</{kind}>")
        for kind in ("ad", "share", "side", "notice", "form"):
            if r.random() < 0.15:
                body.insert(r.randint(0, len(body)), self._part(kind))
        title = r.choice(["", f"<h1>{self._sentence()}</h1>", f"<header><h1>{self._sentence()}</h1></header>"])
        if r.random() < 0.2:
            body.append(self._part("comment"))
        main = self._in(r.choice(_MAIN), title + "".join(body), MAIN)
        for _ in range(r.randint(0, 2)):
            main = self._in(r.choice(["div", "div id=page", "section", "div class=container", "div class=wrapper"]), main)
        if r.random() < 0.08:  # nothing but text
            return "".join(f"<p class={MAIN}>{r.choice([x, self._sentence(), x[:20]])}</p>" for x in self._some(1, 6, self.blocks))
        top = [self._part(k) for k, p in (("notice", 0.3), ("header", 0.6), ("menu", 0.6), ("ad", 0.3), ("form", 0.2), ("side", 0.2)) if r.random() < p]
        last = [self._part(k) for k, p in (("share", 0.2), ("comment", 0.5), ("side", 0.4), ("ad", 0.3), ("form", 0.2), ("menu", 0.1), ("notice", 0.2), ("footer", 0.8)) if r.random() < p]
        if r.random() < 0.2:
            r.shuffle(last)
        inner = "".join([*top, main, *last])
        for _ in range(r.randint(0, 2)):
            inner = self._in(r.choice(["div", "div id=page", "div class=site", "div class=container"]), inner)
        return f"<html><body>{inner}</body></html>"


_TAG = {name: 1 << (len(GROUPS) + i) for i, name in enumerate(TAGS)}
_LEFT_OUT = _TAG["nav"] | _TAG["header"] | _TAG["footer"] | _TAG["aside"] | _TAG["form"] | _TAG["dialog"]
_ARTICLE = _TAG["article"] | _TAG["main"]


def _examples(pages: list[str]) -> Tree | None:
    """Nodes of the training pages, their truth in ``truth``."""
    tree, blocks, short = Tree(), [], []
    for page in pages:
        own = Tree()
        own.add(page)
        said = [own.above[i] for i in range(len(own.parent))]
        marked = any(b & _ARTICLE and not b & _LEFT_OUT for b, t in zip(said, own.text, strict=True) if t)
        for i, text in enumerate(own.text):
            if text is None:
                continue
            main = bool(said[i] & _ARTICLE and not said[i] & _LEFT_OUT) if marked else own.linked[i] * 3 < len(text) and text.count(" ") >= 8
            own.truth[i] = 1 if main else -1
            if main:
                blocks.append(text)
            elif own.linked[i]:
                short.append(text)
        if marked:
            _append(tree, own)
    if not blocks:
        return None
    short = short or [x[:12] for x in blocks]
    for k in range(LAYOUTS * len(pages)):
        tree.add(_Layouts(zlib.crc32(b"%d" % k), blocks, short).page())
    return tree


def _append(tree: Tree, other: Tree) -> None:
    """The nodes of ``other`` after those of ``tree``."""
    shift = len(tree.parent)
    tree.pages += [i + shift for i in other.pages]
    tree.parent += [i + shift if i >= 0 else -1 for i in other.parent]
    tree.end += [i + shift for i in other.end]
    for name in ("own", "above", "depth", "text", "linked", "truth"):
        getattr(tree, name).extend(getattr(other, name))


def train(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE, page_bytes: int = PAGE_BYTES) -> Boosted | None:
    """Trees learned from at most ``sample`` different pages of at most ``page_bytes``; None if there is no paragraph in them."""
    at = F.col(html_col)
    few = pages.select(at.alias("_tw_html")).where(at.isNotNull() & (F.octet_length(at) <= page_bytes))
    seen = [r["_tw_html"] for r in hashed_sample(few, "_tw_html", sample).collect()]
    tree = _examples(seen)
    if tree is None:
        return None
    n = len(tree.parent)
    main = np.concatenate([[0], np.cumsum([t is not None and x > 0 for t, x in zip(tree.text, tree.truth, strict=True)])])
    runs = np.concatenate([[0], np.cumsum([t is not None for t in tree.text])])
    end = np.array(tree.end)
    truth, filled = main[end] - main[:n] > 0, runs[end] - runs[:n] > 0  # of a subtree
    return Boosted().fit(features(tree)[filled], truth[filled].astype(float))


def _main(tree: Tree, model: Boosted | None) -> list[bool]:
    if model is None:
        return [t is not None and not b & _LEFT_OUT for t, b in zip(tree.text, tree.above, strict=True)]
    return decode(tree, model.predict(features(tree)))


def texts(pages: list[str], model: Boosted | None) -> list[str]:
    """The main text of each page."""
    tree = Tree()
    for page in pages:
        tree.add(page)
    if not tree.parent:
        return []
    kept = _main(tree, model)
    bounds = [*tree.pages, len(tree.parent)]
    return ["\n".join(tree.text[i] for i in range(a, b) if tree.text[i] is not None and kept[i]) for a, b in zip(bounds, bounds[1:], strict=False)]


def extract(pages: DataFrame, model: Boosted | None, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (all by default) with _tw_text, the page's main text."""
    keep = keep if keep is not None else pages.columns
    shared = ship(pages.sparkSession).sparkContext.broadcast(model)

    @task("extract")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, html_col, STEP_BYTES):
                found = texts([x.decode("utf-8", "replace") if x else "" for x in blobs(batch.column(html_col))], shared.value)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, pa.string())], names=[*keep, "_tw_text"])

    return pages.select(*dict.fromkeys([*keep, html_col])).mapInArrow(run, with_columns(pages.select(*keep).schema, "_tw_text string"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = extract(pages, train(pages), keep=["page_id", "url"])
    return found.select("page_id", "url", F.col("_tw_text").alias("text"), F.char_length("_tw_text").cast("long").alias("n_chars"))
