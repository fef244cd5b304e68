"""Main text of web pages by a tree-structured graphical model (operator 7).

The nodes of a page's DOM tree (block elements and blocks of text) are content
or not.  A node's own features give its potential, and every edge has a
potential for the four states of parent and child.  Sum-product messages pass
from the leaves up and from the root down, which gives the exact marginals; a
block of text is taken if it is content with probability 0.5 or more.

The potentials are fitted here by maximum likelihood (observed minus expected
counts, the latter from the same messages) on labelled pages: texts of a bounded
sample of the pages at hand, set anew into many layouts, so that it is known
which block is article and which is menu, notice, advert, form or comment.
"""

from __future__ import annotations

import html
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, slices, strings
from .dom import Page

BUCKETS = 1 << 16
#: Bound of the sample of pages whose texts are set into labelled pages.
TRAIN_PAGES = 240
#: Of each page of the sample at most so many blocks of at most so many characters; the made pages draw their phrases
#: from at most so many words.  These bound the fit only; extraction reads whole pages.
TRAIN_BLOCKS, TRAIN_CHARS, TRAIN_WORDS = 20, 2_000, 50_000
LAYOUTS_A_PAGE = 5
EPOCHS, RATE, DECAY = 100, 0.3, 3e-4
KINDS = 2  # edges to elements and edges to blocks of text


@dataclass
class Model:
    weights: np.ndarray  # log odds of "content" by hashed feature
    edges: np.ndarray  # KINDS x parent state x child state


def bucket(name: str, known: dict[str, int]) -> int:
    at = known.get(name)
    if at is None:
        if len(known) > 200_000:
            known.clear()
        at = known[name] = xxhash.xxh3_64_intdigest(name) % BUCKETS
    return at


KNOWN: dict[str, int] = {}


class Forest:
    """The trees of many pages side by side, with nodes by level."""

    def __init__(self, pages: list[Page]):
        self.sizes = [len(p.parent) for p in pages]
        base = np.cumsum([0, *self.sizes[:-1]])
        self.parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + b) for p, b in zip(pages, base.tolist(), strict=True)])
        self.leaf = np.array([t is not None for p in pages for t in p.text])
        depth = np.zeros(len(self.parent), np.int64)
        at = 0
        for p in pages:
            for n, parent in enumerate(p.parent):
                if parent >= 0:
                    depth[at + n] = depth[at + parent] + 1
            at += len(p.parent)
        order = np.argsort(depth, kind="stable")
        cuts = np.flatnonzero(np.diff(depth[order])) + 1
        self.levels = np.split(order, cuts)
        names = [[bucket(f, KNOWN) for f in fs] for p in pages for fs in p.features]
        self.rows = np.repeat(np.arange(len(names)), [len(x) for x in names])
        self.features = np.concatenate([np.array(x, np.int64) for x in names])

    def messages(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of "content", and of the states of (parent, child) for every node but the roots."""
        n = len(self.parent)
        own = np.zeros((n, 2))
        own[:, 1] = np.bincount(self.rows, model.weights[self.features], n)
        kind = self.leaf.astype(int)
        below = own.copy()  # own potential and all messages from below
        up = np.zeros((n, 2))
        for level in self.levels[:0:-1]:
            up[level] = np.logaddexp.reduce(model.edges[kind[level]] + below[level][:, None, :], axis=2)
            np.add.at(below, self.parent[level], up[level])
        down = np.zeros((n, 2))
        both = np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            parent = self.parent[level]
            rest = below[parent] + down[parent] - up[level]
            joint = model.edges[kind[level]] + rest[:, :, None]
            down[level] = np.logaddexp.reduce(joint, axis=1)
            both[level] = joint + below[level][:, None, :]
        belief = below + down
        marginal = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -60, 60)))
        inner = np.concatenate(self.levels[1:]) if len(self.levels) > 1 else np.zeros(0, np.int64)
        top = both[inner].max((1, 2), keepdims=True)
        states = np.exp(both[inner] - top)
        both[inner] = states / states.sum((1, 2), keepdims=True)
        return marginal, both


def fit(pages: list[Page], labels: list[np.ndarray]) -> Model:
    """Potentials of highest likelihood for labelled trees (one 0/1 for each node)."""
    model = Model(np.zeros(BUCKETS), np.zeros((KINDS, 2, 2)))
    if not pages:
        return model
    forest, y = Forest(pages), np.concatenate(labels)
    child = np.flatnonzero(forest.parent >= 0)
    kind, above = forest.leaf[child].astype(int), y[forest.parent[child]]
    seen = np.zeros((KINDS, 2, 2))
    np.add.at(seen, (kind, above, y[child]), 1)
    g_w, g_e = np.full(BUCKETS, 1e-8), np.full((KINDS, 2, 2), 1e-8)
    for _ in range(EPOCHS):
        marginal, both = forest.messages(model)
        d_w = np.bincount(forest.features, (y - marginal)[forest.rows], BUCKETS) / len(pages) - DECAY * model.weights
        expected = np.zeros((KINDS, 2, 2))
        np.add.at(expected, kind, both[child])
        d_e = (seen - expected) / len(pages) - DECAY * model.edges
        g_w += d_w**2
        g_e += d_e**2
        model.weights += RATE * d_w / np.sqrt(g_w)
        model.edges += RATE * d_e / np.sqrt(g_e)
    return model


#: Names that pages give to the parts of a layout (own choice of common ones).
ARTICLE = ("article", "main", "section", 'div class="content"', 'div class="post"', 'div id="main"', 'div class="entry-content"', 'div class="article-body"', 'div class="story"', "div", 'td class="content"', 'div role="main"', 'div itemprop="articleBody"')
MENU = ("nav", 'div class="menu"', 'div id="nav"', 'ul class="menu"', 'div role="navigation"', 'div class="breadcrumb"', 'div class="navbar"')
HEADER = ("header", 'div id="header"', 'div class="site-header"', 'div class="masthead"', 'div class="topbar"', 'div role="banner"')
FOOTER = ("footer", 'div id="footer"', 'div class="footer"', 'div class="site-footer"', 'div role="contentinfo"', 'div class="bottom"')
SIDE = ("aside", 'div class="sidebar"', 'div id="sidebar"', 'div class="widget"', 'div class="related"', 'td class="sidebar"', 'div class="share"', 'div role="complementary"')
NOTICE = ('div class="notice"', 'div class="cookie-banner"', 'div class="alert"', 'div id="cookies"', 'div class="newsletter"', 'div class="popup"', 'div class="subscribe"', 'div role="alert"')
ADVERT = ('div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="sponsored"', 'div class="promo"', 'div id="banner-ad"', 'aside class="ad"', 'div class="advertisement"')
COMMENTS = ('div class="comments"', 'section id="comments"', 'div class="comment"', 'ol class="comment-list"', 'div id="disqus"', 'section class="responses"', 'div class="reader-comments"')
INSIDE = ("p", "p", "p", "p", "h2", "li", "blockquote", "pre", "td", "dd", "h3", "div")


class Layouts:
    """Pages with known labels, made from blocks of text."""

    def __init__(self, blocks: list[str], seed: int):
        self.random, self.blocks = np.random.default_rng(seed), blocks or ["text"]
        self.words = [w for b in self.blocks for w in b.split()][:TRAIN_WORDS] or ["text"]

    def pick(self, names):
        return names[int(self.random.integers(len(names)))]

    def phrase(self, most: int) -> str:
        n, at = int(self.random.integers(1, most + 1)), int(self.random.integers(len(self.words)))
        return html.escape(" ".join(self.words[at : at + n]))

    def box(self, opening: str, inside: str) -> str:
        return f"<{opening}>{inside}</{opening.split()[0]}>"

    def links(self) -> str:
        each = [f'<a href="/x">{self.phrase(3)}</a>' for _ in range(int(self.random.integers(2, 8)))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in each) + "</ul>" if self.random.random() < 0.6 else " | ".join(each)

    def paragraph(self, mark: str) -> str:
        tag, words = self.pick(INSIDE), self.pick(self.blocks).split(" ")
        if self.random.random() < 0.5:  # length alone must not tell an article from the rest
            words = words[: int(self.random.integers(1, 31))]
        text = html.escape(" ".join(words))
        if self.random.random() < 0.3:
            words = text.split(" ")
            at = int(self.random.integers(len(words)))
            words[at] = f"<a href='/y'>{words[at]}</a>" if self.random.random() < 0.5 else f"<b>{words[at]}</b>"
            text = " ".join(words)
        out = f"<{tag}>{mark}{text}</{tag}>"
        return {"li": f"<ul>{out}</ul>", "td": f"<table><tr>{out}</tr></table>", "dd": f"<dl>{out}</dl>"}.get(tag, out)

    def boilerplate(self, mark: str) -> str:
        kind = int(self.random.integers(8))
        text = f"<p>{self.phrase(90)}</p>" if self.random.random() < 0.5 else self.phrase(60)
        if kind == 0:
            return self.box(self.pick(MENU), self.links())
        if kind == 1:
            return self.box(self.pick(HEADER), f"<h1>{self.phrase(5)}</h1>" + self.links())
        if kind == 2:
            return self.box(self.pick(FOOTER), (f"&copy; {self.phrase(4)} &middot; " if self.random.random() < 0.6 else "") + text)
        if kind == 3:
            return self.box(self.pick(SIDE), f"<h3>{self.phrase(3)}</h3>" + (self.links() if self.random.random() < 0.5 else text))
        if kind == 4:
            return self.box(self.pick(NOTICE), text + "<button>OK</button>")
        if kind == 5:
            return self.box(self.pick(ADVERT), text)
        if kind == 6:
            return f"<form action='/s'><p>{self.phrase(8)}</p><label>{self.phrase(2)}</label><input name=q></form>"
        inside = "".join(f"<div><b>{self.phrase(2)}</b>{self.paragraph('')}</div>" if self.random.random() < 0.5 else self.paragraph("") for _ in range(int(self.random.integers(1, 4))))
        return self.box(self.pick(COMMENTS), f"<h3>{self.phrase(2)}</h3>{inside}")

    def page(self) -> tuple[Page, np.ndarray]:
        """A page and the label of each node.  Blocks of the article are marked, and the mark is then taken off."""
        mark = ""
        r = self.random
        inner = [f"<h1>{mark}{self.phrase(12)}</h1>"] if r.random() < 0.8 else []
        for _ in range(int(r.integers(1, 9))):
            inner.append(self.paragraph(mark))
            if r.random() < 0.12:
                inner.append(self.boilerplate(mark))
        article = self.box(self.pick(ARTICLE), "".join(inner))
        if article.startswith("<td"):
            article = f"<table><tr>{article}</tr></table>"
        parts = [self.boilerplate(mark) for _ in range(int(r.integers(1, 7)))]
        parts.insert(int(r.integers(len(parts) + 1)), article)
        body = "".join(parts)
        for _ in range(int(r.integers(0, 3))):
            body = f"<div{' class=' + self.pick(('wrapper', 'container', 'page', 'row')) if r.random() < 0.5 else ''}>{body}</div>"
        page = Page(f"<!DOCTYPE html><html><head><title>{self.phrase(5)}</title></head><body>{body}</body></html>")
        inside = np.zeros(len(page.parent), int)
        for n in range(len(inside) - 1, 0, -1):
            if page.text[n] is not None:
                inside[n] = mark in page.text[n]
                page.text[n] = page.text[n].replace(mark, "")
            inside[page.parent[n]] += inside[n]
        # content are the innermost element around the whole article, and what in it holds some of its text
        labels = (inside > 0).astype(int)
        labels[: np.flatnonzero(inside == inside[0])[-1]] = 0
        return page, labels


def train(pages: DataFrame, most: int = TRAIN_PAGES, seed: int = 11) -> Model:
    """Fit on layouts made of the texts of at most about ``most`` different pages, chosen by a hash of the page."""
    pages = pages.where(F.col("html").isNotNull())
    count = pages.select(F.xxhash64("html").alias("same")).distinct().count()
    place = F.pmod(F.xxhash64(F.lit("train"), "html"), F.lit(1_000_000))
    chosen = pages.where(place < int(1_000_000 * min(1.0, most / max(1, count)))).select("html")
    chosen = chosen.groupBy(F.xxhash64("html").alias("same")).agg(F.first("html").alias("html")).select("html")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [[t[:TRAIN_CHARS] for t in Page(h).text if t][:TRAIN_BLOCKS] for h in strings(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], names=["blocks"])

    rows = chosen.mapInArrow(blocks, "blocks array<string>").toArrow()["blocks"].to_pylist()
    made = Layouts(sorted(b for r in rows for b in r), seed)
    labelled = [made.page() for _ in range(LAYOUTS_A_PAGE * most)]
    return fit([p for p, _ in labelled], [y for _, y in labelled])


def main_texts(pages: list[Page], model: Model) -> list[str]:
    if not pages:
        return []
    marginal, _ = Forest(pages).messages(model)
    out, at = [], 0
    for p in pages:
        out.append("\n".join(t for n, t in enumerate(p.text) if t and marginal[at + n] >= 0.5))
        at += len(p.parent)
    return out


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``.

    Blocks of the main text in page order, joined by line feeds.  Null, empty and markup-only pages have an
    empty text; broken or cut-off markup is read as far as it goes; repeated rows and null ids each have
    their row; an empty table gives an empty result; other columns are not read.
    """
    shipped = pages.sparkSession.sparkContext.broadcast(model)
    rows = pages.select("page_id", "url", "html")
    schema = extended(rows, ["page_id", "url"], "text string, n_chars long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            texts = main_texts([Page(h) for h in strings(batch.column(2))], shipped.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)
