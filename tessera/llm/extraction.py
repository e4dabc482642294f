"""Main text of web pages by a tree-structured graphical model on the DOM.

Every block of a page is a binary variable: main text or not. Its own evidence is a linear score of features
(tag, words of class and id, length, share of links, marks of sentences); each edge to its parent has a 2x2
potential by the kind of child. Sum-product messages go upward from the leaves and downward from the root,
which gives exact marginals; blocks over one half are main text. Weights are trained by the gradient of the
likelihood (what was seen minus what the marginals expect) on labelled pages: ``SEEDS``, written for this
purpose, and a bounded sample of the table's own pages (``TRAIN_PAGES`` of under ``TRAIN_CHARS`` characters and
``TRAIN_BLOCKS`` blocks) whose markup names its article.

Text is decoded, white space within a block becomes one space, blocks are joined in page order by a space.

Defined results: null and empty pages, and pages without main text, give an empty text; broken and cut-off
markup is read as browsers do in the main; repeated rows are extracted each; an empty table gives no rows,
and so does training (the seeds are enough). Pages are read whole.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import least_hashed, read, small_batches
from tessera.llm.dom import Node, attributes, own_texts, parse

#: Bounds of the training sample: pages, characters of a page, blocks of a page. They limit training alone.
TRAIN_PAGES, TRAIN_CHARS, TRAIN_BLOCKS = 120, 200_000, 400
SIZE = 512
#: Kinds of edges: by the child's tag.
KINDS = {"p": 1, "h1": 2, "h2": 2, "h3": 2, "h4": 2, "h5": 2, "h6": 2, "li": 3, "ul": 3, "ol": 3, "dl": 3, "dd": 3, "dt": 3, "td": 4, "tr": 4, "table": 4, "tbody": 4, "div": 5, "section": 5, "article": 6, "main": 6, "nav": 7, "footer": 7, "header": 7, "aside": 7, "form": 7, "blockquote": 1, "pre": 1, "figure": 1}
N_KINDS = 8

# fixed values: what names in markup say about a region
NOT_MAIN = frozenset("nav navbar navigation menu header footer masthead sidebar aside ad ads advert advertisement sponsor sponsored promo banner cookie cookies consent notice notices gdpr popup modal newsletter subscribe signup form search share social related recommended comments comment replies reply disqus breadcrumb breadcrumbs pagination pager login widget widgets toolbar copyright legal disclaimer skip tags meta byline".split())
MAIN = frozenset("article content main post story entry body text prose article-body post-body entry-content post-content main-content articlebody story-body page-content".split())

SEEDS = (
    '<html><body><header class="site-header"><h1 data-y="0">Daily News</h1><ul class="menu"><li data-y="0"><a href="/">Home</a></li><li data-y="0"><a href="/w">World</a></li></ul></header><main id="content"><h1 data-y="1">Rivers rise after a week of rain</h1><p data-y="1">The water rose through the night, and by the morning the lower road was closed.</p><p data-y="1">Residents said they had been warned in time.</p><div class="ad" data-y="0">Buy our boots now and save.</div><p data-y="1">Help is on the way, the mayor said.</p></main><aside class="sidebar"><h3 data-y="0">Most read</h3><ul><li data-y="0"><a href="/1">Ten ways to cook rice</a></li><li data-y="0"><a href="/2">What to plant in May</a></li></ul></aside><div id="comments"><h3 data-y="0">Comments</h3><div class="comment"><p data-y="0">I live there, and it was quite a night for all of us.</p></div></div><footer data-y="0">All rights reserved.</footer></body></html>',
    '<html><body><div class="cookie-notice" data-y="0">We use cookies to improve the site. <a href="#">Accept</a></div><div class="nav" data-y="0"><a href="/a">Start</a> <a href="/b">Shop</a></div><div class="post"><h2 data-y="1">How we built the bridge</h2><div class="entry-content"><p data-y="1">It took three summers and a great deal of timber.</p><ul><li data-y="1">First we laid the stones on both sides.</li><li data-y="1">Then the beams were carried over.</li></ul><blockquote data-y="1">No one slept that week.</blockquote><h3 data-y="1">The last day</h3><p data-y="1">Everyone came to see it open.</p></div></div><div class="related"><p data-y="0"><a href="/x">The old mill</a></p><p data-y="0"><a href="/y">A walk by the sea</a></p></div><form class="newsletter"><p data-y="0">Get our letters by mail every week.</p></form><div class="footer" data-y="0">Contact us</div></body></html>',
    '<html><body><nav><ul><li data-y="0"><a href="/">x</a></li><li data-y="0"><a href="/">y</a></li></ul></nav><article><header><h1 data-y="1">On keeping bees</h1></header><p data-y="1">Bees ask for little, but what they ask for cannot wait until tomorrow.</p><table><tbody><tr><td data-y="1">Spring</td><td data-y="1">Two boxes, no more.</td></tr></tbody></table><section><h2 data-y="1">Tools</h2><p data-y="1">A smoker, a veil and patience.</p><pre data-y="1">smoke(2); wait(5);</pre></section><aside class="promo"><p data-y="0">Join our course for beginners today.</p></aside></article><section class="comments"><article class="comment"><p data-y="0">Lovely piece, thank you for writing it.</p></article><article class="comment"><p data-y="0">My grandfather kept them too, in the same way.</p></article></section><footer><p data-y="0">Imprint and terms</p></footer></body></html>',
    '<html><body><div id="header"><div class="logo" data-y="0">Site</div><form class="search" data-y="0">Search</form></div><div id="wrapper"><div id="sidebar"><div class="widget"><h4 data-y="0">Archive</h4><ul><li data-y="0"><a href="/2">May</a></li></ul></div></div><div id="main"><div class="story"><p data-y="1">Short one.</p><p data-y="1">The committee met on Monday to look at the plans, which had been drawn up over the winter, and found them sound.</p><p class="byline" data-y="0">By staff</p><div class="share" data-y="0"><a href="#">Share</a></div><p data-y="1">Work begins in June.</p></div></div></div><div id="footer"><p data-y="0">Copyright and legal notice.</p></div><div class="popup"><p data-y="0">Subscribe to read more stories like this.</p></div></body></html>',
)


def _hash(word: str) -> int:
    return zlib.crc32(word.encode()) % SIZE


_SPLIT = re.compile(r"[^a-z0-9]+")


def region(node: Node, above: int) -> int:
    """Bits of what a block lies in: 1 a region named as not main text, 2 one named as main text."""
    here = 1 if node.tag in ("nav", "aside", "footer", "form", "menu") else 2 if node.tag in ("main", "article") else 0
    if node.attrs:
        a = attributes(node.attrs)
        names = " ".join((a.get("class", ""), a.get("id", ""), a.get("role", ""), a.get("itemprop", ""))).lower()
        words = set(names.split()) | set(_SPLIT.split(names))
        here |= bool(words & NOT_MAIN) | 2 * bool(words & MAIN and not words & NOT_MAIN)
    if here & 2 and not here & 1 and not above & 1:
        return 2
    return above | here


def features(node: Node, texts: list[str], lies: int) -> list[int]:
    """Indices of the binary features of a block."""
    out = [_hash("bias"), _hash("tag:" + node.tag), _hash(f"in:{lies}")]
    if node.attrs:
        a = attributes(node.attrs)
        names = " ".join((a.get("class", ""), a.get("id", ""), a.get("role", ""), a.get("itemprop", ""))).lower()
        words = set(names.split()) | {w for w in _SPLIT.split(names) if w}
        if words & NOT_MAIN:
            out.append(_hash("names:not"))
        if words & MAIN:
            out.append(_hash("names:main"))
        out += [_hash("name:" + w) for w in sorted(words)]
    n = sum(map(len, texts))
    out.append(_hash(f"len:{min(6, n.bit_length() // 2)}"))
    if n:
        out.append(_hash(f"links:{min(3, int(4 * node.link_chars / (n + 1)))}"))
        out.append(_hash("sentence" if texts[-1][-1] in ".!?\"'”»:;…" else "no sentence"))
    return out


class Page:
    """Blocks in page order with what the model needs of them."""

    def __init__(self, html: str | None):
        self.nodes: list[Node] = []
        todo = [parse(html)]
        while todo:
            node = todo.pop()
            self.nodes.append(node)
            todo += reversed(node.children)
        at = {id(n): i for i, n in enumerate(self.nodes)}
        self.parent = [at[id(n.parent)] if n.parent is not None else -1 for n in self.nodes]
        self.texts = [own_texts(n) for n in self.nodes]
        lies: list[int] = []
        for n, p in zip(self.nodes, self.parent, strict=True):
            lies.append(region(n, lies[p] if p >= 0 else 0))
        self.features = [features(n, t, r) for n, t, r in zip(self.nodes, self.texts, lies, strict=True)]
        self.kind = [KINDS.get(n.tag, 0) for n in self.nodes]

    def text(self, keep: list[bool]) -> str:
        """The texts of the kept blocks in page order."""
        out: list[str] = []
        todo: list = [(0, iter(self.nodes[0].parts), iter(self.texts[0]))]
        # walk parts so that text after a child comes after the child's text
        at = {id(n): i for i, n in enumerate(self.nodes)}
        run: list[str] = []

        def flush(i, texts):
            if "".join(run).strip() and (t := next(texts, None)) is not None and keep[i]:
                out.append(t)
            run.clear()

        while todo:
            i, parts, texts = todo[-1]
            child = None
            for p in parts:
                if isinstance(p, str):
                    run.append(p)
                else:
                    child = p
                    break
            flush(i, texts)
            if child is None:
                todo.pop()
            else:
                j = at[id(child)]
                todo.append((j, iter(child.parts), iter(self.texts[j])))
        return " ".join(out)


class Model:
    def __init__(self):
        self.w = np.zeros(SIZE)
        self.edge = np.zeros((N_KINDS, 2, 2))

    def infer(self, page: Page):
        """Marginals of the blocks, and of the edges as (child, 2x2 by parent and child)."""
        n = len(page.nodes)
        w, edges = self.w, np.exp(self.edge).tolist()
        own = [(1.0, float(np.exp(min(30.0, max(-30.0, sum(w[k] for k in f)))))) for f in page.features]
        up = [[a, b] for a, b in own]  # evidence of a block and all below it
        message = [(1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):
            e, (a, b) = edges[page.kind[i]], up[i]
            m0, m1 = e[0][0] * a + e[0][1] * b, e[1][0] * a + e[1][1] * b
            s = m0 + m1
            message[i] = (m0 / s, m1 / s)
            p = up[page.parent[i]]
            p[0] *= message[i][0]
            p[1] *= message[i][1]
            s = p[0] + p[1]
            p[0] /= s
            p[1] /= s
        belief: list = [None] * n
        pairs: list = [None] * n
        a, b = up[0]
        belief[0] = b / (a + b)
        for i in range(1, n):
            j = page.parent[i]
            q1 = belief[j]
            m0, m1 = message[i]
            c0, c1 = (1 - q1) / max(m0, 1e-300), q1 / max(m1, 1e-300)
            e, (a, b) = edges[page.kind[i]], up[i]
            t = [[c0 * e[0][0] * a, c0 * e[0][1] * b], [c1 * e[1][0] * a, c1 * e[1][1] * b]]
            s = t[0][0] + t[0][1] + t[1][0] + t[1][1]
            belief[i] = (t[0][1] + t[1][1]) / s
            pairs[i] = [[x / s for x in r] for r in t]
        return belief, pairs

    def fit(self, pages: list[tuple[Page, list[int]]], rounds: int = 30, rate: float = 0.4, l2: float = 2e-3) -> Model:
        seen_w, seen_e = np.full(SIZE, 1e-2), np.full(self.edge.shape, 1e-2)
        for _ in range(rounds):
            for page, y in pages:
                belief, pairs = self.infer(page)
                gw, ge = np.zeros(SIZE), np.zeros(self.edge.shape)
                for f, b, t in zip(page.features, belief, y, strict=True):
                    for k in f:
                        gw[k] += t - b
                for i in range(1, len(y)):
                    ge[page.kind[i]] -= pairs[i]
                    ge[page.kind[i], y[page.parent[i]], y[i]] += 1
                gw -= l2 * self.w
                ge -= l2 * self.edge
                seen_w += gw * gw
                seen_e += ge * ge
                self.w += rate * gw / np.sqrt(seen_w)
                self.edge += rate * ge / np.sqrt(seen_e)
        return self

    def extract(self, html: str | None) -> str:
        page = Page(html)
        belief, _ = self.infer(page)
        return page.text([b > 0.5 for b in belief])


def seed_labels(page: Page) -> list[int]:
    """Labels written into a page; a block without one is main text if all labelled blocks below it are."""
    y: list = [attributes(n.attrs).get("data-y") for n in page.nodes]
    below: list[set] = [set() for _ in y]
    for i in range(len(y) - 1, -1, -1):
        if y[i] is not None:
            below[i].add(int(y[i]))
        if i:
            below[page.parent[i]] |= below[i]
    return [int(v) if v is not None else int(b == {1}) for v, b in zip(y, below, strict=True)]


def markup_labels(page: Page) -> list[int] | None:
    """Labels of a page whose markup names its article once; None for other pages."""
    roots = [i for i, n in enumerate(page.nodes) if n.tag == "article" or n.attrs and attributes(n.attrs).get("itemprop", "").lower() == "articlebody"]
    if len(roots) != 1:
        return None
    y = [0] * len(page.nodes)
    for i, n in enumerate(page.nodes):
        names = set(_SPLIT.split(" ".join(attributes(n.attrs).get(k, "") for k in ("class", "id")).lower())) if n.attrs else set()
        off = n.tag in ("nav", "aside", "footer", "form") or bool(names & NOT_MAIN and not names & MAIN)
        y[i] = int(i == roots[0] or i > 0 and y[page.parent[i]] == 1 and not off)
    return y


def train(pages: DataFrame, rows: int = TRAIN_PAGES, chars: int = TRAIN_CHARS, blocks: int = TRAIN_BLOCKS) -> Model:
    """From the seeds and at most ``rows`` pages under ``chars`` characters and ``blocks`` blocks, chosen by hash of the page.
    Pages are extracted whole whatever their size."""
    labelled = []
    pages = pages.where("html is not null").where(F.length("html") < chars).select("html")
    # hashes are chosen first; only the pages chosen travel
    chosen = least_hashed(pages.select(F.xxhash64("html").alias("h")).distinct(), F.col("h"), rows).limit(rows).collect()
    sample = pages.where(F.xxhash64("html").isin([r["h"] for r in chosen])).groupBy(F.xxhash64("html").alias("h")).agg(F.min("html").alias("html"))
    for r in sample.orderBy("h").collect():
        page = Page(r["html"])
        if (y := markup_labels(page)) is not None and len(y) < blocks:
            labelled.append((page, y))
    seeds = []
    for s in SEEDS:
        page = Page(s)
        y = seed_labels(page)
        seeds.append((page, y))
    mixed = []
    for i in range(0, max(1, len(labelled)), 6):
        mixed += labelled[i : i + 6] + seeds
    return Model().fit(mixed, rounds=8 if labelled else 60)


def extract_pages(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    model = model or train(pages)
    kinds = dict(pages.dtypes)

    def run(batches):
        for d in batches:
            t = [model.extract(h) for h in d["html"]]
            yield pd.DataFrame({"page_id": d["page_id"], "url": d["url"], "text": t, "n_chars": [len(x) for x in t]})

    small_batches(pages.sparkSession)
    # ids travel as text: pandas would turn numbers beside nulls into doubles
    out = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html").mapInPandas(run, f"page_id string, url {kinds['url']}, text string, n_chars long")
    return out.withColumn("page_id", F.col("page_id").cast(kinds["page_id"]))


def op6_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages"))
