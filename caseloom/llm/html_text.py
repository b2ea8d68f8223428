"""Main-text extraction: boosted trees over DOM nodes, decoded down the tree.

A page becomes a tree of elements whose leaves are blocks of text.  Every node
gets features of its own (tag, attribute tokens, depth, place among its
siblings), of its subtree (text, link and tag density) and of its ancestors.
The classifier gives log odds that a node holds article text; decoding takes
the best labelling in which nothing is kept below a dropped node, so choices of
ancestors and descendants never contradict each other.

Training pages are laid out at random around the paragraphs of a bounded
sample of pages (``sample_pages``), with menus, notices, adverts, forms,
sidebars, footers and comments whose labels are known; every page is scored.

Defined cases.  A null or empty html, or one without article text, gives an
empty text.  Unclosed and stray tags are repaired as browsers do for
paragraphs, list items and table cells; malformed declarations are comments.
Repeated rows are each extracted, and rows that tie in their id each stay.  A
page is parsed as a whole in time and memory in proportion to its length, at any
depth.  Only the three named columns are read, so others may have any names.  An
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.boosting import BoostedTrees
from caseloom.llm.common import map_rows, table

SAMPLE_PAGES = 200
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown as prose.
UNSEEN = frozenset("head script style noscript template title svg math iframe object textarea select canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img ruby rb rt rp".split())
#: An opening tag of the key closes an open element of the value, unless one of the walls stands between.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WALLS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
TAGS = ["nav header footer aside form dialog", "article main", "p", "h1 h2 h3 h4 h5 h6", "ul ol li menu dl dt dd", "div section span", "table tbody thead tr td th", "button label fieldset", "blockquote pre figure figcaption code", "body html", "#text"]
TAG_GROUP = {t: i for i, g in enumerate(TAGS) for t in g.split()}
#: Attribute tokens by what they announce.
WORDS = [
    "ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner outbrain taboola dfp",
    "nav navbar navigation menu breadcrumb breadcrumbs pager pagination toc skip tabs toolbar topbar",
    "comment comments reply replies respondent respond disqus discussion feedback reader readers thread",
    "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription paywall toast announcement warning",
    "share sharing social follow like likes tweet related recommended recommend more popular trending tags tagcloud byline meta author",
    "form search login signup signin register contact input field",
    "sidebar side rail widget aside secondary complementary",
    "footer foot header head masthead copyright legal colophon bottom banner contentinfo logo",
    "article content post entry main body story text page prose single hentry articlebody",
]
WORD_GROUP = {w: i for i, g in enumerate(WORDS) for w in g.split()}


class Tree(HTMLParser):
    """Nodes as parallel lists; node 0 is the root, ``#text`` nodes are blocks."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.words, self.text, self.linked = ["html"], [-1], [()], [""], [0]
        self.open, self.parts, self.link = [0], [], 0
        self.owner, self.at = [0], {}  # of each open element the block that it is in; of each tag its places among the open ones
        self.unseen = self.anchors = 0
        self.feed(html)
        self.close()
        self.flush()

    def updatepos(self, i: int, j: int) -> int:
        """Line numbers are not wanted."""
        return j

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """``<![...`` is a comment up to the next ``>``, as in browsers."""
        return self.rawdata.find(">", i) + 1 or -1

    def add(self, tag: str, words: tuple = (), text: str = "", linked: int = 0) -> int:
        self.tag.append(tag)
        self.parent.append(self.open[-1] if tag != "#text" else self.owner[-1])
        self.words.append(words)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.tag) - 1

    def flush(self) -> None:
        """End the block that is being gathered."""
        if not self.parts:
            return
        text = " ".join("".join(self.parts).split())
        if text:
            self.add("#text", text=text, linked=min(self.link, len(text)))
        self.parts, self.link = [], 0

    def pop(self, to: int) -> None:
        """Close the open elements from stack place ``to`` on."""
        for n in self.open[to:]:
            self.unseen -= self.tag[n] in UNSEEN
            self.anchors -= self.tag[n] == "a"
            self.at[self.tag[n]].pop()
        del self.open[to:], self.owner[to:]

    def push(self, tag: str, words: tuple) -> None:
        node = self.add(tag, words)
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append(node)
        self.owner.append(self.owner[-1] if tag in INLINE else node)
        self.unseen += tag in UNSEEN
        self.anchors += tag == "a"

    def find(self, names: set[str], walls: set[str]) -> int:
        """Stack place of the innermost open element of ``names``; 0 if there is none or a wall stands before it."""
        last = lambda tags: max((self.at[x][-1] for x in tags if self.at.get(x)), default=0)
        found = last(names)
        return found if found >= last(walls) else 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in INLINE:
            self.flush()
            k = self.find(CLOSES.get(tag, {"p"}), WALLS.get(tag, {"div", "td", "li", "section", "article", "button"}))
            if k:
                self.pop(k)
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        words = ()
        if attrs and (tag not in INLINE or tag == "a"):
            said = " ".join(f"{v}" for k, v in attrs if v and k in ("class", "id", "role", "itemprop", "aria-label"))
            words = tuple(w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", said).lower()) if w)
        self.push(tag, words)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in INLINE and self.tag[self.open[-1]] == tag:
            self.pop(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        k = self.find({tag}, {"table"} if tag not in ("table", "body", "html", "div", "article", "main", "section") else set())
        if tag not in INLINE:
            self.flush()
        if k:
            self.pop(k)

    def handle_data(self, data: str) -> None:
        if not self.unseen:
            self.parts.append(data)
            if self.anchors:
                self.link += len(data)


class Forest:
    """The trees of several pages as one set of arrays; work goes level by level."""

    def __init__(self, trees: list[Tree]):
        sizes = [len(t.tag) for t in trees]
        self.first = np.concatenate(([0], np.cumsum(sizes)))
        self.parent = np.concatenate([np.array(t.parent) + a for t, a in zip(trees, self.first[:-1], strict=True)])
        self.parent[self.first[:-1]] = -1
        self.text = [x for t in trees for x in t.text]
        self.linked = np.array([x for t in trees for x in t.linked], float)
        self.group = np.zeros((len(self.text), len(TAGS)), np.float32)
        self.own = np.zeros((len(self.text), len(WORDS)), np.float32)
        marks = [(i, TAG_GROUP[x]) for i, x in enumerate(x for t in trees for x in t.tag) if x in TAG_GROUP]
        self.group[tuple(np.array(marks).T)] = 1
        for i, words in enumerate(x for t in trees for x in t.words):
            for w in words:
                if w in WORD_GROUP:
                    self.own[i, WORD_GROUP[w]] += 1
        depth: list[int] = []
        for p in self.parent.tolist():
            depth.append(depth[p] + 1 if p >= 0 else 0)
        self.depth = np.array(depth)
        order = np.argsort(self.depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(self.depth))[:-1])[1:]

    def down(self, x: np.ndarray, share: float = 1.0) -> np.ndarray:
        """``x`` of each node plus ``share`` of what its parent has come to."""
        x = x.copy()
        for level in self.levels:
            x[level] += share * x[self.parent[level]]
        return x

    def up(self, x: np.ndarray) -> np.ndarray:
        """The sum of ``x`` over each subtree."""
        x = x.copy()
        for level in reversed(self.levels):
            np.add.at(x, self.parent[level], x[level])
        return x

    def features(self) -> np.ndarray:
        n, parent = len(self.text), np.maximum(self.parent, 0)
        own_chars = np.array([len(x) for x in self.text], float)
        chars, links, blocks, tags = self.up(np.stack([own_chars, np.where(own_chars > 0, self.linked, 0), own_chars > 0, np.ones(n)], 1)).T
        inner = np.flatnonzero(self.parent >= 0)
        by = inner[np.argsort(self.parent[inner], kind="stable")]
        kids = np.bincount(self.parent[inner], minlength=n).astype(float)
        starts = np.concatenate(([0], np.cumsum(kids)))
        place = np.zeros(n)
        place[by] = np.arange(len(by)) - starts[self.parent[by]]
        near = self.down(self.own, 0.5) - self.own
        return np.column_stack([
            self.group, self.own, self.down(self.group)[:, :5], self.down(self.own), near, self.depth, np.log1p(chars), links / np.maximum(chars, 1), chars / tags, blocks, tags,
            place, kids[parent], place / np.maximum(kids[parent], 1), np.log1p(chars[parent]), links[parent] / np.maximum(chars[parent], 1), self.group[parent],
        ])

    def decode(self, odds: np.ndarray) -> np.ndarray:
        """The labelling of greatest total odds that keeps no node below a dropped one."""
        total = odds.copy()
        for level in reversed(self.levels):
            np.add.at(total, self.parent[level], np.maximum(total[level], 0))
        keep = self.parent < 0
        for level in self.levels:
            keep[level] = keep[self.parent[level]] & (total[level] > 0)
        return keep


def texts(pages: list[str], model: BoostedTrees) -> list[str]:
    if not pages:
        return []
    forest = Forest([Tree(x) for x in pages])
    keep = forest.decode(model.log_odds(forest.features()))
    return ["\n".join(x for x, k in zip(forest.text[a:b], keep[a:b].tolist(), strict=True) if x and k) for a, b in zip(forest.first, forest.first[1:])]


class Layouts:
    """Random pages around given paragraphs, with the blocks that are article text known by a mark."""

    MARK = "⁣"

    def __init__(self, paragraphs: list[str], seed: int = 7):
        self.r, self.paragraphs = np.random.default_rng(seed), [p.replace(self.MARK, "") for p in paragraphs] or ["text"]

    def one(self, of: list) -> str:
        return of[int(self.r.integers(len(of)))]

    def chance(self, p: float) -> bool:
        return bool(self.r.random() < p)

    def some(self, most: int = 12) -> str:
        w = self.one(self.paragraphs).split()
        return escape(" ".join(w[: int(self.r.integers(1, most + 1))]))

    def prose(self) -> str:
        w = self.one(self.paragraphs).split()
        return escape(" ".join(w[: int(self.r.integers(1, 30))] if self.chance(0.25) else w))

    def name(self, group: int) -> str:
        """An attribute (or none) whose tokens come from a group, sometimes with noise around."""
        w = self.one(WORDS[group].split())
        w = self.one([w, f"{w}-box", f"site-{w}", f"x{int(self.r.integers(9))} {w}", f"{w}_wrap"])
        return f' {self.one(["class", "class", "id"])}="{w}"'

    def links(self) -> str:
        return f"<ul>{''.join(f'<li><a href="/x">{self.some(3)}</a></li>' for _ in range(int(self.r.integers(2, 9))))}</ul>"

    def junk(self, inside: bool = False) -> str:
        kind = int(self.r.integers(8))
        lines = "".join(f"<p>{self.some(30)}</p>" for _ in range(int(self.r.integers(1, 4))))
        body = self.one([self.some(30), lines, f"<p>{self.some(25)}</p>", f"<h3>{self.some(4)}</h3>{self.links()}"])
        tag = self.one(["div", "div", "section", "aside"])
        if kind == 0:
            return f"<{tag}{self.name(0)}>{body}</{tag}>"
        if kind == 1:
            return f"<nav{self.one(['', self.name(1)])}>{self.links()}</nav>" if self.chance(0.6) else f"<div{self.name(1)}>{self.links()}</div>"
        if kind == 2:
            each = "".join(f"<{self.one(['div', 'li', 'article'])}{self.name(2)}><b>{self.some(2)}</b><p>{self.prose()}</p></div>" for _ in range(int(self.r.integers(1, 5))))
            return f"<{tag}{self.name(2)}><h3>{self.some(2)}</h3>{each}</{tag}>"
        if kind == 3:
            return f"<{self.one(['div', 'section', 'dialog'])}{self.name(3)}>{body}<button>{self.some(2)}</button></div>"
        if kind == 4:
            return f"<{tag}{self.name(4)}>{self.one([self.links(), body])}</{tag}>"
        if kind == 5:
            return f"<form{self.one(['', self.name(5)])}><label>{self.some(3)}</label><input><p>{self.some(10)}</p><button>{self.some(2)}</button></form>"
        if kind == 6:
            return f"<{self.one(['aside', 'aside', 'div'])}{self.name(6)}>{body}{self.links() if self.chance(0.5) else ''}</aside>".replace("</aside>", "</div></aside>")
        if inside:
            return f"<footer{self.one(['', self.name(7)])}><p>{self.some(12)}</p></footer>"
        return f"<{self.one(['header', 'footer', 'footer'])}{self.one(['', self.name(7)])}>{self.one([self.some(12), body, self.links()])}</header></footer>"

    def page(self) -> str:
        m = self.MARK
        parts = [f"<h1>{m}{self.some(10)}</h1>"] if self.chance(0.9) else []
        for _ in range(int(self.r.integers(1, 14))):
            x = f"{m}{self.prose()}"
            parts.append(self.one([f"<p>{x}</p>"] * 8 + [f"<p><b>{x}<br><p>{m}{self.prose()}</p>", f"<h2>{m}{self.some(6)}</h2>", f"<ul><li>{x}</li><li>{m}{self.some(9)}</li></ul>", f"<blockquote><p>{x}</p></blockquote>", f'<p>{x} <a href="/y">{self.some(4)}</a> {self.some(5)}</p>', f"<div>{x}</div>", f"<pre>{x}</pre>", f"<table><tr><td>{x}</td></tr></table>"]))
            if self.chance(0.12):
                parts.append(self.junk(inside=True))
        main = "".join(parts)
        for _ in range(int(self.r.integers(1, 3))):
            main = self.one([f"<article>{main}</article>"] * 3 + [f"<main>{main}</main>", f"<div{self.name(8)}>{main}</div>", f"<div>{main}</div>", f"<section{self.name(8)}>{main}</section>"])
        around = [self.junk() for _ in range(int(self.r.integers(2, 7)))]
        cut = int(self.r.integers(len(around) + 1))
        return f"<!DOCTYPE html><html><head><title>{self.some(8)}</title></head><body>{''.join(around[:cut])}{main}{''.join(around[cut:])}</body></html>"


def trained(pages: list[str], per_page: int = 4, seed: int = 7) -> BoostedTrees:
    """The classifier from ``per_page`` random layouts per sample page."""
    found = [x for p in pages for x in Tree(p).text if x]
    make = Layouts(found, seed)
    forest = Forest([Tree(make.page()) for _ in range(max(200, per_page * len(pages)))])
    y = np.array([float(make.MARK in x) for x in forest.text])
    forest.text = [x.replace(make.MARK, "") for x in forest.text]
    for level in reversed(forest.levels):
        np.maximum.at(y, forest.parent[level], y[level])
    return BoostedTrees().fit(forest.features(), y)


def sampled(pages: DataFrame, page_id: str, html: str, most: int) -> list[str]:
    """The html of at most ``most`` pages: those whose ids hash lowest."""
    ids = [r[0] for r in pages.where(F.col(page_id).isNotNull()).select(page_id).distinct().orderBy(F.xxhash64(page_id), page_id).limit(most).collect()]
    return [r[0] or "" for r in pages.where(F.col(page_id).isin(ids)).select(html, page_id).orderBy(page_id).limit(most).collect()] if ids else []


def extracted(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(trained(sampled(pages, page_id, html, sample_pages)))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        found: list[str] = []
        source = batch.column(2).to_pylist()
        for a in range(0, len(source), 100):
            found += texts([x or "" for x in source[a : a + 100]], shared.value)
        yield {"page_id": batch.column(0), "url": batch.column(1), "text": found, "n_chars": list(map(len, found))}

    slim = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return map_rows(slim, "page_id bigint, url string, text string, n_chars bigint", run)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
