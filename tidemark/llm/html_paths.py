"""HTML extraction by tag-path ratios.

A page becomes a tree of its block elements and a list of text blocks, each with the tag path from the root to its leaf.
Per path the text length outside links and the punctuation are summed and divided by the path's number of blocks; both
ratios are smoothed over the blocks in page order and fused by product. A path's score is the geometric mean of its own
and its smoothed value; paths whose score reaches a fifth of the scores' mean, weighted by text length, are content
paths, and content blocks are those on them.

The outermost article or main elements that hold at least a quarter as much content as the one with the most are the
article; their headings and lists are given, and of their other blocks those on content paths and those that are not
mostly links. A page without such elements gives its content blocks, prose elements, lists and other blocks beside them
in one container, headings between them, and the last title before them; a short line of rights at the very end goes.

What lies in clutter is in no list: menus, footers, sidebars, forms, hidden elements, by tag or role; and adverts,
notices, comments and the like by class or id, unless the element holds half of the page's prose. Some words mark
clutter at either end of a name, others only where the whole name speaks of it (`share-buttons`, not `market-share`).
Inline elements are hidden by no class. `noscript` counts inside an article only.

Each page stands alone, so the job is one map without a shuffle, and a page takes time in proportion to its length:
elements nested deeper than DEPTH are laid side by side there, as browsers do. Edge cases: null, empty or text-free html
gives an empty text; unclosed and misnested tags close as browsers close them; a quote that is never closed ends at the
tag's '>'; rows with a null page_id go, of rows that repeat a page_id the least stays.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidemark.llm._common import keyed, lean

DEPTH = 512
# Fixed values of the HTML standard.
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title template iframe svg select".split())
_KEEPS_P = frozenset("body button caption dd dt head html legend li optgroup option tbody td tfoot th thead tr".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_WITHIN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"optgroup"}}
_TABLE = frozenset("table tbody thead tfoot tr td th caption".split())
_SCOPE = frozenset("table td th caption".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PROSE = frozenset("p li dt dd td th caption figcaption blockquote pre summary".split())
_LISTED = frozenset("li dt dd".split())
_FRAMES = frozenset("ul ol dl li table tbody thead tfoot tr td th blockquote figure".split())
# Words that mark clutter.
_CLUTTER_TAGS = frozenset("nav footer aside menu button dialog head search".split())
_CLUTTER_ROLES = frozenset("navigation banner complementary contentinfo search dialog alert form menu menubar".split())
_CLUTTER_WORDS = frozenset(
    "ad ads advert adverts advertisement breadcrumb breadcrumbs comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar newsletter pagination popup promo sidebar signup sponsored subscribe toolbar topbar widget widgets".split()
)
# These mark clutter too, where a name holds nothing but such words, numbers and words for parts: share-buttons, but not market-share.
_ALONE_WORDS = frozenset("comment copyright navigation notice overlay pager promoted promotion recommended related replies respond share sharing skip social sponsor subscription teaser teasers".split())
_PART_WORDS = frozenset(
    "area articles author bar block body bottom box btn button buttons container content count follow form group header icon icons inner item items left line link links list main meta more node outer panel post posts print reply right row section stories text thread title to top tools wrap wrapper".split()
)
_OUTSIDE_WORDS = frozenset("banner header search".split())  # clutter only outside of articles
_ARTICLE_WORDS = frozenset("article blog body chapter content entry news page-title post section story text title".split())
_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|[!?]|/)")
_STOP = re.compile(r">|=\s*([\"'])")
_ATTR = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|aria-hidden|style)(?![^\s=/])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORDS = re.compile(r"[a-z0-9]+")
_PUNCT = re.compile(r"[.,;:!?…。、，；：！？]")
_RIGHTS = re.compile(r"(?:©|\(c\)\s|copyright\s*(?:©|\(c\)|\d{4}))", re.I)


def _clutter(tag: str, attributes: str, inside: bool) -> int:
    """2 for an element that is clutter, 1 for one that is unless it holds most of the prose, 0 for others."""
    if tag in _CLUTTER_TAGS or tag == "header" and not inside:
        return 2
    kind = int(tag == "form")
    if not attributes or tag in ("html", "body", "main"):
        return kind
    for name, a, b, c in _ATTR.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "role" and value in _CLUTTER_ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return 2
        if name in ("class", "id") and tag not in _HEADINGS:
            for one in value.split():
                words = _WORDS.findall(one)
                ends = {words[0], words[-1]} if words else set()
                alone = any(w in _ALONE_WORDS for w in words) and all(w in _ALONE_WORDS or w in _PART_WORDS or w in _CLUTTER_WORDS or w.isdigit() for w in words)
                if ends & _CLUTTER_WORDS or alone or not inside and not _OUTSIDE_WORDS.isdisjoint(words) and _ARTICLE_WORDS.isdisjoint(words):
                    kind = 1
    return kind


class Block(NamedTuple):
    node: int
    text: str
    linked: int  # characters inside links


class Page:
    """Block elements (tag, parent, path, clutter, by number) and text blocks of a page."""

    def __init__(self, page: str):
        self.tag, self.parent, self.path, self.mark = [""], [-1], [0], [0]
        self.blocks: list[Block] = []
        self._paths: dict[tuple[int, str], int] = {}
        self._stack: list[int] = [0]
        self._open: Counter = Counter()
        self._over: Counter = Counter()
        self._parts: list[str] = []
        self._linked = 0
        self._link = -1  # depth at which a link was opened
        self._hidden = ("", 0, 0)  # inline element whose text is hidden: tag, how many are open, depth
        self._read(page)

    def _flush(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                self.blocks.append(Block(self._stack[-1], text, self._linked))
            self._parts.clear()
        self._linked = 0

    def _add(self, text: str) -> None:
        if text and not self._hidden[1]:
            text = html.unescape(text)
            self._parts.append(text)
            if self._link >= 0:
                self._linked += len(text.strip())

    def _push(self, tag: str, mark: int) -> None:
        self._flush()
        if len(self._stack) > DEPTH:
            self._over[tag] += 1
            return
        top = self._stack[-1]
        self._stack.append(len(self.tag))
        self.tag.append(tag)
        self.parent.append(top)
        self.path.append(self._paths.setdefault((self.path[top], tag), len(self._paths) + 1))
        self.mark.append(mark)
        self._open[tag] += 1

    def _pop_to(self, depth: int) -> None:
        self._flush()
        for k in self._stack[depth:]:
            self._open[self.tag[k]] -= 1
        del self._stack[depth:]
        self._over.clear()
        if self._link > depth:
            self._link = -1
        if self._hidden[2] > depth:
            self._hidden = ("", 0, 0)

    def _up(self, tags: set[str] | frozenset[str], within: set[str] | frozenset[str]) -> int:
        """Depth of the nearest open element of the tags below those within; 0 for none."""
        if any(self._open[t] for t in tags):
            for depth in range(len(self._stack) - 1, 0, -1):
                tag = self.tag[self._stack[depth]]
                if tag in tags:
                    return depth
                if tag in within:
                    break
        return 0

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br" or tag in _VOID:
            if tag == "hr":
                self._flush()
            self._add(" ")
            return
        inside = bool(self._open["article"] or self._open["main"])
        if tag not in _BLOCK:
            if tag == "a":
                self._link = len(self._stack)
            if self._hidden[0] == tag:
                self._hidden = (tag, self._hidden[1] + 1, self._hidden[2])
            elif not self._hidden[1] and attributes and _clutter(tag, attributes, inside) == 2:  # no inline prose is hidden by a class
                self._hidden = (tag, 1, len(self._stack))
            return
        if tag not in _KEEPS_P and self.tag[self._stack[-1]] == "p":
            self._pop_to(len(self._stack) - 1)
        elif tag in _CLOSES and (depth := self._up(_CLOSES[tag], _WITHIN[tag])):
            self._pop_to(depth)
        if tag in ("html", "body") and self._open[tag]:
            return
        if tag == "body" and self._open["head"]:
            self._pop_to(self._up({"head"}, frozenset()))
        self._push(tag, _clutter(tag, attributes, inside and (tag != "article" or self._open["article"] > 0)) if tag != "article" or self._open["article"] else 0)

    def _end(self, tag: str) -> None:
        if tag not in _BLOCK:
            if tag == "a":
                self._link = -1
            if tag == self._hidden[0] and self._hidden[1]:
                self._hidden = (tag, self._hidden[1] - 1, self._hidden[2]) if self._hidden[1] > 1 else ("", 0, 0)
            if tag == "br":
                self._add(" ")
        elif self._over[tag] > 0:
            self._flush()
            self._over[tag] -= 1
        elif depth := self._up({tag}, (_WITHIN.get(tag, set()) if tag != "p" else _BLOCK) if tag in _TABLE | {"li", "p"} else _SCOPE):
            self._pop_to(depth)

    def _read(self, page: str) -> None:
        last = {q: page.rfind(q) for q in "\"'"}
        at, raw = 0, {}
        while m := _OPEN.search(page, at):
            self._add(page[at : m.start()])
            name = m[2]
            if not name:
                mark = m[0]
                end = page.find("-->", m.end()) if mark == "<!--" else page.find(">", m.end())
                at = len(page) if end < 0 else end + (3 if mark == "<!--" else 1)
                continue
            tag, to = name.lower(), m.end()
            while stop := _STOP.search(page, to):
                if stop[0] == ">":
                    to = stop.end()
                    break
                if stop.end() > last[stop[1]]:  # never closed
                    end = page.find(">", stop.end())
                    to = len(page) if end < 0 else end + 1
                    break
                to = page.index(stop[1], stop.end()) + 1
            else:
                break  # the page ends inside a tag
            attributes = page[m.end() : to - 1]
            at = to
            if m[1]:
                self._end(tag)
            elif tag in _RAW or tag == "noscript" and not (self._open["article"] or self._open["main"]):
                if tag not in raw:
                    raw[tag] = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I)
                end = raw[tag].search(page, at)
                at = end.end() if end else len(page)
            else:
                self._start(tag, attributes)
        else:
            self._add(page[at:])
        self._flush()


def _smoothed(values: np.ndarray) -> np.ndarray:
    """A binomial window of five blocks, cut at the ends."""
    weight = np.array([1.0, 4.0, 6.0, 4.0, 1.0])
    return np.convolve(values, weight, "same") / np.convolve(np.ones(len(values)), weight, "same") if len(values) >= 5 else values


def content_blocks(path: np.ndarray, blocks: list[Block], share: float = 0.2) -> np.ndarray:
    """Whether each block is on a path whose fused ratios reach that share of their weighted mean."""
    _, which = np.unique(path, return_inverse=True)
    free = np.array([max(0, len(b.text) - b.linked) for b in blocks], float)
    points = np.array([len(_PUNCT.findall(b.text)) for b in blocks], float)
    count, length = np.bincount(which), np.bincount(which, free)
    by_length, by_points = length / count, np.bincount(which, points) / count
    fused = _smoothed(by_length[which]) * (_smoothed(by_points[which]) + 0.1)
    score = np.sqrt(np.bincount(which, fused) / count * by_length * (by_points + 0.1))
    if not (score > 0).any():
        return np.ones(len(blocks), bool)
    return (score >= share * np.average(score, weights=length))[which]


def _below(values: np.ndarray, parent: list[int]) -> np.ndarray:
    """Sums over each element and all inside it; parents come before their children."""
    total = values.tolist()
    for k in range(len(total) - 1, 0, -1):
        total[parent[k]] += total[k]
    return np.array(total)


def extract(text: str | None) -> str:
    """Main text of one page."""
    page = Page(text or "")
    n = len(page.tag)
    dark = [False] * n

    def darkened(soft: np.ndarray | None) -> None:
        for k in range(1, n):
            dark[k] = dark[page.parent[k]] or page.mark[k] == 2 or soft is not None and page.mark[k] == 1 and not soft[k]

    def mass(blocks: list[Block]) -> np.ndarray:
        return _below(np.bincount([b.node for b in blocks], [max(0, len(b.text) - b.linked) for b in blocks], n), page.parent)

    darkened(None)
    prose = mass([b for b in page.blocks if not dark[b.node]]) if page.blocks else np.zeros(n)
    darkened(prose > 0.5 * prose[0])
    found = [b for b in page.blocks if not dark[b.node]]
    if not found:
        return ""
    content = content_blocks(np.array([page.path[b.node] for b in found]), found)
    held = mass([b for b, c in zip(found, content, strict=True) if c])
    article = [0] * n  # the outermost article or main element around each
    for k in range(1, n):
        article[k] = article[page.parent[k]] or (k if page.tag[k] in ("article", "main") else 0)
    tops = {k for k in set(article) - {0} if held[k] > 0}
    tops = {k for k in tops if 4 * held[k] >= max(held[x] for x in tops)} if 2 * sum(held[k] for k in tops) >= held[0] else set()
    few_links = [b.linked * 2 <= len(b.text) for b in found]
    if tops:
        kept_tags = _HEADINGS | _LISTED
        return "\n\n".join(b.text for b, c, f in zip(found, content, few_links, strict=True) if article[b.node] in tops and (c or f or page.tag[b.node] in kept_tags))

    def container(node: int) -> int:
        """The element around a block, past lists, tables and quotes."""
        node = page.parent[node]
        while page.tag[node] in _FRAMES:
            node = page.parent[node]
        return node

    beside = {container(b.node) for b, c in zip(found, content, strict=True) if c}
    places = np.flatnonzero(content)
    titles = [i for i in range(places[0]) if page.tag[found[i].node] in _HEADINGS]
    main = [i for i in titles if page.tag[found[i].node] == "h1"] or titles
    start = main[-1] if main else places[0]
    kept = []
    for i, b in enumerate(found):
        tag, around = page.tag[b.node], container(b.node)
        if content[i]:
            keep = True
        elif tag in _HEADINGS:
            keep = places[0] < i < places[-1] or i in main[-1:]
        elif around not in beside or not few_links[i]:
            keep = False
        else:
            keep = tag in _PROSE or i > start and (i < places[-1] or page.tag[around] not in ("", "html", "body"))
        if keep and not (i == len(found) - 1 and len(b.text) < 200 and _RIGHTS.match(b.text)):
            kept.append(b.text)
    return "\n\n".join(kept)


@lean
def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        text = [extract(x) for x in batch.html]
        yield pd.DataFrame({"page_id": batch.page_id, "url": batch.url, "text": text, "n_chars": [len(t) for t in text]})


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    rows = keyed(pages, "page_id", "url", "html")
    return rows.mapInPandas(_run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
