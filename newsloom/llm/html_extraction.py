"""Main text of web pages: boosted trees over DOM nodes, decoded from the root down.

Every element, and every run of text beside block elements, is a node with features of its markup,
its text, its subtree and its place among its siblings. The trees say how likely a node holds main
text. Decoding keeps or drops whole subtrees by best total likelihood: a kept node has a kept parent and
all that is under a dropped one is dropped, so ancestors and descendants never contradict each other.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.gbt import Boosted
from newsloom.llm.html_pages import NOISE, Writer

#: Invented pages that the model is fitted on.
TRAINING_PAGES = 500
TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)>""")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
TOKEN = re.compile(r"[a-z]+|[A-Z][a-z]*")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed".split())
BLOCK = frozenset(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template tfoot th thead tr ul caption button script style title textarea iframe".split()
)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
TAG_SETS = [
    {"p"}, {"h1"}, {"h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "dl", "menu"}, {"li", "dd", "dt"}, {"table", "tbody", "thead", "tr", "td", "th", "caption"},
    {"nav"}, {"header"}, {"footer"}, {"aside"}, {"form", "input", "button", "select", "option", "textarea", "label", "fieldset", "legend"},
    {"article"}, {"main"}, {"section"}, {"div"}, {"html", "body"}, {"blockquote", "pre"}, {"figure", "figcaption"},
    {"script", "style", "template", "noscript", "iframe", "head", "title", "svg", "object"}, {"#text"}, {"dialog", "details", "summary", "address"},
]
TOKEN_SETS = [
    {"content", "article", "post", "entry", "main", "body", "text", "story"},
    {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "crumbs", "pager", "pagination"},
    {"header", "masthead", "top", "banner", "head"},
    {"footer", "copyright", "legal", "bottom", "foot", "colophon"},
    {"sidebar", "side", "aside", "widget", "complementary", "trending", "rail"},
    {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsored", "sponsor", "promo", "promotion", "adsense"},
    {"cookie", "cookies", "notice", "consent", "alert", "popup", "modal", "newsletter", "subscribe", "subscription", "paywall", "gdpr", "overlay", "toast"},
    {"comment", "comments", "reply", "replies", "discussion", "responses", "respond", "disqus", "reader"},
    {"share", "sharing", "social", "toolbar", "button", "buttons", "follow"},
    {"related", "recommended", "recommendations", "more", "popular", "tags", "tag", "categories", "labels"},
    {"hidden", "none"},
    {"search", "login", "signup", "form"},
]
BAD_TAGS = TAG_SETS[6] | TAG_SETS[7] | TAG_SETS[8] | TAG_SETS[9] | TAG_SETS[10] | TAG_SETS[18]


class Page:
    """Nodes in page order: parent, tag, attribute tokens, depth, and pieces of text by node."""

    def __init__(self, source: str):
        self.parent, self.tag, self.tokens = [-1], ["#root"], [frozenset()]
        self.pieces: list[tuple[int, str, int]] = []
        self.begun = 0
        self._read(source)
        self._split()

    def _open(self, tag: str, attributes: str) -> int:
        found: set[str] = set()
        for name, value in ATTRIBUTE.findall(attributes) if attributes.strip() else ():
            name = name.lower()
            if name in ("class", "id", "role", "itemprop", "aria-label"):
                found.update(t.lower() for t in TOKEN.findall(value))
            elif name in ("hidden", "aria-hidden") and "false" not in value or name == "style" and "none" in value:
                found.add("hidden")
        self.begun += tag in BLOCK
        self.parent.append(self.stack[-1])
        self.tag.append(tag)
        self.tokens.append(frozenset(found))
        return len(self.tag) - 1

    def _push(self, node: int) -> None:
        self.places.setdefault(self.tag[node], []).append(len(self.stack))
        if self.tag[node] in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def _cut(self, place: int) -> None:
        """Close the open element at that place of the stack and all in it."""
        for node in reversed(self.stack[place:]):
            self.places[self.tag[node]].pop()
            if self.tag[node] in BLOCK:
                self.blocks.pop()
        del self.stack[place:]

    def _top(self, names: set[str]) -> int:
        """The highest place of an open element of one of the names, or 0."""
        return max((self.places[t][-1] for t in names if self.places.get(t)), default=0)

    def _pop_to(self, names: set[str], barrier: set[str]) -> None:
        while (place := self._top(names)) > self._top(barrier):
            self._cut(place)

    def _read(self, s: str) -> None:
        self.stack: list[int] = [0]
        self.places: dict[str, list[int]] = {}  # of open elements by name: a tag costs no walk over the stack
        self.blocks: list[int] = []
        i, n = 0, len(s)
        lower: str | None = None
        while i < n:
            j = s.find("<", i)
            if j < 0:
                j = n
            if j > i:
                self.pieces.append((self.stack[-1], s[i:j], self.begun))
            if j == n:
                return
            if s.startswith("<!--", j):
                end = s.find("-->", j + 4)
                i = n if end < 0 else end + 3
                continue
            if s.startswith(("<!", "<?"), j):
                end = s.find(">", j)
                i = n if end < 0 else end + 1
                continue
            m = TAG.match(s, j)
            if m is None:
                end = s.find(">", j) if s[j + 1 : j + 2].isalpha() or s[j + 1 : j + 2] == "/" else -2
                if end == -2:  # a bare less-than sign
                    self.pieces.append((self.stack[-1], "<", self.begun))
                    i = j + 1
                else:
                    i = n if end < 0 else end + 1
                continue
            tag, i = m[1].lower(), m.end()
            if s[j + 1] == "/":
                place = self._top({tag})
                if tag in ("br", "p") and not place:
                    self.pieces.append((self.stack[-1], " ", self.begun))
                elif place and (tag in BLOCK or not self.blocks or self.blocks[-1] < place):
                    self._cut(place)
                    self.begun += tag in BLOCK
                continue
            if tag == "br":
                self.pieces.append((self.stack[-1], " ", self.begun))
                continue
            if tag in BLOCK and tag not in ("html", "head"):
                self._pop_to({"p"}, {"td", "th", "table", "button", "object", "body"})
            if tag in CLOSES:
                self._pop_to(*CLOSES[tag])
            node = self._open(tag, m[2])
            if tag in RAW and not m[2].endswith("/"):
                lower = lower if lower is not None else s.lower()
                if len(lower) != n:  # lower case changed the length: search by pattern
                    hit = re.compile(f"</{re.escape(tag)}", re.I).search(s, i)
                    end = hit.start() if hit else -1
                else:
                    end = lower.find(f"</{tag}", i)
                self.pieces.append((node, s[i:end] if end >= 0 else s[i:], self.begun))
                close = s.find(">", end) if end >= 0 else -1
                i = n if close < 0 else close + 1
            elif tag not in VOID and not m[2].endswith("/"):
                self._push(node)

    def _split(self) -> None:
        """Fold inline elements into their block; neighbouring text of one block is one run."""
        n = len(self.tag)
        host, linked = list(range(n)), [False] * n
        for k in range(1, n):
            if self.tag[k] not in BLOCK:
                host[k] = host[self.parent[k]]
            linked[k] = self.tag[k] == "a" or linked[self.parent[k]]
        self.host, self.holds = host, {host[self.parent[k]] for k in range(1, n) if self.tag[k] in BLOCK}
        self.runs: list[list] = []  # block node, pieces, linked characters, blocks begun before it
        for k, t, begun in self.pieces:
            h, a = host[k], len(t) if linked[k] else 0
            if self.runs and self.runs[-1][0] == h and self.runs[-1][3] == begun:
                self.runs[-1][1].append(t)
                self.runs[-1][2] += a
            else:
                self.runs.append([h, [t], a, begun])

    def tree(self):
        """(parent, tag, tokens, text, linked characters, places) of block nodes and text runs beside blocks.

        Parents come before their children. places: (node, text) of every text in page order.
        """
        index: dict[int, int] = {}
        parent, tag, tokens, text, linked = [], [], [], [], []
        for k in range(len(self.tag)):
            if self.host[k] == k:
                index[k] = len(parent)
                parent.append(index[self.host[self.parent[k]]] if k else -1)
                tag.append(self.tag[k])
                tokens.append(self.tokens[k])
                text.append("")
                linked.append(0)
        places: list[tuple[int, str]] = []
        for h, parts, a, _ in self.runs:
            t = " ".join(html.unescape("".join(parts)).split())
            if not t:
                continue
            i = index[h]
            if h in self.holds:
                parent.append(i)
                tag.append("#text")
                tokens.append(frozenset())
                i = len(parent) - 1
                text.append(t)
                linked.append(a)
            else:
                text[i], linked[i] = t, a
            places.append((i, t))
        return parent, tag, tokens, text, linked, places


@lru_cache(maxsize=10_000)
def _flags(tag: str, tokens: frozenset) -> tuple[list[float], bool, bool]:
    """Indicators of a node's markup; whether it speaks against or for main text."""
    t, k = [float(tag in s) for s in TAG_SETS], [float(not s.isdisjoint(tokens)) for s in TOKEN_SETS]
    return t + k, any(k[1:]) or tag in BAD_TAGS, bool(t[11] or t[12] or k[0])


UP = [{"article", "main"}, {"nav", "aside", "footer", "header"}, {"form", "button", "noscript", "head"}, {"li", "ul", "ol"}]


def features(parent, tag, tokens, text, linked) -> np.ndarray:
    """[nodes, features] of one page's tree: markup of the node and its parent, ancestors, text, siblings."""
    n = len(parent)
    marks = [_flags(t, k) for t, k in zip(tag, tokens, strict=True)]
    own = [len(t) for t in text]
    words = [t.count(" ") + 1 if t else 0 for t in text]
    stops = [t.count(".") + t.count("!") + t.count("?") if t else 0 for t in text]
    paras = [int(t == "p") for t in tag]
    tot, link, sub = own[:], list(linked), [1] * n
    depth, kids, nth, up = [0] * n, [0] * n, [0] * n, [(0, 0, 0, 0, 0, 0)] * n
    for k in range(1, n):
        p = parent[k]
        depth[k], nth[k] = depth[p] + 1, kids[p]
        kids[p] += 1
        u, t = up[p], tag[p]
        up[k] = (u[0] or t in UP[0], u[1] or t in UP[1], u[2] or t in UP[2], u[3] or t in UP[3], u[4] or marks[p][1], u[5] or marks[p][2])
    for k in range(n - 1, 0, -1):
        p = parent[k]
        for a in (tot, link, sub, paras, words, stops):
            a[p] += a[k]
    peers, best = [0] * n, [0] * n
    for k in range(1, n):
        p = parent[k]
        peers[p] += tot[k]
        best[p] = max(best[p], tot[k])
    par = np.maximum(np.array(parent), 0)
    flags = np.array([m[0] for m in marks])
    tot, link, sub, paras, words, stops, own, depth, kids, nth, peers, best = (np.array(x, float) for x in (tot, link, sub, paras, words, stops, own, depth, kids, nth, peers, best))
    one = np.maximum(tot, 1)
    nums = [depth, np.log1p(tot), tot / one[0], link / one, tot / sub, np.log1p(sub), np.log1p(paras), words / np.maximum(stops, 1), tot / np.maximum(words, 1), stops / one * 100]
    nums += [np.log1p(kids[par]), nth / np.maximum(kids[par], 1), (peers[par] - tot) / one[0], tot / np.maximum(best[par], 1), paras / max(paras[0], 1), np.log1p(own), [m[1] for m in marks], [m[2] for m in marks]]
    above = flags[par]
    above[0] = 0
    return np.concatenate([flags, above, np.array(up, float), np.array(nums, float).T], axis=1)


def decode(parent, log_odds: np.ndarray) -> np.ndarray:
    """Which nodes to keep: best total log likelihood over choices where a kept node's parent is kept."""
    n = len(parent)
    yes, no = -np.logaddexp(0, -log_odds), -np.logaddexp(0, log_odds)
    keep, drop = yes.copy(), no.copy()
    for k in range(n - 1, 0, -1):
        keep[parent[k]] += max(keep[k], drop[k])
        drop[parent[k]] += drop[k]
    out = np.zeros(n, bool)
    out[0] = True
    for k in range(1, n):
        out[k] = out[parent[k]] and keep[k] > drop[k]
    return out


MARK = "⁣"


def _marked(page: list[tuple[str, bool]]):
    """The tree of a written page, and by node and by text whether it is main text."""
    source = "".join(re.sub(r">([^<]+)", rf">{MARK}\1", p) if main else p for p, main in page)
    parent, tag, tokens, text, linked, places = Page(source).tree()
    main = np.array([MARK in t for t in text], float)
    text, places = [t.replace(MARK, "") for t in text], [(i, t.replace(MARK, ""), MARK in t) for i, t in places]
    return parent, tag, tokens, text, linked, main, places


def training_nodes(pages: int = TRAINING_PAGES, seed: int = 7, noise: tuple[str, ...] = NOISE) -> tuple[np.ndarray, np.ndarray]:
    """Features and targets of the nodes of invented pages: a node's target is whether its subtree holds main text."""
    xs, ys = [], []
    for k in range(pages):
        parent, tag, tokens, text, linked, y, _ = _marked(Writer(seed * 100_003 + k, noise).page())
        for i in range(len(parent) - 1, 0, -1):
            y[parent[i]] = max(y[parent[i]], y[i])
        xs.append(features(parent, tag, tokens, text, linked))
        ys.append(y)
    return np.concatenate(xs), np.concatenate(ys)


def measured(trees: Boosted, pages: int, seed: int, noise: tuple[str, ...] = NOISE) -> tuple[float, float]:
    """(precision, recall) of the characters kept of written pages."""
    kept = right = wanted = 0
    for k in range(pages):
        parent, tag, tokens, text, linked, _, places = _marked(Writer(seed * 100_003 + k, noise).page())
        choice = decode(parent, trees.log_odds(features(parent, tag, tokens, text, linked)))
        for i, t, main in places:
            kept += len(t) * choice[i]
            right += len(t) * (choice[i] and main)
            wanted += len(t) * main
    return right / max(1, kept), right / max(1, wanted)


@lru_cache(maxsize=1)
def model(pages: int = TRAINING_PAGES) -> Boosted:
    return Boosted().fit(*training_nodes(pages))


def main_text(source: str | None, trees: Boosted) -> str:
    """The main text of one page; blocks in page order, one space between."""
    if not source or not source.strip():
        return ""
    parent, tag, tokens, text, linked, places = Page(source).tree()
    if not places:
        return ""
    kept = decode(parent, trees.log_odds(features(parent, tag, tokens, text, linked)))
    return " ".join(t for i, t in places if kept[i])


def _extracted(batches: Iterator[pa.RecordBatch], trees: Boosted) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        pages = [Page(s).tree() if s and s.strip() else None for s in batch.column(2).to_pylist()]
        some = [p for p in pages if p is not None and p[5]]
        x = [features(*p[:5]) for p in some]
        odds = trees.log_odds(np.concatenate(x)) if x else np.empty(0)
        cut = np.concatenate([[0], np.cumsum([len(f) for f in x])]).astype(int)
        chosen = {id(p): decode(p[0], odds[a:b]) for p, a, b in zip(some, cut, cut[1:], strict=False)}
        for p in pages:
            kept = chosen.get(id(p))
            out.append("" if kept is None else " ".join(t for i, t in p[5] if kept[i]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", training_pages: int = TRAINING_PAGES) -> DataFrame:
    """page_id, url, text for every row of pages.

    A null, empty or blank page has an empty text, and so has a page without main text. Character
    references are decoded, white space inside a block becomes one space, blocks are joined by one
    space. Broken markup is read as far as it goes; very long pages are read whole; repeated rows get
    a row each. The model (some kilobytes) is fitted on ``training_pages`` invented pages.
    """
    trees = model(training_pages)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(lambda it: _extracted(it, trees), "page_id long, url string, text string")
