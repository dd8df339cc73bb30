"""Main text of web pages by composite text density.

Every block element is a node. Its density is its characters per tag, lowered by the share of link text, and by LOWERED for every node
around it that markup names as menu, header, footer, sidebar, notice, advert, form or comment; the node whose children's
densities add up to most gives the threshold, the least density on the way from it to the body. Under every node that
reaches it the subtree with the largest sum belongs to the article, and so does text that stands there by itself; blocks
below it inside of these, if they are mostly links or lowered, are left out. Class, id or role words around the node with the largest sum, and the same ones
elsewhere, say nothing: they stand on the article. (For that sum words count less than elements.) Names so decide nothing by themselves, only density does.
"""

from __future__ import annotations

import html
import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
#: What is left of the density of text inside a named node; and while the largest sum is looked for, of text inside nodes that words of their class, id or role name.
LOWERED, SUSPECT = 0.02, 0.25
#: Elements and class, id or role words that lower a node's density.
ASIDE = {"nav", "footer", "aside", "form", "button", "select", "option", "svg", "canvas", "object", "audio", "video", "dialog", "menu", "head", "fieldset", "input"}
ASIDE_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "form", "login", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "promoted", "related", "search", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget", "contentinfo", "complementary", "alert"}
HEADER_WORDS = {"header", "masthead"}
ROOTS = {"article", "main"}


class _Node:
    __slots__ = ("tag", "parent", "children", "c", "t", "lc", "lt", "aside", "names", "factor")

    def __init__(self, tag, parent, aside=False, names=""):
        self.tag, self.parent, self.children, self.aside, self.names = tag, parent, [], aside, names
        self.c = self.t = self.lc = self.lt = 0
        self.factor = 1.0


def _names(tag: str, attributes: str, inside_root: bool) -> str:
    """The class, id and role of a node, if a word of theirs is that of an aside."""
    if tag in ROOTS or tag in ("body", "html") or "=" not in attributes:
        return ""
    found = [m[1] or m[2] or m[3] or "" for m in _NAMES.finditer(attributes.lower())]
    words = set(_WORD.findall(" ".join(found)))
    return "|".join(found) if words & ASIDE_WORDS or words & HEADER_WORDS and not inside_root else ""


def parse(page: str) -> _Node:
    """A tree of block elements; strings are text, None a line break. Broken markup closes as browsers do it."""
    root = _Node("body", None)
    stack, at, links, raw_end = [root], 0, 0, {}

    def put(text: str) -> None:
        if text:
            stack[-1].children.append((html.unescape(text), links > 0))

    def close(i: int) -> None:
        del stack[i:]

    pos = 0
    while m := _TOKEN.search(page, pos):
        put(page[at : m.start()])
        at = pos = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                put("")
            continue
        end, attributes = m[1] or m[4], m[3] or m[6] or ""
        if end:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in INLINE:
                pass
            else:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close(i)
                        links = 0
                        break
                    if stack[i].tag in ROOTS and tag not in ("body", "html"):
                        break
            continue
        if tag in RAW:
            pattern = raw_end.setdefault(tag, re.compile(rf"</{tag}\b[^>]*>|\Z", re.I))
            at = pos = pattern.search(page, m.end()).end()
            continue
        if tag == "a":
            links = 1
            stack[-1].lt += 1
            continue
        if tag == "br" or tag == "hr":
            stack[-1].children.append((" ", False))
            continue
        if tag in INLINE or tag in VOID or tag in ("html", "body"):
            continue
        # A block ends an open paragraph; an article ends what wrongly still stands open around it.
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == "p" or tag == "li" and stack[i].tag == "li" or tag in ("td", "th", "tr") and stack[i].tag == tag or tag in ("dt", "dd") and stack[i].tag in ("dt", "dd"):
                close(i)
                break
            if stack[i].tag in ("li", "td", "th", "table", "ul", "ol", "dl", "div", "section", "article", "main"):
                break
        if tag in ROOTS:
            for i in range(1, len(stack)):
                if stack[i].aside or stack[i].names:
                    close(i)
                    break
        links = 0
        within = any(x.tag in ROOTS for x in stack)
        node = _Node(tag, stack[-1], tag in ASIDE or tag == "header" and not within, _names(tag, attributes, within))
        stack[-1].children.append(node)
        if not attributes.rstrip().endswith("/") or tag not in VOID:
            stack.append(node)
    put(page[at:])
    return root


def _walk(root: _Node) -> list[_Node]:
    """All nodes, parents first."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [x for x in reversed(n.children) if isinstance(x, _Node)]
    return out


def _density(n: _Node, body: _Node) -> float:
    """Characters per tag, adjusted for links and for names.

    The published form is C/T log_b(C/LC T/LT) with b = ln(C/(C-LC) LC + LC_body/C_body C + e). It is kept but for three cases, so that
    small nodes do not get boundless or negative densities: without links it is C/T; ln(b) counts as ln(b + 1) and 1 at least; and
    what would fall below 0 is 0.
    """
    if not n.c:
        return 0.0
    t, lc, lt = max(n.t, 1), max(n.lc, 1), max(n.lt, 1)
    if not n.lc:
        return n.factor * n.c / t
    base = math.log(n.c * n.lc / max(n.c - n.lc, 1) + body.lc * n.c / max(body.c, 1) + math.e)
    return n.factor * n.c / t * max(0.0, math.log(n.c / lc * t / lt + 1e-9)) / max(math.log(base + 1), 1.0) if n.lc < n.c else 0.0


def main_text(page: str | None) -> str:
    """The article's text: white space inside a block is one space, blocks are joined by one; empty if there is none."""
    body = parse(page or "")
    nodes = _walk(body)
    for n in reversed(nodes):
        for x in n.children:
            if isinstance(x, _Node):
                n.c, n.t, n.lc, n.lt = n.c + x.c, n.t + x.t + 1, n.lc + x.lc, n.lt + x.lt
            else:
                k = len("".join(x[0].split()))
                n.c += k
                n.lc += k if x[1] else 0
    spoken: set[str] = set()
    for suspect in (SUSPECT, LOWERED):
        left: dict[int, float] = {}
        for n in nodes:
            up = left[id(n.parent)] if n.parent is not None else 1.0
            left[id(n)] = up * LOWERED if n.aside else min(up, suspect) if n.names and n.names not in spoken else up
            n.factor = left[id(n)]
        if suspect == SUSPECT:  # a node counts as much as the text below it
            light: dict[int, float] = {}
            for n in reversed(nodes):
                light[id(n)] = sum(light[id(x)] if isinstance(x, _Node) else n.factor * len("".join(x[0].split())) for x in n.children)
            for n in nodes:
                n.factor = light[id(n)] / n.c if n.c else n.factor
        own = {id(n): _density(n, body) for n in nodes}
        said = lambda n: left[id(n)] * sum(len("".join(x[0].split())) for x in n.children if isinstance(x, tuple) and not x[1])
        sums = {id(n): sum(own[id(x)] for x in n.children if isinstance(x, _Node)) + said(n) for n in nodes}
        best = max(nodes, key=lambda n: sums[id(n)])
        path = [best]
        while path[-1].parent is not None:
            path.append(path[-1].parent)
        spoken |= {n.names for n in path if n.names}
    least = min(own[id(n)] for n in path)
    top: dict[int, _Node] = {}
    for n in reversed(nodes):
        top[id(n)] = max([n, *(top[id(x)] for x in n.children if isinstance(x, _Node))], key=lambda x: sums[id(x)])
    bare = {id(n) for n in nodes if own[id(n)] >= least and said(n) >= max(least, 1)}
    articles = {id(top[id(n)]) for n in nodes if n.c and own[id(n)] >= least}
    parts: list[str] = []
    todo: list = [(body, False)]
    while todo:
        x, inside = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        elif isinstance(x, tuple):
            parts.append(x[0] if inside else " ")
        else:
            inside = id(x) in articles or inside and (own[id(x)] >= least or 2 * x.lc <= x.c and x.factor == 1)
            parts.append(" ")
            todo.append((" ", False))
            todo += [(y, inside or isinstance(y, tuple) and id(x) in bare) for y in reversed(x.children)]
    return " ".join("".join(parts).split())


def extract(pages: DataFrame, page: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """page, url, text and n_chars, one row per row of pages; null and empty pages give an empty text.

    Works row by row, so ties, repeated rows and missing ids need no care; other columns of pages are ignored.
    """
    @F.pandas_udf("string")
    def text_of(h: pd.Series) -> pd.Series:
        return h.map(main_text)

    out = pages.select(F.col(page), F.col(url), text_of(F.col(markup)).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
