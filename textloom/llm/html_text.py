"""Main text of HTML pages by tree scoring.

A page becomes a tree. What cannot be article by its tag, role or being hidden (scripts, menus, forms, asides, footers)
goes; what its class or id calls an advert, a sidebar, comments and so on goes too, unless most of the page's text lies
there. Each paragraph then gives points, by its length and commas, to its ancestors, halved at each level; a container's
points are discounted by the share of its text in links. The best container is kept whole; if it lies in a marked-up
article, that is the container. Around a container that is not so marked, siblings are kept by their text against
their links: headings, paragraphs, lists and parts with paragraphs beside it, and further up what holds a fifth of its
points. Blocks mostly of links at the edges of such a container are menus and go.

Every step is a pass over the page or over its elements, so that a page of any size takes time in proportion. A tag
whose quotes do not close ends at its first `>`, as do all tags after it.

Defined cases: a null or empty page has an empty text, as one without any block; unclosed and stray tags are taken as
browsers take them in the main; deep nesting is walked without recursion; ties go to the element that comes first. Rows
are only mapped: repeated rows, null ids and further columns have no effect, and only page_id, url and html are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe noframes xmp svg math".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_GONE = frozenset("script style noscript template head title nav footer aside form button select option input textarea label fieldset iframe object embed svg math canvas audio video dialog menu".split())
_GONE_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
_PARAGRAPH = frozenset(("p", "pre", "td", "blockquote", "li", "dd"))
#: Elements that are paragraphs if they have text of their own.
_LOOSE_PARAGRAPH = frozenset(("div", "section", "article", "main", "body", "span", "center", "figcaption"))
#: Elements that are menus where they hold links and little else.
_GROUP = frozenset(("ul", "ol", "dl", "table", "div", "section", "p", "center"))
#: Words of class and id that name what is no article, whatever its size.
_COMMENT_NAME = frozenset("comment comments commentlist disqus reply replies respond responses".split())
#: Words that name it unless nearly all of the page's text lies there.
_GONE_NAME = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense breadcrumb breadcrumbs consent cookie cookies footer gdpr masthead menu menus modal nav navbar navigation navigator newsletter pager pagination popup promo promos promotion sidebar sidebars signup sponsor sponsored subscribe subscription toc topbar".split()
)
#: Words that stand in names of articles as well: they count unless half of the page's text lies there.
_WEAK_NAME = frozenset("banner notice notices notification overlay recommended related share shares sharing skip social toolbar widget widgets".split())
#: A name with one of these words says what is not there, or what stands beside.
_NOT = frozenset("free has no non off with without".split())
_GOOD_NAME = frozenset("article body content entry main post story text".split())
_TAG_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
#: What may stand in a tag after its name: anything but a lone quote.
_TAG_REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")
#: One attribute after the other, whole, so that no name is looked for in a value or in part of another name.
_ATTR = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|["'].*+|([^\s>]*+)))?""", re.S)
_ATTRS = frozenset("class id role hidden aria-hidden style".split())
_WORDS = re.compile(r"[a-z0-9]+")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_COMMAS = re.compile("[,，、،]")
#: An open element of the second group that its like closes, up to one of the list's own.
_SCOPE = {"li": "list", "ul": "list", "ol": "list", "menu": "list", "dt": "terms", "dd": "terms", "dl": "terms", "td": "cells", "th": "cells", "tr": "cells", "table": "cells", "option": "options", "select": "options"}
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "option": ("option",)}
#: Levels that a paragraph's points reach.
LEVELS = 5
MARKED_BONUS, NAME_BONUS, BLOCK_BONUS = 25.0, 10.0, 2.0


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "cut", "dead", "chars", "linked", "links", "commas", "own", "worth", "mass", "points", "marked", "heads", "edges")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.cut = self.dead = False
        self.points = 0.0
        self.edges: tuple[int, int] | None = None


def parse(html: str) -> list[Node]:
    """The page's elements in order, the root first."""
    root = Node("#root", {}, None)
    nodes, stack = [root], [root]
    count: dict[str, int] = {}
    scopes: dict[str, list[str]] = {"list": [], "terms": [], "cells": [], "options": []}
    low, end, pos, loose = html.lower(), len(html), 0, False
    if len(low) != end:  # a letter whose lower case is longer would shift places
        low = "".join(c if len(d := c.lower()) != 1 else d for c in html)

    def close_to(tags: tuple[str, ...]) -> None:
        while True:
            tag = stack.pop().tag
            count[tag] -= 1
            if tag in _SCOPE:
                scopes[_SCOPE[tag]].pop()
            if tag in tags:
                return

    while pos < end:
        lt = html.find("<", pos)
        if lt < 0:
            stack[-1].children.append(html[pos:])
            break
        if lt > pos:
            stack[-1].children.append(html[pos:lt])
        if html.startswith("<!--", lt):
            close = html.find("-->", lt + 4)
            pos = end if close < 0 else close + 3
            continue
        if html.startswith(("<!", "<?"), lt):
            close = html.find(">", lt)
            pos = end if close < 0 else close + 1
            continue
        m = _TAG_NAME.match(html, lt + 1)
        gt = -1
        if m and not loose:
            gt = _TAG_REST.match(html, m.end()).end()
            if gt == end or html[gt] != ">":
                loose, gt = True, -1
        if m and gt < 0:
            gt = html.find(">", m.end())
        if not m or gt < 0:
            stack[-1].children.append("<")
            pos = lt + 1
            if m:  # no tag ends after this
                stack[-1].children.append(html[pos:])
                break
            continue
        pos = gt + 1
        tag, rest = m[2].lower(), html[m.end() : gt]
        if m[1]:
            if count.get(tag, 0):
                close_to((tag,))
            elif tag == "br":
                stack[-1].children.append(Node("br", {}, stack[-1]))
            continue
        # a block ends an open paragraph, which holds no block
        if tag in _BLOCK and count.get("p", 0):
            close_to(("p",))
        if tag in _CLOSES and (scope := scopes[_SCOPE[tag]]) and scope[-1] in _CLOSES[tag]:
            close_to(_CLOSES[tag])
            if tag == "tr" and scope and scope[-1] == "tr":
                close_to(("tr",))
        attrs = {a[1].lower(): unescape(a[2] or a[3] or a[4] or "") for a in _ATTR.finditer(rest) if a[1].lower() in _ATTRS} if rest.strip() else {}
        node = Node(tag, attrs, stack[-1])
        stack[-1].children.append(node)
        nodes.append(node)
        if tag in _RAW and not rest.rstrip().endswith("/"):
            close = low.find(f"</{tag}", pos)
            gt = html.find(">", close) if close >= 0 else -1
            pos = end if gt < 0 else gt + 1
        elif tag not in _VOID:
            stack.append(node)
            count[tag] = count.get(tag, 0) + 1
            if tag in _SCOPE:
                scopes[_SCOPE[tag]].append(tag)
    return nodes


def _is_marked(node: Node) -> bool:
    return node.tag in ("article", "main") or node.attrs.get("role", "").lower() in ("article", "main")


def _tokens(node: Node) -> Iterator[list[str]]:
    for token in f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".lower().split():
        words = _WORDS.findall(token)
        if words and not _NOT.intersection(words):
            yield words


def _is_good(node: Node) -> bool:
    return any(words[-1] in _GOOD_NAME and not (_COMMENT_NAME | _GONE_NAME | _WEAK_NAME).intersection(words) for words in _tokens(node))


def _named(node: Node) -> frozenset[str]:
    """The words of class and id that name what is no article. A compound counts less than a plain name beside it: `story social-story` is a story."""
    good = _is_good(node)
    out: set[str] = set()
    for words in _tokens(node):
        bad = (_COMMENT_NAME | _GONE_NAME | _WEAK_NAME).intersection(words)
        if bad and len(words) > 1 and (good or bad <= _WEAK_NAME and words[-1] in _GOOD_NAME - {"content", "body", "text"} and not bad & {"related", "recommended"}):
            continue
        out |= bad
    return frozenset(out)


def _is_header(node: Node) -> bool:
    return node.tag == "header" or any("header" in words for words in _tokens(node))


def _is_hidden(node: Node) -> bool:
    return "hidden" in node.attrs or node.attrs.get("aria-hidden", "").lower() == "true" or bool(_NO_DISPLAY.search(node.attrs.get("style", "")))


def _is_gone(node: Node, total: float) -> bool:
    """Whether the element is no article, given the worth of the whole page's paragraphs (0 while it is not known: by tag and role alone)."""
    if node.tag == "form" and total:
        return not (node.marked or node.mass >= 0.8 * total and node.heads)
    if node.tag in _GONE and node.tag != "form":
        return True
    if not node.attrs or node.tag in ("html", "body", "#root"):
        return False
    if _is_hidden(node):
        return True
    if not _is_marked(node) and not (total and node.marked) and total and node.attrs.get("role", "").lower() in _GONE_ROLE:
        return True
    if not total:
        return False
    bad = _named(node)
    if not bad:
        return False
    if _is_marked(node):
        return not _is_good(node)
    if node.marked:  # the article lies in it: `page with-menu` is no menu
        return False
    if bad & _COMMENT_NAME:
        return True
    return node.mass < (0.8 if bad & _GONE_NAME else 0.5) * total


def _own_chars(node: Node) -> int:
    return len(" ".join("".join(c if isinstance(c, str) else " " for c in node.children).split()))


def _measure(nodes: list[Node]) -> None:
    """Sums over the parts that are not cut, children before their parents: characters, those in links, links, commas outside
    inner paragraphs, the worth of the element as a paragraph, and of all paragraphs in it."""
    for node in reversed(nodes):
        own = commas = 0
        chars = linked = links = 0
        mass = 0.0
        marked = heads = False
        for c in node.children:
            if isinstance(c, str):
                chars += len(" ".join(c.split()))
                commas += len(_COMMAS.findall(c))
            elif not c.cut and c.tag != "br":
                chars += c.chars
                linked += c.linked
                links += c.links
                mass += c.mass
                marked = marked or c.marked
                heads = heads or c.heads
                if c.tag not in _PARAGRAPH:
                    commas += c.commas
        if node.tag == "a":
            linked, links = chars, 1
        own = _own_chars(node) if node.tag in _LOOSE_PARAGRAPH else 0
        node.chars, node.linked, node.links, node.commas, node.own = chars, linked, links, commas, own
        paragraph = node.tag in _PARAGRAPH or own >= 25
        node.worth = (min(chars / 25, 1.0) + commas + min(chars // 100, 3)) if paragraph and chars else 0.0
        node.mass = mass + node.worth * (1 - linked / chars if chars else 0.0)
        bad = _named(node) if node.attrs else ()
        node.marked = marked or node.tag == "main" or _is_marked(node) and not (bad and not _is_good(node))
        node.heads = heads or node.tag in _HEADING and chars > 0


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def tree(html: str) -> list[Node]:
    """The page's elements that may be article, in order, measured."""
    nodes = parse(html)
    for n in nodes:
        n.cut = _is_gone(n, 0.0)
    _measure(nodes)
    total = nodes[0].mass or 1e-9
    for n in nodes:
        n.cut = n.cut or _is_gone(n, total)
    for n in nodes:
        n.dead = n.cut or n.parent is not None and n.parent.dead
    live = [n for n in nodes if not n.dead]
    _measure(live)
    return live


def score(live: list[Node]) -> Node | None:
    """Points of every element, and the first with most of them; None if there is no paragraph."""
    seen: dict[int, Node] = {}
    for node in live:
        if not node.worth:
            continue
        up, level = (node.parent if node.tag in _PARAGRAPH else node), 0
        while up is not None and up.tag != "#root" and level < LEVELS:
            if id(up) not in seen:
                seen[id(up)] = up
                up.points += MARKED_BONUS if _is_marked(up) else NAME_BONUS if _is_good(up) else BLOCK_BONUS if up.tag in ("div", "section") else 0.0
            up.points += node.worth / 2**level
            up, level = up.parent, level + 1
    best: Node | None = None
    for node in live:
        if id(node) in seen:
            node.points *= 1 - _density(node)
            if best is None or node.points > best.points:
                best = node
    return best


def _is_menu(node: Node) -> bool:
    """Links and little else, in a block that may be a menu."""
    return node.tag in _GROUP and _density(node) >= 0.5 and (node.links > 1 or node.tag != "p")


def _beside(node: Node) -> bool:
    """Whether a sibling of the container belongs to it."""
    if node.tag in _HEADING or node.tag in ("hgroup", "figure"):
        return _density(node) < 0.5
    if node.tag in _PARAGRAPH or node.tag in ("ul", "ol", "dl", "table"):
        return bool(node.chars) and (_density(node) < 0.25 if node.chars > 80 else not node.linked or _density(node) < 0.5 and node.tag == "p")
    return node.mass > 0 and _density(node) < 0.25 and not _is_header(node)


def container(live: list[Node]) -> list[Node]:
    """The best container and what belongs to it, in page order."""
    best = score(live)
    if best is None:
        marked = [n for n in live if _is_marked(n) and n.chars]
        return [max(marked, key=lambda n: n.chars)] if marked else [n for n in live if n.tag == "body"][:1] or live[:1]
    up: Node | None = best
    while up is not None and not _is_marked(up):
        up = up.parent
    if up is not None:
        return [up]
    parts, at, first = [best], best, True
    while at.parent is not None and at.tag not in ("body", "html"):
        siblings = [c for c in at.parent.children if not isinstance(c, str) and not c.dead]
        place = next(i for i, c in enumerate(siblings) if c is at)
        kept = [first and _beside(c) or c.mass >= 0.2 * best.mass and _density(c) < 0.25 and not _is_header(c) or c.tag == "h1" and _density(c) < 0.5 for c in siblings]
        parts = [c for c, k in zip(siblings[:place], kept, strict=False) if k] + parts + [c for c, k in zip(siblings[place + 1 :], kept[place + 1 :], strict=True) if k]
        at, first = at.parent, False
    return parts


def _edges(node: Node) -> tuple[int, int]:
    """The first and last child with text that is not mostly links."""
    if node.edges is None:
        solid = [i for i, c in enumerate(node.children) if (c.strip() if isinstance(c, str) else not c.dead and c.mass > 0 and _density(c) < 0.5)]
        node.edges = (solid[0], solid[-1]) if solid else (len(node.children), -1)
    return node.edges


def _blocks(node: Node) -> Iterator[str]:
    held: list[str] = []
    marked = node.tag == "article" or node.attrs.get("role", "").lower() == "article"
    todo: list[Node | str | None] = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            held.append(unescape(x))
        elif x is None or x.tag in _BLOCK:
            if held and (text := " ".join("".join(held).split())):
                yield text
            held = []
            if x is not None:
                todo.append(None)
                todo += reversed(list(_inside(x, marked)))
        elif x.tag == "br":
            held.append(" ")
        else:
            todo += reversed(list(_inside(x, marked)))
    if held and (text := " ".join("".join(held).split())):
        yield text


def _inside(node: Node, marked: bool) -> Iterator[Node | str]:
    """An element's parts but for what was cut and, outside a marked-up article, headers without a heading and menus at the edges."""
    for i, c in enumerate(node.children):
        if isinstance(c, str) or c.tag == "br":
            yield c
        elif not c.dead and (marked or not (_is_header(c) and not (c.heads and node.tag not in ("body", "html", "#root")) and not _is_marked(node)) and not (_is_menu(c) and not _edges(node)[0] < i < _edges(node)[1])):
            yield c


def main_text(html: str | None) -> str:
    if not html:
        return ""
    return "\n\n".join(b for n in container(tree(html)) for b in _blocks(n))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages(page_id, url, html)."""

    bounded_batches(pages.sparkSession)

    @F.arrow_udf("string")
    def text(html: pa.Array) -> pa.Array:
        return pa.array([main_text(x) for x in html.to_pylist()], pa.string())

    return pages.select("page_id", "url", text(F.col("html")).alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
