from __future__ import annotations

import random
import time
from html import escape

import pytest

from textloom.llm import html_text
from textloom.llm.html_text import extract, main_text, op10_html_text

from .helpers import SF

PARA = "A paragraph of the article, with commas, and of a length that counts."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        (f"<p>{PARA}</p>", PARA),
        (f"<div class=ad>Buy now, buy all, buy more of it today, please.</div><article><h1>T</h1><p>{PARA}<p>Two &amp; &#233;&nbsp;x<br>y</article><footer>Foot</footer>", f"T\n\n{PARA}\n\nTwo & é x y"),
        (f"<body><nav><ul><li><a href=a>Home</a></ul></nav><div id=main><p>{PARA}</p><p>{PARA}</p></div><div class=sidebar><p>{PARA}</p></div></body>", f"{PARA}\n\n{PARA}"),
        (f"<div class='content with-sidebar'><article><p>{PARA}</p></article><aside><p>{PARA}</p></aside></div>", PARA),
        (f"<article><p>{PARA}</p></article><article class=comment><p>{PARA} reply</p></article>", PARA),
        (f"<article><p>{PARA}</p><section id=comments><p>{PARA}</p></section><form><p>{PARA}</p></form></article>", PARA),
        (f"<script>if (a < b) document.write('<p>x</p>')</script><style>p{{}}</style><article><p>{PARA}</p></article>", PARA),
        (f"<article><p>{PARA} a < b and c > d</p><!-- <p>gone</p> --></article>", f"{PARA} a < b and c > d"),
        (f"<article><div><div><p>{PARA}</p></div></div><ul><li>one<li>two</ul></article>", f"{PARA}\n\none\n\ntwo"),
    ],
)
def test_pages(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize(
    "attrs",
    ["title='the hidden cost'", 'title="the hidden cost"', 'data-hidden="false"', 'data-state="hidden"', "data-state=hidden", 'data-id="menu-3"', "data-class=ad", 'title="a class=ad b"', "href=/x/hidden", "x-role = 'menu'", "title = 'id=ad' data-role=dialog"],
)
def test_attributes_are_whole(attrs):
    assert main_text(f"<article {attrs}><p>{PARA}</p><p {attrs}>{PARA}</p></article>") == f"{PARA}\n\n{PARA}"


@pytest.mark.parametrize("attrs", ["hidden", "HIDDEN", "title=x hidden", "title='a'hidden", "hidden=''", "class=ad", "CLASS = 'x ad'", "data-id=x id=menu", "/hidden", "aria-hidden=true", "style='display: none'", "role=dialog"])
def test_exact_attributes_count(attrs):
    assert main_text(f"<article><p>{PARA}</p><p {attrs}>{PARA} gone</p></article>") == PARA


def test_hostile_pages_end():
    assert main_text("<div>" * 20_000 + PARA) == PARA
    for html in ("<" * 100_000, "<a " * 30_000, "<p a='" * 20_000, "&" * 100_000, "<!--" * 30_000, "</p>" * 30_000, "<p>" * 30_000):
        main_text(html)


def test_odd_rows(spark):
    rows = [(1, "u", f"<p>{PARA}</p>"), (1, "u", f"<p>{PARA}</p>"), (None, None, None), (2, None, ""), (3, "u", "<p>" + "long, text " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars", "'y' AS key")
    out = sorted((r.page_id or 0, r.n_chars, r.text == PARA) for r in extract(df).collect())
    assert out == [(0, 0, False), (1, len(PARA), True), (1, len(PARA), True), (2, 0, False), (3, 549_999, False)]
    assert extract(df.limit(0)).count() == 0


def test_every_page_loses_its_frame(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = op10_html_text(spark, SF).collect()
    assert len(found) == len(pages)
    for r in found:
        assert r.n_chars == len(r.text)
        foot = pages[r.page_id].partition("<footer>")[2].partition("</footer>")[0].partition(";")[2][-30:]
        assert r.text and (not foot or foot not in r.text) and "track(" not in r.text


LONG = PARA + " It goes on, in a second sentence, for some time, and in a third, so that it weighs more than any note beside it."
FOUR = f"<p>{LONG}</p>" * 4


@pytest.mark.parametrize(
    ("html", "blocks"),
    [
        (f"<body><div>{FOUR}</div><div><p>Short end.</p></div></body>", [LONG] * 4 + ["Short end."]),
        (f"<body><div>{FOUR}</div><ul><li>{LONG}</li><li>{LONG}</li></ul></body>", [LONG] * 6),
        (f"<body><div>{FOUR}<ul><li>{LONG}</li><li>one</li></ul></div></body>", [LONG] * 5 + ["one"]),
        (f"<body><div><header><h1>Title</h1></header>{FOUR}</div></body>", ["Title"] + [LONG] * 4),
        (f"<body><header><h1>Site</h1></header><div><h1>Title</h1>{FOUR}</div></body>", ["Title"] + [LONG] * 4),
        (f"<body><div class='story social-story'>{FOUR}</div><div class=ad><p>{LONG}</p></div></body>", [LONG] * 4),
        (f"<body><div class='notice-of-death'>{FOUR}</div></body>", [LONG] * 4),
        (f"<body><div class='share'>{FOUR}</div><div class=related><p>{LONG}</p></div></body>", [LONG] * 4),
        ("<body><ul><li><a href=/>Home</a><li><a href=/a>About us now</a></ul><p>One is short.</p><p>Two.</p></body>", ["One is short.", "Two."]),
        (f"<body><div><section><h2>A</h2>{FOUR}</section><section><h2>B</h2><p>Little.</p></section></div></body>", ["A"] + [LONG] * 4 + ["B", "Little."]),
        (f"<body><div>{FOUR}<ul><li><a href=1>One</a><li><a href=2>Two</a></ul><p>{LONG}</p></div></body>", [LONG] * 4 + ["One", "Two", LONG]),
        (f"<form><div class=page>{FOUR}<h2>H</h2></div><input><button>Send</button></form>", [LONG] * 4 + ["H"]),
        (f"<div id=content class=no-sidebar>{FOUR}</div><div class=sidebar><p>{LONG}</p></div>", [LONG] * 4),
        (f"<main>{FOUR}<p><a href=x>More</a></p></main><div><p>{LONG}</p></div>", [LONG] * 4 + ["More"]),
        (f"<div class=comments>{FOUR}{FOUR}</div><div>{FOUR}</div>", [LONG] * 4),
    ],
)
def test_what_belongs_to_the_article(html, blocks):
    assert main_text(html).split("\n\n") == blocks


@pytest.mark.parametrize(
    "html",
    ["<b>" * 20_000 + "</i>" * 20_000, '<a b="' * 20_000, "".join(f"<div>own text of level {i}, and more" for i in range(3000)), "<a'>'" * 30_000 + '"', "<b>" * 10_000 + "<p></p>" * 10_000, "<b>" * 10_000 + "<li></li>" * 10_000, "<table>" + "<tr><td>x" * 10_000, '<div class="' + "ad x-y " * 20_000 + '">', "<ul>" * 10_000 + "<li>x" * 10_000],
)
def test_time_grows_with_the_page(html):
    """Four times the page takes well under sixteen times as long."""

    def seconds(text: str) -> float:
        began = time.process_time()
        main_text(text)
        return time.process_time() - began

    short, whole = min(seconds(html) for _ in range(2)), min(seconds(html * 4) for _ in range(2))
    assert whole < 10 * short + 0.2


def _sentence(draw: random.Random, n: int) -> str:
    return " ".join(draw.choice(("river", "stone", "über", "walks, then", "a & b", "x < y", "thé", "quite")) for _ in range(n)).capitalize() + "."


def _page(draw: random.Random) -> tuple[str, list[str]]:
    """A page without article or main, and its article's blocks."""
    truth, inner = [], []

    def put(tag: str, text: str, pad: str = "") -> str:
        truth.append(" ".join(text.split()))
        return f"<{tag}{pad}>{escape(text)}</{tag}>"

    inner.append(put("h1", _sentence(draw, 4)))
    for _ in range(draw.randint(2, 6)):
        kind = draw.random()
        if kind < 0.6:
            inner.append(put("p", _sentence(draw, draw.randint(30, 90)), " title='the hidden cost'" if draw.random() < 0.2 else ""))
        elif kind < 0.75:
            inner.append("<ul>" + "".join(put("li", _sentence(draw, draw.randint(3, 30))) for _ in range(3)) + "</ul>")
        elif kind < 0.9:
            inner.append("<section>" + put("h2", _sentence(draw, 3)) + put("p", _sentence(draw, draw.randint(5, 60))) + "</section>")
        else:
            inner.append("<div>" + put("p", _sentence(draw, draw.randint(2, 40))) + "</div>")
    inner.append(put("p", _sentence(draw, 40)))
    links = lambda n: "<ul>" + "".join(f"<li><a href=/{i}>{_sentence(draw, 2)}</a></li>" for i in range(n)) + "</ul>"
    chrome = [f"<nav>{links(5)}</nav>", f"<header><a href=/>Site</a>{links(3)}</header>", f"<div class='{draw.choice(('menu', 'ad', 'cookie-notice', 'sidebar right'))}'><p>{_sentence(draw, 25)}</p></div>", links(4)]
    draw.shuffle(chrome)
    after = [f"<aside><p>{_sentence(draw, 40)}</p></aside>", f"<div id=comments><p>{_sentence(draw, 90)}</p></div>", f"<footer>{_sentence(draw, 12)}</footer>", f"<form><p>{_sentence(draw, 9)}</p><input></form>", f"<div class=footer>{links(2)}</div>"]
    draw.shuffle(after)
    wrap = draw.choice(("<div>{}</div>", "<div id=page><div class=text>{}</div></div>", "<table><tr><td>{}</td></tr></table>", "<div><div><div class='post social-post'>{}</div></div></div>"))
    return f"<html><head><title>T</title><style>p{{}}</style></head><body>{''.join(chrome)}{wrap.format(''.join(inner))}{''.join(after)}<script>var a = '<p>no</p>';</script></body></html>", truth


def test_pages_without_marks_of_an_article():
    draw = random.Random(7)
    for _ in range(300):
        html, truth = _page(draw)
        assert main_text(html).split("\n\n") == truth, html


def test_scores_against_a_plain_version():
    """Points, counted for each element from all its paragraphs by their definition, on random trees."""
    draw = random.Random(3)

    def some(depth: int) -> str:
        if depth == 0 or draw.random() < 0.3:
            return escape(_sentence(draw, draw.randint(0, 30)))
        tag = draw.choice(("div", "p", "section", "ul", "li", "b", "a", "td", "main"))
        return f"<{tag}{draw.choice(('', '', ' class=post'))}>{''.join(some(depth - 1) for _ in range(draw.randint(0, 3)))}</{tag}>"

    for _ in range(200):
        live = html_text.tree(f"<body>{''.join(some(5) for _ in range(4))}</body>")
        best = html_text.score(live)

        def chars(n, linked=False):
            return sum((len(" ".join(c.split())) if not linked or n.tag == "a" else 0) if isinstance(c, str) else 0 if c.dead else chars(c, linked and n.tag != "a") for c in n.children)

        def commas(n):
            return sum(c.count(",") if isinstance(c, str) else 0 if c.dead or c.tag in html_text._PARAGRAPH else commas(c) for c in n.children)

        points, reached = {id(n): 0.0 for n in live}, set()
        for n in live:
            own = len(" ".join("".join(c if isinstance(c, str) else " " for c in n.children).split()))
            total = chars(n)
            if not total or not (n.tag in html_text._PARAGRAPH or n.tag in html_text._LOOSE_PARAGRAPH and own >= 25):
                continue
            up = n.parent if n.tag in html_text._PARAGRAPH else n
            for level in range(5):
                if up is None or up.tag == "#root":
                    break
                reached.add(id(up))
                points[id(up)] += (min(total / 25, 1) + commas(n) + min(total // 100, 3)) / 2**level
                up = up.parent
        for n in live:
            if id(n) in reached:
                bonus = 25 if n.tag in ("article", "main") else 10 if n.attrs.get("class") == "post" else 2 if n.tag in ("div", "section") else 0
                points[id(n)] = (points[id(n)] + bonus) * (1 - (chars(n, True) / chars(n) if chars(n) else 0))
                assert abs(points[id(n)] - n.points) < 1e-6
        if best is None:
            assert not reached
        else:
            assert abs(best.points - max(points[i] for i in reached)) < 1e-6
