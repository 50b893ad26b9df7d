"""Pages whose article text was dropped with the boilerplate."""

from __future__ import annotations

import pytest

from postella.llm.html_extract import main_text

LONG = "A sentence of some length that stands for the running text of an article without marked container."
MENU = "".join(f"<li><a href={i}>Part {i}</a>" for i in range(6))


def page(body: str) -> str:
    return f"<body><ul>{MENU}</ul>{body}<div><ul>{MENU}</ul></div></body>"


@pytest.mark.parametrize(
    ("body", "want"),
    [
        # blocks of which half or more is links: inside, first, last, and a list between paragraphs
        (f"<div><p>{LONG}</p><p>As told <a href=a>by the paper of the day</a></p><p>{LONG}</p></div>", [LONG, "As told by the paper of the day", LONG]),
        (f"<div><p>According to <a href=a>the paper of the day</a></p><p>{LONG}</p><p>Written for <a href=a>the paper of the day</a></p></div>", ["According to the paper of the day", LONG, "Written for the paper of the day"]),
        (f"<div><p>{LONG}</p><ul>{MENU}</ul><p>Short.</p></div>", [LONG, *(f"Part {i}" for i in range(6)), "Short."]),
        (f"<p>{LONG}</p><p>Written for <a href=a>the paper of the day</a></p>", [LONG, "Written for the paper of the day"]),
        # tags in a row
        (f"<p>{LONG}</p><table><tr><td>One</td><td>2</td></tr><tr><td>Two</td></tr></table><p>{LONG}</p>", [LONG, "One", "2", "Two", LONG]),
        (f"<div><p>{LONG}</p><ul><li><p>One</p></li><li><p>Two</p></li></ul></div>", [LONG, "One", "Two"]),
        (f"<h1>Title</h1><div><div><p>{LONG}</p></div></div>", ["Title", LONG]),
        # an article that is a card only
        (f"<div><p>{LONG}</p><p>{LONG}</p></div><article><p>Card.</p></article>", [LONG, LONG, "Card."]),
        # parts of class names
        (f"<div class='content-with-sidebar'><p>{LONG}</p></div><div class='sidebar left'><p>{LONG} Side.</p></div><div class='cookie-notice'><p>{LONG} Cookie.</p></div>", [LONG]),
    ],
)
def test_whole_articles(body, want):
    assert main_text(page(body)) == "\n".join(want)


def test_short_text_outside_the_main_container_goes():
    assert main_text(page(f"<div><p>{LONG}</p><p>{LONG}</p></div><div>All rights reserved.</div>")) == f"{LONG}\n{LONG}"


def test_links_everywhere():
    assert main_text("<p>As told here <a href=a>by the paper of the day</a></p><p><a href=b>Next</a></p>") == "As told here by the paper of the day"


LINKS = "".join(f"<li><a href={i}>Paper {i}</a></li>" for i in range(4))
PAPERS = [f"Paper {i}" for i in range(4)]


@pytest.mark.parametrize(
    ("body", "want"),
    [
        # headings whose id or class names a subject
        *[(f"<article><p>{LONG}</p><h2 id={n}>On {n}</h2><p>{LONG}</p></article>", [LONG, f"On {n}", LONG]) for n in ("search", "related", "notice", "comments", "menu", "advert")],
        *[(f"<article><p>{LONG}</p><h2 class={n}>On {n}</h2><p>{LONG}</p></article>", [LONG, f"On {n}", LONG]) for n in ("header", "tags", "banner")],
        # a section's id, the article's own header, a paragraph's class and id
        (f"<article><div id=overlay><p>{LONG}</p></div><p>{LONG} More.</p></article>", [LONG, f"{LONG} More."]),
        (f"<article><div class=header><h1>Headline</h1></div><p>{LONG}</p></article>", ["Headline", LONG]),
        (f"<article><div id=header><h1>Headline</h1></div><p>{LONG}</p></article>", ["Headline", LONG]),
        (f"<article><p>{LONG}</p><p class=tags>Short.</p><p id=related>Also short.</p><p>{LONG}</p></article>", [LONG, "Short.", "Also short.", LONG]),
        # formulas are text, what only describes them is not
        (f"<article><p>{LONG}</p><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding=tex>x=2</annotation></math> holds.</p></article>", [LONG, "So x=2 holds."]),
        # lists of links that close an article, marked or not
        (f"<article><p>{LONG}</p><p>{LONG}</p><ul>{LINKS}</ul></article>", [LONG, LONG, *PAPERS]),
        (f"<article><p>{LONG}</p><h2>References</h2><ul>{LINKS}</ul></article>", [LONG, "References", *PAPERS]),
        (f"<div><p>{LONG}</p><p>{LONG}</p><h2>References</h2><ul>{LINKS}</ul></div>", [LONG, LONG, "References", *PAPERS]),
        # menus, comments, adverts and notices go wherever they are
        *[(f"<article><p>{LONG}</p><div class={n}><p>{LONG} Else.</p></div><p>{LONG}</p></article>", [LONG, LONG]) for n in ("comments", "advert", "menu", "notice", "sidebar", "cookie-notice", "'ad banner'", "overlay")],
        *[(f"<article><p>{LONG}</p><div id={n}><p>{LONG} Else.</p></div><p>{LONG}</p></article>", [LONG, LONG]) for n in ("comments", "ads", "newsletter", "disqus")],
        (f"<article><p>{LONG}</p><p class=ad>{LONG} Buy.</p><p class=notice>Updated.</p><p>{LONG}</p></article>", [LONG, LONG]),
        (f"<div><p>{LONG}</p><p>{LONG}</p></div><div id=sidebar><p>{LONG} Side.</p></div><div id=footer><p>{LONG} Foot.</p></div>", [LONG, LONG]),
        (f"<article><p>{LONG}</p></article><div class=header><h1>Site</h1></div><section id=comments><p>{LONG} I say.</p></section>", [LONG]),
    ],
)
def test_names_and_links(body, want):
    assert main_text(page(body)) == "\n".join(want)
