"""Line blocks against a plain version; pages without marks; broken and long markup; names that hint."""

from __future__ import annotations

import random
import re
import time

import pytest

from postella.llm.html_extract import extract, main_text

from .conftest import SF
from .test_html_whole import LONG, MENU


def plain_blocks(sizes):
    """Indices kept of lines with so many characters of text (0: a link only): a run goes on until three lines in a row
    are empty, and is kept from its first line of text to its last if three lines of it together reach 80 or half of the most."""
    windows = [sum(sizes[i : i + 3]) for i in range(len(sizes))]
    kept, i = [], 0
    while i < len(sizes):
        if not sizes[i]:
            i += 1
            continue
        last = j = i
        while j < len(sizes) and j - last <= 3:
            last = j if sizes[j] else last
            j += 1
        if max(sum(sizes[k : min(k + 3, last + 1)]) for k in range(i, last + 1)) >= min(80, max(windows) / 2):
            kept += range(i, last + 1)
        i = last + 1
    return kept


def test_runs_of_flat_lines():
    rng = random.Random(5)
    for _ in range(400):
        sizes = [rng.choice([0, 0, 0, rng.randrange(1, 60), rng.randrange(60, 200)]) for _ in range(rng.randrange(1, 30))]
        text = [f"{i:04d}"[:n].ljust(n, "x") if n else f"link{i}" for i, n in enumerate(sizes)]
        html = "".join(f"<p>{t}</p>" if n else f"<p><a href=x>{t}</a></p>" for n, t in zip(sizes, text, strict=True))
        if any(sizes):
            assert main_text(html) == "\n".join(text[i] for i in plain_blocks(sizes))


@pytest.mark.parametrize("instead", [r"<\1div>", "", r"<\1section>"])
def test_articles_without_marks(spark, instead):
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        assert main_text(re.sub("<(/?)article>", instead, r.html)) == main_text(r.html) != ""


def test_windows_decide_in_marked_articles():
    parts = "\n".join(f"Part {i}" for i in range(6))
    assert main_text(f"<article><ul>{MENU}</ul><h1>Title</h1><p>{LONG}</p><p>End.</p><ul>{MENU}</ul></article>") == f"Title\n{LONG}\nEnd.\n{parts}"
    assert main_text(f"<article><p><a href=x>Part</a></p><p>{LONG}</p><ul>{MENU}</ul><p>It ends here.</p></article>").split("\n") == ["Part", LONG, *(f"Part {i}" for i in range(6)), "It ends here."]


def test_hints_do_not_take_running_text():
    for name in ("share", "related", "search", "tags"):
        assert main_text(f"<article><p>{LONG}</p><p>{LONG}</p><div class={name}><p>{LONG} More.</p><p>Do it.</p></div></article>") == f"{LONG}\n{LONG}\n{LONG} More."
    assert main_text(f"<div class=widget><h1>Short</h1><p>{LONG}</p></div>") == f"Short\n{LONG}"
    assert main_text(f"<article><p>{LONG}</p><p>{LONG}</p><fieldset><p>{LONG}</p><label>Name</label></fieldset></article>") == "\n".join([LONG] * 3)
    assert main_text(f"<article><p>{LONG}</p><div class=comments><p>{LONG} I say.</p></div></article>") == LONG


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ('<p title="x>Hello</p><p>more', "Hello\nmore"),
        ("<p class=it's>Hello</p>", "Hello"),
        ('<p title="a>b">Hello</p>', "Hello"),
        ("<p>a < b and c<3</p>", "a < b and c<3"),
        ("<p>a</p><!-- b <p>c", "a"),
        ("<p>a<script>b</p>c", "a"),
        ("<p>a</ >b</p>", "ab"),
        ("<P CLASS='NAV'>x</P><p>y", "y"),
        ("<p>a<br/>b<hr>c", "a\nb\nc"),
        ("<svg/><p>a<svg><text>b</text></svg></p>", "a"),
    ],
)
def test_broken_markup(html, want):
    assert main_text(html) == want


@pytest.mark.parametrize("part", ["<a x", "<div>", "</b>", "<nav>", "<b><p>", '<p class="', "<!--", "<script>", "</", "<a href='", "<svg>", "<p>word", "&amp", "<"])
def test_time_is_linear(part):
    began = time.process_time()
    main_text(part * 40_000 + "<div>" * 100 + '"')
    assert time.process_time() - began < 15


def test_rows(spark):
    rows = [(1, f"<p>{LONG}</p>" * 20_000, "u"), (1, f"<p>{LONG}</p>", "u"), (1, f"<p>{LONG}</p>", "u"), (2, "<p>é &amp; x", None)]
    df = spark.createDataFrame(rows, "page_id long, html string, url string").selectExpr("page_id", "html", "url", "1 k", "2 t", "'no' HTML").toDF("page_id", "html", "url", "k", "t", "HTML")
    got = sorted(((r.page_id, r.url, r.text) for r in extract(df).collect()), key=repr)
    assert got == sorted([(1, "u", "\n".join([LONG] * 20_000)), (1, "u", LONG), (1, "u", LONG), (2, None, "é & x")], key=repr)
