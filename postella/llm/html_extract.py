"""Main text of web pages by line-block distribution.

Markup is stripped first: comments, scripts, styles and other containers that hold no running text
(menus, page headers and footers, asides, forms, dialogs, and what a whole class, id or role name says is such).
Each block that has text becomes a line; tags alone make none. Text lengths, less the text of links, are summed over
sliding windows of lines. A run of windows with text begins at a surge and ends at a dive, where the next windows are
empty; it is kept, with short and link-heavy lines inside, if its highest window stands out on its page.
The main container is the deepest that holds nearly all text of those runs: from its first to its last line of running
text all is kept; of lines outside it that don't stand out only headings, paragraphs, items and cells are.
Where the page marks an article that holds most of the running text, only its lines have lengths, so the runs lie in it; its
lines are kept, but for a list of links before the first surge that a dive parts from it. Links after the last
dive are the article's too, as are those that a heading is followed by: how dense links are tells furniture from
the article on the page, not within the article.

Names (classes and ids) tell of containers: they take away menus, notices, adverts and comments. Headings are never
judged by them, paragraphs, items and cells only by a class that says advert, comment or the like. Within an article an id
is a hint, as it may name what a section is about, and a header is the article's own. What is only hinted at, as by
`share` or `related`, loses the lines that aren't running text.

Rows: one per page row; rows that repeat a page get equal texts. A null or empty html, or one without text, has the
empty text. Broken markup is read as browsers do, in time linear in its length: a tag ends at the first > outside
quoted values, a value without closing quote at the next >, an unclosed script or comment at the end of the page.
Ties of containers go to the deepest. Nothing is capped, very long pages and blocks are read whole. An empty table
gives no rows. Columns are taken by name, the first of those that clash; others don't matter.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, id_array, pick

# Element names of HTML, and words by which pages name their parts.
RAW = "script style noscript textarea title xmp iframe noembed noframes".split()
SKIP = "nav aside footer form button menu dialog head template svg annotation annotation-xml object canvas audio video select datalist".split()
BLOCK = "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead title tr ul".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
NAMES = "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline-share comment comments disqus respond reply replies cookie cookies consent gdpr notice notices notification alert footer header masthead menu menubar nav navbar navigation newsletter popup modal overlay promo promotion sidebar sidebars sponsor sponsored subscribe subscription topbar".split()
FOREIGN = "ad ads adv advert adverts advertisement advertising adsense comment comments disqus respond reply replies cookie cookies consent gdpr newsletter popup modal promo promotion sponsor sponsored subscribe subscription".split()
HEADER = "banner header masthead".split()
HINTS = "login pager pagination recommended recommendations related search share sharing signup skip social tagcloud tags toolbar widget widgets".split()
HINTED = "fieldset label option input".split()
ROLES = "navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split()

_RAW, _SKIP, _BLOCK, _VOID, _NAMES, _FOREIGN, _HEADER, _HINTS, _HINTED, _ROLES = map(frozenset, (RAW, SKIP, BLOCK, VOID, NAMES, FOREIGN, HEADER, HINTS, HINTED, ROLES))
_CLOSES = {"p": frozenset(_BLOCK - {"br"}), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
_NAME = re.compile(r"/?[A-Za-z][^\s/>]*")
_KEY = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)?(\s*=\s*)?")
_BARE = re.compile(r"[^\s>]*")
_ASKED = frozenset(["class", "id", "role", "hidden", "aria-hidden", "style"])
_SPLIT = re.compile(r"[^a-z0-9]+")
_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW + SKIP}
#: Lines in a window.
WINDOW = 3
#: A run of lines stands out if one of its windows has this many characters, or this part of the page's most.
SURGE, SHARE = 80, 0.5
#: Letters and digits outside links that make a line prose although most of it is links.
PROSE = 10
#: The main container holds this part of the text that stands out.
MOST = 0.9
_HOLDS = frozenset("div section article main td center".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li td th dt dd blockquote pre caption figcaption".split())


class Line(NamedTuple):
    """A block's text, characters of it in links, letters and digits outside them, whether it stands in a marked
    article, whether a name hints that it is no running text, the container it is in, and the block's name."""

    text: str
    links: int
    plain: int
    inside: bool
    hinted: bool
    home: int
    block: str


class _Page:
    """A page's text with searches that look at no part of it twice in vain."""

    def __init__(self, html: str):
        self.html, self.known = html, {}

    def find(self, what, at: int) -> int:
        """Where the string or pattern is next, or -1."""
        since, found = self.known.get(what, (0, -2))
        if found == -2 or at < since or -1 < found < at:
            if isinstance(what, str):
                found = self.html.find(what, at)
            else:
                m = what.search(self.html, at)
                found = m.start() if m else -1
            self.known[what] = at, found
        return found

    def tag(self, at: int) -> tuple[str, list[tuple[str, str]], bool, int] | None:
        """Name (with / if it ends one; empty for a comment), attributes asked for, whether it ends with />, and where
        the text goes on; None if < is text."""
        html, n = self.html, len(self.html)
        mark = html[at + 1 : at + 2]
        if mark in ("!", "?"):
            comment = html.startswith("<!--", at)
            end = self.find("-->" if comment else ">", at + 2)
            return "", [], False, n if end < 0 else end + (3 if comment else 1)
        m = _NAME.match(html, at + 1)
        if not m:
            if mark != "/":
                return None
            end = self.find(">", at)
            return "", [], False, n if end < 0 else end + 1
        at, found = m.end(), []
        while at < n and html[at] != ">":
            k = _KEY.match(html, at)
            key, at = (k[1] or "").lower(), k.end()
            value = ""
            if k[2] is not None:
                quote = html[at : at + 1]
                end = self.find(quote, at + 1) if quote in ('"', "'") else -1
                if end >= 0:
                    value, at = html[at + 1 : end], end + 1
                elif quote in ('"', "'"):
                    end = self.find(">", at)
                    value, at = html[at + 1 : n if end < 0 else end], n if end < 0 else end
                else:
                    v = _BARE.match(html, at)
                    value, at = v[0], v.end()
            if key in _ASKED:
                found.append((key, value.lower()))
        return m[0].lower(), found, html[at - 1 : at] == "/", min(at + 1, n)


def _named_away(name: str, attrs: list[tuple[str, str]], inside: bool) -> tuple[bool, bool]:
    """Whether class, id, role or style take the element out of the article, and whether a name hints at that; inside says
    that it stands in a marked article."""
    whole = name in ("body", "html", "article", "main")
    hint = name in _HINTED
    for key, value in attrs:
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            return not whole, False
        if key == "role":
            if value in _ROLES:
                return not whole, False
        elif key in ("class", "id") and name not in _HEADINGS and not (name in _TEXTUAL and key == "id"):
            for n in value.split():
                parts = _SPLIT.split(n)
                named = n in _NAMES or _NAMES.issuperset(parts)
                foreign = named and not _FOREIGN.isdisjoint([n, *parts])
                if name in _TEXTUAL:
                    # a class of a paragraph or an item counts if it says that its text is another's
                    if foreign:
                        return True, False
                    hint |= named
                elif named and inside and not foreign and (key == "id" or _HEADER.issuperset(parts)):
                    hint |= key == "id" and not _HEADER.issuperset(parts)
                elif named and (not whole or "comment" in n or "dvert" in n):
                    return True, False
                else:
                    hint |= not whole and (n in _HINTS or (_NAMES | _HINTS).issuperset(parts))
    return False, hint


def lines_of(html: str) -> tuple[list[Line], list[int], list[int]]:
    """Blocks with text in page order; and of each container, in page order too, its parent and the last one within it.
    Container 0 is the page."""
    page = _Page(html)
    out: list[Line] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # open elements: name, stripped, hinted
    open_: dict[str, list[int]] = {}  # where in the stack each name is
    blocks: list[int] = []  # where blocks and what closes by itself are
    homes, parent, last = [0], [0], [0]
    state = {"links": 0, "plain": 0, "away": 0, "hint": 0, "article": 0, "a": 0}

    def flush() -> None:
        line = " ".join(unescape("".join(text)).split())
        if line:
            block = next((stack[i][0] for i in reversed(blocks) if stack[i][0] in _BLOCK), "")
            out.append(Line(line, state["links"], state["plain"], state["article"] > 0, state["hint"] > 0, homes[-1], block))
        text.clear()
        state["links"] = state["plain"] = 0

    def put(raw: str) -> None:
        if raw and not state["away"]:
            text.append(raw)
            if state["a"]:
                state["links"] += len(" ".join(unescape(raw).split()))
            else:
                state["plain"] += sum(map(str.isalnum, unescape(raw)))

    def pop(to: int) -> None:
        while len(stack) > to:
            name, away, hint = stack.pop()
            open_[name].pop()
            if blocks and blocks[-1] == len(stack):
                blocks.pop()
            state["away"] -= away
            state["hint"] -= hint
            if name in _HOLDS:
                last[homes.pop()] = len(parent) - 1
            if name in ("article", "main"):
                state["article"] -= 1
            elif name == "a":
                state["a"] -= 1

    at, n = 0, len(html)
    while at < n:
        start = page.find("<", at)
        if start < 0:
            put(html[at:])
            break
        tag = page.tag(start)
        if tag is None:
            put(html[at : start + 1])
            at = start + 1
            continue
        put(html[at:start])
        name, attrs, empty, at = tag
        if not name:
            continue
        bare = name.lstrip("/")
        if bare in _BLOCK:
            flush()
        if name[0] == "/":
            if open_.get(bare):
                pop(open_[bare][-1])
            continue
        if blocks and name in _CLOSES.get(stack[blocks[-1]][0], ()):
            pop(blocks[-1])
        if name in _RAW:
            end = page.find(_END[name], at)
            if end >= 0 or name in ("script", "style", "textarea", "title", "xmp"):
                at = page.find(">", end) + 1 if end >= 0 else n
                at = at or n
            continue
        if name in _VOID or empty and name in ("svg", "math"):
            continue
        away, hint = _named_away(name, attrs, state["article"] > 0)
        away = away or name == "header" and not state["article"] or name in _SKIP and page.find(_END[name], at) >= 0
        open_.setdefault(name, []).append(len(stack))
        if name in _BLOCK or name in _CLOSES:
            blocks.append(len(stack))
        stack.append((name, away, hint))
        state["away"] += away
        state["hint"] += hint
        if name in _HOLDS:
            parent.append(homes[-1])
            last.append(0)
            homes.append(len(parent) - 1)
        if name in ("article", "main"):
            state["article"] += 1
        elif name == "a":
            state["a"] += 1
    flush()
    pop(0)
    last[0] = len(parent) - 1
    return out, parent, last


def _runs(at: list[int], gap: int) -> list[tuple[int, int]]:
    """First and last of the positions (ascending) that are at most gap apart."""
    out: list[tuple[int, int]] = []
    for i in at:
        if out and i - out[-1][1] <= gap:
            out[-1] = (out[-1][0], i)
        else:
            out.append((i, i))
    return out


def _within_dives(size: list[int], prose: list[bool], runs: list[tuple[int, int]]) -> list[int]:
    """The lines of a marked article: all, but for those before its first run that a dive, a whole window of lines without
    running text, parts from it."""
    first = next((i for i in range(len(size)) if size[i] or prose[i]), 0) if runs else 0
    return list(range(0 if first < WINDOW else first, len(size)))


def _headed(lines: list[Line], size: list[int], at: int, mine: range | list[int]) -> list[int]:
    """The links that a heading, the last line with running text, is followed by: of the given lines those up to the next text."""
    if lines[at].block not in _HEADINGS:
        return []
    out = []
    for i in mine:
        if i > at:
            if size[i]:
                break
            out.append(i)
    return out


def main_text(html: str) -> str:
    """The page's article, its blocks joined by line breaks."""
    lines, parent, last = lines_of(html)
    if 2 * sum(x.plain for x in lines if x.hinted) <= sum(x.plain for x in lines):
        lines = [x for x in lines if not x.hinted or x.plain >= SURGE]
    size = [max(0, len(x.text) - 2 * x.links) for x in lines]
    marked = 2 * sum(n for n, x in zip(size, lines, strict=True) if x.inside) >= sum(size) and any(x.inside for x in lines)
    if marked:
        lines, size = [x for x in lines if x.inside], [n for n, x in zip(size, lines, strict=True) if x.inside]
    prose = [x.plain >= PROSE for x in lines]
    if not any(size):  # links everywhere
        size = [x.plain if p else 0 for x, p in zip(lines, prose, strict=True)]
    top = max((sum(size[i : i + WINDOW]) for i in range(len(size))), default=0)

    def stands_out(lo: int, hi: int) -> bool:
        high = max(sum(size[i : min(i + WINDOW, hi + 1)]) for i in range(lo, hi + 1))
        return high >= min(SURGE, top * SHARE)

    # a dive is a window without text, so at least as many lines
    runs = [r for r in _runs([i for i, n in enumerate(size) if n], WINDOW) if stands_out(*r)]
    if marked:
        return "\n".join(lines[i].text for i in _within_dives(size, prose, runs))
    if not runs:
        return ""
    weight = [0] * len(parent)
    for lo, hi in runs:
        for i in range(lo, hi + 1):
            weight[lines[i].home] += size[i]
    total = sum(weight)
    for c in range(len(parent) - 1, 0, -1):
        weight[parent[c]] += weight[c]
    main = max((c for c, w in enumerate(weight) if w >= MOST * total), default=0)
    within = [main <= x.home <= last[main] for x in lines]
    keep = [False] * len(lines)
    for lo, hi in runs:
        out = _runs([i for i in range(lo, hi + 1) if not within[i]], 1)
        for i in range(lo, hi + 1):
            keep[i] = True
        for a, b in out:
            if not stands_out(a, b):
                for i in range(a, b + 1):
                    keep[i] = lines[i].block in _TEXTUAL and (size[i] > 0 or prose[i])
    if main:
        mine = [i for i, here in enumerate(within) if here]
        sized = [i for i in mine if size[i]]
        for i in mine:
            keep[i] = sized[0] <= i <= sized[-1] or prose[i]
        for i in _headed(lines, size, sized[-1], mine):
            keep[i] = True
    for lo, hi in runs:  # link-heavy prose beside a run, and links under a heading
        for i in _headed(lines, size, hi, range(hi, len(lines))) if not main else []:
            keep[i] = True
        while lo and prose[lo - 1] and not size[lo - 1]:
            lo -= 1
            keep[lo] = True
        while hi + 1 < len(lines) and prose[hi + 1] and not size[hi + 1]:
            hi += 1
            keep[hi] = True
    return "\n".join(x.text for x, k in zip(lines, keep, strict=True) if k)


def _extract(batches):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
    for chunk in chunks(batches, 8 << 20):
        texts = [main_text(t.decode()) for t in chunk.texts()]
        yield pa.RecordBatch.from_arrays([id_array(chunk.ids), chunk.column(2).cast(pa.string()), pa.array(texts, pa.string())], schema=schema)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(page_id, url, text) of every page."""
    rows = pick(pages, k=(id_col, "long"), t=(html_col, "string"), url=(url_col, "string"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string")
