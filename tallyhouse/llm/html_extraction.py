"""Main text of web pages by line-block distribution.

A page is stripped of markup and laid out as a grid of lines: each block of text is one line, and
each boundary that can separate an article from its surroundings is a run of empty lines. The text
lengths are summed over sliding windows of lines; link text counts nothing, on any page, unless it is
a heading. A window sum that leaves zero is a surge, one that falls back to zero is a dive, and what
lies between them is a stretch of text.

Tags, names and words are evidence, and change the weight of lines. Lines inside menus, headers,
footers, sidebars, forms, and elements whose class, id or role says notice, advert, comments and so on
are faint, those of an article or main element are heavy, and lines that read like a menu entry, a
notice or a copyright line are faint too. The page's densest window by weight tells which evidence is wrong:
an element that holds it is no surrounding, whatever its names say, nor is any other that is marked by the
same names only. Lines of all other marked elements go.

What is left has a threshold of its own: a ``SHARE`` of its densest window, ``ENOUGH`` letters at most. The
text runs from the first block of lines whose window passes the threshold, or that lies in an article, to
the last one. Outside these, short blocks that read like surroundings go; short blocks that do not are kept.

Defined results: null or empty html gives the empty text; markup that is never closed ends with its
parent; a page without any text gives the empty text; a page with an article element that is empty does not
take its text from marked elements. Scripts, styles and what is hidden never count. Repeated rows give
repeated results. An empty table gives no rows. Only the named columns are read, so other columns cannot
clash. Time grows with the page, however its markup is broken.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: lines in a window
WINDOW = 3
#: weight of lines that evidence speaks against; articles weigh as much more
FAINT = 1 / 16
#: a window is dense from this share of the densest one on, or with so many letters
SHARE, ENOUGH = 1 / 4, 240
#: without an article element, names are doubted only for a window with so many letters
DOUBT = 80

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
NAMED = re.compile(r"""(?<![-\w:])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?(?:false|until-found))|\baria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "xmp"}
NEVER = RAW | {"head", "button", "select", "audio", "video"}
SURROUNDINGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset", "search"}
ARTICLE = {"article", "main"}
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp",
          "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "br"}
#: boundaries of these are empty lines between stretches
CONTAINER = {"body", "html", "section", "div", "table", "td", "tr", "ul", "ol", "dl"}
WORDS = {"nav", "navbar", "navigation", "menu", "header", "masthead", "footer", "sidebar", "aside", "notice", "notices", "cookie", "cookies", "consent", "gdpr", "banner", "ad", "ads", "advert",
         "adverts", "advertisement", "advertising", "promo", "promotion", "sponsor", "sponsored", "form", "comment", "comments", "commentlist", "disqus", "replies", "reply", "respond", "share",
         "sharing", "social", "related", "recommended", "recommendations", "breadcrumb", "breadcrumbs", "subscribe", "subscription", "newsletter", "signup", "login", "popup", "modal", "overlay",
         "alert", "widget", "pagination", "pager", "toolbar", "contentinfo", "complementary", "search", "hidden", "skip", "copyright", "disclaimer"}
REMARKS = {"comment", "comments", "commentlist", "disqus", "reply", "replies"}
SPLIT = re.compile(r"[\s_\-:/.]+|(?<=[a-z])(?=[A-Z])")
#: fixed values: what menu entries say, and what notices and last lines of a page hold
ENTRIES = {"home", "about", "about us", "contact", "contact us", "menu", "search", "login", "log in", "sign in", "sign up", "register", "subscribe", "sitemap", "help", "faq", "skip to content", "back to top", "share", "print",
           "accueil", "à propos", "rechercher", "connexion", "startseite", "über uns", "kontakt", "suche", "anmelden", "impressum", "inicio", "contacto", "buscar", "acerca de", "quiénes somos", "iniciar sesión"}
SAYINGS = re.compile(r"©|\(c\) ?\d{4}|\bcopyright\b|\bcookies?\b|all rights reserved|privacy policy|terms of (?:use|service)|tous droits réservés|mentions légales|alle rechte vorbehalten|datenschutz"
                     r"|todos los derechos reservados|política de privacidad|aviso legal", re.I)


class Line(NamedTuple):
    """A line of the grid: its text (none if empty), letters outside links, innermost marked element (-1: none), whether in an article."""

    text: str
    counted: int
    mark: int
    article: bool


class Mark(NamedTuple):
    """An element that evidence speaks against: the marked element around it, and the names that speak against it."""

    outer: int
    names: frozenset[str]


def _names(tag: str, attributes: str) -> list[str]:
    """Names of an element that tell of surroundings; an article only if they tell of remarks."""
    if not attributes or tag in ("html", "body"):
        return []
    words = REMARKS if tag in ARTICLE else WORDS
    return [n for m in NAMED.finditer(attributes) for n in (m[2] or m[3] or m[4] or "").split() if any(w.lower() in words for w in SPLIT.split(n))]


def _is_remark(names: list[str]) -> bool:
    return any(w.lower() in REMARKS for n in names for w in SPLIT.split(n))


def lines(page: str) -> tuple[list[Line], list[Mark], bool]:
    """The grid, its marked elements (outer ones first), and whether the page has an article element."""
    out: list[Line] = []
    marks: list[Mark] = []
    parts: list[str] = []
    counted = linked = 0
    stack: list[tuple[str, bool, int, bool, bool]] = []  # tag, never shown, mark outside (-2: not marked), article, remarks
    open_tags: Counter[str] = Counter()
    skipped = articles = links = headings = remarks = 0
    mark, has_article = -1, False

    def close_line() -> None:
        nonlocal counted, linked
        text = " ".join("".join(parts).split())
        if text:
            # a bar between links is no text
            out.append(Line(text, 0 if linked and counted < 8 and not any(c.isalnum() for c in "".join(plain)) else counted, mark, articles > 0))
        parts.clear()
        plain.clear()
        counted = linked = 0

    plain: list[str] = []

    def gap(n: int) -> None:
        out.extend([Line("", 0, mark, articles > 0)] * n)

    def text(raw: str) -> None:
        nonlocal counted, linked
        s = entities.unescape(raw)
        parts.append(s)
        if not links or headings:
            plain.append(s)
            counted += len("".join(s.split()))
        else:
            linked += 1

    def pop() -> None:
        nonlocal skipped, articles, links, headings, remarks, mark
        tag, never, outside, article, remark = stack.pop()
        open_tags[tag] -= 1
        if (article or outside > -2) and not skipped:
            close_line()
        if article:
            gap(WINDOW)
        if outside > -2:
            mark = outside
        skipped -= never
        articles -= article
        links -= tag == "a"
        headings -= tag in HEADING
        remarks -= remark
        if (never or outside > -2) and not skipped and not articles:
            gap(WINDOW)

    # where no tag can end any more, all is text
    at, size, last = 0, len(page), page.rfind(">")
    while at < size:
        m = TOKEN.search(page, at) if at <= last else None
        if m is None:
            break
        if not skipped and m.start() > at:
            text(page[at:m.start()])
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if tag is None:
            if m[0].startswith("<![CDATA[") and not skipped:
                text(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if closing:
            if not skipped and tag not in INLINE:
                close_line()
                if tag in CONTAINER and not articles:
                    gap(1)
            if open_tags[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        never = tag in NEVER or HIDDEN.search(attributes) is not None and tag not in ("html", "body")
        if tag in RAW and not attributes.endswith("/"):
            # raw text: nothing inside is markup
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            if not skipped and tag not in ("script", "style", "noscript", "template"):
                close_line()
            continue
        if tag == "br":
            if not skipped:
                parts.append(" ")
            continue
        names = [] if skipped or never else _names(tag, attributes)
        remark = bool(names) and _is_remark(names)
        # a header inside an article is the article's own
        if not skipped and not never and tag in SURROUNDINGS and not (tag == "header" and articles):
            names.append(f"<{tag}> {len(marks)}")
        if not skipped and (tag not in INLINE or never or names):
            close_line()
            if tag in CONTAINER and not articles:
                gap(1)
        if tag in VOID or attributes.endswith("/"):
            continue
        article = tag in ARTICLE and not never and not skipped and not remark and not remarks
        if article or (never or names) and not skipped and not articles:
            gap(WINDOW)
        # an open paragraph, list item or cell ends where the next begins
        if tag in ("p", "li", "td", "tr", "option", "dt", "dd") and stack and stack[-1][0] == tag:
            pop()
        if tag != "p":
            while stack and stack[-1][0] == "p" and tag not in INLINE:
                pop()
        stack.append((tag, never, mark if names else -2, article, remark))
        open_tags[tag] += 1
        if names:
            marks.append(Mark(mark, frozenset(names)))
            mark = len(marks) - 1
        has_article |= article
        skipped += never
        articles += article
        links += tag == "a"
        headings += tag in HEADING
        remarks += remark
    if not skipped and at < size:
        text(page[at:])
    close_line()
    return out, marks, has_article


def window_sums(lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Sum of the window that ends at each line, and of those that end behind the last one."""
    return np.convolve(lengths, np.ones(window))


def stretches(lengths: np.ndarray, window: int = WINDOW) -> list[tuple[int, int]]:
    """(surge, dive): lines between which the sliding window sums stay above zero."""
    if not len(lengths):
        return []
    on = np.flatnonzero(np.diff(np.concatenate(([0], (window_sums(lengths, window) > 0.5).view(np.int8), [0]))))
    return [(int(a), int(b) - window + 1) for a, b in zip(on[::2], on[1::2])]


def reads_like_surroundings(line: Line) -> bool:
    return not line.article and bool(line.text) and (line.text.strip(" .:|»›").lower() in ENTRIES or SAYINGS.search(line.text) is not None)


def unmarked(grid: list[Line], marks: list[Mark], has_article: bool, told: list[bool]) -> list[Line]:
    """Lines that no evidence removes, after the densest window has told which names are wrong."""
    alive = [False] * len(marks)
    counted = np.array([line.counted for line in grid], float)
    weight = counted * [(FAINT if line.mark >= 0 else 1) * (FAINT if t else 1) / (FAINT if line.article else 1) for line, t in zip(grid, told)]
    sums = window_sums(weight)
    end = int(np.argmax(sums))
    begin = max(0, end - WINDOW + 1)
    densest = begin + int(np.argmax(weight[begin:end + 1])) if sums[end] > 0 else -1
    if densest >= 0 and (grid[densest].article or not has_article and counted[begin:end + 1].sum() >= DOUBT):
        wrong: set[str] = set()
        at = grid[densest].mark
        while at >= 0:
            wrong |= marks[at].names
            at = marks[at].outer
        for i, m in enumerate(marks):
            alive[i] = m.names <= wrong and (m.outer < 0 or alive[m.outer])
    return [line for line in grid if line.mark < 0 or alive[line.mark]]


def blocks(grid: list[Line]) -> list[tuple[int, int]]:
    """Runs of lines with text."""
    full = np.array([bool(line.text) for line in grid], np.int8)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], full, [0]))))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2])]


def main_text(page: str) -> str:
    """The text's blocks in page order, one a line."""
    grid, marks, has_article = lines(page)
    if marks:
        grid = unmarked(grid, marks, has_article, [reads_like_surroundings(line) for line in grid])
    if not grid:
        return ""
    lengths = np.array([line.counted for line in grid], float)
    told = np.array([reads_like_surroundings(line) for line in grid])
    gone = np.zeros(len(grid), bool)
    if told.any():
        weight = np.where(told, lengths * FAINT, lengths)
        threshold = min(window_sums(weight).max() * SHARE, ENOUGH)
        sums = np.concatenate(([0], np.cumsum(weight)))
        runs = blocks(grid)
        peak = lambda a, b: sums[b] - sums[a] if b - a <= WINDOW else (sums[a + WINDOW:b + 1] - sums[a:b + 1 - WINDOW]).max()
        dense = [i for i, (a, b) in enumerate(runs) if grid[a].article or threshold and peak(a, b) >= threshold]
        letters = np.array([len(line.text) for line in grid])
        for i, (a, b) in enumerate(runs):
            if dense and not dense[0] <= i <= dense[-1] and 2 * letters[a:b][told[a:b]].sum() >= letters[a:b].sum():
                gone[a:b] = True

    def edge(at: int, step: int) -> int:
        """Lines of links from ``at`` on; none if they fill a window."""
        n = 0
        while n < WINDOW and 0 <= at + n * step < len(grid) and grid[at + n * step].text and not lengths[at + n * step]:
            n += 1
        return n % WINDOW

    keep = [(a - edge(a - 1, -1), b + edge(b, 1)) for a, b in stretches(lengths)]
    return "\n".join(grid[i].text for a, b in keep for i in range(a, b) if grid[i].text and not gone[i])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts = [main_text(h.as_py() or "") for h in part.column(part.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], [*part.schema.names[:-1], "text"])


def extract(pages: DataFrame, html_col: str = "html", *keep: str) -> DataFrame:
    """The columns in ``keep`` (page_id and url if none) with ``text``."""
    keep = keep or ("page_id", "url")
    rows = pages.select(*keep, F.col(html_col).alias("_html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", text string"
    return rows.mapInArrow(_texts, schema)
