"""Main text of web pages by two-pass block rules.

The markup is read once, front to back, into blocks: runs of text between block-level tags, each with its count of characters inside links, the section it
stands in (the innermost element that isn't a paragraph, a heading or part of a list or table), and that section's parent.

The first pass classes each block by itself: bad (many characters in links, or a short line with a copyright sign), short (few characters), weak (few stop
words), near-good (some) or good (many, and long). Only good and bad are decided.

The second pass settles the others by their nearest decided neighbours: first inside their section, then inside its parent, then on the whole page.
In a section or its parent the nearer of the two decides (of two as near, near-good blocks follow a good one, short and weak ones need both); on the page, a near-good
block needs one good side and other blocks two. What stands before a heading belongs to what precedes it, so neighbours to the right aren't
looked for beyond a heading outside the section, and a heading follows what comes after it, unless that is undecided text of its own section. If a page has nothing good, the section that has the most
undecided text gives it: its near-good blocks (and those of sections with half as much), or without those all undecided ones. The good blocks' texts are joined in page order.

Hints, that is elements such as nav, footer or aside, roles, and class or id names that mark adverts, comments and the like, are one more feature: where
the rest of the page has any block that isn't bad, hinted blocks are bad; else they are judged like others. A form, in which a whole page may stand, is a hint only
where the rest has anything good or near-good. Scripts, styles and hidden elements have no text.

Defined results: null, empty or blank html gives an empty text; unclosed elements reach to the end of the page (an unclosed comment or script too); a tag that isn't
closed before the next one begins is text; a null page_id or url stays null; equal rows give equal rows; pages are read whole, in time in proportion to their length;
other columns aren't used, whatever their names. White space inside a block becomes one space; blocks are joined by one space.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mapped

# Elements.
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas audio video select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
HINTED = frozenset("nav aside footer menu dialog button fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are no section of their own.
PARTS = HEADINGS | frozenset("html body p blockquote pre li dt dd ul ol dl dir table tbody thead tfoot tr td th caption figure figcaption center address summary option legend button br hr".split())
#: A closed p, li, dt, dd, tr, td, th or option needs no end tag: another one, or the end of its container, closes it. A p ends at any other block, too.
LOOSE = frozenset("p li dt dd tr td th option".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
# Class and id names that mark text apart from the article.
APART = frozenset("ad ads advert adverts advertisement advertisements advertising adsense banner breadcrumb breadcrumbs comment comments commentary disqus respond reply replies discussion consent cookie cookies disclaimer footer footnav gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion related recommended recommendations search share sharing sidebar signup site-header skip social sponsor sponsored subscribe subscription tags toolbar topbar widget".split())
# Endings that join such a name to what it marks, as in cookie-banner or comment-list.
JOINED = frozenset("area bar banner block box container content form inner item items link links list message overlay panel popup section text widget wrap wrapper".split())
# Frequent function words of English, German, French and Spanish.
STOP = frozenset(
    "a about after all also an and any are as at be been but by can could do for from had has have he her his how i if in into is it its just like more most my no not of on one only or other our out over said she so some than that the their them then there these they this to up was we were what when where which who will with would you your "
    "aber als am an auch auf aus bei bin bis da das dass dem den der des die doch durch ein eine einem einen einer es für hat ich ihr im in ist ja kann mit nach nicht noch nur oder schon sein sich sie sind so über um und uns von vor war was wenn wie wir wird zu zum zur "
    "au aux avec ce ces cette comme dans de des du elle en est et eu il ils je la le les leur lui ma mais me mes moi mon ne nos nous on ou où par pas plus pour qu que qui sa sans se ses si son sont sur ta te tu un une vos votre vous y "
    "al algo como con cuando de del desde donde el ella ellos en entre era es esa ese eso esta este esto fue ha hay la las le lo los más me mi muy no nos o para pero por porque que se ser si sin sobre su sus también te tiene todo un una uno y ya".split()
)
#: Characters, share of stop words, share of characters in links.
SHORT, LONG, STOP_LOW, STOP_HIGH, LINKS = 70, 200, 0.16, 0.28, 0.33

SCHEMA = "page_id long, url string, text string, n_chars long"

_INSIDE = r"""(?:[^<>"']|"[^"<]*"|'[^'<]*')*+"""
_TAG = re.compile(rf"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s<>/]*)({_INSIDE}>|{_INSIDE}(?:"[^"]{{0,500}}"|'[^']{{0,500}}'){_INSIDE}>|[^<>]*>)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?=[\s=/>]|$)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.IGNORECASE)
_WORD = re.compile(r"[^\W\d_]+")
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_ends: dict[str, re.Pattern] = {}


@dataclass
class Block:
    text: str
    linked: int = 0
    heading: bool = False
    section: int = 0
    parent: int = 0
    hinted: bool = False
    form: bool = False
    label: str = ""


def _names_apart(name: str) -> bool:
    if name in APART:
        return True
    head, _, tail = name.replace("_", "-").rpartition("-")
    return head in APART and tail in JOINED


def _marks(name: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is hinted to stand apart from the main text, and whether it is hidden."""
    hinted = name in HINTED or name == "header" and not in_article
    hidden = name == "head"
    if "=" in attributes or "hidden" in attributes:
        for key, value in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'").lower()
            hidden |= key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and bool(_HIDES.search(value))
            hinted |= key == "role" and value in ROLES
            if key in ("class", "id") and name not in ("html", "body", "main", "article"):
                hinted |= any(map(_names_apart, value.split()))
    return hinted, hidden


class _Reader:
    """Reads a page into blocks. Each tag costs the same, however deep it stands, but for elements that it closes."""

    def __init__(self) -> None:
        self.out: list[Block] = []
        self.stack: list[tuple[str, bool, bool]] = []  # open elements: name, hinted, hidden
        self.at: dict[str, list[int]] = {}  # where in the stack elements of a name stand
        self.block_at: list[int] = []  # where blocks stand
        self.sections: list[int] = [0, 0]  # numbers of the open sections
        self.hints = self.hidden = self.links = self.articles = self.seen = 0
        self.heading = False
        self.held: list[str] = []
        self.linked = 0

    def close(self) -> None:
        text = " ".join("".join(self.held).split())
        if text:
            self.out.append(Block(text, self.linked, self.heading, self.sections[-1], self.sections[-2], self.hints > 0, bool(self.at.get("form"))))
        self.held.clear()
        self.linked = 0

    def add(self, raw: str) -> None:
        if raw and not self.hidden:
            text = entities.unescape(raw) if "&" in raw else raw
            self.held.append(text)
            if self.links:
                self.linked += len("".join(text.split()))

    def push(self, name: str, hinted: bool, hidden: bool) -> None:
        self.at.setdefault(name, []).append(len(self.stack))
        if name in BLOCK:
            self.block_at.append(len(self.stack))
        if name in BLOCK and name not in PARTS:
            self.seen += 1
            self.sections.append(self.seen)
        self.stack.append((name, hinted, hidden))
        self.hints += hinted
        self.hidden += hidden
        self.links += name == "a"
        self.articles += name in ("article", "main")

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            name, hinted, hidden = self.stack.pop()
            self.at[name].pop()
            if name in BLOCK:
                self.block_at.pop()
            if name in BLOCK and name not in PARTS:
                self.sections.pop()
            self.hints -= hinted
            self.hidden -= hidden
            self.links -= name == "a"
            self.articles -= name in ("article", "main")

    def inner(self, name: str) -> int | None:
        """Where the last element of a name stands, if no block stands above it."""
        at = self.at.get(name)
        return at[-1] if at and (not self.block_at or at[-1] >= self.block_at[-1]) else None

    def ended(self, name: str) -> None:
        if name in HEADINGS or name == "p":
            self.heading = False
        at = self.at.get(name)
        if at and (name in BLOCK or self.inner(name) is not None):  # an inline end tag doesn't close the blocks around it
            self.pop_to(at[-1])

    def began(self, name: str, attributes: str) -> None:
        if name in LOOSE and (depth := self.inner(name)) is not None or name in BLOCK and name not in ("br", "button", "option") and (depth := self.inner("p")) is not None or name == "a" and (depth := self.inner("a")) is not None:
            self.pop_to(depth)
        if name in BLOCK:
            self.heading = name in HEADINGS
        if name not in VOID:
            self.push(name, *_marks(name, attributes, self.articles > 0))

    def read(self, page: str) -> list[Block]:
        at = 0
        while (m := _TAG.search(page, at)) is not None:
            self.add(page[at : m.start()])
            at = m.end()
            if m[1] is not None:
                self.add(m[1])
            if m[3] is None:
                continue
            name = m[3].lower()
            if name in BLOCK:
                self.close()
            if m[2]:
                self.ended(name)
            elif name in RAW:
                alone = m[4].endswith("/>")
                end = None if alone and name in ("svg", "math") else _ends.setdefault(name, re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.IGNORECASE)).search(page, at)
                at = end.end() if end else at if alone else len(page)
            else:
                self.began(name, m[4][:-1])
        self.add(page[at:])
        self.close()
        return self.out


def blocks_of(page: str) -> list[Block]:
    return _Reader().read(page)


def first_pass(b: Block) -> str:
    size = len("".join(b.text.split()))
    if b.linked > LINKS * size or "©" in b.text and len(b.text) < LONG:
        return "bad"
    if len(b.text) < SHORT:
        return "short"
    words = _WORD.findall(b.text.lower())
    stop = sum(w in STOP for w in words) / len(words) if words else 0.0
    if stop >= STOP_HIGH:
        return "good" if len(b.text) > LONG else "near"
    return "near" if stop >= STOP_LOW else "weak"


def _settled(label: str, heading: bool, left: tuple[str, int], right: tuple[str, int], page: bool) -> str:
    """left, right: the nearest decided labels ("" for none) and how far they are."""
    if heading and right[0]:
        return right[0]
    sides = [s for s in (left, right) if s[0]]
    good = sum(s[0] == "good" for s in sides)
    if page:
        return "good" if good > (label != "near") else "bad"
    if good in (0, len(sides)):
        return "good" if good else "bad"
    if left[1] == right[1]:
        return "good" if label == "near" else "bad"
    return min(sides, key=lambda s: s[1])[0]


def second_pass(page: list[Block]) -> None:
    if all(b.label != "good" for b in page):
        size: dict[int, int] = {}
        for b in page:
            if b.label != "bad":
                size[b.section] = size.get(b.section, 0) + len(b.text)
        main = max(size, key=lambda s: (size[s], -s), default=None)
        near = any(b.label == "near" and b.section == main for b in page)
        for b in page:
            if b.label == "near" and 2 * size[b.section] >= size[main] if near else b.label != "bad" and b.section == main:
                b.label = "good"
    labels = [b.label for b in page]
    found: list[list[dict[str, tuple[str, int]]]] = []
    for k, b in enumerate(page):
        found.append([{}, {}, {}])
    for step in (1, -1):
        side = "left" if step == 1 else "right"
        # the last decided block of each section, of each parent, of the page
        last: tuple[dict[int, int], dict[int, int], dict[int, int]] = ({}, {}, {})
        wall = -1  # to the right: the nearest heading, beyond which only its own section is looked at
        for k in range(len(page)) if step == 1 else range(len(page) - 1, -1, -1):
            b = page[k]
            for level, key in enumerate((b.section, b.parent, 0)):
                at = last[level].get(key)
                if level and step == -1 and at is not None and not b.heading and -1 < wall <= at and page[wall].section != b.section:
                    at = None
                found[k][level][side] = (labels[at], abs(at - k)) if at is not None else ("", 0)
            if labels[k] in ("good", "bad"):
                last[0][b.section] = last[1][b.parent] = last[1][b.section] = last[2][0] = k
            if b.heading:
                wall = k
    for k, b in enumerate(page):
        if labels[k] in ("good", "bad"):
            continue
        for level, sides in enumerate(found[k]):
            if level == 2 or not (level and not b.parent) and (sides["left"][0] or sides["right"][0]):  # the page itself is no parent
                # on the page, a heading that has undecided text of its own section after it doesn't follow what comes later
                alone = level < 2 or k + 1 == len(page) or page[k + 1].section != b.section
                b.label = _settled(labels[k], b.heading and alone, sides["left"], sides["right"], level == 2)
                break


def main_text(page: str, hints: bool = True) -> str:
    """hints: whether they count."""
    found = blocks_of(page)
    for b in found:
        b.label = first_pass(b)
    if hints:
        for name, enough in (("form", ("good", "near")), ("hinted", ("good", "near", "weak", "short"))):
            if any(b.label in enough and not b.form and not b.hinted if name == "form" else b.label in enough and not b.hinted for b in found):
                for b in found:
                    b.label = "bad" if getattr(b, name) else b.label
    second_pass(found)
    return " ".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html, ...) -> page_id, url, text, n_chars; a row for each row. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "") for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return mapped(pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html"), "html_main", run, SCHEMA)
