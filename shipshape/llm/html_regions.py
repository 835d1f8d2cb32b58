"""Main text of web pages by text-to-tag ratio.

The standard library's parser is fed a page as a stream of events, from which the page's lines
(block elements) arise, each with its characters, its tags and the elements around it. The ratio
of characters to tags is smoothed along the lines with a Gaussian; lines above a threshold taken
from the page itself cluster into content regions. Where a page has article or main elements, those
with clusters are its article, whatever the ratio of a line in them; else all clusters are, with the
whole of the elements named as content that hold one, or, where no element is named so, the stretch
between the first and the last. Of that, every line stays that no boilerplate element holds. An
element whose name speaks of layout or boilerplate holds none where the page's article is in it.
"""
from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shipshape.llm.common import ship

SIGMA = 1.0
#: Smoothed ratios above this share of their standard deviation are content.
THRESHOLD = 0.5
#: Lines on both sides that the Gaussian weighs.
RADIUS = 3

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
                    "samp small span strike strong sub sup time tt u var wbr img script style button".split())
#: How surely an element is no part of the article: it may wrap a page's whole article; it may hold an
#: article element, and so may what is named by advertisements; it holds comments; it isn't shown.
LAYOUT, BOILERPLATE, ADVERT, COMMENT, UNSEEN = 1, 2, 3, 4, 5
#: Layout elements with so many times the other text hold the article.
HEAVIER = 2
_DROP = frozenset("head title script style noscript template button select option textarea "
                  "input iframe object embed svg canvas math audio video".split())
_DROP_TAGS = {"form": LAYOUT, "nav": BOILERPLATE, "footer": BOILERPLATE, "aside": BOILERPLATE, "menu": BOILERPLATE,
              "dialog": BOILERPLATE}
_DROP_WORDS = {w: level for level, words in (
    (LAYOUT, "banner notice notices alert popup modal overlay sidebar header masthead toolbar share sharing social "
             "signup login search widget skip form hidden"),
    (BOILERPLATE, "cookie cookies consent aside nav navbar navigation menu breadcrumb breadcrumbs footer related "
                  "recommended newsletter subscribe pagination pager copyright"),
    (ADVERT, "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion"),
    (COMMENT, "comment comments respond reply replies discussion disqus")) for w in words.split()}
#: Names that say what an element has beside it or is filed under ("has-sidebar", "comments-open") name no element.
_BESIDE = frozenset("has have with no not without hide show category tag".split())
_STATES = frozenset("open closed enabled disabled".split())
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar "
                        "toolbar form".split())
_MAIN_WORDS = frozenset("article content main post entry story body text".split())
_NAME = re.compile(r"[A-Za-z]+")


class _Element:
    __slots__ = ("tag", "parent", "own", "level", "main", "mute")

    def __init__(self, tag: str, parent: _Element | None, own: int, main: int):
        self.tag, self.parent, self.own, self.main = tag, parent, own, main
        self.level = max(own, parent.level if parent is not None else 0)
        self.mute = bool(own) and tag in _INLINE or parent is not None and parent.mute  # no part of the line around it


def _named(*names: str) -> set[str]:
    """The words that name an element, from its class and id."""
    out = set()
    for token in " ".join(names).split():
        words = [w.lower() for w in _NAME.findall(token)]
        if words and words[0] not in _BESIDE and words[-1] not in _STATES:
            out.update(words)
    return out


class _Lines(HTMLParser):
    """Collects (text, tags, element) for each line of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.at = _Element("", None, 0, 0)
        self.lines: list[tuple[str, int, _Element]] = []
        self.words: list[str] = []
        self.tags = 0

    def end_line(self):
        text = " ".join("".join(self.words).split())
        if text:
            self.lines.append((text, self.tags, self.at))
            self.tags = 0
        self.words.clear()

    def _main_around(self) -> int:
        most, e = 0, self.at
        while e is not None and most < 2:
            most, e = max(most, e.main), e.parent
        return most

    def handle_starttag(self, tag, attrs):
        block = tag not in _INLINE
        if block:
            self.end_line()
        self.tags += 1
        if tag in _VOID:
            return
        if block and tag != "p":
            self._close("p", stop=("td", "th", "article", "main", "section", "div", "body", "li"))
        elif tag == "p":
            self._close("p", stop=("td", "th", "article", "main", "section", "div", "body", "li", "blockquote"))
        if tag in ("li", "tr", "td", "th", "dt", "dd", "option"):
            self._close(tag, stop=("ul", "ol", "table", "dl", "select"))
        a = {k: v or "" for k, v in attrs}
        main = 2 if tag in ("article", "main") or a.get("role") in ("main", "article") else 0
        drop = UNSEEN if tag in _DROP else _DROP_TAGS.get(tag, 0)
        if tag not in ("html", "body"):
            names = _named(a.get("class", ""), a.get("id", ""))
            around = self._main_around()
            heads = around == 2 or around and names & _MAIN_WORDS  # an article's own header
            if tag == "header" and around < 2:
                drop = max(drop, LAYOUT)
            if block or names & {"ad", "ads", "hidden"}:
                found = [v for w, v in _DROP_WORDS.items() if w in names
                         and not (heads and w in ("header", "masthead")) and (not main or v >= ADVERT)]
                if not main and a.get("role", "").lower() in _DROP_ROLES:
                    found.append(LAYOUT if a["role"].lower() in ("form", "search") else BOILERPLATE)
                drop = max([drop, *found])
            if block and not main and names & _MAIN_WORDS:
                main = 1
            if "hidden" in a or a.get("aria-hidden") == "true" or \
                    "display:none" in a.get("style", "").replace(" ", "").lower():
                drop = UNSEEN
        self.at = _Element(tag, self.at, drop, main)

    def _close(self, tag: str, stop: tuple[str, ...] = ()):
        """Leaves the innermost open element of that tag, unless one of ``stop`` lies within."""
        e = self.at
        while e is not None and e.tag != tag:
            if e.tag in stop:
                return
            e = e.parent
        if e is not None and e.parent is not None:
            self.at = e.parent

    def handle_endtag(self, tag):
        if tag not in _INLINE:
            self.end_line()
        self.tags += 1
        if tag not in _VOID:
            # inline elements left open don't hold what follows the block that they stand in
            self._close(tag, stop=() if tag not in _INLINE else ("p", "li", "td", "div", "article", "section", "main"))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_data(self, data):
        if not self.at.mute:
            self.words.append(data)

    def handle_comment(self, data):
        self.tags += 1


def _smoothed(ratios: list[float]) -> list[float]:
    weights = [math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-RADIUS, RADIUS + 1)]
    out = []
    for i in range(len(ratios)):
        near = [(weights[k - i + RADIUS], ratios[k])
                for k in range(max(0, i - RADIUS), min(len(ratios), i + RADIUS + 1))]
        out.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    return out


def content_lines(ratios: list[float]) -> list[bool]:
    """Which lines the threshold clusters as content."""
    if not ratios:
        return []
    smooth = _smoothed(ratios)
    mean = sum(smooth) / len(smooth)
    limit = THRESHOLD * math.sqrt(sum((s - mean) ** 2 for s in smooth) / len(smooth))
    return [s >= limit for s in smooth]


def main_text(html: str | None) -> str:
    """The article's lines, joined by line feeds; empty where a page has none."""
    page = _Lines()
    page.feed(html or "")
    page.close()
    page.end_line()
    lines = page.lines
    content = content_lines([len(t) / max(1, n) for t, n, _ in lines])
    weights = [len(t) * (1 + 9 * seed) for (t, _, _), seed in zip(lines, content)]
    # by article element, the text that nothing in it drops and the text that layout in it would drop
    mass: dict[_Element, list[int]] = {}
    seeded: set[_Element] = set()
    rest = [0, 0]
    for (_, _, at), weight, seed in zip(lines, weights, content):
        worst, e = 0, at
        while e is not None and worst <= LAYOUT:
            if e.main == 2 and e.own < ADVERT and e.level < UNSEEN:
                mass.setdefault(e, [0, 0])[worst] += weight
            if e.main and seed:
                seeded.add(e)
            worst, e = max(worst, e.own), e.parent
        if worst <= LAYOUT:
            rest[worst] += weight
    if mass:
        plain = [e for e in mass if e.level <= LAYOUT]
        held = [e for e in mass if e.level < COMMENT]
        heaviest = max(plain or held or mass, key=lambda e: sum(mass[e]))
        if plain or held and sum(mass[heaviest]) >= sum(rest) or not any(rest):
            least = heaviest.level
            chosen = {e for e in mass if e.level <= least and (e in seeded or e is heaviest)}
            limit = {e: LAYOUT if mass[e][1] > HEAVIER * mass[e][0] else 0 for e in chosen}

            def inside(e):
                worst = 0
                while e is not None and worst <= LAYOUT:
                    if e in chosen and worst <= limit[e]:
                        return True
                    worst, e = max(worst, e.own), e.parent
                return False
            return "\n".join(t for t, _, at in lines if inside(at))
    most = LAYOUT if rest[1] > HEAVIER * rest[0] else 0
    own = [i for i, (_, _, at) in enumerate(lines) if at.level <= most]
    if not own:  # nothing else is left of the page than what boilerplate's names hold
        own = [i for i, (_, _, at) in enumerate(lines) if at.level == BOILERPLATE and content[i] and not _by_tag(at)]

    def named(e):
        while e is not None and not (e.main and e in seeded):
            e = e.parent
        return e is not None
    held = {i for i in own if named(lines[i][2])}
    seeds = [i for i in own if content[i]] or own
    if held:
        return "\n".join(lines[i][0] for i in own if i in held or content[i])
    return "\n".join(lines[i][0] for i in own if seeds[0] <= i <= seeds[-1])


def _by_tag(e: _Element | None) -> bool:
    while e is not None and e.tag not in _DROP_TAGS:
        e = e.parent
    return e is not None


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text): one row per page row, from its whole html.

    Null html is empty html; a page without an article has the empty text. Repeated rows, null
    ids and null urls are kept as they are; an empty table gives an empty result. Only page_id,
    url and html are read. Broken markup is read as far as events come out of it.
    """
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())],
                                             names=["page_id", "url", "text"])

    ship(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html")).mapInArrow(
        run, "page_id long, url string, text string")
