"""Main text of web pages by parser events and text-to-tag ratios.

The standard library's streaming parser turns a page into lines, one per block of text, each with its characters, its
tags, its link characters and the containers it stands in. The text-to-tag ratios of the lines are smoothed with a
Gaussian, and lines at or above one standard deviation form the content clusters. Their characters vote for the
containers around them: the region is the article or main element with most votes (a main element's outside its articles), or else the innermost
container that holds ``MOST`` of all votes. The region gives all its lines but those of page furniture (menus, headers, footers, side
bars, notices, adverts, forms, reader comments, hidden parts), so a short paragraph between long ones stays; outside an
article element, lines that are mostly links and below the threshold by themselves go as well, and in a main element the articles that
begin with a link (cards). Articles beside the best one that hold half its votes are parts of it. A box whose id is the slug of
its first heading is a section of that name and no furniture, unless it is mostly links. A form that holds the article or most of the text is no furniture. Classes and ids name
furniture on containers only, not on headings or inline elements.

Character references are decoded; white space inside a block becomes one blank; a line break is white space, the cells
of a table row are parts of one block; blocks are joined in page order by a line feed.

Defined cases: null, empty or markup-only pages give an empty text; unclosed, misnested and cut-off markup is read as far
as it goes; repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import by_batch

MOST = 0.8
RADIUS = 2
LINKED = 0.5
SHARE = 0.5
# fixed values: element names of HTML
CONTAINERS = frozenset("article main body section div td table aside nav header footer form ul ol dl blockquote figure details dialog menu".split())
BLOCKS = (CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr pre hr address caption figcaption fieldset legend summary center option thead tbody tfoot html head".split())) - {"td"}
SPACED = frozenset("br td th".split())
# elements without an end tag, and the start tags that end them
CELLS = frozenset("td th tr thead tbody tfoot".split())
ENDED = {"p": BLOCKS | {"td", "th"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": CELLS, "th": CELLS}
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = frozenset("script style noscript template title svg annotation iframe object audio video canvas select button textarea datalist".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE = frozenset("nav aside footer form dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
HEADS = frozenset(["header", "masthead"])
# elements whose class and id can name furniture (advert slots are ins elements)
NAMEABLE = CONTAINERS | {"ins"}
# words in class and id that name page furniture
NAMES = frozenset(
    "ad ads adsbygoogle adv advert adverts advertisement advertising sponsor sponsored promo promotion sidebar cookie cookies consent gdpr notice notices "
    "banner popup modal overlay newsletter subscribe subscription share sharing social related recommended recommendations comment comments "
    "disqus respond replies feedback menu nav navbar navigation breadcrumb breadcrumbs footer pagination pager widget toolbar login signup search skip".split()
)
# of these, words that a box around the whole page may carry as well ("with-sidebar")
LAYOUT = frozenset("sidebar menu nav navbar navigation banner widget toolbar header masthead".split())
# of these, words that stay furniture under a heading of the same name
NEVER_HEADED = frozenset("ad ads adsbygoogle adv advert adverts advertisement comment comments disqus respond replies cookie cookies consent gdpr newsletter subscribe".split())
NUMBERED = re.compile(r"-\d+$")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def slug(text: str) -> str:
    return "-".join(re.findall(r"[^\W_]+", text.lower()))


class _Box:
    """A container element: its name, the box around it, and whether it is furniture."""

    __slots__ = ("article", "furniture", "headed", "layout", "named", "parent", "slug", "tag", "votes")

    def __init__(self, tag: str, parent: _Box | None, furniture: bool, named: bool, layout: bool = False) -> None:
        self.tag, self.parent, self.furniture, self.named, self.layout, self.votes = tag, parent, furniture, named, layout, 0
        self.article = tag in ("article", "main") or bool(parent and parent.article)
        self.slug: str | None = None  # the id, where it alone names the box
        self.headed = False

    def around(self) -> Iterator[_Box]:
        box = self
        while box:
            yield box
            box = box.parent


class _Lines(HTMLParser):
    """Collects (text, tags, link characters, box) per block."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, _Box]] = []
        self.root = self.box = _Box("page", None, False, False)
        self.words: list[str] = []
        self.tags = self.linked = self.links = 0
        self.unseen: list[str] = []
        self.inside_unseen: list[str] = []
        self.endable = False

    def _end_line(self) -> None:
        if self.words:
            text = " ".join("".join(self.words).split())
            if text:
                self.lines.append((text, self.tags, self.linked, self.box))
            self.words = []
        self.tags = self.linked = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in UNSEEN:
            self.unseen.append(tag)
            return
        if self.unseen:
            if tag in CONTAINERS:
                self.inside_unseen.append(tag)
            return
        if tag == "a":
            self.links += 1
        if tag in SPACED:
            self.words.append(" ")
        if tag in BLOCKS:
            self._end_line()
            self.tags = 1
        if self.endable:
            self._end_siblings(tag)
        if tag in CONTAINERS and tag != "td" or attrs and tag not in VOID and tag != "html" and self._named(tag, attrs):
            self._open(tag, dict(attrs))

    def _end_siblings(self, tag: str) -> None:
        """Closes the box of an element that this start tag ends, within the nearest container around it."""
        for box in self.box.around():
            if tag in ENDED.get(box.tag, ()):
                self._end_line()
                self.box = box.parent
            if box.tag in CONTAINERS and box.tag not in ("div", "td"):
                break

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in UNSEEN:
            return
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    @staticmethod
    def _named(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        """Whether class, id or role names furniture, or the element is hidden."""
        for key, value in attrs:
            value = value or ""
            if key in ("class", "id") and tag in NAMEABLE and any(w.lower() in NAMES for w in PARTS.findall(value)):
                return True
            if key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                return True
            if key == "style" and HIDDEN.search(value):
                return True
        return False

    def _open(self, tag: str, attrs: dict[str, str | None]) -> None:
        named = tag not in ("body", "main") and self._named(tag, list(attrs.items()))
        head = tag in HEADS or any(w.lower() in HEADS for k in ("class", "id") for w in PARTS.findall(attrs.get(k) or ""))
        sure = tag in FURNITURE or head and tag == "header" and not self.box.article
        named = named or head and not self.box.article and tag not in ("body", "main", "article")
        if tag in ("article", "main"):
            for box in self.box.around():  # a box that holds the article is no side bar or menu, whatever its class says
                if box.layout:
                    box.named = False
                if box.tag == "form":
                    box.furniture = False
        words = {w.lower() for k in ("class", "id") for w in PARTS.findall(attrs.get(k) or "")}
        layout = named and not words & NAMES - LAYOUT and not ("hidden" in attrs or "role" in attrs or "aria-hidden" in attrs or "style" in attrs)
        self.box = _Box(tag, self.box, sure, named, layout)
        own = attrs.get("id")
        if own and named and not sure and not self._named(tag, [x for x in attrs.items() if x[0] != "id"]) and not words & NEVER_HEADED:
            self.box.slug = NUMBERED.sub("", slug(own))
        self.endable = self.endable or tag in ENDED

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if self.unseen:
            if tag in self.unseen:
                while self.unseen.pop() != tag:
                    pass
                if not self.unseen:
                    self.inside_unseen = []
                return
            if tag in self.inside_unseen:
                while self.inside_unseen.pop() != tag:
                    pass
                return
            if tag not in CONTAINERS or not any(box.tag == tag for box in self.box.around()):
                return
            self.unseen, self.inside_unseen = [], []  # an element that was never closed ends with the box around it
        if tag == "a" and self.links:
            self.links -= 1
        if tag in SPACED:
            self.words.append(" ")
        if tag in BLOCKS:
            before = len(self.lines)
            self._end_line()
            if tag in HEADINGS and len(self.lines) > before:
                self._head(self.lines[-1][0])
        for box in self.box.around():
            if box.tag == tag:
                if tag not in BLOCKS and tag not in SPACED:
                    self._end_line()
                self.box = box.parent
                break

    def _head(self, heading: str) -> None:
        """A box whose id is the slug of its first heading is a section of that name."""
        for box in self.box.around():
            if box.slug is not None:
                box.headed = box.headed or NUMBERED.sub("", slug(heading)) == box.slug
                box.slug = None
                return

    def handle_data(self, data: str) -> None:
        if self.unseen:
            return
        self.words.append(data)
        if self.links:
            self.linked += len(data)

    def unknown_decl(self, data: str) -> None:
        """Conditional sections hold nothing."""

    def close(self) -> None:
        super().close()
        self._end_line()


def lines_of(html: str) -> tuple[list[tuple[str, int, int, _Box]], _Box]:
    parser = _Lines()
    try:
        parser.feed(html)
        parser.close()
    except AssertionError:  # a marked section the parser refuses
        parser = _Lines()
        parser.feed(html.replace("<![", "&lt;!["))
        parser.close()
    return parser.lines, parser.root


def smoothed(ratios: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Gaussian with a standard deviation of half the radius; the ends repeat."""
    at = np.arange(-radius, radius + 1)
    kernel = np.exp(-(at**2) / (2 * (radius / 2) ** 2))
    return np.convolve(np.pad(ratios, radius, mode="edge"), kernel / kernel.sum(), mode="valid")


def _open_forms(lines: list[tuple[str, int, int, _Box]]) -> None:
    """A form that holds most of the text outside other furniture is a layout box."""
    total, held = 0, {}
    for text, _, _, box in lines:
        around = list(box.around())
        if not any(b.named or b.furniture and b.tag != "form" for b in around):
            total += len(text)
            for b in around:
                if b.tag == "form":
                    held[b] = held.get(b, 0) + len(text)
    for form, n in held.items():
        if 2 * n > total:
            form.furniture = False


def _open_sections(lines: list[tuple[str, int, int, _Box]]) -> None:
    """A box whose id is the slug of its heading is no furniture, unless it is mostly links."""
    held: dict[_Box, list[int]] = {}
    for text, _, linked, box in lines:
        for b in box.around():
            if b.headed and b.named:
                size = held.setdefault(b, [0, 0])
                size[0] += len(text)
                size[1] += linked
    for box, (size, linked) in held.items():
        if linked <= LINKED * size:
            box.named = False


def _parts(articles: dict[_Box, int], best: _Box, lines: list[tuple[str, int, int, _Box]]) -> set[_Box]:
    """The best article with those beside it that hold ``SHARE`` of its votes and do not begin with a link (cards do)."""
    first: dict[_Box, bool] = {}
    for text, _, linked, box in lines:
        for b in box.around():
            if b in articles and b not in first:
                first[b] = linked > LINKED * len(text)
    beside = {b for b, n in articles.items() if b.tag == best.tag == "article" and b.parent is best.parent and n >= SHARE * articles[best] and not first[b]}
    return beside | {best}


def _without_cards(lines: list[tuple[str, int, int, _Box]], region: _Box) -> list[tuple[str, int, int, _Box]]:
    """The lines of a main element outside the articles in it that begin with a link; those of an article as they are."""
    if region.tag != "main":
        return lines
    card: dict[_Box, bool] = {}
    kept = []
    for line in lines:
        text, _, linked, box = line
        inner = [b for b in itertools.takewhile(lambda b: b is not region, box.around()) if b.tag == "article"]
        for b in inner:
            card.setdefault(b, linked > LINKED * len(text))
        if not any(card[b] for b in inner):
            kept.append(line)
    return kept


def main_text(html: str | None) -> str:
    lines, root = lines_of(html) if html else ([], None)
    _open_forms(lines)
    _open_sections(lines)
    own = [x for x in lines if not any(b.furniture or b.named for b in x[3].around())]
    own = own or [x for x in lines if not any(b.furniture for b in x[3].around())]
    if not own:
        return ""
    ratios = smoothed(np.array([len(t) / max(tags, 1) for t, tags, _, _ in own], dtype=np.float64))
    high = ratios >= min(ratios.std(), ratios.max())
    articles: dict[_Box, int] = {}
    total = 0
    for (text, _, _, box), is_high in zip(own, high.tolist(), strict=True):
        if is_high:
            total += len(text)
            inside = False
            for b in box.around():
                b.votes += len(text)
                if b.tag == "article" or b.tag == "main":
                    articles[b] = articles.get(b, 0) + (0 if inside and b.tag == "main" else len(text))
                inside = inside or b.tag == "article"
    if articles:
        region = max(articles, key=lambda b: (articles[b], b.tag == "article"))
        parts = _parts(articles, region, own)
        return "\n".join(t for t, _, _, _ in _without_cards([x for x in own if any(b in parts for b in x[3].around())], region))
    best = max((x for x, h in zip(own, high.tolist(), strict=True) if h), key=lambda x: len(x[0]))
    region = next((b for b in best[3].around() if b.votes >= MOST * total), root)
    least = min(ratios.std(), ratios.max())
    kept = [
        t for t, tags, linked, box in own
        if any(b is region for b in box.around()) and (linked <= LINKED * len(t) or len(t) / max(tags, 1) >= least)
    ]
    return "\n".join(kept)


def extracted(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` per page."""

    def work(batch: pa.RecordBatch) -> Iterator[dict[str, list]]:
        for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
            texts = [main_text(h) for h in part.column("html").to_pylist()]
            yield {"page_id": part.column("page_id").to_pylist(), "url": part.column("url").to_pylist(), "text": texts, "n_chars": [len(t) for t in texts]}

    return by_batch(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), "page_id long, url string, text string, n_chars long", work)
