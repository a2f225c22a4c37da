"""The main text of web pages.

Method: two passes of block rules. A page is cut into blocks at block tags. The first pass classes each block by itself: by
its link density, its length and the share of stop words. Short blocks and those with few stop words are left undecided. In
the second pass these inherit the label of the nearest decided blocks before and after them.

What the markup says is a prior. Blocks of navigation, adverts, comments and the like, by tag, role or class, are out. A class or
id name, or a form around them, says that only as long as the page has an article, or other dense text, elsewhere: of elements
that are out by name those that hold an article are let in again, else the one with the most dense text. Names that say how a page
is laid out (has-sidebar, comments-open) say nothing of what an element is. Where a page has hardly any stop word of the four
languages, its language is another one, and length and links alone decide. If no block is left, all that aren't out or links are kept.
Inside a page's article element a block without stop words is undecided rather than bad, only decided blocks of an article
count as neighbours, and a missing neighbour counts as good. Outside of it, where a page has one, a block must be long and full
of stop words, or stand between two good ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

# HTML element names, words of class and id names, and frequent words of four languages.
_DROPPED = frozenset("script style noscript template textarea svg math iframe object canvas select button datalist audio video head".split())
_OUTSIDE = frozenset("nav header footer aside menu dialog".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea template noscript iframe title".split())
_SCOPES = frozenset("p li td div article body section".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|notices?|notification|alert|"
    r"sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|"
    r"popup|modal|overlay|widget|toolbar|pagination|pager|disclaimer|copyright)(?:$|[\s_-])",
    re.IGNORECASE,
)
_COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|respond|replies)(?:$|[\s_-])", re.IGNORECASE)
_LAYOUT = re.compile(r"(?:^|\s)(?:(?:has|no|with|without|is|show|hide)[_-]\S*|\S*[_-](?:open|closed|enabled|disabled|fixed|on|off|active|collapsed))(?=$|\s)", re.IGNORECASE)
_STOP_WORDS = frozenset(
    "the of and to in a is that it for was on are as with be at by this have from or not but his her they we you which an were "
    "le la les de des du et un une en est que qui dans pour pas sur par au avec se ce il elle ne plus sont ou "
    "der die das und ist in zu den von mit ein eine nicht auf für im dem des sich auch es an werden aus er hat dass sie nach wird bei "
    "el los las del y que en un una es por con no para su al lo como más pero sus o este ha".split()
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"\w+")

#: Characters of a short and of a long block; shares of stop words; the share of link characters of a list of links.
SHORT, LONG = 70, 200
FEW_STOPS, MANY_STOPS = 0.15, 0.25
MOST_LINKS = 0.4
#: Words that a page needs to tell its language, and the share of stop words below which it's none of the four.
TELLING, NO_STOPS = 30, 0.01


class _Block:
    __slots__ = ("article", "barred", "by_name", "counts", "heading", "linked", "outside", "text")

    def __init__(self, text: str, linked: int, barred: bool, article: bool, heading: bool, by_name: int = -1):
        """barred: out by tag, role or what comments are called; by_name: the innermost element that is out by its name only, -1 if none."""
        self.text, self.linked, self.barred, self.article, self.heading, self.by_name = text, linked, barred, article, heading, by_name
        self.outside = barred
        self.counts: tuple[int, int] | None = None

    def words(self) -> tuple[int, int]:
        """The number of words, and of stop words."""
        if self.counts is None:
            words = _WORD.findall(self.text.lower())
            self.counts = len(words), sum(w in _STOP_WORDS for w in words)
        return self.counts


def _kind(name: str, attributes: str) -> tuple[str, bool]:
    """What an element makes of its contents: "drop", "out", "in" (the article) or "" (nothing); and whether its name says that they are out."""
    if name in _DROPPED:
        return "drop", False
    found: dict[str, str] = {}
    if attributes:
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            found.setdefault(key.lower(), a or b or c)
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true":
            return "drop", False
    if name in ("body", "html"):
        return "", False
    role = found.get("role", "").lower()
    names = [_LAYOUT.sub(" ", unescape(found.get(k, ""))) for k in ("class", "id")]
    if name in _OUTSIDE or role in _ROLES or any(map(_COMMENTS.search, names)):
        return "out", False
    within = name in ("article", "main") or role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody"
    return "in" if within else "", name == "form" or any(map(_NAMES.search, names))


class _Tags:
    """The open elements. Each is looked up by name and closed once, so the time is linear in the number of tags."""

    def __init__(self):
        self.open: list[tuple[str, str]] = []
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.kinds = {"drop": 0, "out": 0, "in": 0, "": 0}
        #: Of each element that is out by name, the one around it and whether it holds an article; those that are open.
        self.around: list[int] = []
        self.holds: list[bool] = []
        self.named: list[int] = []
        self.named_at: list[int] = []

    def enter(self, name: str, kind: str, by_name: bool) -> None:
        if by_name:
            self.around.append(self.inner())
            self.holds.append(False)
            self.named.append(len(self.around) - 1)
            self.named_at.append(len(self.open))
        if kind == "in":
            one = self.inner()
            while one >= 0 and not self.holds[one]:
                self.holds[one] = True
                one = self.around[one]
        self.places.setdefault(name, []).append(len(self.open))
        if name in _SCOPES:
            self.scopes.append(len(self.open))
        self.open.append((name, kind))
        self.kinds[kind] += 1

    def inner(self) -> int:
        return self.named[-1] if self.named else -1

    def leave(self, name: str) -> None:
        """Closes the last open element of the name, with what is open in it; none open: nothing."""
        if not self.places.get(name):
            return
        while True:
            own, kind = self.open.pop()
            if self.named_at and self.named_at[-1] == len(self.open):
                self.named_at.pop()
                self.named.pop()
            self.kinds[kind] -= 1
            self.places[own].pop()
            if own in _SCOPES:
                self.scopes.pop()
            if own == name:
                return

    def ends(self, name: str) -> str | None:
        """The open element that a block tag ends: a paragraph, or the list item before this one."""
        if not self.scopes:
            return None
        last = self.open[self.scopes[-1]][0]
        return last if last == "p" or last == name == "li" else None


def _parsed(html: str) -> tuple[list[_Block], _Tags]:
    blocks: list[_Block] = []
    tags = _Tags()
    heading = False
    parts: list[str] = []
    linked = 0

    def end_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                blocks.append(_Block(text, min(linked, len(text)), tags.kinds["out"] > 0, tags.kinds["in"] > 0, heading, tags.inner()))
            parts.clear()
        linked = 0

    at, end = 0, len(html)
    while at < end:
        tag = _TOKEN.search(html, at)
        upto = tag.start() if tag else end
        dropped = tags.kinds["drop"] > 0
        if upto > at and not dropped:
            parts.append(html[at:upto])
            if tags.places.get("a"):
                linked += len(parts[-1].strip())
        if not tag:
            break
        at = tag.end()
        slash, name, attributes = (tag[1], tag[2], tag[3]) if tag[2] else (tag[4], tag[5], tag[6])
        if not name:
            continue
        name = name.lower()
        block = name in _BLOCKS
        if not dropped:
            if block:
                end_block()
            elif name == "br":
                parts.append(" ")
        if slash:
            heading = heading and not (name[0] == "h" and name[1:].isdigit())
            tags.leave(name)
            continue
        if name in _VOID or attributes.endswith("/") and not block and name != "a":
            continue
        if name in _RAW:  # their contents aren't markup
            close = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(html, at)
            at = close.end() if close else end
            continue
        if block:
            if (ended := tags.ends(name)) is not None:
                tags.leave(ended)
            heading = name[0] == "h" and name[1:].isdigit() or heading and name not in ("p", "div", "section", "li")
        if name == "body":  # an open head ends here
            tags.leave("head")
        tags.enter(name, *_kind(name, attributes))
    end_block()
    return blocks, tags


def _foreign(blocks: list[_Block]) -> bool:
    """Whether the page's language is none of the four."""
    counts = [b.words() for b in blocks if not b.barred]
    words = sum(n for n, _ in counts)
    return words >= TELLING and sum(n for _, n in counts) < NO_STOPS * words


def _let_in(blocks: list[_Block], tags: _Tags, foreign: bool) -> None:
    """Sets which blocks are out, and lets elements that are out by name only in again until the page has an article or dense text."""
    around, holds = tags.around, tags.holds
    if all(b.by_name < 0 for b in blocks):
        return
    lifted = [False] * len(around)
    alone, whole = [], [0] * len(around)  # whole: the dense text in an element
    for b in blocks:
        b.outside = b.barred
        alone.append(_first_pass(b, False, foreign) in ("good", "near"))
        if alone[-1] and b.by_name >= 0:
            whole[b.by_name] += len(b.text)
    for k in range(len(around) - 1, -1, -1):
        if around[k] >= 0:
            whole[around[k]] += whole[k]
    while True:
        top = [-1] * len(around)  # the outermost element that still bars
        for k, (outer, free) in enumerate(zip(around, lifted, strict=True)):
            top[k] = top[outer] if outer >= 0 and top[outer] >= 0 else -1 if free else k
        dense: dict[int, int] = {}
        article = other = False
        for b, good in zip(blocks, alone, strict=True):
            bar = top[b.by_name] if b.by_name >= 0 else -1
            b.outside = b.barred or bar >= 0
            if good and bar >= 0:
                dense[bar] = dense.get(bar, 0) + len(b.text)
            elif good and not b.barred:
                article, other = article or b.article, True
        held = [k for k in dense if holds[k]]
        if article or not dense or other and not held:
            return
        new = set(held or [max(dense, key=dense.get)])
        for k in range(min(new), len(around)):  # with an element those inside of it that hold all of its dense text
            if k in new or around[k] in new and whole[k] == whole[around[k]]:
                new.add(k)
                lifted[k] = True


def _blocks(html: str) -> list[_Block]:
    blocks, tags = _parsed(html)
    _let_in(blocks, tags, _foreign(blocks))
    return blocks


def _first_pass(block: _Block, has_article: bool, foreign: bool = False) -> str:
    """good, bad, near (few words speak for it) or short, from the block alone; foreign: stop words say nothing."""
    text = block.text
    density = block.linked / len(text)
    if block.outside or density > MOST_LINKS or text.startswith(("©", "(c) ")):
        return "bad"
    if len(text) < SHORT:
        return "bad" if density > 0 and not block.article else "short"
    if foreign:
        return "good" if len(text) > LONG else "near"
    words, stops = block.words()
    stops /= max(1, words)
    if stops >= MANY_STOPS and len(text) > LONG:
        return "good"
    if block.article:
        return "near"
    return "bad" if stops < FEW_STOPS else "short" if has_article else "near"


def _second_pass(blocks: list[_Block], labels: list[str]) -> list[bool]:
    """Whether each block is kept: undecided ones go by the nearest decided ones before and after them."""
    n = len(labels)
    near = []
    for order in (range(n), range(n - 1, -1, -1)):
        side, last = [""] * n, {True: "good", False: "bad"}  # what stands for a missing neighbour inside and outside an article
        for i in order:
            side[i] = last[blocks[i].article]
            if labels[i] in ("good", "bad") and not (blocks[i].article and blocks[i].outside):
                last[blocks[i].article] = labels[i]
        near.append(side)
    kept = []
    for i, (block, label, before, after) in enumerate(zip(blocks, labels, *near, strict=True)):
        if block.article:
            good = label == "good" or label != "bad" and "good" in (before, after)
        elif label == "near":
            # with some stop words among bad ones, it needs another of its kind beside it
            good = "good" in (before, after) or "near" in (labels[i - 1 : i] + labels[i + 1 : i + 2])
        elif label == "short":
            good = before == after == "good" or block.heading and after == "good"
        else:
            good = label == "good"
        kept.append(good)
    return kept


def main_text(html: str | None) -> str:
    """The main text of one page: blocks in page order, joined by two line feeds."""
    blocks = _blocks(html or "")
    has_article, foreign = any(b.article and not b.outside for b in blocks), _foreign(blocks)
    labels = [_first_pass(b, has_article, foreign) for b in blocks]
    kept = [b for b, good in zip(blocks, _second_pass(blocks, labels), strict=True) if good]
    if not kept:  # all that there is
        kept = [b for b in blocks if not b.outside and b.linked <= MOST_LINKS * len(b.text) and not b.text.startswith(("©", "(c) "))]
    return "\n\n".join(b.text for b in kept)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html"):
            text = [main_text(h) for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])


def html_extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of the main text of whole pages.

    White space inside a block is one space; blocks are joined by two line feeds. Null and empty pages, and pages without main
    text, have the text "". Markup that isn't closed ends with the page. One row for each input row; a null url stays null;
    extra columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(_rows, "page_id long, url string, text string, n_chars long")
