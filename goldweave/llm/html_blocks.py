"""Main text of web pages: blocks classified in two passes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words of the languages pages come in.
STOP_WORDS = frozenset((
    "a about after all also an and any are as at be been but by can could do for from had has have he her his i if in into "
    "is it its more no not of on or our she so some than that the their them there these they this to was we were what when "
    "which who will with would you your "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que "
    "qui sa se ses son sont sur un une vous "
    "aber als am an auch auf aus bei bin das dass dem den der des die du durch ein eine einem einen einer er es für hat ich "
    "ihr im in ist ja kann mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wie wir zu zum "
    "al como con cuando de del desde donde el ella ellos en era es esta este fue ha hay la las lo los más me mi muy no o "
    "para pero por porque que se ser si sin sobre son su sus también un una y ya").split())

# Elements that never hold main text, whose content is raw, that end a block, and that have no end tag.
_DROPPED = frozenset("nav footer aside button select option label noscript svg canvas iframe object video audio template "
                     "head dialog menu fieldset map math embed applet datalist".split())
_RAW = frozenset("script style textarea title xmp noembed noframes".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure "
                   "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre section summary "
                   "table tbody tfoot thead tr ul caption".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_MAIN = frozenset(("article", "main"))

# Words of class and id names of parts besides the article, of page headers, of reader comments, of the
# article itself, words that turn a name around, and roles of such parts.
_AWAY = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos "
    "promotion banner banners cookie cookies consent gdpr notice notices popup modal overlay newsletter newsletters "
    "subscribe subscription signup login side sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs "
    "pagination pager footer footers share sharing social related recommended recommendations widget widgets toolbar "
    "copyright search dialog".split())
_HEADERS = frozenset("header headers masthead topbar".split())
_COMMENTS = frozenset("comment comments commentlist disqus replies respond".split())
_HERE = frozenset("article content post entry main body story text".split())
_TURNED = frozenset("has with no not non without is".split())
_ROLES = frozenset("navigation banner complementary contentinfo search dialog alertdialog alert form menu menubar toolbar".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_WIDE = re.compile("[\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff]")  # a character of these scripts says as much as three letters
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|"""
    r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^<>]*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)

# Fixed values of the classification: characters of a short and a long block, densities, the stop-word density below
# which a page is in no known language, and how much more text than the largest article unmarked blocks must hold.
SHORT, LONG, STOP_LOW, STOP_HIGH, LINKS = 70, 200, 0.2, 0.3, 0.5
UNKNOWN_LANGUAGE, OUTWEIGHS = 0.05, 2


@dataclass
class Block:
    text: str
    links: float
    heading: bool
    article: int  # number of the outermost article or main element around it, 0 for none
    parent: int  # number of the element that holds it
    names: tuple[str, ...]  # of the elements around it that are named like parts besides the article

    @property
    def length(self) -> int:
        return len(self.text) if self.text.isascii() else len(self.text) + 2 * len(_WIDE.findall(self.text))


class _Open:
    __slots__ = ("name", "number", "away", "article", "post", "link", "names")

    def __init__(self, name: str, number: int, away: bool, article: int, post: bool, link: bool, names: tuple[str, ...]):
        self.name, self.number, self.away, self.article, self.post, self.link, self.names = name, number, away, article, post, link, names


_ROOT = _Open("", 0, False, 0, False, False, ())


@lru_cache(maxsize=1 << 14)
def _signs(attributes: str) -> tuple[bool, str, bool, tuple[str, ...]]:
    """Whether an element is hidden or has the role of another part, its role, whether it is named like an article,
    and the names that say it is another part: whole class or id words, or names that start or end with one."""
    hidden, role, post, names = False, "", False, []
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (
                key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            hidden = True
        elif key == "role":
            role = value.strip().lower()
            hidden = hidden or role in _ROLES
        elif key in ("class", "id"):
            for token in value.split():
                words = [w.lower() for w in _WORD.findall(token)]
                post = post or not _HERE.isdisjoint(words)
                words = [w for w in words if not w.isdigit()]  # numbers tell copies of an element apart
                if words and _TURNED.isdisjoint(words):
                    name = "-".join(words)
                    for word in (words[0], words[-1]):
                        if word in _COMMENTS:
                            names.append("comments:" + name)
                        elif word in _AWAY:
                            names.append(("whole:" if len(words) == 1 else "part:") + name)
                        elif word in _HEADERS:
                            names.append("header:" + name)
    return hidden, role, post, tuple(dict.fromkeys(names))


def _element(name: str, number: int, attributes: str, up: _Open) -> _Open:
    hidden, role, post, names = _signs(attributes) if attributes else (False, "", False, ())
    whole_page = name in ("html", "body")
    within = bool(up.article) or up.post
    away = up.away or (not whole_page and (hidden or name in _DROPPED or (name == "header" and not within)))
    main = name in _MAIN or role in _MAIN
    if whole_page or name == "main" or role == "main":
        names = ()
    elif any(n.startswith("header:") for n in names):  # the header of an article holds its title
        names = tuple(n for n in names if not n.startswith("header:") or not (within or post))
    if name == "form":
        names += ("part:form",)
    if name == "article" and "article" in up.names:  # an article inside an article is a comment on it
        names += ("comments:article",)
    if names and name not in _BLOCK:  # a name inside a line of text
        away, names = True, ()
    marks = tuple(dict.fromkeys(up.names + names + (("article",) if name == "article" else ())))
    return _Open(name, number, away, up.article or (number if main else 0), within or (post and not whole_page),
                 name == "a" or up.link, marks)


def blocks(html: str) -> list[Block]:
    """The page's text blocks in order, without elements that never hold main text and hidden ones."""
    out: list[Block] = []
    stack: list[_Open] = []
    parts: list[tuple[str, bool]] = []
    heading, breaks, count, at = False, 0, 0, 0

    def end_block() -> None:
        text = " ".join("".join(t for t, _ in parts).split())
        if text:
            linked = sum(len(t.strip()) for t, link in parts if link)
            holder = next((e for e in reversed(stack) if e.name not in ("p", "a", "b", "i", "em", "strong", "span", "font") and not
                           (e.name[0] == "h" and e.name[1:].isdigit())), _ROOT)
            top = stack[-1] if stack else _ROOT
            out.append(Block(text, min(linked / len(text), 1.0), heading, top.article, holder.number,
                             tuple(n for n in top.names if ":" in n)))
        parts.clear()

    while True:
        m = _TOKEN.search(html, at)
        raw = html[at:m.start() if m else len(html)]
        top = stack[-1] if stack else _ROOT
        if raw and not top.away:
            parts.append((unescape(raw), top.link))
            if breaks and not raw.isspace():
                breaks = 0
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        ending, attributes = m[1] or m[4], m[3] or m[6] or ""
        if name == "br":
            parts.append((" ", False))
            breaks += 1
            if breaks > 1:
                end_block()
                breaks = 0
            continue
        if name in _BLOCK:
            end_block()
            breaks = 0
            heading = not ending and name[0] == "h" and name[1:].isdigit()
        elif name in ("td", "th"):
            parts.append((" ", False))
        if ending:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name), None)
            if depth is not None:
                del stack[depth:]
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if name in _VOID or attributes.endswith("/"):
            continue
        if name in _BLOCK:  # a block ends an open paragraph, a list item the one before
            for i in range(len(stack) - 1, max(len(stack) - 12, -1), -1):
                if stack[i].name == "p" or (name == "li" and stack[i].name == "li"):
                    del stack[i:]
                    break
                if stack[i].name in _BLOCK:
                    break
        count += 1
        stack.append(_element(name, count, attributes, stack[-1] if stack else _ROOT))
    end_block()
    return out


def _readable(block: Block) -> int:
    """Characters of a block that may be of an article: short ones and lists of links don't count, unless marked."""
    return block.length if block.links <= LINKS and (block.length >= SHORT or block.article) else 0


def without_other_parts(found: list[Block]) -> list[Block]:
    """The blocks outside elements named like menus, adverts, sidebars, comments and the like.

    Names mislead, so a name is passed over where the page would lose its article by it: one that
    merely starts or ends like such a part, or a form, if its elements hold over half of the readable text outside
    whole names and comments; any other if nothing readable is left outside, comments judged last.
    """
    held: dict[str, int] = {}
    for b in found:
        for n in b.names:
            held[n] = held.get(n, 0) + _readable(b)
    if not held:
        return found
    away = set(held)
    text = sum(_readable(b) for b in found if all(n.startswith("part:") for n in b.names))
    for n in held:
        if n.startswith("part:"):
            own = sum(_readable(b) for b in found if n in b.names and all(x.startswith("part:") for x in b.names))
            if 2 * own > text:
                away.discard(n)
    for n in sorted(away, key=lambda n: (n.startswith("comments:"), -held[n], n)):
        if held[n] and not any(_readable(b) for b in found if away.isdisjoint(b.names)):
            away.discard(n)
    return [b for b in found if away.isdisjoint(b.names)]


def _stop_density(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / max(len(words), 1)


def _first_pass(block: Block, marked: bool, known: bool) -> str:
    """``good``, ``bad``, ``near`` (good if its neighbours don't differ) or ``short`` from the block alone.

    ``marked`` says that the block lies in the article the page marks, ``known`` that the page's
    language has known stop words; without them length and links decide.
    """
    if block.links > LINKS:
        return "bad"
    if block.heading:
        return "near"
    density = _stop_density(block.text)
    if marked:  # only undecided blocks ask their neighbours
        return "good" if block.length >= SHORT or density >= STOP_LOW else "short"
    if block.length < SHORT:
        return "short"
    if not known or density >= STOP_HIGH:
        return "good" if block.length > LONG else "near"
    return "near" if density >= STOP_LOW else "bad"


def _second_pass(found: list[Block], labels: list[str], marked: bool) -> list[bool]:
    """Undecided blocks take the label of the nearest decided neighbours; where these differ, that of one in the same
    element, else that of the nearer one, and at equal distance ``near`` is good and ``short`` is bad. Outside a
    marked article the ends of the page count as bad neighbours; inside one they say nothing, and a block without
    decided neighbours is good."""
    n = len(labels)
    edge = None if marked else "bad"
    before: list[tuple[int, str | None]] = [(-1, edge)] * n
    after: list[tuple[int, str | None]] = [(n, edge)] * n
    for order, side, end in ((range(n), before, (-1, edge)), (range(n - 1, -1, -1), after, (n, edge))):
        last = end
        for i in order:
            side[i] = last
            if labels[i] in ("good", "bad"):
                last = (i, labels[i])
    out = []
    for i, label in enumerate(labels):
        if label in ("near", "short"):
            (left, a), (right, b) = before[i], after[i]
            if a and b and a != b:
                here = [found[j].parent == found[i].parent if 0 <= j < n else False for j in (left, right)]
                if here[0] != here[1]:
                    label = a if here[0] else b
                elif i - left != right - i:
                    label = a if i - left < right - i else b
                else:
                    label = "good" if label == "near" else "bad"
            else:
                label = a or b or "good"
        out.append(label == "good")
    return out


def main_text(html: str) -> str:
    """The main text of one page: its good blocks, joined by line ends.

    If the page marks articles or a main part, blocks outside are bad, unless they hold more than ``OUTWEIGHS``
    times the readable text of the largest marked one: then the marked ones are teasers, and the mark says nothing. A page
    without any decided good block that marks nothing gives its undecided headings and paragraphs.
    """
    found = without_other_parts(blocks(html))
    regions: dict[int, int] = {}
    for b in found:
        regions[b.article] = regions.get(b.article, 0) + _readable(b)
    unmarked = regions.pop(0, 0)
    marked = bool(regions) and unmarked <= OUTWEIGHS * max(regions.values())
    if marked:
        found = [b for b in found if b.article]
    words = [] if marked else [b for b in found if b.links <= LINKS and b.length >= SHORT]
    known = marked or sum(_stop_density(b.text) * b.length for b in words) >= UNKNOWN_LANGUAGE * sum(b.length for b in words)
    labels = [_first_pass(b, marked, known) for b in found]
    if "good" not in labels:  # nothing to inherit from: paragraphs and headings of middling length stand for themselves
        labels = ["good" if x == "near" and not b.heading else x for x, b in zip(labels, found)]
    good = _second_pass(found, labels, marked)
    return "\n".join(b.text for b, keep in zip(found, good) if keep)


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` per row of ``pages``, from the whole page.

    A null or empty page, or one without main text, gives an empty text. Null ids and urls stay, repeated
    rows stay, other columns are ignored, also such as are named like the result's. Broken markup is read as far as it goes; a very
    long page is one row of one task, read in time that grows with its length.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) if h else "" for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"),
                       F.col(html_column).cast("string").alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
