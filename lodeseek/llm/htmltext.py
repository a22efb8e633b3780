"""The main text of web pages by ratios of tag paths.

A page is read once into blocks of text in page order, each with the path of elements from the root to it.  For each path of a
page text length and punctuation are summed and divided by its number of blocks, so a short paragraph shares the figures of the
long ones beside it.  The two ratios and the share of text outside links are fused to one score; along the page scores are smoothed, and
each path keeps the geometric mean of its own score and its smoothed neighbourhood.  Paths that reach the threshold, a share
of the scores' standard deviation in the page, hold the content nodes.  The page's text is then what lies within the element that
holds these nodes: its short blocks count too, link lists below the threshold don't.  What markup names as menu, header, footer,
sidebar, notice, advert, form or comment, by element, role, class or id, is no node at all.

Pages are taken one by one where they lie: nothing is shuffled, and memory is that of a batch of pages.

Defined results.  A null or empty page, or one without content, has the empty text.  Pages of any length are read whole, in
time as of their length; broken markup is read as far as it goes: missing end tags, an open comment or an open script run to the
end of their parent or of the page.  Character references are decoded once; unknown ones stay.  White space of any
kind becomes one space.  Equal paths are one path wherever they lie in the page.  Equal rows have equal results.  All columns of pages
are kept; ``text`` and ``n_chars`` are put in their place if there are columns with these names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of the standard deviation that a path's score must reach.
THRESHOLD = 0.8
#: Weights of a block and its neighbours, nearest first.
SMOOTHING = (4, 2, 1)
#: A block with this share of its text in links is a link list, unless its path is content.
LINK_SHARE = 0.6
#: Where several articles stand in a page, those with this share of the largest one's content count.
ARTICLE_SHARE = 0.25

# Elements of HTML by their role, and words by which pages name what isn't the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
GONE = frozenset("head nav footer aside form menu dialog template svg math object applet canvas audio video map select button datalist fieldset".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
BAD_WORDS = frozenset(
    "ad ads adbox advert advertisement advertising adverts adsense sponsor sponsored promo promotion promotions"
    " nav navbar navigation navi menu menus breadcrumb breadcrumbs topbar toolbar masthead header footer sidebar sidebars aside rail"
    " cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup signin login register"
    " share sharing social comment comments commentlist disqus respond reply replies discussion"
    " related recommended recommendations teaser teasers widget widgets pagination pager copyright legal imprint search form".split()
)
#: Classes that begin so tell what else the page has.
ABOUT_PAGE = ("has-", "with-", "no-", "is-", "js-")
#: An open element that an opening tag of the given names ends.
ENDS = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
    "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
    "tbody": frozenset(["tr", "td", "th", "tbody", "thead"]), "tfoot": frozenset(["tr", "td", "th", "tbody", "thead"]),
}
BOUNDS = frozenset("table ul ol dl article section main body html div".split())

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(?P<loose_close>/?)(?P<loose>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
PUNCTUATION = re.compile(r"[.,;:!?…。，？！؟।]")


def _unwanted(name: str, attributes: dict[str, str], within_article: bool) -> bool:
    if name in GONE or name == "header" and not within_article:
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in BAD_ROLES:
        return True
    if re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return True
    names = [x for x in (attributes.get("class", "") + " " + attributes.get("id", "")).split() if not x.lower().startswith(ABOUT_PAGE)]
    found = {w.lower() for x in names for w in WORD.findall(x)}
    if within_article and name in ("h1", "h2", "h3", "header"):
        found -= {"header"}
    return not BAD_WORDS.isdisjoint(found)


def _attributes(text: str) -> dict[str, str]:
    if not text or text.isspace():
        return {}
    return {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(text)}


class Page:
    """Blocks of text with their elements.  An element is a number; ``parents``, ``tags`` and ``paths`` have an entry for each."""

    def __init__(self, source: str):
        self.parents, self.tags, self.paths = [-1], ["#"], [""]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters of it in links
        self._open = [(0, "#", True)]  # element, tag, whether text within counts
        self._parts: list[tuple[str, bool]] = []
        self._inlines: list[tuple[str, bool]] = []  # open inline elements, and whether they are unwanted
        self._links = self._hidden = self._articles = 0
        self._read(source)

    def _flush(self) -> None:
        if self._parts:
            text = " ".join("".join(t for t, _ in self._parts).split())
            if text:
                linked = sum(len(t.strip()) for t, in_link in self._parts if in_link)
                self.blocks.append((self._open[-1][0], text, min(linked, len(text))))
            self._parts = []

    def _text(self, text: str) -> None:
        if text and self._open[-1][2] and not self._hidden:
            self._parts.append((html.unescape(text) if "&" in text else text, self._links > 0))

    def _close_to(self, at: int) -> None:
        """Ends the elements from place at on, and inline ones within."""
        self._flush()
        self._articles -= sum(tag in ("article", "main") for _, tag, _ in self._open[at:])
        del self._open[at:]
        self._inlines, self._links, self._hidden = [], 0, 0

    def _start(self, name: str, attributes: dict[str, str]) -> None:
        if name in INLINE:
            if name not in VOID:
                hidden = bool(attributes) and _unwanted(name, attributes, self._articles > 0)
                self._inlines.append((name, hidden))
                self._links += name == "a"
                self._hidden += hidden
            return
        if name == "br":
            self._text(" ")
            return
        if self._open[-1][1] == "p" or name in ENDS:
            for at in range(len(self._open) - 1, 0, -1):
                tag = self._open[at][1]
                if tag == "p" or tag in ENDS.get(name, ()):
                    self._close_to(at)
                    if tag != "p":
                        break
                elif tag in BOUNDS or name not in ENDS:
                    break
        self._flush()
        if name in VOID:
            return
        parent, _, counts = self._open[-1]
        self.parents.append(parent)
        self.tags.append(name)
        self.paths.append(f"{self.paths[parent]}/{name}.{attributes.get('class', '')}" if len(self._open) < 200 else self.paths[parent])
        self._open.append((len(self.tags) - 1, name, counts and not _unwanted(name, attributes, self._articles > 0)))
        self._articles += name in ("article", "main")

    def _end(self, name: str) -> None:
        if name in INLINE:
            for at in range(len(self._inlines) - 1, max(-1, len(self._inlines) - 50), -1):
                if self._inlines[at][0] == name:
                    self._links -= name == "a"
                    self._hidden -= self._inlines.pop(at)[1]
                    break
            return
        if name == "br":
            self._text(" ")
        for at in range(len(self._open) - 1, 0, -1):
            if self._open[at][1] == name:
                self._close_to(at)
                return
            if self._open[at][1] in ("article", "main", "body") and name in ("p", "li", "td", "tr", "span"):
                return

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            begin = source.find("<", at)
            if begin < 0:
                break
            token = TOKEN.match(source, begin)
            if not token:
                self._text(source[at : begin + 1])
                at = begin + 1
                continue
            self._text(source[at:begin])
            at = token.end()
            name = (token["name"] or token["loose"] or "").lower()
            if not name:
                continue
            if token["close"] or token["loose_close"]:
                self._end(name)
            elif name in RAW:
                stop = RAW_END[name].search(source, at)
                at = stop.start() if stop else end
            else:
                self._start(name, _attributes(token["attributes"] or ""))
        self._text(source[at:])
        self._flush()

    def ancestors(self, element: int) -> Iterator[int]:
        while element >= 0:
            yield element
            element = self.parents[element]


def path_scores(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """Of each block: its path's score, and whether that reaches the threshold."""
    elements = [e for e, _, _ in page.blocks]
    _, path = np.unique([page.paths[e] for e in elements], return_inverse=True)
    length = np.array([len(t) for _, t, _ in page.blocks], float)
    linked = np.array([n for _, _, n in page.blocks], float)
    marks = np.array([len(PUNCTUATION.findall(t)) for _, t, _ in page.blocks], float)
    blocks, chars = np.bincount(path), np.bincount(path, length)
    fused = chars / blocks * (1 + np.bincount(path, marks) / blocks) * (1 - np.bincount(path, linked) / chars)
    along = fused[path]
    weights = np.array([*SMOOTHING[:0:-1], *SMOOTHING], float)
    smooth = np.convolve(along, weights, "same") if len(along) >= len(weights) else np.convolve(along, weights)[len(SMOOTHING) - 1 :][: len(along)]
    around = np.bincount(path, smooth / weights.sum()) / blocks
    score = np.sqrt(fused * around)[path]
    return score, (score > 0) & (score >= min(THRESHOLD * along.std(), score.max()))


def main_text(source: str | None) -> str:
    page = Page(source or "")
    if not page.blocks:
        return ""
    _, content = path_scores(page)
    if not content.any():
        return ""
    weight = np.array([len(t) for _, t, _ in page.blocks]) * content
    # what each element holds of the content; a parent has a smaller number than its children
    held = np.zeros(len(page.tags))
    np.add.at(held, [e for e, _, _ in page.blocks], weight)
    articles = {}
    for element in range(len(held) - 1, 0, -1):
        held[page.parents[element]] += held[element]
    chosen = np.zeros(len(held), bool)
    outermost = np.zeros(len(held), bool)  # whether an article holds the element
    for element in range(1, len(held)):
        inside = outermost[page.parents[element]]
        if page.tags[element] == "article" and not inside and held[element]:
            articles[element] = held[element]
        outermost[element] = inside or page.tags[element] == "article"
    if not articles:
        mains = [e for e in range(len(held)) if page.tags[e] == "main" and held[e]]
        articles = {e: held[e] for e in mains[:1]}
    if articles:
        most = max(articles.values())
        chosen[[e for e, n in articles.items() if n >= ARTICLE_SHARE * most]] = True
        loose = False
    else:
        within, total = 0, held[0]
        for element in range(1, len(held)):  # the deepest element that holds all content
            if held[element] == total and page.parents[element] == within:
                within = element
        while page.tags[within] in ("p", "li", "blockquote", "td") or page.tags[within][:1] == "h" and page.tags[within][1:].isdigit():
            within = page.parents[within]
        chosen[within], loose = True, page.tags[within] in ("#", "html", "body")
    for element in range(1, len(held)):
        chosen[element] |= chosen[page.parents[element]]
    first, last = np.flatnonzero(content)[[0, -1]]
    while loose and first > 0 and page.tags[page.blocks[first - 1][0]] in ("h1", "h2", "h3", "h4", "h5", "h6"):
        first -= 1
    kept = []
    for at, (element, text, linked) in enumerate(page.blocks):
        menu = linked >= LINK_SHARE * len(text) and not content[at]
        if chosen[element] and not menu and (not loose or first <= at <= last):
            kept.append(text)
    return " ".join(kept)


def _texts(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(p.as_py()) for p in pages], pa.string())


def main_text_of(page: Column | str) -> Column:
    """The main text of a column of pages."""

    @F.arrow_udf("string")
    def extracted(column: pa.Array) -> pa.Array:
        return _texts(column)

    return extracted(page)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages without that column but with text and n_chars, the number of its code points."""
    found = pages.withColumn("text", main_text_of(column)) if column == "text" else pages.withColumn("text", main_text_of(column)).drop(column)
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
