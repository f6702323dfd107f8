"""Operator 10: main text of web pages from streamed parser events.

The standard library's parser delivers tags and text; text between block tags is a *line*. Each line
has a text-to-tag ratio; the ratios are smoothed by a Gaussian along the page, and lines above one
standard deviation form the content cluster. The cluster selects the content region: the articles
or ``main`` of the page, or else the smallest element that holds all of it (no list or table), with the title before it. All lines of that region are kept, short
ones too, but for those in elements that the page itself marks as navigation, advert, form and so on. A mark
counts only after the cluster is known: an element that holds the content is none of these, whatever its name.
On pages without an article element, the cluster also bounds the text: before its first dense line (or the title)
and after its last one, lines go unless they are paragraphs, headings or list items.

Everything is linear in the page: a line knows the element it stands in, elements know their parents, and sums
over elements are taken once over all of them, children before parents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import _extended, _kept
from .common import slices

#: Fixed values of HTML: elements that hold other blocks, other elements that end a line, elements without text of the page.
HOLDERS = frozenset("html body div section article main nav header footer aside form ul ol dl table tbody thead tfoot tr td th figure details fieldset center menu dialog".split())
BREAKS = HOLDERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd br hr pre blockquote address figcaption summary caption legend option title head".split())
SILENT = frozenset("script style title noscript template textarea select button svg iframe object canvas".split())
#: Holders that are a part of an article, not the whole.
PARTS = frozenset("ul ol dl table tbody thead tfoot tr td th figure details".split())
#: Elements, roles and words in class or id that mark what is not the article.
MARGIN = frozenset("nav header footer aside menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar footer header masthead cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup popup modal overlay comment "
    "comments discussion respond replies share sharing social related recommended widget widgets toolbar pagination pager login search skip copyright".split()
)
#: Words of those that hold comments and lists of other pages, and words of a name that says what a holder has, not what it is.
FIRM = frozenset("comment comments discussion respond replies related recommended".split())
HAVING = frozenset("has have having with without no".split())
#: How surely a holder is margin: by part of a compound name or as a form, by its whole name, by element, role or the words above.
WEAK, STRONG, SURE = 1, 2, 3
#: Elements without content, and those whose end the next block (or the next of their kind) may stand for.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDED = frozenset("p h1 h2 h3 h4 h5 h6 pre dt address figcaption caption".split())
AGAIN = frozenset("li dd option".split())
#: Elements whose lines are text by themselves, and those besides holders whose marks are asked.
PROSE = ENDED | AGAIN | frozenset("blockquote".split())
ASKED = PROSE - {"h1", "option"}
_TAG = re.compile(r"<[a-zA-Z/!?]")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
KERNEL = np.exp(-0.5 * (np.arange(-2, 3) / 1.0) ** 2)
KERNEL = KERNEL / KERNEL.sum()


class Lines(HTMLParser):
    """Turns events into lines: text, tags, share of links, the holder they stand in, and whether they are prose by their own
    element; holders have a parent, a kind and a margin mark. Number 0 is the page itself."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, bool]] = []
        self.open: list[tuple[str, int]] = [("", 0)]  # name, number
        self.parents: list[int] = [0]
        self.kinds: list[str] = [""]
        self.marks: list[int] = [0]
        self.tags_of: list[str] = [""]
        self.depth: Counter[str] = Counter()  # open holders by name
        self.mains = 0
        self.titled: set[int] = set()  # holders of an h1
        self.titles: set[int] = set()  # lines that an h1 begins
        self.silent, self.within, self.links = "", [], 0
        self.text: list[str] = []
        self.tags = self.linked = 0
        self.block = ""

    def end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, self.linked, self.open[-1][1], self.block in PROSE))
            self.tags = 0
        self.text, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.silent and not self.within and (self.silent in ENDED and tag in BREAKS or self.silent in AGAIN and tag == self.silent):
            self.silent = ""
        if self.silent:
            if tag not in VOID:
                self.within.append(tag)
            return
        if tag in BREAKS:
            self.end_line()
            self.block = tag
        self.tags += 1
        if tag in SILENT or tag not in HOLDERS and tag not in VOID and self.is_margin(tag, attrs):
            self.silent, self.within = tag, []
        elif tag == "a":
            self.links += 1
        elif tag in HOLDERS:
            main = tag in ("article", "main") or ("role", "main") in attrs
            self.marks.append(self.margin(tag, dict(attrs)))
            self.parents.append(self.open[-1][1])
            self.open.append((tag, len(self.kinds)))
            self.kinds.append("main" if main else tag)
            self.tags_of.append(tag)
            self.depth[tag] += 1
            self.mains += main
        elif tag == "h1":
            self.titles.add(len(self.lines))
            self.titled.add(self.open[-1][1])

    def is_margin(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        """Whether an element that is no holder is hidden, or marked by its whole name."""
        given = dict(attrs)
        if "hidden" in given or (given.get("aria-hidden") or "").lower() == "true":
            return tag in BREAKS or "hidden" in given
        return tag in ASKED and self.margin(tag, given) > WEAK

    def margin(self, tag: str, attrs: dict[str, str | None]) -> int:
        """0, or how surely the page marks an element as margin."""
        if tag in ("html", "body", "article", "main"):
            return 0
        inside = self.mains > 0
        if tag in MARGIN and not (tag == "header" and inside):
            return SURE
        role = (attrs.get("role") or "").lower()
        if "hidden" in attrs or role in ROLES or (attrs.get("aria-hidden") or "").lower() == "true":
            return SURE
        least = WEAK if tag == "form" or role == "form" else 0
        words = {w.lower() for w in _WORD.findall(f"{attrs.get('class') or ''} {attrs.get('id') or ''}")}
        if not words & (WORDS - {"header"} if inside else WORDS):
            return least
        if words & HAVING:
            return WEAK
        return SURE if words & FIRM else STRONG if all(w in WORDS or w.isdigit() for w in words) else WEAK

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            if tag in self.within[-32:]:  # markup that is wrong deeper than that only keeps the silence to its parent's end
                while self.within.pop() != tag:
                    pass
                return
            if tag == self.silent:
                self.silent = ""
                return
            if not self.depth[tag]:
                return
            self.silent = ""  # its parent ends
        if tag in BREAKS:
            self.end_line()
            self.block = ""
        self.tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        elif self.depth[tag]:
            name = ""
            while name != tag:
                name, n = self.open.pop()
                self.depth[name] -= 1
                self.mains -= self.kinds[n] == "main"
            self.links = 0

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.text.append(data)
            if self.links:
                self.linked += len(data)

    def close(self) -> None:
        super().close()
        self.end_line()

    def below(self, own: Iterable[int]) -> np.ndarray:
        """Which holders are, or stand in, one of ``own``."""
        out = np.zeros(len(self.parents), bool)
        out[list(own)] = True
        flags = out.tolist()
        for n in range(1, len(flags)):
            flags[n] = flags[n] or flags[self.parents[n]]
        return np.array(flags)

    def totals(self, at: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Sums of values at holders, each holder's with those of all that stand in it."""
        sums = np.bincount(at, values, len(self.parents)).tolist()
        for n in range(len(sums) - 1, 0, -1):
            sums[self.parents[n]] += sums[n]
        return np.array(sums)

    def path(self, n: int) -> list[int]:
        out = [n]
        while out[-1]:
            out.append(self.parents[out[-1]])
        return out[::-1]


def parsed(html: str) -> Lines:
    """The events of a page. A tag that the page's end cuts off is no text; the parser would try it from each of its characters."""
    whole = html.rfind(">") + 1
    cut = _TAG.search(html, whole)
    parser = Lines()
    parser.feed(html[: cut.start()] if cut else html)
    parser.close()
    return parser


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Gaussian smoothing that mirrors the ends."""
    wide = np.pad(ratios, 2, mode="edge")
    return np.convolve(wide, KERNEL, "valid")


def margins(parser: Lines, at: np.ndarray, size: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    """Which lines stand in margin. A mark does not count where its holder has the page's content: all articles
    that hold clustered text, or most of the clustered text that no surer mark takes away."""
    marked = {n for n, m in enumerate(parser.marks) if m}
    if not marked:
        return np.zeros(len(at), bool)
    inner = [0] * len(parser.parents)  # the innermost article around each holder
    for n in range(1, len(inner)):
        inner[n] = n if parser.kinds[n] == "main" else inner[parser.parents[n]]
    owned = np.array(inner)[at[cluster]]
    owned = owned[owned > 0]
    held = parser.totals(owned, np.ones(len(owned)))
    sole = held == len(owned) if len(owned) else np.zeros(len(inner), bool)  # what holds all articles with clustered text
    out: set[int] = set()
    for mark in (SURE, STRONG, WEAK):
        free = cluster & ~parser.below(out)[at]
        weight, total = parser.totals(at[free], size[free]), size[free].sum()
        for n in (n for n in marked if parser.marks[n] == mark):
            most = 2 * weight[n] > total
            holds = most and sole[n] if mark == SURE else sole[n] or most and (mark == WEAK or n in parser.titled)
            if not holds:
                out.add(n)
    for mark in (WEAK, STRONG):  # a page all in marked holders
        if parser.below(out)[at].all():
            out = {n for n in out if parser.marks[n] != mark}
    return parser.below(out)[at]


def region_of(parser: Lines, at: np.ndarray, size: np.ndarray, chosen: np.ndarray, dense: np.ndarray, usable: np.ndarray) -> np.ndarray:
    """Which lines are content: all usable ones in the page's articles, or else those in the element that holds all chosen lines,
    bounded by the first and last that are dense by themselves."""
    lines, kinds = parser.lines, parser.kinds
    total = size[chosen].sum()
    outer = [0] * len(kinds)  # the outermost article around each holder
    for n in range(1, len(kinds)):
        outer[n] = outer[parser.parents[n]] or (n if kinds[n] == "main" else 0)
    weight: dict[int, float] = {}  # chosen text of outermost articles
    for k in np.flatnonzero(chosen):
        if n := outer[at[k]]:
            weight[n] = weight.get(n, 0.0) + size[k]
    if sum(weight.values()) >= 0.25 * total:
        whole = {n for n in weight if parser.tags_of[n] != "article"}  # main, beside which articles are other pages'
        if 2 * sum(weight[n] for n in whole) < sum(weight.values()):
            whole = {n for n, kind in enumerate(kinds) if kind == "main"}
        return usable & parser.below(whole)[at]
    held = parser.totals(at[chosen], np.ones(int(chosen.sum())))
    root = parser.path(int(np.flatnonzero(held == held[0])[-1]))  # of those that hold all, the last is the innermost
    direct = {int(at[k]) for k, x in enumerate(lines) if usable[k] and at[k] and x[1] and x[2] < 0.9 * len(x[0])}
    while kinds[root[-1]] in PARTS:
        root.pop()
    while len(root) > 2 and root[-2] in direct and kinds[root[-2]] not in PARTS | {"html", "body"}:  # its parent has text of its own
        root.pop()
    inside = parser.below(root[-1:])[at]
    if root[-1] and root[-1] not in parser.titled:  # from the title to the region, if one element of the page or the body itself has both
        first = int(inside.argmax())
        for k in range(first - 1, -1, -1):
            if usable[k] and k in parser.titles:
                path = parser.path(int(at[k]))
                common = [a for a, b in zip(path, root) if a == b]
                if common == path or kinds[common[-1]] not in ("", "html", "body"):
                    inside[k:first] = True
                break
    region = usable & inside
    # beyond the dense lines, only prose and what follows the title is content
    dense = dense if dense.any() else chosen
    first, last = int(dense.argmax()), len(dense) - 1 - int(dense[::-1].argmax())
    title = next((k for k in range(first, -1, -1) if region[k] and k in parser.titles), first)
    parts = set()  # a list or table that begins or ends the dense lines belongs to them whole
    for n in (int(at[first]), int(at[last])):
        while kinds[n] in PARTS:
            parts, n = parts | {n}, parser.parents[n]
    prose = np.array([x[4] for x in lines]) | parser.below(parts)[at]
    places = np.arange(len(lines))
    return region & (prose | (places >= min(title, first)) & (places <= last))


def main_text(html: str | None) -> str:
    """The article's text: white space runs are one space, lines in page order are joined by one."""
    if not html:
        return ""
    parser = parsed(html)
    lines = parser.lines
    if not lines:
        return ""
    for n in range(len(parser.parents) - 1, 0, -1):
        if n in parser.titled:
            parser.titled.add(parser.parents[n])
    at = np.array([x[3] for x in lines])
    size = np.array([len(x[0]) for x in lines], float)
    ratio = size / np.array([max(1, x[1]) for x in lines])
    smooth = smoothed(ratio)
    least = smooth.std()
    cluster = smooth >= least
    usable = ~margins(parser, at, size, cluster)
    if not usable.all() and usable.any():  # margin lines lift no neighbours
        smooth = np.zeros(len(lines))
        smooth[usable] = smoothed(ratio[usable])
        least = smooth[usable].std()
        cluster = smooth >= least
    chosen = usable & cluster
    if not chosen.any():
        chosen = usable
    if not chosen.any():
        return ""
    region = region_of(parser, at, size, chosen, chosen & (ratio >= least), usable)
    in_main = parser.below([n for n, kind in enumerate(parser.kinds) if kind == "main"])
    # outside an article, a line of links alone is none of the text
    return " ".join(text for (text, _, linked, n, _), own in zip(lines, region.tolist()) if own and (in_main[n] or linked < 0.9 * len(text)))


def extract(df: DataFrame, html: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """Adds the main text of each whole page and its code points; one narrow stage.

    Null and empty pages, and pages without an article, have an empty text and 0. Broken or cut-off markup is read as
    far as the events go. Columns with the added names are replaced; repeated rows give repeated results.
    """
    schema = _extended(df, [T.StructField(text, T.StringType()), T.StructField(n_chars, T.LongType())])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, html, 4 << 20):
                out = [main_text(x) for x in batch.column(batch.schema.get_field_index(html)).to_pylist()]
                yield pa.RecordBatch.from_arrays(_kept(batch, schema, 2) + [pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names)

    return df.mapInArrow(run, schema)
