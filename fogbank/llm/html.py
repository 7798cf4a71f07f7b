"""Main text of web pages by tag-path ratios.

A page is read once into blocks: runs of text between block-level tags, each with its path of tags from the root (inline
formatting is left out, anchors add to link text). Tags and class and id words of menus, headers, footers, side bars, notices, adverts,
forms and comments set the blocks below them aside. Such a mark counts for nothing on an element that is the page itself: one with
``most`` of the page's text and a main element or first-level heading below it, or a form or marked element with all text. Headings in the
header of a main element are its title and stay.

Of the other blocks, text length and punctuation are summed per path and divided by the number of blocks: the path's ratios.
Both are smoothed over neighbouring blocks, multiplied, and paths whose best value passes a share of their spread are content
paths. Where a page has main elements, the innermost one that holds almost all text of the selected blocks is the article (all main
elements with such blocks, if none does). Elsewhere it is the smallest element that holds almost all of it, widened out of lists, tables
and sections and up to the page's only first-level heading; blocks on paths that hold nothing but links are left out there. Of the
article every block that was not set aside makes the text, short ones too. A first-level heading right before a main element
without one is its title.

Defined cases: null or empty html, and pages without text, give an empty text; unclosed and crossed tags, unclosed
comments and quotes are read leniently; repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fogbank.llm.common import map_texts

SCHEMA = "page_id bigint, url string, text string, n_chars bigint"

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page.
HIDDEN = frozenset("script style noscript template textarea select iframe object svg math canvas audio video title head".split())
#: Inside these, markup is no markup.
RAW = frozenset("script style noscript template textarea iframe title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr br".split())
ASIDE = frozenset("nav header footer aside form button dialog menu fieldset".split())
#: These are never the page.
BESIDE = ASIDE - {"form", "fieldset"}
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: They stand for the element around them.
LEAVES = HEADINGS | frozenset("p li blockquote pre ul ol dl dt dd table tbody thead tfoot tr td th section figure".split())
#: Words of class, id and role values that mark what is not the article.
WORDS = re.compile(
    r"(?<![a-z])(?:ads?|advert\w*|adbox|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|aside|footer|"
    r"header|masthead|cookie\w*|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|signup|login|search|share|sharing|"
    r"social|related|recommended|comments?|commentlist|disqus|respond|replies|reply|widget|pagination|pager|toolbar|skip|"
    r"contentinfo|complementary|alert|form)(?![a-z])", re.I)
#: What an opening tag closes when it is still open below the nearest of the second set.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr"}),
          "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"})}
TAG = re.compile(r"<!--(?:.*?-->|.*+)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>\"']|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>|<[!?][^>]*+>|</[^>]*+>", re.S)
ATTRIBUTE = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Class words that tell what a page has, not what an element is.
STATES = re.compile(r"(?<![\w-])(?:has|with|without|no|is|show|hide)[-_][\w-]+", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
HIDES = re.compile(r"(?<![\w-])(?:hidden(?![\w-])|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？；：]")
END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


#: Marks of elements: set aside unless the element is the page itself, set aside whatever it holds.
ASIDE_MARK, HIDDEN_MARK = 1, 2


def set_aside(name: str, attributes: str) -> int:
    if attributes and name not in ("html", "body"):
        if HIDES.search(attributes):
            return HIDDEN_MARK
        for m in ATTRIBUTE.finditer(attributes):
            if WORDS.search(CAMEL.sub(" ", STATES.sub(" ", m[1] or m[2] or m[3] or "")).replace("_", " ")):
                return ASIDE_MARK
    return ASIDE_MARK if name in ASIDE else 0


class Blocks:
    """The blocks of a page: text, path, innermost element, characters of links.

    Paths and elements are numbers; ``parent``, ``names`` and ``marks`` give an element's parent, tag and mark, parents come first.
    """

    def __init__(self, page: str):
        # Name, element, path, hidden; inline tags keep the element and path around them.
        self.stack: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]
        self.parent, self.names, self.marks = [0], [""], [0]
        self.paths: dict[tuple[int, str], int] = {}
        self.blocks: list[tuple[str, int, int, int]] = []
        self.piece: list[str] = []
        self.links = self.anchors = 0
        at, n = 0, len(page)
        while at < n:
            m = TAG.search(page, at)
            self.text(page[at: m.start() if m else n])
            if not m:
                break
            at = m.end()
            name = m[2]
            if not name:
                continue
            name = name.lower()
            if m[1]:
                self.close(name)
                continue
            self.open(name, m[3])
            if name in RAW:
                end = END[name].search(page, at)
                at = end.end() if end else n
                self.close(name)
        self.end_block()

    def text(self, piece: str) -> None:
        if piece and not self.stack[-1][3]:
            self.piece.append(piece)
            if self.anchors:
                self.links += len(piece)

    def end_block(self) -> None:
        if self.piece:
            words = entities.unescape("".join(self.piece)).split()
            if words:
                text = " ".join(words)
                _, element, path, _ = self.stack[-1]
                self.blocks.append((text, path, element, min(self.links, len(text))))
            self.piece, self.links = [], 0

    def open(self, name: str, attributes: str) -> None:
        if name not in INLINE:
            self.end_block()
            if name == "p" or name not in CLOSES:
                self.shut({"p"}, {"article", "section", "div", "td", "th", "li", "blockquote", "body"}) if name != "hr" else None
            if name in CLOSES:
                self.shut(*CLOSES[name])
        elif name == "br":
            self.piece.append(" ")
        if name in VOID:
            return
        self.anchors += name == "a"
        _, element, path, hidden = self.stack[-1]
        if name not in INLINE:
            self.parent.append(element)
            self.names.append(name)
            self.marks.append(set_aside(name, attributes))
            element, path = len(self.parent) - 1, self.paths.setdefault((path, name), len(self.paths) + 1)
        self.stack.append((name, element, path, hidden or name in HIDDEN))

    def shut(self, names: set, border: set) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] in names:
                self.cut(i)
                return
            if self.stack[i][0] in border:
                return

    def close(self, name: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == name:
                if name not in INLINE:
                    self.end_block()
                self.cut(i)
                return
            if name in INLINE and self.stack[i][0] not in INLINE:
                return  # inline tags don't close blocks
        if name == "br":
            self.piece.append(" ")

    def cut(self, i: int) -> None:
        self.anchors -= sum(s[0] == "a" for s in self.stack[i:])
        del self.stack[i:]


def smooth(values: np.ndarray) -> np.ndarray:
    """Means weighted 1-2-1 over neighbouring blocks."""
    padded = np.pad(values, 1, mode="edge")
    return (padded[:-2] + 2 * padded[1:-1] + padded[2:]) / 4


def sums(parent: list[int], values) -> list:
    """Sums of ``values`` per element over the element and all below it."""
    out = list(values)
    for e in range(len(parent) - 1, 0, -1):
        out[parent[e]] += out[e]
    return out


def within(parent: list[int], nodes: set[int]) -> list[bool]:
    """Which elements are one of ``nodes`` or below one."""
    out = [0 in nodes] * len(parent)
    for e in range(1, len(parent)):
        out[e] = e in nodes or out[parent[e]]
    return out


def kept_blocks(read: Blocks, most: float) -> list[tuple]:
    """The blocks that no mark sets aside."""
    parent, names, n = read.parent, read.names, len(read.parent)
    held, first = [0] * n, [0] * n
    for text, _, e, _ in read.blocks:
        held[e] += len(text)
        first[e] += names[e] == "h1"
    held, first = sums(parent, held), sums(parent, first)
    inner = sums(parent, [int(names[e] in MAIN and not read.marks[e]) for e in range(n)])
    aside, main = [False] * n, [False] * n
    for e in range(1, n):
        page = held[e] == held[0] and names[e] not in BESIDE or held[e] >= most * held[0] and (first[e] or inner[e])
        own = read.marks[e] == HIDDEN_MARK or read.marks[e] == ASIDE_MARK and not page
        title = names[e] in HEADINGS and names[parent[e]] == "header" and main[parent[e]]
        aside[e] = own or aside[parent[e]] and not (title and not aside[parent[parent[e]]])
        main[e] = main[parent[e]] or names[e] in MAIN
    return [b for b in read.blocks if not aside[b[2]]]


def selected_blocks(blocks: list[tuple], share: float) -> tuple[np.ndarray, np.ndarray]:
    """Text without links of every block, and whether its path is a content path."""
    _, which = np.unique([b[1] for b in blocks], return_inverse=True)
    # Text that is all link counts little.
    size = np.array([len(b[0]) - b[3] + 1.0 for b in blocks])
    marks = np.array([len(PUNCTUATION.findall(b[0])) + 1.0 for b in blocks])
    count = np.bincount(which)
    text_ratio, mark_ratio = np.bincount(which, size) / count, np.bincount(which, marks) / count
    fused = smooth(text_ratio[which]) * smooth(mark_ratio[which])
    best = np.zeros(len(count))
    np.maximum.at(best, which, fused)
    return size, (best >= share * fused.std())[which]


def main_text(page: str | None, share: float = 0.5, holds: float = 0.9, most: float = 0.5) -> str:
    """Text of the article. ``share``: of the spread of fused values, to be content; ``holds`` and ``most``: shares of text."""
    read = Blocks(page or "")
    parent, names = read.parent, read.names
    blocks = kept_blocks(read, most)
    if not blocks:
        return ""
    mains = within(parent, {e for e, name in enumerate(names) if name in MAIN})
    inside = [b for b in blocks if mains[b[2]]]
    found = inside or blocks
    size, chosen = selected_blocks(found, share)
    held, depth = [0.0] * len(parent), [0] * len(parent)
    for b, n in zip(found, size * chosen):
        held[b[2]] += n
    held = sums(parent, held)
    for e in range(1, len(parent)):
        depth[e] = depth[parent[e]] + 1
    enough = [e for e, n in enumerate(held) if n >= holds * held[0]]
    if inside:
        full = [e for e in enough if names[e] in MAIN]
        nodes = {max(full, key=lambda e: depth[e])} if full else {e for e, n in enumerate(held) if n and names[e] in MAIN}
        article = within(parent, nodes)
        out = [b for b in inside if article[b[2]]]
        if not any(names[b[2]] == "h1" for b in out):
            at = blocks.index(out[0]) if out else 0
            out = [b for b in blocks[max(0, at - 1):at] if names[b[2]] == "h1"] + out
        return "\n".join(b[0] for b in out)
    node = max(enough, key=lambda e: depth[e], default=0)
    while node and names[node] in LEAVES:
        node = parent[node]
    titles = {b[2] for b in blocks if names[b[2]] == "h1"}
    if len(titles) == 1:
        above, at = {0}, titles.pop()
        while at:
            above.add(at)
            at = parent[at]
        while node not in above:
            node = parent[node]
    article = within(parent, {node})
    links = {b[1] for b in blocks if b[3] >= len(b[0])} - {b[1] for b in blocks if b[3] < len(b[0])}
    return "\n".join(b[0] for b in blocks if article[b[2]] and b[1] not in links)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""

    def make():
        def apply(chunk: pa.RecordBatch) -> dict:
            texts = [main_text(h) for h in chunk.column("html").to_pylist()]
            return {"page_id": chunk.column("page_id"), "url": chunk.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

        return apply

    need = pages.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return map_texts(need, SCHEMA, make, column="html")
