"""Main text of web pages by tag-path ratios.

Each text block of a page (with the inline elements inside it) has a path of block tags from the root. Per path, text length
and punctuation are summed and divided by the number of blocks. Both ratios are smoothed over neighbouring blocks in page
order and averaged by path again, and then fused on a log scale: length, raised by punctuation, lowered by the share of link
text and, on marked paths, to a tenth. Outside of ``article`` and ``main`` elements it is lowered by the share of the
unmarked text that those hold. Paths that reach ``SHARE`` of the page's highest ratio are content: menus and lists of links
fail by their links, page furniture by its mark, headings pass by their neighbours.

Marks. Tags say what an element is (navigation, header, footer, aside), and so do classes, ids and roles: a word of them marks an
element if it is one of ``NOISE_WORDS``, or joins such with ``NEUTRAL_WORDS`` (``cookie-notice``, ``site-footer``; not ``has-sidebar``). Such
a word does not mark what holds most of the page's text and a heading or several blocks: that is the article. Scripts, styles,
forms and media are no text at all.

What belongs together stays together: if all content lies in one element below the body, every unmarked block in it is kept, its
short lists and tables too; else every unmarked block between the first and the last block of content (and inside an article, if
there is one).

Defined cases: a null or empty page, and one without content, gives the empty text. Text nodes that no element
encloses count as children of the root. Broken markup is read as far as it goes: an end tag without a start is
ignored, open elements end with their parents, a new paragraph, list item, row or cell ends the one before. Nothing is
cut however long or deeply nested a page is. Repeated rows are extracted row by row; an empty table gives an empty
result; columns other than identifier, address and page are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser
from math import log1p

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from additiva.llm.common import table

#: Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("html body p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd tr table thead tbody tfoot caption blockquote pre section article main figure figcaption header footer nav aside form fieldset address details summary hr hgroup center".split())
NO_TEXT = frozenset("head script style noscript template form button select option textarea input iframe object svg math canvas audio video dialog label".split())
MARKED_TAGS = frozenset("nav header footer aside menu".split())
#: Words in classes, ids and roles that mark what is no article. Fixed values.
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login sidebar widget widgets related recommended recommendations share sharing social breadcrumb breadcrumbs pagination pager menu menus nav navbar navigation footer header masthead "
    "toolbar comment comments commentlist disqus respond reply replies complementary contentinfo search searchbox skip".split()
)
NEUTRAL_WORDS = frozenset("site page main top bottom left right inner outer global box block bar list item items area section container wrapper wrap slot unit panel content link links text block".split())
NEVER_NOISE = frozenset(("html", "body", "article", "main"))
#: Elements that a start tag of the same group ends.
ENDS = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
SCOPES = frozenset(("table", "ul", "ol", "dl", "article", "main", "section", "div", "body", "html", "select", "blockquote"))
HEADED = frozenset("h1 h2 article main".split())
ARTICLES = ("article", "main")
PUNCTUATION = re.compile(r"[.,;:!?…。，！？]")
SHARE, SMOOTH, MARKED = 0.35, (0.25, 0.5, 0.25), 0.1


def _hidden(attrs: list[tuple[str, str | None]]) -> bool:
    return any(name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value or "") for name, value in attrs)


def _named_noise(attrs: list[tuple[str, str | None]]) -> bool:
    """Whether a class, id or role is a noise word, or joins such with neutral ones."""
    for name, value in attrs:
        if name in ("class", "id", "role"):
            for token in (value or "").split():
                words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", token).lower()) if w]
                if any(w in NOISE_WORDS for w in words) and all(w in NOISE_WORDS or w in NEUTRAL_WORDS for w in words):
                    return True
    return False


class _Element:
    __slots__ = ("tag", "parent", "at", "no_text", "named", "link", "article", "size", "blocks", "headed", "last", "marked", "path")

    def __init__(self, tag: str, parent: _Element | None, at: int, no_text: bool, named: bool) -> None:
        self.tag, self.parent, self.at, self.named = tag, parent, at, named
        self.no_text = no_text or bool(parent and parent.no_text)
        self.link = tag == "a" or bool(parent and parent.link)
        self.article = tag in ARTICLES or bool(parent and parent.article)
        # Letters, blocks and last element below it, and whether it has a heading: known when the page is read.
        self.size, self.blocks, self.headed, self.last = 0, int(tag in BLOCKS), tag in HEADED, at


class Page(HTMLParser):
    """Text nodes of a page: (element, block, text)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements = [_Element("", None, 0, False, False)]
        self.open = list(self.elements)
        self.count: Counter[str] = Counter()  # open elements by tag
        self.nodes: list[tuple[_Element, int, str]] = []
        self.block = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.block += 1
            if tag not in ("li", "tr", "p"):
                self._end({"p"})
        if tag == "br":
            self.nodes.append((self.open[-1], self.block, " "))
        if tag in VOID:
            return
        if tag in ENDS:
            self._end(ENDS[tag])
        if tag in ("td", "th"):
            self.nodes.append((self.open[-1], self.block, " "))
        named = tag not in NEVER_NOISE and _named_noise(attrs)
        self.open.append(_Element(tag, self.open[-1], len(self.elements), tag in NO_TEXT or _hidden(attrs), named))
        self.elements.append(self.open[-1])
        self.count[tag] += 1

    def _close(self, k: int) -> None:
        """Ends the open elements from place k on."""
        for e in self.open[k:]:
            self.count[e.tag] -= 1
        del self.open[k:]

    def _end(self, tags: set[str]) -> None:
        """Ends the nearest open element of the group, unless a list, table or the like stands between."""
        if not any(self.count[t] for t in tags):
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                return self._close(k)
            if self.open[k].tag in SCOPES:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.block += 1
        if self.count[tag]:
            k = len(self.open) - 1
            while self.open[k].tag != tag:
                k -= 1
            self._close(k)

    def handle_data(self, data: str) -> None:
        self.nodes.append((self.open[-1], self.block, data))


    def settle(self) -> None:
        """Sizes from the leaves up, then marks and paths from the root down."""
        for e, _, t in self.nodes:
            if not e.no_text:
                e.size += len(t.strip())
        for e in reversed(self.elements[1:]):
            up = e.parent
            up.size, up.blocks, up.headed, up.last = up.size + e.size, up.blocks + e.blocks, up.headed or e.headed, max(up.last, e.last)
        most, paths = self.elements[0].size / 2, {}
        for e in self.elements:
            # What holds most of the text and a heading or several blocks is no furniture, whatever it is called.
            named = e.named and not (e.size > most and (e.headed or e.blocks > 3))
            e.marked = named or e.tag in MARKED_TAGS or bool(e.parent and e.parent.marked)
            e.path = paths.setdefault((e.parent.path, e.tag, e.marked), len(paths) + 1) if e.parent and (e.tag in BLOCKS or e.tag in ARTICLES or e.marked != e.parent.marked) else e.parent.path if e.parent else 0


def content_paths(blocks: list[tuple[int, float, str, float]], share: float = SHARE) -> set[int]:
    """The paths that hold content, from the blocks (path, share of link text, text, weight of the path) in page order."""
    length, punctuation, links, count = (defaultdict(float) for _ in range(4))
    weight = {path: w for path, _, _, w in blocks}
    for path, linked, t, _ in blocks:
        length[path] += len(t)
        punctuation[path] += len(PUNCTUATION.findall(t))
        links[path] += linked * len(t)
        count[path] += 1

    def smooth(total: dict[int, float]) -> dict[int, float]:
        """A ratio smoothed over neighbouring blocks, averaged by path."""
        raw = [total[path] / count[path] for path, *_ in blocks]
        out: dict[int, float] = defaultdict(float)
        for k, (path, *_) in enumerate(blocks):
            out[path] += sum(w * raw[min(max(k + d, 0), len(raw) - 1)] for d, w in zip((-1, 0, 1), SMOOTH, strict=True)) / count[path]
        return out

    size, marks = smooth(length), smooth(punctuation)
    fused = {p: log1p(size[p] * (1 + marks[p]) * max(0.0, 1 - links[p] / length[p])) * weight[p] for p in length}
    most = max(fused.values())
    return {p for p, x in fused.items() if x >= share * most and (x > 0 or share == 0)}


def common(a: _Element, b: _Element) -> _Element:
    """The innermost element around both."""
    while a is not b:
        if a.at > b.at:
            a = a.parent
        else:
            b = b.parent
    return a


def extract(html: str | None, share: float = SHARE) -> str:
    page = Page()
    page.feed(html or "")
    page.close()
    page.settle()
    gathered: dict[int, list[tuple[_Element, str]]] = {}
    for e, block, t in page.nodes:
        if not e.no_text:
            gathered.setdefault(block, []).append((e, t))
    read: list[tuple[int, float, str]] = []
    places: list[_Element] = []
    for nodes in gathered.values():
        text = " ".join("".join(t for _, t in nodes).split())
        if text:
            named = [(e, len(t.strip())) for e, t in nodes if t.strip()]
            first = named[0][0]
            read.append((first.path, sum(n for e, n in named if e.link) / sum(n for _, n in named), text))
            places.append(first)
    if not read:
        return ""
    whole, inside = (sum(len(t) for (_, _, t), e in zip(read, places, strict=True) if not e.marked and e.article >= a) for a in (False, True))
    outside = max(MARKED, 1 - inside / whole) if whole else 1.0
    blocks = [(*b, MARKED if e.marked else 1.0 if e.article else outside) for b, e in zip(read, places, strict=True)]
    content = content_paths(blocks, share)
    chosen = [k for k, b in enumerate(blocks) if b[0] in content]
    if not chosen:
        return ""
    around = common(min((places[k] for k in chosen), key=lambda e: e.at), max((places[k] for k in chosen), key=lambda e: e.at))
    while around.tag not in BLOCKS and around.parent:
        around = around.parent
    if around.tag in ("", "html", "body"):
        near = range(chosen[0], chosen[-1] + 1)
    else:
        near = [k for k, e in enumerate(places) if around.at <= e.at <= around.last]
    kept = set(chosen) | {k for k in near if blocks[k][3] == 1}
    return "\n".join(blocks[k][2] for k in sorted(kept))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars), one row per row of ``pages``."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n"])

    narrow = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema}
    return narrow.mapInArrow(of_batches, f"id {kinds['id']}, url {kinds['url']}, text string, n long").toDF(id_col, url_col, "text", "n_chars")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


QUERIES = {"op6_html_extraction": op6_html_extraction}
SQL: dict[str, str] = {}
