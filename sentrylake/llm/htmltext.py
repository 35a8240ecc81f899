"""The main text of web pages, by wrappers induced from the pages of each host.

A page becomes a small tree: an element's children of one tag and class are one
slot, which holds the texts of all of them. Trees of one host are merged by
simple tree matching, the alignment of ordered trees that pairs the most
nodes, into a wrapper that counts for each slot the pages that have it and the
pages that have each text in it. A text that nearly all pages of a slot share is
constant and belongs to the template; what varies is content. Wrappers merge in
any order, so each task makes one a host and these meet in rounds of sixteen:
a host with a third of all pages is no single task's work. Texts and slots
that fewer than a tenth of a wrapper's pages have are forgotten once it has
``PRUNE_AT`` pages, which bounds a wrapper by the size of its pages; one that
the template needs, in nine tenths of the pages, is never among them for good.

Where to look for content is a matter of markup first: an ``article`` (the one
with the most text), else what is marked as the main part, else the whole body;
never menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and comments, by tag, role or the words of class and id. From a whole
body constant texts are left out if two pages at least share them and something
varies beside them. Inside an article or main part they are left out only if
five pages at least share them and they are no more than a quarter of the
page's text, as pages that are copies of each other share their content too.

Character references are decoded, white space inside a block becomes one space,
blocks are trimmed and joined by an empty line. A null html counts as empty,
and pages without text give an empty one. Html may be of any length and depth:
below ``DEPTH`` elements belong to the slot of the one above, texts and all.
Urls without a host, null ones too, share one wrapper. Repeated rows give
repeated results; an empty table an empty one. A column named text is replaced.
"""

from __future__ import annotations

import html as references
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .util import land, work_dir

DEPTH = 48
PRUNE_AT = 20
FAN_IN = 16
SHARED, SHARED_IN_ARTICLE, MOST_SHARED = 2, 5, 0.25
_HOSTS_A_TASK = 2000

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math select".split())
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav search ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: The innermost block is closed by these tags, if it is one of those.
_CLOSES = {t: ("p",) for t in _BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "option", "optgroup"}}
_CLOSES |= {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_CLOSES |= {t: ("tbody", "thead", "tfoot", "tr", "td", "th") for t in ("tbody", "thead", "tfoot")}

_LEFT_OUT = frozenset("nav header footer aside form menu dialog search button label fieldset object audio video canvas map".split()) | _RAW
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar note".split())
#: Words of class and id.
_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager header masthead topbar footer sidebar aside rail widget widgets related recommended "
    "recommendations teaser teasers promo promos promotion sponsor sponsored advert adverts advertisement advertising ad ads adsense banner cookie cookies consent "
    "notice notices notification alert popup modal overlay newsletter subscribe subscription signup login search share sharing social comment comments disqus "
    "respond reply replies discussion form copyright disclaimer skip toolbar toc".split()
)
_MAIN_WORDS = frozenset("article content post entry story main".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_ATTRIBUTE = re.compile(r"(?<![^\s/\"'])([^\s=/\"']++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in _RAW}
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """Text ("", text, ""), opening tags (tag, attributes, "") and closing ones (tag, "", "/"). Comments, declarations
    and what scripts and the like hold are left out. It passes over the page once."""
    at, text, last = 0, 0, html.rfind(">")
    while (at := html.find("<", at)) >= 0:
        if html.startswith("<!--", at):
            yield "", html[text:at], ""
            end = at + 4 if html.startswith(">", at + 4) else html.find("-->", at + 2)
            text = at = len(html) if end < 0 else html.index(">", end) + 1
        elif html.startswith(("<!", "<?"), at) and at < last:
            yield "", html[text:at], ""
            text = at = html.index(">", at) + 1
        elif at < last and (m := _TAG.match(html, at)):
            yield "", html[text:at], ""
            tag = m[2].lower()
            text = at = m.end()
            if not m[1] and tag in _RAW and not m[3].endswith("/"):
                end = _RAW_END[tag].search(html, at)
                close = html.find(">", end.start()) if end else -1
                text = at = len(html) if close < 0 else close + 1
                continue
            yield tag, m[3], m[1]
        else:
            at += 1
    yield "", html[text:], ""


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): references.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if "=" in text else {}


def _left_out(tag: str, attrs: dict[str, str], words: frozenset[str]) -> bool:
    if tag in _LEFT_OUT or attrs.get("role", "").lower() in _ROLES:
        return True
    if tag in ("article", "main"):
        return bool(words & {"comment", "comments", "teaser", "related", "promo", "ad"})
    return bool(words & (_WORDS - {"header"} if words & _MAIN_WORDS else _WORDS))  # the header of an article is its title


def _main(tag: str, attrs: dict[str, str], words: frozenset[str]) -> int:
    """How sure an element is the main part: 2 for an article, 1 for what is marked as such, else 0."""
    if tag == "article" or attrs.get("itemprop", "").lower() == "articlebody":
        return 2
    return int(tag == "main" or attrs.get("role", "").lower() == "main" or tag in ("div", "section", "td") and bool(words & _MAIN_WORDS))


class Slot:
    """Sibling elements of one kind: a node of a page's tree, or of a wrapper."""

    __slots__ = ("kind", "pages", "texts", "below")

    def __init__(self, kind: str, pages: int = 1, texts: dict[int, int] | None = None, below: list[Slot] | None = None) -> None:
        self.kind, self.pages, self.texts, self.below = kind, pages, texts or {}, below or []

    def listed(self) -> list:
        return [self.kind, self.pages, list(self.texts.items()), [s.listed() for s in self.below]]

    @staticmethod
    def of(made: list) -> Slot:
        return Slot(made[0], made[1], dict(map(tuple, made[2])), [Slot.of(s) for s in made[3]])


@dataclass(frozen=True)
class _Open:
    tag: str
    slot: int
    depth: int
    main: int | None


class Page:
    """``root``, the tree, and ``blocks``: text, its slot's number in page order and its main part or None, of each block that may be content."""

    def __init__(self, html: str) -> None:
        self.slots = [Slot("#")]
        self.blocks: list[tuple[str, int, int | None]] = []
        self.mains: list[int] = []  # how sure each main part is
        self._known: dict[tuple[int, str], int] = {}  # slots by the one above and kind
        self._text: list[str] = []
        self._stack = [_Open("#", 0, 0, None)]  # open blocks
        self._count: Counter[str] = Counter()
        self._out: str | None = None  # the tag of the element that is left out, and what is open inside it
        self._inside: Counter[str] = Counter()
        for tag, more, closing in tokens(html):
            if not tag:
                if self._out is None and more:
                    self._text.append(more)
            elif closing:
                self._close(tag)
            else:
                self._open(tag, more)
        self._flush()

    @property
    def root(self) -> Slot:
        return self.slots[0]

    def _flush(self) -> None:
        if self._text:
            text = " ".join(references.unescape("".join(self._text)).split())
            self._text = []
            if text:
                top = self._stack[-1]
                self.slots[top.slot].texts[hashed(text)] = 1
                self.blocks.append((text, top.slot, top.main))

    def _pop(self) -> str:
        self._flush()
        tag = self._stack.pop().tag
        self._count[tag] -= 1
        return tag

    def _close(self, tag: str) -> None:
        if self._out is not None:
            if self._inside[tag]:
                self._inside[tag] -= 1
                return
            if tag == self._out:
                self._out = None
                return
            if not self._count[tag]:
                return
            self._out = None  # left open in a block that ends here
        if self._count[tag]:
            while self._pop() != tag:
                pass
        elif tag == "br":
            self._text.append(" ")
        elif tag == "p":
            self._flush()

    def _open(self, tag: str, more: str) -> None:
        closes = _CLOSES.get(tag, ())
        if self._out is not None:
            if self._out not in closes or self._inside["table" if tag[0] == "t" else "ul"] or self._inside["ol"]:
                if tag not in _VOID:
                    self._inside[tag] += 1
                return
            self._out = None  # such as a paragraph at the next one
        if tag == "br":
            self._text.append(" ")
        elif tag == "hr":
            self._flush()
        if tag in _VOID or tag in ("html", "head", "body"):  # which need not be there
            return
        while self._stack[-1].tag in closes:
            self._pop()
        attrs = attributes(more)
        names = f"{attrs.get('class', '')} {attrs.get('id', '')}"
        words = frozenset(_WORD.findall(_CAMEL.sub(" ", names).lower()))
        block, out = tag in _BLOCKS, _left_out(tag, attrs, words)
        if block:
            self._flush()
        if out:
            self._out, self._inside = tag, Counter()
        elif block:
            top = self._stack[-1]
            sure, main = _main(tag, attrs, words), top.main
            if sure > (0 if main is None else self.mains[main]):
                self.mains.append(sure)
                main = len(self.mains) - 1
            self._stack.append(_Open(tag, self._slot(top, tag, attrs), top.depth + 1, main))
            self._count[tag] += 1

    def _slot(self, above: _Open, tag: str, attrs: dict[str, str]) -> int:
        """The slot of an element: that of its kind under the one above, which is also its own below ``DEPTH``."""
        if above.depth >= DEPTH:
            return above.slot
        kind = " ".join([tag, *attrs.get("class", "").split()])
        known = self._known.setdefault((above.slot, kind), len(self.slots))
        if known == len(self.slots):
            self.slots.append(Slot(kind))
            self.slots[above.slot].below.append(self.slots[-1])
        return known


def hashed(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def matching(a: list[Slot], b: list[Slot], sizes: dict) -> list[tuple[int, int]]:
    """Simple tree matching of the slots below two slots: the pairs of one kind, in order, that align the most nodes.

    A kind stands in each list once, so these are the heaviest increasing places in ``b`` of what ``a`` holds; ``sizes``
    keeps what trees were found to have in common.
    """
    if [s.kind for s in a] == [s.kind for s in b]:
        return [(i, i) for i in range(len(a))]
    place = {s.kind: j for j, s in enumerate(b)}
    ends: list[tuple[int, tuple | None]] = [(0, None)] * (len(b) + 1)  # a Fenwick tree: the heaviest chain that ends before a place
    for i, s in enumerate(a):
        if (j := place.get(s.kind)) is None:
            continue
        most, k = (0, None), j
        while k > 0:
            most, k = max(most, ends[k], key=lambda e: e[0]), k & (k - 1)
        chain, k = (most[0] + matched(s, b[j], sizes), (i, j, most[1])), j + 1
        while k <= len(b):
            ends[k], k = max(ends[k], chain, key=lambda e: e[0]), k + (k & -k)
    most, k = (0, None), len(b)
    while k > 0:
        most, k = max(most, ends[k], key=lambda e: e[0]), k & (k - 1)
    pairs, link = [], most[1]
    while link is not None:
        pairs.append((link[0], link[1]))
        link = link[2]
    return pairs[::-1]


def matched(a: Slot, b: Slot, sizes: dict) -> int:
    """How many nodes of two trees simple tree matching aligns."""
    if a.kind != b.kind:
        return 0
    if (key := (id(a), id(b))) not in sizes:
        sizes[key] = 1 + sum(matched(a.below[i], b.below[j], sizes) for i, j in matching(a.below, b.below, sizes))
    return sizes[key]


def merge(a: Slot, b: Slot, sizes: dict | None = None) -> Slot:
    """The wrapper of all pages of two wrappers."""
    sizes = {} if sizes is None else sizes
    texts = dict(a.texts)
    for t, n in b.texts.items():
        texts[t] = texts.get(t, 0) + n
    there, below, i, j = {s.kind for s in a.below}, [], 0, 0
    for p, q in [*matching(a.below, b.below, sizes), (len(a.below), len(b.below))]:
        below += [*a.below[i:p], *(s for s in b.below[j:q] if s.kind not in there)]
        if p < len(a.below):
            below.append(merge(a.below[p], b.below[q], sizes))
        i, j = p + 1, q + 1
    pages = a.pages + b.pages
    if pages >= PRUNE_AT:
        texts = {t: n for t, n in texts.items() if 10 * n >= pages}
        below = [s for s in below if 10 * s.pages >= pages]
    return Slot(a.kind, pages, texts, below)


def constants(page: Slot, wrapper: Slot, least: int) -> dict[int, set[int]]:
    """By the page's slots (as ids): texts that nine tenths of the pages with that slot share, ``least`` pages at any rate."""
    found, todo, sizes = {}, [(page, wrapper)], {}
    while todo:
        p, w = todo.pop()
        found[id(p)] = {t for t in p.texts if w.texts.get(t, 0) >= max(least, 0.9 * w.pages)}
        todo += [(p.below[i], w.below[j]) for i, j in matching(p.below, w.below, sizes)]
    return found


def main_text(page: Page, wrapper: Slot | None) -> str:
    """The text of a page's content."""
    blocks = page.blocks
    amount: dict[int | None, int] = {}
    for text, _, main in blocks:
        amount[main] = amount.get(main, 0) + len(text)
    surest = max((page.mains[m] for m in amount if m is not None), default=0)
    if surest:
        within = max((m for m in amount if m is not None and page.mains[m] == surest), key=lambda m: (amount[m], -m))
        blocks = [b for b in blocks if b[2] == within]
    if wrapper is not None:
        same = constants(page.root, wrapper, SHARED_IN_ARTICLE if surest else SHARED)
        varying = [b for b in blocks if hashed(b[0]) not in same.get(id(page.slots[b[1]]), ())]
        lost = sum(len(b[0]) for b in blocks) - sum(len(b[0]) for b in varying)
        if varying and (not surest or lost <= MOST_SHARED * sum(len(b[0]) for b in blocks)):
            blocks = varying
    return "\n\n".join(b[0] for b in blocks)


def _host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url.cast("string"), r"^[^:/?#]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _rows(batches: Iterable[pa.RecordBatch], *columns: int) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(i).to_pylist() for i in columns), strict=True)


def wrappers(pages: DataFrame, path: str) -> DataFrame:
    """The wrapper of every host that has constant texts: host, wrapper."""

    def send(made: dict[str, Slot]) -> pa.RecordBatch:
        part = TaskContext.get().partitionId()
        return pa.RecordBatch.from_pydict({"host": list(made), "part": [part] * len(made), "wrapper": [json.dumps(w.listed()) for w in made.values()]},
                                          pa.schema([("host", pa.string()), ("part", pa.int64()), ("wrapper", pa.string())]))

    def induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, Slot] = {}
        for host, html in _rows(batches, 0, 1):
            tree = Page(html or "").root
            made[host] = merge(made[host], tree) if host in made else tree
            if len(made) >= _HOSTS_A_TASK:
                yield send(made)
                made = {}
        if made:
            yield send(made)

    def join(group: pa.Table) -> pa.Table:
        made = None
        for text in sorted(group.column("wrapper").to_pylist()):
            one = Slot.of(json.loads(text))
            made = one if made is None else merge(made, one)
        return pa.table({"host": group.column("host")[:1], "part": pa.array([group.column("part")[0].as_py() // FAN_IN], pa.int64()), "wrapper": [json.dumps(made.listed())]})

    schema, n = "host string, part long, wrapper string", 0
    parts = land(pages.select(_host(F.col("url")).alias("host"), F.col("html").cast("string")).mapInArrow(induce, schema), f"{path}/0")
    last = parts.agg(F.max("part")).first()[0] or 0
    while last or not n:
        n += 1
        parts, last = land(parts.groupBy("host", F.expr(f"part div {FAN_IN}")).applyInArrow(join, schema), f"{path}/{n}"), last // FAN_IN

    def constant(texts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in texts:
            keep = [_has_constant(Slot.of(json.loads(w))) for w in b.column(1).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return land(parts.select("host", "wrapper").mapInArrow(constant, "host string, wrapper string"), f"{path}/kept")


def _has_constant(wrapper: Slot) -> bool:
    return any(n >= max(SHARED, 0.9 * wrapper.pages) for n in wrapper.texts.values()) or any(map(_has_constant, wrapper.below))


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with the main text of each instead of its html."""
    spark = pages.sparkSession
    ship(spark)
    path = work_dir(spark, "wrappers")
    found = wrappers(pages.select(F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html")), path)
    kept = [c for c in pages.columns if c not in (html, "text")]
    kinds = dict(pages.dtypes)
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), _host(F.col(f"`{url}`")).alias("host"), F.col(f"`{html}`").cast("string").alias("html"))
    rows = rows.join(found.withColumnRenamed("host", "__host"), F.col("host") == F.col("__host"), "left").select("row", "html", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Slot] = {}
        for b in batches:
            texts = []
            for page, wrapper in _rows([b], 1, 2):
                if wrapper is not None and wrapper not in known:
                    known = {wrapper: Slot.of(json.loads(wrapper))}
                texts.append(main_text(Page(page or ""), known[wrapper] if wrapper is not None else None))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["row", "text"])

    kind = ", ".join(f"`{c}`: {kinds[c]}" for c in kept)
    return rows.mapInArrow(run, f"row struct<{kind}>, text string").select("row.*", "text")
