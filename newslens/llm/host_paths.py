"""Main text of web pages by consensus paths: containers are scored per page, paths voted on per host, pages re-extracted.

1. Every container of a page (article, section, division, cell ...) is scored by the visible text directly in it, without
   links and without boilerplate, plus half of what its child containers score. A page votes for the generalised path of its best
   container: tags and classes from the root down, digits replaced by ``#``.
2. Spark counts votes per (host, path), before the shuffle per task. The winning paths of a host are those with at least
   ``SHARE`` of its votes and ``LEAST`` votes. Only path digests and counts leave a page.
3. Every page is read again with the winning paths of its host: of its containers on one of them the one with the best score is
   the article; pages without any (a lone template, no host) keep their own best container.

Blocks are what the block-level tags of HTML separate; ``br`` is white space. An end tag closes what is open inside it, a
block-level start tag closes an open ``p``, and ``li``, ``td``, ``tr``, ``dt``, ``dd`` and ``option`` close their like.

Defined results: a null html, or one without text in a container, gives an empty text and 0. Rows are independent
but for the votes: repeated rows vote and return as often as they occur, null and unparsable urls vote nowhere. Ties between containers go
to the outer, then to the earlier one, ties between paths change nothing (all winners count). Unclosed tags, comments and scripts
run to the end of the page; any depth of nesting is read in linear time. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newslens.runtime import materialize

SHARE = 0.1
LEAST = 2
# Tags of HTML by what they mean for a page's text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
CONTAINERS = frozenset("body div article section main td th center".split())
ARTICLES = frozenset(("article", "main"))
HEADERS = frozenset(("header",))
BLOCKS = CONTAINERS | frozenset(
    "address aside blockquote caption dd details dialog dir dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html li menu nav ol p pre "
    "search select option optgroup summary table tbody tfoot thead tr ul button legend".split()
)
DROPPED = frozenset("head nav footer aside form menu dialog button select option svg math template object canvas audio video map datalist search".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar status".split())
# Words of classes and ids that mark what is not the article.
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs footer "
    "masthead sidebar notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup social share sharing related recommended "
    "comment comments commentlist disqus reply replies respond pagination pager toolbar widget widgets login search skip".split()
)
MODIFIERS = frozenset("has have with without no not is open closed enabled disabled".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TAG = re.compile(r"""<(?:!--|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[!?/][^>]*>)""")
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")


class Element:
    """An open element. ``path`` is a digest of the tags and classes from the root down."""

    __slots__ = ("tag", "step", "parent", "path", "dropped", "head", "box", "linked")

    def __init__(self, tag: str, step: str, parent: Element | None, dropped: bool, head: bool):
        self.tag, self.step, self.parent, self.dropped, self.head = tag, step, parent, dropped, head
        self.linked = parent is not None and (parent.linked or tag == "a")
        self.path = blake2b(step.encode(), digest_size=8, key=parent.path).digest() if parent else b""
        self.box: Box | None = parent.box if parent else None

    def inside(self, tags: frozenset[str]) -> bool:
        box = self.box
        while box is not None and box.element.tag not in tags:
            box = box.outer
        return box is not None


class Box:
    """A container: its score, and where its blocks begin and end in the list of blocks of the page."""

    __slots__ = ("element", "outer", "own", "begin", "end")

    def __init__(self, element: Element, outer: Box | None, begin: int):
        self.element, self.outer, self.own, self.begin, self.end = element, outer, 0.0, begin, -1

    @property
    def path(self) -> int:
        return int.from_bytes(self.element.path, "little", signed=True)


def _listed(token: str, words: frozenset[str]) -> bool:
    """Whether a class or id says that its element is one of ``words``, and not that something has or lacks one."""
    parts = [w.lower() for w in _WORD.findall(token)]
    return bool(parts) and (parts[0] in words or parts[-1] in words) and not MODIFIERS.intersection(parts)


def _marks(attributes: str) -> tuple[str, bool, bool]:
    """Generalised classes of a tag, whether a class, id or role marks it as no part of an article, and whether as a header."""
    if "=" not in attributes:
        return "", False, False
    classes, dropped, header = "", False, False
    for name, *values in _NAMED.findall(attributes):
        value = unescape(values[0] or values[1] or values[2])
        if name.lower() == "role":
            dropped |= value.strip().lower() in DROPPED_ROLES
            continue
        dropped |= any(_listed(t, DROPPED_WORDS) for t in value.split())
        header |= any(_listed(t, HEADERS) for t in value.split())
        if name.lower() == "class":
            classes = "".join(f".{c}" for c in sorted({_DIGITS.sub("#", c) for c in value.split()}))
    return classes, dropped, header


class Page:
    """Blocks of text of a page in order, and its containers."""

    def __init__(self, html: str):
        self.blocks: list[str] = []
        self.boxes: list[Box] = []
        self._run: list[str] = []  # text of the open block
        self._plain = 0  # of it, characters outside links
        root = Element("", "", None, False, False)
        self._top = root
        self._counts: dict[str, int] = {}
        self._read(html)
        self._flush()
        while self._top is not root:
            self._pop()
        for box in reversed(self.boxes):  # inner ones come later
            if box.outer:
                box.outer.own += box.own / 2

    def _flush(self) -> None:
        if self._run:
            text = " ".join(unescape("".join(self._run)).split())
            if text:
                self.blocks.append(text)
                if self._top.box and self._plain:
                    self._top.box.own += self._plain * (2 if self._top.tag in ("p", "article", "main", "pre") else 1)
            self._run, self._plain = [], 0

    def _text(self, text: str) -> None:
        if text and not self._top.dropped:
            self._run.append(text)
            if not self._top.linked:
                self._plain += len(text) - text.count(" ")

    def _push(self, tag: str, classes: str, marked: bool, header: bool) -> None:
        up = self._top
        marked = tag in DROPPED or (marked and tag not in ("html", "body"))
        header = tag == "header" or (header and tag != "body")
        kept = up.head and tag in HEADINGS and not marked  # the title in the header of an article
        head = not kept and not marked and (up.head or (header and not up.dropped and up.inside(ARTICLES)))
        element = Element(tag, f"{tag}{classes}", up, not kept and (up.dropped or marked or header), head)
        if tag in CONTAINERS and not element.dropped:
            element.box = Box(element, up.box, len(self.blocks))
            self.boxes.append(element.box)
        self._top = element
        self._counts[tag] = self._counts.get(tag, 0) + 1

    def _pop(self) -> None:
        element = self._top
        if element.box and element.box.element is element:
            element.box.end = len(self.blocks)
        self._counts[element.tag] -= 1
        self._top = element.parent

    def _close(self, tags: set[str], scope: frozenset[str] | set[str]) -> bool:
        """Close the nearest open element of ``tags`` unless one of ``scope`` stands between."""
        if not any(self._counts.get(t) for t in tags):
            return False
        e = self._top
        while e.parent is not None and e.tag not in tags:
            if e.tag in scope:
                return False
            e = e.parent
        if e.parent is None:
            return False
        while self._top is not e:
            self._pop()
        self._pop()
        return True

    def _start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self._flush()
            self._close({"p"}, CONTAINERS)
            if tag in HEADINGS and self._top.tag in HEADINGS:
                self._pop()
            while tag in CLOSES and self._close(CLOSES[tag], SCOPES[tag]):
                pass
        if tag == "br":
            self._text(" ")
        if tag not in VOID:
            if tag == "a":
                self._close({"a"}, BLOCKS)
            marks = _marks(attributes)
            if tag in BLOCKS or tag == "a" or tag in DROPPED or marks[1]:
                self._push(tag, *marks)

    def _end(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        if self._counts.get(tag):
            self._close({tag}, set() if tag in CONTAINERS or tag in DROPPED or tag in ("table", "ul", "ol", "html") else CONTAINERS)

    def _read(self, html: str) -> None:
        at = 0
        while (lt := html.find("<", at)) >= 0:
            found = _TAG.match(html, lt)
            if not found:
                self._text(html[at : lt + 1])
                at = lt + 1
                continue
            self._text(html[at:lt])
            at = found.end()
            if found.group() == "<!--":
                end = lt + 4 if html.startswith(">", lt + 4) else html.find("-->", lt + 2)
                at = len(html) if end < 0 else end + (1 if end == lt + 4 else 3)
                continue
            tag = found.group(2) or found.group(5)
            if not tag:
                continue
            tag, attributes = tag.lower(), found.group(3) or found.group(6) or ""
            if found.group(1) or found.group(4):
                self._end(tag)
            elif tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = end.end() if end else len(html)
            elif tag == "plaintext":
                at = len(html)
            else:
                self._start(tag, attributes)
                if attributes.endswith("/") and tag in ("svg", "math"):
                    self._pop()
        self._text(html[at:])

    def best(self, paths: frozenset[int] | None = None) -> Box | None:
        """The container with the highest score, of those on one of ``paths`` if given; without, the article element around it if there is one."""
        out = None
        for box in self.boxes:
            if (paths is None or box.path in paths) and (out is None or box.own > out.own):
                out = box
        around = out if paths is None else None
        while around is not None and around.element.tag != "article":
            around = around.outer
        return around or out

    def text(self, box: Box | None) -> str:
        return "\n".join(self.blocks[box.begin : box.end]) if box else ""


def path_text(box: Box) -> str:
    """The path in words, from the root down."""
    steps, e = [], box.element
    while e.parent is not None:
        steps.append(e.step)
        e = e.parent
    return " > ".join(reversed(steps))


def host_of(url: Column) -> Column:
    """Host of a url in lower case, without user and port; null where there is none."""
    found = F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def votes(pages: DataFrame) -> DataFrame:
    """``(host, path)``: the vote of each page of ``(host, html)`` that has a host and a container with text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, html in zip(batch.column(0), batch.column(1)):
                box = Page(html.as_py()).best()
                if box and box.own > 0:
                    rows.append((host.as_py(), box.path))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64()))], names=["host", "path"])

    return pages.filter("host is not null and html is not null").mapInArrow(run, "host string, path bigint")


def winning_paths(cast: DataFrame, share: float = SHARE) -> DataFrame:
    """``(host, paths)`` with the paths that got at least ``share`` of the votes of a host; at most ``1 / share`` of them."""
    per_path = cast.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    total = per_path.groupBy("host").agg(F.sum("n").alias("total"))
    won = per_path.filter(F.col("n") >= LEAST).join(total, "host").filter(F.col("n") >= share * F.col("total"))
    return won.groupBy("host").agg(F.collect_set("path").alias("paths"))


def extracted(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for html, paths in zip(batch.column(2), batch.column(3)):
                page = Page(html.as_py()) if html.is_valid else None
                box = page.best(frozenset(paths.as_py())) if page and paths.is_valid else None
                texts.append(page.text(box or page.best()) if page else "")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    url = F.col("url").cast("string")
    rows = pages.select("page_id", url.alias("url"), F.col("html").cast("string").alias("html"), host_of(url).alias("host"))
    winners = materialize(winning_paths(votes(rows.select("host", "html")), share), "host-paths")
    # a plain join: Spark broadcasts the stored winners where their size allows, and else joins by host, splitting large ones
    named = rows.join(winners, "host", "left").select("page_id", "url", "html", "paths")
    kind = pages.schema["page_id"].dataType.simpleString()
    return named.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")


def op11_query(spark: SparkSession, sf: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf}/pages.parquet"))
