"""Main text of web pages by site template removal (operator 5).

1. Every page is read into its elements.  Each block element with text gets a hash of its subtree: tag names and texts, but
   no attributes, since links and counters differ from page to page.  A block of links (three at least, half of its text)
   also gets a hash of its skeleton: tag names, attribute names and classes without any text, equal neighbours once, since
   menus and link lists recur with other entries.
2. Spark counts, for each host, the different pages that hold a subtree; pages that give the same text count as one, so
   copies of an article never make it a template.  Subtrees on at least half of a host's pages, and on ten at least, are its
   template.  Hosts with fewer pages have none; their pages are cleaned by what the markup names alone.
3. Inside an article or main element a subtree is counted on its own, and only if it holds five words at least and is no
   heading: short labels and headings recur in articles as a matter of course, whole sentences recur as notices.
4. Each page drops its host's template subtrees, except those that are or hold its article or main element.  It also drops
   everything that its markup names as no main text (menus, headers,
   footers, sidebars, notices, adverts, forms, scripts, styles, comments of readers), and gives the blocks of its article,
   or else of its main element, or else of its body without blocks made of links.

Defined cases: null and empty html give the empty text; pages without a host are their own and have no template.  Repeated
rows count once and give equal texts.  Broken markup is read as browsers read it: an open paragraph ends
where the next block starts, unknown end tags are skipped, open elements end with the page.  Other columns are not read.

A class or id name marks an element only as a whole name (``ad``, not ``has-sidebar``), never one that is or holds an article
or main element (but for articles named as a reader's comment), and no heading or section inside an article.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souklens.llm.storage import cut

SHARE, LEAST_PAGES = 0.5, 10
LINKS = 3           # of a block that may be template by its skeleton
INSIDE_WORDS = 5    # that a subtree inside an article holds before it may be template

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
                  r"|<[!?/][^>]*>", re.S)
_NAMED = re.compile(r"(?<![\w-])(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?",
                    re.I)
_NAME = re.compile(r"(?:^|(?<=[\s\"']))[a-zA-Z][\w:-]*(?=\s*=|\s|/|$)")
_SPACE = re.compile(r"[ \t\n\r\f\v\xa0  -     　\x85]+")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)|^//(?:[^/?#@]*@)?([^/?#:]+)")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr
    ul caption""".split())
JUNK_TAGS = frozenset("""head script style noscript template nav footer aside form iframe svg math canvas object embed audio
    video button select option textarea input label menu dialog map applet frameset noframes title""".split())
JUNK_WORDS = frozenset("""ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo
    promotion promotions banner banners cookie cookies consent gdpr notice notices notification notifications popup modal
    overlay sidebar sidebars widget widgets menu menus navbar nav navigation breadcrumb breadcrumbs masthead footer footers
    comment comments disqus reply replies respond share sharing social related recommended recommendations newsletter
    subscribe subscription signup login search searchbox pagination pager toolbar skip""".split())
READER_WORDS = frozenset(("comment", "reply"))     # class names of an article that a reader wrote
HEADED = frozenset("h1 h2 h3 h4 h5 h6 section".split())
HEADINGS = HEADED - {"section"}
_INSIDE, _SKELETON = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F    # tell the kinds of hashes apart
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar "
                       "toolbar".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
           "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"},
           "tfoot": {"tbody", "thead", "tr", "td", "th"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
          "option": {"select", "datalist"}, "tbody": {"table"}, "tfoot": {"table"}}
_RAW_END = {n: re.compile(rf"</{n}[^>]*>", re.I) for n in RAW}


class Element:
    __slots__ = ("tag", "first", "end", "junk", "named", "main", "parts", "digest", "depth", "spared", "inside", "shape", "skeleton", "links")

    def __init__(self, tag: str, first: int, junk: bool, named: bool, main: str, depth: int, shape: str):
        self.tag, self.first, self.end, self.junk, self.main, self.depth = tag, first, first, junk, main, depth
        self.named = named      # a class or id name says that it is no main text
        self.parts: list[str] | None = [tag]
        self.digest = self.skeleton = self.links = 0
        self.shape: list[str] | None = [shape]
        self.spared = False     # is, holds or stands inside the page's article or main element
        self.inside = False     # stands inside it


class Page:
    """The texts of a page in order, each with the number of its block, and the elements over them."""

    def __init__(self, source: str):
        self.texts: list[str] = []
        self.blocks: list[int] = []
        self.linked: list[bool] = []
        self.elements: list[Element] = []
        self._stack: list[Element] = []
        self._block = self._links = 0
        self._read(source)

    def _read(self, s: str) -> None:
        at, n = 0, len(s)
        for m in iter(lambda: _TAG.search(s, at), None):
            if m.start() > at:
                self._text(s[at:m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name = name.lower()
            if m[1] or m[4]:
                self._close(name)
            else:
                attributes = m[3] if m[2] else m[6]
                self._open(name, attributes or "")
                if name in RAW:
                    end = _RAW_END[name].search(s, at)
                    at = end.end() if end else n
                    self._close(name)
        if at < n:
            self._text(s[at:])
        while self._stack:
            self._pop()
        self._spare()

    def _spare(self) -> None:
        """Mark the article and main elements that hold text, and the elements over and inside them."""
        shown = bytearray(not t.isspace() and t != "" for t in self.texts)
        for e in self.elements:
            if e.junk:
                shown[e.first:e.end] = bytes(e.end - e.first)
        inside = None
        for e in self.elements:
            if inside is not None and e.depth <= inside:
                inside = None
            e.inside = inside is not None
            e.spared = inside is not None or e.main != "" and not e.named and shown.find(1, e.first, e.end) >= 0
            if inside is None and e.spared:
                inside = e.depth
            elif inside is not None and e.tag in HEADED:
                e.named = False
        below = 0
        for e in reversed(self.elements):
            if e.spared:
                below = e.depth
            elif e.depth < below:
                e.spared, below = True, e.depth
                e.named = False

    def _text(self, raw: str) -> None:
        if raw.isspace() and not self.texts:
            return
        text = _SPACE.sub(" ", entities.unescape(raw) if "&" in raw else raw)
        self.texts.append(text)
        self.blocks.append(self._block)
        self.linked.append(self._links > 0)
        if self._stack:
            self._stack[-1].parts.append(text.strip())

    def _open(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            if tag in _CLOSES:
                self._implied(_CLOSES[tag], _SCOPE[tag])
            if tag not in ("body", "html"):
                self._implied({"p"}, {"table", "button", "object"})
            self._block += 1
        if tag in VOID:
            if tag == "br":
                self._text(" ")
            return
        junk, main, names = tag in JUNK_TAGS, tag if tag in ("article", "main") else "", []
        if attributes and "=" in attributes or "hidden" in attributes:
            for a in _NAMED.finditer(attributes):
                key, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
                if key in ("class", "id"):
                    names += value.split()
                elif key == "role":
                    junk |= value in JUNK_ROLES
                    main = main or ("main" if value == "main" else "article" if value == "article" else "")
                elif key == "itemprop":
                    main = main or ("article" if value == "articlebody" else "")
                elif key == "style":
                    junk |= "display:none" in value.replace(" ", "")
                else:
                    junk |= value != "false" if key == "aria-hidden" else True
        if tag == "header" and not any(e.tag == "article" for e in self._stack):
            junk = True
        words = (JUNK_WORDS if not main else READER_WORDS if main == "article" else frozenset())
        named = tag not in ("body", "html") and not words.isdisjoint(names)
        shape = f"{tag} {' '.join(sorted({a.lower() for a in _NAME.findall(attributes)}))} {' '.join(names)}" if attributes else tag
        e = Element(tag, len(self.texts), junk, named, main, len(self._stack), shape)
        self.elements.append(e)
        self._stack.append(e)
        self._links += tag == "a"

    def _implied(self, closed: set, scope: set) -> None:
        for k in range(len(self._stack) - 1, -1, -1):
            tag = self._stack[k].tag
            if tag in closed:
                while len(self._stack) > k:
                    self._pop()
                return
            if tag in scope or tag in ("article", "body", "html", "section", "main") and "p" in closed:
                return

    def _close(self, tag: str) -> None:
        if tag in BLOCK:
            self._block += 1
        for k in range(len(self._stack) - 1, -1, -1):
            if self._stack[k].tag == tag:
                while len(self._stack) > k:
                    self._pop()
                return
            if tag == "p" and self._stack[k].tag in ("article", "section", "div", "td", "body", "li"):
                return

    def _pop(self) -> None:
        e = self._stack.pop()
        e.end = len(self.texts)
        self._links -= e.tag == "a"
        if e.tag in BLOCK:
            self._block += 1
        e.digest = xxhash.xxh3_64_intdigest("\x00".join(e.parts).encode("utf-8", "replace"))
        e.skeleton = xxhash.xxh3_64_intdigest("\x00".join(e.shape))
        e.parts = e.shape = None
        e.links += e.tag == "a"
        if self._stack:
            up = self._stack[-1]
            up.parts.append(f"{e.tag}{e.digest:x}")
            up.links += e.links
            if up.shape[-1] != (mark := f"{e.skeleton:x}"):
                up.shape.append(mark)

    def _keys(self, e: Element) -> Iterator[int]:
        """The signed hashes by which a block element is counted, and found, as template."""
        if e.tag not in BLOCK or e.tag in ("html", "body") or e.spared and not e.inside:
            return
        if e.links >= LINKS:
            size = sum(map(len, self.texts[e.first:e.end]))
            if 2 * sum(len(t) for t, link in zip(self.texts[e.first:e.end], self.linked[e.first:e.end]) if link) >= size:
                yield _signed(e.skeleton ^ _SKELETON ^ (_INSIDE if e.inside else 0))
        if not e.inside:
            yield _signed(e.digest)
        elif e.tag not in HEADINGS:
            words = 0
            for t in self.texts[e.first:e.end]:
                words += len(t.split())
                if words >= INSIDE_WORDS:
                    yield _signed(e.digest ^ _INSIDE)
                    return

    def subtrees(self) -> set[int]:
        """Signed hashes of the block elements that hold text and may be template."""
        return {k for e in self.elements if any(t.strip() for t in self.texts[e.first:e.end]) for k in self._keys(e)}

    def identity(self) -> int:
        """Signed hash of the text that the page gives without a template: copies of a page have the same."""
        return _signed(xxhash.xxh3_64_intdigest(self.main_text(frozenset()).encode("utf-8", "replace")))

    def main_text(self, template: frozenset) -> str:
        """The text without template and junk; class and id names count for nothing where they leave no text at all."""
        return self._main_text(template, True) or (
            self._main_text(template, False) if any(e.named for e in self.elements) else "")

    def _main_text(self, template: frozenset, by_name: bool) -> str:
        keep = bytearray(b"\x01") * len(self.texts)
        for e in self.elements:
            if e.junk or e.named and by_name or template and any(k in template for k in self._keys(e)):
                keep[e.first:e.end] = bytes(e.end - e.first)
        for kind in ("article", "main"):
            inside = bytearray(len(self.texts))
            for e in self.elements:
                if e.main == kind:
                    inside[e.first:e.end] = b"\x01" * (e.end - e.first)
            blocks = self._join(bytes(a & b for a, b in zip(keep, inside)))
            if blocks:
                return "\n".join(t for t, _ in blocks)
        return "\n".join(t for t, links in self._join(bytes(keep)) if 2 * links <= len(t))

    def _join(self, keep: bytes) -> list[tuple[str, int]]:
        """(text, characters inside links) of each block that has text."""
        out, block, parts, links = [], -1, [], 0

        def end() -> None:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append((text, links))

        for k, text in enumerate(self.texts):
            if not keep[k]:
                continue
            if self.blocks[k] != block:
                end()
                block, parts, links = self.blocks[k], [], 0
            parts.append(text)
            links += len(text) if self.linked[k] else 0
        end()
        return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return (m[1] or m[2] or "").lower().rstrip(".") if m else ""


def site_templates(pages: DataFrame, share: float = SHARE, least: int = LEAST_PAGES) -> DataFrame:
    """(host, template): for each host the hashes of the subtrees that recur across its different pages."""
    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, same, found = [], [], []
            for url, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if host := host_of(url):
                    page = Page(source or "")
                    hosts.append(host)
                    same.append(page.identity())
                    found.append([None, *page.subtrees()])
            yield pa.record_batch([pa.array(hosts, pa.string()), pa.array(same, pa.int64()),
                                   pa.array(found, pa.list_(pa.int64()))], ["host", "page", "subtrees"])

    rows = (pages.select("url", "html").mapInArrow(subtrees, "host string, page long, subtrees array<long>")
            .select("host", "page", F.explode("subtrees").alias("subtree")).distinct())
    counts = cut(rows.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n")).filter(f"n >= {least}"), "subtree-counts")
    total = counts.filter("subtree is null").select("host", F.col("n").alias("pages"))
    often = counts.filter("subtree is not null").join(total, "host").filter(F.col("n") >= share * F.col("pages"))
    return cut(often.groupBy("host").agg(F.collect_set("subtree").alias("template")), "site-templates")


def main_texts(pages: DataFrame, share: float = SHARE, least: int = LEAST_PAGES) -> DataFrame:
    """(page_id, url, text) for every row of ``pages(page_id, url, html)``."""
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: dict = {}
            texts = []
            for source, template in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                key = tuple(template or ())
                if key not in sets:
                    sets[key] = frozenset(key)
                texts.append(Page(source).main_text(sets[key]) if source else "")
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    templates = site_templates(pages, share, least)
    # The same host rule as host_of, as an expression, so that the join needs no Python before it.
    host = F.lower(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    named = pages.select("page_id", "url", "html", F.regexp_replace(host, r"\.+$", "").alias("host"))
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return (named.join(templates, "host", "left").select("page_id", "url", "html", "template")
            .mapInArrow(extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string"))


def op5_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
