"""Main text of web pages: site template removal, then the article's blocks.

Every page is parsed into its elements. Each container element (``div``, ``section``, ``ul`` and the like) gets a hash of its
whole subtree: tags and text. Spark counts, per host, on how many different pages each subtree stands; those on at least
``LEAST_PAGES`` pages and ``LEAST_SHARE`` of the host's pages, or on ``MANY_PAGES`` pages, are its template and are deleted
everywhere, before the article is looked for. Pages with the same article text
(taken as below, with no template known) are one page for this count, whatever menus, adverts and comments stand around it, so
copies of an article don't make it a template. What stands on any of the copies counts once for all of them. Paragraphs, headings
and list items are no containers, so a line that many articles share stays in them.

Of what is left, the text of the article is taken: the ``article`` elements, else ``main``, else the body, without elements that
say what they are (an ``article`` or ``main`` that is or stands in a reader's comment is none): by tag (menus, headers, footers, sidebars, forms, scripts, styles), role or a word of their class or id
(adverts, notices, comments). A header inside an article keeps its headings. Character references are decoded, white space
inside a block becomes one space, blocks are joined by an empty line.

Defined results: null, empty and tag-only pages have the empty text; html that was cut off or isn't well formed is read as far as
it goes, with open elements closed where browsers close them; repeated rows are pages each; a null or odd url is a host of its own name
(the empty string); other columns are kept, but for one named ``text``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tutorloom.llm.common import slices, small_or_not, written

LEAST_PAGES, LEAST_SHARE = 5, 0.2
MANY_PAGES = 1000  # different articles that share a container: it's the site's, whatever its share of a large host
MOST_HOSTS = 100_000  # hosts whose template lists may be sent to all executors
SLICE_CHARS = 4_000_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template".split())
CONTAINERS = frozenset("div section ul ol dl nav table form footer header aside figure details fieldset menu".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre article main address figcaption summary tr td th thead tbody tfoot caption hr body html center legend option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# an element that is still open is closed by these, unless one of its second list stands between
CLOSED_BY = {
    "p": (BLOCKS - frozenset("tr td th thead tbody tfoot caption option legend".split()), frozenset("td th table button object article section div li".split())),
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "td": (frozenset("td th tr tbody tfoot".split()), frozenset(["table"])),
    "th": (frozenset("td th tr tbody tfoot".split()), frozenset(["table"])),
    "tr": (frozenset("tr tbody tfoot".split()), frozenset(["table"])),
    "option": (frozenset("option optgroup".split()), frozenset(["select"])),
}
LEFT_OUT = frozenset("nav footer aside form script style noscript template iframe button select textarea title head svg canvas object dialog menu audio video input".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promotion cookie cookies consent gdpr notice popup modal overlay"
    " sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments replies disqus share sharing social newsletter subscribe"
    " subscription related recommended pagination pager toolbar widget skip login signup search".split()
)
COMMENT = re.compile(r"(?:^|\s)(?:comments?|repl(?:y|ies)|disqus_thread|comments?-(?:list|area|body|thread|section|wrapper))(?=\s|$)", re.I)
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Page:
    """Elements in page order: ``tag``, ``marks`` (the attributes), ``parent``, and the ``events`` (kind, element, text) between them."""

    OPEN, CLOSE, TEXT = 0, 1, 2

    def __init__(self, html: str):
        self.tag, self.marks, self.parent = ["#page"], [""], [-1]
        self.events: list[tuple[int, int, str]] = []
        stack, at = [0], 0
        while at < len(html):
            m = TAG.search(html, at)
            if m is None:
                self._text(stack[-1], html[at:])
                break
            self._text(stack[-1], html[at : m.start()])
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                self._end(stack, name)
                continue
            for open_tag, (closers, walls) in CLOSED_BY.items():
                if name in closers:
                    self._end(stack, open_tag, walls)
            node = len(self.tag)
            self.tag.append(name)
            self.marks.append(m[3])
            self.parent.append(stack[-1])
            self.events.append((self.OPEN, node, ""))
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                self._text(node, html[at : end.start() if end else len(html)])
                at = end.end() if end else len(html)
                self.events.append((self.CLOSE, node, ""))
            elif name in VOID or m[3].endswith("/") and name not in BLOCKS:
                self.events.append((self.CLOSE, node, ""))
            else:
                stack.append(node)
        while len(stack) > 1:
            self.events.append((self.CLOSE, stack.pop(), ""))

    def _text(self, node: int, text: str) -> None:
        if text:
            self.events.append((self.TEXT, node, text))

    def _end(self, stack: list[int], name: str, walls: frozenset[str] = frozenset()) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[depth]]
            if tag == name:
                for node in reversed(stack[depth:]):
                    self.events.append((self.CLOSE, node, ""))
                del stack[depth:]
                return
            if tag in walls:
                return

    def subtrees(self) -> dict[int, int]:
        """Hash of every container's subtree."""
        parts: list[list[bytes]] = [[] for _ in self.tag]
        hashes = {}
        for kind, node, text in self.events:
            if kind == self.TEXT:
                parts[node].append(" ".join(text.split()).encode())
            elif kind == self.CLOSE:
                digest = xxhash.xxh3_64_digest(b"\x00".join([self.tag[node].encode(), *parts[node]]))
                parts[self.parent[node]].append(digest)
                parts[node] = []
                if self.tag[node] in CONTAINERS:
                    hashes[node] = int.from_bytes(digest, "big", signed=True)
        return hashes

    def copy_key(self) -> int:
        """Hash of the article's text, equal for its copies between other menus, adverts and comments."""
        return int.from_bytes(xxhash.xxh3_64_digest(self.main_text(set()).encode()), "big", signed=True)

    def _attributes(self, node: int) -> dict[str, str]:
        return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(self.marks[node])} if self.marks[node] else {}

    def _speaks(self, node: int) -> bool:
        """Whether tag, role, class or id say that the element is none of the article's text."""
        if self.tag[node] in LEFT_OUT:
            return True
        own = self._attributes(node)
        if not own:
            return False
        hidden = "hidden" in own or own.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", own.get("style", ""))
        named = WORD.findall(f"{own.get('class', '')} {own.get('id', '')}")
        return bool(hidden) or own.get("role", "").lower() in ROLES or any(w.lower() in WORDS for w in named)

    def main_text(self, template: set[int]) -> str:
        inside = {"article": [], "main": []}
        hashes = self.subtrees() if template else {}
        lost = [False] * len(self.tag)  # in the template or in a comment: no place for the article
        ancestors: list[set[str]] = [set()]
        for node in range(1, len(self.tag)):
            up = self.parent[node]
            ancestors.append(ancestors[up] | {self.tag[up]} if self.tag[up] in ("article", "main", "aside", "footer") else ancestors[up])
            own = self._attributes(node)
            marked = self.tag[node] not in ("html", "body") and COMMENT.search(f"{own.get('class', '')} {own.get('id', '')}")
            lost[node] = lost[up] or bool(marked) or hashes.get(node) in template
            kind = "main" if own.get("role") == "main" else self.tag[node]
            if kind in inside and not lost[node] and not {kind, "aside", "footer"} & ancestors[node]:
                inside[kind].append(node)
        roots = set(inside["article"] or inside["main"] or [0])
        taken, dropped = [False] * len(self.tag), [False] * len(self.tag)
        heading = [False] * len(self.tag)  # inside a header of the article: only its headings count
        in_header = [False] * len(self.tag)
        taken[0] = 0 in roots
        blocks, current = [], []

        def flush() -> None:
            text = " ".join("".join(current).split())
            if text:
                blocks.append(text)
            current.clear()

        for kind, node, text in self.events:
            tag = self.tag[node]
            if kind == self.TEXT:
                if taken[node] and not dropped[node] and (heading[node] or not in_header[node]):
                    current.append(unescape(text))
                continue
            if tag in BLOCKS:
                flush()
            elif tag == "br":
                current.append(" ")
            if kind == self.OPEN:
                up = self.parent[node]
                taken[node] = taken[up] or node in roots
                wraps = node in roots or not taken[node] or tag in ("html", "body")
                dropped[node] = dropped[up] or not wraps and (self._speaks(node) or hashes.get(node) in template) or tag == "head"
                in_header[node] = in_header[up] or tag == "header"
                heading[node] = heading[up] or tag in HEADINGS and 0 not in roots
        flush()
        return "\n\n".join(blocks)


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def _found(pages: DataFrame) -> DataFrame:
    """(host, body, subtrees) of every page: hash of its article's text and of its containers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html", SLICE_CHARS):
            found = [(p.copy_key(), sorted(set(p.subtrees().values()))) for p in map(Page, (html or "" for html in part.column("html").to_pylist()))]
            columns = [part.column("host"), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "body", "subtrees"])

    return pages.select("host", "html").mapInArrow(run, "host string, body bigint, subtrees array<bigint>")


def templates(pages: DataFrame) -> DataFrame:
    """(host, template): the hashes of the subtrees that recur on the host's pages (``pages``: host, html).

    A page's elements can't be many times those of another, and each listed subtree is on a fifth of the pages or on ``MANY_PAGES``:
    lists stay short.
    """
    found = written(_found(pages), "found")
    totals = found.select("host", "body").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    different = found.select("host", "body", F.explode("subtrees").alias("subtree")).distinct()
    counts = different.groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_PAGES)
    return counts.join(totals, "host").where((F.col("n") >= LEAST_SHARE * F.col("pages")) | (F.col("n") >= MANY_PAGES)).groupBy("host").agg(F.sort_array(F.collect_list("subtree")).alias("template"))


def main_texts(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with column ``text``."""
    kept = [c for c in pages.columns if c != "text" and c != html]
    hosted = pages.select(*kept, host_of(F.col(url)).alias("__host"), F.col(html).alias("__html"))
    known = small_or_not(written(templates(hosted.select(F.col("__host").alias("host"), F.col("__html").alias("html"))), "templates"), MOST_HOSTS)
    joined = hosted.join(known.select(F.col("host").alias("__host"), F.col("template").alias("__template")), "__host", "left")
    schema = T.StructType([*(pages.schema[c] for c in kept), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__html", SLICE_CHARS):
            rows = zip(part.column("__html").to_pylist(), part.column("__template").to_pylist(), strict=True)
            texts = [Page(own or "").main_text(set(template or ())) for own, template in rows]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(texts, pa.string())], names=schema.names)

    return joined.select(*kept, "__html", "__template").mapInArrow(run, schema)
