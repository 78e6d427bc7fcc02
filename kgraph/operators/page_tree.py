"""Pages parsed once: title, headings, paragraphs, list items, tables, ordered blocks and links of each page.

The parser keeps one stack of open elements and closes those that HTML closes by itself. Its result is a flat list of
elements in document order, each with the end of its subtree, so that every rule below is a pass over a range:
noise is a range left out, a table's rows are the ``tr`` elements in its range, and a text is the run of text
nodes in a range. Rows of a page never leave its task; Spark deals pages.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements and classes that hold no content; callers may pass others.
NOISE_TAGS = ["script", "style", "noscript", "iframe", "svg", "nav", "footer"]
NOISE_CLASSES = ["navbar", "navigation", "menu", "sidebar", "breadcrumb", "breadcrumbs", "social", "share", "cookie", "popup", "modal"]
#: Texts up to so many characters are no paragraphs and no list items.
SHORT_PARAGRAPH, SHORT_ITEM = 20, 15
#: Pages that are held as Python objects at once.
PIECE = 64
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Elements without an end tag.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open paragraph.
BLOCKS = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table ul".split())
#: For a start tag: the open elements it ends, and those beyond which it ends nothing.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "body": ({"head"}, set()),
}

TABLE = pa.struct([("headers", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string())))])
BLOCK = pa.struct([("type", pa.string()), ("level", pa.string()), ("text", pa.string()), ("items", pa.list_(pa.string())), ("headers", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string())))])
PAGE = [
    ("title", pa.string()), ("headings", pa.list_(pa.struct([("level", pa.string()), ("text", pa.string())]))), ("paragraphs", pa.list_(pa.string())),
    ("list_items", pa.list_(pa.string())), ("tables", pa.list_(TABLE)), ("blocks", pa.list_(BLOCK)), ("links", pa.list_(pa.string())),
]
PAGE_DDL = (
    "title string, headings array<struct<level:string,text:string>>, paragraphs array<string>, list_items array<string>, tables array<struct<headers:array<string>,rows:array<array<string>>>>, "
    "blocks array<struct<type:string,level:string,text:string,items:array<string>,headers:array<string>,rows:array<array<string>>>>, links array<string>"
)


class _Elements(HTMLParser):
    """Elements in document order: tag, classes, parent, first element and first text node behind its subtree."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tag, self.classes, self.parent, self.end, self.texts_from, self.texts_to = [], [], [], [], [], []
        self.open: list[int] = []
        self.texts: list[str] = []
        self.hrefs: list[str] = []

    def _close(self, depth: int) -> None:
        for i in self.open[depth:]:
            self.end[i], self.texts_to[i] = len(self.tag), len(self.texts)
        del self.open[depth:]

    def _end(self, tags: set[str], within: set[str]) -> None:
        """Ends the outermost open element of these tags, but none outside those of ``within``."""
        at = None
        for depth in range(len(self.open) - 1, -1, -1):
            tag = self.tag[self.open[depth]]
            if tag in tags:
                at = depth
            elif tag in within:
                break
        if at is not None:
            self._close(at)

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._end({"p"}, {"table", "td", "th", "button", "caption"})
        if tag in ENDS:
            self._end(*ENDS[tag])
        attributes = dict(reversed(attrs))  # the first of repeated ones counts
        i = len(self.tag)
        self.tag.append(tag)
        self.classes.append((attributes.get("class") or "").split())
        self.parent.append(self.open[-1] if self.open else -1)
        self.end.append(i + 1)
        self.texts_from.append(len(self.texts))
        self.texts_to.append(len(self.texts))
        if tag == "a" and attributes.get("href") is not None:
            self.hrefs.append(attributes["href"].strip())
        if tag not in VOID:
            self.open.append(i)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # "/" ends nothing in HTML but void elements

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            own = self.tag[self.open[depth]]
            if own == tag:
                return self._close(depth)
            if own == "table" and tag not in ("body", "html", "main", "article"):
                return None  # an end tag in a table closes nothing outside it
        return None

    def handle_data(self, data):
        if text := data.strip():
            self.texts.append(text)

    def close(self):
        super().close()
        self._close(0)


def _closed_references(html: str) -> str:
    """Every ampersand that begins no character reference ended by a semicolon, as a text of its own."""
    return re.sub(r"&(?!#[0-9]+;|#[xX][0-9a-fA-F]+;)([A-Za-z][A-Za-z0-9]*;)?", lambda m: m[0] if m[1] in html5 else "&amp;" + (m[1] or ""), html)


def parsed(html: str, url: str = "", noise_tags: list[str] = NOISE_TAGS, noise_classes: list[str] = NOISE_CLASSES, closed: bool = False) -> dict:
    """The page as a record of PAGE's fields. Links are taken before noise goes, absolute, each once, in order.
    ``closed``: character references count only with their semicolon; HTML itself reads ``&amp`` too."""
    e = _Elements()
    e.feed(_closed_references(html) if closed else html)
    e.close()
    n, noisy = len(e.tag), set(noise_classes)
    live, silent = [True] * n, [False] * len(e.texts)
    i = 0
    while i < n:
        if e.tag[i] in noise_tags or noisy.intersection(e.classes[i]):
            live[i : e.end[i]] = [False] * (e.end[i] - i)
            silent[e.texts_from[i] : e.texts_to[i]] = [True] * (e.texts_to[i] - e.texts_from[i])
            i = e.end[i]
        else:
            i += 1

    def text(i: int) -> str:
        return " ".join(re.sub(r"\s+", " ", t) for t, s in zip(e.texts[e.texts_from[i] : e.texts_to[i]], silent[e.texts_from[i] : e.texts_to[i]], strict=True) if not s).strip()

    def within(i: int, tags: tuple) -> list[int]:
        return [j for j in range(i + 1, e.end[i]) if live[j] and e.tag[j] in tags]

    def table(i: int) -> dict | None:
        rows = [[text(c) for c in within(r, ("td", "th"))] for r in within(i, ("tr",))]
        rows = [r for r in rows if r]
        return {"headers": rows[0], "rows": rows[1:]} if rows else None

    every = [j for j in range(n) if live[j]]
    headings = [{"level": e.tag[j], "text": t} for j in every if e.tag[j] in HEADINGS and (t := text(j))]
    out = {
        "title": next((text(j) for j in every if e.tag[j] == "title"), ""), "headings": headings,
        "paragraphs": [t for j in every if e.tag[j] == "p" and len(t := text(j)) > SHORT_PARAGRAPH], "list_items": [t for j in every if e.tag[j] == "li" and len(t := text(j)) > SHORT_ITEM],
        "tables": [t for j in every if e.tag[j] == "table" and (t := table(j))], "blocks": [],
    }
    root = next((j for tag in ("main", "article", "body") for j in every if e.tag[j] == tag), None)
    for j in every if root is None else within(root, (*HEADINGS, "p", "table", "ul", "ol")):
        tag, block = e.tag[j], None
        if tag in HEADINGS:
            block = (t := text(j)) and {"type": "heading", "level": tag, "text": t}
        elif tag == "p":
            block = len(t := text(j)) > SHORT_PARAGRAPH and {"type": "paragraph", "text": t}
        elif tag == "table":
            block = (t := table(j)) and {"type": "table", **t}
        elif tag in ("ul", "ol"):
            items = [t for k in within(j, ("li",)) if e.parent[k] == j and len(t := text(k)) > SHORT_ITEM]
            block = items and {"type": "list", "items": items}
        if block:
            out["blocks"].append(block)
    found = []
    for href in e.hrefs:
        try:
            found.append(urljoin(url, href))
        except ValueError:  # no URL, as of a broken host
            continue
    return out | {"links": list(dict.fromkeys(found))}


def parsed_batches(batches: Iterable[pa.RecordBatch], noise_tags: list[str], noise_classes: list[str], closed: bool) -> Iterator[pa.RecordBatch]:
    """The pages of batches (page_id, url, html), ``PIECE`` of them at a time: no more are held as Python objects."""
    for whole in batches:
        for at in range(0, whole.num_rows, PIECE):
            b = whole.slice(at, PIECE)
            rows = [parsed(h or "", u or "", noise_tags, noise_classes, closed) for h, u in zip(b.column("html").to_pylist(), b.column("url").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), *(pa.array([r[c] for r in rows], t) for c, t in PAGE)], names=["page_id", "url", *(c for c, _ in PAGE)])


def page_trees(pages: DataFrame, noise_tags: list[str] = NOISE_TAGS, noise_classes: list[str] = NOISE_CLASSES, closed: bool = False) -> DataFrame:
    """page_id, url and the fields of PAGE for each of pages(page_id, url, html); null html is an empty page."""

    def parse(batches):
        return parsed_batches(batches, noise_tags, noise_classes, closed)

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", "html").mapInArrow(parse, f"page_id {kind}, url string, {PAGE_DDL}")


def with_content(trees: DataFrame) -> DataFrame:
    """Pages with any heading, paragraph, list item or table."""
    return trees.where(F.greatest(*(F.size(c) for c in ("headings", "paragraphs", "list_items", "tables"))) > 0)


def page_links(trees: DataFrame, hosts: list[str] | None = None, prefix: str = "/") -> DataFrame:
    """page_id, url, link: each link once, in normal form, of the hosts in scope and of no file to skip."""
    from .pages import in_scope, normal_url, skipped

    rows = trees.select("page_id", "url", F.explode("links").alias("link")).where(F.col("link").rlike("^(?i)https?://"))
    rows = rows.withColumn("link", normal_url(F.col("link"))).where(~skipped(F.col("link")))
    return (rows.where(in_scope(F.col("link"), hosts, prefix)) if hosts else rows).distinct()


def ordered_blocks(trees: DataFrame) -> DataFrame:
    """page_id, ord and the block's fields, a row a block."""
    return trees.select("page_id", F.posexplode("blocks").alias("ord", "b")).select("page_id", "ord", "b.*")
