"""Main text of web pages, by removal of what a site repeats.

Every page is read once into blocks of text. Elements that may belong to a template carry a hash
of their whole subtree: names, classes, ids and text, in order. Spark counts on how many pages of a
host each hash stands, pages of one text counting once, and deletes the subtrees that recur on many.
What a page has of its own is then judged by its markup: menus, headers, footers, asides, forms,
scripts, styles and elements whose class, id or role names such a part are no text, and where a page
marks its article (or its main part), only that is returned. Paragraphs of a marked article are
never deleted for recurring, since articles share passages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changegrid.plans.joins import salted_join
from changegrid.plans.lineage import cut

MIN_PAGES, MIN_SHARE = 10, 0.01
_FLUSH_CHARS = 4 << 20

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"  # comment
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>"  # a quote that never closes
    r"|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z",  # declarations, and a tag that the page's end cuts off
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
HOST = re.compile(r"\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]+)")
NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp"}
VOID = set("area base br col embed hr img input link meta source track wbr".split())
NO_TEXT = RAW | set("head template noscript object svg canvas video audio map nav footer aside form button select dialog menu".split())
PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figcaption caption summary address".split())
BLOCKS = PROSE | NO_TEXT | set("html body article main header section div ul ol dl table thead tbody tfoot tr figure details fieldset center hgroup search".split())
CLOSES_P = BLOCKS - RAW - set("button select map object svg canvas video audio noscript template li dt dd td th tr thead tbody tfoot caption html body head".split()) | {"hr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CELLS = {"td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tbody": {"td", "th", "tr", "thead", "tbody"}, "tfoot": {"td", "th", "tr", "thead", "tbody"}}
HOLDERS = {"ul", "ol", "dl", "table", "html", "body", "article"}
# Words in a class or id, and roles, that name a part that is no article text.
PART_WORDS = set(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice newsletter subscribe subscription "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus replies share sharing social related popup modal masthead pagination".split()
)
PART_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)} if text.strip() else {}


class Element:
    """An open element: what it adds to text, its place, and what its subtree hash is made of."""

    __slots__ = ("name", "dropped", "heads_only", "level", "watched", "parts", "hash", "seen")

    def __init__(self, name: str, parent: Element | None, attrs: dict[str, str]):
        classes = f"{attrs.get('class', '')} {attrs.get('id', '')}"
        words = {w.lower() for w in NAME_PART.findall(classes)}
        role = attrs.get("role", "").lower()
        hidden = "hidden" in attrs or "display:none" in attrs.get("style", "").replace(" ", "").lower()
        whole = name in ("html", "body", "main") or (name == "article" and not words & {"comment", "comments", "reply", "replies"})
        inside = parent.level if parent else 0
        named = bool(words & PART_WORDS) or role in PART_ROLES
        top = name == "header" or "header" in words
        self.name = name
        self.dropped = (parent is not None and parent.dropped) or name in NO_TEXT or hidden or (not whole and (named or (top and not inside and name not in HEADINGS)))
        self.heads_only = (parent is not None and parent.heads_only) or (not whole and top and inside > 0)
        self.level = 2 if name == "article" else max(inside, int(name == "main" or role == "main"))
        # Roots of dropped parts are counted too: a template shows there first.
        outer = parent is None or not parent.dropped
        self.watched = outer and not whole and role != "main" and (self.dropped or not (self.level and name in PROSE))
        self.parts, self.hash, self.seen = [f"{name}\x00{classes.strip()}\x00{role}"], 0, False


def read_page(html: str) -> tuple[list[tuple[str, int, list[Element]]], list[Element]]:
    """([(text, level, elements around it)], watched elements) of a page, in page order.

    Levels: 2 in an article, 1 in a main part, 0 elsewhere. Elements get their subtree hashes when
    they close, at the page's end at the latest. Unclosed and wrongly nested markup is read as
    browsers do: blocks close paragraphs, an end tag closes what is open inside its element.
    """
    stack: list[Element] = []
    blocks: list[tuple[str, int, list[Element]]] = []
    watched: list[Element] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if not text:
            return
        if stack:
            stack[-1].parts.append(text)
            top = stack[-1]
            if not top.dropped and (not top.heads_only or any(e.name in HEADINGS for e in stack)):
                blocks.append((text, top.level, [e for e in stack if e.watched]))
        else:
            blocks.append((text, 0, []))

    def close(count: int) -> None:
        flush()
        for _ in range(count):
            e = stack.pop()
            digest = blake2b("\x01".join(e.parts).encode("utf-8", "replace"), digest_size=8).digest()
            e.hash, e.parts = int.from_bytes(digest, "little", signed=True), []
            if stack:
                stack[-1].parts.append(digest.hex())

    def close_to(names: set[str], stop: set[str]) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].name in names:
                close(len(stack) - k)
                return
            if stack[k].name in stop:
                return

    def push(name: str, attrs: dict[str, str]) -> None:
        flush()
        e = Element(name, stack[-1] if stack else None, attrs)
        stack.append(e)
        if e.watched:
            watched.append(e)

    at = 0
    while (m := TOKEN.search(html, at)) is not None:
        if m.start() > at:
            held.append(unescape(html[at : m.start()]))
        at = m.end()
        name = m["name"] or m["name2"]
        if name is None:
            continue
        name = name.lower()
        if m["end"] or m["end2"]:
            barrier = {"td", "th", "caption"} if name not in ("td", "th", "tr", "tbody", "thead", "tfoot", "table", "caption", "body", "html") else set()
            if name in BLOCKS or any(e.name == name for e in stack[-8:]):
                close_to({name}, barrier - {name})
            continue
        if name == "br":
            held.append("\n")
            continue
        if name in CLOSES_P:
            close_to({"p"}, HOLDERS | CELLS["td"] | {"button"})
        if name in CELLS:
            close_to(CELLS[name] & {"tr", "tbody", "thead", "li", "dt", "dd", "td", "th"}, HOLDERS)
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name in RAW:
            push(name, {})
            stop = re.compile(f"</{name}(?=[\\s/>])", re.I).search(html, at)
            until = stop.start() if stop else len(html)
            stack[-1].parts.append(html[at:until])
            close(1)
            at = until
            continue
        attrs = _attributes(m["attrs"] or m["attrs2"] or "")
        if name in BLOCKS:
            if not (name in ("html", "body") and any(e.name == name for e in stack)):
                push(name, attrs)
        elif attrs or any(e.name == name for e in stack[-1:]):
            # Inline markup is transparent, unless it names a part of its own.
            e = Element(name, stack[-1] if stack else None, attrs)
            if (e.dropped and not (stack and stack[-1].dropped)) or (stack and stack[-1].name == name):
                push(name, attrs)
    held.append(unescape(html[at:]))
    close(len(stack))
    return blocks, watched


def host_of(url: str | None) -> str | None:
    m = HOST.match(url or "")
    return m[1].lower() if m else None


def read_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, page, blocks, subtrees), a row per page: blocks of the article, or of the
    main part, or of all; `page` hashes their text and `subtrees` lists hashes of watched elements."""
    key = pages.schema["page_id"].dataType
    schema = f"page_id {key.simpleString()}, url string, host string, page long, blocks array<struct<text:string,around:array<long>>>, subtrees array<long>"
    kinds = pa.list_(pa.struct([("text", pa.string()), ("around", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size, first = [], 0, 0

            def flush(last: int) -> pa.RecordBatch:
                hosts, ids, blocks, subtrees = (list(c) for c in zip(*out))
                part = batch.slice(first, last - first)
                return pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(hosts, pa.string()), pa.array(ids, pa.int64()), pa.array(blocks, kinds), pa.array(subtrees, pa.list_(pa.int64()))],
                    ["page_id", "url", "host", "page", "blocks", "subtrees"],
                )

            for i in range(batch.num_rows):
                html = batch.column("html")[i].as_py() or ""
                blocks, watched = read_page(html)
                best = max((level for _, level, _ in blocks), default=0)
                kept = [(text, [e.hash for e in around]) for text, level, around in blocks if level == best]
                digest = blake2b("\n".join(t for t, _ in kept).encode("utf-8", "replace"), digest_size=8).digest()
                out.append((host_of(batch.column("url")[i].as_py()), int.from_bytes(digest, "little", signed=True), [{"text": t, "around": a} for t, a in kept], list({e.hash for e in watched})))
                size += len(html)
                if size >= _FLUSH_CHARS:
                    yield flush(i + 1)
                    out, size, first = [], 0, i + 1
            if out:
                yield flush(batch.num_rows)

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)


def template_subtrees(read: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, template): per host the hashes of subtrees on at least `min_pages` of its pages and
    `min_share` of them, so that a list has at most 1 / min_share times the elements of a page.

    Pages of one text count once, so a copied article is no template. Where no mark and no name
    tells an article from the rest, one that recurs beside differing texts goes with the template.
    """
    known = read.where("host is not null")
    n_pages = known.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= min_pages)
    each = known.select("host", "page", F.explode("subtrees").alias("subtree")).distinct()
    often = each.groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    many = often.join(n_pages, "host").where(F.col("n") >= min_share * F.col("n_pages"))
    return many.groupBy("host").agg(F.collect_list("subtree").alias("template"))


def main_text(pages: DataFrame, **limits) -> DataFrame:
    """(page_id, url, text, n_chars, n_template), one row per input row.

    `text` joins blocks by two line feeds, white space inside a block being one space; it is empty
    for a null or empty html and where nothing is left. n_template counts the page's subtrees that
    recur on its host. Pages without a host in their url are read, but not counted together. Null
    and repeated page_ids and repeated rows stay; pages of any length are read whole; an empty
    table gives no rows; other columns are not read.
    """
    read = cut(read_pages(pages))
    template = cut(template_subtrees(read, **limits))
    both = salted_join(read, template, ["host"], ["page_id"], "left")
    hit = F.coalesce(F.array_intersect("subtrees", "template"), F.array().cast("array<long>"))
    both = both.withColumn("hit", hit)
    left = F.filter("blocks", lambda b: ~F.arrays_overlap(b["around"], "hit"))
    text = F.array_join(F.transform(left, lambda b: b["text"]), "\n\n")
    return both.select("page_id", "url", text.alias("text"), F.size("hit").alias("n_template")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_template")
