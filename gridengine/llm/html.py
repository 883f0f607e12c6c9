"""Main text of web pages, with site templates removed.

Every page is parsed to a tree; the subtrees of its elements are hashed, and Spark counts in how many different
articles of a host each hash occurs. Subtrees that recur in many are the site's template and are deleted, besides the
elements that say by tag, role or name that they are menus, adverts, forms or comments. Within the article a recurring
paragraph is text, not template, and copies of an article count as one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import mapped, session, stored

#: Different articles of a host in which a subtree of its template stands at least.
MANY = 8
#: Most template hashes that are broadcast (8 bytes each); more are joined to the pages.
MAX_BROADCAST = 1 << 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that by the standard are no part of an article's text.
DROPPED = frozenset("head script style noscript template iframe object svg canvas audio video nav aside footer form select option textarea input dialog menu search".split())
#: Roles by the standard that say the same.
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Whole names, of a class or id, by which an element other than prose says so.
LABELS = frozenset(
    "ad ads advert adverts advertisement advertising sponsored promo banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar cookie cookies cookie-notice consent notice notices popup modal newsletter subscribe signup share sharing social comment comments commentlist respond pagination pager site-header site-footer site-nav left-sidebar right-sidebar".split()
)
#: Text of an article: a repeated one is no template.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote b i em strong a span code sub sup br td th tr dd dt li".split())
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>""", re.S
)
_ATTR = re.compile(r"""(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("article main section div table ul ol dl body td th nav aside footer header form".split())


class Node:
    __slots__ = ("tag", "label", "children", "hash", "inner", "heads")

    def __init__(self, tag: str, label: str = ""):
        self.tag, self.label, self.children, self.heads = tag, label, [], False


def parse(html: str) -> Node:
    """The tree of a page; end tags that are missing are implied, those without a start are ignored."""
    root = Node("html")
    stack = [root]
    at, n = 0, len(html)
    while True:
        m = _TAG.search(html, at)
        stop = m.start() if m else n
        if stop > at:
            stack[-1].children.append(html[at:stop])
        if not m:
            return root
        at = m.end()
        closing, tag, rest = m[1] or m[4], m[2] or m[5], m[3] or m[6] or ""
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag not in _SCOPE and stack[k].tag in _SCOPE:
                    break
            continue
        if tag in ("html", "body"):
            continue
        own = _CLOSES.get(tag, ())
        if own or tag in BLOCKS:
            for k in range(len(stack) - 1, 0, -1):
                t = stack[k].tag
                if t in own or (t == "p" and tag in BLOCKS):
                    del stack[k:]
                    break
                if t in _SCOPE:
                    break
        label = " ".join(f"{a.lower()}={v}" for a, b, c, d in _ATTR.findall(rest) for v in (b or c or d).split()) if rest else ""
        node = Node(tag, label)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            close = html.find(">", end.end()) if end else -1
            at = close + 1 if close >= 0 else n
        elif tag not in VOID and not rest.endswith("/"):
            stack.append(node)


def labelled(node: Node) -> bool:
    """Whether an element says that it isn't the article's text, by its tag, its role or a whole name. A name never tells of prose, nor of an element around a
    main element or a first heading, which is layout."""
    if node.tag in DROPPED:
        return True
    if not node.label or node.heads or node.tag in PROSE:
        return False
    for part in node.label.lower().split("itemprop=")[0].split():
        name, _, value = part.rpartition("=")
        if value in (ROLES if name == "role" else LABELS):
            return True
    return False


def _length(node: Node) -> int:
    """Code points of the text within, without what says that it is none."""
    out, stack = 0, [node]
    while stack:
        x = stack.pop()
        for c in x.children:
            if isinstance(c, str):
                out += len(c.strip())
            elif not labelled(c):
                stack.append(c)
    return out


def ordered(root: Node) -> list[Node]:
    """All elements, parents before children."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        out.append(x)
        stack += [c for c in reversed(x.children) if isinstance(c, Node)]
    return out


def content_roots(root: Node) -> list[Node]:
    """The outermost articles that aren't comments or adverts, unless a main element holds over twice their text (they are teasers then); else
    main elements; else the whole page."""
    by_tag: dict[str, list[Node]] = {}
    for tag in ("article", "main"):
        found, stack = [], [root]
        while stack:
            x = stack.pop()
            if x.tag == tag or (tag == "main" and "role=main" in x.label):
                found.append(x)
                continue
            stack += [c for c in reversed(x.children) if isinstance(c, Node) and not labelled(c)]
        by_tag[tag] = found
    articles, mains = by_tag["article"], by_tag["main"]
    if articles and not (mains and sum(map(_length, mains)) > 2 * sum(map(_length, articles))):
        return articles
    return mains or [root]


def hashed(root: Node) -> None:
    """Sets each element's hash (tag, label, texts, children) and whether it is inside a content root."""
    for x in reversed(ordered(root)):
        x.heads = x.tag not in DROPPED and any(isinstance(c, Node) and (c.tag in ("main", "h1") or c.heads) for c in x.children)
        parts = [f"{x.tag} {x.label}"]
        for c in x.children:
            if isinstance(c, Node):
                parts.append(f"<{c.hash:x}>")
            elif c := " ".join(c.split()):
                parts.append(c)
        x.hash = xxh64_intdigest("\n".join(parts), 11)
        x.inner = False
    for r in content_roots(root):
        if r is not root:
            for x in ordered(r):
                x.inner = True


def candidates(root: Node) -> tuple[list[int], int]:
    """Hashes of the subtrees that could be template, and the hash of the article."""
    roots = content_roots(root)
    article = xxh64_intdigest(repr([r.hash for r in roots]), 11)
    out = {x.hash for x in ordered(root) if x is not root and x.children and not (x.inner and (x.tag in PROSE or x in roots)) and not labelled(x)}
    return sorted(out), article


def main_text(root: Node, template) -> str:
    """Blocks in page order, white space made one space. ``template``: whether a hash is of the site's template."""
    blocks: list[str] = []
    here: list[str] = []

    def end() -> None:
        if t := " ".join(unescape("".join(here)).split()):
            blocks.append(t)
        here.clear()

    roots = content_roots(root)
    for r in roots:
        stack: list = [r]
        while stack:
            x = stack.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                here.append(x)
            elif x.tag == "br" or x.tag == "wbr":
                here.append(" " if x.tag == "br" else "")
            elif x not in roots and (labelled(x) or (not (x.inner and x.tag in PROSE) and template(x.hash))):
                if x.tag in BLOCKS:
                    end()
            elif x.tag == "header" and x not in roots:  # of it only an article's own headings are text
                end()
                if x.inner:
                    stack += [h for h in reversed(ordered(x)) if re.fullmatch("h[1-6]", h.tag)]
            else:
                if x.tag in BLOCKS:
                    end()
                    stack.append(None)
                stack += reversed(x.children)
        end()
    return " ".join(blocks)


def _mixed(host: str | None, h: int) -> int:
    return xxh64_intdigest(f"{host or ''}\n{h:x}", 5)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _host(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def page_subtrees(pages: DataFrame) -> DataFrame:
    """(key, subtree, article): a row per page and different subtree; ``subtree`` hashes host and content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, subtrees, articles = [], [], []
            for key, url, html in zip(*(b.column(c).to_pylist() for c in ("key", "url", "html"))):
                root, host = parse(html or ""), _host(url)
                hashed(root)
                found, article = candidates(root)
                keys += [key] * len(found)
                subtrees += [_signed(_mixed(host, h)) for h in found]
                articles += [_signed(article)] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, subtrees, articles)], ["key", "subtree", "article"])

    return mapped(pages.select("key", "url", "html"), run, "key long, subtree long, article long")


def extracted(pages: DataFrame, many: int = MANY, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    Null or empty html gives an empty text. Pages without a host (null or odd urls) form a site of their own. Rows that repeat
    each give a row. Deep or broken markup is parsed as far as it goes. Other columns are not read.
    """
    rows = pages.select(pages["page_id"], pages["url"], pages["html"]).withColumn("key", F.xxhash64("page_id", "url", "html"))
    found = stored(page_subtrees(rows), "html-subtrees")
    # Copies of an article count once: first one row per subtree and article, pre-aggregated before the shuffle.
    once = found.select("subtree", "article").distinct()
    template = stored(once.groupBy("subtree").agg(F.count("*").alias("n")).where(F.col("n") >= many).select("subtree"), "html-template")
    if template.count() <= max_broadcast:
        known = np.sort(template.toArrow().column("subtree").to_numpy())
        given = session(pages.sparkSession).sparkContext.broadcast(known)
        own = rows.select("page_id", "url", "html")
    else:
        marked = found.join(template, "subtree", "left_semi").groupBy("key").agg(F.collect_set("subtree").alias("own"))  # a page's own
        given = None
        own = rows.join(marked, "key", "left").select("page_id", "url", "html", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = set(given.value.tolist()) if given else None
        for b in batches:
            out, owns = [], b.column("own").to_pylist() if known is None else [known] * b.num_rows
            for url, html, mine in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), owns):
                root, host = parse(html or ""), _host(url)
                hashed(root)
                mine = mine or ()
                out.append(main_text(root, lambda h: _signed(_mixed(host, h)) in mine))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return mapped(own, run, "page_id long, url string, text string, n_chars long")


def op5_site_templates(spark, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
