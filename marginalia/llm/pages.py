"""Main text of web pages by site style trees.

The DOMs of a host are merged into one style tree. Its element nodes are the paths of styled elements (tag
and class) from the root; below an element node hang its style nodes, the unlike sequences of block
elements that its pages show there. Two importances are measured over the unlike pages of the host:

- presentation, of an element node: the entropy of its style nodes, in parts of the greatest possible, and
  whole from STYLES_WHOLE equally likely ones on. Where every page is built alike, it is 0.
- content, of what a block shows: its information, log(pages / pages that show the same there), in parts
  of log(pages), and whole from half of that on. Its mean over the pages is the block node's entropy.

A block's importance is the product of the greatest presentation importance around it and its content
importance. Blocks below SHARE of the page's best one are of low importance, and a branch that holds no
other blocks is taken out, inside articles as anywhere. A measure relative to the page keeps repeated
articles whole. What says something of its own on every page is not cancelled by how it is presented: a block
of whole content importance stays inside an article or main element, and elsewhere from RICH characters on.
Blocks of links alone outside of articles are menus however they vary: they go where the page shows other
blocks, and are no measure for these. Hosts of fewer than LEAST_PAGES unlike pages are merged by template, the sequence of
elements in the body, over all such hosts. Elements that are no content by their own meaning (scripts,
forms, <nav>, <footer>, hidden ones, reader comments) always go. Words of class names decide only where
the template has too few pages as well.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import checkpoint

#: Unlike pages that a tree needs to judge; share of the best importance below which a block is low; least
#: presentation importance (it only decides where no element varies); equally likely styles that count whole.
LEAST_PAGES, SHARE, FLOOR, STYLES_WHOLE = 8, 0.15, 0.01, 16
#: Characters of a block that no presentation cancels if no other page shows it.
RICH = 200
#: Values that are broadcast at most (20 bytes each); beyond, parsed pages are joined with those of their tree.
VALUES_BROADCAST = 1_000_000
#: Hosts of their own tree that are broadcast at most (8 bytes each).
HOSTS_BROADCAST = 1_000_000
SALTS = 16
PAGE, STYLE, PLACE, BLOCK = range(4)
#: Key of the row that marks a tree of enough pages.
TREE = -1

# Names of elements.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
GONE = RAW | {"head", "nav", "footer", "aside", "form", "svg", "button", "select", "option", "object", "canvas", "dialog", "menu", "datalist", "map", "audio", "video", "math"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul", "li", "dd", "dt"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tbody", "tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
MAIN = {"article", "main"}
ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "status"}
# Class names and ids of reader comments, which differ from page to page as articles do.
COMMENTS = {"comment", "comments", "commentlist", "disqus", "disqus_thread", "respond", "replies"}
# Words of class names and ids, for pages that no tree can judge.
WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "adbox", "banner", "breadcrumb", "breadcrumbs", "consent", "cookie", "cookies", "dialog",
    "footer", "gdpr", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "overlay", "pagination", "pager", "popup",
    "promo", "promotion", "related", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toc", "toolbar",
    "widget", "widgets", "alert", "header",
}
NAME = re.compile(r"[^\s/>]*")
PLAIN = re.compile(r"[^>\"']*")
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
TELLING = re.compile(r"class|id|role|hidden|style", re.I)
PART = re.compile(r"[a-z]+", re.A)


def _hash(text: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), seed)


class Page:
    """A parsed page. Node k: key (path), parent, style (its block elements in order, 0 for none); block k: text, node,
    key (text at that path), gone (by its elements), doubt (by class words), whether it is inside an article and whether
    all of it is links."""

    def __init__(self) -> None:
        self.keys, self.parents, self.styles = [0], [0], [0]
        self.texts: list[str] = []
        self.at: list[int] = []
        self.shown: list[int] = []
        self.gone: list[bool] = []
        self.doubt: list[bool] = []
        self.inside: list[bool] = []
        self.linked: list[bool] = []
        self.template = 0


class Open:
    __slots__ = ("article", "doubt", "gone", "node", "tag")

    def __init__(self, tag: str, node: int, gone: bool, doubt: bool, article: bool):
        self.tag, self.node, self.gone, self.doubt, self.article = tag, node, gone, doubt, article


def _style(tag: str, raw: str, article: bool) -> tuple[str, bool, bool]:
    """(name of the styled element, no content by its element, role or visibility, no content by its class words)."""
    gone = tag in GONE or (tag == "header" and not article)
    if not raw or not TELLING.search(raw):
        return tag, gone, False
    own = {k.lower(): entities.unescape(a or b or c or "") for k, a, b, c in ATTR.findall(raw)}
    names = sorted(own.get("class", "").lower().split())
    ids = own.get("id", "").lower()
    gone |= own.get("role", "").lower() in ROLES or "hidden" in own or own.get("aria-hidden", "").lower() == "true"
    gone |= "display:none" in own.get("style", "").lower().replace(" ", "")
    doubt = False
    if tag not in ("html", "body"):
        gone |= ids in COMMENTS or not COMMENTS.isdisjoint(names)
        words = set(PART.findall(" ".join([*names, ids])))
        doubt = not words.isdisjoint(WORDS - {"header"} if article or tag in MAIN else WORDS)
    return f"{tag}.{' '.join(names)}" if names else tag, gone, doubt


def _tag_end(source: str, at: int, lost: set[str]) -> int:
    """Place of the '>' that ends a tag, -1 if there is none. Quotes behind an equals sign hide it; ``lost`` has the
    quotes that are not closed any more, so that no text is searched twice."""
    while True:
        at = PLAIN.match(source, at).end()
        if at == len(source):
            return -1
        sign = source[at]
        if sign == ">":
            return at
        back = at - 1
        while source[back].isspace():
            back -= 1
        close = source.find(sign, at + 1) if source[back] == "=" and sign not in lost else at
        if close < 0:
            lost.add(sign)
        at = max(at, close) + 1


def parse(source: str | None) -> Page:
    """The blocks and element nodes of a page, in one pass over the source; time is in proportion to its length."""
    page = Page()
    source = source or ""
    if not source:
        return page
    inside: list[str] = []  # text of the block at hand
    stack = [Open("", 0, False, False, False)]
    counts: Counter[str] = Counter()
    lost: set[str] = set()
    ends: dict[str, re.Pattern] = {}
    block_node, block_gone, block_doubt, block_inside, block_plain = 0, False, False, False, False
    body = 0

    def flush() -> None:
        nonlocal block_plain
        if inside:
            if text := " ".join("".join(inside).split()):
                page.texts.append(text)
                page.at.append(block_node)
                page.shown.append(_hash(text, page.keys[block_node] ^ 1))
                page.gone.append(block_gone)
                page.doubt.append(block_doubt)
                page.inside.append(block_inside)
                page.linked.append(not block_plain)
            inside.clear()
        block_plain = False

    def put(text: str, plain: bool = False) -> None:
        nonlocal block_node, block_gone, block_doubt, block_inside, block_plain
        if not text:
            return
        top = stack[-1]
        if inside and (top.gone != block_gone or top.doubt != block_doubt):
            flush()  # a hidden inline element is no part of the block around it
        block_node, block_gone, block_doubt, block_inside = top.node, top.gone, top.doubt, top.article
        block_plain = block_plain or not counts["a"] and not text.isspace()
        inside.append(text if plain or "&" not in text else entities.unescape(text))

    def close() -> None:
        node = stack.pop()
        counts[node.tag] -= 1
        if node.tag not in INLINE:
            flush()

    at, size = 0, len(source)
    while at < size:
        start = source.find("<", at)
        if start < 0:
            put(source[at:])
            break
        put(source[at:start])
        head = source[start + 1 : start + 3]
        if head[:1] in ("!", "?") or (head[:1] == "/" and not (head[1:].isalpha() and head[1:].isascii())):
            if source.startswith("<!--", start):
                end = source.find("-->", start + 2)
                at = size if end < 0 else end + 3
                continue
            if source.startswith("<![CDATA[", start) and "]]>" not in lost:
                end = source.find("]]>", start)
                if end >= 0:
                    put(source[start + 9 : end], plain=True)
                    at = end + 3
                    continue
                lost.add("]]>")
            end = source.find(">", start)
            at = size if end < 0 else end + 1
            continue
        ending = head[:1] == "/"
        first = head[1:] if ending else head[:1]
        if not (first.isalpha() and first.isascii()):
            put("<", plain=True)
            at = start + 1
            continue
        name = NAME.match(source, start + 1 + ending)
        end = _tag_end(source, name.end(), lost)
        if end < 0:
            break  # a tag that was cut off is no text
        raw, at = source[name.end() : end], end + 1
        tag = name.group().lower()
        if ending:
            if tag == "br":
                put(" ", plain=True)
            elif counts[tag]:
                while stack[-1].tag != tag:
                    close()
                close()
            elif tag == "p":
                flush()
            continue
        if tag in VOID:
            if tag == "br":
                put(" ", plain=True)
            elif tag not in INLINE:
                flush()
            continue
        if tag in ENDS_P and counts["p"]:
            while stack[-1].tag != "p":
                close()
            close()
        if tag in SIBLINGS:
            while stack[-1].tag in SIBLINGS[tag]:
                close()
        parent = stack[-1]
        styled, gone, doubt = _style(tag, raw, parent.article)
        node = parent.node
        if tag not in INLINE:
            flush()
            page.styles[node] = _hash(styled, page.styles[node])
            page.keys.append(_hash(styled, page.keys[node]))
            page.parents.append(node)
            page.styles.append(0)
            node = len(page.keys) - 1
            if tag == "body" and not body:
                body = node
        stack.append(Open(tag, node, gone or parent.gone, doubt or parent.doubt, parent.article or tag in MAIN))
        counts[tag] += 1
        if tag in RAW and not raw.rstrip().endswith("/"):
            if tag not in ends:
                ends[tag] = re.compile(rf"</{re.escape(tag)}\s*>", re.I)
            found = ends[tag].search(source, at)
            at = found.end() if found else size
            close()
    flush()
    page.template = page.styles[body]
    return page


def rows_of(page: Page) -> set[tuple[int, int, int]]:
    """(kind, node, what it shows) of a page, each once: the page itself, styles, places of blocks, and blocks."""
    out = {(STYLE, k, s) for k, s in zip(page.keys, page.styles, strict=True) if s}
    out |= {(PLACE, page.keys[n], 0) for n in page.at}
    out |= {(BLOCK, page.keys[n], s) for n, s in zip(page.at, page.shown, strict=True)}
    out.add((PAGE, 0, 0))
    return out


Values = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def judge(page: Page, values: Values | None, words: bool = True) -> list[str]:
    """Texts of the blocks that stay. ``values``: of keys, (whether each has a value, the values) in the page's tree;
    None where no tree can judge the page and class words may."""
    shown = np.array(page.shown, np.uint64)
    keep = ~np.array(page.gone, bool)
    if not keep.any():
        return []
    if values is None:
        keep &= ~(np.array(page.doubt, bool) & words)
    else:
        there, of = values(np.array(page.keys, np.uint64))
        around = np.where(there, of, 0.0)
        for k, up in enumerate(page.parents):  # parents come first
            around[k] = max(around[k], around[up])
        there, of = values(shown)
        content = np.where(there, of, 1.0)
        menu = np.array(page.linked, bool) & ~np.array(page.inside, bool)
        if (keep & ~menu).any():
            keep &= ~menu
        importance = np.maximum(around[np.array(page.at)], FLOOR) * content
        own = (content >= 1.0) & (np.array(page.inside, bool) | np.array([len(t) >= RICH for t in page.texts]))
        keep &= own | (importance >= SHARE * importance[keep].max())
    return [t for t, k in zip(page.texts, keep, strict=True) if k]


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[A-Za-z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _sites(host: str, template: int) -> tuple[int, int]:
    """Keys of the trees of a host and of a template."""
    return _long(_hash(host, 7)), _long(_hash(str(template), 8))


def importances(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(site, key, value): of the trees that can judge, presentation importances that are not 0 (key: element node) and
    content importances below 1 (key: what a block shows), and a row of key TREE for each such tree. pages: (url, html).

    Pages of a host (of a template, for small hosts) that show the same text count once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for url, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                page = parse(source.as_py())
                sites, text = _sites(host_of(url), page.template), _long(_hash("\n".join(page.texts)))
                out += [(*sites, text, kind, _long(node), _long(shown)) for kind, node, shown in rows_of(page)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["host", "template", "page", "kind", "node", "shown"])

    rows = checkpoint(pages.select("url", "html").mapInArrow(run, "host long, template long, page long, kind long, node long, shown long"))
    large = rows.where(F.col("kind") == PAGE).select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    large = large.where(F.col("n") >= least_pages).select("host", F.lit(True).alias("large"))
    large = checkpoint(large)
    if large.count() <= HOSTS_BROADCAST:
        placed = rows.join(F.broadcast(large), "host", "left")
    else:  # hot hosts over SALTS parts
        large = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        placed = rows.withColumn("salt", F.pmod("shown", F.lit(SALTS)).cast("int")).join(large, ["host", "salt"], "left")
    placed = placed.withColumn("site", F.when(F.col("large"), F.col("host")).otherwise(F.col("template")))
    what = ["site", "kind", "node", "shown"]
    counts = checkpoint(placed.select(*what, "page").distinct().groupBy(*what).agg(F.count(F.lit(1)).alias("n")).where((F.col("kind") != BLOCK) | (F.col("n") > least_pages**0.5)))
    trees = counts.where((F.col("kind") == PAGE) & (F.col("n") >= least_pages)).select("site", F.lit(TREE).cast("long").alias("key"), F.lit(1.0).alias("value"))
    total = F.sum("n")
    entropy = F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total
    styles = counts.where(F.col("kind") == STYLE).groupBy("site", "node").agg(total.alias("m"), entropy.alias("bits")).where(F.col("m") >= least_pages)
    styles = styles.select("site", F.col("node").alias("key"), F.least(F.lit(1.0), F.col("bits") / F.log2(F.least("m", F.lit(STYLES_WHOLE)))).alias("value")).where(F.col("value") > FLOOR)
    places = counts.where((F.col("kind") == PLACE) & (F.col("n") >= least_pages)).select("site", "node", F.col("n").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    blocks = counts.where(F.col("kind") == BLOCK).withColumn("salt", F.pmod("shown", F.lit(SALTS)).cast("int")).join(places, ["site", "node", "salt"])
    blocks = blocks.select("site", F.col("shown").alias("key"), F.least(F.lit(1.0), 2 * F.log2(F.col("m") / F.col("n")) / F.log2("m")).alias("value")).where("value < 1")
    return trees.union(styles).union(blocks)


def _mix(sites: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """One key for a tree and a key in it."""
    x = keys ^ sites
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def _found(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(asked), bool), np.zeros(len(asked))
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return keys[at] == asked, values[at].astype(np.float64)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_pages: int = LEAST_PAGES, words: bool = True) -> DataFrame:
    """(page_id, url, text) of every page: the blocks of its main text, joined by two line feeds.

    Null or empty html gives an empty text, a null or odd url counts as the host "". Repeated pages
    stay repeated and all get the same text, a null page_id stays null, other columns (whatever their
    names) are not read; an empty table gives none. Pages of any length are read whole, in time in proportion
    to it; blocks that tie in importance stay or go together. ``least_pages`` above all counts switches the
    trees off, ``words`` the class words for pages beyond the trees.
    """
    base = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    values = checkpoint(importances(base, least_pages))
    if values.count() <= VALUES_BROADCAST:
        return _by_broadcast(base, values, words)
    return _by_join(base, values, words)


def _by_broadcast(base: DataFrame, values: DataFrame, words: bool) -> DataFrame:
    got = values.toArrow()
    mixed = _mix(got.column("site").to_numpy().view(np.uint64), got.column("key").to_numpy().view(np.uint64))
    order = np.argsort(mixed, kind="stable")
    shared = base.sparkSession.sparkContext.broadcast((mixed[order], got.column("value").to_numpy()[order].astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, of = shared.value
        for batch in batches:
            out = []
            for link, source in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                page = parse(source.as_py())
                sites = np.array(_sites(host_of(link), page.template), np.int64).view(np.uint64)
                trees = sites[_found(keys, of, _mix(sites, np.array([TREE, TREE]).view(np.uint64)))[0]]
                out.append("\n\n".join(judge(page, (lambda asked, s=trees[0]: _found(keys, of, _mix(s, asked))) if len(trees) else None, words)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    return base.mapInArrow(run, "page_id long, url string, text string")


def _by_join(base: DataFrame, values: DataFrame, words: bool) -> DataFrame:
    """Parsed pages meet the values of their tree; hot trees are dealt over SALTS parts. A tree's values grow with the root
    of its pages: only what over root(pages) of them show has one."""

    def parsing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "host", "template", "texts", "gone", "doubt", "inside", "linked", "at", "shown", "keys", "parents"]
        kinds = [pa.int64()] * 2 + [pa.list_(t) for t in (pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int32())]
        for batch in batches:
            out = []
            for link, source in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                p = parse(source.as_py())
                out.append((*_sites(host_of(link), p.template), p.texts, p.gone, p.doubt, p.inside, p.linked, p.at, [_long(x) for x in p.shown], [_long(x) for x in p.keys], p.parents))
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names)

    parsed = base.mapInArrow(parsing, "page_id long, url string, host long, template long, texts array<string>, gone array<boolean>, doubt array<boolean>, inside array<boolean>, linked array<boolean>, at array<int>, shown array<long>, keys array<long>, parents array<int>")
    trees = values.groupBy("site").agg(F.sort_array(F.collect_list(F.struct("key", "value"))).alias("known"))
    trees = trees.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = parsed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    side = lambda c: trees.select(F.col("site").alias(c), "salt", F.col("known.key").alias(f"{c}_keys"), F.col("known.value").alias(f"{c}_values"))
    met = dealt.join(side("host"), ["host", "salt"], "left").join(side("template"), ["template", "salt"], "left")
    met = met.select("page_id", "url", "texts", "gone", "doubt", "inside", "linked", "at", "shown", "keys", "parents", F.coalesce("host_keys", "template_keys").alias("known"), F.when(F.col("host_keys").isNotNull(), F.col("host_values")).otherwise(F.col("template_values")).alias("of"))

    def judging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                page = Page()
                page.texts, page.gone, page.doubt, page.inside, page.linked, page.at, page.parents = (row[c] for c in ("texts", "gone", "doubt", "inside", "linked", "at", "parents"))
                page.shown, page.keys = ([x % (1 << 64) for x in row[c]] for c in ("shown", "keys"))
                known = None
                if row["known"] is not None:
                    keys = np.array(row["known"], np.int64).view(np.uint64)
                    order = np.argsort(keys)
                    known = lambda asked, k=keys[order], v=np.array(row["of"])[order]: _found(k, v, asked)
                out.append("\n\n".join(judge(page, known, words)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    return met.mapInArrow(judging, "page_id long, url string, text string")
