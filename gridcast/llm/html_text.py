"""Main text of web pages by a site style tree, with landmark tags as its prior.

Every page becomes a tree of elements, parsed once into a compact table: its blocks of text and, for every element
that may be cut, path (tags and class names from the root), presentation (a hash of the sequence of child elements),
content (a hash of its text) and the blocks it spans. Merged over the distinct pages of a host, elements of one path
are an element node of the host's style tree, and the texts seen under it are its content nodes.

An element node's importance is the larger of the entropies of its presentations and of its contents, relative to the
largest possible. A content node that k of the m pages with its path show has importance 1 - log k / log m. Template
branches look and read alike everywhere and come near 0. Branches below `threshold`, of paths on at least `min_seen`
distinct pages, are cut.

Landmarks are the prior. Navigation, headers, footers, asides, forms, scripts, and elements whose role or whole class
name says notice, advert, comment and the like are never main text; ids count only where a whole id of a container is
such a name. An article or main element is never cut itself, and text outside of it isn't main text where a page has
one. Its plain headings, paragraphs and the like are its own text; of the containers and elements with class names in
it the tree cuts those of low importance, unless they hold more than half of the page's main text: then the page is a
copy of others rather than grown on their template, and stays whole. Without landmarks the tree decides alone, on
every element; a page of which it would leave nothing stays whole.

Statistics move between tasks as one row for every page, path and distinct presentation or content, spread by all of
them, so that a hot host is dealt to all tasks. Time is linear in a page's length, whatever its nesting.

Cases: null html is empty; null url is a host of its own; pages without text give ""; unclosed and crossed tags are
closed where HTML closes them; equal rows are rows of their own, equal pages of a host count once in its tree; an empty
table gives no rows; other columns aren't carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import around, pieces, prepare, released, scratch, write_table

# Names from the HTML standard.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul menu noscript template button select option iframe svg head object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Always cut, with all that they hold.
CUT_TAGS = frozenset("head script style title textarea noscript template nav footer aside form iframe svg button select option menu dialog xmp noembed noframes object canvas".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MAIN = frozenset(["article", "main"])
#: Elements that an opening tag closes, and those that keep it from closing any further out, by family.
FAMILIES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dl": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
OPENS = {"li": "li", "dt": "dl", "dd": "dl", "tr": "tr", "td": "td", "th": "td", "option": "option"}
MARKS = {tag: [(f, tag in closed) for f, (closed, within) in FAMILIES.items() if tag in closed | within] for tag in set().union(*(a | b for a, b in FAMILIES.values()))}

#: Class names of what isn't main text, alone or with neutral words; the last ones outside of articles only.
CUT_WORDS = frozenset("nav navbar navigation menu footer contentinfo sidebar aside ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup share sharing social related recommended comment comments reply replies disqus breadcrumb breadcrumbs pagination pager toolbar search".split())
HEAD_WORDS = frozenset("header masthead topbar".split())
NEUTRAL = frozenset("site page main top bottom left right box bar list section area wrapper wrap container block post posts article links link buttons button icons items item content inner outer text message panel form global primary secondary blog entry thread group unit slot".split())
#: Elements that names don't cut, and those that a whole id may.
NEVER_BY_NAME = frozenset("html body main h1 h2 h3 h4 h5 h6 pre code".split())
CONTAINERS = frozenset("div section ul ol table dl center details figure".split())

MARKUP = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|[!?])")
QUOTED = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
#: Characters of a tag within which quotes may hide its end, and quotes left open after which they no longer do.
TAG_LENGTH, OPEN_QUOTES = 65_536, 64
ATTRS = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
#: White space as HTML has it, and the no-break space that references leave.
SPACE = re.compile(r"\s+")
DIGITS = re.compile(r"[0-9]+")
MASK, PRIME = (1 << 64) - 1, 0x9E3779B97F4A7C15


def _named(name: str, words: frozenset[str]) -> bool:
    """Whether a class name or id consists of the words and neutral ones, at least one of them of the words."""
    parts = name.replace("_", "-").split("-")
    return any(p in words for p in parts) and all(p in words or p in NEUTRAL for p in parts if p)


@lru_cache(maxsize=20_000)
def _names(attrs: str) -> tuple[str, bool, bool, bool, bool]:
    """For the path, and whether by name cut anywhere, cut outside of landmarks, main; whether cut by whole id."""
    path, anywhere, outside, main, by_id = [], False, False, False, False
    for key, value in ATTRS.findall(attrs):
        value = value.strip("\"'").lower()
        if key.lower() == "id":
            by_id |= _named(value, CUT_WORDS)
            main |= value == "main"
            continue
        for name in value.split():
            path.append(DIGITS.sub("#", name))
            main |= name == "main"
            if key.lower() == "role":
                anywhere |= name in CUT_ROLES
                main |= name == "article"
            else:
                anywhere |= _named(name, CUT_WORDS)
                outside |= _named(name, HEAD_WORDS)
    return " ".join(sorted(set(path))), anywhere, outside, main, by_id


class Node:
    __slots__ = ("tag", "parent", "cut", "main", "land", "plain", "path", "shape", "content", "first", "end", "holds", "by_name")

    def __init__(self, tag: str, parent: Node | None, names: str, cut: bool, by_name: bool, main: bool, land: bool, first: int):
        self.tag, self.parent, self.cut, self.by_name, self.main, self.land, self.first, self.end = tag, parent, cut, by_name, main, land, first, first
        self.path = xxhash.xxh3_64_intdigest(f"{parent.path if parent else 0}/{tag}.{names}")
        self.shape = self.content = 0
        self.plain = not names and tag not in CONTAINERS
        self.holds = False


def parse(html: str, spare: frozenset[int] = frozenset()) -> tuple[list[Node], list[tuple[str, bool]]]:
    """Elements in order of their starts, and (text, whether in a landmark) of every block that isn't cut, in page order.

    spare: places of elements that names must not cut.
    """
    root = here = Node("#", None, "", False, False, False, False, 0)
    nodes, blocks, parts = [root], [], []
    count: dict[str, int] = {}
    marks: dict[str, list[tuple[Node, bool]]] = {f: [] for f in FAMILIES}
    skip, depth, skip_at = "", 0, root  # an inline element that is cut, how many of its name are open, where it started
    at, n, last, odd = 0, len(html), html.rfind(">"), 0

    def flush() -> None:
        if parts:
            if not here.cut:
                text = "".join(parts)
                if "&" in text:
                    text = unescape(text)
                text = SPACE.sub(" ", text).strip()
                if text:
                    blocks.append((text, here.main))
                    here.content = (here.content * PRIME + xxhash.xxh3_64_intdigest(text)) & MASK
            parts.clear()

    def close(to: Node) -> None:
        """Close the open elements up to and with `to`."""
        nonlocal here
        while True:
            node = here
            node.end = len(blocks)
            count[node.tag] -= 1
            for family, _ in MARKS.get(node.tag, ()):
                marks[family].pop()
            here = node.parent
            if node.end > node.first:
                here.content = (here.content * PRIME + node.content) & MASK
            if node is to:
                return

    while at < n:
        m = MARKUP.search(html, at)
        if m is None or (m[2] is not None and m.end() > last):  # what never ends is text
            if not skip:
                parts.append(html[at:])
            break
        if m.start() > at and not skip:
            parts.append(html[at : m.start()])
        if m[2] is None:
            end = html.find("-->", m.start() + 2) if m[0] == "<!--" else html.find(">", m.end())
            at = n if end < 0 else end + (3 if m[0] == "<!--" else 1)
            continue
        end = html.find(">", m.end())
        attrs = html[m.end() : end]
        if odd < OPEN_QUOTES and (attrs.count('"') & 1 or attrs.count("'") & 1):
            whole = QUOTED.match(html, m.end(), m.end() + TAG_LENGTH)
            if whole is None:
                odd += 1
            else:
                end = whole.end() - 1
                attrs = html[m.end() : end]
        at, tag = end + 1, m[2].lower()
        if m[1]:
            if tag == skip:
                depth -= 1
                if not depth:
                    skip = ""
            elif count.get(tag):
                flush()
                up = here
                while up.tag != tag:
                    if up is skip_at:
                        skip = ""
                    up = up.parent
                if up is skip_at:
                    skip = ""
                close(up)
            elif tag == "p":
                flush()
            continue
        if tag in RAW:
            found = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            if tag == "iframe" or tag not in CUT_TAGS:
                flush()
            end = html.find(">", found.end()) if found else -1
            at = n if end < 0 else end + 1
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag in ("br", "img", "input"):
                parts.append(" ")
            continue
        names, anywhere, outside, main, by_id = _names(attrs) if "=" in attrs else ("", False, False, False, False)
        if tag not in BLOCK:
            if skip:
                depth += tag == skip
            elif anywhere and not here.cut and tag not in NEVER_BY_NAME and not attrs.endswith("/"):
                skip, depth, skip_at = tag, 1, here
                parts.append(" ")
            continue
        flush()
        family = OPENS.get(tag)
        if family:
            closable, up = marks[family], None
            k = len(closable) - 1
            while k >= 0 and closable[k][1]:
                up, k = closable[k][0], k - 1
            if up is not None:
                close(up)
        while here.tag == "p":  # a block closes an open paragraph
            close(here)
        land = tag in MAIN or (main and tag not in ("html", "body"))
        by_name = tag not in NEVER_BY_NAME and (anywhere or (outside and not here.main) or (by_id and tag in CONTAINERS))
        by_name = by_name and len(nodes) not in spare
        cut = here.cut or bool(skip) or tag in CUT_TAGS or (tag == "header" and not here.main) or by_name
        here.shape = (here.shape * PRIME + xxhash.xxh3_64_intdigest(f"{tag}.{names}")) & MASK
        if not attrs.endswith("/"):
            here = Node(tag, here, names, cut, by_name, here.main or land, land, len(blocks))
            nodes.append(here)
            count[tag] = count.get(tag, 0) + 1
            for f, closes in MARKS.get(tag, ()):
                marks[f].append((here, closes))
            if land and cut:
                up = here
                while up is not None and not up.holds:
                    up.holds = True
                    up = up.parent
    flush()
    if here is not root:
        up = here
        while up.parent is not root:
            up = up.parent
        close(up)
    root.end = len(blocks)
    if not blocks and not spare:  # a name cuts all there is, and a landmark with it
        held = frozenset(i for i, node in enumerate(nodes) if node.by_name and node.holds)
        if held:
            return parse(html, held)
    return nodes, blocks


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def page(html: str) -> tuple[bool, list[str], list[tuple[int, int, int, int, int]], int]:
    """Whether it has a landmark; blocks of main text as landmarks have it; (path, content, shape, first block, end) of
    every element that the tree may cut; a hash of all blocks."""
    nodes, blocks = parse(html)
    land = any(main for _, main in blocks)
    before = np.cumsum([0, *(main or not land for _, main in blocks)]).tolist()
    kept = [text for text, main in blocks if main or not land]
    out = []
    for node in nodes:
        if node.end > node.first and not node.cut and not node.land and node.tag not in ("#", "html", "body") and (not land or (node.main and not node.plain)):
            out.append((_signed(node.path), _signed(node.content), _signed(node.shape), before[node.first], before[node.end]))
    return land, kept, out, _signed(xxhash.xxh3_64_intdigest("\n\n".join(kept)))


NODE = "struct<path:long,content:long,shape:long,first:int,end:int>"
PAGE = f"row long, page_id long, url string, host long, pg long, land boolean, blocks array<string>, nodes array<{NODE}>"


def _lists(lengths: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), values)


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 200):
        found = [page(h or "") for h in batch.column("html").to_pylist()]
        hosts = [_signed(xxhash.xxh3_64_intdigest(host_of(u))) for u in batch.column("url").to_pylist()]
        flat = list(zip(*(x for f in found for x in f[2]), strict=True)) or [()] * 5
        kinds = [pa.int64()] * 3 + [pa.int32()] * 2
        nodes = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(flat, kinds, strict=True)], ["path", "content", "shape", "first", "end"])
        texts = pa.array([b for f in found for b in f[1]], pa.string())
        arrays = [batch.column("row"), batch.column("page_id"), batch.column("url"), pa.array(hosts, pa.int64()), pa.array([f[3] for f in found], pa.int64()), pa.array([f[0] for f in found], pa.bool_())]
        arrays += [_lists([len(f[1]) for f in found], texts), _lists([len(f[2]) for f in found], nodes)]
        yield pa.RecordBatch.from_arrays(arrays, ["row", "page_id", "url", "host", "pg", "land", "blocks", "nodes"])


def low_branches(pages: DataFrame, threshold: float = 0.2, min_seen: int = 5) -> DataFrame:
    """host, path, content (null: any) of the style tree's element and content nodes of low importance.

    pages: host, pg (what tells pages of a host apart), nodes.
    """
    row = lambda kind, value: lambda x: F.struct(x["path"].alias("path"), F.lit(kind).alias("kind"), value(x).alias("value"))
    shapes = F.transform(F.filter("nodes", lambda x: x["shape"] != 0), row(0, lambda x: x["shape"]))
    contents = F.transform("nodes", row(1, lambda x: x["content"]))
    seen = F.transform("nodes", row(2, lambda x: F.lit(0).cast("long")))
    rows = pages.select("host", "pg", F.inline(F.array_distinct(F.concat(shapes, contents, seen)))).distinct()
    counts = rows.groupBy("host", "path", "kind", "value").agg(F.count("*").alias("n"))
    total = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")))
    bits = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n") * F.log2("n")))
    paths = counts.groupBy("host", "path").agg(F.max(F.when(F.col("kind") == 2, F.col("n"))).alias("m"), *(f(k).alias(f"{name}{k}") for k in (0, 1) for name, f in (("n", total), ("s", bits))))
    paths = paths.filter(F.col("m") >= max(2, min_seen))
    entropy = lambda k: F.when(F.col(f"n{k}") > 1, (F.log2(f"n{k}") - F.col(f"s{k}") / F.col(f"n{k}")) / F.log2(f"n{k}"))
    low = paths.filter(F.greatest(entropy(0), entropy(1)) < threshold).select("host", "path", F.lit(None).cast("long").alias("content"))
    again = counts.filter((F.col("kind") == 1) & (F.col("n") > 1)).select("host", "path", F.col("value").alias("content"), "n")
    again = again.join(paths.select("host", "path", "m"), ["host", "path"]).filter(1 - F.log2("n") / F.log2("m") < threshold)
    return low.unionByName(again.select("host", "path", "content"))


def assemble(blocks: list[str], land: bool, cuts: list[tuple[int, int]]) -> tuple[str, int]:
    """The page's text without the blocks that the tree cuts, and how many those are."""
    gone = np.zeros(len(blocks) + 1, dtype=np.int64)
    for first, end in cuts:
        gone[first] += 1
        gone[end] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    lengths = np.array([len(b) for b in blocks], dtype=np.int64)
    if gone.any() and (2 * lengths[gone].sum() > lengths.sum() if land else gone.all()):
        gone[:] = False
    return "\n\n".join(b for b, g in zip(blocks, gone.tolist(), strict=True) if not g), int(gone.sum())


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        cuts = [[(c["first"], c["end"]) for c in x or ()] for x in batch.column("cuts").to_pylist()]
        found = [assemble(b, land, c) for b, land, c in zip(batch.column("blocks").to_pylist(), batch.column("land").to_pylist(), cuts, strict=True)]
        arrays = [batch.column("page_id"), batch.column("url"), pa.array([t for t, _ in found], pa.string()), pa.array([k for _, k in found], pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_cut_by_tree"])


def extract(pages: DataFrame, threshold: float = 0.2, min_seen: int = 5, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars, n_cut_by_tree (blocks) of every row of pages."""
    spark = pages.sparkSession
    prepare(spark)
    outer = around()
    with scratch(spark):
        rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
        rows = write_table(rows.mapInArrow(released(_pages), PAGE), "pages", outer)
        low = write_table(low_branches(rows, threshold, min_seen), "low").withColumnRenamed("content", "of")
        used = rows.select("row", "host", F.inline("nodes")).join(low, ["host", "path"]).filter(F.col("of").isNull() | (F.col("of") == F.col("content")))
        cuts = write_table(used.groupBy("row").agg(F.collect_set(F.struct("first", "end")).alias("cuts")), "cuts", outer)
    texts = rows.join(cuts, "row", "left").select("page_id", "url", "land", "blocks", "cuts")
    texts = texts.mapInArrow(released(_texts), "page_id long, url string, text string, n_cut_by_tree long")
    return texts.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"), "n_cut_by_tree")


def main_text(html: str) -> str:
    """The text of one page as landmarks have it, without a style tree."""
    return "\n\n".join(page(html)[1])
