"""Main text of web pages by site style trees.

The pages of one host are merged into one tree: elements with the same chain of tags, classes
and ids are one node. For every node two entropies are taken over the distinct pages that have
it: how differently its children are arranged (presentation), and how widely each of its features
(text blocks and link targets, digits folded) is spread over pages (content). Both make the node's
importance, from 0 for what is the same on every page to 1 for what differs on each. Where a host
has too few pages to compare, a node counts as important.

In a page, every branch starts from its node's importance. What else is seen of it weighs in by
factors: whether its markup names it as something other than the article, whether it is a list of
links, and how much of the page's text it holds. No single one of these sinks a branch that the tree
holds important. Branches that end up under a threshold go, so menus and adverts that differ from
page to page go by their names and shape, and those without telling names by the tree. A branch that
holds the marked article, or most of a page's text, stays: a host of copies repeats its articles too.

The tree never exists in one place: tasks emit hashed (host, node, feature, page) rows that are
counted by grouped aggregation. Pages that carry the same article count as one.
"""

from __future__ import annotations

import html
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.shared import in_batches, stored

LOW = 0.2  # importance under which a branch goes
NAMED = 0.25  # factor of a telling name, tag or role
LINKS = 0.25  # factor of a list of links
SMALL = 0.7  # factor of a branch with up to half of the page's text, or beside a marked article
PAGES = 4  # distinct pages that must have a node before it can be judged
GAMMA = 0.9

# HTML elements by their role, and the words by which classes and ids tell a branch's role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object select button canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
ASIDE = frozenset("nav footer aside form dialog menu fieldset head".split())
CLOSES = {
    "p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "tbody": "thead tbody tr td th", "tfoot": "tbody tr td th",
}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SCOPES = frozenset("ul ol dl table div section article main body".split())
NOISE = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs byline-share consent cookie cookies footer gdpr login menu menubar modal nav navbar navigation "
    "newsletter notice notices notification overlay pager pagination popup promo promotion related recommended search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription teaser teasers toolbar topbar widget widgets".split()
)
# Words that say where a branch stands or what it is made of; beside a telling word they change nothing.
PLAIN = frozenset(
    "area bar block body bottom box button buttons col column container content footer fixed global group header inner item items js left link links list main mobile module "
    "outer panel post posts primary right row secondary section site slot sticky text top unit user wrap wrapper".split()
)
REMARKS = frozenset("comment comments disqus discussion replies respond".split())
TOP = frozenset("header masthead".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

# A quote opens a string only where an attribute's value begins.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)>|([^<]+|<)", re.S)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"\d+")
_SERIAL = re.compile(r"\d{3,}")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Node:
    tag: str
    label: str
    path: int
    parent: "Node | None"
    named: str = ""  # "noise", "remark", "top" or "hidden" if the markup says so
    children: list["Node"] = field(default_factory=list)
    blocks: list["Block"] = field(default_factory=list)


@dataclass
class Block:
    node: Node
    text: str
    linked: int = 0  # characters inside links
    links: list[str] = field(default_factory=list)


def _named(tag: str, attributes: str) -> tuple[str, str]:
    """The label of an element, and what its markup calls it."""
    if not attributes.strip():
        return tag, "noise" if tag in ASIDE else "top" if tag == "header" else ""
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), html.unescape(next((v for v in values if v), "")))
    names = sorted(_SERIAL.sub("0", x) for key in ("class", "id") for x in found.get(key, "").split())
    label = ".".join([tag, *names])
    if any(_tells(x, REMARKS) for x in names):
        return label, "remark"
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or _HIDDEN.search(found.get("style", ""))
    if hidden:
        return label, "hidden"
    if tag in ASIDE or found.get("role", "").lower() in ROLES or any(_tells(x, NOISE) for x in names):
        return label, "noise"
    return label, "top" if tag == "header" or any(_tells(x, TOP) for x in names) else ""


def _tells(name: str, words: frozenset[str]) -> bool:
    """Whether a class or id holds one of the words and nothing beside it that gives it another sense."""
    own = [w.lower() for w in _WORD.findall(name)]
    return any(w in words for w in own) and all(w in words or w in PLAIN or w in NOISE or len(w) == 1 for w in own)


def parse(page: str) -> tuple[Node, list[Block]]:
    """The tree of block elements of a page and its text blocks in order."""
    root = Node("", "", 1, None)
    at, blocks = root, []
    pieces: list[str] = []
    linked, in_link, links = 0, 0, []

    def end_block() -> None:
        nonlocal linked, links
        text = " ".join("".join(pieces).split())
        if text or links:
            block = Block(at, text, linked, links)
            at.blocks.append(block)
            blocks.append(block)
        pieces.clear()
        linked, links = 0, []

    def close(tags: str, scope: frozenset) -> None:
        nonlocal at
        wanted, node = tags.split(), at
        while node.parent is not None and (node.tag not in scope or node.tag in wanted):
            if node.tag in wanted:
                end_block()
                at = node.parent
                return
            node = node.parent

    place = 0
    while token := _TOKEN.match(page, place):
        place = token.end()
        text = token[4]
        if text is not None:
            plain = html.unescape(text) if "&" in text else text
            pieces.append(plain)
            if in_link:
                linked += len(plain.strip())
            continue
        if token[2] is None:
            continue
        tag = token[2].lower()
        if tag == "br":
            pieces.append(" ")
        elif tag in INLINE:
            if tag == "a":
                in_link = 0 if token[1] else 1
                if not token[1]:
                    target = re.search(r"href\s*=\s*[\"']?([^\s\"'>]+)", token[3])
                    links.append(target[1] if target else "")
        elif token[1]:
            node = at
            while node.parent is not None and node.tag != tag:
                node = node.parent
            if node.parent is not None:
                end_block()
                at, in_link = node.parent, 0
        elif tag in RAW:
            if not token[3].endswith("/"):  # what it holds is no markup, up to its literal end tag
                end = _RAW_END[tag].search(page, place)
                place = end.end() if end else len(page)
        elif tag not in VOID:
            end_block()
            if tag in ENDS_P:
                close("p", SCOPES)
            if tag in CLOSES:
                close(CLOSES[tag], SCOPES)
            label, named = _named(tag, token[3])
            path = zlib.crc32(label.encode(), at.path & 0xFFFFFFFF) | (zlib.adler32(label.encode(), at.path >> 32 & 0x3FFFFFFF) & 0x3FFFFFFF) << 32
            node = Node(tag, label, path, at, named)
            at.children.append(node)
            at, in_link = node, 0
        elif tag == "hr":
            end_block()
    end_block()
    return root, blocks


def _above(node: Node | None):
    while node is not None and node.parent is not None:
        yield node
        node = node.parent


def _has_article(node: Node) -> bool:
    todo = list(node.children)
    while todo:
        x = todo.pop()
        if x.tag in ("article", "main") and not x.named:
            return True
        todo += x.children
    return False


def _menu(node: Node, place: dict[int, int], blocks: list[Block]) -> bool:
    """A list of at least three links and little else, and not one that stands between lines of a story."""
    own, todo = [], [node]
    while todo:
        x = todo.pop()
        own += x.blocks
        todo += x.children
    letters = sum(len(b.text) for b in own)
    if sum(len(b.links) for b in own) < 3 or sum(b.linked for b in own) < 0.8 * letters:
        return False
    first, last = min(place[id(b)] for b in own), max(place[id(b)] for b in own)
    line = lambda k: 0 <= k < len(blocks) and bool(blocks[k].text) and 2 * blocks[k].linked < len(blocks[k].text)
    beside = lambda k: blocks[k].node.parent is node.parent or blocks[k].node is node.parent
    return not (line(first - 1) and beside(first - 1) and line(last + 1) and beside(last + 1))


def _is_article(node: Node) -> bool:
    return node.tag in ("article", "main") and not node.named


def kept_blocks(root: Node, blocks: list[Block], importance: dict[int, float] | None = None) -> list[Block]:
    """The article's blocks: what no branch holds whose importance ends up under LOW.

    `importance` has the nodes of the host's tree that can be judged; others count 1. Where what is
    left lies mostly in marked articles, only these are kept. Hidden branches always go.
    """
    importance = importance or {}
    size: dict[int, int] = {}
    for b in blocks:
        for x in _above(b.node):
            size[id(x)] = size.get(id(x), 0) + len(b.text)
    whole = sum(len(b.text) for b in blocks)
    plain = sum(len(b.text) for b in blocks if not any(x.named for x in _above(b.node)))
    in_articles = sum(len(b.text) for b in blocks if any(_is_article(x) for x in _above(b.node)) and not any(x.named for x in _above(b.node)))
    place = {id(b): k for k, b in enumerate(blocks)}
    gone: dict[int, bool] = {}

    def weight(node: Node) -> float:
        inside = any(x.tag in ("article", "main") for x in _above(node.parent))
        own = size.get(id(node), 0)
        if node.tag in ("body", "html", "main") or _has_article(node):
            return 1.0
        if node.tag == "article" and not (inside and node.named == "remark") and not (node.named == "noise" and 2 * own < whole):
            return 1.0
        told = node.named in ("noise", "remark") or node.named == "top" and not inside
        menu = not told and not inside and node.tag in ("ul", "ol", "div", "table", "section", "p") and _menu(node, place, blocks)
        if 2 * own > whole and not menu and not (node.named and 2 * in_articles >= plain > 0):
            return 1.0  # beside it stands neither the article nor much else
        return importance.get(node.path, 1.0) * SMALL * (NAMED if told else LINKS if menu else 1.0)

    def dropped(last: Node) -> bool:
        chain = []
        for node in _above(last):
            if id(node) in gone:
                break
            chain.append(node)
        for node in reversed(chain):
            gone[id(node)] = gone.get(id(node.parent), False) or node.named == "hidden" or weight(node) < LOW
        return gone.get(id(last), False)

    left = [b for b in blocks if not dropped(b.node)]
    held_by_article = [b for b in left if any(x.tag in ("article", "main") for x in _above(b.node))]
    if 2 * sum(len(b.text) for b in held_by_article) >= sum(len(b.text) for b in left):
        left = held_by_article or left
    return [b for b in left if b.text]


def _hash(text: str) -> int:
    raw = text.encode()
    return (zlib.crc32(raw) << 32 | zlib.crc32(raw, 0x5BD1E995)) - (1 << 63)


def _features(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows (host, node, feature, page), (host, node, arrangement of children, page) and (host, node, ancestor)."""
    rows: set[tuple[str, int, int, int, int]] = set()
    hosts, pages = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    for host, page in zip(hosts, pages):
        root, blocks = parse(page or "")
        article = _hash("\n".join(b.text for b in kept_blocks(root, blocks)))
        todo = [root]
        while todo:
            node = todo.pop()
            todo += node.children
            if node.parent is None:
                continue
            labels = list(dict.fromkeys(x.label for x in node.children))
            rows.add((host, 1, node.path, _hash(">".join(labels)) if labels else 0, article))
            for x in _above(node):
                rows.add((host, 2, node.path, x.path, 0))
            for b in node.blocks:
                if b.text:
                    rows.add((host, 0, node.path, _hash("t" + _DIGITS.sub("0", b.text)), article))
                for target in b.links:
                    rows.add((host, 0, node.path, _hash("a" + _DIGITS.sub("0", target)), article))
    host, kind, node, what, page = zip(*rows) if rows else ((), (), (), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(host, pa.string()), pa.array(kind, pa.int32()), pa.array(node, pa.int64()), pa.array(what, pa.int64()), pa.array(page, pa.int64())], names=["host", "kind", "node", "what", "page"]
    )


def host_of(url: Column) -> Column:
    """The host of a url in lower case, without port; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def node_importance(pages: DataFrame) -> DataFrame:
    """host, node, pages, presentation, content, importance for every node of every host's tree."""
    rows = in_batches(pages.select(host_of(F.col("url")).alias("host"), "html"), _features, "host string, kind int, node bigint, what bigint, page bigint")
    rows = stored(rows.distinct(), "style")
    log = lambda name: F.log(F.col(name).cast("double"))
    kinds = rows.where("kind = 1").groupBy("host", "node", "what").agg(F.count("*").alias("c"))
    shape = kinds.groupBy("host", "node").agg(F.sum("c").alias("pages"), F.sum(F.col("c") * log("c")).alias("clogc"), F.count(F.when(F.col("what") != 0, 1)).alias("inner"))
    spread = rows.where("kind = 0").groupBy("host", "node", "what").agg(F.count("*").alias("k"))
    leaf = spread.groupBy("host", "node").agg(F.sum(F.col("k") * log("k")).alias("klogk"), F.sum("k").alias("k"))
    above = rows.where("kind = 2").select("host", "node", F.col("what").alias("ancestor")).distinct()
    content = above.join(leaf, ["host", "node"]).groupBy("host", F.col("ancestor").alias("node")).agg(F.sum("klogk").alias("klogk"), F.sum("k").alias("k"))
    m = F.log(F.col("pages").cast("double"))
    presentation = F.when(F.col("pages") > 1, F.greatest(F.lit(0.0), (m - F.col("clogc") / F.col("pages")) / m)).otherwise(1.0)
    spread_out = F.when(F.col("pages") > 1, F.greatest(F.lit(0.0), 1 - F.col("klogk") / (F.col("k") * m))).otherwise(1.0)
    share = F.pow(F.lit(GAMMA), F.col("inner"))
    joined = shape.join(content, ["host", "node"])
    joined = joined.select("host", "node", "pages", "inner", presentation.alias("presentation"), spread_out.alias("content"))
    return joined.select("host", "node", "pages", "presentation", "content", ((1 - share) * F.col("presentation") + share * F.col("content")).alias("importance"))


def _extract(batch: pa.RecordBatch) -> pa.RecordBatch:
    out = []
    for page, judged in zip(batch.column(2), batch.column(3)):
        value = page.as_py()
        text = ""
        if value:
            text = "\n\n".join(b.text for b in kept_blocks(*parse(value), {x["node"]: x["importance"] for x in judged.as_py() or ()}))
        out.append(text)
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of `pages` (page_id, url, html).

    A null or empty html has an empty text; pages without a host form a tree of their own.
    Repeated rows are each returned and count once in the tree. Other columns are ignored; an empty
    table gives no rows.
    """
    nodes = node_importance(pages).where((F.col("importance") < 1) & (F.col("pages") >= PAGES))
    judged = stored(nodes.groupBy("host").agg(F.collect_list(F.struct("node", "importance")).alias("judged")), "judged")  # few nodes a host, as serial numbers in names are folded
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(judged, "host", "left")
    return in_batches(rows.select("page_id", "url", "html", "judged"), _extract, "page_id bigint, url string, text string, n_chars bigint")
