"""Main-text extraction by scoring the tree of a page.

A page becomes a tree of elements with the text blocks they hold. Each block gives points, for its length and commas, to the element
it lies in; a paragraph, or an element with just one thing in it, passes all points it has received to its parent, any other
element half of them, and so on up to the root, in one pass from the leaves. A container's points are discounted by its share of
link text. If the best container is one of several far apart that score alike, the lowest element that holds most of these
takes its place. The best container and those siblings that look like it are kept, and their blocks read in page order.

Parts that are never main text (scripts, menus, forms and so on) are pruned by tag, role and hidden state. An element is furniture
if a whole class name, or its whole id, says so in all its words (``ad``, ``cookie-banner``, ``comment-list``, but not
``related-work``), unless it holds most of a page that has hardly any other text.

White space is what Python's ``str.split`` splits at (U+0085, U+00A0 and U+001C to U+001F, too).

One linear pass reads the markup as browsers do: unclosed paragraphs end at the next block, an unfinished tag at the end of a
cut page is dropped, raw text elements end at their own end tag only.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iqlake.llm.textcore import slices

_TOKEN = re.compile(r"""<!--(?s:.*?)(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>"'=]|=\s*+"[^"]*(?:"|\Z)|=\s*+'[^']*(?:'|\Z)|=|["'])*+)(>|\Z)""")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>]+)))?""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
PRUNED = frozenset("head nav footer aside form fieldset button select option datalist dialog menu svg math canvas audio video object embed iframe template noscript script style textarea title input search".split())
#: Words of a class name or id that say that an element is not main text, and words that say nothing beside them.
MARKS = frozenset("ad ads advert advertisement advertising adsense advertorial banner banners sponsor sponsored promo promos promotion nav navbar navigation menu menus sidebar sidebars footer masthead cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay newsletter subscribe subscription signup paywall comment comments commentlist respond replies disqus share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager widget widgets toolbar skip".split())
NEUTRAL = frozenset("site page top bottom left right primary secondary list box container wrapper wrap area inner outer block section item items bar slot unit text global fixed sticky button buttons link links form content main body panel column col row group area zone header".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
OWN = frozenset("html body main article".split())
START = {"article": 25, "main": 25, "section": 5, "div": 5, "blockquote": 3, "pre": 3, "td": 3, "ul": -3, "ol": -3, "dl": -3, "li": -3, "dd": -3, "dt": -3}
#: Never a container; only one if blocks are in it.
LEAVES, CELLS = frozenset("p h1 h2 h3 h4 h5 h6 tr caption figcaption legend summary".split()), frozenset("li td th dd dt".split())
#: What part of its points an element with several things in it passes on, and what part of the best score makes a peer.
SHARE, PEER, PEERS = 0.5, 0.5, 3
#: Start tags that end an open element of the listed kinds.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


class Node:
    __slots__ = ("tag", "parent", "items", "pruned", "furniture", "points", "chars", "link_chars", "peers")

    def __init__(self, tag: str, parent: Node | None, pruned: bool, furniture: bool = False) -> None:
        self.tag, self.parent, self.pruned, self.furniture = tag, parent, pruned, furniture
        self.items: list[Node | Block] = []
        self.points, self.chars, self.link_chars, self.peers = 0.0, 0, 0, 0


class Block:
    """A run of text without a block boundary in it."""

    __slots__ = ("text", "link_chars")

    def __init__(self, text: str, link_chars: int) -> None:
        self.text, self.link_chars = text, link_chars


def _says_furniture(name: str, in_article: bool) -> bool:
    words = {w.lower() for w in _PARTS.findall(name)}
    marks = words & MARKS or (not in_article and "header" in words)
    return bool(marks) and words <= MARKS | NEUTRAL


def _kind(tag: str, attrs: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is pruned, and whether it is furniture by its names."""
    if tag in PRUNED or (tag == "header" and not in_article):
        return True, False
    furniture = False
    if attrs.strip() and tag not in OWN:
        for m in _ATTR.finditer(attrs):
            name = m[1].lower()
            value = m[2] or m[3] or m[4] or ""
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "role" and value.lower() in ROLES) or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                return True, False
            if name == "class":
                furniture = furniture or any(_says_furniture(x, in_article) for x in value.split())
            elif name == "id":
                furniture = furniture or _says_furniture(value, in_article)
    return False, furniture


def parse(page: str) -> Node:
    """The tree of a page; pruned parts are left out."""
    root = Node("html", None, False)
    at, run, links, link_depth, articles = root, [], 0, 0, 0
    still: Counter[str] = Counter()  # open elements by name, so that a stray end tag costs no walk
    pos, end = 0, len(page)

    def close() -> None:
        """Ends the current run of text as a block of the current element."""
        nonlocal links
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                at.items.append(Block(text, min(links, len(text))))
            run.clear()
            links = 0

    def leave(node: Node) -> Node:
        still[node.tag] -= 1
        return node.parent

    while pos < end:
        m = _TOKEN.search(page, pos)
        stop = m.start() if m else end
        if stop > pos and not at.pruned:
            run.append(page[pos:stop])
            if link_depth:
                links += len(html.unescape(page[pos:stop]).strip())
        if not m:
            break
        pos = m.end()
        if m[2] is not None:
            tag = m[2].lower()
            if not m[4]:
                break  # an unfinished tag at the end
            if tag in RAW:
                shut = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, pos)
                pos = shut.end() if shut else end
                continue
            if tag == "a":
                link_depth = 1
            elif tag == "br" or tag == "wbr":
                if not at.pruned and tag == "br":
                    run.append(" ")
            elif tag in BLOCK or tag in PRUNED:
                if tag in BLOCK:
                    close()
                    if at.tag == "p":
                        at = leave(at)
                    if tag in ENDS and at.tag in ENDS[tag]:
                        at = leave(at)
                        if tag == "tr" and at.tag == "tr":
                            at = leave(at)
                if tag in VOID or tag in ("html", "body"):
                    continue
                pruned, furniture = (True, False) if at.pruned else _kind(tag, m[3], articles > 0)
                node = Node(tag, at, pruned, furniture)
                if not node.pruned:
                    at.items.append(node)
                articles += tag in ("article", "main")
                still[tag] += 1
                at = node
        elif m[1] is not None:
            tag = m[1].lower()
            if tag == "a":
                link_depth = 0
            elif tag in BLOCK or tag in PRUNED:
                if still[tag]:
                    close()
                    while at.tag != tag:
                        articles -= at.tag in ("article", "main")
                        at = leave(at)
                    articles -= tag in ("article", "main")
                    at = leave(at)
                elif tag in BLOCK and not at.pruned:
                    close()
    close()
    return root


def _nodes(root: Node) -> list[Node]:
    """All nodes in page order."""
    nodes, stack = [], [root]
    while stack:
        node = stack.pop()
        nodes.append(node)
        stack.extend(x for x in reversed(node.items) if isinstance(x, Node))
    return nodes


def _measure(nodes: list[Node]) -> None:
    """Counts characters, and leaves out elements without any."""
    for node in reversed(nodes):
        node.items = [x for x in node.items if isinstance(x, Block) or x.chars]
        node.chars = sum(len(x.text) if isinstance(x, Block) else x.chars for x in node.items)
        node.link_chars = sum(x.link_chars for x in node.items)


def _clear(root: Node) -> None:
    """Removes furniture and elements without text; an element that holds most of a page with hardly any other text stays."""
    nodes = _nodes(root)
    _measure(nodes)
    outer, stack = 0, [root]
    while stack:
        for x in stack.pop().items:
            if isinstance(x, Node) and x.furniture:
                outer += x.chars
            elif isinstance(x, Node):
                stack.append(x)
    bare, whole = 20 * (root.chars - outer) < root.chars, root.chars
    for node in nodes:
        node.items = [x for x in node.items if isinstance(x, Block) or not x.furniture or (bare and 2 * x.chars >= whole)]
    _measure(nodes)


def _score(nodes: list[Node]) -> None:
    """Passes points up, from the leaves; every node is seen once."""
    for node in reversed(nodes):
        for x in node.items:
            if isinstance(x, Block):
                n = len(x.text)
                node.points += (min(1, n / 25) * (1 + x.text.count(",")) + min(n / 100, 3)) * (1 - x.link_chars / n)
            else:
                node.points += x.points * (1 if len(x.items) == 1 or x.tag in LEAVES or x.tag in CELLS or x.tag == "pre" else SHARE)


def _final(node: Node) -> float:
    return (node.points + START.get(node.tag, 0)) * (1 - node.link_chars / node.chars) if node.chars else float("-inf")


def _container(nodes: list[Node], able: list[Node]) -> Node:
    """The best container, or the lowest that holds most of its peers, beyond all wrappers with nothing else in them."""
    best = max(able, key=_final)
    least = PEER * _final(best)
    alike = {id(n) for n in able if _final(n) >= least}
    for node in reversed(nodes):
        node.peers = sum(x.peers for x in node.items if isinstance(x, Node))
        # Of nodes in each other the lowest is the peer.
        if not node.peers and id(node) in alike:
            node.peers = 1
    if nodes[0].peers >= PEERS:
        while best.parent is not None and 2 * best.peers <= nodes[0].peers:
            best = best.parent
    while best.parent is not None and len(best.parent.items) == 1:
        best = best.parent
    return best


def _blocks(node: Node) -> Iterator[str]:
    stack: list[Node | Block] = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, Block):
            yield x.text
        else:
            stack.extend(reversed(x.items))


def main_text(page: str | None) -> str:
    """The page's main text, blocks joined by a newline; empty for null, empty and pages without text."""
    if not page:
        return ""
    root = parse(page)
    _clear(root)
    nodes = _nodes(root)
    _score(nodes)
    able = [n for n in nodes if n.chars and n.tag not in LEAVES and (n.tag not in CELLS or any(isinstance(x, Node) for x in n.items))]
    if not able:
        return ""
    best = _container(nodes, able)
    if best.parent is None:
        return "\n".join(_blocks(best))
    limit, out, seen = max(10.0, 0.2 * _final(best)), [], False
    for x in best.parent.items:
        if x is best:
            seen = True
            keep = True
        elif isinstance(x, Block):
            keep = len(x.text) > 80 and x.link_chars < 0.25 * len(x.text)
        elif x.tag == "p":
            keep = x.chars > 80 and x.link_chars < 0.25 * x.chars
        elif re.fullmatch("h[1-3]", x.tag):
            keep = not seen and not x.link_chars and x.chars > 0
        else:
            keep = _final(x) >= limit
        if keep:
            out.extend([x.text] if isinstance(x, Block) else _blocks(x))
    return "\n".join(out)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of ``df``: id, url, text, n_chars (code points of the text).

    A null or empty html gives an empty text. Null ids and urls and repeated rows pass through. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, parts in slices(batches, "_html"):
            texts = [main_text(bytes(p).decode("utf-8", "replace")) for p in parts]
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0), url_col: batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long"
    return df.select(id_col, url_col, F.col(html_col).cast("string").alias("_html")).mapInArrow(run, schema)
