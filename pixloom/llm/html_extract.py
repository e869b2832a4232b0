"""HTML extraction by composite text density.

The page becomes a tree.  Elements that are boilerplate by name or role (menus,
headers, footers, forms, scripts, styles) or hidden are left out.  Words of class
and id values (adverts, sidebars, notices, reader comments) are weighed with what
the element holds.  An element of which a whole value is made of such words is
left out, unless it holds most of the page's text while article and main elements
outside have less than a tenth of that.  If only a part of a value is such a word
("related-work", "no-sidebar"), it is left out only where it is mostly links.
Headings and paragraphs are never left out for such words, and a header inside
an article or main element is its own head, not the page's.  Every other node gets
a link-adjusted density:
characters per tag, damped by the share of its characters and tags that are
links, against the share on the whole body.  The density sum of a node adds up
its children's densities, so that an article of many paragraphs beats each of
them.  The node with the largest sum is the article.  The smallest density on
the path from the body to it is the threshold: what hangs off that path joins
the article if it reaches the threshold and is not mostly links, or if it
stands in the same article or main element.

Text is given block by block: character references are decoded, white space
inside a block becomes one space, blocks are trimmed and joined by one line end.

Defined cases: null or empty html gives an empty text; unclosed and stray tags
are repaired; a comment that does not end takes the rest of the page, a quote that
does not end is a character; text outside any tag counts as body text; an empty table gives an
empty table and repeated rows repeated results; of equal sums the outermost, first
node is the article; columns beside id, url and html are not read.  Pages are
mapped over, nothing is shuffled.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixloom.llm.common import bounded_batches, lean, small_batches

#: Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg select".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose start ends an open element of the second kind.
ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"), "option": ("option",),
}
SCOPES = frozenset("table ul ol dl article section div body html td th main aside nav footer header form".split())
BOILERPLATE = frozenset("nav menu header footer aside form button dialog search label fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words of class and id values that announce boilerplate.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside nav navbar "
    "navigation menu breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert popup modal "
    "overlay newsletter subscribe subscription signup login share sharing social comment comments disqus replies respond "
    "related recommended pagination pager toolbar skip widget copyright disclaimer form".split()
)
#: Words that may stand beside them in a value and tell nothing else.
BESIDE = frozenset(
    "area article bar block body bottom box button buttons card cell col column container entry group head icon icons inner "
    "item items js left link links list main module outer page panel post reader right row section site slot strip title top "
    "unit user wrap wrapper zone".split()
)
#: Elements that such words never announce.
KEPT = frozenset("html body article main h1 h2 h3 h4 h5 h6 p".split())

_START = re.compile(r"<(?=[!?]|/?[a-zA-Z])")
#: A tag; quotes count behind an equals sign only, and only if they end.
_TAG = re.compile(r"</?(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>")
#: A tag without regard to quotes.
_PLAIN_TAG = re.compile(r"</?(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>[^>]*+)>")
_ATTR = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")


class Node:
    __slots__ = ("name", "parent", "parts", "chars", "tags", "link_chars", "link_tags", "density", "total", "mark")

    def __init__(self, name: str, parent: Node | None):
        self.name, self.parent = name, parent
        self.parts: list[Node | str] = []
        self.mark = 0  # 1: class or id has a word of boilerplate, 2: a whole value says so


def _judged(name: str, attrs: str) -> tuple[bool, int]:
    """Whether an element is boilerplate whatever it holds, and its mark."""
    if name in BOILERPLATE:
        return True, 0
    if name in ("html", "body", "article", "main") or not attrs.strip():
        return False, 0
    values = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTR.findall(attrs)}
    if "hidden" in values or values.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", values.get("style", "")):
        return True, 0
    if values.get("role", "").lower() in ROLES:
        return True, 0
    mark = 0
    if name not in KEPT:
        for token in (values.get("class", "") + " " + values.get("id", "")).split():
            words = [w.lower() for w in _WORDS.findall(token)]
            if token.lower() == "header" or any(w in MARKS for w in words):
                whole = all(w in MARKS or w in BESIDE or w == "header" or w.isdigit() for w in words)
                mark = max(mark, 2 if whole else 1)
    return False, mark


class Limits:
    """Up to where a page can have tags and sections that end, and whether quotes still count.

    What is not closed is looked for once, so that no page is searched to its end for each of its tags.
    """

    def __init__(self, page: str):
        self.tag, self.section, self.quotes = page.rfind(">") + 1, page.rfind("]]>"), True


def next_tag(page: str, at: int, limits: Limits) -> tuple[str, re.Match[str] | None, int]:
    """The text before the next tag, the tag, where it ends; comments, sections and declarations are left out of the text."""
    texts = []
    while start := _START.search(page, at):
        begin = start.start()
        if page.startswith("<!--", begin):
            stop = page.find("-->", begin + 2) + 3
            stop = stop if stop > 2 else len(page)
        elif begin >= limits.tag:  # no tag ends behind it
            stop = begin + 1
            texts.append(page[at:stop])
            at = stop
            continue
        elif page.startswith("<![CDATA[", begin) and begin < limits.section:
            stop = page.find("]]>", begin) + 3
        elif page[begin + 1] in "!?":
            stop = page.find(">", begin) + 1
        else:
            m = _TAG.match(page, begin, limits.tag) if limits.quotes else None
            if m is None:  # its quotes swallow all the rest: from here on quotes are characters
                limits.quotes = False
                m = _PLAIN_TAG.match(page, begin, limits.tag)
            return "".join(texts) + page[at:begin], m, m.end()
        texts.append(page[at:begin])
        at = stop
    return "".join(texts) + page[at:], None, len(page)


def parse(page: str) -> Node:
    """The tree of a page without its certain boilerplate; raw elements and their contents are left out too."""
    root = Node("body", None)
    stack, dropped, at = [root], 0, 0  # dropped: the depth below which nothing is kept
    # Depths of the open elements by name, of those that are blocks and of those that are scopes: no tag looks through the stack.
    open_at: dict[str, list[int]] = {}
    blocks, scopes = [0], [0]
    limits = Limits(page)

    def push(node: Node) -> None:
        open_at.setdefault(node.name, []).append(len(stack))
        if node.name in BLOCK:
            blocks.append(len(stack))
        if node.name in SCOPES:
            scopes.append(len(stack))
        stack.append(node)

    def pop() -> None:
        nonlocal dropped
        name = stack.pop().name
        open_at[name].pop()
        if name in BLOCK:
            blocks.pop()
        if name in SCOPES:
            scopes.pop()
        if dropped > len(stack):
            dropped = 0

    def deepest(names: Iterable[str]) -> int:
        return max((open_at[n][-1] for n in names if open_at.get(n)), default=0)

    def end_open(names: tuple[str, ...]) -> None:
        while (depth := deepest(names)) and depth >= scopes[-1]:
            while len(stack) > depth:
                pop()
            if stack[-1].name not in names:
                return

    while True:
        text, m, at = next_tag(page, at, limits)
        if text and not dropped:
            stack[-1].parts.append(html.unescape(text) if "&" in text else text)
        if not m:
            return root
        name = m["name"].lower()
        if m[0][1] == "/":
            depth = deepest((name,))
            if depth and (name in BLOCK or depth > blocks[-1]):  # an inline end tag does not close blocks
                while len(stack) > depth:
                    pop()
            continue
        attrs = m["attrs"]
        if name in RAW:
            if not attrs.endswith("/"):
                close = re.compile(rf"</{re.escape(name)}(?![^\s/>])[^>]*+>", re.I).search(page, at, limits.tag)
                at = close.end() if close else len(page)
            continue
        if name in ("html", "body"):
            continue
        if name in BLOCK:
            end_open(("p",))
            end_open(ENDS.get(name, ()))
        node = Node(name, stack[-1])
        certain, node.mark = (False, 0) if dropped else _judged(name, attrs)
        if name == "header" and certain and deepest(("article", "main")) and not attrs.strip():
            certain = False  # an article's own head
        if not dropped:
            stack[-1].parts.append(node)
        if name in VOID:
            continue
        push(node)
        if certain:
            stack[-2].parts[-1] = " " if name not in BLOCK else Node("hr", stack[-2])
            dropped = len(stack)


def nodes_of(root: Node) -> list[Node]:
    """All nodes, parents before their children."""
    out = [root]
    for node in out:
        out += [p for p in node.parts if p.__class__ is Node]
    return out


def measure(root: Node) -> list[Node]:
    """Counts, densities and density sums of every node."""
    nodes = nodes_of(root)
    for node in reversed(nodes):
        node.chars = sum(len("".join(p.split())) for p in node.parts if p.__class__ is str)
        node.tags = node.link_chars = node.link_tags = 0
        for p in node.parts:
            if p.__class__ is Node:
                node.chars += p.chars
                node.tags += p.tags + 1
                node.link_chars += p.chars if p.name == "a" else p.link_chars
                node.link_tags += p.link_tags + (p.name == "a")
        if node.name == "a":
            node.link_chars = node.chars
    share = root.link_chars / max(1, root.chars)
    for node in reversed(nodes):
        chars, tags, links = node.chars, max(1, node.tags), node.link_chars
        if chars:
            base = math.log(chars / max(1, chars - links) * links + share * chars + math.e)
            node.density = chars / tags * math.log(chars / max(1, links) * tags / max(1, node.link_tags) + 1) / math.log(base + 1)
        else:
            node.density = 0.0
        node.total = sum(p.density for p in node.parts if p.__class__ is Node)
    return nodes


def prune(root: Node) -> None:
    """Leave out the marked nodes that hold what their marks say."""
    if not any(n.mark for n in nodes_of(root)):
        return
    nodes = measure(root)
    scoped: dict[int, int] = {}  # characters of article and main elements, by node
    for node in reversed(nodes):
        below = sum(scoped[id(p)] for p in node.parts if p.__class__ is Node)
        scoped[id(node)] = node.chars if node.name in ("article", "main") else below
    kept = [(root, False)]  # and whether it is in or is an article or main element
    for node, inside in kept:
        for k, p in enumerate(node.parts):
            if p.__class__ is not Node:
                continue
            if p.mark == 2:
                # Long comments may outweigh an article, but not an article's own body.
                outside = 0 if inside else scoped[id(root)] - scoped[id(p)]
                drop = 2 * p.chars <= root.chars or 10 * outside >= p.chars
            else:
                drop = p.mark == 1 and 2 * p.link_chars > p.chars
            if drop:
                node.parts[k] = Node("hr", node) if p.name in BLOCK else " "
            else:
                kept.append((p, inside or p.name in ("article", "main")))


def select(root: Node) -> dict[int, bool]:
    """Nodes to print (True) or to leave out (False), by identity; others follow their parents."""
    nodes = measure(root)
    best = max(nodes, key=lambda n: n.total)  # of equal sums the outermost, first one
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    chosen = {id(root): True}
    inside = {id(n) for n in path[: max((i for i, n in enumerate(path) if n.name in ("article", "main")), default=-1) + 1]}
    for below, above in zip(path, path[1:]):
        for p in above.parts:
            if p.__class__ is Node and p is not below:
                linked = 2 * p.link_chars > p.chars
                chosen[id(p)] = not linked and (id(above) in inside or p.density >= threshold)
    return chosen


def blocks_of(root: Node, chosen: dict[int, bool]) -> list[str]:
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            blocks.append(text)
        line.clear()

    work: list[tuple[Node | str | None]] = [(root,)]
    while work:
        (item,) = work.pop()
        if item is None:
            flush()
        elif item.__class__ is str:
            line.append(item)
        elif chosen.get(id(item), True):
            block = item.name in BLOCK
            if block:
                flush()
                work.append((None,))
            if item.name == "br":
                line.append(" ")
            work += [(p,) for p in reversed(item.parts)]
    flush()
    return blocks


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    prune(root)
    return "\n".join(blocks_of(root, select(root)))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    schema = pa.schema([(id_col, pa.int64()), (url_col, pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = [main_text(page) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                schema=schema,
            )

    return bounded_batches(pages).select(F.col(id_col).cast("long"), F.col(url_col), F.col(html_col)).mapInArrow(
        lean(run), f"`{id_col}` long, `{url_col}` string, text string, n_chars long"
    )
