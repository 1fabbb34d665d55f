"""Main text of web pages by tree scoring.

A page is read into a tree of elements; paragraphs pass points for their length and their commas to
their ancestors (all of it to the parent, less with each further level); an ancestor's points are
discounted by its link density, and weigh a quarter more for an article or main element. The best container
stays, with those of its siblings that score well or read like running text; inside an article any sibling
that is not mostly links, at each level up to it. Menus, page headers, footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments are left out before scoring, by element, role or name: a
negative word in a class or id counts whatever else the name says, also on an article. Lists of nothing but
three or more short links are menus as well.

Text is split into blocks at block elements; character references are decoded; white space inside a
block becomes one space; blocks stand in page order with an empty line between them.

Time is in proportion to a page's length, also for malformed ones: no part of the scanner goes back, and the
places of open elements are kept by name.

Defined results: null or empty html, or a page without text, gives an empty text; unclosed and wrongly
nested tags are repaired as browsers do in the common cases; a quote that never closes ends with the word or
the tag; a tag that the page's end cuts off is dropped; a dropped element that is never closed ends with the
element around it; each row is read alone, so repeated rows
and ids are fine; extra columns are ignored.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One attribute: a name and perhaps a value in quotes or without. A quote that never closes counts as part of
#: a bare value. No part gives back what it took, so that a page is read in time proportional to its length.
ONE = r"""(?>[\s/]*+([^\s/>][^\s/>=]*+)(?>\s*+=\s*+(?>"([^"]*+)"|'([^']*+)'|([^\s>]++))?+)?+)"""
TAG = re.compile(rf"<(/?+)([a-zA-Z][^\s/>]*+)((?>{ONE.replace('([', '(?:[')})*+[\s/]*+)(?:>|\Z)", re.S)
OTHER = re.compile(r"<(?:!--(?:>|->|.*?(?:-->|--!>|\Z))|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*+(?:>|\Z)|/[^a-zA-Z>][^>]*+(?:>|\Z)|/>)", re.S)
ATTRIBUTE = re.compile(ONE, re.S)
SPACE = re.compile(r"\s+")
COMMA = re.compile("[,،、，﹐︑]")

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("head script style noscript template svg math canvas iframe object embed audio video nav footer aside form button input select textarea option label fieldset dialog menu title".split())
#: What a head may hold; anything else ends it.
IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: Elements that end an open <p>.
ENDS_P = BLOCKS - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: An element ends an open one of these names, up to the named container.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
#: Words in names of classes and ids that mark boilerplate, wherever else the name says.
NEGATIVE = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr hidden hide login masthead menu menus modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promos promoted promotion recommendation recommendations recommended related replies reply respond share sharing sidebar signup skiplink social sponsor sponsored sponsors subscribe subscription toolbar widget widgets".split())
#: Names that start so tell what a page has or is about, not what the element is.
ABOUT = frozenset("no not has have with without category cat tag topic layout js supports".split())
#: Names that are a page's header as a whole.
HEADERS = frozenset(("header", "site-header", "page-header", "top-header", "global-header"))
POSITIVE = re.compile(r"article|body|content|entry|main|post|story|text", re.I)
PARTS = re.compile(r"[-_:.\s]+|(?<=[a-z0-9])(?=[A-Z])")
JOINED = re.compile(r"\b(side|pop|sign|skip|log|nav|foot)[-_](bar|up|link|in|er)\b", re.I)
HEADER_INSIDE = frozenset(("article", "main", "section"))
WALLS = frozenset(("article", "main", "table", "div", "section"))
PARAGRAPHS = frozenset("p pre blockquote td li dd h1 h2 h3 h4 h5 h6 div section article".split())


class Node:
    __slots__ = ("name", "attributes", "children", "parent", "score", "chars", "linked", "commas")

    def __init__(self, name: str, attributes: str, parent: Node | None):
        self.name, self.attributes, self.parent = name, attributes, parent
        self.children: list[Node | str] = []
        self.score = 0.0
        self.chars = self.linked = self.commas = 0


def attributes(raw: str) -> dict[str, str]:
    """The first of equal names counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def negative(names: str, inside: bool) -> bool:
    """True if a class or id names boilerplate; ``inside``: in an article, where a header belongs to it."""
    for name in JOINED.sub(r"\1\2", names).split():
        parts = [p.lower() for p in PARTS.split(name) if p]
        if parts and parts[0] not in ABOUT and not NEGATIVE.isdisjoint(parts) or not inside and name.lower() in HEADERS:
            return True
    return False


def boilerplate(name: str, raw: str, inside: bool) -> bool:
    if name in DROPPED or name == "header" and not inside:
        return True
    if not raw:
        return False
    own = attributes(raw)
    if own.get("role", "").lower() in ROLES or "hidden" in own or own.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", own.get("style", "")):
        return True
    return negative(f"{own.get('class', '')} {own.get('id', '')}", inside)


class Open:
    """The open elements, with the places of each name, of the blocks and of those that inline end tags do not cross."""

    def __init__(self, root: Node):
        self.nodes, self.at, self.blocks, self.walls = [root], {}, [0], [0]

    def push(self, node: Node) -> None:
        k = len(self.nodes)
        self.nodes.append(node)
        self.at.setdefault(node.name, []).append(k)
        if node.name in BLOCKS:
            self.blocks.append(k)
            if node.name in WALLS:
                self.walls.append(k)

    def cut(self, k: int) -> None:
        """Closes the element at ``k`` and all inside it."""
        for node in reversed(self.nodes[k:]):
            self.at[node.name].pop()
        del self.nodes[k:]
        for places in (self.blocks, self.walls):
            while places[-1] >= k:
                places.pop()

    def last(self, names) -> int:
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=0)

    def close(self, name: str) -> None:
        k = self.last((name,))
        if k and (name in BLOCKS or self.walls[-1] <= k):
            self.cut(k)

    def end_p(self) -> None:
        k = self.blocks[-1]
        if self.nodes[k].name == "p":
            self.cut(k)


def parse(page: str) -> Node:
    """The tree without its boilerplate subtrees. Text nodes are strings with references decoded."""
    root = Node("html", "", None)
    tree, at, n = Open(root), 0, len(page)
    skip: list[str] = []  # open elements inside a dropped one
    skipped: dict[str, int] = {}

    def unskip(name: str) -> None:
        while True:
            last = skip.pop()
            skipped[last] -= 1
            if last == name:
                return

    while at < n:
        k = page.find("<", at)
        m = None
        while k >= 0:
            m = TAG.match(page, k) or OTHER.match(page, k)
            if m:
                break
            k = page.find("<", k + 1)
        end = k if m else n
        if end > at and not skip:
            tree.nodes[-1].children.append(html.unescape(page[at:end]))
        if not m:
            break
        at = m.end()
        if m.re is OTHER:
            if m[0].startswith("<![CDATA[") and not skip:
                tree.nodes[-1].children.append(m[0][9:].removesuffix("]]>"))
            continue
        if page[at - 1] != ">":
            break  # the page ends inside a tag
        name, raw = m[2].lower(), m[3]
        if m[1]:
            if not skip:
                tree.close(name)
            elif skipped.get(name):
                unskip(name)
            elif tree.at.get(name) and name in BLOCKS and name != "p":
                skip.clear(), skipped.clear()  # the dropped element was never closed
                tree.close(name)
            continue
        alone = raw.endswith("/")
        if name in RAW:
            close = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            if not skip and name not in DROPPED:
                text = page[at : close.start() if close else n]
                tree.nodes[-1].children.append(html.unescape(text) if name in ("textarea", "title") else text)
            at = close.start() if close else n
            skipped_end = page.find(">", at) if close else -1
            at = skipped_end + 1 if skipped_end >= 0 else n
            continue
        if skip == ["head"] and name not in IN_HEAD:
            skip.clear(), skipped.clear()
        if skip:
            if name not in VOID and not alone:
                if name in ("p", "li") and skip[-1] == name and len(skip) > 1:
                    unskip(name)
                skip.append(name)
                skipped[name] = skipped.get(name, 0) + 1
            continue
        if name in ("html", "body"):
            continue
        if name in ENDS_P:
            tree.end_p()
        if name in ENDS:
            closes, within = ENDS[name]
            k = tree.last(closes)
            if k and k > tree.last(within):
                tree.cut(k)
        if name in VOID:
            if name in BLOCKS:
                tree.nodes[-1].children.append(Node(name, "", tree.nodes[-1]))
            continue
        if boilerplate(name, raw.rstrip("/"), bool(tree.last(HEADER_INSIDE))):
            tree.nodes[-1].children.append(Node("br" if name in BLOCKS else "span", "", tree.nodes[-1]))
            if not alone:
                skip.append(name)
                skipped[name] = 1
            continue
        node = Node(name, raw, tree.nodes[-1])
        tree.nodes[-1].children.append(node)
        tree.push(node)
    return root


def score(root: Node) -> list[Node]:
    """Fills in text sizes and points; returns the containers that got points."""
    order: list[tuple[Node, bool]] = []
    todo: list[tuple[Node, bool]] = [(root, False)]
    while todo:
        node, link = todo.pop()
        link = link or node.name == "a"
        order.append((node, link))
        todo += [(c, link) for c in node.children if isinstance(c, Node)]
    got: dict[int, Node] = {}
    for node, link in reversed(order):
        own = own_commas = 0
        for c in node.children:
            if isinstance(c, str):
                size = len(SPACE.sub(" ", c).strip())
                own += size
                own_commas += len(COMMA.findall(c))
                if link:
                    node.linked += size
        node.chars += own
        node.commas += own_commas
        inline = own and node.name in PARAGRAPHS or node.name in ("p", "pre", "blockquote") and node.chars
        if inline:
            # a paragraph's size counts its inline parts, and no nested paragraphs' parts twice
            size, commas = (node.chars, node.commas) if node.name in ("p", "pre", "blockquote") else (own, own_commas)
            points = 1 + commas + min(size / 100, 3) + size / 1000
            up, level = node.parent or node, 0
            while up is not None and level < 5:
                up.score += points / (1, 2, 6, 9, 12)[level]
                got[id(up)] = up
                up, level = up.parent, level + 1
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.commas += node.commas
            node.parent.linked += node.linked
    for node in got.values():
        node.score *= 1 - density(node)
        if node.name in ("article", "main"):
            node.score *= 1.25
        elif node.attributes and POSITIVE.search(node.attributes):
            node.score *= 1.1
    return [*got.values()]


def density(node: Node) -> float:
    return min(1.0, node.linked / node.chars) if node.chars else 0.0


def menu(node: Node) -> bool:
    """A list of at least three short links and nothing else."""
    if node.name not in ("ul", "ol") or not node.chars or node.linked < node.chars:
        return False
    entries = sum(isinstance(c, Node) and c.name == "li" and c.chars > 0 for c in node.children)
    return entries >= 3 and node.chars <= 25 * entries


def belongs(node: Node, least: float, article: bool) -> bool:
    """Whether a sibling of the best container is part of the text."""
    if not node.chars or density(node) >= 0.5 or menu(node):
        return False
    if article or node.score >= least:
        return True
    if density(node) >= 0.25:
        return False
    if node.name in ("p", "blockquote", "pre"):
        return node.chars > 80 or node.commas > 0
    return node.name in ("h1", "h2", "h3") or node.chars > 250


def chosen(root: Node) -> list[Node]:
    """The best container and its siblings that belong to the text; inside an article, level by level up to it."""
    best = max(score(root), key=lambda n: n.score, default=None)
    if best is None or best.parent is None:
        return [root]
    least = max(10.0, best.score * 0.2)
    if best.name in ("article", "main"):
        return [n for n in best.parent.children if n is best or isinstance(n, Node) and n.name == best.name and n.score >= least and density(n) < 0.5]
    path, up = [best], best.parent
    while up is not None and up.name not in ("article", "main"):
        path.append(up)
        up = up.parent
    inside = up is not None
    out = [best]
    for at in path if inside else path[:1]:
        children = at.parent.children
        place = next(i for i, c in enumerate(children) if c is at)
        left, right = ([c for c in part if isinstance(c, Node) and belongs(c, least, inside)] for part in (children[:place], children[place + 1 :]))
        out = [*left, *out, *right]
    return out


def blocks(nodes: list[Node]) -> list[str]:
    out: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        if text := SPACE.sub(" ", "".join(parts)).strip():
            out.append(text)
        parts.clear()

    todo: list[Node | str | None] = [*reversed(nodes)]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            parts.append(x)
        elif x.name in BLOCKS:
            if menu(x):
                continue
            flush()
            todo.append(None)
            todo += reversed(x.children)
        else:
            todo += reversed(x.children)
    flush()
    return out


def main_text(page: str | None) -> str:
    return "\n\n".join(blocks(chosen(parse(page)))) if page else ""


def _main_texts(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(x) for x in pages.to_pylist()], pa.string())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points). One pass over the pages, no shuffle."""
    text = F.arrow_udf(_main_texts, "string")
    return pages.select("page_id", "url", text(F.col("html").cast("string")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
